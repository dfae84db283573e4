"""MinHash near-dedup with min-max hashing.

Each permutation is evaluated once per shingle and gives two signature values, its minimum and its
maximum over the document's set, so ``bands * rows`` values cost half as many hash evaluations.
Bands of ``rows`` values bucket the documents. Candidates are verified on full shingle sets, and
the confirmed links are contracted to components.

Work never squares with a group of copies: documents with one and the same set collapse to a
representative; a bucket then links its members to a hub, twice with different hubs; members that
are still in different components are compared in blocks, inside tasks. Where these are many, they meet
on a shingle that sets this similar must share instead: one of the rarest of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: With 40 bands of 5 values a pair at similarity 0.8 is missed with probability 1.3e-7.
BANDS, ROWS = 40, 5
#: Members of a bucket that are compared with as many others at once.
BLOCK = 512
#: Members outside a bucket's largest component from which they meet by rare shingles instead.
SPLIT = 4096
#: Ids of documents up to which they are broadcast (about 120 MB); more are met by a shuffle join.
BROADCAST_IDS = 1_000_000
#: Words whose hashes a worker remembers at once.
_WORDS_KEPT = 400_000
_U = np.uint64


class _WordHashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingle_hashes(text: str | None, k: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter text is one shingle.

    Words are runs of anything but ASCII white space, with A-Z in lower case.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(memo.__getitem__, words), _U, len(words))
    width = min(k, len(h))
    n = len(h) - width + 1
    acc = np.full(n, width, _U)
    for i in range(width):
        acc = _mix(acc + h[i : i + n])
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


def _permutations(count: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, dtype=_U) * _U(2) + _U(1), rng.integers(0, 2**63, count, dtype=_U)


def min_max_signature(hashes: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minima of all permutations, then their maxima."""
    low = np.full(len(mult), 2**64 - 1, _U)
    high = np.zeros(len(mult), _U)
    for i in range(0, len(hashes), 512):
        v = mult[:, None] * hashes[None, i : i + 512] + add[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.concatenate([low, high])


def _signer(k: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = _permutations(-(-bands * rows // 2))
        deal = np.random.default_rng(21).permutation(2 * len(mult))[: bands * rows]
        memo = _WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            keys, sizes, keyed = [], [], []
            for t in texts:
                hashes = shingle_hashes(t.as_py(), k, memo)
                sizes.append(len(hashes))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                acc = np.arange(1, bands + 1, dtype=_U)
                if len(hashes):
                    sig = min_max_signature(hashes, mult, add)[deal].reshape(bands, rows)
                    for j in range(rows):
                        acc = _mix(acc + sig[:, j])
                keyed.append(acc.view(np.int64))
            flat = np.concatenate(keyed) if keyed else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(flat))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n_shingles", "set_key", "bands"])

    return sign


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            got = [shingle_hashes(t.as_py(), k, memo).view(np.int64) for t in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            flat = np.concatenate(got) if got else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["rep", "hashes"])

    return sets


def verified(scratch: Scratch, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b").join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a")
    same = F.size(F.array_intersect("ha", "hb"))
    return scratch.save(both.where(100 * same >= percent * (F.size("ha") + F.size("hb") - same)).select("a", "b"), "links")


def _shares(group: dict[str, list], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of different components of one block, or of its two sides, whose hashed sets overlap enough."""
    sets = group["hashes"]
    n = np.array([len(x) for x in sets])
    # Shingles of one set with one short hash; as many more could be shared.
    lost = np.array([int((x[1:] == x[:-1]).sum()) for x in sets])
    rep, part, main = np.array(group["rep"]), np.array(group["component"]), np.array(group["main"])
    left, right = np.flatnonzero(main), np.flatnonzero(~main)
    if not group["across"][0]:
        left = np.arange(len(sets))
    if not group["within"][0] and group["across"][0]:
        sides = (left, right)
    else:
        sides = (np.arange(len(sets)), right if len(right) else np.arange(len(sets)))
    left, right = sides
    if not len(left) or not len(right):
        return
    hashes = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    words, word = np.unique(hashes, return_inverse=True)
    both = np.bincount(word, minlength=len(words)) > 1
    place = np.cumsum(both) - 1
    keep = both[word]
    word, owner = place[word[keep]], owner[keep]
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    on_left, on_right = np.full(len(sets), -1), np.full(len(sets), -1)
    on_left[left], on_right[right] = np.arange(len(left)), np.arange(len(right))
    same = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(both.sum()), 4096):
        a, b = np.searchsorted(word, (lo, lo + 4096))
        w, o = word[a:b] - lo, owner[a:b]
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        x[on_left[o[on_left[o] >= 0]], w[on_left[o] >= 0]] = 1
        y[on_right[o[on_right[o] >= 0]], w[on_right[o] >= 0]] = 1
        same += x @ y.T
    same += np.minimum(lost[left][:, None], lost[right][None, :])
    good = 100 * same >= percent * (n[left][:, None] + n[right][None, :] - same)
    good &= part[left][:, None] != part[right][None, :]
    for i, j in zip(*np.nonzero(good), strict=True):
        yield int(rep[left[i]]), int(rep[right[j]])


def _compared(percent: int):
    names = ("bucket", "i", "j", "rep", "component", "main", "across", "within")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, None
        done: set[tuple[int, int]] = set()

        def emit() -> pa.RecordBatch:
            rows = [(min(p), max(p)) for p in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column("hashes")
            values, ends = lists.values.to_numpy().view(np.uint32), lists.offsets.to_numpy()
            # Copies, so that no batch is held for a few of its rows.
            hashes = [values[a:b].copy() for a, b in zip(ends, ends[1:], strict=False)]
            for row in zip(*(batch.column(c).to_pylist() for c in names), hashes, strict=True):
                if row[:3] != key:
                    if group:
                        done.update(_shares(group, percent))
                    key, group = row[:3], {c: [] for c in (*names[3:], "hashes")}
                for c, v in zip(group, row[3:], strict=True):
                    group[c].append(v)
            if len(done) > 10_000:
                yield emit()
        if group:
            done.update(_shares(group, percent))
        yield emit()

    return run


def _mixed(placed: DataFrame) -> DataFrame:
    """Buckets with several components: bucket, main (the largest one), n_main, n_others."""
    sizes = placed.groupBy("bucket", "component").count()
    main = sizes.groupBy("bucket").agg(F.max(F.struct(F.col("count").alias("n_main"), F.col("component").alias("main"))).alias("m"), F.sum("count").alias("n_all"))
    return main.where("m.n_main < n_all").select("bucket", "m.main", "m.n_main", (F.col("n_all") - F.col("m.n_main")).alias("n_others"))


def rare_shingles(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``members(rep, n, component)`` by the shingles on which those similar enough must meet: bucket, rep, n, component.

    Of sets of a and b shingles with a similarity of t, each has no more than (1 - t) of its own that the other
    lacks. So among the first ``n - t * n + 1`` of either, in any one order of all shingles, one is common. In the
    order of how many members have them these are the rarest: sets of which more than (1 - t) is their own share
    none. Members of a family just below t still meet each other. Sizes that differ by more than t allows stay
    apart: a size has its class and the one above, whose bounds grow by 1 / t.
    """
    # Rows that share an id have a set each.
    own = sets.select("rep", F.size("hashes").cast("long").alias("n"), F.xxhash64("hashes").alias("set"), "hashes")
    each = members.select("rep", "component").distinct().join(own, "rep").select("rep", "set", "n", "component", F.explode("hashes").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count("*").alias("members"))
    rank = F.row_number().over(Window.partitionBy("rep", "set").orderBy("members", "shingle"))
    needed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = each.join(counts, "shingle").withColumn("rank", rank).where((F.col("rank") <= needed) & (F.col("members") > 1))
    # A little wider, so that rounding of the logarithm parts no sizes that fit.
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) + 1e-9)).cast("int")
    sized = first.select("shingle", "rep", "n", "component", F.explode(F.array(size, size + 1)).alias("size"))
    return sized.select(F.xxhash64("shingle", "size").alias("bucket"), "rep", "n", "component").distinct()


def screened(scratch: Scratch, sets: DataFrame, placed: DataFrame, percent: int, split: int | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of ``placed(bucket, rep, n, component)`` that share a bucket, lie in different
    components and, on 32-bit shingle hashes, are similar enough.

    Equal shingles have equal short hashes, so no similar pair is lost; the few that are too many
    fail the full verification. A bucket's largest component and its other members are dealt to
    blocks, and every block of the one meets every block of the other: no pair becomes a row.

    Rows grow with the square of the other members over ``BLOCK``. Where these are more than ``split``,
    the bucket's members meet by ``rare_shingles`` instead, which loses no similar pair either.
    """
    main = scratch.save(_mixed(placed), "mixed")
    crowded = main.where(F.col("n_others") > (split or SPLIT)).select("bucket")
    if not crowded.isEmpty():
        members = placed.join(crowded, "bucket", "left_semi").select("rep", "n", "component").distinct()
        again = scratch.save(rare_shingles(sets, members, percent), "again")
        main = scratch.save(main.join(crowded, "bucket", "left_anti").unionByName(_mixed(again)), "mixed")
        placed = placed.unionByName(again.select(*placed.columns))
    main = main.select("bucket", "main", F.ceil(F.col("n_main") / BLOCK).cast("int").alias("mains"), F.ceil(F.col("n_others") / BLOCK).cast("int").alias("others"))
    rows = placed.join(main, "bucket").withColumn("is_main", F.col("component") == F.col("main"))
    own = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    every = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    across = F.when(F.col("is_main"), F.transform(every("others"), lambda j: F.struct(own("mains").alias("i"), j.alias("j"), F.lit(True).alias("across"))))
    across = across.otherwise(F.transform(every("mains"), lambda i: F.struct(i.alias("i"), own("others").alias("j"), F.lit(True).alias("across"))))
    # Where the other members fill several blocks, these meet each other in blocks of their own.
    apart = F.transform(every("others"), lambda j: F.struct((-1 - F.least(j, own("others"))).alias("i"), F.greatest(j, own("others")).alias("j"), F.lit(False).alias("across")))
    places = F.when(F.col("is_main") | (F.col("others") == 1), across).otherwise(F.concat(across, apart))
    dealt = rows.select("bucket", "rep", "component", F.col("is_main").alias("main"), (F.col("others") == 1).alias("single"), F.inline(places))
    dealt = dealt.select("bucket", "i", "j", "rep", "component", "main", "across", (F.col("single") & (F.col("i") == 0)).alias("within"))
    short = sets.select("rep", F.transform("hashes", lambda h: F.shiftright(h, 32).cast("int")).alias("hashes"))
    met = dealt.join(short, "rep").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return met.mapInArrow(_compared(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked when their sets of distinct k-word shingles have a Jaccard similarity
    of at least ``percent`` hundredths. ``component_id`` is the smallest id reachable over links,
    ``kept`` says that it is the document's own. Null, empty and blank texts have no shingles and
    no links. Rows that share one id count as one document with several texts. A row without an id
    is kept, has no component and takes part in no link. Texts of any length are read whole, into
    their set of hashes. Further columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.save(plain.mapInArrow(_signer(k, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signed")
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    # Equal sets: one representative.
    sets = scratch.save(linked.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "sets")
    reps = linked.join(sets.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    # A smaller set than this has no similar set but its equals.
    reps = reps.where((100 - percent) * F.col("n_shingles") >= percent)
    buckets = scratch.save(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")).distinct(), "buckets")
    shared = scratch.save(buckets.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("bucket"), "shared")
    members = scratch.save(buckets.join(shared, "bucket"), "members")
    scratch.drop(buckets, shared)
    # Rows that share one id and differ in text stand for one document: its texts are united below.
    texts = plain.select(F.col("doc_id").alias("rep"), "text").where("rep is not null")
    # Sets of all documents that share a bucket. Their ids go to the texts; only where they are too
    # many, the texts are shuffled to meet them.
    needed = scratch.save(members.select("rep").distinct(), "needed")
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    full = scratch.save(texts.join(needed, "rep", "left_semi").mapInArrow(_sets(k), "rep long, hashes array<long>"), "full-sets")

    fits = (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")) & (F.col("rep") != F.col("hub"))
    links = parts = None
    for seed in (None, 1):
        by = F.col("rep") if seed is None else F.xxhash64("rep", F.lit(seed))
        now = members if parts is None else members.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        group = F.lit(0).cast("long") if parts is None else F.col("component")
        hubs = now.groupBy("bucket").agg(F.min(F.struct(by.alias("by"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"), group.alias("hub_part"))).alias("h"), F.min(group).alias("low"), F.max(group).alias("high"))
        if parts is not None:
            hubs = hubs.where("low < high")
        hubs = scratch.save(hubs.select("bucket", "h.hub", "h.hub_n", "h.hub_part"), "hubs")
        pairs = now.join(hubs, "bucket").where(fits)
        if parts is not None:
            pairs = pairs.where(group != F.col("hub_part"))
        pairs = scratch.save(pairs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "pairs")
        found = verified(scratch, full, pairs, percent)
        if parts is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            parts = scratch.save(connected_components(scratch, links), "parts")
    # What is left: members of one bucket in different components, compared in blocks.
    now = members.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rest = scratch.save(screened(scratch, full, scratch.save(now, "placed"), percent), "rest")
    more = not rest.isEmpty()
    if more:
        links = links.unionByName(verified(scratch, full, rest, percent))
    # Rows with one id and several sets tie their representatives together.
    ties = linked.join(sets, "set_key").where("doc_id <> rep").groupBy("doc_id", "rep").count().select(F.col("doc_id").alias("b"), F.col("rep").alias("a"))
    own = linked.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high").select("doc_id")
    repeated = own.limit(1).count() > 0
    if repeated:
        links = links.unionByName(ties.join(own, ties["b"] == own["doc_id"], "left_semi").select("a", "b"))
    if more or repeated:
        parts = scratch.save(connected_components(scratch, links), "parts")
    named = sets.join(parts, sets["rep"] == parts["node"], "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    named = scratch.save(named, "named")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` of which each group of near duplicates keeps one, with all their columns.

    Rows without words or without an id all stay, and so do repeated rows of a kept id. An empty table
    gives an empty result.
    """
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    kept = Scratch(docs.sparkSession, "near-kept").save(kept, "kept")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_row_id"))
    return rows.join(kept, F.col("_row_id").eqNullSafe(F.col("_kept_id")), "left_semi").select("_row.*")
