"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes when a ``length``-byte string that covers it also starts earlier.

1. *Anchors.* The leftmost smallest ``gram``-byte hash in a window of ``length`` bytes is its anchor;
   equal windows have equal anchors. A run is the stretch of windows that share an anchor. Windows
   whose anchor occurs once can't repeat and are left out.
2. *Hot anchors.* A passage in many documents has, at its edges, a different run in each of them. Runs
   of such anchors are cut into pairs of neighbouring windows, dealt by the bytes that both windows
   have. Only two bytes of a pair are outside these, so a group has at most 65,536 different runs,
   however many documents there are.
3. *Whole runs.* Of runs with one anchor and equal bytes, all but the first repeat as a whole. Copies
   within a map task collapse before the shuffle, so a passage in a third of all documents costs one
   record a task. Runs count as equal on 128 bits of two independent hashes: of 10^13 runs, two
   different ones agree with a probability of about 10^-13.
4. *Merge.* The first occurrences of the different runs of an anchor meet in one task. Shards of them
   get suffix arrays and Burrows-Wheeler transforms; the transforms are merged by refining their
   interleaving, two bytes a round, until it is in order to ``length`` bytes. Its blocks are the
   repeated intervals; in each, all but the earliest start repeat.

Records travel as column blobs, so Spark moves bytes by target and Python works on arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LENGTH, GRAM = 100, 40
#: Bytes of text hashed at once, bytes after which a text is cut, runs collapsed at once, bytes of a shard's text, bytes of text a target has.
BATCH_BYTES, PIECE_BYTES, FLUSH_RUNS, SHARD_BYTES, TARGET_BYTES = 1 << 18, 4 << 20, 1_500_000, 1 << 18, 4 << 20
#: Different runs from which an anchor is hot, as told from one document in ``SAMPLE``; most anchors that are taken for hot (8 MB).
#: The sample decides how runs are dealt, never what is removed.
HOT_RUNS, SAMPLE, MOST_HOT = 4096, 64, 1_000_000
_U = np.uint64
_LAST, _NULL_TIE = 2**63 - 1, 2**62
_BASE = 0x5851F42D4C957F2D
#: A byte that no UTF-8 text holds.
_GAP = 255

RUN = np.dtype([("anchor", "<u8"), ("run", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("lo", "<i4"), ("extra", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("lo", "<i4"), ("extra", "<i4")])
FLAG, HEAD = 0, 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * _U(base)
        done, base = 2 * done, base * base % 2**64
    return out


class Hasher:
    """Anchors and runs of documents, by hashes of any substring from prefix sums."""

    def __init__(self, length: int, gram: int, hot: np.ndarray | None = None):
        self.length, self.gram = length, gram
        self.hot = np.sort(hot) if hot is not None else np.empty(0, _U)
        self.values = np.random.default_rng(3).integers(1, 2**63, (2, 256), dtype=_U) * _U(2) + _U(1)
        self.up = self.down = np.empty(0, _U)

    def runs(self, docs: list[bytes]) -> np.ndarray:
        """Records of the documents' runs; ``doc`` is the number in the list, ``tie`` is 0."""
        length, gram = self.length, self.gram
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        buf = np.frombuffer(b"".join(docs), np.uint8)
        n = len(buf)
        if n < length:
            return np.empty(0, RUN)
        if len(self.up) <= n:
            self.up, self.down = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 2**64), n + 1)
        sums = np.zeros((2, n + 1), _U)
        for values, out in zip(self.values, sums, strict=True):
            np.cumsum(values[buf] * self.up[:n], out=out[1:])
        h = _mix((sums[0, gram:] - sums[0, :-gram]) * self.down[: n - gram + 1])
        # The low bits hold the position, so the smallest key is the leftmost smallest hash.
        low = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
        wide, step = length - gram + 1, 1
        while 2 * step <= wide:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if wide - step:
            low = np.minimum(low[: len(low) - wide + step], low[wide - step :])
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(docs)), sizes)[: len(low)]
        at = np.flatnonzero(np.arange(len(low)) + length <= ends[doc])
        if not len(at):
            return np.empty(0, RUN)
        place, doc = (low[at] & _U(0xFFFFFFFF)).astype(np.int64), doc[at]
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        lo, hi, place, doc = at[first], at[last], place[first], doc[first]
        anchor = h[place]
        if len(self.hot):
            hot = self.hot[np.minimum(np.searchsorted(self.hot, anchor), len(self.hot) - 1)] == anchor
            if hot.any():
                parts = self._pairs(lo[hot], hi[hot], place[hot], doc[hot], anchor[hot], sums[0])
                lo, hi, place, doc, anchor = (np.concatenate([a[~hot], b]) for a, b in zip((lo, hi, place, doc, anchor), parts, strict=True))
        out = np.zeros(len(lo), RUN)
        shape = (place - lo).astype(_U) * _U(0x9E3779B97F4A7C15) + (hi - lo).astype(_U) * _U(0xC2B2AE3D27D4EB4F)
        for name, one in zip(("run", "check"), sums, strict=True):
            out[name] = _mix((one[hi + length] - one[lo]) * self.down[lo] + shape)
        out["doc"], out["anchor"], out["lo"], out["extra"] = doc, anchor, lo - (ends - sizes)[doc], hi - lo
        return out

    def _pairs(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, doc: np.ndarray, anchor: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs cut into pairs of windows, with the bytes that both windows have as their anchor.

        Pairs are counted from the anchor backwards, so equal windows are in pairs of one number.
        """
        from_, to = (place - hi) // 2, (place - lo) // 2
        n = to - from_ + 1
        of = np.repeat(np.arange(len(n)), n)
        pair = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + from_[of]
        place, doc, anchor = place[of], doc[of], anchor[of]
        core = place - 2 * pair
        shared = (sums[core + self.length - 1] - sums[core]) * self.down[core]
        key = _mix(_mix(shared) + anchor * _U(0x9E3779B97F4A7C15) + pair.astype(_U))
        return np.maximum(core - 1, lo[of]), np.minimum(core, hi[of]), place, doc, key


def _packed(records: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(records[c]).tobytes() for c in records.dtype.names)


def _unpacked(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    parts = []
    for blob in blobs:
        n = len(blob) // dtype.itemsize
        part, at = np.empty(n, dtype), 0
        for c in dtype.names:
            part[c] = np.frombuffer(blob, dtype[c], n, at)
            at += n * dtype[c].itemsize
        parts.append(part)
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def _spans(records: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), SPAN)
    for c in SPAN.names:
        out[c] = records[c]
    return out


def _dealt(records: np.ndarray, by: np.ndarray, targets: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(kind, target, blob) of the records dealt out by a hash."""
    if not len(records):
        return
    target = (_mix(by.astype(_U) + _U(kind)) % _U(targets)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    cuts = np.searchsorted(target[order], np.arange(targets + 1))
    for t in np.flatnonzero(np.diff(cuts)):
        yield kind, int(t), _packed(records[order[cuts[t] : cuts[t + 1]]])


def _doc_target(ids: np.ndarray, ties: np.ndarray, targets: int) -> np.ndarray:
    return (_mix(ids.astype(_U) * _U(0x9E3779B97F4A7C15) + ties.astype(_U)) % _U(targets)).astype(np.int64)


def _dealt_by_doc(records: np.ndarray, targets: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    if not len(records):
        return
    target = _doc_target(records["doc"], records["tie"], targets)
    order = np.argsort(target, kind="stable")
    cuts = np.searchsorted(target[order], np.arange(targets + 1))
    for t in np.flatnonzero(np.diff(cuts)):
        yield kind, int(t), _packed(records[order[cuts[t] : cuts[t + 1]]])


BLOBS = "kind int, target int, blob binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "target", "blob"])


def _first_of(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by anchor and run, then place; a mark at the first of each run."""
    doc, tie, lo = (records[c] for c in ("doc", "tie", "lo"))
    later = (doc[1:] > doc[:-1]) | (doc[1:] == doc[:-1]) & ((tie[1:] > tie[:-1]) | (tie[1:] == tie[:-1]) & (lo[1:] > lo[:-1]))
    if not later.all():
        records = records[np.lexsort((lo, tie, doc))]
    # Runs stay in the order of their places, since the sort is stable.
    order = np.lexsort((_mix(records["run"] + records["check"] * _U(0xC2B2AE3D27D4EB4F)), records["anchor"]))
    got = records[order]
    new = np.ones(len(got), bool)
    new[1:] = (got["anchor"][1:] != got["anchor"][:-1]) | (got["run"][1:] != got["run"][:-1]) | (got["check"][1:] != got["check"][:-1])
    return got, new


def _sampled(length: int, gram: int):
    """Distinct (anchor, run) of a task's documents, and their bytes in rows without anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, size = Hasher(length, gram), 0
        for batch in batches:
            for _, texts in _pieces([x.as_py() for x in batch.column(0)], length):
                got = hasher.runs(texts)
                _, one = np.unique(_mix(got["anchor"] + got["run"] * _U(0x9E3779B97F4A7C15)), return_index=True)
                size += sum(map(len, texts))
                yield pa.RecordBatch.from_arrays([pa.array(got[c][one].view(np.int64)) for c in ("anchor", "run")], ["anchor", "run"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([size], pa.int64())], ["anchor", "run"])

    return run


def _pieces(texts: Iterable[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Lists of texts of about ``BATCH_BYTES``, with each one's (number, offset): longer ones in pieces that share no window."""
    where, out, size = [], [], 0
    for i, raw in enumerate(texts):
        for lo in range(0, len(raw) - length + 1, PIECE_BYTES):
            out.append(raw if len(raw) <= PIECE_BYTES else raw[lo : lo + PIECE_BYTES + length - 1])
            where.append((i, lo))
            size += len(out[-1])
            if size >= BATCH_BYTES:
                yield where, out
                where, out, size = [], [], 0
    if out:
        yield where, out


def surveyed(scratch: Scratch, texts: DataFrame, length: int, gram: int, hot_runs: int, sample: int) -> tuple[np.ndarray, int]:
    """Hot anchors and the corpus' bytes, from one document in ``sample``, chosen by a hash of its id."""
    some = texts.where(F.pmod(F.xxhash64("doc", "tie"), F.lit(sample)) == 0).select("text")
    pairs = scratch.save(some.mapInArrow(_sampled(length, gram), "anchor long, run long"), "sampled")
    n, size = pairs.agg(F.count("anchor"), F.sum(F.when(F.col("anchor").isNull(), F.col("run")))).first()
    least = max(2, hot_runs // sample, -(-n // MOST_HOT))
    # At most MOST_HOT anchors have so many of the pairs.
    hot = pairs.where("anchor is not null").distinct().groupBy("anchor").count().where(F.col("count") >= least).select("anchor").toArrow()
    return hot.column("anchor").to_numpy().view(_U), (size or 0) * sample


def _anchored(length: int, gram: int, targets: int, hot: np.ndarray):
    """Runs of a task's documents: one of equal ones goes on as a head, the others are flagged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(length, gram, hot)
        held: list[np.ndarray] = []
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                got, new = _first_of(np.concatenate(held))
                yield _batch([*_dealt(got[new], got["anchor"][new], targets, HEAD), *_dealt_by_doc(_joined(_spans(got[~new])), targets, FLAG)])

        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for where, texts in _pieces((x.as_py() for x in batch.column(2)), length):
                got = hasher.runs(texts)
                number, offset = np.array(where).T[:, got["doc"]]
                got["doc"], got["tie"] = ids[number], ties[number]
                got["lo"] += offset
                held.append(got)
                n_held += len(got)
            if n_held >= FLUSH_RUNS:
                yield from flush()
                held, n_held = [], 0
        yield from flush()

    return run


def _met(targets: int):
    """Runs of all tasks by anchor: flags of repeated ones, heads of those that differ."""

    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        blobs = group.column("blob").to_pylist()
        rows = [(FLAG, group.column("target")[0].as_py(), b) for k, b in zip(kinds, blobs, strict=True) if k == FLAG]
        records = _unpacked([b for k, b in zip(kinds, blobs, strict=True) if k == HEAD], RUN)
        if len(records):
            got, new = _first_of(records)
            rows += _dealt_by_doc(_joined(_spans(got[~new])), targets, FLAG)
            got = got[new]
            fresh = np.concatenate([[True], got["anchor"][1:] != got["anchor"][:-1]])
            group_of = np.cumsum(fresh) - 1
            got = got[np.bincount(group_of)[group_of] > 1]
            rows += _dealt_by_doc(got, targets, HEAD)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _with_text(length: int, targets: int):
    """Heads met with their documents: (anchor's target, records, the runs' bytes in order)."""

    def run(docs: pa.Table, heads: pa.Table) -> pa.Table:
        records = _unpacked(heads.column("blob").to_pylist(), RUN)
        rows: dict[str, list] = {"target": [], "blob": [], "bytes": []}
        if len(records):
            records = records[np.lexsort((records["tie"], records["doc"]))]
            where = {(i, t): k for k, (i, t) in enumerate(zip(docs.column("doc").to_pylist(), docs.column("tie").to_pylist(), strict=True))}
            texts = docs.column("text")
            new = np.flatnonzero(np.concatenate([[True], (records["doc"][1:] != records["doc"][:-1]) | (records["tie"][1:] != records["tie"][:-1])]))
            pieces: list[bytes] = []
            for a, b in zip(new, [*new[1:], len(records)], strict=True):
                raw = texts[where[int(records["doc"][a]), int(records["tie"][a])]].as_py()
                lo = records["lo"][a:b].tolist()
                pieces += [raw[x : x + length + e] for x, e in zip(lo, records["extra"][a:b].tolist(), strict=True)]
            target = (_mix(records["anchor"] + _U(HEAD)) % _U(targets)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            cuts = np.searchsorted(target[order], np.arange(targets + 1))
            for t in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[t] : cuts[t + 1]]
                rows["target"].append(int(t))
                rows["blob"].append(_packed(records[own]))
                rows["bytes"].append(b"".join(pieces[i] for i in own))
        return pa.table({"target": pa.array(rows["target"], pa.int32()), "blob": pa.array(rows["blob"], pa.binary()), "bytes": pa.array(rows["bytes"], pa.binary())})

    return run


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the rotations of ``text``, in order of their first ``depth`` bytes at least."""
    n = len(text)
    key = np.zeros(n, _U)
    doubled = np.concatenate([text, text[: min(8, n)]] if n >= 8 else [np.resize(text, n + 8)])
    for i in range(8):
        key = (key << _U(8)) | doubled[i : i + n].astype(_U)
    order = np.argsort(key, kind="stable")
    starts = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    done = 8
    while done < depth:
        # Only places whose rank is shared are sorted again, by the rank `done` bytes on.
        alone = starts & np.concatenate([starts[1:], [True]])
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        own = order[at]
        pair = (rank[own].astype(_U) << _U(32)) | rank[(own + done) % n].astype(_U)
        by = np.argsort(pair, kind="stable")
        own, pair = own[by], pair[by]
        order[at] = own
        starts[at] = np.concatenate([[True], pair[1:] != pair[:-1]])
        place = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        rank[own] = place[at]
        done *= 2
    return order


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform on pairs: the two bytes before each rotation, as one symbol."""
    n = len(text)
    return (text[(order - 2) % n].astype(np.uint16) << np.uint16(8)) | text[(order - 1) % n]


def merged(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shard transforms: which shard each place of the merged order takes its next row from,
    and the block of each place; rows of a block agree on ``depth`` bytes or more.

    Every round extends the prefix to which the interleaving is in order by one symbol: read the
    shards' symbols along it, and deal it stably by symbol. No suffix is looked at again. A block
    splits where the symbols or the old blocks of its rows differ.
    """
    symbols = np.concatenate(transforms)
    n = len(symbols)
    kind = np.uint8 if len(transforms) <= 256 else np.uint16
    shard = np.repeat(np.arange(len(transforms), dtype=kind), [len(t) for t in transforms])
    block = np.zeros(n, np.int32)
    read = np.empty(n, np.uint16)
    for _ in range(-(-depth // 2)):
        read[np.argsort(shard, kind="stable")] = symbols
        deal = np.argsort(read, kind="stable")
        shard, block, sorted_ = shard[deal], block[deal], read[deal]
        split = (sorted_[1:] != sorted_[:-1]) | (block[1:] != block[:-1])
        block = np.concatenate([[0], np.cumsum(split, dtype=np.int32)]).astype(np.int32)
    return shard, block


def _repeats(length: int, targets: int):
    """Starts that repeat among the heads of a target, by merged transforms, as flags."""

    def run(group: pa.Table) -> pa.Table:
        records = _unpacked(group.column("blob").to_pylist(), RUN)
        raw = np.frombuffer(b"".join(group.column("bytes").to_pylist()), np.uint8)
        width = records["extra"].astype(np.int64) + length
        # Every run is followed by a gap, and shards end with whole runs.
        begin = np.concatenate([[0], np.cumsum(width + 1)])
        text = np.full(begin[-1], _GAP, np.uint8)
        text[np.arange(len(raw)) + np.repeat(np.arange(len(records)), width)] = raw
        cuts = [0]
        while cuts[-1] < len(records):
            cuts.append(int(max(cuts[-1] + 1, np.searchsorted(begin, begin[cuts[-1]] + SHARD_BYTES, "right") - 1)))
        ends = [begin[c] for c in cuts]
        orders, transforms = [], []
        for a, b in zip(ends, ends[1:], strict=False):
            order = suffix_array(text[a:b], length)
            transforms.append(transform(text[a:b], order))
            orders.append(order + a)
        shard, block = merged(transforms, length)
        place = np.empty(len(text), np.int64)
        place[np.argsort(shard, kind="stable")] = np.concatenate(orders)
        # Only starts of whole windows count, and only blocks that have several of them.
        of = np.searchsorted(begin, place, "right") - 1
        offset = place - begin[of]
        whole = offset <= records["extra"][of]
        of, offset, block = of[whole], offset[whole], block[whole]
        several = np.bincount(block, minlength=1)[block] > 1
        of, offset, block = of[several], offset[several], block[several]
        spans = np.empty(len(of), SPAN)
        spans["doc"], spans["tie"], spans["lo"], spans["extra"] = records["doc"][of], records["tie"][of], records["lo"][of] + offset, 0
        order = np.lexsort((spans["lo"], spans["tie"], spans["doc"], block))
        spans, block = spans[order], block[order]
        again = np.concatenate([[False], block[1:] == block[:-1]]) if len(block) else np.empty(0, bool)
        return pa.Table.from_batches([_batch(list(_dealt_by_doc(_joined(spans[again]), targets, FLAG)))])

    return run


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans whose starts follow on each other as one; no start is in two spans."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["lo"], spans["tie"], spans["doc"]))]
    new = np.ones(len(spans), bool)
    new[1:] = (spans["doc"][1:] != spans["doc"][:-1]) | (spans["tie"][1:] != spans["tie"][:-1]) | (spans["lo"][1:] > spans["lo"][:-1] + spans["extra"][:-1] + 1)
    first = np.flatnonzero(new)
    out = spans[first].copy()
    last = np.concatenate([first[1:], [len(spans)]]) - 1
    out["extra"] = spans["lo"][last] + spans["extra"][last] - out["lo"]
    return out


RESULT = "doc_id long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(length: int):
    """Documents met with their flags."""

    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        spans = _unpacked(flags.column("blob").to_pylist(), SPAN)
        spans = spans[np.lexsort((spans["lo"], spans["tie"], spans["doc"]))]
        lo, hi = spans["lo"].astype(np.int64), spans["lo"].astype(np.int64) + spans["extra"] + length
        new = np.flatnonzero(np.concatenate([[True], (spans["doc"][1:] != spans["doc"][:-1]) | (spans["tie"][1:] != spans["tie"][:-1])])) if len(spans) else []
        where = {(int(spans["doc"][a]), int(spans["tie"][a])): (a, b) for a, b in zip(new, [*new[1:], len(spans)], strict=True)} if len(spans) else {}
        rows: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        ids, ties = docs.column("doc").to_pylist(), docs.column("tie").to_pylist()
        for key, text in zip(zip(ids, ties, strict=True), docs.column("text"), strict=True):
            raw = text.as_py()
            gone = n_spans = 0
            kept = raw
            if key in where:
                a, b = where[key]
                reach = np.maximum.accumulate(hi[a:b])
                first = np.flatnonzero(np.concatenate([[True], lo[a + 1 : b] > reach[:-1]]))
                begin, end = lo[a:b][first].tolist(), reach[np.concatenate([first[1:], [b - a]]) - 1].tolist()
                n_spans, gone = len(begin), sum(end) - sum(begin)
                kept = b"".join(raw[x:y] for x, y in zip([0, *end], [*begin, len(raw)], strict=True))
            for c, v in zip(rows, (len(raw), gone, n_spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                rows[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({"doc_id": docs.column("doc"), "tie": docs.column("tie")} | {c: pa.array(rows[c], k) for c, k in zip(rows, kinds, strict=True)})

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, targets: int | None = None, hot_runs: int = HOT_RUNS, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Every byte goes that is covered by a ``length``-byte string which also starts earlier: in a
    document with a smaller id, or in the same one at a smaller offset. Strings are judged on the
    input and never cross documents; ``kept`` has the remaining bytes. Null texts count as empty;
    shorter ones have no strings, texts of any length are read whole. Rows that repeat an id are
    ordered by a hash of the text, and repeated rows get one and the same result; rows with a null id
    come after all others. Further columns are ignored; an empty table gives an empty result.

    ``targets`` is the number of groups that runs and documents are dealt to, one for about
    ``TARGET_BYTES`` of text by default; a group is held in memory by one task at a time. Anchors with
    about ``hot_runs`` different runs, as told from one document in ``sample``, are dealt by more of
    their bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    unique = docs.select(ids.alias("doc")).groupBy("doc").count().where("count > 1").limit(1).count() == 0
    # Rows with one id go by their texts' hash, those without an id after all others.
    null = F.when(F.col(id_col).cast("long").isNull(), F.lit(_NULL_TIE)).otherwise(F.lit(0).cast("long"))
    tie = null if unique else null + F.shiftrightunsigned(F.xxhash64(raw), 2)
    texts = docs.select(ids.alias("doc"), tie.alias("tie"), raw.alias("text"))

    hot, size = surveyed(scratch, texts, length, gram, hot_runs, sample)
    targets = targets or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TARGET_BYTES))
    runs = texts.mapInArrow(_anchored(length, gram, targets, hot), BLOBS)
    met = scratch.save(runs.groupBy("target").applyInArrow(_met(targets), BLOBS), "met")
    placed = texts.mapInArrow(_placed(targets), "target int, doc long, tie long, text binary")
    heads = met.where(F.col("kind") == HEAD).select("target", "blob")
    found = placed.groupBy("target").cogroup(heads.groupBy("target")).applyInArrow(_with_text(length, targets), "target int, blob binary, bytes binary")
    late = scratch.save(found.groupBy("target").applyInArrow(_repeats(length, targets), BLOBS), "late")
    flags = met.where(F.col("kind") == FLAG).select("target", "blob").unionByName(late.select("target", "blob"))
    out = placed.groupBy("target").cogroup(flags.groupBy("target")).applyInArrow(_removed(length), RESULT)
    out = out.select(F.when((F.col("doc_id") != _LAST) | (F.col("tie") < _NULL_TIE), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out if with_text else out.drop("kept")


def _placed(targets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target = _doc_target(batch.column(0).to_numpy(), batch.column(1).to_numpy(), targets)
            yield pa.RecordBatch.from_arrays([pa.array(target.astype(np.int32)), *batch.columns], ["target", "doc", "tie", "text"])

    return run
