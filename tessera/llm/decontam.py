"""Benchmark decontamination in DataFrame operations only.

Every document is read as windows of as many words as a benchmark item has. A window gets a 64-bit
SimHash over its weighted shingles and meets the items of its size through a multi-index: the
fingerprint is cut into ``radius + 1`` blocks, so two fingerprints within the radius agree on at
least one block. The candidates are then verified on the exact weighted shingle similarity.

A window of the wanted similarity has a least number of shingles in common with its item, wherever
they stand in it. Exactly the windows in which at least so many shingles occur in some item of their
size are fingerprinted; no other window can reach the similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Words a shingle, similarity that counts, Hamming radius of the fingerprints.
SHINGLE, PERCENT, RADIUS = 5, 80, 20
#: Benchmark shingles up to which the item side is broadcast; beyond, Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; null gives an empty list."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column, k: Column) -> Column:
    """64-bit hashes of the k-word shingles of a word list, repeated ones repeated."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash: bit b is set where shingles with bit b, each as often as it occurs, outnumber the others."""

    def bit(b: Column) -> Column:
        total = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.when(F.expr("1").cast("long") == F.getbit(h, b), 1).otherwise(-1))
        return F.when(total > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", bit(b), b)))


def blocks(fingerprint: Column, radius: int) -> Column:
    """``radius + 1`` disjoint runs of bits that cover the fingerprint, each as (number, value)."""
    parts = radius + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).alias("bits")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))))


def numbered(hashes: Column) -> Column:
    """The hashes with repeated ones made different by their number, so that a bag becomes a set."""
    nth = lambda h, i: F.size(F.filter(F.slice(hashes, 1, i), lambda x: x == h))
    marked = F.transform(hashes, lambda h, i: F.when(nth(h, i) == 0, h).otherwise(F.xxhash64(h, nth(h, i))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(marked)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two ``numbered`` lists: the smaller weights' sum over the larger ones'."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def starts(at: Column, m: Column, n: Column, percent: int) -> Column:
    """Starts of the windows with enough shingles to reach ``percent``, each once.

    ``at`` has the ordered places of the document's shingles that occur in an item, ``m`` is the
    number of shingles in an item and ``n`` the document's. Of a + m shingles, percent / (100 +
    percent) must be common, where a is the window's number: m, or less at the document's end.
    """
    whole = 100 + percent
    need = F.greatest(F.ceil(2 * percent * m / F.lit(whole)).cast("int"), F.lit(1))
    # Each window is opened by its first place, so its start lies behind the place before.
    after = lambda i: F.coalesce(F.get(at, i - 1), F.lit(-1)) + 1
    run = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    last = lambda i: F.get(at, i + need - 1)
    full = F.transform(at, lambda p, i: F.when(last(i).isNotNull(), run(F.greatest(after(i), last(i) - m + 1), F.least(p, n - m))).otherwise(F.array().cast("array<int>")))
    least = lambda i: m + n - F.floor((F.size(at) - i) * F.lit(whole) / F.lit(max(percent, 1))).cast("int")
    short = F.transform(at, lambda p, i: run(F.greatest(after(i), n - m + 1, least(i)), p))
    return F.concat(F.flatten(full), F.flatten(short))


def _items(benchmark: DataFrame, item_col: str, text_col: str, k: int) -> DataFrame:
    """item_id, size, k (words a shingle; fewer for a shorter item), words, weighted."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("item_words")).where(F.size("item_words") > 0)
    items = items.select("item_id", "item_words", F.size("item_words").alias("size"), F.least(F.size("item_words"), F.lit(k)).alias("k"))
    return items.withColumn("item_shingles", shingles(F.col("item_words"), F.col("k")))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, similarity, first_word, n_windows.

    A window counts when its weighted shingle similarity to the item is at least ``percent``
    hundredths; ``similarity`` and ``first_word`` (offset in words) are those of the best window, the
    first among equals. Words are runs of letters and digits in lower case. Null, empty or
    punctuation-only texts and items match nothing; a document shorter than an item is compared as a
    whole, and windows that the document's end cuts short count too. Texts of any length are read
    whole. Repeated rows give one result per id; rows with a null id are reported under a null id.
    Further columns are ignored; an empty table on either side gives an empty result.

    At the default similarity and radius at least 9,997 of 10,000 windows that just reach the similarity
    are met by their fingerprint (simulated for 10 to 200 shingles), nearer ones more surely.

    Beyond ``BROADCAST_ROWS`` item shingles the joins with the benchmark are shuffle joins, of the same
    rows: places and fingerprints, never texts.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    items = scratch.save(_items(benchmark, item_col, item_text_col, k), "items")
    n_items, widest, kinds = items.agg(F.count("*"), F.sum(F.size("item_shingles")), F.sort_array(F.collect_set("k"))).first()
    small = (widest or 0) <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    anchors = items.select("size", "k", F.explode("item_shingles").alias("shingle")).distinct()

    # The outer form keeps Spark from computing the word list a second time, as a filter.
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    read = plain.select("doc_id", "text_key", words(F.col("text")).alias("w"))
    spots = read.select("doc_id", "text_key", "w", F.posexplode_outer("w").alias("pos", "word"))
    size = F.size("w")
    key = lambda n: F.xxhash64(*(F.get("w", F.col("pos") + i) for i in range(n)))
    wide = F.array(*(F.struct(F.lit(n).alias("k"), key(n).alias("shingle")) for n in kinds or [k]))
    spots = spots.where(F.col("pos") + min(kinds or [k]) <= size)
    if len(kinds or [k]) == 1:
        spots = spots.select("doc_id", "text_key", size.alias("n"), "pos", F.lit((kinds or [k])[0]).alias("k"), key((kinds or [k])[0]).alias("shingle"))
    else:
        spots = spots.select("doc_id", "text_key", size.alias("n"), "pos", F.inline(wide)).where(F.col("pos") + F.col("k") <= F.col("n"))
    hits = spots.join(hint(anchors), ["k", "shingle"]).groupBy("doc_id", "text_key", "n", "size", "k").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    opened = hits.select("doc_id", "text_key", "size", "k", starts(F.col("at"), F.col("size") - F.col("k") + 1, F.col("n") - F.col("k") + 1, percent).alias("starts"))
    opened = scratch.save(opened.where(F.size("starts") > 0), "starts").withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    # Starts are a table of known size: Spark broadcasts it where it is small, else the texts are shuffled once, without their words.
    met = plain.join(opened, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    met = met.select("doc_id", "size", "k", "starts", words(F.col("text")).alias("w")).select("doc_id", "size", "k", "starts", shingles(F.col("w"), F.col("k")).alias("hashes"))
    windows = met.select("doc_id", "size", "k", "hashes", F.explode("starts").alias("start"))
    windows = windows.select("doc_id", "size", "start", F.slice("hashes", F.col("start") + 1, F.col("size") - F.col("k") + 1).alias("hashes"))
    # Few bytes make much work here, so the number of tasks is stated; the written table keeps the joins
    # below from evaluating fingerprints again for each condition.
    windows = windows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "size", "start").distinct()
    windows = windows.select("doc_id", "size", "start", numbered(F.col("hashes")).alias("shingles"), simhash(F.col("hashes")).alias("print"))
    windows = scratch.save(windows, "prints")
    windows = windows.select("doc_id", "size", "start", "shingles", "print", F.inline(blocks(F.col("print"), radius)))

    bags = items.select(F.monotonically_increasing_id().alias("item_row"), "item_id", "size", numbered(F.col("item_shingles")).alias("item_bag"), simhash(F.col("item_shingles")).alias("item_print"))
    bags = scratch.save(bags, "item-prints")
    # An item's shingles wait until the fingerprints have met.
    prints = bags.select("item_row", "size", "item_print", F.inline(blocks(F.col("item_print"), radius)))
    near = windows.join(hint(prints), ["size", "block", "bits"])
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    near = near.where(F.bit_count(apart) <= radius)
    # A pair is met once for each block it agrees on; the first such block stands for them.
    agree = blocks(apart, radius)
    near = near.where(F.col("block") == F.element_at(F.filter(agree, lambda x: x["bits"] == 0), 1)["block"])
    near = near.select("doc_id", "start", "shingles", "item_row").join(hint(bags.select("item_row", "item_id", "item_bag")), "item_row")
    found = near.select("doc_id", "item_id", "start", similarity(F.col("shingles"), F.col("item_bag")).alias("similarity"))
    found = found.where(F.col("similarity") * 100 >= percent - 1e-9)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best"), F.count_distinct("start").alias("n_windows")).select("doc_id", "item_id", "best.similarity", (-F.col("best.start")).alias("first_word"), "n_windows")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, with all their columns.

    Null and empty texts stay; rows that share an id stay or go together. An empty benchmark keeps all.
    """
    bad = contaminated(docs, benchmark, id_col=id_col, **how).select(F.col("doc_id").alias("_bad_id")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_row_id"))
    return rows.join(bad, F.col("_row_id").eqNullSafe(F.col("_bad_id")), "left_anti").select("_row.*")
