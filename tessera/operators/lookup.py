"""Joins of paths and names with patterns and terms through index keys, by equality alone.

A pattern that a path has to begin or end with meets the paths on that beginning or end; a term meets the names
that contain its rarest few letters. What meets is then checked. Keys are salted, since one folder or one trigram
may be in a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import cut_lineage

#: Parts over which the rows of one key are dealt.
SALTS = 16
#: Letters of a gram; shorter terms have grams of their own length.
GRAM = 3


def _salt(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """``(ord, base, glob, p)`` with the keys on which its paths are met: (side, key), up to two rows a pattern.

    ``base`` is a plain beginning; a glob ``p`` is met on its literal head, else on its literal tail, else on nothing.
    """
    head = F.regexp_extract("p", r"^[^*?\[]*", 0)
    tail = F.when(F.contains("p", F.lit("[")), F.lit("")).otherwise(F.regexp_extract("p", r"[^*?]*$", 0))
    none = F.lit(None).cast("string")
    key = lambda side, key, base, glob: F.struct(side.alias("side"), key.alias("key"), base.alias("base"), glob.alias("glob"))
    plain = F.when(F.col("base") != "", key(F.lit("head"), F.col("base"), F.col("base"), none))
    side = F.when((head == "") & (tail != ""), "tail").otherwise("head")
    glob = key(side, F.when(side == "tail", tail).otherwise(head), none, F.col("glob"))
    return patterns.select("ord", F.explode(F.filter(F.array(plain, glob), lambda k: k.isNotNull())).alias("k")).select("ord", "k.*").distinct()


def first_pattern(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(path, hit_ord)``: the smallest ``ord`` of the patterns ``(ord, base, glob, p)`` that each path begins with or fits.

    A path goes to one key for each length that keys have, so there are at most as many as its own length.
    """
    keys = pattern_keys(patterns)
    # Lengths of keys: no more than a path can be long. They don't need the patterns' translation.
    plain = pattern_keys(patterns.withColumn("glob", F.lit("")))
    lengths = {r["side"]: sorted(r["n"]) for r in plain.groupBy("side").agg(F.collect_set(F.length("key")).alias("n")).collect()}
    ends = []
    for side, cut in (("head", F.left), ("tail", F.right)):
        for n in lengths.get(side, []):
            ends.append(F.when(F.length("path") >= n, F.struct(F.lit(side).alias("side"), cut(F.col("path"), F.lit(n)).alias("key"))))
    if not ends:
        return paths.select("path", F.lit(None).cast("int").alias("hit_ord")).limit(0)
    met = paths.select("path").distinct().withColumn("salt", _salt(F.col("path"))).select("path", "salt", F.explode(F.filter(F.array(*ends), lambda e: e.isNotNull())).alias("e")).select("path", "salt", "e.*")
    found = met.join(_salted(keys), ["side", "key", "salt"]).where(F.col("base").isNotNull() | F.expr("path rlike glob"))
    return found.groupBy("path").agg(F.min("ord").alias("hit_ord"))


def grams(text: Column, n: Column) -> Column:
    """Distinct runs of ``n`` characters; for 0 the empty one."""
    return F.when(n == 0, F.array(F.lit(""))).when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n)))).otherwise(F.array().cast("array<string>"))


def containing(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``texts(id, text, …)`` beside each of ``terms(term)`` that their text contains, letter case aside.

    A term's candidates are those that share its rarest gram; one with a gram that no text has, has none.
    """
    asked = cut_lineage(terms.select("term", F.lower("term").alias("t")).distinct().where("t is not null").withColumn("size", F.least(F.length("t"), F.lit(GRAM))))
    # Sizes of grams: at most GRAM + 1 numbers.
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())
    rows = texts.where("text is not null")
    if not sizes:
        return rows.join(asked.select("term"), F.lit(False), "inner").limit(0)
    low = rows.select("id", F.lower("text").alias("low")).distinct()
    sized = [F.struct(F.lit(n).alias("size"), grams(F.col("low"), F.lit(n)).alias("grams")) for n in sizes]
    postings = low.select("id", F.explode(F.array(*sized)).alias("g")).select("id", "g.size", F.explode("g.grams").alias("gram"))
    postings = cut_lineage(postings.withColumn("salt", _salt(F.col("id"))))
    counts = postings.groupBy("size", "gram").agg(F.count("*").alias("n"))
    own = asked.select("term", "t", "size", F.explode(grams(F.col("t"), F.col("size"))).alias("gram")).join(counts, ["size", "gram"], "left")
    rarest = own.groupBy("term", "t", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("term", "t", "size", F.col("r.gram").alias("gram"))
    met = postings.join(_salted(rarest), ["size", "gram", "salt"]).select("id", "term", "t")
    return rows.join(met, "id").where(F.contains(F.lower("text"), F.col("t"))).drop("t")


def best(found: DataFrame, limit: int) -> DataFrame:
    """The first rows of each term by score, then id, with their place. Only ``limit`` rows a term leave a task."""
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= limit)
