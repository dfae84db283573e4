"""Crowded buckets of near-duplicate search lose no link."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import near
from tessera.llm.common import Scratch


def family(seed, n, kept, size=120):
    """Sets of one base, of which each member keeps a share and fills up with shingles of its own."""
    r = random.Random(seed)
    base = [r.randrange(1, 2**62) for _ in range(size)]
    return [sorted({x if r.random() < kept else r.randrange(1, 2**62) for x in base}) for _ in range(n)]


def similar(a, b):
    a, b = set(a), set(b)
    return 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize("kept", [0.87, 0.92])
def test_pairs_that_share_a_single_crowded_bucket(spark, kept):
    """All sets lie in one bucket, and in no other; sizes differ, some far; one id has two sets."""
    r = random.Random(1)
    sets = family(3, 90, kept) + [s[: r.randrange(70, 121)] for s in family(4, 40, 0.97)] + family(5, 6, 0.95, 3)
    rows = [(i, s) for i, s in enumerate(sets)] + [(0, sets[100])]
    full = spark.createDataFrame(rows, "rep long, hashes array<long>")
    placed = full.select(F.lit(5).cast("long").alias("bucket"), "rep", F.size("hashes").cast("long").alias("n"), F.col("rep").alias("component"))
    want = {(min(i, j), max(i, j)) for i, a in rows for j, b in rows if i != j and similar(a, b)}
    got = {tuple(p) for p in near.screened(Scratch(spark, "test"), full, placed, 80, split=4).collect()}
    assert len(want) > 20 and want <= got
    exact = {tuple(p) for p in near.verified(Scratch(spark, "test"), full, spark.createDataFrame(sorted(got), "a long, b long"), 80).collect()}
    assert exact == want


def test_unlike_members_share_no_rare_shingle(spark):
    """Sets with more shingles of their own than the similarity allows don't meet, however many they are."""
    for n in (300, 600):
        full = spark.createDataFrame(list(enumerate(family(7, n, 0.6))), "rep long, hashes array<long>")
        members = full.select("rep", F.size("hashes").cast("long").alias("n"), F.col("rep").alias("component"))
        most = near.rare_shingles(full, members, 80).groupBy("bucket").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        assert most < n / 10
