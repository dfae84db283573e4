"""Exact dedup: a sharded minimal perfect hash over the distinct digests of the historical rows.

``build_index`` hashes every distinct historical digest to its own slot of a shard; a slot holds
the full 32-byte digest and the winner's locator, so a lookup compares bytes and cannot err.
``lookup`` probes an index with distinct digests. ``exact_dedup`` uses both: repeats of history
are settled by the index, the other digests group among themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Distinct digests a shard of the index holds on average (a shard is built by one task).
SHARD_KEYS = 50_000
#: Keys a displacement bucket holds on average.
BUCKET_KEYS = 4
_LAST = 2**63 - 1

INDEX_SCHEMA = "shard long, n long, seeds binary, digests binary, winners binary, copies binary"


def normalised(text):
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text):
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _lanes(digests: list[bytes] | np.ndarray) -> np.ndarray:
    """The digests as rows of four 64-bit words."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _slots(lanes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (_mix(lanes[:, 1] + seeds.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(n)).astype(np.int64)


def _buckets(lanes: np.ndarray, n: int) -> np.ndarray:
    return (lanes[:, 2] % np.uint64(max(1, -(-n // BUCKET_KEYS)))).astype(np.int64)


def perfect_seeds(lanes: np.ndarray) -> np.ndarray:
    """One seed per bucket such that all keys land on distinct slots of ``range(len(lanes))``."""
    n = len(lanes)
    bucket = _buckets(lanes, n)
    count = np.bincount(bucket, minlength=max(1, -(-n // BUCKET_KEYS)))
    order = np.argsort(bucket, kind="stable")
    first = np.concatenate([[0], np.cumsum(count)])
    seeds = np.zeros(len(count), np.uint32)
    taken = np.zeros(n, bool)
    tries = np.arange(256, dtype=np.uint64)
    for b in np.argsort(-count, kind="stable"):
        if not count[b]:
            break
        keys = lanes[order[first[b] : first[b + 1]], 1]
        base = 0
        while True:
            at = (_mix(keys[None, :] + (tries + np.uint64(base))[:, None] * np.uint64(0xD1B54A32D192ED03)) % np.uint64(n)).astype(np.int64)
            good = ~taken[at].any(axis=1)
            if len(keys) > 1:
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                hit = int(np.argmax(good))
                seeds[b] = base + hit
                taken[at[hit]] = True
                break
            base += len(tries)
    return seeds


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    lanes = _lanes(pdf["digest"].tolist())
    n = len(lanes)
    seeds = perfect_seeds(lanes)
    slot = _slots(lanes, seeds[_buckets(lanes, n)], n)
    digests, winners, copies = np.empty((n, 4), "<u8"), np.empty(n, "<i8"), np.empty(n, "<i8")
    digests[slot], winners[slot], copies[slot] = lanes, pdf["winner"].to_numpy(), pdf["copies"].to_numpy()
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [n], "seeds": [seeds.astype("<u4").tobytes()], "digests": [digests.tobytes()], "winners": [winners.tobytes()], "copies": [copies.tobytes()]})


def shard_of(digest, shards: int):
    """Shards are dealt by the digest's first 60 bits, so they are even whatever the texts are."""
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long"), F.lit(shards))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """Index rows, one per shard, of ``history(digest, winner, copies)`` with distinct digests."""
    return history.withColumn("shard", shard_of(F.col("digest"), shards)).groupBy("shard").applyInPandas(_build, INDEX_SCHEMA)


def _probe(probe: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = probe[["digest", "winner", "copies"]].copy()
    out["old_winner"], out["old_copies"] = 0, 0
    if len(index) and len(probe):
        row = index.iloc[0]
        n, seeds = int(row["n"]), np.frombuffer(row["seeds"], "<u4")
        lanes = _lanes(probe["digest"].tolist())
        slot = _slots(lanes, seeds[_buckets(lanes, n)], n)
        same = (np.frombuffer(row["digests"], "<u8").reshape(-1, 4)[slot] == lanes).all(axis=1)
        out["old_winner"] = np.where(same, np.frombuffer(row["winners"], "<i8")[slot], 0)
        out["old_copies"] = np.where(same, np.frombuffer(row["copies"], "<i8")[slot], 0)
    return out


def lookup(index: DataFrame, probes: DataFrame, shards: int) -> DataFrame:
    """Each of ``probes(digest, winner, copies)`` with the index's winner and copies; old_copies is 0 where it has none."""
    dealt = probes.withColumn("shard", shard_of(F.col("digest"), shards))
    return dealt.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe, "digest binary, winner long, copies long, old_winner long, old_copies long")


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("rank").alias("winner"), F.count("*").alias("copies"))


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)`` of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history_share: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after ``normalised``; null counts as empty. Of equal
    texts the row with the smallest id is kept. Rows up to the ``history_share`` quantile of the
    ids form the history that is indexed; the others probe it. That split changes the work, never
    the result. Ids may be negative. Rows with a null id come after all others (keep_id is null where a group has no id).
    Repeated rows with one id are all kept, since nothing tells them apart; ``deduplicated``
    leaves one. Texts of any length are read whole, and only their digests are shuffled. An empty
    table gives an empty result; further columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    rows = scratch.save(digests_of(docs, id_col, text_col), "digests")
    cut = rows.agg(F.percentile_approx("doc_id", history_share, 1000)).first()[0]
    ranked = rows.withColumn("rank", F.coalesce("doc_id", F.lit(_LAST)))
    cut = _LAST if cut is None else cut
    history = scratch.save(_distinct(ranked.where(F.col("rank") <= cut)), "history")
    shards = max(1, -(-history.count() // SHARD_KEYS))
    index = scratch.save(build_index(history, shards), "index")
    found = lookup(index, _distinct(ranked.where(F.col("rank") > cut)), shards)
    # History rows come before all probes, so the index's winner has the smaller id.
    settled = found.select(
        "digest",
        F.when(F.col("old_copies") > 0, F.col("old_winner")).otherwise(F.col("winner")).alias("winner"),
        (F.col("copies") + F.col("old_copies")).alias("copies"),
    )
    settled = scratch.save(settled, "settled")
    groups = scratch.save(settled.unionByName(history.join(settled.select("digest"), "digest", "left_anti").select("digest", "winner", "copies")), "groups")
    # Both sides are scans, so a text with a third of all rows is split over tasks.
    return rows.join(groups, "digest").select(
        "doc_id",
        F.when(F.col("winner") < _LAST, F.col("winner")).alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.coalesce("doc_id", F.lit(_LAST)) == F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with all their columns.

    Null and empty texts are one text; of repeated rows one stays. An empty table gives an empty result.
    """
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest"), "group_size")
    kept = Scratch(docs.sparkSession, "kept").save(kept, "kept")
    # Rows that share one id and one text can't be told apart; only then is a second step needed.
    again = kept.groupBy("_digest").count().where("count > 1").limit(1).count()
    # The row travels as one struct, so no name of its columns can clash.
    marked = docs.select(F.struct("*").alias("_row"), text_digest(F.col(text_col)).alias("_digest"), F.col(id_col).cast("long").alias("_id"))
    best = kept.select("_id", "_digest").distinct() if again else kept.select("_id", "_digest")
    out = marked.join(best, (marked["_digest"] == best["_digest"]) & marked["_id"].eqNullSafe(best["_id"]), "left_semi")
    if again:
        out = out.dropDuplicates(["_digest"])
    return out.select("_row.*")
