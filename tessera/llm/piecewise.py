"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over the last bytes of a text; where it is small, a chunk ends, so the same passage is cut at the
same places wherever it stands. Each chunk gives one sign of a signature. The block size, the mean length of a
chunk, is doubled until at most ``PIECES`` chunks end within the text: a limit for the bound is half as often
met when halved, so each block size's cuts are among those of the smaller ones. A fingerprint holds the block
size and the signatures at it and at twice it; two fingerprints whose block sizes are equal, or one twice the
other, are compared by the edit distance of the signatures at one size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes that the rolling hash sees (a power of two), the least block size, and chunks that end within a text.
WINDOW, LEAST, PIECES = 8, 4, 64
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_FACTOR, _SPREAD = 0x9E3779B1, 0x85EBCA6B


def rolling(raw: bytes) -> np.ndarray:
    """At each byte the hash of it and those before, ``WINDOW`` at most."""
    h = np.frombuffer(raw, np.uint8).astype(np.uint32) + np.uint32(1)
    step, factor = 1, _FACTOR
    while step < WINDOW:
        wider = h.copy()
        wider[step:] += h[:-step] * np.uint32(factor)
        h, step, factor = wider, 2 * step, factor * factor % 2**32
    # Products spread to the high bits; the last shift and product bring them back to all.
    h ^= h >> np.uint32(15)
    return h * np.uint32(_SPREAD)


def fingerprint(text: str) -> str:
    """``block size:signature:signature at twice the size``; an empty text's signatures are empty."""
    raw = text.encode("utf-8", "replace")
    h = rolling(raw)
    bound = 2**32 // LEAST
    at = np.flatnonzero(h < bound)
    small, level = h[at], 0
    if len(small) > PIECES:
        most = int(np.partition(small, PIECES)[PIECES])
        while bound >> level > most:
            level += 1
    signatures = []
    for size in (level, level + 1):
        ends = at[small < (bound >> size)] + 1
        ends = ends.tolist()
        if raw and (not ends or ends[-1] < len(raw)):
            ends.append(len(raw))
        signatures.append("".join([SIGNS[zlib.crc32(raw[i:j]) >> 26] for i, j in zip([0, *ends], ends, strict=False)]))
    return f"{LEAST << level}:{signatures[0]}:{signatures[1]}"


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 less the edits per sign between two fingerprints; 0 where their block sizes don't fit."""

    def same(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)

    def compared(p: Column, q: Column) -> Column:
        m, n = p[0].cast("long"), q[0].cast("long")
        return F.when(m == n, same(p[1], q[1])).when(m == 2 * n, same(p[1], q[2])).when(2 * m == n, same(p[2], q[1])).otherwise(0.0)

    # The lambda binds the parts once.
    return F.get(F.transform(F.array(F.struct(F.split(a, ":").alias("p"), F.split(b, ":").alias("q"))), lambda s: compared(s["p"], s["q"])), F.lit(0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint. Null texts count as empty; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


# One row of a task: compared ones, and the first and the last of its range, whose texts its neighbours need.
_ROW = {"kind": pa.string(), "part": pa.int32(), "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "next_fingerprint": pa.string(), "text": pa.string()}
_KINDS = "kind string, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, text string"
#: Rows that a task hands on at once.
_ROWS = 256


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many, or all, of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(part: int, doc_id: int | None, text: str, own: str, following: str, theirs: str) -> tuple:
    other = edited(text, following)
    return "row", part, doc_id, len(text), hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(), own, own if other == text else fingerprint(other), theirs, None


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ROW.values(), strict=True)], list(_ROW))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next of its range; the last one waits for the next range's first."""
    held, rows = None, []
    for batch in batches:
        for part, doc_id, text in zip(*(batch.column(c) for c in ("part", "doc_id", "text")), strict=True):
            part, doc_id, text = part.as_py(), doc_id.as_py(), text.as_py()
            own = fingerprint(text)
            if held is None:
                rows.append(("first", part, doc_id, len(text), None, own, None, None, text))
            else:
                rows.append(_compared(*held, text, own))
            held = part, doc_id, text, own
            if len(rows) >= _ROWS:
                yield _table(rows)
                rows = []
    if held is not None:
        part, doc_id, text, own = held
        rows.append(("last", part, doc_id, len(text), None, own, None, None, text))
        yield _table(rows)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rows of ranges with the first ones of the ranges after them."""
    for batch in batches:
        for row in batch.to_pylist():
            yield _table([_compared(row["part"], row["doc_id"], row["text"], row["fingerprint"], row["following"], row["theirs"])])


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents follow each other by id, null ids last; rows of one id by a hash of their texts, then by these;
    the last one is followed by the first, a single one by itself. The edited text is the document whose last
    quarter (``floor(n_chars / 4)`` code points) is replaced by the first as many, or all, of the next document's.
    ``near_edited`` and ``near_next`` are the likeness of the document's fingerprint to those of the edited text
    and of the next document. Null texts count as empty; an empty text's fingerprint is like that of another empty
    text (1) and of no other (0 signs in common). Texts of any length are hashed whole, and equal texts have equal
    fingerprints. Further columns are ignored; an empty table gives an empty result.

    One range shuffle puts each document beside its next. Only the first and the last text of a range are kept
    for its neighbours, in a written table, so a lost executor changes nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "piecewise")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The hash stands for the text where Spark samples the bounds of the ranges.
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    ranges = plain.withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    found = scratch.save(ranges.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_neighbours, _KINDS), "rows")
    # One range a task, so the list is as long as there are tasks.
    parts = sorted(r["part"] for r in found.where("kind = 'first'").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    firsts = found.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"), F.col("fingerprint").alias("theirs"))
    lasts = found.where("kind = 'last'").select("part", "doc_id", "text", "fingerprint").join(after, "part").join(firsts, "next_part")
    rows = found.where("kind = 'row'").drop("text").unionByName(lasts.mapInArrow(_meet, _KINDS).drop("text"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
