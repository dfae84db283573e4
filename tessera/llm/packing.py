"""Sequence packing along a space-filling curve.

Every document's token histogram is hashed to a vector, projected to four dimensions and mapped to
a Hilbert key. Documents are range-sorted by key, so neighbours in a sequence are alike, and the
sorted stream is cut into sequences. Only the last sequence of a corpus can need padding.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SEQUENCE = 4096
#: Token that ends each document.
END_ID = 2
DIMS, BITS, BUCKETS = 4, 10, 256
#: Parts of texts, and words of other scripts, whose ids a worker remembers at once.
_PARTS_KEPT, _WORDS_KEPT = 300_000, 60_000
_MEMOS: dict[str, Words] = {}


def _forget(memo: dict, kept: int) -> None:
    """Drop the older half of a memo that is full."""
    if len(memo) >= kept:
        for key in list(itertools.islice(memo, kept // 2)):
            del memo[key]


class Parts(dict):
    """Ids, as little-endian 32-bit bytes, of runs of letters or of signs, in lower case and Latin-1."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        # Byte-level models name a byte by its printable character, and the other bytes from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = (b for b in range(256) if b not in set(plain))
        names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.names = {c: "".join(names[b] for b in chr(c).encode()) for c in range(256)}

    def __missing__(self, part: bytes) -> bytes:
        _forget(self, _PARTS_KEPT)
        text = part.decode("latin-1")
        found = [t.id for t in self.model.tokenize(text if part.isascii() else text.translate(self.names))]
        self[part] = ids = struct.pack(f"<{len(found)}I", *found)
        return ids


class Words(dict):
    """Token ids of texts, for a tokenizer that drops white space, lower-cases, and takes runs of letters,
    digits, runs of other signs and English contractions apart.

    A text of plain Latin signs is cut into parts by one expression, and each part's ids are looked up.
    A text with other signs goes word by word through the whole tokenizer, since a document's ids are
    its words' ids in order; its plain words are cut into parts too.
    """

    #: Latin-1 signs whose treatment the expression states: ASCII that prints, tab, line ends, letters.
    SAFE = bytes([9, 10, 13, *range(32, 127), *range(0xC0, 0x100)])
    LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
    PART = re.compile(rb"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Parts(self.tokenizer.model)
        # Strings of special tokens are found in the text as it stands, before anything else.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def plain(self, text: str) -> bytes | None:
        """Ids of a text of plain Latin signs alone; None for others."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if raw.translate(None, self.SAFE) or any(s in raw for s in self.special):
            return None
        return b"".join(map(self.parts.__getitem__, self.PART.findall(raw.translate(self.LOWER))))

    def __missing__(self, word: bytes) -> bytes:
        _forget(self, _WORDS_KEPT)
        text = word.decode("utf-8", "replace")
        ids = self.plain(text)
        if ids is None:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; null counts as empty."""
        raw = self.plain(text or "")
        if raw is None:
            raw = b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))
        return np.frombuffer(raw, "<u4")


def words_of(path: str) -> Words:
    """The process's word table for a tokenizer file."""
    if path not in _MEMOS:
        _MEMOS[path] = Words(path)
    return _MEMOS[path]


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points ``cells`` (points by dimensions)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(counts: np.ndarray) -> np.ndarray:
    """Hilbert keys of rows of hashed token counts."""
    signs = np.random.default_rng(10).choice([-1.0, 1.0], (counts.shape[1], DIMS))
    v = np.sqrt(counts)
    v = v - v.mean(axis=1, keepdims=True)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    place = 1 / (1 + np.exp(-1.7 * (v @ signs)))
    return hilbert_key(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        end = np.array([end_id], "<u4")
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                counts = np.zeros((batch.num_rows, BUCKETS))
                ids = []
                for i, t in enumerate(batch.column(1)):
                    own = np.concatenate([words.ids(t.as_py()), end])
                    counts[i] = np.bincount(own % BUCKETS, minlength=BUCKETS)
                    ids.append(own)
                narrow = [x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(curve_keys(counts)), pa.array(narrow, pa.binary())], ["doc_id", "n", "curve", "ids"]
                )

    return run


#: Documents that a task cuts at once.
_ROWS = 256
PIECE = {c: pa.int64() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}


def _cut(sequence: int, with_ids: bool):
    kinds = PIECE | ({"ids": pa.binary()} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                rows: dict[str, list] = {c: [] for c in kinds}
                for doc_id, n, raw, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "at")), strict=True):
                    own = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")
                    lo = 0
                    while lo < n:
                        offset = (at + lo) % sequence
                        hi = min(n, lo + sequence - offset)
                        piece = own[lo:hi].astype("<u4").tobytes()
                        # The ids come last, and are left out where they aren't asked for.
                        for c, v in zip(rows, (doc_id, lo, hi - lo, zlib.crc32(piece), n, (at + lo) // sequence, offset, piece), strict=False):
                            rows[c].append(v)
                        lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], k) for c, k in kinds.items()], list(kinds))

    return run


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``ids`` (with ``with_ids``) holds the piece's token ids as little-endian 32-bit integers. A document is the ids of
    its text and ``end_id``; null and empty texts are that token alone. The order is by curve key,
    then id, then place in the input, so repeated rows are packed once each. Rows with a null id are
    packed like others, a text of any length is cut into as many pieces as it needs. Further columns
    are ignored; an empty table gives no pieces.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = plain.mapInArrow(_tokenised(tokenizer_path, end_id), "doc_id long, n long, curve long, ids binary")
    tokens = scratch.save(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    # Range partitions of the small columns; each gets its base from the totals before it.
    order = tokens.select("row", "doc_id", "curve", "n").repartitionByRange("curve", "doc_id", "row")
    order = scratch.save(order.withColumn("part", F.spark_partition_id()), "order")
    totals = sorted((r["part"], r["n"]) for r in order.groupBy("part").agg(F.sum("n").alias("n")).collect())
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n
    bases = docs.sparkSession.createDataFrame(bases, "part int, base long")
    before = Window.partitionBy("part").orderBy("curve", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = order.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # One row per range partition, so its size is bounded by the number of partitions.
    placed = placed.join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("inside")).alias("at"))
    joined = tokens.join(placed, "row").select("doc_id", "n", "ids", "at")
    schema = ", ".join(f"{c} long" for c in PIECE) + (", ids binary" if with_ids else "")
    return joined.mapInArrow(_cut(sequence, with_ids), schema)
