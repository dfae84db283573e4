"""Alignment of two tokenizers' tokens over the same bytes.

A byte-level tokenizer gives each token's span in characters, a sentencepiece model gives each piece's
span through its proto. Spans are coarse cuts: tokens that share a character, and the byte pieces of a
character that the model lacks, are cut further by their decoded bytes. Where tokens of both end at one
byte, a group ends.

Texts are aligned part by part. A part ends before a space that follows a sign and is followed by a later
one: no match of the byte-level splitting expression, and no piece of the model (which is checked), crosses
such a place, so a part's tokens are those it has in its text. Workers remember the parts of many texts.

Two tokens that end at one byte are suffixes of each other, so the pairs that can ever be linked follow from
the vocabularies alone. Counts of pairs therefore have a size that no corpus changes.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Parts whose alignment a worker remembers at once, the longest of them, and how many are aligned together.
_PARTS_KEPT, _LONGEST_KEPT, _TOGETHER = 400_000, 64, 150
#: Places of a table of the parts that a worker has seen once; only those that come again are remembered.
_SEEN = 1 << 23
#: Texts that a task aligns at once.
_ROWS = 64
#: A space between signs; the text before it and the text after it are cut independently.
_CUT = re.compile(r"(?<=\S) (?=\s*\S)")
#: ASCII white space and a space: places of an ASCII text where single spaces alone don't tell the cuts.
_WIDE = [f"{c} " for c in " \t\n\v\f\r\x1c\x1d\x1e\x1f"]
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_PARTS: dict[tuple[str, str], Parts] = {}


def byte_level_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, which names bytes by printable characters."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    value = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    out = [b""] * tokenizer.get_vocab_size()
    for name, i in tokenizer.get_vocab().items():
        out[i] = name.encode() if i in special else bytes(value[c] for c in name)
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of each piece: a byte piece is its byte, the space sign a space."""
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    return [bytes.fromhex(_BYTE.fullmatch(n)[1]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Keys, a id * 2**32 + b id, of all pairs of which one token ends with the other; sorted."""

    def by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, t in enumerate(tokens):
            if t:
                out.setdefault(t, []).append(i)
        return out

    of_a, of_b = by_bytes(a), by_bytes(b)
    keys = [(i << 32) + j for t, ids in of_a.items() for cut in range(len(t)) for j in of_b.get(t[cut:], ()) for i in ids]
    keys += [(i << 32) + j for t, ids in of_b.items() for cut in range(1, len(t)) for i in of_a.get(t[cut:], ()) for j in ids]
    return np.sort(np.array(keys, np.int64))


def parts_of(text: str) -> list[str]:
    """The parts of a text, which a space joins."""
    if text.isascii() and not text[:1].isspace() and not text[-1:].isspace() and not any(w in text for w in _WIDE):
        return text.split(" ")
    return _CUT.split(text)


class Parts(dict):
    """Alignment of a part: numbers of A tokens, B tokens and groups, the groups' text, and its links as 32-bit places in ``keys``.

    A part whose tokens don't give back its bytes is None.
    """

    def __init__(self, a_path: str, b_path: str, keys: np.ndarray | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a_bytes, self.b_bytes = byte_level_bytes(self.a), piece_bytes(self.b)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        self.byte_piece = np.array([self.b.is_byte(i) for i in range(self.b.vocab_size())])
        self.seen = bytearray(_SEEN)
        self.names = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        # A model whose pieces go on after a sign's space could join two parts, so its texts stay whole.
        self.whole = any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))
        self.keys = linkable(self.a_bytes, self.b_bytes) if keys is None else keys

    def a_ends(self, raw: bytes, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and byte ends of the byte-level tokens of ``text``."""
        found = self.a.encode(text, add_special_tokens=False)
        ids, spans = found.ids, np.array(found.offsets, np.int64).reshape(-1, 2)
        cuts = spans[:, 1]
        if len(raw) > len(text):  # characters to bytes
            c = np.frombuffer(text.encode("utf-32-le"), "<u4")
            cuts = np.concatenate(([0], np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))))[cuts]
        # Where the next token is in the same character, the span is too coarse.
        return self.refined(raw, ids, cuts, np.append(spans[1:, 0] < spans[:-1, 1], False) if len(ids) else cuts > 0, self.a_bytes, self.a_sizes)

    def b_ends(self, raw: bytes, part: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and byte ends of the pieces of ``part``, which stand for a space and the part."""
        pieces = self.b.encode(part, return_type="proto").pieces
        ids = [p.id for p in pieces]
        # Spans leave out the space before the part; byte pieces but the last of a character have none.
        return self.refined(raw, ids, np.array([p.end for p in pieces], np.int64) + 1, self.byte_piece[ids] if ids else np.zeros(0, bool), self.b_bytes, self.b_sizes)

    @staticmethod
    def refined(raw: bytes, ids: list[int], cuts: np.ndarray, coarse: np.ndarray, decoded: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and ends, where those that are too coarse come from the decoded bytes; None where these aren't ``raw``."""
        if b"".join(map(decoded.__getitem__, ids)) != raw:
            return None
        ids = np.array(ids, np.int64)
        exact = np.cumsum(sizes[ids])
        ends = np.where(coarse, exact, cuts)
        return ids, ends if np.array_equal(ends, exact) else exact

    def align(self, part: str, inner: list[int] | None = None):
        """The alignment of a part; of a text of several parts, a list for those that end at the bytes ``inner``."""
        text = " " + part
        raw = text.encode()
        a, b = self.a_ends(raw, text), self.b_ends(raw, part)
        if a is None or b is None:
            return None
        (a_ids, a_ends), (b_ids, b_ends) = a, b
        at = np.searchsorted(a_ends, b_ends)
        b_last = np.flatnonzero(a_ends[at] == b_ends)
        a_last = at[b_last]
        places = np.searchsorted(self.keys, (a_ids[a_last] << 32) + b_ids[b_last]).astype("<i4").tobytes()
        # Groups before each part's end, and tokens before each group's.
        stops = np.searchsorted(b_ends[b_last], inner or [len(raw)], "right").tolist()
        i, k = [0, *(a_last + 1).tolist()], [0, *(b_last + 1).tolist()]
        a_names, b_names = [self.names[x] for x in a_ids.tolist()], [self.names[x] for x in b_ids.tolist()]
        groups = [
            f"{a_names[a0]}|{b_names[b0]}" if a1 - a0 == 1 == b1 - b0 else f"{','.join(a_names[a0:a1])}|{','.join(b_names[b0:b1])}"
            for a0, a1, b0, b1 in zip(i, i[1:], k, k[1:])
        ]
        out = [(i[to] - i[go], k[to] - k[go], to - go, ";".join(groups[go:to]).encode(), places[4 * go : 4 * to]) for go, to in zip([0, *stops], stops)]
        return out if inner else out[0]

    def learn(self, parts) -> list[str]:
        """Take in parts, those without outer white space together, as one text; and name those that needn't be remembered."""
        if len(self) >= _PARTS_KEPT:
            for key in list(itertools.islice(self, _PARTS_KEPT // 2)):
                del self[key]
        new = [p for p in dict.fromkeys(parts) if p not in self and 0 < len(p) <= _LONGEST_KEPT and not p[0].isspace() and not p[-1].isspace()]
        for first in range(0, len(new), _TOGETHER):
            some = new[first : first + _TOGETHER]
            found = self.align(" ".join(some), list(itertools.accumulate(len(p.encode()) + 1 for p in some)))
            # A part that isn't given back spoils its whole text, so then each is aligned alone when it is asked for.
            if found:
                self.update(zip(some, found, strict=True))
        seen, once = self.seen, []
        for p in new:
            at = hash(p) % _SEEN
            if seen[at]:
                continue
            seen[at] = 1
            once.append(p)
        return once

    def __missing__(self, part: str):
        found = self.align(part)
        if len(part) <= _LONGEST_KEPT:
            self[part] = found
        return found

    def of_texts(self, texts: list[str | None]) -> list[tuple[int, int, int, bytes, bytes]]:
        """The alignment of whole texts; null, empty and unfaithful ones have no tokens."""
        cut = [([t] if self.whole else parts_of(t)) if t else [] for t in texts]
        once = self.learn(itertools.chain.from_iterable(cut))
        out = []
        for parts in cut:
            found = list(map(self.__getitem__, parts))
            if not found or None in found:
                out.append((0, 0, 0, b"", b""))
            else:
                n_a, n_b, n_groups, groups, links = zip(*found, strict=True)
                out.append((sum(n_a), sum(n_b), sum(n_groups), b";".join(groups), b"".join(links)))
        for p in once:
            self.pop(p, None)
        return out


def _parts_of(a_path: str, b_path: str, keys: np.ndarray) -> Parts:
    """The process's memo for two tokenizer files."""
    if (a_path, b_path) not in _PARTS:
        _PARTS[a_path, b_path] = Parts(a_path, b_path, keys)
    return _PARTS[a_path, b_path]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups.

    A is the byte-level tokenizer in ``a_path`` on a space and the text, B the sentencepiece model in ``b_path``
    on the text. A group is a stretch of bytes between two places where tokens of both end; ``groups`` (with
    ``with_groups``) names their ids as ``a1,a2|b1;a3|b2,b3``. Tokens that end together are linked, the last ones
    of each group; ``n_best`` counts the links whose pair of ids is linked as often as any pair of its B id in the
    whole corpus, ties included, and ``count_sum`` adds up how often the links' pairs are. Null and empty texts,
    and those that one of the tokenizers doesn't give back byte by byte (such as texts with U+2581), have no
    tokens: zeros, an empty ``groups`` and an empty ``groups_sha256``. Texts of any length are aligned whole.
    Repeated rows and rows with a null id are aligned, and counted, each; further columns are ignored; an empty
    table gives an empty result.

    Aligned texts are written once, each with its links; tasks add up the pairs of their texts before the
    shuffle. Pairs are bounded by the vocabularies, some hundred thousand, so their counts go to all tasks.
    """
    spark = docs.sparkSession
    keys = Parts(a_path, b_path).keys
    shared = spark.sparkContext.broadcast(keys)
    names = ["n_a", "n_b", "n_groups"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts_of(a_path, b_path, shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(first, _ROWS)
                rows = parts.of_texts(piece.column(1).to_pylist())
                n_a, n_b, n_groups, groups, links = zip(*rows, strict=True)
                digests = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(groups, n_a, strict=True)]
                columns = [piece.column(0), *(pa.array(n, pa.int64()) for n in (n_a, n_b, n_groups)), pa.array(digests, pa.string()), pa.array(links, pa.binary())]
                if with_groups:
                    columns.append(pa.array([g.decode() for g in groups], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "groups_sha256", "links", *(["groups"] if with_groups else [])])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for raw in batch.column(0):
                # A long text's links are counted by value, so that short ones don't touch every pair.
                place, n = np.unique(np.frombuffer(raw.as_py(), "<i4"), return_counts=True)
                total[place] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["pair", "n"])

    kinds = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary" + (", groups string" if with_groups else "")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = Scratch(spark, "align").save(plain.mapInArrow(cut, kinds), "cuts")
    counts = np.zeros(len(keys), np.int64)
    # At most one row for each pair that the vocabularies allow.
    for row in cuts.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[row["pair"]] = row["n"]
    most = np.zeros((keys & 0xFFFFFFFF).max(initial=0) + 1, np.int64)
    np.maximum.at(most, keys & 0xFFFFFFFF, counts)
    tallies = spark.sparkContext.broadcast((counts, counts == most[keys & 0xFFFFFFFF]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = tallies.value
        for batch in batches:
            links = [np.frombuffer(raw.as_py(), "<i4") for raw in batch.column("links")]
            out = {c: batch.column(c) for c in batch.schema.names if c != "links"}
            out |= {"n_best": pa.array([int(best[x].sum()) for x in links], pa.int64()), "count_sum": pa.array([int(n[x].sum()) for x in links], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    scored = cuts.mapInArrow(score, kinds.replace(", links binary", "") + ", n_best long, count_sum long")
    return scored.select("doc_id", *names, F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))
