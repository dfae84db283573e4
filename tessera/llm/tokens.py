"""Token counts of greedy longest-match word pieces by a linear automaton.

The vocabulary becomes a trie. Every node carries a failure link, to the node that is left when the
longest pieces that begin its string are cut off, and the number of pieces cut off on the way. A word
is walked once; following a link adds its count, so no piece is ever built or compared.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker remembers at once.
_WORDS_KEPT = 600_000
_NONE = -1


@dataclass
class Automaton:
    """Trie in arrays: ``edges`` holds node * 256 + byte in order, ``targets`` the child there.

    Nodes 0 and 1 are the root of pieces that begin a word and the root of those that go on with it.
    ``fail`` is -1 where no vocabulary piece begins the node's string; ``popped`` counts the pieces
    that the failure link cuts off.
    """

    edges: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    popped: np.ndarray


def build(first: set[bytes], inner: set[bytes]) -> Automaton:
    """Automaton of the pieces that begin a word and of those inside one."""
    child: dict[int, int] = {}
    final: list[bool] = [False, False]
    order: list[tuple[int, int, int]] = []
    for root, pieces in ((0, first), (1, inner)):
        for piece in sorted(pieces):
            node = root
            for b in piece:
                key = node * 256 + b
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(final)
                    final.append(False)
                    order.append((len(order), node, b))
                node = nxt
            final[node] = True
    final[0] = final[1] = False
    n = len(final)
    depth = np.zeros(n, np.int32)
    for i, parent, _ in order:
        depth[i + 2] = depth[parent] + 1
    fail, popped = np.full(n, _NONE, np.int64), np.zeros(n, np.int64)
    if b"" in first:  # the bare space: a piece of its own, left for the inner ones
        fail[0], popped[0] = 1, 1
    # Parents come before children in depth order; a link always leads to a shorter string.
    for i, parent, b in sorted(order, key=lambda e: depth[e[0] + 2]):
        node = i + 2
        if final[node]:
            fail[node], popped[node] = 1, 1
            continue
        at, count = int(fail[parent]), int(popped[parent])
        while at != _NONE and (at * 256 + b) not in child:
            count += int(popped[at])
            at = int(fail[at])
        if at != _NONE:
            fail[node], popped[node] = child[at * 256 + b], count
    keys = np.fromiter(child, np.int64, len(child))
    sort = np.argsort(keys)
    return Automaton(keys[sort], np.fromiter(child.values(), np.int64, len(child))[sort], fail, popped)


class Counter(dict):
    """Number of greedy pieces of each word; a word without a segmentation counts ``unknown``."""

    def __init__(self, automaton: Automaton, unknown: int = 1):
        super().__init__()
        self.child = dict(zip(automaton.edges.tolist(), automaton.targets.tolist(), strict=True))
        self.fail, self.popped = automaton.fail.tolist(), automaton.popped.tolist()
        self.unknown = unknown

    def count(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node, total = 0, 0
        for b in word:
            while (nxt := child.get(node * 256 + b)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return self.unknown
            node = nxt
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return self.unknown
        return total

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = n = self.count(word)
        return n


def read_ranks(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces of a ranks file: those with a leading space begin a word, the others go on with one.

    The space alone is the empty beginning, so a word that no longer one begins is still cut in pieces.
    """
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    first = {p[1:] for p in pieces if p[:1] == b" "}
    return first, {p for p in pieces if p[:1] != b" "}


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens.

    Words are the runs of anything but ASCII white space, pieces the greedy longest ones of the
    vocabulary, in UTF-8 bytes; no two pieces tie, since of those that fit the longest is taken. Null,
    empty and blank texts count 0 and 0, texts of any length are counted whole, in time in proportion
    to it. Repeated rows and rows with a null id are counted each; further columns are ignored; an
    empty table gives an empty result. The automaton is as large as the vocabulary, whatever the
    corpus is, and is built once, on the driver.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(build(*read_ranks(vocabulary_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            n_words, n_tokens = [], []
            for t in batch.column(1):
                words = (t.as_py() or "").encode("utf-8", "replace").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(counter.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
