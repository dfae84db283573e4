"""Cross-entropy difference of matched n-gram language models.

A target model (trusted texts) and a background model (all texts) share one vocabulary, the ids of a
public tokenizer, and one form: bigrams mixed with unigrams and the uniform distribution. A
document's score is the mean over its tokens of background loss minus target loss: positive where it
is more like the target. Every document is scored by the counts of all others: its own are taken off
both models first, so a text can't speak for itself. Bigrams are counted exactly: each block of
documents names its distinct ones, a shuffle sums them over the corpus, and a second one brings the
sums back to the blocks that asked, but for bigrams that one block alone has. The model grows with the
corpus and no process ever holds it. Texts never move: trusted ids meet the ids of the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .packing import words_of

#: Documents and tokens after which a block ends; weights of bigram, unigram and uniform parts.
BLOCK_DOCS, BLOCK_TOKENS = 4096, 1 << 19
MIX = (0.5, 0.45, 0.05)
#: Bytes of token ids that a bucket of blocks holds on average.
BUCKET_BYTES = 128 << 20
#: Spark writes no more buckets without a setting; beyond, buckets grow.
MOST_BUCKETS = 100_000
#: Tokens whose losses are computed at once; rows that a task hands over at once.
STEP_TOKENS, STEP_ROWS = 1 << 17, 1 << 16


_BLOCK = "block long, doc_ids array<long>, lens array<int>, ids binary"


def _blocks(path: str, vocabulary: int):
    """Documents as blocks of token ids, one after the other."""
    kind = _kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, held = words_of(path), TaskContext.get().partitionId() << 32, []

        def cut() -> pa.RecordBatch:
            doc_ids, ids = zip(*held, strict=True)
            lens = pa.array([[len(x) for x in ids]], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), lens, pa.array([np.concatenate(ids).tobytes()], pa.binary())], ["block", "doc_ids", "lens", "ids"])

        tokens = 0
        for batch in batches:
            for doc_id, t in zip(*batch.columns, strict=True):
                ids = words.ids(t.as_py()).astype(kind)
                held.append((doc_id.as_py(), ids))
                tokens += len(ids)
                if len(held) >= BLOCK_DOCS or tokens >= BLOCK_TOKENS:
                    yield cut()
                    block, held, tokens = block + 1, [], 0
        if held:
            yield cut()

    return run


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _opened(lens: np.ndarray, raw: bytes, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block: its tokens, and what stands before each (0 at a document's start, else id + 1)."""
    ids = np.frombuffer(raw, _kind(vocabulary)).astype(np.int64)
    before = np.concatenate([[0], ids[:-1] + 1])[: len(ids)]
    before[(np.cumsum(lens) - lens)[lens > 0]] = 0
    return ids, before


def _own(doc: np.ndarray, values: np.ndarray, n_values: int) -> np.ndarray:
    """How often each place's value occurs in its own document."""
    key = doc * n_values + values
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]])) if len(key) else np.empty(0, np.int64)
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(np.diff(np.append(new, len(key))), np.diff(np.append(new, len(key))))
    return out


def _bigrams(tokens: np.ndarray, before: np.ndarray, lens: np.ndarray, trusted: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its distinct bigrams' keys, their numbers in all and in trusted documents, and each token's place among them."""
    keys, at, n = np.unique(before * vocabulary + tokens, return_inverse=True, return_counts=True)
    return keys, np.stack([n, np.bincount(at[np.repeat(trusted, lens)], minlength=len(keys))]), at


def _flags(lens: np.ndarray, places: list[int] | None) -> np.ndarray:
    """Which of a block's documents are trusted, from their places in the block."""
    flags = np.zeros(len(lens), bool)
    flags[places or []] = True
    return flags


def _asked(vocabulary: int):
    """Distinct bigrams of each block, with their numbers in all and in trusted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lens, trusted, raw in zip(*batch.columns, strict=True):
                lens = np.array(lens.as_py(), np.int64)
                keys, n, _ = _bigrams(*_opened(lens, raw.as_py(), vocabulary), lens, _flags(lens, trusted.as_py()), vocabulary)
                for lo in range(0, len(keys), STEP_ROWS):
                    own = slice(lo, lo + STEP_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[own]), block.as_py(), np.int64)), pa.array(keys[own]), pa.array(n[0, own]), pa.array(n[1, own])], ["block", "key", "n", "good"])

    return run


def _counter(vocabulary: int):
    """Counts of a partition in all and in trusted documents: unigrams at 0.., contexts at vocabulary.. ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2 * vocabulary + 1), np.int64)
        for batch in batches:
            for _, lens, trusted, raw in zip(*batch.columns, strict=True):
                lens = np.array(lens.as_py(), np.int64)
                ids, before = _opened(lens, raw.as_py(), vocabulary)
                good = np.repeat(_flags(lens, trusted.as_py()), lens)
                for kind, own in ((0, slice(None)), (1, good)):
                    total[kind] += np.bincount(np.concatenate([ids[own], vocabulary + before[own]]), minlength=total.shape[1])
        slots = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(total[0][slots]), pa.array(total[1][slots])], ["slot", "n", "good"])

    return run


class Losses:
    """Per-token losses of both models from their counts; row 0 is the background, row 1 the target."""

    def __init__(self, counts: np.ndarray, vocabulary: int, mix: tuple[float, float, float] = MIX):
        self.vocabulary = vocabulary
        self.unigram = counts[:, :vocabulary]
        self.context = counts[:, vocabulary : 2 * vocabulary + 1]
        self.total = self.unigram.sum(axis=1)
        self.mix = mix

    def of(self, lens: np.ndarray, ids: np.ndarray, before: np.ndarray, bigram: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        """Losses in nats of each token of documents of ``lens`` tokens, by the counts of all other documents.

        ``bigram`` has the counts of each token's bigram in both models, the document's own included;
        ``trusted`` says of each document whether the target counts it.
        """
        a, b, c = self.mix
        doc = np.repeat(np.arange(len(lens)), lens)
        own = [_own(doc, v, n) for v, n in ((ids, self.vocabulary), (before, self.vocabulary + 1), (before * self.vocabulary + ids, (self.vocabulary + 1) * self.vocabulary))]
        out = np.empty((2, len(ids)))
        for kind, counted in ((0, 1), (1, trusted[doc].astype(np.int64))):
            total = self.total[kind] - counted * lens[doc]
            unigram = (self.unigram[kind][ids] - counted * own[0]) / np.maximum(total, 1)
            context = self.context[kind][before] - counted * own[1]
            # A context that no other document has leaves the next token to the unigrams.
            follows = np.where(context > 0, (bigram[kind] - counted * own[2]) / np.maximum(context, 1), unigram)
            # Without any counts the model is uniform.
            out[kind] = -np.log(np.where(total > 0, a * follows + b * unigram + c / self.vocabulary, 1 / self.vocabulary))
        return out


def scored(docs: DataFrame, trusted: DataFrame, tokenizer_path: str, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score.

    ``trusted`` has the ids of the target texts; they count in the background too. Losses are means
    over a document's tokens, by the counts of all other rows, and ``score`` is background_loss -
    target_loss; a document without tokens has losses and score 0. Null texts count as empty, texts of
    any length are read whole, repeated rows count and are scored each (so each has the other's
    counts), a null id is never trusted; further columns are ignored. A model without any other text is
    uniform. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    read = scratch.save(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_blocks(tokenizer_path, vocabulary), _BLOCK), "read")
    ids = trusted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # A row is four bytes here and a block has at most BLOCK_DOCS of them.
    flags = read.select("block", F.posexplode("doc_ids").alias("place", "doc_id")).join(ids, "doc_id", "left_semi").groupBy("block").agg(F.collect_list("place").alias("trusted"))
    size = read.agg(F.sum(F.length("ids"))).first()[0] or 0
    n_buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    # Blocks move once, into one file a bucket; the sums come to them later and they stay.
    blocks = scratch.save_bucketed(read.repartition(n_buckets, "block").join(flags, "block", "left"), "blocks", "block", n_buckets)
    scratch.drop(read)
    plain_blocks = blocks.select("block", "lens", "trusted", "ids")
    # At most 2 * vocabulary + 1 rows, whatever the corpus is.
    summed = plain_blocks.mapInArrow(_counter(vocabulary), "slot long, n long, good long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    counts = np.zeros((2, 2 * vocabulary + 1), np.int64)
    for batch in summed.toArrow().to_batches():
        counts[:, batch.column("slot").to_numpy()] = batch.column("n").to_numpy(), batch.column("good").to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    # Sums and rows that asked for them share one shuffle by bigram, and a frequent bigram's rows stream through
    # both the sum and the join. What comes back is the sum of all other blocks; a block knows its own.
    asked = plain_blocks.mapInArrow(_asked(vocabulary), "block long, key long, n long, good long").repartition("key")
    sums = asked.groupBy("key").agg(F.sum("n").alias("all_n"), F.sum("good").alias("all_good"), F.count("block").alias("blocks")).where("blocks > 1")
    known = asked.join(sums.drop("blocks").hint("merge"), "key").select("block", "key", (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_good") - F.col("good")).alias("good"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model = Losses(shared.value, vocabulary)
        doc_ids, lens = left.column("doc_ids").combine_chunks().flatten(), left.column("lens").combine_chunks().flatten().to_numpy().astype(np.int64)
        good = _flags(lens, left.column("trusted")[0].as_py())
        tokens, before = _opened(lens, left.column("ids")[0].as_py(), vocabulary)
        keys, found, at = _bigrams(tokens, before, lens, good, vocabulary)
        place = np.searchsorted(keys, right.column("key").to_numpy())
        for kind, name in enumerate(("n", "good")):
            found[kind, place] += right.column(name).to_numpy()
        means, ends = np.zeros((2, len(lens))), np.cumsum(lens)
        a = 0
        while a < len(lens):
            # Whole documents of some tokens at a time.
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP_TOKENS, "right")))
            own, some = slice(ends[a] - lens[a], ends[b - 1]), lens[a:b] > 0
            if some.any():
                losses = model.of(lens[a:b], tokens[own], before[own], found[:, at[own]], good[a:b])
                means[:, a:b][:, some] = np.add.reduceat(losses, (ends[a:b] - lens[a:b])[some] - own.start, axis=1) / lens[a:b][some]
            a = b
        return pa.table([doc_ids, pa.array(lens), pa.array(means[1]), pa.array(means[0]), pa.array(means[0] - means[1])], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return blocks.select("block", "doc_ids", "lens", "trusted", "ids").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
