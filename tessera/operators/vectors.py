"""Nearest vectors by cosine: exactly by blocks, and through an index of cells.

The index is an inverted file: k-means cells fitted on a bounded sample, every vector filed under its nearest
cell. A query reads the cells nearest to it. Since the angles between a cell's centre and its vectors are known
to lie within a radius, cells that can't hold a nearer vector than those found are told apart, so a search can
go on until its hits are proven. Queries and vectors meet as blocks of bounded size, in joins; neither pass
through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import cut_lineage

#: Rows of a block of vectors and of one of queries, and bytes of a block, at most: Arrow hands Python up to 10,000 blocks at once.
VECTOR_BLOCK, QUERY_BLOCK, BLOCK_BYTES = 2048, 1024, 8192
#: Blocks of vectors and of queries that meet in one group.
GROUP = 512
#: Rows of vectors that a task compares, and of queries that it compares them with, at a time.
STEP = 1024
#: Rows that the cells are fitted on, at most, and cells, at most: what the driver and every task hold.
SAMPLE_ROWS, MAX_CELLS = 50_000, 4096
#: Queries on which the number of cells to read is measured, at most.
SAMPLE_QUERIES = 200
#: Slack of the bound by angles, for rounding.
_SLACK = 1e-6

_FOUND = "query_id {q}, {id} {i}, vector_score double"


def units(rows) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    m = np.vstack(rows).astype(np.float64) if len(rows) else np.zeros((0, 1))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def _packed(df: DataFrame, id_col: str, vector_col: str, name: str, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of rows, of unit vectors: ``by``, ``{name}_ids``, ``{name}_unit``, and ``{name}_block``, counted from 0 in each task.

    With ``by`` the rows of a task must come in its order; a block has rows of one value.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, rows, block = None, [], [], 0

        def made():
            out = dict(zip(by, key or (), strict=False)) | {f"{name}_block": block, f"{name}_ids": list(ids), f"{name}_unit": units(rows).tobytes()}
            return pd.DataFrame([out])

        for pdf in batches:
            keys = list(zip(*(pdf[c] for c in by), strict=True)) if by else [()] * len(pdf)
            for k, i, v in zip(keys, pdf[id_col], pdf[vector_col], strict=True):
                if ids and (k != key or len(ids) == size or 8 * len(v) * (len(ids) + 1) > BLOCK_BYTES):
                    yield made()
                    ids, rows, block = [], [], block + 1
                key = k
                ids.append(i)
                rows.append(v)
        if ids:
            yield made()

    kinds = "".join(f"{c} {dict(df.dtypes)[c]}, " for c in by)
    return df.select(*by, id_col, vector_col).mapInPandas(run, f"{kinds}{name}_block int, {name}_ids array<{kind}>, {name}_unit binary")


class _Best:
    """The ``k`` best hits of each query that a task has seen; ties go to the smaller id."""

    def __init__(self, k: int, id_col: str, bound: int = 200_000):
        self.k, self.id_col, self.bound, self.held, self.n = k, id_col, bound, [], 0

    def add(self, query_ids, ids, sims: np.ndarray) -> None:
        keep = min(self.k, sims.shape[1])
        # Everything as near as the k-th is kept, so ties are settled by id below.
        edge = np.partition(sims, sims.shape[1] - keep, axis=1)[:, sims.shape[1] - keep]
        at, col = np.nonzero(sims >= edge[:, None])
        self.held.append(pd.DataFrame({"query_id": np.asarray(query_ids)[at], self.id_col: np.asarray(ids)[col], "vector_score": sims[at, col]}))
        self.n += len(at)
        if self.n > self.bound:
            self.held = [self.best()]
            self.n = len(self.held[0])
            self.bound = max(self.bound, 2 * self.n)

    def best(self) -> pd.DataFrame:
        rows = pd.concat(self.held)
        return rows.sort_values(["query_id", "vector_score", self.id_col], ascending=[True, False, True]).groupby("query_id").head(self.k)


def _compare(q: DataFrame, v: DataFrame, keys: list[str], k: int, id_col: str, schema: str, parts: int) -> DataFrame:
    """Hits of the blocks of queries and of vectors with equal ``keys``, the ``k`` best of each query and group.

    Blocks of either side travel by themselves, not in pairs, and the queries of a group come first. A task holds
    them, at most ``GROUP`` blocks or what falls on them by hash, and lets the vectors pass by.
    """
    q_kind, v_kind = dict(q.dtypes)["q_ids"][6:-1], dict(v.dtypes)["v_ids"][6:-1]
    none = F.lit(None)
    both = q.select(*keys, F.lit(0).alias("side"), "q_ids", none.cast(f"array<{v_kind}>").alias("v_ids"), F.col("q_unit").alias("unit"))
    both = both.unionByName(v.select(*keys, F.lit(1).alias("side"), none.cast(f"array<{q_kind}>").alias("q_ids"), "v_ids", F.col("v_unit").alias("unit")))

    def kind(name: str) -> pa.DataType:
        return pa.int64() if name == "bigint" else pa.int32() if "int" in name else pa.string()

    out = pa.schema([("query_id", kind(q_kind)), (id_col, kind(v_kind)), ("vector_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, ids, rows, q_ids, units_, best = None, [], [], [], [], None, _Best(k, id_col)

        def matrix(blocks):
            return np.concatenate([np.frombuffer(u).reshape(n, -1) for n, u in blocks])

        def meet():
            if ids and len(q_ids):
                m = matrix(rows)
                for at in range(0, len(q_ids), STEP):
                    best.add(q_ids[at : at + STEP], ids, units_[at : at + STEP] @ m.T)
            ids.clear()
            rows.clear()

        def done():
            meet()
            if best.held:
                yield from pa.Table.from_pandas(best.best(), schema=out, preserve_index=False).to_batches(10_000)

        for batch in batches:
            columns = [batch.column(c) for c in [*keys, "side", "q_ids", "v_ids", "unit"]]
            for i in range(batch.num_rows):
                *now, side, qs, vs, unit = (c[i].as_py() for c in columns)
                if now != group:
                    yield from done()
                    group, asked, q_ids, units_, best = now, [], [], None, _Best(k, id_col)
                if side == 0:
                    q_ids.extend(qs)
                    asked.append((len(qs), unit))
                    continue
                if asked:
                    units_, asked = matrix(asked), []
                if len(q_ids):
                    ids.extend(vs)
                    rows.append((len(vs), unit))
                    if len(ids) >= STEP:
                        meet()
        yield from done()

    # A stated number of parts stays: the work is in comparing, not in the bytes.
    return both.repartition(parts, *keys).sortWithinPartitions(*keys, "side").mapInArrow(run, schema)


def _schema(queries: DataFrame, vectors: DataFrame, id_col: str) -> str:
    return _FOUND.format(q=dict(queries.dtypes)["query_id"], id=id_col, i=dict(vectors.dtypes)[id_col])


def ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("vector_score"), id_col))
    return found.withColumn("vec_rank", place).where(F.col("vec_rank") <= k)


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "vector") -> DataFrame:
    """The ``k`` nearest vectors of each query: query_id, id, vector_score, vec_rank.

    Ties go to the smaller id; a zero vector scores 0, null vectors are left out. Queries and vectors are packed
    in blocks, and every block of queries meets every block of vectors, in groups of bounded size: the stated
    queries against all rows. A group keeps k rows a query.
    """
    asked = queries.where(F.col("vector").isNotNull())
    q = cut_lineage(_packed(asked, "query_id", "vector", "q", QUERY_BLOCK))
    v = cut_lineage(_packed(vectors.where(F.col(vector_col).isNotNull()), id_col, vector_col, "v", VECTOR_BLOCK))
    n_q, n_v, at_once = q.count(), v.count(), queries.sparkSession.sparkContext.defaultParallelism
    # So many groups at least that all tasks have work.
    lanes = max(1, -(-n_q // GROUP))
    slots = max(1, -(-n_v // GROUP), min(n_v, -(-2 * at_once // lanes)))
    lane = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = q.withColumn("lane", lane("q_ids", lanes)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    v = v.withColumn("slot", lane("v_ids", slots)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return ranked(_compare(q, v, ["lane", "slot"], k, id_col, _schema(queries, vectors, id_col), min(lanes * slots, 16 * at_once)), k, id_col)


@dataclass
class CellIndex:
    """A written index: ``blocks`` (cell, v_block, v_ids, v_unit), and what is known of each cell.

    ``centres`` are the cells' unit vectors, ``radius`` the largest angle of a vector to its centre (-1: empty),
    ``n_blocks`` the numbers of blocks; all bounded by ``MAX_CELLS``.
    """

    blocks: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    n_blocks: np.ndarray
    id_col: str


def fit_cells(vectors: DataFrame, n_cells: int | None = None, id_col: str = "chunk_id", vector_col: str = "vector", rounds: int = 12) -> np.ndarray:
    """Centres of cells by spherical k-means on at most ``SAMPLE_ROWS`` rows, those of the smallest hashed ids.

    By default there are about as many cells as the root of the number of rows.
    """
    rows = vectors.where(F.col(vector_col).isNotNull())
    n = rows.count()
    cells = max(1, min(MAX_CELLS, n_cells or round(n**0.5), n))
    sample = rows.select(vector_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).collect()
    x = units([r[0] for r in sample])
    if not len(x):
        return np.zeros((1, 1))
    rng = np.random.default_rng(7)
    centres = x[np.sort(rng.permutation(len(x))[:cells])]
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(filled[:, None], units(sums), centres)
    return centres


def build_index(vectors: DataFrame, n_cells: int | None = None, id_col: str = "chunk_id", vector_col: str = "vector") -> CellIndex:
    """File every vector under its nearest cell. Blocks are written in order of cells."""
    spark = vectors.sparkSession
    centres = fit_cells(vectors, n_cells, id_col, vector_col)
    shared = spark.sparkContext.broadcast(centres)
    kinds = dict(vectors.dtypes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # So many rows at a time that their table of cells stays small.
            for at in range(0, len(pdf), STEP):
                part = pdf.iloc[at : at + STEP].copy()
                sims = units(part[vector_col]) @ shared.value.T
                part["cell"] = sims.argmax(axis=1).astype(np.int32)
                part["angle"] = np.arccos(np.clip(sims.max(axis=1), -1, 1))
                yield part[[id_col, vector_col, "cell", "angle"]]

    rows = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col).mapInPandas(assign, f"{id_col} {kinds[id_col]}, {vector_col} {kinds[vector_col]}, cell int, angle double")
    filed = cut_lineage(rows.repartitionByRange("cell", F.xxhash64(id_col)).sortWithinPartitions("cell"))
    # Reading may split a file or put several in one task: either way a block has rows of one cell.
    blocks = cut_lineage(_packed(filed, id_col, vector_col, "v", VECTOR_BLOCK, ("cell",)).withColumn("row", F.monotonically_increasing_id()))
    # Blocks of a cell are numbered without their contents.
    numbers = blocks.select("row", (F.row_number().over(Window.partitionBy("cell").orderBy("row")) - 1).alias("number"))
    blocks = cut_lineage(blocks.drop("v_block").join(numbers, "row").drop("row"))
    radius, n_blocks = np.full(len(centres), -1.0), np.zeros(len(centres), np.int64)
    for r in filed.groupBy("cell").agg(F.max("angle").alias("a")).collect():
        radius[r["cell"]] = r["a"]
    for r in blocks.groupBy("cell").agg(F.count("*").alias("n")).collect():
        n_blocks[r["cell"]] = r["n"]
    return CellIndex(blocks, centres, radius, n_blocks, id_col)


def _probes(asked: DataFrame, index: CellIndex, n_probe: int) -> DataFrame:
    """``asked`` (query_id, vector, after, least) with the cells it has still to read, one row each.

    ``after`` cells, the nearest ones, have been read; ``least`` is the score that a further vector has to reach,
    null for any. With ``n_probe`` only so many cells are named.
    """
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast((index.centres, index.radius, index.n_blocks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, radius, n_blocks = shared.value
        for whole in batches:
            # So many queries at a time that their table of cells stays small.
            for first in range(0, len(whole), 256):
                pdf = whole.iloc[first : first + 256]
                sims = units(pdf["vector"]) @ centres.T
                sims[:, radius < 0] = -2.0
                place = np.argsort(np.argsort(-sims, axis=1, kind="stable"), axis=1)
                # No vector of a cell is nearer than by the angle to its centre less the cell's radius.
                bound = np.cos(np.maximum(0, np.arccos(np.clip(sims, -1, 1)) - radius)) + _SLACK
                after, least = pdf["after"].to_numpy()[:, None], pdf["least"].astype(float).fillna(-2.0).to_numpy()[:, None]
                wanted = (place >= after) & (place < after + n_probe) & (radius >= 0) & (bound >= least)
                at, cell = np.nonzero(wanted)
                # A query's vector comes with each of its cells, so they leave in parts.
                for part in range(0, len(at), 10_000):
                    at_, cell_ = at[part : part + 10_000], cell[part : part + 10_000]
                    yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[at_], "vector": pdf["vector"].to_numpy()[at_], "cell": cell_.astype(np.int32), "slots": (-(-n_blocks[cell_] // GROUP)).astype(np.int32)})

    kinds = dict(asked.dtypes)
    return asked.mapInPandas(run, f"query_id {kinds['query_id']}, vector {kinds['vector']}, cell int, slots int")


def _read(probes: DataFrame, index: CellIndex, k: int, schema: str) -> DataFrame:
    """The ``k`` best hits of each query and task in the cells that its probes name.

    Queries of a cell are packed; a cell's blocks of either side are dealt over slots, so that a crowded cell is
    shared by many tasks.
    """
    ordered = probes.repartitionByRange("cell", F.xxhash64("query_id")).sortWithinPartitions("cell")
    q = _packed(ordered, "query_id", "vector", "q", QUERY_BLOCK, ("cell", "slots"))
    q = cut_lineage(q)
    # One row a cell at most.
    lanes = F.broadcast(q.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("lanes")))
    q = q.join(lanes, "cell").withColumn("lane", F.pmod(F.xxhash64("q_ids"), "lanes").cast("int"))
    q = q.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    v = index.blocks.join(lanes, "cell").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    v = v.withColumn("slot", F.floor(F.col("number") / GROUP).cast("int"))
    parts = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * q.sparkSession.sparkContext.defaultParallelism)
    return _compare(q, v, ["cell", "slot", "lane"], k, index.id_col, schema, parts)


def index_topk(queries: DataFrame, index: CellIndex, k: int, n_probe: int = 16, exact: bool = False) -> DataFrame:
    """The ``k`` nearest vectors of each query through the index: query_id, id, vector_score, vec_rank.

    A query reads its ``n_probe`` nearest cells, and scores are those of the vectors themselves. A query with fewer
    than k hits after that reads all other cells; with ``exact`` every query reads on in all cells that may hold
    a vector as near as its k-th, so the hits are those of ``exact_topk``, up to rounding of equal scores.
    """
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {index.id_col} {dict(index.blocks.dtypes)['v_ids'][6:-1]}, vector_score double"
    first = _read(_probes(asked.withColumns({"after": F.lit(0), "least": F.lit(None).cast("double")}), index, n_probe), index, k, schema)
    first = cut_lineage(ranked(first, k, index.id_col))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("vector_score")).alias("least"))
    left = asked.join(kth, "query_id", "left").withColumn("after", F.lit(n_probe))
    if not exact:
        left = left.where("least is null")
    rest = _read(_probes(left.select("query_id", "vector", "after", "least"), index, len(index.centres)), index, k, schema)
    return ranked(first.drop("vec_rank").unionByName(rest), k, index.id_col)


def calibrated_probes(queries: DataFrame, vectors: DataFrame, index: CellIndex, k: int, share: float = 0.95, vector_col: str = "vector") -> int:
    """How many of its nearest cells a query has to read to find ``share`` of its ``k`` exact hits.

    Measured on at most ``SAMPLE_QUERIES`` queries, those of the smallest hashed ids, against all vectors. Vectors
    without clusters need many cells.
    """
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    sample = cut_lineage(asked.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE_QUERIES))
    cells = index.blocks.select("cell", F.explode("v_ids").alias(index.id_col))
    hits = exact_topk(sample, vectors, k, index.id_col, vector_col).join(cells, index.id_col).groupBy("query_id").agg(F.collect_list("cell").alias("cells"))
    rows = hits.join(sample, "query_id").collect()
    if not rows:
        return 1
    sims = units([r["vector"] for r in rows]) @ index.centres.T
    sims[:, index.radius < 0] = -2.0
    place = np.argsort(np.argsort(-sims, axis=1, kind="stable"), axis=1)
    places = np.sort(np.concatenate([place[i, r["cells"]] for i, r in enumerate(rows)]))
    return int(places[min(len(places), -(-int(share * 1000) * len(places) // 1000)) - 1]) + 1


def recall(found: DataFrame, exact: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """How many of each query's exact hits were found: query_id, hits_exact, hits_found."""
    hit = found.select("query_id", id_col, F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", id_col], "left").groupBy("query_id").agg(F.count("*").alias("hits_exact"), F.count("hit").alias("hits_found"))


def write_index(index: CellIndex, path: str) -> None:
    """Keep an index: its blocks, and one row per cell."""
    spark = index.blocks.sparkSession
    index.blocks.write.parquet(f"{path}/blocks")
    cells = [(i, c.tolist(), float(r), int(n)) for i, (c, r, n) in enumerate(zip(index.centres, index.radius, index.n_blocks, strict=True))]
    spark.createDataFrame(cells, "cell int, centre array<double>, radius double, n_blocks long").coalesce(1).write.parquet(f"{path}/cells")


def read_index(spark, path: str, id_col: str = "chunk_id") -> CellIndex:
    """A kept index; its cells are at most ``MAX_CELLS``."""
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
    return CellIndex(spark.read.parquet(f"{path}/blocks"), np.array([r["centre"] for r in cells]), np.array([r["radius"] for r in cells]), np.array([r["n_blocks"] for r in cells]), id_col)
