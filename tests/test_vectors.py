"""Vector search: exact in blocks, and through the index of cells."""

import numpy as np
import pytest

from tessera.operators import search as S
from tessera.operators import vectors as V


@pytest.fixture(scope="module")
def points(spark):
    """Clustered vectors of which a third are alike, zero and null ones, ties."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 12))
    x = centres[r.integers(0, 20, 1200)] + r.normal(size=(1200, 12)) * 0.4
    x[:400] = x[0] + r.normal(size=(400, 12)) * 0.01
    x[10:20] = x[10]
    x[7] = 0
    rows = [(i, v.tolist() if i != 9 else None) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>").repartition(5)
    queries = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    return x, vectors, queries


def brute(x, k):
    """The k nearest by score to ten places, then id."""
    u = V.units(x)
    out = {}
    for q in range(0, len(x), 20):
        sims = u @ u[q]
        out[q] = sorted(((-round(s, 10), i) for i, s in enumerate(sims) if i != 9))[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.vec_rank, -round(r.vector_score, 10), r.chunk_id))
    return {q: [v[1:] for v in sorted(vs)] for q, vs in out.items()}


def test_exact(spark, points, monkeypatch):
    x, vectors, queries = points
    monkeypatch.setattr(V, "VECTOR_BLOCK", 37)
    monkeypatch.setattr(V, "QUERY_BLOCK", 11)
    got, want = found(V.exact_topk(queries, vectors, 7)), brute(x, 7)
    assert {q: [s for s, _ in v] for q, v in got.items()} == {q: [s for s, _ in v] for q, v in want.items()}
    assert found(S.vector_topk(queries, vectors, 7)).keys() == want.keys()
    assert V.exact_topk(queries.limit(0), vectors, 3).count() == 0 == V.exact_topk(queries, vectors.limit(0), 3).count()


@pytest.mark.parametrize("n_probe", [1, 3])
def test_proven_hits_are_exact(spark, points, monkeypatch, n_probe):
    """A crowded cell, of vectors and of queries, is shared by several groups of the join."""
    x, vectors, queries = points
    for name, n in (("VECTOR_BLOCK", 16), ("QUERY_BLOCK", 3), ("GROUP", 2)):
        monkeypatch.setattr(V, name, n)
    index = V.build_index(vectors, 15)
    assert index.n_blocks.max() > 8 and index.n_blocks.sum() == index.blocks.count()
    assert sum(len(r.v_ids) for r in index.blocks.collect()) == len(x) - 1
    got, want = found(V.index_topk(queries, index, 7, n_probe, exact=True)), brute(x, 7)
    assert {q: [s for s, _ in v] for q, v in got.items()} == {q: [s for s, _ in v] for q, v in want.items()}


def test_recall_and_short_cells(spark, points, tmp_path):
    _, vectors, queries = points
    V.write_index(V.build_index(vectors), str(tmp_path / "index"))
    index = V.read_index(spark, str(tmp_path / "index"))
    exact = V.exact_topk(queries, vectors, 10)
    rows = V.recall(V.index_topk(queries, index, 10, 8), exact).collect()
    assert len(rows) == 60 and sum(r.hits_found for r in rows) >= 0.9 * sum(r.hits_exact for r in rows)
    # A query whose cells have too few vectors reads all others.
    tiny = V.build_index(vectors.where("chunk_id > 1150"), 40)
    assert {len(v) for v in found(V.index_topk(queries, tiny, 10, 1)).values()} == {10}
    few = V.build_index(vectors.where("chunk_id > 1196"), 2)
    assert {len(v) for v in found(V.index_topk(queries, few, 10, 1)).values()} == {3}


def test_calibration_reaches_the_share(spark, monkeypatch):
    """Vectors without clusters need many cells; a sample of the queries tells how many."""
    monkeypatch.setattr(V, "SAMPLE_QUERIES", 60)
    r = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(2000, 24)))], "chunk_id long, vector array<double>").repartition(4)
    queries = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    index = V.build_index(vectors)
    n = V.calibrated_probes(queries, vectors, index, 10)
    assert 1 < n <= len(index.centres)
    rows = V.recall(V.index_topk(queries, index, 10, n), V.exact_topk(queries, vectors, 10)).collect()
    assert len(rows) == 100 and sum(r.hits_found for r in rows) >= 0.9 * sum(r.hits_exact for r in rows)
    assert V.calibrated_probes(queries.limit(0), vectors, index, 10) == 1


def test_recall_of_the_example_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id as chunk_id", "embedding as vector")
    queries = e.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    rows = V.recall(V.index_topk(queries, V.build_index(e), 10), V.exact_topk(queries, e, 10)).collect()
    assert sum(r.hits_found for r in rows) >= 0.9 * sum(r.hits_exact for r in rows)
