"""The four workloads as functions of DataFrames: ingest, search, training, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import resolve_weights
from ..operators import artifacts as A
from ..operators import feedback as FB
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import reports as RP
from ..operators import search as S
from ..operators.vectors import CellIndex
from ..sources.stores import RankingModel, cut_lineage, replace_paths


def ingest(artifacts: DataFrame, catalog: DataFrame, ledger: DataFrame, chunks: DataFrame | None, run_ts: float, window: int = 1000, overlap: int = 200, embedder=None) -> dict[str, DataFrame]:
    """Incremental ingest: only changed artifacts are chunked and embedded.

    Returns states, chunks (the store after the run), fresh (this run's chunks), nodes, edges, removed
    and the next ledger.
    """
    # Digests meet the ledger without the texts, once for all that follows; then only changed texts are read on.
    states = cut_lineage(A.classify(artifacts, ledger).drop("content"))
    changed = artifacts.join(states.where("state <> 'skipped'").select("path"), "path", "left_semi")
    fresh = A.embed(A.chunk(changed, window, overlap), embedder)
    removed = A.removed_artifacts(ledger, artifacts)
    store = fresh
    if chunks is not None:
        touched = states.where("state <> 'skipped'").select("path").unionByName(removed.select("path")).distinct()
        store = replace_paths(chunks.join(touched, "path", "left_anti"), fresh)
    counts = A.chunk_counts(fresh)
    return {
        "states": states, "chunks": store, "fresh": fresh, "removed": removed, "ledger": A.merge_ledger(states, counts, run_ts),
        "nodes": G.build_nodes(artifacts, catalog, store), "edges": G.build_edges(artifacts, catalog, store),
    }


def search(queries: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, now: float, profile: str = "default", model: RankingModel | None = None, by: str = "adjusted_score", index: CellIndex | None = None, **weights: float) -> DataFrame:
    """Ranked hits of a batch of queries, exact or through an index of the chunks' vectors.

    ``queries`` has query_id, query, vector and the filter columns q_artifact_types, q_namespaces,
    q_tags, q_subsystems, q_updated_after, q_max_age_days; ``chunks`` has the chunk columns and vector.
    """
    hits = S.vector_topk(queries, chunks, k, index=index).join(chunks.drop("vector"), "chunk_id").join(queries.drop("vector"), "query_id")
    hits = S.payload_filters(hits)
    paths = hits.select("path", "artifact_type").distinct()
    context = S.graph_context(paths, nodes, edges).join(G.path_depth(nodes, edges).select(F.col("id").alias("node_id"), "depth"), "node_id", "left")
    hits = S.recency_filter(S.subsystem_filter(hits.join(context, "path", "left")), now)
    scored = S.score(hits, resolve_weights(profile, **weights)[1], now)
    if model is not None:
        scored = S.model_score(scored, model.feature_names, model.coefficients, model.intercept)
    return S.rank_results(scored, by)


def train_and_evaluate(events: DataFrame, now: str, max_requests: int | None = None, max_age_days: int | None = None, k: tuple[int, ...] = (5, 10)) -> tuple[RankingModel, DataFrame]:
    """Prune, keep voted rows, fit, evaluate: the model and one row of metrics. ``events`` is flat, with seq."""
    rows = events
    if max_requests is not None or max_age_days is not None:
        rows, _ = FB.prune_feedback(events, now, max_age_days, max_requests)
    model = R.train_model(FB.require_vote(rows))
    pred = R.predict(rows.withColumn("vote", F.col("feedback_vote").cast("double")).where("vote is not null"), model)
    out = R.regression_metrics(pred).crossJoin(R.spearman(pred))
    for n in k:
        out = out.crossJoin(R.mean_ndcg(pred, n).drop("n_requests"))
    return model, out


def audit(artifacts: DataFrame, nodes: DataFrame, edges: DataFrame, removed: DataFrame, stale_days: int, now: float) -> DataFrame:
    """One row with the counts of stale documents, isolated nodes, untested subsystems, removed artifacts."""
    return RP.lifecycle_summary(RP.stale_docs(artifacts, stale_days, now), RP.isolated_nodes(nodes, edges), RP.missing_tests(artifacts), removed)
