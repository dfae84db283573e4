"""Operators on small fixtures with hand-computed answers."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.scoring import WEIGHTS
from tessera.operators import artifacts as A
from tessera.operators import feedback as FB
from tessera.operators import graph as G
from tessera.operators import ranking as R
from tessera.operators import reports as RP
from tessera.operators import search as S
from tessera.plans import workloads
from tessera.sources import readers, stores

CATALOG = "ord int, name string, key_lower string, description string, criticality string, tags array<string>, labels array<string>, patterns array<string>, dependencies array<string>"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def tree(spark, *drop):
    files = [("docs/overview.md", "Kasmina module design.\n"), ("docs/obsolete.md", "Old.\n"), ("src/project/kasmina/module.py", "def run():\n    return 'ok'\n"), ("tests/test_module.py", "def test_run():\n    assert True\n")]
    return spark.createDataFrame([f for f in files if f[0] not in drop], "path string, content string")


LEDGER = "path string, artifact_type string, subsystem string, digest string, git_commit string, git_timestamp long, chunk_count long, coverage_ratio double, last_seen double"


@pytest.mark.parametrize(("n", "chunks"), [(1, 1), (800, 1), (801, 2), (1000, 2), (1001, 2), (1600, 2), (1601, 3)])
def test_chunk_counts(spark, n, chunks):
    df = spark.createDataFrame([("a", "x" * n)], "path string, content string")
    assert A.chunk(df).count() == chunks


def test_chunk_texts(spark):
    df = spark.createDataFrame([("a", "abcdefghij"), ("b", " \n "), ("c", ""), ("d", None)], "path string, content string")
    assert rows(A.chunk(df, 5, 1), "chunk_id", "text") == [("a::0", "abcde"), ("a::1", "efghi"), ("a::2", "ij")]
    with pytest.raises(ValueError):
        A.chunk(df, 0, 1)


def test_ingest_twice(spark):
    catalog = spark.createDataFrame([], CATALOG)
    arts = A.attach_catalog(A.describe(tree(spark), A.source_prefixes(tree(spark))), catalog).withColumn("git_timestamp", F.lit(None).cast("long"))
    none = spark.createDataFrame([], LEDGER)
    first = workloads.ingest(arts, catalog, none, None, 1.0, 64, 10)
    assert rows(first["states"], "path", "state") == [(p, "new") for p in ("docs/obsolete.md", "docs/overview.md", "src/project/kasmina/module.py", "tests/test_module.py")]
    assert first["fresh"].count() == 4 and first["removed"].count() == 0
    ledger, store = stores.cut_lineage(first["ledger"]), stores.cut_lineage(first["chunks"])
    later = arts.where("path <> 'docs/obsolete.md'")
    second = workloads.ingest(later, catalog, ledger, store, 2.0, 64, 10)
    assert {r.state for r in second["states"].collect()} == {"skipped"}
    assert rows(second["removed"], "path", "status") == [("docs/obsolete.md", "deleted")]
    assert second["fresh"].count() == 0 and second["chunks"].count() == 3
    assert rows(second["ledger"], "path", "chunk_count", "last_seen") == [("docs/overview.md", 1, 2.0), ("src/project/kasmina/module.py", 1, 2.0), ("tests/test_module.py", 1, 2.0)]
    assert A.classify(later, ledger, incremental=False).where("state = 'skipped'").count() == 0


def test_catalog_patterns(spark):
    cat = [(0, "GatewayCore", ["gateway/api/"]), (1, "Observability", ["docs/OBSERVABILITY_"]), (2, "ReleaseTooling", ["docs/archive/WP6/", "*.sh"])]
    catalog = spark.createDataFrame([(o, n, n.lower(), None, "high", [], [], p, []) for o, n, p in cat], CATALOG)
    paths = ["docs/archive/WP6/x.md", "docs/OBSERVABILITY_GUIDE.md", "docs/FAQ.md", "scripts/a.sh", "scripts/a.shx"]
    arts = A.describe(spark.createDataFrame([(p, "x") for p in paths], "path string, content string"), ["src"])
    got = dict(rows(A.attach_catalog(arts, catalog), "path", "subsystem"))
    assert got == {paths[0]: "ReleaseTooling", paths[1]: "Observability", paths[2]: None, paths[3]: "ReleaseTooling", paths[4]: None}


def test_graph_edges(spark):
    arts = spark.createDataFrame([("src/project/nissa/handler.py", "code", "Nissa", 1_700_000_000, ["IntegrationSync"], ["TelemetryEvent"])], "path string, artifact_type string, subsystem string, git_timestamp long, message_entities array<string>, telemetry_signals array<string>")
    catalog = spark.createDataFrame([(0, "Nissa", "nissa", "Runtime orchestrator", "high", ["runtime"], [], [], ["kasmina", "Nissa"])], CATALOG)
    chunks = spark.createDataFrame([("src/project/nissa/handler.py", "code", "src/project/nissa/handler.py::0")], "path string, artifact_type string, chunk_id string")
    file = "SourceFile:src/project/nissa/handler.py"
    edges = G.build_edges(arts.unionByName(arts), catalog, chunks)
    assert rows(edges, "src", "type", "dst") == sorted(
        [(file, "BELONGS_TO", "Subsystem:Nissa"), ("Subsystem:Nissa", "DEPENDS_ON", "Subsystem:Kasmina"), ("Subsystem:Nissa", "IMPLEMENTS", "IntegrationMessage:IntegrationSync"), ("Subsystem:Nissa", "EMITS", "TelemetryChannel:TelemetryEvent"), (file, "DECLARES", "IntegrationMessage:IntegrationSync"), (file, "HAS_CHUNK", "Chunk:src/project/nissa/handler.py::0")], key=str
    )
    nodes = G.build_nodes(arts, catalog, chunks)
    assert G.check_graph(nodes, edges).count() == 0
    assert dict(rows(G.path_depth(nodes, edges), "id", "depth"))["Chunk:src/project/nissa/handler.py::0"] == 2
    near = {r.id: (r.hops, r.first_type) for r in G.subsystem_neighbourhood(spark.createDataFrame([("Nissa",)], "name string"), edges, 2).collect()}
    assert near["Subsystem:Kasmina"] == (1, "DEPENDS_ON") and near["Chunk:src/project/nissa/handler.py::0"] == (2, "BELONGS_TO")
    with pytest.raises(ValueError):
        G.orphan_nodes(nodes, edges, "Subsystem")


def search_case(spark, hits, weights, query, lexical=0.25, related=("DESCRIBES",)):
    """Scores of ``(path, subsystem, vector, text)`` hits, each with a graph of one subsystem edge."""
    data = [(0, p, v, i + 1, query, t, s, "code", []) for i, (p, s, v, t) in enumerate(hits)]
    df = spark.createDataFrame(data, "query_id int, path string, vector_score double, vec_rank int, query string, text string, subsystem string, artifact_type string, tags array<string>")
    df = df.withColumns({"chunk_id": F.col("path"), "coverage_ratio": F.lit(None).cast("double"), "coverage_missing": F.lit(0.0), "git_timestamp": F.lit(None).cast("long"), "subsystem_criticality": F.lit(None).cast("string")})
    nodes = [(f"SourceFile:{p}", "SourceFile", None, p, s, None, None) for p, s, _, _ in hits if s] + [("Subsystem:core", "Subsystem", "core", None, None, None, None), ("DesignDoc:d", "DesignDoc", None, "d", None, None, None)]
    nodes = spark.createDataFrame(nodes, "id string, label string, name string, path string, subsystem string, criticality string, git_timestamp long")
    edges = [(f"SourceFile:{p}", "BELONGS_TO", "Subsystem:core") for p, s, _, _ in hits if s] + [(f"SourceFile:{p}", "DESCRIBES", "DesignDoc:d") for p, s, _, _ in hits if s and related]
    edges = spark.createDataFrame(edges or [("x", "y", "z")], "src string, type string, dst string")
    context = S.graph_context(df.select("path", "artifact_type"), nodes, edges).withColumn("depth", F.lit(None).cast("int"))
    return S.score(df.join(context, "path", "left"), weights, 1_700_000_000.0, lexical_weight=lexical)


DATACLASS_WEIGHTS = dict(zip(WEIGHTS, (0.30, 0.05, 0.10, 0.15, 0.12), strict=True))


def test_graph_boost_and_order(spark):
    one = search_case(spark, [("src/module.py", "core", 0.9, "x")], DATACLASS_WEIGHTS, "core latency", lexical=0.0).first()
    assert one.adjusted_score == pytest.approx(0.9 + 0.30 + 0.05 * 2 + 0.10 * 0.2)
    two = search_case(spark, [("other", None, 0.95, "x"), ("core", "core", 0.80, "x")], DATACLASS_WEIGHTS, "core telemetry", lexical=0.0)
    assert [r.path for r in S.rank_results(two).orderBy("rank").collect()] == ["core", "other"]
    assert [r.path for r in S.rank_results(two, "vector_score").orderBy("rank").collect()] == ["other", "core"]
    model = S.model_score(two, ["vector_score"], [-1.0], 1.0)
    assert {r.path: round(r.adjusted_score, 9) for r in model.collect()} == {"other": 0.05, "core": 0.20}
    assert S.model_score(two, ["unknown"], [1.0], 0.0).first().model_contributions is None


def test_lexical_breaks_ties(spark):
    got = search_case(spark, [("foo", None, 0.6, "foo details"), ("bar", None, 0.6, "unrelated content")], DATACLASS_WEIGHTS, "foo", lexical=0.5)
    assert {r.path: round(r.adjusted_score, 9) for r in got.collect()} == {"foo": 1.1, "bar": 0.6}
    assert {r.path: r.metadata_warnings_count for r in got.collect()} == {"foo": 1, "bar": 2}


def test_topk_ties_and_zero_vectors(spark):
    chunks = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(99, [0.0, 0.0])], "chunk_id long, vector array<float>").repartition(5)
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, vector array<float>")
    got = S.vector_topk(queries, chunks, 3).collect()
    assert sorted((r.query_id, r.chunk_id, r.vector_score, r.vec_rank) for r in got) == [(q, i, float(q == 1), i + 1) for q in (1, 2) for i in range(3)]
    assert S.vector_topk(queries, chunks, 500).where("query_id = 1").count() == 25


def event(request, rank, vote, **more):
    return {"request_id": request, "timestamp": "2024-08-01T00:00:00Z", "rank": rank, "query": "q", "result_count": 2, "chunk_id": f"c{rank}", "vector_score": 0.8, "signals": {"subsystem_affinity": 1.0}, "graph_context_present": True, "feedback_vote": vote, "metadata": {"request_id": request, "warnings": ["a", "b"]}} | more


def test_feedback_log(spark, tmp_path):
    lines = [json.dumps(event("req-1", 1, 4.0, context={"task": "x"})), "", "{broken", json.dumps(event("req-2", 1, None, metadata={"warnings": "late"}))]
    (tmp_path / "events.jsonl").write_text("\n".join(lines))
    events, stats = readers.read_feedback(spark, str(tmp_path / "events.jsonl"))
    assert tuple(stats.first()) == (2, 1)
    flat, counts = FB.export_dataset(events, with_vote=True)
    assert tuple(counts.first()) == (2, 1, 1) and flat.columns == list(readers.FIELDS)
    row = flat.first()
    assert (row.metadata_warnings_count, row.context_json, row.signal_subsystem_affinity) == (2, '{"task":"x"}', "1.0")
    everything, _ = FB.export_dataset(events)
    assert {r.request_id: r.metadata_warnings_count for r in everything.collect()} == {"req-1": 2, "req-2": 1}
    for suffix in ("csv", "jsonl"):
        path = str(tmp_path / f"set.{suffix}")
        readers.write_dataset(everything, path)
        assert readers.read_dataset(spark, path).count() == 1
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "x.parquet")


PRUNE = "request_id string, timestamp string, seq long"


def test_prune(spark):
    now = "2024-09-01T12:00:00Z"
    log = spark.createDataFrame([("req-int", "1700000000", 0), ("req-z", "2024-08-01T00:00:00Z", 1), ("req-none", None, 2)], PRUNE)
    assert FB.prune_feedback(log, now, max_requests=5)[0].count() == 3
    log = spark.createDataFrame([("old", "2024-07-23T12:00:00Z", 0), ("new", "2024-08-27T12:00:00Z", 1)], PRUNE)
    kept, stats = FB.prune_feedback(log, now, max_age_days=30)
    assert [r.request_id for r in kept.collect()] == ["new"] and tuple(stats.first()) == (2, 1, 1)
    log = spark.createDataFrame([("only", "2024-07-01T00:00:00Z", 0)], PRUNE)
    kept, stats = FB.prune_feedback(log, now, max_age_days=1)
    assert kept.count() == 1 and tuple(stats.first()) == (1, 1, 0)
    log = spark.createDataFrame([("older", "not-a-timestamp", 0), ("middle", "2024-08-27T12:00:00Z", 1), ("newest", "2024-08-31T12:00:00Z", 2)], PRUNE)
    assert {r.request_id for r in FB.prune_feedback(log, now, max_requests=2)[0].collect()} == {"middle", "newest"}
    assert tuple(FB.prune_feedback(log.limit(0), now, max_age_days=30)[1].first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        FB.prune_feedback(log, now)


def test_redact(spark):
    df = spark.createDataFrame([("a", "{}", "n"), ("", None, None), (None, "", "x")], "query string, context_json string, feedback_note string")
    out, stats = FB.redact(df)
    assert [tuple(r) for r in out.collect()] == [("", "", "n"), ("", None, None), (None, "", "x")] and tuple(stats.first()) == (3, 1)


GOLDEN = [("req-1", 1, 0.82, 1.0, 2, 0.3, 0, 1, 5, 1, 0), ("req-1", 2, 0.70, 0.5, 1, 0.1, 0, 1, 3, 1, 0), ("req-2", 1, 0.65, 1.0, 1, 0.4, 0, 1, 4, 1, 0), ("req-2", 2, 0.78, 0.5, 1, 0.2, 0, 1, 3, 1, 0)]


def test_golden_model(spark, tmp_path):
    names = ("request_id", "rank", "vector_score", "signal_subsystem_affinity", "signal_relationship_count", "signal_supporting_bonus", "signal_coverage_missing", "graph_context_present", "feedback_vote", "metadata_graph_context_included", "metadata_warnings_count")
    df = spark.createDataFrame([tuple(str(x) for x in g) for g in GOLDEN], list(names)).withColumn("seq", F.monotonically_increasing_id())
    model, metrics = workloads.train_and_evaluate(df, "2024-09-01T00:00:00Z")
    assert model.coefficients == pytest.approx([-0.31592, 1.81677, 1.07898, 0.25274, 0, 0.40284, 0.40284, 0], abs=1e-4) and model.intercept == pytest.approx(0.40284, abs=1e-4)
    m = metrics.first()
    assert m.mse < 1e-6 and m.r2 == pytest.approx(1.0) and m.ndcg_at_5 == pytest.approx(1.0) and m.spearman == pytest.approx(1.0)
    stores.save_model(spark, model, str(tmp_path / "model"))
    assert stores.load_model(spark, str(tmp_path / "model")) == model
    with pytest.raises(ValueError):
        R.train_model(df.limit(0))


def test_reports(spark):
    now, day = 1_700_000_000.0, 86_400
    arts = spark.createDataFrame([("docs/current.md", "doc", "Kasmina", int(now), 1), ("docs/old.md", "DesignDoc", "Kasmina", int(now) - 40 * day, 1), ("src/service.py", "code", "Kasmina", int(now), 0), ("x.py", "code", None, None, 1)], "path string, artifact_type string, subsystem string, git_timestamp long, chunk_count long")
    assert rows(RP.stale_docs(arts, 30, now), "path") == [("docs/old.md",)]
    assert rows(RP.missing_tests(arts), "subsystem", "source_files", "test_cases") == [("Kasmina", 1, 0), ("unknown", 1, 0)]
    summary, missing = RP.coverage_report(arts, arts.limit(1), 3)
    assert tuple(summary.first()) == (4, 3, 1, 1) and rows(missing, "path") == [("src/service.py",)]
    snaps = spark.createDataFrame([(i, "p") for i in range(4)], "generated_at long, profile string")
    assert rows(stores.retain_latest(snaps, "generated_at", 2), "generated_at") == [(2,), (3,)]
    assert rows(RP.run_deltas(snaps.withColumn("v", F.col("generated_at") ** 2), ("v",)), "generated_at", "v_delta") == [(0, None), (1, 1.0), (2, 3.0), (3, 5.0)]
    checks = spark.createDataFrame([("coverage", now), ("audit", None), ("late", now - 90_000)], "check_name string, generated_at double")
    assert rows(RP.health_status(checks, now), "check_name", "status", "overall") == [("audit", "missing", "degraded"), ("coverage", "ok", "degraded"), ("late", "stale", "degraded")]


def test_fingerprints(spark):
    old = spark.createDataFrame([("file", "h1"), ("gone", "h"), ("same", "s")], "path string, digest string")
    new = spark.createDataFrame([("file", "h2"), ("extra", "h"), ("same", "s")], "path string, digest string")
    assert rows(A.diff_fingerprints(old, new), "path", "change") == [("extra", "added"), ("file", "changed"), ("gone", "removed")]


def test_read_tree_and_catalog(spark, tmp_path):
    for path, data in {"docs/a.md": b"one\r\ntwo\rthree", "docs-old/x": b"plain", "src/b.bin": b"\x00\x01", "src/c.py": b"\xff\xfe", "other/d.md": b"no", "src/e": b"text"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    got = rows(readers.read_artifacts(spark, str(tmp_path)), "path", "content")
    assert got == [("docs-old/x", "plain"), ("docs/a.md", "one\ntwo\nthree"), ("src/e", "text")]
    (tmp_path / "bad.json").write_text("[1")
    (tmp_path / "cat.json").write_text(json.dumps({"Core": {"criticality": "high", "paths": ["gateway/"], "depends_on": ["Obs"]}, "Obs": {}}))
    cat = readers.read_catalog(spark, [str(tmp_path / "bad.json"), str(tmp_path / "cat.json")]).collect()
    assert [(r.ord, r.name, r.criticality, r.patterns, r.dependencies) for r in cat] == [(0, "Core", "high", ["gateway/"], ["Obs"]), (1, "Obs", None, [], [])]


def test_shell_patterns(spark):
    cases = {"docs/[ab]*.md": ("docs/a1.md", "docs/c1.md"), "docs/[!ab]?.md": ("docs/c1.md", "docs/a1.md"), "x[*]y": ("x*y", "xzy"), "a[b": ("a[b", "ab"), "p.d+": ("p.d+", "pxdd"), "*/end": ("a/b/end", "a/end/b"), "line*": ("line\nmore", "a line")}
    df = spark.createDataFrame([(p, t) for p, ts in cases.items() for t in ts], "p string, t string")
    got = {(r.p, r.t): r.hit for r in df.withColumn("glob", A.glob_regex(F.col("p"))).withColumn("hit", F.expr("t rlike glob")).collect()}
    assert got == {(p, t): t == ts[0] for p, ts in cases.items() for t in ts}


def test_page_offsets(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    info = lambda at, n: G.page(df, [F.col("k")], at, n)[1].first()
    assert [tuple(info(*x)) for x in ((0, 4), (4, 4), (8, 4), (6, 4), (20, 4))] == [(10, 4), (10, 8), (10, None), (10, 10), (10, None)]


def test_lexical_score_reads_the_whole_text(spark):
    df = spark.createDataFrame([("needle", "x " * 5000 + "needle"), ("needle", "x " * 5000), (None, "a"), ("a", None)], "q string, t string")
    from tessera.functions.scoring import lexical_score

    assert [r.s for r in df.select(lexical_score(F.col("q"), F.col("t")).alias("s")).collect()] == [1.0, 0.0, 0.0, 0.0]
