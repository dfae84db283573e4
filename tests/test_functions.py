"""Column functions on hand-computed values."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import values as V


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_types_and_namespaces(spark):
    paths = ["docs/a.md", "tests/t.py", "src/app/x.py", "src/app/_generated/y.py", ".codacy/c.yml", "docs-old/x", "src"]
    got = values(spark, [(p,) for p in paths], "path string", T.artifact_type(F.col("path")), T.node_label(T.artifact_type(F.col("path"))), T.namespace(F.col("path")))
    assert got == [("doc", "DesignDoc", "docs"), ("test", "TestCase", "tests"), ("code", "SourceFile", "app"), ("proto", "SourceFile", "app"), ("config", "ConfigFile", ".codacy"), ("other", "Artifact", "docs-old"), ("code", "SourceFile", "src")]


def test_subsystems(spark):
    paths = ["src/project/kasmina/module.py", "src/other.py", "src/project", "lib/x.py", "srcx/y/z.py"]
    got = values(spark, [(p,) for p in paths], "path string", T.normalise_name(T.infer_subsystem(F.col("path"), ["src", "src/project"])))
    assert got == [("Kasmina",), ("Other.py",), ("Project",), (None,), (None,)]
    names = values(spark, [(" nissa ",), ("GatewayCore",), ("",), (None,), ("x1",), ("123",)], "n string", T.normalise_name(F.col("n")))
    assert names == [("Nissa",), ("GatewayCore",), (None,), (None,), ("X1",), ("123",)]


def test_entities_and_tags(spark):
    text = "class SyncMessage(Base): TelemetryEvent, SälMessage TelemetryEvent AckMessage"
    got = values(spark, [(text,)], "c string", T.message_entities(F.col("c")), T.telemetry_signals(F.col("c")))
    assert got == [(["AckMessage", "SyncMessage", "SälMessage"], ["TelemetryEvent"])]
    tags = values(spark, [([" b ", "a", ""], None, ["a", "src0"])], "x array<string>, y array<string>, z array<string>", T.build_tags(F.col("x"), F.col("y"), F.col("z")))
    assert tags == [(["a", "b", "src0"],)]


def test_embedding_slug_and_points(spark):
    got = values(spark, [("hello world",), ("",)], "t string", F.transform(T.hash_embed(F.col("t")), lambda x: F.round(x, 9)))
    assert got[0][0] == pytest.approx([0, 0, 0, 0.2, 0, 3 / 7, 0.5, 0])
    assert got[1][0] == pytest.approx([1 / i for i in range(2, 10)])
    assert values(spark, [("Ünïcode  Title!",), ("***",), (None,)], "t string", T.slug(F.col("t"))) == [("unicode-title",), ("document",), ("document",)]
    digest = "b7cc69a5560632a467cb85b6072ac2bee0cb807f8bcc7843e4bf9c9c1427dfbe"
    got = values(spark, [("docs/readme.md", 0, "hello world")], "p string, i int, t string", F.sha2(F.concat_ws(":", "p", "i", "t"), 256))
    assert got == [(digest,)]
    assert values(spark, [(digest,)], "d string", T.point_id(F.col("d"))) == [("b7cc69a5-5606-32a4-67cb-85b6072ac2be",)]


def test_numbers_and_times(spark):
    raw = [("1.5",), (" 2 ",), ("True",), ("",), ("x",), (None,)]
    assert values(spark, raw, "v string", V.to_double(F.col("v"))) == [(1.5,), (2.0,), (1.0,), (None,), (None,), (None,)]
    times = [("1700000000",), ("2024-08-01T00:00:00Z",), ("not-a-time",), ("",), ("0",), (None,)]
    got = values(spark, times, "t string", V.epoch_seconds(V.parse_ts(F.col("t"))))
    assert [g[0] for g in got] == [1_700_000_000, 1_722_470_400, None, None, None, None]
    assert values(spark, [(86_400,), (0,), (None,), (10**9,)], "t long", V.freshness_days(F.col("t"), 172_800)) == [(1.0,), (None,), (None,), (0.0,)]


def test_scores(spark):
    rows = [("foo bar", "foo details", 1.0), ("foo", "unrelated", 0.6), ("", "x", 0.1), ("tele", "telemetry", 0.2)]
    got = values(spark, rows, "q string, t string, v double", S.lexical_score(F.col("q"), F.col("t")))
    assert got == [(0.5,), (0.0,), (0.0,), (0.5,)]
    got = values(spark, [("Core", "core latency"), ("core", "hardcore"), ("", "x"), (None, "x"), ("y", "x")], "s string, q string", S.subsystem_affinity(F.col("s"), F.col("q")))
    assert got == [(1.0,), (0.5,), (0.0,), (0.0,), (0.0,)]
    got = values(spark, [("0.5", None), (None, 1.0), (None, 0.0), ("7", None), ("bad", 1.0)], "r string, m double", S.coverage_ratio(F.col("r"), F.col("m")))
    assert got == [(0.5,), (0.0,), (1.0,), (1.0,), (0.0,)]
    got = values(spark, [("HIGH",), ("0.3",), (None,), ("odd",)], "c string", S.criticality_score(F.col("c")))
    assert got == [(0.8,), (0.3,), (0.0,), (0.0,)]
    got = values(spark, [(["DesignDoc:a", "DesignDoc:b", "DesignDoc:c", "TestCase:t"],)], "r array<string>", S.supporting_bonus(F.col("r")))
    assert got[0][0] == pytest.approx(0.5)


def test_weight_profiles():
    assert S.resolve_weights()[1]["weight_subsystem"] == 0.28
    name, w = S.resolve_weights("analysis", weight_support=7)
    assert name == "analysis+overrides" and w["weight_support"] == 1.0 and w["weight_criticality"] == 0.18
    with pytest.raises(ValueError):
        S.resolve_weights("none")
    assert S.hybrid_weights(0, 0) == (1.0, 0.0) and S.hybrid_weights(-1, 0.5) == (0.0, 0.5)


def test_slugs_read_whole_pages(spark, tmp_path):
    import __spark_entry__

    spark.createDataFrame([(1, "Start " + "mid " * 100 + "End")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r.slug for r in __spark_entry__.queries()["slugs"](spark, str(tmp_path)).collect()] == ["start-" + "mid-" * 100 + "end"]
