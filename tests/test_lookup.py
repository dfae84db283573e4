"""Index joins, the page directory, the subsystem graph, least squares and NDCG against plain versions."""

import fnmatch
import itertools
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import artifacts as A
from tessera.operators import graph as G
from tessera.operators import lookup as L
from tessera.operators import ranking as R
from tessera.functions import text as T

NESTED = ("BroadcastNestedLoopJoin", "CartesianProduct")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_pattern(spark):
    r = random.Random(2)
    parts = ["docs", "src", "a", "b", "x.yml", "readme.md", "[x]"]
    paths = sorted({"/".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(150)} | {"docs/*/x", "", "src/a*b"})
    patterns = ["docs/", "src/a*", "*.yml", "*a*", "?rc/*", "docs/*/x.yml", "src/[ab]/*", "*[x]", "a", "*/", "**", "src/a*b", "[!d]*.md", "docs/*/x", "readme.md"]
    for some in (patterns, patterns[:3], ["*[x]"], ["nothing/"]):
        df = spark.createDataFrame(list(enumerate(some)), "ord int, p string")
        df = df.select("ord", "p", F.rtrim(F.col("p"), F.lit("*/")).alias("base"), A.glob_regex(F.col("p")).alias("glob"))
        found = L.first_pattern(spark.createDataFrame([(p,) for p in paths], "path string"), df)
        want = {}
        for path in paths:
            fits = [i for i, p in enumerate(some) if (p.rstrip("*/") and path.startswith(p.rstrip("*/"))) or fnmatch.fnmatchcase(path, p)]
            if fits:
                want[path] = min(fits)
        assert {x.path: x.hit_ord for x in found.collect()} == want
    assert not any(n in plan(found) for n in NESTED)


def test_many_patterns(spark):
    """A hundred thousand patterns over as many paths of one folder."""
    n = 100_000
    paths = spark.range(n).select(F.concat(F.lit("src/app/"), "id", F.lit("/file.py")).alias("path"))
    patterns = spark.range(n).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("src/app/"), "id", F.lit("/")).alias("base"), F.lit("^$").alias("glob"), F.concat(F.lit("src/app/"), "id", F.lit("/")).alias("p"))
    began = time.time()
    got = L.first_pattern(paths, patterns).join(paths, "path")
    assert got.where(F.concat(F.lit("src/app/"), "hit_ord", F.lit("/file.py")) == F.col("path")).count() == n
    assert time.time() - began < 120


def test_containing(spark):
    r = random.Random(4)
    texts = [(f"n{i}", "".join(r.choice("abcAé/ .") for _ in range(r.randrange(9))) if i % 9 else None, i) for i in range(400)]
    terms = ["", "a", "AB", "abc", "b/a", "zzz", "éa", "cab a", ". ", "aa", None, "abc"]
    found = L.containing(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(texts, "id string, text string, n long"))
    want = sorted((t, i) for t in set(terms) if t is not None for i, x, _ in texts if x is not None and t.lower() in x.lower())
    assert sorted((x.term, x.id) for x in found.collect()) == want and len(want) > 600
    assert not any(n in plan(found) for n in NESTED)
    assert L.containing(spark.createDataFrame([], "term string"), spark.createDataFrame(texts, "id string, text string, n long")).count() == 0


def test_pages_of_a_directory(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"id{i}", r.choice([None, "name", f"n{i % 50}"]), f"p{i % 7}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id string, name string, path string").repartition(6)
    keys = [F.col("name"), F.col("path"), F.col("id")]
    G.write_pages(df, keys, str(tmp_path / "pages"), 90)
    for offset, limit in ((0, 25), (85, 30), (400, 250), (975, 25), (990, 25), (1000, 5)):
        got, total, following = G.read_page(spark, str(tmp_path / "pages"), offset, limit)
        want, info = G.page(df, keys, offset, limit)
        assert [tuple(x) for x in got.collect()] == [tuple(x) for x in want.collect()]
        assert (total, following) == tuple(info.first())
    one = G.read_page(spark, str(tmp_path / "pages"), 975, 25)[0]
    assert len({f.rpartition("/")[0] for f in one.inputFiles()}) <= 2


def test_subsystem_graph_through_a_hub(spark):
    """Against breadth-first search; a hub has most edges, and there are loops, parallel edges and repeated names."""
    r = random.Random(6)
    ids = [f"Subsystem:s{i}" for i in range(4)] + [f"F:{i}" for i in range(60)]
    edges = {(r.choice(ids), r.choice("XY"), r.choice(ids)) for _ in range(60)} | {("F:0", "HUB", i) for i in ids[4:]} | {("Subsystem:s0", "X", "F:0"), ("Subsystem:s0", "Y", "F:0")}
    ways = [(a, t, "OUT", b) for a, t, b in edges] + [(b, t, "IN", a) for a, t, b in edges]
    nodes, links, paths = [], [], []
    for name in ("s0", "s1", "s2", "s3"):
        start = f"Subsystem:{name}"
        hops, chosen, front = {start: 0}, {}, [start]
        for hop in range(1, 4):
            step = defaultdict(list)
            for a, t, w, b in ways:
                if a in front and b not in hops:
                    step[b].append((a, t, w))
            for b, options in step.items():
                hops[b], chosen[b] = hop, min(options)
            front = list(step)
        for b in chosen:
            chain, at = [], b
            while at != start:
                chain.append((name, b, hops[at], chosen[at][0], at, chosen[at][1], chosen[at][2]))
                at = chosen[at][0]
            paths += chain
            nodes.append((name, b, hops[b], chain[-1][5], chain[-1][6], len(chosen)))
            links.append((name, chosen[b][0], b, chosen[b][1], chosen[b][2]))
    names = spark.createDataFrame([(n,) for n in ("s0", "s1", "s2", "s3", "s0", "unknown")], "name string")
    got = G.subsystem_graph(names, spark.createDataFrame(sorted(edges), "src string, type string, dst string"), 3)
    for df, want in zip(got, (nodes, links, paths), strict=True):
        assert sorted(map(tuple, df.collect())) == sorted(want)


def test_least_squares_of_an_ill_conditioned_design(spark, monkeypatch):
    """Condition number 1e9, where products of columns keep no digits; and collinear columns, of minimum norm."""
    monkeypatch.setattr(R, "FAN", 3)
    r = np.random.default_rng(3)
    n = 4000
    base = r.normal(size=n)
    x = np.column_stack([base, base + 1e-9 * r.normal(size=n), r.normal(size=n), np.full(n, 2.0)])
    y = x[:, 0] * 2 - x[:, 1] + 0.5 * x[:, 2] + 3 + r.normal(size=n) * 0.1
    names = [f"f{i}" for i in range(4)]
    for design in (x, np.column_stack([x[:, 2], x[:, 2], 3 * x[:, 2], np.zeros(n)])):
        df = spark.createDataFrame([(*map(float, row), float(v)) for row, v in zip(design, y, strict=True)], ", ".join(f"{c} double" for c in names) + ", feedback_vote double").repartition(20)
        model = R.train_model(df, names)
        dense = np.hstack([design, np.ones((n, 1))])
        want, *_ = np.linalg.lstsq(dense, y, rcond=None)
        fitted = dense @ np.array([*model.coefficients, model.intercept])
        assert np.allclose(fitted, dense @ want, atol=1e-6)
        assert np.linalg.norm([*model.coefficients, model.intercept]) <= np.linalg.norm(want) * (1 + 1e-3)
        res = y - dense @ want
        assert model.metrics["mse"] == pytest.approx(float(np.mean(res**2))) and model.metrics["r2"] == pytest.approx(1 - float(res @ res) / float(np.sum((y - y.mean()) ** 2)))
        assert model.training_rows == n


def test_ndcg_of_a_hot_request(spark):
    """Most rows have no request; no window may hold them all, so tasks keep k rows."""
    r = random.Random(9)
    rows = [(None if i % 4 else f"r{i % 40}", float(r.randrange(5)), r.random(), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "request_id string, vote double, prediction double, rank long").repartition(6)
    groups = defaultdict(list)
    for q, vote, p, i in rows:
        groups[q].append((vote, p, i))
    scores = []
    for g in groups.values():
        dcg = lambda xs: sum((2**v - 1) / np.log2(i + 2) for i, (v, *_) in enumerate(xs[:5]))
        if ideal := dcg(sorted(g, key=lambda t: -t[0])):
            scores.append(dcg(sorted(g, key=lambda t: (-t[1], t[2]))) / ideal)
    out = R.mean_ndcg(df, 5)
    assert out.first()[0] == pytest.approx(float(np.mean(scores))) and out.first()[1] == len(scores)
    assert plan(out).count("WindowGroupLimit") >= 2


def test_chunks_in_linear_time(spark):
    """Same chunks as slices, for any window and overlap; twice the text, about twice the time."""
    texts = ["", " ", "abcdefghij", "x" * 1601, "日本𝒳é\n" * 700, "a" * 801]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string").select(F.col("i").cast("string").alias("path"), "content")
    for window, overlap in ((1000, 200), (5, 1), (5, 4), (4, 4), (3, 9), (7, 0), (10, 7)):
        step = T.step_of(window, overlap)
        want = sorted((str(i), n, t[s : s + window]) for i, t in enumerate(texts) if t.strip() for n, s in enumerate(range(0, len(t), step)))
        assert sorted((r.path, r.sequence, r.text) for r in A.chunk(df, window, overlap).collect()) == want
    took = []
    for mb in (2, 2, 8):
        big = spark.range(1).select(F.lit("p").alias("path"), F.repeat(F.lit("0123456789abcdé "), F.lit(mb * 65536)).alias("content"))
        began = time.time()
        assert A.chunk(big).agg(F.sum(F.length("text"))).first()[0] > mb * 1_000_000
        took.append(time.time() - began)
    assert took[2] < 12 * max(took[1], 0.3)


def test_alert_episodes(spark):
    from tessera.operators import telemetry as TM

    r = random.Random(3)
    hours = sorted(r.sample(range(300), 240))
    rows = [(h, r.choice([0.1, 0.2, 0.9, 0.3, None])) for h in hours]
    df = spark.createDataFrame(rows, "h long, v double").select(F.timestamp_seconds(F.col("h") * 3600).alias("window_start"), "v")
    rules = {"low": (F.col("v") < 0.5, F.col("v"), "min", 3 * 3600), "any": (F.col("v").isNotNull(), F.col("v"), "max", 3600)}
    value = dict(rows)
    want = []
    for rule, bad, worst, least in (("low", lambda v: v is not None and v < 0.5, min, 3), ("any", lambda v: v is not None, max, 1)):
        for breach, hs in itertools.groupby(range(300), key=lambda h: bad(value.get(h))):
            hs = list(hs)
            if breach and len(hs) >= least:
                want.append((rule, hs[0], hs[-1], hs[0] + least - 1, len(hs), worst(value[h] for h in hs)))
    got = [(x.rule, *(int(t.timestamp()) // 3600 for t in (x.first_window, x.last_window, x.fired_at)), x.n_windows, x.worst) for x in TM.alert_episodes(df, rules, 3600).select("rule", *(F.col(c).cast("timestamp").alias(c) for c in ("first_window", "last_window", "fired_at")), "n_windows", "worst").collect()]
    assert sorted(got) == sorted(want)
