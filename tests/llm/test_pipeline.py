"""The pipeline, stage by stage, against brute-force versions on a small corpus."""

import random
import re

import pytest

from test_llm_operators import WORDS, documents, jaccard_components, prose

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def junk(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("$$$ ### *** %%% buy CLICK win!!! 0000") + r.choice(WORDS[:3]) + "@@" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good prose, junk, copies, near copies, leaks, odd rows; labels of some; a benchmark."""
    items = [(0, prose(900, 40)), (1, prose(901, 60)), (2, None), (3, "")]
    good = [(i, prose(i, 60 + i % 50)) for i in range(120)]
    bad = [(200 + i, junk(i, 50 + i % 30)) for i in range(120)]
    base = prose(5, 65).split()
    copies = [(400, prose(3, 63)), (401, prose(3, 63).replace(" ", "\n ", 2)), (402, " ".join(base).replace(" ", "  ", 2))]
    near = [(410 + i, " ".join([*base[:-1], f"end{i}"])) for i in range(6)]
    w = items[1][1].split()
    leaks = [(420, prose(77, 30) + " " + items[0][1] + " " + prose(78, 30)), (421, " ".join([prose(76, 9), *w[30:], *w[:30], prose(75, 9)])), (422, prose(79, 50) + " " + " ".join(items[1][1].split()[:20]))]
    odd = [(500, None), (501, ""), (502, " \n "), (503, prose(503, 4000)), (120, prose(120, 70)), (120, prose(120, 70))]
    rows = good + bad + copies + near + leaks + odd
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i, _ in good + bad if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, items


def leaked(text, item):
    """Whether any window of the item's size is similar enough; five-word shingles, each as often as it occurs."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    a, b = words(item), words(text)
    if not a or not b:
        return False
    bag = lambda w: sorted(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = bag(a)
    for lo in range(max(1, len(b) - len(a) + 1)):
        left, both = list(want), 0
        got = bag(b[lo : lo + len(a)])
        for x in got:
            if x in left:
                left.remove(x)
                both += 1
        if got and 100 * both >= 80 * (len(want) + len(got) - both):
            return True
    return False


def test_every_stage_against_brute_force(spark, folder):
    where, rows, items = folder
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    key = lambda x: (x[0], x[1] or "")

    # Quality: prose stays, junk goes.
    now = stages["quality_classifier"](spark, docs, where)
    assert now.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in now.collect()), key=key)
    want = sorted((x for x in rows if not 200 <= x[0] < 320), key=key)
    blank = lambda x: not (x[1] or "").strip()
    assert [x for x in got if not blank(x)] == [x for x in want if not blank(x)]

    # The further stages take all rows but the junk, so that blank ones reach them too.
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in want], COLUMNS).write.parquet(f"{where}/kept")
    docs = spark.read.parquet(f"{where}/kept")
    groups = {}
    for i, t in want:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((i, t))
    want = sorted(min(g, key=lambda x: x[0]) for g in groups.values())
    now = stages["exact_dedup"](spark, docs, where)
    assert now.columns == docs.columns
    got = kept(now)
    assert [i for i, _ in got] == [i for i, _ in want]

    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in got], COLUMNS).write.parquet(f"{where}/exact")
    docs = spark.read.parquet(f"{where}/exact")
    sets, part = jaccard_components(got, 5, 80)
    want = [x for x in got if part[x[0]] == x[0]]
    assert len(want) < len(got)
    got = kept(stages["near_dedup"](spark, docs, where))
    assert got == want

    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in got], COLUMNS).write.parquet(f"{where}/near")
    docs = spark.read.parquet(f"{where}/near")
    want = [x for x in got if not any(leaked(x[1], item) for _, item in items)]
    assert {x[0] for x in got} - {x[0] for x in want} == {420, 421}
    got = kept(stages["decontamination"](spark, docs, where))
    assert got == want

    packed = stages["packing"](spark, docs.where("doc_id not in (420, 421)"), where)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in got}


def test_run_is_its_stages(spark, folder):
    where, rows, _ = folder
    got = {r.doc_id for r in corpus_pipeline.run(spark, where).collect()}
    expected = {i for i, t in rows if not 200 <= i < 320 and (t or "").strip()} - {400, 401, 402, 420, 421} - {410 + i for i in range(6)}
    assert {i for i in got if i < 500 or i == 503} == expected


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, folder, name):
    where, _, _ = folder
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents(spark)
    out = stage(spark, docs, where)
    ids = {r.doc_id for r in out.collect()}
    assert ids <= {r.doc_id for r in docs.collect()}
    assert stage(spark, docs.where("doc_id < -1"), where).collect() == []
    if name != "packing":
        assert out.columns == docs.columns
    if name not in ("quality_classifier", "exact_dedup"):
        assert {6, 7, 8, None} <= ids


def test_each_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names
