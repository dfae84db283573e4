"""The keyed store: merge on read, compaction, a writer that dies."""

import os

import pytest

from tessera.sources.keyed import FULL, KeyedStore

SCHEMA = "path string, point_id string, n long"


def store(spark, tmp_path, buckets=4):
    return KeyedStore(spark, f"file://{tmp_path}/store", SCHEMA, ("point_id",), by="path", buckets=buckets)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def read(s, **k):
    return sorted(map(tuple, s.read(**k).collect()))


def test_upserts_and_drops(spark, tmp_path):
    s = store(spark, tmp_path)
    assert read(s) == []
    s.write(rows(spark, ("a", "a0", 1), ("a", "a1", 1), ("b", "b0", 1)))
    s.write(rows(spark, ("a", "a1", 2), ("c", "c0", 2)))
    assert read(s) == [("a", "a0", 1), ("a", "a1", 2), ("b", "b0", 1), ("c", "c0", 2)]
    # A replaced path loses the chunks of its older text; a drop and a put in one write leave the put.
    s.write(rows(spark, ("a", "a2", 3)), replace=True)
    s.write(rows(spark, ("b", "b1", 4)), drop=rows(spark, ("b", "", 0), ("c", "", 0), ("z", "", 0)))
    assert read(s) == [("a", "a2", 3), ("b", "b1", 4)]
    s.write(drop=rows(spark, ("a", "", 0)))
    s.write(rows(spark, ("a", "a2", 6), ("a", "a2", 6)))
    assert read(s) == [("a", "a2", 6), ("b", "b1", 4)]
    assert read(s, buckets=s.touched(rows(spark, ("b", "", 0)))) >= [("b", "b1", 4)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    s = store(spark, tmp_path, buckets=32)
    s.write(spark.range(500).selectExpr("concat('p', id) as path", "concat('i', id) as point_id", "id as n"))
    before = s.manifest()
    written = s.write(rows(spark, ("p7", "i7", -1), ("p9", "i9", -1))).collect()
    after = s.manifest()
    assert {r.bucket for r in written} == set(s.touched(rows(spark, ("p7", "", 0), ("p9", "", 0)))) and {r.kind for r in written} == {"added"}
    assert [b for b in after.added if after.added[b] != before.added.get(b)] == [str(r.bucket) for r in sorted(written, key=lambda r: list(after.added).index(str(r.bucket)))]
    assert s.read().where("n < 0").count() == 2 and s.read().count() == 500


def test_a_named_write_counts_once(spark, tmp_path):
    s = store(spark, tmp_path)
    for n in (1, 2):
        s.write(rows(spark, ("a", "a0", n)), name="batch-0")
    assert read(s) == [("a", "a0", 1)] and s.manifest().version == 1


def test_a_killed_writer_leaves_the_old_state(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    s.write(rows(spark, ("a", "a0", 1)))
    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            s.write(rows(spark, ("a", "a0", 2)), drop=rows(spark, ("a", "", 0)))
    assert read(s) == [("a", "a0", 1)]
    # A draft of a manifest, as of a writer that died while it wrote, isn't read; another writer's version isn't replaced.
    (tmp_path / "store/manifests/_draft").write_text("{")
    assert read(s) == [("a", "a0", 1)]
    stale = s.manifest()
    s.write(rows(spark, ("b", "b0", 3)))
    monkeypatch.setattr(KeyedStore, "manifest", lambda self: stale)
    with pytest.raises(RuntimeError, match="another writer"):
        s.write(rows(spark, ("c", "c0", 4)))
    monkeypatch.undo()
    assert read(s) == [("a", "a0", 1), ("b", "b0", 3)]
    # What died writers left goes with what nothing names any more.
    assert s.vacuum() >= 2 and read(s) == [("a", "a0", 1), ("b", "b0", 3)]


def test_many_writes_cost_a_read_no_more(spark, tmp_path):
    s = store(spark, tmp_path, buckets=2)
    sizes, want = [], {}
    for n in range(3 * FULL):
        s.write(rows(spark, ("a", f"a{n % 5}", n), ("b", f"b{n}", n)), drop=rows(spark, ("b", "", 0)) if n % 3 == 0 else None, name=f"w{n}")
        if n % 3 == 0:
            want = {k: v for k, v in want.items() if v[0] != "b"}
        want |= {f"a{n % 5}": ("a", f"a{n % 5}", n), f"b{n}": ("b", f"b{n}", n)}
        found = s.manifest()
        sizes.append(len(found.base) + sum(map(len, found.added.values())))
    assert read(s) == sorted(want.values())
    # A base and fewer than FULL added files a bucket, whenever it is read.
    assert max(sizes[2 * FULL :]) <= max(sizes[: 2 * FULL]) <= 2 * FULL
    assert len(os.listdir(tmp_path / "store/manifests")) <= 2 * 5 + 2
