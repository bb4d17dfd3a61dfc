import random

import pytest
from pyspark.sql import functions as F

from loomdex.operators import incremental as inc


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["shard"], []).append((r["lo"], r["hi"]))
    return {k: sorted(v) for k, v in out.items()}


def numbers(intervals):
    return {(s, n) for s, v in intervals.items() for lo, hi in v for n in range(lo, hi + 1)}


def frame(spark, d):
    return spark.createDataFrame([(s, lo, hi) for s, v in d.items() for lo, hi in v], inc.INTERVAL)


def test_intervals_fold_numbers(spark):
    df = spark.createDataFrame([(0, 3), (0, 1), (0, 2), (0, 2), (0, 7), (1, 5), (None, 1), (1, None)], "shard int, seq bigint")
    assert sets(inc.intervals(df)) == {0: [(1, 3), (7, 7)], 1: [(5, 5)]}


def test_subtract_and_merge_agree_with_sets(spark):
    rng = random.Random(4)
    for _ in range(4):
        a, b = ({s: [(x := rng.randrange(60), x + rng.randrange(12)) for _ in range(5)] for s in range(3)} for _ in range(2))
        got = sets(inc.subtract(frame(spark, a), frame(spark, b)))
        assert numbers(got) == numbers(a) - numbers(b)
        for v in got.values():
            assert all(y > x + 1 for (_, x), (y, _) in zip(v, v[1:]))
        assert numbers(sets(inc.merge(frame(spark, a), frame(spark, b)))) == numbers(a) | numbers(b)


def test_empty_sets(spark):
    none = frame(spark, {})
    assert sets(inc.subtract(none, none)) == {}
    assert sets(inc.subtract(frame(spark, {0: [(1, 2)]}), none)) == {0: [(1, 2)]}


def records(spark, rows):
    return spark.createDataFrame(rows, "shard int, seq bigint, body string")


def test_log_survives_failure_and_takes_late_records(spark, tmp_path):
    log = inc.IntervalLog(spark, f"file://{tmp_path}/log")
    first = [(0, 1, "a"), (0, 2, "b"), (0, 5, "e"), (1, 1, "x")]
    assert log.run(records(spark, first), lambda d: d) == 1
    assert log.run(records(spark, first), lambda d: d) == 0
    late = [*first, (0, 3, "c"), (0, 6, "f")]  # 3 fell into a range already passed

    def broken(d):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        log.run(records(spark, late), broken)
    assert log.run(records(spark, late), lambda d: d) == 2
    assert sorted(r["body"] for r in log.output().collect()) == ["a", "b", "c", "e", "f", "x"]
    assert sets(log.processed()) == {0: [(1, 3), (5, 6)], 1: [(1, 1)]}


def test_failure_while_writing_leaves_no_trace(spark, tmp_path):
    log = inc.IntervalLog(spark, f"file://{tmp_path}/log")
    bad = F.udf(lambda s: 1 // 0, "int")
    with pytest.raises(Exception):  # noqa: B017
        log.run(records(spark, [(0, 1, "a")]), lambda d: d.withColumn("z", bad("body")))
    assert log.output() is None
    assert log.run(records(spark, [(0, 1, "a")]), lambda d: d) == 1


SCAN = "file_path string, file_hash string, extra string, status string"
MANIFEST = "file_path string, file_hash string, status string, indexed_at double"


def test_files_to_index(spark):
    scan = spark.createDataFrame(
        [("new", "A", None, "z"), ("same", "sha256:BB ", None, None), ("same", "bb", None, None), ("other", "c2", None, None), ("failed", "d", None, None), ("unread", None, None, None), ("back", "e", None, None), (None, "f", None, None)], SCAN
    )
    manifest = spark.createDataFrame(
        [("same", "bb", " Done", 2.0), ("same", "xx", "error", 1.0), ("other", "c1", "done", 1.0), ("failed", "d", "error", 3.0), ("failed", "d", "done", 2.0), ("back", "e", None, 5.0), ("gone", "g", "done", 1.0), ("unread", "u", "done", 1.0)], MANIFEST
    )
    got = {r["file_path"] for r in inc.files_to_index(scan, manifest, shards=3).collect()}
    assert got == {"new", "other", "failed", "back"}
    assert {r["file_path"] for r in inc.vanished_files(scan, manifest).collect()} == {"gone"}
    assert inc.files_to_index(scan.limit(0), manifest).count() == 0
    assert inc.files_to_index(scan, manifest.limit(0)).count() == 5


def test_only_one_writer_gets_a_number(spark, tmp_path):
    from loomdex.operators.commits import Commits

    c = Commits(spark, f"file://{tmp_path}/t")
    (tmp_path / "t" / "_commits").mkdir(parents=True)
    (tmp_path / "t" / "_commits" / "stray").write_text("x")
    assert c.last() == 0
    c.claim(1, {"data": "a"})
    with pytest.raises(RuntimeError, match="taken"):
        c.claim(1, {"data": "b"})
    assert c.last() == 1 and c.read(1) == {"data": "a"}


def test_two_runs_from_one_state(spark, tmp_path):
    log = inc.IntervalLog(spark, f"file://{tmp_path}/log")
    rows = records(spark, [(0, 1, "a"), (0, 2, "b")])

    def meanwhile(d):
        assert inc.IntervalLog(spark, f"file://{tmp_path}/log").run(rows, lambda x: x) == 1
        return d

    with pytest.raises(RuntimeError, match="taken"):
        log.run(rows, meanwhile)
    assert sorted(r["body"] for r in log.output().collect()) == ["a", "b"]
    assert log.run(rows, lambda d: d) == 0


def test_a_killed_run_repeats_nothing(spark, tmp_path, monkeypatch):
    log = inc.IntervalLog(spark, f"file://{tmp_path}/log")
    rows = records(spark, [(0, 1, "a"), (0, 2, "b")])
    with monkeypatch.context() as m:
        m.setattr(log.commits, "claim", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            log.run(rows, lambda d: d)
    assert log.output() is None and log.run(rows, lambda d: d) == 1
    assert log.output().count() == 2


def test_old_versions_keep_their_numbers(spark):
    scan = spark.createDataFrame([(f"f{i}", f"h{i}", None, None) for i in range(6)], SCAN)
    manifest = spark.createDataFrame([(f"f{i}", f"h{i}", "done", float(9 - i)) for i in range(6)], MANIFEST)
    first = {r["file_path"]: (r["shard"], r["seq"]) for r in inc.versions(scan, manifest, 2).collect()}
    more = scan.unionByName(spark.createDataFrame([(f"a{i}", "x", None, None) for i in range(4)], SCAN))
    then = {r["file_path"]: (r["shard"], r["seq"]) for r in inc.versions(more, manifest, 2).collect()}
    assert len(then) == 10 and all(then[k] == v for k, v in first.items())
