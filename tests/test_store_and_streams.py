import datetime
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import store
from orrery.streaming import coalesce

T0 = datetime.datetime(2025, 1, 1)


def test_upsert_keeps_old_where_new_is_null(spark):
    old = spark.createDataFrame([("a", "p", "s", "d", 0.5), ("b", "p", None, "d", 0.1)], "id string, path string, signature string, docstring string, pagerank double")
    new = spark.createDataFrame([("a", "q", None, "e", 1), ("a", "r", "t", None, 2), ("c", "z", None, None, 3)], "id string, path string, signature string, docstring string, seq int")
    got = {r["id"]: tuple(r)[1:] for r in store.upsert(old, new, "id", "seq").collect()}
    assert got == {"a": ("r", "t", "e", 0.5), "b": ("p", None, "d", 0.1), "c": ("z", None, None, None)}


def test_accumulate_and_last(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None)], "k string, w double")
    assert {tuple(r) for r in store.accumulate(a, a, ["k"], "w").collect()} == {("x", 2.0), ("y", 2.0)}
    b = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q")], "k string, n int, v string")
    assert store.last_wins(b, ["k"], "n").head()["v"] == "q"


def test_feedback_and_notes(spark):
    log = spark.createDataFrame([(4, "a")], "id bigint, note string")
    new = spark.createDataFrame([("c",), ("b",)], "note string")
    assert [tuple(r) for r in store.append_feedback(log, new, "note").orderBy("id").collect()] == [(4, "a"), (5, "b"), (6, "c")]
    assert store.truncate_note("é" * 2000).endswith("�") is False or len(store.truncate_note("é" * 2000)) <= 1025
    assert store.truncate_note(None) is None


def test_epochs(spark, tmp_path):
    s = store.EpochStore(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        s.table("t")
    e = s.begin()
    with pytest.raises(RuntimeError):
        s.begin()
    s.write(e, "t", spark.range(3))
    with pytest.raises(RuntimeError):
        s.table("t")
    s.commit(e, symbols=3)
    assert s.table("t").count() == 3 and s.begin() == 2
    s.abort()
    (tmp_path / "ready.json").write_text("{}")
    with pytest.raises(ValueError):
        s.read_marker()


def brute_sessions(events, gap):
    out = {}
    for repo in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == repo and e[3] is not None), key=lambda e: e[3])
        start = last = None
        for _, path, kind, ts in own:
            if last is None or (ts - last).total_seconds() >= gap:
                start = ts
            last = ts
            key = (repo, start, path)
            if key not in out or (ts, kind) >= out[key][::-1]:
                out[key] = (kind, ts)
    return {(*k, v[0]) for k, v in out.items()}


def test_sessions_and_floods(spark):
    rng = random.Random(2)
    events = [(rng.choice(["r", "q", None]), f"p{rng.randrange(6)}", rng.choice(["add", "change", "unlink"]), T0 + datetime.timedelta(milliseconds=rng.randrange(60_000))) for _ in range(150)]
    events.append(("r", "p1", "add", None))
    df = spark.createDataFrame(events, "repo string, path string, kind string, ts timestamp")
    paths = coalesce.sessions(df, 0.6)
    assert {(r["repo"], r["batch_start"], r["path"], r["kind"]) for r in paths.collect()} == brute_sessions(events, 0.6)
    sliced = coalesce.split_floods(paths, ["repo", "batch_start"], 2)
    assert sliced.groupBy("repo", "batch_start", "slice").count().agg(F.max("count")).head()[0] <= 2
    reasons = {r["reason"] for r in coalesce.reasons(paths, ["repo", "batch_start"]).collect()}
    assert reasons <= {"add", "change", "unlink", "mixed"}
    assert coalesce.sessions(df.limit(0)).count() == 0


def test_stream_gives_the_same_batches(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("r", "a", "add", T0), ("r", "a", "change", T0 + datetime.timedelta(milliseconds=300)), ("r", "b", "add", T0 + datetime.timedelta(seconds=5)), ("r", "z", "add", T0 + datetime.timedelta(hours=1))]
    schema = "repo string, path string, kind string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    coalesce.stream_batches(spark.readStream.schema(schema).parquet(src), sink).awaitTermination(90)
    got = {(r["n_events"], tuple(sorted(r["last"].items()))) for r in spark.read.parquet(sink).collect()}
    assert {(2, (("a", "change"),)), (1, (("b", "add"),))} <= got


@pytest.mark.parametrize("span", [1, 3, 50])
def test_sessions_in_spans(spark, span):
    rng = random.Random(span)
    events = [(rng.choice(["r", "q", None]), f"p{rng.randrange(4)}", rng.choice(["add", "change"]), T0 + datetime.timedelta(milliseconds=rng.randrange(40_000))) for _ in range(200)]
    paths = coalesce.sessions(spark.createDataFrame(events, "repo string, path string, kind string, ts timestamp"), 0.6, span=span)
    assert {(r["repo"], r["batch_start"], r["path"], r["kind"]) for r in paths.collect()} == brute_sessions(events, 0.6)
