"""Streaming jobs driven to completion over files."""

import json
import time

from pyspark.sql import functions as F

from condensa.operators import store as ST
from condensa.plans import policy as P
from condensa.sources import readers
from condensa.streaming import jobs

EVENTS = "ts long, session string, strategy string, in_tokens long, out_tokens long"


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    for _ in range(600):  # queries with processing-time timeouts never report that all is processed
        if q.exception() or any(p.numInputRows for p in q.recentProgress):
            break
        time.sleep(0.1)
    q.stop()


def test_daily_savings(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"ts": t, "session": "s", "strategy": k, "in_tokens": 10, "out_tokens": 4}) for t, k in [(0, "log"), (50, "log"), (90_000, "json"), (90_001, "retrieve")]))
    drain(jobs.daily_savings(jobs.follow(spark, str(tmp_path), EVENTS)), "days", "complete")
    assert sorted((r.strategy, r.saved, r.events) for r in spark.table("days").collect()) == [("json", 6, 1), ("log", 12, 2)]


def test_sticky_and_blocks(spark, tmp_path):
    p = P.Policy(tiers=[{"name": "s", "model": "1"}, {"name": "m", "model": "2"}, {"name": "l", "model": "3"}], session={"sticky": True, "min_band_jump": 2})
    rows = [("a", 0, "l", "route"), ("a", 60, "m", "default"), ("a", 120, "s", "default"), ("b", 0, "s", "default")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text("\n".join(json.dumps({"session_id": s, "t": t, "tier": k, "source": c, "reason": "r"}) for s, t, k, c in rows))
    stream = jobs.follow(spark, str(tmp_path / "d"), "session_id string, t long, tier string, source string, reason string").withColumn("ts", F.timestamp_seconds("t"))
    drain(jobs.sticky_sessions(stream, p), "held")
    assert [(r.tier, r.reason) for r in spark.table("held").filter("session_id = 'a'").orderBy("ts").collect()] == [("l", "r"), ("l", "r sticky:kept"), ("s", "r")]
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "x.json").write_text("\n".join(json.dumps({"tier": "l", "t": t, "status": s, "error": "permission_error"}) for t, s in [(0, 403), (60, 200), (2000, 200)]))
    stream = jobs.follow(spark, str(tmp_path / "o"), "tier string, t long, status int, error string").withColumn("ts", F.timestamp_seconds("t"))
    drain(jobs.blocked_tiers(stream), "blocks")
    assert [r.blocked for r in spark.table("blocks").orderBy("ts").collect()] == [False, True, False]


def test_reduce_into(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(json.dumps({"doc_id": i, "content": "plain words " * 50}) for i in range(3)))
    q = jobs.reduce_into(jobs.follow(spark, str(tmp_path / "in"), "doc_id long, content string"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_sources_and_store(spark, tmp_path):
    text = "x" * 300
    events = [{"hook_event_name": "PostToolUse", "session_id": "s", "tool_name": "T", "tool_response": r} for r in (text, {"stdout": "", "result": text}, {"file": {"content": text}}, {"stdout": 5}, "short")]
    df = spark.createDataFrame([(json.dumps(e),) for e in events] + [(json.dumps({"hook_event_name": "Pre", "tool_response": text}),)], "content string")
    assert [r.text for r in readers.hook_events(df).collect()] == [text] * 3
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("hello")
    (tmp_path / "f" / "b.md").write_text("no")
    files = readers.whole_files(spark, str(tmp_path / "f")).collect()
    assert [(f.content, len(f.sha)) for f in files] == [("hello", 12)]
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "content string, t long").withColumn("stored_at", F.timestamp_seconds("t"))
    store = ST.put(rows)
    more = ST.put(spark.createDataFrame([("b", 9), ("c", 8)], "content string, t long").withColumn("stored_at", F.timestamp_seconds("t")), store)
    assert sorted((r.alias, r.content) for r in more.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    found = ST.get(spark.createDataFrame([("2",), ("x",)], "id string"), more).collect()
    assert sorted((r.id, r.content, r.status) for r in found) == [("2", "b", "found"), ("x", None, "expired")]
    kept = ST.evict(more, F.timestamp_seconds(F.lit(10)), ttl=100, most=2).collect()
    assert sorted(r.content for r in kept) == ["b", "c"]
