"""Readers, rebuilt responses, hints, the store, banks, small text helpers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.operators import report, scoring, store
from condensa.operators.reduce import with_hint
from condensa.operators.jsontable import sample_items
from condensa.sources import readers

SHAPES = [
    ('"old"', '"new \\"x\\""'), ('{"stdout": "old", "n": 1.0}', '{"stdout": "new \\"x\\"", "n": 1.0}'), ('{"stdout":"","output":"old"}', '{"stdout":"","output":"new \\"x\\""}'),
    ('{"stdout":5,"result":"old", "z":"\\u00e9"}', '{"stdout":5,"result":"new \\"x\\"", "z":"\\u00e9"}'), ('{ "file" : { "content":"old" , "k":1e5 } }', '{ "file" : { "content":"new \\"x\\"" , "k":1e5 } }'),
    ('{"stdout":"a","stdout":"old"}', '{"stdout":"a","stdout":"new \\"x\\""}'), ("{}", None), ("[]", None), ('""', None), ("5", None), ("{", None), (None, None), ('{"file":{"content":""}}', None), ('{"file":"x"}', None),
]


@pytest.mark.parametrize("given, want", SHAPES)
def test_rebuild(given, want):
    assert readers.rebuild(given, 'new "x"') == want
    assert want is None or json.loads(want) is not None


def test_events_and_files(spark, tmp_path):
    long = "word " * 80
    events = [
        {"hook_event_name": "PostToolUse", "session_id": "s1", "tool_name": "Bash", "tool_response": {"stdout": long}}, {"hook_event_name": "PostToolUse", "session_id": "s2", "tool_name": "Read", "tool_response": long},
        {"hook_event_name": "PostToolUse", "session_id": "s3", "tool_name": "Read", "tool_output": long, "tool_response": {"stdout": 7}}, {"hook_event_name": "PreToolUse", "session_id": "s4", "tool_name": "Read", "tool_response": long},
        {"hook_event_name": "PostToolUse", "session_id": "s5", "tool_name": "Bash", "tool_response": {"stdout": "short"}},
    ]
    got = readers.hook_events(spark.createDataFrame([(json.dumps(e),) for e in events], "content string")).collect()
    assert sorted((r.session_id, r.tool_name, r.text == long) for r in got) == [("s1", "Bash", True), ("s2", "Read", True), ("s3", "Read", True)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text("one\ntwo")
    (tmp_path / "notes.md").write_text("left out")
    assert [(r.content, len(r.sha)) for r in readers.whole_files(spark, str(tmp_path)).collect()] == [("one\ntwo", 12)]
    log = spark.createDataFrame([(1, "s", "t", "prose", 1, 10, 5)], report.EVENTS)
    readers.append_events(log, f"{tmp_path}/log")
    readers.append_events(log.withColumn("ts", F.lit(2).cast("long")), f"{tmp_path}/log")
    (tmp_path / "log" / "bad.json").write_text("{broken\n")
    assert sorted(r.ts for r in report.read_events(spark, f"{tmp_path}/log").collect()) == [1, 2]
    readers.write_texts(spark.createDataFrame([("out",)], "output string"), f"{tmp_path}/texts")
    assert [r.value for r in spark.read.text(f"{tmp_path}/texts").collect()] == ["out"]
    feed = report.feed([log, log.withColumn("ts", F.lit(0).cast("long")).withColumn("more", F.lit("x"))], last=1).collect()
    assert [r.ts for r in feed] == [0, 1]


def test_hint(spark):
    text = "many plain words in a row " * 20
    rows = [(text, "many words", "ansi_strip+llmlingua"), (text, "many words", "ansi_strip+json_crusher"), (text, text, "ansi_strip+llmlingua"), (text, text[:-20], "ansi_strip+log_compressor"), ("a b c", "a", "llmlingua")]
    df = spark.createDataFrame(rows, "t string, o string, s string")
    got = [r[0] for r in df.select(with_hint(F.col("t"), F.col("o"), F.col("s"), alias=F.lit(12))).collect()]
    assert got == ["many words\n[full output: retrieve 12]", "many words", None, text[:-20], "a"]


def test_store_ranks_and_sums(spark):
    rng = random.Random(2)
    rows = [(f"text {rng.randrange(300)}", rng.randrange(500)) for _ in range(800)]
    arrivals = spark.createDataFrame(rows, "content string, at long").select("content", F.timestamp_seconds("at").alias("stored_at")).repartition(5)
    one = store.put(arrivals)
    first = {}
    for c, at in rows:
        first[c] = min(at, first.get(c, at))
    found = {r.alias: r for r in one.collect()}
    assert sorted(found) == list(range(1, len(first) + 1)) and all(found[k].stored_at <= found[k + 1].stored_at for k in range(1, len(first)))
    two = store.put(spark.createDataFrame([("text 1", 1), ("brand new", 900)], "content string, at long").select("content", F.timestamp_seconds("at").alias("stored_at")), one)
    assert {r.content: r.alias for r in two.collect() if r.alias > len(first)} == {"brand new": len(first) + 1}
    held, want = 0, set()
    for k in sorted(found, key=lambda k: (found[k].stored_at, k), reverse=True):
        held += found[k].size
        if held <= 1000:
            want.add(k)
    assert {r.alias for r in store.evict(one, F.timestamp_seconds(F.lit(400)), ttl=10**6, most=1000).collect()} == want and want
    asked = spark.createDataFrame([("1",), ("x",), ("99999",)], "id string")
    assert {r.id: r.status for r in store.get(asked, one).collect()} == {"1": "found", "x": "expired", "99999": "expired"}
    assert store.put(arrivals.limit(0)).count() == 0


def test_banks_agree_with_columns(spark):
    rng = random.Random(4)
    unit = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    df = spark.createDataFrame([(i, unit() if i else None) for i in range(50)], "i int, v array<float>")
    for size in (0, 1, 5):
        vectors = [unit() for _ in range(size)]
        bank = spark.createDataFrame([(v,) for v in vectors], "b array<float>")
        lit = F.array(*[F.array(*[F.lit(float(x)) for x in r.b]) for r in bank.collect()]).cast("array<array<float>>")
        rows = scoring.with_bank_score(df, "v", bank, "got").withColumn("want", scoring.bank_score(F.col("v"), lit)).collect()
        assert all(r.got is None if r.v is None else abs(r.got - r.want) < 1e-6 for r in rows)
    model = lambda texts: [[float(len(t)), 1.0] for t in texts]
    texts = spark.createDataFrame([("ab",), ("",), (None,)], "t string")
    assert [r.vector for r in scoring.embed(texts, "t", model).collect()] == [[2.0, 1.0], None, None]


def test_small_helpers(spark):
    df = spark.createDataFrame([("2024/05/06 07:08:09 GET /x",), ("plain line",)], "l string")
    stamp, rest = T.split_log_prefix(F.col("l"))
    assert [(str(r.s), r.r) for r in df.select(stamp.alias("s"), rest.alias("r")).collect()] == [("2024-05-06 07:08:09", "GET /x"), ("None", "plain line")]
    row = spark.range(1).select(T.clamp(F.lit(7.0), 0.1, 1.0).alias("a"), T.short_session(F.lit("")).alias("b"), T.or_dash(F.lit(None).cast("string")).alias("c"), T.truncated(F.lit("é" * 100), 5).alias("d"), sample_items(F.lit(40), 15).alias("e")).first()
    assert (row.a, row.b, row.c, row.d) == (1.0, "-", "-", "éé…") and row.e == [*range(10), *range(35, 40)]
