"""Policies: checks, compiled rules against a lazy evaluator, sessions, rewritten requests."""

import json
import random

import pytest
from pyspark.sql import functions as F

from condensa.plans import policy as P
from condensa.plans import reconcile as R
from condensa.plans.decide import decide, sticky
from condensa.plans.signals import extract, newest_models

BASE = {"version": 1, "tiers": [{"name": "s", "model": "m-s"}, {"name": "m", "model": "m-m"}, {"name": "l", "model": "m-l"}], "default": "s", "inspect": {"scope": "full"}, "routes": [], "session": {}, "overrides": {},
        "signals": {"embeddings": [{"name": "e", "threshold": 0.5, "candidates": ["x"]}], "complexity": [{"name": "c", "threshold": 0.1, "hard": ["h"], "easy": ["z"]}], "domains": [{"name": "d", "categories": ["math"]}]}}


def made(**changes):
    return P.loads(json.dumps(BASE | changes))


@pytest.mark.parametrize("change,part", [
    ({"version": 2}, "version"), ({"tiers": []}, "tiers"), ({"default": "keep"}, "default"), ({"default": "zz"}, "default"), ({"inspect": {}}, "inspect"), ({"inspect": {"scope": "recent_turns"}}, "recent_turns"),
    ({"extra": 1}, "unknown"), ({"routes": [{"name": "r", "when": {}, "to": "s"}]}, "empty condition"), ({"routes": [{"name": "r", "when": {"all": []}, "to": "s"}]}, "empty group"),
    ({"routes": [{"name": "r", "when": {"tool_loop": True, "has_tools": True}, "to": "s"}]}, "several"), ({"routes": [{"name": "r", "when": {"context_tokens": {"gt": 5, "lt": 3}}, "to": "s"}]}, "nothing lies"),
    ({"routes": [{"name": "r", "when": {"keywords_regex": ["("]}, "to": "s"}]}, "invalid pattern"), ({"routes": [{"name": "r", "when": {"domain": "zz"}, "to": "s"}]}, "no signal"), ({"routes": [{"name": "r", "when": {"complexity": "c:odd"}, "to": "s"}]}, "level"),
    ({"session": {"min_band_jump": -1}}, "min_band_jump"), ({"routes": [{"name": "r", "when": {"not": [{"tool_loop": True}]}, "to": "s"}]}, "not a list"), ({"routes": [{"name": "r", "when": {"context_tokens": "5"}, "to": "s"}]}, "whole number"),
])
def test_refused(change, part):
    with pytest.raises(P.PolicyError, match=part):
        made(**change)


def test_too_deep_and_warnings():
    rule = {"tool_loop": True}
    for _ in range(6):
        rule = {"not": rule}
    with pytest.raises(P.PolicyError, match="deeper"):
        made(routes=[{"name": "r", "when": rule, "to": "s"}])
    warnings, errors = P.check(made(routes=[{"when": {"any": [{"embedding": "e"}]}, "to": "l"}], session={"sticky": True, "min_band_jump": 1}))
    assert not errors and len(warnings) == 4


def lazy(rule, row, state):
    """Value of a rule, cheap children first, stopping early; state collects what was consulted and failed."""
    if "not" in rule:
        return not lazy(rule["not"], row, state)
    for g in ("all", "any"):
        if g in rule:
            for r in sorted(rule[g], key=P.uses_model):
                if lazy(r, row, state) == (g == "any"):
                    return g == "any"
            return g != "any"
    if "tool_loop" in rule:
        return row["tool_loop"] == rule["tool_loop"]
    if "message_count" in rule:
        return row["message_count"] > rule["message_count"]["gt"]
    key, value = ("emb:e", row["emb"]) if "embedding" in rule else ("cplx:c", row["cx"])
    if row["status"] != "ok":
        state["error"] = True
        state["failed"] |= row["status"] == "err"
        return False
    return value >= 0.5 if key == "emb:e" else ("hard" if value > 0.1 else "easy" if value < -0.1 else "medium") == rule["complexity"].split(":")[1]


def test_compiled_rules_are_lazy(spark):
    rng = random.Random(11)

    def tree(depth):
        k = rng.randrange(7 if depth < 4 else 4)
        leaf = [{"tool_loop": rng.random() < 0.5}, {"message_count": {"gt": rng.randrange(4)}}, {"embedding": "e"}, {"complexity": "c:" + rng.choice(P.LEVELS)}]
        return leaf[k] if k < 4 else {"not": tree(depth + 1)} if k == 4 else {["all", "any"][k - 5]: [tree(depth + 1) for _ in range(rng.randrange(1, 4))]}

    rows = [{"i": i, "tool_loop": rng.random() < 0.5, "message_count": rng.randrange(5), "emb": rng.random(), "cx": rng.uniform(-0.3, 0.3), "status": rng.choice(["ok", "ok", "off", "err"])} for i in range(60)]
    df = spark.createDataFrame(rows).withColumns({"context_tokens": F.lit(1), "has_tools": F.lit(False), "recent_text": F.lit(""), "requested_model": F.lit(""), "scores": F.create_map(F.lit("emb:e"), "emb", F.lit("cplx:c"), "cx"), "statuses": F.create_map(F.lit("emb:e"), "status", F.lit("cplx:c"), "status")}).persist()
    for _ in range(12):
        rules = [tree(1), tree(1)]
        p = made(routes=[{"name": f"r{k}", "when": r, "to": ["m", "l"][k]} for k, r in enumerate(rules)])
        got = {r.i: r.reason for r in decide(df, p).select("i", "reason").collect()}
        for row in rows:
            want, failed = "default", False
            for k, r in enumerate(rules):
                state = {"error": False, "failed": False}
                value = lazy(r, row, state)
                failed |= state["failed"]
                if value and not state["error"]:
                    want = f"route:r{k}"
                    break
            assert got[row["i"]] == want + (" ml-degraded" if failed else ""), (rules, row)


def test_sessions(spark):
    p = made(session={"sticky": True, "min_band_jump": 2})
    steps = [(0, "l", "route"), (60, "m", "default"), (120, "s", "default"), (180, "m", "default"), (200, "x", "keep"), (4000, "s", "default")]
    rows = [("a", i, F_ts, t if t != "x" else "s", s, f"r{i}", "") for i, (F_ts, t, s) in enumerate(steps)] + [("", 99, 0, "s", "default", "d", "")]
    df = spark.createDataFrame(rows, "session_id string, i int, t long, tier string, source string, reason string, model string").withColumn("at", F.timestamp_seconds("t"))
    got = {r.i: (r.tier, r.reason) for r in sticky(df, p, "at").collect()}
    assert [got[i][0] for i in range(6)] == ["l", "l", "s", "m", "m", "s"] and got[1][1] == "r1 sticky:kept" and got[99][0] == "s"


def test_requests(spark):
    body = {"model": "claude-x-latest", "tools": [{}], "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}, {"role": "user", "content": [{"type": "text", "text": "<system-reminder> no"}, {"type": "text", "text": "real"}, {"type": "tool_result"}]}]}
    rows = [(json.dumps(body),), ("not json",), ("",)]
    r = extract(spark.createDataFrame(rows, "content string"), scope="last_user_turn").collect()
    assert (r[0].requested_model, r[0].message_count, r[0].has_tools, r[0].tool_loop, r[0].recent_text, r[0].parsed) == ("claude-x", 3, True, True, "real", True)
    assert (r[1].message_count, r[1].parsed, r[1].context_tokens) == (0, False, 2)
    ids = spark.createDataFrame([("claude-opus-4 claude-opus-4-20250101 claude-haiku-3",)], "content string")
    assert {x.family: x.model for x in newest_models(ids).collect()} == {"opus": "claude-opus-4-20250101", "haiku": "claude-haiku-3"}


def test_rewrites(spark):
    body = '{"model":"a","x":1.0,"big":12345678901234567890,"thinking":{},"output_config":{"effort":"high"},"messages":[{"role":"user","content":"a"},{"role":"system","content":"b"},{"role":"assistant","content":[{"type":"thinking"}]}]}'
    df = spark.createDataFrame([(body, "context-1m-2025, effort-x, interleaved-thinking, other", "claude-haiku-4-5"), (body, "other", "claude-opus-4-8"), ("junk", None, "claude-haiku-4-5")], "content string, beta string, model string")
    a, b, c = R.reconcile(df).collect()
    out = json.loads(a.new_body)
    assert a.stripped == ["context-1m", "effort", "thinking", "midconv-system"] and a.new_header == "other" and '"x":1.0,"big":12345678901234567890' in a.new_body
    assert [m["role"] for m in out["messages"]] == ["user"] and len(out["messages"][0]["content"]) == 2 and "output_config" not in out
    assert b.stripped == [] and b.new_header == "other" and c.new_body == "junk"
    caps = spark.createDataFrame([("claude-haiku-9",), ("other",)], "m string").select(R.supports(F.col("m"), "thinking").alias("t"), R.can_serve(F.col("m"), F.lit(190_000)).alias("s")).collect()
    assert [(x.t, x.s) for x in caps] == [(False, False), (True, True)]
