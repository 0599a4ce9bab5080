"""Policies compiled to Column expressions: the waterfall of routes over columns of signals.

Every condition becomes a pair (value, error). A model signal that isn't available is false and an error; an error counts
only if the condition is reached in cheap-first, left-to-right order, and a route with an error doesn't fire. So the result
is that of lazy evaluation, though Spark may compute columns it doesn't need.

Model signals come as columns: domain_label, domain_conf, domain_probs (map), domain_status and the maps scores and
statuses, keyed emb:NAME and cplx:NAME; a status is ok, off (disabled) or err.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import P, java
from .policy import KEEP, REQUESTED, Policy, uses_model

SIGNALS = {"domain_label": "string", "domain_conf": "double", "domain_probs": "map<string,double>", "domain_status": "string", "scores": "map<string,double>", "statuses": "map<string,string>"}


@dataclass
class Node:
    value: Column
    error: Column  # some consulted signal is off or failed
    failed: Column  # some consulted signal failed
    trace: list[Column]  # texts, null where not consulted, in order


def with_signals(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in SIGNALS.items() if c not in df.columns})


def band(value: Column, b: dict) -> Column:
    tests = {"eq": lambda n: value == n, "gt": lambda n: value > n, "gte": lambda n: value >= n, "lt": lambda n: value < n, "lte": lambda n: value <= n}
    if "eq" in b:
        return value == b["eq"]
    return reduce(lambda x, y: x & y, [tests[k](n) for k, n in b.items()]) if b else F.lit(False)


def user_pattern(pattern: str) -> str:
    """A policy author's RE2 pattern in Java's spelling."""
    P["_user"] = pattern
    try:
        return java("_user")
    finally:
        del P["_user"]


def complexity_level(margin: Column, threshold: float) -> Column:
    return F.when(margin > threshold, "hard").when(margin < -threshold, "easy").otherwise("medium")


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def _plain(value: Column) -> Node:
    return Node(F.coalesce(value, F.lit(False)), F.lit(False), F.lit(False), [])


def _asked(status: Column, value: Column, trace: list[Column]) -> Node:
    status = F.coalesce(status, F.lit("off"))
    ok = status == "ok"
    return Node(ok & F.coalesce(value, F.lit(False)), ~ok, status == "err", trace)


def _leaf(p: Policy, rule: dict) -> Node:
    if "context_tokens" in rule:
        return _plain(band(F.col("context_tokens"), rule["context_tokens"]))
    if "message_count" in rule:
        return _plain(band(F.col("message_count"), rule["message_count"]))
    for flag in ("tool_loop", "has_tools"):
        if flag in rule:
            return _plain(F.col(flag) == F.lit(rule[flag]))
    if "keywords" in rule:
        return _plain(_any([T.contains_word(F.col("recent_text"), k) for k in rule["keywords"] if k]))
    if "keywords_regex" in rule:
        return _plain(_any([F.col("recent_text").rlike(user_pattern(k)) for k in rule["keywords_regex"]]))
    if "requested_model" in rule:
        return _plain(_any([F.col("requested_model") == T.canonical_model(F.lit(m)) for m in rule["requested_model"]]))
    if "domain" in rule:
        s = p.signal("domains", rule["domain"])
        status = F.coalesce("domain_status", F.lit("off"))
        least = s.get("min_mass", 0) or 0
        mass = reduce(lambda a, b: a + b, [F.coalesce(F.col("domain_probs")[c], F.lit(0.0)) for c in s["categories"]])
        by_mass = F.lit(least > 0) & (F.coalesce(F.size("domain_probs"), F.lit(0)) > 0)
        said = F.when(status == "off", "dom=off").when(status != "ok", "dom=err").otherwise(F.format_string("dom=%s@%.3f", "domain_label", "domain_conf"))
        gate = F.when((status == "ok") & by_mass, F.format_string(f"dom:{s['name']}=%.3f/{least:.2f}", mass))
        return _asked(F.col("domain_status"), F.when(by_mass, mass >= least).otherwise(F.col("domain_label").isin(s["categories"])), [said, gate])
    kind, ref = ("emb", rule["embedding"]) if "embedding" in rule else ("cplx", rule["complexity"].rpartition(":")[0])
    key = f"{kind}:{ref}"
    score, status = F.col("scores")[key], F.coalesce(F.col("statuses")[key], F.lit("off"))
    said = F.when(status == "off", f"{key}=off").when(status != "ok", f"{key}=err").otherwise(F.format_string(f"{key}=%+.3f", score))
    if kind == "emb":
        return _asked(status, score >= p.signal("embeddings", ref)["threshold"], [said])
    return _asked(status, complexity_level(score, p.signal("complexity", ref)["threshold"]) == rule["complexity"].rpartition(":")[2], [said])


def compile_rule(p: Policy, rule: dict) -> Node:
    if "not" in rule:
        n = compile_rule(p, rule["not"])
        return Node(~n.value, n.error, n.failed, n.trace)
    for group, decisive in (("all", False), ("any", True)):
        if group in rule:
            parts = [compile_rule(p, r) for r in sorted(rule[group], key=uses_model)]
            reach, error, failed, trace, open_ = [], [], [], [], F.lit(True)
            for n in parts:
                reach.append(open_)
                error.append(open_ & n.error)
                failed.append(open_ & n.failed)
                trace += [F.when(open_, t) for t in n.trace]
                open_ = open_ & (~n.value if decisive else n.value)
            return Node(_any([n.value for n in parts]) if decisive else ~_any([~n.value for n in parts]), _any(error), _any(failed), trace)
    return _leaf(p, rule)


def decide(df: DataFrame, p: Policy | None, pin: str | None = None) -> DataFrame:
    """Adds tier, model, reason, source (pin, route, keep, default or passthrough), trace and is_noop. df has the columns of
    signals.extract(); pin names a column with the pinned tier. Without a policy everything passes through."""
    keep = df.columns
    if p is None:
        none = F.lit("")
        return df.select(*keep, F.lit("-").alias("tier"), none.alias("model"), F.lit("passthrough").alias("reason"), F.lit("passthrough").alias("source"), none.alias("trace"), F.lit(True).alias("is_noop"))
    df = with_signals(df)
    out, failed, trace, open_ = None, [], [], F.lit(True)
    row = lambda tier, reason, source: F.struct(F.lit(tier).alias("tier"), F.lit(reason).alias("reason"), F.lit(source).alias("source"))
    pinned = F.lit(False)
    if p.overrides.get("pin_header") and pin:
        pinned = F.coalesce(F.col(pin).isin([t["name"] for t in p.tiers]), F.lit(False))
        out = F.when(pinned, F.struct(F.col(pin).alias("tier"), F.concat(F.lit("pin:"), F.col(pin)).alias("reason"), F.lit("pin").alias("source")))
    for i, r in enumerate(p.routes):
        n = compile_rule(p, r["when"])
        fires = n.value & ~n.error
        reason = f"route:{r.get('name') or f'[{i}]'}"
        said = row(p.default, f"{reason}→keep(no-session→default)", "keep") if r["to"] == KEEP else row(r["to"], reason, "route")
        failed.append(open_ & n.failed)
        trace += [F.when(open_ & ~pinned, t) for t in n.trace]
        out = F.when(fires, said) if out is None else out.when(fires, said)
        open_ = open_ & ~fires
    last = row("-", "default:requested", "default") if p.default == REQUESTED else row(p.default, "default", "default")
    df = df.withColumns({"_d": last if out is None else out.otherwise(last), "_f": ~pinned & _any(failed), "_t": F.array_join(F.array_distinct(F.filter(F.array(*trace), lambda t: t.isNotNull())), " ") if trace else F.lit("")})
    model = F.coalesce(*[F.when(F.col("_d.tier") == t["name"], F.lit(t["model"])) for t in p.tiers], F.when(F.col("_d.tier") == "-", F.col("requested_model")), F.lit(""))
    df = df.withColumns({"model": model, "reason": F.concat(F.col("_d.reason"), F.when(F.col("_f"), " ml-degraded").otherwise(""))})
    noop = (F.length("model") == 0) | ((F.length("requested_model") > 0) & (T.canonical_model(F.col("model")) == F.col("requested_model")))
    return df.select(*[c for c in keep if c not in ("model", "reason")], F.col("_d.tier").alias("tier"), "model", "reason", F.col("_d.source").alias("source"), F.col("_t").alias("trace"), noop.alias("is_noop"))


# Sessions

IDLE_SECONDS = 30 * 60


def sticky(df: DataFrame, p: Policy, ts: str, session: str = "session_id", order: tuple[str, ...] = ()) -> DataFrame:
    """Replays decisions in time order per session: a downgrade by default is held while it is smaller than min_band_jump,
    keep takes the session's tier, pins and keeps leave the session alone, and a session is forgotten after 30 idle minutes.
    Rows without a session are decided alone. tier, model and reason change.

    Sessions are sorted streams of their partition; only the state of the current one is held, however long it is."""
    ranks = {t["name"]: i for i, t in enumerate(p.tiers)}
    jump = p.session.get("min_band_jump", 0) if p.session.get("sticky") else 0
    named = F.length(F.coalesce(F.col(session), F.lit(""))) > 0
    names = df.columns
    by = [F.col(session), F.col(ts).cast("timestamp"), *[F.col(c).cast("string") for c in order]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, cur, seen = None, None, None
        for batch in batches:
            tiers, reasons = [], []
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (session, "_at", "tier", "reason", "source"))
            for s, at, tier, reason, source in zip(*columns, strict=True):
                if s != who:
                    who, cur, seen = s, None, None
                live = cur if seen is not None and at is not None and at - seen <= IDLE_SECONDS else None
                old, new = ranks.get(live), ranks.get(tier)
                if source == "default" and old is not None and new is not None and new < old and old - new < jump:
                    tier, reason = live, f"{reason} sticky:kept"
                elif source == "keep" and live is not None:
                    tier, reason = live, reason.replace("(no-session→default)", "")
                if source in ("route", "default") and tier != "-":
                    cur, seen = tier, at
                else:
                    cur, seen = live, at if live is not None else seen
                tiers.append(tier)
                reasons.append(reason)
            new_columns = {"tier": pa.array(tiers, pa.string()), "reason": pa.array(reasons, pa.string())}
            yield pa.RecordBatch.from_arrays([new_columns.get(c, batch.column(batch.schema.get_field_index(c))) for c in names], names)

    rows = df.filter(named).withColumn("_at", F.unix_timestamp(F.col(ts).cast("timestamp"))).repartition(F.col(session)).sortWithinPartitions(*by)
    out = rows.mapInArrow(run, df.schema).unionByName(df.filter(~named))
    model = F.coalesce(*[F.when(F.col("tier") == t["name"], F.lit(t["model"])) for t in p.tiers], F.col("model"))
    return out.withColumn("model", model).select(*names)
