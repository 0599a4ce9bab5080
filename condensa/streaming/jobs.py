"""Structured Streaming: verdicts over arriving files, daily savings with a watermark, sticky sessions and tier blocks as keyed
state with timeouts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import detect
from ..operators.gate import gate
from ..operators.reduce import reduce_texts, with_inputs
from ..plans.policy import Policy

IDLE_MS, BLOCK_MS = 30 * 60 * 1000, 15 * 60 * 1000


def follow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of files as they arrive. New files are seen, not lines appended to old ones."""
    return spark.readStream.schema(schema).json(path)


def classified(texts: DataFrame) -> DataFrame:
    """A stream of texts (doc_id, content) with gate and type; both are projections, so no state is kept."""
    return detect(gate(with_inputs(texts))).select("doc_id", "in_tokens", "gate_klass", "detected", "confidence")


def reduce_into(texts: DataFrame, path: str, checkpoint: str):
    """Starts a query that reduces each micro-batch of (doc_id, content) and appends its verdicts. A batch that is run again
    overwrites its own folder, so no verdict is written twice."""

    def run(batch: DataFrame, n: int) -> None:
        reduce_texts(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return texts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def daily_savings(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Saved tokens per calendar day and strategy; rows later than the watermark are left out."""
    at = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late).filter("strategy <> 'retrieve'")
    out = at.groupBy(F.window("at", "1 day"), "strategy").agg(F.sum(F.col("in_tokens") - F.col("out_tokens")).alias("saved"), F.count(F.lit(1)).alias("events"))
    return out.select(F.col("window.start").alias("day"), "strategy", "saved", "events")


def sticky_sessions(decisions: DataFrame, p: Policy) -> DataFrame:
    """A stream of decisions (session_id, ts, tier, source, reason) with downgrades by default held as the policy says. The
    state of a session is its tier and when it was seen, and it ends after 30 idle minutes."""
    ranks = {t["name"]: i for i, t in enumerate(p.tiers)}
    jump = p.session.get("min_band_jump", 0) if p.session.get("sticky") else 0

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        cur, seen = state.get if state.exists else (None, 0)
        tiers, reasons = [], []
        for r in rows.itertuples():
            now = int(r.ts.timestamp() * 1000)
            cur = cur if cur is not None and now - seen <= IDLE_MS else None
            tier, reason = r.tier, r.reason
            if r.source == "default" and cur in ranks and tier in ranks and 0 < ranks[cur] - ranks[tier] < jump:
                tier, reason = cur, reason + " sticky:kept"
            elif r.source == "keep" and cur is not None:
                tier = cur
            if r.source in ("route", "default") and tier != "-":
                cur = tier
            seen = now
            tiers.append(tier)
            reasons.append(reason)
        if cur is not None:
            state.update((cur, seen))
            state.setTimeoutDuration(IDLE_MS)
        yield rows.assign(tier=tiers, reason=reasons)[["session_id", "ts", "tier", "reason"]]

    rows = decisions.select("session_id", "ts", "tier", "source", "reason")
    return rows.groupBy("session_id").applyInPandasWithState(run, "session_id string, ts timestamp, tier string, reason string", "tier string, seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def blocked_tiers(outcomes: DataFrame) -> DataFrame:
    """A stream of outcomes (tier, ts, status, error) with whether the tier was blocked: for 15 minutes after a permission
    error of status 403."""

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        (until,) = state.get if state.exists else (0,)
        out = []
        for r in rows.itertuples():
            now = int(r.ts.timestamp() * 1000)
            out.append(now < until)
            if r.status == 403 and r.error == "permission_error":
                until = now + BLOCK_MS
        state.update((until,))
        yield rows.assign(blocked=out)[["tier", "ts", "status", "blocked"]]

    return outcomes.select("tier", "ts", "status", "error").groupBy("tier").applyInPandasWithState(run, "tier string, ts timestamp, status int, blocked boolean", "until long", "append", GroupStateTimeout.NoTimeout)
