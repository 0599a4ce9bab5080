"""Reports over event logs and evaluations: savings, days, strategies, regressions, caching-aware cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

EVENTS = "ts long, session string, tool string, strategy string, id long, in_tokens long, out_tokens long"
RETRIEVE = "retrieve"
WRITE_RATE, READ_RATE = 1.25, 0.1


def in_window(events: DataFrame, now: int, days: int) -> DataFrame:
    return events.filter(F.col("ts") >= now - days * 86_400)


def savings(events: DataFrame, now: int, days: int = 7, price: float = 3.0) -> DataFrame:
    """One row: events, retrievals, sessions (1 at least), saved tokens, saved dollars at a price per million, and the
    share of retrievals."""
    e = in_window(events, now, days)
    real = F.col("strategy") != RETRIEVE
    agg = e.agg(
        F.count(F.when(real, 1)).alias("events"), F.count(F.when(~real, 1)).alias("retrievals"), F.greatest(F.count_distinct(F.when(F.length("session") > 0, F.col("session"))), F.lit(1)).alias("sessions"),
        F.coalesce(F.sum(F.when(real, F.col("in_tokens") - F.col("out_tokens"))), F.lit(0)).alias("saved"),
    )
    rate = F.when(F.col("events") > 0, F.col("retrievals") / F.col("events")).otherwise(0.0)
    return agg.select("*", F.round(F.col("saved") / 1e6 * price, 6).alias("dollars"), F.round(rate, 6).alias("retrieval_rate"))


def daily(events: DataFrame, now: int, days: int = 7) -> DataFrame:
    """Saved tokens by rolling day, oldest first, zero where nothing was saved: day (0 .. days-1), saved."""
    e = in_window(events, now, days).filter(F.col("strategy") != RETRIEVE)
    day = (days - 1 - F.floor((now - F.col("ts")) / 86_400)).cast("int")
    per = e.groupBy(day.alias("day")).agg(F.sum(F.col("in_tokens") - F.col("out_tokens")).alias("saved"))
    every = events.sparkSession.range(days).select(F.col("id").cast("int").alias("day"))
    return every.join(F.broadcast(per), "day", "left").select("day", F.coalesce("saved", F.lit(0)).alias("saved"))


def top_strategies(events: DataFrame, now: int, days: int = 7, most: int = 4) -> DataFrame:
    """The strategies that saved most; equal ones by name."""
    e = in_window(events, now, days).filter(F.col("strategy") != RETRIEVE)
    return e.groupBy("strategy").agg(F.sum(F.col("in_tokens") - F.col("out_tokens")).alias("saved"), F.count(F.lit(1)).alias("n")).orderBy(F.col("saved").desc(), "strategy").limit(most)


def feed(logs: list[DataFrame], last: int = 20) -> DataFrame:
    """The last rows of several logs with a ts column, merged by time."""
    parts = [d.orderBy(F.col("ts").desc()).limit(last) for d in logs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy("ts")


def truncated(x: Column, digits: int = 3) -> Column:
    """Cut toward zero, not rounded."""
    k = 10**digits
    return F.when(x < 0, F.ceil(x * k)).otherwise(F.floor(x * k)) / k


def regressions(now: DataFrame, base: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Rows (name, sha, detected, action, reduction) against a baseline: name, status (ok, missing, new, changed_input,
    changed_verdict, worse), and both reductions."""
    a, b = now.alias("a"), base.alias("b")
    both = a.join(b, F.col("a.name") == F.col("b.name"), "full_outer")
    status = (
        F.when(F.col("a.name").isNull(), "missing").when(F.col("b.name").isNull(), "new").when(F.col("a.sha") != F.col("b.sha"), "changed_input")
        .when((F.col("a.detected") != F.col("b.detected")) | (F.col("a.action") != F.col("b.action")), "changed_verdict").when(F.col("a.reduction") < F.col("b.reduction") - tolerance, "worse").otherwise("ok")
    )
    return both.select(F.coalesce("a.name", "b.name").alias("name"), status.alias("status"), F.col("a.reduction").alias("reduction"), F.col("b.reduction").alias("base_reduction"))


def summary(verdicts: DataFrame) -> DataFrame:
    """Items, tokens and reductions (token-weighted and mean) by detected type."""
    return verdicts.groupBy("detected").agg(
        F.count(F.lit(1)).alias("items"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"),
        F.round(1 - F.sum("out_tokens") / F.greatest(F.sum("in_tokens"), F.lit(1)), 6).alias("reduction"), F.round(F.avg("reduction"), 6).alias("mean_reduction"),
    )


def caching_cost(turns: DataFrame, session: str, pos: str, tokens: str, write: float = WRITE_RATE, read: float = READ_RATE) -> DataFrame:
    """Each turn's cost in token units: written once, read in every later turn: session, pos, reads, cost."""
    later = F.count(F.lit(1)).over(Window.partitionBy(session)) - F.row_number().over(Window.partitionBy(session).orderBy(pos))
    return turns.select(session, pos, later.alias("reads"), F.round(F.col(tokens) * (write + read * later), 6).alias("cost"))


def compounding(costs: DataFrame) -> DataFrame:
    """Turns and cost by the number of later reads."""
    return costs.groupBy("reads").agg(F.count(F.lit(1)).alias("turns"), F.round(F.sum("cost"), 4).alias("cost"))


def material_loss(d1: Column, d2: Column, d3: Column, d4: Column) -> Column:
    return (d1 >= 2) | (d2 >= 1) | (d3 >= 1) | (d4 >= 2)


def price_difference(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of requested less cost of served models per request; prices: model, in_price, out_price per million tokens."""
    p = F.broadcast(prices) if prices.count() <= 10_000 else prices
    cost = lambda side: (F.col("in_tokens") * F.col(f"{side}.in_price") + F.col("out_tokens") * F.col(f"{side}.out_price")) / 1e6
    both = log.join(p.alias("r"), F.col("requested") == F.col("r.model"), "left").join(p.alias("s"), F.col("served") == F.col("s.model"), "left")
    return both.select(*log.columns, F.round(cost("r") - cost("s"), 6).alias("saved_dollars"))


def request_line() -> Column:
    """One JSON line of a served request, never with its texts: from tier, requested, used, reason, signals, status, latency_ms,
    ctx_tokens, in_tokens, out_tokens and session. Without a used model, the requested one ran."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    ran = T.or_dash(F.coalesce(F.nullif("used", F.lit("")), F.col("requested")))
    numbers = ("status", "latency_ms", "ctx_tokens", "in_tokens", "out_tokens")
    return F.to_json(F.struct(text("tier"), T.or_dash(F.col("requested")).alias("requested"), ran.alias("model"), text("reason"), text("signals"), *numbers, T.short_session(F.coalesce("session", F.lit(""))).alias("session")))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event log of JSON lines; bad lines are left out."""
    return spark.read.schema(EVENTS).option("mode", "DROPMALFORMED").json(path)
