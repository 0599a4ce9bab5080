"""Signals of chat requests, read from their JSON bodies by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Content stays raw text until it is known to be a string or a list of blocks.
BODY = "struct<model:string,tools:array<string>,messages:array<struct<role:string,content:string>>>"
BLOCKS = "array<struct<type:string,text:string>>"


def injected(text: Column) -> Column:
    return T.trim(text).startswith("<system-reminder>")


def _blocks(content: Column) -> Column:
    return F.when(content.rlike(r"\A[\t\n\r ]*\["), F.from_json(content, BLOCKS))


def user_text(content: Column) -> Column:
    """Text of a message: the string itself, or its text blocks without injected ones."""
    blocks = F.filter(_blocks(content), lambda b: (b.type == "text") & (F.length(b.text) > 0) & ~injected(b.text))
    return F.coalesce(F.array_join(F.transform(blocks, lambda b: b.text), "\n"), content, F.lit(""))


def extract(df: DataFrame, body: str = "content", session: str | None = None, scope: str = "full", turns: int = 0) -> DataFrame:
    """Adds requested_model, context_tokens, message_count, has_tools, tool_loop, last_user_text, recent_text, session_id and
    parsed (false for bodies that aren't JSON objects; those keep only context_tokens)."""
    keep = df.columns
    df = df.withColumn("_b", F.from_json(F.col(body), BODY))
    said = F.filter(F.transform(F.filter("_b.messages", lambda m: m.role == "user"), lambda m: user_text(m.content)), lambda t: ~T.is_blank(t))
    df = df.withColumns({"_said": F.coalesce(said, F.array().cast("array<string>")), "_last": F.element_at("_b.messages", -1)})
    loop = (F.col("_last.role") == "user") & F.exists(_blocks(F.col("_last.content")), lambda b: b.type == "tool_result")
    last = F.coalesce(F.try_element_at("_said", F.lit(-1)), F.lit(""))
    some = F.when((F.size("_said") > turns) & F.lit(turns > 0), F.slice("_said", -max(turns, 1), max(turns, 1))).otherwise(F.col("_said"))
    recent = {"last_user_turn": last, "recent_turns": F.array_join(some, "\n")}.get(scope, F.array_join("_said", "\n"))
    parsed = F.col("_b").isNotNull() & F.trim(F.col(body)).startswith("{")
    return df.select(
        *keep, T.canonical_model(F.coalesce("_b.model", F.lit(""))).alias("requested_model"), F.floor(F.octet_length(body) / 4).cast("long").alias("context_tokens"),
        F.greatest(F.coalesce(F.size("_b.messages"), F.lit(0)), F.lit(0)).alias("message_count"), F.coalesce(F.size("_b.tools") > 0, F.lit(False)).alias("has_tools"), F.coalesce(loop, F.lit(False)).alias("tool_loop"),
        last.alias("last_user_text"), recent.alias("recent_text"), (F.col(session) if session else F.lit("")).alias("session_id"), parsed.alias("parsed"),
    )


def model_text() -> Column:
    """What model signals look at."""
    return F.coalesce(F.nullif("last_user_text", F.lit("")), F.col("recent_text"))


ROLES = ("haiku", "sonnet", "opus")


def newest_models(df: DataFrame, text: str = "content") -> DataFrame:
    """The best model id per family among those named in texts: dated before bare, then the largest."""
    ids = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"claude-[a-z0-9.-]+"), F.lit(0))).alias("id"))
    family = F.coalesce(*[F.when(F.col("id").contains(f), F.lit(f)) for f in ROLES])
    return ids.withColumn("family", family).filter("family IS NOT NULL").groupBy("family").agg(F.max_by("id", F.struct(F.col("id").rlike(r"-[0-9]{8}\z"), "id")).alias("model"))
