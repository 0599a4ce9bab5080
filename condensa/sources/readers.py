"""Reading texts, tool events and logs; writing verdicts."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

_WHITE = re.compile(r"[ \t\r\n]*")
MIN_BYTES, MAX_EVENT_BYTES = 256, 32 * 2**20


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: path, content, sha (first 12 hex digits of SHA-256). Markdown files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.filter(~F.col("path").endswith(".md")).select("path", F.decode("content", "UTF-8").alias("content"), F.substring(F.sha2("content", 256), 1, 12).alias("sha"))


def _text_at(raw: Column, path: str) -> Column:
    """A JSON string at a path, null for other kinds of values."""
    return F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), path, "variant")) == "STRING", F.try_variant_get(F.try_parse_json(raw), path, "string"))


def tool_text(response: Column, output: Column) -> Column:
    """The text of a tool response: the response itself if it is a string, else stdout, output, result or file.content, the
    first that is a non-empty string, else the older output field."""
    found = [F.nullif(_text_at(response, p), F.lit("")) for p in ("$", "$.stdout", "$.output", "$.result", "$.file.content")]
    return F.coalesce(*found, F.nullif(output, F.lit("")))


_decoder = json.JSONDecoder()


def _members(text: str, at: int) -> dict[str, tuple[int, int]]:
    """Where the values of the object at a place begin and end, by key; of equal keys the last."""
    found, at = {}, _WHITE.match(text, at + 1).end()
    while text[at] != "}":
        key, at = scanstring(text, at + 1)
        low = _WHITE.match(text, _WHITE.match(text, at).end() + 1).end()
        _, high = _decoder.raw_decode(text, low)
        found[key] = low, high
        at = _WHITE.match(text, high).end()
        at = _WHITE.match(text, at + 1).end() if text[at] == "," else at
    return found


def rebuild(response: str | None, text: str) -> str | None:
    """The response with its text (see tool_text()) swapped for another and all else as it was, byte by byte; null where it has
    no text."""
    try:
        whole = json.loads(response) if response else None
        if isinstance(whole, str) and whole:
            return json.dumps(text, ensure_ascii=False)
        if not isinstance(whole, dict):
            return None
        outer = _members(response, _WHITE.match(response, 0).end())
        for key in ("stdout", "output", "result"):
            if isinstance(whole.get(key), str) and whole[key]:
                low, high = outer[key]
                return response[:low] + json.dumps(text, ensure_ascii=False) + response[high:]
        file = whole.get("file")
        if isinstance(file, dict) and isinstance(file.get("content"), str) and file["content"]:
            low, high = _members(response, outer["file"][0])["content"]
            return response[:low] + json.dumps(text, ensure_ascii=False) + response[high:]
    except (ValueError, RecursionError):
        pass
    return None


@F.pandas_udf(K.StringType())
def rebuild_udf(responses: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([rebuild(r, t) if t is not None else None for r, t in zip(responses, texts, strict=True)], dtype=object)


def hook_reply(updated: Column) -> Column:
    """The reply that hands back a rebuilt response (JSON)."""
    return F.concat(F.lit('{"hookSpecificOutput":{"hookEventName":"PostToolUse","updatedToolOutput":'), updated, F.lit("}}"))


def hook_events(df: DataFrame, event: str = "content") -> DataFrame:
    """Tool texts of post-use events: session_id, tool_name, text; short and oversized events are left out."""
    raw = F.col(event)
    fields = F.from_json(raw, "hook_event_name string, session_id string, tool_name string, tool_output string, tool_response string")
    rows = df.filter(F.octet_length(raw) <= MAX_EVENT_BYTES).withColumn("_e", fields).filter("_e.hook_event_name = 'PostToolUse'")
    response = F.get_json_object(raw, "$.tool_response")
    quoted = F.when(_text_at(raw, "$.tool_response").isNotNull(), F.to_json(F.array(_text_at(raw, "$.tool_response")))).otherwise(response)
    bare = F.when(_text_at(raw, "$.tool_response").isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(response)
    text = tool_text(bare, F.col("_e.tool_output"))
    return rows.select(*df.columns, F.col("_e.session_id").alias("session_id"), F.col("_e.tool_name").alias("tool_name"), text.alias("text")).filter(F.octet_length("text") >= MIN_BYTES)


def append_events(events: DataFrame, path: str) -> None:
    """Appends to a log of JSON lines."""
    events.write.mode("append").json(path)


def write_texts(df: DataFrame, path: str, column: str = "output") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
