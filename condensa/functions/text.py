"""Text primitives as Column expressions, with DuckDB twins for checking.

Sizes are bytes of UTF-8 unless said otherwise. White space is space, tab, newline, vertical tab, form feed and carriage
return plus the Unicode spaces U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000 for trimming.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import java

BLANK = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SAMPLE_BYTES = 4000


def matches(text: Column, name: str) -> Column:
    return text.rlike(java(name))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+\\z", "")


def trim_left(text: Column, chars: str = r"[ \t\r\n]") -> Column:
    return F.regexp_replace(text, f"^{chars}+", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{BLANK[1:-1]}]")


def once(value: Column, use) -> Column:
    """use(value) with value computed once per row; a plain reference would be computed at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def count_lines(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def non_blank(lines: Column, most: int | None = None) -> Column:
    found = F.filter(lines, lambda x: ~is_blank(x))
    return F.slice(found, 1, most) if most else found


def count_of(text: Column, what: str) -> Column:
    """Occurrences of a plain string (not overlapping)."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


#: One match for each token of the estimate, so that texts are read once: pieces of up to eight letters, three digits, six blanks
#: after a blank, newlines, four other ASCII characters, or one other code point. Only single and leading blanks match nothing.
_COSTS = r"[A-Za-z]{1,8}+|[0-9]{1,3}+|(?<=[ \t])[ \t]{1,6}+|\n++|[\x00-\x08\x0B-\x1F!-/:-@\[-`{-\x7F]{1,4}+|[^\x00-\x7F]"


def estimate_tokens(text: Column) -> Column:
    """Token cost by runs: letters 1 + (n-1)/8, digits n/3 up, blanks beyond one 1 + (n-2)/6, newlines 1, other ASCII n/4
    up, each other code point 1."""
    marks = F.regexp_replace(text, _COSTS, "x")
    return F.length(F.replace(F.replace(marks, F.lit(" "), F.lit("")), F.lit("\t"), F.lit(""))).cast("long")


def tokens_sql(text: str) -> str:
    run = lambda pattern, cost: f"coalesce(list_sum(list_transform(regexp_extract_all({text}, '{pattern}'), lambda r: {cost})), 0)"
    return (
        "(" + run("[A-Za-z]+", "1 + (length(r) - 1) // 8") + " + " + run("[0-9]+", "(length(r) + 2) // 3") + " + " + run(r"[ \t]{2,}", "1 + (length(r) - 2) // 6") + " + "
        + run(r"\n+", "1") + " + " + run(r"[\x00-\x08\x0B-\x1F!-/:-@\[-`{-\x7F]+", "(length(r) + 3) // 4") + f" + length(regexp_replace({text}, '[\\x00-\\x7F]', '', 'g')))::BIGINT"
    )


def byte_sample(text: Column, most: int = SAMPLE_BYTES) -> Column:
    """The first bytes of a text; a code point cut at the end counts as one replacement character per byte."""
    raw = text.cast("binary")
    head = F.substring(raw, 1, most)
    tail = F.hex(F.substring(head, -3, 3))
    cut = (
        F.when(tail.rlike("([C-F][0-9A-F])\\z"), 1)
        .when(tail.rlike("([EF][0-9A-F][89AB][0-9A-F])\\z"), 2)
        .when(tail.rlike("(F[0-9A-F]([89AB][0-9A-F]){2})\\z"), 3)
        .otherwise(0)
    )
    good = F.decode(F.substring(raw, F.lit(1), F.lit(most) - cut), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(good, F.repeat(F.lit("�"), cut)))


def prose_ratio(text: Column) -> Column:
    """Share of letters and white space among the code points of the sample; 1.0 for an empty text."""
    sample = byte_sample(text)
    kept = F.length(F.regexp_replace(sample, r"[^\p{L}\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", ""))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(kept / F.length(sample))


def sentence_ratio(lines: Column) -> Column:
    """Share of non-blank lines that end with . ! or ?"""
    total = count_lines(lines, lambda x: ~is_blank(x))
    ended = count_lines(lines, lambda x: x.rlike(f"[.!?]{BLANK}*\\z"))
    return F.when(total == 0, F.lit(0.0)).otherwise(ended / total)


def strip_ansi(text: Column) -> Column:
    return F.when(text.contains("\x1b"), F.regexp_replace(text, java("ansi"), "")).otherwise(text)


def collapse_blank_runs(text: Column) -> Column:
    return F.regexp_replace(text, java("blank_run"), "\n\n")


def strip_line_numbers(text: Column) -> Column:
    return F.array_join(F.transform(split_lines(text), lambda x: F.regexp_replace(x, java("line_numbered"), "")), "\n")


def overlay_frames(line: Column) -> Column:
    """What a terminal shows of carriage-return frames: each frame overwrites the start of the one before."""
    frames = F.split(line, "\r", -1)
    lay = lambda shown, f: F.when(F.length(f) == 0, shown).otherwise(F.concat(f, F.substring(shown, F.length(f) + 1, F.greatest(F.length(shown) - F.length(f), F.lit(0)))))
    return F.aggregate(frames, F.lit(""), lay)


def normalize_line(line: Column) -> Column:
    """Key for equal warnings: after the first ':' or '=', addresses, paths and counters are masked, version tokens stay."""
    at = F.regexp_instr(line, F.lit("[:=]"))
    tail = F.substring(line, at + 1, F.length(line))
    tail = F.regexp_replace(tail, "0x[0-9a-fA-F]+", "ADDR")
    tail = F.regexp_replace(tail, r"/[\w./\-]+", "/PATH/")
    tail = F.regexp_replace(tail, r"(?i)(?<![0-9])([0-9]++)(?!(?<=(?<![A-Za-z0-9_])v[0-9]{1,20})(?![A-Za-z0-9_]))", "N")
    return F.when(at == 0, line).otherwise(F.concat(F.substring(line, F.lit(1), at), tail))


def contains_word(text: Column, word: str) -> Column:
    """Whether a lower-cased text holds a word between edges or other characters than ASCII letters and digits."""
    quoted = "\\Q" + word.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.lower(text).rlike(f"(?<![a-z0-9]){quoted}(?![a-z0-9])")


def canonical_model(model: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trim(model), r"-latest\z", ""), r"-[0-9]{8}\z", "")


def max_int_field(body: Column, field: str) -> Column:
    """The largest integer that follows "field": anywhere in a body, 0 if none."""
    found = F.regexp_extract_all(body, F.lit(f'"{field}": *([0-9]+)'), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("long"))), F.lit(0).cast("long"))


def or_dash(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("-"))


def short_session(session: Column) -> Column:
    return F.when(F.length(session) == 0, "-").otherwise(F.substring(session, 1, 8))


def truncated(text: Column, most: int = 160) -> Column:
    """Cut to `most` bytes, with a mark where something went."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(byte_sample(text, most), "�+\\z", ""), F.lit("…")))


def split_log_prefix(line: Column) -> tuple[Column, Column]:
    """(time stamp or null, rest) of a line with an optional YYYY/MM/DD HH:MM:SS prefix."""
    stamp = F.regexp_extract(line, r"^([0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}) ", 1)
    rest = F.when(F.length(stamp) > 0, F.substring(line, F.length(stamp) + 2, F.length(line))).otherwise(line)
    return F.try_to_timestamp(F.when(F.length(stamp) > 0, stamp), F.lit("yyyy/MM/dd HH:mm:ss")), rest


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
