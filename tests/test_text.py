"""Text primitives against plain Python versions on edge strings."""

import random
import re

from pyspark.sql import functions as F

from condensa.functions import text as T
from condensa.functions.columnar import token_cost
from condensa.functions.exact import json_confidence, rewrites, similar_frames, valid_json

EDGE = ["", "\n", "a\n", "a\r\nb", "a\rb", "\x0b\x85 é word", "漢字 and 😀😀", "\x1b[31mred\x1b[0m", "\x1b[3", "x" * 3999 + "é" * 4, "y" * 3998 + "😀z", "FKEEPX 12 1.0e5", "a  b\t\tc   d", "..,,;;!!" * 3]


def column(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", expr(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def slow_tokens(s):
    total = 0
    for m in re.finditer(r"[A-Za-z]+|[0-9]+|[ \t]+|\n+|[^\x00-\x7f]+|[^A-Za-z0-9 \t\n\x80-\U0010ffff]+", s):
        n, c = len(m[0]), m[0][0]
        total += n if ord(c) > 127 else 1 + (n - 1) // 8 if c.isalpha() else -(-n // 3) if c.isdigit() else (1 + (n - 2) // 6 if n > 1 else 0) if c in " \t" else 1 if c == "\n" else -(-n // 4)
    return total


def test_tokens(spark):
    rng = random.Random(5)
    texts = EDGE + ["".join(rng.choice("ab1 \t\n.,é漢😀\r") for _ in range(rng.randrange(60))) for _ in range(300)]
    assert column(spark, texts, T.estimate_tokens) == [slow_tokens(t) for t in texts] == [token_cost(t) for t in texts]


def test_prose_ratio_counts_a_cut_code_point_per_byte(spark):
    def slow(t):
        sample = t if len(t.encode()) <= 4000 else None
        if sample is None:
            raw, sample, i = t.encode()[:4000], "", 0
            while i < len(raw):
                n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                piece = raw[i : i + n]
                try:
                    sample, i = sample + piece.decode(), i + n
                except UnicodeDecodeError:
                    sample, i = sample + "�", i + 1
        return 1.0 if not t else sum(c.isalpha() or c.isspace() for c in sample) / len(sample)

    texts = [*EDGE, "é" * 2500, "a" + "é" * 2500, "漢" * 2000, "ab" + "😀" * 1500]
    got = column(spark, texts, T.prose_ratio)
    for t, x in zip(texts, got, strict=True):
        if "\x85" not in t:
            assert abs(x - slow(t)) < 1e-9, t[:10]


def test_small_rules(spark):
    assert column(spark, ["claude-x-4-20250101", "claude-x-latest", " m "], T.canonical_model) == ["claude-x-4", "claude-x", "m"]
    assert column(spark, ["abcdef\rxy", "a\r", "10%\r20%\r5%"], T.overlay_frames) == ["xycdef", "a", "5%%"]
    assert column(spark, ["w: use v2 at 0xFF /a/b 12", "no delimiter 12", "k=7"], T.normalize_line) == ["w: use v2 at ADDR /PATH/ N", "no delimiter 12", "k=N"]
    assert column(spark, ["a\n\n\n\nb", "a\n \n\t\nb", "a\n\nb"], T.collapse_blank_runs) == ["a\n\nb", "a\n\nb", "a\n\nb"]
    assert column(spark, ["  1\ta\n2\tb", "x\n"], T.strip_line_numbers) == ["a\nb", "x\n"]
    assert column(spark, ["the cat.", "concat", "CAT"], lambda c: T.contains_word(c, "cat")) == [True, False, True]


def test_json_and_frames():
    assert valid_json('{"a":1,"a":2}') and not valid_json('{"a":1}{"b":2}') and not valid_json("NaN") and not valid_json("[1,]")
    assert json_confidence('{"a":1}\n{"b":2}\nx') == 0.5 + 0.5 * 2 / 3 and json_confidence("x") is None and json_confidence(None) is None
    assert similar_frames(b"Downloading 4%", b"Downloading 5%") and not similar_frames(b"", b"a") and not rewrites([b"abc", b"xyz", b"qqq"])
