"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk estimator (Kiryo et al., 2017).

Trusted positives are the documents with quality 1; all documents, whatever their label, are the unlabelled side. A
document is described by statistics of its whole text (letter, digit and symbol shares, shapes and repetition of words,
lines); ids, language and source are never looked at. A linear scorer f minimises

    prior * mean_P loss(f) + max(0, mean_U loss(-f) - prior * mean_P loss(-f))

with the logistic loss; while the inner difference is negative, the step goes up it instead. The class prior is estimated
from a first scorer that tells positives from unlabelled rows: the ratio of the share of unlabelled rows above a threshold to
the share of positives above it, at the threshold with the least upper bound of that ratio. The risk's own minimum decides: nothing is shifted afterwards, and a score is
the logistic function of f.

Every text is described once, in one pass, and written as numbers (about 150 bytes a row). The prior counts all of those
rows, in one pass of mergeable counts. Only the weights rest on a sample: at most about max_positive and max_unlabelled
rows, drawn by a hash of doc_id, whose numbers (not texts) go to the driver.

Nulls: null and empty texts have the statistics of an empty text and get a score; null ids come back as null and never
carry a label. Repeated rows are scored each; repeated labels count once (the largest quality). Without positives every
score is 0.5. An empty table gives an empty table; clashing and other columns are not read by score_quality().
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import starmap
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hex32, materialize, remainder5, small_batches, table

MAX_POSITIVE, MAX_UNLABELLED = 20_000, 40_000
THRESHOLD = 0.3
CLIP, STEPS, DECAY = 6.0, 600, 1e-3
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_SHARES = np.stack([
    _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(bytes(range(48, 58))), _mask(SYMBOLS), _mask(b"!?"), _mask(b"."), _mask(b","), _mask(b"\"'()-:;"),
    _mask(b" \t\n\r\x0b\x0c"), _mask(b"\n"), _mask(bytes(range(128, 256))), _mask(bytes([*range(9), *range(14, 32), 127])),
], axis=1)
N_FEATURES = 2 * _SHARES.shape[1] + 14


def statistics(text: bytes | None) -> np.ndarray:
    """What the scorer knows of a text."""
    text = text or b""
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _SHARES / max(1, len(text))
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    if not n:
        return np.concatenate([shares, np.sqrt(shares), np.zeros(13), [1.0]])
    low = text.lower().split()
    distinct = len(set(low))
    again = sum(starmap(eq, zip(low, low[1:], strict=False)))
    full = [x for x in lines if x.strip()]
    more = [
        math.log1p(n), distinct / n, math.log1p(distinct) / math.log1p(n), again / n, math.sqrt(again / n), sum(map(len, words)) / n / 10,
        sum(map(bytes.isupper, words)) / n, sum(map(bytes.isalpha, words)) / n, sum(map(bytes.istitle, words)) / n, sum(w[-1] in b".,;:!?" for w in words) / n,
        math.log1p(n / max(1, len(full))), 1 - len(set(full)) / max(1, len(full)), max(map(len, words)) / len(text), 0.0,
    ]
    return np.concatenate([shares, np.sqrt(shares), more])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _descend(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def prior_cuts(positive: np.ndarray, floor: float = 0.25) -> np.ndarray:
    """Thresholds that at least `floor` of the positives pass, from their scores."""
    return np.quantile(positive, np.linspace(0.002, 1 - floor, 200))


def counts_above(cuts: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """How many scores reach each threshold."""
    return len(scores) - np.searchsorted(np.sort(scores), cuts, side="left")


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_unlabelled: int) -> float:
    """The share ratio at the threshold with the least upper bound of it (Garg et al., 2021), from how many of both sides
    reach each."""
    p, u = positive / n_positive, unlabelled / n_unlabelled
    doubt = sum(math.sqrt(math.log(40) / (2 * n)) for n in (n_positive, n_unlabelled))
    best = int(np.argmin((u + doubt) / p))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


class Scorer:
    """Scales, weights and prior; small enough to go along with the function that uses it."""

    def __init__(self, center: np.ndarray | None = None, scale: np.ndarray | None = None):
        self.center = np.zeros(N_FEATURES) if center is None else center
        self.scale = np.ones(N_FEATURES) if scale is None else scale
        self.prior, self.weights = 0.5, np.zeros(N_FEATURES + 1)

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.append(np.clip((rows - self.center) / self.scale, -CLIP, CLIP), np.ones((len(rows), 1)), axis=1)

    def places(self, rows: np.ndarray) -> np.ndarray:
        return (self.scaled(rows) * self.weights).sum(axis=1)  # unlike a matrix product, the same in every batch

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(self.places(rows))


def tell_apart(positive: np.ndarray, unlabelled: np.ndarray) -> Scorer:
    """The first scorer: positives against unlabelled rows, both sides of equal weight."""
    out = Scorer(positive.mean(axis=0), np.maximum(np.concatenate([positive, unlabelled]).std(axis=0), 1e-3))
    p, u = out.scaled(positive), out.scaled(unlabelled)
    out.weights = _descend(lambda w: -(p.T @ _sigmoid(-p @ w)) / len(p) + (u.T @ _sigmoid(u @ w)) / len(u) + DECAY * w, N_FEATURES + 1, STEPS // 2)
    return out


def least_risk(first: Scorer, prior: float, positive: np.ndarray, unlabelled: np.ndarray) -> Scorer:
    """The minimum of the non-negative risk."""
    out = Scorer(first.center, first.scale)
    out.prior = prior
    p, u = out.scaled(positive), out.scaled(unlabelled)

    def slope(w):
        fp, fu = p @ w, u @ w
        up = prior * -(p.T @ _sigmoid(-fp)) / len(p)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        down = (u.T @ _sigmoid(fu)) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)
        return (up + down if negative >= 0 else -down) + DECAY * w

    out.weights = _descend(slope, N_FEATURES + 1, STEPS)
    return out


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "x"])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the whole text as float32, of every document; written, so texts are read once."""
    small_batches(docs.sparkSession)
    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_describe, "doc_id long, x binary"), "quality-described")


def _numbers(x: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _sorted(drawn: DataFrame) -> np.ndarray:
    """The rows of a drawn sample in an order of their own, so that reruns agree."""
    return _numbers(sorted(drawn.select("x").toArrow().column("x").to_pylist()))


def _draw(rows: DataFrame, n: int, most: int) -> DataFrame:
    return rows if n <= most else rows.filter(hex32(F.concat(F.lit("quality:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) < int(most / n * 2**32))


def fit(described: DataFrame, positives: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Scorer:
    """described: see describe() (the unlabelled side). positives: doc_id of trusted documents."""
    asked = _draw(positives.select("doc_id").distinct(), positives.count(), max_positive)  # about max_positive ids at most
    known = described.join(F.broadcast(asked), "doc_id", "left_semi").select("x")
    positive = _sorted(_draw(known.withColumn("doc_id", F.xxhash64("x")), known.count(), 2 * max_positive))
    n = described.count()
    if not len(positive) or not n:
        return Scorer()
    unlabelled = _sorted(_draw(described, n, max_unlabelled))
    if not len(unlabelled):
        unlabelled = positive
    # the first scorer learns from every other positive and is judged by the rest, else its prior comes out too low
    first = tell_apart(positive[::2], unlabelled)
    scored = first.places(positive[1::2] if len(positive) > 1 else positive)
    cuts = prior_cuts(scored)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cuts), np.int64)
        for batch in batches:
            total += counts_above(cuts, first.places(_numbers(batch.column(0).to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts))), pa.array(total)], ["cut", "n"])

    above = {r.cut: r.n for r in described.select("x").mapInArrow(count, "cut long, n long").groupBy("cut").agg(F.sum("n").alias("n")).collect()}
    prior = estimate_prior(counts_above(cuts, scored), np.array([above.get(k, 0) for k in range(len(cuts))]), len(scored), n)
    return least_risk(first, prior, positive, unlabelled)


def score_quality(described: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every described document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(_numbers(batch.column(1).to_pylist())))], ["doc_id", "score"])

    return described.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that score below threshold; all columns stay."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if texts:
                rows = np.stack([statistics(None if t is None else t.encode("utf-8", "surrogatepass")) for t in texts]).astype(np.float32)
                yield batch.filter(pa.array(scorer.score(rows) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def trusted(labels: DataFrame) -> DataFrame:
    """Ids with quality 1 among the rows that may be learnt from (crc32 of the id mod 5 is not 0)."""
    return labels.filter((remainder5(F.col("doc_id")) != 0) & F.col("doc_id").isNotNull() & (F.col("quality") == 1)).select("doc_id").distinct()


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    described = describe(table(spark, sf_dir, "documents"))
    out = score_quality(described, fit(described, trusted(table(spark, sf_dir, "labels"))))
    return out.select("doc_id", (remainder5(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
