"""Language-model scoring: hashed maximum entropy with a class-factored softmax.

P(w | history) = P(class of w | history) * P(w | class, history). The HEAD most frequent tokens lie in classes of WIDTH by
rank; both factors are maximum-entropy models for them. All other words lie in TAILS classes by their last two bytes;
inside such a class a word has the add-half share of its training count, so every word of the corpus, known or not, has
a probability. Features are the last three tokens, one by one (n-gram and skip features), and the hashed pair of the last
two. Weights start at the unigram model.

Counts cover all training texts. Only words of at least a threshold count, at most KEPT of them, go to the workers as a
dictionary; the rest are joined by shuffle. One pass encodes every text as symbols of two bytes a token; learning and
scoring read those. Training reads every training text once, in two rounds: texts are dealt to learners by a hash, each
learner takes its texts in the order of a hash, starts from the current weights and makes gradient steps on batches of
tokens; after a round the weights are averaged by feature, weighted by how often each learner met it. Scoring is one pass
of sparse gathers and dense sums.

What is gathered grows with the input: the counts with the vocabulary, the hashed feature rows with the square root of the
training tokens (up to MOST_ROWS, which a worker's memory sets), the number of learners with the tokens; the symbols of a
learner's texts, two bytes a token and about a hundred megabytes at most, are one group. All of it follows
from the data alone, so scores are the same on any number of cores.

Nulls: a null or empty text is its end token alone; a null doc_id counts as an empty text in the split. Repeated rows are
scored each. An empty table gives an empty table; clashing and other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remainder5, small_batches, table

HEAD, WIDTH, TAILS = 1024, 32, 32
TOPS = HEAD // WIDTH
CLASSES = TOPS + TAILS
SYMBOLS = HEAD + TAILS + 1  # history symbols: head tokens, tail classes, and before-the-text
BEFORE = SYMBOLS - 1
LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 17
#: Words of the dictionary that goes to the workers; bytes of words that a worker counts at a time.
KEPT, HELD = 1 << 18, 16 << 20
TOKENS_PER_ROW, ROUNDS = 400, (0.2, 0.8)
BATCH, RATE = 16384, 0.3
END = b""
#: Tokens that are scored at a time, so that their arrays stay in a core's cache; no result depends on it.
SCORED_AT_ONCE = 1024
#: Rows that one piece of a sum by groups has at most.
PIECE = 16
LOG10 = 1 / math.log(10)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of texts, one after the other, and how many each has. Arrow's kernels for ASCII go by bytes,
    whatever these are."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string(), safe=False).fill_null("")))
    parts = pc.ascii_split_whitespace(texts)
    words, times = parts.flatten().cast(pa.binary()), pc.list_value_length(parts).to_numpy().astype(np.int64)
    some = pc.binary_length(texts).to_numpy() > 0
    if not some.all():  # no text gives one empty part
        words, times = words.filter(pa.array(np.repeat(some, times))), times * some
    return words, times


# Counts


def _partial_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, texts = [], 0, 0

    def counted():
        found = pc.value_counts(pa.concat_arrays(held))
        held.clear()
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "c"])

    for batch in batches:
        words, _ = words_of(batch.column(0))
        held.append(words)
        size += words.nbytes
        texts += batch.num_rows
        if size >= HELD:
            yield counted()
            size = 0
    if held:
        yield counted()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], ["word", "c"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of docs, the end token as an empty word."""
    return docs.select(F.col("text").cast("binary")).mapInArrow(_partial_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The dictionary of frequent words and the totals, small enough to go to every worker."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.tokens, self.types = int(total.n), int(total.v)
        level = F.floor(F.log2("c") * 8)
        sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("level").desc()).collect()
        held, least = 0, 2**62
        for r in sizes:
            held += r.n
            if held > KEPT - 1:
                break
            least = r.level
        frequent = counts.filter((level >= least) | (F.col("word") == F.lit(b""))).toArrow().to_pydict()
        ranked = sorted(zip(frequent["c"], frequent["word"], strict=True), key=lambda x: (x[1] != END, -x[0], x[1]))
        if not ranked or ranked[0][1] != END:
            ranked.insert(0, (0, END))
        self.words = [bytes(w) for _, w in ranked]
        self.counts = np.array([c for c, _ in ranked], np.float64)
        self.rest = counts.filter(~((level >= least) | (F.col("word") == F.lit(b""))))
        # what is not in the model's head, by last two bytes; there are at most 65536 of them
        ends = self.rest.groupBy(F.substring("word", -2, 2).alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow().to_pydict()
        mass: Counter = Counter()
        for e, c, n in zip(ends["e"], ends["c"], ends["n"], strict=True):
            mass[bytes(e)] += c + 0.5 * n
        for w, c in zip(self.words[HEAD:], self.counts[HEAD:], strict=True):
            mass[w[-2:]] += c + 0.5
        top = sorted(mass.items(), key=lambda x: (-x[1], x[0]))
        self.tail_class = {e: k for k, (e, _) in enumerate(top[: TAILS - 1])}
        self.tail_mass = np.full(TAILS, 0.5)
        for e, m in top:
            self.tail_mass[self.tail_class.get(e, TAILS - 1)] += m


class Lexicon:
    """What workers need of a Vocabulary: plain arrays, no DataFrame."""

    def __init__(self, v: Vocabulary):
        self.words = pa.array(v.words, pa.binary())
        self.log_counts = np.log10(v.counts + 0.5)
        self.known = v.counts > 0
        self.log_tail = np.log10(v.tail_mass)
        # tail classes by the last two bytes, or by the only one
        self.tail_class = np.full((1 << 16) + 256, TAILS - 1)
        for e, k in v.tail_class.items():
            if e:
                self.tail_class[int.from_bytes(e, "big") + (len(e) == 1) * (1 << 16)] = k
        tails = np.array([v.tail_class.get(w[-2:], TAILS - 1) for w in v.words], np.int64)
        symbol = np.arange(len(v.words))
        symbol[HEAD:] = HEAD + tails[HEAD:]
        self.symbol = np.concatenate([symbol, HEAD + np.arange(TAILS)[::-1]])  # negative ranks index from the end

    def ranks(self, words: pa.Array) -> np.ndarray:
        """Ranks in the dictionary, or -1 - tail class. Words aren't empty."""
        found = pc.index_in(words, value_set=self.words)
        ranks = found.fill_null(-1).to_numpy().astype(np.int64)
        rest = words.filter(found.is_null())
        if len(rest):
            _, offsets, data = rest.buffers()
            ends = np.frombuffer(offsets, np.int32)[rest.offset : rest.offset + len(rest) + 1].astype(np.int64)
            data, length, last = np.frombuffer(data, np.uint8), np.diff(ends), ends[1:] - 1
            before = np.where(length > 1, data[np.maximum(last - 1, 0)], 256).astype(np.int64)
            ranks[ranks < 0] = -1 - self.tail_class[before * 256 + data[last]]
        return ranks


# Model

#: Where each kind of feature begins in the two weight tables: hashed rows stand last, before the bias of the first table.
PAIR_ROW, NEAR_ROW = 3 * SYMBOLS, TOPS


def hashed_rows(tokens: int) -> int:
    """Rows for pairs of the last two symbols, for the last symbol in a class, and half as many for the one before it."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << round(math.log2(1.8 * math.sqrt(tokens + 1)))))


def start_weights(v: Vocabulary, rows: int = LEAST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The unigram model as the two bias rows."""
    head = np.full(HEAD, -30.0)
    n = min(HEAD, len(v.counts))
    head[:n] = np.log(v.counts[:n] + 0.5)
    by_class = np.logaddexp.reduce(head.reshape(TOPS, WIDTH), axis=1)
    classes = np.zeros((PAIR_ROW + rows + 1, CLASSES), np.float32)
    bias = np.concatenate([by_class, np.log(v.tail_mass)])
    classes[-1] = bias - np.logaddexp.reduce(bias)
    inside = np.zeros((NEAR_ROW + rows + rows // 2, WIDTH), np.float32)
    inside[:NEAR_ROW] = head.reshape(TOPS, WIDTH) - by_class[:, None]
    return classes, inside


def history(docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Symbols of all tokens of some texts, and of the three tokens before each."""
    n = sum(map(len, docs))
    flat = np.full(n + 3 * len(docs), BEFORE, np.int64)
    real = np.ones(len(flat), bool)
    at = 0
    for d in docs:
        real[at : at + 3] = False
        flat[at + 3 : at + 3 + len(d)] = d
        at += 3 + len(d)
    place = np.flatnonzero(real)
    return flat[place], flat[place - 1], flat[place - 2], flat[place - 3]


def class_features(p1: np.ndarray, p2: np.ndarray, p3: np.ndarray, rows: int) -> list[np.ndarray]:
    pair = ((p1 * 1_000_003 + p2) * 2_654_435_761 >> 16) % rows
    return [p1, p2 + SYMBOLS, p3 + 2 * SYMBOLS, pair + PAIR_ROW]


def word_features(p1: np.ndarray, p2: np.ndarray, c: np.ndarray, rows: int) -> list[np.ndarray]:
    near = ((p1 * 10_007 + c) * 2_654_435_761 >> 16) % rows
    far = ((p2 * 20_011 + c) * 2_654_435_761 >> 16) % (rows // 2)
    return [near + NEAR_ROW, far + NEAR_ROW + rows, c]


def log_softmax(w: np.ndarray, features: list[np.ndarray], bias: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, their exponentials, and the sums of those. Only rows whose sum leaves the safe range are shifted by their
    maximum, which costs more than all else here; a row's result does not depend on the others."""
    z = w.take(features[0], axis=0, mode="clip")  # features are in range; this mode writes without a copy
    more = np.empty_like(z)
    for f in features[1:]:
        z += w.take(f, axis=0, out=more, mode="clip")
    if bias is not None:
        z += w[bias]
    with np.errstate(over="ignore"):
        e = np.exp(z, out=more)
        total = np.einsum("ij->i", e)
    odd = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))
    if len(odd):
        z[odd] -= z[odd].max(axis=1, keepdims=True)
        e[odd] = np.exp(z[odd])
        total[odd] = e[odd].sum(axis=1)
    return z, e, total


def stable_order(f: np.ndarray) -> np.ndarray:
    """The stable order of row numbers, by 16 bits at a time, which NumPy sorts by radix."""
    order = np.argsort(f.astype(np.uint16), kind="stable")
    high = f >> 16
    return order[np.argsort(high[order].astype(np.uint16), kind="stable")] if high.any() else order


def group_sums(g: np.ndarray, order: np.ndarray, cuts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The sums of g[order] by group; groups begin at cuts and have so many rows. Groups are cut into pieces, whose first
    rows are added at once, then their second rows and so on, and the pieces are summed the same way; reduceat would go
    through the rows once for each column."""
    pieces = (times + PIECE - 1) // PIECE
    first = np.cumsum(pieces) - pieces
    group = np.repeat(np.arange(len(cuts)), pieces)
    before = PIECE * (np.arange(len(group)) - first[group])
    length = np.minimum(times[group] - before, PIECE).astype(np.int8)
    by = np.argsort(-length, kind="stable")
    begin = (cuts[group] + before)[by]
    longer = len(group) - np.cumsum(np.bincount(length, minlength=PIECE + 1))
    out = g.take(order[begin], axis=0, mode="clip")
    more = np.empty((longer[1], g.shape[1]), g.dtype)
    for k in range(1, PIECE):
        n = longer[k]
        if not n:
            break
        out[:n] += g.take(order[begin[:n] + k], axis=0, out=more[:n], mode="clip")
    place = np.empty_like(by)
    place[by] = np.arange(len(by))
    return out.take(place, axis=0, mode="clip") if len(group) == len(cuts) else group_sums(out, place, first, pieces)


class Learner:
    """Local gradient steps (per-weight rates after Adagrad) from given weights."""

    def __init__(self, classes: np.ndarray, inside: np.ndarray, rate: float):
        self.tables = [(classes.copy(), np.ones_like(classes), np.zeros(len(classes), np.float32)), (inside.copy(), np.ones_like(inside), np.zeros(len(inside), np.float32))]
        self.rate = rate

    def step(self, k: int, features: list[np.ndarray], bias: int | None, gold: np.ndarray) -> None:
        w, squares, met = self.tables[k]
        g = np.empty((len(gold), w.shape[1]), w.dtype)
        for at in range(0, len(gold), SCORED_AT_ONCE):
            _, e, total = log_softmax(w, [f[at : at + SCORED_AT_ONCE] for f in features], bias)
            np.divide(e, total[:, None], out=g[at : at + SCORED_AT_ONCE])
        g[np.arange(len(gold)), gold] -= 1
        for f in features:
            order = stable_order(f)
            found = f[order]
            cuts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            times = np.diff(cuts, append=len(found))
            self.update(w, squares, met, found[cuts], group_sums(g, order, cuts, times), times)
        if bias is not None:
            self.update(w, squares, met, np.array([bias]), g.sum(axis=0)[None], np.array([len(gold)]))

    def update(self, w, squares, met, rows, slope, times) -> None:
        seen = squares.take(rows, axis=0, mode="clip")
        more = slope * slope
        seen += more
        squares[rows] = seen
        slope *= self.rate
        slope /= np.sqrt(seen, out=seen)
        w[rows] = np.subtract(w.take(rows, axis=0, out=more, mode="clip"), slope, out=more)
        met[rows] += times

    def learn(self, docs: list[np.ndarray]) -> None:
        rows = len(self.tables[0][0]) - PAIR_ROW - 1
        all_s, all_1, all_2, all_3 = history(docs)
        for at in range(0, len(all_s), BATCH):
            s, p1, p2, p3 = (x[at : at + BATCH] for x in (all_s, all_1, all_2, all_3))
            top = s < HEAD
            self.step(0, class_features(p1, p2, p3, rows), PAIR_ROW + rows, np.where(top, s // WIDTH, s - HEAD + TOPS))
            if top.any():
                c = s[top] // WIDTH
                self.step(1, word_features(p1[top], p2[top], c, rows), None, s[top] % WIDTH)


BLOCK = 1024


def _symbols(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint16).astype(np.int64)


def _learn(weights: tuple[np.ndarray, np.ndarray], rate: float):
    """The weights of one learner times how often it met them, in blocks; blocks that it never met are left out."""

    def run(key: tuple[pa.Scalar], texts: pa.Table) -> pa.Table:
        learner, some, held = Learner(*weights, rate), [], 0
        for x in texts.sort_by([("order", "ascending"), ("symbols", "ascending")]).column("symbols").to_pylist():
            some.append(_symbols(x))
            held += len(some[-1])
            if held >= 4 * BATCH:
                learner.learn(some)
                some, held = [], 0
        if some:
            learner.learn(some)
        out = []
        for k, (w, _, met) in enumerate(learner.tables):
            for at in range(0, len(w), BLOCK):
                if (m := met[at : at + BLOCK]).any():
                    rows = np.flatnonzero(m)
                    out.append((k * 1000 + at // BLOCK, key[0].as_py(), rows.astype(np.uint16).tobytes(), (w[at : at + BLOCK][rows] * m[rows, None]).tobytes(), m[rows].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), LEARNT_TYPES, strict=True)], LEARNT_NAMES)

    return run


LEARNT = "block int, part int, rows binary, w binary, met binary"
LEARNT_NAMES, LEARNT_TYPES = ["block", "part", "rows", "w", "met"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _summed(found: pa.Table) -> pa.Table:
    """One block from several learners, in the order of those."""
    w, met = np.zeros((BLOCK, 0)), np.zeros(BLOCK)
    for r in found.sort_by("part").to_pylist():
        rows = np.frombuffer(r["rows"], np.uint16)
        more = np.frombuffer(r["w"], np.float32).reshape(len(rows), -1)
        if not w.shape[1]:
            w = np.zeros((BLOCK, more.shape[1]))
        w[rows] += more
        met[rows] += np.frombuffer(r["met"], np.float32)
    rows = np.flatnonzero(met)
    sums = [rows.astype(np.uint16).tobytes(), w[rows].astype(np.float32).tobytes(), met[rows].astype(np.float32).tobytes()]
    return pa.table([found.column("block").slice(0, 1), found.column("part").slice(0, 1), *(pa.array([x], pa.binary()) for x in sums)], LEARNT_NAMES)


def average(found: DataFrame, groups: int, weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights by feature, averaged over learners in two levels of sums; features that none met keep theirs."""
    summed = found.groupBy("block", F.pmod("part", F.lit(groups)).alias("g")).applyInArrow(_summed, LEARNT).groupBy("block").applyInArrow(_summed, LEARNT)
    out = [w.copy() for w in weights]
    for r in summed.toArrow().to_pylist():
        w = out[r["block"] // 1000][r["block"] % 1000 * BLOCK :][:BLOCK]
        met = np.frombuffer(r["met"], np.float32)
        w[np.frombuffer(r["rows"], np.uint16)] = np.frombuffer(r["w"], np.float32).reshape(len(met), -1) / met[:, None]
    return out[0], out[1]


def train(encoded: DataFrame, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """encoded needs order and symbols, of training texts; every text is read once, in the round that its hash says."""
    rows = hashed_rows(v.tokens)
    weights = start_weights(v, rows)
    draw, low = F.pmod(F.col("order"), F.lit(1000)), 0.0
    for k, share in enumerate(ROUNDS):
        part = encoded.filter((draw >= int(round(1000 * low))) & (draw < int(round(1000 * (low + share)))))
        learners = max(1, round(share * v.tokens / (TOKENS_PER_ROW * rows)))
        dealt = part.groupBy(F.pmod(F.xxhash64("order", F.lit(k)), F.lit(learners)).cast("int").alias("learner"))
        found = dealt.applyInArrow(_learn(weights, RATE / (k + 1)), LEARNT)
        weights = average(found, max(1, math.isqrt(learners)), weights)
        low += share
    return weights


# Scores


def token_logs(weights: tuple[np.ndarray, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """log10 of P(class) for each token, times P(token | class) for head tokens."""
    rows = len(weights[0]) - PAIR_ROW - 1
    all_s, all_1, all_2, all_3 = history(docs)
    out = np.empty(len(all_s))
    for at in range(0, len(all_s), SCORED_AT_ONCE):
        s, p1, p2, p3 = (x[at : at + SCORED_AT_ONCE] for x in (all_s, all_1, all_2, all_3))
        top = s < HEAD
        z, _, total = log_softmax(weights[0], class_features(p1, p2, p3, rows), PAIR_ROW + rows)
        logs = (z[np.arange(len(s)), np.where(top, s // WIDTH, s - HEAD + TOPS)] - np.log(total)).astype(np.float64)
        if top.any():
            z, _, total = log_softmax(weights[1], word_features(p1[top], p2[top], s[top] // WIDTH, rows), None)
            logs[top] += z[np.arange(len(z)), s[top] % WIDTH] - np.log(total)
        out[at : at + SCORED_AT_ONCE] = logs
    return out * LOG10


ENCODED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, head_base double, tail_score double, symbols binary, words array<binary>, times array<int>"
#: Tokens of a text, or of many short ones, whose history is laid out at a time.
LAID_OUT = 1 << 20


def _encode(lexicon: Lexicon):
    """Everything about a text that needs its words: counts, base score, the part of the score inside tail classes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            words, times = words_of(batch.column(2))
            coded = words.dictionary_encode()
            code, text = coded.indices.to_numpy(), np.repeat(np.arange(n), times)
            ranks = lexicon.ranks(coded.dictionary)[code]
            flat = np.zeros(len(words) + n, np.int64)  # the end token has rank 0
            flat[np.arange(len(words)) + text] = ranks
            cuts = np.cumsum(times + 1) - times - 1
            off = np.flatnonzero(ranks < 0)
            rare, repeats = np.unique(text[off] * len(coded.dictionary) + code[off], return_counts=True)
            rare_text, rare_code = np.divmod(rare, max(1, len(coded.dictionary)))
            lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rare_text, minlength=n))]), pa.int32())
            known = flat >= 0
            base = np.where(known, lexicon.log_counts[np.maximum(flat, 0)], 0.0)
            symbols = lexicon.symbol[flat]
            inside = np.where(symbols >= HEAD, base - lexicon.log_tail[np.maximum(symbols - HEAD, 0)], 0.0)
            sums = lambda x: np.add.reduceat(x, cuts)
            bounds = np.append(2 * cuts, 2 * len(flat)).astype(np.int32)
            columns = [
                pa.array(np.arange(uid, uid + n)), batch.column(0), batch.column(1), pa.array(times + 1),
                pa.array(sums((known & lexicon.known[np.maximum(flat, 0)]).astype(np.int64))), pa.array(sums(base)), pa.array(sums(inside)),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(symbols.astype(np.uint16))]),
                pa.ListArray.from_arrays(lists, coded.dictionary.take(pa.array(rare_code))), pa.ListArray.from_arrays(lists, pa.array(repeats, pa.int32())),
            ]
            uid += n
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ENCODED.split(", ")])

    return run


def _scores(weights: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [_symbols(x) for x in batch.column(1).to_pylist()]
            out, at = [], 0
            while at < len(docs):
                till, held = at, 0
                while till < len(docs) and (till == at or held + len(docs[till]) <= LAID_OUT):
                    held += len(docs[till])
                    till += 1
                logs = token_logs(weights, docs[at:till])
                out.append(np.add.reduceat(logs, np.cumsum([0] + [len(d) for d in docs[at : till - 1]])))
                at = till
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["uid", "score"])

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, held_out. Learns from the rows that aren't held out and scores all:
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    counts = materialize(word_counts(docs.filter("NOT held_out")), "lm-counts")
    v = Vocabulary(counts)
    lexicon = Lexicon(v)
    encoded = materialize(docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("binary")).mapInArrow(_encode(lexicon), ENCODED), "lm-encoded")
    weights = train(encoded.filter("NOT held_out").select(F.xxhash64("doc_id", "symbols").alias("order"), "symbols"), v)
    model = encoded.select("uid", "symbols").mapInArrow(_scores(weights), "uid long, score double")
    rare = encoded.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(v.rest, "word").groupBy("uid").agg(F.sum("times").alias("found"), F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("logs"))
    n_rare = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
    out = encoded.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "head_base", "tail_score", n_rare.alias("rare")).join(model, "uid").join(found, "uid", "left")
    known = F.coalesce("found", F.lit(0))
    logs = F.coalesce("logs", F.lit(0.0)) + (F.col("rare") - known) * math.log10(0.5)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + logs - F.col("n_tokens") * math.log10(v.tokens + 0.5 * (v.types + 1))).alias("base_score"), (F.col("score") + F.col("tail_score") + logs).alias("score"),
    )


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder5(F.col("doc_id")) == 1).alias("held_out"))
    return score_texts(docs)
