"""Toxicity by a linear-chain conditional random field.

Tokens of a bounded sample of labelled documents are labelled first: a token is toxic if its document is and one of its
features (the word or a prefix) is much commoner in toxic documents than in others. A two-state chain with feature and
transition weights is fitted to windows of these tokens by penalised likelihood. Scoring runs forward-backward over
every whole text; the marginals give the offending spans, and their mass, peak and share give the document's score
through a logistic calibration on the same sample.

Documents whose crc32(id) mod 4 is 2 are held out: their labels are never read. Scores use the text alone.

Defined results: null and empty texts have no token and get the calibrated score of that. Null labels and labels
without a document are ignored; repeated labels of an id count as toxic if one is. Without any usable label of both
kinds, every score is 0. Repeated rows are scored alike. An empty table gives an empty result. Further columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import CACHE_WORDS, bounded_batches, schemas, text_chunks
from terrane.llm.suffix_arrays import split_words
from terrane.session import cut

THRESHOLD = 0.3
#: Labelled rows of a fit at most; each is fitted on with its whole text.
FIT_ROWS = 6000
#: Log odds and documents from which on a feature marks tokens of toxic documents.
MARK_ODDS, MARK_DOCS = 3.5, 5
#: Tokens on either side of a toxic one that are fitted on, and as many windows again from elsewhere.
REACH, STEPS = 8, 90
TOKEN = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def features(word: bytes) -> list[str]:
    w = word.decode(errors="replace").lower()
    return ["=" + w, *("^" + w[:n] for n in (3, 4, 5, 6) if len(w) >= n)]


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t]) from x[-1] = 1, many stretches of t at a time."""
    n = len(a)
    if not n:
        return np.zeros(0)
    steps = max(1, int(n**0.5))
    rows = -(-n // steps)
    pad = rows * steps - n
    a, b, c, d = (np.ascontiguousarray(np.append(v, np.full(pad, fill)).reshape(rows, steps).T) for v, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    p, q, r, s = (np.full(rows, v) for v in (1.0, 0.0, 0.0, 1.0))
    for t in range(steps):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        norm = 1 / (p + q + r + s)
        p, q, r, s = p * norm, q * norm, r * norm, s * norm
    x, starts = 1.0, np.empty(rows)
    for i, (pi, qi, ri, si) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        starts[i] = x
        x = min(max((pi * x + qi) / (ri * x + si), 1e-30), 1e30)
    out, x = np.empty((steps, rows)), starts
    for t in range(steps):
        x = (a[t] * x + b[t]) / (c[t] * x + d[t])
        out[t] = x
    return out.T.ravel()[:n]


@dataclass
class Crf:
    """Feature weights are log odds of toxic against clean; `chain` holds log transition weights and the start's."""

    weights: dict[str, float]
    bias: float
    chain: np.ndarray  # clean-clean, clean-toxic, toxic-clean, toxic-toxic, start of toxic
    calibration: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0, 0, 0]))

    def emission(self, word: bytes) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def marginals(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The probability that each token is toxic; e are emissions, of documents of these lengths one after another."""
        ends = np.cumsum(lengths)
        first, last = (ends - lengths)[lengths > 0], ends[lengths > 0] - 1
        cc, ct, tc, tt, start = np.exp(self.chain)
        odds = np.exp(np.clip(e, -30, 30))
        a, b, c, d = odds * tt, odds * ct, np.full(len(e), tc), np.full(len(e), cc)
        a[first], b[first], c[first], d[first] = 0, odds[first] * start, 0, 1
        forward = scan(a, b, c, d)
        after = np.append(odds[1:], 1.0)
        a, b, c, d = after * tt, np.full(len(e), tc), after * ct, np.full(len(e), cc)
        a[last], b[last], c[last], d[last] = 0, 1, 0, 1
        backward = scan(a[::-1], b[::-1], c[::-1], d[::-1])[::-1]
        both = forward * backward
        return both / (1 + both)


def aggregates(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each document: one, the log mass of likely tokens, the peak and the share."""
    ends = np.cumsum(lengths)
    full, first = lengths > 0, (ends - lengths)[lengths > 0]
    mass, peak = np.zeros(len(lengths)), np.zeros(len(lengths))
    if len(first):
        mass[full] = np.add.reduceat(np.where(p >= 0.1, p, 0), first)
        peak[full] = np.maximum.reduceat(p, first)
    return np.stack([np.ones(len(lengths)), np.log1p(mass), peak, mass / np.maximum(lengths, 1) * 10], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
    return w


def fit_chain(windows: list[list[int]], gold: list[list[int]], owned: list[np.ndarray], n_features: int, penalty: float = 0.5) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient ascent (Adam) on the penalised likelihood of windows of word numbers; owned: each word's features."""
    size = max(map(len, windows))
    word = np.array([w + [-1] * (size - len(w)) for w in windows])
    y = np.array([g + [0] * (size - len(g)) for g in gold])
    mask = word >= 0
    counts = np.array([len(o) for o in owned])
    flat, owner = np.concatenate(owned), np.repeat(np.arange(len(owned)), counts)
    theta = np.zeros(n_features + 6)  # weights, bias, chain
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    theta[n_features] = -1.0
    rows = np.arange(len(word))
    for step in range(1, STEPS + 1):
        emit = np.bincount(owner, theta[flat], minlength=len(owned)) + theta[n_features]
        e = np.where(mask, emit[word], 0.0)
        chain = theta[n_features + 1 :]
        log_a = chain[:4].reshape(2, 2)
        alpha, beta = np.zeros((size, len(word), 2)), np.zeros((size, len(word), 2))
        alpha[0] = np.stack([np.zeros(len(word)), e[:, 0] + chain[4]], axis=1)
        for t in range(1, size):
            nxt = np.logaddexp(alpha[t - 1][:, :1] + log_a[0], alpha[t - 1][:, 1:] + log_a[1])
            nxt[:, 1] += e[:, t]
            alpha[t] = np.where(mask[:, t, None], nxt, alpha[t - 1])
        total = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        pair = np.zeros((2, 2))
        seen = np.zeros((2, 2))
        for t in range(size - 2, -1, -1):
            ahead = beta[t + 1] + np.stack([np.zeros(len(word)), e[:, t + 1]], axis=1)
            joint = alpha[t][:, :, None] + log_a[None] + ahead[:, None, :] - total[:, None, None]
            own = mask[:, t + 1]
            pair += np.exp(joint[own]).sum(axis=0)
            np.add.at(seen, (y[own, t], y[own, t + 1]), 1)
            back = np.logaddexp(log_a[:, 0] + ahead[:, :1], log_a[:, 1] + ahead[:, 1:])
            beta[t] = np.where(own[:, None], back, 0.0)
        p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total).T
        gap = np.where(mask, y - p, 0.0)
        by_word = np.bincount(word[mask], gap[mask], minlength=len(owned))
        grad = np.zeros_like(theta)
        grad[:n_features] = np.bincount(flat, by_word[owner], minlength=n_features)
        grad[n_features] = gap.sum()
        grad[n_features + 1 : n_features + 5] = (seen - pair).ravel()
        grad[n_features + 5] = gap[rows, 0].sum()
        grad -= penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1 :]


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice of labelled texts: how many of each label hold each feature."""
    for batch, texts in text_chunks(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(texts, batch.column(batch.schema.get_field_index("label")).to_pylist(), strict=True):
            counts[label].update({f for w in set(split_words(text)) for f in features(w)})
        names = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)], names=["feature", "clean", "toxic"])


def window_rows(marks: frozenset[str], schema: pa.Schema):
    """Windows of the whole texts around all marked words of toxic ones, and two others of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
            found: list[list[dict]] = []
            for text, label in zip(texts, labels, strict=True):
                words = split_words(text)
                known = {w: any(f in marks for f in features(w)) for w in set(words)} if label else {}
                rng = np.random.default_rng(crc32(text))
                at = [i for i, w in enumerate(words) if known.get(w)] + (rng.integers(0, len(words), 2).tolist() if words else [])
                own = [words[max(0, i - REACH) : i + REACH + 1] for i in at]
                found.append([{"words": w, "gold": [int(known.get(x, False)) for x in w]} for w in own])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(found, schema.field("windows").type)], schema=schema)

    return run


def aggregate_rows(crf: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(crf)
        for batch, texts in text_chunks(batches):
            _, lengths, p = token_marginals(crf, emissions, texts)
            x = aggregates(p, lengths)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("label")), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "label", "x"])

    return run


def fit_weights(windows: list[list[bytes]], gold: list[list[int]], marks: frozenset[str]) -> Crf:
    """The chain on windows of words; features of one fitted word alone count only if they are marks."""
    words = sorted({w for window in windows for w in window})
    number = {w: i for i, w in enumerate(words)}
    held = Counter(f for w in words for f in features(w))
    known = {f: i for i, f in enumerate(sorted(f for f, n in held.items() if n >= 2 or f in marks))}
    if not known:
        return Crf({}, -30.0, np.zeros(5))
    owned = [np.array([known[f] for f in features(w) if f in known], dtype=np.int64) for w in words]
    weights, bias, chain = fit_chain([[number[w] for w in window] for window in windows], gold, owned, len(known))
    return Crf({f: float(weights[i]) for f, i in known.items() if abs(weights[i]) > 1e-3}, bias, chain)


class Emissions(dict):
    def __init__(self, crf: Crf):
        self.crf = crf

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = self.crf.emission(word)
        return value


def token_marginals(crf: Crf, emissions: Emissions, texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    docs = [split_words(t) for t in texts]
    lengths = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    e = np.fromiter((x for d in docs for x in map(emissions.__getitem__, d)), dtype=np.float64, count=int(lengths.sum()))
    return docs, lengths, crf.marginals(e, lengths)


def scored_rows(crf: Crf, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(crf)
        for batch, texts in text_chunks(batches):
            docs, lengths, p = token_marginals(crf, emissions, texts)
            score = sigmoid(aggregates(p, lengths) @ crf.calibration)
            spans: list[list[dict]] = [[] for _ in docs]
            first = np.cumsum(lengths) - lengths
            for d in np.unique(np.searchsorted(first, np.flatnonzero(p >= 0.5), "right") - 1).tolist():
                own = p[first[d] : first[d] + lengths[d]]
                places = [m.span() for m in TOKEN.finditer(texts[d].decode())]
                spans[d] = [{"start": places[i][0], "end": places[i][1], "p": float(own[i])} for i in np.flatnonzero(own >= 0.5).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(score, pa.float64()), pa.array(spans, schema.field("spans").type)], schema=schema)

    return run


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Crf:
    """A model of at most `rows` labelled documents that are not held out, the same ones on every run; of an id with
    several texts, the smallest. Whole texts stay with the tasks: the driver gets marked features, windows and four
    numbers for each document."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # the bound also bounds what is broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = cut(texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "labelled")
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return Crf({}, -30.0, np.zeros(5))
    held = sample.select("text", "label").mapInArrow(feature_rows, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.ln((F.col("toxic") + 0.5) / (n[1] + 1)) - F.ln((F.col("clean") + 0.5) / (n[0] + 1))
    need, most = min(MARK_DOCS, max(2, n[1] // 10)), min(MARK_ODDS, float(np.log(n[0] + 1)) - 0.5)
    marks = frozenset(r.feature for r in held.where((F.col("toxic") >= need) & (odds >= most)).collect())
    spark_schema, arrow = schemas({"id": sample.schema["id"].dataType, "windows": "array<struct<words:array<binary>,gold:array<int>>>"})
    made = sample.mapInArrow(window_rows(marks, arrow), spark_schema).collect()
    windows = [w for r in sorted(made, key=lambda r: str(r.id)) for w in r.windows]
    if not windows:
        return Crf({}, -30.0, np.zeros(5))
    crf = fit_weights([[bytes(x) for x in w["words"]] for w in windows], [list(w["gold"]) for w in windows], marks)
    spark_schema, _ = schemas({"id": sample.schema["id"].dataType, "label": "int", "x": "array<double>"})
    got = sorted(sample.mapInArrow(aggregate_rows(crf), spark_schema).collect(), key=lambda r: str(r.id))
    crf.calibration = logistic(np.array([r.x for r in got]), np.array([r.label for r in got]))
    return crf


def score(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans): spans are the tokens, in code points, that are toxic with a probability of a half or more."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark_schema, arrow = schemas({"id": source.schema["id"].dataType, "score": "double", "spans": "array<struct<start:long,end:long,p:double>>"})
    return source.mapInArrow(scored_rows(crf, arrow), spark_schema).withColumnRenamed("id", id_col)


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold."""
    crf = fit(docs, labels, id_col, text_col)
    whole = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return score(whole, crf, "row", "text").where(F.col("score") < THRESHOLD).select("row.*")
