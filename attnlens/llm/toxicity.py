"""Toxicity by weak supervision.

1. From a bounded sample of labelled training rows (at most ``max_rows`` of each label, picked by a hash), words and word
   starts that toxic rows hold far more often are mined and dealt into lexicon voters; pattern voters look at
   exclamation marks, capitals and repetition.
2. A generative label model estimates, by EM over a hidden label and starting from the voters' rates on the sample, how
   often each voter fires under either label, and from the residuals of the fit the correlations between voters; a voter's log
   odds count 1 / (1 + the sum of its positive correlations), so many copies of one signal weigh as one.
3. A logistic regression on hit counts is trained on the posterior labels and scores every whole text.

Fitting runs in one task over that bounded sample; scoring is a map over all documents without a shuffle.  Held-out
rows (``crc32(doc_id) mod 3 = 1``) take no part in 1 to 3, and neither labels, lang, source nor doc_id enter a score.

Bounds of the fit: ``max_rows`` labelled rows of each label, one row an id (its smallest text; toxic if any of its labels says so), and FEATURES mined
features of each kind, strong and weak, the ones with the largest count x log ratio.

Defined cases: a null or empty text has no hits and gets the score of such a text; a null id is not held out; labels with null flags or null ids are left
out; with no labelled row of one kind the score is 0.5 for all; repeated rows get equal scores; an empty table gives no rows;
all columns travel in the struct ``row``.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attnlens.llm.common import alnum_words, lean, sliced

MAX_ROWS = 5_000
STARTS = (3, 4, 5, 6)
FEATURES = 3_000
VOTERS, STRONG = 24, 12
MIN_ROWS = 6
#: log of the least ratio between a feature's frequency in toxic and other rows
MIN_RATIO = np.log(30.0)
CUT = 0.7
#: Words whose features a task keeps.
CACHE = 200_000


def held_out(doc_id: Column, modulus: int = 3, remainder: int = 1) -> Column:
    """True for the held-out rows; a null id is not one."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def _features(word: bytes) -> list[bytes]:
    """The word itself and its starts, marked by a star."""
    chars = word.decode("utf-8", "surrogatepass")
    return [word, *(chars[:k].encode("utf-8", "surrogatepass") + b"*" for k in STARTS if len(chars) > k)]


def _patterns(text: str, words: list[bytes], distinct: int) -> list[float]:
    n = max(1, len(text))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [text.count("!") / n, upper / n, 1 - distinct / max(1, len(words)), np.log1p(len(words)) / 10]


@dataclass
class Model:
    lexicon: dict[bytes, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.known: dict[bytes, tuple[tuple[bytes, int], ...]] = {}

    def counts(self, text: str | None) -> np.ndarray:
        """Distinct hits per voter, then the patterns."""
        words = alnum_words(text)
        distinct = set(words)
        out = np.zeros(VOTERS + 4)
        hits = set()
        for word in distinct:
            found = self.known.get(word)
            if found is None:
                if len(self.known) > CACHE:
                    self.known.clear()
                found = self.known[word] = tuple((f, v) for f in _features(word) if (v := self.lexicon.get(f)) is not None)
            if found:
                hits.update(found)
        for _, voter in hits:
            out[voter] += 1
        out[VOTERS:] = _patterns(text or "", words, len(distinct))
        return out

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        x = np.array([self.counts(t) for t in texts]).reshape(-1, VOTERS + 4)
        return _sigmoid((_design(x) - self.mean) / self.scale @ self.weights + self.bias)


def _design(counts: np.ndarray) -> np.ndarray:
    hits = counts[:, :VOTERS]
    strong, weak = hits[:, :STRONG].sum(1, keepdims=True), hits[:, STRONG:].sum(1, keepdims=True)
    return np.concatenate([np.log1p(hits), np.log1p(strong), strong > 0, np.log1p(weak), weak > 0, counts[:, VOTERS:]], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def mine(rows: list[tuple[str | None, int]]) -> dict[bytes, int]:
    """Features of toxic rows and the voter of each.  Features that no clean row has go to the first STRONG voters."""
    features = lambda text: {f for w in set(alnum_words(text)) for f in _features(w)}
    toxic: Counter[bytes] = Counter()
    for text, label in rows:
        if label:
            toxic.update(features(text))
    toxic = Counter({f: n for f, n in toxic.items() if n >= MIN_ROWS})
    # most features of other rows are rare ones that no toxic row has: they are not counted
    clean: Counter[bytes] = Counter()
    for text, label in rows:
        if not label:
            clean.update(features(text) & toxic.keys())
    n_toxic = sum(label for _, label in rows)
    strong, weak = [], []
    for f, n in toxic.items():
        ratio = np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean[f] + 0.5) / (len(rows) - n_toxic + 1))
        if ratio >= MIN_RATIO:
            (weak if clean[f] or n < 2 * MIN_ROWS else strong).append((-n * ratio, f))
    out = {f: k % STRONG for k, (_, f) in enumerate(sorted(strong)[:FEATURES])}
    return out | {f: STRONG + k % (VOTERS - STRONG) for k, (_, f) in enumerate(sorted(weak)[:FEATURES])}


def label_model(fired: np.ndarray, start: np.ndarray, prior: float, rounds: int = 50, trust: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label, rates [label, voter] and the voters' weights.  ``start``: the rates to begin with, which
    also count as ``trust`` times as many rows as there are."""
    n, rates, weights = len(fired), start, np.ones(fired.shape[1])
    post = np.zeros(n)
    for step in range(rounds):
        odds = np.log(prior / (1 - prior)) + (fired * np.log(rates[1] / rates[0]) + (1 - fired) * np.log((1 - rates[1]) / (1 - rates[0]))) @ weights
        new = _sigmoid(odds)
        done = np.abs(new - post).max() < 1e-6
        post = new
        if step >= 2 and done:
            break
        mass = np.array([(1 - post).sum(), post.sum()])[:, None]
        extra = trust * n * np.array([[1 - prior], [prior]])
        rates = (np.stack([(1 - post) @ fired, post @ fired]) + extra * start) / (mass + extra)
        rest = fired - (post[:, None] * rates[1] + (1 - post)[:, None] * rates[0])  # what the label does not explain
        cov = rest.T @ rest / n
        sd = np.sqrt(np.diag(cov)) + 1e-9
        corr = np.clip(cov / np.outer(sd, sd), 0, 1)
        corr[corr < 0.05] = 0
        weights = 1 / corr.sum(1).clip(1)
    return post, rates, weights


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """A model from (text, label) rows."""
    lexicon = mine(rows)
    empty = Model(lexicon, np.zeros(1), np.ones(1), np.zeros(1), 0.0)
    counts = np.array([empty.counts(t) for t, _ in rows])
    labels = np.array([y for _, y in rows])
    clean = counts[labels == 0]
    limits = np.quantile(clean[:, VOTERS:], 0.99, axis=0) if len(clean) else np.ones(4)
    hits = counts[:, :VOTERS]
    fired = np.concatenate([hits > 0, hits.sum(1, keepdims=True) >= 2, hits.sum(1, keepdims=True) >= 4, counts[:, VOTERS:] > limits], 1).astype(float)
    start = np.stack([(fired[labels == k].sum(0) + 0.5) / ((labels == k).sum() + 1) for k in (0, 1)])
    post, _, _ = label_model(fired, start, float(np.clip(labels.mean(), 0.01, 0.99)))
    x = _design(counts)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps with a small ridge
        p = _sigmoid(z @ w)
        ridge = np.r_[np.full(len(w) - 1, 1.0), 1e-6]
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (post - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(lexicon, mean, scale, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """The model of the labelled rows outside the held-out third."""
    use = (labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("label").alias("label")))
    n = {r["label"]: r["n"] for r in use.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    rate = F.when(F.col("label") == 1, min(1.0, max_rows / n[1])).otherwise(min(1.0, max_rows / n[0]))
    # at most about 2 x max_rows ids are broadcast
    picked = F.broadcast(use.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000))
    # of rows that repeat an id one counts, so ids bound the rows
    sample = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t, y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True) if t is not None)
        if {y for _, _, y in rows} == {0, 1}:
            model = fit(sorted({(t, y) for _, t, y in rows}))  # a text counts once, however many copies it has
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.lexicon, model.mean, model.scale, model.weights, model.bias))], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(lean(run), "model binary").collect()
    return Model(*pickle.loads(found[0]["model"])) if found else None


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``row`` (all of ``docs``) and ``score``."""
    model = train(docs, labels, max_rows)
    rows = docs.select(F.struct("*").alias("row"))
    if model is None:
        return rows.withColumn("score", F.lit(0.5))
    state = (model.lexicon, model.mean, model.scale, model.weights, model.bias)
    sent = docs.sparkSession.sparkContext.broadcast(state)  # at most FEATURES entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            texts = sliced(pa.compute.struct_field(batch.column(0), "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(texts), pa.float64())], ["row", "score"])

    return rows.mapInArrow(lean(run), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
