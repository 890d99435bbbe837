"""Language-model scores by a gated recurrent network in numpy.

Counts.  Words of all training texts are counted by Spark; the table of counts grows with the corpus and is joined, never
broadcast.  The most frequent words, at most TOP, are broadcast with their counts; the count they need follows from a table of counts of counts.

Model.  The output softmax has two levels: P(word) = P(class | state) P(word | class, state).  The FREQUENT most frequent
tokens (the end of a text is one) form classes of WIDTH by rank, with a softmax each.  All other words fall into classes by
their spelling (last character, length, non-ASCII letters), where P(word | class) = (c + 1) / (N_class + V_class + 1): every string has a
probability.  The state is a gated recurrent unit's; it starts at zero with each text and is carried from window to
window to the text's end, so a score is the whole text's.

Training.  Truncated backpropagation through time over windows of STEPS tokens, Adam, in ``shards`` tasks at once; after each
round the shards' weights are averaged by their tokens, in a tree of sums of FAN.  All training texts are learned from: each is in one
shard of one round, and there is a shard for every SHARD_TOKENS tokens of a round.  A shard makes at least one whole pass over
its texts: a longer one has more streams, a short one more passes, up to ROUND_STEPS windows.  A shard beyond 2 SHARD_TOKENS (one row many
times over) is learned from piece by piece.

Defined cases: a null or empty text is its end alone; repeated rows get equal scores; an empty training set leaves the untrained
model and counts of zero; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attnlens.llm.common import cut, sliced

WIDTH, FREQUENT_CLASSES, SPELLING_CLASSES = 32, 32, 64
FREQUENT = WIDTH * FREQUENT_CLASSES
CLASSES = FREQUENT_CLASSES + SPELLING_CLASSES + 1
START = FREQUENT + SPELLING_CLASSES + 1
TOP = 200_000
HIDDEN = 24
STEPS, STREAMS, ROUND_STEPS, ROUNDS = 32, 64, 80, 2
#: Tokens of a shard, and weights added up in one place.
SHARD_TOKENS, FAN = 500_000, 32
#: Tokens that a task scores together.
BUFFER = 4_000_000
END = b" "


def spelling(word: bytes) -> str:
    """The spelling class: last character, three lengths, any non-ASCII letter."""
    text = word.decode("utf-8", "surrogatepass")
    return f"{chr(min(ord(text[-1]), 0x250))}{0 if len(text) < 5 else 1 if len(text) < 9 else 2}{int(len(word) != len(text))}"


def named(spelled: str) -> str:
    """The name in ``spelling`` of a value of ``spelled_as``."""
    last, rest = spelled.split(" ")
    return chr(int(last)) + rest


# -- the network ------------------------------------------------------------------------------------------------------

Weights = dict[str, np.ndarray]


def fresh(seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    new = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    return {"x": new(START + 1, 3 * h, s=0.1), "u": new(h, 3 * h, s=h ** -0.5), "c": new(h, CLASSES, s=0.05), "cb": np.zeros(CLASSES, np.float32),
            "w": new(FREQUENT_CLASSES, h, WIDTH, s=0.05), "wb": np.zeros((FREQUENT_CLASSES, WIDTH), np.float32)}


def _apart(a: np.ndarray) -> np.ndarray:
    """Rows of three gates as [gate, row, unit]; update and reset are negated, as their exponentials are taken."""
    a = np.ascontiguousarray(a.reshape(len(a), 3, HIDDEN).swapaxes(0, 1))
    a[:2] *= -1
    return a


def _step(g: np.ndarray, u: np.ndarray, h: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The next state in ``out``, and what the candidate has of the state; inputs ``g`` of ``_apart`` become update, reset and candidate."""
    hu = h @ u
    gates, c = g[:2], g[2]
    gates += hu[:2]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[1], hu[2], out=out)
    c += out
    np.tanh(c, out=c)
    np.subtract(h, c, out=out)
    out *= gates[0]
    out += c
    return hu[2]


def _calm(weights: np.ndarray, bias: np.ndarray) -> bool:
    """True if exponentials of the logits of all states (units within -1 and 1) stay far from float32's ends."""
    return float((np.abs(weights).sum(-2) + np.abs(bias)).max()) < 60


def _class_of(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < FREQUENT, symbols // WIDTH, symbols - FREQUENT + FREQUENT_CLASSES)


def _log_chosen(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray, calm: bool) -> np.ndarray:
    """Log of the softmax at one place of each row."""
    out, ones = np.empty(len(rows), np.float32), np.ones(len(bias), np.float32)
    for k in range(0, len(rows), 2048):
        logit = rows[k : k + 2048] @ weights
        logit += bias
        if not calm:
            logit -= logit.max(1, keepdims=True)
        chosen = logit[np.arange(len(logit)), at[k : k + 2048]]
        np.exp(logit, out=logit)
        out[k : k + 2048] = chosen - np.log(logit @ ones)
    return out


def log_probs(w: Weights, h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Natural log of P(class) and, for frequent tokens, P(token | class), of each state's next symbol."""
    cls = _class_of(symbols)
    out = _log_chosen(h, w["c"], w["cb"], cls, _calm(w["c"], w["cb"])).astype(np.float64)
    order, ends = _by_class(cls)
    rows, at, found, calm = h[order], symbols[order] % WIDTH, np.empty(len(order)), _calm(w["w"], w["wb"])
    for c in range(FREQUENT_CLASSES):
        b, e = ends[c], ends[c + 1]
        if e > b:
            found[b:e] = _log_chosen(rows[b:e], w["w"][c], w["wb"][c], at[b:e], calm)
    out[order] += found
    return out


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Places of the frequent tokens, class by class, and where each class begins and ends among them."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    ends = np.searchsorted(cls[order], np.arange(FREQUENT_CLASSES + 1)).tolist()
    return order[: ends[-1]], ends


def text_log_probs(w: Weights, texts: list[np.ndarray], window: int = 256) -> np.ndarray:
    """Natural log-probability of each whole symbol sequence."""
    return flat_log_probs(w, np.concatenate(texts), np.array([len(t) for t in texts]), window)


def flat_log_probs(w: Weights, flat: np.ndarray, lengths: np.ndarray, window: int = 256) -> np.ndarray:
    """Of sequences that lie end to end in ``flat``.  Longest first, so those that still run are the first ones; their states are scored ``window`` x 128 at a time."""
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    running = (len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), side="right")).tolist()
    total = np.zeros(len(lengths))
    inputs, u = _apart(w["x"]), _apart(w["u"])
    h, last = np.zeros((len(lengths), HIDDEN), np.float32), np.full(len(lengths), START)
    states, symbols, held = [], [], 0
    for t, n in enumerate(running):
        g, new, last = np.take(inputs, last[:n], axis=1), np.empty((n, HIDDEN), np.float32), flat[begin[:n] + t]
        _step(g, u, h[:n], new)
        h = new
        states.append(new)
        symbols.append(last)
        held += n
        if held >= window * 128 or t == len(running) - 1:
            lp, at = log_probs(w, np.concatenate(states), np.concatenate(symbols)), 0
            for some in states:
                total[: len(some)] += lp[at : at + len(some)]
                at += len(some)
            states, symbols, held = [], [], 0
    out = np.empty(len(lengths))
    out[order] = total
    return out


def _gradients(w: Weights, x: np.ndarray, y: np.ndarray, h0: np.ndarray) -> tuple[Weights, np.ndarray, float]:
    """Gradients of the mean loss over one window [step, stream], the last state, and the loss."""
    steps, streams, n = *x.shape, HIDDEN
    begins = x == START
    some = begins.any(1).tolist()
    u = _apart(w["u"])
    gates = np.take(_apart(w["x"]), x, axis=1)  # inputs, and after a step its update, reset and candidate: [gate, step, stream, unit]
    before, states, resets = (np.empty((steps, streams, n), np.result_type(h0, w["u"])) for _ in range(3))
    h = h0
    for t in range(steps):
        if some[t]:  # a text begins
            h = np.where(begins[t][:, None], np.float32(0), h)
        before[t] = h
        resets[t] = _step(gates[:, t], u, h, states[t])
        # a state that the next text's start resets is still the one that predicts its end
        h = states[t]
    flat, sym = states.reshape(-1, n), y.ravel()
    cls = _class_of(sym)
    g = {k: np.zeros_like(v) for k, v in w.items()}

    def softmax(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray, calm: bool) -> tuple[np.ndarray, float]:
        """The loss's derivative by the logits, and the loss."""
        d = rows @ weights
        d += bias
        if not calm:
            d -= d.max(1, keepdims=True)
        np.exp(d, out=d)
        d *= (1 / (d @ np.ones(len(bias), d.dtype)))[:, None]
        real = np.arange(len(at))
        loss = -float(np.log(d[real, at] + 1e-30).sum())
        d[real, at] -= 1
        return d, loss

    calm = _calm(w["w"], w["wb"])
    loss, quiet, dh_out = 0.0, _calm(w["c"], w["cb"]), np.empty_like(flat)
    for k in range(0, len(flat), 2048):  # as many as a core's cache holds
        rows = flat[k : k + 2048]
        d, more = softmax(rows, w["c"], w["cb"], cls[k : k + 2048], quiet)
        loss += more
        g["c"] += rows.T @ d
        g["cb"] += np.ones(len(d), d.dtype) @ d
        np.matmul(d, w["c"].T, out=dh_out[k : k + 2048])
    order, ends = _by_class(cls)
    rows, at = flat[order], sym[order] % WIDTH
    back = np.empty_like(rows)
    for c in range(FREQUENT_CLASSES):
        b, e = ends[c], ends[c + 1]
        if e > b:
            d, more = softmax(rows[b:e], w["w"][c], w["wb"][c], at[b:e], calm)
            loss += more
            g["w"][c], g["wb"][c] = rows[b:e].T @ d, np.ones(len(d), d.dtype) @ d
            np.matmul(d, w["w"][c].T, out=back[b:e])
    dh_out[order] += back
    dh_out = dh_out.reshape(steps, streams, n)
    z, r, c = gates
    by_c, by_z, by_r = (1 - z) * (1 - c * c), (before - c) * z * (1 - z), resets * r * (1 - r)
    # by the inputs: update, reset, candidate; by what the candidate has of the state
    dg, da = np.empty_like(gates), np.empty_like(before)
    back, parts = np.zeros((streams, n), before.dtype), np.ascontiguousarray(w["u"].reshape(n, 3, n).transpose(1, 2, 0))
    for t in range(steps - 1, -1, -1):
        dh = dh_out[t]
        dh += back
        dz, dr, dc = dg[:, t]
        np.multiply(dh, by_c[t], out=dc)
        np.multiply(dh, by_z[t], out=dz)
        np.multiply(dc, by_r[t], out=dr)
        np.multiply(dc, r[t], out=da[t])
        back = dh * z[t]
        back += dz @ parts[0]
        back += dr @ parts[1]
        back += da[t] @ parts[2]
        if some[t]:
            back[begins[t]] = 0
    first = before.reshape(-1, n).T
    g["u"] = np.concatenate([first @ d.reshape(-1, n) for d in (dg[0], dg[1], da)], 1)
    order = np.argsort(x.astype(np.int16), axis=None, kind="stable")
    seen, first = np.unique(x.ravel()[order], return_index=True)
    g["x"][seen] = np.add.reduceat(np.concatenate([d.reshape(-1, n) for d in dg], 1)[order], first)
    h = h.copy()
    return {k: v / len(sym) for k, v in g.items()}, h, loss / len(sym)


def windows(texts: list[np.ndarray], steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inputs and next symbols [step, stream] of one whole pass over the texts, laid end to end in as many streams, STREAMS at least, as need no more
    than ``steps`` windows.  Every symbol is in a window; the texts' beginning is repeated to fill the last stream."""
    flat = np.concatenate(texts).astype(np.int64)
    first = np.zeros(len(flat), bool)
    first[np.r_[0, np.cumsum([len(t) for t in texts])[:-1]]] = True
    inputs = np.where(first, START, np.r_[START, flat[:-1]])
    streams = max(STREAMS, -(-len(flat) // (STEPS * steps)))
    per = max(STEPS, -(-len(flat) // streams))
    x, y = (np.resize(a, per * streams).reshape(streams, per).T for a in (inputs, flat))
    for at in range(0, per, STEPS):
        yield x[at : at + STEPS], y[at : at + STEPS]


def train(w: Weights, texts: list[np.ndarray], steps: int, rate: float = 0.01) -> tuple[Weights, float]:
    """``steps`` windows of Adam over the texts: at least one whole pass, then again from the start."""
    w = {k: v.copy() for k, v in w.items()}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    step, loss, whole = 0, 0.0, False
    while not whole or step < steps:
        h = None
        for x, y in windows(texts, steps):
            if whole and step == steps:
                break
            step += 1
            g, h, loss = _gradients(w, x, y, np.zeros((x.shape[1], HIDDEN), np.float32) if h is None else h)
            size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            clip = min(1.0, 1.0 / (size + 1e-9))
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * clip * g[k]
                v[k] = 0.99 * v[k] + 0.01 * (clip * g[k]) ** 2
                w[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        whole = True
    return w, loss


# -- the corpus -------------------------------------------------------------------------------------------------------

def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (``common.SPACE_WORD``, as strings), the place of each word of each text among them, and the number of words of each text; null has none."""
    # a copy: Arrow's cast of a slice of a longer array gave bytes that are not its own
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = lists.flatten().dictionary_encode()
    codes, ends = found.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    empty = pc.index(found.dictionary, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:  # Arrow has an empty word before white space at a text's end
        real = codes != empty
        codes, ends = codes[real], np.r_[0, np.cumsum(real)][ends]
    return found.dictionary, codes, np.diff(ends)


#: Rows of texts whose words are found at once.
SLICE = 1024


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, c`` of all words of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for at in range(0, len(batch), SLICE):
                words, codes, _ = words_of(batch.column(0).slice(at, SLICE))
                c = np.bincount(codes, minlength=len(words))
                some = pa.table({"word": words, "c": pa.array(c, pa.int64())})
                held.append(some.filter(pa.array(c > 0)))
            if held:
                all_ = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
                yield from all_.select(["word", "c_sum"]).rename_columns(["word", "c"]).cast(pa.schema([("word", pa.binary()), ("c", pa.int64())])).to_batches(100_000)

    return docs.select(text).mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def spelled_as(word: str = "word") -> Column:
    """``spelling`` of a column of words."""
    text = F.decode(word, "UTF-8")
    last, n = F.ascii(F.substring(text, -1, 1)), F.char_length(text)
    return F.concat(F.least(last, F.lit(0x250)).cast("string"), F.lit(" "), F.when(n < 5, "0").when(n < 9, "1").otherwise("2"), (F.octet_length(word) != n).cast("int").cast("string"))


def most_frequent(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """The words of ``word, c`` above the lowest count that leaves at most ``limit`` of them.

    Counts from 1024 on are told apart by steps of 1 %, so the table of counts of counts has some 4,500 rows at any size."""
    level = F.when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor((F.log2("c") - 10) * 64)).cast("int")
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    taken, least = 0, None
    for at in sorted(sizes, reverse=True):
        taken += sizes[at]
        if taken > limit:
            break
        least = at
    return [] if least is None else [(bytes(r["word"]), r["c"]) for r in counts.where(level >= least).select("word", "c").collect()]


class Symbols:
    """Symbols and counts of the most frequent words, and the spelling classes of all others."""

    def __init__(self, top: list[tuple[bytes, int]], ends: int, spellings: dict[str, tuple[int, int]]) -> None:
        top = sorted([*top, (END, ends)], key=lambda x: (-x[1], x[0]))
        # the end is always a frequent token
        place = [w for w, _ in top].index(END)
        if place >= FREQUENT:
            top.insert(FREQUENT - 1, top.pop(place))
        named = sorted(spellings.items(), key=lambda x: (-x[1][0], x[0]))
        self.class_of = {s: k for k, (s, _) in enumerate(named[:SPELLING_CLASSES])}
        mass = np.zeros((SPELLING_CLASSES + 1, 2))
        for s, (n, v) in named:
            mass[self.class_of.get(s, SPELLING_CLASSES)] += (n, v)
        self.log_mass = np.log10(mass.sum(1) + 1)
        self.index = {w: k for k, (w, _) in enumerate(top)}
        self.count = np.array([c for _, c in top], np.int64)
        self.log_count = np.log10(self.count + 1.0)
        self.symbol = np.array([k if k < FREQUENT else FREQUENT + self.spelled(w) for k, (w, _) in enumerate(top)], np.int32)

    def spelled(self, word: bytes) -> int:
        return self.class_of.get(spelling(word), SPELLING_CLASSES)

    def _spelled(self, words: pa.Array) -> np.ndarray:
        """``spelled`` of an array of strings."""
        last = pc.utf8_slice_codeunits(words, -1).dictionary_encode()
        ends = np.array([min(ord(c or "\0"), 0x250) for c in last.dictionary.to_pylist()], np.int64)[last.indices.to_numpy()]
        n, size = pc.utf8_length(words).to_numpy(), pc.binary_length(words).to_numpy()
        keys, at = np.unique(8 * ends + 2 * np.where(n < 5, 0, np.where(n < 9, 1, 2)) + (n != size), return_inverse=True)
        return np.array([self.class_of.get(f"{chr(k >> 3)}{k >> 1 & 3}{k & 1}", SPELLING_CLASSES) for k in keys.tolist()], np.int32)[at]

    def look_up(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts with their ends: distinct words, then their symbols and places in the top list (-1: not in it), each with the end's behind; the place
        of every token among them, and the number of tokens of each text."""
        words, codes, sizes = words_of(texts)
        at = np.fromiter(map(self.index.get, words.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), repeat(-1)), np.int32, len(words))
        rare = np.flatnonzero(at < 0)
        at = np.append(at, np.int32(self.index[END]))
        symbols = self.symbol[at]
        if len(rare):
            symbols[rare] = FREQUENT + self._spelled(words.take(pa.array(rare)))
        tokens = np.full(len(codes) + len(sizes), len(words), np.int32)
        tokens[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes
        return words, symbols, at, tokens, sizes + 1

    def read(self, text: str | None, known: dict | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Symbols, places in the top list and the words that are not in it, in order, of one text with its end."""
        words, symbols, at, tokens, _ = self.look_up(pa.array([text], pa.string()))
        far = tokens[at[tokens] < 0]
        return symbols[tokens], at[tokens], words.take(pa.array(far)).cast(pa.large_binary()).to_pylist()


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def averaged(parts: DataFrame, n: int) -> np.ndarray | None:
    """The mean of the float32 vectors ``w`` of ``at, n, w``, weighted by ``n``; ``at`` is about 0 to n - 1.

    Sums of FAN rows each, level by level, until the driver has at most about FAN; always in the order of ``at``."""

    def whole(w: bytes, kind: type) -> np.ndarray:
        return np.frombuffer(w, kind).astype(np.float64)

    def adding(kind: type) -> Callable[[pa.Table], pa.Table]:
        def add(part: pa.Table) -> pa.Table:
            rows = sorted(zip(*(part.column(c).to_pylist() for c in ("at", "n", "w")), strict=True))
            total = sum(whole(w, kind) * (k if kind is np.float32 else 1) for _, k, w in rows)
            return pa.table({"at": pa.array([rows[0][0] // FAN], pa.int64()), "n": pa.array([sum(r[1] for r in rows)], pa.int64()), "w": pa.array([total.tobytes()], pa.binary())})

        return add

    kind: type = np.float32
    while kind is np.float32 or n > FAN:
        parts = parts.groupBy(F.floor(F.col("at") / FAN).alias("by")).applyInArrow(adding(kind), "at bigint, n bigint, w binary")
        kind, n = np.float64, -(-n // FAN)
    found = sorted(parts.collect(), key=lambda r: r["at"])
    return sum(whole(r["w"], kind) for r in found) / sum(r["n"] for r in found) if found else None


def fitted(learn: DataFrame, n_tokens: int, symbols: Symbols) -> Weights:
    """Weights after ROUNDS rounds of sharded training on all of ``learn`` and averaging."""
    spark = learn.sparkSession
    shards = max(1, -(-n_tokens // (ROUNDS * SHARD_TOKENS)))
    w = fresh()
    if not n_tokens:
        return w
    sent_symbols = spark.sparkContext.broadcast(symbols)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = sent_symbols.value
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                some = batch.slice(at, SLICE)
                _, symbol, _, tokens, sizes = symbols.look_up(some.column(3))
                ends = np.r_[0, 2 * np.cumsum(sizes)].astype(np.int64)
                found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(symbol[tokens].astype("<i2"))])
                yield pa.RecordBatch.from_arrays([*some.columns[:3], found.cast(pa.binary())], ["round", "shard", "place", "symbols"])

    mixed = lambda k: F.xxhash64("doc_id", "text", F.lit(k))
    dealt = learn.select(F.pmod(mixed(1), F.lit(ROUNDS)).alias("round"), mixed(2).alias("shard"), mixed(3).alias("place"), "text")
    dealt = cut(dealt.mapInArrow(read, "round bigint, shard bigint, place bigint, symbols binary"))
    for round_ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=0.01 / (1 + round_)) -> Iterator[pa.RecordBatch]:
            w, texts, size, seen = sent.value, [], 0, 0
            for batch in batches:
                for found in sliced(batch.column(0)):
                    texts.append(np.frombuffer(found, "<i2"))
                    size += len(texts[-1])
                    if size >= 2 * SHARD_TOKENS:
                        w, seen, texts, size = train(w, texts, ROUND_STEPS, rate)[0], seen + size, [], 0
            if texts:  # what is left of a shard in pieces is read once
                w, seen = train(w, texts, min(ROUND_STEPS, -(-size // (STEPS * STREAMS))) if seen else ROUND_STEPS, rate)[0], seen + size
            if seen:
                flat = np.concatenate([w[k].ravel() for k in sorted(w)]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([flat], pa.binary())], ["at", "n", "w"])

        part = dealt.where(F.col("round") == round_).repartition(shards, "shard").sortWithinPartitions("place").select("symbols")
        flat, at = averaged(part.mapInArrow(run, "at bigint, n bigint, w binary"), shards), 0
        for k in sorted(w) if flat is not None else ():
            w[k], at = flat[at : at + w[k].size].reshape(w[k].shape).astype(np.float32), at + w[k].size
    return w


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", _held_out(F.col("doc_id")))
    learn = docs.where("not held_out")
    n_docs = learn.count()
    counts = cut(counted(learn))
    top = most_frequent(counts, TOP)
    # spelling classes hold the words that are not frequent tokens
    often = spark.createDataFrame([(w,) for w, _ in sorted([*top, (END, n_docs)], key=lambda x: (-x[1], x[0]))[: FREQUENT]], "word binary")
    rest = counts.join(F.broadcast(often), "word", "left_anti")
    spellings = {named(r["spelling"]): (r["n"], r["v"]) for r in rest.groupBy(spelled_as().alias("spelling")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n_train, v_train = (total[0] or 0) + n_docs, total[1] + (n_docs > 0)
    symbols = Symbols(top, n_docs, spellings)
    sent = spark.sparkContext.broadcast((fitted(learn, n_train, symbols), symbols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, symbols = sent.value
        mass = np.append(symbols.log_mass, 0)
        pending: list[tuple] = []
        size = 0

        def rows() -> pa.RecordBatch:
            flat, sizes = (np.concatenate([p[k] for p in pending]) for k in (0, 1))
            model = flat_log_probs(w, flat, sizes) / np.log(10)
            own = [pa.concat_arrays([p[2].column(k) for p in pending]) for k in range(3)]
            n_known, base, spelled = (np.concatenate([p[k] for p in pending]) for k in (3, 4, 5))
            # no word has a space
            alone = pa.array([b" %d" % u for u in own[0].to_pylist()], pa.binary())
            columns = [own[0], alone, np.zeros(len(sizes), np.int64), *own[1:], sizes, n_known, base, model + spelled]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for begin in range(0, len(batch), SLICE):
                some = batch.slice(begin, SLICE)
                words, symbol, at, tokens, sizes = symbols.look_up(some.column(3))
                first = np.cumsum(sizes) - sizes
                listed = at >= 0
                log_count = np.where(listed, symbols.log_count[at], 0)
                spelled = np.where(symbol >= FREQUENT, log_count - mass[np.maximum(symbol - FREQUENT, 0)], 0)
                flat = symbol[tokens].astype(np.int16)
                n_known = np.add.reduceat((listed & (symbols.count[at] > 0)).astype(np.int64)[tokens], first)
                pending.append((flat, sizes, some, n_known, np.add.reduceat(log_count[tokens], first), np.add.reduceat(spelled[tokens], first)))
                size += len(flat)
                # words that are not in the top list, once a text
                far = np.flatnonzero(~listed[tokens])
                if len(far):
                    pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[far] * len(at) + tokens[far], return_counts=True)
                    more = [some.column(0).take(pa.array(pairs // len(at))), words.take(pa.array(pairs % len(at))).cast(pa.binary()), pa.array(tf, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*more, *(pa.nulls(len(pairs), k) for k in kinds[3:])], names)
                if size >= BUFFER:
                    yield rows()
                    pending, size = [], 0
        if pending:
            yield rows()

    names = ["uid", "word", "tf", "doc_id", "held_out", "n_tokens", "known", "base", "model"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [pa.int64(), pa.binary(), pa.int64(), to_arrow_type(docs.schema["doc_id"].dataType), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    parts = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(
        run, f"uid bigint, word binary, tf bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, model double")
    rare = F.col("tf") * F.log10(F.col("c") + 1)
    out = (parts.join(counts.select("word", "c"), "word", "left").groupBy("uid").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "known", "base", "model")],
        F.coalesce(F.sum(rare), F.lit(0.0)).alias("rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("rare_known")))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
                      (F.col("base") + F.col("rare") - F.col("n_tokens") * float(np.log10(n_train + v_train + 1))).alias("base_score"),
                      (F.col("model") + F.col("rare")).alias("score"))
