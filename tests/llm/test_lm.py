import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attnlens.llm import lm
from attnlens.llm.common import space_words


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm.fresh(1).items()}
    x, y = rng.integers(0, lm.START, (6, 3)), rng.integers(0, lm.START, (6, 3))
    x[2, 1] = lm.START
    h = rng.normal(0, 0.1, (3, lm.HIDDEN))
    g, _, _ = lm._gradients(w, x, y, h)
    for k in w:
        for at in rng.choice(w[k].size, 6) if k != "x" else np.ravel_multi_index((x.ravel()[:6], rng.integers(0, 3 * lm.HIDDEN, 6)), w[k].shape):
            near = []
            for e in (1e-5, -1e-5):
                v = {**w, k: w[k].copy()}
                v[k].flat[at] += e
                near.append(lm._gradients(v, x, y, h)[2])
            assert abs((near[0] - near[1]) / 2e-5 - g[k].flat[at]) < 1e-5


def test_state_is_carried_across_windows():
    w, rng = lm.fresh(2), np.random.default_rng(1)
    texts = [rng.integers(0, lm.START, n) for n in (1, 5, 64, 65, 200)]
    whole, small = lm.text_log_probs(w, texts, 256), lm.text_log_probs(w, texts, 7)
    assert np.allclose(whole, small, atol=1e-3)


def test_most_frequent_words_fit_the_limit(spark):
    counts = spark.createDataFrame([(b"w%d" % k, c) for k, c in enumerate([1] * 50 + [2] * 30 + [5, 2000, 2000, 1_000_000])], "word binary, c bigint")
    take = lambda n: sorted(c for _, c in lm.most_frequent(counts, n))
    assert take(84) == sorted([1] * 50 + [2] * 30 + [5, 2000, 2000, 1_000_000])
    assert take(83) == take(34) == sorted([2] * 30 + [5, 2000, 2000, 1_000_000])
    assert take(2) == [1_000_000] and take(0) == []
    assert lm.most_frequent(counts.limit(0), 5) == []


def test_scores_of_null_empty_and_repeated_texts(spark):
    rows = [(1, "a b a"), (2, None), (3, ""), (4, "a b a"), (4, "a b a"), (None, "c")]
    got = lm.scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 6 and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {1}


def test_a_pass_reads_every_symbol():
    rng = np.random.default_rng(3)
    for n in (1, 50, 5_000, 300_000):
        texts = [np.full(k, s % lm.START) for s, k in enumerate(rng.multinomial(n, [0.5, 0.3, 0.2]) + 1)]
        parts = list(lm.windows(texts, lm.ROUND_STEPS))
        assert len(parts) <= lm.ROUND_STEPS
        x, y = (np.concatenate(c).T.ravel()[: n + 3] for c in zip(*parts, strict=True))
        assert (y == np.concatenate(texts)).all() and (x == np.concatenate([np.r_[lm.START, t[:-1]] for t in texts])).all()


def test_the_end_of_a_long_shard_is_learned_from():
    """Beyond the first 80 x 32 of each of 64 streams of 200,000 symbols."""
    a, b = (lm.train(lm.fresh(), [np.zeros(199_500, np.int64), np.full(500, k)], lm.ROUND_STEPS)[0] for k in (0, 5))
    assert (a["cb"] != b["cb"]).any()


def test_every_training_text_is_learned_from(spark):
    """Other word orders in texts that a sample of 2,000 of 3,000 leaves out change the scores of the others."""
    docs = spark.range(3000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 6), k -> concat('w', (id * k * k) % 23))) as text",
                                        "pmod(xxhash64(id), 1000000) >= 900000 as far")
    turned = docs.withColumn("text", F.expr("if(far, array_join(reverse(split(text, ' ')), ' '), text)"))
    far = {r["doc_id"] for r in docs.where("far").collect()}
    a, b = ({r["doc_id"]: (r["base_score"], r["score"]) for r in lm.scores(d).collect()} for d in (docs, turned))
    near = [k for k in a if k not in far]
    assert np.allclose([a[k][0] for k in near], [b[k][0] for k in near])
    assert max(abs(a[k][1] - b[k][1]) for k in near) > 1e-4


def test_weights_are_averaged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 3)
    rows = [(k, k % 4 + 1, np.array([k, 1, -k], np.float32).tobytes()) for k in range(29)]
    got = lm.averaged(spark.createDataFrame(rows, "at bigint, n bigint, w binary"), 29)
    assert np.allclose(got, np.average([np.frombuffer(w, np.float32) for _, _, w in rows], axis=0, weights=[n for _, n, _ in rows]))
    assert lm.averaged(spark.createDataFrame([], "at bigint, n bigint, w binary"), 1) is None


def test_counts_and_base_scores_match_plain_python(spark):
    """And scores match a plain pass of the network over each text, word by word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = {i: [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w] for i, t in rows}
    learned = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in learned for w in [*words[i], None])
    n, v = sum(counts.values()), len(counts)
    kept = {}
    monkey = lm.fitted
    try:
        def keep(learn, n_tokens, symbols):
            kept["w"], kept["symbols"] = monkey(learn, n_tokens, symbols), symbols
            return kept["w"]
        lm.fitted = keep
        got = {r["doc_id"]: r for r in lm.scores(docs).collect()}
    finally:
        lm.fitted = monkey
    assert got.keys() == words.keys()
    w, symbols = kept["w"], kept["symbols"]
    mass = 10 ** symbols.log_mass
    for i, some in words.items():
        tokens = [*some, None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in learned, len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert abs(r["base_score"] - sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)) < 1e-6 * len(tokens)
        if len(tokens) < 300:
            h, x, total = np.zeros(lm.HIDDEN), lm.START, 0.0
            for t in tokens:
                sym = int(symbols.read(t or "", {})[0][0])
                g, hu, k = w["x"][x].astype(float), h @ w["u"], lm.HIDDEN
                z, reset = (1 / (1 + np.exp(-(g[a : a + k] + hu[a : a + k]))) for a in (0, k))
                c = np.tanh(g[2 * k :] + reset * hu[2 * k :])
                h = c + z * (h - c)
                cls = sym // lm.WIDTH if sym < lm.FREQUENT else sym - lm.FREQUENT + lm.FREQUENT_CLASSES
                logit = h @ w["c"] + w["cb"]
                total += logit[cls] - np.log(np.exp(logit).sum())
                if sym < lm.FREQUENT:
                    logit = h @ w["w"][cls] + w["wb"][cls]
                    total += logit[sym % lm.WIDTH] - np.log(np.exp(logit).sum())
                else:
                    total += np.log((counts[t] + 1) / mass[sym - lm.FREQUENT])
                x = sym
            assert abs(r["score"] - total / np.log(10)) < 1e-3 * len(tokens)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = lm.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    tokens = sum(r["n_tokens"] for r in rows)
    assert (sum(r["score"] for r in rows) - sum(r["base_score"] for r in rows)) / tokens > 0.1


def test_empty_table_clashing_names_ties_and_a_long_text(spark):
    rows = [(1, "a b a", 3, "x"), (2, "a b a", 4, "y"), (3, "long text " * 30_000, 5, "z"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int, word string")
    got = {r["doc_id"]: r for r in lm.scores(docs).collect()}
    assert got[1]["score"] == got[2]["score"] and got[3]["n_tokens"] == 60_001 and got[None]["n_tokens"] == 1
    assert lm.scores(docs.limit(0)).count() == 0


def test_words_of_slices_are_the_word_rule():
    texts = ["", None, " Ab a\n", "x\x0bY\x1cÀ É\x85z\n\n", "\t", "a a A  b 𐐀x", "long " * 3000, "É" * 70] * 40
    column, symbols = pa.array(texts), lm.Symbols([(b"a", 9)], len(texts), {lm.spelling(w): (1, 1) for w in (b"x", b"long", "É".encode())})
    for at in range(0, len(texts), 37):  # the later ones begin inside the array's buffers
        some = column.slice(at, 37)
        words, codes, sizes = lm.words_of(some)
        words = words.cast(pa.large_binary()).to_pylist()
        want = [space_words(t) for t in some.to_pylist()]
        assert [words[k] for k in codes] == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]
        _, symbol, place, tokens, sizes = symbols.look_up(some)
        assert sizes.tolist() == [len(t) + 1 for t in want]
        assert symbol[tokens].tolist() == [symbols.symbol[symbols.index[w]] if w in symbols.index else lm.FREQUENT + symbols.spelled(w) for t in want for w in [*t, lm.END]]


def test_spelling_in_sql_is_the_spelling(spark):
    words = ["a", "abcde", "abcdefghi", "é", "aé", "éa", "語", "x𐐀", "ɏɐ", "12345678", "naïveté"]
    rows = spark.createDataFrame([(w.encode(),) for w in words], "word binary").select("word", lm.spelled_as().alias("s")).collect()
    assert [lm.named(r["s"]) for r in rows] == [lm.spelling(w.encode()) for w in words]


def test_steps_run_only_for_sequences_that_go_on(monkeypatch):
    step, rows = lm._step, []
    monkeypatch.setattr(lm, "_step", lambda g, u, h, out: rows.append(len(h)) or step(g, u, h, out))
    lm.text_log_probs(lm.fresh(2), [np.zeros(n, np.int64) for n in (1, 5, 64, 65, 200)])
    assert sum(rows) == 335 and len(rows) == 200
