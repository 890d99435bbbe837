"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names of the operators that have DuckDB SQL or brute force for plain rows."""

import random
from collections import Counter

import numpy as np

from attnlens.llm import decontam, linededup, minhash, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, found string, removed string, score double, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "r", "f", "x", 1.0, 5) for i, t, s in rows], SCHEMA)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_decontamination(spark):
    item = " ".join(f"w{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item), (2, "Only four words here"), (3, None), (4, "..."), (None, item), (1, item)], "item_id long, text string")
    docs = table(spark, [(1, None, "a"), (2, "", "a"), (3, item.upper(), "a"), (3, item.upper(), "a"), (4, "x " * 50_000 + item, None),
                         (None, "say only FOUR, words here now", "a"), (5, " ".join(f"w{k}" for k in range(12)), "a")])
    got = decontam.with_verdict(decontam.find(docs, bench)).select("row.doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()
    assert ordered(got) == ordered([(1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 20, 20, 1, True), (3, 20, 20, 1, True), (4, 50_020, 20, 1, False),
                                    (None, 6, 4, 1, True), (5, 12, 0, 0, False)])
    assert decontam.find(table(spark, []), bench).count() == 0
    assert {r.n_hit for r in decontam.with_verdict(decontam.find(docs, bench.limit(0))).collect()} == {0}


def components(rows, width):
    """Brute force over all pairs: (doc_id, set size, smallest id reachable, kept)."""
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        n = min(width, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return [(i, len(sets[i]), label[i], label[i] == i) for i, _ in rows]


def test_near_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t", "one", "ONE", "one two", "long text " * 20_000]
    for _ in range(20):
        words = [f"v{rng.randrange(300)}" for _ in range(rng.randint(1, 60))]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(300)}"
            texts.append(" ".join(copy))
    rows = [*enumerate(texts), (9, texts[9])]
    docs = table(spark, [*((i, t, "s") for i, t in rows), (None, texts[9], "s"), (None, "alone among all", None)])
    for width in (2, 5):
        got = [tuple(r) for r in minhash.near_duplicates(docs, width).collect()]
        assert sorted(r for r in got if r[0] is not None) == sorted(components(rows, width))
        assert [r[2:] for r in got if r[0] is None] == [(None, True)] * 2
    kept = minhash.drop_near_duplicates(docs, 5)
    assert kept.columns == docs.columns
    want = Counter({r[0] for r in components(rows, 5) if r[3]}) + Counter({None: 2})
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert minhash.near_duplicates(table(spark, []), 2).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    docs = table(spark, [(1, a, "s"), (2, b, "s"), (2, a + " end", "s"), (3, b + " end", "t")])
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False)}
    assert [r.doc_id for r in minhash.drop_near_duplicates(docs, 2).collect()] == [1]
    twice = table(spark, [(1, a, "s"), (1, b, "s"), (1, b, "s"), (2, "other words", "s")])
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(twice, 2).collect()) == [1, 2]


def test_families_of_strays_match_brute_force(spark):
    """Two thousand texts around one, most of them too far from any centre, and alike strays among them."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(1000):
        words = list(base)
        for at in rng.sample(range(120), rng.choice((3, 7, 9, 10, 11, 12))):
            words[at] = f"r{rng.randrange(10**9)}"
        texts.append(" ".join(words))
        words[rng.randrange(120)] = f"r{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    shingler = minhash.Shingler(2)
    sets = [shingler(t) for t in texts]
    place = {h: k for k, h in enumerate(np.unique(np.concatenate(sets)).tolist())}
    held = np.zeros((len(sets), len(place)), np.float32)
    for k, s in enumerate(sets):
        held[k, [place[h] for h in s.tolist()]] = 1
    both, size = held @ held.T, held.sum(1)
    near = 100 * both >= 80 * (size[:, None] + size - both)
    want = np.arange(len(texts))
    while (low := np.where(near, want[None, :], len(texts)).min(1)).tolist() != want.tolist():
        want = low
    got = minhash.near_duplicates(table(spark, [(k, t, "s") for k, t in enumerate(texts)]).repartition(4), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want.tolist()))
    assert 1 < len(set(want.tolist())) < len(texts)


def test_blocks_give_spanning_forests(monkeypatch):
    a, b = np.array([0, 0, 1, 2, 5, 1]), np.array([1, 2, 2, 0, 6, 0])
    assert len(minhash.spanning(a, b)) == 3 and minhash.spanning(a[:0], b[:0]) == []


def test_toxicity(spark):
    rng = random.Random(2)
    plain = lambda: " ".join(f"word{rng.randrange(200)}" for _ in range(30))
    rows = [(k, plain() + (" vile scum filth" if k % 3 == 0 else ""), "s") for k in range(300)]
    docs = table(spark, [*rows, rows[1], (None, plain(), None), (400, None, "s"), (401, "", "s"), (402, plain() * 2_000, "s")])
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    got = toxicity.scores(docs, labels).select("row.doc_id", "score").collect()
    assert len(got) == 305 and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert score[400] == score[401] and len({r.score for r in got if r.doc_id == 1}) == 1
    assert all((score[k] >= toxicity.CUT) == (k % 3 == 0) for k in range(300))
    assert {r.score for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.scores(table(spark, []), labels).count() == 0


def test_sharding(spark):
    rows = [(k, f"text {k}", "s") for k in range(400)] + [(7, "text 7", "s"), (None, "a", "s"), (None, None, None), (500, None, "s"), (501, "é" * 100_000, "s")]
    got = sharding.shard_rows(table(spark, rows), sharding.ShardTree.balanced(4, 2, 5)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    of = {r.doc_id: r for r in got}
    assert (of[500].size, of[500].text_crc32, of[501].size) == (16, 0, 200_016)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.shard_rows(table(spark, []), sharding.ShardTree.balanced(4, 2, 5)).count() == 0


def test_line_dedup(spark):
    line, two_sites = "a line of all sites", "a line of two sites"
    rows = [(1, f"{line}\nown words of one\n {line} ", "a"), (2, f"{two_sites}\n{line}", "b"), (3, f"x\n{line}\nx", "c"), (3, f"x\n{line}\nx", "c"), (4, None, "d"),
            (5, "", "d"), (6, two_sites, None), (7, two_sites, "a"), (None, "words without an id", "a"), (8, "many lines here\n" * 20_000, "a")]
    docs = table(spark, rows)
    got = [(r.row.doc_id, r.n_lines, r.n_removed, r.text) for r in linededup.drop_boilerplate(docs).collect()]
    want = [(1, 3, 1, f"{line}\nown words of one"), (2, 2, 1, two_sites), (3, 3, 1, "x\nx"), (3, 3, 1, "x\nx"), (4, 0, 0, None), (5, 1, 0, ""), (6, 1, 0, two_sites),
            (7, 1, 0, two_sites), (None, 1, 0, "words without an id"), (8, 20_001, 0, "many lines here\n" * 20_000)]
    assert ordered(got) == ordered(want)
    assert linededup.drop_boilerplate(table(spark, [])).count() == 0
