import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from attnlens.llm import packing


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_match_the_tokenizer_and_sequences_are_gapless(spark):
    texts = [None, "", "One two, three!", "a b\x1cc\x85d e <|endoftext|> x", "long words " * 900, "né é ÀÇ", "same", "same"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(7, "same", "x")], "doc_id long, text string, piece string")
    rows = packing.pack(packing.pieces(docs, PATH, 64), 64, group_pieces=5).collect()
    tokenizer = Tokenizer.from_file(PATH)
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert got == sorted(want * (2 if i == 7 else 1))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 21, 400)
    bins, _ = packing.sum_of_squares(lengths, 20)
    gaps = {}
    for size, at in zip(lengths.tolist(), bins.tolist(), strict=True):
        def total(choice):
            g = dict(gaps)
            g[choice] = g.get(choice, 20) - size
            return sum(n * n for n in np.bincount([x for x in g.values() if x], minlength=1).tolist())
        choices = [c for c, g in gaps.items() if g >= size] + [-1]
        best = min(total(c) for c in choices)
        assert total(at if at in gaps else -1) == best
        gaps[at] = gaps.get(at, 20) - size


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(docs, PATH)).count() == 0


def test_every_character_of_the_basic_plane_gets_the_tokenizers_ids():
    tokenizer, tokens = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1F100, 0x1F200)]
    # composed, apart, and an upper case that only its lower case is composed of
    texts = [f"wo{c}rd {c}, {c}{c}" for c in chars] + [f"{b}{m} a{b}{m}c" for b in "AaHhTtWwYyJjKkSsIi" for m in "\u0301\u0308\u030a\u030c\u0331\u0307\u0323"]
    want = [np.array([*e.ids, 0], "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, tokens.many(texts), want, strict=True) if a != b] == []


def test_hindi_and_other_composed_letters_in_long_texts():
    tokenizer, tokens = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    text = " ".join(chr(c) + "\u0915" for c in range(0x958, 0x960)) + " क़लम ज़मीन, फ़िल्म! " + "word " * 10
    assert list(tokens.many([text * 300])) == [np.array([*tokenizer.encode(text * 300, add_special_tokens=False).ids, 0], "<u4").tobytes()]


def test_equal_rows_are_packed_in_several_groups(spark):
    docs = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'same words here' as text")
    rows = packing.pack(packing.pieces(docs, PATH), group_pieces=4_000)
    assert rows.selectExpr("sequence_id & 16777215 as g").groupBy("g").count().where("count < 6000").count() == 6
    assert rows.count() == 20_000 and rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_latin_words_go_to_the_model_alone():
    tokenizer, tokens = Tokenizer.from_file(PATH), packing.WordTokens(PATH)

    class Whole:
        def encode(self, text, **_):
            raise AssertionError(text)

        def encode_batch_fast(self, texts, **_):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    asked, tokens.tokenizer = [], Whole()
    texts = ["", " \t", "The cat's 'tis don't 'RE-do 're'st, 2024-11-30!? a_b %%%&&& x\x00y\x1cz .,;", "Été, größe; ŉ ǆ über. ", None, "it''s'' 'll'd'x naïve?!", "the the  été"]
    want = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert list(tokens.many(texts)) == want and asked == []
    texts = ["×2 a÷b", "слово, 語 té€"]
    assert list(tokens.many(texts)) == [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts] and len(asked) == 5


def test_special_strings_in_capitals_are_plain_text():
    tokenizer, tokens = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    texts = ["a <|ENDOFTEXT|> b", "é<|StartOfText|>", "é<|endoftext|≯"]
    assert list(tokens.many(texts)) == [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]


def test_words_learned_anew_and_long_texts_keep_their_ids(monkeypatch):
    monkeypatch.setattr(packing, "GROUP_CHARS", 50)
    monkeypatch.setattr(packing, "PART_WORDS", 7)
    monkeypatch.setattr(packing, "CACHE", 5)
    tokenizer, tokens = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    texts = [f"Word{k}, other words {k * k}-{k}; été{k % 3} x's" * (1 + 4 * (k % 2)) for k in range(40)]
    assert list(tokens.many(texts)) == [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
