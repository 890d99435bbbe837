"""Alignment: against whole-text tokens of both libraries, in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers
import pytest

from attnlens.llm import aligning

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", " a", "a ", "  a  b   c ", "a\n b\n\n  c\t d", "it's we'll 'tis ' s 's", "x　y z   w", "▁ in a text", "naïve café 東京は 良い\n", "१२३ ４５ 12,345.67!!",
       "<|endoftext|> <s> </s> <0x41>", "a\x1cb\x1f c\x00 d", "é ö नि", "🙂🙃 🙂", "a" * 900, ";\r\n}\r\n", "word, " * 40, "'" * 50 + "s"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def whole(libraries, text):
    """Groups and links of one text by the two libraries alone."""
    a, b = libraries
    if not text:
        return [], []
    of = aligning.byte_level()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], []
    ends_a, ends_b = np.cumsum([len(r) for r in raw_a]).tolist(), np.cumsum([len(r) for r in raw_b]).tolist()
    at_b = {e: k for k, e in enumerate(ends_b)}
    groups, links, i, j = [], [], 0, 0
    for k, e in enumerate(ends_a):
        if e in at_b:
            groups.append((ids_a[i : k + 1], ids_b[j : at_b[e] + 1]))
            links.append((ids_a[k], ids_b[at_b[e]]))
            i, j = k + 1, at_b[e] + 1
    return groups, links


def expected(libraries, texts):
    found = [whole(libraries, t) for t in texts]
    count = Counter(link for _, links in found for link in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for groups, links in found:
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == most[x[1]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("chunk", [1 << 15, 40, 7])
def test_whole_table_equals_the_libraries(spark, libraries, chunk):
    rng = random.Random(3)
    alphabet = ["the", "ing", " ", " ", "\n", "é", "東", "12", ",", "'s", "  ", "x", "Straße", "\t", "…", "ﬁ"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 120))) for _ in range(60)]
    if chunk > 1000:
        texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts.append(texts[-1])
    docs = spark.createDataFrame([(k, "x", t) for k, t in enumerate(texts)], "doc_id long, n_a string, text string")
    got = {r.doc_id: tuple(r)[1:] for r in aligning.links(docs, A, B, chunk).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    want = expected(libraries, texts)
    assert len(got) == len(texts)
    assert [k for k in got if got[k] != want[k]] == []


def test_fragments_are_a_monoid(libraries):
    rng, sides = random.Random(5), aligning.Sides(A, B)
    text = " " + "".join(rng.choices(["heinhe", "the", ",", " ", "é", "!?", "1999", "\n", "wordy"], k=400))
    a, b = sides.a_ids(text), sides.b_ids(text)
    tokens = aligning.Open(a, np.cumsum(sides.a_len[a]), b, np.cumsum(sides.b_len[b]))
    groups = aligning.Groups(sides)

    def flat(f):
        whole = reduce(aligning.Open.__add__, f.closed, aligning.Open())
        return [x.tolist() for x in (*f.prefix.parts(), *whole.parts(), *f.suffix.parts())], f.met

    for _ in range(40):
        # A and B tokens of a stretch need not end together
        i, j = sorted(rng.sample(range(len(a)), 5)), sorted(rng.sample(range(len(b)), 5))
        i, j = [0, *i, len(a)], [0, *j, len(b)]
        parts = [aligning.fragment(aligning.Open(a[x:y], tokens.a_ends[x:y], b[u:v], tokens.b_ends[u:v])) for x, y, u, v in zip(i, i[1:], j, j[1:], strict=False)]
        left = reduce(aligning.join, parts)
        right = reduce(lambda acc, part: aligning.join(part, acc), reversed(parts))
        assert flat(left) == flat(right) == flat(aligning.fragment(tokens))
        assert flat(aligning.join(aligning.Fragment(), left)) == flat(left) == flat(aligning.join(left, aligning.Fragment()))
    assert groups.of(aligning.Open())[0] == b""


def test_an_empty_table_gives_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert aligning.links(docs, A, B).count() == 0
