"""Fill-in-middle: against plain slicing of lines, over frames of any size."""

import hashlib
import re

import pytest
import zstandard

from attnlens.llm import fim

TEXTS = [None, "", "one line", "one line\n", "\n", "\n\n\n", "a\nb\nc\nd\n", "a\nb\nc\nd", "é\nçà\n\n ü𝒳\n" * 7, "x" * 300 + "\n" + "y" * 300, "has <P> inside\nand more\n",
         "<\nP>\nS>\n<\n" * 5, "<S", "<M\n>\n", "long " * 200 + "\n", *[f"line {k}\n" * (k % 13) + "tail" * (k % 2) for k in range(80)]]


def plain(doc_id, text, seed=7, share=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(lines), hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 3 else k, "x", t, 1) for k, t in enumerate(TEXTS)] + [(7, "x", TEXTS[7], 1)]
    return spark.createDataFrame(rows, "doc_id long, output string, text string, n long")


@pytest.mark.parametrize(("frame_chars", "share"), [(1, 100), (3, 100), (64, 60), (1 << 15, 100)])
def test_forms_and_texts_equal_plain_slicing(spark, docs, frame_chars, share):
    stored = fim.frames(docs, frame_chars)
    done = fim.transform(stored, share=share)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, fim.text_of(r.output)) for r in done.collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, *plain(r.doc_id, r.text, share=share)) for r in docs.select("doc_id", "text").collect())
    assert got == want
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    of = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in fim.digests(done).collect():
        assert r.output_sha256 == hashlib.sha256(plain(r.doc_id, of[r.doc_id], share=share)[4].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(of[r.doc_id].encode()).hexdigest()


def test_frames_seek_by_counts_and_untouched_frames_stay(spark):
    text = "".join(f"line {k}\n" for k in range(1000))
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    row = fim.frames(docs, 100).first()
    assert len(row.frames) == -(-len(text) // 100)
    for k, frame in enumerate(row.frames):
        before = text[: 100 * k]
        assert (frame.ends, frame.chars, frame.bytes) == (before.count("\n"), len(before), len(before.encode()))
        assert zstandard.ZstdDecompressor().decompress(frame.body).decode() == text[100 * k : 100 * k + 100]
    out = fim.transform(fim.frames(docs, 100)).first()
    kept = {bytes(f.body) for f in row.frames}
    assert sum(bytes(f) not in kept for f in out.output) <= 3 + 4  # three marks, two frames a cut


def test_a_mark_over_two_frames_is_found_and_a_missing_one_is_an_error():
    pack = zstandard.ZstdCompressor().compress
    back = fim.Restore([pack(b"<P"), pack(b">ab<"), pack(b"S>"), pack(b"cd<M>"), pack(b"ef")], "psm")
    assert b"".join(back.text()) == b"abefcd"
    with pytest.raises(ValueError, match="mark"):
        fim.Restore([pack(b"<P>ab<S>")], "psm")


def test_an_empty_table_gives_no_rows(spark, docs):
    assert fim.digests(fim.transform(fim.frames(docs.limit(0)))).count() == 0
