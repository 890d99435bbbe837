"""Fill-in-middle over seekable compressed frames.

``frames`` stores a text as independent zstandard frames of at most ``frame_chars`` code points, beside cumulative counts: the
line ends, code points and bytes before each frame.  ``transform`` finds both cuts by those counts and decompresses only the frames that a cut
falls into; all others go into the output as they are, so the output is a list of frames again.  ``digests`` streams ordered frames,
one at a time: the output for its digest and for the places of the marks, then the text rebuilt from the output alone.  No step holds a whole
decompressed text but the first, which gets it as a row.

A text of n lines is cut after ``min`` and ``max`` of h1 % (n + 1) and h2 % (n + 1) lines into prefix, middle and suffix; h1 to h4 are the first
four groups of 8 hex digits of ``sha256("<seed>:<doc_id>")``.  Forms: ``plain`` (the text), ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle),
``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle).  Texts that are empty or hold a mark stay plain, so a mark in an output is never text.

Defined cases: a null text is an empty one; a null doc_id is hashed as the word ``null``; a text of one line has a cut at either end; repeated rows
give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attnlens.llm.common import sliced

FRAME_CHARS = 1 << 15
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
FRAMES = "array<struct<ends: bigint, chars: bigint, bytes: bigint, body: binary>>"
_FRAME = pa.list_(pa.struct([("ends", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("body", pa.binary())]))
#: Rows of a batch that go back to Spark together.
ROWS = 64


def frames(docs: DataFrame, frame_chars: int = FRAME_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, n_chars, marked, frames``: every text as frames; ``ends``, ``chars``, ``bytes`` count what stands before a frame."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)

        def framed(text: str) -> list[tuple[int, int, int, bytes]]:
            out, ends, size = [], 0, 0
            for at in range(0, len(text), frame_chars):
                part = text[at : at + frame_chars]
                body = part.encode("utf-8", "surrogatepass")
                out.append((ends, at, size, pack.compress(body)))
                ends, size = ends + part.count("\n"), size + len(body)
            return out

        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([t.count("\n") + (t[-1:] not in ("", "\n")) for t in texts], pa.int64()), pa.array(map(len, texts), pa.int64()),
                     rows.column(2), pa.array([[dict(zip(("ends", "chars", "bytes", "body"), f)) for f in framed(t)] for t in texts], _FRAME)],
                    ["doc_id", "n", "n_chars", "marked", "frames"])

    kind = docs.schema[doc_id].dataType.simpleString()
    marked = F.lit(False)
    for mark in MARKS:
        marked |= F.coalesce(F.contains(F.col(text), F.lit(mark)), F.lit(False))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), marked.alias("marked")).mapInArrow(
        store, f"doc_id {kind}, n bigint, n_chars bigint, marked boolean, frames {FRAMES}")


def _draw(doc_id: Column, seed: int, k: int) -> Column:
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(named, 256), 8 * k - 7, 8), 16, 10).cast("long")


class Seek:
    """Frames of one text, opened one at a time."""

    def __init__(self, stored: list[dict], n: int, n_chars: int) -> None:
        self.stored, self.n, self.n_chars = stored, n, n_chars
        self.open = zstandard.ZstdDecompressor().decompress

    def cut(self, lines: int) -> tuple[int, int, int]:
        """Frame, place in its bytes and code points before the cut after ``lines`` lines."""
        if lines == 0:
            return 0, 0, 0
        if lines == self.n:
            return len(self.stored), 0, self.n_chars
        k = bisect_left(self.stored, lines, key=lambda f: f["ends"]) - 1
        body, place = self.open(self.stored[k]["body"]), 0
        for _ in range(lines - self.stored[k]["ends"]):
            place = body.index(b"\n", place) + 1
        return k, place, self.stored[k]["chars"] + len(body[:place].decode("utf-8", "surrogatepass"))


def _between(seek: Seek, begin: tuple[int, int, int], end: tuple[int, int, int], pack: zstandard.ZstdCompressor) -> list[bytes]:
    """Frames of the text between two cuts; only those that a cut falls into are written anew."""
    if begin[:2] == end[:2]:
        return []
    (a, i, _), (b, j, _) = begin, end
    if a == b:
        return [pack.compress(seek.open(seek.stored[a]["body"])[i:j])]
    first = [pack.compress(rest)] if i and (rest := seek.open(seek.stored[a]["body"])[i:]) else []
    last = [pack.compress(seek.open(seek.stored[b]["body"])[:j])] if j else []
    return first + [f["body"] for f in seek.stored[a + bool(i) : b]] + last


def transform(stored: DataFrame, seed: int = 7, share: int = 100, spm: int = 50) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of the rows of ``frames``: of 100 texts ``share`` are transformed, of those ``spm`` to ``spm``.

    ``output`` holds ordered zstandard frames; ``text_of`` joins them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        mark = {m: pack.compress(m.encode()) for m in MARKS}
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                prefix, middle, output = [], [], []
                for row in rows.to_pylist():
                    seek = Seek(row["frames"], row["n"], row["n_chars"])
                    if row["form"] == "plain":
                        prefix.append(None)
                        middle.append(None)
                        output.append([f["body"] for f in seek.stored])
                        continue
                    a, b = seek.cut(min(row["h1"], row["h2"])), seek.cut(max(row["h1"], row["h2"]))
                    head, body = _between(seek, (0, 0, 0), a, pack), _between(seek, a, b, pack)
                    tail = _between(seek, b, (len(seek.stored), 0, seek.n_chars), pack)
                    prefix.append(a[2])
                    middle.append(b[2] - a[2])
                    output.append([mark[PREFIX], *head, mark[SUFFIX], *tail, mark[MIDDLE], *body] if row["form"] == "psm" else
                                  [mark[SUFFIX], *tail, mark[PREFIX], *head, mark[MIDDLE], *body])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(2), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.list_(pa.binary()))],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    doc_id = F.col("doc_id")
    plain = (F.col("n") == 0) | F.col("marked") | (_draw(doc_id, seed, 3) % 100 >= share)
    form = F.when(plain, "plain").when(_draw(doc_id, seed, 4) % 100 < spm, "spm").otherwise("psm")
    place = [(_draw(doc_id, seed, k) % (F.col("n") + 1)).alias(f"h{k}") for k in (1, 2)]
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n", form.alias("form"), *place, "n_chars", "frames").mapInArrow(
        build, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output array<binary>")


def text_of(output: list[bytes]) -> str:
    """An output as one text."""
    return b"".join(map(zstandard.ZstdDecompressor().decompress, output)).decode("utf-8", "surrogatepass")


class Restore:
    """Streams an output once for its digest and the places of its marks; then the text, in its own order."""

    def __init__(self, output: list[bytes], form: str) -> None:
        self.output, self.open = output, zstandard.ZstdDecompressor().decompress
        self.sha256, self.begins, self.size = hashlib.sha256(), [], 0
        wanted = [m.encode() for m in {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}.get(form, ())]
        found, carry = [], b""
        for frame in output:
            body = self.open(frame)
            self.sha256.update(body)
            seen, base = carry + body, self.size - len(carry)
            place = 0
            while len(found) < len(wanted) and (hit := seen.find(wanted[len(found)], place)) >= 0:
                found.append(base + hit)
                place = hit + 3
            carry = seen[max(place, len(seen) - 2) :]  # a mark may lie across two frames
            self.begins.append(self.size)
            self.size += len(body)
        if len(found) < len(wanted):
            raise ValueError("an output lacks a mark of its form")
        if form == "plain":
            self.parts = [(0, self.size)]
        else:
            one, two, three = (found[0] + 3, found[1]), (found[1] + 3, found[2]), (found[2] + 3, self.size)
            self.parts = [one, three, two] if form == "psm" else [two, three, one]

    def text(self) -> Iterator[bytes]:
        for begin, end in self.parts:
            for k in range(max(0, bisect_right(self.begins, begin) - 1), len(self.output)):
                if self.begins[k] >= end:
                    break
                yield self.open(self.output[k])[max(0, begin - self.begins[k]) : end - self.begins[k]]


def digests(done: DataFrame) -> DataFrame:
    """The rows of ``transform`` with ``output_sha256`` and ``restored_sha256`` (of the text rebuilt from output and form) in place of ``output``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, restored = [], []
            for output, form in zip(sliced(batch.column(5), ROWS), sliced(batch.column(2), ROWS), strict=True):
                back, digest = Restore(output, form), hashlib.sha256()
                for part in back.text():
                    digest.update(part)
                out.append(back.sha256.hexdigest())
                restored.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.string()), pa.array(restored, pa.string())],
                                             [*batch.schema.names[:5], "output_sha256", "restored_sha256"])

    kind = done.schema["doc_id"].dataType.simpleString()
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").mapInArrow(
        read, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")
