"""Best-fit packing into sequences by the sum-of-squares rule.

A document's token ids end with the separator id 0.  Only documents longer than ``capacity`` are cut,
into full pieces and one rest.  A piece goes where the sum over gaps g of N(g)^2 becomes smallest, N(g) being the number of
open bins with gap g: into an open bin of gap g (if the piece fits), or into a new bin; ties go to the smallest gap left.

Pieces are dealt by a hash of their number into groups of about ``group_pieces`` and each group is packed by itself, so a task holds one bounded group (three integers a piece) and the bins lost at
a group's end are few beside its thousands.  Full pieces fill a sequence each and are not packed.

Tokens: texts are encoded in groups of about GROUP_CHARS characters.  Arrow finds the distinct words between white space of a group, which are encoded at once,
as the tokenizer never joins across white space; the ids of at most CACHE words and a group's own are kept until the task ends.  Words of ASCII and
Latin letters with end marks are normalized and cut here by the tokenizer's rule and go to its model alone; other words go to the whole tokenizer.  Texts
that hold one of its special strings, in capitals too, or whose lower case NFC would compose once more, are encoded whole.

Defined cases: a null or empty text is the single id 0; repeated rows are packed as rows of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnlens.llm.common import cut, give_back, lean, sliced

CAPACITY = 2048
GROUP_PIECES = 40_000
#: Characters of texts that are encoded together, words of a part of a longer text, and words whose ids a task keeps.
GROUP_CHARS, PART_WORDS, CACHE = 4_000_000, 200_000, 300_000
END = bytes(4)
#: Letters whose lower case depends on their neighbours, or is more than one character, in Python's rule.
BY_CONTEXT = ("\u0130", "\u03a3")
#: The tokenizer's own rule on lower-case ASCII words, end marks, and Latin letters up to U+024F, which are letters to every Unicode version.
CUT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
MARKS = b".,;:!?"
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")


class WordTokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for words that are normalized and apart already: no normalizer, no rule of splitting but white space.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {b"": b""}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith(self.tokenizer.model.end_of_word_suffix)]] = True

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new lower-case words.  The tokenizer cuts a word into parts that are words of their own to it, letters and end marks in the main, so a part
        is encoded once for all its words, together with many others."""
        known = self.known
        if len(known) > CACHE:  # words in use now stay
            known = self.known = {w: known[w] for w in (b"", *words) if w in known}
        parts, marked, cores, tails, odd, other = set(), [], [], [], [], []
        for word in words:
            if word in known:
                continue
            if word.isalpha() or LETTERS.fullmatch(word):
                parts.add(word)
                continue
            core = word.rstrip(MARKS)
            if len(core) < len(word) and (core.isalpha() or LETTERS.fullmatch(core)):
                marked.append(word)
                cores.append(core)
                tails.append(word[len(core) :])
            elif word.isascii():
                odd.append((word, CUT.findall(word)))
                parts.update(odd[-1][1])
            else:
                other.append(word)
        parts.update(cores)
        parts.update(tails)
        new = list(parts.difference(known))
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            found = np.array(self.bare.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends, raw = (4 * np.r_[0, np.flatnonzero(self.last[found]) + 1]).tolist(), found.tobytes()
            if len(ends) != len(part) + 1 or ends[-1] != len(raw):
                raise ValueError("a word's last token does not end it")
            known.update(zip(part, map(raw.__getitem__, map(slice, ends[:-1], ends[1:])), strict=True))
        known.update(zip(marked, map(add, map(known.__getitem__, cores), map(known.__getitem__, tails)), strict=True))
        known.update((word, b"".join(map(known.__getitem__, found))) for word, found in odd)
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in other], add_special_tokens=False)
        known.update((word, np.array(found.ids, "<u4").tobytes()) for word, found in zip(other, encoded, strict=True))

    def many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str | None]) -> Iterator[bytes]:
        long = [len(t or "") > GROUP_CHARS for t in texts]
        words = [None if far else self._words(t or "") for t, far in zip(texts, long, strict=True)]
        encoded = self._encoded([x or b"" for x in words])
        for text, far, x, ids in zip(texts, long, words, encoded, strict=True):
            yield (ids if x is not None else b"".join(self._parts(text)) if far else self._ids(text)) + END

    def _encoded(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of texts of ``_words``: each distinct word is looked up once, Arrow puts its ids at all its places."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        places = lists.flatten().dictionary_encode()
        words = places.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        self._learn(words)
        ids = pa.array([*map(self.known.__getitem__, words)], pa.large_binary()).take(places.indices)
        _, offsets, data = ids.buffers()
        if data is None:
            yield from (b"" for _ in texts)
            return
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[lists.offsets.to_numpy()].tolist()
        data = memoryview(data)
        yield from (bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True))

    def _words(self, text: str) -> bytes | None:
        """The text as the tokenizer normalizes it: composed, then in lower case; None if the tokenizer must see it in one piece."""
        if any(s in text for s in self.special):
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if any(c in text for c in BY_CONTEXT) or not unicodedata.is_normalized("NFC", text.lower()):
                return None
        text = text.lower()
        if any(s in text for s in self.special):  # in capitals it is no special string
            return None
        return text.encode("utf-8", "surrogatepass")

    def _parts(self, text: str) -> Iterator[bytes]:
        rest = self._words(text)
        if rest is None:
            yield self._ids(text)
        while rest:
            words = rest.split(None, PART_WORDS)
            words, rest = words[:PART_WORDS], words[PART_WORDS] if len(words) > PART_WORDS else b""
            yield from self._encoded([b" ".join(words)])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece.  ``tokenizer``: the path of its file."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        tokens = WordTokens(tokenizer)
        for batch in batches:
            owner, piece, length, crc = [], [], [], []
            for at, ids in enumerate(tokens.many(sliced(batch.column(1)))):
                for k, begin in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[begin : begin + 4 * capacity]
                    owner.append(at)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            number = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), batch.column(2).take(pa.array(owner, pa.int64())), pa.array(number),
                 pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "row_hash", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("row_hash")).mapInArrow(
        lean(split), f"doc_id {kind}, row_hash bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        # a bin that goes from gap g to g - size changes the sum by 2 (N(g - size) - N(g)) + 2; full bins are not
        # open, so one that becomes full only leaves the sum
        gaps = count[size:]
        cost = 2 * (count[: len(gaps)] - gaps) + 2
        cost[0] = 1 - 2 * gaps[0]
        cost[gaps == 0] = np.iinfo(np.int64).max
        best = int(cost.argmin())
        fresh = 2 * int(count[capacity - size]) + 1 if size < capacity else 0
        if gaps[best] and cost[best] <= fresh:
            bin_ = open_[best + size].pop()
            count[best + size] -= 1
            gap = best
        else:
            bin_, gap = len(used), capacity - size
            used.append(0)
        bins[i], offsets[i] = bin_, used[bin_]
        used[bin_] += size
        if gap:
            count[gap] += 1
            open_[gap].append(bin_)
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``parts`` (of ``pieces``) with ``sequence_id`` and ``offset``."""
    parts = cut(parts.withColumn("number", F.monotonically_increasing_id()))  # texts are tokenized once; repeated rows have numbers of their own
    n = parts.where(F.col("length") < capacity).count()
    groups = n // group_pieces + 1
    group = F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int")
    kind = parts.schema["doc_id"].dataType.simpleString()

    def fill(part: pa.Table) -> pa.Table:
        group = part.column("group")[0].as_py()
        # two orders, by a hash and largest first; the one that takes fewer sequences counts
        by_hash = part.sort_by([("row_hash", "ascending"), ("piece", "ascending"), ("number", "ascending")])
        by_size = by_hash.sort_by([("length", "descending")])
        tried = [(p, *sum_of_squares(p.column("length").to_numpy(), capacity)) for p in (by_hash, by_size)]
        part, bins, offsets = min(tried, key=lambda t: t[1].max())
        return part.drop_columns(["group", "row_hash", "number"]).append_column("sequence_id", pa.array((bins << 24) + group)).append_column("offset", pa.array(offsets))

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    packed = (parts.where(F.col("length") < capacity).withColumn("group", group).groupBy("group").applyInArrow(
        fill, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"))
    # a full piece is a sequence of its own; negative numbers cannot meet those of the groups
    full = parts.where(F.col("length") == capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
