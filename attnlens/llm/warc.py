"""WARC archives as a chunked record table.

``classified`` compares digests and ids only; payloads stay where they were read unless more than BROADCAST digests have several pages.
``archive`` turns each page into one record and splits a payload of more than ``chunk`` characters into
segments (WARC's ``continuation`` records) in one pass, a few at a time, so that neither the writer nor a reader holds more than some chunks beside
the page's own row.  Spark's text writer puts CRLF CRLF after every record, which is what the format asks for, and gzip keeps a file in one
task when it is read.  ``chunks`` streams the archives into rows of record id and chunk number, those of a record one after the other; ``digests``
carries one SHA-1 state from row to row, and first sorts rows that come in another order.

Of pages with equal payloads of at least ``smallest`` bytes, the one with the smallest page_id is the response and the
others are revisits of it without a payload.

Defined cases: a null payload is empty; a page_id with several payloads has a record for each, and a revisit belongs to the one whose digest its header gives; repeated rows with the smallest page_id are all responses; a null page_id never becomes the
response of a group that has another; line ends in a URL are dropped; a null URL is written without the field; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attnlens.llm.common import cut, shared_dir, sliced, small, split_join

CHUNK = 1 << 18
#: Digests of several pages are broadcast up to this many (some 60 MB), and meet the pages by a shuffle beyond.
BROADCAST = 500_000
#: Characters of chunks that a writer hands on at once.
HELD = 1 << 22
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A fixed date: archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"


def base32(hex_: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five digits are four characters."""
    out = []
    for k in range(0, 40, 5):
        n = F.conv(F.substring(hex_, k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + F.lit(1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def classified(pages: DataFrame, smallest: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, payload, payload_bytes, sha1, first`` (the response's page_id, null where it is the page itself)."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(F.encode(payload, "UTF-8")).alias("sha1"))
    groups = (rows.where(F.col("payload_bytes") >= smallest).groupBy("sha1")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    groups = cut(groups)
    if small(groups, BROADCAST):
        joined = rows.join(F.broadcast(groups), "sha1", "left")
    else:
        joined = split_join(rows, groups, "sha1", "n", pages.count(), "left")
    return joined.drop("n").withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def archive(rows: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Writes a record for each row of ``classified`` to gzipped archives in ``path``."""
    rows = rows.withColumn("record", F.concat_ws("-", F.col("page_id").cast("string"), F.monotonically_increasing_id().cast("string")))
    columns = ["record", "page_id", "url", "sha1", "first"]
    body = F.when(F.col("first").isNull(), F.col("payload")).otherwise("")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, last, at, part, held = [], [], [], [], 0

            def rows(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                kept = batch.select(columns).take(pa.array(places, pa.int64()))
                return pa.RecordBatch.from_arrays([*kept.columns, pa.array(last, pa.int32()), pa.array(at, pa.int32()), pa.array(part, pa.string())], [*columns, "last", "at", "part"])

            for k, text in enumerate(sliced(batch.column("body"), 16)):
                for begin in range(0, max(1, len(text)), chunk):
                    places.append(k)
                    last.append(max(0, len(text) - 1) // chunk)
                    at.append(begin // chunk)
                    part.append(text[begin : begin + chunk])
                    held += len(part[-1])
                    if held >= HELD:
                        yield rows()
                        places, last, at, part, held = [], [], [], [], 0
            if places:
                yield rows()

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    rows = rows.select(*columns, body.alias("body")).mapInArrow(split, f"{kinds}, last int, at int, part string")
    kind = F.when(F.col("at") > 0, "continuation").when(F.col("first").isNull(), "response").otherwise("revisit")
    field = lambda name, value, when: F.when(when, F.concat(F.lit(f"{name}: "), value))
    always = F.lit(True)
    header = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), field("WARC-Type", kind, always),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("record"), F.lit(":"), F.col("at").cast("string"), F.lit(">")), always),
        F.lit(f"WARC-Date: {DATE}"), field("X-Page-ID", F.col("page_id").cast("string"), F.col("page_id").isNotNull()),
        field("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", ""), F.col("url").isNotNull()),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1"))), F.col("at") == 0),
        field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")), F.col("first").isNotNull()),
        field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("first").isNotNull()),
        field("WARC-Segment-Number", (F.col("at") + 1).cast("string"), F.col("last") > 0),
        field("WARC-Segment-Origin-ID", F.concat(F.lit("<urn:page:"), F.col("record"), F.lit(":0>")), F.col("at") > 0),
        F.lit("Content-Type: text/html; charset=utf-8"), field("Content-Length", F.octet_length("part").cast("string"), always))
    rows.select(F.concat(header, F.lit(END), F.col("part")).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """``record, chunk, kind, page_id, refers_to, digest`` and the bytes ``part`` of every record of the archives in ``path``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: dict[str, str] | None = None
        wanted, held, size, skip = 0, [], 0, 0
        for batch in batches:
            out: list[tuple] = []
            for value in sliced(batch.column(0), 16):
                value, skip = value[skip:], 0
                if fields is None:
                    if not value:
                        continue
                    lines = value.split("\r\n")
                    if not lines[0].startswith("WARC/"):
                        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
                    fields = dict(line.split(": ", 1) for line in lines[1:])
                    wanted, held, size = int(fields["Content-Length"]), [], -len(END)
                    continue
                held.append(value.encode("utf-8", "surrogatepass"))
                size += len(held[-1]) + len(END)
                if size + 2 == wanted:  # the payload ends in CRLF, which the reader took for half of the record's end
                    held[-1] += END[:2].encode()
                    size, skip = wanted, 2
                if size >= wanted:
                    if size != wanted:
                        raise ValueError(f"record {fields['WARC-Record-ID']}: {size} bytes for {wanted}")
                    record, _, at = fields["WARC-Record-ID"][len("<urn:page:") : -1].rpartition(":")
                    out.append((record, int(at), fields["WARC-Type"], fields.get("X-Page-ID"), fields.get("WARC-Refers-To", "<urn:page:>")[len("<urn:page:") : -1] or None,
                                fields.get("WARC-Payload-Digest", "")[len("sha1:") :] or None, END.encode().join(held)))
                    fields = None
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)
        if fields is not None:
            raise ValueError("an archive ends inside a record")

    names = ["record", "chunk", "kind", "page_id", "refers_to", "digest", "part"]
    schema = pa.schema([(n, pa.int32() if n == "chunk" else pa.binary() if n == "part" else pa.string()) for n in names])
    return spark.read.option("lineSep", END).text(path).mapInArrow(
        parse, "record string, chunk int, kind string, page_id string, refers_to string, digest string, part binary")


def digests(parts: DataFrame, together: bool = False) -> DataFrame:
    """``record, kind, page_id, refers_to, said`` (the header's digest), ``payload_bytes`` and ``payload_digest`` of
    every record of ``chunks``, in whatever order its rows come; ``together``: those of a record follow each other, as ``chunks`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record", "kind", "page_id", "refers_to", "said", "payload_bytes", "payload_digest"]
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names])
        now: list | None = None

        def done(x: list) -> dict:
            return dict(zip(names, [*x[:5], x[5], base64.b32encode(x[6].digest()).decode()], strict=True))

        for batch in batches:
            out = []
            columns = [sliced(batch.column(n), 16) for n in ("record", "chunk", "kind", "page_id", "refers_to", "digest", "part")]
            for record, at, kind, page, refers, said, part in zip(*columns, strict=True):
                if now is None or now[0] != record:
                    if now is not None:
                        out.append(done(now))
                    if at:
                        raise ValueError(f"record {record} has no first chunk")
                    now = [record, kind, page, refers, said, 0, hashlib.sha1(), 0]
                if at != now[7]:
                    raise ValueError(f"record {record} lacks chunk {now[7]}")
                now[5] += len(part)
                now[6].update(part)
                now[7] += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([done(now)], schema=schema)

    dealt = parts if together else parts.repartition("record").sortWithinPartitions("record", "chunk")
    return dealt.mapInArrow(
        run, "record string, kind string, page_id string, refers_to string, said string, payload_bytes bigint, payload_digest string")


def round_trip(pages: DataFrame, smallest: int = 0, chunk: int = CHUNK, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives ``pages`` in the shared folder and reads the archives back:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archive(classified(pages, smallest, page_id, url, html), path, chunk)
    kind = pages.schema[page_id].dataType
    back = cut(digests(chunks(spark, path), together=True).withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind)))
    responses = back.where("kind = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
    # a revisit has the payload of the response that it names, of those with its page_id the one with its digest
    named = back.where("kind = 'revisit'").select("page_id", "refers_to", F.concat_ws(" ", F.col("refers_to").cast("string"), "said").alias("of"))
    full = responses.groupBy(F.concat_ws(" ", F.col("page_id").cast("string"), "payload_digest").alias("of")).agg(
        F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    members = cut(full.join(named.groupBy("of").agg(F.count(F.lit(1)).alias("n")), "of"))
    revisits = split_join(named, members, "of", "n", named.count()).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return responses.unionByName(revisits)
