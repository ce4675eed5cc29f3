"""WARC archives: writing records, and reading them back by boundary-chain verification.

Writing: a record per page. Of equal payloads the page with the smallest id is a response and the others are revisits
without payload. Spark's text writer makes the files (records end with an empty line twice, its separator), so any file
system that Spark knows will do.

Reading: Spark deals the files out in byte ranges, whatever their size, and each task cuts its range where a record can begin: at
the magic at the begin of a line (no part of this separator is its begin again, so that the cuts do not depend on the range; should an
empty piece be lost at a range's end, the pieces do not add up to the file, which is then read as one range). A piece that begins with a header, however long, is a candidate: an edge from its record's offset to its successor (header +
Content-Length + 4 bytes on). Magic inside payloads gives candidates too. A task follows the edges within its range and emits, for each candidate, where its chain leaves the range. Offsets are counted from the
sizes of the ranges before. Pointer jumping from offset 0, doubling the jumps each round, then tells by which record, if any, each range
is entered, and a second pass over the ranges reads what lies on the chain. Records over several ranges are put together from their
parts, one record in a task. A file whose chain does not begin at 0 or does not end at its length is an error.

Nulls: null html is an empty payload; a null page_id comes last among equal payloads, and equal ids of equal payloads are
all responses. Empty table: an archive without records. Pages with the same id and payload (repeated rows) get a record each.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import hash_map, marked, materialize, salted_join, shared_folder, ship, small_batches

MAGIC = b"WARC/1."
END = "\r\n\r\n"
EMPTY = END.encode()
#: What separates pieces: the last byte of an empty line, and the magic.
MARK = EMPTY[-1:] + MAGIC
#: Records of a file that is written, at most.
FILE_RECORDS = 2000
#: Pages of one payload from which on their join is dealt over several tasks.
HOT = 256
#: Ranges up to which the table of their entries (about 100 bytes each) is broadcast.
MOST_RANGES = 200_000
FOUND = "file string, range long, kind int, rel long, exit long"
RECORD = "file string, range long, kind int, rel long, uri string, page_id string, record_type string, refers_to string, length long, payload_bytes long, payload_digest string, part binary"
_RECORD = [x.split()[0] for x in RECORD.split(", ")]


def _base32_sha1(hexadecimal: Column) -> Column:
    """The base32 form of 40 hexadecimal digits: five of them are four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexadecimal, 5 * i + 1, F.lit(5)), 16, 10).cast("int"))
    four = lambda v: F.concat(*[F.substring(F.lit(letters), F.shiftright(v, b).bitwiseAND(31) + 1, F.lit(1)) for b in (15, 10, 5, 0)])
    return F.array_join(F.transform(five, four), "")


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def write(pages: DataFrame, path: str | None = None, least_revisit: int = 0, file_records: int = FILE_RECORDS) -> str:
    """Write `pages` (page_id, url, html) as WARC files below `path` (a new shared folder by default); returns the path."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    p = p.withColumn("key", F.concat_ws(":", "digest", "size"))
    # only payloads of several ids go on from here
    narrow = materialize(p.where(F.col("size") >= least_revisit).select("key", "page_id"))
    groups = narrow.groupBy("key").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("page_id").alias("n"), F.count("*").alias("all"))
    groups = materialize(groups.where((F.col("first") < F.col("last")) | (F.col("n").between(1, F.col("all") - 1))).select("key", "first", "all"))
    split = marked(p.withColumn("h", F.xxhash64("key")), hash_map(groups.select(F.xxhash64("key").alias("h")))).drop("h")
    hot = groups.where(F.col("all") > HOT).select(F.xxhash64("key").alias("h"))
    copies = salted_join(split.where("in_map").drop("in_map"), groups.select("key", "first"), "key", hot, "left")
    columns = ["page_id", "url", "html", "digest", "size", "first"]
    p = copies.select(*columns).unionByName(split.where("NOT in_map").withColumn("first", F.lit(None).cast("long")).select(*columns))
    p = p.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).withColumn("payload_digest", _base32_sha1(F.col("digest")))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:page:"), _number(F.col("page_id")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "%20")), F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), _number(F.col("first")), F.lit(">"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")), F.concat(F.lit("X-Payload-Length: "), F.col("size")),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), 0).otherwise(F.col("size"))),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), F.when(F.col("revisit"), "").otherwise(F.col("html")))
    p.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)
    return path


def parse_header(data: bytes) -> dict[str, str] | None:
    """The fields, in lower case, of a header (without the empty line behind it), or None."""
    first, *lines = data.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[0-9]", first):
        return None
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return fields if fields.get("content-length", "").isdigit() else None


def _page(uri: str) -> str | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", uri or "")
    return m[1] if m else None  # pandas would make longs with nulls doubles


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, size, range (where it begins), piece: what lies between separators, in order within each range. The first piece of a file has
    its magic, the others come behind theirs."""
    files = spark.read.option("lineSep", MARK.decode()).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").text(path)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("piece"))


def whole_files(spark: SparkSession, names: list[str]) -> DataFrame:
    """What `pieces` gives of some files, each as one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                found = data.as_py().split(MARK)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([len(data.as_buffer())] * n), pa.array([0] * n), pa.array(found, pa.binary())], ["file", "size", "range", "piece"])

    files = spark.read.format("binaryFile").load(names).select(F.col("_metadata.file_path").alias("file"), "content")
    return files.mapInArrow(run, "file string, size long, range long, piece binary")


def chains(found: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """(offset, where its chain leaves the range or ends) of the candidates (offset, successor) of a range, ascending."""
    leaves: dict[int, int] = {}
    for at, successor in reversed(found):
        leaves[at] = leaves.get(successor, successor)
    return [(at, leaves[at]) for at, _ in found]


def begun(begin: int, at: int, piece: bytes) -> tuple[int, bytes]:
    """(offset in the range, bytes) of what begins with the magic that a piece at `at` has or stands behind."""
    return (0, piece) if begin == at == 0 else (at - len(MAGIC), MAGIC + piece)


def headed(data: bytes) -> tuple[bytes, bytes, bytes]:
    """(header, what follows in the same piece, the separator behind it): the separator can hold the header's end, if the payload begins
    with the magic."""
    header, empty, rest = data.partition(EMPTY)
    if not empty and data.endswith(EMPTY[:3]):
        return data[:-3], MAGIC, b""
    return header, rest, MARK


def candidates(cut: DataFrame) -> DataFrame:
    """kind 0: rel (offset in its range) and exit of each candidate; kind 1: the bytes of each range, and its file's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at, found = None, 0, []

        def done() -> pa.RecordBatch:
            file, begin, size = here
            rows = [(file, begin, 0, a, e) for a, e in chains(found, at)] + [(file, begin, 1, at, size)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["file", "range", "kind", "rel", "exit"])

        for batch in batches:
            for file, size, begin, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "range", "piece")), strict=True):
                if here is None or here[:2] != (file, begin):
                    if here:
                        yield done()
                    here, at, found = (file, begin, size), 0, []
                rel, data = begun(begin, at, piece)
                header, _, _ = headed(data)
                if f := parse_header(header):
                    found.append((rel, rel + len(header) + 4 + int(f["content-length"]) + 4))
                at += len(piece) + len(MARK)
        if here:
            yield done()

    return cut.mapInArrow(run, FOUND)


def entered(found: DataFrame) -> DataFrame:
    """file, range, entry (offset in the range) of each range in which a record of its file's chain begins."""
    ranges = found.where("kind = 1").select("file", "range", F.col("rel").alias("n"), F.col("exit").alias("size"))
    begin = F.sum("n").over(Window.partitionBy("file").orderBy("range")) - F.col("n")  # a row for each range of a file
    ranges = materialize(ranges.select("file", "range", "size", begin.alias("begin")))
    c = found.where("kind = 0").join(ranges, ["file", "range"])
    jumps = materialize(c.select("file", "range", "rel", F.expr("begin + rel").alias("at"), F.expr("begin + exit").alias("jump")))
    known = jumps.select("file", "at", "range", "rel")
    reached = materialize(jumps.where("at = 0").select("file", "at"))
    hop = jumps.select("file", "at", "jump")
    while True:
        more = reached.join(hop, ["file", "at"]).select("file", F.col("jump").alias("at")).join(known.select("file", "at"), ["file", "at"], "left_semi").join(reached, ["file", "at"], "left_anti")
        more = materialize(more.distinct())
        if more.isEmpty():
            break
        reached = materialize(reached.unionByName(more))
        hop = materialize(hop.join(hop.select("file", F.col("at").alias("jump"), F.col("jump").alias("over")), ["file", "jump"], "left").select("file", "at", F.coalesce("over", "jump").alias("jump")))
    last = jumps.join(reached, ["file", "at"], "left_semi").groupBy("file").agg(F.max("jump").alias("last"))
    wrong = ranges.select("file", "size").distinct().join(last, "file", "left").where("last IS NULL OR last <> size").first()
    if wrong is not None:
        raise ValueError(f"{wrong.file} does not begin with a record" if wrong["last"] is None else f"the records of {wrong.file} end at byte {wrong['last']} of {wrong.size}")
    return materialize(known.join(reached, ["file", "at"], "left_semi").select("file", "range", F.col("rel").alias("entry"), F.expr("at - rel").alias("begin")))


def records(cut: DataFrame, entries: DataFrame) -> DataFrame:
    """kind 0: whole records of the chain; 1: a record's header and first part, where its range ends before it; 2: what lies in a
    range before its entry, or all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at, fields, start, held, need, got, rows = None, 0, None, 0, [], 0, 0, []

        def row(kind: int, rel: int, f: dict | None, n: int | None, payload: bytes | None, part: bytes | None) -> tuple:
            file, begin, _ = here
            if f is None:
                return file, begin, kind, rel, None, None, None, None, None, None, None, part
            whole = payload is not None and f.get("warc-type") == "response"
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else f.get("warc-payload-digest", "").removeprefix("sha1:")
            size = n if f.get("warc-type") == "response" else int(f["x-payload-length"]) if f.get("x-payload-length", "").isdigit() else None
            return file, begin, kind, rel, f.get("warc-target-uri"), _page(f.get("warc-record-id", "")), f.get("warc-type"), _page(f.get("warc-refers-to", "")), n, size, digest, part

        def end() -> None:
            """The range is over: what is unfinished goes on in the next one."""
            nonlocal fields, held
            if fields is not None:
                rows.append(row(1, start, fields, need, None, b"".join(held)))
            elif held:
                rows.append(row(2, 0, None, None, None, b"".join(held)))
            fields, held = None, []

        def flushed() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _RECORD)
            rows.clear()
            return out

        for batch in batches:
            for file, begin, entry, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "range", "entry", "piece")), strict=True):
                if here is None or here[:2] != (file, begin):
                    if here:
                        end()
                    here, at, got = (file, begin, entry), 0, 0
                rel, data = begun(begin, at, piece)
                if fields is None and entry is not None and rel >= entry:
                    if held:  # before the entry
                        rows.append(row(2, 0, None, None, None, b"".join(held)))
                    header, rest, more = headed(data)
                    fields, start, held = parse_header(header), rel, [rest]
                    need = int(fields["content-length"])
                else:
                    held.append(piece)
                    more = MARK
                got = got + len(held[-1]) if len(held) > 1 else len(held[0])
                if fields is not None and more and got >= need:  # without a separator behind it, the record goes on
                    rows.append(row(0, start, fields, need, b"".join(held)[:need], None))
                    fields, held = None, []
                else:
                    held.append(more)
                    got += len(more)
                at += len(piece) + len(MARK)
            if rows:
                yield flushed()
        if here:
            end()
        if rows:
            yield flushed()

    if entries.count() <= MOST_RANGES:
        j = cut.join(F.broadcast(entries), ["file", "range"], "left")  # of a checked size; keeps the order within ranges
    else:
        j = cut.withColumn("number", F.monotonically_increasing_id()).join(entries, ["file", "range"], "left").repartition("file", "range").sortWithinPartitions("file", "range", "number")
    return j.select("file", "range", "entry", "piece").mapInArrow(run, RECORD)


def _joined_parts(parts: DataFrame) -> DataFrame:
    """Records over several ranges: the last one that began takes what lies before the entries of the ranges that follow."""
    owner = F.max(F.when(F.col("kind") == 1, F.col("range"))).over(Window.partitionBy("file").orderBy("range", F.desc("kind")))
    keys = parts.select("file", "range", "kind").withColumn("owner", owner)  # narrow; a row or two for each range

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        # a range's own end comes before the beginning of the next one
        pdf = pdf.sort_values(["range", "kind"], ignore_index=True)
        head = pdf[pdf.kind == 1].iloc[[0]].copy()
        n = int(head.length.iloc[0])
        data = b"".join(bytes(x) for x in pdf.part)[:n]
        if head.record_type.iloc[0] == "response":
            head["payload_digest"] = base64.b32encode(hashlib.sha1(data).digest()).decode()
        head["kind"], head["part"] = 0, None
        return head.drop(columns="owner")

    return parts.join(keys, ["file", "range", "kind"]).groupBy("file", "owner").applyInPandas(put, RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, offset, uri, page_id, record_type, refers_to, payload_bytes, payload_digest."""
    small_batches(spark)
    cut = pieces(spark, path)
    first = materialize(candidates(cut))
    sums = first.where("kind = 1").groupBy("file").agg(F.sum("rel").alias("n"), F.max("exit").alias("size"))
    odd = materialize(sums.where(F.col("n") != F.col("size") + len(MARK)).select("file"))
    names = [r.file for r in odd.collect()]  # files in which a piece is missing
    rest = whole_files(spark, names) if names else None
    if rest is not None:
        cut = cut.join(F.broadcast(odd), "file", "left_anti")  # the names are here already
        first = materialize(first.join(odd, "file", "left_anti").unionByName(candidates(rest)))
    entries = entered(first)
    starts = entries.select("file", "range", "entry")
    found = records(cut, starts)
    found = materialize(found if rest is None else found.unionByName(records(rest, starts)))
    whole = found.where("kind = 0")
    parts = found.where("kind > 0")
    if not parts.isEmpty():
        whole = whole.unionByName(_joined_parts(parts))
    begins = entries.select("file", "range", "begin")
    out = whole.join(begins, ["file", "range"], "left").select("file", F.expr("begin + rel").alias("offset"), "uri", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


ship(__name__)
