"""Web archives (WARC 1.1): pages written as records, indexed, and read back by byte ranges.

Spark's own text writer makes the archives: a row is a record, and the line separator is the
blank lines that end a record.  A file therefore comes whole from one task or not at all,
also where executors are lost, and any file system that Spark writes will do.

Reading goes by the index.  :func:`indexed` hops through the headers of each archive and
notes offset, length, address and digest of every record.  :func:`read_records` takes any
choice of index rows, sorts them by file and offset, joins ranges that are at most
:data:`GAP` bytes apart into reads of about :data:`RANGE` bytes, and cuts the records out of
what it has read.  These two open files by ``pyarrow.fs`` (local, S3, GCS, HDFS).

Of records with equal payloads of at least ``least`` bytes, the one with the largest id holds
the payload; the others are revisits that refer to it.  A null payload counts as empty.  Rows
without id come last among equals and are revisits if another has an id; rows that repeat the
largest id all hold the payload, so copies that all lack an id do too.  Characters that would end a header line, and blanks,
are written as %20; a page without address gets ``urn:page:<id>``.  Any length of text is one
record, held whole by one task.  An empty table gives an empty archive and an empty index.
Other columns of the pages are left out, whatever their names.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import pinned, removed, stored, text_or_empty, with_code

#: Payloads of fewer bytes are always written out.
LEAST = 1000
#: Bytes of a coalesced read, and of the gap that a read may bridge.
RANGE, GAP = 8 << 20, 64 << 10
#: Index rows handed on at once.
ROWS = 5000
#: Bits of the filter that spares most pages the join with the copies; the driver sees 128 kB of it.
BITS = 1 << 20
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "file string, offset long, length long, record_type string, url string, digest string, "
    "record_id string, refers_to_id string, page_id long"
)
#: Header fields that the index keeps.
FIELDS = {
    b"warc-type": "record_type", b"warc-target-uri": "url", b"warc-payload-digest": "digest",
    b"warc-record-id": "record_id", b"warc-refers-to": "refers_to_id", b"warc-page-id": "page_id",
}


def classified(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, bytes and, for revisits, ``refers_to``.

    Copies are counted on digests, so a hot payload is combined before it is shuffled.  Pages
    whose digest falls on a bit that no copy has set stay where they are; only the rest, which
    are the copies while these are fewer than :data:`BITS`, travel to the join.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        text_or_empty("html").alias("html"),
    ).withColumns({"digest": F.sha1(F.col("html")), "bytes": F.octet_length("html").cast("long")})
    copies = (
        rows.filter(F.col("bytes") >= least)
        .groupBy("digest", "bytes")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper"))
        .filter((F.col("n") > 1) & F.col("keeper").isNotNull())
        .drop("n")
    )
    bit = F.pmod(F.xxhash64("digest"), F.lit(BITS))
    word, place = (bit / 64).cast("int"), (bit % 64).cast("int")
    marks = copies.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits"))
    words = [0] * (BITS // 64)
    for row in marks.collect():
        words[row["word"]] = row["bits"]
    none = F.lit(None).cast("long")
    if not any(words):
        return rows.withColumn("refers_to", none)
    known = F.split(F.lit(",".join(map(str, words))), ",").cast("array<long>")
    may_be = F.call_function("shiftright", F.get(known, word), place).bitwiseAND(F.lit(1).cast("long")) == 1
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    travelling = rows.filter(may_be).join(copies, ["digest", "bytes"], "left")
    return (
        travelling.withColumn("refers_to", refers).drop("keeper")
        .unionByName(rows.filter(~may_be).withColumn("refers_to", none))
    )


def record_id(page_id: Column, digest: Column) -> Column:
    """A name that depends on id and digest only, so a record has it in each run."""
    name = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    parts = "^(.{8})(.{4})(.{4})(.{4})(.{12})$"
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, parts, "$1-$2-$3-$4-$5"), F.lit(">"))


def record() -> Column:
    """One row of :func:`classified` as a record, without the blank lines after it."""
    is_revisit = F.col("refers_to").isNotNull()
    page = F.col("page_id").cast("string")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    url = F.when(url == "", F.concat(F.lit("urn:page:"), F.coalesce(page, F.lit("-")))).otherwise(url)
    reply = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(END),
    )
    block = F.concat(reply, F.when(is_revisit, F.lit("")).otherwise(F.col("html")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    original = F.concat(
        field("WARC-Profile", F.lit(PROFILE)),
        field("WARC-Refers-To", record_id(F.col("refers_to"), F.col("digest"))),
    )
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", url),
        F.coalesce(field("WARC-Page-ID", page), F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(is_revisit, original).otherwise(""),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """Write one archive per partition of the pages into ``folder``."""
    rows = classified(pages, least).select(record().alias("value"))
    rows.write.option("lineSep", END).option("compression", "none").text(folder)


def opened(file: str):
    """The file, for reading from any place; Spark writes local paths with one slash."""
    system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
    return system.open_input_file(path)


def records(file: str) -> Iterator[tuple]:
    """A row of :data:`INDEX` for each record, from its header; contents are skipped."""
    with opened(file) as source:
        size, offset, reader = source.size(), 0, io.BufferedReader(source, 1 << 18)
        while offset < size:
            reader.seek(offset)
            if not reader.readline().startswith(b"WARC/"):
                raise ValueError(f"no record begins at byte {offset} of {file}")
            found = dict.fromkeys(FIELDS.values())
            content = 0
            while (line := reader.readline()).strip():
                name, _, value = line.partition(b":")
                name, value = name.strip().lower(), value.strip()
                if name == b"content-length":
                    content = int(value)
                elif name in FIELDS:
                    found[FIELDS[name]] = value.decode()
            length = reader.tell() - offset + content + len(END)
            digest = (found["digest"] or "").removeprefix("sha1:") or None
            page = None if found["page_id"] is None else int(found["page_id"])
            yield (
                file, offset, length, found["record_type"], found["url"], digest,
                found["record_id"], found["refers_to_id"], page,
            )
            offset += length


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all archives in a folder: a row of :data:`INDEX` per record.

    One task per archive, with one header in memory at a time.
    """
    with_code(spark)
    names = [field.split()[0] for field in INDEX.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["path"]:
                rows = []
                for row in records(file):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("path")
    return files.repartition("path").mapInPandas(scan, INDEX)


def payload(raw: bytes) -> bytes:
    """The payload of a record as read from its archive: what follows the headers of its block."""
    block = raw.partition(b"\r\n\r\n")[2]
    return block.partition(b"\r\n\r\n")[2].removesuffix(END.encode())


def read_records(index: DataFrame) -> DataFrame:
    """The chosen index rows with their ``payload``, by coalesced reads.

    ``index`` may have further columns.  The payload of a revisit is empty, as written.
    """
    with_code(index.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = 0
            while start < len(batch):
                file, first, end = batch["file"].iat[start], batch["offset"].iat[start], 0
                at = start
                while at < len(batch) and batch["file"].iat[at] == file:
                    low, high = batch["offset"].iat[at], batch["offset"].iat[at] + batch["length"].iat[at]
                    if at > start and (low - end > GAP or high - first > RANGE):
                        break
                    end, at = max(end, high), at + 1
                with opened(file) as source:
                    source.seek(int(first))
                    held = source.read(int(end - first))
                some = batch.iloc[start:at]
                cuts = zip(some["offset"] - first, some["offset"] - first + some["length"])
                yield some.assign(payload=[payload(held[low:high]) for low, high in cuts])
                start = at

    return (
        index.withColumn("_span", F.floor(F.col("offset") / RANGE))
        .repartition("file", "_span").sortWithinPartitions("file", "offset").drop("_span")
        .mapInPandas(read, f"{schema}, payload binary")
    )


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest are counted on what was read; a revisit has those of the record it
    refers to.  Archives and index stand in the shared checkpoint folder until the result,
    which is narrow, is pinned.
    """
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least)
    index, index_folder = stored(indexed(spark, folder))
    read = pinned(
        read_records(index.filter(F.col("record_type") == "response")).select(
            "page_id", "record_id", F.length("payload").cast("long").alias("payload_bytes"),
            F.sha1("payload").alias("payload_digest"),
        )
    )
    originals = read.groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"),
        F.max("payload_digest").alias("payload_digest"),
    )
    revisits = (
        index.filter(F.col("record_type") == "revisit").select("page_id", "refers_to_id")
        .join(originals, "refers_to_id", "left")
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    result = pinned(
        read.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
        .select(*columns)
        .unionByName(revisits.withColumn("record_type", F.lit("revisit")).select(*columns))
    )
    removed(spark, folder)
    removed(spark, index_folder)
    return result
