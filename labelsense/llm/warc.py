"""WARC archives: a deterministic sharded writer, and a reader that checks every digest.

Records are range-sorted by page id. Where a range begins follows from the running total of record
sizes, not from a sample, so the ranges are those of the pages. A range is written to files of one
gzip member per record, the first of which describes the file, and a new file begins when the
compressed size reaches a bound. Headers, record ids and digests are made from the record alone,
without clock or chance: the same pages give the same files, whatever the cluster.

Files are written under temporary names that hold the attempt. What a task has written is known
only from its rows of the manifest, a Parquet table that Spark commits once; a second job then gives
these files their final names, and can be repeated. Attempts that failed leave temporary files
which the manifest does not name; they are deleted at the end.

Of records with equal payloads the one with the largest page id is the response; the others are
revisits, with the digest and length of the payload but not the payload, and with the id, target and
date of that record.

Defined results: a null html is an empty payload, a null url a record without target; a null page id
counts as smaller than any other and is written as no page id; rows that share payload and largest
page id are all responses; a payload of any size is one record, held in memory alone; an empty table
gives an empty archive and an empty result; other columns of the pages are not read.
"""

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsense.operators.scale import lookup_join, running_totals, shared_folder, stored

ROLL_BYTES = 64 << 20
RANGE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "temporary string, name string, records bigint, bytes bigint, raw_bytes bigint, sha1 string"
_RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "payload binary, file string, offset bigint"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, payload_digest: str) -> str:
    """The same id for the same record; a UUID made from a hash of it."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{payload_digest}').urn}>"


def target(url: str | None) -> str | None:
    """The url with white space and control characters escaped, as a header can't hold them."""
    return None if url is None else re.sub(r"[\s\x00-\x1f\x7f]+", lambda found: quote(found[0]), url)


def _record(fields: dict, block: bytes) -> bytes:
    fields = fields | {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": len(block)}
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items() if value is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def file_record(name: str) -> bytes:
    """The record that a file begins with."""
    fields = {
        "WARC-Type": "warcinfo",
        "WARC-Record-ID": f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>",
        "WARC-Date": DATE,
        "WARC-Filename": name,
        "Content-Type": "application/warc-fields",
    }
    return _record(fields, b"software: labelsense\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_to_url: str | None = None) -> bytes:
    """A WARC/1.1 record. ``refers_to`` and ``refers_to_url`` are of the response that a revisit repeats."""
    payload_digest = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    revisit = refers_to is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, url, payload_digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": target(url),
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": record_id(refers_to, refers_to_url, payload_digest) if revisit else None,
        "WARC-Refers-To-Target-URI": target(refers_to_url) if revisit else None,
        "WARC-Refers-To-Date": DATE if revisit else None,
        "WARC-Page-ID": page_id,
        "WARC-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
    }
    return _record(fields, http.encode() + (b"" if revisit else payload))


class _Rolling:
    """Writes gzip members to files under temporary names, one file after the other."""

    def __init__(self, folder: str, task: int, roll_bytes: int):
        self.files, self.root = pyarrow.fs.FileSystem.from_uri(folder)
        self.task, self.roll_bytes, self.attempt = task, roll_bytes, uuid.uuid4().hex
        self.part, self.out, self.done = 0, None, []

    def write(self, data: bytes) -> None:
        member = gzip.compress(data, compresslevel=6, mtime=0)
        if self.out is not None and self.bytes + len(member) > self.roll_bytes:
            self.close()
        if self.out is None:
            self.name = f"records-{self.task:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{self.attempt}"
            self.out = self.files.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.records, self.bytes, self.raw, self.sha1 = 0, 0, 0, hashlib.sha1()
            first = file_record(self.name)
            self._put(gzip.compress(first, compresslevel=6, mtime=0), len(first))
        self._put(member, len(data))
        self.records += 1

    def _put(self, member: bytes, raw: int) -> None:
        self.out.write(member)
        self.sha1.update(member)
        self.bytes, self.raw = self.bytes + len(member), self.raw + raw

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.temporary, self.name, self.records, self.bytes, self.raw, self.sha1.hexdigest()))
            self.out, self.part = None, self.part + 1


def _write(folder: str, roll_bytes: int):
    names = [field.split()[0] for field in _MANIFEST.split(", ")]
    columns = ("task", "page_id", "url", "html", "refers_to", "refers_to_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, done = None, []
        for batch in batches:
            for row in zip(*[batch.column(c) for c in columns], strict=True):
                task, page_id, url, html, refers_to, refers_to_url = [cell.as_py() for cell in row]
                if rolling is None or rolling.task != task:  # a task may write several ranges
                    if rolling is not None:
                        rolling.close()
                        done += rolling.done
                    rolling = _Rolling(folder, task, roll_bytes)
                rolling.write(record(page_id, url, (html or "").encode(), refers_to, refers_to_url))
        if rolling is not None:
            rolling.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, *rolling.done, strict=True)], names)

    return run


def _publish(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for temporary, name in zip(batch["temporary"].to_pylist(), batch["name"].to_pylist(), strict=True):
                source = files.get_file_info(f"{root}/{temporary}")
                if source.type != pyarrow.fs.FileType.NotFound:  # else moved by an earlier attempt
                    files.move(f"{root}/{temporary}", f"{root}/{name}")
                if files.get_file_info(f"{root}/{name}").type == pyarrow.fs.FileType.NotFound:
                    raise FileNotFoundError(f"{name}: neither it nor its temporary file is there")
            yield batch

    return run


def with_reference(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to, refers_to_url): the largest page id with the same payload, if it is another."""
    payload = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    digested = pages.select(F.col("page_id").cast("bigint"), "url", "html", payload.alias("_digest"))
    largest = digested.groupBy("_digest").agg(F.max(F.struct("page_id", "url")).alias("_largest"), F.count(F.lit(1)).alias("_rows"))
    repeated = largest.filter("_rows > 1")
    joined = lookup_join(digested, repeated, ["_digest"], "left", salt_on=["page_id"], key_rows="_rows")
    other = ~F.col("page_id").eqNullSafe(F.col("_largest.page_id"))
    return joined.select(
        "page_id", "url", "html", F.when(other, F.col("_largest.page_id")).alias("refers_to"),
        F.when(other, F.col("_largest.url")).alias("refers_to_url"),
    )


def range_bounds(pages: DataFrame, range_bytes: int) -> np.ndarray:
    """Page ids at which ranges begin, but for the first: a range has ``range_bytes`` or ends with a page id.

    One number per range reaches the driver.
    """
    sizes = pages.select(F.col("page_id").cast("bigint"), (F.coalesce(F.octet_length("html"), F.lit(0)) + 512).cast("bigint").alias("size"))
    sizes = sizes.groupBy("page_id").agg(F.sum("size").alias("size"))
    placed = running_totals(sizes, [F.asc_nulls_first("page_id")], {"before": F.col("size")}, one_task_rows=0)
    no = F.expr(f"before div {range_bytes}").alias("no")
    firsts = placed.groupBy(no).agg(F.min("page_id").alias("first")).filter("no > 0")
    return np.array(sorted(row["first"] for row in firsts.collect()), np.int64)


def range_of(page_id: Column, bounds: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right").astype(np.int32))

    return place(F.coalesce(page_id, F.lit(-(1 << 63))))


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below the URI ``folder``; the manifest of the files."""
    pyarrow_files, root = pyarrow.fs.FileSystem.from_uri(folder)
    pyarrow_files.create_dir(f"{root}/_temporary", recursive=True)
    bounds = range_bounds(pages, range_bytes)
    order = ["task", "page_id", "url", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))]
    ranged = with_reference(pages).withColumn("task", range_of(F.col("page_id"), bounds))
    sorted_ = ranged.repartition(len(bounds) + 1, "task").sortWithinPartitions(*order)
    manifest = stored(sorted_.mapInArrow(_write(folder, roll_bytes), _MANIFEST))
    published = _dealt(manifest).mapInArrow(_publish(folder), _MANIFEST)
    final = published.drop("temporary")
    final.write.parquet(f"{folder}/manifest")
    pyarrow_files.delete_dir(f"{root}/_temporary")
    return pages.sparkSession.read.schema(final.schema).parquet(f"{folder}/manifest")


def _dealt(manifest: DataFrame) -> DataFrame:
    """A row of the manifest for each task, up to the number of tasks of a shuffle or of the cores; adaptive
    execution would read so few bytes in one."""
    spark = manifest.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return manifest.repartitionByRange(max(1, min(manifest.count(), most)), "name")


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream."""
    offset, held = 0, b""
    while held or (held := stream.read(chunk)):
        unzip, out, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not held and not (held := stream.read(chunk)):
                raise EOFError("a gzip member is cut off")
            out.append(unzip.decompress(held))
            used += len(held)
            held = b""
        held = unzip.unused_data
        used -= len(held)
        yield offset, b"".join(out)
        offset += used


def parse(data: bytes) -> dict | None:
    """Fields of a record and its payload, None for a description of the file; an error if a digest doesn't fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{digest(block)}" != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.decode().rpartition("Content-Length: ")[2])
    response = fields["WARC-Type"] == "response"
    if response and f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("WARC-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To-Page-ID"),
        "payload": payload if response else None,
    }


def _read(folder: str, payloads: bool):
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string()),
        ("offset", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                rows, size = [], 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, data in members(stream):
                        found = parse(data)
                        if found is None:
                            continue
                        rows.append(found | {"file": name, "offset": offset})
                        if not payloads:
                            rows[-1]["payload"] = None
                        size += len(rows[-1]["payload"] or b"") + 256
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record, checked against its digests: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload (null for revisits), file, offset."""
    return _dealt(manifest.select("name")).mapInArrow(_read(folder, payloads), _RECORDS)


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"
    )
