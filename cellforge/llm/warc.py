"""WARC archives, written with an index first and read by coalesced byte ranges.

Rows of equal payload (UTF-8 html; null counts as empty) of at least `dedup_bytes` bytes are one response,
that of the largest page_id, and revisits that refer to it. Every task writes one archive of its own (one
gzip member a record) into a folder that all machines share, through pyarrow's file systems, and returns
the index rows: file, offset, length, url and digest of each record. Only the index of finished tasks is
kept, so an archive that a lost executor began is never read.

Reading selects records in the index, deals them by file and stretch, in as many parts as their bytes ask for, sorts the ranges, joins those that
lie closer than GAP into reads of up to READ bytes, and takes the records out of each read.

A null url is written as an empty target. A null page_id comes last among equal payloads. Of rows
that repeat wholly exactly one can be the response. Extra columns are ignored. An
empty table gives an empty index and result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm.common import arrow_batches, scratch, stored

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges closer than GAP bytes are read together, up to READ bytes; a task reads a stretch of a file.
GAP, READ, STRETCH = 64 << 10, 4 << 20, 64 << 20
#: A read task has so many bytes at least, however many cores there are.
LEAST_STRETCH = 4 << 20
INDEX = "record_id string, page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, of)}>"


def response_id(payload_digest: str) -> str:
    """The id of the one response that revisits of a payload refer to."""
    return record_id(f"payload {payload_digest}")


def record(kind: str, own: str, url: str, payload: bytes) -> bytes:
    """The bytes of the record with id own: a response with its payload, or a revisit with the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [("WARC-Type", kind), ("WARC-Target-URI", " ".join(url.split())), ("WARC-Date", DATE), ("WARC-Record-ID", own), ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("Content-Type", "application/http;msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", response_id(digest(payload)))]
    named = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{named}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's named fields (lower case) and its payload (empty for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _store(uri: str):  # noqa: ANN202
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def plan(pages: DataFrame, dedup_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, record_type and refers_to of each row of pages (page_id, url, html)."""
    each = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    equal = stored(each.where(F.length("payload") >= dedup_bytes).groupBy("page_id", "url", "sha").agg(F.count("*").alias("n")), "warc_rows")
    # read from a table, so that adaptive execution can split the pages of one payload
    top = stored(equal.groupBy("sha").agg(F.max(F.struct("page_id", "url", "n")).alias("top"), F.sum("n").alias("copies")).where("copies > 1"), "warc_firsts")
    of = each.join(top, "sha", "left").withColumn("first", F.col("top").isNotNull() & F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url")))
    again = F.col("top").isNotNull() & (F.length("payload") >= dedup_bytes) & ~F.col("first")
    kind = lambda revisit: [F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("top.page_id")).alias("refers_to")]
    cols = ["page_id", "url", "payload"]
    planned = of.select(*cols, *kind(again), (F.col("first") & (F.col("top.n") > 1)).alias("same"), "top")
    if equal.where("n > 1").isEmpty():
        return planned.drop("same", "top")
    # rows that repeat wholly are one row with a count: one response, and a revisit for each other copy
    copies = planned.where("same").groupBy("page_id", "url", F.sha1("payload").alias("sha")).agg(F.first("payload").alias("payload"), F.first("top").alias("top"))
    copies = copies.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top.n"))).alias("k")).select(*cols, *kind(F.col("k") > 1))
    return planned.where("NOT same").drop("same", "top").union(copies)


def write(planned: DataFrame, folder: str, dedup_bytes: int = 0) -> DataFrame:
    """Writes the archives into folder, and returns the stored index.

    The response of payloads that are deduplicated is named by its digest, any other record by its file and offset,
    so that no two records share an id, whatever rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in batches:
                rows = []
                for page_id, url, payload, kind, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    own = response_id(digest(payload)) if kind == "response" and len(payload) >= dedup_bytes else record_id(f"{name} {at}")
                    data = z.compress(record(kind, own, url or "", payload)) + z.flush()
                    out.write(data)
                    rows.append((own, page_id, url, digest(payload), kind, refers, f"{folder}/{name}", at, len(data)))
                    at += len(data)
                cols = list(zip(*rows, strict=True)) or [[]] * 9
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["record_id", "page_id", "url", "payload_digest", "record_type", "refers_to", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    arrow_batches(planned.sparkSession, 256)
    return stored(planned.mapInArrow(run, INDEX), "warc_index")


def ranges(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, first, last) of the reads that cover sorted byte ranges; last is exclusive."""
    first = 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > GAP or offsets[i] + lengths[i] - offsets[first] > READ:
            yield offsets[first], offsets[i - 1] + lengths[i - 1], first, i
            first = i


def read(selected: DataFrame) -> DataFrame:
    """The records of selected index rows, read back from the archives and checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, opened = None, ("", None)
        for b in batches:
            files, offsets, lengths, pages, refers, ids = (b.column(n).to_pylist() for n in ("file", "offset", "length", "page_id", "refers_to", "record_id"))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                if opened[0] != files[i]:
                    if opened[1] is not None:
                        opened[1].close()
                    fs, path = _store(files[i])
                    opened = (files[i], fs.open_input_file(path))
                for start, end, lo, hi in ranges(offsets[i:j], lengths[i:j]):
                    block = opened[1].read_at(end - start, start)
                    rows = []
                    for k in range(i + lo, i + hi):
                        fields, payload = parse(zlib.decompress(block[offsets[k] - start : offsets[k] - start + lengths[k]], 31))
                        sha = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-record-id"] != ids[k] or (fields["warc-type"] == "response" and digest(payload) != sha):
                            raise ValueError(f"{files[k]} at {offsets[k]} isn't the record of the index")
                        rows.append((pages[k], fields["warc-target-uri"], fields["warc-type"], refers[k], sha, payload))
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()], strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"])
                i = j
        if opened[1] is not None:
            opened[1].close()

    # a given number of parts: by the size of index rows, adaptive execution would leave all bytes to a few tasks
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    cores = selected.sparkSession.sparkContext.defaultParallelism
    stretch = min(max(total // (4 * cores), LEAST_STRETCH), STRETCH)
    dealt = selected.repartition(2 * max(1, -(-total // stretch)), "file", F.floor(F.col("offset") / stretch)).sortWithinPartitions("file", "offset")
    return dealt.select("record_id", "page_id", "refers_to", "file", "offset", "length").mapInArrow(run, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, dedup_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each row, from the archives."""
    index = write(plan(pages, dedup_bytes), folder or scratch(spark, "warc"), dedup_bytes)
    back = stored(read(index).select("page_id", "record_type", "refers_to", "payload_digest", F.length("payload").cast("long").alias("payload_bytes")), "warc_records")
    whole = back.where("record_type = 'response'")
    # a revisit's payload is that of the response with its digest
    sizes = whole.groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"))
    again = back.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, "payload_digest").withColumnRenamed("full", "payload_bytes")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.select(*cols).union(again.select(*cols))
