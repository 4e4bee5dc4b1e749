"""WARC archives through a chunked record table (operator 10).

Payloads travel as rows (row, chunk number, bytes), cut in the JVM, so no
Python worker holds a whole oversized record.  Bodies are never exchanged:

1. Chunks are hashed where they are read, the digest carried from chunk to
   chunk; what comes out is one narrow row per page.
2. Narrow rows decide which record is the response and which revisit it; the
   decisions are stored by the part of the input that they are for.
3. Chunks are read once more and streamed, as they come, into one gzip member
   per record, beside the decisions of that part.  The digest is taken again
   and compared.

The reader streams members back as chunk rows that carry the digest so far.

Archives are files under the shared folder, opened through ``pyarrow.fs`` by
URI.  A writing task names its files uniquely and only successful tasks enter
the manifest, which is a written table; what a lost executor leaves behind is
never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, require, written

#: Payload bytes in a chunk row.
CHUNK = 64 << 10
#: Bytes of an archive, about; a record is never cut.
ARCHIVE_BYTES = 64 << 20
#: Date of records without one.
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """Archive bytes that break the format or fail a digest."""


def stable_rows(pages: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(row, id, url, body): rows numbered where they are read.

    A repeated task, and a second reading, gives a row the same number: tables
    are read in the same parts again, and what comes from an exchange is
    written first.
    """
    require(pages, id_col, url_col, text_col)
    if "Exchange" in pages._jdf.queryExecution().executedPlan().toString():
        pages = written(pages, "pages")
    return pages.select(
        pages[id_col].cast("long").alias("id"),
        F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(pages[text_col].cast("string"), F.lit("")), "UTF-8").alias("body"),
    ).withColumn("row", F.monotonically_increasing_id())


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table (row, id, url, n, chunk_no, data): at least one chunk per row."""
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / chunk).cast("int") - 1)
    return (
        rows.withColumn("n", F.length("body").cast("long"))
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
        .select(
            "row",
            "id",
            # Once a record, however many chunks it has.
            F.when(F.col("chunk_no") == 0, F.col("url")).alias("url"),
            "n",
            "chunk_no",
            F.expr(f"substring(body, chunk_no * {chunk} + 1, {chunk})").alias("data"),
        )
    )


def payload_digests(chunks: DataFrame) -> DataFrame:
    """(row, id, n, sha1): digests carried from chunk to chunk; nothing is exchanged."""

    def run(batches):
        import pyarrow as pa

        row, digest = None, None
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(3)] + [batch.column(3)]
            for i, (own, own_id, n) in enumerate(zip(*columns[:3])):
                if own != row:
                    row, digest, size = own, hashlib.sha1(), 0
                data = columns[3][i].as_buffer()
                digest.update(data)
                size += len(data)
                if size == n:
                    out.append((row, own_id, n, digest.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            own_columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(own_columns, kinds)], names=["row", "id", "n", "sha1"]
            )

    return chunks.select("row", "id", "n", "data").mapInArrow(run, "row long, id long, n long, sha1 string")


def record_plan(digests: DataFrame, smallest: int) -> DataFrame:
    """(row, n, sha1, record, kind, refers): each row's record to be; narrow rows only.

    Of rows with equal payloads of at least ``smallest`` bytes the one with
    the largest id is the response and the others revisit it.  Equal ids with
    equal payloads are alike: both response, or both revisits.  Rows without
    an id revisit a response that has one, or else are responses.
    """
    rows = written(digests, "digests")
    # One row for each payload, however many pages share it; written, so that
    # the join's sides are plain exchanges and a hot payload can be split.
    heads = written(
        rows.filter(F.col("n") >= smallest).groupBy("sha1", "n").agg(F.max("id").alias("head")), "heads"
    )
    known = rows.join(heads, ["sha1", "n"], "left")
    revisit = F.col("head").isNotNull() & ~F.coalesce(F.col("id") == F.col("head"), F.lit(False))
    return known.select(
        "row",
        "n",
        "sha1",
        F.regexp_replace(
            F.md5(F.concat_ws("|", F.col("row").cast("string"), F.col("sha1"))),
            "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
            "$1-$2-$3-$4-$5",
        ).alias("record"),
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("head")).alias("refers"),
    )


#: Bits of a row's number below that of its part.
PART_BITS = 33


def _stored_by_part(plan: DataFrame) -> str:
    """Writes the plan by part of the input, rows in order; returns its folder."""
    path = fresh_path(plan.sparkSession, "plan")
    part = F.shiftrightunsigned("row", PART_BITS).alias("part")
    own = plan.select("*", part).repartition("part").sortWithinPartitions("part", "row")
    own.write.partitionBy("part").parquet(path)
    return path


def _plan_of(path: str, part: int):
    """The stored plan of a part, row after row."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    store, folder = fs.FileSystem.from_uri(f"{path}/part={part}")
    files = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
    for name in sorted(files):  # one file, but for very many rows
        with store.open_input_file(name) as raw:
            for batch in pq.ParquetFile(raw).iter_batches(batch_size=4096):
                yield from batch.to_pylist()


def digest_text(hex_digest: str) -> str:
    """The bare upper-case base32 form of a hex digest."""
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def one_line(text: str) -> str:
    """A header value: control characters become %XX."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def head_bytes(row: dict) -> bytes:
    """WARC and HTTP headers of a record; row holds id, url, n, sha1, ..."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['n']}\r\n\r\n"
    ).encode()
    size = len(http) + row["stored_n"]
    name = "" if row["id"] is None else row["id"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['kind']}",
        f"WARC-Record-ID: <urn:uuid:{row['record']}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(row['url'])}",
        f"WARC-Payload-Digest: sha1:{digest_text(row['sha1'])}",
        f"X-Page-ID: {name}",
    ]
    if row["kind"] == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page: {row['refers']}",
            f"X-Payload-Bytes: {row['n']}",
        ]
    lines += [
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {size}",
        "",
        "",
    ]
    return "\r\n".join(lines).encode() + http


def write_archives(
    pages: DataFrame,
    smallest: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
    path: str | None = None,
    chunk: int = CHUNK,
    level: int = 1,
) -> DataFrame:
    """Writes gzip-compressed WARC files; returns their manifest.

    The manifest (uri, records, bytes, head) is a written table; ``head`` is
    the longest header.  Which rows are revisits is said at
    :func:`record_plan`.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "archives")
    chunks = chunked(stable_rows(pages, id_col, url_col, text_col), chunk)
    plan_path = _stored_by_part(record_plan(payload_digests(chunks), smallest))

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        out = packer = record = digest = plans = None
        name, records, size, longest, done = "", 0, 0, 0, []

        def put(data):
            nonlocal size
            if data:
                out.write(data)
                size += len(data)

        def end_record():
            if digest.hexdigest() != record["sha1"]:
                raise WarcError("the input's rows came in another order the second time")
            put(packer.compress(b"\r\n\r\n") + packer.flush())

        for batch in batches:
            numbers, ids, urls = (batch.column(i).to_pylist() for i in range(3))
            data = batch.column(3)
            for i, number in enumerate(numbers):
                if record is None or number != record["row"]:
                    if record is None:
                        plans = _plan_of(plan_path, number >> PART_BITS)
                    else:
                        end_record()
                    if out is None or size >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                            done.append((f"{path}/{name}", records, size, longest))
                        records, size = 0, 0
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    record = next((p for p in plans if p["row"] == number), None)
                    if record is None:
                        raise WarcError("the input's rows came in another order the second time")
                    response = record["kind"] == "response"
                    records, digest = records + 1, hashlib.sha1()
                    head = head_bytes(record | {"id": ids[i], "url": urls[i], "stored_n": record["n"] if response else 0})
                    longest = max(longest, len(head))
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    put(packer.compress(head))
                own = data[i].as_buffer()
                digest.update(own)
                if response:
                    put(packer.compress(own))
        if out is not None:
            end_record()
            out.close()
            done.append((f"{path}/{name}", records, size, longest))
        columns = list(zip(*done)) if done else [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["uri", "records", "bytes", "head"]
        )

    # A record's chunks come one after the other, and all of a task's are of one part.
    rows = chunks.select("row", "id", "url", "data")
    manifest = rows.mapInArrow(run, "uri string, records long, bytes long, head long")
    where = f"{path}/manifest"
    manifest.write.parquet(where)
    return spark.read.schema(manifest.schema).parquet(where)


class _Source:
    """Bytes of a gzip file with many members, a piece at a time."""

    def __init__(self, stream, piece: int = 256 << 10):
        self.stream, self.piece = stream, piece
        self.inflate = zlib.decompressobj(31)
        self.raw, self.ready = b"", bytearray()

    def fill(self) -> bool:
        """More bytes into ``ready``; False at the end."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.piece)
                if not self.raw:
                    if not self.inflate.eof and self.inflate.unconsumed_tail:
                        raise WarcError("a member is cut off")
                    return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            got = self.inflate.decompress(self.raw, self.piece)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                self.ready += got
                return True

    def until(self, mark: bytes, most: int) -> bytes | None:
        """Bytes up to and with ``mark``, ``most`` at most; None at the end of the file."""
        at = 0
        while (found := self.ready.find(mark, at)) < 0:
            at = max(0, len(self.ready) - len(mark))
            if len(self.ready) > most + self.piece:
                raise WarcError("a header without end")
            if not self.fill():
                if self.ready:
                    raise WarcError("a header is cut off")
                return None
        out = bytes(self.ready[: found + len(mark)])
        del self.ready[: found + len(mark)]
        return out

    def take(self, most: int) -> bytes:
        while not self.ready:
            if not self.fill():
                raise WarcError("a record is cut off")
        out = bytes(self.ready[:most])
        del self.ready[:most]
        return out


#: The longest header of archives written elsewhere.
HEAD_BYTES = 64 << 20


def read_records(stream, chunk: int = CHUNK, longest: int = HEAD_BYTES):
    """(headers, chunk number, bytes, SHA-1 so far, payload size so far, last).

    Each record gives at least one chunk; the digest carries over from chunk
    to chunk and is compared with the record's own at the last.
    """
    source = _Source(stream)
    while (head := source.until(b"\r\n\r\n", longest)) is not None:
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("no WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:] if line)
        left = int(fields["Content-Length"])
        if fields.get("Content-Type", "").startswith("application/http"):
            left -= len(source.until(b"\r\n\r\n", longest))
        digest, size, number, held = hashlib.sha1(), 0, 0, bytearray()
        while left > 0 or number == 0:
            while left > 0 and len(held) < chunk:
                got = source.take(min(left, chunk - len(held)))
                held += got
                left -= len(got)
            data = bytes(held)
            held.clear()
            digest.update(data)
            size += len(data)
            if left == 0:
                own = digest_text(digest.hexdigest())
                named = fields.get("WARC-Payload-Digest", "sha1:" + own)
                if fields["WARC-Type"] == "response" and named != "sha1:" + own:
                    raise WarcError(f"payload digest of {fields.get('WARC-Record-ID')}")
            yield fields, number, data, digest.hexdigest(), size, left == 0
            number += 1
        if source.until(b"\r\n\r\n", longest) != b"\r\n\r\n":
            raise WarcError("a record without end")


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``manifest`` (uri[, head]).

    (record, kind, id, refers, url, chunk_no, data, sha1, n, last, digest):
    ``sha1`` and ``n`` cover the payload up to this chunk, ``digest`` is the
    record's own, ``full`` the payload's size as a revisit names it.  Without
    ``with_data`` the bytes are left out.
    """
    head = F.col("head") if "head" in manifest.columns else F.lit(HEAD_BYTES).cast("long")
    files = manifest.select("uri", head.alias("head")).repartition(max(1, manifest.count()), "uri")
    schema = (
        "record string, kind string, id long, refers long, url string, chunk_no int,"
        " data binary, sha1 string, n long, last boolean, digest string, full long"
    )

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
        names = ["record", "kind", "id", "refers", "url", "chunk_no", "data", "sha1", "n", "last", "digest", "full"]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names
            )

        rows, held = [], 0
        for batch in batches:
            for uri, longest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, where = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(where, compression=None) as stream:
                    for f, number, data, sha1, n, last in read_records(stream, chunk, longest):
                        own, refers = f.get("X-Page-ID", ""), f.get("X-Refers-To-Page", "")
                        rows.append(
                            (
                                f.get("WARC-Record-ID"),
                                f["WARC-Type"],
                                int(own) if own else None,
                                int(refers) if refers else None,
                                f.get("WARC-Target-URI"),
                                number,
                                data if with_data else None,
                                sha1,
                                n,
                                last,
                                f.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
                                int(f["X-Payload-Bytes"]) if "X-Payload-Bytes" in f else None,
                            )
                        )
                        held += len(data) if with_data else 200
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return files.mapInArrow(run, schema)


def archive_pages(
    pages: DataFrame,
    smallest: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) per page.

    Writes the archives and reads them back.  Null texts are empty payloads;
    repeated rows have a record each; other columns are dropped.
    """
    manifest = write_archives(pages, smallest, id_col, url_col, text_col)
    records = read_archives(manifest, with_data=False).filter("last")
    # A revisit has no payload of its own, and names the size of that of its response.
    return records.select(
        "id",
        F.coalesce("full", "n").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers").alias("refers_to"),
    )


def open_archive(spark: SparkSession, uris: list[str]) -> DataFrame:
    """The chunked record table of named archive files."""
    return read_archives(spark.createDataFrame([(u,) for u in uris], "uri string"))
