"""WARC archives of pages, written and read back as a chunked record table.

A page is rows of record and chunk number with WRITE_BYTES of its payload each, so that no writer
holds a record whole; writers stream them into archive files of the shared folder, one file after
the other from FILE_BYTES on, under names of their own attempt. The written table of file names is
what counts, so what a lost task leaves is never read. Readers open an archive as a stream, as many
tasks as there are archives, and give a row for each CHUNK_BYTES of a record's payload, with the
SHA-1 so far and, on the last, of the whole. A payload's record is a response, or a revisit of the
response that has the same payload.

Null html is an empty payload, as is empty text; a table without pages gives no archive and no row.
Null page_ids are archived too; they are never what a revisit refers to, unless no other page has
the payload. Repeated page_ids are records of their own: of several rows with the greatest page_id of
a payload each is a response. page_id is a whole number. Only page_id, url and html are read; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm.common import read, shared_dir, small, table

CHUNK_BYTES, FILE_BYTES = 1 << 18, 64 << 20
#: Bytes of a payload in a row that goes to a writer.
WRITE_BYTES = 1 << 16
REVISIT_BYTES = 1000
_URN = "urn:uuid:"
_SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")


def records(pages: DataFrame, chunk_bytes: int = WRITE_BYTES) -> DataFrame:
    """(page_id, url, refers_to, size, digest, chunk_no, last, chunk): a record's chunks stand together, in order.

    refers_to is the response that a revisit repeats; a revisit has one empty chunk.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"))
    key = F.when(F.col("size") >= REVISIT_BYTES, F.sha2("payload", 256))
    named = own.where(F.col("size") >= REVISIT_BYTES).select(key.alias("key"), "page_id")
    best = named.groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    best = small(table(best.select("key", "first"), "repeated-payloads"), 500_000)
    both = own.withColumn("key", key).join(best, "key", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    both = both.withColumn("refers_to", refers).withColumn("digest", F.sha1("payload"))
    n = F.when(F.col("refers_to").isNull(), F.greatest(F.ceil(F.col("size") / chunk_bytes), F.lit(1))).otherwise(1).cast("int")
    chunk = F.when(F.col("refers_to").isNull(), F.substr("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    both = both.withColumn("chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return both.select("page_id", "url", "refers_to", "size", "digest", "chunk_no", (F.col("chunk_no") == F.col("chunks") - 1).alias("last"), chunk.alias("chunk"))


def record_head(page_id, url, size: int, digest: str, refers_to) -> bytes:
    """Header lines of a record; digest is hexadecimal, in the archive base32 as is the custom."""
    name = lambda x: f"<{_URN}{uuid.uuid5(_SPACE, str(x))}>"
    out = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    out += [f"WARC-Page-ID: {page_id}"] * (page_id is not None)
    if url is not None:
        out.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    out.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    out.append(f"WARC-Payload-Length: {size}")
    if refers_to is not None:
        out += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    out.append(f"Content-Length: {size if refers_to is None else 0}")
    return ("\r\n".join(out) + "\r\n\r\n").encode()


def write_archives(rows: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(path, n_records) of the archives that hold rows; a written table."""
    folder = f"{shared_dir(rows.sparkSession)}/warc-{uuid.uuid4().hex}"
    jvm = rows.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).mkdirs(where)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out, path, n, done = None, "", 0, []
        for b in batches:
            for at in range(0, b.num_rows, 64):
                for row in b.slice(at, 64).to_pylist():
                    if row["chunk_no"] == 0:
                        if out is None or out.tell() >= file_bytes:
                            if out is not None:
                                out.close()
                                done.append((path, n))
                            path, n = f"{root}/{uuid.uuid4().hex}.warc", 0
                            out = store.open_output_stream(path)
                        out.write(record_head(row["page_id"], row["url"], row["size"], row["digest"], row["refers_to"]))
                    out.write(row["chunk"])
                    if row["last"]:
                        out.write(b"\r\n\r\n")
                        n += 1
        if out is not None:
            out.close()
            done.append((path, n))
        paths, counts = zip(*done) if done else ((), ())
        scheme = folder[: folder.index(root)] if root in folder else ""
        yield pa.RecordBatch.from_arrays([pa.array([scheme + p for p in paths], pa.string()), pa.array(counts, pa.int64())], names=["path", "n_records"])

    return table(rows.mapInArrow(write, "path string, n_records long"), "archives")


def read_record(stream, chunk_bytes: int) -> Iterator[tuple[dict, int, bytes, str, bool]]:
    """(header, chunk number, chunk, SHA-1 so far, last) of the record that starts here; none at the end."""
    version = stream.readline()
    if not version:
        return
    if not version.startswith(b"WARC/"):
        raise ValueError(f"not a record: {version[:40]!r}")
    head = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode().partition(":")
        head[name.lower()] = value.strip()
    left, digest, n = int(head["content-length"]), hashlib.sha1(), 0
    while left or not n:
        chunk = stream.read(min(left, chunk_bytes))
        if len(chunk) < min(left, chunk_bytes):
            raise EOFError("archive ends within a record")
        left -= len(chunk)
        digest.update(chunk)
        yield head, n, chunk, digest.hexdigest(), not left
        n += 1
    if stream.read(4) != b"\r\n\r\n":
        raise ValueError("no end of record")


_CHUNKS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, chunk binary, digest_so_far string, last boolean"


def read_archives(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, keep_chunks: bool = True) -> DataFrame:
    """Chunk rows of every record; keep_chunks False leaves their bytes null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pyarrow import fs

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=pa.schema(kinds))

        kinds = [pa.field(a, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for a, t in (x.split() for x in _CHUNKS.split(", "))]
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with io.BufferedReader(store.open_input_stream(at), 1 << 16) as stream:
                    more = True
                    while more:
                        more = False
                        for head, n, chunk, digest, last in read_record(stream, chunk_bytes):
                            more = True
                            stated = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                            if last and head["warc-type"] == "response" and stated != digest:
                                raise ValueError(f"damaged payload of {head['warc-record-id']}")
                            url = head.get("warc-target-uri")
                            url = url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                            rows.append((head["warc-record-id"], number(head.get("warc-page-id")), url, head["warc-type"], number(head.get("warc-refers-to-page-id")), int(head["warc-payload-length"]), stated, n, chunk if keep_chunks else None, digest, last))
                            held += len(chunk) * keep_chunks
                            if len(rows) >= 2000 or held >= 4 << 20:
                                yield pack(rows)
                                rows, held = [], 0
                if rows:
                    yield pack(rows)

    files = archives.select("path").repartition(max(1, archives.count()))  # a task an archive; AQE leaves a given number
    return files.mapInArrow(run, _CHUNKS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(records(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return read_archives(archives, keep_chunks=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
m AS (SELECT d, max(page_id) AS f FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, q.d AS payload_digest, CASE WHEN f IS NULL OR f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to
FROM q LEFT JOIN m ON q.d = m.d AND n >= 1000
"""
