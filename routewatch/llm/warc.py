"""WARC archives: monolithic gzip files, their normaliser, and reading by the offset index.

Pages are first written as monolithic archives, each one gzip stream over many records, as crawlers
and bulk tools leave them; such a file can be read from its start only. The normaliser inflates each
stream once, in pieces of bounded size, writes every record as a gzip member of its own, and beside
the archive an index (Parquet) with each record's offset and length. Readers then fetch members by it.

Tasks write under names of their own and report them in a manifest, which is a written table; what
failed or repeated attempts leave behind is not in it.
"""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import file_system, one_row_per_salt, salt_bit, salt_of, shared_folder, written

CRLF = b"\r\n"
GZIP, PIECE = 31, 1 << 20
#: Bytes of records after which a task goes on in a new archive.
ARCHIVE_BYTES = 256 << 20
MANIFEST = "archive string, index_file string, n_records long, n_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long, archive string"


def roles(pages: DataFrame, min_bytes=0) -> DataFrame:
    """page_id, url, html of every row with the first page_id of its payload: first_id.

    A payload's digest groups are combined in the map tasks, merged by salt and then whole, and go
    back to the pages by digest and salt, so a payload that a third of the pages share is split.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumns({"digest": F.unhex(F.sha2("html", 256)), "salt": salt_of("page_id")})
    salted = rows.groupBy("digest", "salt").agg(F.min("page_id").alias("first_id"))
    firsts = salted.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.bit_or(salt_bit(F.col("salt"))).alias("salts"))
    small = F.octet_length("html") < min_bytes
    return rows.join(one_row_per_salt(firsts), ["digest", "salt"]).select(
        "page_id", "url", "html", F.when(small, F.col("page_id")).otherwise(F.col("first_id")).alias("first_id"))


def record(page_id, url, html: str, first_id) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the first page."""
    payload = html.encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    revisit = first_id != page_id
    # the HTTP head keeps the payload's length, in revisits too
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"),
             b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")).encode(),
             b"WARC-Date: 1970-01-01T00:00:00Z",
             b"Content-Type: application/http; msgtype=response",
             b"WARC-Payload-Digest: sha1:" + digest]
    if page_id is not None:
        lines.append(b"X-Page-ID: %d" % page_id)
    if url is not None:
        lines.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass"))
    if revisit:
        lines += [b"X-Refers-To-Page-ID: %d" % first_id,
                  b"WARC-Refers-To: <urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{first_id}")).encode(),
                  b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(b"Content-Length: %d" % len(block))
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def parsed(data: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(CRLF * 2)
    lines = head.split(CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(b":") for line in lines[1:])}
    return headers, rest[:int(headers[b"content-length"])]


def write_monolithic(pages: DataFrame, folder: str | None = None, min_bytes=0) -> DataFrame:
    """Write every page into archives that are one gzip stream each; returns their manifest.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id is
    the response and the others revisit it; smaller ones are all responses. Null html is an empty
    payload. Rows repeated with one page_id are records each and all responses if theirs is the
    smallest; rows without page_id are revisits if any row with one has the payload. An empty table
    gives an empty manifest; other columns are not read.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")

    def write(parts):
        files, root = file_system(folder)
        out = packer = path = None
        size = n = 0

        def closed():
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_pylist([{"archive": path, "index_file": None, "n_records": n, "n_bytes": size}], schema=_arrow(MANIFEST))

        for part in parts:
            for row in part.to_pylist():
                if out is None:
                    files.create_dir(root, recursive=True)
                    name = f"mono-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    path, out, packer, size, n = f"{folder}/{name}", files.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, 0
                data = record(row["page_id"], row["url"], row["html"], row["first_id"])
                out.write(packer.compress(data))
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(roles(pages, min_bytes).mapInArrow(write, MANIFEST), "warc-monolithic")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def inflated(stream):
    """The content of a gzip stream, of one member or several, in pieces of bounded size."""
    inflate, rest = zlib.decompressobj(GZIP), b""
    while rest or (rest := stream.read(PIECE)):
        if inflate.eof:
            inflate = zlib.decompressobj(GZIP)
        yield inflate.decompress(rest, PIECE)
        rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
    yield inflate.flush()
    if not inflate.eof:
        raise ValueError("the gzip stream is cut short")


def records_of(stream):
    """The records of a gzip stream, inflated once from its start."""
    held, need = bytearray(), None
    for piece in inflated(stream):
        held += piece
        at = 0
        while True:
            if need is None:
                end = held.find(CRLF * 2, at)
                if end < 0:
                    break
                headers, _ = parsed(bytes(held[at:end]) + CRLF * 2)
                need = end - at + 4 + int(headers[b"content-length"]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at:at + need])
            at, need = at + need, None
        del held[:at]
    if held:
        raise ValueError("the last record is cut short")


def normalise(manifest: DataFrame, folder: str | None = None) -> DataFrame:
    """Rewrite each monolithic archive with a gzip member per record and an index beside it; returns the manifest.

    One task per archive, whose size is bounded where it is written. The index has one row per record:
    offset and length of its member, its type, page_id and payload digest.
    """
    spark = manifest.sparkSession
    folder = folder or shared_folder(spark, "warc-members")
    archives = manifest.count()

    def rewrite(parts):
        for part in parts:
            for row in part.to_pylist():
                source_files, source = file_system(row["archive"])
                files, root = file_system(folder)
                files.create_dir(root, recursive=True)
                stem = f"warc-{uuid.uuid4().hex}"
                index, offset = [], 0
                with source_files.open_input_stream(source, compression=None) as stream, \
                        files.open_output_stream(f"{root}/{stem}.warc.gz", compression=None) as out:
                    for data in records_of(stream):
                        packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = packer.compress(data) + packer.flush()
                        out.write(member)
                        index.append((offset, len(member)))
                        offset += len(member)
                with files.open_output_stream(f"{root}/{stem}.index") as out:
                    pq.write_table(pa.table({"offset": pa.array([o for o, _ in index], pa.int64()), "length": pa.array([n for _, n in index], pa.int64())}), out)
                yield pa.RecordBatch.from_pylist([{"archive": f"{folder}/{stem}.warc.gz", "index_file": f"{folder}/{stem}.index",
                                                   "n_records": len(index), "n_bytes": offset}], schema=_arrow(MANIFEST))

    if not archives:
        return manifest
    return written(manifest.repartition(min(archives, 10_000)).mapInArrow(rewrite, MANIFEST), "warc-normalised")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record, fetched by the index: page_id, payload_bytes, payload_digest, record_type, refers_to, offset, length, archive.

    A response's payload is measured and digested again; if that is not what its header says, it raises.
    """
    archives = manifest.count()

    def read(parts):
        for part in parts:
            for row in part.to_pylist():
                files, path = file_system(row["archive"])
                with files.open_input_file(file_system(row["index_file"])[1]) as source:
                    index = pq.read_table(source)
                places = list(zip(index["offset"].to_pylist(), index["length"].to_pylist()))
                with files.open_input_file(path) as source:
                    for at in range(0, len(places), 1000):
                        found = [_row(source.read_at(n, o), o, n, row["archive"]) for o, n in places[at:at + 1000]]
                        yield pa.RecordBatch.from_pylist(found, schema=_arrow(RECORDS))

    if not archives:
        return manifest.sparkSession.createDataFrame([], RECORDS)
    return manifest.repartition(min(archives, 10_000)).mapInArrow(read, RECORDS)


def _row(member: bytes, offset: int, length: int, archive: str) -> dict:
    headers, block = parsed(zlib.decompress(member, GZIP))
    head, _, payload = block.partition(CRLF * 2)
    said = next(int(v) for k, _, v in (line.partition(b":") for line in head.split(CRLF)) if k.lower() == b"content-length")
    digest = headers[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
    kind = headers[b"warc-type"].decode()
    if kind == "response" and (len(payload) != said or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload is not what its header says")
    number = lambda name: int(headers[name]) if name in headers else None
    return {"page_id": number(b"x-page-id"), "payload_bytes": said, "payload_digest": digest, "record_type": kind,
            "refers_to": number(b"x-refers-to-page-id"), "offset": offset, "length": length, "archive": archive}
