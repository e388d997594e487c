"""WARC archives of web pages: written, normalised, indexed and read back.

Method: pages are written as records into archives that are one gzip stream each. The
normaliser inflates such a stream once from front to back, rewrites every record as a gzip
member of its own and notes where each member lies; with that sidecar index a record is
read without its neighbours.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.common import small, small_lists, stored

# Payload bytes of one archive, about; a larger page is an archive alone.
ARCHIVE_BYTES = 16 << 20
# Payloads below this are never written as revisits.
REVISIT_FROM = 100
# Fixed, so that equal pages give equal archives.
DATE = "2026-01-01T00:00:00Z"
LEVEL = 6
BLOCK = 1 << 20

_GZIP = 16 + zlib.MAX_WBITS
MONOLITHIC = "archive string, data binary"
NORMALISED = "archive string, data binary, members array<struct<offset:bigint,length:bigint>>"
RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary"
)


def with_originals(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html``, ``digest`` and ``original``: the page a revisit refers to.

    Of equal payloads of at least 100 bytes the smallest page_id is the original; rows with
    that same id are no revisits. Counting is done on digests; a hot one is one row after
    the first step of the aggregate, and the join splits its rows.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("_bytes"),
    )
    firsts = stored(
        rows.filter(F.col("_bytes") >= REVISIT_FROM)
        .groupBy("digest")
        .agg(F.min("page_id").alias("original"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    # Only digests that repeat are joined; the pages themselves are shuffled only if those are many.
    joined = rows.join(small(firsts), "digest", "left")
    revisit = F.col("original").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("original")))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("original")).alias("original"))


def record(name: str, page_id: int | None, url: str | None, html: bytes, digest: str, original: int | None) -> bytes:
    """One record; a revisit has the HTTP header alone, which keeps the payload's length."""
    # Control characters would end the header line.
    uri = "".join(f"%{ord(c):02X}" if ord(c) < 0x21 or ord(c) == 0x7F else c for c in url or "urn:none")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: <urn:sha256:{hashlib.sha256(name.encode()).hexdigest()}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if original is None:
        block += html
    else:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-ID: {original}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of the pages of :func:`with_originals`, each one gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def close() -> pa.RecordBatch:
            out.append(stream.flush())
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part:06d}-{number:06d}"]), pa.array([b"".join(out)], pa.binary())], names=["archive", "data"]
            )

        stream, out, held, n = None, [], 0, 0
        for batch in batches:
            for page_id, url, html, digest, original in zip(*batch.columns):
                if stream is None:
                    stream, out, held, n = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP), [], 0, 0
                payload = html.as_buffer().to_pybytes()
                name = f"{part}-{number}-{n}"
                out.append(stream.compress(record(name, page_id.as_py(), url.as_py(), payload, digest.as_py(), original.as_py())))
                held, n = held + len(payload), n + 1
                if held >= archive_bytes:
                    yield close()
                    stream, number = None, number + 1
        if stream is not None:
            yield close()

    return pages.select("page_id", "url", "html", "digest", "original").mapInArrow(run, MONOLITHIC)


def inflated(data: pa.Buffer) -> Iterator[bytes]:
    """Content of a gzip file in blocks, whatever members it has; a cut one is an error."""
    view, at = memoryview(data), 0
    while at < len(view):
        stream = zlib.decompressobj(_GZIP)
        while not stream.eof:
            given = stream.unconsumed_tail
            if not given:
                given = view[at : at + BLOCK]
                at += len(given)
            block = stream.decompress(given, BLOCK)
            if not block and not len(given) and not stream.eof:
                raise ValueError("the archive ends inside a gzip member")
            yield block
        at -= len(stream.unused_data)


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, with the two line ends after each, from content in blocks."""
    held = bytearray()
    need = None
    for block in blocks:
        held += block
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def normalise(archives: DataFrame) -> DataFrame:
    """Archives with a gzip member per record, and where each member lies.

    Takes any ``archive``, ``data`` rows of gzip files, of one member or several; an empty
    file has no records, a cut or damaged one is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                out, index, offset = [], [], 0
                for one in split_records(inflated(data.as_buffer())):
                    stream = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
                    member = stream.compress(one) + stream.flush()
                    index.append({"offset": offset, "length": len(member)})
                    out.append(member)
                    offset += len(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()]), pa.array([b"".join(out)], pa.binary()), pa.array([index], members)],
                    names=["archive", "data", "members"],
                )

    return archives.select("archive", "data").mapInArrow(run, NORMALISED)


def sidecar(normalised: DataFrame) -> DataFrame:
    """The offset index: archive, record number, offset and length of every member.

    Only the column of the members is read.
    """
    return normalised.select("archive", F.posexplode("members").alias("record", "member")).select(
        "archive", "record", "member.offset", "member.length"
    )


def indexed(archives: DataFrame, index: DataFrame) -> DataFrame:
    """``archive``, ``data`` and the ``members`` that the index has of it, in order of their records.

    The members of one archive are few (an archive has about ARCHIVE_BYTES), so a list.
    """
    member = F.struct("record", "offset", "length")
    lists = index.groupBy("archive").agg(F.sort_array(F.collect_list(member)).alias("members"))
    return archives.select("archive", "data").join(small_lists(stored(lists), "members"), "archive")


def read_records(archives: DataFrame, index: DataFrame) -> DataFrame:
    """The records that ``index`` has (all, or those looked for), each by its member alone.

    Digest and length of a response are taken anew; nothing else of an archive is inflated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
            ]
        )
        for batch in batches:
            for data, members in zip(batch.column(0), batch.column(1)):
                view, rows, held = memoryview(data.as_buffer()), [], 0
                for member in members.as_py():
                    rows.append(parsed(zlib.decompress(view[member["offset"] : member["offset"] + member["length"]], _GZIP)))
                    held += rows[-1]["payload_bytes"]
                    if held >= BLOCK:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return indexed(archives, index).select("data", "members").mapInArrow(run, RECORDS)


def parsed(one: bytes) -> dict:
    head, _, rest = one.partition(b"\r\n\r\n")
    fields = headers(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    page_id, original = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return {
        "page_id": None if page_id is None else int(page_id),
        "url": fields["warc-target-uri"],
        "record_type": kind,
        "refers_to": None if original is None else int(original),
        "payload_bytes": len(payload) if kind == "response" else int(headers(http)["content-length"]),
        "payload_digest": (
            hashlib.sha256(payload).hexdigest() if kind == "response" else fields["warc-payload-digest"].removeprefix("sha256:")
        ),
        "payload": payload if kind == "response" else None,
    }


def archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised archives of ``pages`` (``page_id``, ``url``, ``html``) and their sidecar index.

    Two tables in the shared folder: ``archive``, ``data`` and ``archive``, ``record``, ``offset``,
    ``length``. A null html is an empty payload, a null url stands as ``urn:none``, a null page_id
    is read back as null and never an original. A page of any length is one record, larger
    than ARCHIVE_BYTES an archive alone. Repeated rows are records each. Other columns are
    ignored; an empty table has no archives.
    """
    normalised = stored(normalise(stored(write_monolithic(with_originals(pages)))))
    return normalised.select("archive", "data"), stored(sidecar(normalised))


def save_files(archives: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """Write each archive as ``NAME.warc.gz`` with ``NAME.idx`` into a folder every executor mounts.

    Returns the paths and bytes; a task that runs again replaces its files as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, data, members in zip(*batch.columns):
                path = os.path.join(folder, name.as_py())
                lines = "".join(f"{m['offset']} {m['length']}\n" for m in members.as_py()).encode()
                for file, content in ((f"{path}.warc.gz", data.as_buffer()), (f"{path}.idx", lines)):
                    part = f"{file}.{TaskContext.get().taskAttemptId()}"
                    with open(part, "wb") as out:
                        out.write(content)
                    os.replace(part, file)
                yield pa.RecordBatch.from_pylist([{"path": f"{path}.warc.gz", "bytes": data.as_buffer().size}])

    rows = indexed(archives, index).select("archive", "data", "members")
    return rows.mapInArrow(run, "path string, bytes bigint")
