"""WARC archives with an index written first, and reads of selected records as coalesced sorted byte ranges.

write_archives() lays each partition of the pages into one archive file of gzip members, one member a record, and returns
the index: file, offset, length, url, digest and kind of each record. The index is a written table, so archives are made
once. Every attempt of a task writes a file of its own name, which its index rows carry; the index keeps the rows of one
attempt, and files of other attempts, which no row names, are deleted afterwards. So a lost executor or a speculative copy
never changes a file that the index describes.
read_records() takes any selection of index rows, sorts it by file and offset, joins ranges that touch or lie close
together into one read, and returns the records it finds there, checked against their digests.

Of records with equal payloads the one with the largest page_id is a response; the others revisit it. Only (page_id,
digest) pairs are shuffled to find them, after a partial aggregate, so a payload that many pages share is no task's burden;
the list of revisits then meets the pages by page_id, broadcast only if it has at most FEW rows.

Defined results: null html is an empty payload; a null url becomes `urn:page:<id>`, line breaks in a url are escaped;
a null page_id is written as a response of its own and refers to nothing; repeated rows with one page_id and payload are
all responses if theirs is the largest page_id of the payload, else all revisits; a very long html is one record, held
whole by its task; an empty table gives no archive and an empty index; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import new_path, parts, pieces, ready, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GAP, SPAN = 64 << 10, 8 << 20
FEW = 200_000  # revisits, of about 50 bytes each, that may be broadcast
_INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, sha: str, refers_to: int | None, target: str | None = None) -> bytes:
    """One WARC record, not yet compressed. A revisit carries no payload, only its size and digest."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"record:{page_id}:{sha}:{url}")
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page: {refers_to}", *([f"WARC-Refers-To-Target-URI: {target}"] if target else [])]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length doesn't match its header")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def _deflate(raw: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


def _open(url: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, refers_to): pages with the record each will become."""
    ready(pages.sparkSession)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            sha = [digest((h or "").encode()) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sha, pa.string())], ["page_id", "url", "html", "payload_digest"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(name, "page_id long, url string, html string, payload_digest string")
    named = written(own.filter("page_id is not null").select("page_id", "payload_digest").distinct(), "digests")
    heads = named.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = written(named.join(heads, "payload_digest").filter("page_id < refers_to"), "revisits")
    if revisits.count() <= FEW:
        revisits = F.broadcast(revisits)
    return own.join(revisits, ["page_id", "payload_digest"], "left").select("page_id", "url", "html", "payload_digest", "refers_to")


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages into archives under `folder` (default: the shared folder), which is new; returns the index."""
    spark = ready(pages.sparkSession)
    folder = folder or new_path(spark, "warc")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        task = TaskContext.get()
        file = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        rows, at, out = [], 0, None
        for batch in pieces(batches, "html"):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{file}", compression=None)
            for page, url, html, sha, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")), strict=True):
                payload = (html or "").encode()
                target = (url or f"urn:page:{page}").replace("\r", "%0D").replace("\n", "%0A")
                member = _deflate(record(page, target, payload, sha, refers))
                out.write(member)
                rows.append((page, target, sha, len(payload), "response" if refers is None else "revisit", refers, file, at, len(member)))
                at += len(member)
        if out is not None:
            out.close()
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in _INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    index = written(plan_records(pages).mapInArrow(lay, _INDEX), "warc-index")
    _drop_unnamed(folder, {r[0] for r in index.select("file").distinct().collect()})  # a name for each task
    return index.withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


def _drop_unnamed(folder: str, names: set[str]) -> None:
    """Delete the archives of attempts that the index doesn't hold."""
    fs, root = _open(folder)
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith("part-") and info.base_name not in names:
            fs.delete_file(info.path)


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) pairs as (first, end, number of ranges) reads, none longer than `span` unless one range is."""
    out: list[tuple[int, int, int]] = []
    for offset, length in ranges:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= span:
            first, end, n = out[-1]
            out[-1] = (first, max(end, offset + length), n + 1)
        else:
            out.append((offset, offset + length, 1))
    return out


def read_records(index: DataFrame, bodies: bool = False) -> DataFrame:
    """The records of the selected index rows: page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload].

    payload_bytes and payload_digest of a response are taken from the payload read; a mismatch with its header is an error.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream, fs = None, None, None
        for batch in batches:
            rows, names = [], batch.column("file").to_pylist()
            spots = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
            a = 0
            while a < len(names):
                b = a
                while b < len(names) and names[b] == names[a]:
                    b += 1
                if names[a] != file:
                    file = names[a]
                    fs, path = _open(file)
                    stream = fs.open_input_file(path)
                k = a
                for first, end, n in coalesce(spots[a:b]):
                    block = stream.read_at(end - first, first)
                    for offset, length in spots[k : k + n]:
                        fields, payload = parse(zlib.decompress(block[offset - first : offset - first + length], 31))
                        rows.append(_row(fields, payload))
                    k += n
                a = b
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            cols = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(zip(*rows, strict=True), kinds, strict=True))[: 6 + bodies]], cols[: 6 + bodies])

    def _row(fields: dict[str, str], payload: bytes) -> tuple:
        sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(fields["X-Payload-Length"])
        response = fields["WARC-Type"] == "response"
        if response and (digest(payload) != sha or len(payload) != size):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
        page, refers = fields["X-Page-ID"], fields.get("WARC-Refers-To-Page")
        return (int(page) if page else None, fields["WARC-Target-URI"], fields["WARC-Type"], int(refers) if refers else None, size, sha, payload if response else None)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * bodies
    # a run of neighbouring ranges to each task; even a single large archive is read by several
    spread = index.select("file", "offset", "length").repartitionByRange(parts(index), "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInArrow(fetch, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    return read_records(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def archive_bytes(index: DataFrame, file: str) -> io.BytesIO:
    """One whole archive, for a look at it."""
    fs, path = _open(file)
    with fs.open_input_file(path) as f:
        return io.BytesIO(f.read())
