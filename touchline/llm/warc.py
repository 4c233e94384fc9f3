"""WARC archives: monolithic gzip files in, one gzip member per record and an offset index out.

Capture: every task writes its pages into archives that are one gzip stream
each, as crawlers that do not flush per record leave them. Such a file can only
be read from its start. The normaliser inflates each stream once, in pieces,
rewrites every record as a gzip member of its own, and writes a sidecar index
with the offset and length of each member, so that a record is one seek away.

On the way it turns records whose payload another record holds into revisits.
Which record keeps the payload is decided on the manifest, whose rows are small:
no payload is shuffled.

Archives are named by task attempt. Only those in the manifest count, so a
repeated or lost task leaves nothing behind that is read. All files lie in the
shared folder; every store that pyarrow opens by URI will do.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.store import materialize, shared_folder

ROLL_BYTES = 64 << 20
PIECE = 1 << 18
CAPTURE_LEVEL, MEMBER_LEVEL = 1, 4
DATE = "2024-01-01T00:00:00Z"

# The revisit profile of the format, and line ends.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"

MANIFEST = "archive string, archive_no long, seq long, page_id long, payload_bytes long, digest string"
INDEX = (
    "archive string, offset long, length long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    """A header value without control characters."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(kind: str, record_id: str, page_id, url, digest: str, size: int, payload: bytes | None, refers_to=None, refers_id: str = "") -> bytes:
    """One record; a revisit has the HTTP headers only, which tell the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {one_line(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers_id}>"]
        head += [f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    head += [f"Content-Length: {len(block)}"]
    return b"WARC/1.1" + END + END.join(h.encode() for h in head) + END + END + block + END + END


def record_id(archive_no: int, seq: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_OID, f"{archive_no}:{seq}"))


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.split(END)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no record starts with {lines[0][:40]!r}")
    return {k.strip().decode().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines[1:] if line)}


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip stream, inflated piece by piece; one record is held at a time."""
    inflate, held = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal inflate
        while True:
            piece = stream.read(PIECE)
            if not piece:
                return False
            while piece:
                held.extend(inflate.decompress(piece))
                piece = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
            if held:
                return True

    while held or more():
        while (at := held.find(END + END)) < 0:
            if not more():
                raise ValueError("the archive ends inside a record")
        head = parse_head(bytes(held[:at]))
        end = at + 4 + int(head["content-length"])
        while len(held) < end + 4:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(held[at + 4 : end])
        del held[: end + 4]


def capture(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write every page as a response record into monolithic archives; returns the manifest, one row per record.

    Archives roll over at `roll_bytes` of records, heads included, which bounds
    what one normaliser task handles, also where payloads are empty; a single
    larger page makes a larger archive.
    """

    def work(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/raw", recursive=True)
        context = TaskContext.get()
        number, out, rows = context.partitionId() << 20, None, []

        def close():
            out.write(deflate.flush())
            out.close()

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if out is None:
                    name = f"raw/{number:014d}-{context.taskAttemptId()}.warc.gz"
                    out, deflate, seq, size = store.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(CAPTURE_LEVEL, zlib.DEFLATED, 31), 0, 0
                payload = (html or "").encode()
                digest = payload_digest(payload)
                whole = record("response", record_id(number, seq), page_id, url, digest, len(payload), payload)
                out.write(deflate.compress(whole))
                rows.append((name, number, seq, page_id, len(payload), digest))
                seq, size = seq + 1, size + len(whole)
                if size >= roll_bytes:
                    close()
                    out, number = None, number + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), MANIFEST_TYPES, strict=True)], MANIFEST_NAMES)
                rows = []
        if out is not None:
            close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return materialize(rows.mapInArrow(work, MANIFEST))


MANIFEST_NAMES = ["archive", "archive_no", "seq", "page_id", "payload_bytes", "digest"]
MANIFEST_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
INDEX_NAMES = ["archive", "offset", "length", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def with_revisits(manifest: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The manifest with keeper_no, keeper_seq, keeper_page: where the payload stays, null for records that keep their own.

    Of equal payloads of at least `least_bytes`, the record of the largest
    page_id keeps it (null ids last; of repeated ids the last written).
    """
    place = F.struct("page_id", "archive_no", "seq")
    large = manifest.filter(F.col("payload_bytes") >= least_bytes)
    keepers = large.groupBy("digest", "payload_bytes").agg(F.max(place).alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = manifest.join(keepers, ["digest", "payload_bytes"], "left")
    other = (F.col("keeper.archive_no") != F.col("archive_no")) | (F.col("keeper.seq") != F.col("seq"))
    return joined.select(
        *MANIFEST_NAMES, *[F.when(other, F.col(f"keeper.{c}")).alias(n) for c, n in (("archive_no", "keeper_no"), ("seq", "keeper_seq"), ("page_id", "keeper_page"))],
    )


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with one gzip member per record and a sidecar index; returns the index, one row per record.

    A group holds the manifest rows of one archive, which `roll_bytes` bounds.
    """

    def work(group: pa.Table) -> pa.Table:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/warc", recursive=True)
        plan = {row["seq"]: row for row in group.to_pylist()}
        first = next(iter(plan.values()))
        name = f"warc/{first['archive_no']:014d}-{TaskContext.get().taskAttemptId()}.warc.gz"
        rows, offset = [], 0
        with store.open_input_stream(f"{root}/{first['archive']}", compression=None) as raw, store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for seq, (head, block) in enumerate(records(raw)):
                row = plan[seq]
                payload = block[block.index(END + END) + 4 :]
                kind = "response" if row["keeper_no"] is None else "revisit"
                keeper = "" if row["keeper_no"] is None else record_id(row["keeper_no"], row["keeper_seq"])
                member = record(
                    kind, head["warc-record-id"][10:-1], row["page_id"], head.get("warc-target-uri"), row["digest"], len(payload),
                    payload if kind == "response" else None, row["keeper_page"], keeper,
                )
                deflate = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
                packed = deflate.compress(member) + deflate.flush()
                out.write(packed)
                rows.append((name, offset, len(packed), row["page_id"], len(payload), row["digest"], kind, row["keeper_page"]))
                offset += len(packed)
        if len(rows) != len(plan):
            raise ValueError(f"{first['archive']} has {len(rows)} records, the manifest {len(plan)}")
        with store.open_output_stream(f"{root}/{name}.idx", compression=None) as side:
            for r in rows:
                side.write(f"{r[1]} {r[2]} {r[6]} {r[5]} {'-' if r[3] is None else r[3]}\n".encode())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), INDEX_TYPES, strict=True)], INDEX_NAMES)

    return materialize(manifest.groupBy("archive_no").applyInArrow(work, INDEX))


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """The index as the `.idx` files beside the archives tell it: archive, offset, length, record_type, payload_digest, page_id.

    An archive is thus usable without the table that `normalise` returns.
    """
    lines = spark.read.text(f"{folder}/warc/*.idx").select("value", F.col("_metadata.file_name").alias("file"))
    part = F.split("value", " ")
    return lines.select(
        F.concat(F.lit("warc/"), F.expr("substring(file, 1, length(file) - 4)")).alias("archive"), part[0].cast("long").alias("offset"),
        part[1].cast("long").alias("length"), part[2].alias("record_type"), part[3].alias("payload_digest"), F.nullif(part[4], F.lit("-")).cast("long").alias("page_id"),
    )


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as the archives themselves tell.

    Each record is one seek by the index. A response's digest and length are
    taken from its payload, a revisit's from its headers.
    """

    def work(batches):
        store, root = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, store.open_input_file(f"{root}/{archive}")
                file.seek(offset)
                member = zlib.decompress(file.read(length), 31)
                at = member.index(END + END)
                head, block = parse_head(member[:at]), member[at + 4 : -4]
                http = block.index(END + END)
                payload = block[http + 4 :]
                page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
                kind, digest = head["warc-type"], head["warc-payload-digest"][5:]
                if kind == "response":
                    size = len(payload)
                    if payload_digest(payload) != digest:
                        raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                else:
                    size = int(parse_head(b"WARC/" + END + block[:http].partition(END)[2])["content-length"])
                rows.append((None if page is None else int(page), size, digest, kind, None if refers is None else int(refers)))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file is not None:
            file.close()

    rows = index.select("archive", "offset", "length")
    return rows.mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> tuple[DataFrame, str]:
    """Capture and normalise `pages` (page_id, url, html); returns the index and the folder with the archives.

    Null html is an empty payload, a null url has no target header, a null
    page_id no id header; repeated rows are records of their own. Other columns
    are not looked at. No rows give no archives and an empty index.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/touchline/warc-{uuid.uuid4().hex}"
    manifest = capture(pages, folder, roll_bytes)
    return normalise(with_revisits(manifest, least_bytes), folder), folder
