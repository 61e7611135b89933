"""WARC archives: a parallel writer and a splittable reader.

Each record is a gzip member of its own. The reader's tasks scan byte ranges of the archives for gzip's magic bytes:
Spark's text reader cuts files at any byte string, so with the magic as separator each task gets what starts inside
its range, in any store that Spark can read. The magic also occurs inside compressed data, so every piece is a
candidate only: a piece starts a member if its header decodes and its data inflate to a WARC version line; otherwise it
continues the member before it. A member that a range's end cuts is put together again from what the next range
found before its first member.

Archive files have no ``.gz`` in their names: by that name Hadoop would inflate them as one stream that cannot be split.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
#: Payloads below this size are always stored whole.
REVISIT_BYTES = 1000
LEVEL = 4
#: Records, and bytes of their payloads, that a task holds before it passes them on.
BATCH_RECORDS, BATCH_BYTES = 1000, 8 << 20
BROADCAST_GROUPS = 100_000
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member; it ends in a zero byte.
PADDING = bytes.fromhex("1f8b08000000000000ff0300") + b"\0" * 8


# -- writing


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (binary), payload_digest (hex SHA-1), record_type, refers_to.

    Of equal payloads of ``least`` bytes and more, the one with the largest page_id is the response and the others
    revisit it. Null html: empty payload. Null ids are below all others; rows that share the largest id, repeated rows
    among them, are all responses. Other columns are ignored; an empty table gives no rows."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    groups = cut(own.filter(large).groupBy(F.col("payload_digest").alias("of")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    joined = own.join(small(groups, BROADCAST_GROUPS), (F.col("payload_digest") == F.col("of")) & large, "left")
    revisits = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first")).alias("refers_to"))


def record(kind: str, page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One WARC record. The HTTP header tells the length of the full payload in a revisit too, which has no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(content: bytes, level: int = LEVEL) -> bytes:
    """A gzip member (and an empty one after it where needed) that ends in a zero byte."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(content) + z.flush()
    return out if out[-1] == 0 else out + PADDING


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> None:
    """One archive a task under ``path``, through Spark's committer: a lost task is run again, none is written twice.

    Spark's text writer ends each row by a separator; that is the zero byte in which each member ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, payloads, digests, kinds, refers = (batch.column(i) for i in range(6))
            members = [member(record(kinds[i].as_py(), ids[i].as_py(), urls[i].as_py(), payloads[i].as_py(), digests[i].as_py(), refers[i].as_py()))[:-1] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])

    with_revisits(pages, id_col, url_col, html_col, least).mapInArrow(run, "member binary").select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


# -- reading


class Member:
    """A gzip member that is being put together from pieces."""

    def __init__(self) -> None:
        self.inflate, self.raw, self.content = zlib.decompressobj(31), [], []

    def feed(self, data: bytes) -> None:
        self.raw.append(data)
        if not self.inflate.eof:
            self.content.append(self.inflate.decompress(data))

    @property
    def whole(self) -> bool:
        return self.inflate.eof


def starts_member(piece: bytes) -> bool | None:
    """Whether ``piece`` (from the magic on) is the head of a WARC record or an empty member; None: too short to tell."""
    z = zlib.decompressobj(31)
    try:
        head = z.decompress(piece, 8)
    except zlib.error:
        return False
    if z.eof and not head:
        return True
    if len(head) >= 5:
        return head.startswith(b"WARC/")
    return None if b"WARC/".startswith(head) and not z.eof else False


def assembled(pieces: Iterable[bytes], orphans: list[bytes], doubtful: bool = False) -> Iterator[Member]:
    """Members, in order, from pieces that each begin with the magic; ``orphans`` gets the pieces before the first.
    The last member may not be whole. ``doubtful``: the first may be too short to tell that it starts a member."""
    current: Member | None = None
    for piece in pieces:
        start = starts_member(piece)
        if current is None and start is not True and not (doubtful and start is None):
            orphans.append(piece)
            continue
        if current is not None:
            if start is True or (current.whole and start is None):
                yield current
            else:
                try:
                    current.feed(piece)
                except zlib.error as broken:
                    raise ValueError("damaged gzip member") from broken
                continue
        current = Member()
        current.feed(piece)
    if current is not None:
        yield current


def parsed(content: bytes, verify: bool = False) -> dict[str, object]:
    """record_type, record_id, target_uri, payload_bytes, payload_digest, refers_to, payload of one record.
    ``verify``: a response whose payload has not the SHA-1 that its header gives is an error."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(field["content-length"])]
    payload, size = block, len(block)
    if "application/http" in field.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if field.get("warc-type") == "revisit" and (m := re.search(rb"(?im)^content-length:\s*(\d+)", http)):
            size = int(m[1])
    of = lambda name: field[name].strip("<>") if name in field else None
    digest = field.get("warc-payload-digest", "").removeprefix("sha1:")
    if verify and field.get("warc-type") == "response" and (own := hashlib.sha1(payload).hexdigest()) != digest:
        raise ValueError(f"payload of {of('warc-record-id')} has SHA-1 {own}, its header says {digest or 'none'}")
    return {"record_type": field.get("warc-type"), "record_id": of("warc-record-id"), "target_uri": field.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest or None, "refers_to": of("warc-refers-to"), "payload": payload}


FIELDS = [("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
_OUT = pa.schema([("path", pa.string()), ("at", pa.int64()), ("nth", pa.int32()), ("left", pa.binary()), *FIELDS])
_SQL = "path string, at long, nth int, left binary, record_type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def _records(contents: Iterable[bytes], path: str, at: int, payloads: bool, verify: bool) -> list[dict[str, object]]:
    return [{"path": path, "at": at} | (r if payloads else r | {"payload": None}) for r in (parsed(c, verify) for c in contents)]


def read_archives(spark: SparkSession, path: str, payloads: bool = True, verify: bool = False) -> DataFrame:
    """Every record of the archives under ``path``: record_type, record_id, target_uri, payload_bytes,
    payload_digest, refers_to, payload (null unless ``payloads``).

    A task owns the records that start in its byte range. Payload length and digest of a revisit are those of the
    full payload, as its header says. Empty members are skipped; a damaged one raises, and with ``verify`` (digests in
    hex) a response whose payload and digest differ. No archive: no rows.
    """
    scan = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    pieces = scan.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[tuple[str, int], bytes]]:
            for batch in batches:
                yield from zip(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()), batch.column(0).to_pylist())

        from itertools import groupby

        for (file, at), own in groupby(rows(), key=lambda r: r[0]):
            texts = (p for _, p in own)
            if at == 0:  # what stands before the file's first magic
                if next(texts, b""):
                    raise ValueError(f"{file} does not begin with a gzip member")
            orphans: list[bytes] = []
            found, held, left = [], 0, b""
            for m in assembled((MAGIC + p for p in texts), orphans):
                if not m.whole:
                    left = b"".join(m.raw)
                elif content := b"".join(m.content):
                    found += _records([content], file, at, payloads, verify)
                    held += len(content) if payloads else 0
                if len(found) >= BATCH_RECORDS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(found, _OUT)
                    found, held = [], 0
            ends = [{"path": file, "at": at, "nth": n, "left": x} for n, x in enumerate([*orphans, *([left] if left else [])])]
            yield pa.RecordBatch.from_pylist(found + ends, _OUT)

    def join_ends(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["at", "nth", "left"]).to_pylist(), key=lambda r: (r["at"], r["nth"]))
        orphans: list[bytes] = []
        members = list(assembled((r["left"] for r in rows), orphans, doubtful=True))
        if orphans or not all(m.whole for m in members):
            raise ValueError(f"damaged gzip member in {key[0]}")
        return pa.Table.from_pylist(_records([c for m in members if (c := b"".join(m.content))], key[0].as_py(), 0, payloads, verify), _OUT)

    read = cut(pieces.mapInArrow(run, _SQL))
    ends = read.filter(F.col("left").isNotNull()).groupBy("path").applyInArrow(join_ends, _SQL)
    return read.filter(F.col("left").isNull()).unionByName(ends).select(*(n for n, _ in FIELDS))


def page_id_of(urn: Column) -> Column:
    """The page id in a record id; null for a page without one."""
    return F.regexp_extract(urn, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` under ``path``, read the archives back, each response's payload held against its digest: page_id,
    payload_bytes, payload_digest, record_type, refers_to.

    Nulls, repeated rows and other columns are as in :func:`with_revisits`: each row is a record of its own and comes back
    as one row, a page without an id with a null page_id. Payloads of any length are whole. Empty table: no rows."""
    write_archives(pages, path)
    back = read_archives(pages.sparkSession, path, payloads=False, verify=True)
    return back.select(page_id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id_of(F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""
