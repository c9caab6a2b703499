"""WARC archives with revisit resolution (operator 6).

Archives are written by Spark's own writer, so any file system that Spark knows will do, and a lost
executor only repeats its task.  Each record is a gzip member of its own, so that it can be sought by its
offset; the CR LF CR LF that ends a WARC record is a second, short member, which is here the writer's line
separator.  Reading streams through each archive by Content-Length and holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import new_path, only, stored, text_of

#: Records and, by their mean size, bytes in one archive file; a task with more goes on in another file.
PER_FILE, FILE_BYTES = 10_000, 1 << 30
#: So many revisits are broadcast to the records at most; more meet them by a shuffle.
FEW = 1 << 17
#: Fixed value: the profile that a revisit of an identical payload names.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload binary, payload_bytes bigint, digest_ok boolean"


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_headers(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, payload_bytes, payload_digest) of every page; payloads stay where they are."""
    own = only(pages, id_col, payload_col).select(F.col(id_col), text_of(payload_col).alias("_payload"))
    kind = own.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.large_binary())
            pairs = [(len(b), digest_of(b)) for b in (x.as_py() for x in raw)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in pairs], pa.int64()), pa.array([d for _, d in pairs], pa.string())], names=[id_col, "payload_bytes", "payload_digest"])

    return own.mapInArrow(run, f"`{id_col}` {kind}, payload_bytes bigint, payload_digest string")


def resolve(headers: DataFrame, id_col: str, min_bytes: int = 0) -> DataFrame:
    """Distinct (id, payload_digest, payload_bytes) with record_type and refers_to.

    Headers meet by digest and length.  The original of a payload is found by an aggregate that combines
    before its shuffle; the way back joins narrow rows only, which adaptive execution splits where a
    digest is hot.
    """
    heads = headers.select(id_col, "payload_digest", "payload_bytes").distinct()
    first = headers.groupBy("payload_digest", "payload_bytes").agg(F.min(id_col).alias("_first"))
    again = (F.col("payload_bytes") >= min_bytes) & (F.col(id_col) > F.col("_first"))
    again = F.coalesce(again, (F.col("payload_bytes") >= min_bytes) & F.col(id_col).isNull() & F.col("_first").isNotNull())
    return heads.join(first, ["payload_digest", "payload_bytes"]).select(
        id_col, "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
    )


def _uri(col):
    """A target URI that can't break a header: control characters and spaces are percent-encoded away."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def member(data: bytes) -> bytes:
    """A gzip member of its own, alike at every run (no time, no name)."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: What ends a record, as a member of its own: the writer's line separator.
_END = member(b"\r\n\r\n").decode("latin-1")


def _write(records: DataFrame, path: str, mean_bytes: float, per_file: int, file_bytes: int) -> None:
    """Write ``records`` (value: a gzip member each) below ``path``: at most ``per_file`` records a file, and
    about ``file_bytes`` bytes before compression."""
    most = max(1, min(per_file, int(file_bytes // max(1.0, mean_bytes))))
    # the text writer writes bytes as they are; only the separator is encoded
    rows = records.select(F.col("value").cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", _END).option("maxRecordsPerFile", most).text(path)


def _head(kind: str, fields: list[tuple[str, str | None]], length: int) -> bytes:
    lines = [f"{k}: {v}" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(length))] if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines)).encode()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", per_file: int = PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row of ``pages`` to gzip archives below ``path``, one member for each record.

    Of equal payloads of at least ``min_bytes`` bytes the record of the smallest id is a response, the
    others are revisits without a block.  Null payloads are empty; null URIs are empty; a null id is
    larger than all others, and where all ids of a payload are null all are responses.  Rows that repeat
    an id and its payload are alike, each a record.  An empty table gives an archive without records.
    Payloads move only where more than ``FEW`` records are revisits.
    """
    own = only(pages, id_col, uri_col, payload_col).select(F.col(id_col).alias("_id"), _uri(F.col(uri_col)).alias("_uri"), text_of(payload_col).alias("_payload"))
    heads = stored(payload_headers(own.select("_id", "_payload"), "_id", "_payload"), "warc-heads", pages)
    sizes = heads.agg(F.coalesce(F.avg("payload_bytes"), F.lit(0.0))).first()[0]
    # SHA-1 again in the JVM tells rows of one id apart; hex and base32 name the same digest
    again = resolve(heads, "_id", min_bytes).where("record_type = 'revisit'").select(F.col("_id").alias("_hid"), _hex_of_base32(F.col("payload_digest")).alias("_hhex"), F.col("refers_to").cast("string").alias("_to"))
    again = stored(again, "warc-revisits")
    keyed = own.withColumn("_hex", F.sha1(F.col("_payload").cast("binary")))
    side = F.broadcast(again) if again.count() <= FEW else again.hint("shuffle_hash")
    rows = keyed.join(side, keyed["_id"].eqNullSafe(again["_hid"]) & (keyed["_hex"] == again["_hhex"]), "left")
    rows = rows.select(F.coalesce(F.col("_id").cast("string"), F.lit("null")).alias("id"), "_uri", F.when(F.col("_hhex").isNull(), F.col("_payload")).alias("payload"), F.base64(F.unhex("_hex")).alias("digest"), "_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        for batch in batches:
            out = []
            for id_, uri, payload, digest, to in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = payload is None
                block = b"" if revisit else http + payload.encode()
                fields = [("WARC-Record-ID", f"<urn:page:{id_}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(base64.b64decode(digest)).decode())]
                if revisit:
                    fields += [("WARC-Refers-To", f"<urn:page:{to}>"), ("WARC-Profile", PROFILE)]
                head = _head("revisit" if revisit else "response", [*fields, ("Content-Type", "application/http; msgtype=response")], len(block))
                out.append(member(head + b"\r\n\r\n" + block))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    _write(rows.mapInArrow(run, "value binary"), path, sizes, per_file, file_bytes)


def _hex_of_base32(col):
    """Lower-case hex of an upper-case base32 of 160 bits: eight groups of four letters are 20 bits each."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    as32 = F.translate(col, digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    return F.lower(F.concat(*[F.lpad(F.conv(F.substring(as32, 1 + 4 * i, 4), 32, 16), 5, "0") for i in range(8)]))


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


#: Bytes that a reader takes from an archive at once.
CHUNK = 1 << 18


def _chunks(source: bytes | Iterator[bytes]) -> Iterator[bytes]:
    if not isinstance(source, bytes):
        yield from source
        return
    for at in range(0, len(source), CHUNK):
        yield source[at : at + CHUNK]


def _unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces of an archive, unpacked where it is gzip (of one member or of many)."""
    z, plain, rest = None, None, b""
    for chunk in chunks:
        data = rest + chunk
        if plain is None and len(data) >= 2:
            plain = data[:2] != b"\x1f\x8b"
        if plain is None:
            rest = data
            continue
        rest = b""
        while data:
            if plain:
                yield data
                break
            z = z or zlib.decompressobj(31)
            out = z.decompress(data, 4 * CHUNK)
            if out:
                yield out
            data = z.unused_data if z.eof else z.unconsumed_tail
            z = None if z.eof else z
    if rest:
        yield rest
    if z is not None and not z.eof:
        raise ValueError("an archive ends inside a gzip member")


def raw_records_in(source: bytes | Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header as it is, block) of each record of one archive, which may come in pieces; holds one record."""
    held, pieces, more, at = bytearray(), _unpacked(_chunks(source)), True, 0

    def fetch() -> None:
        nonlocal more, at
        piece = next(pieces, None)
        more = piece is not None
        if at:
            del held[:at]
            at = 0
        held.extend(piece or b"")

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0 and more:
            fetch()
        if end < 0:
            if held[at:].strip():
                raise ValueError("an archive ends inside a record's headers")
            return
        head = bytes(held[at:end])
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {head[:40]!r}")
        found = _LENGTH.search(head)
        if not found:
            raise ValueError("a record without a Content-Length")
        begin, size = end + 4 - at, int(found[1])
        while more and len(held) - at < begin + size + 4:
            fetch()
        if len(held) - at < begin + size:
            raise ValueError("an archive ends inside a record's block")
        yield head, bytes(held[at + begin : at + begin + size])
        at = min(len(held), at + begin + size + 4)


def records_in(blob: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of one archive."""
    for head, block in raw_records_in(blob):
        yield fields_of(head), block


def fields_of(head: bytes) -> dict[str, str]:
    fields = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in fields}


def _archives(spark: SparkSession, path: str) -> tuple[DataFrame, Callable[[pa.Array], Iterator[Iterator[bytes]]]]:
    """(a table of one column, what makes of a batch of it the archives below ``path``, each in pieces).

    Where Python can open the store, archives are streamed, however large; else Spark reads them, a file a row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    try:
        pafs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        if "://" in path:
            return files.select("content"), lambda column: (_chunks(x.as_py()) for x in column)

    def streamed(column: pa.Array) -> Iterator[Iterator[bytes]]:
        for uri in column.to_pylist():
            yield _read(uri)

    return files.select("path"), streamed


def _read(uri: str) -> Iterator[bytes]:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        while chunk := stream.read(CHUNK):
            yield chunk


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path`` (columns: ``RECORDS``).

    payload is what follows the HTTP headers, null with ``payloads=False`` and for revisits;
    payload_bytes is null for revisits; digest_ok tells whether a payload has the digest that its
    header names.
    """
    files, opened = _archives(spark, path)
    schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in opened(batch.column(0)):
                rows, held = [], 0
                for head, block in records_in(archive):
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    row = {"record_id": head.get("warc-record-id"), "warc_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "warc_date": head.get("warc-date"), "payload_digest": digest, "refers_to": head.get("warc-refers-to")}
                    if row["warc_type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        row |= {"payload": payload if payloads else None, "payload_bytes": len(payload), "digest_ok": digest_of(payload) == digest}
                    rows.append(row)
                    held += len(block) if payloads else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with payload_bytes of revisits taken from their originals; ``original`` is false where
    an original is missing.  Only headers are shuffled."""
    own = records.select("record_id", "warc_type", "payload_digest", "refers_to", "payload_bytes", "digest_ok")
    sizes = own.where("warc_type = 'response'").groupBy("payload_digest").agg(F.min("payload_bytes").alias("_size"))
    return own.join(sizes, "payload_digest", "left").select(
        "record_id", "warc_type", "payload_digest", "refers_to", F.coalesce("payload_bytes", "_size").alias("payload_bytes"), F.coalesce("digest_ok", F.col("_size").isNotNull()).alias("original")
    )


_NUMBER = re.compile(r"<urn:page:(-?\d{1,18})>")


def _archived(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """All records below ``path``, of whatever type, with header and block as they are (null without ``blocks``).

    The digest of a response is that of its payload, of another record what its header names (null for
    none); _number is the page of an id that ``write_warc`` gave.
    """
    files, opened = _archives(spark, path)
    schema = pa.schema([("_id", pa.string()), ("_type", pa.string()), ("_number", pa.int64()), ("_refers", pa.string()), ("_digest", pa.string()), ("_bytes", pa.int64()), ("_head", pa.binary()), ("_block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in opened(batch.column(0)):
                rows, held = [], 0
                for raw, block in raw_records_in(archive):
                    head = fields_of(raw)
                    number = _NUMBER.fullmatch(head.get("warc-record-id", ""))
                    row = {"_id": head.get("warc-record-id"), "_type": head.get("warc-type"), "_number": int(number[1]) if number else None, "_refers": head.get("warc-refers-to")}
                    row |= {"_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "_bytes": len(block)}
                    if row["_type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        row |= {"_digest": digest_of(payload), "_bytes": len(payload)}
                    rows.append(row | ({"_head": raw, "_block": block} if blocks else {}))
                    held += len(raw) + len(block) if blocks else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, "_id string, _type string, _number bigint, _refers string, _digest string, _bytes bigint, _head binary, _block binary")


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0, per_file: int = PER_FILE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Read archives, keep one response per payload of at least ``min_bytes`` bytes, write fresh headers.

    Of equal payloads the response of the smallest page number stays, then of the smallest record id, then
    one without an id; the others become revisits of it.  So do revisits whose digest, or where they name none or one of another
    form (sha256, hexadecimal) whose WARC-Refers-To, is that of a response in the source.  Ids (of any form, also missing), dates, URIs and HTTP headers stay.
    Revisits whose original is elsewhere, and records of other types, are written as they are.  Sources are
    read twice, headers first; only headers meet by a shuffle.

    Returns (outcome, n): responses kept, responses made revisits, revisits resolved, revisits unresolved, others.
    """
    heads = stored(_archived(spark, source, blocks=False).drop("_head", "_block"), "warc-heads")
    order = F.struct(F.col("_id").isNull(), F.col("_number").isNull(), "_number", "_id")  # one that can be referred to
    responses = heads.where("_type = 'response'")
    firsts = responses.groupBy("_digest").agg(F.min(order)["_id"].alias("_first"), F.max("_bytes").alias("_size"))
    named = responses.where("_id is not null").groupBy(F.col("_id").alias("_refers")).agg(F.min("_digest").alias("_theirs"))
    comparable = F.col("_digest").rlike("^[A-Z2-7]{32}$")  # the form of those that are worked out here
    narrow = heads.where("_type in ('response', 'revisit')").join(named, "_refers", "left")
    narrow = narrow.withColumn("_own", F.col("_digest")).withColumn("_digest", F.when(F.col("_type") == "revisit", F.coalesce(F.when(comparable, F.col("_digest")), F.col("_theirs"), F.col("_digest"))).otherwise(F.col("_digest")))
    met = narrow.join(firsts, "_digest", "left")
    again = F.coalesce(F.when(F.col("_type") == "revisit", F.col("_size").isNotNull()).otherwise((F.col("_size") >= min_bytes) & ~F.col("_id").eqNullSafe(F.col("_first"))), F.lit(False))
    # a record is found again by id, type and digest; of repeated records all are alike
    key = lambda *cols: [F.coalesce(c, F.lit("")) for c in cols]
    met = stored(met.withColumn("_again", again).select(*[c.alias(n) for c, n in zip(key(F.col("_id"), F.col("_type"), F.col("_own"), F.col("_refers")), ("_k0", "_k1", "_k2", "_k3"))], "_again", "_first", "_digest"), "warc-met")
    changed = met.where("_again").select("_k0", "_k1", "_k2", "_k3", "_first", F.col("_digest").alias("_original")).distinct()
    own = _archived(spark, source)
    own = own.withColumns(dict(zip(("_k0", "_k1", "_k2", "_k3"), key(F.col("_id"), F.col("_type"), F.col("_digest"), F.col("_refers")))))
    side = F.broadcast(changed) if changed.count() <= FEW else changed.hint("shuffle_hash")
    rows = own.join(side, ["_k0", "_k1", "_k2", "_k3"], "left").select("_head", "_block", "_type", "_digest", F.col("_original").isNotNull().alias("_again"), "_first", "_original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, block, kind, digest, again_, first, original in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "response" or again_:
                    fields = fields_of(raw)
                    if again_ and kind == "response":  # the HTTP headers stay; a source's revisit has no more
                        http, gap, _ = block.partition(b"\r\n\r\n")
                        block = http + gap
                    kept = [("WARC-Record-ID", fields.get("warc-record-id")), ("WARC-Date", fields.get("warc-date")), ("WARC-Target-URI", fields.get("warc-target-uri")), ("WARC-Payload-Digest", f"sha1:{original if again_ else digest}")]
                    if again_:
                        kept += [("WARC-Refers-To", first), ("WARC-Profile", PROFILE)]
                    raw = _head("revisit" if again_ else "response", [*kept, ("Content-Type", fields.get("content-type"))], len(block))
                out.append(member(raw + b"\r\n\r\n" + block))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    mean = heads.agg(F.coalesce(F.avg("_bytes"), F.lit(0.0))).first()[0]
    _write(rows.mapInArrow(run, "value binary"), target, mean, per_file, file_bytes)
    what = F.when(F.col("_k1") == "response", F.when(F.col("_again"), "responses made revisits").otherwise("responses kept")).otherwise(F.when(F.col("_again"), "revisits resolved").otherwise("revisits unresolved"))
    others = heads.where("coalesce(_type, '') not in ('response', 'revisit')").select(F.lit("others").alias("outcome"))
    return met.select(what.alias("outcome")).unionByName(others).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html), read the archives back and resolve revisits.

    Rows: page_id, payload_bytes, payload_digest, record_type, refers_to.  A payload that doesn't match
    its digest, or a revisit without an original, fails the query.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path, min_bytes=min_bytes)
    found = resolve_revisits(read_warc(spark, path, payloads=False))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(\d+|-\d+)>$", 1)
    as_long = lambda c: F.when(number(c) != "", number(c).cast("long"))
    checked = F.when(F.col("original"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))))
    return found.select(as_long(F.col("record_id")).alias("page_id"), "payload_bytes", checked.alias("payload_digest"), F.col("warc_type").alias("record_type"), as_long(F.coalesce("refers_to", F.lit(""))).alias("refers_to"))
