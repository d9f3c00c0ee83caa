"""Legacy ARC archives converted to WARC, with revisit records for repeated payloads.

An archive is a row (archive, content): its name and its bytes, gzip members of one record each, or plain. Tables of archives
are written by Spark into any store; `write_files` makes files of them in a mounted folder, `read_files` takes files from
any store. Archives of `arc_archives` end at a number of bytes, a longer record has one of its own.

Parsing an ARC archive begins with its version block (`filedesc://`), whose first line names the version. Version 1 (also
1.1, whose block holds more text behind the field names) has five fields in a record's header line, version 2 has ten; a
line is taken apart from its right end, as URLs and content types of old crawls hold spaces. The declared length gives the
record's end. Where no header line stands behind it, lines are passed over up to the next one and reported; a record that
ends with the archive is kept as far as it goes and marked.

Conversion synthesises what ARC lacks: a record id (urn:uuid) from the SHA-256 of archive, place, URL, date and block, so a
repeated run gives the same; the date in ISO form; the type (`filedesc` warcinfo, an HTTP reply response, others resource);
SHA-256 digests of block and payload (what follows the HTTP head). An index of digests is aggregated first: of responses with
equal payloads of at least LEAST bytes the first stays, by number in the HTTP field KEY_FIELD, then date and place, and the
others become revisit records that refer to it and hold the HTTP head only. Only revisits' verdicts travel to their archives;
payloads are not shuffled unless more than BROADCAST verdicts must be joined.

Defined results: a null or empty url is `unknown:`, bytes of URLs outside visible ASCII are percent-encoded; a null body is empty; a
null key leaves its field out and comes behind all others among equals; repeated rows are records of their own, all but one
revisits; null contents give no records; dates that are none fall back to the archive's, then to 1970; an empty table gives
no rows; other columns are not looked at. Transfer codings in old replies are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import _shared

#: Shorter payloads are never revisits.
LEAST = 100
KEY_FIELD = "X-Page-Id"
#: Bytes of records in an archive, gzip's level, and the bytes that are inflated at once.
ARCHIVE_BYTES, LEVEL, PIECE = 1 << 20, 1, 1 << 16
#: Verdicts (some 200 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST = 100_000
#: What `arc_archives` gives as the time of the crawl where none is named.
FETCHED = "20080430204825"
# Header lines of both versions, the names of their fields, and what WARC records are called.
NAMES = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
HEADERS = {
    1: re.compile(rb"(?P<url>\S.*) (?P<ip>[0-9A-Fa-f.:]+) (?P<date>[0-9]{4,17}) (?P<mime>\S.*?) (?P<length>[0-9]+)\r?\n?"),
    2: re.compile(rb"(?P<url>\S.*) (?P<ip>[0-9A-Fa-f.:]+) (?P<date>[0-9]{4,17}) (?P<mime>\S.*?) (?P<code>[0-9]{3}|-) (?P<sum>\S+) (?P<location>\S+) (?P<offset>[0-9]+|-) (?P<file>\S+) (?P<length>[0-9]+)\r?\n?"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Reader:
    """An archive's bytes from the front to the back; gzip members are inflated piece by piece."""

    def __init__(self, content):
        self.pieces = self._pieces(memoryview(content).cast("B"))
        self.held, self.at, self.place = b"", 0, 0

    @staticmethod
    def _pieces(raw: memoryview) -> Iterator[bytes]:
        at, packed, whole = 0, bytes(raw[:2]) == b"\x1f\x8b", len(raw)
        member = None
        while at < whole:
            piece = raw[at : at + PIECE]
            if not packed:
                at += len(piece)
                yield bytes(piece)
                continue
            if member is None:
                if bytes(raw[at : at + 2]) != b"\x1f\x8b":  # padding behind the last member
                    return
                member = zlib.decompressobj(31)
            try:
                out = member.decompress(piece)
            except zlib.error:
                return
            at += len(piece) - len(member.unused_data)
            if member.eof:
                member = None
            yield out

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def line(self) -> bytes:
        """The next line with its end; empty at the archive's end."""
        seen = self.at
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                end = len(self.held) - 1
                break
        out = self.held[self.at : end + 1]
        self.at, self.place = end + 1, self.place + len(out)
        return out

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the archive's end."""
        parts, missing = [], n
        while missing:
            part = self.held[self.at : self.at + missing]
            parts.append(part)
            self.at += len(part)
            missing -= len(part)
            if missing and not self._more():
                break
        out = b"".join(parts)
        self.place += len(out)
        return out


def arc_records(content) -> Iterator[dict]:
    """Records of one ARC archive: kind (`info` first), url, ip, date, mime, block, place, and error where something is damaged."""
    source = Reader(content)
    version, passed, began = 0, 0, 0
    while line := source.line():
        if not line.strip():
            continue
        place = source.place - len(line)
        is_info = line.startswith(b"filedesc:")
        found = next((m for v in ((2, 1) if is_info or not version else (version,)) if (m := HEADERS[v].fullmatch(line))), None)
        if found is None:
            began, passed = (began if passed else place), passed + len(line)
            continue
        if passed:
            yield {"kind": "damaged", "place": began, "error": f"{passed} bytes without a header"}
            passed = 0
        length = int(found["length"])
        block = source.take(length)
        record = {"kind": "info" if is_info else "record", "place": place, "error": None if len(block) == length else f"{len(block)} of {length} bytes", "block": block}
        record |= {k: found[k].decode("utf-8", "replace") for k in ("url", "ip", "date", "mime")}
        if is_info:
            first, _, rest = block.partition(b"\n")
            version = int(first.split()[0]) if first.split() and first.split()[0] in (b"1", b"2") else 0
            if len(rest.partition(b"\n")[0].split()) == len(NAMES[2].split()):
                version = 2
            if not version:
                record["error"] = f"unknown version {first[:40].decode('latin-1')}"
        yield record
    if passed:
        yield {"kind": "damaged", "place": began, "error": f"{passed} bytes without a header"}


@lru_cache(1 << 12)
def iso_date(digits: str) -> str | None:
    """YYYY up to YYYYMMDDhhmmss and thousandths as an ISO date; None where it is no date."""
    whole = digits[:14] + "00000101000000"[len(digits[:14]) :]
    try:
        out = datetime.strptime(whole, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%S")
    except ValueError:
        return None
    return (out if len(out) == 19 else out.zfill(19)) + (f".{digits[14:17]}Z" if len(digits) > 14 else "Z")


def record_id(*parts) -> str:
    """A urn:uuid (version 8, custom) from the SHA-256 of the parts, each with its length."""
    own = hashlib.sha256()
    for x in parts:
        raw = x if isinstance(x, bytes) else str(x).encode()
        own.update(b"%d:" % len(raw) + raw)
    raw = bytearray(own.digest()[:16])
    raw[6], raw[8] = raw[6] & 0x0F | 0x80, raw[8] & 0x3F | 0x80
    return f"urn:uuid:{uuid.UUID(bytes=bytes(raw))}"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head with its empty line, and what follows; no head where the block is no HTTP reply."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at, at + len(x)) for x in (b"\r\n\r\n", b"\n\n") if (at := block.find(x)) >= 0]
    end = min(ends)[1] if ends else len(block)
    return block[:end], block[end:]


def field(head: bytes, name: str) -> str | None:
    """The value of an HTTP head's field."""
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)[ \t]*\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def synthesised(archive: str, content) -> Iterator[dict]:
    """What a WARC record needs for each record of an ARC archive; damaged stretches as they are told."""
    fallback = None
    for r in arc_records(content):
        if r["kind"] == "damaged":
            yield r
            continue
        date = iso_date(r["date"])
        if r["kind"] == "info":
            fallback = date
        head, payload = split_http(r["block"]) if r["kind"] == "record" else (b"", r["block"])
        kind = "warcinfo" if r["kind"] == "info" else "response" if head else "resource"
        mime = {"warcinfo": "application/warc-fields", "response": "application/http; msgtype=response"}.get(kind) or ("text/dns" if r["url"].startswith("dns:") else r["mime"])
        digest = hashlib.sha256(r["block"]).hexdigest()
        yield r | {
            "type": kind, "head": head, "payload": payload, "mime": mime, "date": date or fallback or "1970-01-01T00:00:00Z", "block_digest": digest,
            "payload_digest": hashlib.sha256(payload).hexdigest() if head else digest, "id": record_id(archive, r["place"], r["url"], r["date"], digest),
        }


def packed(raw: bytes) -> bytes:
    """One gzip member."""
    member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return member.compress(raw) + member.flush()


def warc_record(named: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in named if v is not None)
    return packed(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


def warc_archive(archive: str, content, verdicts: dict[int, dict]) -> bytes:
    """The WARC archive of an ARC archive. verdicts: by place, what a revisit refers to."""
    out, info = [], None
    for r in synthesised(archive, content):
        if r["kind"] == "damaged":
            continue
        named = [("WARC-Type", r["type"]), ("WARC-Record-ID", f"<{r['id']}>"), ("WARC-Date", r["date"])]
        if r["type"] == "warcinfo":
            info = r["id"]
            block = f"software: lodestar\r\nformat: WARC File Format 1.1\r\nconverted-from: {archive}\r\n".encode()
            out.append(warc_record([*named, ("WARC-Filename", warc_name(archive)), ("Content-Type", r["mime"]), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")], block))
            continue
        named += [("WARC-Target-URI", r["url"]), ("WARC-IP-Address", None if r["ip"] == "0.0.0.0" else r["ip"]), ("WARC-Warcinfo-ID", info and f"<{info}>"), ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"), ("Content-Type", r["mime"])]
        block, digest = r["block"], r["block_digest"]
        if first := verdicts.get(r["place"]):
            named[0] = ("WARC-Type", "revisit")
            named += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{first['id']}>"), ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", first["date"])]
            block, digest = r["head"], hashlib.sha256(r["head"]).hexdigest()
        out.append(warc_record([*named, ("WARC-Truncated", "unspecified" if r["error"] else None), ("WARC-Block-Digest", f"sha256:{digest}")], block))
    return b"".join(out)


def warc_records(content) -> Iterator[dict]:
    """Records of one WARC archive: fields (names in lower case), block and error; digests are checked."""
    source = Reader(content)
    while line := source.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            yield {"fields": {}, "block": b"", "error": "no WARC header"}
            return
        fields, last = {}, ""
        while (line := source.line()).strip():
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        length = fields.get("content-length", "")
        if not length.isdigit():
            yield {"fields": fields, "block": b"", "error": "no Content-Length"}
            return
        block = source.take(int(length))
        kind, _, digest = fields.get("warc-block-digest", "").partition(":")
        error = None if len(block) == int(length) else f"{len(block)} of {length} bytes"
        if kind == "sha256" and digest != hashlib.sha256(block).hexdigest():
            error = error or "block digest differs"
        yield {"fields": fields, "block": block, "error": error}


# -- tables of archives


def warc_name(archive: str) -> str:
    return re.sub(r"(\.arc)?(\.gz)?$", ".warc.gz", archive, count=1)


def arc_record(version: int, url: str, mime: str, block: bytes, fetched: str, ip: str = "0.0.0.0", offset: int = 0, archive: str = "-", code: str = "200") -> bytes:
    """One record of an ARC archive: header line, block, end."""
    more = f" {code} - - {offset} {archive}" if version == 2 else ""
    return f"{url} {ip} {fetched} {mime}{more} {len(block)}\n".encode() + block + b"\n"


def arc_head(version: int, archive: str, fetched: str) -> bytes:
    """The version block at an archive's front."""
    return arc_record(version, f"filedesc://{archive}", "text/plain", b"%d 0 lodestar\n%s\n" % (version, NAMES[version]), fetched, archive=archive)


def arc_archives(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", fetched: str = FETCHED, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages as HTTP replies in ARC archives of versions 1 and 2 by turns: archive, content."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, texts in _shared.slices(batch, "body", archive_bytes):
                version, name = 1 + n % 2, f"pages-{part:07d}-{n:07d}.arc.gz"
                members, at = [packed(arc_head(version, name, fetched))], 0
                for k, u, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), texts):
                    payload = t.as_py().encode()
                    mark = "" if k is None else f"{KEY_FIELD}: {k}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
                    at += len(members[-1])
                    members.append(packed(arc_record(version, quote(u or "unknown:", safe="".join(map(chr, range(0x21, 0x7F)))), "text/html", head.encode() + payload, fetched, offset=at, archive=name)))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(members)], pa.binary())], ["archive", "content"])
                n += 1

    _shared.bounded(pages.sparkSession)
    rows = pages.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{body}`").alias("body"))
    return rows.mapInArrow(run, "archive string, content binary")


def arc_index(archives: DataFrame) -> DataFrame:
    """One row for each record of ARC archives: archive, place, id, url, date, type, payload's bytes and digest, number, error."""
    names = {"archive": pa.string(), "place": pa.int64(), "id": pa.string(), "url": pa.string(), "date": pa.string(), "type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "number": pa.int64(), "error": pa.string()}

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                if not content.is_valid:
                    continue
                rows = []
                for r in synthesised(archive.as_py(), content.as_buffer()):
                    number = field(r.get("head", b""), KEY_FIELD) or ""
                    rows.append({k: r.get(k) for k in ("place", "id", "url", "date", "type", "payload_digest", "error")} | {"archive": archive.as_py(), "payload_bytes": len(r.get("payload", b"")), "number": int(number) if re.fullmatch(r"-?[0-9]{1,18}", number) else None})
                yield from pa.Table.from_pylist(rows, pa.schema(names.items())).to_batches()

    return archives.select("archive", "content").mapInArrow(run, "archive string, place long, id string, url string, date string, type string, payload_bytes long, payload_digest string, number long, error string")


def revisits(index: DataFrame, least: int = LEAST) -> DataFrame:
    """(archive, verdict) for each record that repeats an earlier payload: its place, and what it refers to."""
    order = F.struct(F.col("number").isNull().alias("none"), "number", "date", "archive", "place", "id", "url")
    same = index.where((F.col("type") == "response") & (F.col("payload_bytes") >= least))
    heads = same.groupBy("payload_digest").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "head")
    found = same.join(heads, "payload_digest").where("id != head.id")
    return found.select("archive", F.struct("place", F.col("head.id").alias("id"), F.col("head.url").alias("url"), F.col("head.date").alias("date")).alias("verdict"))


def convert(archives: DataFrame, least: int = LEAST) -> DataFrame:
    """ARC archives as WARC archives: archive, content. The index is written first; then each archive is converted with the
    verdicts on its own records, which an archive's size bounds."""
    spark = archives.sparkSession
    found = _shared.materialize(revisits(_shared.materialize(arc_index(archives), "arc-index"), least), "revisits")
    verdicts = found.groupBy("archive").agg(F.collect_list("verdict").alias("verdicts"))
    if found.count() <= BROADCAST:
        verdicts = F.broadcast(verdicts)

    def run(batches):
        for batch in batches:
            for archive, content, told in zip(*batch.columns):
                if content.is_valid:
                    out = warc_archive(archive.as_py(), content.as_buffer(), {v["place"]: v for v in told.as_py() or []})
                    yield pa.RecordBatch.from_arrays([pa.array([warc_name(archive.as_py())]), pa.array([out], pa.binary())], ["archive", "content"])

    _shared.bounded(spark)
    return archives.select("archive", "content").join(verdicts, "archive", "left").mapInArrow(run, "archive string, content binary")


def read_warc(archives: DataFrame, payload: bool = False) -> DataFrame:
    """One row for each record of WARC archives but warcinfo: archive, id, type, url, date, key (the HTTP field KEY_FIELD),
    payload's bytes and digest (of revisits: as they are declared), refers_to (a record id), error, and the payload itself if
    it is asked for."""
    kinds = {**dict.fromkeys(("archive", "id", "type", "url", "date", "key", "payload_digest", "refers_to", "error"), pa.string()), "payload_bytes": pa.int64(), **({"payload": pa.binary()} if payload else {})}

    def told(archive: str, r: dict) -> dict:
        fields, block, error = r["fields"], r["block"], r["error"]
        head, body = split_http(block) if "application/http" in fields.get("content-type", "") else (b"", block)
        declared = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if fields.get("warc-type") == "revisit":
            size = field(head, "Content-Length") or ""
            n, digest, body = int(size) if size.isdigit() else None, declared, None
        else:
            n, digest = len(body), hashlib.sha256(body).hexdigest()
            if declared and declared != digest:
                error = error or "payload digest differs"
        strip = lambda x: x and x.strip("<>")
        return {
            "archive": archive, "id": strip(fields.get("warc-record-id")), "type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "key": field(head, KEY_FIELD),
            "payload_bytes": n, "payload_digest": digest, "refers_to": strip(fields.get("warc-refers-to")), "error": error, "payload": body,
        }

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                if content.is_valid:
                    rows = [told(archive.as_py(), r) for r in warc_records(content.as_buffer()) if r["fields"].get("warc-type") != "warcinfo"]
                    yield from pa.Table.from_pylist(rows, pa.schema(kinds.items())).to_batches()

    _shared.bounded(archives.sparkSession)
    return archives.select("archive", "content").mapInArrow(run, ", ".join(f"{k} {'long' if t == pa.int64() else t}" for k, t in kinds.items()))


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """Each archive as a file in a mounted folder; archive and bytes written, once an action runs."""

    def run(batches):
        for batch in batches:
            names = [x.as_py().rpartition("/")[2] for x in batch.column(0)]
            for name, content in zip(names, batch.column(1)):
                _shared.write_array(folder, name, np.frombuffer(content.as_buffer(), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(x.as_buffer()) for x in batch.column(1)], pa.int64())], ["archive", "bytes"])

    return archives.where("content IS NOT NULL").select("archive", "content").mapInArrow(run, "archive string, bytes long")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files (2 GB at most each) of any store as a table of archives."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("archive"), "content")


def op12_legacy_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC archives, converted to WARC archives, which are read back; refers_to follows the record ids."""
    pages = _shared.table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    with _shared.scratch(spark):
        archives = _shared.materialize(convert(_shared.materialize(arc_archives(pages), "arc")), "warc")
        records = _shared.materialize(read_warc(archives), "warc-records", keep=True)
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("archive", F.lit(": "), "error"))).otherwise(F.col("key"))
    own = records.select(sound.cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "id", "refers_to")
    first, again = own.where("record_type = 'response'"), own.where("record_type != 'response'")
    referred = again.drop("id").join(first.select(F.col("id").alias("refers_to"), F.col("page_id").alias("_first")), "refers_to", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.withColumn("refers_to", F.lit(None).cast(kind)).select(names).unionByName(referred.withColumn("refers_to", F.col("_first")).select(names))
