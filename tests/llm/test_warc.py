import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestar.llm import _shared, warc


def expected(rows):
    """[(page_id, html)] with distinct ids to the rows of the query."""
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        head = first.setdefault(raw, i) if len(raw) >= 100 else i
        again = len(raw) >= 100 and (raw, i) != (raw, head)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", head if again else None))
    return out


def query(spark, monkeypatch, pages):
    monkeypatch.setattr(_shared, "table", lambda *_: pages)
    return [tuple(r) for r in warc.op12_legacy_warc(spark, "").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]


def odd_pages():
    rng = random.Random(9)
    same, other = "<p>" + "same " * 40, "y" * 100
    rows = [(k, f"http://h{k % 3}.example/é a/{k}?x=%20 1", f"<html>{rng.random()}\r\n\r\nHTTP/1.1 x\nWARC/1.1\r\n" + "w " * rng.randint(0, 900)) for k in range(40)]
    rows += [(1000 - k, "https://copy.example/", same) for k in range(300)]
    return rows + [(41, None, None), (42, "", ""), (43, "http://a/", "y" * 99), (44, "http://a/", "y" * 99), (45, "http://a/", other), (46, "http://a/", other), (47, "dns:x", "é" * 2_000_000), (None, "http://a/", same), (48, "http://b/", "z" * 20_000_000), (49, "http://b/", "z" * 20_000_000)]


def test_query_by_hand(spark, monkeypatch):
    rows = odd_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "body", "archive", "content", "type")}).repartition(3)
    got = query(spark, monkeypatch, pages)
    assert sorted(got, key=str) == sorted(expected([(i, t) for i, _, t in rows]), key=str)
    monkeypatch.setattr(warc, "BROADCAST", -1)
    assert sorted(query(spark, monkeypatch, pages), key=str) == sorted(got, key=str)
    assert query(spark, monkeypatch, pages.limit(0)) == []


def test_repeated_rows(spark, monkeypatch):
    """Rows that are the same in all columns: one response, the others revisit it."""
    pages = spark.createDataFrame([(7, "http://a/", "x" * 200)] * 5 + [(8, "http://a/", "x" * 200)], "page_id long, url string, html string").repartition(2)
    got = query(spark, monkeypatch, pages)
    assert sorted((r[0], r[3], r[4]) for r in got) == [(7, "response", None)] + [(7, "revisit", 7)] * 4 + [(8, "revisit", 7)]


def one_archive(version=1, tail=b"", packed=False):
    names = warc.NAMES[version]
    info = b"%d 0 crawler\n%s\n" % (version, names) + (b"<xml>1.1 has more here</xml>\n" if version == 1 else b"")
    more = (lambda n: b"") if version == 1 else (lambda n: b" 200 - - %d x.arc" % n)
    reply = b"HTTP/1.0 200 OK\nContent-type: text/html\n\n<b>hello</b>"
    parts = [b"filedesc://x.arc 0.0.0.0 19960917145842 text/plain" + more(0) + b" %d\n" % len(info) + info + b"\n"]
    parts.append(b"http://a.example/with space 10.0.0.1 199609171458 text/html; charset=x" + more(5) + b" %d\n" % len(reply) + reply + b"\n")
    parts.append(b"dns:a.example 10.0.0.2 20010203040506789 text/dns" + more(6) + b" 11\n" + b"a 1 IN A\n\nx" + b"\n\n")
    parts.append(b"http://a.example/2 10.0.0.1 99999999999999 text/html" + more(7) + b" %d\n" % len(reply) + reply + b"\n")
    return b"".join(gzip.compress(p) for p in parts) + (gzip.compress(tail) if tail else b"") if packed else b"".join(parts) + tail


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_header_lines_and_what_is_synthesised(version, packed):
    info, page, dns, last = warc.synthesised("x.arc", one_archive(version, packed=packed))
    assert info["type"] == "warcinfo" and info["date"] == "1996-09-17T14:58:42Z"
    assert (page["url"], page["ip"], page["mime"], page["date"]) == ("http://a.example/with space", "10.0.0.1", "application/http; msgtype=response", "1996-09-17T14:58:00Z")
    assert page["payload"] == b"<b>hello</b>" and page["payload_digest"] == hashlib.sha256(b"<b>hello</b>").hexdigest()
    assert (dns["type"], dns["mime"], dns["block"], dns["date"]) == ("resource", "text/dns", b"a 1 IN A\n\nx", "2001-02-03T04:05:06.789Z")
    assert last["date"] == "1996-09-17T14:58:42Z" and last["id"] != page["id"] and last["payload_digest"] == page["payload_digest"]
    assert [r["id"] for r in warc.synthesised("x.arc", one_archive(version, packed=not packed))] == [r["id"] for r in (info, page, dns, last)]


def test_damage_is_told(spark):
    tail = b"junk without fields\nmore\nhttp://b/ 1.2.3.4 20000101000000 text/plain 5\nabcde\nhttp://c/ 1.2.3.4 20000101000000 text/plain 50\nshort"
    found = list(warc.arc_records(one_archive(1, tail)))
    assert [r["kind"] for r in found] == ["info", "record", "record", "record", "damaged", "record", "record"]
    assert found[4]["error"] == "25 bytes without a header" and found[5]["block"] == b"abcde"
    assert found[6]["error"] == "5 of 50 bytes" and found[6]["block"] == b"short"
    assert [r["kind"] for r in warc.arc_records(b"no archive\n")] == ["damaged"] and list(warc.arc_records(b"")) == []
    frame = spark.createDataFrame([("x.arc", bytearray(one_archive(1, tail))), ("none.arc", None)], "archive string, content binary")
    assert frame.count() == 2 and warc.arc_index(frame).where("type IS NULL").select("error").collect()[0][0] == found[4]["error"]
    out = warc.read_warc(warc.convert(frame), payload=True).collect()
    assert [(r.type, bytes(r.payload or b"")) for r in out][-2:] == [("resource", b"abcde"), ("resource", b"short")] and all(r.error is None for r in out)


def test_files_and_their_form(spark, tmp_path):
    """Files on disk: gzip members of one record each, fields that the format asks for, digests, and what comes back."""
    pages = spark.createDataFrame([(1, "http://a/x", "p" * 150), (2, "http://a/y", "p" * 150), (3, "http://a/z", "q")], "page_id long, url string, html string").coalesce(1)
    converted = _shared.materialize(warc.convert(_shared.materialize(warc.arc_archives(pages), "arc")), "warc")
    assert [r.bytes > 0 for r in warc.write_files(converted, str(tmp_path)).collect()] == [True]
    (path,) = tmp_path.glob("*.warc.gz")
    heads, rest = [], path.read_bytes()
    for record in gzip.decompress(rest).split(b"WARC/1.1\r\n")[1:]:
        head, _, body = record.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n"))
        block = body[: int(fields["Content-Length"])]
        assert body[len(block) :] == b"\r\n\r\n" and fields["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
        heads.append(fields)
    assert [h["WARC-Type"] for h in heads] == ["warcinfo", "response", "revisit", "response"]
    assert heads[2]["WARC-Refers-To"] == heads[1]["WARC-Record-ID"] and heads[2]["WARC-Refers-To-Target-URI"] == "http://a/x" and heads[2]["WARC-Payload-Digest"] == heads[1]["WARC-Payload-Digest"]
    assert len({h["WARC-Record-ID"] for h in heads}) == 4 and all(h["WARC-Date"] == "2008-04-30T20:48:25Z" for h in heads[1:])
    back = warc.read_warc(warc.read_files(spark, str(tmp_path)), payload=True).orderBy("key").collect()
    assert [(r.key, r.type, r.payload_bytes, r.payload and bytes(r.payload)) for r in back] == [("1", "response", 150, b"p" * 150), ("2", "revisit", 150, None), ("3", "response", 1, b"q")]
    damaged = bytearray(gzip.decompress(rest))
    damaged[damaged.index(b"pppp")] = 0x71
    bad = spark.createDataFrame([("d.warc", damaged)], "archive string, content binary")
    assert {r.error for r in warc.read_warc(bad).where("error IS NOT NULL").collect()} == {"block digest differs"}
