import hashlib
import random
import zlib

import pytest

from sparkloom.llm import warc


def brute(rows):
    by = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            by.setdefault(b, []).append(i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        top = max(by.get(b, [i or 0]))
        again = b in by and i is not None and i < top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_archive_round_trip(spark):
    big, bigger = "é" * 500, "x" * 999
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: 1", big), (3, None, None), (4, "u", ""), (5, "u", bigger), (6, "u", bigger), (7, "u", big), (7, "u", big), (8, "u", "WARC/1.1\r\n\x1f\x8b\x08" * 300), (None, "u", big)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, payload int")
    got = warc.archive_pages(spark, df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert warc.archive_pages(spark, df.limit(0)).count() == 0


def archive(n=30, plain=False):
    r = random.Random(0)
    parts = []
    for i in range(n):
        raw = warc.record(i, f"http://x/{i}", bytes(r.randrange(256) for _ in range(r.choice([0, 10, 3000]))), None)
        parts.append(raw if plain else warc.member(raw) + warc.EMPTY_MEMBER)
    return parts


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("kind", ["flip", "cut", "insert", "zero"])
def test_salvage(plain, kind):
    parts = archive(plain=plain)
    r = random.Random(kind)
    hit = {3, 4, 11, 29}
    damaged, spans, at = [], {}, 0
    for i, p in enumerate(parts):
        own = p
        if i in hit:
            k = 30 if plain else len(p) // 3
            own = {"flip": p[:k] + bytes([p[k] ^ 0x55]) + p[k + 1 :], "cut": p[:k], "insert": p[:k] + b"\x1f\x8b\x08junk WARC/1.1\r\n" + p[k:], "zero": bytes(len(p))}[kind]
        spans[i] = (at, at + len(own))
        at += len(own)
        damaged.append(own)
    data = b"".join(damaged)
    found = list(warc.read_archive(data))
    ids = [int(x.fields["x-page-id"]) for x in found if isinstance(x, warc.Record)]
    assert set(ids) >= set(range(30)) - hit and len(ids) == len(set(ids))
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    lost = set(range(30)) - set(ids)
    for i in lost:  # each lost record lies in a gap
        assert any(g.start <= spans[i][0] < g.end for g in gaps)
    for g in gaps:  # and no gap holds a whole record that was given
        assert g.start < g.end and not any(g.start <= spans[i][0] and spans[i][1] <= g.end for i in ids)
    assert sum(x.end - x.start for x in gaps) + sum(x.end - x.start for x in found if isinstance(x, warc.Record)) <= len(data)


def test_damaged_file_in_spark(spark, tmp_path):
    parts = archive(10)
    parts[4] = parts[4][:20] + b"\0\0\0\0" + parts[4][24:]
    (tmp_path / "part-0.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "part-1.warc.gz").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(x.page_id for x in rows if x.kind == "record") == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    gap = [x for x in rows if x.kind == "gap"]
    assert len(gap) == 1 and gap[0].start == sum(map(len, parts[:4])) and gap[0].reason


def ids(found):
    return [int(x.fields["x-page-id"]) for x in found if isinstance(x, warc.Record)]


def test_bad_record_in_a_member_of_several():
    raw = archive(12, plain=True)
    for hit in (0, 5, 11):
        bad = raw[hit][:30] + b"\0" + raw[hit][31:-9] + b"!" + raw[hit][-8:]
        before = sum(map(len, raw[:hit]))
        data = warc.member(b"".join(raw[:hit] + [bad] + raw[hit + 1 :]))
        found = list(warc.read_archive(data + warc.member(warc.record(99, "u", b"x", None))))
        assert ids(found) == [i for i in range(12) if i != hit] + [99]
        gap = [x for x in found if isinstance(x, warc.Gap)]
        assert [(x.start, x.end, x.inner) for x in gap] == [(0, len(data), (before, before + len(bad)))] and gap[0].reason


def test_member_of_several_with_a_bad_end():
    raw, after = archive(12, plain=True), warc.member(warc.record(99, "u", b"x", None))
    data = warc.member(b"".join(raw))
    crc = data[:-8] + bytes([data[-8] ^ 1]) + data[-7:]
    found = list(warc.read_archive(crc + after))
    assert ids(found) == [*range(12), 99] and found[0].reason and found[-1].reason is None
    cut = data[: len(data) * 2 // 3]
    whole = zlib.decompressobj(31).decompress(cut)
    n = max(i for i in range(13) if sum(map(len, raw[:i])) <= len(whole))
    assert 0 < n < 12
    for tail in (b"", after, warc.record(99, "u", b"x", None)):
        found = list(warc.read_archive(cut + tail))
        assert ids(found) == [*range(n)] + [99] * bool(tail)
        gap = [x for x in found if isinstance(x, warc.Gap)]
        assert [x.end for x in gap] == [len(cut)] and gap[0].start == found[0].end and gap[0].inner is None


def test_inner_gap_in_spark(spark, tmp_path):
    raw = archive(3, plain=True)
    (tmp_path / "part-0.warc.gz").write_bytes(warc.member(raw[0] + b"x" * 40 + raw[2]))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(x.kind, x.page_id) for x in rows] == [("record", 0), ("gap", None), ("record", 2)]
    assert (rows[1].inner_start, rows[1].inner_end) == (len(raw[0]), len(raw[0]) + 40)


def test_digests_of_other_forms(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    payload = b"hello"

    def rec(i, digest, kind="response", more=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nX-Page-Id: {i}\r\nContent-Type: application/http\r\nWARC-Payload-Digest: {digest}\r\n{more}Content-Length: {len(body)}\r\n\r\n"
        return warc.member(head.encode() + body + b"\r\n\r\n")

    sha1, sha256 = hashlib.sha1(payload).hexdigest(), hashlib.sha256(payload).hexdigest()
    parts = [
        rec(1, "sha1:" + sha1),
        rec(2, "SHA-256:" + sha256.upper()),
        rec(3, "sha256:" + "0" * 64),  # differs
        rec(4, "blake3:xyz"),
        rec(5, "sha1:notadigest!"),
        rec(6, "sha1:" + sha1, "revisit", "X-Payload-Length: five\r\n"),
        rec(7, "sha256:" + sha256, "revisit"),
        rec(8, "", "revisit"),
        rec(9, warc.sha1_base32(payload)),
    ]
    (tmp_path / "part-0").write_bytes(b"".join(parts))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert [x.reason for x in rows if x.kind == "gap"] == ["payload digest differs"]
    got = {x.page_id: (x.payload_bytes, x.payload_digest) for x in rows if x.kind == "record"}
    assert got == {1: (5, sha1), 2: (5, sha1), 4: (5, sha1), 5: (5, sha1), 6: (None, sha1), 7: (None, "sha256:" + sha256), 8: (None, None), 9: (5, sha1)}
