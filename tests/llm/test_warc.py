import gzip
import hashlib
import random

import pytest

from platewright.llm import warc as w

BIG = "<p>größe</p>" * 120
PAGES = [
    (1, "http://a/\r\nX: y", BIG),
    (5, "http://b/", BIG),
    (3, None, BIG),
    (2, "http://c/", None),
    (4, "http://d/", ""),
    (6, "http://e/", "short"),
    (7, "http://f/", "short"),
    (8, "http://g/", "tricky\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "z" * 1000),
    (None, "http://h/", "no id"),
    (9, "http://i/", "twice" * 300),
    (9, "http://i/", "twice" * 300),
]


def rows(spark, pages=PAGES):
    return spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record string")


def test_round_trip(spark, tmp_path):
    w.write(rows(spark), str(tmp_path / "a"), file_bytes=3000)
    got = w.read(spark, str(tmp_path / "a")).collect()
    assert all(r["gap"] is None for r in got) and len(got) == len(PAGES)
    by_id = {}
    for r in got:
        by_id.setdefault(r["record_id"], []).append(r)
    for page, _url, html in PAGES:
        full = (html or "").encode()
        for r in by_id[f"<urn:x-page:{'' if page is None else page}>"]:
            assert r["payload_bytes"] == len(full) and r["payload_digest"] == hashlib.sha1(full).hexdigest()
            if page in (1, 3):
                assert (r["type"], r["refers_to"]) == ("revisit", "<urn:x-page:5>")
            else:
                assert r["type"] == "response" and bytes(r["payload"]) == full and r["refers_to"] is None
    assert by_id["<urn:x-page:3>"][0]["url"] is None and "\r" not in by_id["<urn:x-page:1>"][0]["url"]


def test_empty_table(spark, tmp_path):
    w.write(rows(spark, []), str(tmp_path / "e"))
    assert w.read(spark, str(tmp_path / "e")).count() == 0
    assert w.read(spark, str(tmp_path / "none")).count() == 0


def record(k: int) -> bytes:
    body = bytes([65 + k]) * (50 + k)
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nWARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_recovers_later_records_and_logs_the_gap(zipped):
    parts = [gzip.compress(record(k), mtime=0) if zipped else record(k) for k in range(8)]
    rng = random.Random(5)
    for _ in range(60):
        hurt = rng.randrange(8)
        part = bytearray(parts[hurt])
        kind = rng.choice(["flip", "cut", "junk"])
        if kind == "flip":
            part[rng.randrange(len(part) - 60 if not zipped else len(part) - 4)] ^= 0x5A
        elif kind == "cut":
            del part[rng.randrange(10, len(part)) :]
        else:
            part = part + b"junk" * 9
        data = b"".join([*parts[:hurt], bytes(part), *parts[hurt + 1 :]])
        found = list(w.salvage(data))
        good = [h["warc-record-id"] for _, _, h, b in found if b is not None]
        lost = {f"<urn:x-page:{k}>" for k in range(8)} - set(good)
        assert len(lost) <= (2 if hurt < 7 and kind != "junk" else 1), (kind, hurt, found)
        at = 0
        for begin, finish, _, _ in found:
            assert begin == at and finish > begin
            at = finish
        assert at == len(data)


def test_not_an_archive():
    assert [x[:3] for x in w.salvage(b"nothing here")] == [(0, 12, "no version line")]
    assert list(w.salvage(b"")) == []


def test_plain_archive_with_a_damaged_first_line_and_a_gzip_body():
    def record(k, block):
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    first, zipped, third = record(1, b"a" * 5000), record(2, gzip.compress(b"body" * 99)), record(3, b"c")
    data = b"X" + first[1:] + zipped + third
    assert [(b, e, x is None) for b, e, _, x in w.salvage(data)] == [(0, len(first), True), (len(first), len(first + zipped), False), (len(first + zipped), len(data), False)]
    mixed = b"X" + first[1:] + gzip.compress(third) + zipped
    assert [x is None for _, _, _, x in w.salvage(mixed)] == [True, False, False]


def test_revisits_too_many_to_broadcast(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (1500 if i % 3 else 900 + i), 1) for i in range(40)], "page_id long, url string, html string, `a.b` int")
    assert sorted(r["record"] for r in w.records(pages).collect()) == sorted(r["record"] for r in w.records(pages, broadcast_ids=0).collect())
