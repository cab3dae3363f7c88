"""Archives: what is written is read again; frames open on their own with the dictionary; equal payloads are kept once."""

import hashlib
import io
import json
import random
import re

import pyarrow.fs as pafs
import pytest
import zstandard

from fumiyomi.llm import warc

PAGES = "page_id long, url string, html string, payload string, digest int, first long"


def pages_of(rng, n=60):
    body = lambda k: "<html><body>" + " ".join(rng.choice(["alpha", "beta", "gamma", "ünï", "日本"]) for _ in range(k)) + "</body></html>"
    rows = [(i, f"http://h{i % 3}.example/p/{i}", body(20 + i)) for i in range(n)]
    rows += [(100 + i, "http://copy.example/", rows[7][2]) for i in range(40)] + [(-5, "http://early.example/", rows[9][2])]
    rows += [(200, None, None), (201, "", ""), (202, "http://x/\r\nA: b <c>", "short"), (203, "u", "short"), (204, "u", "x" * 99), (205, "u", "x" * 99), (206, "u", "y" * 100), (207, "u", "y" * 100)]
    rows += [(None, "u", rows[7][2]), (None, None, "no id here " * 20), (300, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 20), (301, "u", "long " * 400_000), (7, rows[7][1], rows[7][2])]
    return rows


def brute(rows):
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in payload:
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in payload:
        f = first.get(p)
        again = f is not None and i != f
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = pages_of(random.Random(3))
    path = f"file://{tmp_path_factory.mktemp('warc')}/archives"
    warc.archive(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], PAGES).repartition(3), path)
    return path, rows


def test_pages_come_back(spark, folder):
    path, rows = folder
    assert sorted((tuple(r) for r in warc.pages_of(warc.archived(spark, path)).collect()), key=str) == brute(rows)


def test_texts_come_back(spark, folder):
    path, rows = folder
    kept = sorted(bytes(r["payload"]) for r in warc.archived(spark, path).filter("record_type = 'response'").collect())
    wanted = set(brute(rows))
    row = lambda i, p: (i, len(p), hashlib.sha256(p).hexdigest(), "response", None)
    assert kept == sorted(p for i, p in ((i, (h or "").encode()) for i, _, h in rows) if row(i, p) in wanted)


def test_each_record_is_a_frame_of_its_own(folder):
    fs, base = pafs.FileSystem.from_uri(folder[0])
    with fs.open_input_stream(f"{base}/{warc.MANIFEST}") as f:
        files = json.loads(f.read())
    records = 0
    for name in files:
        with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
            data = f.read()
        assert data[:4] == bytes.fromhex("5d2a4d18")
        n = int.from_bytes(data[4:8], "little")
        shared = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]))
        assert shared.as_bytes()[:4] == bytes.fromhex("37a430ec")
        rest = data[8 + n :]
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
            text = one.decompress(rest)
            head, _, block = text.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
            assert int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]) == len(block) - 4
            rest, records = one.unused_data, records + 1
    assert records == len(folder[1])


def test_archives_are_cut_and_saves_add_up(spark, tmp_path):
    rows = pages_of(random.Random(4), 30)
    df = warc.page_records(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], PAGES)).coalesce(1)
    path = f"file://{tmp_path}/a"
    for _ in range(2):
        warc.registered(spark)
        df.write.format("warczst").option("path", path).option("archiveBytes", "5000").mode("append").save()
    assert len(json.loads((tmp_path / "a" / warc.MANIFEST).read_text())) > 4
    assert warc.archived(spark, path).count() == 2 * len(rows)


def test_leftovers_of_failed_tasks_are_passed_over(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.archive(spark.createDataFrame([(1, "u", "h" * 500, "x", 1, 2)], PAGES), path)
    (tmp_path / "a" / "left.warc.zst").write_bytes(b"half a frame")
    assert warc.archived(spark, path).count() == 1


def test_empty_table_and_archives_of_others(spark, tmp_path):
    warc.archive(spark.createDataFrame([], PAGES), f"file://{tmp_path}/e")
    assert warc.archived(spark, f"file://{tmp_path}/e").count() == 0
    (tmp_path / "o").mkdir()
    plain = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    (tmp_path / "o" / "x.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(plain) * 2)  # no dictionary
    rows = warc.archived(spark, f"file://{tmp_path}/o").collect()
    assert [(r["record_type"], bytes(r["payload"])) for r in rows] == [("warcinfo", b"ab\r\n")] * 2


def test_a_cut_archive_is_an_error():
    out = io.BytesIO()
    archive = warc.Archive(out)
    archive.add(warc.record({"record_id": "urn:page:1", "record_type": "response", "target_uri": None, "date": None, "refers_to": None, "payload_digest": "d", "payload_bytes": 5, "payload": b"abcde"}))
    archive.begin()
    assert [r["payload"] for r in warc.opened(io.BytesIO(out.getvalue()))] == [b"abcde"]
    cut = zstandard.ZstdDecompressor().decompress(out.getvalue())[:-8]
    with pytest.raises(EOFError):
        list(warc.opened(io.BytesIO(zstandard.ZstdCompressor().compress(cut))))
