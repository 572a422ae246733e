import hashlib

import zstandard
from snapscope.llm import warc
from snapscope.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string, bundle string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h or "") if len(data) >= 100 else None
        revisit = to is not None and to != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_round_trip_with_odd_rows(spark):
    long = "é" * 400_000
    rows = [(3, "http://a/é x", "p" * 100), (1, None, "p" * 100), (2, "http://b\r\nX: y", "p" * 100), (4, "u", "q" * 99), (5, "u", "q" * 99),
            (6, "u", None), (7, "u", ""), (8, "u", long), (9, "u", long), (None, "u", "p" * 100), (None, "u", "r" * 200), (None, "u", "r" * 200), (1, "u", "p" * 100),
            (10, "u", "HTTP/1.1 200\r\n\r\nnested\r\n\r\n" * 9)]
    got = warc.archive_and_read(pages(spark, rows)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert {r.url for r in got if r.page_id == 3} == {"http://a/é x"} and {r.url for r in got if r.page_id == 2} == {"http://b\r\nX: y"}


def test_frames_decompress_alone_and_whole(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(60)]
    folder = fresh_path(spark, "bundles")
    places = warc.write_bundles(pages(spark, rows), folder, frame_bytes=2000, bundle_bytes=4000)
    assert places.select("bundle").distinct().count() > 2 and places.count() == 60
    fs, path = warc.file_system(folder)
    place = places.where("record_id = 17").first()
    with fs.open_input_file(f"{path}/{place.bundle}") as f:
        start, size, full = warc.read_seek_table(f)[place.frame]
        data = zstandard.ZstdDecompressor().decompress(f.read_at(size, start), max_output_size=full)
        record = data[place.offset : place.offset + place.length]
        assert record.startswith(b"WARC/1.1\r\n") and b"<urn:page:17>" in record and record.endswith(rows[17][2].encode() + b"\r\n\r\n")
        f.seek(0)
        whole = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == places.where(places.bundle == place.bundle).count()


def test_hot_payload_and_empty_table(spark):
    rows = [(i, "u", "same" * 50) for i in range(2500)]
    got = warc.archive_and_read(pages(spark, rows))
    assert got.where("record_type = 'response'").count() == 1 and got.where("refers_to = 0").count() == 2499
    assert warc.archive_and_read(pages(spark, rows).limit(0)).count() == 0
