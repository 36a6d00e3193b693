import hashlib

import zstandard
from pyarrow import fs

from strideline.llm import warc


def test_round_trip_with_copies_nulls_and_single_records(spark, tmp_path):
    folder = f"file://{tmp_path}/bundles"
    html = {3: "<p>é</p>", 1: "<p>é</p>", 7: None, 9: "", 12: "x\r\n\r\ny" * 4000, 4: "WARC/1.1\r\n\r\n"}
    rows = [(k, f"http://x/{k}\n", v, "z") for k, v in html.items()] + [(12, None, html[12], None), (None, "u", "<p>é</p>", None), (None, None, "alone", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first string")
    index = warc.write_archive(pages, folder, frame_bytes=100, bundle_bytes=5000)
    got = {(r.page, r.payload_digest): r for r in warc.read_archive(index, folder, group=2).collect()}
    assert index.count() == len(rows)
    for k, _, v, _ in rows:
        r = got[(None if k is None else str(k)), warc.digest((v or "").encode())]
        first = {"<p>é</p>": "1", None: "7", "": "7"}.get(v)
        assert r.payload_bytes == len((v or "").encode())
        assert r.refers_to == (first if first and first != str(k) else None)
        assert r.record_type == ("revisit" if r.refers_to else "response")
    place = index.where("page = '4'").first()
    fields, payload = warc.fetch(folder, place.bundle, place.frame, place.at, place.length)
    assert payload == html[4].encode() and fields["WARC-Type"] == "response"
    store, path = fs.FileSystem.from_uri(folder)
    for file in store.get_file_info(fs.FileSelector(path)):
        data = store.open_input_file(file.path).read()
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read().startswith(b"WARC/1.1")


def test_small_payloads_can_all_be_responses_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    index = warc.write_archive(pages, f"file://{tmp_path}/a", smallest=3)
    assert {r.record_type for r in warc.read_archive(index, f"file://{tmp_path}/a").collect()} == {"response"}
    assert warc.read_archive(warc.write_archive(pages.limit(0), f"file://{tmp_path}/b"), f"file://{tmp_path}/b").count() == 0
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest() == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
