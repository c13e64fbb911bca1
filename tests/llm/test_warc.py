import base64
import gzip
import hashlib
import re

from groundset.llm import warc

PAGES = "page_id long, url string, html string"
HTML = '<html lang="en"><head><title> A\n b </title></head><body><a href="/x?y=1">Link</a><p>Text é</p></body></html>'


def _sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data.encode()).digest()).decode()


def test_records_are_linked_and_digests_kept(spark):
    pages = spark.createDataFrame([(1, "https://e.com/", HTML), (2, None, None), (2, None, None), (None, "u", "")], PAGES)
    sources = {r.record_id: r for r in warc.responses(pages).collect()}
    made = warc.derivatives(warc.responses(pages.selectExpr("*", "1 as block", "2 as record_id"))).collect()
    assert len(made) == 8 and len(sources) == 3
    for r in made:
        source = sources[r.refers_to]
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}>", r.record_id)
        assert r.uri == source.uri and r.date == source.date
        assert r.source_payload_digest == source.payload_digest == _sha1(source.payload)
        assert r.source_block_digest == _sha1(source.http_headers + source.payload)
        assert r.block_digest == _sha1(r.block) and r.content_length == len(r.block.encode())
    assert len({r.record_id for r in made}) == 6
    first = {r.record_type: r.block for r in made if r.page_id == 1}
    assert first["conversion"] == "Link\nText é"
    assert first["metadata"].split("\r\n")[:-1] == [
        "http-header: HTTP/1.1 200 OK", "http-header: Content-Type: text/html; charset=utf-8",
        f"http-header: Content-Length: {len(HTML.encode())}", "title: A b", "language: en", "outlink: /x?y=1",
    ]
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_files_hold_whole_records(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    records = warc.derivatives(warc.responses(pages))
    warc.write_derivatives(records, str(tmp_path / "out"))
    want = {r.record_id: r for r in records.collect()}
    seen = set()
    for path in (tmp_path / "out").glob("*.gz"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            block, data = rest[:n].decode(), rest[n:]
            assert head.startswith(b"WARC/1.1\r\n") and data.startswith(b"\r\n\r\n")
            data = data[4:]
            r = want[fields["WARC-Record-ID"]]
            assert block == r.block and fields["WARC-Refers-To"] == r.refers_to
            assert fields["WARC-Block-Digest"] == r.block_digest and fields["WARC-Target-URI"] == r.uri
            seen.add(r.record_id)
    assert seen == set(want)


def test_query(spark):
    from groundset.llm.queries import op10_warc_derivatives

    sf_dir = "/root/testdata/sf0.001"
    rows = op10_warc_derivatives(spark, sf_dir).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert sorted((r.page_id, r.record_type) for r in rows) == sorted(
        (k, t) for k in pages for t in ("metadata", "conversion")
    )
    assert all(r.source_payload_digest == _sha1(pages[r.page_id].html) for r in rows)
