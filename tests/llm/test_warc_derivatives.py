import gzip
import hashlib

from critiq.llm import warc_derivatives as W

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script>
</head><body><!-- not <b>this</b> --><p>One <b>bold</b>&nbsp;word</p><br/>two   lines<ul><li>x</li><li>&lt;y&gt;</li></ul>
</body></html>"""


def digest(data):
    return "sha256:" + hashlib.sha256(data).hexdigest()


def derived(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    return W.derive_records(W.responses_of_pages(pages, date="2020-01-01T00:00:00Z"))


def test_records_are_linked(spark):
    found = {r["warc_type"]: r for r in derived(spark, [(7, "http://a/b", PAGE, "old")]).collect()}
    text, metadata = found["conversion"], found["metadata"]
    assert text["block"] == "A & B\nOne bold word\ntwo lines\nx\n<y>"
    assert text["refers_to"] == metadata["refers_to"] and text["concurrent_to"] == metadata["record_id"]
    assert f"conversion: {text['record_id']}\r\n" in metadata["block"]
    headers = text["source_headers"]
    assert headers.endswith(f"Content-Length: {len(PAGE.encode())}") and headers == metadata["source_headers"]
    assert text["source_payload_digest"] == digest(PAGE.encode())
    assert text["source_block_digest"] == digest(f"{headers}\r\n\r\n{PAGE}".encode())
    for row in (text, metadata):
        assert row["block_digest"] == digest(row["block"].encode())
        assert row["content_length"] == len(row["block"].encode()) and row["page_id"] == 7
    again = derived(spark, [(7, "http://a/b", PAGE, "other")]).collect()
    assert {r["record_id"] for r in again} == {text["record_id"], metadata["record_id"]}


def test_unclosed_and_odd_markup(spark):
    cases = {
        "<p>a<script>never closed": "a",
        "a<!-- never closed": "a",
        "a < b and c > d": "a < b and c > d",
        "<P CLASS='x'>a</P\n>b": "a\nb",
        "<sCRipt src=x>1</SCRIPT >é": "é",
        "a&amp;lt;b": "a&lt;b",
        "": "",
        None: "",
        " \t\n ": "",
    }
    rows = [(i, "u", html, "") for i, html in enumerate(cases)]
    found = {r["page_id"]: r["block"] for r in derived(spark, rows).where("warc_type = 'conversion'").collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())


def test_edge_cases(spark):
    rows = [(None, None, None, None), (1, "u", "<p>x", None), (1, "u", "<p>x", None)]
    found = derived(spark, rows)
    assert found.count() == 6 and found.select("record_id").distinct().count() == 4
    responses = spark.createDataFrame(
        [(None, "u", None, None, "<p>x"), ("<urn:uuid:1>", None, None, "H: 1", None)],
        "source_id string, source_uri string, source_date string, source_headers string, payload string",
    )
    by_source = {r["refers_to"] for r in W.derive_records(responses).collect()}
    assert "<urn:uuid:1>" in by_source and len(by_source) == 2 and None not in by_source
    assert derived(spark, []).count() == 0


def test_written_records_can_be_read(spark, tmp_path):
    path = str(tmp_path / "out")
    records = derived(spark, [(i, f"http://a/{i}", PAGE, "") for i in range(5)])
    W.write_records(records, path)
    data = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "out").glob("*.gz")))
    seen = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block, closing, data = rest[:size], rest[size : size + 4], rest[size + 4 :]
        assert lines[0] == "WARC/1.1" and closing == b"\r\n\r\n"
        assert fields["WARC-Block-Digest"] == digest(block) and fields["WARC-Date"] == "2020-01-01T00:00:00Z"
        seen.append((fields["WARC-Type"], fields["WARC-Record-ID"]))
    assert sorted(seen) == sorted((r["warc_type"], r["record_id"]) for r in records.collect())
