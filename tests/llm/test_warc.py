import hashlib
from base64 import b32encode
from html.parser import HTMLParser

from fairledger.llm import warc


class Plain(HTMLParser):
    """An independent reading of well-formed markup."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.out.append("\n" if tag in warc.LINES else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.out.append("\n" if tag in warc.LINES else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)

    @classmethod
    def of(cls, markup):
        p = cls()
        p.feed(markup)
        p.close()
        lines = [" ".join(x.replace("\xa0", " ").split()) for x in "".join(p.out).split("\n")]
        return "\n".join(x for x in lines if x)


def test_pages_like_an_html_parser(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z")).where("type = 'conversion'")
    texts = {r.target_uri: r for r in got.collect()}
    rows = pages.collect()
    same = sum(texts[r.url].block.split() == Plain.of(r.html).split() for r in rows)
    assert len(texts) == len({r.url for r in rows}) and same >= 0.95 * len(rows)


def test_linked_records(spark):
    page = (
        "<title>A &amp; b</title><style>x{}</style><p class='a>b'>One<br>two&nbsp;three</p>"
        "<!-- <p>no --><script>var a = '<p>no</p>';</script><a href='../x?y=1'>go</a>"
        "<td>c<td>d <i>e</i> 1 < 2 <p title=\"broken>f")
    data = [("<urn:uuid:1>", "http://h/a/b", "2020-02-02T00:00:00Z", "HTTP/1.1 404 No\r\nContent-Type: Text/HTML; x",
             None, page),
            ("<urn:uuid:2>", None, None, None, "sha1:GIVEN", None),
            ("<urn:uuid:3>", "http://h/c", None, "HTTP/1.1 200 OK\r\ncontent-type: image/png", None, "\\x"),
            ("<urn:uuid:4>", "http://[bad", None, "HTTP/1.1 200 OK\r\nContent-Type: text/plain", None, " a <b>\n"),
            (None, "http://h/d", None, None, None, "<a href='http://[::bad'>x</a>")]
    data += [data[0]]
    table = spark.createDataFrame([(*r, "extra") for r in data], warc.RESPONSE + ", block string")
    got = warc.derive(table).collect()
    by = {(r.refers_to, r.type): r for r in got}
    assert len(got) == 11 and ("<urn:uuid:3>", "conversion") not in by
    one = by["<urn:uuid:1>", "conversion"]
    assert one.block == 'A & b\nOne\ntwo three\ngo c d e 1 < 2\nf'
    own = "sha1:" + b32encode(hashlib.sha1(page.encode()).digest()).decode()
    meta = by["<urn:uuid:1>", "metadata"]
    assert one.source_payload_digest == own and one.digest_matches and meta.target_uri == "http://h/a/b"
    assert meta.block.split("\r\n") == [
        "source-content-type: text/html", "http-status: 404", f"source-payload-digest: {own}",
        f"conversion-record-id: {one.record_id}", f"conversion-block-digest: {one.block_digest}",
        "title: A & b", "outlink: http://h/x?y=1", ""]
    assert by["<urn:uuid:2>", "conversion"].block == "" and not by["<urn:uuid:2>", "metadata"].digest_matches
    assert by["<urn:uuid:2>", "metadata"].source_payload_digest == "sha1:GIVEN"
    assert by["<urn:uuid:4>", "conversion"].block == "a <b>"
    assert warc.derive(table.limit(0)).count() == 0


def test_files_round_trip(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    records = warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z"))
    path = str(tmp_path / "warc")
    warc.write(records, path, per_file=37)
    back = warc.read(spark, path)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, records.select(back.columns).collect()))


def test_long_and_odd_markup():
    for markup in ("<" * 50_000, "<a '" * 20_000, "<script>" * 20_000, "<!--" * 20_000, "x" * 500_000, ""):
        warc.plain(markup, "http://h/")
