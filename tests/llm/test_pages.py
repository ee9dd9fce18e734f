"""HTML extraction and WARC archives."""

import base64
import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tabularium.llm import html_extract, shared, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="page">
<header><h2>Site</h2></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First&nbsp;line<br>goes   on.<br><p>Second &lt;b&gt; &#233;<!-- gone --> a < b</p><div class="ad">Buy</div>
<ul><li>one<li>two</ul><table><tr><td>x<td>y</table><div class="share-buttons">Share</div><form>Mail<input></form></article>
<section id="comments"><p>Reader says</p></section><aside>More</aside><footer>&copy; site</footer>"""


def text_of(page: str) -> str:
    return "\n".join(b["text"] for b in html_extract.page_parts(page)["blocks"])


def test_article_is_extracted():
    assert text_of(PAGE) == "Title & more\nFirst line goes on.\nSecond <b> é a < b\none\ntwo\nx\ny"


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<p>a</i></div>b", "ab"), ("<script>never ends", ""), ("<p>x <a title='>'>y</a", "x y"), ("<div>" * 3000 + "deep", "deep"),
    ("<main><p>m</p></main><p>out</p>", "m"), ("<p>a&amp;amp;b &notit;", "a&amp;b ¬it;"), ("<P HIDDEN>h</P><p>s", "s"), ("<article class=comment><p>no</p></article><p>yes", "yes"),
])
def test_odd_pages(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize("page, text", [
    ("<main><p>long text of the page here</p><article>teaser</article></main>", "long text of the page here\nteaser"),
    ("<body><article><p>one</p></article><article><p>two and more</p></article></body>", "one\ntwo and more"),
    ("<div class='content has-sidebar'><p>the text of it</p><nav>x</nav></div>", "the text of it"),
    ("<div class=notice-board-page><h1>Board</h1><p>words of the page</p></div><p>small print</p>", "Board\nwords of the page\nsmall print"),
    ("<article class='post comments-open'><p>body text</p></article>", "body text"),
    ("<article><p>story</p></article><div class=comments><p>much longer words of many readers</p></div>", "story"),
    ("<article><p>s</p></article><div class=sidebar><p>much longer than the story</p></div>", "s"),
    ("<div class=comments><p>nothing but readers</p></div>", ""),
])
def test_labels_and_articles_that_carry_the_text(page, text):
    assert text_of(page) == text


def test_recurring_subtrees_of_a_host_go(spark):
    page = "<body><div class=box><span>Follow us</span> today</div><div><p>Body of page {0} {1}</p></div></body>"
    rows = [(i, "http://a.example/x", page.format(i, "words " * 9)) for i in range(12)] + [(50 + i, "http://b.example/x", page.format(i, "words " * 9)) for i in range(3)]
    # copies of one page are one body: they make no template of its paragraphs
    rows += [(100 + i, "https://a.example", "<div><p>The same text everywhere</p></div>") for i in range(30)]
    rows += [(200 + i, "https://a.example", f"<article><p>Long opening of article number {i} here</p><p>Shared paragraph.</p><div>Tap to share</div></article>") for i in range(12)]
    found = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)).collect()}
    assert found[3] == "Body of page 3 " + ("words " * 9).strip()
    assert found[51].startswith("Follow us today\n") and found[110] == "The same text everywhere"
    assert found[205] == "Long opening of article number 5 here\nShared paragraph."


def edge_pages(spark):
    rows = [(1, "http://h/a", "<p>x</p>", 1, 2), (2, None, None, 1, 2), (3, "u", "", 1, 2), (3, "u", "", 1, 2), (None, "http://h/b\r\nX: y", "<p>x</p>", 1, 2), (5, "u", "<p>" + "long é " * 50_000, 1, 2), (6, "u", "<p>x</p>", 1, 2)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, row int, host int").repartition(3)


def test_page_edge_cases(spark):
    pages = edge_pages(spark)
    rows = html_extract.main_text(pages).collect()
    assert len(rows) == 7 and all(r.n_chars == len(r.text) for r in rows)
    assert {r.page_id: r.text for r in rows if r.page_id in (2, 3)} == {2: "", 3: ""}
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_archives_come_back_whole(spark):
    pages = edge_pages(spark)
    rows = warc.round_trip(pages).collect()
    digest = lambda html: base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    want = [(p.page_id, len((p.html or "").encode()), digest(p.html)) for p in pages.collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in rows), key=key) == sorted(want, key=key)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in rows}
    assert kinds == {(1, "response", None), (6, "revisit", 1), (None, "revisit", 1), (2, "response", None), (3, "revisit", 2), (5, "response", None)}
    assert {bytes(r.payload).decode() for r in rows if r.payload is not None} == {p.html or "" for p in pages.collect()}
    only_long = warc.with_revisits(pages, min_bytes=100)
    assert only_long.filter("record_type = 'revisit'").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_each_record_is_a_member_at_its_offset(spark):
    folder = shared.shared_folder(spark, "test-warc")
    warc.write_monolithic(warc.with_revisits(edge_pages(spark)).coalesce(1), f"{folder}/in", records_per_file=4)
    index = warc.normalise(spark, f"{folder}/in", f"{folder}/out").collect()
    store, root = warc.file_system(f"{folder}/out")
    assert len(index) == 7 and len({r.archive for r in index}) == 2
    for r in index:
        data = store.open_input_file(f"{root}/{r.archive}").read()
        assert zlib.decompressobj(31).decompress(data[r.offset :]).startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        assert gzip.decompress(data[r.offset : r.offset + r.length]).endswith(b"\r\n\r\n")


def test_broken_archives_are_errors():
    record = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    packed = gzip.compress(record * 3)
    assert len(list(warc.split_records(warc.inflate(packed)))) == 3
    assert len(list(warc.split_records(warc.inflate(packed + packed)))) == 6
    for broken in (packed[:-12], gzip.compress(record[:-1]), gzip.compress(b"x" + record)):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.split_records(warc.inflate(broken)))


def test_native_base32(spark):
    texts = ["", "a", "é" * 99]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32_sha1(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts}
