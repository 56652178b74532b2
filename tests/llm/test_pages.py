"""HTML extraction and WARC packages."""

import io
import zipfile

import pytest
from pyarrow import fs

from assayline.llm import html_extract, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<div class="cookie-notice"><p>We use cookies for many good reasons, please accept them all now.</p></div>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News &amp; more</a></li></ul></nav>
<article><h1>A  title</h1><p>First &eacute; paragraph<br>with a <a href="#">link</a> &lt;b&gt; in it.
<p><b>Bold start of the second paragraph without an end.<br><p>Third.</p>
<script>var x = "</p><p>never";</script><!-- <p>nor this</p> --></article>
<section id="comments"><p>A reader says that all of this is a very long and quite interesting comment.</p></section>
<aside><p>Some words in the side column that nobody needs.</p></aside>
<footer>&copy; us</footer></body></html>"""


@pytest.fixture(scope="module")
def tree(spark):
    return html_extract.train(spark)


def test_extraction(spark, tree):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (1, "u", PAGE), (4, "u", "<p>cut <b"), (5, "u", "<article><p>a</p><p>" + "b " * 9000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(pages, tree)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    text = {r.page_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert text[1].text == (
        "A title\n\nFirst é paragraph with a link <b> in it.\n\n"
        "Bold start of the second paragraph without an end.\n\nThird."
    )
    assert text[1].n_chars == len(text[1].text)
    assert text[2].text == text[3].text == "" and text[2].n_chars == 0
    assert text[5].text == "a\n\n" + " ".join("b" * 9000)
    assert html_extract.extract(pages.limit(0), tree).count() == 0


def test_held_out_accuracy(spark, tree):
    right = total = 0

    def decide(node, x):
        while not isinstance(node, int):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        return node

    for page, labels in html_extract.labelled_pages(seed=77, pages=80):
        for x, y in zip(html_extract._neighbours(html_extract.blocks(page)), labels, strict=True):
            right += decide(tree, x) == y
            total += 1
    assert right / total > 0.97


ARTICLE = (
    "<h1>Rivers of the north</h1><p>The long river rises in the hills and runs east for many days before it meets the sea.</p>"
    "<p>Boats went up as far as the rapids, where the goods were carried over land by men and mules.</p><p>Few do so today.</p>"
)
BODY = (
    "Rivers of the north\n\nThe long river rises in the hills and runs east for many days before it meets the sea.\n\n"
    "Boats went up as far as the rapids, where the goods were carried over land by men and mules.\n\nFew do so today."
)
MENU = '<ul><li><a href="/">Start</a></li><li><a href="/n">News</a></li><li><a href="/m">Maps and plans</a></li></ul>'
HAND_LABELLED = [
    # names that look like furniture around a whole article
    (f'<body class="home has-sidebar">{ARTICLE}</body>', BODY),
    (f'<div class="entry-content comments-open">{ARTICLE}</div>', BODY),
    (f'<div class="social-science">{ARTICLE}</div>', BODY),
    (f'<div class="form-article">{ARTICLE}</div>', BODY),
    # short paragraphs and links in an article
    ('<article><p>Short one.</p><p><a href="#">A paragraph that is a link</a></p><p>Last words.</p></article>',
     "Short one.\n\nA paragraph that is a link\n\nLast words."),
    ("<h1>Notice of change</h1><p>We have moved.</p><p>The new hall is round the corner.</p><p>See you there.</p>",
     "Notice of change\n\nWe have moved.\n\nThe new hall is round the corner.\n\nSee you there."),
    # usual pages
    (f"<nav>{MENU}</nav><main>{ARTICLE}</main><footer><p>All rights reserved by us.</p></footer>", BODY),
    (f'<div id="top-menu">{MENU}</div><div class="post-content">{ARTICLE}</div><div id="site-footer"><p>Imprint and so on</p></div>', BODY),
    (f'<header><p>The river paper, daily since long ago</p></header><article>{ARTICLE}</article>', BODY),
    (f'<article><header><h1>Rivers of the north</h1></header>{ARTICLE.partition("</h1>")[2]}</article><aside><p>Read this too.</p></aside>', BODY),
    (f'<article>{ARTICLE}</article><section id="comments"><p>I liked this very much, please write more of it.</p><p>So did I.</p></section>', BODY),
    (f'<div class="cookie-banner"><p>We use cookies to make this page work for you, click here.</p></div><article>{ARTICLE}</article>', BODY),
    (f'<main>{ARTICLE}<div class="newsletter"><p>Sign up for letters from us, once a week.</p></div></main>', BODY),
    (f'<article>{ARTICLE}<form><p>Send us your own view of it.</p></form></article>', BODY),
    (f'<div>{MENU}</div><div>{ARTICLE}</div>', BODY),
    (f'<main>{ARTICLE}</main><div class="related"><ul><li><a href="#">Lakes of the south</a></li><li><a href="#">Hills</a></li></ul></div>', BODY),
]


def test_hand_labelled_pages(spark, tree):
    pages = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(HAND_LABELLED)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages, tree).collect()}
    wrong = {i: got[i] for i, (_, want) in enumerate(HAND_LABELLED) if got[i] != want}
    assert not wrong


def test_odd_markup():
    texts = lambda page: [b[0] for b in html_extract.blocks(page)]
    assert texts("a < b and c<1") == ["a < b and c<1"]
    assert texts('<p title="a > b">x</p>') == ["x"]
    assert texts("<p title='unclosed>x</p>y") in (["x", "y"], ["x</p>y"])
    assert texts("<P>x<DIV>y</DIV></P>&nbsp; &am") == ["x", "y", "&am"]
    assert texts("<script>never ends <p>x") == []
    assert texts("<ul><li>a<li>b</ul>") == ["a", "b"]
    link = html_extract.blocks('<li><a href="x">one two</a> three')[0]
    assert link[1:3] == (3, 2)


def pages_of(spark):
    rows = [(1, "http://a/\nb", "x"), (2, "http://b", "é" * 50), (3, None, "x"), (5, "http://c", None), (6, "http://d", ""),
            (None, "http://e", "x"), (None, "http://f", "only null"), (2, "http://b", "é" * 50), (9, "u", "<p>" * 70000)]
    rows += [(100 + i, f"http://h/{i}", "same" if i % 2 else f"own {i}") for i in range(60)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_round_trip(spark, tmp_path):
    rows, pages = pages_of(spark)
    folder = f"file://{tmp_path}/w"
    packages = warc.write(pages.repartition(4), folder, package_bytes=1500).cache()
    got = warc.read(packages, run_bytes=700).collect()
    assert packages.count() > 4 and sum(r.records for r in packages.collect()) == len(rows)
    raw = [((r[2] or "").encode(), r[0]) for r in rows]
    top = {}
    for body, i in raw:
        top[body] = max((x for x in (top.get(body), i) if x is not None), default=None)
    want = [
        (i, len(b), warc.digest(b), "response" if i == top[b] else "revisit", None if i == top[b] else top[b]) for b, i in raw
    ]
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    bodies = {i: b for b, i in raw if i is not None}
    assert all(r.payload == bodies[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    path = packages.first().path.removeprefix("file://")
    with zipfile.ZipFile(path) as opened:  # other readers can open it
        assert opened.testzip() is None and warc.DATA in opened.namelist()
    assert warc.archived(spark, pages.limit(0), folder).count() == 0


@pytest.mark.parametrize("limit", [zipfile.ZIP64_LIMIT, 10])
def test_directories_of_both_kinds(tmp_path, monkeypatch, limit):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("first", b"a" * 100)
        out.writestr("packed", b"b" * 100, compress_type=zipfile.ZIP_DEFLATED)
        out.writestr("second", b"c" * 50)
        out.comment = b"a comment"
    with fs.LocalFileSystem().open_input_file(str(path)) as source:
        found = warc.members(source)
        assert set(found) == {"first", "second"}
        at, size = found["second"]
        source.seek(at)
        assert source.read(size) == b"c" * 50
    assert (b"PK\6\6" in path.read_bytes()) == (limit == 10)


def test_damage_is_noticed():
    class Memory(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    with pytest.raises(ValueError):
        warc.members(Memory(b"not a zip file"))
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1\r\n\r\n")


def test_record_ids_hold_page_ids():
    for i in (0, 1, -5, 2**63 - 1, -(2**63), None):
        assert warc.page_of(warc.record_id(i)) == i
