"""Main text of pages and WARC archives."""

import time
import base64
import hashlib

import pytest

from boxlake.llm import html_text, warc

SCHEMA = "page_id bigint, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">Accept cookies now please</div>
<div id="content"><article><h1>Title &amp; more</h1><p>First   paragraph with <a href="#">a link</a> and text.<p>Second<br>line &lt;b&gt; &#x41;&#66;.
<div class="ad">Buy this</div><ul><li>one</li><li>two</li></ul><form><input name=q><label>Search</label></form></article>
<section class="comments"><p>A reader wrote a rather long comment here, longer than the article perhaps, on and on.</p></section></div>
<aside><p>Sidebar text that is long enough to matter for density.</p></aside><footer>&copy; 2024</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.extract(PAGE) == "Title & more First paragraph with a link and text. Second line <b> AB. one two"


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("just words &amp; no tags", "just words & no tags"),
        ("<p>a<p>b", "a b"),
        ("<body><script>x</script>", ""),
        ("<div><p>un<b>closed", "unclosed"),
        ("<p>a<!-- no --> b</p>", "a b"),
        ("<p>x\n\t y</p><nav>menu</nav>", "x y"),
        ("<" * 50, "<" * 50),
    ],
)
def test_odd_html(html, text):
    assert html_text.extract(html) == text


def test_deep_and_long_pages():
    assert html_text.extract("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    words = " ".join(f"w{i}" for i in range(50_000))
    assert html_text.extract(f"<article><p>{words}</p></article>") == words


BODY = "A sentence of the article that is long enough to count as text. " * 4


@pytest.mark.parametrize("name", ["class='container with-sidebar'", "class=no-sidebar", "class=long-form", "id=has-comments", "class=sidebar", "class='form'"])
def test_wrappers_of_the_article_stay(name):
    assert html_text.extract(f"<body><div {name}><article><p>{BODY}</p></article></div>") == BODY.strip()
    assert html_text.extract(f"<body><div {name}><p>{BODY}</p><p>{BODY}</p></div>") == f"{BODY}{BODY}".strip()


@pytest.mark.parametrize("part", ["<section id='related-work'><p>kept</p></section>", "<h2 id='search-and-menu'>kept</h2>", "<h2 id='comments'>kept</h2>", "<p class='notice-board'>kept</p>"])
def test_longer_names_inside_an_article_stay(part):
    assert html_text.extract(f"<article><p>{BODY}</p>{part}</article>") == f"{BODY}kept"


@pytest.mark.parametrize("name", ["class='ad'", "class='box cookie-notice'", "id='main-menu'", "class='related-posts'", "class='sidebar-left'", "id='comments'"])
def test_parts_with_a_name_of_their_own_go(name):
    part = f"<div {name}><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p></div>"
    assert html_text.extract(f"<body><article><p>{BODY}</p></article>{part}") == BODY.strip()
    assert html_text.extract(f"<body><article><p>{BODY}{BODY}</p><div {name}><p>gone</p></div></article>") == f"{BODY}{BODY}".strip()
    replies = f"<div id='comments'><article>{BODY}{BODY}</article></div>"
    assert html_text.extract(f"<body><main><p>{BODY}</p>{replies}</main>") == BODY.strip()


LEAD, PARAGRAPH = "lead " * 40, "para " * 80
TEN = f"<p>{PARAGRAPH}</p>" * 10


@pytest.mark.parametrize("tag", ["p", "div", "section"])
def test_title_and_lead_of_a_page_of_divs_stay(tag):
    want = f"Title {LEAD}{PARAGRAPH * 10}end".strip()
    post = f"<h1>Title</h1><{tag}>{LEAD}</{tag}><div class=body>{TEN}</div><p>end</p>"
    menu = "<div id=x><ul>" + "".join(f"<li><a href='/{i}'>menu item {i}</a></li>" for i in range(9)) + "</ul></div>"
    small = "<div id=bottom>2024 Company</div>"
    assert html_text.extract(f"<body><div class=post>{post}</div>") == want
    assert html_text.extract(f"<body>{menu}<div><div class=post>{post}</div></div>{menu}{small}") == want
    assert html_text.extract(f"<body><div><h1>Title</h1><{tag}>{LEAD}</{tag}><div><div>{TEN}</div></div><p>end</p></div>{menu}") == want


@pytest.mark.parametrize("wrapper", ["<div class='container has-sidebar'>{}</div>", "<div class='post share-enabled'>{}</div>", "<form id='aspnetForm'>{}</form>", "<form><main>{}</main></form>"])
def test_a_wrapper_of_the_page_stays(wrapper):
    for inner in (f"<article><h1>T</h1><p>{BODY}</p></article>", f"<h1>T</h1><p>{BODY}</p>"):
        assert html_text.extract("<body>" + wrapper.format(inner)) == f"T {BODY}".strip()


def test_several_articles_and_a_headline_in_a_block_of_its_own():
    one, two = (f"<article><p>{BODY}{x}</p></article>" for x in ("one", "two"))
    links = f"<article><a href=x>{BODY}</a></article>"
    assert html_text.extract(f"<body>{one}{two}{links}") == f"{BODY}one {BODY}two"
    assert html_text.extract(f"<body><div>{links}{two}</div><div>{one}</div>") == f"{BODY}two {BODY}one"
    assert html_text.extract(f"<body><div><h1>Head</h1></div><div class=c><p>{BODY}</p><p>{BODY}</p></div>") == f"Head {BODY}{BODY}".strip()
    assert html_text.extract(f"<body><article><p>{BODY}</p><form><p>Search this site</p></form></article>") == BODY.strip()


def plain_sums(node):
    """The composite density's definition, by recursion: (chars, link chars, tags, link tags), and sums by node."""
    import re

    size = lambda text: len(re.sub(r"[\x20\x09-\x0D]", "", text))
    counts, sums = {}, {}

    def count(n):
        kids = [k for k in n.kids if not isinstance(k, str) and not k.dropped]
        inner = [count(k) for k in kids]
        chars = sum(size(k) for k in n.kids if isinstance(k, str)) + sum(x[0] for x in inner)
        counts[n] = (chars, chars if n.tag == "a" else sum(x[1] for x in inner), sum(x[2] + 1 for x in inner), sum(x[3] + (k.tag == "a") for k, x in zip(kids, inner)))
        return counts[n]

    whole, all_links = count(node)[:2]

    def density(n):
        import math

        c, lc, t, lt = counts[n]
        if not c:
            return 0.0
        scale = math.log(c / max(c - lc, 1) * lc + all_links / max(whole, 1) * c + math.e) if lc else math.log(all_links + math.e)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0) + 1.0) / max(scale, 1.0)

    for n in counts:
        sums[n] = sum(density(k) for k in n.kids if not isinstance(k, str) and not k.dropped) + sum(size(k) for k in n.kids if isinstance(k, str))
    return sums


def test_sums_follow_the_definition(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()] + [PAGE, f"<body><div>{TEN}</div><a href=x>{BODY}</a>"]
    for html in pages:
        root = html_text.parse(html or "")
        want = plain_sums(root)
        nodes = html_text.measure(root)
        assert {n: pytest.approx(want[n]) for n in nodes} == {n: n.total for n in nodes}
        assert want[max(nodes, key=lambda n: n.total)] == pytest.approx(max(want.values()))


def test_text_beside_the_path_stays():
    got = html_text.extract(f"<body><div>Some words <b>before</b> the text<div>{TEN}</div>{'dense ' * 300}<a href=x>link</a></div>")
    assert got == f"Some words before the text {PARAGRAPH * 10}{'dense ' * 300}link"
    assert html_text.extract(f"<body><div><div>{TEN}</div></div><section>{TEN}</section>") == (PARAGRAPH * 20).strip()


def test_whole_column(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None)], SCHEMA).withColumn("text", F.lit("clash"))
    rows = html_text.extract_text(pages).orderBy("page_id").collect()
    assert [(r.page_id, r.n_chars) for r in rows] == [(1, len(html_text.extract(PAGE))), (2, 0), (2, 0)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "http://a/ü b", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "u\r\nx", None), (4, "v", ""), (7, "w", "é" * 100_000), (8, "w", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(pages, SCHEMA).repartition(2)
    warc.write_warc(df, str(tmp_path / "w"))
    rows = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert len(rows) == len(pages)
    for page_id, _, html in pages:
        payload = (html or "").encode()
        r = rows[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
    kinds = {k: (r.record_type, r.refers_to) for k, r in rows.items()}
    assert kinds == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 4), 4: ("response", None), 7: ("response", None), 8: ("response", None)}
    warc.write_warc(df, str(tmp_path / "w"))  # again: the same files
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == len(pages)


def test_warc_edges(spark, tmp_path):
    repeated = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "b", "x")], SCHEMA)
    manifest = warc.write_warc(repeated, str(tmp_path / "r"))
    assert sorted(str(r.record_type) for r in warc.read_warc(spark, str(tmp_path / "r"), manifest).collect()) == ["response"] * 3
    assert warc.write_warc(repeated.limit(0), str(tmp_path / "e")).count() == 0
    large = spark.createDataFrame([(1, "a", "xy"), (2, "a", "xy")], SCHEMA)
    warc.write_warc(large, str(tmp_path / "m"), min_bytes=3)
    assert {r.record_type for r in warc.read_warc(spark, str(tmp_path / "m")).collect()} == {"response"}


def test_archive_of_many_records_has_a_trained_dictionary():
    records = [warc.warc_record(i, f"http://x/{i}", f"<html><body><p>page {i} of many alike</p></body></html>".encode() * 3, None, False, "2025-01-01T00:00:00Z") for i in range(500)]
    content = warc.archive(records)
    assert int.from_bytes(content[:4], "little") == warc.SKIPPABLE_MAGIC
    assert list(warc.records_in(content)) == records
    assert len(content) - int.from_bytes(content[4:8], "little") < sum(map(len, records)) / 3
    assert list(warc.records_in(warc.archive(records[:1]))) == records[:1]


@pytest.mark.parametrize("wrap", ["{}", "<div id='content'>{}</div>"])
@pytest.mark.parametrize("title", ["", "<h2>Title</h2>", "<h3><a href='q'>Linked title</a></h3>"])
@pytest.mark.parametrize("sizes", [(1, 2, 1), (1, 5, 1), (2, 1, 3)])
def test_posts_beside_each_other_all_stay(sizes, title, wrap):
    """However long each is, and whether they are articles or not."""
    posts = "".join(f"<div class='post'>{title}" + f"<p>{'post' + str(i)} has words that go on and on for a while.</p>" * n + "</div>" for i, n in enumerate(sizes))
    for body in (posts, posts.replace("<div class='post'>", "<article>").replace("</div>", "</article>")):
        page = "<html><body><div class='menu'><a href='x'>Home</a></div>" + wrap.format(body) + "<div class='footer'>Copyright <a href='z'>us</a></div></body></html>"
        text = html_text.extract(page)
        assert [text.count(f"post{i}") for i in range(3)] == list(sizes) and "Home" not in text and "Copyright" not in text


@pytest.mark.parametrize("name", ["id='comments'", "class='comment-list'", "class='comments widget'", "id='disqus'"])
def test_comments_never_hold_the_page(name):
    """Not even where they are most of its text and no element is an article."""
    story, remarks = "<p>" + "story text " * 20 + "</p>", "<div><p>" + "remark made " * 30 + "</p></div>"
    text = html_text.extract(f"<html><body><h1>Head</h1><div class='story'>{story * 2}</div><div {name}>{remarks * 6}</div></body></html>")
    assert text.count("story text") == 40 and "remark" not in text
    assert "remark" in html_text.extract(f"<html><body><div {name}>{remarks}</div></body></html>")  # nothing else has text


def test_thousands_of_articles():
    began = time.time()
    text = html_text.extract("<html><body>" + "<article><p>one of many</p></article>" * 8000 + "</body></html>")
    assert text.count("one of many") == 8000 and time.time() - began < 10
