"""Archives, main text, the registered queries and the pipeline."""

import glob
import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tracewell.llm import html, queries, warc
from tracewell.llm.common import written

BIG = "<p>" + "y" * 1200 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.example/x", BIG), (5, "http://a.example/y z\r\n", BIG), (3, None, BIG), (3, None, BIG), (None, "http://b.example", BIG), (7, "u", None), (8, "u", ""), (9, "http://c.example/é", "small"), (10, "http://c.example", "small"), (11, "http://c.example", "<p>é</p>" * 300)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS payload", "3 AS host")


def test_archive(spark, pages):
    rows = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(*warc.archive(pages)).collect()}
    n = len(BIG)
    assert rows == {(1, n, "revisit", 5), (5, n, "response", None), (3, n, "revisit", 5), (None, n, "revisit", 5), (7, 0, "response", None), (8, 0, "response", None), (9, 5, "response", None), (10, 5, "response", None), (11, len("<p>é</p>".encode()) * 300, "response", None)}
    assert warc.read(*warc.archive(pages)).count() == pages.count()
    assert warc.read(*warc.archive(pages.where("false"))).count() == 0


def test_records_are_rebuilt(spark, pages):
    headers, payloads = warc.archive(pages)
    assert payloads.count() == pages.select(F.coalesce("html", F.lit(""))).distinct().count()
    for r in warc.records(headers, payloads).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert bytes(r["header"]) == head + b"\r\n\r\n" and rest.endswith(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(rest) - 4 and fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(bytes(r["payload"])).hexdigest()
        if fields["WARC-Type"] == "response":
            assert rest[:-4] == bytes(r["payload"])
        else:
            assert rest == b"\r\n\r\n" and fields["WARC-Refers-To"] == "<urn:x-page:5>"


def test_damage_is_found(spark, pages):
    headers, payloads = warc.archive(pages)
    damaged = written(payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))), "damaged")
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read(headers, damaged).collect()


def site(i, body):
    return f"<html><head><title>t{i}</title></head><body><div><span>Our Site</span></div><div id=c><h2>Head {i}</h2>{body}</div><div><span>Call us on 123</span><form><input>Search {i}</form></div></body>"


def test_template_and_slot(spark):
    bodies = [f"<p>Story {i} begins &amp; goes   on.<br>Here.<p>Second part {i * i}.</p><div class='comment'>I disagree {i}</div>" for i in range(12)]
    frame = spark.createDataFrame([(i, f"http://h.example/{i}", site(i, b)) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.main_text(frame).collect()}
    for i in range(12):
        assert got[i]["text"] == f"Head {i}\n\nStory {i} begins & goes on. Here.\n\nSecond part {i * i}." and got[i]["n_chars"] == len(got[i]["text"])


def test_main_text_of_odd_pages(spark, pages):
    odd = [(20, "http://z.example/1", "<p>unclosed <b>bold<p>next <!-- c"), (21, "http://z.example/2", "plain & text &lt;tag&gt; &#233;"), (22, "http://z.example/3", "<" * 2000), (23, "http://z.example/4", "<div>" * 3000 + "deep"), (24, "http://z.example/5", '<p title="a>b">x</p><script>if (a<b) "</p>"</script>'), (25, "http://y.example", "<nav>menu</nav>")]
    frame = spark.createDataFrame(odd, "page_id long, url string, html string").unionByName(pages.select("page_id", "url", "html"))
    got = {r["page_id"]: r["text"] for r in html.main_text(frame).collect()}
    assert got[20] == "unclosed bold\n\nnext" and got[21] == "plain & text <tag> é" and got[23] == "deep" and got[24] == "x" and got[25] == "" and got[7] == "" and got[8] == ""
    assert html.main_text(frame).count() == frame.count() and html.main_text(frame.where("false")).count() == 0


def extracted(spark, host, sources, **options):
    rows = [(i, f"http://{host}.example/{i}", s) for i, s in enumerate(sources)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}
    return [got[i] for i in range(len(sources))]


def framed(body):
    return f'<html><body><div class="top"><a href="/">Home</a><a href="/b">About us</a></div>{body}<div class="site-footer">Imprint</div></body></html>'


@pytest.mark.parametrize("attribute", ['title="The hidden valley"', 'data-note="display:none was here"', "class=valley title='aria-hidden=true'", 'alt=" hidden "', 'title=" class=comments "', 'data-x="a" title="id=ad"'])
def test_values_of_attributes_hide_nothing(spark, attribute):
    bodies = [f"<article {attribute}><h1>Head {i}</h1><p>Story {i} of a valley.</p></article>" for i in range(6)]
    assert extracted(spark, "v", [framed(b) for b in bodies]) == [f"Head {i}\n\nStory {i} of a valley." for i in range(6)]


@pytest.mark.parametrize("attribute", ["hidden", 'hidden=""', "class=x hidden", 'aria-hidden="true"', "aria-hidden=TRUE", 'style="color:red; display : none"', "HIDDEN"])
def test_attributes_hide(spark, attribute):
    bodies = [f"<article><h1>Head {i}</h1><p>Story {i} of a valley.</p><div {attribute}>Secret {i}</div></article>" for i in range(6)]
    assert extracted(spark, "v", [framed(b) for b in bodies]) == [f"Head {i}\n\nStory {i} of a valley." for i in range(6)]


STORY = "<p>Part one of story {0}, which goes on for a while and then some.</p><p>Part two of story {0}, number {1}, has an end as well.</p>"
TOLD = "Part one of story {0}, which goes on for a while and then some.\n\nPart two of story {0}, number {1}, has an end as well."


@pytest.mark.parametrize("head", ["<h1>Head {0}</h1>", "<div><h1>Head {0}</h1></div>", "<h2>Head {0}</h2>", "<div><span>Head {0}</span></div>"])
def test_a_heading_beside_the_content_is_kept(spark, head):
    pages = [framed(f'<div id="x">{head.format(i)}<div class="story">{STORY.format(i, i * i)}</div></div>') for i in range(8)]
    assert extracted(spark, "h", pages) == [f"Head {i}\n\n{TOLD.format(i, i * i)}" for i in range(8)]


def test_a_lead_beside_the_story_is_kept_and_links_and_templates_are_not(spark):
    lead, links = '<div class="lead"><p>Lead {0} says in a line what it is about.</p></div>', '<div class="x9"><a href="/{0}">Other page {0}</a><a href="/q{0}">And one more {0}</a></div>'
    pages = [framed(f'<div>{lead.format(i)}<div class="story">{STORY.format(i, i * i)}</div>{links.format(i)}<div>Call us on 123</div></div>') for i in range(8)]
    assert extracted(spark, "l", pages) == [f"Lead {i} says in a line what it is about.\n\n{TOLD.format(i, i * i)}" for i in range(8)]


@pytest.mark.parametrize("name", ["search", "menu", "share", "alert"])
def test_chapters_have_names_too(spark, name):
    """A chapter with a heading and paragraphs, whose anchor is such a word, is text; a widget of that name isn't, nor are readers' comments."""
    body = '<article><h1>Head {0}</h1><p>Begin {0}.</p><section id="{1}"><h2>On it {0}</h2><p>What to know of it, {0} times and more.</p></section><div class="{1}"><p>Widget {0}</p></div><div id="{1}"><span>Find {0}</span></div><section id="comments"><h3>Comments</h3><p>Reader {0} disagrees with it.</p></section></article>'
    assert extracted(spark, "c", [framed(body.format(i, name)) for i in range(6)]) == [f"Head {i}\n\nBegin {i}.\n\nOn it {i}\n\nWhat to know of it, {i} times and more." for i in range(6)]


def test_pages_on_either_side_of_the_parameters(spark):
    """From least_pages pages on texts that stay the same are template; from layout_pages on a layout has a wrapper of its own."""
    page = lambda i: framed(f"<div><div>Our constant slogan</div><div>{STORY.format(i, i * i)}</div></div>")
    for n in (3, 4):
        got = extracted(spark, "s", [page(i) for i in range(n)])
        assert [t.endswith(TOLD.format(i, i * i)) for i, t in enumerate(got)] == [True] * n and ("Imprint" in got[0] or "slogan" in got[0]) is (n == 3)
    assert extracted(spark, "s", [page(i) for i in range(4)], least_pages=2) == extracted(spark, "s", [page(i) for i in range(4)])
    other = lambda i: framed(f"<section><p>Short {i} and other.</p></section>")
    mixed = [page(i) if i % 2 else other(i) for i in range(12)]
    want = [TOLD.format(i, i * i) if i % 2 else f"Short {i} and other." for i in range(12)]
    assert extracted(spark, "m", mixed, layout_pages=6) == want


def test_extraction_against_brute_force(spark):
    """Small random templates: what varies outside links and named asides is the text, block by block, in page order."""
    random = np.random.default_rng(11)
    for case in range(4):
        parts = []  # (html of page i, text of page i or None)
        for n in range(int(random.integers(2, 5))):
            kind = random.integers(0, 5)
            parts.append([
                ("<p>Paragraph {n}-{i} with some words of its own, {n} and {i}.</p>", "Paragraph {n}-{i} with some words of its own, {n} and {i}."),
                ("<h2>Section {n} {i}</h2>", "Section {n} {i}"), ("<div>Always the same {n}</div>", None),
                ('<ul class="sidebar"><li>Side {n} {i}</li></ul>', None), ('<div><a href="/{i}">Link {n} {i}</a></div>', None),
            ][kind])
        parts.append(("<div>" + "<p>The story {i} is long enough to be what holds the most, with words and words, part {n}.</p>" * 3 + "</div>", "\n\n".join(["The story {i} is long enough to be what holds the most, with words and words, part {n}."] * 3)))
        random.shuffle(parts)
        pages = [framed("<div>" + "".join(h.format(n=n, i=i) for n, (h, _) in enumerate(parts)) + "</div>") for i in range(7)]
        want = ["\n\n".join(t.format(n=n, i=i) for n, (_, t) in enumerate(parts) if t) for i in range(7)]
        assert extracted(spark, f"b{case}", pages) == want


def test_names_of_blocks(spark):
    """Blocks go by whole names alone, anchors and frames stay, and a form that frames the page isn't one to fill in."""
    body = (
        '<div class="site-header">Site {0}</div><article class="post comments-open"><h1>Title {0}</h1><div class="share-price">Price {0}</div><section id="related-work"><p>Work {0}</p></section><h2 id="search">Search {0}</h2><div class="post-header">By {0}</div>'
        '<p>Text {0} of it.</p><div class="share-buttons">Tweet {0}</div><aside>Aside {0}</aside></article><div id="comment-list"><article class="comment">Reader {0}</article></div>'
        '<div class="adSlot left">Buy {0}</div><form class="newsletter"><p>Mail {0}</p></form><div hidden>Secret {0}</div>'
    )
    want = "Title {0}\n\nPrice {0}\n\nWork {0}\n\nSearch {0}\n\nBy {0}\n\nText {0} of it."
    whole = "<html><body><form id=aspnet><div class=page-sidebar-right>" + body + "</div></form></body></html>"
    bare = "<body><form action=x><div><p>Long text {0} without an article, in a form.</p><p>And more {0}.</p></div></form><nav>menu</nav></body>"
    rows = [(i, "http://a.example", body.format(i)) for i in range(6)] + [(10 + i, "http://b.example", whole.format(i)) for i in range(6)] + [(20 + i, "http://c.example", bare.format(i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == got[10 + i] == want.format(i) and got[20 + i] == f"Long text {i} without an article, in a form.\n\nAnd more {i}."


def test_layouts_of_a_host(spark):
    """Stories and lists of one host have wrappers of their own; a few odd pages share the host's."""
    story = "<html><body><div>Our site</div><section><div><p>Story {0} begins.</p><p>Story {0} ends.</p></div></section><footer>f</footer></body></html>"
    listed = "<html><body><div>Our site</div><main><div>Lists</div><ul><li>Item {0}</li><li>Other {0}</li></ul></main><section><div>All rights</div></section></body></html>"
    rows = [(i, "http://l.example/x", (story if i % 2 else listed).format(i)) for i in range(60)] + [(99, "http://l.example/y", "<p>Odd one</p>")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(60):
        assert got[i] == (f"Story {i} begins.\n\nStory {i} ends." if i % 2 else f"Item {i}\n\nOther {i}"), got[i]
    assert got[99] == "Odd one"


def slow_score(a, b, x=0, y=0):
    """Simple tree matching as it is written down."""
    if a.tag[x] != b.tag[y]:
        return 0
    xs, ys = a.children[x], b.children[y]
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i in range(len(xs)):
        for j in range(len(ys)):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + slow_score(a, b, xs[i], ys[j]))
    return 1 + table[-1][-1]


def random_page(random, depth=0):
    tags = ("div", "ul", "b", "i")
    return "".join(f"<{t}>{random_page(random, depth + 1) if depth < 4 else ''}</{t}>" for t in random.choice(tags, random.integers(0, 5)))


@pytest.mark.parametrize("seed", range(25))
def test_matching_by_brute_force(seed):
    random = np.random.default_rng(seed)
    a, b = html.Page(random_page(random)), html.Page(random_page(random))
    m = html.Matching(b)
    found = m.align(a)
    assert len(found) == slow_score(a, b) and len(set(found.values())) == len(found)
    for x, y in found.items():
        assert a.tag[x] == b.tag[y] and (x == 0 or found[a.parent[x]] == b.parent[y])
    for node in range(1, len(a.tag)):  # order is kept
        own = [found[c] for c in a.children[node] if c in found]
        assert own == sorted(own)
    assert len(html.Matching(b).align(html.Page(random_page(random)))) >= 1


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 3000
    wide = lambda n, odd: "".join(f"<p>{i}</p>" if i % odd else "<ul><li>x</ul>" for i in range(n))
    a, b = html.Page(deep + "<p>one</p>"), html.Page(deep + "<p>two</p><b>x</b><ul></ul>")
    assert len(html.Matching(a).align(b)) == 3002
    a, b = html.Page(wide(3000, 7)), html.Page(wide(2500, 9))
    assert len(html.Matching(a).align(b)) > 2400
    rows = [(i, "http://deep.example", deep + f"<p>Story {i}</p>" + "<i>" * i) for i in range(5)] + [(5, "http://deep.example", "<div>" * 50_000 + "</p>" * 50_000 + "end")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"Story {i}" for i in range(5)] and got[5] == "end"


def test_matching():
    a = html.Page("<body><ul><li>1<li>2</ul><p>x</p></body>")
    m = html.Matching(a)
    same = m.align(html.Page("<body><ul><li>1<li>2</ul><p>y</p></body>"))
    assert len(same) == len(a.tag)
    b = html.Page("<body><div></div><ul><li>1<li>2<li>3</ul><p>x</p></body>")
    found = m.align(b)
    assert all(b.tag[x] == a.tag[y] for x, y in found.items()) and len(found) == len(a.tag)


def test_oracle_of_the_archive(spark, data):
    views = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        views.sql(f"create view {Path(f).stem} as select * from '{f}'")
    got = queries.QUERIES["op6_content_addressed_warc"](spark, data)
    want = views.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES['op6_content_addressed_warc']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, data), name)
        counts.append(now.count())
        if name != "best_fit_packing":
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4] <= counts[5]
    pieces = now.groupBy("doc_id").agg(F.sum("length").alias("n"))
    good = labels.where("quality = 1").select("doc_id").join(docs.dropDuplicates(["text"]).select("doc_id"), "doc_id")
    assert good.join(pieces, "doc_id", "left_semi").count() >= 0.85 * good.count()
    assert corpus_pipeline.run(spark, data).count() == counts[5]


def test_pipeline_of_nothing_and_odd_rows(spark, data, odd):
    rows = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("own"), F.lit("k").alias("__id"), F.lit(2.5).alias("spans"))
    for docs in (rows.where("false"), rows):
        for name, stage in corpus_pipeline.STAGES:
            last, docs = docs, written(stage(spark, docs, data), name)
            assert docs.count() <= last.count() or name == "best_fit_packing"
            if name != "best_fit_packing":
                assert docs.columns == rows.columns and docs.dtypes == rows.dtypes
                assert docs.select("doc_id").exceptAll(last.select("doc_id")).count() == 0


def test_stages_on_planted_rows(spark, data):
    """Each stage alone against what was planted: near copies, a passage, junk."""
    random = np.random.default_rng(12)
    word = lambda n: " ".join(f"w{x}" for x in random.integers(0, 10**5, n))
    passage, base = word(55), word(120)
    texts = {0: base, 1: base.replace(" ", "  ", 3), 2: base.rsplit(" ", 10)[0], 3: f"{word(40)} {passage} {word(20)}", 4: f"{word(70)}\n{passage}\n{word(30)}", 5: word(90), 6: None, 7: "", 8: "### $$$ " * 200}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_dedup(spark, docs, data).collect()}
    assert set(kept) == {0, 3, 4, 5, 6, 8}
    cut = {r["doc_id"]: r for r in corpus_pipeline.suffix_array_dedup(spark, docs.where("doc_id in (3, 4, 5, 6)"), data).collect()}
    assert passage not in cut[3]["text"] and cut[3]["text"].split() == texts[3].replace(passage, "").split() and cut[4]["n_chars"] == len(cut[4]["text"]) and cut[5]["text"] == texts[5] and cut[6]["text"] is None
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, data).collect()} & {6, 7, 8} == set()
    pieces = corpus_pipeline.best_fit_packing(spark, docs, data).collect()
    assert {r["doc_id"] for r in pieces} == set(texts) and sum(r["length"] for r in pieces if r["doc_id"] in (6, 7)) == 2
