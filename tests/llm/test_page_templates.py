from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from netloom.llm import page_templates as pt
from netloom.llm.html_events import CLOSE, OPEN, TEXT, read

PAGES = "page_id long, url string, html string"


def site(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    return spark.createDataFrame(rows, PAGES)


def texts(spark, pages):
    return {r["page_id"]: r["text"] for r in pt.main_text(site(spark, pages)).collect()}


WORDS = "river stone lamp glass window paper bridge garden copper winter orange silver".split()


def paragraph(i, n=12):
    return " ".join(WORDS[(i * 7 + k * (i % 5 + 1)) % 12] for k in range(n)) + "."


def marked(i):
    body = f"<h1>Title {i}</h1><p>{paragraph(i)}<p>{paragraph(i + 3)} &amp; more&nbsp;of <a href=x>it</a><br>next  line"
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a>Home</a><li><a>N{i}</a></ul></nav>"
        f"<div class='ad'>Buy {i}</div><!-- <p>no</p> --><article>{body}<script>var x='</p>';</script><div class=\"share-links\">Share</div>"
        f"<section id=comments><h2>Comments</h2><article>first! {i}</article></section></article><aside>Side</aside><form>Mail <input></form><footer>&copy; end"
    )


def marked_text(i):
    return f"Title {i}\n{paragraph(i)}\n{paragraph(i + 3)} & more of it\nnext line"


def bare(i):
    """No element says what it is; the frame is the same on all pages."""
    return (
        f"<html><body><div class=top>Daily Paper</div><div class=w><div class=l><span>Sections</span></div><div class=c><h2>Story {i}</h2>"
        + "".join(f"<p>{paragraph(i + k, 30)}</p>" for k in range(i % 4 + 2))
        + "<p>Printed on paper</p></div></div><div class=b>All rights</div></body></html>"
    )


def test_marked_pages(spark):
    pages = [("https://a.example/%d" % i, marked(i)) for i in range(8)] + [("https://solo.example/", marked(50)), (None, marked(51)), ("mailto:x", marked(52))]
    found = texts(spark, pages)
    assert found == {i: marked_text(i) for i in range(8)} | {8: marked_text(50), 9: marked_text(51), 10: marked_text(52)}


def test_template_finds_the_content_of_unmarked_pages(spark):
    pages = [("http://b.example/%d" % i, bare(i)) for i in range(6)]
    found = texts(spark, pages)
    for i in range(6):
        assert found[i] == "\n".join([f"Story {i}", *[paragraph(i + k, 30) for k in range(i % 4 + 2)]])


def test_copies_keep_their_text(spark):
    pages = [("http://c.example/%d" % i, bare(3)) for i in range(5)]
    for text in texts(spark, pages).values():
        assert text.startswith("Story 3\n") and text.endswith("Printed on paper")


def test_awkward_rows(spark):
    odd = [None, "", "plain text only", "<", "<p", "a < b <b>c</b>", "<div><p>one<p>two</div></div></p>three", "<!-- open", "&lt;p&gt; &#65; &am",
           "<p title=don't>x</p><p>y</p>", "<article>" + "<div>" * 3000 + "deep", "<p>" + "long " * 200_000, "<svg><text>no</text></svg>yes</br>z"]
    rows = [("http://d.example/", h) for h in odd] * 2
    found = texts(spark, rows)
    want = ["", "", "plain text only", "<", "<p", "a < b c", "one\ntwo\nthree", "", "<p> A &am", "x\ny", "deep", ("long " * 200_000).strip(), "yes\nz"]
    assert [found[i] for i in range(len(odd))] == want
    assert [found[i + len(odd)] for i in range(len(odd))] == want
    assert pt.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_counts_and_clashing_names(spark):
    pages = site(spark, [("http://a.example/1", marked(1)), ("http://a.example/1", marked(1))]).withColumn("host", F.lit("x")).withColumn("row", F.lit(1))
    found = pt.main_text(pages).collect()
    assert [r["text"] for r in found] == [marked_text(1)] * 2
    assert [r["n_chars"] for r in found] == [len(marked_text(1))] * 2
    assert {r["host"] for r in found} == {"a.example"}


def test_events_nest():
    for page in (marked(1), bare(2), "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<table><tr><td>1<td>2<tr><td>3</table>", "</p></div><b><i>x</b>y</i>"):
        open_ = []
        for e in read(page):
            if e.kind == OPEN:
                open_.append(e.path)
            elif e.kind == CLOSE:
                assert open_.pop() == e.path
            else:
                assert e.kind == TEXT and (not open_ or open_[-1] == e.path)
        assert not open_


def brute_classes(pages):
    """Classes by the vectors themselves, their order by the pages themselves."""
    seen = [[t for t, _, _ in pt.tokens_of(read(h))] for h in pages]
    counts = [Counter(s) for s in seen]
    by_vector = defaultdict(set)
    for t in set().union(*counts):
        vector = tuple(c[t] for c in counts)
        on = sum(map(bool, vector))
        if on >= pt.LEAST_PAGES and on >= pt.LEAST_SHARE * len(pages):
            by_vector[vector].add(t)
    classes = [frozenset(c) for c in by_vector.values() if len(c) >= pt.LEAST_TOKENS]
    ordered = set()
    for c in classes:
        rounds = set()
        for s in seen:
            own = [t for t in s if t in c]
            rounds |= {tuple(own[i : i + len(c)]) for i in range(0, len(own), len(c))}
        if len(rounds) == 1 and set(next(iter(rounds))) == c:
            ordered.add(c)
    return set(classes), ordered


@pytest.mark.parametrize("make", [marked, bare, lambda i: marked(i) if i % 3 else bare(i)])
def test_classes_against_whole_vectors(spark, make):
    html = [make(i) for i in range(9)]
    pages = site(spark, [("http://e.example/", h) for h in html]).select(pt.host_of(F.col("url")).alias("host"), F.col("page_id").alias("row"), "html")
    vectors = pt.cut(pt.token_vectors(pages))
    hosts = pt.cut(vectors.where("token = 0").select("host", "pages", "chars"))
    classes = pt.equivalence_classes(vectors, hosts)
    every, ordered = brute_classes(html)
    assert {frozenset(t["token"] for t in r["tokens"]) for r in classes.collect()} == every
    valid = {frozenset(t["token"] for t in r["tokens"]): r for r in pt.valid_classes(pages, classes, hosts).collect()}
    assert valid and valid.keys() <= ordered
    assert any(r["around"] for r in valid.values()) or make is not bare  # the paragraphs stand in a gap of the frame


def test_overlapping_classes_are_at_fault():
    events = read("<a></a><b></b><i></i>")
    t = [x for x, _, _ in pt.tokens_of(events)]
    inside = {t[0]: 1, t[3]: 1, t[1]: 2, t[2]: 2}
    assert pt.class_places(events, inside, {1: 2, 2: 2}, {1: 9, 2: 9})[2][1:] == (1, 1)
    crossed = {t[0]: 1, t[2]: 1, t[1]: 2, t[3]: 2}
    found = pt.class_places(events, crossed, {1: 2, 2: 2}, {1: 9, 2: 5})
    assert found[1][0] != 0 and found[2][0] == 0
