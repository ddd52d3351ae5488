"""Page extraction and URL filter."""

import re

import numpy as np
import pytest

from paragauge.llm import html_crf as H
from paragauge.llm import url_cascade as U

MODEL = H.default_model()

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
<header><div class="logo">Site</div><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies. Accept them all.</p></div>
<article><h1>Main  title</h1><p>First &amp; best,&nbsp;one
line.<br>Same block.</p><div class="ad">Buy now. It is good.</div><p>Second <b>part</b> &#x41;&lt;b&gt;.</p>
<script>var t = "</p><p>not text</p>";</script><form><label>Mail</label><input></form><p>Third</p></article>
<aside><p>Other things to read.</p></aside>
<section class="comments"><h2>Comments</h2><p>I liked this very much. Thanks.</p></section>
<footer>&copy; Site. All of it.</footer></body></html>"""


def test_a_page_by_hand():
    want = "Main title\nFirst & best, one line. Same block.\nSecond part A<b>.\nThird"
    assert H.main_text(PAGE, MODEL) == want


BY_HAND = [
    (
        "<div id=top><a href=/>links</a> <a href=/x>more</a></div><div>Some long text that goes on for a while, with words."
        " And more of it here.<br><br>Second part of the long text, also with some words in it.</div><div>Copyright 2024 Us</div>",
        "Some long text that goes on for a while, with words. And more of it here. Second part of the long text, also with"
        " some words in it.",
    ),
    ("Just a page of plain text without any tags. It has some sentences.", "Just a page of plain text without any tags. It has some sentences."),
    ("<article><p>See the code:</p><pre>x = 1</pre><p>It prints.</p></article>", "See the code:\nx = 1\nIt prints."),
    (
        '<article><p title="a>b">One para here.</p><p>Then another one of more words, as is usual.</p><p>Two para here.</p></article>',
        "One para here.\nThen another one of more words, as is usual.\nTwo para here.",
    ),
    (
        "<html><body><h1>Title here</h1><p>Short.</p><p>A longer paragraph follows here with words.</p></body></html>",
        "Title here\nShort.\nA longer paragraph follows here with words.",
    ),
    (
        '<body><div class="nav"><a href=a>Home</a> | <a href=b>News</a></div><div><h2>Heading of it</h2>Some text in a plain div'
        " which is the main thing of this page. It has two sentences.</div><div class=footer>All rights reserved</div></body>",
        "Heading of it\nSome text in a plain div which is the main thing of this page. It has two sentences.",
    ),
]


@pytest.mark.parametrize("page,want", BY_HAND)
def test_pages_by_hand(page, want):
    assert H.main_text(page, MODEL) == want


def test_nested_pages_cost_in_proportion():
    """A page of a megabyte whose elements are never closed; features are added once per element."""
    def work(n):
        asked = []
        page = "".join(f"<div class='c{i % 50}'><ul><li><p>Some words go here. " for i in range(n))
        H.blocks(page, lambda f, _: asked.append(f) or 0.0)
        return len(asked)

    assert work(4000) <= 4.1 * work(1000)
    page = "<div><p>Some words go here. " * 40_000
    assert len(H.blocks(page, MODEL.weights.get)) == 40_000


def test_both_forms_of_paths_agree():
    """Sums of weights along the open elements are those of the features by name."""
    for page in [*H.labelled_pages(30, seed=8), *(p for p, _ in BY_HAND), PAGE]:
        assert MODEL.decode(H.blocks(page)) == MODEL.decode(H.blocks(page, MODEL.weights.get))


def brute(model, found):
    """The best of all labellings."""
    emit = [sum(model.weights.get(f, 0.0) for f in own) for own in H.features(found)]
    best = (-np.inf, None)
    for bits in range(1 << len(found)):
        y = [bits >> i & 1 for i in range(len(found))]
        total = model.start[y[0]] + sum(e for e, v in zip(emit, y) if v)
        total += sum(model.moves[a, b] for a, b in zip(y, y[1:]))
        best = max(best, (total, y), key=lambda x: x[0])
    return best[0], emit, best[1]


def test_viterbi_finds_the_best_labelling():
    tried = 0
    for page in H.labelled_pages(40, seed=5):
        found = H.blocks(page)[:11]
        best, emit, _ = brute(MODEL, found)
        y = MODEL.decode(found)
        total = MODEL.start[int(y[0])] + sum(e for e, v in zip(emit, y) if v)
        total += sum(MODEL.moves[int(a), int(b)] for a, b in zip(y, y[1:]))
        assert np.isclose(total, best)
        tried += 1
    assert tried == 40


def test_unseen_layouts():
    right = all_ = 0
    for page in H.labelled_pages(200, seed=99):
        found = H.blocks(page)
        truth = [H.MARK in b.text for b in found]
        for b in found:
            b.text = b.text.replace(H.MARK, "") or "."
        right += sum(a == b for a, b in zip(truth, MODEL.decode(found)))
        all_ += len(found)
    assert right / all_ > 0.985


def test_given_pages_and_odd_ones(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(60)
    odd = spark.createDataFrame(
        [(-1, "u", None), (-2, None, ""), (-3, "u", "<p"), (-4, "u", "<!-- x"), (-5, "u", "no tags at all"),
         (-6, "u", "<article><p>" + "long words " * 30_000), (-6, "u", "<article><p>twice</p></article>")],
        "page_id long, url string, html string",
    )
    rows = H.extract(pages.unionByName(odd), ["page_id", "url"]).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == len(html) + 7
    got = {r.page_id: r for r in rows}
    assert all(r.n_chars == len(r.text) for r in rows)
    assert all(got[i].text == "" for i in (-1, -2, -3, -4))
    for i, page in html.items():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        first = H.html.unescape(re.search(r"<h1>(.*?)</h1>", inner, re.S)[1])
        assert got[i].text.split("\n")[0] == " ".join(first.split())
        assert "©" not in got[i].text and "track(" not in got[i].text
    assert H.extract(pages.where("false"), ["page_id"]).collect() == []


RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "allow"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.org/es/1?x=/en/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "allow"),
        ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        ("https://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        ("https://x.com/fr", "x.com", "/fr", None, "allow"),
        ("https://evil.com?/fr/", "evil.com", "", None, "block"),
        ("https://org", "org", "", None, "allow"),
        ("//evil.com/a", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("a://evil.net/b://c", "evil.net", "/b://c", None, "block"),
        ("http://" + "É" * 9000 + ".de/" + "p" * 9000, "É" * 9000 + ".de", "/" + "p" * 9000, None, "allow"),
    ],
)
def test_rules_and_lists(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "h")] * 2, "page_id long, url string, host string")
    sites = spark.createDataFrame([("Evil.com",), ("evil.net",), ("never.met",)], "host string")
    for r in U.judge(pages, RULES, sites, ["page_id"]).collect():
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_equal_rules_and_clashing_columns(spark):
    """Of equally long rules the earlier one decides; columns of the input may have any name."""
    pages = spark.createDataFrame([(1, "http://a.b/c", "r", "v")], "page_id long, url string, rule string, verdict string")
    for rules in ([("b", "/c", "block"), ("b", "/c", "allow")], [("a.b", "/", "block"), ("b", "/c/", "allow"), ("b", "/c", "block")]):
        (row,) = U.judge(pages, rules, spark.createDataFrame([], "host string"), ["page_id"]).collect()
        assert row.verdict == "block"


@pytest.mark.parametrize("listed,others,rate", [(300, 4000, None), (4000, 300, None), (50, 5000, 0.5), (0, 40, None), (40, 0, None)])
def test_cascade_is_exact(spark, listed, others, rate):
    keys = [(f"k{i}", i < listed) for i in range(listed + others)]
    frame = spark.createDataFrame(keys or [("", False)], "key string, listed boolean")
    cascade = U.build(frame, rate)
    hashes = frame.select("listed", *[h.alias(c) for h, c in zip(U.hashed(frame.key), "ab")]).toPandas()
    one, two = (hashes[c].to_numpy().view(np.uint64) for c in "ab")
    assert (cascade.contains(one, two) == hashes.listed.to_numpy()).all()
    assert len(cascade.levels) > 1 or not listed or not others or rate is None


def test_beyond_the_size_bound_and_empty(spark, monkeypatch):
    pages = spark.createDataFrame(
        [(i, f"http://{'evil' if i % 3 else 'good'}.h{i}.net/") for i in range(90)], "page_id long, url string"
    )
    sites = spark.createDataFrame([(f"EVIL.h{i}.net",) for i in range(0, 200, 7)] * 2 + [(None,), ("",)], "host string")
    want = sorted(U.judge(pages, RULES, sites, ["page_id"]).collect())
    assert [r.verdict == "block" for r in want] == [i % 3 > 0 and i % 7 == 0 for i in range(90)]
    monkeypatch.setattr(U, "MAX_BYTES", 4)
    assert sorted(U.judge(pages, RULES, sites, ["page_id"]).collect()) == want
    assert U.judge(pages.where("false"), RULES, sites, ["page_id"]).collect() == []
    assert {r.verdict for r in U.judge(pages, [], sites.where("false"), ["page_id"]).collect()} == {"allow"}


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a</p><svg-icon name=x></svg-icon><p>b</p><p>c</p>", "a b c"),
        ("<p>a</p><title-bar></title-bar><button-group></button-group><object-view></object-view><p>b</p>", "a b"),
        ("<p>a</p><svg width=1 /><p>b</p><svg><text>no</text></svg><p>c</p>", "a b c"),
        ("<p>a</p><svg><svg><text>no</text></svg><text>no</text></svg><p>b</p>", "a b"),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p>", "a x=2 b"),
        ("<p>a</p><math/><p>b</p>", "a b"),
        ("<p>a</p><button>b<p>c</p><button>no</button><p>d</p>", "a b c d"),
        ("<p>a</p><SELECT><option>no</SELECT ><p>b</p><template/><p>c</p>", "a b c"),
        ("<p>a</p><object>no<script>'</object>'</script>no</object><p>b</p>", "a b"),
        ("<p>a</p><script>var no = '<p>no</p>'", "a"),
        ("<title>no</title><p>a</p><textarea><p>no</p>", "a"),
    ],
)
def test_only_raw_elements_are_dropped(page, want):
    assert " ".join(b.text for b in H.blocks(page)) == want


def test_listed_rules_are_the_contracts(spark):
    from paragauge.llm import catalog

    assert catalog.URL_RULES == [
        ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
        ("com", "/fr/", "allow"), ("com", "/de/", "block"),
    ]
    pages = spark.createDataFrame([(1, "http://a.example.org/en/12"), (2, "http://example.org/en/2")], "page_id long, url string")
    sites = spark.createDataFrame([], "host string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages, catalog.URL_RULES, sites, ["page_id"]).collect()}
    assert got == {1: ("example.org/en/1", "block"), 2: ("org/", "allow")}
