import pytest

from skylattice.llm import html_extract as H

CASES = [
    ("<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First  line\nof text here.</p><p>Second &eacute;, with <b>bold</b> words.</article><footer>&copy; 2020 someone</footer></body></html>", "Title & more\n\nFirst line of text here.\n\nSecond é, with bold words."),
    ('<body><header><h2>Site name</h2></header><div class="content"><h1>Heading of it</h1><p>One paragraph with several words, as they are.</p><p>Another paragraph with more words.</p></div><aside class="sidebar"><h3>Related</h3><ul><li><a href=x>Other</a></li><li><a href=y>More</a></li></ul></aside><div id="comments" class="comments"><div class="comment"><p>I like this text very much indeed.</p></div></div><div class="cookie-banner">We use cookies. <button>OK</button></div></body>', "Heading of it\n\nOne paragraph with several words, as they are.\n\nAnother paragraph with more words."),
]


@pytest.fixture(scope="module")
def model():
    return H.train()


def test_known_pages(model):
    for page, want in CASES:
        assert model.texts([page]) == [want]


@pytest.mark.parametrize(
    "script",
    [
        "for(i=0;i<n;i++){x}",
        "if(a<b)c()",
        "if (a <b && c> d) e='it\\'s'",
        "s = 'don\"t <p' + \"<b\"",
        "<!-- x <y --",
        "// it's <!-- open",
        "s='</scripts><p>no</p></ script>'",
        "<![CDATA[ a<b ]]",
        "",
    ],
)
def test_text_after_a_script_stays(model, script):
    page, want = CASES[0]
    for end in ("</script>", "</SCRIPT >"):
        inline = page.replace("<p>Second", f"<script>{script}{end}<p>Second")
        root = H.parse(f"<div><script>{script}{end}<p>after</p></div>")
        assert [c.tag for c in root.children[0].children] == ["script", "p"]
        assert model.texts([inline]) == [want]
    style = H.parse(f"<style>{script}</style><title>a<b</title><p>after</p>")
    assert [c.tag for c in style.children] == ["style", "title", "p"]


def test_held_out_layouts(model):
    layouts = H.Layouts(1234)
    hits = extra = missed = 0
    for _ in range(80):
        page = layouts.page()
        got = {b for b in model.texts([page])[0].split("\n\n") if b}
        tree = H.Tree(page)
        gold = {b for b in tree.text([True] * len(tree.nodes)).split("\n\n") if H.Layouts.MARK in b}
        hits, extra, missed = hits + len(got & gold), extra + len(got - gold), missed + len(gold - got)
    assert hits / (hits + extra) > 0.97 and hits / (hits + missed) > 0.97


def test_decoding_is_hierarchical(model):
    import numpy as np

    tree = H.Tree("<body><div><p>a</p><p>b</p></div><div><p>c</p></div></body>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        odds = rng.normal(0, 3, len(tree.nodes))
        kept = tree.kept(odds)
        assert all(not kept[i] or i == 0 or kept[tree.parents[i]] for i in range(len(kept)))

        def score(k, odds=odds):
            return sum(-np.logaddexp(0, -o if x else o) for o, x in zip(odds, k, strict=True))

        best = max((score(k) for k in _all(len(kept)) if all(not k[i] or i == 0 or k[tree.parents[i]] for i in range(len(k)))), default=0)
        assert score(kept) == pytest.approx(best)


def _all(n):
    for bits in range(2**n):
        yield [bool(bits >> i & 1) for i in range(n)]


def test_broken_pages(model):
    pages = ["", "no markup at all", "<", "<p", "<!-- open", "<script>var a='<p>x</p>'", "</div></div>", "<a<b>", "<div " + "x" * 2000, "<div>" * 3000 + "deep", '<p class="x>quote']
    for page, out in zip(pages, model.texts(pages), strict=True):
        assert isinstance(out, str), page


ARTICLE = "<article><h1>Heading</h1><p>The first paragraph, of several words.</p><p>The second one, with more words in it.</p></article>"
ARTICLE_TEXT = "Heading\n\nThe first paragraph, of several words.\n\nThe second one, with more words in it."


@pytest.mark.parametrize(
    "page",
    [
        f"<head><title>t</title><meta charset=utf-8><body>{ARTICLE}</body>",
        f"<html><head><script>var s='<!--';</script><link rel=x>{ARTICLE}",
        f"<body><script>for(var i=0;i<n;i++){{x()}}</script>{ARTICLE}<footer>(c) someone</footer>",
        f"<body><!-->{ARTICLE}<!-- never closed <p>hidden</p>",
        f"<body><!-- a -- b --!>{ARTICLE}</body>",
        f'<body><div class="nav menu"><a href="a>b">Home</a> <a href=\'c"d\'>About</a></div>{ARTICLE}</body>',
        f"<body>{ARTICLE}<p unfinished",
    ],
)
def test_pages_labelled_by_hand(model, page):
    assert model.texts([page]) == [ARTICLE_TEXT]


def test_references_and_misnested_tags(model):
    page = ARTICLE.replace("several words", "&am<b>p;</b> &eacute;t&eacute; &#x41;&#66; &lt;x&gt;").replace("more words", "<b><i>more</b> wo</i>rds")
    assert model.texts([page]) == [ARTICLE_TEXT.replace("several words", "&amp; été AB <x>").replace("words in", "words in")]
    root = H.parse("<div><b><p>one</b> two</p></div><p>three")
    assert [c.tag for c in root.children] == ["div", "p"]
    # A quote that is never closed ends with its tag.
    assert model.texts([ARTICLE.replace("<p>The second", '<p title="x>The second')]) == [ARTICLE_TEXT]


@pytest.mark.parametrize("broken", ['<a "', "<a '>", "</p>", "<div x='", "<b><hr>", "<i><div></b>", "<li><ul>", "<!-- ", "<![CDATA[", "<p " + "x" * 50, "<", "<script>", "</script>", "a=", "<x a= "])
def test_parsing_is_linear(broken):
    import time

    took = []
    for n in (20_000, 100_000):
        start = time.perf_counter()
        tree = H.Tree(broken * n)
        tree.text([True] * len(tree.nodes))
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 1


def test_frame(spark, model):
    df = spark.createDataFrame([(1, "u", CASES[0][0], 5), (2, None, None, 6), (2, None, None, 6), (None, "v", "", 7)], "page_id long, url string, html string, text long")
    rows = H.extract(df, model).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in rows) == [(0, 0), (1, len(CASES[0][1])), (2, 0), (2, 0)]
    assert H.extract(df.limit(0), model).count() == 0
