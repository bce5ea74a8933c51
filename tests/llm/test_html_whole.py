"""Pages with unclosed media, formulas, and articles inside wrappers."""

import pytest

from tests.oracle import SF

from waymark.llm.html_extract import PRIOR, Parser, extract, features, labels, main_text, smoothness

WORDY = "<p>First paragraph with some words in it, long enough to be read by people.</p><p>Second one, also long enough to be read, with more words.</p>"


@pytest.mark.parametrize("before", ["<video src=a>", "<object data=a>", "<canvas>", "<svg>", "<svg><svg></svg><text>in a picture</text></svg>", "<template><div>later</div></template>", "<video><p>Your browser cannot play this, which is a pity.</p></video>", "<noscript>", "<!-- <svg> --><script>'<svg>'</script>"])
def test_only_closed_subtrees_are_dropped(before):
    got = main_text(f"<body><main><h1>The title</h1>{before}{WORDY}</main></body>")
    assert "First paragraph" in got and "Second one" in got
    assert "picture" not in got and "later" not in got and "browser" not in got


def test_formula_and_fallback_text_stays():
    got = main_text("<article><p>The sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> is shown by <object data=a>a fallback text</object> in this paragraph.</p></article>")
    assert got == "The sum x+y is shown by a fallback text in this paragraph."


@pytest.mark.parametrize("wrapper", ["<form action=x>", "<div class='content-sidebar-wrap'>", "<div class='has-sidebar'>", "<form><div class='page sidebar-left'>"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_an_article_in_a_wrapper_is_content(wrapper, tag):
    got = main_text(f"<body>{wrapper}<{tag}>{WORDY}</{tag}><div class='comments'><p>Nice post, thanks a lot for writing it!</p></div></body>")
    assert "First paragraph" in got and "Second one" in got and "Nice post" not in got
    assert main_text(f"<body><aside><{tag}>{WORDY}</{tag}></aside></body>") == ""


def test_articles_of_others_stay_out():
    others = f"<div class='related-posts'><article>{WORDY}</article></div>"
    assert main_text(f"<body>{others}</body>") == ""
    assert "First paragraph" in main_text(f"<body><div class='page-wrap has-comments'><article>{WORDY}</article></div></body>")


def test_the_cut_overrules_the_classifier():
    page = f"<body><div class=x><div>{WORDY}a short aside, see{WORDY}</div><div><div><a href=1>One</a></div><div>Plain words between the links</div><div><a href=2>Two</a></div><div><a href=3>Three</a></div></div></div></body>"
    blocks = Parser().feed(page)
    alone = (features(blocks) @ PRIOR > 0).tolist()
    cut = labels(blocks)
    assert alone != cut
    assert [b.text for b, x in zip(blocks, cut, strict=True) if not x] == ["One", "Plain words between the links", "Two", "Three"]


def plain_cut(gains, edges):
    """The least cost over all labellings."""
    n = len(gains)
    return min(sum(abs(g) for i, g in enumerate(gains) if (m >> i & 1) != (g > 0)) + sum(w for i, j, w in edges if (m >> i & 1) != (m >> j & 1)) for m in range(1 << n))


def test_small_pages_like_all_labellings(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    seen = 0
    for page in pages:
        blocks = Parser().feed(page or "")
        if not 0 < len(blocks) <= 13:
            blocks = blocks[:13]
        gains, edges = (features(blocks) @ PRIOR).tolist(), smoothness(blocks)
        found = labels(blocks)
        cost = sum(abs(g) for g, x in zip(gains, found, strict=True) if x != (g > 0)) + sum(w for i, j, w in edges if found[i] != found[j])
        assert cost == pytest.approx(plain_cut(gains, edges), abs=1e-6)
        seen += 1
        if seen == 25:
            break
    assert seen == 25


def plain_text(page):
    """Main text of the test pages by their own names alone: what is inside an article or main element and no marked place."""
    return [b.text for b in Parser().feed(page) if b.main and not b.away]


def test_query_like_names_alone(spark):
    from waymark.llm.queries import QUERIES

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op8_min_cut_extraction"](spark, SF).collect():
        assert r["text"].split("\n\n") == (plain_text(pages[r["page_id"]] or "") or [""])


def test_no_pages_and_odd_pages(spark):
    kind = "page_id long, url string, html string"
    assert extract(spark.createDataFrame([], kind)).count() == 0
    assert [r["text"] for r in extract(spark.createDataFrame([(1, None, None), (1, None, None), (2, None, "<article><svg><p>lost")], kind)).orderBy("page_id").collect()][:2] == ["", ""]
