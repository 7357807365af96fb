"""Layouts that the labelled pages don't have: the article comes out whole, and nothing else."""

import pytest
from pyspark.sql import functions as F

from quillstone.llm import html
from quillstone.llm.queries import op5_html

ONE = "The river runs past the old mill and turns south near the bridge where boats are kept."
TWO = "In spring the water rises and the fields beside it stay wet until May, so nobody sows early."
BODY = f"<p>{ONE}</p><p>{TWO}</p>"
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
ODD = "many other words that nobody came here to read at all " * 3

CONTAINERS = [
    '<article class="post has-sidebar">{}</article>',
    '<div class="content no-sidebar">{}</div>',
    '<article class="story comments-open">{}</article>',
    '<div id="widget-guide">{}</div>',
    '<article id="post-17" class="post-17 post type-post status-publish format-standard hentry category-news tag-share">{}</article>',
    '<main class="layout-with-widgets">{}</main>',
    '<div class="related-sciences"><div class="text">{}</div></div>',
    '<section class="share-price-report">{}</section>',
    '<div class="Banner-School-District">{}</div>',
    '<form id="aspnetForm" action="x"><div class="c">{}</div></form>',
    '<div class="header-less">{}</div>',
    '<div class="advertising-industry">{}</div>',
    '<div class="td-post-content tagdiv-type">{}</div>',
    '<div class="elementor-widget-container">{}</div>',
    '<div itemprop="articleBody">{}</div>',
    '<table><tr><td width="80%">{}</td></tr></table>',
    '<div class="nav-open sticky-header"><div>{}</div></div>',
    '<div role="main">{}</div>',
    '<div><div><div class="x1 y2 z3">{}</div></div></div>',
    '<article class="article--social">{}</article>',
    '<div class="menu-of-the-day recipes">{}</div>',
]
SIDES = [
    f"<aside>{ODD}</aside>",
    f"<div class='sidebar'><p>{ODD}</p></div>",
    f"<div id='comments'><div class='comment'><p>{ODD}</p></div><div class='comment'><p>{ODD}{ODD}</p></div></div>",
    f"<div class='sidebar-primary'><p>{ODD}</p></div>",
    f"<div class='cookie-notice'><p>{ODD}</p></div>",
    f"<footer class='whatever'><p>{ODD}</p></footer>",
    f"<div role='complementary'><p>{ODD}</p></div>",
    f"<form><label>{ODD}</label><input></form>",
]


@pytest.mark.parametrize("container", CONTAINERS)
def test_container(container):
    assert html.extract_text(f"<body>{container.format(BODY)}</body>") == f"{ONE}\n\n{TWO}"
    assert html.extract_text(f"<body>{NAV}{container.format(BODY)}<footer>Copyright by us all</footer></body>") == f"{ONE}\n\n{TWO}"


@pytest.mark.parametrize("side", SIDES)
@pytest.mark.parametrize("container", CONTAINERS[:8])
def test_sides(container, side):
    page = container.format(BODY)
    assert html.extract_text(f"<body>{NAV}{page}{side}</body>") == f"{ONE}\n\n{TWO}"
    within = container.format(BODY.replace("</p><p>", f"</p>{side}<p>"))
    assert html.extract_text(f"<body>{NAV}{within}</body>") == f"{ONE}\n\n{TWO}"


def test_text_of_any_markup_stays():
    page = f"<article><p>{ONE} <math><mi>x</mi><mo>=</mo><mn>4</mn></math> and <object>a plan</object>.</p><p>{TWO}</p><canvas>A chart of it.</canvas></article>"
    assert html.extract_text(page) == f"{ONE} x=4 and a plan.\n\n{TWO}A chart of it." or html.extract_text(page) == f"{ONE} x=4 and a plan.\n\n{TWO}\n\nA chart of it."


def test_labelled_pages_give_their_own_text():
    from quillstone.llm.pagelabels import MARK, labelled_pages

    for page in labelled_pages():
        want = " ".join(" ".join(t.split()) for k, t, _ in html.read(page).entries if MARK in t)
        assert html.extract_text(page).split() == want.split()


def test_repeated_rows_and_clashing_names(spark, tmp_path):
    rows = [(1, "u", f"<article>{BODY}</article>"), (1, "u", f"<article>{BODY}</article>"), (None, None, None), (2, "u", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.text, r.n_chars) for r in op5_html(spark, str(tmp_path)).collect())
    assert got == [("", 0), ("", 0), (f"{ONE}\n\n{TWO}", len(ONE) + len(TWO) + 2), (f"{ONE}\n\n{TWO}", len(ONE) + len(TWO) + 2)]
    pages.limit(0).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert op5_html(spark, str(tmp_path / "none")).count() == 0
