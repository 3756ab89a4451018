import html
import re
import time

import pytest

from fieldlake.llm.html_text import apply_tree, extract, labelled_table, main_text, tree

SF = "/root/testdata/sf0.01"
LONG = "word " * 30


def test_tree_knows_its_table():
    rows, labels = labelled_table()
    assert 40 < len(rows) < 200 and (apply_tree(tree(), rows) == (labels > 0)).mean() > 0.97


def test_pages_hold_their_article(spark):
    """The given pages mark their article; it is cut out here by its tags."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.DOTALL)[1]
        inside = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))
        assert r.text == " ".join(html.unescape(inside).split()) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<nav>menu</nav>", ""),
        (f"<article><p>a<b>b</b>c<br>d\n\t e&nbsp;&eacute;&#33;</p><p>{LONG}</p></article>", f"abc d e é! {LONG.strip()}"),
        (f"<article><p>x<script>if (a < b) '</p>'</script>y<!-- no <p> --></p><p>{LONG}</article>", f"xy {LONG.strip()}"),
        (f"<article><p>{LONG}<aside>side</aside><p>No.<section class='comment-list'><p>{LONG}</p></section></article>", f"{LONG.strip()} No."),
        (f"<header><h1>Site</h1></header><main><p>{LONG}</p></main><div id=cookie-notice>We use {LONG}</div><footer>{LONG}</footer>", LONG.strip()),
        (f"<main><style>p{{}}</style><p title='a > b'>{LONG}</p></main>", LONG.strip()),
    ],
)
def test_single_pages(page, text):
    assert main_text(page) == text


def test_broken_markup_takes_linear_time():
    began = time.time()
    for page in ("<a" * 200_000, '<a "' * 100_000, "<div>" * 50_000 + LONG, "<!--" * 100_000, "<p>x" * 50_000, "<script>" * 50_000):
        main_text(page)
    assert time.time() - began < 60


def test_nulls_repeats_and_clashing_names(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(1, "u", page, 5), (1, "u", page, 5), (None, None, page, 5), (2, "v", None, 5)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert sorted((str(r.page_id), str(r.url), r.n_chars) for r in got.collect()) == [("1", "u", 149), ("1", "u", 149), ("2", "v", 0), ("None", "None", 149)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
