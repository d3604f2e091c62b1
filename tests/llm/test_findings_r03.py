"""Cases of pages that went wrong: comments, empty blocks, link paragraphs, bare text."""
import pytest

from lexicluster.llm import html_extraction as H

BODY = "Some article text that is long enough to be seen as content by anyone."
REPLY = "I disagree with what is written here, and so do many others."


def page(inside="", after=""):
    return f"<html><body><nav><ul><li><a href=#>Home</a></li></ul></nav><article><h1>The title of it</h1><p>{BODY}</p>{inside}</article>{after}</body></html>"


@pytest.fixture(scope="module")
def model(spark):
    return H.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


@pytest.mark.parametrize("inside,after", [
    (f'<section class="comments"><h3>Comments</h3><p>{REPLY}</p></section>', ""),
    ("", f'<div class="comment-list"><h3>Comments</h3><ul><li><p>{REPLY}</p></li></ul></div>'),
    (f'<div class="comment-list"><ul><li><p>{REPLY}</p></li><li>{REPLY}</li></ul></div>', ""),
    (f'<h3>Comments</h3><div id="comments"><div class="comment"><p>{REPLY}</p></div></div>', ""),
    ('<h3>Related</h3><ul class="related"><li><a href="#">Other story</a></li></ul>', '<div class="share">Share this</div>'),
])
def test_comments_and_boxes_are_left_out(model, inside, after):
    assert model.text(page(inside, after)) == f"The title of it {BODY}"


def test_paragraphs_of_the_article_stay(model):
    link, note = "A paragraph that is one link to another place.", "A note that belongs to the article and says a little more on it."
    assert model.text(page(f'<p><a href="#">{link}</a></p><p class="note more">{note}</p>')) == f"The title of it {BODY} {link} {note}"


def test_empty_blocks_part_the_text(model):
    html = '<html><body><div class="content">First part of the text, which is long enough.<p></p>Second part of it, which is long too.</div></body></html>'
    assert model.text(html) == "First part of the text, which is long enough. Second part of it, which is long too."


def test_text_without_blocks(model):
    assert model.text("just some <b>bare</b> text &amp; no block") == "just some bare text & no block"
    assert model.text("") == "" == model.text("<script>x</script>")


def test_very_long_page_and_extra_columns(spark):
    long = "<html><body><article>" + "".join(f"<p>{BODY} {i}</p>" for i in range(20_000)) + "</article></body></html>"
    rows = [(1, "u", long, "x", 1), (2, None, None, "y", 2), (None, "v", "", None, 3), (2, None, None, "y", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r.page_id or 0, r.url, r.n_chars) for r in H.extract(df).collect()), key=repr)
    want = len(" ".join(f"{BODY} {i}" for i in range(20_000)))
    assert got == sorted([(1, "u", want), (2, None, 0), (0, "v", 0), (2, None, 0)], key=repr)
