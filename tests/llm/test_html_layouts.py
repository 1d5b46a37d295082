"""Wrappers come from all pages of a host: rare layouts and copies included."""

import pytest

from logloom.llm import html

RARE = '<html><body><div class="wrap"><div class="content"><p>Offers of the day, {i}, in a long list of offers that nobody reads {i}</p></div></div><div class="story"><p>{text}</p><h4>Sent by our desk</h4></div></body></html>'
USUAL = '<html><body><div class="wrap"><div class="content"><p>{text}</p><h4>Read more on our site</h4></div></div></body></html>'


def story(i):
    return f"Story {i} " + " ".join(f"word{i * k}" for k in range(60))


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_rare_layouts_and_copies(spark, broadcast_bytes):
    """8 pages of a layout among 400, and 3,000 copies of one page under urls of their own."""
    rows = [(i, f"http://h.com/{i}", (RARE if i % 50 == 7 else USUAL).format(i=i, text=story(i))) for i in range(400)]
    rows += [(1000 + i, f"http://h.com/copy/{i}", USUAL.format(text=story(1))) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r.text for r in html.extract_pages(df, broadcast_bytes=broadcast_bytes).collect()}
    assert got == {i: story(1 if i >= 1000 else i) for i, _, _ in rows}


def test_kept_wrappers_come_back():
    part = html.part_of(html.parse("<div>" * 300 + USUAL.format(text=story(3))))
    assert html.dumped(html.loaded(html.dumped(part))) == html.dumped(part)
    assert html.expression(html.loaded(html.dumped(part))) == html.expression(part)
