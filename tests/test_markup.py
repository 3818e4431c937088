"""The HTML reader: tables against a plain grid, all metadata, cleaning with its veto, and linear time on malformed pages."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest

from quernstone.sources import markup

FILLER = "This sentence stands here so that the paragraph is long enough to be read. " * 5


def page(body, head=""):
    return f"<html><head><title>T &amp; t</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><td>a <table><tr><td>b</td></tr></table></td><td>c</td></tr></table>", [(0, 0, ["a b", "c"]), (1, 0, ["b"])]),
        ("<table><tr><th rowspan=2>x<th colspan=2>y<tr><td>1<td>2<tr><td>3</table>", [(0, 0, ["x", "y", "y"]), (0, 1, ["x", "1", "2"]), (0, 2, ["3"])]),
        ("<TABLE><tr class=x><TH>a\n b</TH><td> 1 <br>2</td></tr><tr></tr></TABLE>", [(0, 0, ["a b", "1 2"]), (0, 1, [])]),
        ("<table><tr><td rowspan=99>a<td>b<tr><td colspan='0'>c", [(0, 0, ["a", "b"]), (0, 1, ["a", "c"])]),
        ("<table><thead><tr><th>h<tbody><tr><td>1 &lt; 2<td><script>x</td></script>z</table>after", [(0, 0, ["h"]), (0, 1, ["1 < 2", "x</td> z"])]),
        ("<td>no table</td>", []), (None, []), ("<table>", []),
        ("<table><td>no row<table><td>deep</table></td><td>end", [(0, 0, ["no row deep", "end"]), (1, 0, ["deep"])]),
    ],
)
def test_tables(html, want):
    assert markup.tables(html) == want


def test_random_grids_with_spans_and_missing_end_tags():
    rng = random.Random(2)
    for _ in range(200):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        grid = [[None] * m for _ in range(n)]
        html = "<table>"
        for i in range(n):
            html += "<tr>"
            for j in range(m):
                if grid[i][j] is None:
                    down, right = rng.randint(1, n - i), 1
                    while j + right < m and grid[i][j + right] is None and rng.random() < 0.4:
                        right += 1
                    free = next((d for d in range(1, down) if any(grid[i + d][j + r] is not None for r in range(right))), down)
                    name = f"c{i}_{j}"
                    for d in range(free):
                        for r in range(right):
                            grid[i + d][j + r] = name
                    html += rng.choice(["<td", "<TH"]) + f" rowspan={free} colspan=\"{right}\">{name}" + rng.choice(["", "</td>" if "<td" in html[-40:] else ""])
            html += rng.choice(["", "</tr>"])
        assert [r for _, _, r in markup.tables(html + "</table>")] == grid


def test_all_metadata_in_any_order_and_quotes():
    head = """<meta content='Og' property=og:title><META NAME="date" CONTENT="2024-02-01"><meta property="article:published_time" content=2024-03-01>
    <script type="application/ld+json">{"@graph": [{"headline": "H", "datePublished": "2024-01-01", "author": [{"name": "A"}, "B"]}, 3]}</script><script type='application/ld+json'>{broken</script>"""
    got = markup.metadata(page('<time datetime="2024-04-01">x</time><time class=y datetime=\'2024-05-01\'></time>', head))
    assert set(got) == {
        ("title", "H", "json_ld"), ("published", "2024-01-01", "json_ld"), ("author", "A", "json_ld"), ("author", "B", "json_ld"), ("title", "Og", "open_graph"), ("published", "2024-02-01", "meta"),
        ("published", "2024-03-01", "open_graph"), ("published", "2024-04-01", "time"), ("published", "2024-05-01", "time"), ("title", "T & t", "title"),
    }


def test_clean_removes_furniture_and_keeps_the_article_in_order():
    body = f"""<nav class="site-nav">Home &gt; News</nav><div id="cookie-banner">Accept all</div><article><h1>Head</h1><p>First. {FILLER}</p><script>f("</p>")</script>
    <h2>Sub</h2><blockquote>“Said.”</blockquote><ul><li>One<li><p>Two</p></ul><figure><img src=x><figcaption>At the door</figcaption></figure><div class="share social">Share</div></article><div class=footer>Rights</div>"""
    got = markup.clean(page(body, '<meta content="Named" property="og:title">'), ("div.entry", "main article"))
    assert got.title == "Named" and got.selector == "generic:article" and got.status == "cleaned" and got.captions == ["At the door"]
    assert got.body.split("\n\n") == ["Head", f"First. {FILLER}".strip(), "Sub", "“Said.”", "One", "Two", "At the door"]
    assert markup.clean(page(f"<main><article><p>{FILLER}</article></main>"), ("main article",)).selector == "own:main article"


@pytest.mark.parametrize(("text", "why"), [("“Better buses,” they said", "contains_quotation"), ("Labour statement", "kept_word"), ("Long words come here now. " * 20, "several_sentences"), ("Buy now", None), ("Short. Twice.", None)])
def test_veto(text, why):
    got = markup.clean(page(f"<article><p>{FILLER}</p><div class='promo'><p>{text}</p></div></article>"))
    assert (text.strip() in got.body) == (why is not None)
    assert [k.split(":")[0] for k in got.kept] == ([why] if why else []) and ("uncertain_blocks_kept" in got.warnings) == bool(why)


def test_pages_that_are_no_articles():
    assert markup.clean(page("<h1>Just a moment...</h1>")).warnings == ["non_article_page"]
    assert (markup.clean(page("<div>loose text</div>")).status, markup.clean(None).status) == ("review_required", "review_required")
    assert markup.clean(page(f"<div id='wm-ipp-base'><p>Archive toolbar</p></div><p>{FILLER}</p>")).body == FILLER.strip()


def test_cleaning_twice_changes_nothing():
    first = markup.clean(page(f"<article><h1>Head</h1><p>{FILLER}</p><div class=promo>“x”</div></article>"))
    again = markup.clean(page("<article>" + "".join(f"<p>{p}</p>" for p in first.body.split("\n\n")) + "</article>"))
    assert again.body == first.body


@pytest.mark.parametrize("bit", ["<a 'x", "<div class=nav><p>", "<!-- ", "</p", "<table><tr><td>", "<script>", "&#", "<form>", "<", "<td><p></table>"])
def test_malformed_pages_take_linear_time(bit):
    began = time.perf_counter()
    markup.clean(bit * 5000)
    markup.tables(bit * 5000)
    assert time.perf_counter() - began < 5


def test_over_tables_with_odd_names(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>a</table>", "x"), (None, None, "y"), (1, "<table><tr><td>a</table>", "x")], "`a.b` long, `h t` string, names string")
    assert [tuple(r) for r in markup.table_rows(df, "a.b", "h t").collect()] == [(1, 0, 0, ["a"])] * 2
    assert sorted(r["status"] for r in markup.cleaned(df, "a.b", "h t").collect()) == ["review_required"] * 3
    assert markup.evidence(df.limit(0), "a.b", "h t").count() == 0


def test_metadata_with_named_entities_only():
    """html_metadata reads three escapes, as its SQL does; a title cut within one, or with another entity, stays as it is written."""
    three = markup.named_entities({"&lt;": "<", "&gt;": ">", "&amp;": "&"})
    page = "<title>a &lt;b&gt; &amp; c &quot;d&quot; &amp;lt; the&amp</title>"
    assert markup.metadata(page, three) == [("title", "a <b> & c &quot;d&quot; &lt; the&amp", "title")]
    assert markup.metadata(page) == [("title", 'a <b> & c "d" &lt; the&', "title")]


def test_pages_of_one_shape_are_parsed_once(monkeypatch):
    sheet = lambda n, x: "<table>" + "\n".join(f"<tr id=r><td class='c'> <b>{x} {k}</b>\n</td><td>é {x}\t.</td><td></td></tr>" for k in range(n)) + "</table>"
    pages = [sheet(k % 3 + 1, k) for k in range(300)] + [None, "<table><tr><td>a &amp; b", "1 < 2 <table><td>x"]
    want = [(k, *r) for k, p in enumerate(pages) for r in markup.tables(p)]
    parsed, plain = [], markup.tables
    monkeypatch.setattr(markup, "tables", lambda html: parsed.append(html) or plain(html))
    got = [r for page, table, row, cells in markup.Shapes().read(pa.array(pages)) for r in zip(page.tolist(), table.tolist(), row.tolist(), cells.to_pylist(), strict=True)]
    assert got == want
    assert len(parsed) == 3 + 3  # three shapes, and the pages without any


def test_batches_of_odd_pages_are_read_as_page_by_page():
    """Random tags and texts, two shapes a batch; spans, nesting, quotes that never close, comments, scripts, entities and rare blanks."""
    rng = random.Random(5)
    tags = ["<table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<td rowspan=2>", "<td colspan='2'>", "</table>", "<b>", "</b>", "<p>", "<br>", '<td a="x y">', "<td a='>", "<td a=b'c>", "<!-- x -->", "<script>", "</script>"]
    texts = ["", "a", " b ", "  c  d ", "\n", "\te f", "é", "12", "x &amp; y", "&nbsp;", "1 < 2", "2 > 1", "z\x1cq", "\x85", "'", '"']
    for trial in range(600):
        shapes = [["<table>", *(rng.choice(tags[: rng.choice([9, 14, 19])]) for _ in range(rng.randint(1, 12)))] for _ in range(2)]
        some = texts[: rng.choice([5, 8, 16])]
        pages = [None, *("".join(rng.choice(some) + x for x in rng.choice(shapes)) + rng.choice(some) for _ in range(7))]
        want = [(k, *r) for k, p in enumerate(pages) for r in markup.tables(p)]
        found = markup.Shapes().read(pa.array(["q<", *pages])[1:])
        assert [r for page, table, row, cells in found for r in zip(page.tolist(), table.tolist(), row.tolist(), cells.to_pylist(), strict=True)] == want, (trial, pages)
