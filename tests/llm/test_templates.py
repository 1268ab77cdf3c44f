"""Site templates against a plain counter, and the odd pages."""

from __future__ import annotations

from collections import defaultdict

from verdigris.llm import html


def deleted_by_hand(rows, share=html.SHARE, pages=html.PAGES):
    """page: (number of templates, characters in them), counted without Spark."""
    parsed = {i: (html.host(u), html.Page(h or "")) for i, u, h in rows}
    says, of, paragraph = defaultdict(set), defaultdict(set), {}
    for at, p in parsed.values():
        of[at].add(p.text())
        for h, tag in zip(p.hashes(), p.tags):
            if h:
                says[at, h].add(p.text())
                paragraph[h] = tag in html.PARAGRAPHS
    gone = {k for k, v in says.items() if len(v) >= pages and len(v) >= share * len(of[k[0]]) and (not paragraph[k[1]] or len(v) >= html.PARAGRAPH_PAGES and len(v) >= html.PARAGRAPH_SHARE * len(of[k[0]]))}
    return {i: (len({h for h in p.hashes() if (at, h) in gone}), p.parted({h for a, h in gone if a == at})[1]) for i, (at, p) in parsed.items()}


def test_templates_of_the_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet")
    out = {r["page_id"]: (r["n_templates"], r["template_chars"]) for r in html.extracted(pages).collect()}
    assert out == deleted_by_hand([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    assert sum(n > 0 for n, _ in out.values()) > 0


def test_templates_without_any_marks(spark):
    """Menus and boxes that no name or element gives away: two variants on a host; text that two pages share stays."""
    page = lambda k: f"<body><div><a>Home {k % 2}</a><a>Shop</a></div><div><p>Story {k} is told here</p><p>{'Said by all' if k < 9 else 'Said once ' + str(k)}</p></div><table><tr><td>Box {k % 2}</td></tr></table>"
    rows = [(k, "http://a.example/", page(k)) for k in range(20)] + [(100 + k, "http://b.example/", page(k)) for k in range(2)]
    out = {r["page_id"]: r for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0]["text"] == "Story 0 is told here\nSaid by all" and out[19]["text"] == "Story 19 is told here\nSaid once 19"
    assert out[100]["text"] == "Home 0Shop\nStory 0 is told here\nSaid by all\nBox 0"  # two pages prove nothing
    assert all(out[i]["n_templates"] >= 2 for i in range(20)) and out[0]["template_chars"] == len("Home 0ShopBox 0")
    assert {i: (r["n_templates"], r["template_chars"]) for i, r in out.items()} == deleted_by_hand(rows)


def test_odd_pages(spark):
    """Repeated and missing ids, one id with two pages, columns of the same names, and a very long page."""
    long = "<article>" + "<p>Word &amp; word</p>" * 40_000 + "</article>"
    rows = [(1, "http://a/", "<p>one</p>", "x"), (1, "http://a/", "<p>two</p>", "x"), (None, "http://a/", "<p>no id</p>", "x"), (2, None, long, "x"), (3, "http://a/", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumnRenamed("text", "host").selectExpr("*", "host AS text", "1 AS deleted", "2 AS hash")
    out = sorted((r["page_id"] or 0, r["text"]) for r in html.extracted(df).collect())
    assert out == [(0, "no id"), (1, "one"), (1, "two"), (2, "\n".join(["Word & word"] * 40_000)), (3, "")]
