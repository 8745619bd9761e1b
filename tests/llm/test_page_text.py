"""Page differencing: alignment against the textbook table, markup by cases, pages of a made site."""

import random

import pytest

from pumpwatch.llm import page_text as pt


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("bits", [1 << 27, 8])
def test_common_is_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(pt, "TABLE_BITS", bits)
    r = random.Random(bits)
    for _ in range(300):
        a, b = ([r.choice("abcd"[:r.randint(1, 4)]) for _ in range(r.randint(0, 14))] for _ in range(2))
        got = pt.common(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        assert len(got) == longest(a, b)


def test_common_of_very_many_equal_lines():
    a, b = ["x"] * 20_000 + ["y"], ["y"] + ["x"] * 15_000
    assert len(pt.common(a, b)) == 15_000


@pytest.mark.parametrize("html, text", [
    ("", []),
    ("plain &lt;b&gt; &amp; text", ["plain <b> & text"]),
    ("<p>one<p>two<br>lines</p>three", ["one", "two lines", "three"]),
    ("<script>var t='</p>';</script><p>a</p><style>p{}</style>", ["a"]),
    ("<nav><ul><li>m</ul></nav><header>h</header><p>a</p><footer>f", ["a"]),
    ("<div class=ad>x</div><div class='main-nav'>y</div><p>a</p><div id=comments><p>c</div><p>b", ["a", "b"]),
    ("<main><p>a</p><aside>s</aside></main><p>outside</p>", ["a"]),
    ("<article><header><h1>T</h1></header><p>a <b>b</b></p><div class='cookie-notice'>n</div></article><div>x</div>", ["T", "a b"]),
    ("<article><p>a</p><section class=comments><article class=comment><p>c</p></article></section></article>", ["a"]),
    ("<div class='page has-sidebar'><p>a</p></div>", ["a"]),
    ("<div class='sidebar-layout'><p>a</p></div>", ["a"]),
    ("<!-- <p>no</p> --><p title='1 > 2'>a</p><!-- open", ["a"]),
    ("<p hidden>x</p><p style='display: none'>y</p><p>a&nbsp;&#160; b&#x41;</p>", ["a bA"]),
    ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>", ["a", "b", "c", "d", "e"]),
    ("<div><p>a</b></div></div><p>b</p></article>", ["a", "b"]),
    ("<form><input><p>q</p></form><textarea><p>x</textarea><title>t</title><p>a < b</p>", ["a < b"]),
])
def test_lines_of_markup(html, text):
    assert pt.Lines(html).text == text


def site(n, article):
    """Pages of one host whose menu and notice have no telling names."""
    return [(i, f"http://h.example/a/{i:04d}?x=1", "<div><p>Home</p><p>All about us</p></div>" + article(i) + "<p>Write to us</p>") for i in range(n)]


def extracted(spark, rows):
    return {(r.page_id, r.url): r.text for r in pt.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("block", [256, 3])
def test_shared_lines_go_and_others_stay(spark, monkeypatch, block):
    monkeypatch.setattr(pt, "BLOCK_PAGES", block)
    rows = site(23, lambda i: f"<p>Title {i}</p><p>Body of {i}, and its own.</p>")
    rows += [(100, "http://other.example/1", "<p>Home</p><p>alone</p>"), (101, None, "<p>Home</p>"), (102, "no url", None)]
    got = extracted(spark, rows)
    assert all(got[i, u] == f"Title {i}\nBody of {i}, and its own." for i, u, _ in rows[:23])
    assert got[100, "http://other.example/1"] == "Home\nalone" and got[101, None] == "Home" and got[102, "no url"] == ""


def test_copied_articles_stay(spark):
    rows = site(12, lambda i: f"<article><p>Title {i // 3}</p><p>The same long story of the group {i // 3}.</p><p>Licence line</p></article>")
    got = extracted(spark, rows)
    assert all(got[i, u].startswith(f"Title {i // 3}\nThe same long story of the group {i // 3}.") for i, u, _ in rows)


def test_a_notice_in_every_article_goes_and_a_passage_in_some_stays(spark):
    def article(i):
        passage = "<p>A passage of half of them</p>" if i % 4 < 2 else ""
        return f"<article><p>Title {i}</p>{passage}<p>A long story of its own, number {i}.</p><p>Tell your friends</p></article>"
    got = extracted(spark, site(16, article))
    want = lambda i: f"Title {i}\n" + ("A passage of half of them\n" if i % 4 < 2 else "") + f"A long story of its own, number {i}."
    assert all(text == want(i) for (i, _), text in got.items() if 1 < i < 14)


def test_pages_of_the_table(spark):
    rows = pt.extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        body = html[r.page_id].split("<article>")[1].split("</article>")[0]
        want = pt.Lines(f"<p>{body}").text
        assert r.text == "\n".join(want) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, key string, block long, gone string"
    big = "<p>" + "</p><p>".join(f"line {i % 900}" for i in range(60_000)) + "</p>"
    rows = [(2**53 + 1, "http://h/1", "<p>a</p>", "k", 1, "g"), (None, "http://h/1", "<p>a</p>", "k", 1, "g"), (None, None, None, None, None, None),
            (3, "http://h/2", big, "k", 1, "g"), (4, "http://h/3", big + "<p>own</p>", "k", 1, "g"), (4, "http://h/3", big + "<p>own</p>", "k", 1, "g")]
    got = pt.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert [r.text.endswith("own") for r in got if r.page_id == 4] == [True, True]
    assert pt.extract_text(spark.createDataFrame([], schema)).count() == 0
