import random
from collections import Counter

from pointweave.llm import html
from tests.llm.helpers import collected, words


def texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in collected(html.extract(df))}


def page(i, extra=""):
    return f"<article><h1>Title {i}</h1><p>Read more on our site</p><p>Body number {i}</p>{extra}</article>"


def test_outliers_and_long_pages_leave_the_template(spark):
    pages = [page(i) for i in range(15)]
    pages[3] = page(3, "<p>" + "long " * 600_000 + "</p>")
    got = texts(spark, [*pages, None, "", "<p>cut <b"])
    assert got[0] == "Title 0\n\nBody number 0" and got[3].startswith("Title 3\n\nBody number 3\n\nlong")
    assert (got[15], got[16], got[17]) == ("", "", "cut")


def test_template_needs_pages_support_and_order(spark):
    copies = texts(spark, [page(1)] * 20)
    assert copies[0] == "Title 1\n\nRead more on our site\n\nBody number 1"
    some = texts(spark, [page(i) if i % 3 else f"<article><h1>Title {i}</h1><p>Body number {i}</p></article>" for i in range(15)])
    assert some[1] == "Title 1\n\nRead more on our site\n\nBody number 1"
    ab = ["<p>Part one</p>", "<p>Part two</p>"]
    crossed = texts(spark, [f"<article><p>Body {i}</p>{''.join(ab[:: 1 if i % 2 else -1])}</article>" for i in range(12)])
    assert crossed[1] == "Body 1\n\nPart one\n\nPart two"


def plain_page(i, r):
    """A page whose names say nothing; its article, and the page."""
    body = [words(r.randint(20, 60), 1000 * i + k) for k in range(r.randint(1, 5))]
    blocks = "".join(f"<p>{b}</p>" for b in body)
    menu = "".join(f"<div class='k2'><a href='/{k}'>{words(1, 7 * i + k)}</a></div>" for k in range(5))
    more = f"<div class='k9'>{''.join(f'<a href=x>{words(3, 99 * i + k)}</a>' for k in range(4))}</div>"
    markup = f"<html><body><div class='k1'>{menu}</div><div class='k3'>{words(6, 31 * i)}</div><div class='k4'><div class='k5'><h1>{words(4, i)}</h1>{blocks}{more}<p>Always the same line</p></div></div><div class='k6'>{words(5, 17 * i)}</div></body></html>"
    return "\n\n".join([words(4, i), *body]), markup


def test_meaningless_names_still_give_the_article(spark):
    r = random.Random(4)
    pages = [plain_page(i, r) for i in range(40)]
    got = texts(spark, [m for _, m in pages])
    assert [got[i] for i in range(40)] == [t for t, _ in pages]
    df = spark.createDataFrame([(i, "http://h.example/", m) for i, (_, m) in enumerate(pages)], "page_id bigint, url string, html string")
    off = {x["page_id"]: x["text"] for x in collected(html.extract(df, deduce=False))}
    assert all(off[i] != got[i] for i in range(40))


def test_names_do_not_outweigh_the_text(spark):
    pages = [f"<body><nav><a>menu {i}</a></nav><div class='entry-content ad-free'><h2>Head {i}</h2><p>{words(80, i)}</p></div><div class='ad'>{words(4, 50 + i)}</div></body>" for i in range(6)]
    got = texts(spark, pages)
    assert got[2] == f"Head 2\n\n{words(80, 2)}"
    assert texts(spark, pages[:1])[0] == f"Head 0\n\n{words(80, 0)}"


def test_other_pages_of_a_host_and_markup(spark):
    r = random.Random(4)
    pages = [plain_page(i, r) for i in range(20)]
    odd = "<article><h1>Other</h1><p>E = <math><mi>m</mi></math> c</p><svg/><p>end</p><object>x</object></article><aside>no</aside>"
    got = texts(spark, [*[m for _, m in pages], odd])
    assert got[20] == "Other\n\nE = m c\n\nend" and got[3] == pages[3][0]


def test_heavy_hosts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(html, "HEAVY_PAGES", 7)
    r = random.Random(8)
    pages = [plain_page(i, r) for i in range(40)]
    got = texts(spark, [m for _, m in pages])
    assert [got[i] for i in range(40)] == [t for t, _ in pages]


def brute_roots(pages):
    """Containers' paths that half of the pages have once."""
    counts = Counter(p for page in pages for p, n in Counter(p for p, _, _ in page.nodes).items() if n == 1)
    return {p for p, n in counts.items() if 2 * n >= len(pages)}


def test_classes_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(f"h{i % 2}", plain_page(i, r)[1] if i % 5 else "<div class=z><p>odd</p></div>" + words(3, i)) for i in range(30)]
    df = spark.createDataFrame(rows, "host string, html string")
    got = {x["host"]: x for x in collected(html.host_templates(df, html.Parts.of(df)))}
    for h in ("h0", "h1"):
        pages = [html.parse(m) for name, m in rows if name == h]
        k5 = [c for c in (html.containers(p)[1].get(got[h]["main"]) for p in pages) if c]
        assert k5 and {c.path for c in k5} <= brute_roots(pages) and len(k5) == sum(m.count("k5") for name, m in rows if name == h)


def test_nesting_and_repeats_stay_linear():
    for s in ("<div>" * 60_000, "<p><div class='ad'>x" * 30_000, "<b>" * 100_000 + "x", '<a "' * 50_000):
        html.main_text(html.parse(s), None)
    long = "<article><p>" + "word " * 1_000_000 + "</p></article>"
    assert len(html.main_text(html.parse(long), None)) == 4_999_999
