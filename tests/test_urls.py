"""Urls and links against the standard library and worked cases."""

from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from conftest import values
from tessera.functions import urls as U
from tessera.operators import access as A, discovery as D, links as N

URLS = [
    "https://www.Example.com:8080/a/b;p=1?x=1&y=2#f", "http://h.example.com", "//h.example.com/x",
    "/only/path?q", "https://h.example.com/a;b/c", "https://h.example.com/?a=/b", "mailto:a@b.example.com", "",
]


def test_url_parts(spark):
    parsed = [urlparse(u) for u in URLS]
    assert values(spark, URLS, U.netloc) == [p.netloc for p in parsed]
    assert values(spark, URLS[:6], U.path) == [p.path for p in parsed[:6]]
    assert values(spark, URLS, U.query) == [p.query for p in parsed]
    assert values(spark, URLS, U.url_domain) == [p.netloc.lower() for p in parsed]


def test_url_join(spark):
    bases = ["https://h.example.com/a/b?x=1", "https://h.example.com", "http://h.example.com/a/"]
    refs = [
        "", "c", "/c", "//o.example.com/z", "https://o.example.com/", "?q=1", "../c", "./c/", "../../c",
        "/a/./b/../c", "..", ".", "mailto:x@y.example.com", "c/d.html#f", "#f",
    ]
    pairs = [(b, r) for b in bases for r in refs]
    rows = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string")
    got = rows.orderBy("i").select(U.url_join(F.col("b"), F.col("r"))).collect()
    want = [urljoin(b, r) for b, r in pairs]
    assert [(p, g[0]) for p, g in zip(pairs, got)] == [(p, w) for p, w in zip(pairs, want)]


def test_normalize_url(spark):
    cases = {
        ' "https://h.example.com/a b/ç?x=1 2&y", ': "https://h.example.com/a%20b/%C3%A7?x=1%202&y",
        "https://h.example.com/a%20%22rest": "https://h.example.com/a",
        "'https://h.example.com/p%20q?k=v%22z'": "https://h.example.com/p%20q?k=v",
        "https://h.example.com/~a*b+c": "https://h.example.com/~a%2Ab%2Bc",
        "https://h.example.com,": "https://h.example.com",
    }
    assert values(spark, list(cases), U.normalize_url) == list(cases.values())


def test_url_variations(spark):
    got = values(spark, ["h.example.com/", "http://www.h.example.com/a/"], U.url_variations)
    assert got[0] == [
        "https://www.h.example.com", "https://h.example.com", "http://www.h.example.com", "http://h.example.com",
    ]
    assert got[1] == [
        "https://www.h.example.com/a", "https://h.example.com/a", "http://www.h.example.com/a", "http://h.example.com/a",
    ]


def test_links_of_a_page(spark):
    html = (
        '<a href="/a.PDF,">1</a><a href="x.png">2</a><a href="#t">3</a><a HREF=\'JavaScript:go()\'>4</a>'
        '<a href="https://o.example.com/">5</a><a href="b?img=a.jpg">6</a><a href=c&amp;d>7</a><a href="/c%26">8</a>'
        '<a href="/p#t">9</a><a href="c&d,">10</a><!-- <a href="/no">no</a> -->'
    )
    row = values(spark, [html], lambda c: N.extract_links(c, F.lit("https://h.example.com/p")))[0]
    assert row["documents"] == ["https://h.example.com/a.PDF"]
    assert row["pages"] == ["https://h.example.com/c&d", "https://h.example.com/c%26"]


def test_prioritize_links(spark):
    base = "https://h.example.com"
    links = [f"{base}/{p}" for p in ["", "sobre", "blog", "login/sobre", "x/y/z", "page/2", "contato", "b", "a"]]
    got = values(spark, [links], lambda c: N.prioritize_links(c, F.lit(base)), "array<string>")[0]
    order = [s["link"].replace(base, "") for s in got]
    # "login/sobre": -100 + 50 - 3 = -53 stays; "blog": -102 goes; the base itself goes.
    assert order == ["/contato", "/sobre", "/page/2", "/a", "/b", "/x/y/z", "/login/sobre"]


def test_select_links_falls_back(spark):
    links = [f"https://h.example.com/p{i}" for i in range(6)]
    few = values(spark, [links], lambda c: N.select_links(c, F.lit("https://h.example.com"), 6), "array<string>")[0]
    assert few == links
    picked = F.array(F.lit(links[5]), F.lit(links[1]), F.lit(links[2]))
    got = values(spark, [links], lambda c: N.select_links(c, F.lit("https://h.example.com"), 2, picked), "array<string>")[0]
    assert got == [links[5], links[1]]
    none = F.array().cast("array<string>")
    got = values(spark, [links], lambda c: N.select_links(c, F.lit("https://h.example.com"), 2, none), "array<string>")[0]
    assert got == links[:2]


def test_subpage_cap_under_five_becomes_ten(spark):
    assert values(spark, [True, False], lambda c: N.subpage_cap(c), "boolean") == [10, 100]


def test_blocked_domains(spark):
    cases = {
        "https://www.facebook.com/a": True, "facebook.com": True, "m.facebook.com/x": True,
        "http://a.b.olx.com.br": True, "https://notfacebook.com": False, "https://facebook.com.example.org": False,
        "https://mobile.x.com": True, "https://www.m.mobile.youtube.com": True, "": False,
    }
    assert values(spark, list(cases), D.is_blocked) == list(cases.values())
    rows = spark.createDataFrame([(u,) for u in cases], "u string")
    kept = {r[0] for r in D.drop_blocked(rows, "u", D.blocked_table(spark)).collect()}
    assert kept == {u for u, bad in cases.items() if not bad}


def test_name_and_domain_pairs(spark):
    pairs = [
        ("AR ENGENHARIA", "https://arengenharia.eng.br", True), ("12M", "http://www.12m.com.br", True),
        ("CONSTRUTORA CESAR", "construtoracesar.com.br", True), ("ASST Serviços", "https://asst.com.br", True),
        ("CIMMAA Metalmecanica", "https://cimmaa.com.br", True),
        ("Alianza Manutenção", "https://allianzautomacao.com.br", True), ("4M Engenharia", "https://4mengenharia.com.br", True),
        ("Padaria Sol", "https://guia.example.com", False),
    ]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, n string, u string, want boolean")
    got = rows.orderBy("i").select(D.name_matches_domain(F.col("n"), F.col("u"))).collect()
    assert [g[0] for g in got] == [p[2] for p in pairs]


def test_legal_suffix_literal_and_whole_word(spark):
    names = ["ABC MERCADO LTDA", "X ME", "Y S/A"]
    assert values(spark, names, D.strip_legal_suffix) == ["ABCRCADO", "X", "Y"]
    assert values(spark, names, lambda c: D.strip_legal_suffix(c, whole_word=True)) == ["ABC MERCADO", "X", "Y"]


def test_retry_after(spark):
    now = 1445412420.0  # Wed, 21 Oct 2015 07:27:00 GMT
    cases = {"120": 60.0, "5": 5.0, "0": None, "-1": None, "": None, "x": None, "Wed, 21 Oct 2015 07:27:30 GMT": 30.0,
             "Wed, 21 Oct 2015 07:28:00 GMT": 60.0, "Wed, 21 Oct 2015 07:20:00 GMT": None}
    assert values(spark, list(cases), lambda c: D.retry_after(c, now)) == list(cases.values())


def test_soft_404_lengths(spark):
    texts = ["Not Found", "x" * 150 + " not found", "x" * 300 + " not found", "x" * 900 + " page not found", "x" * 1100 + " page not found"]
    assert values(spark, texts, A.is_soft_404) == [True, True, False, True, False]


def test_robots(spark):
    files = ["User-agent: *\nDisallow: /", "User-agent: *\nDisallow: /x", "User-agent: a\nDisallow: /\n", "", None]
    assert values(spark, files, A.robots_allowed) == [False, True, True, True, None]
