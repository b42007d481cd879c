"""Chunking against a plain pass over each site's joined text."""

import random

from pyspark.sql import functions as F

from test_text import dedupe, tidy
from tessera.operators import chunking as C, sites as S
from tessera.plans.site_chunks import site_chunks
from tessera.sources import stores as R
from tessera.session import scratch_folder

MARK = "--- PAGE START:"


def tokens(text):
    return len(text) // 3


def plain_chunks(pages, limit):
    """Join, clean, split by page marks, split long pages, pack, split again."""
    joined = "\n\n".join(f"{MARK} {u} ---\n{c}\n--- PAGE END ---" for u, c in pages)
    clean = tidy(dedupe(joined))
    parts = clean.split(MARK)
    texts = ([parts[0]] if parts[0].strip() else []) + [MARK + p for p in parts[1:]]
    pieces = [p for t in texts for p in (C.split_text(t, limit) if tokens(t) > limit else [t])]
    groups, used = [], 0
    for piece in pieces:
        if groups and used + tokens(piece) <= limit:
            groups[-1].append(piece)
            used += tokens(piece)
        else:
            groups.append([piece])
            used = tokens(piece)
    chunks = []
    for group in groups:
        text = "\n\n".join(group)
        chunks += C.split_within(text, limit) if tokens(text) > limit else [text]
    return chunks


def made_pages(seed=9):
    rng = random.Random(seed)
    words = ["alfa", "beta", "gama", "delta", "épsilon", "zeta", "x", "um", "dois"]
    menu = ["Home | Sobre | Contato", "Rodapé da empresa", "ok"]
    rows = []
    for place in range(240):
        site = "hot.example.com" if rng.random() < 0.6 else f"s{rng.randrange(12)}.example.com"
        body = menu[:]
        for _ in range(rng.randrange(3, 14)):
            body.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))))
        if place % 17 == 0:
            body.append("palavra " * 300)
        if place % 23 == 0:
            body.append("z" * 900)
        rows.append((site, place, f"https://{site}/p{place}", "\n".join(x.strip() for x in body)))
    return rows


def test_chunks_equal_one_pass(spark):
    rows = made_pages()
    pages = spark.createDataFrame(rows, "site string, page_ord long, url string, content string")
    limit = 200
    out = site_chunks(pages, C.ChunkRules(limit=limit, hard_limit=260, min_chars=50)).collect()
    got = {}
    for r in out:
        got.setdefault(r.site, {})[r.chunk_index] = r
    sites = {}
    for site, _, url, content in rows:
        sites.setdefault(site, []).append((url, content))
    for site, its_pages in sites.items():
        want = plain_chunks(its_pages, limit)
        mine = got[site]
        assert sorted(mine) == list(range(1, len(want) + 1))
        assert [mine[i].content for i in sorted(mine)] == want
        assert all(r.total_chunks == len(want) and r.tokens == tokens(r.content) for r in mine.values())
        assert all(r.tokens <= limit for r in mine.values())
        assert all(len(r.pages_included) > 0 for r in mine.values())


def test_split_keeps_all_text():
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice("abc  \n\n") for _ in range(rng.randrange(1, 4000)))
        flat = lambda s: "".join(s.split())
        assert flat("".join(C.split_text(text, 60))) == flat(text)
        strict = C.split_within(text, 60)
        assert flat("".join(strict)) == flat(text)
        assert all(tokens(p) <= 60 for p in strict)


def test_split_flushes_text_before_a_long_paragraph():
    pieces = C.split_text("short one\n\n" + "long " * 100, 60)
    assert pieces[0].strip() == "short one"


def test_long_line_breaks_at_a_space():
    line = ("w" * 9 + " ") * 40
    pieces = C.split_text(line.strip(), 50)
    assert all(p.endswith(" ") for p in pieces[:-1])
    assert C.split_text("y" * 400, 50)[0] == "y" * 135


def test_marked_text_comes_apart(spark):
    text = f"intro\n{MARK} https://a.example.com/1 ---\none\n{MARK} https://a.example.com/2\ntwo"
    rows = C.split_marked_text(spark.createDataFrame([("s", text)], "site string, content string")).orderBy("page_ord").collect()
    assert [r.url for r in rows] == [None, "https://a.example.com/1", "https://a.example.com/2"]
    assert rows[0].page == "intro\n" and rows[2].page == f"{MARK} https://a.example.com/2\ntwo"


def test_site_content_and_joined_text(spark):
    rows = [(f"s{i % 2}", i, f"u{i}", "x" * 50) for i in range(20)]
    pages = spark.createDataFrame(rows, "site string, page_ord long, url string, content string")
    blocks = S.site_content(pages)
    whole = {r.site: r.content for r in S.joined_text(blocks).collect()}
    offsets = {(r.site, r.page_ord): (r.char_offset, r.block) for r in blocks.collect()}
    for site in ("s0", "s1"):
        want = "\n\n".join(
            f"{MARK} {u} ---\n{c}\n--- PAGE END ---" for s, _, u, c in rows if s == site
        )
        assert whole[site] == want
        for (s, _), (at, block) in offsets.items():
            assert s != site or want[at : at + len(block)] == block
    pages = C.split_marked_text(S.joined_text(blocks)).collect()
    assert sorted(r.page_ord for r in pages if r.site == "s0") == list(range(10))


def test_chunk_store_replaces_and_appends(spark):
    shape = "cnpj_basico string, chunk_index long, total_chunks long, chunk_content string, token_count long, pages_included array<string>"
    first = spark.createDataFrame([("a", 1, 2, "x", 1, ["u"] * 7), ("a", 2, 2, "y", 1, []), ("b", 1, 1, "z", 1, ["v"])], shape)
    folder = scratch_folder(spark, "test-chunks")
    R.write_chunks(first, folder)
    R.write_chunks(spark.createDataFrame([("a", 1, 1, "new", 1, ["w"])], shape), folder)
    rows = {(r.cnpj_basico, r.chunk_index): r for r in R.read_chunks(spark, folder).collect()}
    assert set(rows) == {("a", 1), ("b", 1)}
    assert rows["a", 1].chunk_content == "new" and rows["b", 1].page_source == "v"
    R.write_chunks(first, folder, mode="append")
    assert R.read_chunks(spark, folder).count() == 5
    assert R.read_chunks(spark, folder).where("page_source = 'u,u,u,u,u'").count() == 1
