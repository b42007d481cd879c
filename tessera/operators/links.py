"""Links of a page: extraction, filters, priorities, selection and batches.

The links of a page live in the page's row as an array, so every step here is an
array expression: nothing is exploded and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions import urls as U
from tessera.functions.html import hrefs
from tessera.functions.text import contains_any, let, quote_literal, strip

# File types and folders that are not pages.
DOCUMENT_EXTENSIONS = [".pdf", ".doc", ".docx", ".ppt", ".pptx"]
STATIC_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp", ".tiff",
    ".zip", ".rar", ".tar", ".gz", ".xls", ".xlsx", ".csv", ".txt", ".xml", ".json", ".js", ".css",
    ".mp4", ".mp3", ".avi", ".mov", ".wmv", ".flv", ".webm",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
]
QUERY_IMAGE_NAMES = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp"]
PAGE_QUERY_IMAGE_NAMES = [".png", ".jpg", ".jpeg", ".gif", ".svg"]
ASSET_FOLDERS = ["/wp-content/uploads/", "/assets/", "/images/", "/img/", "/static/", "/media/"]
ASSET_IMAGES = QUERY_IMAGE_NAMES + [".ico"]

# Words that raise or lower a link.
HIGH_PRIORITY = [
    "quem-somos", "sobre", "institucional",
    "portfolio", "produto", "servico", "solucoes", "atuacao", "tecnologia",
    "catalogo", "catalogo-digital", "catalogo-online", "produtos", "servicos",
    "clientes", "cases", "projetos", "obras", "certificacoes", "premios", "parceiros",
    "equipe", "time", "lideranca", "contato", "fale-conosco", "unidades",
]
LOW_PRIORITY = [
    "login", "signin", "cart", "policy", "blog", "news", "politica-privacidade", "termos",
]
PAGING = ["page", "p=", "pagina", "nav"]

# Link limits.
MAX_LINKS = 30
MAX_SUBPAGES = 100
RESCUE_LINKS = 3
RESCUE_BELOW_CHARS = 500
BATCH_SIZE = 25


def _ends_with_any(c: Column, endings: list[str]) -> Column:
    return c.rlike("(?:" + "|".join(quote_literal(e) for e in endings) + r")\z")


def clean_link(link: Column) -> Column:
    return F.regexp_replace(strip(link), r",+\z", "")


def _same_page(link: Column, base: Column) -> Column:
    return F.contains(link, F.lit("#")) & (U.without_fragment(link) == U.without_fragment(base))


def link_kind(link: Column, base: Column) -> Column:
    """``document``, ``page`` (same host) or null for what is not followed."""
    route, args = F.lower(U.path(link)), F.lower(U.query(link))
    return (
        F.when(_ends_with_any(route, DOCUMENT_EXTENSIONS), "document")
        .when(_ends_with_any(route, STATIC_EXTENSIONS), F.lit(None).cast("string"))
        .when(
            (U.netloc(link) == U.netloc(base)) & ~contains_any(args, PAGE_QUERY_IMAGE_NAMES), "page"
        )
    )


def extract_links(html: Column, base: Column) -> Column:
    """Struct (documents, pages) of the distinct links of a page, resolved."""
    wanted = F.filter(
        F.array_distinct(hrefs(html)),
        lambda h: ~h.startswith("#") & ~F.lower(h).startswith("javascript:"),
    )
    full = F.array_distinct(
        F.transform(wanted, lambda h: F.regexp_replace(U.url_join(base, h), r",+\z", ""))
    )
    kinds = F.transform(
        F.filter(full, lambda x: ~_same_page(x, base)),
        lambda x: F.struct(link_kind(x, base).alias("kind"), x.alias("link")),
    )

    def of_kind(ks: Column, name: str) -> Column:
        return F.transform(F.filter(ks, lambda k: k["kind"] == name), lambda k: k["link"])

    return let(
        kinds,
        lambda ks: F.struct(
            of_kind(ks, "document").alias("documents"), of_kind(ks, "page").alias("pages")
        ),
    )


def is_html_link(link: Column) -> Column:
    """False for documents, static files and images, wherever the name hides."""
    route, args = F.lower(U.path(link)), F.lower(U.query(link))
    return (
        (link != "")
        & ~_ends_with_any(route, DOCUMENT_EXTENSIONS)
        & ~_ends_with_any(route, STATIC_EXTENSIONS)
        & ~contains_any(args, QUERY_IMAGE_NAMES)
        & ~(contains_any(route, ASSET_FOLDERS) & _ends_with_any(route, ASSET_IMAGES))
    )


def filter_non_html_links(links: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(links, clean_link), is_html_link))


def link_score(link: Column) -> Column:
    """Keyword bonus and malus, minus the depth of the path."""
    low = F.lower(link)
    is_low = contains_any(low, LOW_PRIORITY)
    score = F.when(is_low, -100).otherwise(0)
    score = score + F.when(contains_any(low, HIGH_PRIORITY), 50).otherwise(0)
    score = score - F.size(F.split(U.path(link), "/", -1))
    return score + F.when(contains_any(low, PAGING) & ~is_low, 30).otherwise(0)


def prioritize_links(links: Column, base: Column, keep_above: int = -80) -> Column:
    """Array of (score, link), best first, without the base url and the hopeless.

    Ties are broken by the url, which makes the order the same on every run.
    """
    bare_base = F.regexp_replace(base, r"/+\z", "")
    wanted = F.filter(
        F.transform(links, clean_link),
        lambda x: (x != "") & (F.regexp_replace(x, r"/+\z", "") != bare_base),
    )
    scored = F.transform(
        wanted, lambda x: F.struct((-link_score(x)).alias("minus"), x.alias("link"))
    )
    return F.transform(
        F.sort_array(F.filter(scored, lambda s: s["minus"] < -keep_above)),
        lambda s: F.struct((-s["minus"]).alias("score"), s["link"].alias("link")),
    )


def _link_names(scored: Column) -> Column:
    return F.transform(scored, lambda s: s["link"])


def select_links(
    links: Column, base: Column, max_links: int = MAX_LINKS, picked: Column | None = None
) -> Column:
    """Links to fetch: all when few, else the picked ones, else the best scored."""

    def choose(usable: Column) -> Column:
        best = F.slice(_link_names(prioritize_links(usable, base)), 1, max_links)
        if picked is not None:
            chosen = F.coalesce(picked, F.array().cast("array<string>"))
            best = F.when(F.size(chosen) > 0, F.slice(chosen, 1, max_links)).otherwise(best)
        return F.when(F.size(usable) <= max_links, F.sort_array(usable)).otherwise(best)

    return let(filter_non_html_links(links), choose)


def subpage_cap(slow: Column, slow_cap: int = 3, max_subpages: int = MAX_SUBPAGES) -> Column:
    """Subpages to fetch; a cap under five becomes ten, as the rule is defined."""
    cap = F.when(slow, F.lit(slow_cap)).otherwise(F.lit(max_subpages))
    return F.when(cap < 5, F.lit(10)).otherwise(cap)


def target_subpages(links: Column, base: Column, cap: Column) -> Column:
    """Usable links by priority, cut at the cap."""
    return F.slice(_link_names(prioritize_links(filter_non_html_links(links), base)), F.lit(1), cap)


def rescue_links(content: Column, links: Column, base: Column, n_subpages: Column) -> Column:
    """Top links of a short main page that has links but no fetched subpages."""
    top = F.slice(
        _link_names(prioritize_links(filter_non_html_links(links), base)), 1, RESCUE_LINKS
    )
    needed = (F.length(content) < RESCUE_BELOW_CHARS) & (F.size(links) > 0) & (n_subpages == 0)
    return F.when(needed, top).otherwise(F.array().cast("array<string>"))


def fetch_batches(links: Column, size: int = BATCH_SIZE) -> Column:
    """Array of (batch, link): ``size`` links per batch, in order."""
    return F.transform(
        links,
        lambda x, i: F.struct(F.floor(i / size).cast("long").alias("batch"), x.alias("link")),
    )


def index_to_url(response: Column, links: Column) -> Column:
    """Links a JSON answer picks by 1-based position in the sorted link list.

    The positions are an array: the answer itself, its ``links``, ``selected`` or
    ``indices``, or the first array in it. What is no valid position is dropped.
    """
    arrays = "array<variant>"

    def read(v: Column) -> Column:
        named = [F.try_variant_get(v, p, arrays) for p in ("$", "$.links", "$.selected", "$.indices")]
        members = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
        other = F.filter(
            F.transform(members, lambda x: F.try_variant_get(x, "$", arrays)),
            lambda a: a.isNotNull(),
        )
        return F.coalesce(*named, F.get(other, F.lit(0)), F.array().cast(arrays))

    places = F.transform(
        let(F.try_parse_json(response), read), lambda x: F.try_variant_get(x, "$", "int")
    )
    return let(
        F.sort_array(F.array_distinct(links)),
        lambda ls: F.transform(
            F.filter(places, lambda i: i.isNotNull() & (i >= 1) & (i <= F.size(ls))),
            lambda i: F.get(ls, i - 1),
        ),
    )
