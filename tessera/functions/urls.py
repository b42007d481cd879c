"""Url parts, joins, normal forms and variations as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.text import let, strip

_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, rf"^({_SCHEME}):", 1))


def netloc(url: Column) -> Column:
    """Host with port, as written; empty when the url has none."""
    return F.regexp_extract(url, rf"^(?:{_SCHEME}:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    raw = F.regexp_extract(url, rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*\z", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_domain(url: Column) -> Column:
    """Lowered host with port: the key under which a site is grouped."""
    return F.lower(netloc(url))


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike(r"^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*\z", "")


def _remove_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path, for paths that hold any."""
    parts = F.split(p, "/", -1)
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    ends_in_dots = p.rlike(r"/\.{1,2}\z")
    joined = F.array_join(folded, "/")
    return F.when(
        p.rlike(r"/\.{1,2}(/|\z)"), F.when(ends_in_dots, F.concat(joined, F.lit("/"))).otherwise(joined)
    ).otherwise(p)


def url_join(base: Column, ref: Column) -> Column:
    """Resolve ``ref`` against the absolute url ``base``."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    tail = F.regexp_extract(ref, r"^[^?#]*(.*)\z", 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    return (
        F.when(ref == "", base)
        .when(ref.rlike(rf"^{_SCHEME}:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, _remove_dots(ref_path), tail))
        .when(ref.startswith("?"), F.concat(root, path(base), ref))
        .when(ref.startswith("#"), F.concat(without_fragment(base), ref))
        .otherwise(F.concat(root, _remove_dots(F.concat(folder, ref_path)), tail))
    )


def _percent_encode(part: Column) -> Column:
    """Percent-encode one part; letters, digits and ``_.-~`` stay."""
    encoded = F.url_encode(part)
    for wrong, right in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(wrong), F.lit(right))
    return encoded


def _cut_at_quote(c: Column) -> Column:
    return F.regexp_replace(c, r"(%20)?%22.*\z", "")


def normalize_url(url: Column) -> Column:
    """Drop quotes and trailing commas, cut at an encoded quote, encode plain parts."""
    bare = F.regexp_replace(strip(url), r",+\z", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r'\A"(.*)"\z', "$1"), r"\A'(.*)'\z", "$1")
    bare = F.regexp_replace(strip(bare), r",+\z", "")

    def build(u: Column) -> Column:
        clean_path = let(
            _cut_at_quote(path(u)),
            lambda p: F.when(F.contains(p, F.lit("%")), p).otherwise(
                F.array_join(F.transform(F.split(p, "/", -1), _percent_encode), "/")
            ),
        )
        clean_query = let(
            _cut_at_quote(query(u)),
            lambda q: F.when(F.contains(q, F.lit("%")), q).otherwise(
                F.array_join(
                    F.transform(
                        F.split(q, "&", -1),
                        lambda kv: F.when(
                            F.contains(kv, F.lit("=")),
                            F.concat(
                                _percent_encode(F.regexp_extract(kv, r"(?s)^([^=]*)=", 1)),
                                F.lit("="),
                                _percent_encode(F.regexp_extract(kv, r"(?s)^[^=]*=(.*)\z", 1)),
                            ),
                        ).otherwise(_percent_encode(kv)),
                    ),
                    "&",
                )
            ),
        )
        return F.concat(
            scheme(u),
            F.lit("://"),
            netloc(u),
            clean_path,
            F.when(clean_query != "", F.concat(F.lit("?"), clean_query)).otherwise(F.lit("")),
        )

    return let(bare, build)


def url_variations(url: Column) -> Column:
    """http/https and www/bare forms, https first and then www first."""

    def build(u: Column) -> Column:
        host = F.replace(netloc(u), F.lit("www."), F.lit(""))
        route = F.when(path(u) == "", F.lit("/")).otherwise(path(u))

        def form(prefix: str, h: Column) -> Column:
            return F.regexp_replace(F.concat(F.lit(prefix), h, route), r"/+\z", "")

        original = F.regexp_replace(
            F.concat(scheme(u), F.lit("://"), netloc(u), route), r"/+\z", ""
        )
        forms = F.array(
            form("https://www.", host),
            form("https://", host),
            form("http://www.", host),
            form("http://", host),
            original,
        )
        ranked = F.transform(
            F.array_distinct(forms),
            lambda x, i: F.struct(
                (~x.startswith("https")).alias("plain"),
                (~F.contains(x, F.lit("www."))).alias("bare"),
                i.alias("place"),
                x.alias("url"),
            ),
        )
        return F.transform(F.sort_array(ranked), lambda r: r["url"])

    return let(with_scheme(url), build)
