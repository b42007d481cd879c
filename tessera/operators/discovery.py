"""From company to official site: queries, hit filters, matching, stage status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions import urls as U
from tessera.functions.text import let, quote_literal, strip
from tessera.session import staged

# Hosts that are never a company's own site.
BLOCKED_DOMAINS = [
    "econodata.com.br", "cnpj.biz", "cnpja.com", "cnpj.info", "cnpjs.rocks",
    "casadosdados.com.br", "empresascnpj.com", "consultacnpj.com",
    "informecadastral.com.br", "cadastroempresa.com.br", "transparencia.cc",
    "listamais.com.br", "solutudo.com.br", "telelistas.net", "apontador.com.br",
    "guiamais.com.br", "construtora.net.br", "b2bleads.com.br",
    "empresas.serasaexperian.com.br", "jusbrasil.com.br", "jusdados.com",
    "facebook.com", "instagram.com", "linkedin.com", "youtube.com",
    "twitter.com", "x.com", "tiktok.com", "pinterest.com", "threads.net",
    "mercadolivre.com.br", "shopee.com.br", "olx.com.br", "amazon.com.br",
    "magazineluiza.com.br", "americanas.com.br",
    "translate.google.com", "webcache.googleusercontent.com",
]
# Legal suffixes taken off a name, and the words added to a query.
LEGAL_SUFFIXES = [" LTDA", " S.A.", " EIRELI", " ME", " EPP", " S/A"]
QUERY_WORDS = "site oficial"
# Confidence of a match; reasons of a discovery without one.
MATCH_CONFIDENCE = 0.9
NO_SEARCH = "Nenhum resultado Serper encontrado"
NO_HITS = "Nenhum resultado de busca disponível"
ALL_BLOCKED = "Todos os resultados foram filtrados (blacklist)"


def search_host(url: Column) -> Column:
    """Host of a hit without ``www.``, ``m.`` and ``mobile.``, each taken off once."""
    host = U.url_domain(U.with_scheme(url))
    for prefix in ("www", "m", "mobile"):
        host = F.regexp_replace(host, rf"\A{prefix}\.", "")
    return host


def is_blocked(url: Column) -> Column:
    """The host is a listed domain or lies under one; one regex, no join."""
    listed = "|".join(quote_literal(d) for d in BLOCKED_DOMAINS)
    return F.coalesce(search_host(url).rlike(rf"(?:\A|\.)(?:{listed})\z"), F.lit(False))


def blocked_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in BLOCKED_DOMAINS], "domain string")


def drop_blocked(df: DataFrame, url: str, blocked: DataFrame) -> DataFrame:
    """Rows whose host is not under any domain of a table of any size.

    Each distinct host is expanded to its suffixes and matched on equality. The
    hosts found are few or many as the data has it, so the plan picks the join.
    """
    hosts = df.select(search_host(F.col(url)).alias("_host")).distinct()
    parts = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    hit = (
        hosts.select("_host", F.explode(suffixes).alias("domain"))
        .join(blocked.select("domain").distinct(), "domain", "left_semi")
        .select("_host")
        .distinct()
    )
    return df.withColumn("_host", search_host(F.col(url))).join(hit, "_host", "left_anti").drop("_host")


def filter_search_results(hits: DataFrame, key: str = "cnpj_basico", rank: str = "rank") -> DataFrame:
    """First hit per (company, link), without blocked hosts.

    Blocked hits go first: that keeps the result and shrinks the shuffle.
    """
    rest = [c for c in hits.columns if c not in (key, "link")]
    kept = hits.where(~is_blocked(F.col("link")))
    first = F.min_by(F.struct(*rest), F.col(rank))
    return kept.groupBy(key, "link").agg(first.alias("h")).select(key, "link", "h.*")


def strip_legal_suffix(name: Column, whole_word: bool = False) -> Column:
    """Name without legal suffixes.

    By default every occurrence goes, also inside a word (" MERCADO" loses " ME").
    ``whole_word`` leaves longer words alone.
    """
    for suffix in LEGAL_SUFFIXES:
        if whole_word:
            name = F.regexp_replace(name, quote_literal(suffix) + r"(?=\s|\z)", "")
        else:
            name = F.replace(name, F.lit(suffix), F.lit(""))
    return strip(name)


def _given(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def _query(name: Column, city: Column) -> Column:
    return strip(F.concat(name, F.lit(" "), city, F.lit(f" {QUERY_WORDS}")))


def search_queries(
    legal_name: Column, trade_name: Column, city: Column, whole_word: bool = False
) -> Column:
    """Up to two queries: trade name, then the bare legal name when it differs."""

    def build(r: Column) -> Column:
        by_trade = F.when(r["trade"] != "", _query(r["trade"], r["city"]))
        differs = (r["trade"] == "") | (F.upper(r["legal"]) != F.upper(r["trade"]))
        by_legal = F.when((r["legal"] != "") & differs, _query(r["legal"], r["city"]))
        return F.array_compact(F.array(by_trade, by_legal))

    return let(
        F.struct(
            strip_legal_suffix(_given(legal_name), whole_word).alias("legal"),
            _given(trade_name).alias("trade"),
            _given(city).alias("city"),
        ),
        build,
    )


def search_query_single(legal_name: Column, trade_name: Column, city: Column) -> Column:
    """One query by priority: trade name, legal name, city alone, or the bare words."""
    trade, town = _given(trade_name), _given(city)
    legal = strip_legal_suffix(_given(legal_name))
    return (
        F.when(trade != "", _query(trade, town))
        .when(legal != "", _query(legal, town))
        .when(town != "", F.concat(F.lit(f"{QUERY_WORDS} "), town))
        .otherwise(QUERY_WORDS)
    )


def query_key(text: Column, n_results: Column) -> Column:
    """Key under which equal queries share one fetch."""
    return F.md5(F.concat(strip(F.lower(text)), F.lit(":"), n_results.cast("string")))


def union_queries(results: DataFrame, key: str = "cnpj_basico") -> DataFrame:
    """All hits of all queries of a company in order; failed queries give none.

    ``results`` holds (key, query_no, ok, results).
    """
    return results.where("ok").select(
        key, "query_no", F.posexplode("results").alias("rank", "hit")
    ).select(key, "query_no", "rank", "hit.*")


# Letters without their accents.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"


def squash(name: Column) -> Column:
    """Lower letters and digits only, accents taken off."""
    return F.regexp_replace(F.translate(F.lower(name), ACCENTED, PLAIN), "[^a-z0-9]", "")


def domain_label(url: Column) -> Column:
    """First label of the host: the name a company picked for its domain."""
    return F.regexp_extract(search_host(url), r"\A([^.:]+)", 1)


def name_matches_domain(name: Column, url: Column) -> Column:
    """The domain holds the squashed name, is its first word, or begins almost like it."""

    def rules(r: Column) -> Column:
        near = F.levenshtein(F.substring(r["label"], F.lit(1), F.length(r["first"]) + 1), r["first"])
        return (
            ((F.length(r["name"]) >= 2) & F.contains(r["label"], r["name"]))
            | ((F.length(r["first"]) >= 2) & (r["label"] == r["first"]))
            | ((F.length(r["first"]) >= 5) & (near <= 1))
        )

    return let(
        F.struct(
            squash(name).alias("name"),
            squash(F.get(F.split(strip(name), r"\s+"), F.lit(0))).alias("first"),
            F.regexp_replace(domain_label(url), "[^a-z0-9]", "").alias("label"),
        ),
        rules,
    )


def match_site(hits: DataFrame, key: str = "cnpj_basico", name: str = "name") -> DataFrame:
    """Best-ranked hit of each company whose domain matches its name."""
    found = hits.where(name_matches_domain(F.col(name), F.col("link")))
    return found.groupBy(key).agg(F.min_by("link", "rank").alias("website_url"))


def discovery_rows(
    requests: DataFrame, searches: DataFrame, hits: DataFrame, matches: DataFrame, key: str = "cnpj_basico"
) -> DataFrame:
    """One status row per request, with the reason when a stage before it gave nothing.

    ``searches`` holds (key, results_count), ``hits`` the filtered hits and
    ``matches`` (key, website_url).
    """
    left_hits = hits.groupBy(key).agg(F.count("*").alias("n_hits"))
    joined = requests.join(searches, key, "left").join(left_hits, key, "left").join(matches, key, "left")
    found = F.col("website_url").isNotNull()
    reason = (
        F.when(F.col("results_count").isNull(), NO_SEARCH)
        .when(F.col("results_count") == 0, NO_HITS)
        .when(F.coalesce("n_hits", F.lit(0)) == 0, ALL_BLOCKED)
    )
    return joined.select(
        key,
        "website_url",
        F.when(found, "found").otherwise("not_found").alias("discovery_status"),
        F.when(found, F.lit(MATCH_CONFIDENCE)).alias("confidence_score"),
        F.when(~found, reason).alias("llm_reasoning"),
    )


def discovery_answer(response: Column) -> Column:
    """Site named by a JSON answer, only when it is called official."""
    fenced = F.coalesce(
        F.when(F.contains(response, F.lit("```json")), F.regexp_extract(response, r"(?s)```json(.*?)(?:```|\z)", 1)),
        F.when(F.contains(response, F.lit("```")), F.regexp_extract(response, r"(?s)```(.*?)(?:```|\z)", 1)),
        response,
    )

    def read(v: Column) -> Column:
        first = F.coalesce(F.get(F.try_variant_get(v, "$", "array<variant>"), F.lit(0)), v)
        site = F.try_variant_get(first, "$.site", "string")
        official = F.try_variant_get(first, "$.site_oficial", "string") == "sim"
        return F.when(official & (site != "") & (site != "nao_encontrado"), site)

    return let(F.try_parse_json(strip(fenced)), read)


def retry_after(header: Column, as_of: float, cap: float = 60.0) -> Column:
    """Seconds to wait from a header: a number or an HTTP date, capped; null if none.

    ``as_of`` is the time of the answer in epoch seconds.
    """
    value = strip(header)
    moment = F.try_to_timestamp(
        F.concat(F.regexp_extract(value, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit(" GMT")),
        F.lit("d MMM yyyy HH:mm:ss z"),
    )
    wait = F.coalesce(value.try_cast("double"), F.unix_micros(moment) / 1e6 - as_of)
    return F.when(wait > 0, F.least(wait, F.lit(cap)))


def best_url(probes: DataFrame) -> DataFrame:
    """Per base url the reachable variation: no redirect first, then the fastest."""
    usable = probes.where(F.col("status") < 400)
    order = F.struct((F.col("status") >= 300).alias("redirects"), "time_ms", "url")
    return usable.groupBy("base_url").agg(
        F.min_by(F.struct("url", "time_ms", "status"), order).alias("b")
    ).select("base_url", "b.*")


def best_error(errors: DataFrame, priority: Column) -> DataFrame:
    """Per base url the most informative error; earlier ones win among equals."""
    return errors.groupBy("base_url").agg(
        F.min_by(F.struct("error_class", "message"), F.struct(priority.alias("p"), "ord")).alias("e")
    ).select("base_url", "e.*")


def retry_failed(rows: DataFrame, key: str, first, second) -> DataFrame:
    """Two passes: all rows, then only the failures with other parameters.

    ``first`` and ``second`` map rows to (key, content, ok). Rows that fail twice
    come back with empty content. The first pass is written once, so a row that answers
    differently when fetched again is neither lost nor doubled.
    """
    done = staged(first(rows).where("ok").select(key, "content", F.lit(1).alias("attempt")), "first-pass")
    failed = rows.join(done.select(key), key, "left_anti")
    again = second(failed).where("ok").select(key, "content", F.lit(2).alias("attempt"))
    return rows.select(key).join(done.unionByName(again), key, "left").select(
        key, F.coalesce("content", F.lit("")).alias("content"), F.coalesce("attempt", F.lit(0)).alias("attempt")
    )
