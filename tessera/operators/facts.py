"""Facts: extraction by rule, checks, merging into one record per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera import schemas
from tessera.functions import facts as X
from tessera.functions.text import contains_any, once, split_words, strip
from tessera.session import staged

# Limits of a fact and of its bundle.
QUOTE_CHARS = 320
FACTS_PER_SECTION = 20
DEFAULT_CONFIDENCE = 0.7
EVIDENCE_PER_FIELD = 20
MERGED_CAPS = {
    "contact.emails": 80, "contact.phones": 80, "contact.locations": 80,
    "offerings.products": 80, "offerings.services": 80,
    "reputation.client_list": 80, "reputation.certifications": 50,
    "reputation.awards": 50, "reputation.partnerships": 50,
}
# Limits of the template filter.
TEMPLATE_ITEMS = 40
TEMPLATE_REPEATS = 5
TEMPLATE_WORDS = 3
SECTIONS = ["identity", "contact", "offerings", "reputation"]

# Which pages are trusted on a company, by words of their path.
PAGE_RANKS = [
    (1, ("sobre", "quem-somos", "institucional", "/empresa")),
    (2, ("/contato", "/footer")),
    (4, ("servico", "serviço", "solucoes")),
]
HOME_RANK, OTHER_RANK = 3, 5

#: An address starts where its run of characters starts, so a long word is read once.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"


def extract_facts(chunks: DataFrame) -> DataFrame:
    """Facts found by rule in each chunk, one row each.

    E-mails, long numbers and urls are contact facts, code-like words offerings,
    and lines with identity or reputation words facts of those sections. The line
    is the quote. ``chunks`` holds (cnpj_basico, chunk_index, chunk_content,
    page_source).
    """
    rows = chunks.select(
        "cnpj_basico",
        "chunk_index",
        "page_source",
        F.posexplode(F.split("chunk_content", "\n")).alias("line_no", "line"),
    )
    line = strip(F.col("line"))
    quote = F.substring(line, 1, QUOTE_CHARS)
    reputation_words = [w for words in X.REPUTATION_KEYWORDS.values() for w in words]

    def found(section: str, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(F.col("line"), F.lit(pattern), F.lit(0)),
            lambda v: F.struct(F.lit(section).alias("section"), v.alias("value")),
        )

    def whole_line(section: str, words: list[str]) -> Column:
        fact = F.struct(F.lit(section).alias("section"), quote.alias("value"))
        return F.when(contains_any(F.lower(line), words), F.array(fact)).otherwise(F.array())

    values = F.concat(
        whole_line("identity", ["cnpj", "ltda", "eireli", "fundada", "desde"]),
        found("contact", MAIL),
        found("contact", r"\d{8,}"),
        found("contact", r"https?://[^\s<>\"']+"),
        found("offerings", r"\b[A-Z]{1,5}-?\d{2,}[A-Z0-9]*\b"),
        whole_line("reputation", reputation_words),
    )
    facts = rows.select(
        "cnpj_basico",
        "chunk_index",
        "page_source",
        "line_no",
        quote.alias("evidence_quote"),
        F.posexplode(values).alias("pos", "fact"),
    )
    return facts.select(
        "cnpj_basico",
        "chunk_index",
        F.struct(F.col("line_no").cast("long").alias("line_no"), "pos").alias("ord"),
        "fact.section",
        "fact.value",
        "evidence_quote",
        F.lit(DEFAULT_CONFIDENCE).alias("confidence"),
        "page_source",
    )


def validate_facts(facts: DataFrame) -> DataFrame:
    """Trimmed facts with value and quote, quote cut to length, confidence in range."""
    return (
        facts.withColumns(
            {
                "value": strip(F.col("value")),
                "evidence_quote": F.substring(strip(F.col("evidence_quote")), 1, QUOTE_CHARS),
                "confidence": F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)),
            }
        )
        .where((F.col("value") != "") & (F.col("evidence_quote") != ""))
        .where(F.col("confidence").between(0.0, 1.0))
    )


def bundle_facts(facts: DataFrame) -> DataFrame:
    """First twenty distinct values of each section of a chunk, case aside."""
    bundle = ["cnpj_basico", "chunk_index", "section"]
    rest = [c for c in facts.columns if c not in bundle]
    unique = (
        facts.groupBy(*bundle, F.lower(strip(F.col("value"))).alias("_key"))
        .agg(F.min_by(F.struct(*rest), F.col("ord")).alias("f"))
        .select(*bundle, "f.*")
    )
    w = Window.partitionBy(*bundle).orderBy("ord")
    return (
        unique.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= FACTS_PER_SECTION)
        .drop("_rn")
    )


def useful_bundles(facts: DataFrame) -> DataFrame:
    """Facts per chunk; a chunk without facts has no row and takes no part."""
    return facts.where(F.col("section").isin(SECTIONS)).groupBy("cnpj_basico", "chunk_index").agg(
        F.count("*").alias("useful_count")
    )


def routed(facts: DataFrame) -> DataFrame:
    """Facts with their target field, stored value and dedupe key."""
    place = F.struct("chunk_index", "ord").alias("place")
    url = F.coalesce(F.get("page_source", F.lit(0)), F.lit(""))
    target = X.routed_fact(F.col("section"), F.col("value"), F.col("evidence_quote"))
    return (
        once(facts, "_to", target)
        .where(F.col("_to").isNotNull() & (F.col("_to.value") != ""))
        .select(
            "cnpj_basico",
            place,
            "_to.field",
            "_to.value",
            "_to.key",
            F.when((F.col("_to.field") == "contact.website_url") & (url == ""), F.col("_to.value"))
            .otherwise(url)
            .alias("url"),
            F.col("evidence_quote").alias("quote"),
            "confidence",
        )
    )


def merge_identity(routes: DataFrame) -> DataFrame:
    """First cnpj, name and year; the shortest description."""
    first = F.col("place")

    def pick(field: str, order: Column) -> Column:
        mine = F.col("field") == f"identity.{field}"
        return F.min_by("value", F.when(mine, order)).alias(field)

    return (
        routes.where(F.col("field").startswith("identity."))
        .groupBy("cnpj_basico")
        .agg(
            pick("company_name", first),
            pick("cnpj", first),
            pick("founding_year", first),
            F.min_by(
                "value",
                F.when(F.col("field") == "identity.description", F.struct(F.length("value"), first)),
            ).alias("description"),
        )
    )


def page_rank(url: Column) -> Column:
    """How far a page is trusted on its company: 1 most, 5 least."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    by_words = F.lit(None).cast("int")
    for rank, words in reversed(PAGE_RANKS):
        by_words = F.when(contains_any(path, words), rank).otherwise(by_words)
    return F.coalesce(by_words, F.when(path.isin("", "/"), HOME_RANK).otherwise(OTHER_RANK))


def supported_values(routes: DataFrame) -> DataFrame:
    """What speaks for each value of each field of a company.

    Returns (cnpj_basico, field, key, value, confidence, chunks, page_rank, place): the
    highest confidence, in how many chunks it was found, the best page it stands on, and
    where it comes first; ``value`` is as written there. Facts are counted per chunk first,
    so a value that a company repeats without end is small before it is moved.
    """
    by_chunk = routes.groupBy("cnpj_basico", "field", "key", F.col("place.chunk_index").alias("chunk_index")).agg(
        F.max("confidence").alias("confidence"),
        F.min(page_rank(F.col("url"))).alias("page_rank"),
        F.min(F.struct("place", "value")).alias("first"),
    )
    return (
        by_chunk.groupBy("cnpj_basico", "field", "key")
        .agg(
            F.max("confidence").alias("confidence"),
            F.count("*").alias("chunks"),
            F.min("page_rank").alias("page_rank"),
            F.min("first").alias("first"),
        )
        .select("cnpj_basico", "field", "key", "first.value", "confidence", "chunks", "page_rank", "first.place")
    )


def best_supported(routes: DataFrame) -> DataFrame:
    """The value of each field that most speaks for: one row per company and field.

    Highest confidence, then most chunks, then the better page, then the first place. It
    stands beside the merge in which the first value wins.
    """
    order = F.struct(-F.col("confidence"), -F.col("chunks"), F.col("page_rank"), F.col("place"))
    values = F.struct("value", "confidence", "chunks", "page_rank")
    best = supported_values(routes).groupBy("cnpj_basico", "field").agg(F.min_by(values, order).alias("b"))
    return best.select("cnpj_basico", "field", "b.*")


def first_values(routes: DataFrame) -> DataFrame:
    """First occurrence of each distinct value of each list field.

    Grouping by value spreads even one huge company over many tasks, and repeats
    are reduced before the shuffle.
    """
    return (
        routes.where(~F.col("field").startswith("identity."))
        .groupBy("cnpj_basico", "field", "key")
        .agg(F.min("place").alias("place"), F.min_by(F.struct("value", "url", "quote"), "place").alias("f"))
        .select("cnpj_basico", "field", "place", "f.*")
    )


def capped_lists(firsts: DataFrame) -> DataFrame:
    """One array per company and list field, in first-seen order, cut at its cap."""
    top = Window.partitionBy("cnpj_basico", "field").orderBy("place")
    cap = F.create_map(*[F.lit(x) for pair in MERGED_CAPS.items() for x in pair])
    widest = max(MERGED_CAPS.values())
    return (
        firsts.where(F.col("field").isin(list(MERGED_CAPS)))
        .withColumn("rn", F.row_number().over(top))
        .where(F.col("rn") <= widest)
        .where(F.col("rn") <= cap[F.col("field")])
        .groupBy("cnpj_basico", "field")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "value"))).alias("vs"))
        .select("cnpj_basico", "field", F.transform("vs", lambda v: v["value"]).alias("items"))
    )


def evidence_rows(routes: DataFrame) -> DataFrame:
    """Up to twenty (url, quote) per company and field, in order.

    Identity fields take every fact; lists take the first of each value.
    """
    rows = routes.where(F.col("field").startswith("identity.")).select(
        "cnpj_basico", "field", "place", "url", "quote"
    ).unionByName(first_values(routes).select("cnpj_basico", "field", "place", "url", "quote"))
    top = Window.partitionBy("cnpj_basico", "field").orderBy("place", "url", "quote")
    return rows.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= EVIDENCE_PER_FIELD)


def evidence_map(routes: DataFrame) -> DataFrame:
    per_field = evidence_rows(routes).groupBy("cnpj_basico", "field").agg(
        F.sort_array(F.collect_list(F.struct("rn", "url", "quote"))).alias("es")
    )
    entries = F.transform("es", lambda e: F.struct(e["url"].alias("url"), e["quote"].alias("quote")))
    return (
        per_field.select("cnpj_basico", F.struct("field", entries.alias("entries")).alias("entry"))
        .groupBy("cnpj_basico")
        .agg(F.map_from_entries(F.collect_list("entry")).alias("evidence_map"))
    )


def merge_facts(facts: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """One merged record per company: identity, contact, offerings, reputation, evidence.

    ``companies`` holds the keys that get a record; without it, those with facts.
    The routed facts are read four times, so they are written once.
    """
    routes = staged(routed(facts), "routes")
    firsts = first_values(routes)
    lists = capped_lists(firsts)
    site = firsts.where(F.col("field") == "contact.website_url").groupBy("cnpj_basico").agg(
        F.min_by("value", "place").alias("website_url")
    )

    def items(field: str) -> Column:
        mine = F.max(F.when(F.col("field") == field, F.col("items")))
        return F.coalesce(mine, F.array().cast("array<string>")).alias(field.split(".")[1])

    wide = lists.groupBy("cnpj_basico").agg(*[items(f) for f in MERGED_CAPS])
    keys = (companies if companies is not None else routes).select("cnpj_basico").distinct()
    joined = (
        keys.join(merge_identity(routes), "cnpj_basico", "left")
        .join(wide, "cnpj_basico", "left")
        .join(site, "cnpj_basico", "left")
        .join(evidence_map(routes), "cnpj_basico", "left")
    )

    def listed(name: str) -> Column:
        return F.coalesce(name, F.array().cast("array<string>")).alias(name)

    return joined.select(
        "cnpj_basico",
        F.struct("company_name", "cnpj", "description", "founding_year").alias("identity"),
        F.struct(listed("emails"), listed("phones"), "website_url", listed("locations")).alias("contact"),
        F.struct(listed("products"), listed("services")).alias("offerings"),
        F.struct(*[listed(n) for n in ("client_list", "certifications", "awards", "partnerships")]).alias(
            "reputation"
        ),
        F.coalesce(
            "evidence_map", F.create_map().cast("map<string,array<struct<url:string,quote:string>>>")
        ).alias("evidence_map"),
    )


def merged_items(merged: str = "") -> Column:
    lists = [
        *[f"contact.{n}" for n in schemas.CONTACT_LISTS],
        "offerings.products",
        "offerings.services",
        *[f"reputation.{n}" for n in schemas.REPUTATION_LISTS],
    ]
    total = F.lit(0)
    for name in lists:
        total = total + F.size(name)
    return total.cast("long")


def bundle_metrics(chunks: DataFrame, facts: DataFrame, merged: DataFrame) -> DataFrame:
    """Per company: chunks, empty share, facts in, items out, size of the record."""
    useful = useful_bundles(facts).groupBy("cnpj_basico").agg(
        F.count("*").alias("useful"), F.sum("useful_count").alias("input_facts")
    )
    total = chunks.groupBy("cnpj_basico").agg(F.count("*").alias("total"))
    record = F.struct("identity", "contact", "offerings", "reputation", "evidence_map")
    out = merged.select(
        "cnpj_basico", merged_items().alias("merged_items"), F.length(F.to_json(record)).cast("long").alias("merged_size")
    )
    zero = F.lit(0).cast("long")
    return (
        total.join(useful, "cnpj_basico", "left")
        .join(out, "cnpj_basico", "left")
        .select(
            "cnpj_basico",
            "total",
            *[F.coalesce(c, zero).alias(c) for c in ("useful", "input_facts", "merged_items", "merged_size")],
        )
        .withColumn("empty", F.col("total") - F.col("useful"))
        .withColumn("empty_rate", F.col("empty") / F.col("total"))
        .withColumn("dedupe_delta", F.greatest(zero, F.col("input_facts") - F.col("merged_items")))
    )


def anti_template(
    items: DataFrame, key: str, order: str, item: str, cap: int = TEMPLATE_ITEMS, repeats: int = TEMPLATE_REPEATS
) -> DataFrame:
    """At most ``cap`` items per list and ``repeats`` that share their first words.

    Both ranks are cut per task before their shuffle.
    """
    head = F.array_join(F.slice(split_words(F.col(item)), 1, TEMPLATE_WORDS), " ")
    by_head = Window.partitionBy(key, "_head").orderBy(order)
    by_list = Window.partitionBy(key).orderBy(order)
    return (
        items.withColumn("_head", head)
        .withColumn("_rn", F.row_number().over(by_head))
        .where(F.col("_rn") <= repeats)
        .withColumn("_rn", F.row_number().over(by_list))
        .where(F.col("_rn") <= cap)
        .drop("_rn", "_head")
    )
