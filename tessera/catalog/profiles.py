"""Profiles over documents, customers and parts; model answers over conversations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera import schemas as S
from tessera.catalog.facts import good_facts, sql_strip, SQL_ROUTES
from tessera.catalog.registry import Tables, query
from tessera.catalog.text import SQL_WS, loop_sql
from tessera.catalog.web import page_links, sql_links
from tessera.functions import answers as N, profile as V
from tessera.functions.text import split_words
from tessera.operators import facts as O, models as M, profiles as P
from tessera.plans.company_profile import profiles_from_chunks
from tessera.sources import decode as D


def profile_of(**given: Column) -> Column:
    """A profile struct with the given paths (dots as two underscores) set."""

    # Cast one by one: a cast of the whole struct would build all fields for whoever reads one.
    def value(path: str, kind: str) -> Column:
        empty = F.array() if kind.startswith("array") else F.lit(None)
        own = given.get(path.replace(".", "__"))
        # Given records have their type: a cast of them would build all their fields for whoever reads one.
        kept = own is not None and kind.startswith("array<struct")
        return (own if kept else (empty if own is None else own).cast(kind)).alias(path.split(".")[-1])

    def texts(section: str, names: list[str]) -> list[Column]:
        return [value(f"{section}.{n}", "string") for n in names]

    def lists(section: str, names: list[str], kind: str = "array<string>") -> list[Column]:
        return [value(f"{section}.{n}", kind) for n in names]

    return F.struct(
        F.struct(*texts("identity", S.IDENTITY)).alias("identity"),
        F.struct(*texts("classification", S.CLASSIFICATION)).alias("classification"),
        F.struct(*texts("team", ["size_range"]), *lists("team", S.TEAM_LISTS)).alias("team"),
        F.struct(
            *lists("offerings", S.OFFERING_LISTS),
            *lists("offerings", ["product_categories"], f"array<{S.CATEGORY}>"),
            *lists("offerings", ["service_details"], f"array<{S.SERVICE}>"),
        ).alias("offerings"),
        F.struct(
            *lists("reputation", S.REPUTATION_LISTS), *lists("reputation", ["case_studies"], f"array<{S.CASE}>")
        ).alias("reputation"),
        F.struct(*lists("contact", S.CONTACT_LISTS), *texts("contact", S.CONTACT_TEXT)).alias("contact"),
        value("sources", "array<string>"),
    )


# Each document gives one partial profile of its source. The parts are plain SQL
# that both engines read; the check SQL uses the same texts.
PARTS = {
    "company_name": "CASE doc_id % 3 WHEN 0 THEN concat('Company ', source, repeat('x', CAST(doc_id % 5 AS INT))) END",
    "tagline": "concat(lang, ' ', length(text) % 7)",
    "description": "concat(lang, ' ', length(text), ' ', md5(text))",
    "founding_year": "CAST(1950 + doc_id % 70 AS STRING)",
    "staff": "concat(doc_id % 50, '-', doc_id % 50 + 40)",
    "business_model": "CASE WHEN doc_id % 2 = 0 THEN 'B2B' END",
    "geo": "repeat('g', CAST(doc_id % 9 AS INT))",
    "category": "CASE doc_id % 6 WHEN 0 THEN ' Geral ' ELSE concat('Cat ', doc_id % 4) END",
}


SERVICE_DESCRIPTION = "concat(md5(text), ' ', lang, ' ', length(text) % 5)"


def partial_profiles(t: Tables):
    e = {k: F.expr(v) for k, v in PARTS.items()}
    docs = t.documents.withColumn("w", split_words(F.col("text")))
    word = F.col("w")

    def one(text: str) -> Column:
        return F.expr(f"array({text})")

    service = F.struct(
        F.expr("concat('svc ', doc_id % 5)").alias("name"),
        F.expr(SERVICE_DESCRIPTION).alias("description"),
        F.col("lang").alias("methodology"),
        word.alias("deliverables"),
        F.expr("concat('ideal ', doc_id % 11)").alias("ideal_client_profile"),
    )
    case = F.struct(
        F.expr("concat('case ', doc_id % 4)").alias("title"),
        F.col("lang").alias("client_name"),
        F.lit(None).cast("string").alias("industry"),
        F.col("text").alias("challenge"),
        F.lit("").alias("solution"),
        F.expr("concat('o', doc_id % 13)").alias("outcome"),
    )
    profile = profile_of(
        identity__company_name=e["company_name"],
        identity__tagline=e["tagline"],
        identity__description=e["description"],
        identity__founding_year=e["founding_year"],
        identity__employee_count_range=e["staff"],
        classification__industry=F.col("lang"),
        classification__business_model=e["business_model"],
        classification__geographic_coverage=e["geo"],
        team__key_roles=one("concat('role ', doc_id % 5)"),
        offerings__products=word,
        offerings__services=one("concat('s', doc_id % 30), concat(' s', doc_id % 7)"),
        offerings__key_differentiators=one("lang"),
        offerings__product_categories=F.array(
            F.struct(e["category"].alias("category_name"), word.alias("items"))
        ),
        offerings__service_details=F.array(service),
        reputation__certifications=one("concat('ISO ', doc_id % 40)"),
        reputation__partnerships=one("concat('P', doc_id % 60)"),
        reputation__client_list=one("concat('C', doc_id % 100), ' '"),
        reputation__case_studies=F.array(case),
        contact__emails=one("concat('m', doc_id % 12, '@e.example.com')"),
        contact__locations=one("concat('Loc ', doc_id % 30)"),
        contact__website_url=F.expr("concat('https://', source, '.example.com')"),
        sources=one("concat('https://d', doc_id % 500, '.example.com')"),
    )
    return docs.select(F.col("source").alias("cnpj_basico"), F.col("doc_id").alias("ord"), profile.alias("profile"))


def _len(c: str) -> str:
    return f"coalesce(length({c}), 0) // 10"


SQL_PARTIALS = f"""
docs AS (SELECT doc_id, source, lang, text, list_filter(regexp_split_to_array(text, '{SQL_WS}+'), lambda w: w <> '') AS w,
  {", ".join(f"{v} AS {k}" for k, v in PARTS.items())} FROM documents),
scored AS (SELECT *, {_len('company_name')} + {_len('tagline')} + {_len('description')} + {_len('founding_year')} + {_len('staff')}
   + {_len('lang')} + {_len('business_model')} + {_len('geo')} + {_len("'https://' || source || '.example.com'")}
   + 1 + len(w) + 2 + 1 + 1 + 1 + 1 + 1 + 2 + 1 + 1 + 1 + 1 AS score FROM docs),
based AS (SELECT *, first_value(doc_id) OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS base_ord,
   count(*) OVER (PARTITION BY source) AS n FROM scored),
turned AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id <> base_ord, doc_id) AS turn FROM based)
"""


@query("completeness_score", f"WITH {SQL_PARTIALS} SELECT source AS cnpj_basico, doc_id AS ord, CAST(score AS BIGINT) AS score FROM scored")
def completeness_score(t: Tables):
    return partial_profiles(t).select("cnpj_basico", "ord", V.completeness_score("profile").alias("score"))


def _longest_sql(c: str) -> str:
    return f"coalesce(arg_min({c}, -length({c}) * 100000 + turn) FILTER ({c} <> ''), '')"


@query(
    "merge_scalars",
    f"""WITH {SQL_PARTIALS} SELECT source AS cnpj_basico, {_longest_sql('company_name')} AS company_name, {_longest_sql('founding_year')} AS founding_year,
      {_longest_sql('staff')} AS staff, {_longest_sql('lang')} AS industry, {_longest_sql('business_model')} AS business_model, {_longest_sql('geo')} AS geo,
      arg_min('role ' || doc_id % 5, turn) AS roles, arg_min('m' || doc_id % 12 || '@e.example.com', turn) AS emails FROM turned GROUP BY source""",
)
def merge_scalars(t: Tables):
    m = P.merge_scalars(P.ranked_profiles(partial_profiles(t)))

    def text(c: str, name: str) -> Column:
        return F.coalesce(c, F.lit("")).alias(name)

    return m.select(
        "cnpj_basico",
        text("identity__company_name", "company_name"),
        text("identity__founding_year", "founding_year"),
        text("identity__employee_count_range", "staff"),
        text("classification__industry", "industry"),
        text("classification__business_model", "business_model"),
        text("classification__geographic_coverage", "geo"),
        F.array_join("team__key_roles", ",").alias("roles"),
        F.array_join("contact__emails", ",").alias("emails"),
    )


# The fold of the joined texts as a recursive walk in merge order.
SQL_FOLD = f"""
src AS (SELECT source, turn, 'description' AS field, '' AS item, description AS v FROM turned
  UNION ALL SELECT source, turn, 'tagline', '', tagline FROM turned
  UNION ALL SELECT source, turn, 'service_description', 'svc ' || doc_id % 5, {SERVICE_DESCRIPTION} FROM turned
  UNION ALL SELECT source, turn, 'service_methodology', 'svc ' || doc_id % 5, lang FROM turned),
num AS (SELECT *, row_number() OVER (PARTITION BY source, field, item ORDER BY turn) AS rn FROM src WHERE v <> ''),
fold AS (
  SELECT source, field, item, rn, v AS cur FROM num WHERE rn = 1
  UNION ALL
  SELECT source, field, item, rn, CASE WHEN x <> '' AND y <> '' AND NOT contains(x, y) AND NOT contains(y, x)
      AND len(list_intersect(wx, wy)) / greatest(len(wx), len(wy)) < 0.3::DOUBLE THEN {sql_strip('cur')} || '. ' || {sql_strip('v')}
      WHEN length(v) > length(cur) THEN v ELSE cur END
  FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(x, '{SQL_WS}+'), lambda w: w <> '')) AS wx,
          list_distinct(list_filter(regexp_split_to_array(y, '{SQL_WS}+'), lambda w: w <> '')) AS wy
        FROM (SELECT n.source, n.field, n.item, n.rn, n.v, f.cur, lower({sql_strip('f.cur')}) AS x, lower({sql_strip('n.v')}) AS y
              FROM fold f JOIN num n ON n.source = f.source AND n.field = f.field AND n.item = f.item AND n.rn = f.rn + 1))),
joined AS (SELECT source, field, item, arg_max(cur, rn) AS value FROM fold GROUP BY ALL)
"""


@query(
    "merge_texts",
    f"WITH RECURSIVE {SQL_PARTIALS}, {SQL_FOLD} SELECT source AS cnpj_basico, field, item, value FROM joined",
)
def merge_texts(t: Tables):
    return P.joined_texts(P.ranked_profiles(partial_profiles(t)))


SQL_UNION = f"""
vals AS (SELECT source, turn, 'offerings.products' AS field, unnest(w) AS value, unnest(range(len(w))) AS pos FROM turned
  UNION ALL SELECT source, turn, 'offerings.services', unnest(['s' || doc_id % 30, 's' || doc_id % 7]), unnest([0, 1]) FROM turned
  UNION ALL SELECT source, turn, 'offerings.key_differentiators', lang, 0 FROM turned
  UNION ALL SELECT source, turn, 'reputation.certifications', 'ISO ' || doc_id % 40, 0 FROM turned
  UNION ALL SELECT source, turn, 'reputation.partnerships', 'P' || doc_id % 60, 0 FROM turned
  UNION ALL SELECT source, turn, 'reputation.client_list', 'C' || doc_id % 100, 0 FROM turned),
seen AS (SELECT source, field, value, min(turn * 10000000 + pos) AS place FROM vals GROUP BY ALL),
listed AS (SELECT source AS cnpj_basico, field, value, row_number() OVER (PARTITION BY source, field ORDER BY place) AS pos FROM seen)
"""


@query("merge_lists", f"WITH {SQL_PARTIALS}, {SQL_UNION} SELECT cnpj_basico, field, CAST(pos AS BIGINT) AS pos, value FROM listed")
def merge_lists(t: Tables):
    lists = P.merge_lists(P.ranked_profiles(partial_profiles(t)))
    return lists.select("cnpj_basico", "field", F.posexplode("items").alias("p", "value")).select(
        "cnpj_basico", "field", (F.col("p") + 1).cast("long").alias("pos"), "value"
    )


@query(
    "merge_keyed_structs",
    f"""WITH RECURSIVE {SQL_PARTIALS}, {SQL_FOLD},
    c AS (SELECT source, turn, category, w FROM turned WHERE lower(trim(category)) <> 'geral'),
    cf AS (SELECT source, category, row_number() OVER (PARTITION BY source ORDER BY min(turn)) AS rn FROM c GROUP BY source, category),
    sv AS (SELECT source, turn, 'svc ' || doc_id % 5 AS name, 'ideal ' || doc_id % 11 AS ideal, w FROM turned),
    sf AS (SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY min(turn)) AS rn, {_longest_sql('ideal')} AS ideal FROM sv GROUP BY source, name),
    k AS (SELECT source, turn, 'case ' || doc_id % 4 AS title, lang, text AS challenge, 'o' || doc_id % 13 AS outcome FROM turned),
    kf AS (SELECT source, title, row_number() OVER (PARTITION BY source ORDER BY min(turn)) AS rn, {_longest_sql('lang')} AS client,
      {_longest_sql('challenge')} AS challenge, {_longest_sql('outcome')} AS outcome FROM k GROUP BY source, title),
    l AS (SELECT source, 'category' AS kind, category AS name, turn, w FROM c UNION ALL SELECT source, 'service', name, turn, w FROM sv),
    iv AS (SELECT source, kind, name, value, min(turn * 10000000 + pos) AS place FROM (SELECT source, kind, name, turn, unnest(w) AS value, unnest(range(len(w))) AS pos FROM l) GROUP BY ALL),
    ci AS (SELECT source, kind, name, string_agg(value, '|' ORDER BY place) AS items FROM iv GROUP BY source, kind, name)
    SELECT cf.source AS cnpj_basico, 'category' AS kind, CAST(cf.rn AS BIGINT) AS pos, cf.category AS name, coalesce(ci.items, '') AS items,
      '' AS description, '' AS methodology, '' AS ideal_client_profile, '' AS client_name, '' AS industry, '' AS challenge, '' AS solution, '' AS outcome
    FROM cf LEFT JOIN ci ON ci.source = cf.source AND ci.name = cf.category AND ci.kind = 'category'
    UNION ALL SELECT sf.source, 'service', CAST(sf.rn AS BIGINT), sf.name, coalesce(ci.items, ''), coalesce(d.value, ''), coalesce(m.value, ''), sf.ideal, '', '', '', '', ''
    FROM sf LEFT JOIN ci ON ci.source = sf.source AND ci.name = sf.name AND ci.kind = 'service'
      LEFT JOIN joined d ON d.source = sf.source AND d.item = sf.name AND d.field = 'service_description'
      LEFT JOIN joined m ON m.source = sf.source AND m.item = sf.name AND m.field = 'service_methodology'
    UNION ALL SELECT source, 'case', CAST(rn AS BIGINT), title, '', '', '', '', client, '', challenge, '', outcome FROM kf""",
)
def merge_keyed_structs(t: Tables):
    merged = P.merge_keyed_structs(P.ranked_profiles(partial_profiles(t)))

    def rows(kind: str, column: str, name: str, items: Column | None, given: list[str]):
        record = F.posexplode(column).alias("p", "r")

        def text(field: str) -> Column:
            return (F.coalesce(f"r.{field}", F.lit("")) if field in given else F.lit("")).alias(field)

        texts = ["description", "methodology", "ideal_client_profile", "client_name", "industry", "challenge", "solution", "outcome"]
        return merged.select("cnpj_basico", record).select(
            "cnpj_basico",
            F.lit(kind).alias("kind"),
            (F.col("p") + 1).cast("long").alias("pos"),
            F.col(f"r.{name}").alias("name"),
            (F.lit("") if items is None else F.array_join(items, "|")).alias("items"),
            *[text(f) for f in texts],
        )

    services = ["description", "methodology", "ideal_client_profile"]
    return (
        rows("category", "product_categories", "category_name", F.col("r.items"), [])
        .unionByName(rows("service", "service_details", "name", F.col("r.deliverables"), services))
        .unionByName(rows("case", "case_studies", "title", None, S.CASE_FIELDS))
    )


@query(
    "merge_cases",
    f"""WITH {SQL_PARTIALS}, c AS (SELECT source, turn, 'case ' || doc_id % 4 AS title, lang, text AS challenge, 'o' || doc_id % 13 AS outcome FROM turned)
    SELECT source AS cnpj_basico, title, {_longest_sql('lang')} AS client_name, {_longest_sql('challenge')} AS challenge, {_longest_sql('outcome')} AS outcome FROM c GROUP BY source, title""",
)
def merge_cases(t: Tables):
    merged = P.merge_cases(P.ranked_profiles(partial_profiles(t)))
    return merged.select("cnpj_basico", F.inline("case_studies")).select(
        "cnpj_basico", "title", "client_name", "challenge", "outcome"
    )


@query(
    "merge_services",
    f"""WITH RECURSIVE {SQL_PARTIALS}, {SQL_FOLD},
    sv AS (SELECT source, turn, 'svc ' || doc_id % 5 AS name, 'ideal ' || doc_id % 11 AS ideal, w FROM turned),
    sf AS (SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY min(turn)) AS rn, {_longest_sql('ideal')} AS ideal_client_profile FROM sv GROUP BY source, name),
    dv AS (SELECT source, name, value, min(turn * 10000000 + pos) AS place FROM (SELECT source, name, turn, unnest(w) AS value, unnest(range(len(w))) AS pos FROM sv) GROUP BY ALL),
    dr AS (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY place) AS rn FROM dv),
    dl AS (SELECT source, name, string_agg(value, '|' ORDER BY rn) AS deliverables FROM dr GROUP BY source, name)
    SELECT sf.source AS cnpj_basico, sf.name, d.value AS description, m.value AS methodology, coalesce(deliverables, '') AS deliverables, ideal_client_profile
    FROM sf LEFT JOIN dl ON dl.source = sf.source AND dl.name = sf.name
      LEFT JOIN joined d ON d.source = sf.source AND d.item = sf.name AND d.field = 'service_description'
      LEFT JOIN joined m ON m.source = sf.source AND m.item = sf.name AND m.field = 'service_methodology'""",
)
def merge_services(t: Tables):
    ranked = P.ranked_profiles(partial_profiles(t))
    merged = P.merge_services(ranked, P.joined_texts(ranked))
    return merged.select("cnpj_basico", F.inline("service_details")).withColumn(
        "deliverables", F.array_join("deliverables", "|")
    )


@query(
    "merge_sources",
    f"""WITH {SQL_PARTIALS} SELECT source AS cnpj_basico, 'https://d' || doc_id % 500 || '.example.com' AS source, CAST(arg_min(doc_id, turn) AS BIGINT) AS first_ord
    FROM turned GROUP BY ALL""",
)
def merge_sources(t: Tables):
    rows = P.merge_sources(P.ranked_profiles(partial_profiles(t)))
    return rows.select("cnpj_basico", "source", F.col("place.turn.ord").alias("first_ord"))


def merged_sql(partials: str) -> str:
    """The whole merged profile: every text, list and record that the partials hold."""

    def listed(field: str, name: str) -> str:
        return f"coalesce((SELECT string_agg(value, '|' ORDER BY pos) FROM listed l WHERE l.field = '{field}' AND l.cnpj_basico = source), '') AS {name}"

    def joined(field: str) -> str:
        return f"coalesce((SELECT value FROM joined j WHERE j.source = t.source AND j.field = '{field}' AND j.item = ''), '') AS {field}"

    return f"""WITH RECURSIVE {partials}, {SQL_FOLD}, {SQL_UNION},
    cc AS (SELECT source, turn, category, w FROM turned WHERE lower(trim(category)) <> 'geral'),
    cplace AS (SELECT source, category, min(turn) AS place FROM cc GROUP BY ALL),
    citem AS (SELECT source, category, value, min(turn * 10000000 + pos) AS place FROM (SELECT source, category, turn, unnest(w) AS value, unnest(range(len(w))) AS pos FROM cc) GROUP BY ALL),
    cat AS (SELECT p.source, p.category, p.place, coalesce(string_agg(i.value, '|' ORDER BY i.place), '') AS items FROM cplace p LEFT JOIN citem i USING (source, category) GROUP BY ALL),
    cats AS (SELECT source, md5(string_agg(category || '=' || items, ';' ORDER BY place)) AS digest FROM cat GROUP BY source),
    ss AS (SELECT source, turn, 'svc ' || doc_id % 5 AS name, 'ideal ' || doc_id % 11 AS ideal, w FROM turned),
    sitem AS (SELECT source, name, value, min(turn * 10000000 + pos) AS place FROM (SELECT source, name, turn, unnest(w) AS value, unnest(range(len(w))) AS pos FROM ss) GROUP BY ALL),
    slist AS (SELECT source, name, string_agg(value, '|' ORDER BY place) AS items FROM sitem GROUP BY ALL),
    sone AS (SELECT source, name, min(turn) AS place, {_longest_sql('ideal')} AS ideal FROM ss GROUP BY source, name),
    svc AS (SELECT o.source, o.name, o.place, o.ideal, coalesce(l.items, '') AS items, d.value AS description, m.value AS methodology FROM sone o
      LEFT JOIN slist l ON l.source = o.source AND l.name = o.name
      LEFT JOIN joined d ON d.source = o.source AND d.item = o.name AND d.field = 'service_description'
      LEFT JOIN joined m ON m.source = o.source AND m.item = o.name AND m.field = 'service_methodology'),
    svcs AS (SELECT source, md5(string_agg(concat_ws('=', name, description, methodology, items, ideal), ';' ORDER BY place)) AS digest FROM svc GROUP BY source),
    kk AS (SELECT source, turn, 'case ' || doc_id % 4 AS title, lang, text AS challenge, 'o' || doc_id % 13 AS outcome FROM turned),
    kone AS (SELECT source, title, min(turn) AS place, {_longest_sql('lang')} AS client, {_longest_sql('challenge')} AS challenge, {_longest_sql('outcome')} AS outcome FROM kk GROUP BY source, title),
    cases AS (SELECT source, md5(string_agg(concat_ws('=', title, client, challenge, outcome), ';' ORDER BY place)) AS digest FROM kone GROUP BY source),
    place AS (SELECT source, 'https://d' || doc_id % 500 || '.example.com' AS url, min(turn) AS place FROM turned GROUP BY ALL),
    urls AS (SELECT source, string_agg(url, '|' ORDER BY place) AS sources FROM place GROUP BY source)
    SELECT source AS cnpj_basico, {_longest_sql('company_name')} AS company_name, {joined('tagline')}, {joined('description')},
      {_longest_sql('founding_year')} AS founding_year, {_longest_sql('staff')} AS staff, {_longest_sql('lang')} AS industry,
      {_longest_sql('business_model')} AS business_model, {_longest_sql('geo')} AS geo,
      arg_min('role ' || doc_id % 5, turn) AS roles, arg_min('m' || doc_id % 12 || '@e.example.com', turn) AS emails, arg_min('Loc ' || doc_id % 30, turn) AS locations,
      'https://' || source || '.example.com' AS website,
      {listed('offerings.products', 'products')}, {listed('offerings.services', 'services')}, {listed('offerings.key_differentiators', 'differentiators')},
      {listed('reputation.certifications', 'certifications')}, {listed('reputation.partnerships', 'partnerships')}, {listed('reputation.client_list', 'clients')},
      (SELECT digest FROM cats c WHERE c.source = t.source) AS categories, (SELECT digest FROM svcs s WHERE s.source = t.source) AS service_details,
      (SELECT digest FROM cases k WHERE k.source = t.source) AS cases, (SELECT sources FROM urls u WHERE u.source = t.source) AS sources
    FROM turned t GROUP BY source"""


def merged_whole(merged):
    """Every part of a merged profile that the partials hold, lists joined and records digested."""

    def text(path: str, name: str) -> Column:
        return F.coalesce(F.col(f"profile.{path}"), F.lit("")).alias(name)

    def listed(path: str, name: str) -> Column:
        return F.array_join(f"profile.{path}", "|").alias(name)

    def records(path: str, show, name: str) -> Column:
        return F.md5(F.array_join(F.transform(f"profile.{path}", show), ";")).alias(name)

    return merged.select(
        "cnpj_basico",
        text("identity.company_name", "company_name"),
        text("identity.tagline", "tagline"),
        text("identity.description", "description"),
        text("identity.founding_year", "founding_year"),
        text("identity.employee_count_range", "staff"),
        text("classification.industry", "industry"),
        text("classification.business_model", "business_model"),
        text("classification.geographic_coverage", "geo"),
        listed("team.key_roles", "roles"),
        listed("contact.emails", "emails"),
        listed("contact.locations", "locations"),
        text("contact.website_url", "website"),
        listed("offerings.products", "products"),
        listed("offerings.services", "services"),
        listed("offerings.key_differentiators", "differentiators"),
        listed("reputation.certifications", "certifications"),
        listed("reputation.partnerships", "partnerships"),
        listed("reputation.client_list", "clients"),
        records("offerings.product_categories", lambda c: F.concat_ws("=", c["category_name"], F.array_join(c["items"], "|")), "categories"),
        records(
            "offerings.service_details",
            lambda x: F.concat_ws("=", x["name"], x["description"], x["methodology"], F.array_join(x["deliverables"], "|"), x["ideal_client_profile"]),
            "service_details",
        ),
        records(
            "reputation.case_studies",
            lambda k: F.concat_ws("=", k["title"], k["client_name"], k["challenge"], k["outcome"]),
            "cases",
        ),
        listed("sources", "sources"),
    )


@query("merge_profiles", merged_sql(SQL_PARTIALS))
def merge_profiles(t: Tables):
    return merged_whole(P.merge_profiles(partial_profiles(t)))


SQL_TOLD = SQL_PARTIALS.replace(
    "FROM documents)", "FROM documents WHERE company_name IS NOT NULL OR business_model IS NOT NULL)"
)


@query("multi_chunk_profile", merged_sql(SQL_TOLD))
def multi_chunk_profile(t: Tables):
    # A chunk whose answer names neither the company nor its model counts as failed.
    told = F.col("profile.identity.company_name").isNotNull() | F.col("profile.classification.business_model").isNotNull()
    partials = partial_profiles(t).withColumn("profile", F.when(told, F.col("profile")))
    return merged_whole(M.multi_chunk_profile(partials))


@query(
    "clean_profile",
    f"""WITH {SQL_PARTIALS} SELECT doc_id AS ord, CASE WHEN lower(trim(category)) = 'geral' THEN '' ELSE md5(category || '=' || array_to_string(w, '|')) END AS categories,
      'C' || doc_id % 100 AS clients, md5(concat_ws('=', 'case ' || doc_id % 4, lang, text, '', 'o' || doc_id % 13)) AS cases, md5(array_to_string(w, '|')) AS products,
      md5(concat_ws('=', 'svc ' || doc_id % 5, array_to_string(w, '|'))) AS service_details FROM docs""",
)
def clean_profile(t: Tables):
    cleaned = partial_profiles(t).select("ord", P.clean_profile(F.col("profile")).alias("p"))

    def digest(path: str, show) -> Column:
        shown = F.array_join(F.transform(path, show), ";")
        return F.when(F.size(path) > 0, F.md5(shown)).otherwise("")

    return cleaned.select(
        "ord",
        digest("p.offerings.product_categories", lambda c: F.concat_ws("=", c["category_name"], F.array_join(c["items"], "|"))).alias("categories"),
        F.array_join("p.reputation.client_list", "|").alias("clients"),
        digest("p.reputation.case_studies", lambda c: F.concat_ws("=", c["title"], c["client_name"], c["challenge"], c["solution"], c["outcome"])).alias("cases"),
        F.md5(F.array_join("p.offerings.products", "|")).alias("products"),
        digest("p.offerings.service_details", lambda c: F.concat_ws("=", c["name"], F.array_join(c["deliverables"], "|"))).alias("service_details"),
    )


@query(
    "list_union",
    """SELECT doc_id, array_to_string(list_distinct_sorted, '|') AS items FROM (SELECT doc_id, list_sort(list_distinct(list_concat(string_split(a, chr(10)), string_split(b, chr(10))))) AS list_distinct_sorted
      FROM (SELECT x.doc_id, x.text AS a, y.text AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1))""",
)
def list_union(t: Tables):
    docs = t.documents.select("doc_id", F.split("text", "\n").alias("a"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    both = docs.join(after, "doc_id")
    return both.select("doc_id", F.array_join(F.sort_array(F.array_union("a", "b")), "|").alias("items"))


# Parts and customers as small profiles with gaps.
GAPPY = {
    "identity__company_name": "CASE WHEN c_custkey % 2 = 0 THEN c_name END",
    "identity__tagline": "CASE WHEN c_custkey % 3 = 0 THEN 'We sell' END",
    "classification__industry": "CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END",
    "contact__website_url": "CASE WHEN c_custkey % 7 = 0 THEN 'https://c.example.com' END",
}


def gappy_profiles(t: Tables):
    given = {k: F.expr(v) for k, v in GAPPY.items()}
    many = F.expr("transform(sequence(1, CAST(c_custkey % 12 AS INT) + 1), i -> concat('m', i))")
    some = F.when(F.col("c_custkey") % 11 == 0, many).otherwise(F.array().cast("array<string>"))
    long_list = F.expr("transform(sequence(1, CAST(c_custkey % 30 AS INT) + 45), i -> concat('p', i))")
    evidence = F.map_from_arrays(
        F.array(F.lit("identity.company_name"), F.lit("contact.emails")), F.array(F.lit(1), F.lit(2))
    )
    return t.customer.select(
        "c_custkey",
        profile_of(**given, contact__emails=some, offerings__products=F.when(F.col("c_custkey") % 13 == 0, long_list).otherwise(F.array().cast("array<string>"))).alias("profile"),
        evidence.alias("evidence_map"),
    )


SQL_GAPPY = f"""
g AS (SELECT c_custkey AS k, {", ".join(f"({v}) IS NOT NULL AS {n.split('__')[1]}" for n, v in GAPPY.items())},
  c_custkey % 11 = 0 AS emails, CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 12 + 1 ELSE 0 END AS n_emails,
  c_custkey % 13 = 0 AS products, CASE WHEN c_custkey % 13 = 0 THEN c_custkey % 30 + 45 ELSE 0 END AS n_products FROM customer)
"""


@query(
    "profile_is_empty",
    f"WITH {SQL_GAPPY} SELECT k AS c_custkey, NOT (company_name OR tagline OR industry OR website_url OR emails OR products) AS is_empty FROM g",
)
def profile_is_empty(t: Tables):
    return gappy_profiles(t).select("c_custkey", V.is_empty("profile").alias("is_empty"))


@query(
    "fill_rate",
    f"""WITH {SQL_GAPPY} SELECT k AS c_custkey, round((company_name::INT + tagline::INT) / 6, 6) AS identity, round((website_url::INT + emails::INT) / 6, 6) AS contact,
      round(products::INT / 5, 6) AS offerings, 0.0::DOUBLE AS reputation FROM g""",
)
def fill_rate(t: Tables):
    rates = gappy_profiles(t).select("c_custkey", V.fill_rates("profile").alias("r")).select("c_custkey", "r.*")
    return rates.select("c_custkey", *[F.round(c, 6).alias(c) for c in ("identity", "contact", "offerings", "reputation")])


@query(
    "cap_hit_rate",
    f"WITH {SQL_GAPPY} SELECT k AS c_custkey, ((n_emails >= 10)::INT + (n_products >= 60)::INT) / 10 AS rate FROM g",
)
def cap_hit_rate(t: Tables):
    return gappy_profiles(t).select("c_custkey", V.cap_hit_rate("profile").alias("rate"))


@query(
    "evidence_coverage",
    f"""WITH {SQL_GAPPY}, c AS (SELECT k, company_name::INT + tagline::INT + industry::INT + website_url::INT + emails::INT + products::INT AS filled, company_name::INT + emails::INT AS backed FROM g)
    SELECT k AS c_custkey, CASE WHEN filled > 0 THEN round(backed / filled, 6) ELSE 0.0 END::DOUBLE AS coverage FROM c""",
)
def evidence_coverage(t: Tables):
    return gappy_profiles(t).select("c_custkey", F.round(V.evidence_coverage(), 6).alias("coverage"))


FLAT = {
    "name": "CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN '  ' END",
    "tagline": "CASE c_custkey % 5 WHEN 1 THEN concat(' ', repeat('long tag ', 20)) WHEN 2 THEN ' ' END",
    "description": "CASE c_custkey % 5 WHEN 2 THEN concat('Makes ', c_mktsegment, '. And more.') WHEN 3 THEN concat('.', c_name) END",
    "year": "CASE c_custkey % 3 WHEN 0 THEN ' 1990 ' WHEN 1 THEN 'about 1990' END",
    "staff": "CASE c_custkey % 4 WHEN 0 THEN '10 - 50' WHEN 1 THEN '100+' WHEN 2 THEN 'a-5' END",
}


@query(
    "profile_flatten",
    f"""WITH f AS (SELECT c_custkey, c_mktsegment, c_name, c_nationkey::VARCHAR AS c_phone, {", ".join(f"{v} AS {k}" for k, v in FLAT.items())} FROM customer)
    SELECT c_custkey AS cnpj, CASE WHEN trim(coalesce(name, '')) <> '' THEN name WHEN trim(coalesce(tagline, '')) <> '' THEN substr(trim(tagline), 1, 100)
       WHEN trim(coalesce(description, '')) <> '' THEN CASE WHEN trim(split_part(substr(trim(description), 1, 50), '.', 1)) <> '' THEN trim(split_part(substr(trim(description), 1, 50), '.', 1)) ELSE trim(substr(trim(description), 1, 50)) END
       ELSE 'Empresa CNPJ ' || c_custkey END AS company_name,
      CAST(CASE c_custkey % 3 WHEN 0 THEN 1990 ELSE -1 END AS BIGINT) AS founding_year, CAST(CASE c_custkey % 4 WHEN 0 THEN 10 ELSE -1 END AS BIGINT) AS low,
      CAST(CASE c_custkey % 4 WHEN 0 THEN 50 ELSE -1 END AS BIGINT) AS high, coalesce(tagline, '') AS tagline, coalesce(description, '') AS description,
      c_mktsegment AS industry, '' AS business_model, '' AS target_audience, c_name AS geographic_coverage, coalesce(staff, '') AS employee_count_range,
      c_name AS headquarters_address, 'a@' || c_custkey || '.example.com|b' AS emails, c_phone AS phones, '' AS linkedin_url, 'https://c' || c_custkey || '.example.com' AS website_url,
      'https://s' || c_custkey || '.example.com' AS sources, c_mktsegment AS json_industry, c_phone AS json_phone, TRUE AS same FROM f""",
)
def profile_flatten(t: Tables):
    e = {k: F.expr(v) for k, v in FLAT.items()}
    profile = profile_of(
        identity__company_name=e["name"],
        identity__tagline=e["tagline"],
        identity__description=e["description"],
        identity__founding_year=e["year"],
        identity__employee_count_range=e["staff"],
        classification__industry=F.col("c_mktsegment"),
        classification__geographic_coverage=F.col("c_name"),
        contact__headquarters_address=F.col("c_name"),
        contact__emails=F.expr("array(concat('a@', c_custkey, '.example.com'), 'b')"),
        contact__phones=F.array(F.col("c_nationkey").cast("string")),
        contact__website_url=F.expr("concat('https://c', c_custkey, '.example.com')"),
        sources=F.expr("array(concat('https://s', c_custkey, '.example.com'))"),
    )
    flat = P.profile_flatten(t.customer.select(F.col("c_custkey").alias("cnpj_basico"), profile.alias("profile")))

    def number(c: str, name: str) -> Column:
        return F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(name)

    return flat.select(
        "cnpj",
        "company_name",
        number("founding_year", "founding_year"),
        number("employee_count_min", "low"),
        number("employee_count_max", "high"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("tagline", "description", "industry", "business_model", "target_audience", "geographic_coverage", "employee_count_range", "headquarters_address")],
        F.array_join("emails", "|").alias("emails"),
        F.array_join("phones", "|").alias("phones"),
        F.coalesce("linkedin_url", F.lit("")).alias("linkedin_url"),
        "website_url",
        F.array_join("sources", "|").alias("sources"),
        F.get_json_object("profile_json", "$.classification.industry").alias("json_industry"),
        F.get_json_object("full_profile", "$.contact.phones[0]").alias("json_phone"),
        (F.col("profile_json") == F.col("full_profile")).alias("same"),
    )


@query(
    "profile_children",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    new AS (SELECT doc_id AS company_id, 'company_location' AS tbl, {sql_strip('line')} AS value FROM l WHERE doc_id % 3 <> 0 AND {sql_strip('line')} <> ''
      UNION ALL SELECT doc_id, 'company_award', lang || ' award' FROM documents
      UNION ALL SELECT doc_id, 'company_service', 'svc ' || source || '=["' || lang || '"]' FROM documents
      UNION ALL SELECT doc_id, 'company_certification', 'ISO ' || doc_id % 40 FROM documents
      UNION ALL SELECT doc_id, 'company_partnership', 'P' || doc_id % 60 FROM documents
      UNION ALL SELECT doc_id, 'company_product_category', 'Cat ' || doc_id % 4 || '=["' || lang || '","' || source || '"]' FROM documents)
    SELECT * FROM new UNION ALL SELECT doc_id, 'company_location', 'old' FROM documents WHERE doc_id % 3 = 0""",
)
def profile_children(t: Tables):
    none = F.array().cast("array<string>")
    lines = F.when(F.col("doc_id") % 3 != 0, F.split("text", "\n")).otherwise(none)
    blank = F.lit(None).cast("string")
    service = F.struct(
        F.concat(F.lit("svc "), F.col("source")).alias("name"),
        blank.alias("description"),
        blank.alias("methodology"),
        F.array("lang").alias("deliverables"),
        blank.alias("ideal_client_profile"),
    )
    category = F.struct(F.expr("concat('Cat ', doc_id % 4)").alias("category_name"), F.array("lang", "source").alias("items"))
    profile = profile_of(
        contact__locations=lines,
        reputation__awards=F.expr("array(concat(lang, ' award '), ' ')"),
        reputation__certifications=F.expr("array(concat('ISO ', doc_id % 40), '')"),
        reputation__partnerships=F.expr("array(' ', concat(' P', doc_id % 60))"),
        offerings__service_details=F.array(service),
        offerings__product_categories=F.array(category),
    )
    profiles = t.documents.select(F.col("doc_id").alias("company_id"), profile.alias("profile"))
    children = P.profile_children(profiles)
    old = t.documents.select(F.col("doc_id").alias("company_id"), F.lit("old").alias("location"))
    kept = P.replace_children(old, children["company_location"], profiles, "company_location")

    def tagged(df, table: str, column: str):
        return df.select("company_id", F.lit(table).alias("tbl"), F.col(column).alias("value"))

    def pairs(table: str, name: str, listed: str):
        value = F.concat_ws("=", name, listed).alias("value")
        return children[table].select("company_id", F.lit(table).alias("tbl"), value)

    return (
        tagged(kept, "company_location", "location")
        .unionByName(tagged(children["company_award"], "company_award", "name"))
        .unionByName(tagged(children["company_certification"], "company_certification", "name"))
        .unionByName(tagged(children["company_partnership"], "company_partnership", "name"))
        .unionByName(pairs("company_service", "name", "deliverables"))
        .unionByName(pairs("company_product_category", "category_name", "items"))
    )


@query(
    "build_profile",
    f"""WITH {SQL_ROUTES}, b AS (SELECT cnpj_basico, field, row_number() OVER (PARTITION BY cnpj_basico, field ORDER BY min(rn)) AS pos, trim(value) AS value FROM lists GROUP BY cnpj_basico, field, trim(value))
    SELECT cnpj_basico, field, CAST(pos AS BIGINT) AS pos, value FROM b WHERE pos <= CASE field WHEN 'contact.emails' THEN 10 WHEN 'contact.phones' THEN 10 WHEN 'contact.locations' THEN 25
      WHEN 'offerings.products' THEN 60 WHEN 'offerings.services' THEN 60 WHEN 'reputation.certifications' THEN 30 WHEN 'reputation.awards' THEN 20 WHEN 'reputation.partnerships' THEN 50 ELSE 80 END""",
)
def build_profile(t: Tables):
    built = P.build_profile(O.merge_facts(good_facts(t)))
    paths = [p for p in V.CAP_PATHS if p != "offerings.product_categories"]
    entries = F.array(*[F.struct(F.lit(p).alias("field"), F.col(f"profile.{p}").alias("items")) for p in paths])
    rows = built.select("cnpj_basico", F.explode(entries).alias("e"))
    return rows.select("cnpj_basico", "e.field", F.posexplode("e.items").alias("p", "value")).select(
        "cnpj_basico", "field", (F.col("p") + 1).cast("long").alias("pos"), "value"
    )


@query("profiles_from_chunks")
def profiles_of_documents(t: Tables):
    chunks = t.documents.select(
        F.col("source").alias("cnpj_basico"),
        F.col("doc_id").alias("chunk_index"),
        F.col("text").alias("chunk_content"),
        F.array(F.concat(F.lit("https://d"), F.col("doc_id"), F.lit(".example.com/"))).alias("page_source"),
    )
    return profiles_from_chunks(chunks).select("cnpj_basico", F.to_json("profile").alias("profile"))


# --- answers --------------------------------------------------------------------

# Each event's payload as an answer: bare, fenced, inside text, cut, or empty.
JSON_ANSWER = """CASE event_id % 7 WHEN 0 THEN concat(' ', props, ' ') WHEN 1 THEN concat('Here:\n```json\n', props, '\n```\nbye') WHEN 2 THEN concat('```\n', props, '\n```')
  WHEN 3 THEN concat('Answer: ', props, ' and {more') WHEN 4 THEN concat('[', props, ']') WHEN 5 THEN concat('{"a": {"b": ', props) ELSE '  ' END"""


@query(
    "json_extract",
    """SELECT event_id, CASE event_id % 7 WHEN 4 THEN '[' || props || ']' WHEN 5 THEN '' WHEN 6 THEN '' ELSE props END AS json,
      CASE event_id % 7 WHEN 0 THEN 'direct' WHEN 4 THEN 'direct' WHEN 1 THEN 'fenced' WHEN 2 THEN 'fenced' WHEN 3 THEN 'object' ELSE '' END AS stage,
      CASE event_id % 7 WHEN 5 THEN 'unparseable' WHEN 6 THEN 'empty' ELSE '' END AS reject_reason FROM events""",
)
def json_extract(t: Tables):
    found = t.events.select("event_id", N.json_extract(F.expr(JSON_ANSWER)).alias("r")).select("event_id", "r.*")
    return found.na.fill("")


PROFILE_ANSWER = """CASE event_id % 4
  WHEN 0 THEN concat('{"identity": {"company_name": "N', event_id, '", "founding_year": 1990}, "contact": {"emails": "a@b.example.com", "website_url": ["x", "https://w', user_id, '.example.com"], "headquarters_address": ["Rua A", "B"]}}')
  WHEN 1 THEN concat('[{"offerings": {"products": ["p1", null, 3, " p1 ", "p2"], "services": "no list", "product_categories": [{"category_name": "c", "items": ["i", ""]}, {"items": []}]}, "team": {"key_roles": null, "size_range": 12}}]')
  WHEN 2 THEN concat('{"reputation": {"partnerships": [{"partner_name": "PP"}, {"x": 1}, "Q"], "awards": "one", "case_studies": [{"challenge": "hard work"}, {"client_name": "CC"}, {}]}, "classification": {"business_model": "Other"}, "sources": null}')
  ELSE '"text"' END"""


@query(
    "normalize_response",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'N' || event_id ELSE '' END AS company_name, CASE event_id % 4 WHEN 0 THEN 'https://w' || user_id || '.example.com' ELSE '' END AS website_url,
      CASE event_id % 4 WHEN 0 THEN 'Rua A' ELSE '' END AS address, CASE event_id % 4 WHEN 0 THEN 'a@b.example.com' ELSE '' END AS emails,
      CASE event_id % 4 WHEN 1 THEN 'p1|p2' ELSE '' END AS products, CASE event_id % 4 WHEN 1 THEN 'c' ELSE '' END AS categories, CASE event_id % 4 WHEN 1 THEN '12' ELSE '' END AS size_range,
      CASE event_id % 4 WHEN 2 THEN 'PP|Q' ELSE '' END AS partnerships, CASE event_id % 4 WHEN 2 THEN 'one' ELSE '' END AS awards,
      CASE event_id % 4 WHEN 2 THEN 'Desafio: hard work...|Caso: CC' ELSE '' END AS cases, event_id % 4 <> 3 AS is_profile FROM events""",
)
def normalize_response(t: Tables):
    p = t.events.select("event_id", N.normalize_response(F.expr(PROFILE_ANSWER)).alias("p"))

    def joined(c: Column) -> Column:
        return F.coalesce(F.array_join(c, "|"), F.lit(""))

    return p.select(
        "event_id",
        F.coalesce("p.identity.company_name", F.lit("")).alias("company_name"),
        F.coalesce("p.contact.website_url", F.lit("")).alias("website_url"),
        F.coalesce("p.contact.headquarters_address", F.lit("")).alias("address"),
        joined(F.col("p.contact.emails")).alias("emails"),
        joined(F.col("p.offerings.products")).alias("products"),
        joined(F.col("p.offerings.product_categories.category_name")).alias("categories"),
        F.coalesce("p.team.size_range", F.lit("")).alias("size_range"),
        joined(F.col("p.reputation.partnerships")).alias("partnerships"),
        joined(F.col("p.reputation.awards")).alias("awards"),
        joined(F.col("p.reputation.case_studies.title")).alias("cases"),
        F.col("p").isNotNull().alias("is_profile"),
    )


THOUGHT = """CASE turn % 3 WHEN 0 THEN concat('<think>', text, '</think> x <THINK> more </Think>') WHEN 1 THEN concat('<think>', text) ELSE text END"""


@query(
    "reasoning_text",
    f"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN substr({sql_strip("text || chr(10) || ' more '")}, 1, 5000) ELSE '' END AS reasoning FROM conversations)
    SELECT conv_id, turn, reasoning, reasoning <> '' AS has_reasoning FROM r""",
)
def reasoning_text(t: Tables):
    r = t.conversations.select("conv_id", "turn", N.reasoning_text(F.expr(THOUGHT)).alias("reasoning"))
    return r.select(
        "conv_id", "turn", F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.col("reasoning").isNotNull().alias("has_reasoning")
    )


REPLY = "CASE (conv_id + turn) % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN concat(text, repeat(concat(substr(text, 1, 40), ' '), 30)) ELSE text END"


@query(
    "answer_status",
    f"""WITH src AS (SELECT conv_id * 1000 + turn AS id, {REPLY} AS text, (conv_id + turn) % 7 <> 5 AS has FROM conversations), {loop_sql('id')}
    SELECT s.id, CASE WHEN NOT has THEN 'no_choices' WHEN text IS NULL THEN 'null_content' WHEN {sql_strip('text')} = '' THEN 'empty'
      WHEN length(text) >= 100 AND (id IN (SELECT id FROM gram_hits) OR id IN (SELECT id FROM cut_hits) OR (length(text) > 8000 AND NOT regexp_matches(text, '\\}}{SQL_WS}*$'))) THEN 'loop' ELSE 'ok' END AS status FROM src s""",
)
def answer_status(t: Tables):
    has = (F.col("conv_id") + F.col("turn")) % 7 != 5
    return t.conversations.withColumn("reply", F.expr(REPLY)).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), N.answer_status(has, F.col("reply")).alias("status")
    )


@query(
    "prompt_text",
    """SELECT doc_id, md5('chunk_index=' || doc_id || ' / total_chunks=9' || chr(10) || 'token_count=' || length(text) // 3 || chr(10) || 'page_source=[''' || source || ''', ''' || lang || ''']'
      || chr(10) || chr(10) || 'CONTEÚDO DO CHUNK:' || chr(10) || chr(10) || text) AS fact_prompt FROM documents""",
)
def prompt_text(t: Tables):
    tokens = F.floor(F.length("text") / 3).cast("long")
    prompt = M.fact_prompt(F.col("doc_id"), F.lit(9), tokens, F.array("source", "lang"), F.col("text"))
    return t.documents.select("doc_id", F.md5(prompt).alias("fact_prompt"))


@query(
    "link_prompt",
    f"""WITH {sql_links()}, s AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY link) AS rn FROM links WHERE kind = 'page')
    SELECT page_id, string_agg(rn || '. ' || link, chr(10) ORDER BY rn) AS listing FROM s GROUP BY page_id""",
)
def link_prompt(t: Tables):
    return page_links(t).select("page_id", M.numbered_links(F.col("found.pages")).alias("listing"))


@query(
    "discovery_prompt",
    """SELECT c_custkey, md5(chr(10) || 'Dados da Empresa:' || chr(10) || '- Nome Fantasia: ' || c_name || chr(10) || '- Razão Social: Não informado' || chr(10) || '- CNPJ: ' || c_custkey || chr(10)
      || '- E-mail: Não informado' || chr(10) || '- Município: Não informado' || chr(10) || '- CNAEs (Atividades): Não informado' || chr(10) || chr(10) || 'Resultados da Busca (Consolidados):' || chr(10)
      || '["' || c_mktsegment || '"]' || chr(10)) AS prompt FROM customer""",
)
def discovery_prompt(t: Tables):
    prompt = M.discovery_prompt(
        F.col("c_name"), F.lit(None).cast("string"), F.col("c_custkey").cast("string"), F.lit(""), F.array("c_mktsegment")
    )
    return t.customer.select("c_custkey", F.md5(prompt).alias("prompt"))


def _stub(batch):
    """Stands for a model: loops on the first try for some prompts, fails for others."""
    answers = []
    for prompt, temperature in zip(batch["prompt"], batch["temperature"]):
        kind = len(prompt) % 5
        if kind == 0 and temperature < 0.2:
            answers.append("ja " * 60)
        elif kind == 1:
            answers.append(None)
        else:
            answers.append(f"answer to {len(prompt)} characters")
    return answers


@query(
    "model_map",
    """SELECT doc_id, CASE length(text) % 5 WHEN 0 THEN 'loop' WHEN 1 THEN '' ELSE 'answer to ' || length(text) || ' characters' END AS content FROM documents""",
)
def model_map(t: Tables):
    prompts = t.documents.select("doc_id", F.col("text").alias("prompt"))
    rows = M.with_call_settings(prompts, F.floor(F.length("prompt") / 3), 4096)
    called = M.model_map(rows, "doc_id", _stub)
    content = F.when(F.col("content").startswith("ja ja"), "loop").otherwise(F.coalesce("content", F.lit("")))
    return called.select("doc_id", content.alias("content"))


@query(
    "degenerate_retry",
    """SELECT doc_id, CASE length(text) % 5 WHEN 1 THEN '' ELSE 'answer to ' || length(text) || ' characters' END AS content,
      CASE length(text) % 5 WHEN 1 THEN 'failed' ELSE '' END AS failure, CAST(CASE length(text) % 5 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS attempt FROM documents""",
)
def degenerate_retry(t: Tables):
    prompts = t.documents.select("doc_id", F.col("text").alias("prompt"))
    out = M.degenerate_retry(prompts, "doc_id", F.floor(F.length("prompt") / 3), 4096, _stub)
    return out.select(
        "doc_id",
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("failure", F.lit("")).alias("failure"),
        F.col("attempt").cast("long").alias("attempt"),
    )


# --- raw responses --------------------------------------------------------------


@query(
    "decode_pages",
    """SELECT page_id, CASE WHEN page_id % 6 = 5 THEN '' ELSE md5(CASE WHEN page_id % 6 IN (2, 4) THEN regexp_replace(html, '[^\\x00-\\x{ff}]', '?', 'g') ELSE html END) END AS digest FROM pages""",
)
def decode_pages(t: Tables):
    latin = F.encode(F.regexp_replace("html", r"[^\x00-\x{ff}]", "?"), "ISO-8859-1")
    kind = F.col("page_id") % 6
    body = (
        F.when(kind.isin(2, 4), latin)
        .when(kind == 5, F.concat(F.lit(b"%PDF-"), F.encode("html", "UTF-8")))
        .otherwise(F.encode("html", "UTF-8"))
    )
    # Header names the set, names nothing, or names one nobody knows; the last
    # latin-1 pages carry a false utf-8 mark and are found out by their bytes.
    header = F.when(kind == 2, "text/html; charset=ISO-8859-1; x=1").when(kind == 3, "text/html; charset=nope")
    decoded = D.decode_pages(t.pages.select("page_id", body.alias("body"), header.alias("content_type")))
    return decoded.select(
        "page_id", F.when(F.col("html") == "", "").otherwise(F.md5("html")).alias("digest")
    )
