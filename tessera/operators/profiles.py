"""Company profiles: building, merging, flattening."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tessera import schemas as S
from tessera.functions import profile as P
from tessera.functions.text import WS_CHARS, blank_to_null, strip, unique_trimmed
from tessera.operators.ordered import ordered_fold, range_sorted
from tessera.session import staged

# Category names that say nothing.
GENERIC_CATEGORIES = [
    "outras categorias", "outras", "marcas", "marca", "geral", "diversos", "outros", "categorias",
    "categoria", "produtos", "produto",
]
JOINED_TEXTS = ["description", "tagline"]

_TEXTS = "array<string>"


def _no_items(kind: str = _TEXTS) -> Column:
    return F.array().cast(kind)


# --- building ---------------------------------------------------------------


def build_profile(merged: DataFrame) -> DataFrame:
    """Merged facts to a profile: only given values, lists cut at the profile's caps."""

    def listed(path: str) -> Column:
        name = path.split(".")[1]
        return unique_trimmed(F.coalesce(F.col(path), _no_items()), S.LIST_CAPS[name]).alias(name)

    given = {"company_name", "cnpj", "description", "founding_year"}
    blank = F.lit(None).cast("string")
    profile = F.struct(
        F.struct(*[(F.col(f"identity.{f}") if f in given else blank).alias(f) for f in S.IDENTITY]).alias("identity"),
        F.struct(*[blank.alias(f) for f in S.CLASSIFICATION]).alias("classification"),
        F.struct(
            blank.alias("size_range"), *[_no_items().alias(f) for f in S.TEAM_LISTS]
        ).alias("team"),
        F.struct(
            listed("offerings.products"),
            listed("offerings.services"),
            _no_items().alias("engagement_models"),
            _no_items().alias("key_differentiators"),
            _no_items(f"array<{S.CATEGORY}>").alias("product_categories"),
            _no_items(f"array<{S.SERVICE}>").alias("service_details"),
        ).alias("offerings"),
        F.struct(
            *[listed(f"reputation.{f}") for f in S.REPUTATION_LISTS],
            _no_items(f"array<{S.CASE}>").alias("case_studies"),
        ).alias("reputation"),
        F.struct(
            *[listed(f"contact.{f}") for f in S.CONTACT_LISTS],
            blank.alias("linkedin_url"),
            F.col("contact.website_url").alias("website_url"),
            blank.alias("headquarters_address"),
        ).alias("contact"),
        _no_items().alias("sources"),
    )
    return merged.select("cnpj_basico", profile.alias("profile"), "evidence_map")


# --- merging ------------------------------------------------------------------


def _scored(partials: DataFrame) -> DataFrame:
    return partials.withColumn("score", P.completeness_score("profile"))


def _placed(scored: DataFrame) -> DataFrame:
    """Scored partial profiles with their place.

    The base is found with an aggregate over two numbers per row and written: the planner so
    knows its size, and few companies are joined where the profiles lie, without a shuffle.
    """
    base = staged(
        scored.groupBy("cnpj_basico").agg(
            F.min_by("ord", F.struct(-F.col("score"), "ord")).alias("base_ord"),
            F.count("*").alias("n_partials"),
        ),
        "base",
    )
    place = F.col("ord").cast("long")
    # The base comes first, and those before it move up into its place: 64 bits hold any order.
    rank = F.when(F.col("ord") == F.col("base_ord"), F.lit(-(2**63))).otherwise(
        F.when(F.col("ord") < F.col("base_ord"), place + 1).otherwise(place)
    )
    return scored.join(base, "cnpj_basico").select(
        "cnpj_basico",
        F.struct((F.col("ord") != F.col("base_ord")).alias("later"), "ord").alias("turn"),
        rank.alias("rank"),
        "n_partials",
        "profile",
    )


def ranked_profiles(partials: DataFrame) -> DataFrame:
    """Partial profiles with their place: the most complete one first, then in order.

    ``partials`` holds (cnpj_basico, ord, profile). It is read for the scores, and by each
    part of a merge for just the nested fields this needs: stage it first where it is costly
    or may differ when read again.
    """
    return _placed(_scored(partials))


def merge_scalars(ranked: DataFrame) -> DataFrame:
    """Longest text of each field, the earlier one among equals; first filled list.

    One aggregate for all fields; nothing but the best value of each task moves.
    """

    def longest(path: str) -> Column:
        value = F.col(f"profile.{path}")
        order = F.when(value != "", F.struct(-F.length(value), F.col("turn")))
        return F.min_by(value, order).alias(path.replace(".", "__"))

    def first_list(path: str) -> Column:
        value = F.col(f"profile.{path}")
        return F.min_by(value, F.when(F.size(value) > 0, F.col("turn"))).alias(path.replace(".", "__"))

    texts = [p for p in P.TEXT_PATHS if p not in ("identity.description", "identity.tagline")]
    lists = [f"team.{f}" for f in S.TEAM_LISTS] + [f"contact.{f}" for f in S.CONTACT_LISTS]
    return ranked.groupBy("cnpj_basico").agg(
        *[longest(p) for p in texts], *[first_list(p) for p in lists], F.max("n_partials").alias("n_partials")
    )


def _records(path: str, *fields: str) -> Column:
    """Records of an array with some of their fields: asked for one by one, so that a scan reads no others."""
    own = F.arrays_zip(*[F.col(f"profile.{path}.{f}") for f in fields])
    return F.transform(own, lambda r: F.struct(*[r[f].alias(f) for f in fields]))


def _service_rows(ranked: DataFrame, *fields: str) -> DataFrame:
    """Named services with some of their fields. Their deliverables, most of the bytes, are read by who asks for them."""
    services = ranked.select("cnpj_basico", "turn", _records("offerings.service_details", "name", *fields).alias("services"))
    return services.select("cnpj_basico", "turn", F.posexplode("services").alias("pos", "s")).where(F.col("s.name") != "")


def joined_texts(ranked: DataFrame) -> DataFrame:
    """Texts that are joined when they add to each other, folded in order.

    Rows (cnpj_basico, field, item, value): the description and tagline of the
    company, the description and methodology of each service.
    """
    none = F.lit("")
    own = ranked.select(
        "cnpj_basico",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("field"), none.alias("item"), F.col(f"profile.identity.{f}").alias("value"))
                    for f in JOINED_TEXTS
                ]
            )
        ).alias("x"),
        "turn",
        F.lit(0).alias("pos"),
    )
    services = _service_rows(ranked, "description", "methodology").select(
        "cnpj_basico",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f"service_{f}").alias("field"), F.col("s.name").alias("item"), F.col(f"s.{f}").alias("value"))
                    for f in ("description", "methodology")
                ]
            )
        ).alias("x"),
        "turn",
        "pos",
    )
    rows = own.unionByName(services).select(
        "cnpj_basico", "x.field", "x.item", "turn.later", "turn.ord", "pos", "x.value"
    ).where(F.col("value") != "")
    keys, order = ["cnpj_basico", "field", "item"], ["later", "ord", "pos"]
    # Sorting reads its input twice, for the bounds too: the narrow rows are written before.
    return ordered_fold(
        range_sorted(staged(rows, "texts"), keys, order), keys, order, ["value"], P.JoinedText.add, "", "value string",
        enter=P.JoinedText, leave=lambda joined: joined.text,
    )


def _place(pos: Column) -> Column:
    """One number that sorts like (later, ord, pos): 64 bits of ord, 31 of pos.

    The smallest struct of a group needs a sort of all rows; the smallest number is kept in
    a hash table.
    """
    whole = lambda n: F.lit(Decimal(n))
    number = (F.col("turn.ord").cast("decimal(20,0)") + whole(2**63)) * whole(2**31) + pos.cast("long")
    return F.when(F.col("turn.later"), number).otherwise(number - whole(2**95))


def _lists_by_name(records: Column, name: str, items: str) -> Column:
    """Records as (name, items), those of equal names as one, so that a partial has one list a name."""
    own = F.transform(records, lambda r: F.struct(r[name].alias("name"), F.coalesce(r[items], _no_items()).alias("items")))

    def of_name(n: Column) -> Column:
        return F.struct(
            n.alias("name"), F.flatten(F.transform(F.filter(own, lambda r: r["name"].eqNullSafe(n)), lambda r: r["items"])).alias("items")
        )

    names = F.array_distinct(F.transform(records, lambda r: r[name]))
    return F.when(F.size(names) == F.size(records), own).otherwise(F.transform(names, of_name))


#: How a part of a merge hands on what it moved: as it is, or written (``staged``).
Step = Callable[[DataFrame, str], DataFrame]


def _as_it_is(df: DataFrame, name: str) -> DataFrame:
    return df


def _trimmed(values: list[pa.Array]) -> pa.Array:
    """Distinct trimmed values, the first of equal ones, without blanks."""
    own = pc.utf8_trim(pa.concat_arrays(values), characters=WS_CHARS)
    return pc.unique(own.filter(pc.not_equal(own, "")))


def _united(names: list[str]) -> Callable:
    """Rows (*names, value), sorted, to one row a key with its values as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values, kinds = None, [], None

        def row() -> pa.RecordBatch:
            items = _trimmed(values)
            column = pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
            return pa.RecordBatch.from_arrays([*[pa.array([v], k) for v, k in zip(held, kinds)], column], [*names, "items"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [c.type for c in batch.columns[:-1]]
            new = pa.array([True] + [False] * (batch.num_rows - 1))
            for c in batch.columns[:-1]:
                same = pc.fill_null(pc.equal(c[1:], c[:-1]), False)
                both = pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1]))
                new = pc.or_(new, pa.concat_arrays([pa.array([True]), pc.invert(pc.or_(same, both))]))
            starts = pc.indices_nonzero(new).to_pylist()
            for at, to in zip(starts, [*starts[1:], batch.num_rows]):
                key = [c[at].as_py() for c in batch.columns[:-1]]
                if key != held:
                    if held is not None:
                        yield row()
                    held, values = key, []
                values.append(batch.column(len(names))[at:to])
        if held is not None:
            yield row()

    return run


def _first_seen(lists: DataFrame, keys: list[str], step: Step = _as_it_is) -> DataFrame:
    """All distinct values per key in first-seen order.

    ``lists`` holds (*keys, rank, items), one list a key and rank. Two numbers per value are kept in the hash table,
    so repeats go before the shuffle; only distinct values are trimmed. Grouping by value spreads a large key. Its
    distinct values, which its list holds anyway, are then sorted, on disk where they are many, and go by as a stream:
    only the list itself is ever in memory.
    """
    distinct = (
        lists.select(*keys, "rank", F.posexplode(F.array_distinct("items")).alias("at", "value"))
        .groupBy(*keys, "value")
        .agg(F.min("rank").alias("rank"), F.min_by("at", "rank").alias("at"))
    )
    ordered = distinct.repartition(*keys).sortWithinPartitions(*keys, "rank", "at").select(*keys, "value")
    types = ", ".join(f"`{k}` {ordered.schema[k].dataType.simpleString()}" for k in keys)
    # Values that differ in white space only are one: the first stays.
    return step(ordered.mapInArrow(_united(keys), f"{types}, items array<string>").where(F.size("items") > 0), "united")


UNION_FIELDS = [f"offerings.{f}" for f in S.OFFERING_LISTS] + [f"reputation.{f}" for f in S.REPUTATION_LISTS]


def merge_lists(ranked: DataFrame, step: Step = _as_it_is) -> DataFrame:
    """Union of each list field over all partials, in first-seen order; nothing is cut."""
    # A field is its number where every value carries it.
    entries = F.array(
        *[F.struct(F.lit(i).alias("field"), F.col(f"profile.{p}").alias("items")) for i, p in enumerate(UNION_FIELDS)]
    )
    lists = ranked.select("cnpj_basico", "rank", F.explode(entries).alias("e")).select("cnpj_basico", "rank", "e.*")
    united = _first_seen(lists, ["cnpj_basico", "field"], step)
    return united.withColumn("field", F.get(F.array(*[F.lit(p) for p in UNION_FIELDS]), F.col("field")))


def merge_sources(ranked: DataFrame) -> DataFrame:
    """Distinct sources of a company as rows with the place where each is first seen."""
    rows = ranked.select("cnpj_basico", "turn", F.posexplode("profile.sources").alias("pos", "source"))
    return rows.where(strip(F.col("source")) != "").groupBy("cnpj_basico", "source").agg(
        F.min(F.struct("turn", "pos")).alias("place")
    )


def _collect_by_place(rows: DataFrame, record: Column, name: str) -> DataFrame:
    return (
        rows.groupBy("cnpj_basico")
        .agg(F.sort_array(F.collect_list(F.struct("place", record.alias("r")))).alias("rs"))
        .select("cnpj_basico", F.transform("rs", lambda x: x["r"]).alias(name))
    )


def merge_categories(ranked: DataFrame, step: Step = _as_it_is) -> DataFrame:
    """Product categories by name with the union of their items; generic names go."""
    def named(rows: DataFrame) -> DataFrame:
        name = F.col("category_name")
        return rows.where((name != "") & ~F.lower(strip(name)).isin(GENERIC_CATEGORIES))

    keys, path = ["cnpj_basico", "category_name"], "offerings.product_categories"
    # The field of the array: only the names are read.
    names = ranked.select("cnpj_basico", "turn", F.col(f"profile.{path}.category_name").alias("names"))
    firsts = named(
        names.select("cnpj_basico", "turn", F.posexplode("names").alias("pos", "category_name"))
    ).groupBy(*keys).agg(F.min(_place(F.col("pos"))).alias("place"))
    lists = ranked.select("cnpj_basico", "rank", F.explode(_lists_by_name(_records(path, "category_name", "items"), "category_name", "items")).alias("c"))
    items = named(lists.select("cnpj_basico", F.col("c.name").alias("category_name"), "rank", "c.items"))
    merged = firsts.join(_first_seen(items, keys, step), keys, "left").withColumn(
        "items", F.coalesce("items", _no_items())
    )
    record = F.struct("category_name", "items")
    return step(_collect_by_place(merged, record, "product_categories"), "categories")


def _longest(value: Column, place: Column) -> Column:
    return F.min_by(value, F.when(value != "", F.struct(-F.length(value), place)))


def merge_services(ranked: DataFrame, texts: DataFrame, step: Step = _as_it_is) -> DataFrame:
    """Service details by name: texts joined or longest, deliverables united."""
    rows = _service_rows(ranked, "ideal_client_profile").select("cnpj_basico", F.struct("turn", "pos").alias("place"), "s.*")
    keys = ["cnpj_basico", "name"]
    firsts = rows.groupBy(*keys).agg(
        F.min("place").alias("place"),
        _longest(F.col("ideal_client_profile"), F.col("place")).alias("ideal_client_profile"),
    )
    by_name = _lists_by_name(_records("offerings.service_details", "name", "deliverables"), "name", "deliverables")
    lists = ranked.select("cnpj_basico", "rank", F.explode(by_name).alias("s")).select("cnpj_basico", "s.name", "rank", "s.items")
    delivered = _first_seen(lists.where(F.col("name") != ""), keys, step).withColumnRenamed("items", "deliverables")
    folded = (
        texts.where(F.col("field").startswith("service_"))
        .groupBy("cnpj_basico", F.col("item").alias("name"))
        .agg(
            F.max(F.when(F.col("field") == "service_description", F.col("value"))).alias("description"),
            F.max(F.when(F.col("field") == "service_methodology", F.col("value"))).alias("methodology"),
        )
    )
    merged = firsts.join(delivered, keys, "left").join(folded, keys, "left").withColumn(
        "deliverables", F.coalesce("deliverables", _no_items())
    )
    record = F.struct("name", "description", "methodology", "deliverables", "ideal_client_profile")
    return step(_collect_by_place(merged, record, "service_details"), "services")


def merge_cases(ranked: DataFrame) -> DataFrame:
    """Case studies by title, the longest text of each field."""
    rows = ranked.select(
        "cnpj_basico", "turn", F.posexplode("profile.reputation.case_studies").alias("pos", "c")
    ).select("cnpj_basico", F.struct("turn", "pos").alias("place"), "c.*").where(F.col("title") != "")
    others = [f for f in S.CASE_FIELDS if f != "title"]
    merged = rows.groupBy("cnpj_basico", "title").agg(
        *[_longest(F.col(f), F.col("place")).alias(f) for f in others],
        F.min("place").alias("place"),
    )
    record = F.struct(*S.CASE_FIELDS)
    return _collect_by_place(merged, record, "case_studies")


def _keyed_structs(ranked: DataFrame, texts: DataFrame, step: Step) -> list[DataFrame]:
    return [merge_categories(ranked, step), merge_services(ranked, texts, step), step(merge_cases(ranked), "cases")]


#: Columns of one row, by name, or columns under the name of a struct.
Layout = dict[str, "str | dict[str, str]"]


def _put_together(names: list[str], layout: Layout) -> Callable:
    """Rows (key, *names), sorted, to one row a key: each column's value that is not null, or a list's lack of any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, kinds = None, {}, {}

        def one(name: str) -> pa.Array:
            kind = kinds[name]
            return found.get(name, pa.array([[]] if pa.types.is_list(kind) else [None], kind))

        def row() -> pa.RecordBatch:
            columns = {
                n: one(c) if isinstance(c, str) else pa.StructArray.from_arrays([one(x) for x in c.values()], list(c)) for n, c in layout.items()
            }
            return pa.RecordBatch.from_arrays([key, *columns.values()], ["cnpj_basico", *columns])

        for batch in batches:
            kinds = dict(zip(batch.schema.names, batch.schema.types))
            keys = batch.column(0)
            for at in range(batch.num_rows):
                if key is None or not keys[at].equals(key[0]):
                    if key is not None:
                        yield row()
                    # What is taken is a copy: the batch need not stay.
                    key, found = keys.take(pa.array([at])), {}
                for name in names:
                    if batch.column(name)[at].is_valid:
                        found[name] = batch.column(name).take(pa.array([at]))
        if key is not None:
            yield row()

    return run


def _side_by_side(parts: list[DataFrame], layout: Layout, schema: str) -> DataFrame:
    """One row a company out of parts with columns of their own, of which each fills each of its columns once.

    Joins and aggregates would hold the row, which has all lists, several times over; so it is put
    together from the sorted parts as they go by, once. A list that no part fills is empty.
    """
    rows = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), parts)
    names = [c for c in rows.columns if c != "cnpj_basico"]
    ordered = rows.select("cnpj_basico", *names).repartition("cnpj_basico").sortWithinPartitions("cnpj_basico")
    return ordered.mapInArrow(_put_together(names, layout), schema)


def merge_keyed_structs(ranked: DataFrame) -> DataFrame:
    """Categories by name, services by name and case studies by title: one row a company that has any.

    Inner lists are united, a service's description and methodology are joined, of the other texts the
    longest stays. A part is written when it is done. A company without some kind has an empty list of it.
    """
    parts = _keyed_structs(ranked, staged(joined_texts(ranked), "joined"), staged)
    kinds = {"product_categories": S.CATEGORY, "service_details": S.SERVICE, "case_studies": S.CASE}
    columns = ", ".join(f"{name} array<{kind}>" for name, kind in kinds.items())
    return _side_by_side(parts, {name: name for name in kinds}, f"cnpj_basico string, {columns}")


def merge_profiles(partials: DataFrame) -> DataFrame:
    """One profile per company out of its partial ones.

    A company with a single partial keeps it as it is. Each part reads just the nested fields it needs, and a copy of
    all partials, several times their source, is not written: stage ``partials`` first where they are costly or may
    differ when read again. Every part is an aggregate keyed by company and value, so no company is gathered into one
    task, and is written when it is done, so that no two parts' shuffles are on disk at once.
    """
    ranked = ranked_profiles(partials)
    single = ranked.where(F.col("n_partials") == 1).select("cnpj_basico", "profile")
    several = ranked.where(F.col("n_partials") > 1)
    texts = staged(joined_texts(several), "joined")
    own_texts = texts.where(F.col("item") == "").select(
        "cnpj_basico", *[F.when(F.col("field") == f, F.col("value")).alias(f"joined_{f}") for f in JOINED_TEXTS]
    )
    lists = merge_lists(several, staged).select(
        "cnpj_basico", *[F.when(F.col("field") == p, F.col("items")).alias(p.replace(".", "__")) for p in UNION_FIELDS]
    )
    sources = (
        merge_sources(several)
        .groupBy("cnpj_basico")
        .agg(F.sort_array(F.collect_list(F.struct("place", "source"))).alias("ss"))
        .select("cnpj_basico", F.transform("ss", lambda s: s["source"]).alias("sources"))
    )
    # United lists are trimmed and distinct already.
    given = [f"team__{f}" for f in S.TEAM_LISTS] + [f"contact__{f}" for f in S.CONTACT_LISTS]
    scalars = merge_scalars(several).withColumns({c: unique_trimmed(F.coalesce(c, _no_items())) for c in given})
    parts = [staged(scalars.drop("n_partials"), "scalars"), own_texts, lists, *_keyed_structs(several, texts, staged), staged(sources, "sources")]

    def under(section: str, names: list[str]) -> dict[str, str]:
        return {n: f"joined_{n}" if n in JOINED_TEXTS else f"{section}__{n}" for n in names}

    layout = {
        "identity": under("identity", S.IDENTITY),
        "classification": under("classification", S.CLASSIFICATION),
        "team": under("team", ["size_range", *S.TEAM_LISTS]),
        "offerings": under("offerings", S.OFFERING_LISTS) | {n: n for n in ("product_categories", "service_details")},
        "reputation": under("reputation", S.REPUTATION_LISTS) | {"case_studies": "case_studies"},
        "contact": under("contact", S.CONTACT_LISTS + S.CONTACT_TEXT),
        "sources": "sources",
    }
    kinds = S.PROFILE.removeprefix("struct<").removesuffix(">")
    # Not written: read back, a file's rows come in one batch, with all their lists.
    merged = _side_by_side(parts, layout, f"cnpj_basico string, {kinds}")
    return single.unionByName(merged.select("cnpj_basico", F.struct(*layout).alias("profile")))


def clean_profile(profile: Column) -> Column:
    """A profile without blank items, nameless entries and generic categories."""

    def listed(c: Column) -> Column:
        return F.filter(c, lambda x: strip(x) != "")

    offerings, reputation, contact = profile["offerings"], profile["reputation"], profile["contact"]
    categories = F.transform(
        F.filter(
            offerings["product_categories"],
            lambda c: (c["category_name"] != "")
            & ~F.lower(strip(c["category_name"])).isin(GENERIC_CATEGORIES),
        ),
        lambda c: c.withField("items", listed(c["items"])),
    )
    services = F.transform(
        F.filter(offerings["service_details"], lambda s: s["name"] != ""),
        lambda s: s.withField("deliverables", listed(s["deliverables"])),
    )
    for name in S.OFFERING_LISTS:
        offerings = offerings.withField(name, listed(profile["offerings"][name]))
    offerings = offerings.withField("product_categories", categories).withField("service_details", services)
    for name in S.REPUTATION_LISTS:
        reputation = reputation.withField(name, listed(profile["reputation"][name]))
    cases = F.filter(profile["reputation"]["case_studies"], lambda c: c["title"] != "")
    reputation = reputation.withField("case_studies", cases)
    for name in S.CONTACT_LISTS:
        contact = contact.withField(name, listed(profile["contact"][name]))
    return (
        profile.withField("offerings", offerings)
        .withField("reputation", reputation)
        .withField("contact", contact)
        .withField("sources", listed(profile["sources"]))
    )


# --- flattening ---------------------------------------------------------------


def flat_name(name: Column, tagline: Column, description: Column, cnpj: Column) -> Column:
    """Company name with fallbacks: tagline, first sentence, the key."""
    opening = F.substring(strip(description), 1, 50)
    sentence = strip(F.get(F.split(opening, r"\.", -1), F.lit(0)))
    return F.coalesce(
        blank_to_null(name),
        F.when(strip(tagline) != "", F.substring(strip(tagline), 1, 100)),
        F.when(strip(description) != "", F.when(sentence != "", sentence).otherwise(strip(opening))),
        F.concat(F.lit("Empresa CNPJ "), cnpj),
    )


def employee_range(text: Column) -> Column:
    """Struct (low, high) of a range such as "10-50"; nulls for anything else."""
    parts = F.split(text, "-", -1)
    low = strip(F.get(parts, F.lit(0))).try_cast("int")
    high = strip(F.get(parts, F.lit(1))).try_cast("int")
    is_range = F.size(parts) == 2
    return F.struct(
        F.when(is_range, low).alias("low"), F.when(is_range & low.isNotNull(), high).alias("high")
    )


def profile_flatten(profiles: DataFrame) -> DataFrame:
    """Profiles (cnpj_basico, profile) as flat rows with the whole record as JSON."""
    p = F.col("profile")
    identity, contact = p["identity"], p["contact"]
    staff = employee_range(identity["employee_count_range"])
    record = F.to_json("profile")
    return profiles.select(
        F.col("cnpj_basico").alias("cnpj"),
        flat_name(
            identity["company_name"], identity["tagline"], identity["description"], F.col("cnpj_basico").cast("string")
        ).alias("company_name"),
        identity["tagline"].alias("tagline"),
        identity["description"].alias("description"),
        *[p["classification"][f].alias(f) for f in S.CLASSIFICATION],
        strip(identity["founding_year"]).try_cast("int").alias("founding_year"),
        staff["low"].alias("employee_count_min"),
        staff["high"].alias("employee_count_max"),
        identity["employee_count_range"].alias("employee_count_range"),
        contact["headquarters_address"].alias("headquarters_address"),
        contact["emails"].alias("emails"),
        contact["phones"].alias("phones"),
        contact["linkedin_url"].alias("linkedin_url"),
        contact["website_url"].alias("website_url"),
        p["sources"].alias("sources"),
        record.alias("profile_json"),
        record.alias("full_profile"),
    )


def profile_children(profiles: DataFrame) -> dict[str, DataFrame]:
    """The six child tables of (company_id, profile)."""

    def values(path: str, name: str) -> DataFrame:
        rows = profiles.select("company_id", F.explode(f"profile.{path}").alias(name))
        return rows.withColumn(name, strip(F.col(name))).where(F.col(name) != "")

    services = profiles.select("company_id", F.inline("profile.offerings.service_details"))
    categories = profiles.select("company_id", F.inline("profile.offerings.product_categories"))
    return {
        "company_location": values("contact.locations", "location"),
        "company_service": services.where(F.col("name") != "").withColumn(
            "deliverables", F.to_json("deliverables")
        ),
        "company_product_category": categories.where(F.col("category_name") != "").withColumn(
            "items", F.to_json("items")
        ),
        "company_certification": values("reputation.certifications", "name"),
        "company_award": values("reputation.awards", "name"),
        "company_partnership": values("reputation.partnerships", "name"),
    }


CHILD_LISTS = {
    "company_location": "contact.locations",
    "company_service": "offerings.service_details",
    "company_product_category": "offerings.product_categories",
    "company_certification": "reputation.certifications",
    "company_award": "reputation.awards",
    "company_partnership": "reputation.partnerships",
}


def replace_children(old: DataFrame, new: DataFrame, profiles: DataFrame, table: str) -> DataFrame:
    """Child rows after a save: old rows go only where the new list has items."""
    renewed = profiles.where(F.size(f"profile.{CHILD_LISTS[table]}") > 0).select("company_id")
    return old.join(renewed, "company_id", "left_anti").unionByName(new)
