"""Model answers: finding the JSON, bringing it into shape, judging the text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera import schemas as S
from tessera.functions.text import let, strip, unique_trimmed
from tessera.functions.tokens import repetition_loop

# The most characters of reasoning that are kept.
REASONING_CHARS = 5000
# Keys under which an object names itself, in order.
NAME_KEYS = ["name", "title", "partner_name", "company", "client_name", "certification", "award"]

_VARIANTS = "array<variant>"


def reasoning_text(content: Column) -> Column:
    """Text inside think tags, joined by newlines, cut to its limit; null if none."""
    found = F.regexp_extract_all(content, F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1))
    text = strip(F.array_join(found, "\n"))
    return F.when(text != "", F.substring(text, 1, REASONING_CHARS))


def answer_status(has_choices: Column, content: Column) -> Column:
    """Why an answer is unusable, or ``ok``."""
    return (
        F.when(~F.coalesce(has_choices, F.lit(False)), "no_choices")
        .when(content.isNull(), "null_content")
        .when(strip(content) == "", "empty")
        .when(repetition_loop(content), "loop")
        .otherwise("ok")
    )


def _fence_content(c: Column) -> Column:
    tagged = F.regexp_extract(c, r"(?s)```json\s*(.*?)\s*```", 1)
    plain = F.regexp_extract(c, r"(?s)```\s*(.*?)\s*```", 1)
    inner = F.when(F.contains(c, F.lit("```json")), tagged).when(F.contains(c, F.lit("```")), plain)
    return strip(F.when(inner != "", inner).otherwise(c))


def _first_object(c: Column) -> Column:
    """From the first brace to the one that closes it; braces in strings count too."""
    tail = F.regexp_extract(c, r"(?s)(\{.*)", 1)
    runs = F.regexp_extract_all(tail, F.lit(r"[{}]|[^{}]+"), F.lit(0))
    end = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("chars"), F.lit(False).alias("closed")),
        lambda acc, run: F.when(acc["closed"], acc).otherwise(
            let(
                F.when(run == "{", acc["depth"] + 1).when(run == "}", acc["depth"] - 1).otherwise(acc["depth"]),
                lambda depth: F.struct(
                    depth.alias("depth"),
                    (acc["chars"] + F.length(run)).alias("chars"),
                    ((run == "}") & (depth == 0)).alias("closed"),
                ),
            )
        ),
    )
    return let(
        F.struct(tail.alias("tail"), end.alias("end")),
        lambda r: F.when(r["end"]["closed"], F.substring(r["tail"], F.lit(1), r["end"]["chars"])),
    )


def json_extract(response: Column) -> Column:
    """Struct (json, stage, reject_reason) of the JSON text inside an answer.

    Tried in order: the answer itself, its fenced block, its first closed object.
    """

    def parses(c: Column) -> Column:
        return F.try_parse_json(c).isNotNull()

    def build(r: Column) -> Column:
        stage = (
            F.when(parses(r["whole"]), "direct")
            .when(parses(r["fenced"]), "fenced")
            .when(r["object"].isNotNull() & parses(r["object"]), "object")
        )
        return let(
            stage,
            lambda s: F.struct(
                F.when(s == "direct", r["whole"])
                .when(s == "fenced", r["fenced"])
                .when(s == "object", r["object"])
                .alias("json"),
                s.alias("stage"),
                F.when(s.isNull(), F.when(r["whole"] == "", "empty").otherwise("unparseable")).alias(
                    "reject_reason"
                ),
            ),
        )

    def candidates(whole: Column) -> Column:
        return let(
            F.struct(whole.alias("whole"), _fence_content(whole).alias("fenced")),
            lambda r: F.struct(
                r["whole"].alias("whole"),
                r["fenced"].alias("fenced"),
                _first_object(r["fenced"]).alias("object"),
            ),
        )

    return let(let(strip(response), candidates), build)


# --- bringing an answer into the shape of a profile -------------------------


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_text(v: Column) -> Column:
    return _kind(v) == "STRING"


def _is_object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def _fields(v: Column, names: list[str]) -> Column:
    """The named members of an object, all read at once; null for every other kind."""
    return F.try_variant_get(v, "$", "struct<" + ", ".join(f"{n}: variant" for n in names) + ">")


def _text(v: Column) -> Column:
    """The string in a variant, null for every other kind."""
    return let(v, lambda x: F.when(_is_text(x), F.try_variant_get(x, "$", "string")))


def _filled_text(v: Column) -> Column:
    return let(_text(v), lambda s: F.when(strip(s) != "", s))


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", _VARIANTS), F.array().cast(_VARIANTS))


def _texts_of(v: Column) -> Column:
    """Non-blank strings of a list; other items are dropped."""
    return F.filter(F.transform(_items(v), _filled_text), lambda s: s.isNotNull())


def _text_list(v: Column, name: str, from_single: bool) -> Column:
    """List field: strings of a list, or one string as a list where that is allowed."""
    cap = S.LIST_CAPS[name]
    items = _texts_of(v)
    if from_single:
        listed = items
        items = let(_filled_text(v), lambda one: F.when(one.isNotNull(), F.array(one)).otherwise(listed))
    return unique_trimmed(items, cap).alias(name)


def _name_of(v: Column) -> Column:
    """String of an item, or the first name an object gives itself."""

    def first(o: Column) -> Column:
        named = F.coalesce(*[F.when(_truthy(o[k]), o[k]) for k in NAME_KEYS])
        return F.when(o.isNotNull(), _filled_text(named)).otherwise(_filled_text(v))

    return let(_fields(v, list(NAME_KEYS)), first)


def _truthy(v: Column) -> Column:
    """Set and not empty, zero or false."""
    empty = ["null", '""', "0", "0.0", "false", "[]", "{}"]
    return F.coalesce(~F.to_json(v).isin(empty), F.lit(False))


def _shown(v: Column) -> Column:
    """A value as text, strings without quotes."""
    return F.when(_is_text(v), F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _named_list(v: Column, name: str) -> Column:
    names = F.filter(F.transform(_items(v), _name_of), lambda s: s.isNotNull())
    items = let(_filled_text(v), lambda one: F.when(one.isNotNull(), F.array(one)).otherwise(names))
    return unique_trimmed(items, S.LIST_CAPS[name]).alias(name)


def _url(v: Column, wanted) -> Column:
    """A url given as text, or the first fitting one of a list."""
    fitting = F.filter(_texts_of(v), wanted)
    first = strip(F.get(fitting, F.lit(0)))
    return F.when(_is_text(v), strip(_filled_text(v))).otherwise(first)


def _category(v: Column) -> Column:
    return let(
        _fields(v, ["category_name", "items"]),
        lambda o: F.struct(
            _filled_text(o["category_name"]).alias("category_name"),
            unique_trimmed(_texts_of(o["items"]), S.ITEMS_CAP).alias("items"),
        ),
    )


def _service(v: Column) -> Column:
    return let(
        _fields(v, ["name", "description", "methodology", "deliverables", "ideal_client_profile"]),
        lambda o: F.struct(
            _filled_text(o["name"]).alias("name"),
            _text(o["description"]).alias("description"),
            _text(o["methodology"]).alias("methodology"),
            unique_trimmed(_texts_of(o["deliverables"]), S.DELIVERABLES_CAP).alias("deliverables"),
            _text(o["ideal_client_profile"]).alias("ideal_client_profile"),
        ),
    )


def _case(v: Column) -> Column:
    """A case study; one without a title gets one from what it has."""

    members = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))

    def build(o: Column) -> Column:
        def opening(label: str, name: str) -> Column:
            return F.concat(F.lit(f"{label}: "), F.substring(_shown(o[name]), 1, 50), F.lit("..."))

        title = (
            F.when(_truthy(o["title"]), _text(o["title"]))
            .when(_truthy(o["challenge"]), opening("Desafio", "challenge"))
            .when(_truthy(o["solution"]), opening("Solução", "solution"))
            .when(_truthy(o["client_name"]), F.concat(F.lit("Caso: "), _shown(o["client_name"])))
            .when(F.exists(members, _truthy), "Estudo de Caso (Sem Título)")
        )
        return F.struct(title.alias("title"), *[_text(o[f]).alias(f) for f in S.CASE_FIELDS if f != "title"])

    return let(_fields(v, list(S.CASE_FIELDS)), build)


def _field(section: Column, name: str, read, *options) -> Column:
    """A field of a section read by ``read``."""
    return read(section[name], name, *options).alias(name)


def _structs(v: Column, build, key: str, name: str) -> Column:
    objects = F.filter(_items(v), _is_object)
    kept = F.filter(F.transform(objects, build), lambda s: s[key].isNotNull())
    return F.slice(kept, 1, S.LIST_CAPS[name]).alias(name)


def normalize_response(json: Column) -> Column:
    """A profile from a JSON answer of loose shape; null when it holds no object.

    A list stands for its first object; missing parts become null or empty. Lists
    over their cap are cut and an unknown business model becomes null, where a
    strict reader would throw the whole profile away.
    """

    members = {
        "identity": S.IDENTITY,
        "classification": S.CLASSIFICATION,
        "team": ["size_range", *S.TEAM_LISTS],
        "offerings": [*S.OFFERING_LISTS, "product_categories", "service_details"],
        "reputation": [*S.REPUTATION_LISTS, "case_studies"],
        "contact": [*S.CONTACT_LISTS, "linkedin_url", "website_url", "headquarters_address"],
    }
    names = list(members)

    def sections(root: Column) -> Column:
        """Every section with all its fields, each object read once."""
        return let(
            _fields(root, [*names, "sources"]),
            lambda p: F.struct(*[_fields(p[n], members[n]).alias(n) for n in names], p["sources"].alias("sources")),
        )

    def build(parts: Column) -> Column:
        identity, classification, team, offerings, reputation, contact = [parts[n] for n in names]
        size = team["size_range"]
        address = contact["headquarters_address"]
        first_line = F.get(_items(address), F.lit(0))
        model = _text(classification["business_model"])
        return F.struct(
            F.struct(*[_text(identity[f]).alias(f) for f in S.IDENTITY]).alias("identity"),
            F.struct(
                *[
                    (F.when(model.isin(S.BUSINESS_MODELS), model) if f == "business_model" else _text(classification[f])).alias(f)
                    for f in S.CLASSIFICATION
                ]
            ).alias("classification"),
            F.struct(
                F.when(_is_text(size), _text(size)).when(_truthy(size), _shown(size)).alias("size_range"),
                *[_field(team, f, _text_list, True) for f in S.TEAM_LISTS],
            ).alias("team"),
            F.struct(
                *[_field(offerings, f, _text_list, False) for f in S.OFFERING_LISTS],
                _structs(offerings["product_categories"], _category, "category_name", "product_categories"),
                _structs(offerings["service_details"], _service, "name", "service_details"),
            ).alias("offerings"),
            F.struct(
                *[_field(reputation, f, _named_list) for f in S.REPUTATION_LISTS],
                _structs(reputation["case_studies"], _case, "title", "case_studies"),
            ).alias("reputation"),
            F.struct(
                *[_field(contact, f, _text_list, True) for f in S.CONTACT_LISTS],
                _url(contact["linkedin_url"], lambda u: F.contains(F.lower(u), F.lit("linkedin"))).alias("linkedin_url"),
                _url(contact["website_url"], lambda u: u.startswith("http")).alias("website_url"),
                F.when(_is_text(address), _text(address))
                .when(_truthy(first_line), _shown(first_line))
                .alias("headquarters_address"),
            ).alias("contact"),
            _texts_of(parts["sources"]).alias("sources"),
        )

    root = let(
        F.try_parse_json(json),
        lambda v: F.when(_is_object(v), v).otherwise(F.get(_items(v), F.lit(0))),
    )
    return let(root, lambda r: F.when(_is_object(r), let(sections(r), build)))
