"""Normal forms and tests of single fact values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.text import collapse, contains_any, let, strip

# Words left out of a service label, and plurals brought to singular.
SERVICE_STOPWORDS = ["de", "da", "do", "das", "dos"]
SERVICE_PLURALS = [("sistemas", "sistema"), ("serviços", "serviço"), ("soluções", "solução")]
# Keywords that place a reputation fact, in order of test.
REPUTATION_KEYWORDS = {
    "client_list": ["cliente", "clientes", "quem confia", "cases", "nossos clientes"],
    "certifications": ["certificação", "iso", "anvisa", "inmetro"],
    "awards": ["prêmio", "premiação", "award"],
    "partnerships": ["parceria", "parceiro", "partner"],
}
# Marks of a company name inside an identity fact.
NAME_MARKS = ["ltda", "s.a", "sa ", "me ", "eireli"]
_EDGE = r"[\p{L}\p{N}_]"


def normalize_email(c: Column) -> Column:
    return F.lower(strip(c))


def normalize_link(c: Column) -> Column:
    """Url without query, fragment and a trailing slash."""
    bare = F.regexp_replace(strip(c), r"[?#].*$", "")
    return F.when(bare.endswith("/") & (F.length(bare) > 9), F.regexp_replace(bare, r"/\z", "")).otherwise(bare)


def normalize_phone(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d+]", "")


def service_label(c: Column) -> Column:
    """Lower label without small words, common plurals in the singular."""
    words = F.filter(F.split(F.lower(collapse(c)), " "), lambda w: ~w.isin(SERVICE_STOPWORDS))
    label = F.array_join(words, " ")
    for plural, singular in SERVICE_PLURALS:
        label = F.regexp_replace(label, f"(?<!{_EDGE}){plural}(?!{_EDGE})", singular)
    return strip(label)


def is_product(c: Column) -> Column:
    """Letters with digits, a number with a unit, or a word for a code."""
    mixed = c.rlike("[A-Za-z]") & c.rlike("[0-9]")
    code = c.rlike(rf"(?iu)(?<!{_EDGE})(modelo|código|sku|ref\.?|reference)(?!{_EDGE})")
    return (strip(c) != "") & (mixed | code)


def identity_field(value: Column, whole_word: bool = False) -> Column:
    """Field of the identity a fact belongs to.

    "sa " also matches inside "empresa "; ``whole_word`` asks for the word itself.
    """
    low = F.lower(value)
    if whole_word:
        marks = "|".join(m.strip().replace(".", r"\.") for m in NAME_MARKS)
        named = low.rlike(rf"(?<!{_EDGE})({marks})(?!{_EDGE})")
    else:
        named = contains_any(low, NAME_MARKS)
    return (
        F.when(F.contains(low, F.lit("cnpj")) | low.rlike(r"\d{11,14}"), "cnpj")
        .when(named, "company_name")
        .when(contains_any(low, ["fundada", "desde"]), "founding_year")
        .otherwise("description")
    )


def contact_field(value: Column, digits_first: bool = False) -> Column:
    """Field of the contact a fact belongs to.

    A phone needs eight digits in a row; ``digits_first`` counts digits through
    punctuation, so that "(21) 3848-0141" is a phone too.
    """
    long_number = value.rlike(r"\d{8,}")
    if digits_first:
        long_number = long_number | (
            value.rlike(r"\A[\d\s()+./-]+\z") & (F.length(normalize_phone(value)) >= 8)
        )
    return (
        F.when(F.contains(value, F.lit("@")), "emails")
        .when(long_number, "phones")
        .when(value.startswith("http://") | value.startswith("https://"), "website_url")
        .when(F.length(value) >= 5, "locations")
    )


def reputation_field(quote: Column) -> Column:
    """Field of the reputation by the words of the quote; null when none is there."""
    low = F.lower(quote)
    chain = F
    for field, words in REPUTATION_KEYWORDS.items():
        chain = chain.when(contains_any(low, words), field)
    return chain


def routed_fact(section: Column, value: Column, quote: Column) -> Column:
    """Struct (field, value, key): where a fact goes, as what, and its dedupe key.

    Null when the fact belongs nowhere.
    """

    def build(v: Column) -> Column:
        contact = contact_field(v)
        stored = (
            F.when(contact == "emails", normalize_email(v))
            .when(contact == "phones", normalize_phone(v))
            .when(contact == "website_url", normalize_link(v))
            .otherwise(v)
        )
        product = is_product(v)
        offering = F.when(product, v).otherwise(service_label(v))

        def row(field: Column, name: Column) -> Column:
            return F.struct(
                field.alias("field"), name.alias("value"), F.lower(name).alias("key")
            )

        field = F.concat_ws(".", F.lit("contact"), contact)
        return (
            F.when(v == "", F.lit(None))
            .when(section == "identity", row(F.concat(F.lit("identity."), identity_field(v)), v))
            .when((section == "contact") & contact.isNotNull(), row(field, stored))
            .when(
                section == "offerings",
                row(F.when(product, "offerings.products").otherwise("offerings.services"), offering),
            )
            .when(
                (section == "reputation") & reputation_field(quote).isNotNull(),
                row(F.concat(F.lit("reputation."), reputation_field(quote)), v),
            )
        )

    return let(collapse(value), build)
