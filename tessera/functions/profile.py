"""Profile values: completeness, emptiness, fill rates, text merging."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, functions as F

from tessera import schemas as S
from tessera.functions.text import let, split_words, strip

# Points per characters of text; the word overlap that separates texts.
TEXT_POINT_CHARS = 10
SIMILAR_FROM = 0.3
#: Characters of a word's end or beginning that are remembered beside its neighbour, the most first.
ENDS = (8, 2)


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _any_item(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def texts_complementary(a: Column, b: Column) -> Column:
    """Neither text holds the other and few of their words are shared."""

    def rules(r: Column) -> Column:
        x, y = r["x"], r["y"]
        shared = F.size(F.array_intersect(r["wx"], r["wy"]))
        larger = F.greatest(F.size(F.array_distinct(r["wx"])), F.size(F.array_distinct(r["wy"])))
        return (
            (x != "")
            & (y != "")
            & ~F.contains(x, y)
            & ~F.contains(y, x)
            & (shared / larger < SIMILAR_FROM)
        )

    def words(r: Column) -> Column:
        return F.struct(
            r["x"].alias("x"),
            r["y"].alias("y"),
            split_words(r["x"]).alias("wx"),
            split_words(r["y"]).alias("wy"),
        )

    pair = F.struct(F.lower(strip(a)).alias("x"), F.lower(strip(b)).alias("y"))
    return F.coalesce(let(let(pair, words), rules), F.lit(False))


def word_overlap(a: str, b: str) -> float:
    """Words of both texts as a share of the larger vocabulary; 1 where one holds the other."""
    texts = sorted((t.strip().lower() for t in (a, b)), key=len)
    if texts[0] in texts[1]:
        return 1.0
    vocabularies = [frozenset(t.split()) for t in texts]
    return len(frozenset.intersection(*vocabularies)) / max(map(len, vocabularies))


def join_texts(*texts: str) -> str:
    """Two texts as one when they add to each other, else the longest, the earlier of equals."""
    given = [t for t in texts if t]
    if len(given) > 1 and word_overlap(*given) < SIMILAR_FROM:
        return ". ".join(t.strip() for t in given)
    return max(given, key=len, default="")


class JoinedText:
    """``join_texts`` over one text after the other, at the cost of the new text only.

    Kept are the text, its lower-cased form as bytes that can be searched and added to, and
    how often each of its words occurs. A text of three words or more can only lie inside the
    held one if all words between its first and last are words of it, and if its first word
    ends, and its last begins, like a neighbour of these; of that the hashes of the neighbours'
    ends are kept, so hardly a text is searched for that is not there.
    """

    def __init__(self, text: str = ""):
        self._hold(text)

    def _hold(self, text: str) -> None:
        low = text.strip().lower()
        self.parts, self.size = [text], len(text)
        self.low, self.low_size = bytearray(low.encode()), len(low)
        words = low.split()
        self.words = Counter(words)
        self.last = words[-1] if words else ""
        self.before_last = words[-2] if len(words) > 1 else ""
        self.beside: set[int] = set()
        self._note(words)

    @property
    def text(self) -> str:
        if len(self.parts) > 1:
            self.parts = ["".join(self.parts)]
        return self.parts[0]

    def _note(self, words: list[str]) -> None:
        """Remember how the neighbours of each word end and begin."""
        for a, b in zip(words, words[1:]):
            self.beside.update(hash((a[-n:], b)) for n in ENDS if len(a) >= n)
            self.beside.update(hash((a, b[:n], n)) for n in ENDS if len(b) >= n)

    def _may_hold(self, words: list[str]) -> bool:
        """False only where no place in the held text has these words side by side."""
        if not all(w in self.words for w in words[1:-1]):
            return False
        if len(words) < 3:
            return True
        first, last = words[0], words[-1]
        n = next((n for n in ENDS if len(first) >= n), 0)
        if n and hash((first[-n:], words[1])) not in self.beside:
            return False
        n = next((n for n in ENDS if len(last) >= n), 0)
        return not n or hash((words[-2], last[:n], n)) in self.beside

    def _holds(self, low: str) -> bool:
        return low.encode() in self.low

    def _overlap(self, low: str, words: list[str]) -> float:
        if len(low) < self.low_size:
            if self._may_hold(words) and self._holds(low):
                return 1.0
        elif self.low.decode() in low:
            return 1.0
        distinct = set(words)
        return sum(w in self.words for w in distinct) / max(len(distinct), len(self.words))

    def add(self, text: str) -> "JoinedText":
        if not text:
            return self
        if not self.size:
            self._hold(text)
            return self
        low = text.strip().lower()
        words = low.split()
        if self._overlap(low, words) < SIMILAR_FROM:
            self._append(text.strip(), low, words)
        elif len(text) > self.size:
            self._hold(text)
        return self

    def _append(self, text: str, low: str, words: list[str]) -> None:
        if len(self.parts) == 1:
            self.parts = [self.parts[0].strip()]
            self.size = len(self.parts[0])
        self.parts.append(". " + text)
        self.size += 2 + len(text)
        self.low += b". " + low.encode()
        self.low_size += 2 + len(low)
        # The last word so far ends in a dot now.
        self.words[self.last] -= 1
        if not self.words[self.last]:
            del self.words[self.last]
        self.words.update([self.last + ".", *words])
        self._note([*([self.before_last] if self.before_last else []), self.last + ".", *words])
        self.before_last = words[-2] if len(words) > 1 else self.last + "."
        self.last = words[-1]


def _texts(section: str, names: list[str]) -> list[str]:
    return [f"{section}.{n}" for n in names]


TEXT_PATHS = [
    *_texts("identity", S.IDENTITY),
    *_texts("classification", S.CLASSIFICATION),
    "team.size_range",
    *_texts("contact", S.CONTACT_TEXT),
]
LIST_PATHS = [
    *_texts("team", S.TEAM_LISTS),
    *_texts("offerings", [*S.OFFERING_LISTS, "product_categories", "service_details"]),
    *_texts("reputation", [*S.REPUTATION_LISTS, "case_studies"]),
    *_texts("contact", S.CONTACT_LISTS),
]


def _at(profile: str, path: str) -> Column:
    return F.col(f"{profile}.{path}")


def completeness_score(profile: str = "profile") -> Column:
    """Items of all lists, plus a point per ten characters of each text."""
    score = F.lit(0)
    for path in TEXT_PATHS:
        score = score + F.floor(F.coalesce(F.length(_at(profile, path)), F.lit(0)) / TEXT_POINT_CHARS)
    for path in [*LIST_PATHS, "sources"]:
        score = score + F.coalesce(F.size(_at(profile, path)), F.lit(0))
    return score.cast("long")


def is_empty(profile: str = "profile") -> Column:
    """No core field of identity, classification, offerings or contact is set."""
    texts = [
        *_texts("identity", ["company_name", "cnpj", "tagline", "description"]),
        *_texts("classification", ["industry", "business_model", "target_audience"]),
        "contact.website_url",
    ]
    lists = [
        *_texts("offerings", ["products", "services", "product_categories"]),
        *_texts("contact", ["emails", "phones"]),
    ]
    some = F.lit(False)
    for path in texts:
        some = some | _filled(_at(profile, path))
    for path in lists:
        some = some | _any_item(_at(profile, path))
    return ~some


def _share(tests: list[Column]) -> Column:
    total = F.lit(0)
    for test in tests:
        total = total + test.cast("int")
    return total / F.lit(float(len(tests)))


def fill_rates(profile: str = "profile") -> Column:
    """Struct of the share of filled slots in four sections."""

    def texts(paths: list[str]) -> list[Column]:
        return [_filled(_at(profile, p)) for p in paths]

    def lists(paths: list[str]) -> list[Column]:
        return [_any_item(_at(profile, p)) for p in paths]

    return F.struct(
        _share(texts(_texts("identity", S.IDENTITY))).alias("identity"),
        _share(
            lists(_texts("contact", S.CONTACT_LISTS)) + texts(_texts("contact", S.CONTACT_TEXT))
        ).alias("contact"),
        _share(lists(_texts("offerings", [*S.OFFERING_LISTS, "product_categories"]))).alias("offerings"),
        _share(lists(_texts("reputation", [*S.REPUTATION_LISTS, "case_studies"]))).alias("reputation"),
    )


# The lists whose caps are watched.
CAP_PATHS = [
    "contact.emails", "contact.phones", "contact.locations",
    "offerings.products", "offerings.services", "offerings.product_categories",
    "reputation.certifications", "reputation.awards", "reputation.partnerships",
    "reputation.client_list",
]


def cap_hit_rate(profile: str = "profile") -> Column:
    """Share of the watched lists that are full."""
    return _share(
        [
            F.coalesce(F.size(_at(profile, p)), F.lit(0)) >= S.LIST_CAPS[p.split(".")[1]]
            for p in CAP_PATHS
        ]
    )


def evidence_coverage(profile: str = "profile", evidence: str = "evidence_map") -> Column:
    """Filled profile fields that have evidence, as a share of the filled ones."""
    filled, backed = F.lit(0), F.lit(0)
    for path in [*TEXT_PATHS, *LIST_PATHS]:
        value = _at(profile, path)
        here = _filled(value) if path in TEXT_PATHS else _any_item(value)
        known = F.coalesce(F.map_contains_key(F.col(evidence), path), F.lit(False))
        filled = filled + here.cast("int")
        backed = backed + (here & known).cast("int")
    return F.when(filled > 0, backed / filled).otherwise(F.lit(0.0))
