"""Text and links out of HTML as Column functions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from tessera.functions.text import BREAK, let, strip

# Elements whose content is not text.
DROPPED_ELEMENTS = (
    "script", "style", "noscript", "iframe", "svg", "path", "defs", "symbol", "use",
)

# Pages may hold tags of any length, so no pattern backtracks into a repeated group: every
# repetition of one is possessive, which Java runs as a loop and not as a recursion.
#: A comment, and a tag in which a quoted attribute value may hold ``>``. What is never
#: closed runs to the end of the page.
COMMENT = r"(?s)<!--(?:[^-]++|-(?!->))*+(?:-->|\z)"
TAG = r"<[/!?a-zA-Z](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+(?:>|\z)"
#: An anchor up to its first ``href``: whole attributes, so that neither a name that ends
#: in href nor text inside a quoted value is taken for one.
HREF = (
    r"(?i)<a(?:\s++(?!href\s*+=)[^\s\"'>=/<]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'><]++))?+)*+"
    r"\s++href\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)"
)

# All entity names of HTML, and those that are also known without a semicolon.
_NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
_BARE = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
# Numbers 128 to 159 mean the characters of the Windows code page.
_WINDOWS = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]


def _numbered(body: Column) -> Column:
    """The character of ``#233`` or ``#xE9``."""
    digits = F.when(body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10))
    number = F.coalesce(digits, F.substr(body, F.lit(2))).try_cast("bigint")

    def character(n: Column) -> Column:
        control = n.between(1, 8) | n.between(14, 31) | n.between(127, 159) | (n == 11) | n.between(0xFDD0, 0xFDEF)
        return (
            F.when(n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .when(n.between(128, 159), F.get(F.array(*[F.lit(c) for c in _WINDOWS]), (n - 128).cast("int")))
            .when(control, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    return let(number, character)


def decode_entities(c: Column, attribute: bool = False) -> Column:
    """Every named and numeric entity, each decoded once.

    The text is split at its entities and put together again, so a decoded ``&`` is not
    read a second time. In an attribute a name without semicolon counts only if no
    letter, digit or ``=`` follows, as in ``?a=1&copy=2``.
    """
    names = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")
    bare = rf"(?:{_BARE})" + (r"(?![A-Za-z0-9=])" if attribute else "")
    entity = rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|{bare})"

    def one(e: Column) -> Column:
        body = F.regexp_replace(e, "^&|;$", "")
        start = F.regexp_extract(e, rf"^&({_BARE})", 1)
        prefixed = F.lit(None).cast("string") if attribute else F.when(
            start != "", F.concat(F.element_at(names, start), F.substr(e, F.length(start) + 2))
        )
        return (
            F.when(e == "&amp;", F.lit("&"))
            .when(body.startswith("#"), _numbered(body))
            .otherwise(F.coalesce(F.element_at(names, body), prefixed, e))
        )

    found = F.transform(F.regexp_extract_all(c, F.lit(entity), F.lit(0)), one)
    pieces = F.split(c, entity, -1)
    joined = let(found, lambda f: F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(f, i), F.lit("")))), ""))
    return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)


def drop_elements(html: Column, names: tuple[str, ...] = DROPPED_ELEMENTS) -> Column:
    """Remove elements with their content, in one pass for all names.

    A script or style that is never closed takes the rest of the page, as in a browser.
    """
    either = "|".join(names)
    return F.regexp_replace(
        html, rf"(?is)<({either})(?:\s[^>]*+)?+>.*?</\1\s*+>|<(?:script|style)(?:\s[^>]*+)?+>.*+", "\n"
    )


def html_text(html: Column) -> Column:
    """Text nodes, one per line, trimmed and without blank lines."""
    bare = drop_elements(F.regexp_replace(html, COMMENT, "\n"))
    text = decode_entities(F.regexp_replace(bare, TAG, "\n"))
    # One pass: a run of white space that holds a line end becomes one newline.
    return F.regexp_replace(strip(text), BREAK, "\n")


def visible_length(html: Column) -> Column:
    """Length of the text with every text node trimmed and joined without a gap."""
    bare = drop_elements(F.regexp_replace(html, COMMENT, "\x00"), ("script", "style", "noscript"))
    bare = decode_entities(F.regexp_replace(bare, TAG, "\x00"))
    nodes = F.transform(F.split(bare, "\x00", -1), lambda x: F.length(strip(x)))
    return F.aggregate(nodes, F.lit(0), lambda acc, n: acc + n)


def hrefs(html: Column) -> Column:
    """Href values of the anchors that are left in the cleaned markup, trimmed and decoded."""
    raw = F.regexp_extract_all(drop_elements(F.regexp_replace(html, COMMENT, "")), F.lit(HREF), F.lit(1))
    return F.transform(
        raw,
        lambda h: F.regexp_replace(
            strip(decode_entities(F.regexp_replace(h, r"^[\"']|[\"']\z", ""), attribute=True)), r",+\z", ""
        ),
    )
