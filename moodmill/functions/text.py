"""Cleaning, normalizing and matching text."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as str.split() sees it: Unicode White_Space plus the four
# information separators. Once as a regex class, once as trim characters.
SPACE = r"[\s\x1c-\x1f]"
_COLLAPSE = rf"(?U){SPACE}+"
_SPACES = "".join(
    chr(c)
    for first, last in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    )
    for c in range(first, last + 1)
)
_TAG = "<[^>]+>"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside one expression, so it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_space(text: Column | str) -> Column:
    return F.btrim(as_col(text), F.lit(_SPACES))


def collapse_space(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(text), _COLLAPSE, " "))


def is_blank(text: Column | str) -> Column:
    """True for NULL, empty and whitespace-only text."""
    return F.coalesce(strip_space(text), F.lit("")) == ""


def first_non_empty(*values: Column | str) -> Column:
    """The first value that is neither NULL nor '', else ''."""
    return F.coalesce(*[F.nullif(as_col(v), F.lit("")) for v in values], F.lit(""))


def join_non_empty(separator: str, *values: Column | str) -> Column:
    return F.concat_ws(separator, *[F.nullif(as_col(v), F.lit("")) for v in values])


# What a reference may be, without its ampersand.
_REFERENCE = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Names that also count without a semicolon, whatever follows; the longest first.
_OPEN_NAMES = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"
_PAIR, _KEY = "\x01", "\x02"
_NAMED = _PAIR.join(name + _KEY + value for name, value in html5.items())
_NUMBERED = _PAIR.join(
    f"{n}{_KEY}{bytes([n]).decode('cp1252', 'ignore') or chr(n)}" for n in range(0x80, 0xA0)
)


def _table(pairs: str) -> Column:
    """A constant map from one literal, which the planner folds."""
    return F.str_to_map(F.lit(pairs), F.lit(_PAIR), F.lit(_KEY))


def _numbered(ref: Column) -> Column:
    hexed = F.lower(F.substring(ref, 2, 1)) == "x"
    digits = F.regexp_replace(ref, "^#[xX]?0*|;$", "")
    # More digits than the last code point has; also keeps conversions in range.
    huge = F.length(digits) > F.when(hexed, 6).otherwise(7)
    short = F.when(huge | (digits == ""), F.lit("0")).otherwise(digits)
    number = F.when(hexed, F.conv(short, 16, 10)).otherwise(short).cast("long")

    def decoded(n: Column) -> Column:
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        control = n.between(0x01, 0x08) | n.between(0x0E, 0x1F) | (n == 0x0B) | (n == 0x7F)
        no_character = n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd"))
            .when(n.between(0x80, 0x9F), F.try_element_at(_table(_NUMBERED), n.cast("string")))
            .when(control | no_character, F.lit(""))
            .otherwise(char)
        )

    return let(number, decoded)


def _decoded_reference(ref: Column) -> Column:
    def by_start(start: Column) -> Column:
        rest = ref.substr(F.length(start) + 1, F.length(ref))
        return F.when(start == "", F.concat(F.lit("&"), ref)).otherwise(
            F.concat(F.try_element_at(_table(_NAMED), start), rest)
        )

    named = F.coalesce(
        F.try_element_at(_table(_NAMED), ref), let(F.regexp_extract(ref, _OPEN_NAMES, 1), by_start)
    )
    return F.when(F.startswith(ref, F.lit("#")), _numbered(ref)).otherwise(named)


def decode_entities(text: Column | str) -> Column:
    """Decode every HTML entity, as browsers read them.

    The text is cut before each ampersand; a piece that starts with a reference
    gets it replaced, by name from one constant table or by number.
    """
    text = as_col(text)

    def piece(p: Column) -> Column:
        def put(ref: Column) -> Column:
            return F.when(ref == "", p).otherwise(
                F.concat(_decoded_reference(ref), p.substr(F.length(ref) + 2, F.length(p)))
            )

        return let(F.regexp_extract(p, _REFERENCE, 1), put)

    pieces = F.array_join(F.transform(F.split(text, "(?=&)"), piece), "")
    return F.when(F.contains(text, F.lit("&")), pieces).otherwise(text)


def strip_html(text: Column | str) -> Column:
    """Tags become spaces, entities are decoded, whitespace collapses."""
    decoded = decode_entities(F.regexp_replace(as_col(text), _TAG, " "))
    return strip_space(F.regexp_replace(decoded, r"[\t\n\f\r ]+", " "))


def clean_html(text: Column | str) -> Column:
    """Archive comments: ``<p>`` becomes a line break, other tags vanish."""
    broken = F.replace(as_col(text), F.lit("<p>"), F.lit("\n"))
    return strip_space(decode_entities(F.regexp_replace(broken, _TAG, "")))


def normalize_text(text: Column | str) -> Column:
    return F.lower(collapse_space(text))


def truncate_text(text: Column | str, max_chars: int = 2000) -> Column:
    """The request-size limit of the scoring service. Never applied implicitly."""
    return F.substring(as_col(text), 1, max_chars)


def aspect_window(text: Column | str, aspect: Column | str, radius: int = 40) -> Column:
    """Text around the first mention of ``aspect``, or the whole text without one."""
    text, aspect = as_col(text), as_col(aspect)
    hit = F.position(F.lower(aspect), F.lower(text))
    start = F.greatest(hit - radius, F.lit(1))
    stop = hit + F.length(aspect) + radius
    return F.when(
        (hit > 0) & (F.length(aspect) > 0), text.substr(start, stop - start)
    ).otherwise(text)


def extract_symbol(topic: Column | str) -> Column:
    """The ticker a topic is about.

    The first ``$`` word that is one to five letters once its punctuation is
    trimmed, else the whole topic when it has that shape, else ''.
    """
    topic = strip_space(topic)
    dollar_word = r"(?U)(?<!\S)\$[.,;:!?]*([A-Za-z]{1,5})[.,;:!?]*(?!\S)"
    tagged = F.regexp_extract(topic, dollar_word, 1)
    whole = F.regexp_extract(topic, "^([A-Za-z]{1,5})$", 1)
    return F.upper(first_non_empty(tagged, whole))


# Spellings that name each class in model outputs.
LABEL_SYNONYMS = {
    "negative": ("negative", "neg", "label_0"),
    "neutral": ("neutral", "neu", "label_1"),
    "positive": ("positive", "pos", "label_2"),
}


def canonical_label(raw: Column | str) -> Column:
    """Canonical class of a model's own label; raises on an unknown one."""
    key = F.lower(as_col(raw))
    out = F.raise_error(F.concat(F.lit("unexpected label: "), F.coalesce(key, F.lit("NULL"))))
    for label, spellings in LABEL_SYNONYMS.items():
        out = F.when(key.isin(*spellings), F.lit(label)).otherwise(out)
    return out


def float32_text(value: Column | str) -> Column:
    """Shortest text that reads back as the same 32-bit float: no trailing
    ``.0``, plain digits down to 0.0001, then ``d.ddde-NN``."""
    plain = F.regexp_replace(as_col(value).cast("float").cast("string"), r"\.0$", "")
    sign = F.regexp_extract(plain, "^(-?)", 1)
    digits = F.regexp_replace(F.regexp_extract(plain, r"^-?(\d+(?:\.\d+)?)E", 1), r"\.0$", "")
    power = F.regexp_extract(plain, r"E-(\d+)$", 1)
    tiny = F.concat(sign, digits, F.lit("e-"), F.lpad(power, 2, "0"))
    small = F.concat(sign, F.lit("0.000"), F.replace(digits, F.lit("."), F.lit("")))
    return F.when(power == "", plain).when(power == "4", small).otherwise(tiny)
