"""Text clean-up, content blocks and JSON found in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_WORD_GAP = "\ufdd0\ufdd1 "  # two code points that no text may hold
# Fixed value: a fenced block, with or without the word json.
_FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def strip(text: Column) -> Column:
    """Remove all outer white space; a plain ``trim`` would remove blanks only."""
    return F.trim(text, F.lit(WHITE_SPACE))


def title(text: Column) -> Column:
    """Every run of letters starts upper case: ``men's non-fiction`` -> ``Men'S Non-Fiction``.

    ``initcap`` starts words after blanks only, so a blank is put before each other run start and
    taken out again.
    """
    gapped = F.regexp_replace(text, f"([^{_CASED} ])(?=[{_CASED}])", "$1" + _WORD_GAP)
    return F.replace(F.initcap(gapped), F.lit(_WORD_GAP), F.lit(""))


def normalize_text(text: Column, hint: str | None) -> Column:
    words = (hint or "").lower()
    if "lower" in words:
        text = F.lower(text)
    elif "upper" in words:
        text = F.upper(text)
    elif "title" in words:
        text = title(text)
    if "strip" in words or "trim" in words:
        text = strip(text)
    return text


def content_text(blocks: Column) -> Column:
    """Join the texts of the ``text`` blocks of an ``array<struct<type,text>>`` with newlines."""
    kept = F.filter(blocks, lambda b: b["type"] == "text")
    return F.array_join(F.transform(kept, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _one_json_value(text: Column) -> Column:
    """``text`` as a variant if it is exactly one JSON value, else NULL.

    The parser stops after the first value and so accepts trailing text. A text that parses both
    as the only content of an array and as the value of an object can hold nothing else.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(in_array.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def _widest(text: Column, opening: str, closing: str) -> Column:
    start = F.instr(text, opening)
    end = F.length(text) - F.instr(F.reverse(text), closing) + 1
    found = (start > 0) & text.contains(closing) & (end > start)
    return F.when(found, F.substr(text, start, end - start + 1))


def extract_json(content: Column) -> Column:
    """``struct<json, method>``: the JSON a free text holds and where it was found, or NULL.

    The JSON is the text's own characters: numbers keep all digits, keys their order. A place is looked at only
    if those before it held no JSON.
    """
    text = strip(content)
    places = [
        ("whole", text),
        ("fence", strip(F.regexp_extract(text, _FENCE, 1))),
        ("array", _widest(text, "[", "]")),
        ("object", _widest(text, "{", "}")),
    ]

    def attempt(method: str, candidate: Column) -> Column:
        json = _let(candidate, lambda c: F.when(_one_json_value(c).isNotNull(), c))
        return _let(json, lambda j: F.when(j.isNotNull(), F.struct(j.alias("json"), F.lit(method).alias("method"))))

    return F.coalesce(*[attempt(method, candidate) for method, candidate in places])
