"""Text: three normalisers, tokens, relevance and search scores, description cleaning, rule matching."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from . import rules

_MARKS = ("\u0300", "\u036f")


def _decomposed() -> tuple[str, str]:
    """Lower-case letters below U+2000 whose canonical decomposition is one letter and combining marks, and those letters."""
    pairs = []
    for c in map(chr, range(0x80, 0x2000)):
        first, *marks = unicodedata.normalize("NFD", c)
        if marks and c == c.lower() and all(_MARKS[0] <= m <= _MARKS[1] for m in marks):
            pairs.append((c, first))
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


_ACCENTED, _PLAIN = _decomposed()
#: A word boundary between ASCII word characters and others, whatever the engine thinks of accented letters.
_W = "[A-Za-z0-9_]"
EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def plain_words(text: Column) -> Column:
    """Whatever isn't a-z or a digit as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def fold(text: Column) -> Column:
    """Lower case without accents, composed or combining (search normaliser)."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), f"[{_MARKS[0]}-{_MARKS[1]}]", "")


def subscription_key(text: Column) -> Column:
    """Lower case, with a space for everything but ASCII letters and digits, accented letters too."""
    return plain_words(F.lower(text))


def product_key(text: Column) -> Column:
    """Folded, units of volume and weight joined to their number, other signs as spaces."""
    # A digit is looked for first and what stands before it then: positions without one cost next to nothing.
    number = rf"([0-9](?<!{_W}[0-9])[0-9]*)"
    out = F.regexp_replace(fold(text), rf"{number}\s*(?:(l)(?:itros?|ts?)|(m)i(l)ilitros?|(g)ramos?)(?!{_W})", "$1$2$3$4$5")
    return plain_words(F.regexp_replace(out, rf"{number}\s*kilos?(?!{_W})", "$1kg"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(product_key(text), " "), lambda w: (F.length(w) > 1) & ~w.isin(rules.BASKET_STOP_WORDS))


def keywords(text: Column) -> Column:
    return F.filter(F.split(fold(text), " "), lambda w: (F.length(w) > 2) & ~w.isin(rules.SEARCH_STOP_WORDS))


def search_query(text: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(tokens(text), " "), F.lit("")), product_key(text))


def _synonyms(token: Column) -> Column:
    return F.try_element_at(F.create_map(*(x for k, v in rules.SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), token)


def with_synonyms(token: Column) -> Column:
    """The token and its synonyms, each once."""
    return F.array_distinct(F.concat(F.array(token), F.coalesce(_synonyms(token), F.array().cast("array<string>"))))


def _in_product(token: Column, name: Column) -> Column:
    return F.contains(name, token) | F.coalesce(F.exists(_synonyms(token), lambda s: F.contains(name, s)), F.lit(False))


def in_product(token: Column, name: Column) -> Column:
    """Whether a product's normalised name has the token or one of its synonyms."""
    return _in_product(token, name)


def relevance(query_tokens: Column, name: Column) -> Column:
    """The share of the tokens that a product's normalised name has, itself or by a synonym."""
    hits = F.size(F.filter(query_tokens, lambda t: _in_product(t, name)))
    return F.when(F.size(query_tokens) == 0, F.lit(0.0)).otherwise(hits / F.size(query_tokens))


def is_relevant(query_tokens: Column, name: Column) -> Column:
    """The first token must be there, and half of all; no tokens: everything is relevant."""
    return F.when(F.size(query_tokens) == 0, F.lit(True)).otherwise(_in_product(F.get(query_tokens, F.lit(0)), name) & (relevance(query_tokens, name) >= 0.5))


def search_score(query: Column, words: Column, name: Column) -> Column:
    """struct<score, matched, main_noun, first_keyword> of a folded name for a folded query and its keywords."""
    matched = F.size(F.filter(words, lambda w: F.contains(name, w)))
    first = F.get(F.filter(F.split(name, " "), lambda w: (F.length(w) > 1) & ~w.isin(rules.SEARCH_STOP_WORDS)), F.lit(0))
    noun = F.coalesce(F.exists(words, lambda w: F.contains(first, w)), F.lit(False))
    phrase = F.when(F.contains(name, query), 10).otherwise(0)
    place = F.when(first.isNull(), 0).when(noun, 5).otherwise(-3)
    return F.struct(
        F.when(matched == 0, 0).otherwise(3 * matched + phrase + place).alias("score"), matched.alias("matched"), noun.alias("main_noun"),
        F.coalesce(F.contains(name, F.get(words, F.lit(0))), F.lit(False)).alias("first_keyword"),
    )


def clean_description(text: Column) -> Column:
    """A statement's description without the bank's phrases, card masks, references and stray signs; 255 characters at most."""
    out = reduce(lambda c, phrase: F.regexp_replace(c, f"(?i){phrase}", ""), rules.BANK_PHRASES, text)
    for pattern, by in (
        (r"(?i)TARJ(?:ETA)?[:\s]*[#X]*[0-9]{4}", ""), (rf"(?i){EDGE}[A-Z0-9:-]{{8,}}{EDGE}", ""), (rf"{EDGE}[0-9]{{3,7}}{EDGE}", ""),
        ("[,*:-]", " "), (r"\s{2,}", " "), (r"[|\\/]{2,}", ""), ("^[^A-Za-z0-9_]+", ""), (r"^[\s ]+|[\s ]+$", ""),
    ):
        out = F.regexp_replace(out, pattern, by)
    return F.substring(out, 1, 255)


def _java(pattern: str) -> str:
    return "(?iu)" + pattern.replace(r"\b", EDGE)


def first_rule(text: Column, table: list[tuple], at: int, otherwise: str | None) -> Column:
    """Column `at` of the first rule whose pattern (column 0) the text has."""
    out = F.lit(otherwise)
    for rule in reversed(table):
        out = F.when(text.rlike(_java(rule[0])), rule[at]).otherwise(out)
    return out


def first_rule_of_long(text: Column, table: list[tuple], at: int, otherwise: str) -> Column:
    """`first_rule` for whole documents: Arrow's matcher takes a text once for each rule, whatever a rule's alternatives.

    Its word boundaries are those of ASCII words, as EDGE is.
    """
    patterns, values = [r[0] for r in table], [r[at] for r in table]

    @F.arrow_udf("string")
    def category(texts: pa.Array) -> pa.Array:
        found = [pc.match_substring_regex(texts, p, ignore_case=True) for p in patterns]
        return pc.case_when(pc.make_struct(*found, field_names=[str(i) for i in range(len(found))]), *(pa.scalar(v) for v in values), pa.array([otherwise] * len(texts), pa.string()))

    return category(text)


def upload_category(text: Column) -> Column:
    return first_rule(text, rules.UPLOAD_RULES, 1, rules.OTHER_CATEGORY)


def manual_category(text: Column) -> Column:
    return first_rule(F.lower(text), rules.MANUAL_RULES, 1, rules.OTHER_CATEGORY)


def document_category(text: Column) -> Column:
    """`upload_category` of whole documents."""
    return first_rule_of_long(text, rules.UPLOAD_RULES, 1, rules.OTHER_CATEGORY)


def manual_document_category(text: Column) -> Column:
    """`manual_category` of whole documents."""
    return first_rule_of_long(text, rules.MANUAL_RULES, 1, rules.OTHER_CATEGORY)


def merchant(text: Column) -> Column:
    """The known merchant of a description, or null."""
    return first_rule(text, rules.MERCHANTS, 1, None)


def hue(text: Column) -> Column:
    """A colour's hue in degrees by the text: a 32-bit rolling hash, its absolute value modulo 360."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    letters = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    return F.pmod(F.abs(F.aggregate(letters, F.lit(0).cast("long"), lambda h, c: wrap(F.shiftleft(h, 5)) - h + F.ascii(c))), F.lit(360))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {{name}} replaced by its value."""
    return reduce(lambda out, kv: F.replace(out, F.lit("{{" + kv[0] + "}}"), kv[1].cast("string")), values.items(), template)


def resolve(resources: Column, path: Column, values: Column | None = None) -> Column:
    """The text at a dotted path of nested resources (JSON), with each {{name}} replaced by its value of a map; the path itself where there is no text.

    A path's parts are names of objects. Without values nothing is replaced.
    """
    parts = F.transform(F.split(path, r"\."), lambda p: F.concat(F.lit("['"), p, F.lit("']")))
    found = F.try_variant_get(F.try_parse_json(resources), F.concat(F.lit("$"), F.array_join(parts, "")), "variant")
    plain = F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))
    if values is not None:
        fill = lambda out, v: F.replace(out, F.concat(F.lit("{{"), v["key"], F.lit("}}")), F.coalesce(v["value"], F.lit("null")))
        plain = F.when(plain.isNotNull(), F.coalesce(F.aggregate(F.map_entries(values), plain, fill), plain))
    return F.coalesce(plain, path)
