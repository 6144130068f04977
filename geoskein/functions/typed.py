"""Guarded casts and token parses: text in, typed values or NULL out, never an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns a text must match as a whole before it is cast.
INTEGER = "[0-9]+"
NUMBER = "[0-9]+([.][0-9]+)?"
SIGNED_NUMBER = "-?[0-9]+([.][0-9]+)?"
DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
CURRENCY = "[$]([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]{2})?"
TRUE_TOKENS = ("t", "true", "yes")
FALSE_TOKENS = ("f", "false", "no")


def matches(value: Column, pattern: str) -> Column:
    """Whether the whole text matches; a line break at the end is not ignored."""
    return value.rlike(rf"\A(?:{pattern})\z")


def guarded(value: Column, pattern: str, kind: str) -> Column:
    return F.when(matches(value, pattern), value.try_cast(kind))


def integer(value: Column, kind: str = "int") -> Column:
    return guarded(value, INTEGER, kind)


def number(value: Column) -> Column:
    return guarded(value, NUMBER, "double")


def coordinate(value: Column) -> Column:
    return guarded(value, SIGNED_NUMBER, "double")


def date(value: Column) -> Column:
    """Dates that do not exist in the calendar give NULL as well."""
    return guarded(value, DATE, "date")


def currency(value: Column) -> Column:
    """``$1,234.00`` to decimal(14,2); amounts that do not fit give NULL."""
    return F.when(matches(value, CURRENCY), F.translate(value, "$,", "").try_cast("decimal(14,2)"))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def log_positive(value: Column) -> Column:
    return F.when(value > 0, F.log(value.cast("double")))


def log1p_nonnegative(value: Column) -> Column:
    return F.when(value >= 0, F.log1p(value.cast("double")))


def boolean_token(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin(*TRUE_TOKENS), True).when(low.isin(*FALSE_TOKENS), False)


def fallback_number(structured: Column, text: Column) -> tuple[Column, Column, Column]:
    """(value, provenance, disagree): the structured number, else the first number of the text, else half for 'half'."""
    given = number(structured)
    found = F.nullif(F.regexp_extract(text, r"([0-9]+(?:[.][0-9]+)?)", 1), F.lit("")).try_cast("double")
    half = F.when(text.rlike("(?i)half-bath"), F.lit(0.5))
    from_text = F.coalesce(found, half)
    value = F.coalesce(given, from_text)
    provenance = F.when(given.isNotNull(), "structured").when(found.isNotNull(), "text_number").when(half.isNotNull(), "text_half").otherwise("missing")
    return value, provenance, F.coalesce(given != from_text, F.lit(False))


def loose_number(value: Column) -> Column:
    """Everything but digits, sign and point dropped, then cast."""
    return F.regexp_replace(value, r"[^0-9.\-]", "").try_cast("double")


def first_number(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"[-+]?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def json_has_token(array_text: Column, token: str) -> Column:
    """Exact membership in a JSON array of texts; NULL where the source is NULL or malformed."""
    return F.array_contains(F.from_json(array_text, "array<string>"), token)


def aliased(value: Column, aliases: Mapping[str, str]) -> Column:
    """The alias of the value, or the value."""
    if not aliases:
        return value
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


def code_prefix(value: Column) -> Column:
    return F.substring_index(value, " ", 1)


def padded_key(prefix: str, number_: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number_.cast("string"), width, "0"))


def quarter_start(value: Column) -> Column:
    """``2026Q1`` to the first day of the quarter; other texts give NULL."""
    year = F.regexp_extract(value, r"\A([0-9]{4})Q([1-4])\z", 1).try_cast("int")
    quarter = F.regexp_extract(value, r"\A([0-9]{4})Q([1-4])\z", 2).try_cast("int")
    return F.when(year.isNotNull() & quarter.isNotNull(), F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1)))


def ordered_rule(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds; rules that are NULL do not hold."""
    out = None
    for condition, label in rules:
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))
