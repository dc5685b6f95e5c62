"""Numbers: half-up rounding, numeric prefixes, and amounts written by people and banks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(x: Column) -> Column:
    """The nearest whole number, halves towards plus infinity (-2.5 gives -2)."""
    return F.floor(x + F.lit(0.5))


def rounded(x: Column, digits: int) -> Column:
    """Halves up at a decimal place, in double arithmetic that other engines repeat exactly."""
    return half_up(x * 10**digits) / 10**digits


def number_prefix(text: Column) -> Column:
    """The number at the start of a text, as a double; null if there is none (`1.2.3` gives 1.2)."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def _first_comma_to_dot(text: Column) -> Column:
    return F.regexp_replace(text, "^([^,]*),", "$1.")


def parse_price(text: Column) -> Column:
    """A price in which dots group thousands and a comma starts the decimals; 0 if it isn't one."""
    digits = F.regexp_replace(F.regexp_replace(text, "[^0-9.,]", ""), r"\.", "")
    return F.coalesce(number_prefix(_first_comma_to_dot(digits)), F.lit(0.0))


def parse_amount(text: Column) -> Column:
    """A signed amount with either dots or commas as thousands; null if it isn't one."""
    bare = F.regexp_replace(text, r"\s", "")
    dots = bare.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})*(,[0-9]{2})?$")
    commas = bare.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]{2})?$")
    return (
        F.when(dots, number_prefix(_first_comma_to_dot(F.regexp_replace(bare, r"\.", ""))))
        .when(commas, number_prefix(F.regexp_replace(bare, ",", "")))
        .otherwise(number_prefix(_first_comma_to_dot(bare)))
    )


def parse_deposit(text: Column) -> Column:
    """A deposit as typed: dots dropped, comma as the decimal point."""
    return number_prefix(_first_comma_to_dot(F.regexp_replace(text, r"\.", "")))


def discount_percent(price: Column, list_price: Column) -> Column:
    return F.when(list_price > price, half_up((1 - price / list_price) * 100))


def lenient_limit(text: Column) -> Column:
    """How many rows a limit as typed leaves: null (all) if it is empty or no number, else its whole part; negative ones count from the end."""
    bare = F.trim(text)
    number = bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    whole = F.regexp_extract(bare, "^[+-]?[0-9]+", 0).try_cast("long")  # `1e2` starts with 1, `.5` with no digit
    return F.when(number, F.coalesce(whole, F.lit(0)))
