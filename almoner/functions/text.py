"""Names, numbers in cells, and similarity of names."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nulls import col, zero_filled

# Accented letters and what they are without accents.
ACCENTED = "áàâäãéèêëíìîïóòôöõőúùûüűçñÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕŐÚÙÛÜŰÇÑ"
PLAIN = "aaaaaeeeeiiiioooooouuuuucnAAAAAEEEEIIIIOOOOOOUUUUUCN"
# Words that don't tell a unit apart.
DROPPED = ("nagyközség", "község", "megyei jogú város", "fővárosi kerület", "város", "járás")
# Numbers of districts in Roman numerals.
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx", "xxi", "xxii", "xxiii"]


def without_accents(x: Column | str) -> Column:
    return F.translate(col(x), ACCENTED, PLAIN)


def one_space(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", " ")


def normalised_name(x: Column | str, dropped: Iterable[str] = DROPPED, accents: bool = True) -> Column:
    """Lower case, single blanks, without the dropped words wherever they stand, without marks at the ends."""
    out = one_space(F.lower(col(x)))
    for word in dropped:
        out = F.replace(out, F.lit(word), F.lit(""))
    out = F.btrim(one_space(out), F.lit(" -,."))
    return out if accents else without_accents(out)


def plain_name(x: Column | str) -> Column:
    """Lower case, no accents, marks as blanks, single blanks."""
    return F.trim(one_space(F.regexp_replace(without_accents(F.lower(col(x))), r"[^a-z0-9]+", " ")))


def county_name(x: Column | str) -> Column:
    """A county's name without the words for county and capital."""
    return F.trim(one_space(F.regexp_replace(plain_name(x), r"\b(?:varmegye|megye|fovaros)\b", " ")))


def settlement_name(x: Column | str) -> Column:
    """A settlement's name; districts of the capital, however numbered, as `budapest NN`."""
    plain = plain_name(x)
    digits = F.regexp_extract(plain, r"^budapest (\d{1,2})\b", 1)
    roman = F.regexp_extract(plain, r"^budapest ([ivx]+)\b", 1)
    number = F.lit(None).cast("string")
    for i, r in enumerate(ROMAN, 1):
        number = F.when(roman == r, F.lit(str(i))).otherwise(number)
    number = F.coalesce(F.nullif(digits, F.lit("")), number)
    return F.when(number.isNotNull(), F.concat(F.lit("budapest "), zero_filled(number, 2))).otherwise(plain)


def cell_number(x: Column | str) -> Column:
    """A table cell as a whole number: a dash is 0, blanks within are removed, anything else unknown is NULL."""
    t = F.trim(F.translate(col(x).cast("string"), "  ", "  "))
    packed = F.regexp_replace(t, r"\s", "")
    return F.when(t.isin("-", "–", "—"), F.lit(0).cast("long")).when(packed.rlike(r"^-?\d+$"), packed.try_cast("long"))


def digits_number(x: Column | str) -> Column:
    """The digits of a text as one whole number; NULL if there are none."""
    return F.regexp_replace(col(x).cast("string"), r"[^0-9]", "").try_cast("long")


def comma_number(x: Column | str) -> Column:
    """A number with a decimal comma."""
    return F.replace(F.regexp_replace(col(x).cast("string"), r"\s", ""), F.lit(","), F.lit(".")).try_cast("double")


def localised(x: Column | str, digits: int = 2) -> Column:
    """1,234.56 as 1\\,234{,}56."""
    return F.replace(F.replace(F.replace(F.format_number(col(x), digits), F.lit("."), F.lit("{;}")), F.lit(","), F.lit("\\,")), F.lit("{;}"), F.lit("{,}"))


def sorted_tokens(x: Column | str) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(one_space(F.lower(col(x)))), " ")), " ")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, 0 to 100; Levenshtein distance is not the same measure."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else 100 * SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
