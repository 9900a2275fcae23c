"""What sources' tables and texts mean: surveillance weeks, practices, prices, amounts, decrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, nulls, text


def week_of_file(df: DataFrame, name: str = "file") -> DataFrame:
    """iso_year, iso_week and bounds from a file's name; archive_only before 2014."""
    y = F.regexp_extract(name, r"(20\d\d)[^0-9]{0,3}(\d{1,2})", 1).try_cast("int")
    w = F.regexp_extract(name, r"(20\d\d)[^0-9]{0,3}(\d{1,2})", 2).try_cast("int")
    start = dates.iso_monday(y, w)
    return df.withColumns({"iso_year": y, "iso_week": w, "period_start": start, "period_end": F.date_add(start, 6), "archive_only": y < 2014})


def county_rows(cells: DataFrame, counties: DataFrame) -> DataFrame:
    """Rows of a table that name a county by its name or an alias: file, county_id, geo_name, value. counties: county_id, geo_name, alias."""
    names = counties.select("county_id", "geo_name", text.plain_name("alias").alias("__k")).dropDuplicates(["__k"])
    return cells.withColumn("__k", text.plain_name("label")).join(F.broadcast(names), "__k").select("file", "county_id", "geo_name", text.cell_number("cell").cast("double").alias("value"))


def agreed(rows: DataFrame, controls: DataFrame, tolerance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): rows of files whose county sum meets the table's total and the national value, and the others with a reason."""
    sums = rows.groupBy("file").agg(nulls.total("value").alias("__sum"))
    checked = sums.join(controls, "file", "left")
    off = lambda c: F.col(c).isNotNull() & (F.abs(F.col("__sum") - F.col(c)) > tolerance)
    reason = F.when(off("total"), "total").when(off("national"), "national")
    verdict = checked.select("file", reason.alias("reason"))
    both = rows.join(verdict, "file")
    return both.where("reason IS NULL").drop("reason"), both.where("reason IS NOT NULL")


def structure(cells: DataFrame, least_counties: int = 18, least_rows: int = 18, least_columns: int = 3) -> DataFrame:
    """file, passes: enough columns, rows and named counties, and a column of the disease. cells: file, n_columns, is_county, has_disease."""
    return cells.groupBy("file").agg((F.max("n_columns") >= least_columns).alias("a"), (F.count("*") >= least_rows).alias("b"), (F.count_if("is_county") >= least_counties).alias("c"), F.coalesce(F.max("has_disease"), F.lit(False)).alias("d")).select("file", (F.col("a") & F.col("b") & F.col("c") & F.col("d")).alias("passes"))


def national_value(lines: DataFrame, label: str) -> DataFrame:
    """file, national: the first number behind the label."""
    x = F.regexp_extract(F.lower("line"), rf"{label.lower()}\D*?(\d+(?:\s\d{{3}})*)", 1)
    return lines.where(x != "").groupBy("file").agg(F.min(F.struct("line_no", text.digits_number(x).alias("n"))).alias("f")).select("file", F.col("f.n").alias("national"))


def valid_rows(df: DataFrame) -> DataFrame:
    """rule, n_rows: negatives, records before the break, district level, repeated keys; one pass, and one for the keys."""
    marks = df.agg(F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.col("period_start") < F.lit("2014-01-01").cast("date")).alias("before_break"), F.count_if(F.col("geo_level") == "district").alias("district_level"))
    repeated = df.groupBy("geo_name", "variable", "period_start").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_key"))
    return marks.crossJoin(repeated).unpivot([], ["negative", "before_break", "district_level", "duplicate_key"], "rule", "n_rows")


def footers_removed(df: DataFrame, column: str) -> DataFrame:
    """Without blank rows, totals, remarks and sources."""
    return df.where(~nulls.blank(column) & ~F.lower(F.trim(column)).rlike(r"^(?:összesen|mindösszesen|megjegyzés|forrás|\*)"))


# Kinds of practices.
PRACTICES = {"gyermek": "paediatric", "felnőtt": "adult", "vegyes": "mixed", "fogorvosi": "dental"}


def practices(df: DataFrame) -> DataFrame:
    """Rows with a four-digit postal code; the kind by its word; exact copies once."""
    kind = F.lit("other")
    for k, v in reversed(PRACTICES.items()):
        kind = F.when(F.contains(F.lower("practice_type_raw"), F.lit(k)), F.lit(v)).otherwise(kind)
    code = F.regexp_extract("postal_code", r"(\d{4})", 1)
    return df.withColumns({"postal_code": code, "practice_type": kind}).where(F.col("postal_code") != "").distinct()


def first_of_month(snapshots: DataFrame, when: str = "ts", group: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """The first snapshot of each month."""
    k = F.row_number().over(W.partitionBy(*(group or []), F.date_trunc("month", when)).orderBy(when, *([tie] if tie else [])))
    return snapshots.withColumn("__k", k).where("__k = 1").drop("__k")


def disease_row(rows: DataFrame, token: str) -> DataFrame:
    """file, ordinal, cell: the cells of each file's first row with the token in any cell. rows: file, line, cells."""
    hit = F.exists("cells", lambda x: F.contains(F.lower(x), F.lit(token.lower())))
    first = rows.where(hit).groupBy("file").agg(F.min_by("cells", "line").alias("cells"))
    return first.select("file", F.posexplode("cells").alias("ordinal", "cell"))


def price_index(rows: DataFrame) -> DataFrame:
    """year from the first cell, index from the first number of the others."""
    year = F.regexp_extract(F.element_at("cells", 1), r"\b((?:19|20)\d\d)\b", 1)
    numbers = F.filter(F.transform(F.slice("cells", 2, 1000), text.comma_number), lambda x: x.isNotNull())
    return rows.where((year != "") & (F.size(numbers) > 0)).select(year.cast("int").alias("year"), F.element_at(numbers, 1).alias("index_value"))


AMOUNT = r"(\d{1,3}(?:[ .\x{A0}]\d{3})+|\d+)\s*(?:Ft|forint|HUF)\b"


def amounts(df: DataFrame, key: str, column: str, low: int = 1000, high: int = 200_000) -> DataFrame:
    """key, candidates (distinct, ascending) and most: all amounts of money in a text between low and high."""
    found = F.filter(F.transform(F.regexp_extract_all(F.col(column), F.lit(AMOUNT), F.lit(1)), text.digits_number), lambda x: x.between(low, high))
    return df.select(key, F.array_sort(F.array_distinct(found)).alias("candidates")).withColumn("most", F.when(F.size("candidates") > 0, F.array_max("candidates")))


def amount_contexts(df: DataFrame, key: str, column: str, keywords: dict[str, str], before: int = 120, behind: int = 40) -> DataFrame:
    """key, parameter_id, amount: amounts with a keyword within so many characters before or behind.

    The text is split at amounts; a piece's end is what stands before, the next one's beginning what stands behind.
    """
    x = df.select(key, F.split(F.col(column), AMOUNT).alias("__parts"), F.regexp_extract_all(F.col(column), F.lit(AMOUNT), F.lit(1)).alias("__a"))
    at = x.select(key, "__parts", F.posexplode("__a").alias("i", "__amount"))
    near = F.lower(F.concat_ws(" ", F.right(F.get("__parts", F.col("i")), F.lit(before)), F.left(F.get("__parts", F.col("i") + 1), F.lit(behind))))
    which = F.lit(None).cast("string")
    for k, v in reversed(keywords.items()):
        which = F.when(F.contains(near, F.lit(k.lower())), F.lit(v)).otherwise(which)
    return at.select(key, which.alias("parameter_id"), text.digits_number("__amount").alias("amount")).where("parameter_id IS NOT NULL")


def decree_lines(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, district_name, value: lines `… járás` with a number of decimal comma behind."""
    line = df.select(key, F.explode(F.split(column, "\n")).alias("line"))
    pattern = r"^\s*(.*?járás)\D*?(\d+(?:,\d+)?)"
    return line.where(F.col("line").rlike(pattern)).select(key, F.trim(F.regexp_extract("line", pattern, 1)).alias("district_name"), text.comma_number(F.regexp_extract("line", pattern, 2)).alias("value"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those whose key is new, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def column_with(df: DataFrame, *tokens: str) -> str | None:
    """The first column whose name holds all tokens."""
    return next((c for c in df.columns if all(t.lower() in c.lower() for t in tokens)), None)


def foia(df: DataFrame) -> DataFrame:
    """District counts from an information request: columns found by their names, weeks dated, unknown values gone."""
    names = {"geo_name": column_with(df, "járás") or column_with(df, "jaras"), "iso_year": column_with(df, "év") or column_with(df, "ev"), "iso_week": column_with(df, "hét") or column_with(df, "het"), "value": column_with(df, "eset")}
    if lacking := [k for k, v in names.items() if v is None]:
        raise ValueError(f"no column for {lacking}")
    x = df.select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()])
    start = dates.iso_monday(F.col("iso_year").try_cast("int"), F.col("iso_week").try_cast("int"))
    return x.select("geo_name", F.col("iso_year").try_cast("int").alias("iso_year"), F.col("iso_week").try_cast("int").alias("iso_week"), nulls.number("value").alias("value"), start.alias("period_start"), F.lit("district").alias("geo_level"), F.lit("observed").alias("evidence_class"), F.lit("nngyk_foia").alias("source_id")).where("value IS NOT NULL")
