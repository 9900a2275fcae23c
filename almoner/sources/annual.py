"""Yearly tables of sheets and reports: national diseases, counties, the annex of a decree.

All take rows as the workbook source gives them, or a PDF reader would: path, sheet, line, cells. What can't be read is
queued with a reason and never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls, text

# How headers of diseases begin, without accents, and what they are called here.
DISEASES = {
    "rotavirus": "rotavirus",
    "baranyhimlo": "varicella",
    "jarvanyos fultomirigy gyulladas": "mumps",
    "fertozo majgyulladas": "hepatitis_a",
    "vorheny": "scarlet_fever",
    "szalmonellozis": "salmonellosis",
    "campylobakteriozis": "campylobacteriosis",
    "lyme kor": "lyme",
}
# The columns of the decree's annex.
ANNEX = ["idx", "region", "county_name", "district_name", "population", "development", "rank", "beneficiary", "to_develop", "complex_program"]
SHEET = ["path", "sheet"]


def digits(x: Column) -> Column:
    """All digits of a cell as one number; NULL without any."""
    return text.digits_number(F.coalesce(x, F.lit("")))


def disease_of(header: Column, names: dict[str, str]) -> Column:
    """The name of the first beginning that a header has; NULL if it has none."""
    plain, out = text.plain_name(header), F.lit(None).cast("string")
    for beginning, name in reversed(list(names.items())):
        out = F.when(F.startswith(plain, F.lit(beginning)), F.lit(name)).otherwise(out)
    return out


def _columns(rows: DataFrame, header: int, names: dict[str, str]) -> DataFrame:
    """path, sheet, place, disease of the header line's cells; of several columns of a disease the last counts."""
    cells = rows.where(F.col("line") == header).select(*SHEET, F.posexplode("cells").alias("place", "head"))
    named = cells.withColumn("disease", disease_of(F.col("head"), names)).where("disease IS NOT NULL")
    return named.groupBy(*SHEET, "disease").agg(F.max("place").alias("place"))


def national(rows: DataFrame, header: int = 1, must: str = "rotavirus", names: dict[str, str] = DISEASES, first: int = 1990, last: int = 2035) -> DataFrame:
    """path, sheet, year, disease, cases below a header line. A row's year is its first cell's digits, within bounds; years in which `must` is unknown go."""
    below = rows.where(F.col("line") > header).withColumn("year", digits(F.get("cells", F.lit(0)))).where(F.col("year").between(first, last))
    long = below.join(_columns(rows, header, names), SHEET).select(*SHEET, "line", F.col("year").cast("int").alias("year"), "disease", digits(F.get("cells", "place")).alias("cases"))
    known = long.where((F.col("disease") == must) & F.col("cases").isNotNull()).select(*SHEET, "line")
    return long.where("cases IS NOT NULL").join(known, [*SHEET, "line"], "left_semi").drop("line")


def counties(rows: DataFrame, names: DataFrame, header: int = 0, disease: str = "rotavirus", least: int = 15) -> tuple[DataFrame, DataFrame]:
    """path, county_id, year, cases of tables with a row for each county; and path, reason of the tables that are queued for a person.

    names: name and county_id, a row for each spelling of each county. The year stands in the file's name behind `osap_`. A
    table needs a column of the disease and at least `least` rows of counties. A cell of a dash is 0; one that is no number is unknown, and
    its row goes.
    """
    year = F.regexp_extract("path", r"osap_(\d{4})", 1).try_cast("int")
    at = _columns(rows, header, {disease: disease}).select(*SHEET, "place")
    known = names.select(text.county_name("name").alias("__n"), "county_id").where("__n <> ''").distinct()
    below = rows.where(F.col("line") > header).withColumn("__n", text.county_name(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))))
    met = below.join(known, "__n").join(at, SHEET, "left").select(*SHEET, "line", "county_id", year.alias("year"), "place", text.cell_number(F.get("cells", F.coalesce("place", F.lit(-1)))).alias("cases"))
    tables = rows.select(*SHEET).distinct().join(met.groupBy(*SHEET).agg(F.count("*").alias("n")), SHEET, "left").join(at, SHEET, "left")
    reason = F.when(F.col("place").isNull(), F.lit(f"no column of {disease}")).when(F.coalesce("n", F.lit(0)) < least, F.concat(F.lit("rows of counties: "), F.coalesce("n", F.lit(0)).cast("string")))
    judged = tables.withColumn("reason", reason)
    good = met.join(judged.where("reason IS NULL").select(*SHEET), SHEET, "left_semi").where("cases IS NOT NULL")
    return good.select(*SHEET, "county_id", "year", "cases"), judged.where("reason IS NOT NULL").select(*SHEET, "reason")


def observed(good: DataFrame, names: DataFrame, source_id: str = "nngyk") -> DataFrame:
    """County totals as rows of the surveillance table: yearly, observed, of their file."""
    day = lambda m, d: F.make_date("year", F.lit(m), F.lit(d))
    return good.join(names, "county_id").select(
        F.lit("county").alias("geo_level"), "geo_name", F.lit("rotavirus_cases_annual").alias("variable"), F.col("cases").cast("double").alias("value"), F.col("year").alias("iso_year"), F.lit(None).cast("int").alias("iso_week"),
        day(1, 1).alias("period_start"), day(12, 31).alias("period_end"), F.lit("observed").alias("evidence_class"), F.lit(source_id).alias("source_id"), F.element_at(F.split("path", "/"), -1).alias("source_file"), F.lit("").alias("quality_flag"),
    )


def cross_check(weekly: DataFrame, annual: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """county_id, year, weekly, annual, difference, agrees: sums of weeks beside the yearly count; a side that is missing is NULL and doesn't agree."""
    sums = weekly.groupBy("county_id", F.col("iso_year").cast("int").alias("year")).agg(F.sum(nulls.number("value")).alias("weekly"))
    given = annual.groupBy("county_id", F.col("year").cast("int").alias("year")).agg(F.sum("cases").cast("double").alias("annual"))
    both = sums.join(given, ["county_id", "year"], "full").withColumn("difference", F.col("weekly") - F.col("annual"))
    return both.withColumn("agrees", F.coalesce(F.abs("difference") <= tolerance, F.lit(False)))


def annex(rows: DataFrame, header: int = 0, least: int = 9) -> DataFrame:
    """The decree's districts: names, people, the development indicator (decimal comma), rank, and three flags of 0 or 1.

    Of each path the sheet, or table, of the most rows counts that has at least `least` cells in its header; sums go.
    """
    sizes = rows.groupBy(*SHEET).agg(F.count("*").alias("n"), F.max(F.when(F.col("line") == header, F.size("cells"))).alias("width")).where(F.col("width") >= least)
    chosen = sizes.groupBy("path").agg(F.max_by("sheet", F.struct("n", "sheet")).alias("sheet"))
    body = rows.where(F.col("line") > header).join(chosen, SHEET, "left_semi")
    raw = body.select("path", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(ANNEX)])
    named = raw.where(~nulls.blank("district_name") & ~F.contains(F.lower("district_name"), F.lit("összesen")))
    flag = lambda c: F.least(F.greatest(F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).cast("int")
    number = F.replace(F.regexp_replace(F.coalesce("development", F.lit("")), r"[^\d,.\-]", ""), F.lit(","), F.lit(".")).try_cast("double")
    made = {"population": digits(F.col("population")), "development": number, "rank": digits(F.col("rank"))} | {c: flag(F.col(c)) for c in ANNEX[7:]}
    return named.withColumns(made).drop("idx")


def annex_of(annex_rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The annex with district_id, by what a crosswalk or `closest` has found for its names (name, district_id); and the names without one."""
    met = annex_rows.join(found.select(F.col("name").alias("district_name"), "district_id"), "district_name", "left")
    good = met.where("district_id IS NOT NULL").withColumn("district_id", nulls.zero_filled("district_id", 3))
    return good, met.where("district_id IS NULL").select("district_name").distinct()
