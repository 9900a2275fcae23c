"""Tables in files: Parquet, CSV of unknown dialect, JSON, GeoJSON, yearly registries, sheets with headers somewhere."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import nulls, order

# The canonical columns of a registry.
REGISTRY = ["settlement_id", "settlement_name", "postal_codes", "district_id", "district_name", "county_id", "county_name", "nuts3_code", "nuts2_code"]


class SchemaDriftError(ValueError):
    """A file lacks what it must have."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def optional(spark: SparkSession, path: str, **options: str) -> DataFrame | None:
    """A CSV table, or None where there is no such path in whatever store it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.options(header="true", **options).csv(path) if exists else None


def text_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, missing ones empty."""
    return spark.read.options(header="true", sep=sep, encoding=encoding, inferSchema="false").csv(path).na.fill("")


def sniff(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-2", "windows-1250"), seps: tuple[str, ...] = (";", ",", "\t")) -> DataFrame:
    """The first of encodings and separators under which the header has more than one column; only headers are read for that."""
    for encoding in encodings:
        for sep in seps:
            df = spark.read.options(header="true", sep=sep, encoding=encoding, inferSchema="false").csv(path)
            if len(df.columns) > 1 and not any("�" in c for c in df.columns):
                return df
    raise SchemaDriftError(f"no dialect gives {path} more than one column")


def canonical_registry(df: DataFrame) -> DataFrame:
    """Canonical columns as trimmed text, settlements' ids with leading zeros up to five digits; absent columns are empty."""
    if lacking := [c for c in ("settlement_id", "district_id", "county_id") if c not in df.columns]:
        raise SchemaDriftError(f"a registry without {lacking}")
    out = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit("") for c in REGISTRY]
    return df.select(*[x.alias(c) for x, c in zip(out, REGISTRY, strict=True)]).withColumn("settlement_id", nulls.zero_filled("settlement_id", 5))


def workbook_registry(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """A registry under other headers: five-digit settlements only, no pseudo-districts, no county 00, one row for each settlement."""
    renamed = canonical_registry(df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns}))
    digits = renamed.withColumns({"settlement_id": F.regexp_replace("settlement_id", r"\D", ""), "district_id": nulls.zero_filled(F.regexp_replace("district_id", r"\D", ""), 3), "county_id": nulls.zero_filled(F.regexp_replace("county_id", r"\D", ""), 2)})
    good = digits.where(F.col("settlement_id").rlike(r"^\d{5}$") & ~F.col("district_id").isin("999", "000") & (F.col("county_id") != "00"))
    k = F.row_number().over(W.partitionBy("settlement_id").orderBy(*[F.col(c) for c in REGISTRY[1:]]))
    return good.withColumn("__k", k).where("__k = 1").drop("__k")


def vintages(paths: DataFrame) -> DataFrame:
    """year and path: of each year registry_<year>.csv, else the workbook of that year."""
    name = F.element_at(F.split("path", "/"), -1)
    csv, book = F.regexp_extract(name, r"^registry_(\d{4})\.csv$", 1), F.regexp_extract(name, r"megnevezesekkel.*?(\d{4})\.xlsx$", 1)
    rows = paths.select("path", F.coalesce(F.nullif(csv, F.lit("")), F.nullif(book, F.lit(""))).cast("int").alias("year"), (csv == "").cast("int").alias("rank")).where("year IS NOT NULL")
    return rows.groupBy("year").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def header_row(sheet: DataFrame, tokens: list[str], most: int = 15, line: str = "line") -> DataFrame:
    """sheet, line: of each sheet the first of `most` rows that holds all tokens in its cells, whatever their case."""
    cells = [c for c in sheet.columns if c not in ("sheet", line)]
    joined = F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in cells]))
    hit = reduce(lambda a, b: a & b, [F.contains(joined, F.lit(t.lower())) for t in tokens])
    return sheet.where((F.col(line) < most) & hit).groupBy("sheet").agg(F.min(line).alias(line))


def renamed_by(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns renamed by the first text of the mapping that their names contain; a new name is given once."""
    out: dict[str, str] = {}
    for c in df.columns:
        new = next((v for k, v in mapping.items() if k.lower() in c.lower() and v not in out.values()), None)
        if new:
            out[c] = new
    return df.withColumnsRenamed(out)


def filled_down(df: DataFrame, column: str, line: str, group: list[str]) -> DataFrame:
    """Blank cells take what last stood above them; a file may be of any length (order.filled_forward)."""
    return order.filled_forward(df.withColumn(column, F.when(~nulls.blank(column), F.col(column))), column, group, [F.col(line)])


def sections(df: DataFrame, first: str, cells: list[str], line: str, group: list[str], out: str = "section") -> DataFrame:
    """Rows with the heading they stand under: a row that has a first cell and no other is the heading of what follows, and goes."""
    alone = reduce(lambda a, b: a & b, [nulls.blank(F.col(f"`{c}`")) for c in cells])
    heading = alone & ~nulls.blank(first)
    marked = df.withColumns({out: F.when(heading, F.trim(first)), "__heading": heading})
    return order.filled_forward(marked, out, group, [F.col(line)]).where("NOT __heading").drop("__heading")


def sectioned_years(df: DataFrame, first: str, line: str, group: list[str], value: str = "value") -> DataFrame:
    """group, section, first, year, value of a table whose columns are years and whose rows stand under headings."""
    years = [c for c in df.columns if re.fullmatch(r"(?:19|20)\d\d", c)]
    rows = sections(df, first, years, line, group)
    return years_long(rows, [*group, "section", first], value)


def months_long(df: DataFrame, year: str, line: str, months: dict[str, int], group: list[str], value: str = "value") -> DataFrame:
    """group, year, month, value of a table with a column for each month whose year stands in its first row only."""
    rows = filled_down(df, year, line, group).withColumn(year, F.regexp_extract(F.col(year).cast("string"), r"(\d{4})", 1).try_cast("int"))
    long = rows.select(*group, year, *[nulls.number(F.col(f"`{c}`")).alias(c) for c in months]).unpivot([*group, year], list(months), "month", value)
    number = reduce(lambda a, m: F.when(F.col("month") == m, F.lit(months[m])).otherwise(a), months, F.lit(None).cast("int"))
    return long.withColumn("month", number).where(F.col(year).isNotNull() & F.col(value).isNotNull())


def years_long(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Columns whose names are years, as rows of keys, year, value; cells that aren't numbers go."""
    years = [c for c in df.columns if re.fullmatch(r"(?:19|20)\d\d", c)]
    long = df.select(*keys, *[nulls.number(F.col(f"`{y}`")).alias(y) for y in years]).unpivot(keys, years, "year", value)
    return long.withColumn("year", F.col("year").cast("int")).where(F.col(value).isNotNull())


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def geo_features(documents: DataFrame, column: str = "json") -> DataFrame:
    """name, osm_id, geometry_type of each feature of GeoJSON documents."""
    schema = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string>>>"
    f = documents.select(F.explode(F.from_json(column, schema)["features"]).alias("f"))
    p = F.col("f.properties")
    return f.select(p["name"].alias("name"), F.coalesce(p["osm_id"], p["@id"], F.col("f.id")).alias("osm_id"), F.col("f.geometry.type").alias("geometry_type"))


def pages_of(ranges: str) -> set[int] | None:
    """1-3,5 as {1, 2, 3, 5}; all as None."""
    if ranges.strip().lower() == "all":
        return None
    ends = [[int(x) for x in part.split("-")] for part in ranges.split(",") if part.strip()]
    return {n for e in ends for n in range(e[0], e[-1] + 1)}


def first_passing(candidates: DataFrame) -> DataFrame:
    """file, strategy, table: of each file the passing candidate of the first strategy. candidates: file, strategy, rank, table, passes."""
    return candidates.where("passes").groupBy("file").agg(F.min_by(F.struct("strategy", "table"), F.struct("rank", "table")).alias("c")).select("file", "c.strategy", "c.table")


def keep_latest(rows: DataFrame, keys: list[str], when: str) -> DataFrame:
    """A registry of downloads: the last row of each key."""
    k = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(when)))
    return rows.withColumn("__k", k).where("__k = 1").drop("__k")


def to_fetch(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Resources whose address and hash no registry row has."""
    return wanted.join(have.select("url", "sha256").distinct(), ["url", "sha256"], "left_anti")
