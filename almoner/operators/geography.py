"""Registries of units with yearly vintages: consistency, validity, changes, apportionment, name matching."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import nulls, order, text


def consistency(registry: DataFrame, expected_counties: int | None = None) -> DataFrame:
    """rule, unit: repeated settlements, districts of two counties, blank districts, and the count of counties if not as expected."""
    by = ["vintage"] if "vintage" in registry.columns else []
    repeated = registry.groupBy(*by, "settlement_id").count().where("count > 1").select(F.lit("duplicate_settlement").alias("rule"), F.col("settlement_id").cast("string").alias("unit"))
    spread = registry.groupBy(*by, "district_id").agg(F.countDistinct("county_id").alias("n")).where("n > 1").select(F.lit("district_in_several_counties"), F.col("district_id").cast("string"))
    empty = registry.where(nulls.blank("district_id")).select(F.lit("blank_district"), F.col("settlement_id").cast("string"))
    out = repeated.union(spread).union(empty)
    if expected_counties is not None:
        counted = registry.groupBy(*by).agg(F.countDistinct("county_id").alias("n")) if by else registry.agg(F.countDistinct("county_id").alias("n"))
        out = out.union(counted.where(F.col("n") != expected_counties).select(F.lit("county_count"), F.col("n").cast("string")))
    return out


def intervals(rows: DataFrame, unit: str, keys: list[str], vintage: str = "vintage", tie: str | None = None) -> DataFrame:
    """unit, keys, valid_from, valid_to: one row for each unbroken run of vintages in which the keys don't change.

    valid_from is January 1 of the run's first vintage; valid_to that of the vintage after its last one, NULL if that is
    the latest of all. A unit that is absent from a vintage begins anew when it comes back. Of rows that repeat a unit and
    vintage the first counts.
    """
    vintages = rows.select(vintage).distinct()
    # vintages are few: years
    order = vintages.select(F.col(vintage).alias("__v"), F.row_number().over(W.orderBy(vintage)).alias("__i"), F.lead(vintage).over(W.orderBy(vintage)).alias("__next"))
    first = F.row_number().over(W.partitionBy(unit, vintage).orderBy(*([tie] if tie else []), *keys))
    once = rows.withColumn("__k", first).where("__k = 1").drop("__k").join(F.broadcast(order), F.col(vintage) == F.col("__v"))
    w = W.partitionBy(unit).orderBy("__i")
    same = (F.lag("__i").over(w) == F.col("__i") - 1) & F.lag("__sig").over(w).eqNullSafe(F.col("__sig"))
    marked = once.withColumn("__sig", F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))).withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    january = lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(1))
    return runs.groupBy(unit, "__run").agg(*[F.min_by(k, "__i").alias(k) for k in keys], january(F.min(vintage)).alias("valid_from"), january(F.max_by("__next", "__i")).alias("valid_to")).drop("__run")


def registry(per_year: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settlements and districts with their validity; districts of county 01 are the capital's."""
    settlements = intervals(per_year, "settlement_id", ["settlement_name", "postal_codes", "district_id", "county_id"])
    units = per_year.where(~nulls.blank("district_id")).groupBy("vintage", "district_id").agg(*[F.min(k).alias(k) for k in ("district_name", "county_id", "county_name", "nuts3_code", "nuts2_code")])
    districts = intervals(units, "district_id", ["district_name", "county_id", "county_name", "nuts3_code", "nuts2_code"])
    return settlements, districts.withColumn("is_budapest_district", F.col("county_id") == "01")


def write_registry(per_year: DataFrame, path: str) -> dict[str, int]:
    """Settlements, districts and boundary changes as tables under a folder; how many rows each has."""
    settlements, districts = registry(per_year)
    changes = boundary_changes(per_year.select("settlement_id", "district_id", "vintage"))
    out = {}
    for name, df in {"geo_settlements": settlements, "geo_districts": districts, "boundary_changes": changes}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        out[name] = per_year.sparkSession.read.parquet(f"{path}/{name}.parquet").count()
    return out


# Columns of the file of matches that are settled by hand.
REVIEW = ["source_id", "raw_value", "raw_kind", "candidate_district_id", "candidate_district_name", "score", "status", "reviewer", "created_at", "note"]


def manual_reviews(spark: SparkSession, path: str, kind: str = "name") -> DataFrame:
    """name (lower case), district_id, confirmed of what is settled by hand, for `crosswalk`; a pending row settles nothing.

    Lines that begin with # are remarks; rows without a value go; a row without a kind is of a name; of several rows of a
    value the last counts, by when it was written. A confirmed row without a district settles nothing.
    """
    raw = spark.read.options(header="true", comment="#", ignoreLeadingWhiteSpace="true", inferSchema="false").csv(path)
    have = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in REVIEW])
    rows = have.where(~nulls.blank("raw_value") & (F.coalesce("raw_kind", F.lit("name")) == kind))
    last = rows.groupBy(F.lower(F.trim("raw_value")).alias("name")).agg(F.max_by(F.struct("candidate_district_id", "status"), F.struct("created_at", "status", "candidate_district_id")).alias("r"))
    settled = last.where((F.col("r.status") == "rejected") | ((F.col("r.status") == "confirmed") & ~nulls.blank("r.candidate_district_id")))
    confirmed = F.col("r.status") == "confirmed"
    return settled.select("name", F.when(confirmed, F.col("r.candidate_district_id")).alias("district_id"), confirmed.alias("confirmed"))


def pending_reviews(found: DataFrame, source_id: str, note: str = "") -> DataFrame:
    """What `crosswalk` has left pending, as rows of the review file."""
    rows = found.where("status = 'pending'")
    none = F.lit("")
    made = {"source_id": F.lit(source_id), "raw_value": F.col("name"), "raw_kind": F.lit("name"), "candidate_district_id": F.coalesce("district_id", none), "candidate_district_name": none, "score": F.coalesce(F.format_number("score", 1), F.lit("0.0")), "status": F.lit("pending"), "reviewer": none, "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "note": F.lit(note)}
    return rows.select(*[made[c].alias(c) for c in REVIEW])


def boundary_changes(rows: DataFrame, unit: str = "settlement_id", parent: str = "district_id", vintage: str = "vintage") -> DataFrame:
    """change, unit, before, after, vintage: units that changed their parent, parents that appeared or went, between neighbouring vintages."""
    order = rows.select(vintage).distinct().select(F.col(vintage).alias("__v"), F.lead(vintage).over(W.orderBy(vintage)).alias("__next"), F.lag(vintage).over(W.orderBy(vintage)).alias("__prev"))
    once = rows.select(vintage, unit, parent).distinct()
    now = once.join(F.broadcast(order), F.col(vintage) == F.col("__v"))
    w = W.partitionBy(unit).orderBy(vintage)
    after = now.withColumns({"__then": F.lead(vintage).over(w), "__after": F.lead(parent).over(w)})
    moved = after.where((F.col("__then") == F.col("__next")) & ~F.col(parent).eqNullSafe(F.col("__after")))
    moved = moved.select(F.lit("settlement_reassigned").alias("change"), F.col(unit).cast("string").alias("unit"), F.col(parent).cast("string").alias("before"), F.col("__after").cast("string").alias("after"), F.col("__then").alias("vintage"))
    units = once.where(F.col(parent).isNotNull()).select(vintage, parent).distinct()
    of = W.partitionBy(parent).orderBy(vintage)
    dated = units.join(F.broadcast(order), F.col(vintage) == F.col("__v")).withColumns({"__had": F.lag(vintage).over(of), "__has": F.lead(vintage).over(of)})
    came = dated.where(F.col("__prev").isNotNull() & ~F.col("__had").eqNullSafe(F.col("__prev")))
    went = dated.where(F.col("__next").isNotNull() & ~F.col("__has").eqNullSafe(F.col("__next")))
    none = F.lit(None).cast("string")
    came = came.select(F.lit("district_created").alias("change"), F.col(parent).cast("string").alias("unit"), none.alias("before"), F.concat(F.col(parent).cast("string"), F.lit("")).alias("after"), F.col(vintage).alias("vintage"))
    went = went.select(F.lit("district_dissolved").alias("change"), F.col(parent).cast("string").alias("unit"), F.concat(F.col(parent).cast("string"), F.lit("")).alias("before"), none.alias("after"), F.col("__next").alias("vintage"))
    return moved.union(came).union(went)


def common_parts(rows: DataFrame, unit: str = "settlement_id", parent: str = "district_id", vintage: str = "vintage") -> DataFrame:
    """unit, part: units with the same parent in every vintage (NA where absent) are one part, KTE0001 on in order of their least unit."""
    vintages = rows.select(vintage).distinct()
    every = rows.select(unit).distinct().crossJoin(F.broadcast(vintages))  # vintages are few
    filled = every.join(rows.select(unit, vintage, parent).dropDuplicates([unit, vintage]), [unit, vintage], "left")
    signed = filled.groupBy(unit).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(vintage, F.coalesce(F.col(parent).cast("string"), F.lit("NA")).alias("p"))))), 256).alias("__sig"))
    firsts = signed.groupBy("__sig").agg(F.min(unit).alias("__first"))
    names = order.numbered(firsts, [], [F.col("__first")], "__k").withColumn("part", F.format_string("KTE%04d", F.col("__k")))
    return signed.join(names.select("__sig", "part"), "__sig").select(unit, "part")


def apportion(values: DataFrame, source_of: DataFrame, target_of: DataFrame, population: DataFrame, columns: list[str], unit: str = "settlement_id") -> DataFrame:
    """Sums of a source's values on targets, by its settlements' population; equal parts where a source has none.

    A missing source value counts 0. What falls on settlements without a target is lost, and their people still count in
    the source: `lost` reports that. values: source, columns; source_of and target_of: unit, source or target.
    """
    pop = F.coalesce(F.col("population").cast("double"), F.lit(0.0))
    bridge = source_of.join(population, unit, "left").join(target_of, unit, "left").withColumn("__p", pop)
    whole, n = F.sum("__p").over(W.partitionBy("source")), F.count("*").over(W.partitionBy("source"))
    shares = bridge.withColumn("__share", F.when(whole <= 0, 1.0 / n).otherwise(F.try_divide(F.col("__p"), whole)))
    dealt = shares.join(values, "source", "left").where(F.col("target").isNotNull())
    return dealt.groupBy("target").agg(*[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.col("__share")).alias(c) for c in columns])


def lost(source_of: DataFrame, target_of: DataFrame, unit: str = "settlement_id") -> DataFrame:
    """source, n_lost: settlements that have no target."""
    return source_of.join(target_of.where(F.col("target").isNotNull()), unit, "left_anti").groupBy("source").agg(F.count("*").alias("n_lost"))


def apportion_rate(values: DataFrame, source_of: DataFrame, target_of: DataFrame, population: DataFrame, numerator: str, denominator: str, out: str = "rate") -> DataFrame:
    """A rate: numerator and denominator are apportioned together, then divided; NULL over 0."""
    both = apportion(values, source_of, target_of, population, [numerator, denominator])
    return both.select("target", nulls.ratio(numerator, denominator).alias(out))


def harmonise(values: DataFrame, source_of: DataFrame, target_of: DataFrame, population: DataFrame, extensive: dict[str, bool], unit: str = "settlement_id") -> DataFrame:
    """All columns on target units: extensive ones are summed, others are rates over population. Every target has a row."""
    pop = source_of.join(population, unit, "left").groupBy("source").agg(nulls.total("population").alias("__pop"))
    made = values.join(pop, "source", "left").withColumns({f"__n_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.col("__pop") for c, e in extensive.items() if not e})
    columns = [c if e else f"__n_{c}" for c, e in extensive.items()] + ["__pop"]
    sums = apportion(made, source_of, target_of, population, columns, unit)
    every = target_of.where(F.col("target").isNotNull()).select("target").distinct()
    return every.join(sums, "target", "left").select("target", *[(F.col(c) if e else nulls.ratio(f"__n_{c}", "__pop")).alias(c) for c, e in extensive.items()])


def unambiguous(dim: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and value, of keys that have one value only."""
    return dim.groupBy(*keys).agg(F.countDistinct(value).alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")


def _grams(x: Column) -> Column:
    """The two-letter runs of a text, in order; a shorter text is its own."""
    return F.when(F.length(x) < 2, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2))))


def closest(names: DataFrame, candidates: DataFrame, least: float = 90.0, by_tokens: bool = True) -> DataFrame:
    """name, candidate_id, score: the most similar candidate, by sorted tokens or as it stands, the first of equals; null if none reaches `least`.

    names are what no exact match has settled. Only pairs that share a two-letter run are compared, and nothing is lost by
    that: at a similarity of r, at most 2 (1 - r) / r letters of a name's length are added or dropped, each breaks two runs
    at most, and so one of a name's first so many runs is in the candidate. This holds from 85 on.
    """
    if least < 85:
        raise ValueError("below 85 similar names may share no two letters in a row")
    form = text.sorted_tokens if by_tokens else F.col
    edits = F.floor(F.length("__n") * (2 * (100 - least) / least) + 1e-9)
    c = candidates.select("candidate_id", "ordinal", form("candidate").alias("__c"))
    n = names.select("name").distinct().withColumn("__n", form("name"))
    asked = n.select("name", "__n", F.explode(F.array_distinct(F.slice(_grams(F.col("__n")), 1, (2 * edits + 1).cast("int")))).alias("__g"))
    filed = c.select("candidate_id", "ordinal", "__c", F.explode(F.array_distinct(_grams(F.col("__c")))).alias("__g"))
    long, short = F.greatest(F.length("__n"), F.length("__c")), F.least(F.length("__n"), F.length("__c"))
    met = asked.join(filed, "__g").where(200 * short >= least * (long + short) - 1e-6).select("name", "__n", "candidate_id", "ordinal", "__c").distinct()
    scored = met.withColumn("score", text.similarity("__n", "__c")).where(F.col("score") >= least)
    best = scored.groupBy("name").agg(F.max_by(F.struct("candidate_id", "score"), F.struct("score", -F.col("ordinal"))).alias("b"))
    return n.select("name").join(best, "name", "left").select("name", F.col("b.candidate_id").alias("candidate_id"), F.col("b.score").alias("score"))


def crosswalk(names: DataFrame, settlements: DataFrame, manual: DataFrame | None = None, least: float = 90.0, dropped: Iterable[str] = text.DROPPED) -> DataFrame:
    """name, district_id, method, status, score for each distinct name.

    In this order: confirmed by hand; rejected by hand (none); postal code; exact name; else the most similar name, pending;
    else none, pending. Only confirmed matches carry a district. settlements: settlement_name, postal_codes (joined by ;),
    district_id, ordinal. Of a postal code the first listed settlement counts, of a name the last.
    """
    asked = names.select("name").distinct().withColumn("__n", text.normalised_name("name", dropped))
    none = F.lit(None).cast("string")
    rules = (manual if manual is not None else names.sparkSession.createDataFrame([], "name string, district_id string, confirmed boolean")).select(F.lower(F.trim("name")).alias("__raw"), F.col("district_id").alias("__manual"), "confirmed").dropDuplicates(["__raw"])
    codes = settlements.select(F.explode(F.split("postal_codes", ";")).alias("__code"), "district_id", "ordinal").groupBy(F.trim("__code").alias("__code")).agg(F.min_by("district_id", "ordinal").alias("__postal"))
    exact = settlements.groupBy(text.normalised_name("settlement_name", dropped).alias("__n")).agg(F.max_by("district_id", "ordinal").alias("__exact"))
    step = asked.join(F.broadcast(rules), F.lower(F.trim("name")) == F.col("__raw"), "left").join(codes, F.trim("name") == F.col("__code"), "left").join(exact, "__n", "left")
    by_hand = F.col("confirmed").isNotNull()
    settled = step.withColumn("method", F.when(by_hand & F.col("confirmed"), "manual").when(by_hand, "rejected").when(F.col("__postal").isNotNull(), "postal").when(F.col("__exact").isNotNull(), "exact_name"))
    done = settled.where(F.col("method").isNotNull()).select("name", F.when(F.col("method") == "manual", F.col("__manual")).when(F.col("method") == "postal", F.col("__postal")).when(F.col("method") == "exact_name", F.col("__exact")).otherwise(none).alias("district_id"), F.when(F.col("method") == "rejected", "none").otherwise(F.col("method")).alias("method"), F.when(F.col("method") == "rejected", "rejected").otherwise("confirmed").alias("status"), F.lit(None).cast("double").alias("score"))
    rest = settled.where(F.col("method").isNull()).select(F.col("name").alias("__name"), F.col("__n").alias("name"))
    near = closest(rest, settlements.select(F.col("district_id").alias("candidate_id"), text.normalised_name("settlement_name", dropped).alias("candidate"), "ordinal"), least)
    pending = rest.join(near, "name", "left").select(F.col("__name").alias("name"), none.alias("district_id"), F.when(F.col("candidate_id").isNotNull(), "fuzzy").otherwise("none").alias("method"), F.lit("pending").alias("status"), "score")
    return done.unionByName(pending)


def matched(df: DataFrame, name: str, found: DataFrame) -> DataFrame:
    """Rows with what the crosswalk found for their names; all rows stay."""
    return df.join(found.withColumnRenamed("name", name), name, "left")


def same_name(a: Column, b: Column) -> Column:
    return text.plain_name(a) == text.plain_name(b)
