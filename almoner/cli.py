"""Command line: `python -m almoner.cli list | run | panel | geography | allocate | validate | costs | dictionary | availability`."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import allocation, costs, equity, geography, need, panel, validation
from .plans import bindings, catalog
from .sources import sinks
from .sources.tabular import table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="almoner", description=__doc__)
    p.add_argument("--data", default="/root/testdata/sf0.001", help="the folder of tables, on any store that Spark reads")
    p.add_argument("--out", help="where results go, as Parquet and CSV; shown if not given")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of queries")
    commands.add_parser("run", help="one query").add_argument("name", choices=sorted(catalog.QUERIES))
    c = commands.add_parser("panel", help="districts with apportioned cases, or counties by week")
    c.add_argument("--ci-fraction", type=float, default=0.5)
    c.add_argument("--resolution", choices=("yearly", "weekly"), default="yearly")
    g = commands.add_parser("geography", help="settlements, districts and boundary changes, written under --out")
    g.add_argument("--strict", action="store_true", help="exit with 1 if the registry is inconsistent")
    a = commands.add_parser("allocate", help="scenarios over the panel")
    a.add_argument("--scenario", type=int, action="append", help="an id; all if not given")
    a.add_argument("--budget", type=float, default=bindings.BUDGET)
    a.add_argument("--year", type=int, help="of the cases; all if not given")
    a.add_argument("--compare", action="store_true", help="equity of each scenario instead")
    v = commands.add_parser("validate", help="findings of all rules")
    v.add_argument("--strict", action="store_true", help="exit with 1 on errors")
    v.add_argument("--variable", action="append", help="that has a break; all of the table if not given")
    k = commands.add_parser("costs", help="cost per case at each level, or parameters as of a year")
    k.add_argument("--year", type=int, help="parameters as of this year instead, from the table's listings")
    k.add_argument("--strict", action="store_true", help="exit with 1 if a parameter has no value")
    commands.add_parser("dictionary", help="columns, tables and null shares")
    commands.add_parser("availability", help="what sources should give and what they gave")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        print(*sorted(catalog.QUERIES), sep="\n")
        return 0
    spark = SparkSession.builder.appName("almoner").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    status = 0
    if args.command == "run":
        df = catalog.QUERIES[args.name](spark, args.data)
    elif args.command == "panel" and args.resolution == "weekly":
        df = catalog.weekly_counts(spark, args.data)
    elif args.command == "geography":
        rows = bindings.registry_years(spark, args.data)
        broken = geography.consistency(rows)
        status = int(args.strict and not broken.isEmpty())
        if args.out:
            for name, n in geography.write_registry(rows, args.out).items():
                print(name, n)
            return status
        df = broken
    elif args.command == "panel":
        df = panel.population_share(bindings.county_years(spark, args.data), bindings.panel(spark, args.data).select("district_id", "county_id", "population"), spread=args.ci_fraction)
    elif args.command == "allocate":
        wanted = [s for s in allocation.SCENARIOS if args.scenario is None or s.scenario_id in args.scenario]
        if not wanted:
            print(f"no such scenario: {args.scenario}", file=sys.stderr)
            return 2
        rows = bindings.panel(spark, args.data)
        if args.year is not None:
            cases = bindings.county_years(spark, args.data).where(F.col("year") == args.year)
            of_year = panel.population_share(cases, rows.select("district_id", "county_id", "population")).select("district_id", F.col("cases_modelled").alias("cases"))
            rows = rows.drop("cases").join(of_year, "district_id")
        rows = need.need_index(rows, bindings.index())
        df = allocation.allocate(rows, allocation.scenario_rows(spark, wanted), args.budget)
        df = equity.summary(df, "aid_amount", "need_score", "region_id", ["scenario_id"]) if args.compare else df
    elif args.command == "validate":
        sv = bindings.surveillance(spark, args.data)
        bounds = spark.createDataFrame(catalog.BOUNDS, "variable string, low double, high double")
        variables = args.variable or [r[0] for r in sv.select("variable").distinct().collect()]  # names of variables
        df = validation.run_all(sv, validation.standard_rules(spark, bounds, variables))
        status = int(args.strict and not df.where("severity = 'error'").isEmpty())
    elif args.command == "costs" and args.year is not None:
        df = catalog.asof_parameter(spark, args.data).where(F.col("year") == args.year)
        status = int(args.strict and not df.where("value IS NULL").isEmpty())
    elif args.command == "availability":
        e = table(spark, args.data, "events")
        variables = e.select(F.col("event_type").alias("variable"), F.lit("events").alias("source_id"), F.lit("surveillance").alias("block")).distinct()
        files = spark.createDataFrame([("events", f) for f in e.inputFiles()], "source_id string, file string")
        df = sinks.availability(variables, files).withColumn("blocks", F.array_join("blocks", ";"))
    elif args.command == "costs":
        df = costs.analysis_parameters(spark).withColumn("cost_per_case", costs.cost_per_case())
    else:
        names = ("customer", "orders", "lineitem", "events")
        df = sinks.dictionary({n: table(spark, args.data, n) for n in names}).withColumn("tables", F.array_join("tables", ";"))
    if args.out:
        sinks.twin(df, args.out)
    else:
        df.show(50, truncate=False)
    return status


if __name__ == "__main__":
    sys.exit(main())
