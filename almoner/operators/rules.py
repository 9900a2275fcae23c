"""Row rules and table schemas, all of them in one scan.

A rule is a condition that rows must meet. All rules become one projection: the names of those a row breaks, and the row
as JSON where it breaks any; rows that break none go no further. A task folds what is left to a count and the least rows
of each rule, so that a rule that all rows break costs no more than one, and the tasks' parts are merged by a grouped
aggregation. An expression that fails while it runs (a cast, an index, a division) doesn't stop the others: the scan is
then split in halves until the failing rules are alone, and each of these becomes a warning.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls
from .validation import BREAK, FINDING

SAMPLE = 5


@dataclass
class RowRule:
    """condition: a column or SQL text; rows in which it is false break the rule. NULL passes; write what must be known into the condition."""

    name: str
    condition: Column | str
    severity: str = "error"
    message: str = ""

    def column(self) -> Column:
        return F.expr(self.condition) if isinstance(self.condition, str) else self.condition


class _Least:
    """The count and the least rows of each rule."""

    def __init__(self, names: list[str], sample: int):
        self.n, self.rows, self.sample = dict.fromkeys(names, 0), {n: [] for n in names}, sample

    def add(self, broken: list[str], row: str) -> None:
        for name in broken:
            self.n[name] += 1
            held = self.rows[name]
            # the greatest of the least stands first: strings in turned order
            if len(held) < self.sample:
                heapq.heappush(held, _Turned(row))
            elif row < held[0].text:
                heapq.heapreplace(held, _Turned(row))


class _Turned:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text

    def __lt__(self, other: _Turned) -> bool:
        return self.text > other.text


def _scan(df: DataFrame, rules: list[RowRule], sample: int) -> list[tuple]:
    """The findings of rules, in one pass; an error of any of them is raised."""
    names = [r.name for r in rules]
    broken = F.filter(F.array(*[F.when(~r.column(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    found = df.select(broken.alias("broken"), row.alias("row")).where(F.size("broken") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = _Least(names, sample)
        for batch in batches:
            for b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                least.add(b, text)
        told = [n for n in names if least.n[n]]
        yield pa.RecordBatch.from_arrays([pa.array(told, pa.string()), pa.array([least.n[n] for n in told], pa.int64()), pa.array([sorted(x.text for x in least.rows[n]) for n in told], pa.list_(pa.string()))], names=["rule", "n", "rows"])

    parts = found.mapInArrow(run, "rule string, n long, rows array<string>")
    merged = parts.groupBy("rule").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("rows"))), 1, sample).alias("rows"))  # as many lists as tasks, each of `sample` rows
    by = {r.name: r for r in rules}
    return [(x["rule"], by[x["rule"]].severity, by[x["rule"]].message or f"rows break {x['rule']}", x["n"], x["rows"]) for x in merged.collect()]  # a row for each rule


def evaluate(df: DataFrame, rules: list[RowRule], sample: int = SAMPLE) -> DataFrame:
    """The findings of all rules (rule, severity, message, n_rows, sample): one scan, or a few more if a rule fails while it runs."""
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("rules need names of their own")
    out, open_ = [], [rules] if rules else []
    while open_:
        part = open_.pop()
        try:
            out += _scan(df, part, sample)
        except Exception as e:  # noqa: BLE001 - a rule must not stop the others
            if len(part) == 1:
                out.append((part[0].name, "warning", f"the rule failed: {(e.getCondition() if isinstance(e, PySparkException) else None) or type(e).__name__}", 0, []))
            else:
                open_ += [part[: len(part) // 2], part[len(part) // 2 :]]
    return df.sparkSession.createDataFrame(sorted(out, key=lambda x: x[0]), FINDING)


@dataclass
class Field:
    """One column of a schema: its type, whether it may be missing from the table or in a row, and what its values must meet."""

    name: str
    type: str = "string"
    nullable: bool = False
    required: bool = True
    among: tuple[str, ...] | None = None
    least: float | None = None
    most: float | None = None
    pattern: str | None = None
    since: str | None = None


# What columns may hold.
EVIDENCE = ("observed", "estimated", "assumed")
CONFIDENCE = ("high", "medium", "low")
GEO_LEVELS = ("country", "county", "district")

SCHEMAS: dict[str, list[Field]] = {
    "county_weekly_epi": [
        Field("geo_level", among=GEO_LEVELS), Field("geo_name", nullable=True, required=False), Field("variable"), Field("value", "double", nullable=True, least=0),
        Field("iso_year", "bigint", nullable=True, required=False), Field("iso_week", "bigint", nullable=True, required=False, least=1, most=53),
        Field("period_start", "date", nullable=True, required=False, since=BREAK), Field("evidence_class", among=EVIDENCE), Field("source_id"),
    ],
    "cost_parameters_resolved": [
        Field("parameter_id"), Field("value", "double", nullable=True), Field("price_year", "bigint", nullable=True), Field("evidence_class", among=EVIDENCE),
        Field("confidence", nullable=True, among=CONFIDENCE), Field("source_url", nullable=True),
    ],
    "geo_districts": [Field("district_id", pattern=r"^\S+$"), Field("district_name"), Field("county_id"), Field("valid_from", nullable=True), Field("valid_to", nullable=True)],
    "district_panel": [
        Field("district_id"), Field("year", "bigint"), Field("evidence_class", nullable=True, among=EVIDENCE),
        *[Field(f"rotavirus_cases_district_modelled{x}", "double", nullable=True, required=False, least=0) for x in ("", "_lo", "_hi")],
    ],
}


def schema_rules(df: DataFrame, fields: list[Field]) -> list[RowRule]:
    """The rules of a schema over the columns that df has. A value that can't be read as its type breaks the type's rule alone."""
    rules = []
    for f in fields:
        if f.name not in df.columns:
            continue
        x = F.col(f"`{f.name}`")
        read = x if f.type == "string" else x.cast("string").try_cast(f.type) if f.type != "bigint" else x.cast("string").try_cast("decimal(38,6)")
        read = nulls.known(read) if f.type == "double" else read
        if not f.nullable:
            rules.append(RowRule(f"{f.name}:known", x.isNotNull() & (~F.isnan(x) if dict(df.dtypes)[f.name] in ("double", "float") else F.lit(True)), message=f"{f.name} is missing"))
        if f.type == "bigint":
            rules.append(RowRule(f"{f.name}:type", x.isNull() | (read.isNotNull() & (read == F.floor(read))), message=f"{f.name} is no whole number"))
        elif f.type == "double":
            rules.append(RowRule(f"{f.name}:type", x.isNull() | read.isNotNull() | (F.lower(F.trim(x.cast("string"))) == "nan"), message=f"{f.name} is no number"))
        text = x.cast("string")
        if f.among is not None:
            rules.append(RowRule(f"{f.name}:among", text.isin(*f.among), message=f"{f.name} is none of {', '.join(f.among)}"))
        if f.least is not None:
            rules.append(RowRule(f"{f.name}:least", read >= f.least, message=f"{f.name} is below {f.least}"))
        if f.most is not None:
            rules.append(RowRule(f"{f.name}:most", read <= f.most, message=f"{f.name} is above {f.most}"))
        if f.pattern is not None:
            rules.append(RowRule(f"{f.name}:pattern", text.rlike(f.pattern), message=f"{f.name} doesn't look like {f.pattern}"))
        if f.since is not None:
            rules.append(RowRule(f"{f.name}:since", text.try_cast("date") >= F.lit(f.since).cast("date"), message=f"{f.name} is before {f.since}"))
    return rules


def check_schema(df: DataFrame, fields: list[Field], sample: int = SAMPLE) -> DataFrame:
    """The findings of a schema: absent columns, and all rules of the others in one scan. Other columns are let be."""
    absent = [(f"{f.name}:column", "error", f"there is no column {f.name}", 0, []) for f in fields if f.required and f.name not in df.columns]
    found = evaluate(df, schema_rules(df, fields), sample)
    return found.unionByName(df.sparkSession.createDataFrame(absent, FINDING)) if absent else found
