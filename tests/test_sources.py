"""Workbooks, sectioned tables, rules in one scan, and collections of files with broken ones among them."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from almoner.operators import rules
from almoner.sources import tabular, workbook

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets):
    """A workbook of sheets (name to rows of cells): texts shared, every third one inline, numbers as they are, None not there."""
    shared: list[str] = []

    def cell(i, j, v):
        ref, n = "", j
        while True:
            ref, n = chr(65 + n % 26) + ref, n // 26 - 1
            if n < 0:
                break
        if isinstance(v, str) and (i + j) % 3 == 0:
            return f'<c r="{ref}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
        if isinstance(v, str):
            shared.append(v)
            return f'<c r="{ref}{i + 1}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{ref}{i + 1}"><v>{v}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="rId{k + 7}"/>' for k, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f"{HEAD}<workbook {NS}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{k + 7}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml" Type="x"/>' for k in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows) if any(v is not None for v in r))
            z.writestr(f"xl/worksheets/s{k}.xml", f"{HEAD}<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {NS}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r><rPh><t>no</t></rPh></si>" for s in shared) + "</sst>")


@pytest.fixture()
def books(tmp_path):
    book(tmp_path / "a.xlsx", {"2022": [["Kimutatás"], [None, None], ["Település neve", None, "Járás kódja"], ["Onga", 1, "0511"], [None, 2, None], ["Encs", 2.5, "0512"]], "Üres": []})
    book(tmp_path / "b.xlsx", {"2022": [["x", "JÁRÁS", "település"], ["1", "0513", "Forró"]], "2023": [["nincs", "fejléc"]], "W": [[None] * 27 + ["AB"]]})
    (tmp_path / "c.txt").write_text("no workbook")
    return str(tmp_path)


def test_sheets_are_listed(spark, books):
    got = sorted((r["path"].rsplit("/", 1)[1], r["sheet"], r["place"]) for r in workbook.sheets(spark, books).collect())
    assert got == [("a.xlsx", "2022", 0), ("a.xlsx", "Üres", 1), ("b.xlsx", "2022", 0), ("b.xlsx", "2023", 1), ("b.xlsx", "W", 2)]


def test_cells(spark, books):
    workbook.register(spark)
    rows = spark.read.format("workbook").load(f"{books}/a.xlsx").where("sheet = '2022'").collect()
    assert sorted((r["line"], r["cells"]) for r in rows) == [(0, ["Kimutatás"]), (2, ["Település neve", None, "Járás kódja"]), (3, ["Onga", "1", "0511"]), (4, [None, "2"]), (5, ["Encs", "2.5", "0512"])]
    wide = spark.read.format("workbook").load(f"{books}/b.xlsx").where("sheet = 'W'").first()["cells"]
    assert len(wide) == 28 and wide[27] == "AB" and wide[0] is None


def test_sheets_ruled_out_are_not_opened(spark, books):
    """A sheet is a partition; filters on sheet and path leave partitions out."""
    workbook.register(spark)
    df = spark.read.format("workbook").load(books)
    assert df.rdd.getNumPartitions() == 5
    assert df.where("sheet = '2022'").rdd.getNumPartitions() == 2
    assert df.where(F.col("sheet").isin("2023", "W", "no")).rdd.getNumPartitions() == 2
    assert df.where("sheet = '2022' AND line = 3").count() == 1 and df.where("sheet = 'no'").count() == 0
    reader = workbook.WorkbookReader({"path": books})
    assert list(reader.pushFilters([workbook.EqualTo(("sheet",), "2022"), workbook.EqualTo(("line",), 3)])) == [workbook.EqualTo(("line",), 3)]
    assert [(p.path.rsplit("/", 1)[1], p.name) for p in reader.partitions()] == [("a.xlsx", "2022"), ("b.xlsx", "2022")]


def test_rows_below_headers(spark, books):
    got = sorted((r["sheet"], r["line"], r["settlement"], r["district"]) for r in workbook.read_sheets(spark, books, {"település": "settlement", "járás": "district"}).collect())
    assert got == [("2022", 1, "Forró", "0513"), ("2022", 3, "Onga", "0511"), ("2022", 5, "Encs", "0512")]
    with pytest.raises(tabular.SchemaDriftError):
        workbook.read_sheets(spark, books, {"nope": "x"})
    with pytest.raises(Exception, match="no-such"):
        workbook.sheets(spark, f"{books}/no-such").collect()


def test_sections_are_carried_on(spark):
    rows = [("f", 0, "Férfi", None, None), ("f", 1, "0-14", "1", "2"), ("f", 2, "15-64", "3", ".."), ("f", 3, "Nő", "", None), ("f", 4, "0-14", "5", "6"), ("g", 0, "0-14", "7", "8")]
    df = spark.createDataFrame(rows, "file string, line int, age string, `2021` string, `2022` string").repartition(3)
    got = {(r["file"], r["section"], r["age"], r["year"], r["value"]) for r in tabular.sectioned_years(df, "age", "line", ["file"]).collect()}
    assert got == {("f", "Férfi", "0-14", 2021, 1.0), ("f", "Férfi", "0-14", 2022, 2.0), ("f", "Férfi", "15-64", 2021, 3.0), ("f", "Nő", "0-14", 2021, 5.0), ("f", "Nő", "0-14", 2022, 6.0), ("g", None, "0-14", 2021, 7.0), ("g", None, "0-14", 2022, 8.0)}


def test_years_stand_in_their_first_row(spark):
    rows = [("f", 0, "2021. év", "a", "1", "2"), ("f", 1, None, "b", "3", "x"), ("f", 2, "2022", "a", "5", "6")]
    df = spark.createDataFrame(rows, "file string, line int, year string, unit string, jan string, feb string")
    got = {(r["year"], r["month"], r["unit"], r["value"]) for r in tabular.months_long(df, "year", "line", {"jan": 1, "feb": 2}, ["file", "unit"]).collect()}
    assert (2021, 1, "a", 1.0) in got and (2022, 2, "a", 6.0) in got and len(got) == 4  # the fill goes by unit here
    by_file = {(r["year"], r["month"], r["value"]) for r in tabular.months_long(df, "year", "line", {"jan": 1, "feb": 2}, ["file"]).collect()}
    assert by_file == {(2021, 1, 1.0), (2021, 2, 2.0), (2021, 1, 3.0), (2022, 1, 5.0), (2022, 2, 6.0)}


def test_fill_over_slices(spark):
    from almoner.functions import order

    rows = [(i, None if i % 7 else f"v{i}", i % 2) for i in range(3, 200)]
    df = spark.createDataFrame(rows, "k int, v string, g int").repartition(5)
    for group in ([], ["g"]):
        got = {r["k"]: r["w"] for r in order.filled_forward(df, "v", group, [F.col("k")], "w", 6).collect()}
        for k, _, g in rows:
            before = [x for x in rows if x[0] <= k and x[1] is not None and (not group or x[2] == g)]
            assert got[k] == (before[-1][1] if before else None)


def test_rules_in_one_scan(spark, monkeypatch):
    scans, real = [], rules._scan
    monkeypatch.setattr(rules, "_scan", lambda df, part, sample: scans.append([r.name for r in part]) or real(df, part, sample))
    rows = spark.createDataFrame([(i, float(i) if i % 10 else None, "x" if i == 77 else str(i)) for i in range(1000)], "id long, v double, t string").repartition(7)
    mine = [rules.RowRule("small", "v < 990"), rules.RowRule("even", F.col("id") % 2 == 0, "warning", "odd"), rules.RowRule("fine", "id >= 0")]
    got = {r["rule"]: r for r in rules.evaluate(rows, mine).collect()}
    assert scans == [["small", "even", "fine"]] and set(got) == {"small", "even"}
    assert got["small"]["n_rows"] == 9 and got["even"]["n_rows"] == 500 and got["even"]["severity"] == "warning"
    every = sorted(json.dumps({"id": i} | ({"v": float(i)} if i % 10 else {}) | {"t": "x" if i == 77 else str(i)}, separators=(",", ":")) for i in range(1, 1000, 2))
    assert got["even"]["sample"] == every[:5]
    scans.clear()
    got = {r["rule"]: r for r in rules.evaluate(rows, [*mine, rules.RowRule("cast", "CAST(t AS INT) = id"), rules.RowRule("divide", "1 / (id - 5) < 2")]).collect()}
    assert got["cast"]["severity"] == got["divide"]["severity"] == "warning" and "CAST_INVALID_INPUT" in got["cast"]["message"] and "DIVIDE_BY_ZERO" in got["divide"]["message"]
    assert got["small"]["n_rows"] == 9 and got["even"]["n_rows"] == 500 and len(scans) < 10
    assert rules.evaluate(rows.where("false"), mine).isEmpty() and rules.evaluate(rows, []).isEmpty()
    with pytest.raises(ValueError):
        rules.evaluate(rows, [mine[0], mine[0]])


def test_schemas(spark):
    rows = [("county", "a", "v", "1.5", "2020", "7", "2020-01-06", "observed", "s"), ("planet", None, None, "-1", "x", "54", "2013-12-31", "guessed", "s"), ("county", "b", "v", None, None, None, None, "assumed", None), ("district", "c", "v", "abc", "2020.5", "0", "no date", "estimated", "s")]
    df = spark.createDataFrame(rows, "geo_level string, geo_name string, variable string, value string, iso_year string, iso_week string, period_start string, evidence_class string, source_id string")
    got = {r["rule"]: r["n_rows"] for r in rules.check_schema(df, rules.SCHEMAS["county_weekly_epi"]).collect()}
    assert got == {"geo_level:among": 1, "variable:known": 1, "value:type": 1, "value:least": 1, "iso_year:type": 2, "iso_week:least": 1, "iso_week:most": 1, "period_start:since": 1, "evidence_class:among": 1, "source_id:known": 1}
    got = {r["rule"]: r["n_rows"] for r in rules.check_schema(df, rules.SCHEMAS["geo_districts"]).collect()}
    assert got == {f"{c}:column": 0 for c in ("district_id", "district_name", "county_id", "valid_from", "valid_to")}
    good = spark.createDataFrame([("d 1", "n", "c", None, None)], "district_id string, district_name string, county_id string, valid_from string, valid_to string")
    assert [r["rule"] for r in rules.check_schema(good, rules.SCHEMAS["geo_districts"]).collect()] == ["district_id:pattern"]


def _tables(spark, store):
    from almoner.streaming import collect

    shown = {}
    for name, columns in {"rows": ["url", "line", "row"], "registry": ["url", "status", "n_rows", "columns"], "errors": ["url", "error"], "drift": ["url", "added", "removed"]}.items():
        shown[name] = sorted(str([r["url"].rsplit("/", 2)[1:], *[r[c] for c in columns[1:]]]) for r in collect.read(spark, store, name).collect())
    return shown


def test_collection(spark, tmp_path):
    """Two broken files among good ones; run twice, and once more from nothing but the store, it gives the same tables; a new column is told of once."""
    import os
    import time

    from almoner.streaming import collect

    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    put = lambda name, text, at: ((folder / name).write_bytes(text), os.utime(folder / name, (at, at)))
    now = time.time() - 1000
    put("a.json", b'{"x": 1, "y": "p"}\n{"x": 2, "y": "q"}\n', now)
    put("b.json", b'{"x": ', now + 1)
    put("c.json", b"\xff\xfe broken", now + 2)
    put("d.json", b'{"x": 3, "y": null}\n', now + 3)
    put("e.json", b"\n", now + 4)
    run = lambda: collect.collect(spark, str(folder), store, collect.json_lines, files_each=2)
    run()
    first = _tables(spark, store)
    assert len(first["rows"]) == 3 and len(first["errors"]) == 2 and len(first["registry"]) == 5 and not first["drift"]
    assert any("JSONDecodeError" in x for x in first["errors"]) and any("UnicodeDecodeError" in x for x in first["errors"])
    run()
    assert _tables(spark, store) == first
    # the same files again, to a stream that has forgotten them
    os.rename(f"{store}/checkpoint", f"{store}/forgotten")
    spark.read.format("binaryFile").load(str(folder)).count()
    again = spark.read.format("binaryFile").load(str(folder)).select(F.col("path").alias("url"), "content", "modificationTime")
    collect.keep(again, 1000, store, collect.json_lines, F.lit("in"))
    assert _tables(spark, store) == first
    os.rename(f"{store}/forgotten", f"{store}/checkpoint")
    # a source whose columns change, and a file that was mended
    put("f.json", b'{"x": 4, "z": "new"}\n', now + 5)
    put("g.json", b'{"x": 5, "z": "new"}\n', now + 6)
    run()
    more = _tables(spark, store)
    assert len(more["rows"]) == 5 and more["drift"] == ["[['in', 'f.json'], ['z'], ['y']]"] and len(more["registry"]) == 7
    run()
    assert _tables(spark, store) == more and collect.latest(spark, store).count() == 7


def test_a_batch_that_runs_again(spark, tmp_path):
    from almoner.streaming import collect

    files = spark.createDataFrame([("s/a", b'{"x": 1}', 0), ("s/a", b'{"x": 1}', 0), ("s/b", b"{", 1)], "url string, content binary, t int").withColumn("modificationTime", F.timestamp_seconds("t")).drop("t")
    for _ in range(2):
        collect.keep(files, 0, str(tmp_path), collect.json_lines, F.lit("s"))
    assert collect.read(spark, str(tmp_path), "rows").count() == 1 and collect.read(spark, str(tmp_path), "errors").count() == 1 and collect.read(spark, str(tmp_path), "registry").count() == 2
    collect.keep(files.where("false"), 1, str(tmp_path), collect.json_lines, F.lit("s"))
    assert collect.read(spark, str(tmp_path), "registry").count() == 2


def _sheet(spark, tables):
    rows = [(p, s, i, [None if c is None else str(c) for c in r]) for (p, s), table in tables.items() for i, r in enumerate(table)]
    return spark.createDataFrame(rows, "path string, sheet string, line int, cells array<string>").repartition(3)


def test_national_diseases(spark):
    from almoner.sources import annual

    rows = _sheet(spark, {("k.xlsx", "a"): [["Cím"], ["Év", "Bárányhimlő", "Rotavírus fertőzés", "Más"], ["2019", "30 412", "1 204", "7"], ["2020.", "–", "", "1"], ["Megjegyzés 12", "1", "2"], ["2021", None, "5"]]})
    got = {(r["year"], r["disease"], r["cases"]) for r in annual.national(rows).collect()}
    assert got == {(2019, "varicella", 30412), (2019, "rotavirus", 1204), (2021, "rotavirus", 5)}


def test_counties_of_yearly_reports(spark):
    from almoner.sources import annual

    names = spark.createDataFrame([("Pest", "13"), ("Pest vármegye", "13"), ("Győr-Moson-Sopron", "08"), ("Budapest", "01"), ("Főváros Budapest", "01")], "name string, county_id string")
    rows = _sheet(spark, {
        ("x/osap_2018.pdf", "9"): [["Terület", "Lyme", "Rotavírus"], ["PEST MEGYE", 1, "1 200"], ["győr-moson-sopron", 2, "–"], ["Budapest", 3, "n.a."], ["Összesen", 6, 1200]],
        ("x/osap_2019.pdf", "9"): [["Terület", "Lyme"], ["Pest", 1], ["Budapest", 2], ["Győr Moson Sopron", 3]],
        ("x/osap_2020.pdf", "9"): [["Terület", "Rotavirus"], ["Pest", 1]],
    })
    good, queued = annual.counties(rows, names, least=3)
    assert {(r["county_id"], r["year"], r["cases"]) for r in good.collect()} == {("13", 2018, 1200), ("08", 2018, 0)}
    assert {(r["path"], r["reason"]) for r in queued.collect()} == {("x/osap_2019.pdf", "no column of rotavirus"), ("x/osap_2020.pdf", "rows of counties: 1")}
    said = annual.observed(good, spark.createDataFrame([("13", "Pest"), ("08", "GYMS")], "county_id string, geo_name string")).collect()
    assert {(r["geo_name"], r["value"], str(r["period_end"]), r["source_file"]) for r in said} == {("Pest", 1200.0, "2018-12-31", "osap_2018.pdf"), ("GYMS", 0.0, "2018-12-31", "osap_2018.pdf")}
    weekly = spark.createDataFrame([("13", 2018, 700.0), ("13", 2018, 500.4), ("08", 2018, 3.0), ("01", 2018, 1.0)], "county_id string, iso_year int, value double")
    checked = {r["county_id"]: (r["weekly"], r["annual"], r["agrees"]) for r in annual.cross_check(weekly, good).collect()}
    assert checked["13"][2] and not checked["08"][2] and checked["01"] == (1.0, None, False)


def test_decree_annex(spark):
    from almoner.sources import annual

    head = ["Sorszám", "Régió", "Vármegye", "Járás", "Népesség", "Komplex", "Rang", "Kedv.", "Fejl.", "Program"]
    rows = _sheet(spark, {("d.html", "0"): [["a", "b"], ["c", "d"], ["e", "f"], ["g", "h"], ["i", "j"], ["k", "l"]], ("d.html", "1"): [head, ["1.", "É", "B", "Encsi", "20 123", "−8,37", "1.", "1", "1", "1"], ["2.", "É", "B", "Ongai", "1 000", "46,68", "2", "", "x", "3"], [None, None, None, "Összesen", "9"], [None]]})
    got = {r["district_name"]: r for r in annual.annex(rows).collect()}
    assert set(got) == {"Encsi", "Ongai"} and got["Ongai"]["development"] == 46.68 and got["Encsi"]["population"] == 20123
    assert [got["Encsi"][c] for c in annual.ANNEX[7:]] == [1, 1, 1] and [got["Ongai"][c] for c in annual.ANNEX[7:]] == [0, 0, 1]
    good, rest = annual.annex_of(annual.annex(rows), spark.createDataFrame([("Encsi", "7"), ("Ongai", None)], "name string, district_id string"))
    assert [(r["district_id"], r["rank"]) for r in good.collect()] == [("007", 1)] and [r[0] for r in rest.collect()] == ["Ongai"]
