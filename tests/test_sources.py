"""Files written by the test, read back by the library."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tabwright.operators import experiment
from tabwright.sources import readers
from tabwright.sources.excel import read_excel
from tabwright.sources.readers import EmptyDatasetError, Registry, dataset_info, load, read_csv, read_json
from tabwright.sources.report import read_ga_report
from tabwright.sources.stages import StageStore, save_summary


def test_csv_types_and_tokens(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        "id,when,x,flag,,id,code,void\n"
        '1,2024-01-05,1.5,True,a,NA,007,\n'
        '2,-,NaN,False,"b,""q""",5,08x,\n'
        "\n"
        "3,?,1e3,,null,6,9,\n"
    )
    df = read_csv(spark, str(path))
    assert df.columns == ["id", "when", "x", "flag", "Unnamed: 4", "id.1", "code", "void"]
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "boolean", "string", "bigint", "string", "double"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "2024-01-05", 1.5, True, "a", None, "007", None),
        (2, "-", None, False, 'b,"q"', 5, "08x", None),
        (3, "?", 1000.0, None, None, 6, "9", None),
    ]
    assert [t for _, t in read_csv(spark, str(path), infer=False).dtypes] == ["string"] * 8
    assert read_csv(spark, str(path), types={"id": "double"}).schema["id"].dataType.simpleString() == "double"


def test_quoted_line_ends(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text('a\tb\n1\t"x\ny"\n')
    assert readers.read_tsv(spark, str(path), multiline=True).first()["b"] == "x\ny"


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b\n")
    with pytest.raises(EmptyDatasetError):
        load(spark, str(tmp_path / "none.csv"))
    with pytest.raises(EmptyDatasetError) as e:
        readers.assert_not_empty(load(spark, str(tmp_path / "head.csv")))
    assert e.value.reason == "empty_file"


RECORDS = [{"b": 1, "a": "x"}, {"b": 2, "a": None, "c": 0.5}]


def test_json_forms(spark, tmp_path):
    (tmp_path / "records.json").write_text(json.dumps(RECORDS, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, RECORDS)))
    (tmp_path / "columns.json").write_text(
        json.dumps({"b": {"0": 1, "1": 2}, "a": {"0": "x", "1": None}, "c": {"0": None, "1": 0.5}}, indent=1)
    )
    for form in ("records", "lines", "columns"):
        df = load(spark, str(tmp_path / f"{form}.json"))
        assert df.columns == ["b", "a", "c"], form
        assert [tuple(r) for r in df.orderBy("b").collect()] == [(1, "x", None), (2, None, 0.5)]
    assert readers.json_orientation(spark, str(tmp_path / "columns.json")) == "columns"
    with pytest.raises(ValueError):
        read_json(spark, str(tmp_path / "lines.json"), orient="table")


def test_dispatch(spark, tmp_path):
    assert readers.format_label("x/A.XLSX") == "Excel"
    assert readers.format_label("a.dat") == ".DAT"
    with pytest.raises(ValueError, match="Unsupported file format: .txt"):
        load(spark, "a.txt")
    spark.range(3).write.parquet(str(tmp_path / "t.PARQUET"))
    assert load(spark, str(tmp_path / "t.PARQUET")).count() == 3
    registry = Registry().register("three", str(tmp_path / "t.PARQUET"), "Three rows")
    assert registry.label("three") == "Three rows" and registry.load(spark, "three").count() == 3
    with pytest.raises(KeyError):
        registry.load(spark, "four")


def test_info(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "a int, b double")
    assert tuple(dataset_info(df, "a.tsv").first()) == ("a.tsv", "TSV", 2, 2, 50.0)


def workbook(sheet, strings=(), formats=""):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="styles.xml"/><Relationship Id="rId7" Target="worksheets/first.xml"/></Relationships>',
        )
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="2"/></cellXfs></styleSheet>',
        )
        z.writestr("xl/worksheets/first.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def test_excel(spark, tmp_path):
    strings = ["id", "name", "day", "ok", "mix", "NA", "rich"]
    head = "<row>" + "".join(f'<c r="{c}1" t="s"><v>{i}</v></c>' for i, c in enumerate("ABCDE")) + "</row>"
    first = head + (
        '<row><c r="A2"><v>1</v></c><c r="B2" t="inlineStr"><is><t>a</t></is></c><c r="C2" s="1"><v>45296</v></c>'
        '<c r="D2" t="b"><v>1</v></c><c r="E2" s="3"><v>1.5</v></c></row><row/>'
        '<row><c r="A4"><v>2</v></c><c r="B4" t="s"><v>5</v></c><c r="C4" s="2"><v>45296.75</v></c><c r="E4" t="s"><v>6</v></c></row>'
    )
    second = (
        '<row><c r="A1" t="s"><v>1</v></c><c r="B1" t="s"><v>0</v></c></row>'
        '<row><c r="A2" t="str"><v>z</v></c><c r="B2"><v>3</v></c></row><row><c r="A3" t="e"><v>#REF!</v></c></row>'
    )
    (tmp_path / "a.xlsx").write_bytes(workbook(first, strings))
    (tmp_path / "b.xlsx").write_bytes(workbook(second, strings))
    one = load(spark, str(tmp_path / "a.xlsx"))
    assert dict(one.dtypes) == {"id": "bigint", "name": "string", "day": "timestamp_ntz", "ok": "boolean", "mix": "string"}
    got = [tuple(map(str, r)) for r in one.orderBy("id").collect()]
    assert got == [
        ("1", "a", "2024-01-05 00:00:00", "True", "1.5"),
        ("2", "None", "2024-01-05 18:00:00", "None", "rich"),
    ]
    both = read_excel(spark, str(tmp_path / "*.xlsx"))
    assert both.select("id", "name").orderBy("id").collect()[-1] == (3, "z")


EXPORT = """# ------
# report
# first to last
# ------
# end

Group,Event name,Active users,Event count
,,71,2901,Grand total
(not set),ab_group,24,55
A,ab_group,20,61
B,ab_group,20,61
A,dataset_loaded_success,9,14
B,dataset_loaded_success,4,4
,first_visit,1,1
"""


def test_report_to_verdict(spark, tmp_path):
    path = tmp_path / "report.csv"
    path.write_text(EXPORT)
    report = read_ga_report(spark, str(path))
    assert report.count() == 7
    assert tuple(report.filter("group is null and event_name is null").first()) == (None, None, 71, 2901)
    rates = experiment.conversion_from_report(report, "dataset_loaded_success", {"A": 20, "B": 20})
    assert {r["group"]: r["rate"] for r in rates.collect()} == {"A": 45.0, "B": 20.0}
    assert {tuple(r) for r in rates.collect()} == {
        tuple(r) for r in experiment.conversion_from_report(report, "dataset_loaded_success").collect()
    }
    found = experiment.verdict(experiment.fisher_exact(experiment.contingency(rates))).first()
    assert (found["a"], found["b"], found["c"], found["d"]) == (9, 11, 4, 16)
    assert round(found["p_value"], 4) == 0.1760
    assert found["p_value"] == pytest.approx(0.17599563650731614, rel=1e-12)
    assert found["odds_ratio"] == pytest.approx(3.2727, abs=1e-4)
    assert (found["significant"], found["conclusion"]) == (False, "fail to reject")


def test_stages(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "stages"))
    assert store.latest_name() == "none" and store.latest() is None and not store.has_downstream()
    raw = store.save("raw", spark.range(5))
    store.save("cleaned", raw.filter("id > 0"))
    store.save("cleaned", store.load("cleaned").filter("id > 1"))
    store.save("engineered", store.load("cleaned").withColumn("x", F.col("id") * 2))
    assert store.latest_name() == "engineered" and store.latest().columns == ["id", "x"]
    assert store.load("cleaned").count() == 3
    assert tuple(store.info("five.csv").first()) == ("five.csv", "CSV", 5, 1, 0.0)
    store.save("raw", spark.range(2))
    assert store.latest_name() == "raw" and store.latest().count() == 2
    with pytest.raises(EmptyDatasetError):
        store.save("raw", spark.range(0))
    with pytest.raises(FileNotFoundError):
        store.load("cleaned")
    with pytest.raises(ValueError):
        store.load("final")


def test_save_summary(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert tuple(save_summary(df).first()) == (3, 2, 2, 1)
    assert tuple(save_summary(df, features_created=4).first()) == (3, 2, 4)


def test_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "b.csv").write_text("name,id\nq,9\n")
    (tmp_path / "c.csv").write_text("id,more\n5,z\n")
    df = read_csv(spark, f"{tmp_path}/*.csv")
    assert df.columns == ["id", "name", "more"]
    assert sorted(map(tuple, df.collect())) == [(1, "x", None), (5, None, "z"), (9, "q", None)]


def test_json_lines_of_nested_objects(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"a":{"x":1}}\n\n{"a":{"x":2}}\n')
    df = read_json(spark, str(tmp_path / "n.json"))
    assert sorted(r["a"]["x"] for r in df.collect()) == [1, 2]
    (tmp_path / "one.json").write_text('{"a":{"x":1},"b":{"y":2}}\n')
    assert readers.json_orientation(spark, str(tmp_path / "one.json")) == "lines"


@pytest.mark.parametrize("text", ['[{"a":1}]\n[{"a":2}]', '{"a":{"0":1}}{"a":{"1":2}}', '{\n"a":{"0":"} {"}}\n{"a":{"1":2}}'])
def test_a_second_document_is_refused(spark, tmp_path, text):
    (tmp_path / "two.json").write_text(text)
    orient = "records" if text.startswith("[") else "columns"
    with pytest.raises(ValueError, match="more than one JSON document"):
        read_json(spark, str(tmp_path / "two.json"), orient)


def test_quoted_braces_are_one_document(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"a":{"0":"} {","1":"\\\\"}}')
    assert sorted(r[0] for r in read_json(spark, str(tmp_path / "q.json"), "columns").collect()) == ["\\", "} {"]
