import json
import zipfile

import pytest

from steadyseed.config import ensure_checkpoint_dir
from steadyseed.sources import load_table, read_csv, read_json, read_workbooks, write_leaderboards, write_results


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('i,f,b,s,n,mixed\n1,NA,True,x,,1\n2,3.5,False,"a,b",nan,2.5\n,nan,,None,NULL,inf\n')
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "n": "double", "mixed": "double"}
    rows = df.collect()
    assert [r["i"] for r in rows] == [1, 2, None]
    assert [r["f"] for r in rows] == [None, 3.5, None]
    assert [r["b"] for r in rows] == [True, False, None]
    assert [r["s"] for r in rows] == ["x", "a,b", None]
    assert [r["n"] for r in rows] == [None, None, None]
    assert rows[2]["mixed"] == float("inf")


def test_csv_keeps_text_that_only_looks_numeric(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c\n1d,1_000,99999999999999999999\n2f,2,1\n")
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "string", "b": "string", "c": "double"}


def test_json_orients(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "records.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "columns.json").write_text(json.dumps({"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": None}}))
    for orient in ("records", "lines", "columns"):
        df = read_json(spark, str(tmp_path / f"{orient}.json"), orient)
        assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        read_json(spark, str(tmp_path / "lines.json"), "table")


def workbook(path, rows):
    """A minimal .xlsx with shared strings, numbers and gaps."""
    texts = sorted({v for r in rows for v in r if isinstance(v, str)})
    body = []
    for i, row in enumerate(rows, start=1):
        cells = ""
        for j, value in enumerate(row):
            ref = f"{chr(65 + j)}{i}"
            if isinstance(value, bool):
                cells += f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
            elif isinstance(value, str):
                cells += f'<c r="{ref}" t="s"><v>{texts.index(value)}</v></c>'
            elif value is not None:
                cells += f'<c r="{ref}"><v>{value}</v></c>'
        body.append(f'<row r="{i}">{cells}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(body)}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["id", "name", "ok"], [1, "x", True], [2, None, False]])
    workbook(tmp_path / "b.xlsx", [["id", "name", "ok"], [3, "NA", True]])
    df = read_workbooks(spark, str(tmp_path))
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("ok", "boolean")]
    assert sorted((r["id"], r["name"], r["ok"]) for r in df.collect()) == [(1, "x", True), (2, None, False), (3, None, True)]
    assert load_table(spark, str(tmp_path / "b.xlsx")).count() == 1


def test_dispatch(spark, tables, tmp_path):
    assert load_table(spark, f"{tables}/orders.parquet").count() == 1500
    with pytest.raises(ValueError, match="no reader for the extension"):
        load_table(spark, "table.feather")
    with pytest.raises(ValueError, match="legacy"):
        load_table(spark, "table.xls")
    spark.sql("SELECT double('NaN') AS x, 1 AS y").write.parquet(str(tmp_path / "n.parquet"))
    assert load_table(spark, str(tmp_path / "n.parquet")).first()["x"] is None


def test_spread_only_when_narrow(spark, tables):
    assert load_table(spark, f"{tables}/orders.parquet", spread=True).rdd.getNumPartitions() == 4
    assert load_table(spark, f"{tables}/orders.parquet").rdd.getNumPartitions() < 4


def test_writers(spark, tmp_path):
    board = spark.sql("SELECT * FROM VALUES ('Best', 'm', 0.5D, 1), ('Worst', 'm', 0.25D, 1) AS t(seed_role, model, Accuracy, rank)")
    write_leaderboards(board, str(tmp_path / "lb"))
    assert sorted(p.name for p in (tmp_path / "lb").iterdir() if p.is_dir()) == ["seed_role=Best", "seed_role=Worst"]
    write_results({"seed_results": board, "analysis_record": board}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/seed_results")).count() == 2
    assert spark.read.json(str(tmp_path / "out/analysis_record")).count() == 2


def test_checkpoint_folder_is_the_session_setting(spark):
    folder = ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured in folder


def test_json_keeps_its_column_order_and_finds_its_orient(spark, tmp_path):
    sources = {
        "records": '[{"zed": 1, "abc": 2, "mid": 3}, {"zed": 4, "abc": 5, "mid": 6}]',
        "lines": '{"zed": 1, "abc": 2, "mid": 3}\n{"zed": 4, "abc": 5, "mid": 6}\n',
        "columns": '{"zed": {"0": 1, "1": 4}, "abc": {"0": 2, "1": 5}, "mid": {"0": 3, "1": 6}}',
    }
    for name, text in sources.items():
        path = tmp_path / f"{name}.json"
        path.write_text(text)
        table = load_table(spark, str(path))
        assert table.columns == ["zed", "abc", "mid"]
        assert sorted(tuple(r) for r in table.collect()) == [(1, 2, 3), (4, 5, 6)]
