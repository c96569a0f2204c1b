from datetime import datetime

import pytest

from conftest import rows
from rowloom.queries.workbook_fixture import sheet_xml, workbook_bytes
from rowloom.sinks.files import write_dated, write_delimited
from rowloom.sources.files import read_delimited
from rowloom.sources.workbooks import list_sheets, read_workbooks, workbook_files, workbook_table


def put(tmp_path, text, name="in.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv(spark, tmp_path):
    df = read_delimited(spark, put(tmp_path, 'a,,c\n1,"q""q","x,y"\n2\n3,,\n4,5,6,7\n\n"",b,\n'))
    assert df.columns == ["a", "Column2", "c"]
    assert rows(df) == [("", "b", ""), ("1", 'q"q', "x,y"), ("2", None, None), ("3", "", ""), ("4", "5", "6")]


def test_csv_without_header(spark, tmp_path):
    df = read_delimited(spark, put(tmp_path, "1,2\n3,4\n"), header=False)
    assert df.columns == ["Column1", "Column2"] and rows(df) == [("1", "2"), ("3", "4")]
    assert read_delimited(spark, put(tmp_path, "1,2\n3,4\n"), header=False, max_rows=1).count() == 1


def test_repeated_header_keeps_the_last_column(spark, tmp_path):
    df = read_delimited(spark, put(tmp_path, "a,b,a\n1,2,3\n"))
    assert df.columns == ["a", "b"] and rows(df) == [("3", "2")]


def test_tsv_has_no_quotes(spark, tmp_path):
    df = read_delimited(spark, put(tmp_path, 'a\tb\n"x\ty"\n1\n\n  p \t1\t2\n\t3\n'), "TSV")
    assert rows(df) == [("", "3"), ("  p ", "1"), ('"x', 'y"'), ("1", None)]


def test_txt_delimiters(spark, tmp_path):
    assert rows(read_delimited(spark, put(tmp_path, "a||b\n1||2|3\n"), "TXT", delimiter="||")) == [("1", "2|3")]
    assert rows(read_delimited(spark, put(tmp_path, 'a,b\n"1,2",3\n'), "TXT")) == [("1,2", "3")]
    assert rows(read_delimited(spark, put(tmp_path, "a.b\n1.2\n"), "TXT", delimiter=".")) == [("1", "2")]


def test_encodings(spark, tmp_path):
    sjis = put(tmp_path, "市,n\n東京,1\n", encoding="shift_jis")
    df = read_delimited(spark, sjis, encoding="Shift-JIS")
    assert df.columns == ["市", "n"] and rows(df) == [("東京", "1")]
    bom = put(tmp_path, "市,n\n東京,1\n", "bom.csv", "utf-8-sig")
    df = read_delimited(spark, bom, encoding="UTF-8 BOM")
    assert df.columns == ["市", "n"] and rows(df) == [("東京", "1")]
    plain = read_delimited(spark, put(tmp_path, "市;n\n東京;1\n", "p.txt", "shift_jis"), "TXT", delimiter=";", encoding="Shift-JIS")
    assert rows(plain) == [("東京", "1")]


def test_folder_of_files_skips_every_header(spark, tmp_path):
    put(tmp_path, "a,b\n1,2\n", "one.csv")
    put(tmp_path, "a,b\na,b\n", "two.csv")
    assert rows(read_delimited(spark, str(tmp_path))) == [("1", "2"), ("a", "b")]


def frame(spark):
    data = [(1, "plain", 2.0, None), (2, 'say "x", ok', 2.5, ""), (3, " pad ", 1e8, "東京")]
    return spark.createDataFrame(data, "i int, s string, d double, n string")


def lines(path):
    return sorted(line for p in path.glob("part-*") for line in p.read_text(encoding="utf-8").splitlines())


def test_csv_output(spark, tmp_path):
    df = frame(spark).coalesce(1)
    assert write_delimited(df, str(tmp_path / "o_{yyyyMMdd}"), at=datetime(2026, 4, 3)) is df
    out = tmp_path / "o_20260403"
    assert lines(out) == ["1,plain,2,", '2,"say ""x"", ok",2.5,', "3, pad ,100000000,東京", "i,s,d,n"]
    assert len(list(out.glob("part-*"))) == 1
    assert rows(read_delimited(spark, str(out)))[1] == ("2", 'say "x", ok', "2.5", "")


def test_tsv_output_is_never_quoted(spark, tmp_path):
    write_delimited(frame(spark), str(tmp_path / "o"), "TSV", header=False)
    assert lines(tmp_path / "o") == ["1\tplain\t2\t", '2\tsay "x", ok\t2.5\t', "3\t pad \t100000000\t東京"]


def test_encoded_output(spark, tmp_path):
    df = frame(spark).select("i", "n")
    write_delimited(df, str(tmp_path / "o"), encoding="Shift-JIS")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "o").glob("part-*"))
    assert "東京".encode("shift_jis") in raw and "東京".encode() not in raw
    assert rows(read_delimited(spark, str(tmp_path / "o"), encoding="Shift-JIS")) == [("1", ""), ("2", ""), ("3", "東京")]


def test_repeated_workbook_header_means_the_last_column(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes({"S": sheet_xml([["a", "b", "a"], [9, 2, 1]])}))
    table = workbook_table(read_workbooks(spark, str(tmp_path)), ["a", "b"])
    assert rows(table.select("a", "b")) == [("1", "2")]


def test_dated_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2026, 1, 2)), (2, datetime(2026, 1, 3))], "i int, t timestamp_ntz")
    write_dated(df, str(tmp_path / "o"), "t")
    assert sorted(p.name for p in (tmp_path / "o").glob("date_token=*")) == ["date_token=20260102", "date_token=20260103"]


@pytest.fixture()
def books(tmp_path):
    data = sheet_xml([["id", "name", "day", "ok", ""], [1, "A & B", 46113, True, "x"], [2.5, None, 46113.5, False], [], [4, "東京"]], dates=[3])
    info = sheet_xml([["note"], ["hi"]])
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.xlsx").write_bytes(workbook_bytes({"Info": info, "Data": data}))
    (tmp_path / "sub" / "two.xlsx").write_bytes(workbook_bytes({"Info": info}))
    (tmp_path / "notes.txt").write_text("no workbook")
    return str(tmp_path)


def test_workbooks(spark, books):
    cells = read_workbooks(spark, books, "Data").where("path LIKE '%one.xlsx'")
    found = {(r["row_no"], r["col_no"]): (r["header"], r["value"], r["kind"]) for r in cells.collect()}
    assert found[(1, 1)] == ("id", "1", "number")
    assert found[(1, 2)] == ("name", "A & B", "text")
    assert found[(1, 3)] == ("day", "2026/04/01 00:00:00", "date")
    assert found[(2, 3)] == ("day", "2026/04/01 12:00:00", "date")
    assert found[(1, 4)] == ("ok", "True", "bool")
    assert found[(2, 1)] == ("id", "2.5", "number")
    assert found[(3, 1)] == ("id", None, "empty")
    assert found[(4, 2)] == ("name", "東京", "text")
    table = workbook_table(cells, ["id", "name"]).orderBy("row_no").select("id", "name")
    assert [tuple(r) for r in table.collect()] == [("1", "A & B"), ("2.5", None), (None, None), ("4", "東京")]
    assert workbook_table(cells, ["id"], max_rows=2).count() == 2


def test_unknown_sheet_means_the_first(spark, books):
    cells = read_workbooks(spark, books, "Nope")
    assert {(r["sheet"], r["header"], r["value"]) for r in cells.collect()} == {("Info", "note", "hi")}
    bare = read_workbooks(spark, books, "Data", header=False).where("path LIKE '%two.xlsx'")
    assert [(r["row_no"], r["header"], r["value"]) for r in bare.collect()] == [(1, "Column1", "note"), (2, "Column1", "hi")]


def test_sheet_names(spark, books):
    names = list_sheets(workbook_files(spark, books))
    assert sorted(r["sheet"] for r in names.collect()) == ["Data", "Info", "Info"]


def test_workbook_step_gives_a_table(spark, books):
    from rowloom.plans.flow import build
    from rowloom.plans.steps import Context

    step = {"Id": "w", "StepType": "ExcelInput", "Settings": {"FilePath": books + "/one.xlsx", "SheetName": "Data"}}
    table = build({"Steps": [step]}, Context(spark)).frame("w")
    assert table.columns == ["id", "name", "day", "ok", ""]
    assert rows(table.select("id", "ok")) == [("1", "True"), ("2.5", "False"), ("4", None), (None, None)]


def test_control_characters_survive(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_bytes(b"a\tb\tc\r\n1\tx\x01y\t3\r\n")
    assert rows(read_delimited(spark, str(path), "TSV")) == [("1", "x\x01y", "3")]
    other = tmp_path / "d.txt"
    other.write_bytes(b"a\x01b\n1\x012\n")
    assert rows(read_delimited(spark, str(other), "TXT", delimiter="\x01")) == [("1", "2")]


@pytest.mark.parametrize("sep, kind", [(",", "CSV"), ("\t", "TSV")])
def test_headers_in_another_order_fail(spark, tmp_path, sep, kind):
    (tmp_path / "1.csv").write_text(f"a{sep}b\n1{sep}2\n")
    (tmp_path / "2.csv").write_text(f"b{sep}a\n20{sep}10\n")
    with pytest.raises(Exception, match="(?s)header|FAILED_READ_FILE"):
        read_delimited(spark, str(tmp_path), kind).collect()
