import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tablelab import ROW_ID, SPLIT
from tablelab.catalog.fixtures import workbook
from tablelab.sources import (
    excel_rows,
    expand_archives,
    ingest,
    load_dataset,
    read_csv,
    read_excel,
    read_json,
    read_legacy_xy,
    read_manifest,
    save_dataset,
)
from tablelab.sources.excel import wanted_columns

CSV = "a;b;c\n1;2.5;x\n2;3.5;y\n3;4.5;z\n"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_separators(spark, tmp_path, sep):
    df = read_csv(spark, put(tmp_path / "t.csv", CSV.replace(";", sep)), sep)
    assert df.dtypes == [("a", "int"), ("b", "double"), ("c", "string")] and df.count() == 3


def test_csv_errors(spark, tmp_path):
    good = put(tmp_path / "t.csv", CSV)
    with pytest.raises(ValueError, match="separator parameter was not provided"):
        read_csv(spark, good)
    with pytest.raises(TypeError, match="should be a string"):
        read_csv(spark, good, 1)
    with pytest.raises(Exception):
        ingest(spark, put(tmp_path / "bad.csv", CSV + "1;2;3;4;5\n"), "csv", str(tmp_path / "o"), {"separator": ";"})
    with pytest.raises(ValueError, match="no columns"):
        read_csv(spark, put(tmp_path / "empty.csv", ""), ";")
    put(tmp_path / "two" / "1.csv", "a;b\n1;2\n")
    put(tmp_path / "two" / "2.csv", "a;z\n1;2\n")
    with pytest.raises(Exception, match="CSV header"):
        read_csv(spark, str(tmp_path / "two"), ";").collect()


def test_split_folders(spark, tmp_path):
    for folder, n in (("train", 2), ("test", 1), ("val", 1)):
        for i in range(n):
            put(tmp_path / "d" / folder / f"part {i} (1).csv", CSV)
    df = read_csv(spark, str(tmp_path / "d"), ";", splits_in_folders=True)
    got = {r[0]: r[1] for r in df.groupBy(SPLIT).count().collect()}
    assert got == {"train": 6, "test": 3, "validation": 3}
    out = ingest(spark, str(tmp_path / "d"), "csv", str(tmp_path / "o"), {"separator": ";"}, splits_in_folders=True)
    assert sorted(r[0] for r in out.select(ROW_ID).collect()) == list(range(12))
    put(tmp_path / "d" / "loose.csv", CSV)
    with pytest.raises(ValueError, match="files outside"):
        read_csv(spark, str(tmp_path / "d"), ";", splits_in_folders=True)


RECORDS = [{"z": 1, "a": "x", "m": 1.5}, {"z": 2, "a": "ñ", "m": 2.5}]


def test_json_layouts(spark, tmp_path):
    flat = put(tmp_path / "r.json", json.dumps(RECORDS))
    table = put(tmp_path / "t.json", json.dumps({"task_info": "x", "data": RECORDS}, ensure_ascii=True))
    for df in (read_json(spark, flat), read_json(spark, table, "data")):
        assert df.columns == ["z", "a", "m"]
        assert sorted(map(tuple, df.collect())) == [(1, "x", 1.5), (2, "ñ", 2.5)]


@pytest.mark.parametrize("text", ['[{"a": 1}] garbage', "", '{"a": 1', '[{"a": 1}]{"a": 2}'])
def test_json_errors(spark, tmp_path, text):
    with pytest.raises(Exception, match="JSON"):
        read_json(spark, put(tmp_path / "bad.json", text)).collect()


def test_json_parameters(spark, tmp_path):
    path = put(tmp_path / "t.json", json.dumps({"data": RECORDS, "none": []}))
    with pytest.raises(TypeError):
        read_json(spark, path, 3)
    with pytest.raises(ValueError, match="no key"):
        read_json(spark, path, "other")
    with pytest.raises(ValueError, match="no records"):
        read_json(spark, path, "none")


def test_ingest_keeps_file_order(spark, tmp_path):
    lines = "".join(f"{i},{i % 3}\n" for i in range(5000))
    put(tmp_path / "in" / "b.csv", "id,k\n" + lines)
    put(tmp_path / "in" / "a.csv", "id,k\n7,1\n8,2\n")
    spec = {"train": 0.6, "test": 0.2, "validation": 0.2, "seed": 1}
    out = ingest(spark, str(tmp_path / "in"), "csv", str(tmp_path / "o"), {"separator": ","}, spec)
    rows = [r["id"] for r in out.orderBy(ROW_ID).collect()]
    assert rows == [7, 8, *range(5000)]
    assert out.filter("split = 'train'").count() == 3001
    assert read_manifest(spark, str(tmp_path / "o")) == {"splits": ["test", "train", "validation"]}
    with pytest.raises(Exception):
        save_dataset(load_dataset(spark, str(tmp_path / "o")), str(tmp_path / "o"))


def books(spark, *contents):
    return spark.createDataFrame([(f"{i}.xlsx", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_excel(spark, tmp_path):
    rows = [["a", "b", "c", "d"], [1, 2.5, "x", True], [2, None, "<&>", False], [3, 4, None, True]]
    book = workbook({"first": [["other"], [1]], "table_1": rows})
    got = excel_rows(books(spark, book), sheet="table_1")
    assert got.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "boolean")]
    assert sorted(map(tuple, got.collect())) == [
        (1, 2.5, "x", True), (2, None, "<&>", False), (3, 4.0, None, True)
    ]
    assert excel_rows(books(spark, book), sheet=1, usecols="A,C:D").columns == ["a", "c", "d"]
    assert excel_rows(books(spark, book), sheet=1, header=None).columns == ["0", "1", "2", "3"]
    assert excel_rows(books(spark, book), sheet=1, header=1).columns == ["1", "2.5", "x", "true"]
    with pytest.raises(Exception, match="no sheet named"):
        excel_rows(books(spark, book), sheet="zz")
    with pytest.raises(Exception, match="not an Excel workbook"):
        excel_rows(books(spark, b"nonsense"))
    with pytest.raises(ValueError, match="differ"):
        excel_rows(books(spark, book, workbook({"x": [["q"]], "y": [["r"], [1]]})), sheet=1)
    with pytest.raises(ValueError):
        wanted_columns("A-C")
    for folder in ("train", "test", "validation"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "b.xlsx").write_bytes(book)
    df = read_excel(spark, str(tmp_path), 1, splits_in_folders=True)
    assert df.groupBy(SPLIT).count().filter("count = 3").count() == 3
    out = ingest(spark, str(tmp_path / "train"), "excel", str(tmp_path / "o"), {"sheet": "table_1"})
    assert [r["a"] for r in out.orderBy(ROW_ID).collect()] == [1, 2, 3]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("train/x.csv", CSV)
        z.writestr("test/y.csv", "a;b;c\n")
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.zip"))
    got = expand_archives(files).select("entry", F.decode("content", "UTF-8").alias("t")).collect()
    assert {r["entry"]: r["t"] for r in got} == {"train/x.csv": CSV, "test/y.csv": "a;b;c\n"}


def test_legacy_layout(spark, tmp_path):
    doc = {"task_info": {}, "train": {"x": ["hello", "bye"], "y": [1, 0]}, "test": {"x": ["yo"], "y": [1]}}
    got = read_legacy_xy(spark, put(tmp_path / "l.json", json.dumps(doc)))
    assert sorted(map(tuple, got.collect())) == [("bye", 0, "train"), ("hello", 1, "train"), ("yo", 1, "test")]


def test_csv_quotes(spark, tmp_path):
    path = put(tmp_path / "q.csv", 'id,t\n1,"he said ""x"" ok"\n2,"a, ""b"", c"\n3,"two\nlines, ""q"""\n4,\n')
    got = {r["id"]: r["t"] for r in read_csv(spark, path, ",", multi_line=True).collect()}
    assert got == {1: 'he said "x" ok', 2: 'a, "b", c', 3: 'two\nlines, "q"', 4: None}
    path = put(tmp_path / "r.csv", 'id,t\n1,"he said ""x"" ok"\n2,"a, ""b"", c"\n')
    assert {r["t"] for r in read_csv(spark, path, ",").collect()} == {'he said "x" ok', 'a, "b", c'}


def test_ragged_workbook(spark):
    rows = [["a", "a"], [1, 2, 3], [], [None, 5], [7]]
    files = spark.createDataFrame([("f", bytearray(workbook({"s": rows})))], "path string, content binary")
    out = excel_rows(files)
    assert out.columns == ["a", "a.1", "Unnamed: 2"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, 2, 3), (None, None, None), (None, 5, None), (7, None, None)], key=str)
