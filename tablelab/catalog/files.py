"""Readers and writers, over files that Spark makes from the test tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab import ROW_ID, SPLIT
from tablelab.catalog import fixtures
from tablelab.catalog.registry import query, table
from tablelab.operators.dataset import with_row_ids
from tablelab.operators.splits import split_exact
from tablelab.session import scratch_path
from tablelab.sources import (
    excel_rows,
    expand_archives,
    ingest,
    load_dataset,
    read_csv,
    read_json,
    read_json_lines,
    read_labelled_files,
    resplit_saved,
    save_dataset,
    update_saved_spec,
)
from tablelab.sources.legacy import legacy_rows

_SPLIT_CASE = """CASE WHEN rn <= floor(0.7 * n + 1e-9) THEN 'train'
   WHEN rn <= floor(0.7 * n + 1e-9) + floor(0.5 * (n - floor(0.7 * n + 1e-9)) + 1e-9) THEN 'test'
   ELSE 'validation' END AS split"""
_CUSTOMER_SPLIT_SQL = f"""SELECT * EXCLUDE (rn, n), {_SPLIT_CASE} FROM (
   SELECT *, row_number() OVER (ORDER BY md5('4:' || c_custkey)) AS rn, count(*) OVER () AS n FROM customer)"""


def _customers_split(spark, sf):
    return split_exact(table(spark, sf, "customer"), 0.7, 0.15, 0.15, seed=4, row_id="c_custkey")


@query("csv_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _csv(spark, sf):
    path = scratch_path(spark, "csv")
    orders = table(spark, sf, "orders").drop("o_orderdate")
    orders.write.csv(path, sep=";", header=True)
    return read_csv(spark, path, ";")


@query("json_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _json_table(spark, sf):
    path = scratch_path(spark, "json")
    fixtures.json_documents(table(spark, sf, "customer"), "c_custkey", path, "data")
    return read_json(spark, path, "data").drop("doc")


@query("json_records", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _json_records(spark, sf):
    path = scratch_path(spark, "json")
    fixtures.json_documents(table(spark, sf, "part"), "p_partkey", path, None)
    return read_json(spark, path).drop("doc")


@query("json_lines", "SELECT event_id, user_id, event_type, value, props FROM events")
def _json_lines(spark, sf):
    path = scratch_path(spark, "jsonl")
    table(spark, sf, "events").drop("ts").write.json(path)
    return read_json_lines(spark, path)


@query("folder_splits", _CUSTOMER_SPLIT_SQL)
def _folder_splits(spark, sf):
    root = scratch_path(spark, "folders")
    rows = _customers_split(spark, sf)
    for split, folder in (("train", "train"), ("test", "test"), ("validation", "val")):
        rows.filter(F.col(SPLIT) == split).drop(SPLIT).write.csv(f"{root}/{folder}", header=True)
    return read_csv(spark, root, ",", splits_in_folders=True)


@query("save_load", f"SELECT * FROM ({_CUSTOMER_SPLIT_SQL}) WHERE split = 'test'")
def _save_load(spark, sf):
    path = scratch_path(spark, "dataset")
    save_dataset(_customers_split(spark, sf), path)
    return load_dataset(spark, path).filter(F.col(SPLIT) == "test")


@query(
    "ingest_csv",
    f"""SELECT * EXCLUDE (rn, n, o_orderdate), {_SPLIT_CASE} FROM (
          SELECT *, o_orderkey AS _row_id, row_number() OVER (ORDER BY md5('6:' || o_orderkey)) AS rn,
                 count(*) OVER () AS n FROM orders)""",
)
def _ingest(spark, sf):
    source, out = scratch_path(spark, "csv"), scratch_path(spark, "dataset")
    orders = table(spark, sf, "orders").drop("o_orderdate")
    # range partitions are written as files in key order, so the file order is the key order
    orders.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.csv(source, header=True)
    spec = {"train": 0.7, "test": 0.15, "validation": 0.15, "seed": 6}
    return ingest(spark, source, "csv", out, {"separator": ","}, spec)


@query(
    "excel_scan",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer",
)
def _excel(spark, sf):
    books = fixtures.workbooks(table(spark, sf, "customer"), "c_custkey")
    return excel_rows(books, sheet="data", header=0, usecols="A,B:D")


@query(
    "excel_no_header",
    'SELECT p_partkey AS "0", p_name AS "1", p_size AS "2" FROM part',
)
def _excel_no_header(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    books = fixtures.workbooks(part, "p_partkey")
    # without a header the first row is data: here the names, which make every column text
    rows = excel_rows(books, sheet=1, header=None).filter(F.col("0") != "p_partkey")
    return rows.select(F.col("0").cast("long").alias("0"), "1", F.col("2").cast("int").alias("2"))


@query(
    "archive_expand",
    "SELECT (c_custkey // 1000) || '.zip' AS archive, 'rows/' || c_custkey || '.txt' AS entry, c_name AS content FROM customer",
)
def _archives(spark, sf):
    zips = fixtures.archives(table(spark, sf, "customer"), "c_custkey", "c_name")
    return expand_archives(zips).withColumn("content", F.decode("content", "UTF-8"))


_FOLDER_SQL = """SELECT CASE WHEN n_chars > 1000 THEN 'train' ELSE 'test' END AS split, '{c}=' || {c} AS label,
   CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY ALL"""


def _labelled(spark, sf, column, kind):
    """Text files stand in for the images or sounds; the scan never looks inside them."""
    root = scratch_path(spark, kind)
    documents = table(spark, sf, "documents")
    for split, rows in (("train", documents.filter("n_chars > 1000")), ("test", documents.filter("n_chars <= 1000"))):
        rows.select("text", column).write.partitionBy(column).text(f"{root}/{split}")
    files = read_labelled_files(spark, root, "*.txt", kind)
    return files.groupBy("split", "label").agg(F.sum(F.octet_length(kind)).alias("bytes"))


@query("image_folder", _FOLDER_SQL.format(c="lang"))
def _images(spark, sf):
    return _labelled(spark, sf, "lang", "image")


@query("audio_folder", _FOLDER_SQL.format(c="source"))
def _audio(spark, sf):
    return _labelled(spark, sf, "source", "audio")


@query(
    "legacy_xy",
    """SELECT o_totalprice AS feature_0, CAST(o_custkey AS DOUBLE) AS feature_1, o_orderstatus AS class,
         CASE WHEN o_orderpriority < '3' THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def _legacy(spark, sf):
    orders = table(spark, sf, "orders").withColumn("doc", F.floor(F.col("o_orderkey") / 1000))
    row = F.struct(
        F.array("o_totalprice", F.col("o_custkey").cast("double")).alias("x"), F.col("o_orderstatus").alias("y")
    )
    test = F.col("o_orderpriority") < "3"
    parts = orders.groupBy("doc").agg(
        F.collect_list(F.when(~test, row)).alias("a"), F.collect_list(F.when(test, row)).alias("b")
    )
    return legacy_rows(parts.select(
        F.struct(F.col("a.x").alias("x"), F.col("a.y").alias("y")).alias("train"),
        F.struct(F.col("b.x").alias("x"), F.col("b.y").alias("y")).alias("test"),
    ))



@query("dataset_versions", """
    WITH v AS (SELECT 0 AS version, c_custkey, c_acctbal::DOUBLE AS balance FROM customer WHERE c_custkey % 2 = 1
               UNION ALL SELECT 1, c_custkey, c_acctbal::DOUBLE FROM customer
               UNION ALL SELECT 2, c_custkey, trunc(c_acctbal) FROM customer
               UNION ALL SELECT 3, c_custkey, trunc(c_acctbal) FROM customer)
    SELECT version, count(*) AS n, count(*) AS ids, sum(c_custkey)::BIGINT AS keys, round(sum(balance), 2) AS balance,
           CASE WHEN version = 3 THEN floor(count(*) * 0.5 + 1e-9) ELSE count(*) END::BIGINT AS train FROM v GROUP BY 1""")
def _dataset_versions(spark, sf):
    """Saved, appended to, a column's type changed and split again; every version can still be read."""
    path = scratch_path(spark, "versions")
    rows = with_row_ids(table(spark, sf, "customer")).select(
        ROW_ID, "c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.lit("train").alias(SPLIT))
    save_dataset(rows.filter("c_custkey % 2 = 1"), path)
    save_dataset(rows.filter("c_custkey % 2 = 0"), path, "append")
    update_saved_spec(spark, path, {"c_acctbal": ("Value", "int64")})
    resplit_saved(spark, path, {"train": 0.5, "test": 0.5, "validation": 0.0})
    out = [load_dataset(spark, path, v).select(
        F.lit(v).alias("version"), ROW_ID, SPLIT, "c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
        for v in range(4)]
    return functools.reduce(DataFrame.unionByName, out).groupBy("version").agg(
        F.count("*").alias("n"), F.count_distinct(ROW_ID).alias("ids"), F.sum("c_custkey").alias("keys"),
        F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count_if(F.col(SPLIT) == "train").alias("train"))
