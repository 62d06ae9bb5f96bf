"""Splits, column operators, labels, samples and dataset descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab import ROW_ID, SPLIT
from tablelab.catalog.registry import query, table
from tablelab.operators import dataset as ds
from tablelab.operators import schema as sc
from tablelab.operators import tasks
from tablelab.operators.splits import resplit, split_by_ranges, split_exact

# Split of every row by the exact sizes 70 / 15 / 15, given its place `rn` among `n` rows.
_SPLIT_CASE = """
  CASE WHEN rn <= floor(0.7 * n + 1e-9) THEN 'train'
       WHEN rn <= floor(0.7 * n + 1e-9)
                  + floor(0.5 * (n - floor(0.7 * n + 1e-9)) + 1e-9) THEN 'test'
       ELSE 'validation' END AS split"""


@query(
    "split_exact",
    f"""SELECT o_orderkey, o_orderpriority, {_SPLIT_CASE} FROM (
          SELECT *, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) AS rn,
                 count(*) OVER () AS n FROM orders)""",
)
def _split_exact(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split_exact(orders, 0.7, 0.15, 0.15, seed=42, row_id="o_orderkey")


@query(
    "split_exact_lineitem",
    f"""SELECT CAST(p - 1 AS BIGINT) AS _row_id, l_orderkey, {_SPLIT_CASE} FROM (
          SELECT *, row_number() OVER (ORDER BY md5('7:' || (p - 1))) AS rn, count(*) OVER () AS n
          FROM (SELECT l_orderkey, row_number() OVER () AS p FROM lineitem))""",
)
def _split_lineitem(spark, sf):
    rows = ds.with_row_ids(table(spark, sf, "lineitem")).select(ROW_ID, "l_orderkey")
    return split_exact(rows, 0.7, 0.15, 0.15, seed=7)


@query(
    "split_ordered",
    f"""SELECT o_orderkey, {_SPLIT_CASE} FROM (
          SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n
          FROM orders)""",
)
def _split_ordered(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return split_exact(orders, 0.7, 0.15, 0.15, shuffle=False, row_id="o_orderkey")


@query(
    "split_stratified",
    f"""SELECT o_orderkey, o_orderpriority, {_SPLIT_CASE} FROM (
          SELECT *, row_number() OVER (PARTITION BY o_orderpriority
                                       ORDER BY md5('42:' || o_orderkey)) AS rn,
                 count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""",
)
def _split_stratified(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split_exact(
        orders, 0.7, 0.15, 0.15, seed=42, stratify="o_orderpriority", row_id="o_orderkey"
    )


@query(
    "split_stratified_many",
    f"""SELECT o_orderkey, o_custkey, {_SPLIT_CASE} FROM (
          SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42:' || o_orderkey)) AS rn,
                 count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""",
)
def _split_stratified_many(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return split_exact(orders, 0.7, 0.15, 0.15, seed=42, stratify="o_custkey", row_id="o_orderkey")


@query(
    "resplit",
    """SELECT c_custkey,
         CASE WHEN rn <= floor(0.5 * n + 1e-9) THEN 'train'
              WHEN rn <= floor(0.5 * n + 1e-9)
                   + floor(0.6 * (n - floor(0.5 * n + 1e-9)) + 1e-9) THEN 'test'
              ELSE 'validation' END AS split
       FROM (SELECT *, row_number() OVER (ORDER BY md5('9:' || c_custkey)) AS rn,
                    count(*) OVER () AS n FROM customer)""",
)
def _resplit(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey")
    first = split_exact(customers, 0.7, 0.15, 0.15, seed=1, row_id="c_custkey")
    spec = {"train": 0.5, "test": 0.3, "validation": 0.2, "seed": 9}
    return resplit(first, spec, row_id="c_custkey")


@query(
    "split_manual_ranges",
    """SELECT r AS _row_id, o_totalprice,
         CASE WHEN r < n // 2 OR r = n - 1 THEN 'train'
              WHEN r < n // 2 + n // 4 THEN 'test' ELSE 'validation' END AS split
       FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r, o_totalprice,
                    count(*) OVER () AS n FROM orders)""",
)
def _split_manual(spark, sf):
    orders = ds.with_row_ids(table(spark, sf, "orders")).select(ROW_ID, "o_totalprice")
    n = orders.count()
    a, b = n // 2, n // 2 + n // 4
    train, test, rest = (
        ds.rows_from_ranges(text, n) for text in (f"1-{a},{n}", f"{a + 1}-{b}", f"{b + 1}-{n - 1}")
    )
    return split_by_ranges(orders, train, test, rest)


@query(
    "row_ids_by_key",
    """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS _row_id
       FROM events""",
)
def _row_ids_by_key(spark, sf):
    # the events are written in time order, so their time is a unique key in this table
    return ds.row_ids_by_key(table(spark, sf, "events").select("event_id", "ts"), "ts").select(
        "event_id", ROW_ID
    )


@query(
    "dataset_info",
    f"""SELECT count(*) AS total_rows, 6 AS total_columns,
          count(*) FILTER (WHERE split = 'train') AS train_rows,
          count(*) FILTER (WHERE split = 'test') AS test_rows,
          count(*) FILTER (WHERE split = 'validation') AS validation_rows
        FROM (SELECT {_SPLIT_CASE} FROM (
          SELECT row_number() OVER (ORDER BY md5('42:' || o_orderkey)) AS rn,
                 count(*) OVER () AS n FROM orders))""",
)
def _dataset_info(spark, sf):
    orders = table(spark, sf, "orders")
    return ds.dataset_info(split_exact(orders, 0.7, 0.15, 0.15, seed=42, row_id="o_orderkey"))


@query(
    "columns_spec",
    """SELECT CAST(position AS INTEGER) AS position, column_name, kind, dtype FROM (VALUES
         (0, 'p_partkey', 'Value', 'bigint'), (1, 'p_name', 'Value', 'string'),
         (2, 'p_brand', 'ClassLabel', 'double'), (3, 'p_type', 'Value', 'string'),
         (4, 'p_size', 'Value', 'int'), (5, 'p_retailprice', 'Value', 'double'))
       AS t(position, column_name, kind, dtype)""",
)
def _columns_spec(spark, sf):
    return ds.columns_spec(sc.encode_label(table(spark, sf, "part"), "p_brand"))


@query(
    "column_summary",
    """WITH f AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 1)
       SELECT 0 AS position, 'c_custkey' AS column_name, 'Value' AS kind, 'bigint' AS dtype,
              CAST(c_custkey AS VARCHAR) AS example FROM f
       UNION ALL SELECT 1, 'c_name', 'Value', 'string', c_name FROM f
       UNION ALL SELECT 2, 'c_nationkey', 'Value', 'int', CAST(c_nationkey AS VARCHAR) FROM f
       UNION ALL SELECT 3, 'c_acctbal', 'Value', 'double', CAST(c_acctbal AS VARCHAR) FROM f
       UNION ALL SELECT 4, 'c_mktsegment', 'Value', 'string', c_mktsegment FROM f""",
)
def _column_summary(spark, sf):
    return ds.column_summary(ds.as_dataset(table(spark, sf, "customer")))


@query(
    "select_io",
    "SELECT c_custkey AS _row_id, 'train' AS split, c_acctbal, c_nationkey, c_mktsegment FROM customer",
)
def _select_io(spark, sf):
    customers = ds.as_dataset(table(spark, sf, "customer"), row_id="c_custkey")
    inputs = ds.column_names(customers, [4, 3])
    return ds.select_columns(customers, inputs, ["c_mktsegment"])


@query("keep_features", "SELECT p_name, p_size, p_retailprice FROM part")
def _keep_features(spark, sf):
    return ds.select_features(table(spark, sf, "part"), ["p_retailprice", "p_name", "p_size"])


@query("drop_by_name", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def _drop_by_name(spark, sf):
    from tablelab.operators.converters import ColumnDropperByName

    return ColumnDropperByName(columnNames=["p_name", "p_type"]).transform(table(spark, sf, "part"))


@query("drop_by_index", "SELECT p_partkey, p_size FROM part")
def _drop_by_index(spark, sf):
    from pyspark.ml import Pipeline

    from tablelab.operators.converters import ColumnDropperByIndex

    part = table(spark, sf, "part")
    droppers = [ColumnDropperByIndex(first=1, last=3), ColumnDropperByIndex(first=2, last=9)]
    return Pipeline(stages=droppers).fit(part).transform(part)


@query(
    "reindex_missing",
    """SELECT CAST(NULL AS DOUBLE) AS discount, c_mktsegment, c_acctbal FROM customer""",
)
def _reindex(spark, sf):
    training = T.StructType.fromDDL("discount double, c_mktsegment string, c_acctbal double")
    return ds.reindex_columns(table(spark, sf, "customer"), training)


@query(
    "validate_io_report",
    """SELECT * FROM (VALUES
         ('tabular', 'valid', ''),
         ('too far', 'invalid', 'The list of indices can only contain elements within the amount of columns. Index 99 is greater than the total of columns.'),
         ('empty', 'invalid', 'Inputs and outputs columns lists to validate must not be empty'),
         ('fraction as class', 'invalid', 'column l_discount holds fractions and cannot be made categorical'))
       AS t("case", dataset_status, error)""",
)
def _validate_io(spark, sf):
    lineitem = table(spark, sf, "lineitem")
    cases = {
        "tabular": ([5, 6, 7, 8], [9]),
        "too far": ([5, 99], [9]),
        "empty": ([], [9]),
        "fraction as class": ([5, 6], [7]),
    }
    reports = [
        tasks.validation_report(lineitem, "TabularClassificationTask", i, o).withColumn("case", F.lit(c))
        for c, (i, o) in cases.items()
    ]
    return ds.concat_splits(*reports)


@query(
    "validate_task_report",
    """SELECT * FROM (VALUES
         ('TextClassificationTask', 'invalid', 'Error in the inputs of lineitem: TextClassificationTask takes 1 column(s), got 2'),
         ('ImageClassificationTask', 'invalid', 'Error in the inputs of lineitem: column l_quantity is Value, ImageClassificationTask takes Image'),
         ('TranslationTask', 'invalid', 'Error in the inputs of lineitem: TranslationTask takes 1 column(s), got 2'),
         ('TabularClassificationTask', 'valid', ''))
       AS t(task, dataset_status, error)""",
)
def _validate_task(spark, sf):
    lineitem = table(spark, sf, "lineitem")
    return ds.concat_splits(*[
        tasks.validation_report(lineitem, t, [5, 6], [9], "lineitem").withColumn("task", F.lit(t))
        for t in tasks.TASKS
    ])


@query(
    "validate_instances",
    """SELECT * FROM (VALUES ('valid', '', 'part'), ('invalid', 'l_tax,l_discount', 'customer'))
       AS t(dataset_status, missing, instances)""",
)
def _validate_instances(spark, sf):
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    ok = tasks.validate_instances(part, ["p_size", "p_retailprice"])
    bad = tasks.validate_instances(customer, ["c_acctbal", "l_tax", "l_discount"])
    return ok.withColumn("instances", F.lit("part")).unionByName(
        bad.withColumn("instances", F.lit("customer"))
    )


@query(
    "label_encode",
    """SELECT l_orderkey, l_linenumber, CAST(r AS DOUBLE) AS l_returnflag, CAST(k AS DOUBLE) AS l_suppkey
       FROM (SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS r,
                    dense_rank() OVER (ORDER BY l_suppkey) - 1 AS k FROM lineitem)""",
)
def _label_encode(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")
    return sc.change_columns_type(rows, {"l_returnflag": "Categorical", "l_suppkey": "Categorical"})


@query(
    "label_encode_many",
    """SELECT l_linenumber, CAST(dense_rank() OVER (ORDER BY CAST(l_orderkey AS VARCHAR)) - 1 AS DOUBLE) AS order_code,
         l_orderkey FROM lineitem""",
)
def _label_encode_many(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("order_code"))
    return sc.change_columns_type(rows, {"order_code": "Categorical"})


@query("label_decode", "SELECT o_orderkey, o_orderpriority AS decoded FROM orders")
def _label_decode(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    coded = sc.set_class_column(orders, 1)
    names = sc.class_names(coded, "o_orderpriority")
    return coded.select("o_orderkey", sc.decode("o_orderpriority", names).alias("decoded"))


@query("label_values", "SELECT DISTINCT l_shipdate FROM lineitem WHERE l_shipdate IS NOT NULL")
def _label_values(spark, sf):
    return sc.label_values(table(spark, sf, "lineitem"), "l_shipdate")


@query(
    "cast_columns",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
         CAST(r - 1 AS DOUBLE) AS c_mktsegment
       FROM (SELECT *, dense_rank() OVER (ORDER BY c_mktsegment) AS r FROM customer)""",
)
def _cast_columns(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return sc.update_columns_spec(
        rows,
        {
            "c_custkey": ("Value", "string"),
            "c_nationkey": ("Value", "float64"),
            "c_mktsegment": ("ClassLabel", ""),
        },
    )


@query(
    "numerical_float32",
    "SELECT p_partkey, CAST(p_retailprice AS FLOAT) AS p_retailprice, CAST(p_size AS FLOAT) AS p_size FROM part",
)
def _numerical(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return sc.change_columns_type(part, {"p_retailprice": "Numerical", "p_size": "Numerical"})


@query(
    "cast_schema",
    """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
         CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem""",
)
def _cast_schema(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sc.cast_schema(
        rows, T.StructType.fromDDL("l_orderkey string, l_linenumber bigint, l_quantity bigint")
    )


@query("sample_head", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 50")
def _sample_head(spark, sf):
    return ds.sample(ds.with_row_ids(table(spark, sf, "events")), 50).select("event_id", "value")


@query("sample_tail", "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 50")
def _sample_tail(spark, sf):
    rows = ds.with_row_ids(table(spark, sf, "events"))
    return ds.sample(rows, 50, "tail").select("event_id", "value")


@query(
    "sample_random",
    """WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events)
       SELECT d.i AS draw, e.event_id, e.value
       FROM range(100) AS d(i) JOIN e
         ON e.r = CAST('0x' || substr(md5('3:' || d.i), 1, 15) AS BIGINT) % (SELECT count(*) FROM events)""",
)
def _sample_random(spark, sf):
    rows = ds.with_row_ids(table(spark, sf, "events"))
    return ds.sample(rows, 100, "random", seed=3).select("draw", "event_id", "value")


@query(
    "page_desc",
    "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 25 OFFSET 50",
)
def _page(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return ds.page(orders, 25, number=2, by="o_orderkey")


@query(
    "concat_splits",
    """SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1""",
)
def _concat_splits(spark, sf):
    rows = ds.with_row_ids(table(spark, sf, "lineitem")).select(ROW_ID, "l_returnflag", "l_quantity")
    parts = split_exact(rows, 0.6, 0.2, 0.2, seed=5)
    whole = ds.concat_splits(*[parts.filter(F.col(SPLIT) == s) for s in ("train", "test", "validation")])
    return whole.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query(
    "zip_by_row_id",
    "SELECT o_orderkey AS _row_id, o_totalprice, o_orderpriority FROM orders",
)
def _zip(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", ROW_ID)
    return ds.zip_by_row_id(orders.select(ROW_ID, "o_totalprice"), orders.select(ROW_ID, "o_orderpriority"))


@query(
    "select_rows",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def _select_rows(spark, sf):
    owing = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return ds.select_rows(table(spark, sf, "orders"), owing, "o_custkey").select("o_orderkey", "o_totalprice")
