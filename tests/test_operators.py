import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab import ROW_ID, SPLIT
from tablelab.functions import display_split, format_timestamp, metric_column, run_status, two_decimals
from tablelab.operators import dataset as ds
from tablelab.operators import schema as sc
from tablelab.operators import tasks
from tablelab.operators.converters import ColumnDropperByIndex, ColumnDropperByName
from tablelab.operators.metrics import check_lengths, classification_scores, with_predicted_class
from tablelab.operators.quantiles import exact_quantiles
from tablelab.operators.ranks import cut_points, hash_key, hash_rank
from tablelab.operators.splits import (
    check_split_values,
    resplit,
    split_approximate,
    split_by_ranges,
    split_exact,
    split_sizes,
)
from tablelab.operators.translation import bleu, ter, ter_edits


def rows_of(spark, n):
    return spark.range(n).withColumnRenamed("id", ROW_ID)


def sizes(df):
    return {r[SPLIT]: r["count"] for r in df.groupBy(SPLIT).count().collect()}


@pytest.mark.parametrize(
    "fractions, wanted",
    [((0.5, 0.25, 0.25), (75, 37, 38)), ((0.7, 0.15, 0.15), (105, 22, 23)),
     ((0.2, 0.75, 0.05), (30, 112, 8)), ((0.5, 0.3, 0.2), (75, 45, 30)), ((1.0, 0.0, 0.0), (150, 0, 0))],
)
def test_exact_sizes(spark, fractions, wanted):
    assert split_sizes(150, *fractions) == wanted
    got = sizes(split_exact(rows_of(spark, 150), *fractions, seed=3))
    assert got == {k: v for k, v in zip(("train", "test", "validation"), wanted) if v}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 400), cut=st.integers(0, 400), seed=st.integers(0, 5))
def test_cut_points_take_exactly_the_wanted_rows(spark, n, cut, seed):
    df = rows_of(spark, n)
    key = hash_key(seed, ROW_ID)
    found = cut_points(df, key, lambda total: [min(cut, total)], digits=1)[""][0]
    assert df.filter(key < found).count() == min(cut, n)


def test_split_is_repeatable_and_seeded(spark):
    df = rows_of(spark, 200)
    a = split_exact(df, 0.6, 0.2, 0.2, seed=1).collect()
    assert sorted(a) == sorted(split_exact(df.repartition(5), 0.6, 0.2, 0.2, seed=1).collect())
    assert sorted(a) != sorted(split_exact(df, 0.6, 0.2, 0.2, seed=2).collect())


def test_unshuffled_and_manual_splits(spark):
    df = rows_of(spark, 150)
    blocks = split_exact(df, 0.5, 0.3, 0.2, shuffle=False)
    assert blocks.filter("split = 'train'").agg(F.max(ROW_ID)).first()[0] == 74
    manual = split_by_ranges(df, [(0, 99)], [(100, 129)], [(130, 149)])
    assert sizes(manual) == {"train": 100, "test": 30, "validation": 20}
    again = resplit(manual, {"ranges": {"train": [(0, 9)], "test": [(10, 19)], "validation": []}})
    assert sizes(again) == {"train": 10, "test": 10}
    with pytest.raises(ValueError, match="more than once"):
        split_by_ranges(df, [(0, 10)], [(10, 20)], [])
    both = split_by_ranges(df, [(0, 10)], [(10, 20)], [], allow_overlap=True)
    assert both.filter(f"{ROW_ID} = 10").count() == 2


def test_stratified_split_of_a_hot_class(spark):
    df = rows_of(spark, 300).withColumn("c", F.when(F.col(ROW_ID) < 200, "hot").otherwise("cold"))
    out = split_exact(df, 0.5, 0.25, 0.25, seed=1, stratify="c").groupBy("c", SPLIT).count().collect()
    assert {(r[0], r[1]): r[2] for r in out} == {
        ("hot", "train"): 100, ("hot", "test"): 50, ("hot", "validation"): 50,
        ("cold", "train"): 50, ("cold", "test"): 25, ("cold", "validation"): 25,
    }


def test_approximate_split(spark):
    got = sizes(split_approximate(rows_of(spark, 5000), 0.6, 0.2, 0.2, seed=1))
    assert abs(got["train"] - 3000) < 200 and sum(got.values()) == 5000


def test_split_values_are_checked():
    with pytest.raises(ValueError, match="test_size"):
        check_split_values(0.5, 1.5, 0.2)
    with pytest.raises(ValueError, match="add up"):
        check_split_values(0.5, 0.3, 0.1)


def test_hash_rank_is_a_permutation(spark):
    df = rows_of(spark, 500).withColumn("g", F.col(ROW_ID) % 2)
    ranked = hash_rank(df, hash_key(1, ROW_ID), within=["g"], n=10_000_000).collect()
    for g in (0, 1):
        assert sorted(r["rank"] for r in ranked if r["g"] == g) == list(range(250))


def test_row_ids_over_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 100, 1, 4).write.parquet(path)
    ids = ds.with_row_ids(spark.read.parquet(path))
    assert sorted(r[0] for r in ids.select(ROW_ID).collect()) == list(range(100))
    assert ids.filter(F.col("id") != F.col(ROW_ID)).count() == 0  # files are in id order


def test_parse_ranges():
    assert ds.parse_ranges("1-3, 5,8-9", 10) == [(1, 3), (5, 5), (8, 9)]
    assert ds.rows_from_ranges("1-3", 10) == [(0, 2)]
    for text, message in (("1-", "format"), ("a", "format"), ("1-11", "minor"), ("11", "minor"), ("5-3", "second")):
        with pytest.raises(ValueError, match=message):
            ds.parse_ranges(text, 10)


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True, None)], "a int, b double, c string, d boolean, e int")
    assert ds.column_names(df, [1, 3, 4]) == ["a", "c", "d"]
    with pytest.raises(ValueError, match="greater than the total"):
        ds.column_names(df, [6])
    with pytest.raises(ValueError, match="start at 1"):
        ds.column_names(df, [0])
    assert ds.default_roles(df) == (["a", "b", "c", "d"], ["e"])
    assert ds.drop_by_index(df, (1, 99)).columns == ["a"]
    assert ds.drop_by_index(df, 0).columns == ["b", "c", "d", "e"]
    with pytest.raises(ValueError):
        ds.remove_columns(df, "zz")
    with pytest.raises(TypeError):
        ds.select_features(df, "a")
    assert ds.select_features(df, ["c", "a"]).columns == ["a", "c"]
    with pytest.raises(ValueError, match="must not be empty"):
        ds.validate_inputs_outputs(df, [], ["a"])
    with pytest.raises(ValueError, match="Extra elements: zz"):
        ds.validate_inputs_outputs(df, ["a", "zz"], ["b"])
    with pytest.raises(ValueError, match="more elements than names"):
        ds.validate_inputs_outputs(df, ["a", "b", "c", "d", "e"], ["b"])


def test_droppers_are_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    for i, stage in enumerate((ColumnDropperByName(columnNames=["b"]), ColumnDropperByIndex(first=1))):
        stage.write().overwrite().save(str(tmp_path / str(i)))
        assert type(stage).load(str(tmp_path / str(i))).transform(df).columns == ["a", "c"]


def test_samples(spark):
    df = rows_of(spark, 50).repartition(4)
    assert [r[0] for r in ds.sample(df, 3).collect()] == [0, 1, 2]
    assert [r[0] for r in ds.sample(df, 3, "tail").collect()] == [47, 48, 49]
    drawn = [r[ROW_ID] for r in ds.sample(df, 50, "random", seed=1).collect()]
    assert len(drawn) == 50 and set(drawn) <= set(range(50)) and len(set(drawn)) < 50
    with pytest.raises(ValueError, match="less than or equal"):
        ds.sample(df, 51)
    gaps = df.filter(F.col(ROW_ID) % 3 == 1)
    assert [r[ROW_ID] for r in ds.sample(gaps, 3).collect()] == [1, 4, 7]
    assert [r[ROW_ID] for r in ds.sample(gaps, 2, "tail").collect()] == [46, 49]
    assert ds.sample(gaps, 0).count() == 0 and ds.sample(df.limit(0), 0, "tail").count() == 0
    some = [r[ROW_ID] for r in ds.sample_without_replacement(df, 7, seed=2).collect()]
    by_hash = sorted(range(50), key=lambda i: hashlib.md5(f"2:{i}".encode()).hexdigest())
    assert sorted(some) == sorted(by_hash[:7])
    assert ds.sample_without_replacement(df, 90).count() == 50
    assert ds.sample_without_replacement(df.limit(0), 3).count() == 0
    rows = ds.from_rows(spark, [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}])
    assert rows.columns == ["a", "b", ROW_ID, SPLIT] and rows.count() == 2


def test_label_encoding(spark, tmp_path):
    df = spark.createDataFrame([(10, "b"), (2, "a"), (2, None)], "k int, s string")
    out = sc.change_columns_type(df, {"k": "Categorical", "s": "Categorical"})
    assert [tuple(r) for r in out.collect()] == [(1.0, 1.0), (0.0, 0.0), (0.0, None)]
    assert sc.class_names(out, "k") == ["2", "10"]
    out.write.parquet(str(tmp_path / "x"))
    assert sc.class_names(spark.read.parquet(str(tmp_path / "x")), "s") == ["a", "b"]
    with pytest.raises(ValueError, match="fractions"):
        sc.encode_label(spark.createDataFrame([(1.5,)], "x double"), "x")
    with pytest.raises(ValueError, match="does not exist"):
        sc.change_columns_type(df, {"zz": "Numerical"})
    with pytest.raises(ValueError, match="38 digits"):
        sc.spark_type("decimal256")
    bad = sc.update_columns_spec(df, {"s": ("Value", "int64")})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.collect()


def test_tasks(spark):
    df = spark.createDataFrame([("hi", "hola", 1)], "text string, other string, y int")
    assert tasks.metadata("TranslationTask")["inputs_cardinality"] == 1
    assert tasks.prepare_for_task(df, "TranslationTask", ["other"]) is df
    prepared = tasks.prepare_for_task(df, "TextClassificationTask", ["y"])
    tasks.validate_for_task(prepared, "TextClassificationTask", ["text"], ["y"])
    with pytest.raises(TypeError):
        tasks.validate_for_task(df, "TextClassificationTask", ["text"], ["y"])
    with pytest.raises(ValueError):
        tasks.validate_for_task(prepared, "TextClassificationTask", ["text", "other"], ["y"])
    assert tasks.compatible_metrics("TranslationTask") == ("Bleu", "Ter")


def test_scalar_functions(spark):
    df = spark.createDataFrame([(3, "test_metrics", 0.5, None)], "c int, s string, v double, t timestamp")
    row = df.select(
        run_status("c"), display_split("s"), two_decimals("v"), format_timestamp("t"),
        metric_column(F.lit("validation"), F.lit("F1")),
    ).first()
    assert tuple(row) == ("Finished", "test", "0.50", "", "val_F1")
    for bad in (run_status(F.lit(9)), display_split(F.lit("x"))):
        with pytest.raises(Exception, match="Error"):
            df.select(bad).collect()


def scores(spark, pairs):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "y double, p double")
    return classification_scores(df, "y", "p", by=[]).first()


def test_macro_metrics_by_hand(spark):
    # class 3 is only ever predicted: it counts in the macro mean of precision, not in recall's
    s = scores(spark, [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3)])
    assert s["Accuracy"] == pytest.approx(3 / 5)
    assert s["Precision"] == pytest.approx((1 + 1 / 2 + 1 + 0) / 4)
    assert s["Recall"] == pytest.approx((1 / 2 + 1 + 1 / 2 + 0) / 4)
    assert s["F1"] == pytest.approx((2 / 3 + 2 / 3 + 2 / 3 + 0) / 4)
    assert s["BalancedAccuracy"] == pytest.approx((1 / 2 + 1 + 1 / 2) / 3)


def test_binary_metrics_by_hand(spark):
    s = scores(spark, [(0, 0), (0, 1), (1, 1), (1, 0), (1, 1)])
    assert (s["Precision"], s["Recall"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    none = scores(spark, [(0, 0), (0, 0)])
    assert (none["Accuracy"], none["Precision"], none["F1"]) == (1.0, 0.0, 0.0)


def test_unnormalised_probabilities(spark):
    df = spark.createDataFrame(
        [(1.0, [0.1, 0.1, 0.8]), (2.0, [0.0, 0.8, 0.2]), (0.0, [0.9, 0.0, 0.5])], "y double, probability array<double>"
    )
    got = with_predicted_class(df)
    assert [r.prediction for r in got.collect()] == [2.0, 1.0, 0.0]
    assert classification_scores(got, "y", by=[]).first()["Accuracy"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError, match="must be equal"):
        check_lengths(df, df.limit(1))


def test_bleu_by_hand(spark):
    rows = [(1, "the cat sat on the mat", "the cat is on the mat"), (2, "a b c d e", "a b c d e")]
    df = spark.createDataFrame(rows, "id int, c string, r string")
    got = bleu(df, "c", "r", "id").first()[0]
    p = [(5 + 5) / 11, (3 + 4) / 9, (1 + 3) / 7, (0 + 2) / 5]
    assert got == pytest.approx(math.exp(sum(map(math.log, p)) / 4))
    same = df.withColumn("c", F.col("r"))
    assert bleu(same, "c", "r", "id").first()[0] == pytest.approx(1.0)
    short = spark.createDataFrame([(1, "a b c d", "a b c d e f g h")], "id int, c string, r string")
    assert bleu(short, "c", "r", "id").first()[0] == pytest.approx(math.exp(1 - 8 / 4))
    assert bleu(spark.createDataFrame([(1, "x", "y")], "id int, c string, r string"), "c", "r", "id").first()[0] == 0


def test_ter_by_hand(spark):
    assert ter_edits("a b c d", "a b c d") == 0
    assert ter_edits("c d a b", "a b c d") == 1  # one block shift
    assert ter_edits("", "a b") == 2 and ter_edits("a b", "") == 2
    assert ter_edits(
        "this week the saudis denied information published in the new york times",
        "saudi arabia denied this week information published in the american new york times",
    ) == 4
    assert ter_edits("c d a b", "a b c d", max_size=1) == 2  # word by word
    assert ter_edits("c d a b", "a b c d", max_distance=0) == 4  # no shift at all
    # thousands of moves, all of them tried; the one that helps goes from end to end
    assert ter_edits("x y " * 60, "y x " * 60) == 2
    assert ter_edits("x y " * 60, "y x " * 60, max_distance=120) == 1
    df = spark.createDataFrame([("a b c d", "a b c d"), ("c d a b", "a b c d")], "c string, r string")
    assert ter(df, "c", "r").first()["Ter"] == pytest.approx(100 / 8)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, prev = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


words = st.lists(st.sampled_from("abcd"), max_size=9)


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_ter_never_exceeds_the_word_edit_distance(a, b):
    edits = ter_edits(" ".join(a), " ".join(b))
    assert abs(len(a) - len(b)) <= edits <= plain_edits(a, b)


def test_exact_quantiles(spark, monkeypatch):
    import numpy as np

    from tablelab.operators import quantiles

    values = np.random.default_rng(0).normal(size=4000).round(2)
    values[:1500] = 0.25  # a hot value
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    for limit in (2000, 20):
        monkeypatch.setattr(quantiles, "COLLECT_VALUES", limit)
        got = exact_quantiles(df, ["v"], [0.0, 0.05, 0.5, 0.95, 1.0])["v"]
        assert got == pytest.approx(np.quantile(values, [0.0, 0.05, 0.5, 0.95, 1.0]))


def test_types_have_spark_counterparts(spark):
    for name in sc.DTYPES:
        T.StructType.fromDDL(f"a {sc.spark_type(name)}")


def test_null_and_empty_strata_are_split_apart(spark):
    rows = [(i, None if i % 2 else "") for i in range(40)]
    out = split_exact(spark.createDataFrame(rows, "_row_id long, c string"), 0.5, 0.25, 0.25, stratify="c")
    got = {(r["c"], r[SPLIT]): r["count"] for r in out.groupBy("c", SPLIT).count().collect()}
    assert got == {(c, s): n for c in (None, "") for s, n in (("train", 10), ("test", 5), ("validation", 5))}


def test_more_classes_than_metadata_holds(spark, monkeypatch):
    from tablelab.operators import schema

    df = spark.createDataFrame([(i, f"k{i % 30:02d}") for i in range(60)] + [(60, None)], "i int, c string")
    named = {r["i"]: r["c"] for r in schema.encode_label(df, "c").collect()}
    monkeypatch.setattr(schema, "MAX_CLASSES", 20)
    coded = schema.encode_label(df, "c")
    assert {r["i"]: r["c"] for r in coded.collect()} == named
    assert schema.is_label(coded.schema["c"]) and schema.encode_label(coded, "c") is coded
    with pytest.raises(ValueError, match="too many classes"):
        schema.class_names(coded, "c")


def test_bleu_counts_pairs_with_a_null_side(spark):
    from tablelab.operators.translation import ngram_matches

    df = spark.createDataFrame(
        [(1, "a b c d e", None), (2, None, "a b c d e"), (3, "a b c d", "a b c d e")], "i int, c string, r string")
    row = ngram_matches(df, "c", "r", "i").first()
    assert (row["total_1"], row["reference_length"], row["match_1"]) == (9, 10, 4)
