"""The classifiers, by name, each as a fitted ``PipelineModel``.

A model takes the raw input columns and adds ``probability`` (array of doubles, one per class) and
``prediction``. Known differences from single-machine libraries are noted at each classifier.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion, SQLTransformer, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablelab.models.grown import GrownTrees, Rules, boost, forest
from tablelab.models.knn import fit_knn
from tablelab.models.stages import ClassProbabilities, Landmarks, PriorProbabilities
from tablelab.models.text_linear import TextLinearModel, fit_text_linear
from tablelab.operators.features import assemble, bag_of_words
from tablelab.operators.schema import class_names

FEATURES = "_features"
# Rows that are looked at per landmark at first.
LANDMARK_DRAWS = 8
# Rows for each core up to which several classes are fitted at once.
CLASS_ROWS = 1_000_000


def _max_bins(df: DataFrame) -> int:
    """Tree bins must cover the largest category count of the indexed text inputs."""
    attrs = df.schema[FEATURES].metadata.get("ml_attr", {}).get("attrs", {})
    return max([32, *[len(a.get("vals", [])) + 1 for a in attrs.get("nominal", [])]])


def _common(label: str) -> dict:
    return {
        "featuresCol": FEATURES,
        "labelCol": label,
        "predictionCol": "_prediction",
    }


def _soft(label: str) -> dict:
    return {**_common(label), "probabilityCol": "_probability", "rawPredictionCol": "_raw"}


def _one_stage(estimator, df) -> list[Transformer]:
    return [estimator.fit(df), ClassProbabilities(vectors=["_probability"])]


def _each_class(df: DataFrame, label: str, k: int, fit_one: Callable, rows: int) -> list[Transformer]:
    """One-against-rest fits, a few at a time; two classes need only the second one's model.

    Each fit caches its own copy of the rows. Those of a table that has more than ``CLASS_ROWS`` rows for each core keep
    all cores busy by themselves and go one after another, so that there is one such copy at a time.
    """
    if k == 2:
        return [*fit_one(df.withColumn("_is", F.col(label)), 1), ClassProbabilities(vectors=["_p1"])]

    def run(c: int):
        return fit_one(df.withColumn("_is", (F.col(label) == c).cast("double")), c)

    at_once = 1 if rows > CLASS_ROWS * df.sparkSession.sparkContext.defaultParallelism else min(k, 4)
    with ThreadPool(at_once) as pool:
        fitted = pool.map(inheritable_thread_target(df.sparkSession)(run), range(k))
    stages = [s for one in fitted for s in one]
    return [*stages, ClassProbabilities(vectors=[f"_p{c}" for c in range(k)])]


def _logistic(df, label, k, *, penalty="l2", tol=1e-3, C=1.0, max_iter=100):
    """Penalty weights follow ``C * sum(loss) + penalty``; inputs are not standardised."""
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.5}[penalty]
    estimator = LogisticRegression(
        **_soft(label), family="auto", regParam=1.0 / (C * max(df.count(), 1)), elasticNetParam=mix,
        tol=tol, maxIter=max_iter, standardization=False,
    )
    return _one_stage(estimator, df)


_IMPURITY = {"entropy": "entropy", "log_loss": "entropy", "gini": "gini"}


def _grown(trees: str) -> list[Transformer]:
    return [GrownTrees(inputCol=FEATURES, outputCol="_probability", trees=trees),
            ClassProbabilities(vectors=["_probability"])]


# Deepest trees of Spark's own learners; what they cannot do is grown best-first (``grown``), where text
# inputs are split in the order of their codes.
SPARK_DEPTH = 30


def _tree(
    df, label, k, *, criterion="entropy", max_depth=1, min_samples_split=None, min_samples_leaf=1,
    max_features=None, random_state=0, max_leaf_nodes=None,
):
    """Trees of unlimited or large depth, of limited leaves, or whose nodes need more than two rows to be
    split, are grown best-first; others are Spark's."""
    subset = "sqrt" if max_features == "auto" else max_features
    if (min_samples_split or 2) > 2 or max_leaf_nodes or not max_depth or max_depth > SPARK_DEPTH:
        rules = Rules(max_leaf_nodes, max_depth, min_samples_split or 2, min_samples_leaf)
        return _grown(forest(df, FEATURES, label, k, 1, _IMPURITY[criterion], rules, False, subset, random_state or 0))
    shared = {
        **_soft(label), "impurity": _IMPURITY[criterion], "maxDepth": max_depth,
        "minInstancesPerNode": min_samples_leaf, "maxBins": _max_bins(df), "seed": random_state,
    }
    if max_features is None:
        return _one_stage(DecisionTreeClassifier(**shared), df)
    one = RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy=subset, **shared)
    return _one_stage(one, df)


def _forest(
    df, label, k, *, n_estimators=100, max_depth=2, min_samples_split=None, min_samples_leaf=1,
    max_leaf_nodes=None, random_state=0,
):
    """Grown best-first in the same cases as a single tree; rows are then weighed by Poisson draws."""
    if (min_samples_split or 2) > 2 or max_leaf_nodes or not max_depth or max_depth > SPARK_DEPTH:
        rules = Rules(max_leaf_nodes, max_depth, min_samples_split or 2, min_samples_leaf)
        return _grown(forest(df, FEATURES, label, k, n_estimators, "gini", rules, True, "sqrt", random_state or 0))
    estimator = RandomForestClassifier(
        **_soft(label), numTrees=n_estimators, maxDepth=max_depth,
        minInstancesPerNode=min_samples_leaf, maxBins=_max_bins(df), seed=random_state or 0,
    )
    return _one_stage(estimator, df)


def _boosting(
    df, label, k, *, learning_rate=0.1, max_iter=100, max_depth=1, max_leaf_nodes=None,
    min_samples_leaf=20, l2_regularization=None,
):
    """Histogram boosting, best-first, one softmax over all classes. Two classes without limited leaves, l2
    penalty or unlimited depth are Spark's trees, level by level."""
    if k > 2 or max_leaf_nodes or l2_regularization or not max_depth or max_depth > SPARK_DEPTH:
        rules = Rules(max_leaf_nodes, max_depth, 2, min_samples_leaf, l2_regularization or 0.0)
        return _grown(boost(df, FEATURES, label, k, max_iter, learning_rate, rules))
    estimator = GBTClassifier(
        featuresCol=FEATURES, labelCol=label, predictionCol="_said", stepSize=learning_rate,
        maxIter=max_iter, maxDepth=max_depth, minInstancesPerNode=min_samples_leaf, maxBins=_max_bins(df), seed=0,
    )
    estimator.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    return [estimator.fit(df), ClassProbabilities(vectors=["_probability"])]


def _kernel_width(df: DataFrame, gamma: str | float, size: int) -> float:
    if not isinstance(gamma, str):
        return float(gamma)
    if gamma == "auto":
        return 1.0 / size
    s = df.select(Summarizer.metrics("mean", "normL2", "count").summary(F.col(FEATURES)).alias("s"))
    row = s.select("s.*").first()
    squares = float((row["normL2"].toArray() ** 2).sum()) / (row["count"] * size)
    variance = squares - float(row["mean"].toArray().mean()) ** 2
    return 1.0 / (size * variance) if variance > 0 else 1.0


def _landmarks(df: DataFrame, most: int, seed: int) -> str:
    """At most ``most`` distinct rows, chosen by a hash: those of the lowest hashes.

    Only rows below a bound on the hash are sent, a few times ``most`` of them; the bound is raised until there are
    enough distinct ones below it.
    """
    x = vector_to_array(F.col(FEATURES))
    rows = df.select(x.alias("x"), F.xxhash64(x, F.lit(seed)).alias("h"))
    share = LANDMARK_DRAWS * most / max(df.count(), 1)
    while True:
        below = rows if share >= 1 else rows.filter(F.col("h") < int(share * (1 << 64)) - (1 << 63))
        chosen = below.distinct().orderBy("h", "x").limit(most).collect()
        if share >= 1 or len(chosen) == most:
            return json.dumps([r["x"] for r in chosen])
        share *= 64


def _svc(
    df, label, k, *, C=1.0, kernel="rbf", degree=3, gamma="scale", coef0=None, tol=1e-3,
    max_iter=100, probability=True, shrinking=None, verbose=None, n_components=256, random_state=0,
):
    """Linear machines on mapped inputs: none for ``linear``, the kernel at ``n_components`` landmarks for
    ``rbf``, ``poly`` and ``sigmoid``. A ``poly`` without ``coef0`` has all monomials up to its degree instead,
    weighed alike. Fitted one against the rest, with margins turned into probabilities by a logistic curve
    (Platt). ``shrinking`` and ``verbose``, which change no result, are ignored.
    """
    size = len(df.select(FEATURES).head()[0])
    mapped, maps = FEATURES, []
    if kernel == "poly" and coef0 is None:
        maps = [PolynomialExpansion(degree=int(degree), inputCol=FEATURES, outputCol="_mapped")]
    elif kernel in ("rbf", "poly", "sigmoid"):
        maps = [
            Landmarks(
                inputCol=FEATURES, outputCol="_mapped", kernel=kernel, gamma=_kernel_width(df, gamma, size),
                coef0=float(coef0 or 0), degree=int(degree), points=_landmarks(df, n_components, random_state or 0),
            )
        ]
    elif kernel != "linear":
        raise ValueError(f"kernel should be linear, poly, rbf or sigmoid, got {kernel}")
    for stage in maps:
        df, mapped = stage.transform(df), "_mapped"
    df = df.select(label, mapped)
    if maps:  # unmapped rows are cached already
        df.persist()
    try:
        count = df.count()
        reg = 1.0 / (C * max(count, 1))

        def fit_one(rows, c):
            machine = LinearSVC(
                featuresCol=mapped, labelCol="_is", predictionCol=f"_side{c}",
                rawPredictionCol=f"_raw{c}", regParam=reg, tol=tol,
                maxIter=max_iter if max_iter > 0 else 1000, standardization=False,
            )
            margin = VectorSlicer(inputCol=f"_raw{c}", outputCol=f"_margin{c}", indices=[1])
            curve = LogisticRegression(
                featuresCol=f"_margin{c}", labelCol="_is", predictionCol=f"_said{c}",
                probabilityCol=f"_p{c}", rawPredictionCol=f"_curve{c}",
            )
            return Pipeline(stages=[machine, margin, curve]).fit(rows).stages

        return [*maps, *_each_class(df, label, k, fit_one, count)]
    finally:
        if maps:
            df.unpersist()


def _dummy(df, label, k, *, strategy="prior", random_state=0):
    if strategy not in ("most_frequent", "prior", "stratified", "uniform"):
        raise ValueError(f"unknown strategy {strategy}")
    counts = {int(c): n for c, n in df.groupBy(label).count().collect()}  # one row per class
    total = sum(counts.values())
    priors = [counts.get(c, 0) / total for c in range(k)]
    return [PriorProbabilities(strategy=strategy, priors=priors, seed=random_state)]


def _neighbours(df, label, k, *, n_neighbors=5, weights="uniform", algorithm="auto", recall=0.9, random_state=0):
    """Exact, but for the algorithm ``approx``, which looks in as many buckets as ``recall`` takes; the other
    algorithms are indexes of one machine, which change no answer."""
    approx = recall if algorithm == "approx" else None
    return [fit_knn(df, FEATURES, label, k, n_neighbors, weights, approx, random_state or 0),
            ClassProbabilities(vectors=["_probability"])]


CLASSIFIERS = {
    "LogisticRegression": _logistic,
    "DecisionTreeClassifier": _tree,
    "RandomForestClassifier": _forest,
    "HistGradientBoostingClassifier": _boosting,
    "KNeighborsClassifier": _neighbours,
    "SVC": _svc,
    "DummyClassifier": _dummy,
}


def _fit(df, features: list, name: str, params: dict | None, output: str) -> PipelineModel:
    if name not in CLASSIFIERS:
        raise ValueError(f"{name} is not a classifier; choose from {', '.join(CLASSIFIERS)}")
    k = len(class_names(df, output))
    prepared = Pipeline(stages=features).fit(df)
    # features are made once, however many passes and classes a classifier needs
    rows = prepared.transform(df).filter(F.col(output).isNotNull()).persist()
    try:
        stages = CLASSIFIERS[name](rows, output, k, **(params or {}))
    finally:
        rows.unpersist()
    return PipelineModel([*prepared.stages, *stages])


def fit(
    df: DataFrame, name: str, inputs: list[str], output: str, params: dict | None = None
) -> PipelineModel:
    """Fit a classifier on every row of ``df``; ``output`` must be an encoded label."""
    if name == "DummyClassifier":
        model = _fit(df, [SQLTransformer(statement="SELECT * FROM __THIS__")], name, params, output)
    else:
        model = _fit(df, assemble(df, inputs, FEATURES), name, params, output)
    return about(model, df, inputs, output)


def fit_text(
    df: DataFrame, name: str, text: str, output: str, params: dict | None = None,
    ngram_min_n: int = 1, ngram_max_n: int = 1,
) -> PipelineModel | TextLinearModel:
    """Fit any classifier on the bag of words of a text column, of any number of terms.

    Logistic regression keeps its coefficients in a table (``text_linear``). The other classifiers, and it
    with a penalty other than ``l2``, learn on sparse vectors and hold what they know of each term themselves.
    """
    given = dict(params or {})
    if name == "LogisticRegression" and given.pop("penalty", "l2") == "l2":
        model = fit_text_linear(df, text, output, len(class_names(df, output)), min_n=ngram_min_n, max_n=ngram_max_n, **given)
    else:
        model = _fit(df, bag_of_words(text, ngram_min_n, ngram_max_n, FEATURES), name, params, output)
    return about(model, df, [text], output)


def about(model, df: DataFrame, inputs: list[str], output: str):
    """Notes on the model what scoring by name needs: the class names and the input columns."""
    model.class_names = class_names(df, output)
    model.input_schema = df.select(*[F.col(f"`{c}`") for c in inputs]).schema
    return model


def save(model: PipelineModel | TextLinearModel, path: str) -> None:
    """Saves the model with its class names and input columns."""
    if isinstance(model, TextLinearModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)
    if hasattr(model, "class_names"):
        facts = [(model.class_names, model.input_schema.json())]
        SparkSession.getActiveSession().createDataFrame(facts, "names array<string>, inputs string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/about")


def load(path: str) -> PipelineModel | TextLinearModel:
    spark = SparkSession.getActiveSession()
    model = _if_there(lambda: TextLinearModel.load(spark, path)) or PipelineModel.load(path)
    facts = _if_there(lambda: spark.read.parquet(f"{path}/about").first())
    if facts is not None:
        model.class_names = list(facts["names"])
        model.input_schema = StructType.fromJson(json.loads(facts["inputs"]))
    return model


def _if_there(read: Callable):
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return None
