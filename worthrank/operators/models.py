"""Model operators on Spark MLlib.

The frozen-encoder classifier of the task is a linear softmax layer over fixed features, which
is exactly (class-weighted) logistic regression: features come from a supplied embedding column
(``array_to_vector``) or from hashed word n-grams; MLlib fits it with distributed
``treeAggregate`` gradient passes. Scores are p1 - p0 from the ``probability`` vector (never from
``rawPrediction``, whose binomial form is [-m, m]).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worthrank.functions.scalar import binarize, hash_key, margin
from worthrank.operators.metrics import best_by
from worthrank.operators.prepare import weight_columns

NUM_HASH_FEATURES = 1 << 16


def random_scores(df: DataFrame, id_col: str, seed: int = 42, out: str = "score") -> DataFrame:
    """M1: a reproducible random ranking, score in [0, 1) from a keyed hash of the id."""
    h = F.abs(hash_key(id_col, seed) % F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    return df.withColumn(out, h)


def ngram_pipeline(text_col: str = "text", label_col: str = "label", weight_col: str | None = "weight",
                   n: int = 2, num_features: int = NUM_HASH_FEATURES, reg: float = 0.0,
                   max_iter: int = 20) -> Pipeline:
    """M2: lower-cased word tokens + word n-grams -> hashed term frequencies -> IDF -> logistic
    regression. Everything is a built-in JVM stage. A null text counts as empty (the tokenizer would fail on it)."""
    whole = SQLTransformer(statement=f"SELECT *, coalesce(`{text_col}`, '') AS _text FROM __THIS__")
    tok = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True,
                         minTokenLength=1)
    grams = NGram(n=n, inputCol="_words", outputCol="_grams")
    both = SQLTransformer(statement="SELECT *, concat(_words, _grams) AS _terms FROM __THIS__")
    tf = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, family="binomial", regParam=reg,
                            maxIter=max_iter, **({"weightCol": weight_col} if weight_col else {}))
    return Pipeline(stages=[whole, tok, grams, both, tf, idf, lr])


def embedding_features(df: DataFrame, vec_col: str = "embedding", out: str = "features") -> DataFrame:
    """A supplied embedding array as an MLlib vector (the frozen encoder's output)."""
    return df.withColumn(out, array_to_vector(F.col(vec_col).cast("array<double>")))


def frozen_head(label_col: str = "label", weight_col: str | None = "weight", reg: float = 0.0,
                max_iter: int = 100) -> LogisticRegression:
    """M3: the linear head over fixed features."""
    return LogisticRegression(featuresCol="features", labelCol=label_col, family="binomial", regParam=reg,
                              maxIter=max_iter, **({"weightCol": weight_col} if weight_col else {}))


def with_weights(df: DataFrame, label_col: str = "label", use_class_weights: bool = True,
                 extra: str | None = None) -> DataFrame:
    """Training weights: class weights N/n_c (or 1.0) times an optional per-row factor (M6)."""
    if use_class_weights:
        w0, w1 = weight_columns(df, label_col)
        w = F.when(F.col(label_col) == 1, w1).otherwise(w0)
    else:
        w = F.lit(1.0)
    if extra is not None:
        w = w * F.col(extra)
    return df.withColumn("weight", w.cast("double"))


def score(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """M4: batch scoring; ``score`` = p1 - p0 and the argmax ``prediction``."""
    out = model.transform(df)
    p = vector_to_array("probability")
    return out.select(*keep, margin(p[0], p[1]).alias("score"),
                      F.col("prediction").cast("int").alias("prediction"))


def score_with_pandas(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], keep: Sequence[str]) -> DataFrame:
    """M4 extension point: bring-your-own scorer over Arrow batches (``mapInPandas``); the
    function maps a pandas batch to a Series of scores."""
    from worthrank.session import ship_package

    ship_package(df.sparkSession)
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[list(keep)].copy()
            out["score"] = scorer(pdf).astype("float64").to_numpy()
            yield out

    return df.mapInPandas(run, schema)


def training_frame(train: DataFrame) -> DataFrame:
    """Training rows dealt out into partitions whose number follows the rows (one per core at least) and
    persisted (memory and disk) for an iterative fit: a single-file source can leave them in one
    partition, and every optimiser pass would then run on one core. One shuffle of the training
    rows buys all cores for every pass; lost blocks are recomputed from lineage."""
    from pyspark import StorageLevel

    from worthrank.session import tasks_for

    return train.repartition(tasks_for(train)).persist(StorageLevel.MEMORY_AND_DISK)


def fit_persisted(estimator, train: DataFrame):
    """Fit on ``training_frame(train)``, unpersisting afterwards."""
    frame = training_frame(train)
    try:
        return estimator.fit(frame)
    finally:
        frame.unpersist()


def accuracy(scored: DataFrame, label_col: str = "label") -> DataFrame:
    """A10 on a scored frame, one row."""
    return scored.agg(F.avg((F.col("prediction") == F.col(label_col)).cast("double")).alias("accuracy"))


def select_best(train: DataFrame, val: DataFrame, candidates: Sequence[dict], make_estimator,
                keep: Sequence[str], label_col: str = "label", parallelism: int = 4):
    """M5 + A15: fit every candidate setting on the persisted training rows, measure validation
    accuracy, keep the best; ties go to the earliest candidate. Independent fits run as concurrent
    Spark jobs (like ``TrainValidationSplit(parallelism=...)``); results do not depend on it.
    Returns (best_model, table)."""
    from concurrent.futures import ThreadPoolExecutor

    train = training_frame(train)

    def fit_one(i_params):
        i, params = i_params
        m = make_estimator(**params).fit(train)
        acc = accuracy(score(m, val, [*keep, label_col]), label_col).first()["accuracy"]
        return m, (i, float(acc if acc is not None else 0.0), str(params))

    try:
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(candidates)))) as pool:
            results = list(pool.map(fit_one, enumerate(candidates)))
    finally:
        train.unpersist()
    models = [m for m, _ in results]
    spark = train.sparkSession
    table = spark.createDataFrame([r for _, r in results], "candidate int, val_acc double, params string")
    best = best_by(table, "val_acc", "candidate").first()
    return models[best["candidate"]], table


def training_loss(model) -> DataFrame:
    """The objective per optimiser iteration of a fitted logistic model (or of the last
    stage of a pipeline model) and, per row, the running mean loss. Bounded by maxIter."""
    lr = model.stages[-1] if hasattr(model, "stages") else model
    history = list(lr.summary.objectiveHistory)
    spark = lr.summary.predictions.sparkSession
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(history)], "iteration int, loss double")
    from pyspark.sql import Window

    w = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("mean_loss", F.avg("loss").over(w))


def load_model(path: str) -> PipelineModel:
    """A saved pipeline model."""
    return PipelineModel.load(path)


def corpus_weights(df: DataFrame, corpus_col: str, weights: dict[str, float], default: float = 1.0) -> DataFrame:
    """M6: per-corpus sample weight for training in stages over combined corpora."""
    expr = F.lit(default)
    for name, w in weights.items():
        expr = F.when(F.col(corpus_col) == name, F.lit(float(w))).otherwise(expr)
    return df.withColumn("corpus_weight", expr)


__all__ = ["binarize", "embedding_features", "ngram_pipeline", "frozen_head", "score", "select_best",
           "random_scores", "score_with_pandas", "with_weights", "corpus_weights", "load_model"]
