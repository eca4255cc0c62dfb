"""Entity labels by one linear support vector machine a label: window features hashed to vectors, margins as probabilities, legal
labels by the constrained decoder of `crf`. Training and scoring are Spark ML over rows of tokens."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.morphology import margin_probability
from glossa.operators.crf import ENTITY_LABELS, decode_entities

SLOPE = 10.0


def window_features(tokens: DataFrame, key: Sequence[str], order: str, columns: Sequence[str], reach: int = 2) -> DataFrame:
    """tokens with `features`: each column's value at the places up to `reach` before and after, as `column offset:value`."""
    w = Window.partitionBy(*key).orderBy(order)
    at = lambda c, k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) if k else F.col(c)
    each = [F.concat(F.lit(f"{c}{k:+d}:"), F.coalesce(at(c, k).cast("string"), F.lit("-"))) for c in columns for k in range(-reach, reach + 1)]
    return tokens.withColumn("features", F.array(*each))


def _vectors(rows: DataFrame, size: int) -> DataFrame:
    return HashingTF(numFeatures=size, binary=True, inputCol="features", outputCol="_vector").transform(rows)


def train(rows: DataFrame, labels: Sequence[str] | None = None, size: int = 1 << 16, rounds: int = 50, penalty: float = 1e-3) -> dict[str, LinearSVCModel]:
    """A machine for each label of rows (features, label)."""
    data = _vectors(rows.select("features", "label"), size).cache()
    found = list(labels) if labels is not None else sorted(r["label"] for r in data.select("label").distinct().collect())  # 33 at most
    svm = LinearSVC(featuresCol="_vector", labelCol="_y", maxIter=rounds, regParam=penalty)
    models = {y: svm.fit(data.withColumn("_y", (F.col("label") == y).cast("double"))) for y in found}
    data.unpersist()
    return models


def probabilities(rows: DataFrame, models: dict[str, LinearSVCModel], size: int = 1 << 16) -> DataFrame:
    """rows with `p`, a map from label to the probability that its margin stands for."""
    out, found = _vectors(rows, size), []
    for i, (label, model) in enumerate(models.items()):
        model = model.copy().setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_found{i}")
        out = model.transform(out)
        found += [F.lit(label), margin_probability(vector_to_array(f"_raw{i}")[1], SLOPE)]
    return out.withColumn("p", F.create_map(*found)).drop("_vector", *[f"_{x}{i}" for i in range(len(models)) for x in ("raw", "found")])


def label_entities(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """(key, order, label) from rows (key, order, p): the best legal labels of each sentence; a label without a machine has 0."""
    at = {y: i for i, y in enumerate(ENTITY_LABELS)}

    @F.pandas_udf("array<string>")
    def run(sentences: pd.Series) -> pd.Series:
        out = []
        for maps in sentences:
            p = np.full((len(maps), len(at)), 1e-6)
            for i, m in enumerate(maps):
                for y, v in dict(m).items():
                    p[i, at[y]] = max(v, 1e-6)
            out.append(decode_entities(p))
        return pd.Series(out)

    per = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, F.map_entries("p").alias("p")))).alias("own"))  # a sentence
    found = per.select(*key, F.transform("own", lambda x: x[order]).alias(order), run(F.transform("own", lambda x: F.map_from_entries(x["p"]))).alias("label"))
    return found.select(*key, F.inline(F.arrays_zip(F.col(order), F.col("label"))))
