"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Both dictionaries are trained on labelled text cut into pieces. A text is compressed piece by piece with each;
the difference of the compressed sizes, normalised by the larger one and by the text's bytes, and the smaller
size per byte are calibrated to a probability by a logistic fit on other labelled rows.

The sample has at most `train_rows` labelled rows of each label, the first by a hash: half of them for the
dictionaries (`train_pieces` pieces each at most), half for the calibration. Everything else is over all rows.

Defined cases: null and empty texts are scored as the empty text. If a label has no rows, every score is the
share of label 1 (0.5 without labels). Repeated rows get equal scores. Columns of docs other than doc_id and text are
not looked at, whatever their names and types; `good` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.plans.session import ship

PIECE, LEVEL, DICTIONARY = 1000, 3, 112_640


class Model:
    """Dictionaries as bytes (label 0, label 1), the logistic fit, or a constant."""

    def __init__(self, constant: float | None = None) -> None:
        self.constant = constant
        self.dictionaries: list[bytes] = []
        self.mean = self.scale = self.weights = np.zeros(0)
        self._at: list = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_at": []}

    def sizes(self, text: str | None) -> tuple[int, int, int]:
        if not self._at:
            import zstandard as z

            for raw in self.dictionaries:
                data = z.ZstdCompressionDict(raw)
                data.precompute_compress(level=LEVEL)
                self._at.append(z.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        raw = (text or "").encode("utf-8", "surrogatepass")
        bad, good = self._at
        size_bad = size_good = 0
        for i in range(0, len(raw) or 1, PIECE):
            piece = raw[i : i + PIECE]
            size_bad += len(bad(piece))
            size_good += len(good(piece))
        return size_bad, size_good, len(raw)

    def features(self, texts: list[str | None]) -> np.ndarray:
        bad, good, size = np.array([self.sizes(t) for t in texts], float).reshape(-1, 3).T
        size = np.maximum(size, 1)
        return np.column_stack([(bad - good) / np.maximum(np.maximum(bad, good), 1), (bad - good) / size, np.minimum(bad, good) / size])

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Newton steps with a small ridge."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (p - y) / len(y) + 1e-4 * w
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + 1e-4 * np.eye(len(w)), slope)
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def _pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def _dictionary(pieces: list[bytes]) -> bytes:
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY, pieces).as_bytes()
    except z.ZstdError:  # too few samples to train on: their bytes themselves
        return b"".join(pieces)[:DICTIONARY] or b" "


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 6000, train_pieces: int = 8000) -> Model:
    """docs (doc_id, text) and labels (doc_id, quality 0 or 1), both only rows to learn from."""
    ship(docs.sparkSession)
    order = F.xxhash64(F.lit("quality"), F.col("doc_id"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality", order.alias("h"))
    sample = known.where("quality = 0").orderBy("h", "doc_id").limit(train_rows).unionByName(known.where("quality = 1").orderBy("h", "doc_id").limit(train_rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.dropDuplicates(["doc_id", "quality"])), "doc_id")
    for_dictionary = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(q, h, i, p) for q, h, t in zip(pdf["quality"], pdf["h"], pdf["text"], strict=True) for i, p in enumerate(_pieces(t))]
            yield pd.DataFrame(out, columns=["quality", "h", "i", "piece"])

    pieces = texts.where(for_dictionary).select("quality", "h", "text").mapInPandas(cut, "quality int, h long, i int, piece binary")
    mixed = F.xxhash64("h", "i")
    samples = [[bytes(r["piece"]) for r in pieces.where(F.col("quality") == q).orderBy(mixed, "h", "i").limit(train_pieces).select("piece").collect()] for q in (0, 1)]
    if not all(samples):
        n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
        return Model(n.get(1, 0) / sum(n.values()) if n else 0.5)
    model = Model()
    model.dictionaries = [_dictionary(s) for s in samples]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = held.value.features(pdf["text"].tolist())
            yield pd.DataFrame({"y": pdf["quality"], "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})

    fit = texts.where(~for_dictionary).select("quality", "text").mapInPandas(measure, "y int, a double, b double, c double").toPandas()
    if fit["y"].nunique() < 2:
        return Model(float(fit["y"].mean()) if len(fit) else 0.5)
    fit = fit.sort_values(["y", "a", "b", "c"])  # the sums don't depend on the order of tasks
    model = Model()
    model.dictionaries = held.value.dictionaries
    model.fit(fit[["a", "b", "c"]].to_numpy(), fit["y"].to_numpy())
    return model


def scored(model: Model, spark: SparkSession) -> Callable[[Column], Column]:
    """A column function: the score of a text. Only the text goes to Python, so other columns stay as they are."""
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series(np.full(len(texts), float(m.constant)) if m.constant is not None else m.score(m.features(texts.tolist())))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row of docs."""
    return docs.select("doc_id", scored(model, docs.sparkSession)("text").alias("score"))


def good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns, that score at least `least`."""
    return docs.where(scored(model, docs.sparkSession)(docs["text"]) >= least)
