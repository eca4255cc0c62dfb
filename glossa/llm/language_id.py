"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, its runs of non-letters become one space, and its 1- to 3-grams are hashed into BUCKETS.
Training counts n-grams per language over a sample of about `train_rows` documents per language (all, where
there are fewer); the counts are summed by Spark and the log-probability matrix, languages x BUCKETS, goes to
the executors. Scoring is numpy over batches: all n-grams of many texts at once, gathered from the matrix and
summed per text. Texts are scored whole: one of over a million characters is read in pieces, each with the end of the
piece before it, so that no n-gram is lost or counted twice.

The matrix takes 8 x BUCKETS bytes a language. Above `max_languages` values of lang (500: 131 MB) training stops with an
error, as lang then holds something else or the limit is to be raised knowingly.

Defined cases: a text that is null or has no letter is `und` with score 0. Ties go to the first language in
order. Without any labelled text every document is `und`. Repeated rows get equal answers. Only texts go to Python, so
ids of any size and type stay as they are, beside nulls too; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import materialize
from glossa.plans.session import ship

BUCKETS = 1 << 15
ORDERS = 3
PIECE = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)
_letter: list[np.ndarray] = []


def _letters(points: np.ndarray) -> np.ndarray:
    if not _letter:
        _letter.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letter[0][points]


def _hashed(points: np.ndarray, n: int) -> np.ndarray:
    """The bucket of every n-gram of the code points."""
    h = np.full(max(0, len(points) - n + 1), n, np.uint64)
    for i in range(n):
        h = (h * np.uint64(31) + points[i : len(points) - n + 1 + i]) * _MULTIPLIERS[i]
        h ^= h >> np.uint64(15)
    return (h >> np.uint64(7)) % np.uint64(BUCKETS)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram, one pair of arrays for each order."""
    flat = "".join(f" {t} " for t in texts).lower()
    points = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t.lower()) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), size)
    letter = _letters(points)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])  # one space after each run of letters, one to begin a text
    points = np.where(letter, points, 32)[keep].astype(np.uint64)
    owner = owner[keep]
    for n in range(1, ORDERS + 1):
        h = _hashed(points, n)
        inside = owner[: len(h)] == owner[n - 1 :]
        if n == 1:
            inside &= points != 32
        yield owner[: len(h)][inside], h[inside]


def long_grams(text: str, size: int = PIECE) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of one text, piece by piece; the same as grams gives."""
    text, before, letter_before = f" {text.lower()} ", np.empty(0, np.uint64), True
    for j in range(0, len(text), size):
        points = np.frombuffer(text[j : j + size].encode("utf-32-le", "replace"), np.uint32)
        letter = _letters(points)
        keep = letter | np.r_[letter_before, letter[:-1]]
        points = np.concatenate([before, np.where(letter, points, 32)[keep].astype(np.uint64)])
        for n in range(1, ORDERS + 1):
            new = max(0, len(before) - n + 1)
            h = _hashed(points, n)[new:]
            yield h[points[new:] != 32] if n == 1 else h
        before, letter_before = points[-(ORDERS - 1) :], letter[-1]


def counted(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram of all texts, about PIECE characters at a time."""
    at: list[int] = []
    room = PIECE
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            for buckets in long_grams(t):
                yield np.full(len(buckets), i), buckets
        elif t:
            if len(t) > room and at:
                for owner, buckets in grams([texts[k] for k in at]):
                    yield np.array(at)[owner], buckets
                at, room = [], PIECE
            at.append(i)
            room -= len(t)
    if at:
        for owner, buckets in grams([texts[k] for k in at]):
            yield np.array(at)[owner], buckets


def train(docs: DataFrame, train_rows: int = 2000, max_languages: int = 500) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix with the prior as its last column) from docs (doc_id, text, lang)."""
    ship(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialize(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if (found := counts.count()) > max_languages:
        raise ValueError(f"{found} languages, more than max_languages ({max_languages})")
    known = F.broadcast(counts)  # texts aren't shuffled by language
    draw = F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.join(known, "lang").where(draw * F.col("n") < train_rows).select("lang", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in frames:
            for lang, own in pdf.groupby("lang"):
                sums = total.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                sums[-1] += len(own)
                for _, buckets in counted(own["text"].tolist()):
                    sums[:-1] += np.bincount(buckets.astype(np.int64), minlength=BUCKETS)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": sums[at]})

    rows = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    matrix = np.zeros((len(langs), BUCKETS + 1))
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        sums = np.zeros(BUCKETS + 1)
        sums[own["bucket"].to_numpy()] = own["n"].to_numpy()
        matrix[i, :-1] = np.log((sums[:-1] + 0.5) / (sums[:-1].sum() + 0.5 * BUCKETS))
        matrix[i, -1] = np.log(sums[-1])
    return langs, matrix


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (posterior of lang_pred) for every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    @F.pandas_udf("lang_pred string, score double")
    def run(column: pd.Series) -> pd.DataFrame:
        langs, matrix = model.value
        names = np.array([*langs, "und"], object)
        texts = [t if t is not None else "" for t in column]
        found = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
        score = np.tile(matrix[:, -1] if langs else np.zeros(0), (len(texts), 1))
        for owner, buckets in counted(texts) if langs else ():
            for i in range(len(langs)):
                score[:, i] += np.bincount(owner, weights=matrix[i][buckets], minlength=len(texts))
        found &= bool(langs)
        best = score.argmax(axis=1) if langs else np.zeros(len(texts), int)
        top = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1) if langs else np.zeros(len(texts))
        return pd.DataFrame({"lang_pred": names[np.where(found, best, len(langs))], "score": np.where(found, top, 0.0)})

    return docs.select("doc_id", run("text").alias("found")).select("doc_id", "found.*")
