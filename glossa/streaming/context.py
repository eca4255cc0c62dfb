"""Article context as keyed streaming state: words and entities seen so far, decayed salience, reset on overflow.

State is keyed by article, so the order of partitions can't mix articles. Rows of an article are sorted within a
micro-batch; a row that comes after a later one of its article was handled is late and is dropped with a mark.
State has a size limit, after which the article's context is reset, and a timeout after which it is forgotten.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WORD = re.compile(r"[^ \t\r\n]+")
LETTERS = re.compile(r"[^\W\d_]+")


def names(text: str) -> set[str]:
    """The capitalised words of a text, lower-cased: from the first capital of a run of letters on, two letters at least."""
    found = set()
    for run in LETTERS.findall(text):
        at = next((i for i, c in enumerate(run) if c.isupper()), len(run))
        if len(run) - at > 1:
            found.add(run[at:].lower())
    return found


class Context:
    """What one article remembers."""

    def __init__(self, dump: str | None = None) -> None:
        self.last, self.words, self.entities = json.loads(dump) if dump else (None, {}, {})

    def dump(self) -> str:
        return json.dumps([self.last, self.words, self.entities])

    def see(self, order: int, text: str, base: float, most: int) -> tuple[int, int, str | None, float, bool]:
        """(words, words seen before, most salient entity, its salience, whether the context was reset)."""
        words = set(WORD.findall((text or "").lower()))
        old = sum(w in self.words for w in words)
        gap = order - self.last if self.last is not None else 0
        self.entities = {e: s * base**gap for e, s in self.entities.items()}
        for name in names(text or ""):
            self.entities[name] = self.entities.get(name, 0.0) + 1.0
        self.words.update(dict.fromkeys(words, order))
        self.last = order
        top = max(self.entities.items(), key=lambda x: (round(x[1], 9), x[0]), default=(None, 0.0))
        reset = len(self.words) + len(self.entities) > most
        if reset:
            self.words, self.entities = {}, {}
        return len(words), old, top[0], top[1], reset


def article_context(rows: DataFrame, article: str, order: str, text: str, base: float = 0.5, most: int = 100_000, timeout: str = "1 hour") -> DataFrame:
    """A stream of rows to (article, order, n_words, n_seen, entity, salience, late, reset)."""
    kind = {c: t for c, t in rows.dtypes}
    schema = f"{article} {kind[article]}, {order} {kind[order]}, n_words long, n_seen long, entity string, salience double, late boolean, reset boolean"
    columns = [article, order, "n_words", "n_seen", "entity", "salience", "late", "reset"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        context = Context(state.get[0] if state.exists else None)
        out = []
        own = pd.concat(list(frames)).sort_values(order, kind="stable")
        for o, t in zip(own[order], own[text], strict=True):
            if context.last is not None and o < context.last:
                out.append((key[0], o, 0, 0, None, 0.0, True, False))
                continue
            n, old, entity, score, reset = context.see(int(o), t, base, most)
            out.append((key[0], o, n, old, entity, score, False, reset))
        state.update((context.dump(),))
        if timeout:
            state.setTimeoutDuration(_milliseconds(timeout))
        yield pd.DataFrame(out, columns=columns)

    return (
        rows.select(article, order, text)
        .groupBy(article)
        .applyInPandasWithState(step, schema, "context string", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout)
    )


def _milliseconds(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]


def run_to_end(stream: DataFrame, folder: str) -> None:
    """Drain a stream into Parquet files in folder/out, once, with its checkpoint beside it."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
