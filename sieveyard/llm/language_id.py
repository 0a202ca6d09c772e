"""Language identification by word-first backoff.

A word that the labelled sample knows scores by its log frequency in each language.  An unknown word falls back to
its character n-grams, the longest order first, down to single letters; the first order of which
the sample knows any gram decides.  A text's score is the sum over its words, its confidence the posterior of the
best language.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveyard.llm.worker_cache import release

UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
QUICK = re.compile(r"[^\W\d_]+")
#: Characters beyond which Python's letter class is not the Unicode one.
OUTSIDE = re.compile("[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞€]")


def words(text: str) -> list[str]:
    return (LETTERS if OUTSIDE.search(text) else QUICK).findall(text.lower())


@dataclass(frozen=True)
class LanguageModel:
    """``tables[0]``: word -> log probabilities by language; ``tables[n]``: the same for n-grams of marked words."""

    languages: tuple[str, ...]
    tables: tuple[dict[str, np.ndarray], ...]

    def score(self, word: str) -> np.ndarray:
        known = self.tables[0].get(word)
        if known is not None:
            return known
        marked = f"<{word}>"
        for n in range(len(self.tables) - 1, 0, -1):
            source, table = (word, self.tables[1]) if n == 1 else (marked, self.tables[n])
            found = [table[g] for i in range(len(source) - n + 1) if (g := source[i : i + n]) in table]
            if found:
                return np.sum(found, axis=0, dtype=np.float32) / n
        return np.zeros(len(self.languages), np.float32)


def _table(counts: dict[str, Counter], languages: tuple[str, ...], least: int, floor: float = 0.5) -> dict[str, np.ndarray]:
    """Log probabilities with add-``floor`` smoothing, less their mean: only differences matter."""
    total: Counter = Counter()
    for c in counts.values():
        total.update(c)
    keys = [k for k, n in total.items() if n >= least]
    size = np.array([sum(counts[x].values()) for x in languages], float) + floor * max(1, len(total))
    raw = np.array([[counts[x][k] for x in languages] for k in keys], float).reshape(len(keys), len(languages))
    logs = np.log((raw + floor) / size)
    logs -= logs.mean(axis=1, keepdims=True)
    return dict(zip(keys, logs.astype(np.float32), strict=True))


def fit(docs: DataFrame, train: Column | None = None, per_language: int = 250, order: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from a bounded sample: about ``per_language`` labelled texts of each language, those with the lowest hash.

    Rows whose text or label is null teach nothing.  Without any labelled row the model knows no language and
    predicts ``und``.  What comes to the driver is the sample's word counts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.lit(True) if train is None else train).alias("use"))
    rows = rows.where(F.col("use") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    labelled = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not labelled:
        return LanguageModel((), ({},) * (order + 1))
    share = F.create_map(*[F.lit(v) for k, n in sorted(labelled.items()) for v in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / F.lit(1_000_003)
    sample = rows.where(draw < share[F.col("lang")])
    found = (
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .groupBy("lang", "word").agg(F.count("*").alias("n")).toPandas()
    )
    languages = tuple(sorted(labelled))
    counts: list[dict[str, Counter]] = [defaultdict(Counter) for _ in range(order + 1)]
    for lang, word, n in zip(found["lang"], found["word"], found["n"]):
        counts[0][lang][word] += n
        counts[1][lang].update({g: n * word.count(g) for g in set(word)})
        marked = f"<{word}>"
        for k in range(2, order + 1):
            c = counts[k][lang]
            for i in range(len(marked) - k + 1):
                c[marked[i : i + k]] += n
    return LanguageModel(languages, tuple(_table(counts[k], languages, 2) for k in range(order + 1)))


class Scorer(dict):
    """word -> row of ``scores``; bounded."""

    def __init__(self, model: LanguageModel, most: int = 250_000):
        super().__init__()
        self.model, self.scores = model, np.zeros((most, max(1, len(model.languages))), np.float32)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.scores[i] = self.model.score(word)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else []
        if not found or not self.model.languages:
            return UNKNOWN, 0.0
        total = np.zeros(self.scores.shape[1])
        step = len(self.scores) // 2
        for at in range(0, len(found), step):
            if len(self) > step:
                self.clear()
            part = found[at : at + step]
            total += self.scores[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.model.languages[best], 1.0 / sum(math.exp(max(-700.0, x - total[best])) for x in total)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "lang_score", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns, if None) with the predicted language and its posterior probability, 0 to 1.

    Null, empty or letterless text: ``und`` and 0.  Equal scores: the language first in order of name.  Columns named as
    the new ones are replaced.  Each input row gives one output row; one map, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (keep if keep is not None else docs.columns) if c not in (lang_as, score_as)]

    def run(batches):
        release()
        scorer = Scorer(shared.value)
        for batch in batches:
            out = [scorer.predict(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([x for x, _ in out], pa.string()), pa.array([float(x) for _, x in out], pa.float64())],
                names=[*batch.schema.names[1:], lang_as, score_as],
            )

    rows = docs.select(F.col(text_col).alias("__text"), *[F.col(c) for c in names])
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return rows.mapInArrow(run, f"{kinds}`{lang_as}` string, `{score_as}` double")
