"""Language of texts: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import stored

LONGEST = 4
SAMPLE_DOCS = 1500
LEAST_WORD, LEAST_GRAM = 2, 3
CACHED_WORDS = 100_000
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return [w for w in _WORD.findall(text.lower()) if w.isascii() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Rows:
    """Rows of numbers by name. The driver holds and sends two arrays; only tasks, which look names up, make Python strings of them."""

    def __init__(self, names: pa.Array, values: np.ndarray) -> None:
        self.names, self.values = names, values

    @cached_property
    def at(self) -> dict[str, int]:
        return dict(zip(self.names.to_pylist(), range(len(self.names))))

    def __iter__(self) -> Iterator[str]:
        return iter(self.at)

    def __contains__(self, name: str) -> bool:
        return name in self.at

    def __getitem__(self, name: str) -> np.ndarray:
        return self.values[self.at[name]]

    def get(self, name: str) -> np.ndarray | None:
        return self[name] if name in self.at else None


@dataclass
class Model:
    """What was learnt: languages, their shares, and rows of log frequencies by language for words and n-grams."""

    languages: list[str]
    shares: np.ndarray
    words: Rows
    grams: list[Rows]


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def _row(self, word: str) -> np.ndarray:
        known = self.model.words.get(word)
        if known is not None:
            return known
        for n in range(LONGEST, 0, -1):
            table = self.model.grams[n - 1]
            found = [table[g] for g in grams(word, n) if g in table]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.model.languages), np.float32)

    def _place(self, word: str) -> int:
        i = self.at.get(word)
        if i is None:
            i = self.at[word] = len(self.rows)
            self.rows.append(self._row(word))
        return i

    def predict(self, text: str) -> tuple[str, float]:
        counts = Counter(letter_words(text))
        if not counts or not self.model.languages:
            return UNDETERMINED, 0.0
        if len(self.at) > CACHED_WORDS:
            self._empty()
        rows = np.array([self.rows[i] for i in map(self._place, counts)])
        total = np.fromiter(counts.values(), np.float64, len(counts)) @ rows + self.model.shares
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum())


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words (n = 0) and n-grams by language, summed over each batch."""
    for pdf in batches:
        rows = []
        for lang, part in pdf.groupby("lang"):
            words = Counter(w for t in part["text"] for w in letter_words(t))
            rows += [(lang, 0, w, c) for w, c in words.items()]
            for n in range(1, LONGEST + 1):
                found: Counter[str] = Counter()
                for w, c in words.items():
                    for g in grams(w, n):
                        found[g] += c
                rows += [(lang, n, g, c) for g, c in found.items()]
        yield pd.DataFrame(rows, columns=["lang", "n", "gram", "count"])


def _no_rows(languages: list[str]) -> Rows:
    return Rows(pa.array([], pa.string()), np.zeros((0, len(languages)), np.float32))


def _relative(counts: pa.Table, languages: list[str]) -> Rows:
    """Log of each gram's frequency in each language (one added), less the mean over languages."""
    if not counts.num_rows:
        return _no_rows(languages)
    found = counts["gram"].combine_chunks().dictionary_encode()
    values = np.zeros((len(found.dictionary), len(languages)), order="F")
    values[found.indices.to_numpy(), pc.index_in(counts["lang"], pa.array(languages)).to_numpy()] = counts["count"].to_numpy()
    logs = np.log((values + 0.5) / (values.sum(axis=0) + 0.5 * len(values)))
    logs -= logs.mean(axis=1, keepdims=True)
    return Rows(found.dictionary, logs.astype(np.float32, order="C"))


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from ``labelled`` (doc_id, text, lang). Rows without text or lang teach nothing; no rows give a model without languages.

    Of each language about ``sample_docs`` documents are read, whole; they are those whose hashed id lies lowest. That bounds
    the counts, which Spark sums and the driver then gathers, and so the model that every task is sent.
    """
    usable = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(0), _no_rows([]), [_no_rows([]) for _ in range(LONGEST)])
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, sample_docs / sizes[k]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.filter(draw < F.element_at(share, F.col("lang"))).select("lang", "text")
    counts = sample.mapInPandas(_counted, "lang string, n int, gram string, count long")
    counts = counts.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    totals = counts.groupBy("n", "gram").agg(F.sum("count").alias("all")).filter(
        F.col("all") >= F.when(F.col("n") == 0, LEAST_WORD).otherwise(LEAST_GRAM))
    table = stored(counts.join(totals, ["n", "gram"]).select("lang", "n", "gram", "count"), "language-counts").toArrow()
    tables = [_relative(table.filter(pc.equal(table["n"], n)), languages) for n in range(LONGEST + 1)]
    taught = np.array([sizes[k] for k in languages], float)
    return Model(languages, np.log(taught / taught.sum()), tables[0], tables[1:])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` (a learnt language; ``und`` if the text is null or has no letter) and ``lang_score`` (0 to 1, 0 for ``und``).

    Each row goes through Python once, whatever is done with the result: rows are passed on with the prediction beside them.

    A word that the model knows counts by its log frequency in each language; another one by the mean over its character n-grams of the
    greatest length of which any is known. The score is the share of the best language. Only ``text`` is read.

    Rows are worked on one by one, so repeated rows are treated alike, and no rows give no rows; ties go to the language first in
    order; other columns stay, and input columns with the names of the results are replaced. There is no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    kept = docs.drop("lang_pred", "lang_score")
    at = kept.columns.index("text")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t.as_py() or "") for t in batch.column(at)]
            told = [pa.array([f[i] for f in found], kind) for i, kind in ((0, pa.string()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*batch.schema.names, "lang_pred", "lang_score"])

    return kept.mapInArrow(predicted, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """Documents that are never learnt from: a fifth by the checksum of the id, and those without an id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % folds == 0, F.lit(True))
