"""Quality classifier: a weak-label model trains a hashed linear scorer.

Seven overlapping heuristics vote on each document: capitals, odd marks, table bars, words said twice, function words,
few distinct words, and plain words that go on.
Expectation-maximisation over the counts of all vote patterns estimates their accuracies and the posterior of each
pattern. Posteriors are the labels of a logistic model on hashed word shapes, fitted on at most ``max_rows`` documents
(those with the least hash). Its score decides: below ``threshold``, a document goes. Texts of every length are judged by
the same features: shares are of the words and a few plain ones more, so that those of short texts say little. No labels
are used.

Null, empty and blank texts have no words and nothing against them: their score is 1, and they are kept. Whole texts are
read, however long. Repeated rows, and ties of texts with equal features, are judged alike. Columns other than the id and
the text are not read by the model; ``keep_good`` passes them on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipper.llm.common import blocks, cut, text_column
from dipper.llm.weak import fit_logistic, posteriors, votes_key

#: Buckets of the shape hash.
DIM = 1 << 12
#: Plain words that a text is taken to have besides its own.
MORE = 6
#: Function words of four languages.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it was for on are as with be at by this from or an a "
    b"le la les de des du et en un une que qui dans pour par sur au aux avec est pas "
    b"der die das und den dem von zu mit sich des auf ist im nicht ein eine als auch es "
    b"el los las del y se por con para su al lo como".split()
)
_SHAPE = bytes([*(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))])
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_MARKED = re.compile(rb"[$%&#*]|!!")
_PLAIN_SHAPES = tuple(w + m for w in (b"a", b"Aa", b"A", b"0") for m in (b"", b".", b",", b";", b":", b"?"))
_EDGE = b".,;:!?\"'()"


def describe(text: bytes) -> tuple[str, dict[int, float]]:
    """Votes on a text (+: good), and its hashed word shapes as shares of its words."""
    words = text.split()
    n = len(words)
    if not n:
        return votes_key([0] * 7), {}
    lower, upper = sum(map(text.count, (b"a", b"e", b"i", b"n", b"r", b"t"))), sum(map(text.count, (b"A", b"E", b"I", b"N", b"R", b"T")))
    shapes = Counter(_RUN.sub(rb"\1", text.translate(_SHAPE)).split())
    m = n + MORE
    marked = sum(c for s, c in shapes.items() if _MARKED.search(s) or s == b"!" or s.endswith(b"!")) / m
    bars = shapes.get(b"|", 0) / m
    again = sum(map(bytes.__eq__, words, words[1:])) / m
    known = sum(w.strip(_EDGE).lower() in FUNCTION_WORDS for w in words)
    capitals = upper / (MORE + lower + upper)
    odd = n - sum(map(shapes.get, _PLAIN_SHAPES, repeat(0)))
    bad = lambda x: -1 if x else 0
    votes = [bad(capitals >= 0.3), bad(marked >= 0.1), bad(bars >= 0.06), bad(again >= 0.1), bad(100 * known + 9 * MORE <= 3 * m), bad(4 * len(set(words)) + 2 * MORE <= m)]
    votes.append(-1 if 10 * odd >= 4 * m or again >= 0.2 else 1 if 10 * odd <= m and again <= 0.04 else 0)
    shapes[b"a"] += MORE
    features = {xxhash.xxh3_64_intdigest(s) % (DIM - 1): 0.0 for s in shapes}
    for s, c in shapes.items():
        features[xxhash.xxh3_64_intdigest(s) % (DIM - 1)] += c / m
    features[DIM - 1] = again
    return votes_key(votes), features


class Model:
    """The posterior of each pattern of votes, and the weights of the scorer."""

    def __init__(self, good: dict[str, float], weights: np.ndarray, threshold: float):
        self.good, self.weights, self.threshold = good, weights, threshold

    def score(self, votes: str, features: dict[int, float]) -> float:
        if not features:
            return 1.0
        z = sum(self.weights[i] * x for i, x in features.items()) + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(df: DataFrame, max_rows: int = 20_000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model for ``df``, and what it saw: (id, votes, at, share), kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            seen = [describe(t) for t in text_column(b, "text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v for v, _ in seen], pa.string()), pa.array([list(x) for _, x in seen], pa.list_(pa.int32())), pa.array([list(x.values()) for _, x in seen], pa.list_(pa.float32()))], names=["id", "votes", "at", "share"])

    kind = df.schema[id_col].dataType.simpleString()
    seen = cut(df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, f"id {kind}, votes string, at array<int>, share array<float>"))
    patterns = {r["votes"]: r["count"] for r in seen.groupBy("votes").count().collect()}
    good, _ = posteriors(patterns, start=0.8)
    # Those with the least hash: a bit more than max_rows have one below the bound, so little is sorted or sent.
    slots = 1 << 30
    bound = min(slots, int(1.3 * slots * max_rows / max(1, sum(patterns.values()))) + 1)
    least = F.pmod(F.xxhash64("id", "votes", "at", "share"), F.lit(slots))
    sample = seen.where((F.size("at") > 0) & (least < bound)).orderBy(least, "votes", "at", "share").limit(max_rows).select("votes", "at", "share").collect()
    weights = fit_logistic([(dict(zip(r["at"], r["share"], strict=True)), good[r["votes"]], 1.0) for r in sample], DIM)
    return Model(good, weights, threshold), seen


def judge_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row per row: the id, ``votes``, ``posterior`` (of the votes alone), ``score`` and ``keep``."""
    model, seen = fit(df, id_col=id_col, text_col=text_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = b.column(1).to_pylist()
            score = [model.score(v, dict(zip(at, x, strict=True))) for v, at, x in zip(votes, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([model.good[v] for v in votes], pa.float64()), pa.array(score, pa.float64()), pa.array([s >= model.threshold for s in score], pa.bool_())], names=["id", "votes", "posterior", "score", "keep"])

    kind = df.schema[id_col].dataType.simpleString()
    return seen.mapInArrow(run, f"id {kind}, votes string, posterior double, score double, keep boolean").withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The rows of ``df`` that the classifier keeps, with all columns; each is judged where it lies."""
    model, _ = fit(df, id_col=id_col, text_col=text_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col):
            keep = [model.score(*describe(t)) >= model.threshold for t in text_column(b, text_col).cast(pa.large_binary()).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op6_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, of all ``documents``."""
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("keep")


QUERIES = {"op6_quality_filter": op6_quality_filter}
