"""Quality classifier: random Fourier features over document statistics, ridge by summed normal equations, isotonic scores."""

from __future__ import annotations

import re
import string
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, batch, joined, pick, prepare, remainder, saved, table, texts, unpacked

#: Labelled rows that the classifier is fitted on at most, drawn by a hash of doc_id.
MAX_LABELLED = 40_000
#: Cosine features; the width of the kernel in standardised statistics; the ridge.
FEATURES, WIDTH, RIDGE = 300, 3.0, 1e-1
#: Partial sums of the normal equations that reach the driver.
SUMS = 8
SEED = 71

_SYMBOL = re.compile(r"[#*$%&|<>]")
_NOT_PUNCT = str.maketrans("", "", string.punctuation)
STATISTICS = ("words", "chars", "word_length", "word_spread", "upper", "digits", "punctuation", "symbols", "marks", "bars", "shouted",
              "marked_words", "lines", "line_words", "repeated_lines", "distinct", "repeated_triples", "top_word", "short_words",
              "long_words", "sentence_ends", "lone_symbols", "non_ascii", "blanks")


def statistics(text: str) -> list[float]:
    """Statistics of one whole text, all in bounded ranges or logarithms; of an empty text all 0."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    sizes = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in text.split("\n") if not x.isspace() and x]
    plain = text.translate(_NOT_PUNCT)
    letters = max(1, len(plain))
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    symbols = len(_SYMBOL.findall(text))
    upper = sum(map(text.count, string.ascii_uppercase))
    shouted = sum(map(str.isupper, words))
    marked = sum(w[-1] in "#*$%&|<>!" for w in words)
    return [
        np.log1p(n), np.log1p(chars), float(np.log1p(sizes.mean())), float(np.log1p(sizes.std())), upper / letters,
        sum(map(text.count, string.digits)) / letters, (chars - len(plain)) / chars, symbols / n, min(4.0, text.count("!") / n), text.count("|") / n,
        shouted / n, marked / n, float(np.log1p(len(lines))), float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)), len(counts) / n, 1 - triples / max(1, n - 2) if n > 2 else 0.0, max(counts.values()) / n,
        float((sizes <= 3).mean()), float((sizes > 14).mean()), sum(w[-1] in ".!?" for w in words) / n,
        sum(len(w) == 1 and not w.isalnum() for w in words) / n, (len(text.encode()) - chars) / chars, float(np.log1p((chars - sizes.sum()) / n)),
    ]


def _matrix(docs: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in docs], np.float64).reshape(len(docs), len(STATISTICS))


class Model:
    """Standardisation, random cosines, ridge weights and an isotonic map from raw scores to probabilities."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.freq = rng.normal(size=(len(mean), FEATURES)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots, self.values = np.array([0.0]), np.array([0.5])

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.freq + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing map from x to y with least squares (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, s = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[2] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + s
    return np.array([s / w for _, w, s in blocks]), np.array([v for v, _, _ in blocks])


def fit(rows: DataFrame) -> Model | None:
    """A model from a written table (doc_id, x, y); None where it is empty.

    Two thirds of the rows (by hash of doc_id) give the ridge, from normal equations that tasks sum and Spark adds up to
    SUMS partial sums; the rest calibrate.
    """
    dim = len(STATISTICS)
    width = FEATURES + 1
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3))
    rows = rows.withColumn("fold", fold)
    moments = rows.select("y", *[F.col("x")[i].alias(f"x{i}") for i in range(dim)]).agg(
        F.count("*"), *[F.avg(f"x{i}") for i in range(dim)], *[F.stddev_pop(f"x{i}") for i in range(dim)]).first()
    if not moments[0]:
        return None
    spread = np.array(moments[1 + dim:], float)
    model = Model(np.array(moments[1:1 + dim], float), np.where(spread > 1e-9, spread, 1.0))

    def sums(batches: Batches) -> Batches:
        a, c = np.zeros((width, width)), np.zeros(width)
        for b in batches:
            if not b.num_rows:
                continue
            z = model.cosines(np.array(b.column("x").to_pylist(), float))
            a += z.T @ z
            c += z.T @ np.array(b.column("y").to_pylist(), float)
        yield batch(part=pa.array([zlib.crc32(a.tobytes()) % SUMS], pa.int32()), a=[a.tobytes()], c=[c.tobytes()])

    def add(group):
        a = sum((np.frombuffer(x) for x in group.a), np.zeros(width * width))
        c = sum((np.frombuffer(x) for x in group.c), np.zeros(width))
        return pd.DataFrame({"a": [a.tobytes()], "c": [c.tobytes()]})

    parts = rows.filter("fold > 0").select("x", "y").mapInArrow(sums, "part int, a binary, c binary")
    total = parts.groupBy("part").applyInPandas(add, "a binary, c binary").collect()
    a = sum((np.frombuffer(r.a) for r in total), np.zeros(width * width)).reshape(width, width)
    c = sum((np.frombuffer(r.c) for r in total), np.zeros(width))
    model.weights = np.linalg.solve(a + RIDGE * np.eye(width), c)
    held = rows.filter("fold = 0").select("x", "y").toArrow()
    if held.num_rows:
        model.knots, model.values = isotonic(model.raw(np.array(held["x"].to_pylist(), float)), np.array(held["y"].to_pylist(), float))
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, text) as (doc_id, score); without a model every score is 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        for b in batches:
            yield batch(doc_id=b.column("doc_id"), score=pa.array(_scores(held.value, texts(b)), pa.float64()))

    return docs.mapInArrow(run, "doc_id long, score double")


def _scores(model: Model | None, docs: list[str]) -> np.ndarray:
    return model.score(_matrix(docs)) if model is not None and docs else np.full(len(docs), 0.5)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model learned from the texts of docs that labels (doc_id, quality) speak of.

    Learns from rows whose crc32(doc_id) mod 5 is not 0 with quality 0 or 1, MAX_LABELLED of them at most, drawn by hash; a
    doc_id with several labels takes the largest. The drawn labels are few enough to be broadcast, so only the texts
    that they name are looked at.
    """
    y = pick(labels, "doc_id", "quality").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    y = y.filter("y in (0, 1) and doc_id is not null").filter(remainder(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("y").cast("double").alias("y"))
    n = y.count()
    y = y.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit("quality-sample")), F.lit(1 << 30)) / float(1 << 30))
    y = saved(y.filter(F.col("draw") < min(1.0, MAX_LABELLED / max(n, 1))).orderBy("draw", "doc_id").limit(MAX_LABELLED).select("doc_id", "y"), "labels")

    def look(batches: Batches) -> Batches:
        for b in batches:
            x = _matrix(texts(b))
            yield batch(doc_id=b.column("doc_id"), y=b.column("y"), x=pa.array(list(x), pa.list_(pa.float64())))

    src = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    named = joined(src, y, ["doc_id"], "inner")
    return fit(saved(named.mapInArrow(look, "doc_id long, y double, x array<double>"), "labelled"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is ``least`` or more, with their columns; one pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Batches) -> Batches:
        for b in batches:
            keep = pa.array(_scores(held.value, texts(b)) >= least)
            yield b.select(["_row"]).filter(keep)

    rows = pick(docs, "text", row="_row")
    out = rows.mapInArrow(run, rows.select("_row").schema)
    return unpacked(out, "_row", docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document.

    Null and empty texts have all statistics 0 and are scored by them; repeated rows are scored each; without labels
    every score is 0.5; other columns are not read.
    """
    prepare(spark)
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
