"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.llm.common import learnable, named, texts, with_arrow

STATISTICS = (
    "log_bytes", "log_words", "word_length", "longest_word", "letters", "upper", "digits", "blanks", "marks", "symbols",
    "high_bytes", "entropy", "log_lines", "line_length", "repeated_lines", "distinct_words", "commonest_word",
    "repeated_neighbours", "distinct_pairs", "shouted_words", "capital_words", "short_words", "sentence_ends", "squeezed",
)


def _classes() -> np.ndarray:
    """One column of 0 and 1 over the 256 bytes for each kind of byte."""
    kinds = (str.isalpha, str.isupper, str.isdigit, str.isspace, ".,;:?!'\"-()".__contains__)
    table = np.array([[i < 128 and bool(k(chr(i))) for k in kinds] for i in range(256)], float)
    high = (np.arange(256) >= 128).astype(float)
    other = 1 - np.minimum(table[:, [0, 2, 3, 4]].sum(1) + high, 1)
    return np.column_stack([table, other, high])


_CLASSES = _classes()


def statistics(raw: bytes) -> list[float]:
    """The STATISTICS of one whole text; an empty text has zeros only."""
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    letters, upper, digits, blanks, marks, symbols, high = (counts @ _CLASSES / len(raw)).tolist()
    p = counts[counts > 0] / len(raw)
    text = raw.decode("utf-8", "replace")
    words, lines = text.split(), text.split("\n")
    n, n_lines = max(1, len(words)), len(lines)
    lengths = list(map(len, words))
    seen = Counter(words)
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(len(words))),
        sum(lengths) / n,
        float(min(max(lengths, default=0), 1000)),
        letters, upper, digits, blanks, marks, symbols, high,
        float(-(p * np.log2(p)).sum()),
        float(np.log1p(n_lines)),
        float(np.log1p(len(text) / n_lines)),
        1 - len(set(lines)) / n_lines,
        len(seen) / n,
        max(seen.values(), default=0) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(x <= 3 for x in lengths) / n,
        (text.count(". ") + text.count(".\n")) / n,
        len(zlib.compress(raw, 1)) / len(raw),
    ]


@dataclass
class Forest:
    """Complete trees of one depth as arrays: `feature` and `above` per inner node, `leaf` per leaf."""

    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; all trees walk down together."""
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), "i8")
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1]))) if len(trees) else ():
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.above[trees, node])
        inner = self.feature.shape[1]
        return self.base + (self.leaf[trees, node - inner].sum(1) if len(trees) else np.zeros(len(x)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def grow(
    x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0,
    least: float = 2.0,
) -> Forest:
    """Boosted trees on the logistic loss. Splits come from histograms of gradient and curvature over `bins` codes.

    `least` is the smallest sum of curvature on either side, and the ridge shrinks the leaves. One class only,
    or no rows, gives a constant score.
    """
    inner = (1 << depth) - 1
    rate_of_one = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    forest = Forest(np.zeros((0, inner), "i8"), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if not len(y) or y.min() == y.max():
        return forest
    n, p = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    codes = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    cells = codes + np.arange(p) * bins
    margin = np.full(n, base)
    made = []
    for _ in range(trees):
        score = 1 / (1 + np.exp(-margin))
        gradient, curve = y - score, score * (1 - score)
        feature, above = np.zeros(inner, "i8"), np.full(inner, np.inf)
        node = np.zeros(n, "i8")
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            at = ((node - first)[:, None] * (p * bins) + cells).ravel()
            sums = [np.bincount(at, np.repeat(v, p), width * p * bins).reshape(width, p, bins) for v in (gradient, curve)]
            left = [s.cumsum(2)[:, :, :-1] for s in sums]
            total = [s.sum(2, keepdims=True) for s in sums]
            gain = sum(
                g**2 / (h + ridge) for g, h in (left, [t - v for t, v in zip(total, left)])
            ) - total[0] ** 2 / (total[1] + ridge)
            gain[(left[1] < least) | (total[1] - left[1] < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for w in range(width):
                j, code = divmod(int(best[w]), bins - 1)
                if gain[w, j, code] > 1e-9 and code < len(edges[j]):
                    feature[first + w], above[first + w] = j, edges[j][code]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > above[node])
        leaf = [np.bincount(node - inner, v, inner + 1) for v in (gradient, curve)]
        values = rate * leaf[0] / (leaf[1] + ridge)
        margin += values[node - inner]
        made.append((feature, above, values))
    return Forest(*(np.array(v) for v in zip(*made)), base)


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, max_rows: int = 40_000, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", **options,
) -> Forest:
    """Trees learned from the labelled documents that are not held out.

    At most about `max_rows` documents are used, chosen by a hash of the id (bound of the sample; all of them
    where there are fewer). Only their statistics reach the driver. Labels of one id are averaged, and 0.5 or
    more counts as 1. Null ids and null labels teach nothing; null and empty texts have zero statistics;
    rows that repeat count as often as they come. Without labelled rows the score is one half for every text.
    """
    known = (
        labels.select(named(id_col).alias("id"), named(label_col).cast("double").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull())
        .where(learnable(F.col("id")))
        .groupBy("id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))
    mine = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    mine = mine.where(learnable(F.col("id")) & chosen)
    rows = _measured(mine).select("id", "statistics").join(known.where(chosen), "id")
    got = rows.select("statistics", "y").limit(2 * max_rows).toPandas()
    x = np.array(got["statistics"].tolist(), float).reshape(len(got), len(STATISTICS))
    # The order of rows must not change the trees.
    order = np.lexsort([*x.T, got["y"].to_numpy(dtype=float)])
    return grow(x[order], got["y"].to_numpy(dtype=float)[order], **options)


def _measured(docs: DataFrame) -> DataFrame:
    fields = T.StructType().add("statistics", T.ArrayType(T.DoubleType()))

    def measure(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([statistics(t) for t in texts(batch)], pa.list_(pa.float64()))]

    return with_arrow(docs, fields, measure)


def quality_scores(docs: DataFrame, model: Forest, *, name: str = "score", text_col: str = "text") -> DataFrame:
    """`docs` with the column `name`, the probability from 0 to 1 that a text is good.

    The score depends on the text alone; a null text scores like an empty one. An input column called `name`
    is replaced. No row leaves its partition; the model is some thousand numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        x = np.array([statistics(t) for t in texts(batch, text_col)], float)
        return [pa.array(shared.value.scores(x), pa.float64())]

    return with_arrow(docs, T.StructType().add(name, T.DoubleType()), score, text_col)


def good_documents(docs: DataFrame, model: Forest, *, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their own columns, whose score is at least `least`."""
    own = docs.columns
    inner = docs.select([named(c).alias(f"c{i}") for i, c in enumerate(own)])
    kept = quality_scores(inner, model, text_col=f"c{own.index(text_col)}").where(F.col("score") >= least)
    return kept.select([F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
