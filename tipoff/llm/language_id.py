"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL, with a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.llm.common import learnable, named, slices, texts, with_arrow

# Size of the hashed feature space and the greatest n-gram.
DIMS, LONGEST = 1 << 15, 3
_BLANK = np.array([not chr(c).isalpha() for c in range(128)])


def gram_counts(text: str) -> np.ndarray:
    """Number of times that the n-grams of 1 to LONGEST characters of a whole text fall on each feature.

    Letters are lower-cased; other ASCII characters are blanks.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype("u8")
    low = codes < 128
    codes[low] = np.where(_BLANK[codes[low]], 32, codes[low])
    codes = np.concatenate([[32], codes, [32]]).astype("u8")
    total, mixed = np.zeros(DIMS, "i8"), np.zeros(len(codes), "u8")
    for n in range(1, LONGEST + 1):
        mixed = mixed[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        hashed = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        total += np.bincount(hashed.astype("i8"), minlength=DIMS)
    return total


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the normalised TF-IDF vector."""
    at = np.flatnonzero((counts > 0) & (idf > 0))
    values = (1 + np.log(counts[at])) * idf[at]
    return at, values / (np.sqrt((values**2).sum()) or 1.0)


@dataclass
class Languages:
    names: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        """Name and calibrated probability; `und` and 0 without a letter or a learned language."""
        if not self.names or not has_letter(text):
            return "und", 0.0
        at, values = features(gram_counts(text), self.idf)
        p = softmax(values @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.names[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001,
    l2: float = 0.01, epochs: int = 3,
) -> np.ndarray:
    """FTRL-proximal with elastic-net penalties: weights are closed forms of the summed gradients `z`, many exactly zero."""
    z, n = np.zeros((DIMS, classes)), np.zeros((DIMS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    for _ in range(epochs):
        for at, values, y in rows:
            w = weights(z[at], n[at])
            error = softmax(values @ w)
            error[y] -= 1
            g = values[:, None] * error
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return weights(z, n)


def calibrated(logits: list[np.ndarray], ys: list[int]) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not ys:
        return 1.0

    def loss(t: float) -> float:
        return -sum(np.log(max(softmax(x / np.exp(t))[y], 1e-300)) for x, y in zip(logits, ys))

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(30):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature stands, and the number of texts; every text counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, "i8"), 0
        for batch in batches:
            for part in slices(batch, "text"):
                for raw in texts(part):
                    total += gram_counts(raw.decode("utf-8", "replace")) > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([n, *total[at]], pa.int64())], ["feature", "n"])

    sums = docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(sums["feature"].tolist(), sums["n"].tolist()))
    rows = found.pop(-1, 0)
    df = np.zeros(DIMS)
    df[list(found)] = list(found.values())
    return df, rows


def fit_languages(
    docs: DataFrame, *, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options
) -> Languages:
    """Weights learned from the documents with a language that are not held out.

    Document frequencies are taken over all of them. The weights are fitted on a sample of about `max_rows`
    documents (documented bound; an equal share for each language, by a hash of id and text), of which every
    fifth is kept for the temperature. Rows with a null id, text or language teach nothing; rows that repeat
    count as often as they come. Without any such row the model knows no language.
    """
    mine = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"), named(lang_col).cast("string").alias("lang"))
    mine = mine.where(learnable(F.col("id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = dict(map(tuple, mine.groupBy("lang").count().collect()))
    names = sorted(sizes)
    if not names:
        return Languages([], np.zeros((DIMS, 0)), np.zeros(DIMS), 1.0)
    df, n = _document_frequencies(mine)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 0.1, 0)
    share = F.create_map([F.lit(x) for k in names for x in (k, min(1.0, max_rows / len(names) / sizes[k]))])
    place = F.xxhash64("id", "text")
    sample = mine.where(F.pmod(place, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).withColumn("place", place)

    def sparse(batch: pa.RecordBatch) -> list[pa.Array]:
        out = [(np.flatnonzero(c), c) for c in (gram_counts(t.decode("utf-8", "replace")) for t in texts(batch))]
        at = [a.astype("<u2").tobytes() for a, _ in out]
        return [pa.array(at, pa.binary()), pa.array([c[a].astype("<u4").tobytes() for a, c in out], pa.binary())]

    fields = T.StructType().add("at", T.BinaryType()).add("counts", T.BinaryType())
    got = with_arrow(sample, fields, sparse).select("place", "lang", "at", "counts").limit(2 * max_rows).collect()
    rows = []
    for r in sorted(got, key=lambda r: (r["place"], r["lang"])):
        counts = np.zeros(DIMS, "i8")
        counts[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["counts"], "<u4")
        rows.append((*features(counts, idf), names.index(r["lang"])))
    kept = rows[::5]
    weights = follow_the_leader([r for i, r in enumerate(rows) if i % 5] or rows, len(names), **options)
    temperature = calibrated([v @ weights[at] for at, v, _ in kept], [y for _, _, y in kept])
    return Languages(names, weights.astype("f4"), idf, temperature)


def predict_languages(docs: DataFrame, model: Languages, *, text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score`, which depend on the whole text alone.

    A null or empty text, or one without a letter, is `und` with score 0, and so is every text if no language
    was learned. Of equal scores the first name wins. Input columns called like a result are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch: pa.RecordBatch) -> list[pa.Array]:
        made = [shared.value.predict(t.decode("utf-8", "replace")) for t in texts(batch, text_col)]
        return [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]

    return with_arrow(docs, T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType()), predict, text_col)
