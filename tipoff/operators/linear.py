"""Ridge, least squares and feature selection by distributed sums and a small driver solve."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tipoff.operators.ranking import medians
from tipoff.session import pinned

_MAX_GROUPS = 10_000


def balanced(terms: Sequence[Column], combine: Callable = add) -> Column:
    """Combine many columns in a tree of small depth."""
    terms = list(terms)
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        pairs = [combine(a, b) for a, b in zip(terms[::2], terms[1::2])]
        terms = pairs + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def finite(c: Column | str) -> Column:
    """Double, with NaN and infinity as null; booleans count 1 and 0."""
    if isinstance(c, str) and c.isidentifier():  # one call to the JVM; wide tables ask for hundreds
        return F.expr(f"CASE WHEN NOT isnan(double(`{c}`)) AND abs(double(`{c}`)) != double('Infinity') THEN double(`{c}`) END")
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


@dataclass(frozen=True)
class Profile:
    """Sizes, medians and moments (after median imputation) of many columns, by column name."""

    rows: int
    counts: dict[str, int]
    medians: dict[str, float]
    means: dict[str, float]
    variances: dict[str, float]
    correlations: dict[str, float | None]


def _long(df: DataFrame, columns: Sequence[str], target: Column) -> DataFrame:
    """One row per row and column. A wide aggregate would carry hundreds of buffers; this carries one set
    per column and combines on the map side just as well."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(target.cast("double").alias("y"), F.posexplode(values).alias("i", "v"))
    return rows.withColumn("v", finite("v"))


def profile(df: DataFrame, columns: Sequence[str], target: Column | None = None) -> Profile:
    """Two passes over the long form: sizes and medians, then moments of the imputed values."""
    columns = list(columns)
    if not columns:
        return Profile(df.count(), {}, {}, {}, {}, {})
    y = F.lit(0.0) if target is None else target
    long = _long(df, columns, y)
    sizes = {r["i"]: r for r in long.groupBy("i").agg(F.count("*").alias("n"), F.count("v").alias("k")).collect()}
    rows = max((r["n"] for r in sizes.values()), default=0)
    found = {r["i"]: r["v"] for r in medians(long, ["i"], ["v"], rows_bound=rows).collect()}
    mids = [found.get(i) if found.get(i) is not None else 0.0 for i in range(len(columns))]
    fill = F.element_at(F.array(*[F.lit(float(m)) for m in mids]), F.col("i") + 1)
    moments = {
        r["i"]: r
        for r in long.withColumn("v", F.coalesce("v", fill))
        .groupBy("i")
        .agg(F.avg("v").alias("m"), F.var_pop("v").alias("vv"), F.covar_pop("v", "y").alias("c"), F.var_pop("y").alias("vy"))
        .collect()
    }

    def correlation(r) -> float | None:
        spread = (r["vv"] or 0.0) * (r["vy"] or 0.0)
        return abs(r["c"]) / math.sqrt(spread) if spread > 0 else None

    return Profile(
        rows,
        {c: sizes[i]["k"] if i in sizes else 0 for i, c in enumerate(columns)},
        {c: float(mids[i]) for i, c in enumerate(columns)},
        {c: (moments[i]["m"] if i in moments else None) or 0.0 for i, c in enumerate(columns)},
        {c: (moments[i]["vv"] if i in moments else None) or 0.0 for i, c in enumerate(columns)},
        {c: correlation(moments[i]) if i in moments else None for i, c in enumerate(columns)},
    )


@dataclass(frozen=True)
class FeatureSpec:
    """Imputation and scaling of the features, and the group labels for one-hot terms."""

    columns: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    groups: list[str]
    group_column: str | None

    def scaled(self, column: str) -> Column:
        filled = F.coalesce(finite(column), F.lit(self.medians[column]))
        return (filled - self.means[column]) / self.scales[column]


def group_labels(df: DataFrame, column: str) -> list[str]:
    """Sorted labels of a column that is meant to have few."""
    label = F.col(column).cast("string")
    found = df.select(label.alias("g")).where(F.col("g") != "").distinct().limit(_MAX_GROUPS + 1).collect()
    if len(found) > _MAX_GROUPS:
        raise ValueError(f"{column} has too many labels for one-hot terms in one expression; use fit_ridge_by_label")
    return sorted(r["g"] for r in found)


def fit_spec(
    df: DataFrame, columns: Sequence[str], group_column: str | None = None, known: Profile | None = None
) -> FeatureSpec:
    """Spec of the columns; a profile that covers them saves its two passes."""
    columns = list(columns)
    p = profile(df, columns) if known is None else known
    scales = {c: math.sqrt(max(p.variances[c], 0.0)) or 1.0 for c in columns}
    groups = group_labels(df, group_column) if group_column else []
    return FeatureSpec(
        columns, {c: p.medians[c] for c in columns}, {c: p.means[c] for c in columns}, scales, groups, group_column
    )


def _design_sums(spec: FeatureSpec):
    """Sums of products of [1, value and missing flag per feature, group terms, y] over a task's rows."""
    middle = np.array([spec.medians[c] for c in spec.columns])
    mean = np.array([spec.means[c] for c in spec.columns])
    scale = np.array([spec.scales[c] for c in spec.columns])
    place = {g: i for i, g in enumerate(spec.groups)}
    start = 1 + 2 * len(spec.columns)
    width = start + len(place) + 1

    def run(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.zeros((len(pdf), width))
            x[:, 0] = 1.0
            if spec.columns:
                raw = np.array([np.asarray(v, dtype=float) for v in pdf["x"]])
                missing = ~np.isfinite(raw)
                x[:, 1:start:2] = (np.where(missing, middle, raw) - mean) / scale
                x[:, 2:start:2] = missing
            for row, label in enumerate(pdf["g"]):
                if label in place:
                    x[row, start + place[label]] = 1.0
            x[:, -1] = pdf["y"].to_numpy()
            total += x.T @ x
        yield pd.DataFrame({"sums": [total.ravel()]})

    return run, width


def design_products(df: DataFrame, spec: FeatureSpec, target: Column) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, X'y) of the imputed, scaled design."""
    label = F.col(spec.group_column).cast("string") if spec.group_column else F.lit(None).cast("string")
    rows = df.select(
        F.array(*[F.col(c).cast("double") for c in spec.columns]).cast("array<double>").alias("x"),
        label.alias("g"),
        target.cast("double").alias("y"),
    )
    run, width = _design_sums(spec)
    return _merged_products(rows.mapInPandas(run, "sums array<double>"), width)


def _partial_sums(width: int):
    def run(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["x"].to_numpy())
                total += x.T @ x
        yield pd.DataFrame({"sums": [total.ravel()]})

    return run


def _add_up(batches):
    total = None
    for pdf in batches:
        for values in pdf["sums"]:
            total = np.array(values) if total is None else total + np.asarray(values)
    if total is not None:
        yield pd.DataFrame({"sums": [total]})


def cross_products(df: DataFrame, terms: Sequence[Column], target: Column) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, X'y): each task adds up its rows, then the tasks are added up in two steps."""
    width = len(terms) + 1
    rows = df.select(F.array(*[t.cast("double") for t in terms], target.cast("double")).alias("x"))
    return _merged_products(rows.mapInPandas(_partial_sums(width), "sums array<double>"), width)


def _merged_products(parts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    fan_in = max(1, math.isqrt(max(1, parts.sparkSession.sparkContext.defaultParallelism)))
    merged = parts.repartition(fan_in).mapInPandas(_add_up, "sums array<double>")
    cells = merged.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    gram = np.zeros(width * width)
    for cell in cells:
        gram[cell["pos"]] = cell["v"]
    gram = gram.reshape(width, width)
    return gram[:-1, :-1], gram[:-1, -1]


def solve(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(gram, moment)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(gram, moment, rcond=None)[0]


@dataclass(frozen=True)
class RidgeModel:
    spec: FeatureSpec
    weights: np.ndarray

    def predict(self) -> Column:
        """One term per feature: scale, mean and missing flag are folded into constants."""
        w, s = self.weights, self.spec
        constant, terms = float(w[0]), []
        for i, c in enumerate(s.columns):
            slope = float(w[1 + 2 * i]) / s.scales[c]
            constant -= slope * s.means[c]
            missing = slope * s.medians[c] + float(w[2 + 2 * i])
            terms.append(F.coalesce(finite(c) * slope, F.lit(missing)))
        offset = 1 + 2 * len(s.columns)
        if s.groups:
            pairs = [F.lit(x) for g, v in zip(s.groups, w[offset:]) for x in (g, float(v))]
            label = F.coalesce(F.col(s.group_column).cast("string"), F.lit(""))
            terms.append(F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(0.0)))
        return balanced([F.lit(constant), *terms])

    @property
    def columns(self) -> list[str]:
        return self.spec.columns

    def scores(self, value_of: Callable[[str], np.ndarray], labels: Sequence[str | None]) -> np.ndarray:
        """The same as `predict`, term by term, from values by column (NaN for none) and the group of each row."""
        w, s = self.weights, self.spec
        constant, terms = float(w[0]), []
        for i, c in enumerate(s.columns):
            slope, v = float(w[1 + 2 * i]) / s.scales[c], value_of(c)
            constant -= slope * s.means[c]
            terms.append(np.where(np.isnan(v), slope * s.medians[c] + float(w[2 + 2 * i]), v * slope))
        if s.groups:
            effects = dict(zip(s.groups, map(float, w[1 + 2 * len(s.columns) :])))
            terms.append(np.array([effects.get(g, 0.0) for g in labels]))
        return balanced([np.full(len(labels), constant), *terms])


def with_scores(
    df: DataFrame, models: dict, out: str, by: str | None = None, keep: Sequence[str] | None = None, label: str = "conference"
) -> DataFrame:
    """Add `out`, the array of the predictions of fitted models; with `by` each value of that column has its own models.

    The models are applied to batches in numpy. As expressions, many trees and ridges take longer to build and to
    compile than the rows take to score.
    """
    keep = list(df.columns if keep is None else keep)
    columns = list(dict.fromkeys(c for group in models.values() for m in group for c in m.columns))
    width = max((len(group) for group in models.values()), default=0)
    held = df.sparkSession.sparkContext.broadcast(models)
    rows = df.select(
        *keep, F.array(*[finite(c) for c in columns]).cast("array<double>").alias("_x"), F.col(label).cast("string").alias("_label")
    )

    def run(batches):
        place = {c: i for i, c in enumerate(columns)}
        for batch in batches:
            n = batch.num_rows
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(columns))
            labels = np.array(batch.column("_label").to_pylist(), dtype=object)
            keys = np.array(batch.column(by).to_pylist() if by else [None] * n, dtype=object)
            scores = np.full((n, width), np.nan)
            for key, group in held.value.items():
                at = np.flatnonzero(keys == key)
                if len(at):
                    part = x[at]
                    for j, model in enumerate(group):
                        scores[at, j] = model.scores(lambda c: part[:, place[c]], labels[at])
            found = pa.ListArray.from_arrays(np.arange(n + 1, dtype="i4") * width, pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], found], [*keep, out])

    schema = StructType([*rows.select(*keep).schema.fields, StructField(out, ArrayType(DoubleType()))])
    return rows.mapInArrow(run, schema)


def fit_ridge(
    df: DataFrame,
    columns: Sequence[str],
    target: Column,
    alpha: float,
    group_column: str | None = None,
    known: Profile | None = None,
) -> RidgeModel:
    """Ridge with an unpenalised intercept on imputed, scaled features."""
    spec = fit_spec(df, columns, group_column, known)
    gram, moment = design_products(df, spec, target)
    penalty = np.eye(len(moment)) * alpha
    penalty[0, 0] = 0.0
    return RidgeModel(spec, solve(gram + penalty, moment))


@dataclass(frozen=True)
class LabelRidge:
    """Ridge whose label terms are a table (`_label`, `_effect`), so labels may be as many as rows."""

    features: RidgeModel
    effects: DataFrame
    label_column: str

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """`df` with the prediction. Rows with a null, blank or unknown label get no label term.

        Rows without a label meet nothing, so they do not pass the join; what the features say is summed up before it.
        """
        base = df.withColumns({"_label": _label(self.label_column), "_base": self.features.predict()})
        none = base.where(F.col("_label").isNull()).withColumn("_effect", F.lit(None).cast("double"))
        known = base.where(F.col("_label").isNotNull()).join(self.effects, "_label", "left")
        joined = none.unionByName(known)
        return joined.withColumn(out, F.col("_base") + F.coalesce("_effect", F.lit(0.0))).drop("_label", "_base", "_effect")


def _label(column: str) -> Column:
    return F.nullif(F.col(column).cast("string"), F.lit(""))


def fit_ridge_by_label(
    df: DataFrame, columns: Sequence[str], target: Column, alpha: float, label_column: str, known: Profile | None = None
) -> LabelRidge:
    """The same fit as `fit_ridge` with one-hot labels, for any number of labels.

    The block of the labels in the normal equations is diagonal, so it is eliminated: each label has its number
    of rows and its sums of the design and the target, summed before the shuffle, and what it takes from the small system of the
    features is a sum over the labels (the Schur complement). Once the small system is solved, the term of a
    label follows from its own sums. The driver holds only that system, whose size the labels do not change.
    Rows whose target is null or not finite are left out.
    """
    spec = fit_spec(df, columns, known=known)
    design = [F.lit(1.0)]
    for c in spec.columns:
        design += [spec.scaled(c), finite(c).isNull().cast("double")]
    width = len(design)
    rows = df.select(_label(label_column).alias("_label"), finite(target).alias("y"), *[d.alias(f"x{i}") for i, d in enumerate(design)])
    rows = rows.where("y is not null")
    terms = [F.col(f"x{i}") for i in range(width)]
    gram, moment = cross_products(rows, terms, F.col("y"))
    sums = [F.sum(t).alias(f"x{i}") for i, t in enumerate(terms)]
    labels = rows.where("_label is not null").groupBy("_label").agg(F.count("*").alias("n"), F.sum("y").alias("y"), *sums)
    labels = pinned(labels)
    root = F.sqrt(F.col("n") + alpha)
    taken, taken_moment = cross_products(labels, [t / root for t in terms], F.col("y") / root)
    penalty = np.eye(width) * alpha
    penalty[0, 0] = 0.0
    weights = solve(gram + penalty - taken, moment - taken_moment)
    explained = balanced([t * float(w) for t, w in zip(terms, weights)])
    effects = labels.select("_label", ((F.col("y") - explained) / (F.col("n") + alpha)).alias("_effect"))
    return LabelRidge(RidgeModel(spec, weights), effects, label_column)


def fit_least_squares(df: DataFrame, terms: Sequence[Column], target: Column) -> list[float]:
    """Coefficients of intercept and terms."""
    gram, moment = cross_products(df, [F.lit(1.0), *terms], target)
    return [float(v) for v in solve(gram, moment)]


def calibration_report(df: DataFrame, terms: Sequence[Column], target: Column, season: str) -> dict:
    """Least-squares fit with its errors, coefficients to six and errors to two decimals."""
    b = fit_least_squares(df, terms, target)
    estimate = balanced([F.lit(b[0]), *[t * c for t, c in zip(terms, b[1:])]])
    miss = estimate - target
    row = df.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.sort_array(F.collect_set(season)).alias("seasons"),
    ).first()
    return {
        "coefficients": [round(v, 6) for v in b],
        "row_count": row["n"],
        "seasons": list(row["seasons"]),
        "mae": round(row["mae"], 2),
        "rmse": round(row["rmse"], 2),
    }


def observed(known: Profile, columns: Sequence[str]) -> list[str]:
    """Columns with at least one finite value."""
    return [c for c in columns if known.counts[c]]


def correlation_scores(known: Profile, columns: Sequence[str]) -> list[tuple[float, str]]:
    """Absolute correlation with the target after median imputation; flat columns are left out."""
    return [(known.correlations[c], c) for c in columns if known.correlations[c] is not None]


def select_features(
    known: Profile, columns: Sequence[str], limit: int | None, forced: Sequence[str] = ()
) -> list[str]:
    """The `limit` columns most correlated with the target, then the forced ones."""
    columns = list(columns)
    chosen = columns
    if limit is not None and len(columns) > limit:
        ranked = sorted(correlation_scores(known, columns), reverse=True)
        chosen = [c for _, c in ranked[:limit]] or columns[:limit]
    return [*chosen, *[c for c in forced if c in columns and c not in chosen]]
