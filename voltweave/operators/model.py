"""Demand prediction: features, ridge regression from sufficient statistics, and its measures."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

ALPHAS = np.logspace(-6, 6, 200)
FOLDS = 10


def all_null_columns(df: DataFrame, columns: list[str]) -> list[str]:
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if not counts[c]]


#: Different texts of a column up to which their numbers are broadcast.
BROADCAST_VALUES = 1_000_000


def codes(df: DataFrame, column: str) -> DataFrame:
    """Different texts (or booleans) of a column with their number in alphabetical order: one row for each."""
    values = stage(df.filter(F.col(column).isNotNull()).select(F.col(column).alias("__value")).distinct(), "values")
    return stage(values.withColumn("__code", (F.row_number().over(Window.orderBy("__value")) - 1).cast("double")), "codes")


def encode(df: DataFrame, column: str, numbers: DataFrame | None = None) -> DataFrame:
    """Texts (or booleans) replaced by their number; null, and what has no number, becomes null."""
    numbers = codes(df, column) if numbers is None else numbers
    hint = F.broadcast if numbers.count() <= BROADCAST_VALUES else (lambda x: x)
    return df.join(hint(numbers), F.col(column) == F.col("__value"), "left").drop(column, "__value").withColumnRenamed("__code", column)


@dataclass
class Features:
    """What is learned of training rows: the columns that have values, numbers of texts, means and deviations."""

    columns: list[str]
    target: str
    key: str
    numbers: dict[str, DataFrame]
    means: dict[str, float]
    spread: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str], target: str, key: str) -> "Features":
        data = train.select(key, *columns, target).filter(F.col(target).isNotNull())
        columns = [c for c in columns if c not in all_null_columns(data, columns)]
        numbers = {c: codes(data, c) for c in columns if dict(data.dtypes)[c] in ("string", "boolean")}
        out = cls(columns, target, key, numbers, {}, {})
        filled = out._numeric(data)
        if columns:
            out.means = filled.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
            filled = filled.fillna({c: m for c, m in out.means.items() if m is not None})
            out.spread = filled.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first().asDict()
        return out

    def _numeric(self, df: DataFrame) -> DataFrame:
        data = df.select(self.key, *self.columns, self.target).filter(F.col(self.target).isNotNull())
        for c, numbers in self.numbers.items():
            data = encode(data, c, numbers)
        return data.select(self.key, *[F.col(c).cast("double") for c in self.columns], F.col(self.target).cast("double"))

    def transform(self, df: DataFrame) -> DataFrame:
        """key, standardised features (nulls and unknown texts get the training mean) and target of rows that have a target."""
        data = self._numeric(df).fillna({c: m for c, m in self.means.items() if m is not None})
        return data.withColumns({c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.spread[c] or 1.0) for c in self.columns}) if self.columns else data


def feature_matrix(df: DataFrame, columns: list[str], target: str, key: str, impute: bool = True) -> DataFrame:
    """key, features and target as doubles: rows without target go, as do columns without values; nulls get the mean, or their rows go."""
    data = df.select(key, *columns, target).filter(F.col(target).isNotNull())
    columns = [c for c in columns if c not in all_null_columns(data, columns)]
    for c in columns:
        if dict(data.dtypes)[c] in ("string", "boolean"):
            data = encode(data, c)
    data = data.select(key, *[F.col(c).cast("double") for c in columns], F.col(target).cast("double"))
    if not impute:
        return data.dropna(subset=columns)
    means = data.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    return data.fillna({c: m for c, m in means.items() if m is not None})


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a constant one becomes 0."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[c]["m"])) / F.lit(stats[c]["s"] or 1.0) for c in columns})


def held_out(key: Column, share: int = 5) -> Column:
    """One in ``share`` rows, by a hash of the key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % share == 0


@dataclass
class Gram:
    """n, sums and products of features and target."""

    n: float
    x: np.ndarray
    y: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __sub__(self, other: "Gram") -> "Gram":
        return Gram(*(a - b for a, b in zip(vars(self).values(), vars(other).values())))

    def solve(self, alpha: float) -> tuple[np.ndarray, float]:
        mx, my = self.x / self.n, self.y / self.n
        a = self.xx - self.n * np.outer(mx, mx) + alpha * np.eye(len(mx))
        w = np.linalg.lstsq(a, self.xy - self.n * mx * my, rcond=None)[0]
        return w, my - w @ mx

    def r2(self, w: np.ndarray, b: float) -> float:
        sse = self.yy - 2 * (w @ self.xy + b * self.y) + w @ self.xx @ w + 2 * b * (w @ self.x) + self.n * b * b
        sst = self.yy - self.y**2 / self.n
        return 1 - sse / sst if sst > 0 else 0.0


def grams(df: DataFrame, columns: list[str], target: str, fold: Column) -> dict[int, Gram]:
    """Sufficient statistics of each fold, in one aggregate."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.count(F.lit(1)), *[F.sum(c) for c in columns], F.sum(target), *[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs], *[F.sum(F.col(c) * F.col(target)) for c in columns], F.sum(F.col(target) * F.col(target))]
    out = {}
    for row in df.groupBy(fold.alias("__fold")).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect():
        v = np.array([float(x) for x in row[1:]])
        xx = np.zeros((k, k))
        for (i, j), value in zip(pairs, v[k + 2 : k + 2 + len(pairs)]):
            xx[i, j] = xx[j, i] = value
        out[row[0]] = Gram(v[0], v[1 : k + 1], v[k + 1], xx, v[k + 2 + len(pairs) : -1], v[-1])
    return out


@dataclass
class Ridge:
    columns: list[str]
    weights: np.ndarray
    intercept: float
    alpha: float
    cv_r2: float

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, sum((F.col(c) * float(w) for c, w in zip(self.columns, self.weights)), F.lit(float(self.intercept))))


def ridge_cv(df: DataFrame, columns: list[str], target: str, key: str, alphas=ALPHAS, folds: int = FOLDS) -> Ridge:
    """Ridge with the alpha of the best mean R2 over folds (a hash of the key); the data are read once."""
    by_fold = grams(df, columns, target, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(folds)))
    parts = list(by_fold.values())
    whole = Gram(*(sum(x) for x in zip(*(vars(g).values() for g in parts))))
    usable = [g for g in parts if g.n > 1 and whole.n - g.n > 1]
    scores = [np.mean([g.r2(*(whole - g).solve(a)) for g in usable]) if usable else 0.0 for a in alphas]
    best = int(np.argmax(scores))
    w, b = whole.solve(alphas[best])
    return Ridge(columns, w, b, float(alphas[best]), float(scores[best]))


def _descend(g: Gram, alpha: float, l1_ratio: float, w: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept of |y - Xw|^2 / 2n + alpha (l1 |w|_1 + (1 - l1) |w|^2 / 2) by coordinate descent, from ``w`` on."""
    mx, my = g.x / g.n, g.y / g.n
    a, b = g.xx / g.n - np.outer(mx, mx), g.xy / g.n - mx * my
    w = np.zeros(len(b)) if w is None else w.copy()
    for _ in range(10_000):
        before = w.copy()
        for i in range(len(w)):
            rest = b[i] - a[i] @ w + a[i, i] * w[i]
            w[i] = np.sign(rest) * max(0.0, abs(rest) - alpha * l1_ratio) / (a[i, i] + alpha * (1 - l1_ratio) or 1.0)
        if np.abs(w - before).max(initial=0.0) < 1e-12:
            break
    return w, my - w @ mx


def elastic_net(df: DataFrame, columns: list[str], target: str, alpha: float, l1_ratio: float = 1.0) -> Ridge:
    """Lasso (l1_ratio 1) or elastic net at one alpha, from the sufficient statistics."""
    w, b = _descend(grams(df, columns, target, F.lit(0))[0], alpha, l1_ratio)
    return Ridge(columns, w, b, alpha, float("nan"))


def elastic_net_cv(df: DataFrame, columns: list[str], target: str, key: str, l1_ratio: float = 1.0, alphas=ALPHAS, folds: int = FOLDS) -> Ridge:
    """Lasso or elastic net with the alpha of the best mean R2 over folds (a hash of the key); the data are read once.

    Alphas are taken from the largest down, each from the weights of the one before.
    """
    by_fold = grams(df, columns, target, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(folds)))
    parts = list(by_fold.values())
    whole = Gram(*(sum(x) for x in zip(*(vars(g).values() for g in parts))))
    usable = [g for g in parts if g.n > 1 and whole.n - g.n > 1]
    down = sorted(alphas, reverse=True)
    scores = np.zeros(len(down))
    for g in usable:
        w, rest = None, whole - g
        for i, alpha in enumerate(down):
            w, b = _descend(rest, alpha, l1_ratio, w)
            scores[i] += g.r2(w, b) / len(usable)
    best = int(np.argmax(scores))
    w, b = _descend(whole, down[best], l1_ratio)
    return Ridge(columns, w, b, float(down[best]), float(scores[best]))


def prediction_metrics(df: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """Correlation and R2 of predictions."""
    mean = df.agg(F.avg(target)).first()[0]
    error, spread = F.sum((F.col(target) - F.col(prediction)) ** 2), F.sum((F.col(target) - F.lit(mean)) ** 2)
    return df.agg(F.count(F.lit(1)).alias("n"), F.corr(target, prediction).alias("r"), (1 - F.try_divide(error, spread)).alias("r2"))


def stratified(df: DataFrame, strata: dict[str, Column], columns: list[str], target: str, key: str) -> list[tuple[str, int, float | None, float | None]]:
    """(stratum, test rows, r, R2) of a ridge fitted and tested within each stratum; all that is learned comes from its training rows."""
    out = []
    for name, condition in strata.items():
        data = stage(df.filter(condition).filter(F.col(target).isNotNull()), "stratum")
        test = held_out(F.col(key))
        if data.filter(~test).isEmpty() or data.filter(test).isEmpty():
            out.append((name, 0, None, None))
            continue
        features = Features.fit(data.filter(~test), columns, target, key)
        if not features.columns:
            out.append((name, 0, None, None))
            continue
        fit = ridge_cv(features.transform(data.filter(~test)), features.columns, target, key)
        row = prediction_metrics(fit.predict(features.transform(data.filter(test))), target).first()
        out.append((name, row["n"], row["r"], row["r2"]))
    return out


def top_predictors(spark, model: Ridge, n: int = 10) -> DataFrame:
    """Features by the size of their weight, zeros left out."""
    rows = [(c, float(w)) for c, w in zip(model.columns, model.weights) if w]
    return spark.createDataFrame(rows, "feature string, weight double").orderBy(F.abs("weight").desc(), "feature").limit(n)
