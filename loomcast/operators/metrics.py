"""Ranking and agreement measures of scored rows, as distributed aggregates.

Scores are grouped before anything is ordered, so what a window sorts is distinct scores and not
rows. NaN stands for a measure that a block does not have (one class, no rows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import in_ranges, totals_before

NAN = float("nan")


def _or_nan(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.lit(NAN))


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, n_pos, auc): area under the ROC curve with ties counted half."""
    counts = df.groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("__p"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("__q"))
    won = _negatives_below(counts, score, by).withColumn("won", F.col("__p") * (F.col("__below") + F.col("__q") / 2.0))
    out = won.groupBy(*by).agg(F.sum("__p").alias("n_pos"), F.sum("__q").alias("n_neg"), F.sum("won").alias("won"))
    return out.select(*by, (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos", _or_nan((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.try_divide("won", F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def _negatives_below(counts: DataFrame, score: str, by: Sequence[str], bins: int = 1024) -> DataFrame:
    """`counts` with __below, the sum of __q over smaller scores. Scores are dealt to bins of equal width,
    so sums run within a bin and over the bins of a block, and no task orders all scores of a block."""
    keys = list(by)
    span = counts.groupBy(*keys).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    both = counts.join(span, keys) if keys else counts.crossJoin(F.broadcast(span))
    place = F.coalesce(F.try_divide(F.col(score) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    binned = both.withColumn("__bin", F.floor(place * bins).cast("int")).drop("__lo", "__hi")
    before = lambda parts, order: Window.partitionBy(*(parts or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(*keys, "__bin").agg(F.sum("__q").alias("__all"))
    totals = totals.withColumn("__lower", F.coalesce(F.sum("__all").over(before(keys, "__bin")), F.lit(0))).drop("__all")
    own = binned.withColumn("__own", F.coalesce(F.sum("__q").over(before([*keys, "__bin"], score)), F.lit(0)))
    return own.join(totals, [*keys, "__bin"]).withColumn("__below", F.col("__own") + F.col("__lower")).drop("__own", "__lower", "__bin")


def average_precision(df: DataFrame, y: str, score: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_pos, ap): mean precision at the positives, ties in the order of `tie`.

    Ranks and hits before a row come from ranges of the order, so no task ranks all rows of a block.
    """
    hit = (F.col(y) == 1).cast("long")
    ranked = totals_before(df.select(*by, y, score, tie), [F.col(score).desc(), F.col(tie)], {"__tp": F.coalesce(hit, F.lit(0)), "__n": F.lit(1)}, by)
    out = ranked.groupBy(*by).agg(F.count_if(F.col(y) == 1).alias("n_pos"), F.avg(F.when(F.col(y) == 1, (F.col("__tp") + 1) / (F.col("__n") + 1))).alias("ap"))
    return out.withColumn("ap", F.coalesce("ap", F.lit(NAN)))


def tpr_at_fpr(df: DataFrame, y: str, score: str, fpr: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, tpr): the share of positives strictly above the k-th largest negative, with
    k = floor(fpr * negatives) and the largest for k = 0."""
    counts = df.groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("__p"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("__q"))
    part = Window.partitionBy(*(by or [F.lit(0)]))
    above = part.orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    told = counts.withColumns({"__above": F.sum("__q").over(above), "__neg": F.sum("__q").over(part)})
    k = F.floor(F.lit(float(fpr)) * F.col("__neg"))
    at = told.withColumn("__threshold", F.max(F.when((F.col("__above") > k) & (F.col("__q") > 0), F.col(score))).over(part))
    out = at.groupBy(*by).agg(F.max("__threshold").alias("threshold"), F.sum("__p").alias("__p"), F.sum("__q").alias("__q"), F.sum(F.when(F.col(score) > F.col("__threshold"), F.col("__p")).otherwise(0)).alias("hit"))
    both = (F.col("__p") > 0) & (F.col("__q") > 0)
    return out.select(*by, _or_nan(both, F.col("threshold")).alias("threshold"), _or_nan(both, F.try_divide("hit", "__p")).alias("tpr"))


def balanced_accuracy(y: Column, predicted: Column) -> Column:
    """Aggregate: the mean of the shares of positives and of negatives told rightly."""
    rate = lambda c, ok: F.count_if(c & ok) / F.greatest(F.lit(1), F.count_if(c))
    return 0.5 * (rate(y, predicted) + rate(~y, ~predicted))


#: 19 thresholds from 0.05 to 0.95.
IOU_THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))


def best_iou(df: DataFrame, target: str, prob: str, by: Sequence[str] = (), thresholds: Sequence[float] = IOU_THRESHOLDS) -> DataFrame:
    """(by, best_iou, best_threshold): the best overlap of prob >= threshold with the target; the
    first of equal thresholds, and (0, 0.5) where there is none. All thresholds in one aggregate."""
    hit = F.col(target) == 1
    sums = []
    for i, t in enumerate(thresholds):
        over = F.col(prob) >= t
        sums += [F.count_if(over & hit).alias(f"__i{i}"), F.count_if(over | hit).alias(f"__u{i}")]
    out = df.groupBy(*by).agg(*sums)
    options = F.array(*[F.struct(F.coalesce(F.try_divide(f"__i{i}", f"__u{i}"), F.lit(0.0)).alias("iou"), F.lit(-float(t)).alias("minus")) for i, t in enumerate(thresholds)])
    best = out.withColumn("__best", F.array_max(options))
    some = F.col("__best.iou") > 0
    return best.select(*by, F.when(some, F.col("__best.iou")).otherwise(0.0).alias("best_iou"), F.when(some, -F.col("__best.minus")).otherwise(0.5).alias("best_threshold"))


def within_group_auc(df: DataFrame, y: str, score: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_groups, mean_auc): the mean over groups that have both classes."""
    each = roc_auc(df, y, score, [*by, group]).where(~F.isnan("auc"))
    out = each.groupBy(*by).agg(F.count("*").alias("n_groups"), F.avg("auc").alias("mean_auc"))
    return out.withColumn("mean_auc", F.coalesce("mean_auc", F.lit(NAN)))


def metric_blocks(df: DataFrame, y: str, score: str, groupings: Sequence[Sequence[str]], least: int = 5) -> DataFrame:
    """(block, key, n, n_pos, auc) of all rows and of each grouping; blocks of fewer than `least` rows
    or of one class are left out."""
    sets: DataFrame | None = None
    for cols in ([], *groupings):
        block = F.lit("/".join(cols) or "all")
        key = F.concat_ws("/", *[F.col(c).cast("string") for c in cols]) if cols else F.lit("")
        one = df.select(block.alias("block"), key.alias("key"), F.col(y).alias("y"), F.col(score).alias("score"))
        sets = one if sets is None else sets.unionByName(one)
    out = roc_auc(sets, "y", "score", ["block", "key"])
    return out.where((F.col("n") >= least) & ~F.isnan("auc"))


def bootstrap_ci(df: DataFrame, by: Sequence[str], columns: Sequence[str], statistic: Callable[[np.ndarray], float], reps: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(by, low, high): the percentile interval of `statistic` over resamples of each block's rows.

    Resamples without a value are skipped; without any, the interval is null. A resample needs the block in one place; blocks are
    evaluation sets, whose size their caller bounds.
    """
    names = list(by)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows = part[list(columns)].to_numpy(dtype=np.float64)
        rows = rows[np.lexsort(rows.T[::-1])]  # the order of rows does not matter
        rng = np.random.default_rng(seed)
        found = [statistic(rows[rng.integers(0, len(rows), len(rows))]) for _ in range(reps)]
        found = [v for v in found if v == v]
        low, high = (np.quantile(found, alpha / 2), np.quantile(found, 1 - alpha / 2)) if found else (NAN, NAN)
        return pd.DataFrame([[*key, float(low), float(high)]], columns=[*names, "low", "high"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(*names, *columns).groupBy(*names).applyInPandas(run, f"{schema}, low double, high double")


def bootstrap_auc(df: DataFrame, by: Sequence[str], y: str, score: str, reps: int = 1000, seed: int = 0, alpha: float = 0.05, ranges: int | None = None) -> DataFrame:
    """(by, low, high): the percentile interval of the ROC-AUC over `reps` Poisson resamples.

    Rows are counted by score first. A count is drawn anew in each resample, from a stream seeded by
    the count's keys, so the order of rows and the number of tasks do not matter. Each range of scores
    adds up, for all resamples at once, its positives, its negatives and the pairs won within it; of
    the other pairs, range totals tell all. Resamples of one class are skipped; without any, the
    interval is null.
    """
    names = list(by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    kinds = kinds + ", " if kinds else ""
    counts = df.groupBy(*names, score).agg(F.count_if(F.col(y) == 1).alias("__p"), F.count_if(F.col(y) != 1).alias("__q"))
    counts = counts.withColumn("__seed", F.xxhash64(*names, F.col(score).cast("double"), F.lit(seed)))
    placed = in_ranges(counts.select(*names, F.col(score).cast("double").alias("__score"), "__p", "__q", "__seed"), [*map(F.col, names), F.col("__score")], ranges)

    def totals(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("__score")
        p, q, won = np.zeros(reps), np.zeros(reps), np.zeros(reps)
        for x, z, s in zip(part["__p"].to_pylist(), part["__q"].to_pylist(), part["__seed"].to_pylist()):
            rng = np.random.default_rng(s & (1 << 64) - 1)
            more, below = rng.poisson(x, reps), rng.poisson(z, reps)
            won += more * (q + below / 2)
            p, q = p + more, q + below
        return pa.table([*[[k] for k in key], [p], [q], [won]], names=[*names, "__range", "p", "q", "won"])

    sums = placed.groupBy(*names, "__range").applyInArrow(totals, f"{kinds}__range int, p array<double>, q array<double>, won array<double>")

    def interval(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("__range")
        p, q, won = (np.array(part[c].to_pylist()).reshape(-1, reps) for c in ("p", "q", "won"))
        total = (won + p * (np.cumsum(q, 0) - q)).sum(0)
        pairs = p.sum(0) * q.sum(0)
        found = total[pairs > 0] / pairs[pairs > 0]
        low, high = np.quantile(found, [alpha / 2, 1 - alpha / 2]) if len(found) else (NAN, NAN)
        return pa.table([*[[k] for k in key], [float(low)], [float(high)]], names=[*names, "low", "high"])

    if not names:
        sums = sums.withColumn("__all", F.lit(0))
        return sums.groupBy("__all").applyInArrow(lambda key, part: interval((), part), "low double, high double")
    return sums.groupBy(*names).applyInArrow(interval, f"{kinds}low double, high double")


def auc_of(rows: np.ndarray) -> float:
    """ROC-AUC of (y, score) rows."""
    y, s = rows[:, 0] == 1, rows[:, 1]
    p, q = int(y.sum()), int((~y).sum())
    if not p or not q:
        return NAN
    order = np.sort(s[~y])
    return float((np.searchsorted(order, s[y], "left") + np.searchsorted(order, s[y], "right")).sum() / 2 / (p * q))


def gram(df: DataFrame, vector: str, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, sum of outer products) of a vector column, summed up by partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(-1, dims)
            n, total, outer = n + len(x), total + x.sum(0), outer + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([outer.ravel().tolist()])], names=["n", "total", "outer"])

    parts = df.select(vector).mapInArrow(run, "n long, total array<double>, outer array<double>")
    sums = [F.sum("n").alias("n")]
    both = parts.withColumn("all", F.concat("total", "outer")).select("n", F.posexplode("all").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), *sums)
    rows = sorted(both.collect())
    flat = np.array([r["v"] for r in rows])
    return (int(rows[0]["n"]) if rows else 0), flat[:dims], flat[dims:].reshape(dims, dims) if rows else np.zeros((dims, dims))


def collapse(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """(n, mean_std, rankme, collapsed): the mean deviation per dimension times the root of their
    number, for unit vectors, and the exponential entropy of the singular values."""
    unit = df.select(F.transform(vector, lambda x: x / F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))).alias("unit"))
    n, total, outer = gram(unit, "unit", dims)
    _, _, raw = gram(df, vector, dims)
    variance = np.maximum(np.diag(outer) - total**2 / max(n, 1), 0) / max(n - 1, 1)
    spread = float(np.sqrt(variance).mean() * np.sqrt(dims))
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(raw), 0))
    p = values / (values.sum() + 1e-7) + 1e-7
    rank = float(np.exp(-(p * np.log(p)).sum()))
    return df.sparkSession.createDataFrame([(n, spread, rank, bool(spread < 0.1 or rank / max(1, min(n, dims)) < 0.1))], "n long, mean_std double, rankme double, collapsed boolean")


def fit_probe(df: DataFrame, features: str, label: Column, weight_decay: float):
    """A class-balanced logistic regression on standardised features; returns the MLlib model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), label.cast("double").alias("label"))
    n, positive = rows.agg(F.count("*"), F.sum("label")).first()
    positive = positive or 0.0
    weight = F.when(F.col("label") == 1, n / max(2.0 * positive, 1.0)).otherwise(n / max(2.0 * (n - positive), 1.0))
    return LogisticRegression(regParam=weight_decay, standardization=True, weightCol="weight", maxIter=100).fit(rows.withColumn("weight", weight))


def select_probe(train: DataFrame, val: DataFrame, features: str, label: Column, decays: Sequence[float]):
    """(model, weight decay) with the least log loss on `val`; the first of equals."""
    best = None
    for decay in decays:
        model = fit_probe(train, features, label, decay)
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p")))
        loss = score_probe(model, val.withColumn("__y", label.cast("double")), features).agg(F.avg(-F.when(F.col("__y") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]
        if best is None or (loss is not None and loss < best[2]):
            best = model, decay, loss if loss is not None else float("inf")
    return best[0], best[1]


def score_probe(model, df: DataFrame, features: str) -> DataFrame:
    """`df` with p, the probability of the label."""
    w, b = model.coefficients.toArray().tolist(), float(model.intercept)
    score = F.aggregate(F.zip_with(F.col(features), F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(b), lambda s, x: s + x)
    return df.withColumn("p", 1.0 / (1.0 + F.exp(-score)))


def parity(reference: DataFrame, variant: DataFrame, id_col: str, score: str, vector: str) -> DataFrame:
    """(n, correlation, mean_cosine, max_abs_diff) of a variant's outputs against the reference's."""
    a = reference.select(id_col, F.col(score).alias("__s"), F.col(vector).alias("__v"))
    both = variant.select(id_col, score, vector).join(a, id_col)
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    v, w = F.col(vector), F.col("__v")
    cosine = F.try_divide(product(v, w), F.sqrt(product(v, v) * product(w, w)))
    return both.agg(F.count("*").alias("n"), F.corr(score, "__s").alias("correlation"), F.avg(cosine).alias("mean_cosine"), F.max(F.abs(F.col(score) - F.col("__s"))).alias("max_abs_diff"))


def within_tolerance(delta_auc: Column, delta_degrees: Column, auc: float = 0.01, degrees: float = 1.0) -> Column:
    """Whether a variant passes; an unknown delta passes."""
    ok = lambda d, most: F.isnan(d) | (F.abs(d) <= most)
    return F.coalesce(ok(delta_auc, auc), F.lit(True)) & F.coalesce(ok(delta_degrees, degrees), F.lit(True))


def threshold_search(df: DataFrame, value: str, label: str, names: Sequence[str], quantiles: Sequence[float], least: int = 5) -> DataFrame:
    """(a, b, agreement): of all pairs a <= b of the quantiles of `value`, the one whose three classes
    `names` (below a, below b, the rest) agree most with `label`; of equals the smallest a, then b.

    Rows without a label do not count; fewer than `least` labelled rows give no row. Rows are counted
    by class between neighbouring quantiles; running sums of these counts tell what each threshold gets
    right by itself, and a running maximum the best partner below it, so no pairs are listed.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(value).alias("v"), F.col(label).alias("label"))
    whole = rows.agg(F.percentile("v", [float(q) for q in quantiles]).alias("q"), F.count("*").alias("n")).where(F.col("n") >= least)
    whole = whole.select(F.array_sort(F.array_distinct("q")).alias("q"), "n")
    place = F.size(F.filter("q", lambda x: x <= F.col("v")))
    counts = rows.join(F.broadcast(whole)).groupBy(place.alias("place")).agg(*[F.count_if(F.col("label") == name).alias(f"n{i}") for i, name in enumerate(names)])
    # of each quantile, the rows of each class below it: those at a place up to its own
    grid = whole.select("n", F.posexplode("q").alias("place", "x")).join(counts, "place", "full")
    upto = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    below = [F.coalesce(F.sum(f"n{i}").over(upto), F.lit(0)).alias(f"b{i}") for i in range(3)]
    told = grid.select("place", "x", F.max("n").over(every).alias("n"), *below, F.coalesce(F.sum("n2").over(every), F.lit(0)).alias("last")).where("x is not null")
    # right = below a of the first + between of the second + from b on of the third; the best a up to each b
    lower = F.max(F.struct((F.col("b0") - F.col("b1")).alias("f"), (-F.col("place")).alias("minus"), F.col("x").alias("a"))).over(upto)
    found = told.select(lower.alias("lower"), F.col("x").alias("b"), (F.col("b1") - F.col("b2") + F.col("last")).alias("g"), "n")
    found = found.select("lower.a", "b", "n", (F.col("lower.f") + F.col("g")).alias("right"))
    return found.orderBy(F.desc("right"), "a", "b").limit(1).select("a", "b", (F.col("right") / F.col("n")).alias("agreement"))
