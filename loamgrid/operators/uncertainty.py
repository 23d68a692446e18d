"""Locally weighted conformal intervals, area of applicability and risk classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.operators.neighbors import knn_reduce, nearest_distance
from loamgrid.operators.ordering import exact_quantile_scalar, exact_quantiles
from loamgrid.session import write_and_read

# Default settings of the interval and applicability analysis.
ALPHA = 0.10
NEIGHBORS = 60
BANDWIDTH_SCALE = 0.60
MIN_BANDWIDTH = 200.0
CCB_BINS = 10
AOA_OUTLIER_QUANTILE = 0.95
WIDTH_QUANTILE = 0.75
IDW_NEIGHBORS = 48
IDW_POWER = 1.5
IDW_SHRINK = 0.35
IDW_MIN_SCALE = 0.65
IDW_MAX_SCALE = 1.80

# Most distinct values that one task orders, and the parts into which more are cut.
ORDERED = 100_000
RANK_PARTS = 256

# The interval parameter sets that are compared.
PARAM_SETS = (
    ("baseline", 0.10, 60, 0.6, 200.0),
    ("wider_interval", 0.15, 60, 0.6, 200.0),
    ("more_neighbors", 0.10, 80, 0.6, 200.0),
    ("smoother_bandwidth", 0.10, 60, 0.8, 300.0),
    ("balanced_alt", 0.15, 45, 0.8, 300.0),
)


def weighted_quantile_rows(v: np.ndarray, w: np.ndarray, q: float) -> np.ndarray:
    """Row-wise smallest value whose cumulative weight reaches q of the total; weights of 0 never count."""
    order = np.lexsort((w, v), axis=1)
    v, cum = np.take_along_axis(v, order, axis=1), np.cumsum(np.take_along_axis(w, order, axis=1), axis=1)
    hit = (cum >= q * cum[:, -1:]) & (cum > 0)
    return np.where(hit.any(axis=1), np.take_along_axis(v, hit.argmax(axis=1)[:, None], axis=1)[:, 0], np.nan)


def gaussian_rows(dist, resid, alpha, scale, min_bw):
    bw = np.maximum(min_bw, dist[:, -1:] * scale)
    return weighted_quantile_rows(resid, np.exp(-0.5 * (dist / bw) * (dist / bw)), 1.0 - alpha)


def doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def neighbor_count(neighbors: int) -> int:
    return max(5, neighbors)


def local_qhat(
    targets: DataFrame,
    calib: DataFrame,
    *,
    alpha=ALPHA,
    neighbors=NEIGHBORS,
    scale=BANDWIDTH_SCALE,
    min_bw=MIN_BANDWIDTH,
    exclude_self: str | None = None,
    **kw,
) -> DataFrame:
    """Adds ``qhat``. A sample that is its own target counts itself unless ``exclude_self`` names its id column."""
    one = lambda d, c: [gaussian_rows(d, c[:, :, 0], alpha, scale, min_bw)]
    return knn_reduce(targets, calib, neighbor_count(neighbors), one, doubles("qhat"), carry=["abs_residual"], self_id=exclude_self, **kw)


def conformal_global_quantile(oof: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row: n, q and the metrics of the constant-width interval.

    q is the residual of rank ceil((n + 1)(1 - alpha)), clamped to [1, n]; taken from the ordered
    distinct residuals around that rank, so no full sort happens in one place.
    """
    n = oof.select(F.count("abs_residual")).scalar()
    rank = F.least(F.greatest(F.ceil((n + 1) * F.lit(1.0 - alpha)), F.lit(1)), n)
    q = ranked_value(oof, "abs_residual", lambda c: F.least(F.greatest(F.ceil((c + 1) * F.lit(1.0 - alpha)), F.lit(1)), c))
    t = oof.withColumn("q", q)
    lo, hi = F.col("pred") - F.col("q"), F.col("pred") + F.col("q")
    cov = ((F.col("y_true") >= lo) & (F.col("y_true") <= hi)).cast("double")
    res = t.agg(
        F.count("*").alias("n"),
        F.max("q").alias("q"),
        F.avg(cov).alias("picp"),
        F.avg(2 * F.col("q")).alias("width"),
        F.avg(interval_score(F.col("y_true"), lo, hi, alpha)).alias("interval_score"),
    )
    return res.filter(F.col("n") >= 8).withColumn("rank", rank.cast("long"))


def ranked_value(df: DataFrame, value: str, rank_of) -> Column:
    """Value at an exact rank (1-based; ``rank_of`` maps the number of values to it) as a scalar; NULL without values.

    Distinct values are counted and written once. Their range is cut into 256 parts of even size, the part that holds the
    rank is kept, and so on until at most ``ORDERED`` distinct values are left: only those are ever ordered in one place.
    """
    v = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    d = write_and_read(v.groupBy("v").agg(F.count("*").alias("m")), "values")
    k, n = d.agg(F.count("*"), F.sum("m")).first()
    if not k:
        return F.lit(None).cast("double")
    rank = df.sparkSession.range(1).select(rank_of(F.lit(n)).cast("long")).first()[0]
    while k > ORDERED:
        cuts = d.agg(F.array_distinct(F.percentile_approx("v", [i / RANK_PARTS for i in range(RANK_PARTS + 1)], 10_000))).first()[0]
        part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda e: e < F.col("v")))
        sizes = d.groupBy(part.alias("b")).agg(F.count("*").alias("k"), F.sum("m").alias("m")).orderBy("b").collect()  # RANK_PARTS + 1 rows
        for b, k, m in sizes:
            if m >= rank:
                break
            rank -= m
        d = d.filter(part == b)
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # at most ORDERED rows
    return d.withColumn("c", F.sum("m").over(w)).filter(F.col("c") >= rank).agg(F.min("v")).scalar()


def interval_score(y: Column, lo: Column, hi: Column, alpha: float) -> Column:
    pen = F.lit(2.0 / alpha)
    return (hi - lo) + pen * F.greatest(lo - y, F.lit(0.0)) + pen * F.greatest(y - hi, F.lit(0.0))


def prediction_intervals(df: DataFrame) -> DataFrame:
    """lower, upper, width = 2 qhat, covered."""
    return (
        df.withColumn("interval_lower", F.col("pred") - F.col("qhat"))
        .withColumn("interval_upper", F.col("pred") + F.col("qhat"))
        .withColumn("interval_width", F.lit(2.0) * F.col("qhat"))
        .withColumn(
            "covered",
            ((F.col("y_true") >= F.col("interval_lower")) & (F.col("y_true") <= F.col("interval_upper"))).cast("int"),
        )
    )


def grid_intervals(cells: DataFrame, calib: DataFrame, **kw) -> DataFrame:
    """The same interval for every valid cell of a map."""
    t = local_qhat(cells, calib, **kw)
    return (
        t.withColumn("interval_lower", F.col("pred") - F.col("qhat"))
        .withColumn("interval_upper", F.col("pred") + F.col("qhat"))
        .withColumn("interval_width", F.lit(2.0) * F.col("qhat"))
    )


def coverage_by_width_bin(iv: DataFrame, alpha: float = ALPHA, bins: int = CCB_BINS, by: list[str] = (), few: bool = False) -> DataFrame:
    """Coverage per width-quantile bin (right-closed, equal edges merged) per group; ``few`` as in ``exact_quantiles``."""
    by = list(by)
    q = exact_quantiles(iv, "interval_width", [i / bins for i in range(bins + 1)], by, few=few)
    if by:
        b = iv.join(F.broadcast(q) if few else q, by)
    else:
        b = iv.withColumn("q", q.select("q").scalar())
    edge = F.array_distinct("q")
    b = b.withColumn("bin", F.greatest(F.size(F.filter(edge, lambda e: e < F.col("interval_width"))), F.lit(1)))
    return b.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(F.col("covered").cast("double")).alias("coverage"))


def interval_metrics(iv: DataFrame, alpha: float | Column = ALPHA, bins: int = CCB_BINS, by: list[str] = (), few: bool = False) -> DataFrame:
    """PICP, MPIW, NMPIW, binned coverage error, interval score and median width per group.

    ``few`` as in ``exact_quantiles``: then the groups' quantiles go to the rows. Rows that repeat are small files, and the
    planner would take them for the side to broadcast.
    """
    by = list(by)
    nominal = F.lit(1.0) - (alpha if isinstance(alpha, Column) else F.lit(alpha))
    pen = F.lit(2.0) / (alpha if isinstance(alpha, Column) else F.lit(alpha))
    y, lo, hi = F.col("y_true"), F.col("interval_lower"), F.col("interval_upper")
    score = (hi - lo) + pen * F.greatest(lo - y, F.lit(0.0)) + pen * F.greatest(y - hi, F.lit(0.0))
    base = iv.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.col("covered").cast("double")).alias("picp"),
        F.avg("interval_width").alias("mpiw"),
        (F.max("y_true") - F.min("y_true")).alias("__r"),
        F.avg(score).alias("interval_score"),
        F.max(nominal).alias("nominal"),
    )
    err = coverage_by_width_bin(iv, bins=bins, by=by, few=few)
    med = exact_quantiles(iv, "interval_width", [0.5], by, out="__m", few=few)
    if by:
        base = base.join(med, by)
        err = err.join(base.select(*by, F.col("nominal").alias("__nom")), by)
        err = err.groupBy(*by).agg(F.avg(F.abs(F.col("coverage") - F.col("__nom"))).alias("__ccb"))
        base = base.join(err, by)
    else:
        base = base.withColumn("__m", med.select("__m").scalar())
        base = base.withColumn("__ccb", err.select(F.avg(F.abs(F.col("coverage") - nominal))).scalar())
    ccb = F.when(F.col("n") < bins, F.abs(F.col("picp") - F.col("nominal"))).otherwise(F.col("__ccb"))
    return base.select(
        *by,
        "n",
        "picp",
        "mpiw",
        F.when(F.col("__r") > 0, F.col("mpiw") / F.col("__r")).alias("nmpiw"),
        ccb.alias("ccb"),
        "interval_score",
        F.col("__m")[0].alias("median_width"),
        "nominal",
    )


def composite_score(m: DataFrame) -> DataFrame:
    """Larger is better."""
    s = -F.col("interval_score") - 4.0 * F.abs(F.col("picp") - F.col("nominal")) - F.col("ccb") - 0.2 * F.col("nmpiw")
    return m.withColumn("composite_score", s)


def gcp_param_search(oof: DataFrame, params=PARAM_SETS, **kw) -> DataFrame:
    """Metrics and score of every parameter set from one neighbour search.

    The neighbours are found once for the largest k; smaller sets are prefixes of that list.
    """
    sets = [(name, a, neighbor_count(k), scale, bw) for name, a, k, scale, bw in params]
    every = lambda d, c: [gaussian_rows(d[:, :k], c[:, :k, 0], a, scale, bw) for _, a, k, scale, bw in sets]
    names = [f"q_{name}" for name, *_ in sets]
    nn = knn_reduce(oof, oof, max(p[2] for p in sets), every, doubles(*names), carry=["abs_residual"], **kw)
    rows = F.array(*[F.struct(F.lit(p[0]).alias("name"), F.lit(p[1]).alias("alpha"), F.col(q).alias("qhat")) for p, q in zip(sets, names)])
    long = nn.select("y_true", "pred", F.inline(rows))
    iv = write_and_read(prediction_intervals(long), "param-intervals")
    return composite_score(interval_metrics(iv, F.col("alpha"), by=["name"], few=True))


def local_qhat_idw(targets: DataFrame, calib: DataFrame, alpha: float = ALPHA, k: int = IDW_NEIGHBORS, **kw) -> DataFrame:
    """Distance-power weights, shrunk towards the global quantile and clamped around it."""
    glob = conformal_global_quantile(calib, alpha).select("q").scalar()

    def local(d, c):
        return [weighted_quantile_rows(c[:, :, 0], 1.0 / np.power(np.maximum(d, 1.0), IDW_POWER), 1.0 - alpha)]

    j = knn_reduce(targets, calib, k, local, doubles("__q"), carry=["abs_residual"], **kw).withColumn("__g", glob)
    g = F.col("__g")
    shrunk = F.lit(1.0 - IDW_SHRINK) * F.coalesce("__q", g) + F.lit(IDW_SHRINK) * g
    half = F.least(F.greatest(shrunk, g * F.lit(IDW_MIN_SCALE)), g * F.lit(IDW_MAX_SCALE))
    return j.withColumn("half_width", half).drop("__q", "__g")


# ---------------------------------------------------------------- area of applicability


def standardize_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """One row of mean and population deviation per feature; a zero deviation becomes 1."""
    aggs = []
    for f in features:
        aggs.append(F.avg(f).alias(f"{f}__mean"))
        sd = F.stddev_pop(f)
        aggs.append(F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias(f"{f}__std"))
    return df.agg(*aggs)


def feature_weights(features: list[str], importance: dict[str, float] | None) -> dict[str, float]:
    """Square root of importance over its mean; negative counts as 0; all ones when none is known."""
    w = {f: max(0.0, float((importance or {}).get(f, 0.0))) for f in features}
    total = sum(w.values())
    if total <= 0:
        return dict.fromkeys(features, 1.0)
    return {f: (v / (total / len(features))) ** 0.5 for f, v in w.items()}


def weighted_space(df: DataFrame, features: list[str], stats: DataFrame, weights: dict[str, float], out: str = "zw") -> DataFrame:
    """Standardised, weighted feature vector; a missing value sits at the training mean."""
    have = set(df.columns)
    s = df.withColumn("__st", stats.select(F.struct(*stats.columns)).scalar())
    z = [
        F.coalesce((F.col(f) - F.col("__st")[f"{f}__mean"]) / F.col("__st")[f"{f}__std"], F.lit(0.0)) * F.lit(weights[f])
        if f in have
        else F.lit(0.0)
        for f in features
    ]
    return s.withColumn(out, F.array(*z)).drop("__st")


def aoa_train_di(train: DataFrame, features: list[str], importance=None, id_col: str = "sample_id", **kw) -> DataFrame:
    """Distance to the nearest other training row over the mean positive distance."""
    stats = standardize_stats(train, features)
    zw = weighted_space(train, features, stats, feature_weights(features, importance))
    kw = {"target_coords": F.col("zw"), "item_coords": F.col("zw"), **kw}
    nn = nearest_distance(zw, zw, "nn_dist", item_id=id_col, self_id=id_col, **kw)
    nn = write_and_read(nn.select(id_col, "nn_dist"), "train-di")
    mean = nn.filter(F.col("nn_dist") > 0).select(F.coalesce(F.avg("nn_dist"), F.lit(1.0))).scalar()
    return nn.withColumn("mean_nn", mean).withColumn("di", F.coalesce(F.col("nn_dist"), F.lit(0.0)) / F.col("mean_nn"))


def aoa_threshold(di: DataFrame) -> DataFrame:
    """Largest DI that is no outlier (q3 + 1.5 IQR), else the 95th percentile."""
    q = exact_quantile_scalar(di, "di", [0.25, 0.75, AOA_OUTLIER_QUANTILE])
    t = di.withColumn("q", q).withColumn("cap", F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0]))
    return t.agg(F.coalesce(F.max(F.when(F.col("di") <= F.col("cap"), F.col("di"))), F.max(F.col("q")[2])).alias("threshold"))


def aoa_grid_di(cells: DataFrame, train: DataFrame, features: list[str], importance=None, id_col="sample_id", train_di=None, **kw) -> DataFrame:
    """Cell distance to the nearest training row in the training space, over the training mean."""
    have = [f for f in features if f in cells.columns]
    if len(have) < max(3, int(0.6 * len(features))):
        raise ValueError(f"only {len(have)} of {len(features)} features on the grid")
    stats = standardize_stats(train, features)
    w = feature_weights(features, importance)
    zt, zc = weighted_space(train, features, stats, w), weighted_space(cells, features, stats, w)
    nn = nearest_distance(zc, zt, "__nn", target_coords=F.col("zw"), item_coords=F.col("zw"), item_id=id_col, **kw)
    ref = train_di if train_di is not None else aoa_train_di(train, features, importance, id_col, **kw)
    mean = ref.agg(F.max("mean_nn")).scalar()
    return nn.withColumn("di", F.col("__nn") / mean).drop("__nn", "zw")


def coord_di(targets: DataFrame, samples: DataFrame, **kw) -> DataFrame:
    """Fallback by place: distance to the nearest sample over the mean positive distance."""
    nn = write_and_read(nearest_distance(targets, samples, "nn_dist", **kw), "coord-di")
    mean = nn.filter(F.col("nn_dist") > 0).select(F.coalesce(F.avg("nn_dist"), F.lit(1.0))).scalar()
    return nn.withColumn("di", F.col("nn_dist") / mean)


def risk_class(cells: DataFrame, width_quantile: float = WIDTH_QUANTILE) -> DataFrame:
    """1 narrow+inside, 2 wide+inside, 3 wide+outside, 4 narrow+outside."""
    thr = exact_quantile_scalar(cells, "interval_width", [width_quantile])
    wide = F.col("interval_width") > F.col("__t")[0]
    inside = F.col("inside") == 1
    cls = F.when(~wide & inside, 1).when(wide & inside, 2).when(wide & ~inside, 3).when(~wide & ~inside, 4)
    return cells.withColumn("__t", thr).withColumn("risk", cls).drop("__t")


def risk_class_counts(classed: DataFrame) -> DataFrame:
    """Cells and share per class."""
    c = classed.groupBy("risk").agg(F.count("*").alias("n_cells"))
    return c.withColumn("share", F.col("n_cells") / c.agg(F.sum("n_cells")).scalar())
