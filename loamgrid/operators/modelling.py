"""Random-forest trend, kriged residuals and their tuning."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators.aggregates import regression_metrics
from loamgrid.operators.forest import fit_forests, pack
from loamgrid.operators.kriging import fitted, krige_local
from loamgrid.operators.ordering import exact_quantiles
from loamgrid.operators.schema import unpivot
from loamgrid.operators.validation import group_split
from loamgrid.session import write_and_read

# The options whose combinations are tried, and the baselines that come first.
TREES = [500, 800]
DEPTHS_LARGE = [8, 14, 16, 0]
DEPTHS_SMALL = [6, 10, 14, 0]
LEAVES = [1, 2, 4, 6]
FEATURE_SHARES = ["sqrt", "0.5", "0.8", "1.0"]
VARIOGRAMS = ["spherical", "exponential", "gaussian", "linear"]
LAGS = [4, 6, 8, 10, 12]
NEAREST = [16, 32, 64]
CANDIDATES = 16
BASELINE_NEAREST = [16, 32]
RF_DEFAULT = {"trees": 500, "depth": 16, "leaf": 1, "split": 2, "share": "1.0"}
RF_BASELINE = {"trees": 1200, "depth": 16, "leaf": 1, "split": 2, "share": "1.0"}
AOI_WEIGHT = 3.0


def aoi_sample_weight(df: DataFrame, inside: Column, factor: float = AOI_WEIGHT) -> DataFrame:
    """3 inside the area, 1 outside; NULL for all when nobody is inside."""
    some = df.select(F.coalesce(F.bool_or(inside), F.lit(False))).scalar()
    return df.withColumn("weight", F.when(some, F.when(inside, F.lit(float(factor))).otherwise(F.lit(1.0))))


def sample_size_defaults(n: Column) -> Column:
    """Forest parameters by the number of samples; depth 0 means unlimited."""
    p = lambda t, d, l, s, f: F.struct(F.lit(t).alias("trees"), F.lit(d).alias("depth"), F.lit(l).alias("leaf"), F.lit(s).alias("split"), F.lit(f).alias("share"))
    return F.when(n < 30, p(400, 6, 4, 6, 0.6)).when(n < 80, p(600, 10, 3, 4, 0.7)).when(n < 200, p(800, 16, 2, 2, 0.8)).otherwise(p(1000, 0, 1, 2, 1.0))


def candidate_space(studies: DataFrame, by: str, n: str, count: int = CANDIDATES) -> DataFrame:
    """Parameter sets per study: the baselines, then a reproducible choice from all combinations.

    Combinations are numbered 0..15359 and decoded by arithmetic; per study the first ones in
    hash order are kept, so no product table is joined.
    """
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    sizes = [len(TREES), 4, len(LEAVES), len(FEATURE_SHARES), len(VARIOGRAMS), len(LAGS), len(NEAREST), 2]
    total = 1
    for s in sizes:
        total *= s
    e = studies.select(by, n, F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("i"))
    h = F.md5(F.concat(F.col(by).cast("string"), F.lit(":"), F.col("i").cast("string")))
    w = Window.partitionBy(by).orderBy(h)
    e = e.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= count - len(BASELINE_NEAREST))
    digits, rest = [], F.col("i")
    for s in sizes:
        digits.append(rest % s)
        rest = F.floor(rest / s)
    t, d, l, f, v, g, c, b = digits
    depth = F.when(F.col(n) >= 300, pick(DEPTHS_LARGE, d)).otherwise(pick(DEPTHS_SMALL, d))
    leaf = pick(LEAVES, l)
    cols = [by, "pos", "trees", "depth", "leaf", "split", "share", "variogram", "nlags", "nearest", "weighted"]
    out = e.select(
        by, (F.col("r") + len(BASELINE_NEAREST)).alias("pos"), pick(TREES, t).alias("trees"), depth.alias("depth"), leaf.alias("leaf"), F.greatest(F.lit(2), leaf * 2).alias("split"),
        pick(FEATURE_SHARES, f).alias("share"), pick(VARIOGRAMS, v).alias("variogram"), pick(LAGS, g).alias("nlags"), pick(NEAREST, c).alias("nearest"), (b == 1).alias("weighted"),
    )
    base = studies.select(by, F.posexplode(F.array(*[F.lit(x) for x in BASELINE_NEAREST])).alias("p", "nearest"))
    base = base.select(
        by, (F.col("p") + 1).alias("pos"), F.lit(1200).alias("trees"), F.lit(16).alias("depth"), F.lit(1).alias("leaf"), F.lit(2).alias("split"), F.lit("1.0").alias("share"),
        F.lit("spherical").alias("variogram"), F.lit(8).alias("nlags"), "nearest", F.lit(False).alias("weighted"),
    )
    return base.select(*cols).unionByName(out.select(*cols))


# ---------------------------------------------------------------- forest


def medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact median per feature (0 when it has no value): one row per column comes back."""
    q = exact_quantiles(unpivot(df, features), "value", [0.5], ["feature"], few=True).collect()
    found = {r["feature"]: r["q"][0] for r in q}
    return {f: float(found.get(f) or 0.0) for f in features}


def filled(features: list[str], fill: dict[str, float]) -> list[Column]:
    """The features as numbers; missing values are filled for this call only, the columns stay as they are."""
    return [F.coalesce(F.col(f).cast("double"), F.lit(fill[f])) for f in features]


class RfkModel:
    """A fitted trend, the training residuals as a table, and the variogram of the residuals."""

    def __init__(self, features, fill, forests, spec, residuals, vario, nearest):
        self.features, self.fill, self.forests, self.spec = features, fill, forests, spec
        self.residuals, self.vario, self.nearest = residuals, vario, nearest

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds trend, krig (0 when off) and pred = trend + krig."""
        t = self.forests.predict(df, filled(self.features, self.fill), self.spec)
        return add_krig(t, self.residuals, self.vario, self.nearest)

    def importance(self) -> DataFrame:
        names = F.array(*[F.lit(f) for f in self.features])
        return self.forests.importances().where(F.col("spec") == self.spec).select(F.get(names, F.col("feature").cast("int")).alias("feature"), "importance")


def add_krig(df: DataFrame, residuals: DataFrame, vario: dict | None, nearest: int) -> DataFrame:
    """Adds krig (0 when off) and pred = trend + krig."""
    if vario is None:
        return df.withColumn("krig", F.lit(0.0)).withColumn("pred", F.col("trend"))
    k = krige_local(df, residuals, vario, nearest, item_id="id").drop("krig_var", "fallback")
    return k.withColumn("krig", F.coalesce("krig", F.lit(0.0))).withColumn("pred", F.col("trend") + F.col("krig"))


def residual_variogram(res: DataFrame, krig: dict | None) -> dict | None:
    """The fitted variogram of residuals (id, x, y, z); none for constant ones or under 8 points."""
    if not krig:
        return None
    s = res.agg(F.count("*").alias("n"), F.stddev_pop("z").alias("sd")).first()
    if s["n"] < 8 or s["sd"] < 1e-9:
        return None
    return fitted(res, krig.get("model", "spherical"), krig.get("nlags", 6), krig.get("weighted", False))


def fit_rfk(df: DataFrame, target: str, features: list[str], rf: dict = RF_DEFAULT, krig: dict | None = None, id_col: str = "sample_id", weight: str | None = None) -> RfkModel:
    """Forest on all rows, then a variogram on its residuals; kriging is off for constant residuals or under 8 points."""
    fill = medians(df, features)
    cols = filled(features, fill)
    rows = pack(df, F.col(id_col), F.col(target), cols, F.col(weight) if weight else None)
    forests = fit_forests(rows, len(features), [rf])
    res = forests.predict(df.filter(F.col(target).isNotNull()), cols).select(F.col(id_col).cast("long").alias("id"), "x", "y", (F.col(target) - F.col("trend")).alias("z"))
    res = write_and_read(res.dropna(), "residuals")
    return RfkModel(features, fill, forests, 0, res, residual_variogram(res, krig), (krig or {}).get("nearest", 16))


def holdouts(df: DataFrame, group: str, seeds: list[int], share: float = 0.3) -> DataFrame:
    """``df`` with ``__test``: bit ``f`` is set for test rows of the split of the ``f``-th seed. NULL is a group."""
    bits = F.sum(F.when(F.col("role") == "test", F.element_at(F.create_map(*[F.lit(v) for i, s in enumerate(seeds) for v in (s, 1 << i)]), F.col("seed"))).otherwise(0))
    roles = group_split(df, group, seeds, share).groupBy(F.col(group).alias("__g")).agg(bits.cast("long").alias("__test"))
    return df.join(roles, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def folds(df: DataFrame, fold: Column) -> DataFrame:
    """``df`` with ``__test`` for folds numbered from 0: each row is a test row once."""
    return df.withColumn("__test", F.pow(F.lit(2.0), fold).cast("long"))


def score_folds(df: DataFrame, target: str, features: list[str], labels: list, rfs: list[dict], weight: str | None = None, id_col: str = "sample_id", held: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores, rows) of every parameter set on every fold of ``__test``, all forests grown together.

    Scores have key, candidate, fold (its place in ``labels``), trend and ``held``: whether the row is a test row there;
    with the argument ``held`` test rows only.
    Missing values are filled with medians of the whole table, as tables are prepared before they are split.
    """
    rows = write_and_read(df.where(F.col(target).isNotNull()), "folds")
    cols = filled(features, medians(rows, features))
    specs = [{**rf, "fold": f} for rf in rfs for f in range(len(labels))]
    forests = fit_forests(pack(rows, F.col(id_col), F.col(target), cols, F.col(weight) if weight else None, F.col("__test")), len(features), specs)
    got = forests.scores(rows, F.col(id_col), cols, F.col("__test"), held)
    k = F.lit(len(labels))
    return write_and_read(got.select("key", F.floor(F.col("spec") / k).cast("int").alias("candidate"), (F.col("spec") % k).cast("int").alias("fold"), "trend", "held"), "scores"), rows


def predict_folds(df: DataFrame, target: str, features: list[str], labels: list, rf: dict, krig: dict | None = None, weight: str | None = None, id_col: str = "sample_id", threads: int = 4) -> DataFrame:
    """Test predictions of every fold of ``__test``: id, x, y, y_true, trend, krig, pred, fold (its label). Forests of
    all folds are one set of jobs; kriging of a fold sees the residuals of its own train rows only, without it these get
    no trend."""
    scores, rows = score_folds(df, target, features, labels, [rf], weight, id_col, held=not krig)
    return _with_krig(scores, rows, target, labels, krig, id_col, threads)


def _with_krig(scores: DataFrame, rows: DataFrame, target: str, labels: list, krig: dict | None, id_col: str, threads: int) -> DataFrame:
    at = rows.select(F.col(id_col), F.col(id_col).cast("long").alias("key"), "x", "y", F.col(target).alias("y_true"))
    got = scores.join(at, "key")
    name = F.get(F.array(*[F.lit(v) for v in labels]), F.col("fold"))
    out = [id_col, "x", "y", "y_true", "trend", "krig", "pred"]
    if not krig:
        return write_and_read(add_krig(got.where("held"), None, None, 0).select(*out, name.alias("fold")), "cv")

    def one(f: int) -> DataFrame:
        mine = got.where(F.col("fold") == f)
        res = write_and_read(mine.where("not held").select(F.col("key").alias("id"), "x", "y", (F.col("y_true") - F.col("trend")).alias("z")).dropna(), "residuals")
        return add_krig(mine.where("held"), res, residual_variogram(res, krig), krig.get("nearest", 16)).select(*out, F.lit(labels[f]).alias("fold"))

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(one), range(len(labels))))
    return write_and_read(reduce(DataFrame.unionByName, parts), "cv")


def run_split(split: DataFrame, target: str, features: list[str], rf: dict, krig: dict | None, id_col: str = "sample_id") -> DataFrame:
    """Fit on the train rows of one split (``role``) and predict its test rows."""
    marked = split.withColumn("__test", F.when(F.col("role") == "test", 1).otherwise(0).cast("long"))
    return predict_folds(marked, target, features, [0], rf, krig, id_col=id_col).drop("fold")


def cross_validate(df: DataFrame, target: str, features: list[str], group: str, seeds: list[int], rf: dict, krig: dict | None = None, id_col: str = "sample_id", weight: str | None = None) -> DataFrame:
    """Test predictions of a spatial holdout per seed."""
    return predict_folds(holdouts(df, group, seeds), target, features, seeds, rf, krig, weight, id_col)


def oof_table(preds: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """One row per sample from its test predictions of all folds."""
    a = preds.groupBy(id_col).agg(F.count("*").alias("folds"), F.min("fold").alias("first_fold"), F.avg("pred").alias("pred"), F.first("y_true").alias("y_true"), F.first("x").alias("x"), F.first("y").alias("y"))
    return a.withColumn("abs_residual", F.abs(F.col("y_true") - F.col("pred")))


def candidates(study: DataFrame, n: str, count: int = CANDIDATES, locks: dict | None = None) -> list[dict]:
    """The parameter sets of ``candidate_space`` for one study (a row with its number of samples), without repeats once
    the locked parameters have their fixed values."""
    rows = candidate_space(study.select(F.lit(0).alias("study"), n), "study", n, count).orderBy("pos").collect()  # ``count`` rows
    out = []
    for r in rows:
        p = {**r.asDict(), **(locks or {})}
        one = {"rf": {k: p[k] for k in ("trees", "depth", "leaf", "split", "share")}, "krig": {"model": p["variogram"], "nlags": p["nlags"], "nearest": p["nearest"], "weighted": p["weighted"]}}
        if one not in out:
            out.append(one)
    return out


def tune(df: DataFrame, target: str, features: list[str], group: str, candidates: list[dict], seeds: list[int], finalists: int | None = None, goal_r2: float | None = None, wave: int = CANDIDATES, weight: str | None = None, id_col: str = "sample_id") -> DataFrame:
    """One row of pooled metrics per candidate over the same spatial splits; best marks the winner.

    The forests of a wave of candidates on all splits are one set of jobs; candidates with the same forest share it. The best
    ``finalists`` by their trends (all where none is given) that ask for kriging get it. No further wave begins once one
    reaches ``goal_r2``.
    """
    spark, rows = df.sparkSession, []
    marked = write_and_read(holdouts(df, group, seeds), "holdouts")
    rank = lambda r: (r[4], -(r[3] if r[3] is not None else float("-inf")), r[0])
    for lo in range(0, len(candidates), wave):
        part = candidates[lo : lo + wave]
        rfs = [c["rf"] for i, c in enumerate(part) if c["rf"] not in [p["rf"] for p in part[:i]]]
        forest = [rfs.index(c["rf"]) for c in part]
        scores, base = score_folds(marked, target, features, seeds, rfs, weight, id_col)
        truth = base.select(F.col(id_col).cast("long").alias("key"), F.col(target).alias("y_true"))
        found = {r["candidate"]: r for r in regression_metrics(scores.where("held").join(truth, "key"), p="trend", by=["candidate"]).collect()}  # a row for each forest
        now = [(lo + i, str(c), r["n"], r["r2"], r["rmse"], r["mae"], r["bias"], False) for i, c in enumerate(part) if (r := found.get(forest[i]))]
        for row in sorted(now, key=rank)[: finalists if finalists is not None else len(now)]:
            krig = candidates[row[0]].get("krig")
            if krig:
                cv = _with_krig(scores.where(F.col("candidate") == forest[row[0] - lo]), base, target, seeds, krig, id_col, 4)
                m = regression_metrics(cv).first()
                now[now.index(row)] = (row[0], row[1], m["n"], m["r2"], m["rmse"], m["mae"], m["bias"], True)
        rows += now
        if goal_r2 is not None and any(r[3] is not None and r[3] >= goal_r2 for r in now):
            break
    best = min(rows, key=rank)[0] if rows else None
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "candidate int, params string, n long, r2 double, rmse double, mae double, bias double, kriged boolean, best boolean")


def rank_features(df: DataFrame, target: str, features: list[str], topk: int, rf: dict) -> DataFrame:
    """Features by pilot importance; at least six are kept."""
    m = fit_rfk(df, target, features, rf)
    k = min(max(6, topk), len(features))
    return m.importance().orderBy(F.desc("importance"), "feature").limit(k)


def predict_grid(model: RfkModel, cells: DataFrame, mask: Column | None = None, nodata: float = -9999.0) -> DataFrame:
    """Prediction for every cell with all features (inside the mask); nodata elsewhere."""
    ok = F.lit(True)
    for f in model.features:
        ok = ok & F.col(f).isNotNull()
    valid = (ok & F.coalesce(mask, F.lit(False))) if mask is not None else ok
    p = model.predict(cells.filter(valid)).select("row", "col", "pred")
    return cells.select("row", "col", "x", "y").join(p, ["row", "col"], "left").withColumn("pred", F.coalesce("pred", F.lit(nodata)))
