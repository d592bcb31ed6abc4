"""Health of features and scores: AUC, KS, average precision, thresholds, shifts, leaks.

Ranks over a whole table come from running sums over ranges of the order, so that no
window holds all rows and no value, however frequent, is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.operators.running import running


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _auc(rank: Column, y: Column, least: int, among: Column) -> tuple[Column, Column]:
    """(rows, AUC) of the rows ``among``, from their ranks."""
    count = lambda c: F.count(F.when(among & c, 1)).cast("double")
    n, n1, n0 = F.count(F.when(among, 1)), count(y == 1), count(y == 0)
    auc = (F.sum(F.when(among & (y == 1), rank)) - n1 * (n1 + 1) / 2) / (n1 * n0)
    return n, F.when((n >= least) & (n1 > 0) & (n0 > 0), auc)


def ordinal_auc(df: DataFrame, x: Column, y: Column, place: Column, least: int = 10) -> DataFrame:
    """One row: AUC with ties ranked in the order of ``place``, null below ``least`` values or with one class."""
    base = df.select(x.cast("double").alias("x"), y.alias("y"), place.alias("place"), F.lit(1).alias("n")).where(_finite(F.col("x")))
    n, auc = _auc(F.col("n_upto"), F.col("y"), least, F.lit(True))
    return running(base, ["x", "place"], ["n"]).agg(n.alias("n"), auc.alias("auc"))


def _ks(df: DataFrame, by: list[str]) -> DataFrame:
    """The largest distance of two classes' distribution functions, from (by, x, y)."""
    base = df.where(_finite(F.col("x")))
    counts = base.groupBy(*by, "x").agg(F.count(F.when(F.col("y") == 1, 1)).alias("n1"), F.count(F.when(F.col("y") == 0, 1)).alias("n0"))
    c = running(counts, ["x"], ["n1", "n0"], by)
    total = c.groupBy(*by).agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    c = c.join(total, by) if by else c.join(F.broadcast(total))  # one row
    gap = F.when((F.col("t1") > 0) & (F.col("t0") > 0), F.abs(F.col("n1_upto") / F.col("t1") - F.col("n0_upto") / F.col("t0")))
    return c.groupBy(*by).agg(F.max(gap).alias("ks"))


def ks_statistic(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: the largest distance of the two classes' distribution functions."""
    return _ks(df.select(x.cast("double").alias("x"), y.alias("y")), [])


def average_precision(df: DataFrame, x: Column, y: Column, place: Column) -> DataFrame:
    """One row: average precision by descending score, ties in the order of ``place``."""
    base = df.select(x.cast("double").alias("x"), y.alias("y"), place.alias("place"), F.lit(1).alias("n"), F.when(y == 1, 1).otherwise(0).alias("hit"))
    r = running(base, [F.desc("x"), F.asc("place")], ["n", "hit"])
    n1 = F.sum("hit")
    return r.agg(F.when(n1 > 0, F.sum(F.when(F.col("hit") == 1, F.col("hit_upto") / F.col("n_upto"))) / n1).alias("pr_auc"))


def threshold_sweep(df: DataFrame, x: Column, y: Column, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f05) in one pass."""
    base = df.select(x.cast("double").alias("x"), y.alias("y"))
    n = lambda c: F.count(F.when(c, 1))
    up, pos = (lambda t: F.col("x") >= t), F.col("y") == 1
    rows = [F.struct(F.lit(float(t)).alias("threshold"), n(up(t) & pos).alias("tp"), n(up(t) & ~pos).alias("fp"), n(~up(t) & pos).alias("fn"), n(~up(t) & ~pos).alias("tn")) for t in thresholds]
    out = base.agg(F.array(*rows).alias("a")).select(F.inline("a"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    safe = lambda c, d: F.when(d > 0, c).otherwise(0.0)
    out = out.withColumns({"precision": safe(p, F.col("tp") + F.col("fp")), "recall": safe(r, F.col("tp") + F.col("fn"))})
    return out.withColumn("f05", safe(1.25 * F.col("precision") * F.col("recall") / (0.25 * F.col("precision") + F.col("recall")), F.col("tp")))


def distribution_shift(a: DataFrame, b: DataFrame, columns: list[str], most: float = 0.15, least: int = 20) -> DataFrame:
    """(column_name, shift, shifted): the largest gap of five quantiles over the joint spread; columns with under ``least`` values are left out."""
    ps = [0.10, 0.25, 0.50, 0.75, 0.90]
    long = lambda df, s: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select("s.*", F.lit(s).alias("split")).where("x is not null and not isnan(x)")
    both = long(a, 0).unionByName(long(b, 1))
    side = lambda s: F.percentile(F.when(F.col("split") == s, F.col("x")), F.array(*map(F.lit, ps)))
    n = lambda s: F.count(F.when(F.col("split") == s, 1))
    g = both.groupBy("column_name").agg(side(0).alias("pa"), side(1).alias("pb"), n(0).alias("na"), n(1).alias("nb"), F.greatest(F.stddev_pop("x"), F.lit(1e-9)).alias("sd")).where((F.col("na") >= least) & (F.col("nb") >= least))
    shift = F.array_max(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y))) / F.col("sd")
    return g.select("column_name", shift.alias("shift"), (shift > most).alias("shifted"))


def feature_report(df: DataFrame, columns: list[str], label: str, place: str, hard: Column | None = None, least: int = 10) -> DataFrame:
    """Per feature: variance, share undefined, AUC, KS, whether constant, and AUC among hard rows.

    All features go through the same few passes, as rows of one long table.
    """
    is_hard = F.coalesce(hard, F.lit(False)).cast("int") if hard is not None else F.lit(0)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns)))
    long = df.select(each.alias("s"), F.col(label).alias("y"), F.col(place).alias("place"), is_hard.alias("hard"), F.lit(1).alias("n")).select("s.feature", "s.x", "y", "place", "hard", "n")
    head = long.groupBy("feature").agg(F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("variance"), (1 - F.count("x") / F.greatest(F.count("*"), F.lit(1))).alias("share_null"), (F.coalesce(F.max("x") - F.min("x"), F.lit(0.0)) == 0).alias("constant"))
    r = running(long.where(_finite(F.col("x"))), ["x", "place"], ["n", "hard"], ["feature"])
    aucs = [_auc(F.col("n_upto"), F.col("y"), least, F.lit(True))[1].alias("auc")]
    if hard is not None:
        aucs.append(_auc(F.col("hard_upto"), F.col("y"), least, F.col("hard") == 1)[1].alias("auc_hard"))
    ranked = r.groupBy("feature").agg(*aucs)
    out = head.join(ranked, "feature", "left").join(_ks(long.select("feature", "x", "y"), ["feature"]), "feature", "left")
    return out.select("feature", "variance", "share_null", "constant", "auc", "ks", *(["auc_hard"] if hard is not None else []))


def leak_suspects(report: DataFrame, high: float = 0.95, low: float = 0.05) -> DataFrame:
    """Features whose AUC alone is too good to be true."""
    return report.where((F.col("auc") > high) | (F.col("auc") < low)).select("feature", "auc")
