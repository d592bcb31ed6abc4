"""Descriptive statistics: counts, quantiles, shapes, outliers, correlations."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions import text as T
from rookery.functions.similarity import jaccard_or_zero
from rookery.operators.running import running

DF_BUCKETS = [(1, 1), (2, 10), (11, 100), (101, 1000), (1001, 10000), (10001, 100000), (100001, 10**9)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def completeness(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows, distinct keys, repeated keys and blank values of each column, in one pass over counts by key."""
    blank = [F.sum(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", 1).otherwise(0)).alias(f"blank_{c}") for c in columns]
    by_key = df.groupBy(key).agg(F.count("*").alias("n"), *blank)
    return by_key.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("n_repeated"), *(F.sum(f"blank_{c}").alias(f"blank_{c}") for c in columns))


def top_values(df: DataFrame, column: str | Column, n: int) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    return df.groupBy(c.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def nearest_quantiles(df: DataFrame, value: Column, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, p, v): the value at place int(m * p) of the sorted values, of each group.

    Works on counts of distinct values, dealt by ranges.
    """
    by = by or []
    counts = df.select(*by, value.alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n"))
    ranked = running(counts, ["v"], ["n"], by)
    m = ranked.groupBy(*by).agg(F.sum("n").alias("m"))
    ranked = ranked.join(m, by) if by else ranked.join(F.broadcast(m))  # one row
    each = ranked.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ps))))
    place = F.least(F.floor(F.col("m") * F.col("p")), F.col("m") - 1)
    return each.where((place < F.col("n_upto")) & (place >= F.col("n_upto") - F.col("n"))).select(*by, "p", "v")


def repeated_groups(df: DataFrame, value: Column) -> DataFrame:
    """Rows in groups of equal values: n_rows, n_values, n_ambiguous_rows, n_ambiguous_values."""
    g = df.groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    return g.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_values"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("n_ambiguous_rows"), F.count(F.when(many, 1)).alias("n_ambiguous_values"))


def document_frequency(df: DataFrame, terms: Column) -> DataFrame:
    """(term, df): in how many rows a term occurs."""
    return df.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def df_buckets(frequencies: DataFrame) -> DataFrame:
    """(lo, hi, n_terms) over fixed ranges of document frequency; empty ranges are left out."""
    case = None
    for lo, hi in DF_BUCKETS:
        s = F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
        hit = F.col("df").between(lo, hi)
        case = F.when(hit, s) if case is None else case.when(hit, s)
    return frequencies.groupBy(case.alias("b")).agg(F.count("*").alias("n_terms")).select("b.lo", "b.hi", "n_terms")


def describe(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """count, mean, spread, quartiles, range per column.

    Exact quartiles keep a count per distinct value; for columns with very many
    use ``exact=False``, which bounds memory by accuracy instead.
    """
    quart = (lambda c, p: F.percentile(c, p)) if exact else (lambda c, p: F.percentile_approx(c, p, 10000).cast("double"))

    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column_name"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"), F.min(x).alias("min"),
            quart(x, 0.25).alias("q1"), quart(x, 0.5).alias("median"), quart(x, 0.75).alias("q3"), F.max(x).alias("max"),
        )

    rows = df.agg(F.array(*(one(c) for c in columns)).alias("a")).select(F.inline("a"))
    return rows.withColumns({"iqr": F.col("q3") - F.col("q1"), "spread": F.col("max") - F.col("min")})


def shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population and bias-corrected skewness and excess kurtosis per column."""

    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column_name"), F.count(x).cast("double").alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))

    rows = df.agg(F.array(*(one(c) for c in columns)).alias("a")).select(F.inline("a"))
    n, g, k = F.col("n"), F.col("skew"), F.col("kurt")
    corrected = F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))
    corrected_k = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6))
    label = F.when(F.abs(corrected) < 0.5, "symmetric").when(corrected > 0, "right").otherwise("left")
    return rows.select("column_name", g.alias("skew_population"), k.alias("kurtosis_population"), corrected.alias("skew"), corrected_k.alias("kurtosis"), label.alias("shape"))


def outliers(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Values outside 1.5 interquartile ranges, and beyond 3 standard deviations, per column."""
    d = describe(df, columns, exact).select("column_name", "q1", "q3", "iqr", "mean", "std")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select("s.*")
    j = long.join(F.broadcast(d), "column_name")  # one row per column
    far = (F.col("x") < F.col("q1") - 1.5 * F.col("iqr")) | (F.col("x") > F.col("q3") + 1.5 * F.col("iqr"))
    z = F.abs(F.col("x") - F.col("mean")) > 3 * F.col("std")
    return j.groupBy("column_name").agg(F.count(F.when(far, 1)).alias("n_iqr"), F.count(F.when(z, 1)).alias("n_z"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, in one pass."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for a, b in combinations(columns, 2)]
    return df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))


def constant_columns(df: DataFrame, columns: list[str], near: float = 0.95) -> DataFrame:
    """Distinct values and largest share of each column; constant, or nearly, where one value has over ``near``."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns))).alias("s")).select("s.*")
    g = long.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    out = g.groupBy("column_name").agg(F.count("v").alias("n_distinct"), (F.max("n") / F.sum("n")).alias("top_share"))
    return out.withColumns({"constant": F.col("n_distinct") <= 1, "near_constant": F.col("top_share") > near})


def class_means(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Mean of each column where the label is 1 and 0, and their distance."""

    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column_name"), F.avg(F.when(F.col(label) == 1, x)).alias("mean_1"), F.avg(F.when(F.col(label) == 0, x)).alias("mean_0"))

    return df.agg(F.array(*(one(c) for c in columns)).alias("a")).select(F.inline("a")).withColumn("separation", F.col("mean_1") - F.col("mean_0"))


def rate_by(df: DataFrame, category: str, label: str) -> DataFrame:
    return df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) over equal bins of [lo, hi]; values outside go to bins 0 and bins + 1."""
    return df.groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def box(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """What a box plot shows of each column: quartiles, whiskers (the last values within 1.5 interquartile ranges), values outside."""
    d = describe(df, columns, exact).select("column_name", "q1", "median", "q3", "iqr")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select("s.*")
    j = long.join(F.broadcast(d), "column_name")  # one row per column
    near = (F.col("x") >= F.col("q1") - 1.5 * F.col("iqr")) & (F.col("x") <= F.col("q3") + 1.5 * F.col("iqr"))
    return j.groupBy("column_name", "q1", "median", "q3").agg(F.min(F.when(near, F.col("x"))).alias("low"), F.max(F.when(near, F.col("x"))).alias("high"), F.count(F.when(~near, 1)).alias("n_outside"))


def density(df: DataFrame, column: str, lo: float, hi: float, points: int, width: float) -> DataFrame:
    """(x, density): a Gaussian kernel estimate at ``points`` places from ``lo`` to ``hi``.

    Equal values are counted first; each count is then spread over the fixed grid.
    """
    counts = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count("*").alias("n"))
    step = (hi - lo) / (points - 1)
    grid = [lo + i * step for i in range(points)]
    kernel = lambda x: F.sum(F.col("n") * F.exp(-0.5 * ((F.lit(x) - F.col("v")) / width) ** 2))
    sums = counts.agg(F.sum("n").alias("m"), F.array(*map(kernel, grid)).alias("k"))
    at = sums.select("m", F.posexplode("k").alias("i", "k"))
    return at.select((F.lit(lo) + F.col("i") * step).alias("x"), (F.col("k") / (F.col("m") * width * (2 * 3.141592653589793) ** 0.5)).alias("density"))


#: Named checks of a record's name and address.
CHECKS = {
    "name_len_lt_3": lambda n, a: F.char_length(F.trim(n)) < 3,
    "name_is_url": lambda n, a: F.lower(F.trim(n)).rlike(r"(https?://|www\.|\.com$|\.in$)"),
    "name_leading_punct": lambda n, a: n.rlike(r"^[-.,/#&*]") | (n == ""),
    "name_all_digits": lambda n, a: F.trim(n).rlike(r"^\p{Nd}+$"),
    "addr_no_alnum": lambda n, a: (F.trim(a) != "") & ~a.rlike(r"[A-Za-z0-9\x{0900}-\x{097F}]"),
    "control_chars": lambda n, a: n.rlike(r"[\x00-\x08\x0B-\x1F]") | a.rlike(r"[\x00-\x08\x0B-\x1F]"),
    "name_has_tab_escape": lambda n, a: n.contains("\\t") | a.contains("\\t"),
}


def validity(records: DataFrame) -> DataFrame:
    """(check, n, pct): how many records (name, address) fail each named check, in one pass; an empty name counts as led by a mark."""
    n, a = T.text("name"), T.text("address")
    rows = [F.struct(F.lit(k).alias("check"), F.count(F.when(f(n, a), 1)).alias("n"), F.count("*").alias("m")) for k, f in CHECKS.items()]
    return records.agg(F.array(*rows).alias("r")).select(F.inline("r")).select("check", "n", F.when(F.col("m") > 0, F.round(100 * F.col("n") / F.col("m"), 4)).alias("pct"))


def pair_similarity(pairs: DataFrame, ps: tuple[float, ...] = (0.10, 0.25, 0.50, 0.75, 0.90)) -> DataFrame:
    """(measure, p, v) and the mean as p = null, over pairs with structs x and y (tokens, grams, addr): how alike true pairs are.

    Two empty sets count as 0 alike; pairs without the second address are left out of its measure.
    """
    made = {"name_tokens": jaccard_or_zero(F.col("x.tokens"), F.col("y.tokens")), "name_grams": jaccard_or_zero(F.col("x.grams"), F.col("y.grams")), "addr_tokens": F.when(F.size("y.addr") > 0, jaccard_or_zero(F.col("x.addr"), F.col("y.addr")))}
    long = pairs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in made.items()))).alias("s")).select("s.*").where("v is not null")
    mean = long.groupBy("measure").agg(F.lit(None).cast("double").alias("p"), F.avg("v").alias("v"))
    return nearest_quantiles(long, F.col("v"), list(ps), ["measure"]).unionByName(mean)


def source_mix(truth: DataFrame) -> DataFrame:
    """(source, n): from which sources the true partners come."""
    return truth.groupBy(F.substring("cand_id", 1, 2).alias("source")).agg(F.count("*").alias("n"))


def source_patterns(truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(pattern, n): in which sources entities have partners, ``none`` where they have none."""
    own = truth.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set(F.substring("cand_id", 1, 2))), "").alias("p"))
    return entities.select("s1_id").join(own, "s1_id", "left").groupBy(F.coalesce("p", F.lit("none")).alias("pattern")).agg(F.count("*").alias("n"))


def match_counts(truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(n_matches, n_entities): how many partners entities have, none included."""
    n = truth.groupBy("s1_id").agg(F.count("*").alias("k"))
    return entities.select("s1_id").join(n, "s1_id", "left").groupBy(F.coalesce("k", F.lit(0)).alias("n_matches")).agg(F.count("*").alias("n_entities"))


def partition_check(truth: DataFrame) -> DataFrame:
    """Slots, distinct candidates, and candidates with more than one owner."""
    g = truth.groupBy("cand_id").agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_slots"), F.count("*").alias("n_candidates"), F.count(F.when(F.col("n") > 1, 1)).alias("n_shared"))


def pair_structure(pairs: DataFrame) -> DataFrame:
    """Structure of labelled pairs with columns x and y (structs of name, norm, tokens, grams, address tokens, country)."""
    s = lambda c: F.count(F.when(c, 1))
    shared = F.size(F.array_intersect("x.tokens", "y.tokens"))
    addr = F.size(F.array_intersect("x.addr", "y.addr")) / F.greatest(F.size(F.array_union("x.addr", "y.addr")), F.lit(1))
    return pairs.agg(
        F.count("*").alias("n_pairs"),
        s(F.col("x.norm") == F.col("y.norm")).alias("n_exact"),
        s(shared > 0).alias("n_shared_token"),
        s(F.size(F.array_intersect("x.grams", "y.grams")) >= 2).alias("n_two_grams"),
        s((shared == 0) & (addr > 0.2)).alias("n_address_only"),
        s(F.col("x.country") != F.col("y.country")).alias("n_cross_country"),
        s((F.size("x.addr") == 0) | (F.size("y.addr") == 0)).alias("n_empty_address"),
        s(T.has_devanagari(F.col("y.norm")) & ~T.has_devanagari(F.col("x.norm"))).alias("n_cross_script"),
    )
