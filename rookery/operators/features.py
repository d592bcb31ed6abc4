"""The 77 pair features: base, extra, group-relative, reciprocal, in that order.

Per-record text is derived once; a pair is then one ``select`` over arrays, with
the string ratios as Arrow functions.  Undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions import similarity as S
from rookery.functions import text as T
from rookery.operators.windows import group_features, reciprocal_features
from rookery.plans.durable import materialize

HIGH = 0.85

# The columns in order.
BASE = (
    "retrieval_score name_exact name_core_exact first_token_exact last_token_exact addr_exact addr_numeric_set_exact name_digits_equal name_digits_conflict name_has_digits_both "
    "name_token_jaccard name_token_dice name_contain_fwd name_contain_rev shared_token_count idf_weighted_overlap max_idf_shared name_ngram_jaccard name_ngram_contain "
    "name_len_diff name_len_ratio token_count_diff token_count_ratio addr_token_jaccard addr_ngram_jaccard addr_numeric_jaccard name_token_sort_ratio name_token_set_ratio name_ratio "
    "script_match is_cross_script addr_missing_either addr_missing_both name_missing_either n_fields_comparable "
    "both_high name_high_addr_low name_low_addr_high sim_disagreement min_field_sim mean_field_sim"
).split()
EXTRA = (
    "is_domain_l is_domain_r is_domain_either eff_name_ratio eff_name_token_set_ratio eff_token_jaccard eff_token_contain_fwd eff_token_contain_rev "
    "translit_ratio translit_token_set_ratio translit_token_jaccard translit_token_contain addr_contain_fwd addr_contain_rev addr_dice addr_last_exact "
    "addr_first_num_equal addr_first_num_conflict addr_token_count_ratio addr_idf_overlap addr_max_idf_shared cand_is_S2"
).split()
GROUP = "rank_in_group is_top1 score_margin_to_2nd score_ratio_to_max score_minus_group_mean z_score_in_group group_size score_gap_below frac_above".split()
RECIPROCAL = "rank_reverse is_mutual_best n_competitors_for_cand cand_best_score cand_score_margin".split()
COLUMNS = [*BASE, *EXTRA, *GROUP, *RECIPROCAL]
FUZZY = [c for c in COLUMNS if c.endswith("_ratio") and any(k in c for k in ("name_ratio", "sort", "set", "translit"))]


def prepare(records: DataFrame, unicode: bool = True) -> DataFrame:
    """(id, rec): per-record text as one struct."""
    norm = T.normalize if unicode else T.normalize_native
    df = records.withColumns({"norm": norm("name"), "addr": norm("address"), "stem": T.domain_stem("name")})
    core = T.core_tokens(F.col("norm"))
    df = df.withColumn("core", core)
    core_name = F.array_join("core", " ")
    df = df.withColumn("eff", F.when(F.col("stem") != "", F.col("stem")).otherwise(core_name))
    tr = F.when(T.has_devanagari(F.col("name")), norm(T.transliterate("name"))).otherwise(F.col("norm")) if unicode else F.col("norm")
    df = df.withColumn("tr", tr)
    script = T.dominant_script("norm") if unicode else F.when(F.col("norm").rlike(r"\p{L}"), "LATIN").otherwise("NONE")
    rec = F.struct(
        "norm", "addr", "stem", "eff", "tr", "source",
        core_name.alias("core_name"),
        F.array_distinct("core").alias("tokens"),
        T.ngrams(F.col("norm")).alias("grams"),
        T.tokens(F.col("norm")).alias("all"),
        F.array_distinct(T.tokens(F.col("addr"))).alias("addr_tokens"),
        T.tokens(F.col("addr")).alias("addr_all"),
        T.ngrams(F.col("addr")).alias("addr_grams"),
        F.array_sort(F.array_distinct(T.digit_runs(F.col("addr")))).alias("addr_nums"),
        T.digit_runs(F.col("addr")).alias("addr_digits"),
        F.array_sort(F.array_distinct(T.digit_runs(F.col("norm")))).alias("name_nums"),
        F.array_distinct(T.tokens(F.col("eff"))).alias("eff_tokens"),
        F.array_distinct(T.core_tokens(F.col("tr"))).alias("tr_tokens"),
        script.alias("script"),
    )
    return df.select(F.col("entity_id").alias("id"), rec.alias("rec"))


def idf(prepared: DataFrame, field: str) -> DataFrame:
    """(token, idf): ln((n + 1) / (df + 1)) + 1 over the records in play."""
    n = prepared.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    df = prepared.select(F.explode(F.col(f"rec.{field}")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def idf_overlap(pairs: DataFrame, weights: DataFrame, x: Column, y: Column, total: str, most: str) -> DataFrame:
    """Sum and maximum of the IDF of shared tokens, 0 without any; joins only the shared tokens."""
    shared = pairs.select("s1_id", "cand_id", F.explode(F.array_intersect(x, y)).alias("token"))
    sums = shared.join(weights, "token").groupBy("s1_id", "cand_id").agg(F.sum("idf").alias(total), F.max("idf").alias(most))
    return pairs.join(sums, ["s1_id", "cand_id"], "left").fillna(0.0, [total, most])


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def with_records(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """``pairs`` (s1_id, cand_id, score) with structs l and r; pairs with an unknown id fall out."""
    left = prepared.select(F.col("id").alias("s1_id"), F.col("rec").alias("l"))
    right = prepared.select(F.col("id").alias("cand_id"), F.col("rec").alias("r"))
    return pairs.join(left, "s1_id").join(right, "cand_id")


def cross_features(ns: Column, as_: Column) -> dict[str, Column]:
    """Of the similarities of names and of addresses."""
    return {
        "both_high": _flag((ns > HIGH) & (as_ > HIGH)),
        "name_high_addr_low": _flag((ns > HIGH) & (as_ <= HIGH)),
        "name_low_addr_high": _flag((ns <= HIGH) & (as_ > HIGH)),
        "sim_disagreement": F.abs(ns - as_),
        "min_field_sim": F.least(ns, as_),
        "mean_field_sim": (ns + as_) / 2,
    }


def base_features() -> dict[str, Column]:
    l, r = (lambda f: F.col(f"l.{f}")), (lambda f: F.col(f"r.{f}"))  # noqa: E741
    has = lambda c: F.size(c) > 0
    first, last = (lambda c: F.get(c, F.lit(0))), (lambda c: F.element_at(F.when(F.size(c) > 0, c), -1))
    ln, rn = F.char_length(l("norm")), F.char_length(r("norm"))
    lc, rc = F.size(l("tokens")), F.size(r("tokens"))
    name_both, addr_both = (l("norm") != "") & (r("norm") != ""), (l("addr") != "") & (r("addr") != "")
    ns, as_ = S.jaccard_sets(l("grams"), r("grams")), S.jaccard_sets(l("addr_tokens"), r("addr_tokens"))
    return {
        "retrieval_score": F.col("score"),
        "name_exact": _flag((l("norm") == r("norm")) & (l("norm") != "")),
        "name_core_exact": _flag((l("core_name") == r("core_name")) & (l("core_name") != "")),
        "first_token_exact": _flag(first(l("all")) == first(r("all"))),
        "last_token_exact": _flag(last(l("all")) == last(r("all"))),
        "addr_exact": _flag((l("addr") == r("addr")) & (l("addr") != "")),
        "addr_numeric_set_exact": _flag((l("addr_nums") == r("addr_nums")) & has(l("addr_nums"))),
        "name_digits_equal": _flag(l("name_nums") == r("name_nums")),
        "name_digits_conflict": _flag(has(l("name_nums")) & has(r("name_nums")) & (l("name_nums") != r("name_nums"))),
        "name_has_digits_both": _flag(has(l("name_nums")) & has(r("name_nums"))),
        "name_token_jaccard": S.jaccard_sets(l("tokens"), r("tokens")),
        "name_token_dice": S.dice(l("tokens"), r("tokens")),
        "name_contain_fwd": S.containment(l("tokens"), r("tokens")),
        "name_contain_rev": S.containment(r("tokens"), l("tokens")),
        "shared_token_count": S.shared(l("tokens"), r("tokens")),
        "name_ngram_jaccard": ns,
        "name_ngram_contain": S.containment(l("grams"), r("grams")),
        "name_len_diff": F.abs(ln - rn),
        "name_len_ratio": S.length_ratio(ln, rn),
        "token_count_diff": F.abs(lc - rc),
        "token_count_ratio": S.length_ratio(lc, rc),
        "addr_token_jaccard": as_,
        "addr_ngram_jaccard": S.jaccard_sets(l("addr_grams"), r("addr_grams")),
        "addr_numeric_jaccard": S.jaccard_sets(l("addr_nums"), r("addr_nums")),
        "script_match": _flag(l("script") == r("script")),
        "is_cross_script": _flag((l("script") != r("script")) & (l("script") != "NONE") & (r("script") != "NONE")),
        "addr_missing_either": _flag(~addr_both),
        "addr_missing_both": _flag((l("addr") == "") & (r("addr") == "")),
        "name_missing_either": _flag(~name_both),
        "n_fields_comparable": name_both.cast("int") + addr_both.cast("int"),
    } | cross_features(ns, as_)


def extra_features() -> dict[str, Column]:
    l, r = (lambda f: F.col(f"l.{f}")), (lambda f: F.col(f"r.{f}"))  # noqa: E741
    last = lambda c: F.element_at(F.when(F.size(c) > 0, c), -1)
    num = lambda c: F.get(c, F.lit(0))
    return {
        "is_domain_l": _flag(l("stem") != ""),
        "is_domain_r": _flag(r("stem") != ""),
        "is_domain_either": _flag((l("stem") != "") | (r("stem") != "")),
        "eff_token_jaccard": S.jaccard_sets(l("eff_tokens"), r("eff_tokens")),
        "eff_token_contain_fwd": S.containment(l("eff_tokens"), r("eff_tokens")),
        "eff_token_contain_rev": S.containment(r("eff_tokens"), l("eff_tokens")),
        "translit_token_jaccard": S.jaccard_sets(l("tr_tokens"), r("tr_tokens")),
        "translit_token_contain": S.containment(l("tr_tokens"), r("tr_tokens")),
        "addr_contain_fwd": S.containment(l("addr_tokens"), r("addr_tokens")),
        "addr_contain_rev": S.containment(r("addr_tokens"), l("addr_tokens")),
        "addr_dice": S.dice(l("addr_tokens"), r("addr_tokens")),
        "addr_last_exact": _flag(last(l("addr_all")) == last(r("addr_all"))),
        "addr_first_num_equal": _flag(num(l("addr_digits")) == num(r("addr_digits"))),
        "addr_first_num_conflict": _flag(num(l("addr_digits")) != num(r("addr_digits"))),
        "addr_token_count_ratio": S.length_ratio(F.size(l("addr_tokens")), F.size(r("addr_tokens"))),
        "cand_is_S2": _flag(r("source") == "S2"),
    }


def fuzzy_features() -> dict[str, Column]:
    l, r = (lambda f: F.col(f"l.{f}")), (lambda f: F.col(f"r.{f}"))  # noqa: E741
    return {
        "name_token_sort_ratio": S.fuzzy_token_sort(l("norm"), r("norm")),
        "name_token_set_ratio": S.fuzzy_token_set(l("norm"), r("norm")),
        "name_ratio": S.fuzzy_ratio(l("norm"), r("norm")),
        "eff_name_ratio": S.fuzzy_ratio(l("eff"), r("eff")),
        "eff_name_token_set_ratio": S.fuzzy_token_set(l("eff"), r("eff")),
        "translit_ratio": S.fuzzy_ratio(l("tr"), r("tr")),
        "translit_token_set_ratio": S.fuzzy_token_set(l("tr"), r("tr")),
    }


def weighed(prepared: DataFrame, idf: DataFrame, field: str, out: str) -> DataFrame:
    """``prepared``, whose ids are unique, with the IDF of each token of a field in ``rec``, in its order."""
    each = prepared.select("id", F.posexplode(f"rec.{field}").alias("pos", "token")).join(idf, "token")
    sums = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "idf"))).alias("_w")).select("id", F.col("_w.idf").alias(out))
    return prepared.join(sums, "id", "left").withColumn(out, F.coalesce(out, F.array().cast("array<double>")))


def shared_idf(l_tokens: Column, l_weights: Column, r_tokens: Column, total: str, most: str) -> dict[str, Column]:
    """Sum and maximum of the IDF of shared tokens, 0 without any, where the left record bears the weights of its tokens."""
    shared = F.filter(F.arrays_zip(l_tokens.alias("t"), l_weights.alias("w")), lambda x: F.array_contains(r_tokens, x["t"]))
    return {total: F.aggregate(shared, F.lit(0.0), lambda acc, x: acc + x["w"]), most: F.coalesce(F.array_max(F.transform(shared, lambda x: x["w"])), F.lit(0.0))}


def featurize(pairs: DataFrame, records: DataFrame, *, name_idf: DataFrame | None = None, addr_idf: DataFrame | None = None, fuzzy: bool = True, unicode: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """s1_id, cand_id and the feature columns in order, of pairs (s1_id, cand_id, score), and columns of theirs to ``keep``.

    Ranks and sizes of groups need ids and scores only, and so are made before a pair meets its records; a record brings
    the weights of its tokens along.  So rows with both records go straight into features and are not shuffled again.
    """
    prepared = materialize(prepare(records, unicode), "feature-records")
    name_idf, addr_idf = name_idf or idf(prepared, "tokens"), addr_idf or idf(prepared, "addr_tokens")
    made = base_features() | extra_features() | (fuzzy_features() if fuzzy else {})
    columns = [c for c in COLUMNS if fuzzy or c not in fuzzy_features()]
    pairs = pairs.select("s1_id", "cand_id", "score", *keep)
    if not prepared.groupBy("id").count().where("count > 1").isEmpty():  # such an id stands for each of its records
        df = with_records(pairs, prepared)
        df = idf_overlap(df, name_idf, F.col("l.tokens"), F.col("r.tokens"), "idf_weighted_overlap", "max_idf_shared")
        df = idf_overlap(df, addr_idf, F.col("l.addr_tokens"), F.col("r.addr_tokens"), "addr_idf_overlap", "addr_max_idf_shared")
        df = reciprocal_features(group_features(df.withColumns(made).drop("l", "r")))
        return df.select("s1_id", "cand_id", *columns, *keep)
    known = prepared.select("id")
    for side in ("s1_id", "cand_id"):
        pairs = pairs.join(known.withColumnRenamed("id", side), side, "left_semi")
    pairs = materialize(reciprocal_features(group_features(pairs)), "feature-ranks")
    heavy = weighed(weighed(prepared, name_idf, "tokens", "_n"), addr_idf, "addr_tokens", "_a")
    heavy = materialize(heavy.select("id", F.struct("rec.*", F.col("_n").alias("token_idf"), F.col("_a").alias("addr_idf")).alias("rec")), "feature-weights")
    made |= shared_idf(F.col("l.tokens"), F.col("l.token_idf"), F.col("r.tokens"), "idf_weighted_overlap", "max_idf_shared")
    made |= shared_idf(F.col("l.addr_tokens"), F.col("l.addr_idf"), F.col("r.addr_tokens"), "addr_idf_overlap", "addr_max_idf_shared")
    return with_records(pairs, heavy).withColumns(made).select("s1_id", "cand_id", *columns, *keep)
