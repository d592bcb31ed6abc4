"""Candidate generation: exact cores, composite keys, TF-IDF passes, their union.

Records come prepared (``prepare``) with columns entity_id, source, country and
their derived text.  Candidates never cross countries, so country is part of
every key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.functions import text as T
from rookery.operators import tfidf
from rookery.plans.durable import materialize

# Address words too common to be keys, and what marks the second document of a record.
KEY_ADDR_STOP = "road rd street st nagar colony near opp opposite floor no plot block sector phase main cross lane ave avenue dr drive suite ste unit apt building".split()
ALIAS = "|tr"


@dataclass(frozen=True)
class BlockConfig:
    """Knobs of the passes."""

    name_top_k: int = 50
    addr_top_k: int = 30
    min_df: int = 2
    weight_name: float = 0.6
    weight_addr: float = 0.4
    final_top_k: int = 150
    min_output_score: float = 0.0
    n_rare_name: int = 10
    n_rare_addr: int = 6
    n_rare_gram: int = 2
    cap: int = 400
    families: frozenset[str] = frozenset(["RT", "RA", "G4", "X"])


def prepare(records: DataFrame, unicode: bool = True) -> DataFrame:
    """Per-record text, once.  ``unicode=False`` stays in built-in expressions (no NFKC, no romanisation)."""
    norm = T.normalize if unicode else T.normalize_native
    df = records.withColumns({"n": norm("name"), "a": norm("address"), "stem": T.domain_stem("name")})
    df = df.withColumns({"nt": T.tokens(F.col("n")), "at": T.tokens(F.col("a")), "core": T.name_core(F.col("n"))})
    tr = T.normalize(T.transliterate("name")) if unicode else F.lit("")
    df = df.withColumn("tr", tr)
    return df.withColumns({"nums": T.numeric_tokens(F.col("at")), "grams": T.packed_ngrams(F.when(F.col("core") != "", F.col("core")).otherwise(F.col("n")), 4, True)})


def left(records: DataFrame) -> DataFrame:
    return records.where("source = 'S1'")


def right(records: DataFrame) -> DataFrame:
    return records.where("source <> 'S1'")


def core_keys(records: DataFrame) -> DataFrame:
    """(entity_id, source, country, key): the core of an S1 name; of a target, its core and that of its romanised name."""
    cores = F.filter(F.array_distinct(F.array("core", F.when(F.col("source") == "S1", F.col("core")).otherwise(T.name_core(F.col("tr"))))), lambda k: k != "")
    return records.where("source IS NOT NULL").select("entity_id", "source", "country", F.explode(cores).alias("key"))


def exact_core(records: DataFrame) -> DataFrame:
    """(s1_id, cand_id, source, score, pass): equal name cores, or the core of a target's romanised name.

    Every pair of equal cores is a candidate.  Cores of more targets than others are
    joined like all; a join that is skewed by one is split at run time.
    """
    keyed = core_keys(records)
    a = left(keyed).select("country", "key", F.col("entity_id").alias("s1_id"))
    b = right(keyed)
    hits = a.join(b.select("country", "key", F.col("entity_id").alias("cand_id"), "source"), ["country", "key"])
    return hits.select("s1_id", "cand_id", "source", F.lit(1.0).alias("score"), F.lit("P1").alias("pass")).distinct()


def frequencies(records: DataFrame) -> DataFrame:
    """(country, field, term, df) over the target records; fields are nt, at and grams."""

    def named(field: str) -> Column:
        return F.transform(F.array_distinct(field), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))

    each = F.explode(F.flatten(F.array(*map(named, ("nt", "at", "grams"))))).alias("x")
    return right(records).select("country", each).groupBy("country", "x.field", "x.term").agg(F.count("*").alias("df"))


def rarest(records: DataFrame, df: DataFrame, field: str, terms: Column, n: int, stop: list[str] | None = None) -> DataFrame:
    """(country, entity_id, term): each record's ``n`` rarest terms of three letters or more, ties by term."""
    t = records.select("country", "entity_id", F.explode(F.array_distinct(terms)).alias("term")).where(F.char_length("term") >= 3)
    if stop:
        t = t.where(~F.col("term").isin(stop))
    t = t.join(df.where(F.col("field") == field).select("country", "term", "df"), ["country", "term"], "left")
    best = Window.partitionBy("country", "entity_id").orderBy(F.coalesce("df", F.lit(0)), "term")
    return t.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n).select("country", "entity_id", "term")


def keys(records: DataFrame, df: DataFrame, cfg: BlockConfig = BlockConfig()) -> DataFrame:
    """(country, entity_id, key), distinct: the same for both sides."""
    tag = lambda p, c: F.concat(F.lit(p + "|"), c)
    first = lambda c: F.get(c, F.lit(0))
    last = lambda c: F.element_at(c, -1)
    has_n, has_a, has_num = F.size("nt") > 0, F.size("at") > 0, F.size("nums") > 0
    whole = [
        F.when(F.col("core") != "", tag("C", F.col("core"))),
        F.when((F.col("core") != "") & (F.size("nt") >= 2), tag("S", F.array_join(F.array_sort("nt"), " "))),
        F.when(F.col("tr") != "", tag("C", T.name_core(F.col("tr")))),
        F.when(F.col("stem") != "", tag("C", F.col("stem"))),
    ]
    if "X" in cfg.families:
        none = F.lit(None).cast("string")
        whole += [
            F.when(has_n & has_a, F.concat_ws("|", F.lit("NA"), first(F.col("nt")), last(F.when(has_a, F.col("at"))))),
            F.when(has_n & has_num, F.concat_ws("|", F.lit("NN"), first(F.col("nt")), first(F.col("nums")))),
            F.when(has_num & has_a, F.concat_ws("|", F.lit("AN"), first(F.col("nums")), last(F.when(has_a, F.col("at"))))),
            F.when(F.size("at") >= 2, F.concat(F.lit("A2|"), F.concat_ws(" ", first(F.col("at")), F.get("at", F.lit(1))))).otherwise(none),
        ]
    out = records.select("country", "entity_id", F.explode(F.array_compact(F.array(*whole))).alias("key"))
    rare = []
    if "RT" in cfg.families:
        rare.append(("RT", rarest(records, df, "nt", F.col("nt"), cfg.n_rare_name)))
    if "RA" in cfg.families:
        rare.append(("RA", rarest(records, df, "at", F.col("at"), cfg.n_rare_addr, KEY_ADDR_STOP)))
    if "G4" in cfg.families:
        rare.append(("G4", rarest(records, df, "grams", F.col("grams"), cfg.n_rare_gram)))
    rare.append(("RT", rarest(records.where("tr <> ''"), df, "nt", T.tokens(F.col("tr")), 2)))
    for p, terms in rare:
        out = out.unionByName(terms.select("country", "entity_id", tag(p, F.col("term")).alias("key")))
    return out.distinct()


def key_candidates(records: DataFrame, cfg: BlockConfig = BlockConfig()) -> DataFrame:
    """(country, s1_id, cand_id): records that share a key which at most ``cap`` target records have.

    The cap is the operator's own: a key of more records is a scan, no evidence.
    Heavy keys go before the join, by counts made map-side.
    """
    df = frequencies(records)
    k = keys(records, df, cfg).join(records.select("country", "entity_id", "source"), ["country", "entity_id"])
    target = k.where("source <> 'S1'").select("country", "key", F.col("entity_id").alias("cand_id"))
    light = target.groupBy("country", "key").agg(F.count("*").alias("n")).where(F.col("n") <= cfg.cap).select("country", "key")
    asked = k.where("source = 'S1'").select("country", "key", F.col("entity_id").alias("s1_id")).join(light, ["country", "key"])
    return asked.join(target, ["country", "key"]).select("country", "s1_id", "cand_id").distinct()


def _corpus(records: DataFrame, terms: Column, part: Column) -> DataFrame:
    return records.select(F.col("entity_id").alias("id"), part.alias("part"), terms.alias("terms"))


def field_vectors(records: DataFrame, field: str, cfg: BlockConfig = BlockConfig(), per_source: bool = True) -> tuple[DataFrame, DataFrame]:
    """(queries, documents) as weighted terms of a field (name or address).

    Each target source of a country is a corpus of its own, or all of a country
    together; S1 records are queries to each.  Texts that are empty are no documents.
    A record with a romanised name has, per source, a second document of that spelling (its id
    ends in ALIAS), and in the corpus of a country one document of both spellings.
    """
    part = F.concat_ws("|", "country", "source") if per_source else F.col("country")
    target, asked = right(records), left(records)
    if field == "address":
        own, query = T.word_1_2grams(F.col("a")), T.word_1_2grams(F.col("a"))
        target = target.where("a <> ''")
    else:
        query = T.char_wb_ngrams(F.col("n"))
        both = F.when(F.col("tr") != "", F.concat_ws(" ", "n", "tr")).otherwise(F.col("n"))
        own = query if per_source else T.char_wb_ngrams(both)
        target = target.where("n <> ''") if per_source else target
    docs = _corpus(target, own, part)
    if field == "name" and per_source:
        alias = right(records).where("tr <> ''").withColumn("entity_id", F.concat("entity_id", F.lit(ALIAS)))
        docs = docs.unionByName(_corpus(alias, T.char_wb_ngrams(F.col("tr")), part))
    parts = right(records).select("country", part.alias("part")).distinct()
    asked = asked.select("entity_id", "country", query.alias("terms")).where(F.size("terms") > 0)
    asked = asked.join(parts, "country").select(F.col("entity_id").alias("id"), "part", "terms")
    vocab = tfidf.vocabulary(docs, cfg.min_df)
    return tfidf.weigh(asked, vocab), tfidf.weigh(docs, vocab)


Vectors = dict[str, tuple[DataFrame, DataFrame]]


def all_vectors(records: DataFrame, cfg: BlockConfig = BlockConfig(), per_source: bool = True) -> Vectors:
    """The vectors of both fields, written once for all their readers."""
    made = {f: field_vectors(records, f, cfg, per_source) for f in ("name", "address")}
    return {f: (materialize(q, f"{f}-queries"), materialize(d, f"{f}-documents")) for f, (q, d) in made.items()}


def of_records(documents: DataFrame) -> DataFrame:
    """Packed documents by record: of a record with two documents the romanised one, which a Latin query can meet."""
    alias = F.col("id").endswith(ALIAS)
    base = documents.withColumns({"_a": alias, "id": F.when(alias, F.substring_index("id", "|", 1)).otherwise(F.col("id"))})
    best = base.groupBy("part", "id").agg(F.max_by(F.struct("terms", "weights"), F.col("_a")).alias("v"))
    return best.select("part", "id", "v.terms", "v.weights")


def tfidf_pass(records: DataFrame, field: str, tag: str, cfg: BlockConfig = BlockConfig(), vectors: Vectors | None = None) -> DataFrame:
    """(s1_id, cand_id, source, score, pass): the nearest documents of each source by one field; those of a romanised name are pass P4."""
    q, d = vectors[field] if vectors else field_vectors(records, field, cfg)
    hits = tfidf.cosine_search(q, d, cfg.name_top_k if field == "name" else cfg.addr_top_k)
    alias = F.col("d").endswith(ALIAS)
    cand = F.when(alias, F.substring_index("d", "|", 1)).otherwise(F.col("d"))
    return hits.select(F.col("q").alias("s1_id"), cand.alias("cand_id"), F.substring("d", 1, 2).alias("source"), "score", F.when(alias, "P4").otherwise(tag).alias("pass"))


def union_rescored(records: DataFrame, hits: DataFrame, cfg: BlockConfig = BlockConfig(), vectors: Vectors | None = None) -> DataFrame:
    """(s1_id, cand_id, source, passes, score, rank): union of passes with provenance, rescored, trimmed.

    score = max(w_n cos_n + w_a cos_a, w_n best raw score, w_a cos_a).
    """
    pairs = hits.groupBy("s1_id", "cand_id", "source").agg(F.array_join(F.array_sort(F.collect_set("pass")), "+").alias("passes"), F.max("score").alias("raw_max"))
    pairs = pairs.join(records.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    pairs = pairs.select(F.concat_ws("|", "country", "source").alias("part"), F.col("s1_id").alias("q"), F.col("cand_id").alias("d"), "source", "passes", "raw_max")
    vectors = vectors or all_vectors(records, cfg)
    for field, out in (("name", "cos_name"), ("address", "cos_addr")):
        q, d = vectors[field]
        pairs = tfidf.cosine_pairs(pairs, tfidf.packed(q), of_records(tfidf.packed(d)), out)
    wn, wa = F.lit(cfg.weight_name), F.lit(cfg.weight_addr)
    score = F.round(F.greatest(wn * F.col("cos_name") + wa * F.col("cos_addr"), F.col("raw_max") * wn, F.col("cos_addr") * wa), 6)
    pairs = pairs.withColumn("score", score).where(F.col("score") >= cfg.min_output_score)
    return _trim(pairs.select(F.col("q").alias("s1_id"), F.col("d").alias("cand_id"), "source", "passes", "score"), cfg.final_top_k)


def _trim(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def key_block_rescored(records: DataFrame, cfg: BlockConfig = BlockConfig()) -> DataFrame:
    """(s1_id, cand_id, source, score, rank): key candidates, rescored by both cosines over the country, best first."""
    pairs = materialize(key_candidates(records, cfg), "key-pairs").select(F.col("country").alias("part"), F.col("s1_id").alias("q"), F.col("cand_id").alias("d"))
    vectors = all_vectors(records, cfg, per_source=False)
    for field, out in (("name", "cos_name"), ("address", "cos_addr")):
        q, d = vectors[field]
        pairs = tfidf.cosine_pairs(pairs, tfidf.packed(q), tfidf.packed(d), out)
    score = F.round(cfg.weight_name * F.col("cos_name") + cfg.weight_addr * F.col("cos_addr"), 6)
    return _trim(pairs.select(F.col("q").alias("s1_id"), F.col("d").alias("cand_id"), F.substring("d", 1, 2).alias("source"), score.alias("score")), cfg.final_top_k)


def _both_vectors(vectors: Vectors, side: int) -> DataFrame:
    """(id, part, xt, xw, yt, yw): packed name and address of one side, parts told apart by their terms."""
    made = None
    for field, x in (("name", "x"), ("address", "y")):
        own = tfidf.packed(vectors[field][side])
        own = of_records(own) if side else own
        own = own.select("part", "id", F.transform("terms", lambda t: t.bitwiseXOR(F.xxhash64("part"))).alias(x + "t"), F.col("weights").alias(x + "w"))
        made = own if made is None else made.join(own, ["part", "id"], "full")
    return made


def best_core(records: DataFrame, vectors: Vectors, cfg: BlockConfig = BlockConfig()) -> DataFrame:
    """Hits of ``exact_core``, without those that ``final_top_k`` others of the same core surely beat in ``union_rescored``.

    Only cores of more than ``final_top_k`` targets have such.  A pair scores at least w_n here, and more by its two
    cosines only, so the best of a core are found without a row for each of its pairs.
    """
    keyed = materialize(core_keys(records).distinct(), "core-keys")
    size = right(keyed).groupBy("country", "key").agg(F.count("*").alias("_n"))
    asked = left(keyed).join(size, ["country", "key"]).select("country", "key", F.col("entity_id").alias("s1_id"), "_n")
    crowd = F.col("_n") > cfg.final_top_k
    hits = asked.where(~crowd).drop("_n").join(right(keyed).select("country", "key", F.col("entity_id").alias("cand_id"), "source"), ["country", "key"])
    hits = hits.select("s1_id", "cand_id", "source")
    group = F.concat_ws("|", "country", "key").alias("group")
    queries = asked.where(crowd).select(group, F.col("s1_id").alias("id"))
    live = asked.where(crowd).select("country", "key").distinct()
    docs = right(keyed).join(live, ["country", "key"]).select(group, F.concat_ws("|", "country", "source").alias("part"), "source", F.col("entity_id").alias("id"))
    names = ("xt", "array<bigint>"), ("xw", "array<double>"), ("yt", "array<bigint>"), ("yw", "array<double>")
    there = lambda df: df.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in names})
    # A query has a vector for each part; its terms meet those of the same part only.
    q = there(_both_vectors(vectors, 0).join(queries.select("id").distinct(), "id", "left_semi")).groupBy("id")
    q = q.agg(F.sort_array(F.collect_list(F.struct("part", *(c for c, _ in names)))).alias("v")).select("id", *(F.flatten(f"v.{c}").alias(c) for c, _ in names))
    q = there(queries.join(q, "id", "left"))
    d = there(docs.join(_both_vectors(vectors, 1), ["part", "id"], "left")).drop("part")
    best = tfidf.group_best(q, d, cfg.final_top_k, cfg.weight_name, cfg.weight_addr, cfg.weight_name)
    return hits.unionByName(best.select(F.col("q").alias("s1_id"), F.col("d").alias("cand_id"), "source")).withColumns({"score": F.lit(1.0), "pass": F.lit("P1")})


def union_block(records: DataFrame, cfg: BlockConfig = BlockConfig(), vectors: Vectors | None = None, named: DataFrame | None = None) -> DataFrame:
    """All passes, united and rescored; ``named`` are hits of the pass by name, where they are there already."""
    vectors = vectors or all_vectors(records, cfg)
    named = tfidf_pass(records, "name", "P2", cfg, vectors) if named is None else named
    hits = best_core(records, vectors, cfg).unionByName(named).unionByName(tfidf_pass(records, "address", "P3", cfg, vectors))
    return union_rescored(records, materialize(hits, "hits"), cfg, vectors)


def rare_token_block(records: DataFrame, truth: DataFrame, max_df: int = 120, top: int = 40) -> DataFrame:
    """(s1_id, cand_id, score, is_match): rare shared name tokens count 2, shared address numbers of 3 digits 1.

    The best ``top`` of each entity; true partners are always in.
    """
    name = records.select("entity_id", "source", "country", F.explode(F.array_distinct("nt")).alias("term"))
    df = name.where("source <> 'S1'").groupBy("country", "term").agg(F.count("*").alias("df")).where(F.col("df") <= max_df)
    name = name.join(df.select("country", "term"), ["country", "term"]).withColumn("w", F.lit(2))
    digits = T.digit_runs(F.col("address"))
    number = records.select("entity_id", "source", "country", F.explode(F.array_distinct(digits)).alias("term")).where(F.char_length("term") >= 3)
    number = number.select("country", F.concat(F.lit("#"), "term").alias("term"), "entity_id", "source", F.lit(1).alias("w"))
    every = name.unionByName(number)
    a = every.where("source = 'S1'").select("country", "term", "w", F.col("entity_id").alias("s1_id"))
    b = every.where("source <> 'S1'").select("country", "term", F.col("entity_id").alias("cand_id"))
    score = a.join(b, ["country", "term"]).groupBy("s1_id", "cand_id").agg(F.sum("w").alias("score"))
    best = Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id")
    got = score.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).drop("r")
    return got.join(truth.withColumn("m", F.lit(1)), ["s1_id", "cand_id"], "full").select("s1_id", "cand_id", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("m", F.lit(0)).alias("is_match"))
