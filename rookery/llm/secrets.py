"""Secret scans: fixed patterns, and two character Markov models held against each other.

Base spans come from three patterns.  The method adds runs of token characters
whose first-order character chain is likelier under a model of random strings
than under one of ordinary identifiers, by at least ``threshold`` nats.  Both
models are trained from labelled samples: random strings made by rule, and
identifiers, together with long words of a bounded, stated number of documents
(``sample_documents``) that lie in no base span.  Everything on the main path is
built-in expressions; texts without a match pay one search per pattern.  Work is linear in a
text's length and in its number of spans: characters are split once, positions are running
sums, and lists grow in parts.

Positions are code points, ends exclusive.  A match is found leftmost first and
without overlap per kind; one that is too short is dropped but still consumed.

Cases: null and empty texts have no spans.  Repeated rows each keep theirs.
Empty tables give empty results.  Extra columns are left out of the result.  Of very long
texts and tokens the whole is read.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the contract: kind, pattern, group that is measured, least length.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter ones may be skipped by the pattern
]
METHOD = "markov"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"

SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
K = len(SYMBOLS) + 1  # symbol 0 stands before the first character

# Words that the rule for ordinary identifiers combines.
WORDS = (
    "account active address admin alert align amount append archive array batch block border branch buffer builder button cache "
    "calendar callback cancel category channel check client cluster code column command comment commit compare component config "
    "connection container content context control convert counter create current customer database date default delete detail "
    "device dialog directory display document domain download edge element email enable encode entity entry error event example "
    "export factory feature field file filter final folder font format frame function gateway global graph group handler header "
    "height helper history home image import index input install instance integer internal invoice item iterator join kernel "
    "label language layer layout length level library license limit line link list loader local location logger login manager "
    "mapping master matrix member memory menu message method metric model module monitor network node notification number object "
    "offset online option order output owner package page panel parameter parent parser partition path pattern payment picture "
    "pixel platform player plugin point policy position prefix preview price primary process product profile project property "
    "provider public query queue random range reader record region register release remote render report request resource response "
    "result return role route runtime sample schedule schema screen script search section selector sequence server service session "
    "setting shadow shape signal simple size socket source stack standard state static status storage stream string structure style "
    "subject summary support switch symbol system table target task template text theme thread ticket timeout title toggle toolbar "
    "total tracker transaction transform translation trigger type update upload user utility validator value variable vector version "
    "video view visible volume warning widget width window worker wrapper writer"
).split()


@dataclass(frozen=True)
class MarkovRatio:
    """Log-likelihood ratios of character pairs, random against ordinary."""

    table: tuple[float, ...]
    threshold: float

    def score(self, token: str) -> float:
        """The same sum on the driver, for tests and thresholds."""
        at, total = 0, 0.0
        for c in token:
            to = SYMBOLS.index(c) + 1
            total, at = total + self.table[at * K + to], to
        return total

    def flags(self, token: Column) -> Column:
        ratios = F.from_json(F.lit(json.dumps(self.table)), "array<double>")
        after = symbols(token)
        before = F.concat(F.array(F.lit(0)), F.slice(after, F.lit(1), F.size(after) - 1))
        return F.aggregate(F.zip_with(before, after, lambda a, b: F.element_at(ratios, a * K + b + 1)), F.lit(0.0).cast("double"), lambda acc, r: acc + r) >= self.threshold


def symbols(token: Column) -> Column:
    """The number of each character of a token, 1 to K - 1."""
    numbers = F.from_json(F.lit(json.dumps([SYMBOLS.find(chr(i)) + 1 for i in range(128)])), "array<int>")
    return F.transform(F.split(token, ""), lambda c: F.element_at(numbers, F.ascii(c) + 1))


def random_samples(spark: SparkSession, n: int) -> DataFrame:
    """``n`` random strings in four alphabets, made from digests of their number; labelled 1."""
    h = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[\r\n]", "")
    by_kind = F.when(F.col("id") % 4 == 0, F.substring(h, 1, 40)).when(F.col("id") % 4 == 1, b64).when(F.col("id") % 4 == 2, F.translate(b64, "+/=", "-_")).otherwise(F.upper(F.translate(b64, "+/=", "")))
    return spark.range(n).select(by_kind.alias("token"), F.lit(1).alias("random"))


def identifier_samples(spark: SparkSession, n: int) -> DataFrame:
    """``n`` identifiers of two or three words in the usual spellings; labelled 0."""
    words = F.split(F.lit(" ".join(WORDS)), " ")
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(WORDS))) + 1).cast("int"))
    a, b, c = word(1), word(2), word(3)
    kinds = [F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.concat_ws("-", a, b), F.concat_ws("/", a, b, c), F.upper(F.concat_ws("_", a, b)), F.concat(a, b, (F.col("id") % 100).cast("string"))]
    pick = kinds[0]
    for i, k in enumerate(kinds[1:], 1):
        pick = F.when(F.col("id") % len(kinds) == i, k).otherwise(pick)
    return spark.range(n).select(pick.alias("token"), F.lit(0).alias("random"))


def document_samples(documents: DataFrame, sample_documents: int) -> DataFrame:
    """Words of 8 letters or more of about ``sample_documents`` documents, chosen by a hash of doc_id; labelled 0."""
    n = documents.select("doc_id").count()
    share = min(1.0, sample_documents / max(n, 1))
    some = documents.select("doc_id", "text").where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * share))
    bare = F.coalesce("text", F.lit(""))
    for _, pattern, _, _ in KINDS:
        bare = F.regexp_replace(bare, pattern, " ")
    return some.select(F.explode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z_/-]{8,}"), 0)).alias("token")).select("token", F.lit(0).alias("random"))


def train(samples: DataFrame, *, threshold: float = 12.0, smoothing: float = 0.5) -> MarkovRatio:
    """The two chains of labelled ``samples`` (token, random), as one table of log ratios.

    Only counts of character pairs reach the driver, at most 2 * 68 * 68 rows.
    """
    chain = samples.where("length(token) > 0").select("random", F.concat(F.array(F.lit(0)), symbols(F.col("token"))).alias("s"))
    pairs = chain.select("random", F.explode(F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda a, b: a * K + b)).alias("pair"))
    counts = [[0.0] * (K * K) for _ in range(2)]
    for random, pair, n in pairs.groupBy("random", "pair").count().collect():
        counts[random][pair] = n
    logs = []
    for own in counts:
        row = []
        for a in range(K):
            part = own[a * K : (a + 1) * K]
            total = sum(part) + smoothing * (K - 1)
            row += [math.log((x + smoothing) / total) for x in part]
        logs.append(row)
    return MarkovRatio(tuple(round(r - o, 6) for r, o in zip(logs[1], logs[0], strict=True)), threshold)


SPAN = "struct<start:int,rank:int,end:int,kind:string>"
#: Entries of a part of a list, which is copied when one is added; characters of a block of text.
PART, BLOCK = 32, 1024


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _sweep(items: Column, kind: str, value, combine, made, keep=None) -> Column:
    """``made(state, x)`` of the items with ``keep(state, x)``, in order; the state is the ``value`` of all items before, combined.

    Part by part: what an aggregate carries along is copied at every step, so it must stay short.
    """
    none = F.array().cast(f"array<{kind}>")

    def part(xs: Column, state: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            out = F.array_append(acc["out"], made(acc["state"], x).cast(kind))
            if keep is not None:
                out = F.when(keep(acc["state"], x), out).otherwise(acc["out"])
            return F.struct(combine(acc["state"], value(x)).alias("state"), out.alias("out"))

        return F.aggregate(xs, F.struct(state.alias("state"), none.alias("out")), add, lambda acc: acc["out"])

    def all_parts(parts: Column) -> Column:
        totals = F.transform(parts, lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: combine(acc, value(x))))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(totals, zero, lambda acc, t: F.struct(combine(acc["at"], t).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, starts, part))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / PART).cast("int")), lambda i: F.slice(xs, i * PART + 1, F.lit(PART)))
    return _let(items, lambda xs: F.when(F.size(xs) > 0, _let(cut(xs), all_parts)).otherwise(none))


def _spans(text: Column, kind: str, rank: int, pattern: str, ok) -> Column:
    """Spans of ``pattern``; gaps and matches alternate, so their lengths give the positions."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("all"), ok[0](text, pattern).alias("part"))
    sizes = F.transform(parts, lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.coalesce(F.char_length(x["all"]), F.lit(0)).alias("all"), (x["all"].isNotNull() & ok[1](x["part"])).alias("good")))
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + x["gap"] + x["all"]).alias("end"), F.lit(kind).alias("kind"))
    found = _sweep(sizes, SPAN, lambda x: x["gap"] + x["all"], lambda at, n: at + n, span, lambda _, x: x["good"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _group(n: int):
    return lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), n)


def with_spans(documents: DataFrame, model: MarkovRatio | None, text: str = "text") -> DataFrame:
    """``documents`` with arrays of spans: ``base_spans`` of the patterns, ``all_spans`` with the method's.

    A span of the method that lies within a base span is not repeated.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = {}
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        own[f"_{kind}"] = _spans(body, kind, rank, pattern, (_group(group), lambda part, least=least: F.char_length(part) >= least))
    if model:
        own["_method"] = _spans(body, METHOD, len(KINDS), CANDIDATE, (_group(0), model.flags))
    else:
        own["_method"] = F.array().cast(f"array<{SPAN}>")
    df = documents.withColumns(own)
    df = df.withColumn("base_spans", F.array_sort(F.concat(*(F.col(f"_{k[0]}") for k in KINDS))))
    # By start, then rank, so base spans that begin where a span of the method does come before it.
    both = F.array_sort(F.concat("base_spans", "_method"))
    base = lambda s: s["rank"] < len(KINDS)
    reach = lambda s: F.when(base(s), s["end"]).otherwise(0)
    merged = _sweep(both, SPAN, reach, F.greatest, lambda _, s: s, lambda end, s: base(s) | (s["end"] > end))
    return df.withColumn("all_spans", F.when(F.size("_method") > 0, merged).otherwise(F.col("base_spans")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def corpus_model(documents: DataFrame, *, sample_documents: int = 512, samples: int = 6000, threshold: float = 12.0) -> MarkovRatio:
    """The model that the queries use."""
    spark = documents.sparkSession
    return train(random_samples(spark, samples).unionByName(identifier_samples(spark, samples)).unionByName(document_samples(documents, sample_documents)), threshold=threshold)


def scan(documents: DataFrame, model: MarkovRatio) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    df = with_spans(documents.select("doc_id", "text"), model)
    return df.select("doc_id", *(F.size(f"_{k[0]}").cast("long").alias(f"n_{k[0]}") for k in KINDS), F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


def redact(documents: DataFrame, model: MarkovRatio, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every span, overlapping ones as one, replaced by ``mark``; n_chars follows the text.

    Documents without spans, and null texts, stay as they are.
    """
    columns = documents.columns
    df = with_spans(documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), "text"), model)
    body = F.coalesce("text", F.lit(""))
    blocks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    end = F.struct(F.char_length(body).alias("start"), F.lit(0).alias("rank"), F.char_length(body).alias("end"), F.lit("").alias("kind")).cast(SPAN)
    last = lambda s: s["kind"] == ""

    def cut(parts: Column, a: Column, b: Column) -> Column:
        """Characters a to b, read off the blocks they lie in."""
        low = F.floor(a / BLOCK).cast("int")
        some = F.array_join(F.slice(parts, low + 1, F.floor((b - 1) / BLOCK).cast("int") - low + 1), "")
        return F.when(b > a, F.substring(some, a - low * BLOCK + 1, b - a)).otherwise("")

    def rest(parts: Column) -> Column:
        piece = lambda at, s: F.concat(cut(parts, at, s["start"]), F.when(last(s), "").otherwise(mark))
        return F.array_join(_sweep(F.array_append("all_spans", end), "string", lambda s: s["end"], F.greatest, piece, lambda at, s: last(s) | (s["start"] >= at)), "")

    clean = F.when(F.size("all_spans") > 0, _let(blocks, rest))
    own = {c: F.col("_row").getField(c) for c in columns}
    own["text"] = F.when(F.size("all_spans") > 0, F.col("_clean")).otherwise(F.col("text"))
    if "n_chars" in columns:
        own["n_chars"] = F.when(F.size("all_spans") > 0, F.char_length("_clean").cast("long")).otherwise(own["n_chars"])
    return df.withColumn("_clean", clean).select(*(v.alias(c) for c, v in own.items()))
