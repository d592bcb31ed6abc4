"""Pieces of SQL that the oracle queries share."""

from __future__ import annotations

from rookery.functions.text import ADDR_STOPWORDS, SUBDOMAIN, SUFFIX, TLD, TLDISH
from rookery.operators.blocking import ALIAS, KEY_ADDR_STOP
from rookery.sources.records import DEVANAGARI, VOWELS

# What the letters of the records' names are in Latin.
ROMAN = dict(zip("बचडफगहजकलमनपरसटवखय", "b c d ph g h j k l m n p r s t v kh y".split(), strict=True))
ROMAN_VOWELS = dict(zip("अएइओउ", "aeiou", strict=True))


def strings(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def norm(x: str, unicode: bool = False) -> str:
    """The normal form; with ``unicode`` as full as the tables need it: of their letters only the sharp s folds to more than lower case."""
    x = f"replace(lower(nfc_normalize(coalesce({x}, ''))), 'ß', 'ss')" if unicode else x
    return rf"trim(regexp_replace(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[\pP\pS\pZ]', ' ', 'g'), '[\s\x0B\x1c-\x1f\x{{85}}]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def without(x: str, words: list[str]) -> str:
    kept = f"list_filter({x}, lambda t: NOT list_contains({strings(words)}, t))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {x} END"


def joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, ' '), '')"


def grams(s: str, n: int, short: bool = True) -> str:
    tail = f"CASE WHEN {s} <> '' THEN [{s}] ELSE [] END" if short else "[]"
    return f"CASE WHEN length({s}) >= {n} THEN list_transform(range(1, length({s}) - {n - 2}), lambda i: substr({s}, i, {n})) ELSE {tail} END"


def domain_stem(x: str) -> str:
    s = f"lower(trim(coalesce({x}, '')))"
    labels = rf"array_to_string(list_filter(regexp_split_to_array({s}, '[.\-_]+'), lambda t: t <> ''), ' ')"
    tail = f"trim(regexp_replace({labels}, '(^| )(({'|'.join(TLDISH)})( |$))+$', ''))"
    head = f"trim(regexp_replace({tail}, '^(({'|'.join(SUBDOMAIN)})( |$))+', ''))"
    return rf"CASE WHEN regexp_matches({s}, '^[a-z0-9][a-z0-9.\-]*\.({'|'.join(TLD)})$') THEN {head} ELSE '' END"


def replaced(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def roman(x: str) -> str:
    """Of texts that ``devanagari`` made: a consonant and its virama, or a vowel, letter by letter."""
    made = [(c + "\u094d", ROMAN[c]) for c in dict.fromkeys(DEVANAGARI.values())] + [(c, ROMAN_VOWELS[c]) for c in VOWELS.values()]
    return f"lower({replaced(x, made)})"


def devanagari(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), '{''.join([*VOWELS, *DEVANAGARI])}', '{''.join([*VOWELS.values(), *DEVANAGARI.values()])}'), '([क-ह])', '\\1्', 'g')"


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda t: t <> '')"

RECORDS = f"""
docs AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS country, substr(text, 1, 40) AS prefix,
         CASE WHEN CAST(substr(source, 4) AS INT) < 4 THEN 'S1' WHEN CAST(substr(source, 4) AS INT) < 12 THEN 'S2' ELSE 'S3' END AS source, {_WORDS} AS tk
  FROM documents
), latin AS MATERIALIZED (
  SELECT source || '-' || doc_id AS entity_id, doc_id, source, country, prefix,
         coalesce(array_to_string(tk[1:6], ' '), '') AS latin, coalesce(array_to_string(tk[7:14], ' '), '') AS address
  FROM docs
), records AS MATERIALIZED (
  SELECT entity_id, doc_id, source, country, prefix, CASE WHEN source <> 'S1' AND doc_id % 7 = 3 THEN {devanagari("latin")} ELSE latin END AS name, address FROM latin
)"""

TRUTH = """
owners AS (SELECT country, prefix, min(doc_id) AS s1 FROM records WHERE source = 'S1' GROUP BY ALL),
truth AS MATERIALIZED (SELECT 'S1-' || s1 AS s1_id, entity_id AS cand_id FROM records JOIN owners USING (country, prefix) WHERE source <> 'S1')"""

PREP = f"""
p0 AS MATERIALIZED (
  SELECT *, {norm("name", True)} AS n, {norm("address", True)} AS a, {domain_stem("name")} AS stem,
         CASE WHEN regexp_matches(name, '[\\x{{0900}}-\\x{{097F}}]') THEN {norm(roman("name"), True)} ELSE '' END AS tr FROM records),
p1 AS MATERIALIZED (SELECT *, {toks("n")} AS nt, {toks("a")} AS aw FROM p0),
p2 AS MATERIALIZED (SELECT *, {joined(f"list_sort({without('nt', SUFFIX)})")} AS core, {toks("tr")} AS trt FROM p1),
p3 AS MATERIALIZED (SELECT *, {joined(f"list_sort({without('trt', SUFFIX)})")} AS trcore FROM p2),
prep AS MATERIALIZED (
  SELECT *, list_filter(aw, lambda t: regexp_matches(t, '^\\p{{Nd}}+$')) AS nums,
         replace(CASE WHEN core <> '' THEN core ELSE n END, ' ', '') AS packed
  FROM p3
), g AS MATERIALIZED (SELECT *, {grams("packed", 4)} AS grams FROM prep)"""

FREQ = """
freq AS MATERIALIZED (
  SELECT country, field, term, count(*) AS df FROM (
    SELECT country, 'nt' AS field, unnest(list_distinct(nt)) AS term FROM g WHERE source <> 'S1'
    UNION ALL SELECT country, 'at', unnest(list_distinct(aw)) FROM g WHERE source <> 'S1'
    UNION ALL SELECT country, 'grams', unnest(list_distinct(grams)) FROM g WHERE source <> 'S1') GROUP BY ALL
)"""


def rarest(name: str, field: str, column: str, n: int, stop: list[str] | None = None) -> str:
    no = f"AND NOT list_contains({strings(stop)}, term)" if stop else ""
    return f"""
{name} AS MATERIALIZED (
  SELECT country, entity_id, term FROM (
    SELECT t.country, t.entity_id, t.term, row_number() OVER (PARTITION BY t.country, t.entity_id ORDER BY coalesce(f.df, 0), t.term) AS r
    FROM (SELECT country, entity_id, unnest(list_distinct({column})) AS term FROM g) t
    LEFT JOIN freq f ON f.country = t.country AND f.term = t.term AND f.field = '{field}'
    WHERE length(t.term) >= 3 {no.replace("term", "t.term")})
  WHERE r <= {n}
)"""


KEYS = (
    rarest("rt", "nt", "nt", 10)
    + ","
    + rarest("ra", "at", "aw", 6, KEY_ADDR_STOP)
    + ","
    + rarest("g4", "grams", "grams", 2)
    + ","
    + rarest("rr", "nt", "trt", 2)
    + """,
keys AS MATERIALIZED (
  SELECT DISTINCT country, entity_id, key FROM (
    SELECT country, entity_id, CASE WHEN core <> '' THEN 'C|' || core END AS key FROM g
    UNION ALL SELECT country, entity_id, CASE WHEN core <> '' AND len(nt) >= 2 THEN 'S|' || array_to_string(list_sort(nt), ' ') END FROM g
    UNION ALL SELECT country, entity_id, CASE WHEN stem <> '' THEN 'C|' || stem END FROM g
    UNION ALL SELECT country, entity_id, CASE WHEN tr <> '' THEN 'C|' || trcore END FROM g
    UNION ALL SELECT country, entity_id, 'RT|' || term FROM rr
    UNION ALL SELECT country, entity_id, CASE WHEN len(nt) > 0 AND len(aw) > 0 THEN 'NA|' || nt[1] || '|' || aw[-1] END FROM g
    UNION ALL SELECT country, entity_id, CASE WHEN len(nt) > 0 AND len(nums) > 0 THEN 'NN|' || nt[1] || '|' || nums[1] END FROM g
    UNION ALL SELECT country, entity_id, CASE WHEN len(nums) > 0 AND len(aw) > 0 THEN 'AN|' || nums[1] || '|' || aw[-1] END FROM g
    UNION ALL SELECT country, entity_id, CASE WHEN len(aw) >= 2 THEN 'A2|' || aw[1] || ' ' || aw[2] END FROM g
    UNION ALL SELECT country, entity_id, 'RT|' || term FROM rt
    UNION ALL SELECT country, entity_id, 'RA|' || term FROM ra
    UNION ALL SELECT country, entity_id, 'G4|' || term FROM g4)
  WHERE key IS NOT NULL
), light AS (SELECT country, key FROM keys WHERE entity_id NOT LIKE 'S1-%' GROUP BY ALL HAVING count(*) <= 400),
kc AS MATERIALIZED (
  SELECT DISTINCT a.country, a.entity_id AS s1_id, b.entity_id AS cand_id
  FROM keys a JOIN light USING (country, key) JOIN keys b ON b.country = a.country AND b.key = a.key
  WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%'
)"""
)

def _padded(tokens: str) -> str:
    return f"flatten(list_transform({tokens}, lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))))"


NAME_TERMS = _padded("nt")
BOTH_TERMS = _padded("list_concat(nt, trt)")
_W = r"regexp_extract_all(a, '[\p{L}\p{N}_]{2,}')"
ADDR_TERMS = f"list_concat({_W}, list_transform(range(1, len({_W})), lambda i: {_W}[i] || ' ' || {_W}[i + 1]))"


def vectors(p: str, terms: str, where: str = "true", per_source: bool = True, docs: str = "") -> str:
    """CTEs of vectors and cosines; ``docs`` are the terms of targets where they are not those of queries."""
    part = "country || '|' || source" if per_source else "country"
    alias = f"UNION ALL SELECT entity_id || '{ALIAS}', {part}, {_padded('trt')} FROM g WHERE source <> 'S1' AND tr <> ''" if terms == NAME_TERMS and per_source else ""
    return f"""
{p}docs AS MATERIALIZED (SELECT entity_id AS id, {part} AS part, {docs or terms} AS terms FROM g WHERE source <> 'S1' AND {where} {alias}),
{p}n AS (SELECT part, count(*) AS n FROM {p}docs GROUP BY part),
{p}voc AS MATERIALIZED (
  SELECT part, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf
  FROM (SELECT part, unnest(list_distinct(terms)) AS term FROM {p}docs) JOIN {p}n USING (part) GROUP BY part, term HAVING count(*) >= 2),
{p}asked AS (
  SELECT entity_id AS id, s.part, {terms} AS terms
  FROM g JOIN (SELECT DISTINCT country, {part} AS part FROM g WHERE source <> 'S1') s USING (country) WHERE source = 'S1'),
{p}raw AS (
  SELECT side, id, part, term, (1 + ln(tf)) * idf AS v FROM (
    SELECT side, id, part, term, count(*) AS tf FROM (
      SELECT 'd' AS side, id, part, unnest(terms) AS term FROM {p}docs UNION ALL SELECT 'q', id, part, unnest(terms) FROM {p}asked) GROUP BY ALL)
  JOIN {p}voc USING (part, term)),
{p}w AS MATERIALIZED (SELECT side, id, part, term, v / sqrt(sum(v * v) OVER (PARTITION BY side, part, id)) AS w FROM {p}raw),
{p}cos AS MATERIALIZED (
  SELECT q.part, q.id AS q, d.id AS d, round(sum(q.w * d.w), 6) AS score
  FROM {p}w q JOIN {p}w d ON q.part = d.part AND q.term = d.term AND q.side = 'q' AND d.side = 'd' GROUP BY ALL HAVING round(sum(q.w * d.w), 6) > 0)"""


def by_record(p: str) -> str:
    """{p}rec: cosines by record, of its romanised document where there is one."""
    return f"{p}rec AS MATERIALIZED (SELECT part, q, split_part(d, '|', 1) AS d, max_by(score, d LIKE '%{ALIAS}') AS score FROM {p}cos WHERE d LIKE '%{ALIAS}' OR d || '{ALIAS}' NOT IN (SELECT id FROM {p}docs) GROUP BY ALL)"


def search(p: str, k: int) -> str:
    return f"{p}top AS MATERIALIZED (SELECT part, q, d, score FROM (SELECT *, row_number() OVER (PARTITION BY part, q ORDER BY score DESC, d) AS r FROM {p}cos) WHERE r <= {k})"


EXACT = """
p1hits AS MATERIALIZED (
  SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id, b.source
  FROM g a JOIN (SELECT entity_id, source, country, core AS key FROM g UNION SELECT entity_id, source, country, trcore FROM g) b ON a.country = b.country AND a.core = b.key
  WHERE a.core <> '' AND a.source = 'S1' AND b.source <> 'S1')"""

# One scored claim per order and part: a fixed arithmetic function of the line.
CLAIMS = """
claims AS MATERIALIZED (
  SELECT l_orderkey AS s1_id, l_partkey AS cand_id,
         max(((CAST(l_quantity AS INT) * 37 + CAST(round(l_discount * 100) AS INT) * 61 + l_linenumber * 17) % 97) / 97.0) AS prob
  FROM lineitem GROUP BY ALL)"""

ADDR_WORDS = without("aw", ADDR_STOPWORDS)
