"""Text normalization and tokenization as column expressions.

Everything ASCII stays in built-in expressions.  Only texts with other
characters go through an Arrow function (for NFKC and case folding), and they
alone: other rows reach it as nulls.  Null text counts as empty text.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no identity in a business name.
SUFFIX = (
    "inc incorporated llc ltd limited corp corporation co company llp lp plc holdings group "
    "sarl sarlu sas sasu sa eurl snc scop scp pvt private pvtltd gmbh ag kg ohg bv nv ab oy as aps and the of et"
).split()
# Legal forms that the pair features ignore.
LEGAL = "ltd limited llc inc incorporated corp corporation co company plc pvt private pte gmbh ag sarl sas sa eurl bv nv srl spa sl".split()
# Street words that address tokens leave out.
ADDR_STOPWORDS = "st street rd road ave avenue blvd boulevard ln lane dr drive ct court pl place suite ste apt unit floor fl n s e w north south east west".split()

BLANKS = r"[\s\x1c-\x1f\x{85}]+"
MARKS = r"[\p{P}\p{S}\p{Z}]"
ASCII_ONLY = r"^[\x00-\x7F]*$"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column) -> Column:
    """Space-separated tokens; none for an empty string."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def raw_tokens(c: Column, first: int | None = None) -> Column:
    """Tokens between any white space, or the ``first`` so many, for which a long text is not split."""

    def found(t: Column, limit: int) -> Column:
        return F.filter(F.split(t, r"[ \t\n\x0B\f\r]+", limit), lambda x: x != "")

    if first is None:
        return found(text(c), -1)
    # Before the first token there may be an empty part, and the last part is the rest.  Tokens of the text's
    # beginning are whole if one more begins there; else the text itself is asked.
    head = found(F.substring(text(c), 1, 32 * first), first + 2)
    return F.slice(F.when(F.size(head) > first, head).otherwise(found(text(c), first + 2)), 1, first)


def strip_marks(c: Column) -> Column:
    """Punctuation, symbols and separators become spaces; combining marks stay."""
    return F.regexp_replace(c, MARKS, " ")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def normalize_native(c: Column | str) -> Column:
    """Lower case, ``&`` as ``and``, marks as spaces, white space collapsed."""
    return squeeze(strip_marks(F.replace(F.lower(text(c)), F.lit("&"), F.lit(" and "))))


def _compat_fold(s: str) -> str:
    return unicodedata.normalize("NFKC", s).casefold()


@F.arrow_udf(StringType())
def compat_fold(values: pa.Array) -> pa.Array:
    """NFKC and case folding."""
    return pa.array([None if v is None else _compat_fold(v) for v in values.to_pylist()], pa.string())


def folded(c: Column | str) -> Column:
    """NFKC and case folding; plain lower case where that is the same."""
    t = text(c)
    plain = t.rlike(ASCII_ONLY)
    return F.coalesce(compat_fold(F.when(~plain, t)), F.lower(t))


def normalize(c: Column | str) -> Column:
    """The full normal form of any script; idempotent."""
    return squeeze(strip_marks(F.replace(folded(c), F.lit("&"), F.lit(" and "))))


@F.arrow_udf(StringType())
def compat(values: pa.Array) -> pa.Array:
    """NFKC."""
    return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def normalize_lower(c: Column | str) -> Column:
    """NFKC and lower case, without case folding; marks as spaces, ``&`` as it comes."""
    t = text(c)
    plain = t.rlike(ASCII_ONLY)
    return squeeze(strip_marks(F.replace(F.lower(F.coalesce(compat(F.when(~plain, t)), t)), F.lit("&"), F.lit(" and "))))


def normalize_naive(c: Column | str) -> Column:
    """Lower case with all but letters, digits and ``_`` as spaces.  It parts combining marks from their letters; kept to show that."""
    return squeeze(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}_\s\x0B\x1c-\x1f\x{85}]", " "))


def country_key(c: Column | str) -> Column:
    """Partition key of a country: folded, white space collapsed, marks kept."""
    return squeeze(F.regexp_replace(folded(c), r"\p{Z}", " "))


def _without(toks: Column, words: list[str]) -> Column:
    """Tokens not in ``words``; all of them if none is left."""
    kept = F.filter(toks, lambda t: ~t.isin(words))
    return F.when(F.size(kept) > 0, kept).otherwise(toks)


def name_tokens(norm: Column, drop_suffix: bool = True) -> Column:
    return _without(tokens(norm), SUFFIX) if drop_suffix else tokens(norm)


def name_core(norm: Column) -> Column:
    """Sorted name tokens without suffixes: the order-free exact key."""
    return F.array_join(F.array_sort(name_tokens(norm)), " ")


def core_tokens(norm: Column) -> Column:
    return _without(tokens(norm), LEGAL)


def addr_tokens(norm: Column) -> Column:
    return _without(tokens(norm), ADDR_STOPWORDS)


def has_devanagari(c: Column) -> Column:
    return text(c).rlike(r"[\x{0900}-\x{097F}]")


def script_class(c: Column) -> Column:
    """devanagari, arabic, cjk, latin-extended or ascii: the first that occurs."""
    t = text(c)
    return (
        F.when(t.rlike(r"[\x{0900}-\x{097F}]"), "devanagari")
        .when(t.rlike(r"[\x{0600}-\x{06FF}]"), "arabic")
        .when(t.rlike(r"[\x{4E00}-\x{9FFF}]"), "cjk")
        .when(t.rlike(r"[^\x00-\x7F]"), "latin-extended")
        .otherwise("ascii")
    )


def _windows(s: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))


def ngrams(s: Column, n: int = 3) -> Column:
    """Distinct character n-grams, spaces kept; a shorter string is its own gram."""
    return F.when(F.char_length(s) >= n, F.array_distinct(_windows(s, n))).when(s != "", F.array(s)).otherwise(F.array().cast("array<string>"))


def packed_ngrams(s: Column, n: int, short_is_itself: bool) -> Column:
    """Character n-grams with spaces removed, repeats kept."""
    p = F.replace(s, F.lit(" "), F.lit(""))
    none = F.array().cast("array<string>")
    short = F.when(p != "", F.array(p)).otherwise(none) if short_is_itself else none
    return F.when(F.char_length(p) >= n, _windows(p, n)).otherwise(short)


def char_wb_ngrams(s: Column, n: int = 3) -> Column:
    """n-grams of each word padded with one space, repeats kept."""
    return F.flatten(F.transform(tokens(s), lambda w: _windows(F.concat(F.lit(" "), w, F.lit(" ")), n)))


def word_1_2grams(s: Column) -> Column:
    """Words of two or more word characters, and pairs of neighbours."""
    w = F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    two = F.when(F.size(w) >= 2, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, two)


def digit_runs(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(\p{Nd}+)"), 1)


def numeric_tokens(toks: Column) -> Column:
    return F.filter(toks, lambda t: t.rlike(r"^\p{Nd}+$"))


# What a bare domain ends in, labels without identity at its end and at its start.
TLD = "com net org in co io biz info us uk fr shop online site store".split()
TLDISH = [*TLD, "ac", "gov", "edu"]
SUBDOMAIN = "www web shop store online my the".split()


def domain_stem(c: Column | str) -> Column:
    """The identity-bearing labels of a bare domain, '' of anything else.  Reads the raw string."""
    s = F.lower(F.trim(text(c)))
    bare = s.rlike(rf"^[a-z0-9][a-z0-9.\-]*\.({'|'.join(TLD)})$")
    labels = F.array_join(F.filter(F.split(s, r"[.\-_]+"), lambda t: t != ""), " ")
    tail = F.regexp_replace(labels, rf"(^| )((?:{'|'.join(TLDISH)})(?: |$))+$", "")
    head = F.regexp_replace(F.trim(tail), rf"^(?:(?:{'|'.join(SUBDOMAIN)})(?: |$))+", "")
    return F.when(bare, F.trim(head)).otherwise("")


# Devanagari letters by their regular place in the block; the schwa is written only where no sign follows.
_CONSONANTS = dict(zip(map(chr, range(0x915, 0x93A)), "k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split(), strict=True))
_VOWELS = dict(zip(map(chr, range(0x905, 0x915)), "a aa i ii u uu r l e e e ai o o o au".split(), strict=True))
_SIGNS = dict(zip(map(chr, range(0x93E, 0x94D)), "aa i ii u uu r rr e e e ai o o o au".split(), strict=True))
_OTHER = {"ँ": "n", "ं": "n", "ः": "h", "ऽ": "'", "ॐ": "om", "।": ".", "॥": "."} | {chr(0x966 + i): str(i) for i in range(10)}


def romanize(s: str) -> str:
    """Devanagari letter by letter in Latin; other characters stay."""
    out = []
    for i, c in enumerate(s):
        if c in _CONSONANTS:
            after = s[i + 1 : i + 2]
            schwa = after not in _SIGNS and after not in ("्", "़") and after and "ऀ" <= after <= "ॿ"
            out.append(_CONSONANTS[c] + ("a" if schwa else ""))
        elif c not in ("्", "़"):
            out.append(_VOWELS.get(c) or _SIGNS.get(c) or _OTHER.get(c) or c)
    return "".join(out).lower()


@F.arrow_udf(StringType())
def _romanize(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else romanize(v) for v in values.to_pylist()], pa.string())


def transliterate(c: Column | str) -> Column:
    """Romanised text where there is Devanagari, null elsewhere."""
    t = text(c)
    return _romanize(F.when(has_devanagari(t), t))


def script_of(s: str, order: tuple[str, ...] = ()) -> str:
    """First word of the Unicode names of most letters; NONE without letters, ties to the first in ``order``, else to the first seen."""
    counts: dict[str, int] = {}
    for c, n in Counter(s).items():
        if c.isalpha() and (name := unicodedata.name(c, "")):
            kind = name.split()[0]
            counts[kind] = counts.get(kind, 0) + n
    place = {k: -i for i, k in enumerate(order)}
    return max(counts, key=lambda k: (counts[k], place.get(k, -len(order)))) if counts else "NONE"


def dominant_script(c: Column | str, order: tuple[str, ...] = ()) -> Column:
    """``script_of`` of a text; only texts with other than ASCII characters reach Python."""

    @F.arrow_udf(StringType())
    def script(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else script_of(v, order) for v in values.to_pylist()], pa.string())

    t = text(c)
    plain = t.rlike(ASCII_ONLY)
    return F.coalesce(script(F.when(~plain, t)), F.when(t.rlike("[A-Za-z]"), "LATIN").otherwise("NONE"))
