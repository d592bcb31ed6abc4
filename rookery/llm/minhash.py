"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped edges.

One hash of every distinct shingle fills ``BANDS * ROWS`` bins; an empty bin takes
the value of the first filled bin in an order of its own (optimal densification, without
replacement).  Documents with equal sets are one node.  Nodes that share a band
share a bucket, and a bucket proposes only a star: its hub, the smallest id,
with each other member.  Size ratio and a 256-bit sketch discard pairs that
cannot, or all but surely do not, reach the threshold; the rest are confirmed on
the full shingle sets.  Confirmed edges give components by alternating large and
small stars.  Sets are confirmed on the words themselves: hashes of words and shingles are
checked to be one to one in the texts compared, and exchanged for the words where they are not.

The first hub of a bucket is the member that meets most others over all its
buckets, so that in a family of copies the original, which is alike to all, is
hub everywhere.  A star alone would lose a link between two members that are
both unlike the hub.  So for ``ROUNDS`` rounds a bucket whose members that were not yet
hub still lie in several components proposes two further stars, from the ends of
an order of its own, to the members outside the hub's component.  A hub has then met
its whole bucket and leaves it.  What is left after that goes to an exact
join: members of buckets still open are paired by the rarest of their shingles, of which
two sets at the threshold always share one (prefix filter), so every pair that
shares a bucket is either in one component or was compared.

Cases: null texts and texts without words have no shingles, link with nothing
and are their own component.  A very long text is a piece of its own and costs memory in proportion to its length.  Rows of equal doc_id are one document to the
links; each row is returned.  An empty table gives no rows.  Extra columns are
left out.  A null doc_id names no document: such a row is its own component, null, and kept.  Ties go to the smaller doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.textarrays import bounded, column_bytes, exact, mix, pieces, released, shingles, words
from rookery.plans.durable import materialize

BANDS, ROWS = 56, 8
BINS = 512
assert BANDS * ROWS <= BINS
SKETCH_LONGS = 4
#: Bits of 256 that must agree: a tenth of them differs at similarity 0.8, each column by itself.
SKETCH_AGREE = 208
#: Sets smaller than this skip the sketch: a few shingles repeat over many columns.
SKETCH_FROM = 64
_RNG = np.random.default_rng(1237)
_ORDER = np.argsort(_RNG.random((BINS, BINS)), axis=1).astype(np.int16)
_RANK = np.argsort(_ORDER, axis=1).astype(np.int16)
_ODD = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_TRIES = 24
_LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Sets held by at least one row in so many are hot; there are no more of them than that.
HOT_SHARE = 2000
#: Rounds of two further hubs in each open bucket before the exact join of what is left.
ROUNDS = 2


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows before, row, hash) of the distinct shingles of a piece of a column, by row, then hash."""
    raw, offsets = column_bytes(texts)
    for a, b in pieces(offsets):
        own = offsets[a : b + 1] - offsets[a]
        h, row, _, _ = words(raw[offsets[a] : offsets[b]], own)
        s, r = shingles(h, row, b - a, k)
        order = np.lexsort((s, r))
        s, r = s[order], r[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
        yield a, b - a, r[new], s[new]


def signatures(row: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """n x BINS minima of rows with at least one shingle; rows without any are zero."""
    out = np.zeros((n, BINS), np.uint64)
    filled = np.zeros((n, BINS), bool)
    if len(s):
        bins = (s >> np.uint64(55)).astype(np.int64)
        first = np.ones(len(s), bool)
        first[1:] = (bins[1:] != bins[:-1]) | (row[1:] != row[:-1])
        out[row[first], bins[first]] = s[first]
        filled[row[first], bins[first]] = True
    some = filled.any(1)
    r, c = np.nonzero(~filled & some[:, None])
    for t in range(_TRIES):
        if not len(r):
            break
        source = _ORDER[c, t]
        ok = filled[r, source]
        out[r[ok], c[ok]] = out[r[ok], source[ok]]
        r, c = r[~ok], c[~ok]
    if len(r):
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        for a, b in zip(starts, [*starts[1:], len(r)], strict=True):
            own = np.flatnonzero(filled[r[a]])
            out[r[a], c[a:b]] = out[r[a], own[_RANK[c[a:b]][:, own].argmin(1)]]
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    rows = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    h = np.zeros((len(sig), BANDS), np.uint64)
    for j in range(ROWS):
        h = mix(h + rows[:, :, j] * _ODD[j])
    return mix(h + np.arange(1, BANDS + 1, dtype=np.uint64))


def _sketch(sig: np.ndarray) -> np.ndarray:
    column = mix(np.arange(1, 64 * SKETCH_LONGS + 1, dtype=np.uint64))
    bits = (mix(sig[:, : 64 * SKETCH_LONGS] ^ column) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def signed(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_id, s0..s3 and bands of every row; without shingles the last are null."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = [f"s{i}" for i in range(SKETCH_LONGS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            ids = batch.column("doc_id")
            for a, n, row, s in shingle_sets(batch.column("text"), k):
                count = np.bincount(row, minlength=n)
                ends = np.cumsum(count)
                data = s.tobytes()
                digest = [hashlib.blake2b(data[8 * (e - c) : 8 * e], digest_size=16).digest() if c else None for c, e in zip(count.tolist(), ends.tolist(), strict=True)]
                sig = signatures(row, s, n)
                none = count == 0
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(_bands(sig).view(np.int64).ravel()))
                sketch = [pa.array(x, mask=none) for x in _sketch(sig).view(np.int64).T.copy()]
                yield pa.RecordBatch.from_arrays([ids.slice(a, n), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), *sketch, bands], ["doc_id", "n_shingles", "set_id", *names, "bands"])

    schema = f"doc_id {kind}, n_shingles long, set_id binary, {', '.join(f'{x} long' for x in names)}, bands array<long>"
    return bounded(documents).select("doc_id", "text").mapInArrow(run, schema)


def _alike(a: Column, b: Column, percent: int) -> Column:
    """What the facts of a pair at the threshold must show before its sets are read."""
    agree = sum((F.bit_count(a[f"s{i}"].bitwiseXOR(b[f"s{i}"])) for i in range(SKETCH_LONGS)), F.lit(0))
    x, y = a["n_shingles"], b["n_shingles"]
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & ((F.least(x, y) < SKETCH_FROM) | (64 * SKETCH_LONGS - agree >= SKETCH_AGREE))


def _links(a: pa.Array, b: pa.Array, k: int, percent: int) -> np.ndarray:
    """Which rows of two text columns are links, on the shingles themselves.

    Hashes stand for shingles only where ``exact`` found that equal hashes come from equal words here.
    """
    n = len(a)
    raw, offsets = column_bytes(pa.concat_arrays([a, b]))
    if exact(raw, offsets, k):
        h, row, _, _ = words(raw, offsets)
        s, r = shingles(h, row, 2 * n, k)
    else:
        number: dict[tuple[str, ...], int] = {}
        texts = [bytes(raw[x:y]).translate(_LOWER_ASCII).split() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        grams = [(i, tuple(w[j : j + k])) for i, w in enumerate(texts) if w for j in range(max(1, len(w) - k + 1))]
        s = np.array([number.setdefault(g, len(number)) for _, g in grams], np.uint64)
        r = np.array([i for i, _ in grams], np.int64)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[new], r[new]
    size = np.bincount(r, minlength=2 * n)
    order = np.lexsort((s, r % n))
    s, r = s[order], r[order] % n
    shared = np.bincount(r[1:][(s[1:] == s[:-1]) & (r[1:] == r[:-1])], minlength=n)
    return (100 * shared >= percent * (size[:n] + size[n:] - shared)) & (shared > 0)


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids with 100 * intersection >= percent * union, on full sets."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            offsets = [column_bytes(batch.column(c))[1] for c in ("text_a", "text_b")]
            links = [np.zeros(0, bool)]
            # The same few rows of both columns at a time, so only their sets are held.
            for lo, hi in pieces(offsets[0] + offsets[1]):
                links.append(_links(*(batch.column(c).slice(lo, hi - lo) for c in ("text_a", "text_b")), k, percent))
            keep = pa.array(np.concatenate(links))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in undirected ``edges`` (a, b); component is its smallest id.

    Large and small stars alternate until the edges stay as they are, in about
    log n rounds; a hub's edges meet as partial minima, never in one list.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    seen = None
    while True:
        # Large star: neighbours that are larger than u get the smallest id around u.
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours of u, and u, get the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "star")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (id, component) after more ``edges`` (a, b): only these, between components, are worked off."""
    ends = edges
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(c, F.coalesce(f"c{c}", c))
    new = components(ends.select("a", "b").where("a <> b").distinct())
    moved = labels.join(new.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return materialize(moved.unionByName(new), "minhash-labels")


def _confirmed(likely: DataFrame, texts: DataFrame, k: int, percent: int, broadcast_ids: int) -> DataFrame | None:
    """The pairs (a, b) that are links, None if none is; only texts of these pairs are read."""
    n = likely.count()
    if not n:
        return None
    ends = likely.select(F.explode(F.array("a", "b")).alias("id"))
    ends = F.broadcast(ends) if 2 * n <= broadcast_ids else ends.distinct()
    wanted = materialize(texts.join(ends, "id", "left_semi"), "minhash-texts")
    found = materialize(confirm(likely, wanted, k, percent), "minhash-edges")
    return None if found.isEmpty() else found


def prefix_pairs(nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes (id, component, facts) across components, among them every link.

    Sets at the threshold share at least ``percent / (100 + percent)`` of their summed sizes, so in one
    order of all shingles, rare ones first, they share one of the first that each has beyond that.
    """
    kind = nodes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            ids = batch.column("id")
            for a, n, row, s in shingle_sets(batch.column("text"), k):
                yield pa.RecordBatch.from_arrays([ids.slice(a, n).take(pa.array(row)), pa.array(s.view(np.int64))], ["id", "h"])

    wanted = texts.join(nodes.select("id"), "id", "left_semi").select("id", "text")
    each = materialize(wanted.mapInArrow(run, f"id {kind}, h long"), "minhash-shingles")
    # A shingle of one set alone joins nothing; it only takes a place before the others.
    often = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    first = each.join(often, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("hs")).join(nodes, "id")
    size = F.col("facts.n_shingles")
    posts = first.select("id", "component", "facts", size.alias("size"), (size - F.size("hs") + 1).alias("before"), F.posexplode("hs").alias("i", "x"))
    posts = posts.select("id", "component", "facts", "size", F.col("x.h").alias("h"), (F.col("before") + F.col("i")).alias("place"))
    posts = materialize(posts.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1), "minhash-prefixes")
    x, y = posts.alias("x"), posts.alias("y")
    shared = F.ceil((F.col("x.size") + F.col("y.size")) * percent / (100 + percent))
    both = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.place") <= F.col("x.size") - shared + 1) & (F.col("y.place") <= F.col("y.size") - shared + 1) & _alike(F.col("x.facts"), F.col("y.facts"), percent))
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_duplicates(documents: DataFrame, *, k: int = 4, percent: int = 80, broadcast_ids: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; see the module."""
    rows = materialize(signed(documents, k), "minhash")
    nameless = rows.where("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = rows.where("doc_id IS NOT NULL")
    nodes = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("id"))
    facts = ["n_shingles", *(f"s{i}" for i in range(SKETCH_LONGS))]
    nodes = rows.join(nodes, (rows.set_id == nodes.set_id) & (rows.doc_id == nodes.id)).select("id", F.struct(*facts).alias("facts"), "bands").dropDuplicates(["id"])
    nodes = materialize(nodes, "minhash-nodes")
    banded = nodes.select("id", F.explode("bands").alias("bucket"))

    # Members of the buckets that have any two; singletons end here.
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(banded.join(shared, "bucket").join(nodes.select("id", "facts"), "id"), "minhash-buckets")
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["id"])

    def likely(stars: DataFrame) -> DataFrame:
        """Distinct pairs of stars (hub, hub_facts, id, facts) that may be links."""
        return stars.where(_alike(F.col("hub_facts"), F.col("facts"), percent)).select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()

    tried = labels = None

    def link(pairs: DataFrame) -> None:
        """Confirms the pairs that were not proposed before and joins what they link."""
        nonlocal tried, labels
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "minhash-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = _confirmed(pairs, texts, k, percent, broadcast_ids)
        if found is not None:
            labels = components(found) if labels is None else merged(labels, found)

    def named(some: DataFrame) -> DataFrame:
        if labels is None:
            return some.withColumn("component", F.col("id"))
        return some.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))

    degree = members.groupBy("id").agg((-F.sum(F.col("n") - 1)).alias("meets"))
    first = members.join(degree, "id").groupBy("bucket").agg(F.min(F.struct("meets", "id", "facts")).alias("h"))
    stars = first.select("bucket", F.col("h.id").alias("hub"), F.col("h.facts").alias("hub_facts")).join(members, "bucket").where("id <> hub")
    # Members that are yet to meet others of their bucket, each with its place in the bucket's own order.
    left = materialize(stars.select("bucket", "hub", "hub_facts", "id", "facts", F.xxhash64("id", "bucket").alias("place")), "minhash-left")
    link(likely(left))
    left = left.select("bucket", "id", "facts", "place")
    for round_ in range(ROUNDS + 1):
        own = named(left)
        at = F.struct("place", "id", "component", "facts")
        hubs = own.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(at).alias("h0"), F.max(at).alias("h1")).where("x <> y").drop("x", "y")
        own = materialize(hubs.join(own, "bucket"), "minhash-open")
        if own.isEmpty():
            break
        if round_ == ROUNDS:
            link(prefix_pairs(own.select("id", "component", "facts").dropDuplicates(["id"]), texts, k, percent))
            break
        # A member is met only by hubs of other components that it may be linked with.
        open_ = F.filter(F.array("h0", "h1"), lambda h: (h["component"] != F.col("component")) & _alike(h["facts"], F.col("facts"), percent))
        stars = own.select("id", F.explode(F.transform(open_, lambda h: h["id"])).alias("hub"))
        link(stars.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct())
        left = own.where("id <> h0.id AND id <> h1.id").select("bucket", "id", "facts", "place")

    reps = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    reps = reps.withColumn("component", F.col("id")) if labels is None else reps.join(labels, "id", "left")
    reps = materialize(reps.select("set_id", F.coalesce("component", "id").alias("component_id"), "copies"), "minhash-sets")
    # The copies of a hot set find their component by a broadcast, the others by a join on the set.
    share = reps.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") * HOT_SHARE >= share
    hot, cold = F.broadcast(reps.where(is_hot).drop("copies")), reps.where(~is_hot).drop("copies")
    some = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "set_id")
    full = some.join(hot, "set_id").unionByName(some.join(hot, "set_id", "left_anti").join(cold, "set_id")).drop("set_id")
    none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(none).unionByName(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(documents: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which each group of near duplicates keeps its smallest doc_id."""
    kept = near_duplicates(documents, k=k, percent=percent).where("kept").select("doc_id").distinct()
    named = documents.join(kept, "doc_id", "left_semi").select(*documents.columns)
    return named.unionByName(documents.where("doc_id IS NULL"))
