"""Approximate nearest neighbours over sharded, robust-pruned directed graphs.

Vectors belong to the nearest of a number of centroids, fitted on a bounded sample
(``sample_rows``), and each cell is a shard; a cell of more than ``shard_rows`` vectors is dealt over
several shards by a hash of the vector, so no shard outgrows its task.  Each shard's graph is built by one task: greedy searches from the medoid
propose neighbours for a batch of points at a time, and robust pruning keeps at
most ``degree`` of them, dropping a candidate that lies ``alpha`` times nearer to
a kept one than to the point.  Edges are added in both directions and pruned
again where a point has too many.

A query is answered by beam search in all shards of its nearest cells; how many cells is
calibrated on the sample, as the number that holds ``cover`` of the true neighbours of sample
rows.  Queries travel in blocks.  The candidates of all shards are ranked by Euclidean distance
in double precision on the original vectors; only the walk through a graph is in single precision.

Equal vectors are one graph node.  Of their rows the ``k + 1`` smallest vec_ids are
kept, which loses nothing: ties go to the smaller vec_id, and one of them may be
the query.

Cases: vectors that are null, empty or zero, or hold null or non-finite
components, and rows of null vec_id, neither ask nor answer.  Vectors of different dimension are never
compared.  Every query row is answered by itself, also if others have its vec_id; its own row is one
row with its vec_id and its vector.  With fewer candidates than ``k`` all are returned; an empty table gives no rows; extra
columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.plans.durable import materialize

BATCH = 256


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, squared distances, expanded) of the beams of all rows of ``q``, side by side.

    ids are -1 where a beam is not full.  ``expanded`` has the node that each step
    expanded in each row, -1 for rows that were done.
    """
    m, n = len(q), len(x)
    beam = min(beam, n)
    square = np.einsum("ij,ij->i", x, x)
    own = np.einsum("ij,ij->i", q, q)
    ids = np.full((m, beam), -1, np.int32)
    dist = np.full((m, beam), np.inf, np.float32)
    open_ = np.zeros((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    seeds = np.arange(n) if n <= beam else np.array([start])
    ids[:, : len(seeds)] = seeds
    dist[:, : len(seeds)] = square[seeds] - 2 * q @ x[seeds].T + own[:, None]
    open_[:, : len(seeds)] = True
    seen[:, seeds] = True
    rows = np.arange(m)
    expanded: list[np.ndarray] = []
    while n > beam:
        key = np.where(open_, dist, np.inf)
        slot = key.argmin(1)
        live = np.isfinite(key[rows, slot])
        if not live.any():
            break
        node = np.where(live, ids[rows, slot], -1)
        expanded.append(node)
        open_[rows, slot] = False
        near = np.where(live[:, None], graph[node], n)
        near = np.where(near < 0, n, near)
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        d = np.full(near.shape, np.inf, np.float32)
        to = near[r, c]
        d[r, c] = square[to] - 2 * np.einsum("ij,ij->i", q[r], x[to]) + own[r]
        all_ids, all_dist, all_open = np.concatenate([ids, near.astype(np.int32)], 1), np.concatenate([dist, d], 1), np.concatenate([open_, fresh], 1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        ids, dist, open_ = (np.take_along_axis(v, best, 1) for v in (all_ids, all_dist, all_open))
        ids[~np.isfinite(dist)] = -1
        open_ &= ids >= 0
    return ids, dist, expanded


def robust_prune(x: np.ndarray, points: np.ndarray, cands: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours for each point out of its row of ``cands`` (-1: none)."""
    # One of each candidate, and never the point itself.
    cands = np.sort(np.where(cands == points[:, None], -1, cands), axis=1)
    cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = -1
    v = x[cands]
    d = np.where(cands >= 0, ((v - x[points][:, None]) ** 2).sum(2), np.inf)
    square = np.einsum("ijk,ijk->ij", v, v)
    out = np.full((len(points), degree), -1, np.int32)
    rows = np.arange(len(points))
    for j in range(degree):
        pick = d.argmin(1)
        ok = np.isfinite(d[rows, pick])
        if not ok.any():
            break
        out[ok, j] = cands[rows, pick][ok]
        between = np.maximum(square - 2 * np.einsum("ijk,ik->ij", v, v[rows, pick]) + square[rows, pick][:, None], 0)
        d[(alpha * alpha * between <= d) & ok[:, None]] = np.inf
        d[rows, pick] = np.inf
    return out


def build_graph(x: np.ndarray, *, degree: int = 24, beam: int = 48, alpha: float = 1.2, seed: int = 11) -> tuple[np.ndarray, int]:
    """(neighbours, start): a row of at most ``degree`` node numbers, -1 padded, for each vector."""
    n = len(x)
    rng = np.random.default_rng(seed)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin()) if n else 0
    graph = np.full((n, degree), -1, np.int32)
    if n <= 1:
        return graph, start
    first = rng.integers(0, n, (n, min(degree, 8)))
    first[first == np.arange(n)[:, None]] = -1
    graph[:, : first.shape[1]] = first
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            points = order[at : at + BATCH]
            ids, _, expanded = beam_search(x, graph, start, x[points], beam)
            cands = np.concatenate([ids, graph[points], *([np.stack(expanded, 1)] if expanded else [])], 1)
            new = robust_prune(x, points, cands, degree, a)
            graph[points] = new
            back, i = np.repeat(points, degree), new.ravel()
            back, to = back[i >= 0], i[i >= 0]
            by = np.argsort(to, kind="stable")
            back, to = back[by], to[by]
            targets, begin, count = np.unique(to, return_index=True, return_counts=True)
            width = int(count.max(initial=0))
            incoming = np.full((len(targets), width), -1, np.int32)
            incoming[np.repeat(np.arange(len(targets)), count), np.arange(len(to)) - np.repeat(begin, count)] = back
            for b in range(0, len(targets), BATCH):
                t = targets[b : b + BATCH]
                both = np.concatenate([graph[t], incoming[b : b + BATCH]], 1)
                both.sort(1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                many = (both >= 0).sum(1) > degree
                if many.any():
                    graph[t[many]] = robust_prune(x, t[many], both[many], degree, a)
                few = -np.sort(-both[~many], axis=1)[:, :degree]
                graph[t[~many], : few.shape[1]] = few
    return graph, start


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    big = float("inf")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (e < big) & (e > -big)) & F.exists(v, lambda e: e != 0)
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def _single(x: np.ndarray) -> np.ndarray:
    """Single precision for the walk through a graph; what it cannot hold is cut off there only."""
    return np.clip(x, -1e18, 1e18).astype(np.float32)


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, up to a term of each row."""
    return (centroids * centroids).sum(1) - 2 * x @ centroids.T


def fit_cells(x: np.ndarray, cells: int, *, k: int, cover: float, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, int]:
    """(centroids, how many nearest cells a query visits) from the sample ``x``."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(x) // 8))
    centroids = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds if cells > 1 else 0):
        own = np.concatenate([_squares(x[a : a + 4096], centroids).argmin(1) for a in range(0, len(x), 4096)])
        size = np.bincount(own, minlength=cells)
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(size)
        sums = np.add.reduceat(x[order], (np.cumsum(size) - size)[some], axis=0)
        centroids[some] = sums / size[some, None]
    if cells == 1:
        return centroids, 1
    own = np.concatenate([_squares(x[a : a + 4096], centroids).argmin(1) for a in range(0, len(x), 4096)])
    asked = rng.choice(len(x), min(256, len(x)), replace=False)
    square = (x * x).sum(1)
    d = square - 2 * x[asked] @ x.T
    d[np.arange(len(asked)), asked] = np.inf
    true = np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(_squares(x[asked], centroids), axis=1), axis=1)
    at = np.sort(np.take_along_axis(place, own[true], 1).ravel())
    return centroids, int(at[min(len(at) - 1, int(cover * len(at)))]) + 1


def _rows(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, their vectors) of each dimension in a batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, _matrix(batch.column("v").take(pa.array(at)), dim)


def index(vectors: DataFrame, *, k: int = 10, cell_rows: int = 8192, shard_rows: int = 16384, most_cells: int = 4096, sample_rows: int = 20_000, cover: float = 0.985, degree: int = 24, beam: int = 48, alpha: float = 1.2) -> tuple[DataFrame, DataFrame, dict]:
    """(one row per shard with its graph, vectors and vec_ids; number of shards of each cell; cells of each dimension)."""
    spark = vectors.sparkSession
    exact = "double" in vectors.schema["embedding"].dataType.simpleString()
    first = Window.partitionBy("v").orderBy("vec_id")
    rows = _rows(vectors).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("vec_id", "v", F.size("v").alias("dim"))
    rows = materialize(rows, "neighbour-rows")

    # A bounded sample tells where the cells of each dimension lie; a dimension that it does not show has one cell.
    n = rows.count()
    chosen = F.pmod(F.xxhash64(F.lit("cells"), "vec_id", "v"), F.lit(1 << 62)) < int((1 << 62) * min(1.0, sample_rows / max(n, 1)))
    sample = rows.where(chosen).select("dim", "v").toArrow()
    cells: dict[int, tuple[np.ndarray, int]] = {}
    dims = sample["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        x = _single(_matrix(sample["v"].take(pa.array(own)), dim))
        want = min(most_cells, math.ceil(n * len(own) / len(dims) / cell_rows))
        if want > 1 and len(own) >= 64:
            cells[dim] = fit_cells(x, want, k=k, cover=cover)
    sent = spark.sparkContext.broadcast({d: c for d, (c, _) in cells.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for dim, at, x in _by_dim(batch):
                if dim in sent.value:
                    cell[at] = _squares(_single(x), sent.value[dim]).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "v", "dim", "cell"])

    if cells:
        rows = materialize(rows.mapInArrow(place, "vec_id long, v array<double>, dim int, cell int"), "neighbour-cells")
    else:
        rows = rows.withColumn("cell", F.lit(0))
    shards = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    shards = materialize(shards, "neighbour-shards")
    rows = rows.join(shards, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int").alias("shard"), "vec_id", "v")

    def build(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        flat, ids = _matrix(table["v"], dim), table["vec_id"].to_numpy()
        order = np.lexsort((ids, *flat.T[::-1]))
        flat, ids = flat[order], ids[order]
        new = np.r_[True, (flat[1:] != flat[:-1]).any(1)]
        x = flat[new]
        graph, start = build_graph(np.ascontiguousarray(_single(x)), degree=degree, beam=beam, alpha=alpha)
        ends = np.r_[np.flatnonzero(new), len(ids)].astype(np.int64)
        out = {c: table[c].slice(0, 1).combine_chunks() for c in ("dim", "cell", "shard")}
        out["start"] = pa.array([start], pa.int32())
        for c, v in (("x", x if exact else x.astype(np.float32)), ("graph", graph), ("ids", ids), ("ends", ends)):
            out[c] = pa.array([v.tobytes()], pa.binary())
        return pa.table(out)

    built = rows.groupBy("dim", "cell", "shard").applyInArrow(build, "dim int, cell int, shard int, start int, x binary, graph binary, ids binary, ends binary")
    return materialize(built, "neighbour-graphs"), shards, cells


def search(graphs: DataFrame, shards: DataFrame, cells: dict, queries: DataFrame, *, k: int = 10, beam: int = 96, block_rows: int = 512, degree: int = 24) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found for each query."""
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(cells)
    # Rows alike in vec_id and vector get the same answer, once for each.
    asked = _rows(queries).groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.count("*").alias("copies"))
    asked = materialize(asked.select("query_id", F.xxhash64("v").alias("key"), "copies", F.size("v").alias("dim"), "v"), "neighbour-queries")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for dim, own, x in _by_dim(batch):
                if dim in sent.value:
                    centroids, visits = sent.value[dim]
                    near = np.argsort(_squares(_single(x), centroids), axis=1, kind="stable")[:, :visits]
                else:
                    near = np.zeros((len(own), 1), np.int64)
                at.append(np.repeat(own, near.shape[1]))
                cell.append(near.ravel())
            rows = batch.take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(cell).astype(np.int32))], ["query_id", "key", "dim", "v", "cell"])

    routed = asked.select("query_id", "key", "dim", "v").mapInArrow(route, "query_id long, key long, dim int, v array<double>, cell int")
    blocks = max(1, math.ceil(asked.count() / block_rows))
    block = F.pmod(F.xxhash64("query_id", "key"), F.lit(blocks)).cast("int")
    packed = routed.groupBy("dim", "cell", block.alias("block")).agg(F.collect_list(F.struct("query_id", "key", "v")).alias("asked"))
    packed = packed.join(shards, ["dim", "cell"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, t, i=i: np.frombuffer(batch.column(c)[i].as_py(), t)
                dim = batch.column("dim")[i].as_py()
                graph, ids, ends = get("graph", np.int32).reshape(-1, degree), get("ids", np.int64), get("ends", np.int64)
                blob = batch.column("x")[i].as_py()
                exact = np.frombuffer(blob, np.float64 if len(blob) == 8 * dim * len(graph) else np.float32).reshape(-1, dim)
                x = _single(exact)
                listed = batch.column("asked")[i].values
                q_ids, keys = listed.field("query_id").to_numpy(), listed.field("key").to_numpy()
                q = listed.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                out: list[list] = [[], [], [], []]
                for a in range(0, len(q), BATCH):
                    found, _, _ = beam_search(x, graph, batch.column("start")[i].as_py(), _single(q[a : a + BATCH]), beam)
                    for j, nodes in enumerate(found, a):
                        nodes = nodes[nodes >= 0]
                        size = ends[nodes + 1] - ends[nodes]
                        row = np.repeat(ends[nodes], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        d = np.sqrt(((exact[nodes].astype(np.float64) - q[j]) ** 2).sum(1))
                        same = np.repeat((exact[nodes] == q[j]).all(1), size)
                        cand, d = ids[row], np.repeat(d, size)
                        own = np.flatnonzero(same & (cand == q_ids[j]))[:1]
                        cand, d = np.delete(cand, own), np.delete(d, own)
                        best = np.lexsort((cand, d))[:k]
                        out[0].append(np.full(len(best), q_ids[j]))
                        out[1].append(np.full(len(best), keys[j]))
                        out[2].append(cand[best])
                        out[3].append(d[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "key", "vec_id", "score"])

    hits = graphs.join(packed, ["dim", "cell", "shard"]).select("dim", "start", "x", "graph", "ids", "ends", "asked").mapInArrow(run, "query_id long, key long, vec_id long, score double")
    nearest = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
    best = hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    best = best.join(asked.select("query_id", "key", "copies"), ["query_id", "key"])
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 10, **options) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``, both with vec_id and embedding."""
    graphs, shards, cells = index(vectors, k=k, **options)
    return search(graphs, shards, cells, queries, k=k)
