"""Sharding by bytes: a minimax contiguous partition of ordered atomic groups.

Groups are equal texts, ordered by the SHA-256 of the text; a group never
crosses shards.  The smallest capacity with which ``n_shards`` contiguous runs
hold all groups is found by binary search, each trial checked greedily.

The search never sees all groups at once.  It runs over *items* in key order:
hash-prefix buckets with their total and largest group.  Inside a bucket a cut is only known to
an interval, so a trial answers feasible, infeasible or open; the buckets that
an open trial's cuts may fall into are replaced by finer buckets (one
aggregation each round) until no trial is open.  The driver holds at most about
``2 * items`` numbers in any round, whatever the table's size.

Cases: a null text counts as an empty one (size 1, crc 0, one group with the
empty texts).  Repeated texts and doc_ids keep one row each.  An empty table
gives no rows.  A hot group is dealt over ``salts`` parts before rows are
numbered.  Only doc_id and text of ``documents`` are read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.plans.durable import materialize

KEY_HEX = 64


class Items:
    """Buckets in key order, each with its bytes, number of groups and largest group."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(r[1] for r in self.rows))
        self.total = self.ends[-1] if self.ends else 0

    def fill(self, start: int, capacity: int) -> tuple[int, int, int]:
        """(least, most, item) that a run from ``start`` may reach; item is the one it ends in, or -1."""
        x = start + capacity
        if x >= self.total:
            return self.total, self.total, -1
        i = bisect_right(self.ends, x)
        begin = self.ends[i] - self.rows[i][1]
        if self.rows[i][2] == 1:
            return begin, begin, -1
        return max(begin, x - self.rows[i][3] + 1), x, i

    def trial(self, capacity: int, n: int) -> bool | None:
        """Whether ``n`` runs suffice: True, False, or None where the items are too coarse to tell."""
        low = high = 0
        for _ in range(n):
            low, high = self.fill(low, capacity)[0], self.fill(high, capacity)[1]
        return True if low >= self.total else None if high >= self.total else False

    def bounds(self, n: int, least: int, most: int) -> tuple[int, int]:
        """(largest capacity known to fail, smallest known to do) by binary search within [least, most]."""

        def first(ok) -> int:
            a, b = least, most
            while a < b:
                m = (a + b) // 2
                a, b = (a, m) if ok(self.trial(m, n)) else (m + 1, b)
            return a

        return first(lambda t: t is not False) - 1, first(lambda t: t is True)

    def open_items(self, n: int, fails: int, does: int) -> list[str]:
        """Prefixes of the buckets that cuts may fall into for any capacity in (fails, does]."""
        found: set[int] = set()
        low = high = 0
        for _ in range(n):
            a, b = low + fails + 1, high + does
            for i in range(bisect_right(self.ends, a), min(bisect_right(self.ends, b), len(self.rows) - 1) + 1):
                if self.rows[i][2] > 1:
                    found.add(i)
            low, high = self.fill(low, fails + 1)[0], self.fill(high, does)[1]
        return [self.rows[i][0] for i in sorted(found)]

    def cuts(self, n: int, capacity: int) -> list[int]:
        """Where the greedy runs end, in bytes; exact once no trial is open."""
        out, at = [], 0
        for _ in range(n):
            at = self.fill(at, capacity)[0]
            out.append(at)
        return out


def search(groups: DataFrame, n_shards: int, items: int = 1 << 16) -> tuple[int, list[str]]:
    """(smallest capacity, first key of shards 1 and on) of ``groups`` with columns key and bytes.

    The list is shorter where fewer shards hold everything.
    """

    def histogram(prefix_hex: int, inside: list[str] | None, outer_hex: int) -> list[tuple]:
        df = groups
        if inside is not None:
            spark = groups.sparkSession
            wanted = spark.createDataFrame([(p,) for p in inside], "p string")
            df = df.withColumn("p", F.substring("key", 1, outer_hex)).join(F.broadcast(wanted), "p", "left_semi")
        got = df.groupBy(F.substring("key", 1, prefix_hex).alias("p")).agg(F.sum("bytes"), F.count("*"), F.max("bytes"))
        return [tuple(r) for r in got.collect()]

    width = max(1, (items.bit_length() - 1) // 4)
    view = Items(histogram(width, None, 0))
    if not view.total:
        return 0, []
    largest = max(r[3] for r in view.rows)
    least = max(largest, -(-view.total // n_shards))
    fails, does = view.bounds(n_shards, least, least + largest)
    while True:
        todo = view.open_items(n_shards, fails, does) if does - fails > 1 else []
        todo = todo or _inexact(view, n_shards, does)
        if not todo or width >= KEY_HEX:
            break
        width = min(KEY_HEX, width + max(1, ((items // len(todo)).bit_length() - 1) // 4))
        by_width = {len(p): [q for q in todo if len(q) == len(p)] for p in todo}
        fresh = [r for w, ps in by_width.items() for r in histogram(width, ps, w)]
        gone = set(todo)
        view = Items([r for r in view.rows if r[0] not in gone] + fresh)
        fails, does = view.bounds(n_shards, max(least, fails + 1), does)
    ends = view.cuts(n_shards, does)
    starts = []
    for e in ends[:-1]:
        if e >= view.total:
            break
        starts.append(view.rows[bisect_right(view.ends, e)][0])
    return does, starts


def _inexact(view: Items, n: int, capacity: int) -> list[str]:
    """Buckets that a cut of the chosen capacity falls into."""
    found, at = [], 0
    for _ in range(n):
        at, _, i = view.fill(at, capacity)
        if i >= 0:
            return [*found, view.rows[i][0]]
    return found


def shard_documents(documents: DataFrame, n_shards: int = 16, *, items: int = 1 << 16, salts: int = 64, bucket_hex: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce("text", F.lit(""))
    docs = materialize(
        documents.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("key"),
            F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(salts)).cast("int").alias("salt"),
        ),
        "shard-docs",
    )
    parts = materialize(docs.groupBy("key", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-parts")
    _, starts = search(parts.groupBy("key").agg(F.sum("bytes").alias("bytes")), n_shards, items)

    def shard(key: Column) -> Column:
        out = F.lit(0)
        for s in starts:
            out = out + (key >= s).cast("int")
        return out

    # Slots: rows before the bucket in its shard, then before the part in its bucket, then within the part.
    parts = parts.select("key", "salt", "n", shard(F.col("key")).alias("shard"), F.substring("key", 1, bucket_hex).alias("bucket"))
    buckets = parts.groupBy("shard", "bucket").agg(F.sum("n").alias("m"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("shard", "bucket", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    offsets = parts.join(F.broadcast(buckets), ["shard", "bucket"]).select("key", "salt", "shard", (F.col("before") + F.col("earlier")).alias("offset"))
    own = Window.partitionBy("key", "salt").orderBy("doc_id")
    return docs.join(offsets, ["key", "salt"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.row_number().over(own) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
