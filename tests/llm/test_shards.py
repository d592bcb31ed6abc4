import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from rookery.llm.shards import Items, search, shard_documents


def smallest(sizes, n):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        m, k, s = (lo + hi) // 2, 1, 0
        for x in sizes:
            if s + x > m:
                k, s = k + 1, 0
            s += x
        lo, hi = (lo, m) if k <= n else (m + 1, hi)
    return lo


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 9), st.integers(1, 7))
def test_bounds_of_coarse_items_hold_the_optimum(sizes, n, group):
    rows = [(f"{i:04x}", sum(sizes[i : i + group]), len(sizes[i : i + group]), max(sizes[i : i + group])) for i in range(0, len(sizes), group)]
    view = Items(rows)
    fails, does = view.bounds(n, max(max(sizes), -(-sum(sizes) // n)), -(-sum(sizes) // n) + max(sizes))
    assert fails < smallest(sizes, n) <= does
    if group == 1:
        assert does == smallest(sizes, n) == fails + 1


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n long")


def check(rows, got, n):
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        b = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(n))
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in ordered]
    assert keys == sorted(keys)
    assert all(len({r.shard for r, k in zip(ordered, keys, strict=True) if k == x}) == 1 for x in set(keys))
    sizes = {}
    for r, k in zip(ordered, keys, strict=True):
        sizes[k] = sizes.get(k, 0) + r.size
    if sizes:
        assert max(sum(r.size for r in x) for x in by.values()) == smallest(list(sizes.values()), n)


def test_smallest_capacity_with_copies_and_a_hot_group(spark):
    rows = [(i, "hot text" if i % 3 == 0 else None if i % 50 == 1 else "" if i % 50 == 2 else f"text {i} " * (i % 17), i) for i in range(400)]
    for items in (16, 256, 1 << 16):
        check(rows, shard_documents(docs(spark, rows), 16, items=items).collect(), 16)


def test_few_rows_and_none(spark):
    check([(1, "a", 1), (2, "a", 1)], shard_documents(docs(spark, [(1, "a", 1), (2, "a", 1)]), 16).collect(), 16)
    assert shard_documents(docs(spark, []), 16).collect() == []


def test_search_reports_the_capacity(spark):
    groups = spark.createDataFrame([(f"{i:02x}" + "0" * 62, 10 * i + 1) for i in range(40)], "key string, bytes long")
    assert search(groups, 5, items=16)[0] == smallest([10 * i + 1 for i in range(40)], 5)


def test_clashing_columns_are_left_alone(spark):
    docs = spark.createDataFrame([(i, "t" * (i % 5), "k", 1, 2, 3) for i in range(40)], "doc_id long, text string, key string, size int, shard int, slot int")
    rows = shard_documents(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(40)) and all(r["size"] == r.doc_id % 5 + 1 and 0 <= r.shard < 16 for r in rows)
