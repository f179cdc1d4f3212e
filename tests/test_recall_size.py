"""Keyword recall against plain loops, in blocks of any size, and on many queries."""

import random
import re
import time

import pytest

from siltstone.operators import retrieval as rt

QUERY, RECORD = "query_id bigint, category string, query string", "id string, seq bigint, category string, title string, text string"


def by_loops(queries, memory, k):
    out = []
    for number, category, query in queries:
        terms = [t for t in re.split(r"[^a-z0-9_]+", (query or "").lower()) if len(t) > 3]
        own = [(-sum(t in " ".join(x for x in r[3:] if x is not None).lower() for t in terms), r[1], r[0]) for r in memory if category is not None and r[2] == category]
        out += [(number, i, -score, place) for place, (score, _, i) in enumerate(sorted(x for x in own if x[0])[:k], 1)]
    return sorted(out)


def found(spark, queries, memory, k=3):
    got = rt.keyword_recall(spark.createDataFrame(queries, QUERY), spark.createDataFrame(memory, RECORD), k)
    return sorted((r.query_id, r.id, r.score, r.place) for r in got.collect())


@pytest.mark.parametrize("limits", [{}, {"BLOCK_RECORDS": 7, "BLOCK_QUERIES": 5}, {"BLOCK_CHARS": 300, "ROW_BYTES": 100}, {"ROW_BYTES": 0}])
def test_blocks_and_rows_change_nothing(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(rt, name, value)
    rng = random.Random(5)
    words = ["leak", "leaks", "Leaked", "bleak", "lock_page", "unlock_pages", "page", "deadbeef", "beef", "a", "the", "größe", "ÜBER_lauf", "lauf", "x1234y", "1234", "don't", "cafés", "Kernel", "kernel"]
    said = lambda n: rng.choice([" ", ".", "-", "\n"]).join(rng.choices(words, k=rng.randrange(n)))
    categories = ["c", "c", "c", "d", "only", None]
    memory = [(f"m{i}", 2**53 + i, rng.choice(categories[:4] + [None, "unasked"]), rng.choice([None, said(4)]), rng.choice([None, said(12), said(12)])) for i in rng.sample(range(200), 120)]
    queries = [(i, rng.choice(categories), rng.choice([None, "", said(6), said(6), said(6)])) for i in range(60)] + [(60, "c", "leak " * 300 + "page"), (61, "c", "leak")]
    want = by_loops(queries, memory, 3)
    assert len(want) > 60 and found(spark, queries, memory) == want
    assert found(spark, queries, memory, 500) == by_loops(queries, memory, 500)
    assert found(spark, queries, [m for m in memory if m[2] is None]) == []


def test_many_queries_of_one_category_take_seconds(spark):
    rng = random.Random(6)
    words = [f"word{i}_{rng.randrange(10**6)}" for i in range(2_000)]
    some = words[:40]  # in very many records
    memory = [(f"m{i}", i, "c", " ".join(rng.sample(some, 3)), " ".join(rng.choices(words, k=50))) for i in range(12_000)]
    queries = [(i, "c", " ".join([*rng.sample(some, 2), *rng.choices(words, k=4)])) for i in range(3_000)]
    q, m = spark.createDataFrame(queries, QUERY), spark.createDataFrame(memory, RECORD)
    began = time.perf_counter()
    got = sorted((r.query_id, r.id, r.score, r.place) for r in rt.keyword_recall(q, m).collect())
    assert time.perf_counter() - began < 45  # every pair by itself: minutes
    assert len(got) == 9_000 and [r for r in got if r[0] in (0, 1_500, 2_999)] == by_loops([queries[i] for i in (0, 1_500, 2_999)], memory, 3)
