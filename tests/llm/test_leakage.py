import random
import re

from siltstone import session
from siltstone.llm import leakage

DOCS, ITEMS = "doc_id bigint, text string, words string, shingle string", "item_id bigint, text string, words string"


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def brute(docs, items, run=12):
    windows = {}
    for i, text, _ in items:
        w = words(text)
        for k in range(len(w) - run + 1):
            windows.setdefault(tuple(w[k : k + run]), set()).add(i)
    return {(d, i) for d, text, *_ in docs if d is not None for k in range(len(words(text)) - run + 1) for i in windows.get(tuple(words(text)[k : k + run]), ()) if i is not None}


def run(spark, docs, items):
    got = [tuple(r) for r in leakage.leaked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(rng):
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40))), "") for i in range(25)]
    docs = []
    for d in range(150):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            w = words(rng.choice(items)[1])
            n = rng.choice([11, 12, 13, 30])
            at = rng.randrange(max(1, len(w) - n + 1))
            part = w[at : at + n]
            if rng.random() < 0.2 and len(part) > 4:
                part[rng.randrange(len(part))] = "changed"
            text[len(text) // 2 : len(text) // 2] = part
        docs.append((d, rng.choice([" ", "\r\n", " ** ", "_"]).join(w.upper() if rng.random() < 0.3 else w for w in text), "", ""))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = made(random.Random(1))
    want = brute(docs, items)
    assert run(spark, docs, items) == want and len(want) > 30


def test_equals_brute_force_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    docs, items = made(random.Random(2))
    assert run(spark, docs, items) == brute(docs, items)


def test_nulls_repeats_and_exact_bounds(spark):
    text = " ".join(f"t{i}" for i in range(12))
    items = [(1, text, ""), (1, text, ""), (1, "other " * 12, ""), (2, None, ""), (3, "", ""), (None, text, ""), (4, "x" * 100_000, "")]
    docs = [(1, text, "", ""), (1, text, "", ""), (2, text[:-1], "", ""), (3, None, "", ""), (4, "", "", ""), (None, text, "", ""), (5, "pad " * 50_000 + text.replace(" ", "\n> "), "", ""), (6, "other " * 12, "", "")]
    assert run(spark, docs, items) == {(1, 1), (5, 1), (6, 1)}
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()


def test_most_documents_are_copies(spark):
    text = "before " + " ".join(f"t{i}" for i in range(20)) + " after"
    docs = [(i, text, "", "") for i in range(500)] + [(500, "nothing here " * 10, "", "")]
    assert run(spark, docs, [(7, " ".join(f"t{i}" for i in range(14)), "")]) == {(i, 7) for i in range(500)}
