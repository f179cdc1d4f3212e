import random
import re

from siltstone.llm.neardup import finding_duplicates

SCHEMA = "finding_seq bigint, file string, title string, rationale string, id string, place string"
VOCABULARY = [f"w{i}" for i in range(400)]


def runs(title, rationale):
    words = re.findall(r"[a-z0-9_]+", f"{title or ''} {rationale or ''}".lower())
    return None if len(words) < 20 else set(zip(words, words[1:], words[2:]))


def brute(rows, least=0.6):
    seen = {r[0]: (r[1].strip().removeprefix("./"), runs(r[2], r[3])) for r in rows if r[0] is not None and r[1] is not None}
    seen = sorted((k, *v) for k, v in seen.items() if v[1])
    return {(a, b) for i, (a, pa, x) in enumerate(seen) for b, pb, y in seen[i + 1 :] if pa == pb and len(x & y) >= least * len(x | y)}


def texts(rng, n, edits):
    base = [rng.choice(VOCABULARY) for _ in range(60)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], [rng.choice(VOCABULARY)], [words[i], rng.choice(VOCABULARY)]])
        out.append(" ".join(words))
    return out


def make(rng):
    rows = []
    for g in range(40):
        for t in texts(rng, 4, 6):
            rows.append((len(rows), rng.choice(["src/a.c", "./src/a.c ", "b.go"]), rng.choice(["Title", None]), t, "x", "y"))
    return rows


def pairs(spark, rows):
    got = [tuple(r) for r in finding_duplicates(spark.createDataFrame(rows, SCHEMA)).pairs().collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def test_recall_against_brute_force_and_no_false_pair(spark):
    rows = make(random.Random(5))
    want, got = brute(rows), pairs(spark, rows)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 60


def test_copies_form_a_class_and_all_their_pairs_come_out(spark):
    text = " ".join(VOCABULARY[:30])
    near = " ".join([*VOCABULARY[:29], "other"])
    rows = [(i, "f", "T", text, "", "") for i in range(60)] + [(100, "f", "T", near, "", ""), (101, "f", "T", near, "", ""), (102, "g", "T", text, "", "")]
    assert pairs(spark, rows) == brute(rows)
    found = finding_duplicates(spark.createDataFrame(rows, SCHEMA)).membership().collect()
    assert {r.id: (r.class_id, r.n_links) for r in found if r.id in (0, 59, 101, 102)} == {0: (0, 1), 59: (0, 1), 101: (100, 1), 102: (102, 0)} and len(found) == 63


def test_nulls_short_long_and_repeated_rows(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [
        (1, "f", None, None, "", ""), (2, "f", "", " ", "", ""), (3, "f", "a b", "c", "", ""), (None, "f", "t", long, "", ""), (4, None, "t", long, "", ""), (5, "f", "t", long, "", ""), (5, "f", "t", long, "", ""),
        (6, "f", None, "t " + long, "", ""), (7, "f", "T", long.upper() + " tail", "", ""),
    ]
    assert pairs(spark, rows) == {(5, 6), (5, 7), (6, 7)}


def test_empty_table(spark):
    assert pairs(spark, []) == set()
    assert finding_duplicates(spark.createDataFrame([], SCHEMA)).membership().count() == 0


def test_hot_forms_give_the_same_pairs(spark, monkeypatch):
    from siltstone.llm import neardup

    rng = random.Random(11)
    rows = make(rng) + [(1000 + i, "src/a.c", None, t, "x", "y") for i, t in enumerate(texts(rng, 60, 8))]
    usual = pairs(spark, rows)
    monkeypatch.setattr(neardup, "HOT_FORM", 3)
    assert pairs(spark, rows) == usual and len(usual & brute(rows)) >= 0.97 * len(brute(rows)) and usual <= brute(rows)


def test_run_sets_are_exact():
    from siltstone.llm.neardup import run_sets

    rng = random.Random(2)
    for run in (1, 3, 5):
        some = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["", "a"]
        keys, starts, n = run_sets(some, run)
        words = [t.split() for t in some]
        sets = [set(zip(*(w[k:] for k in range(run)))) for w in words]
        assert [b - a for a, b in zip(starts, starts[1:])] == [len(x) for x in sets]
        own = [set((keys[a:b] % n).tolist()) for a, b in zip(starts, starts[1:])]
        assert all(len(own[i] & own[j]) == len(sets[i] & sets[j]) for i in range(42) for j in range(42))
