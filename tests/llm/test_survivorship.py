import random

from siltstone.llm.survivorship import finding_survivors

SCHEMA = (
    "case_id string, id string, finding_seq bigint, severity string, confidence double, suggested_patch string, evidence array<struct<ev_type:string,ev_ref:string>>, created_at timestamp, "
    "_best string, finding_id string"
)
RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def order(r):
    _, _, seq, severity, confidence, patch, evidence, created, *_ = r
    usable = confidence if confidence is not None and 0 <= confidence <= 1 else -1
    return (RANK.get((severity or "").strip().lower(), 9), -usable, not (patch or "").strip(), -len(set(evidence or [])), -(created.timestamp() if created else 0), seq)


def brute(rows):
    groups = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and r[2] is not None:
            groups.setdefault((r[0], r[1]), {})[r[2]] = r
    out = set()
    for key, of in groups.items():
        if len(of) > 1:
            best = sorted(of.values(), key=order)
            patched = [r for r in best if (r[5] or "").strip()]
            out.add((*key, best[0][2], patched[0][2] if patched else -1))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in finding_survivors(df).select("case_id", "finding_id", "best_seq", "patch_seq").collect()}


def test_equals_brute_force_with_nulls_ties_and_repeats(spark):
    from datetime import datetime

    rng = random.Random(3)
    rows = []
    for seq in range(400):
        evidence = rng.choice([None, [], [("code", "a")], [("code", "a"), ("code", "a")], [("code", "a"), ("code", "b")]])
        rows.append(
            (rng.choice(["c", "d", None]), rng.choice(["x", "y", "z", None]), rng.choice([seq, seq, None]), rng.choice([" High", "HIGH ", "low", "?", None, ""]), rng.choice([None, 0.5, 0.9, 2.0, float("nan")]),
             rng.choice([None, "", " \n", "fix"]), evidence, rng.choice([None, datetime(2025, 1, rng.randint(1, 3))]), "clash", "clash")
        )
    rows += rows[:50]
    assert run(spark, rows) == brute(rows)


def test_single_rows_repeats_and_empty_table(spark):
    one = ("c", "x", 1, "low", 0.5, None, None, None, "", "")
    assert run(spark, [one, one]) == set()
    assert run(spark, []) == set()


def test_one_group_with_most_rows(spark):
    rows = [("c", "hot", i, "low", 0.5, "p" if i == 700 else None, None, None, "", "") for i in range(2000)]
    assert run(spark, rows) == {("c", "hot", 700, 700)}


def test_values_come_field_by_field(spark):
    rows = [("c", "x", 1, "critical", None, None, None, None, "", ""), ("c", "x", 2, "low", 0.9, "p" * 100_000, [("code", "a")], None, "", "")]
    r = finding_survivors(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    assert (r.best_seq, r.severity, r.confidence, r.patch_seq, len(r.patch), r.evidence_seq) == (1, "critical", 0.9, 2, 100_000, 2)
