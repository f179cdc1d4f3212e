import pytest

from siltstone.operators import evaluation as ev

F_SCHEMA = "seq bigint, case_id string, ablation string, file string, line int, category string"
G_SCHEMA = "gt_seq bigint, case_id string, file string, line int, end_line int, category string"


def metrics(spark, findings, labels, **options):
    f = spark.createDataFrame([(i, "c", "a", *x) for i, x in enumerate(findings)], F_SCHEMA)
    g = spark.createDataFrame([(i, "c", *x) for i, x in enumerate(labels)], G_SCHEMA)
    runs = spark.createDataFrame([("c", "a")], "case_id string, ablation string")
    r = ev.case_metrics(f, g, runs, **options).collect()[0]
    return r.true_positives, r.false_positives, r.false_negatives, r.localized


def test_within_tolerance_and_localized(spark):
    assert metrics(spark, [("f", 12, "memory")], [("f", 10, 15, "memory")]) == (1, 0, 0, 1)
    assert metrics(spark, [("f", 18, "memory")], [("f", 10, 15, "memory")]) == (1, 0, 0, 0)
    assert metrics(spark, [("f", 19, "memory")], [("f", 10, 15, "memory")]) == (0, 1, 1, 0)


def test_category_counts_only_if_asked(spark):
    assert metrics(spark, [("f", 12, "security")], [("f", 10, 15, "memory")]) == (0, 1, 1, 0)
    assert metrics(spark, [("f", 12, "security")], [("f", 10, 15, "memory")], by_category=False) == (1, 0, 0, 1)
    assert metrics(spark, [("f", 12, "security")], [("f", 10, 15, None)]) == (1, 0, 0, 1)


def test_ranges_of_a_file_are_one_defect_unless_taken_apart(spark):
    labels = [("f", 10, 11, "memory"), ("f", 50, 51, "memory")]
    assert metrics(spark, [("f", 10, "memory"), ("f", 50, "memory")], labels) == (1, 0, 0, 1)
    assert metrics(spark, [("f", 10, "memory")], labels, collapse=False) == (1, 0, 1, 1)


def test_first_finding_of_a_defect_decides_localization(spark):
    assert metrics(spark, [("f", 17, "memory"), ("f", 12, "memory")], [("f", 10, 15, "memory")]) == (1, 0, 0, 0)


def test_nothing_found_or_nothing_there(spark):
    assert metrics(spark, [], [("f", 1, 1, None)]) == (0, 0, 1, 0)
    assert metrics(spark, [("f", 1, "memory")], []) == (0, 1, 0, 0)


def test_rates_of_nothing(spark):
    m = spark.createDataFrame([("a", 0, 0, 0, 0)], "ablation string, true_positives bigint, false_positives bigint, false_negatives bigint, localized bigint")
    r = ev.rates(m, ["ablation"]).collect()[0]
    assert (r.recall, r.precision, r.f1, r.false_positives_per_case, r.localization_accuracy) == (1, 1, 1, 0, 0)


def test_interval_of_three_values(spark):
    r = ev.described(spark.createDataFrame([("a", 0.6), ("a", 0.7), ("a", 0.8), ("b", 0.5)], "k string, v double"), ["k"], "v").orderBy("k").collect()
    assert r[0].mean == pytest.approx(0.7) and r[0]["std"] == pytest.approx(0.1) and r[0].sem == pytest.approx(0.057735, abs=1e-6) and r[0].ci95 == pytest.approx(4.303 * 0.0577350, abs=1e-5)
    assert (r[1]["std"], r[1].ci95) == (0, 0)


def test_regressions_are_beyond_the_tolerance(spark):
    schema = "k string, recall double, precision double, f1 double, false_positives_per_case double"
    now = spark.createDataFrame([("a", 0.5, 0.98, 0.9, 2.5)], schema)
    before = spark.createDataFrame([("a", 0.6, 0.95, 0.8, 1.0)], schema)
    got = {r.metric: r.verdict for r in ev.regressions(now, before, ["k"]).collect()}
    assert got == {"recall": "regression", "precision": "same", "f1": "improvement", "false_positives_per_case": "regression"}
