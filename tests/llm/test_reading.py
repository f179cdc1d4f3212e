from pathlib import Path

import pytest

from siltstone.llm.reading import occurrences, reading_levels

DOCS, SAMPLES = "doc_id bigint, text string, lang string, doc_kind string, items string, place int", "sample_id bigint, rater string, band int, text string"
DATA = Path("/root/testdata/sf0.001/level_samples.parquet")


def samples():
    import pyarrow.parquet as pq

    return [(r["sample_id"], r["rater"], r["band"], r["text"]) for r in pq.read_table(DATA).to_pylist()]


def docs(rows):
    return [(i, t, "en", "guideline", "clash", 0) for i, t in rows]


@pytest.mark.skipif(not DATA.exists(), reason="no samples")
def test_held_out_accuracy(spark):
    rated = samples()
    own = sorted(r for r in rated if r[1] == "rater-a")
    held = own[::2]
    left = [r for r in rated if r[0] not in {h[0] for h in held}]
    got = reading_levels(spark.createDataFrame(docs([(r[0], r[3]) for r in held]), DOCS), spark.createDataFrame(left, SAMPLES))
    band = {r.doc_id: r.band for r in got.collect()}
    right = sum(band[r[0]] == r[2] for r in held)
    assert set(band) == {r[0] for r in held} and right >= 0.88 * len(held) and all(abs(band[r[0]] - r[2]) <= 1 for r in held)


@pytest.mark.skipif(not DATA.exists(), reason="no samples")
def test_who_gets_a_row(spark):
    rated = samples()
    easy = next(r[3] for r in rated if r[2] == 1 and r[1] == "rater-a")
    rows = docs([(1, easy), (2, None), (3, ""), (4, "123 ..."), (5, "zzyzx qwrtp"), (6, easy + " " + easy * 200), (None, easy), (1, easy)])
    rows += [(7, easy, "de", "guideline", "", 0), (8, easy, None, "guideline", "", 0), (9, easy, "en", "commit_message", "", 0), (10, easy, "en", None, "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = [(r.doc_id, r.band) for r in reading_levels(df, spark.createDataFrame(rated, SAMPLES)).collect()]
    assert len(got) == len(set(got)) and {d for d, _ in got} == {1, 5, 6} and dict(got)[1] == 1 and dict(got)[5] == 3
    assert {r.band for r in reading_levels(df, spark.createDataFrame([], SAMPLES)).collect()} == {None}
    assert reading_levels(df.limit(0), spark.createDataFrame(rated, SAMPLES)).count() == 0


def test_code_headings_and_identifiers_are_aside():
    text = "# Big Title Words\n\nWe read one page.\n```cpp\nint hidden(int secret) { return 1; }\n```\n* Look at `fold_entry` in src/x.cpp (see v1.2.3) now.\n~~~\nopen fence stays code"
    found = occurrences(text)
    assert found["page"] == 1 and found["look"] == 1 and found["now"] == 1
    assert found["title"] == 1 and found["see"] == 1  # headings and what stands in parentheses are prose; a heading is no sentence
    assert not {"hidden", "secret", "fold", "entry", "src", "stays"} & set(found)
    assert sum(n for w, n in found.items() if w[0] == "#") == 2


def test_long_runs_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("=" * 300_000, "a" * 300_000, "(" * 300_000, " " * 300_000 + "x", "word " * 60_000 + "x_y"):
        occurrences(text)
    assert time.perf_counter() - began < 10
