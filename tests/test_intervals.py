from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siltstone.operators.intervals import spans_and_gaps

SCHEMA = "k string, line int, end_line int, noise string"


def brute(rows):
    out = set()
    for key in {r[0] for r in rows if r[0] is not None}:
        covered = set()
        for k, a, b, _ in rows:
            if k == key and a is not None:
                b = a if b is None else b
                covered |= set(range(min(a, b), max(a, b) + 1))
        lines, spans = sorted(covered), []
        for x in lines:
            if spans and spans[-1][1] == x - 1:
                spans[-1][1] = x
            else:
                spans.append([x, x])
        out |= {(key, "span", a, b) for a, b in spans}
        out |= {(key, "gap", p[1] + 1, q[0] - 1) for p, q in zip(spans, spans[1:])}
    return out


def run(spark, rows, width=7):
    got = spans_and_gaps(spark.createDataFrame(rows, SCHEMA), ["k"], "line", "end_line", bucket_width=width).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


line = st.one_of(st.none(), st.integers(-5, 60))
rows = st.lists(st.tuples(st.sampled_from(["a", "b", None]), line, line, st.just("x")), max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_equals_brute_force(spark, data):
    assert run(spark, data) == brute(data)


def test_touching_nested_reversed_and_lone(spark):
    data = [("a", 1, 5, ""), ("a", 6, 9, ""), ("a", 20, 12, ""), ("a", 14, 15, ""), ("b", 0, None, ""), ("c", None, 4, "")]
    assert run(spark, data) == {("a", "span", 1, 9), ("a", "gap", 10, 11), ("a", "span", 12, 20), ("b", "span", 0, 0)}


def test_one_entity_with_most_rows(spark):
    data = [("hot", i % 50 * 3, None, "") for i in range(3000)] + [("b", 1, 2, "")]
    got = run(spark, data, width=16)
    assert got == brute(data) and len(got) == 50 + 49 + 1


def test_empty_table(spark):
    assert run(spark, []) == set()
