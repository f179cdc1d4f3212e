"""Values and behaviours that must equal the ones users know, each by name."""

import pytest

from siltstone.operators import evaluation as ev
from siltstone.operators import findings as fi
from siltstone.operators import runtime as rt
from siltstone.operators import state as st
from siltstone.sources import files as fs


def test_guideline_files_in_order(spark, tmp_path):
    for name in ("STYLE.md", ".clang-tidy", "CONTRIBUTING", "CONTRIBUTING.md", "AGENTS.md", "CODING_GUIDELINES.md", "README.md"):
        (tmp_path / name).write_text(f"of {name}")
    names = ["CONTRIBUTING.md", "CONTRIBUTING", "AGENTS.md", "CODING_GUIDELINES.md", "STYLE.md", ".clang-tidy"]
    assert fs.guidelines(spark, str(tmp_path)).first().text == "\n\n".join(f"# {n}\nof {n}" for n in names)


def test_guidelines_gather_no_more_than_the_cut_leaves(spark):
    parts = spark.createDataFrame([(1, i, f"n{i}", "x" * (i % 7)) for i in range(3_000)] + [(2, 0, "a", "y" * 9_000), (2, 1, "b", "z")], "all int, place int, name string, text string")
    got = {r["all"]: r.text for r in fs.joined_guidelines(parts, ["all"], 400).collect()}
    whole = "\n\n".join(f"# n{i}\n" + "x" * (i % 7) for i in range(3_000))
    assert got[1] == whole[:400] + "\n... [truncated]" and got[2] == ("# a\n" + "y" * 9_000)[:400] + "\n... [truncated]"


@pytest.mark.parametrize(("status", "tries"), [(429, 5), (500, 5), (503, 5), (520, 5), (599, 5), (400, 1), (404, 1), (600, 1)])
def test_retries_of_statuses(status, tries):
    calls = []

    def call():
        calls.append(1)
        raise rt.HttpStatus(status)

    with pytest.raises(rt.HttpStatus):
        rt.with_retries(call, sleep=lambda s: None)
    assert len(calls) == tries


def test_body_has_the_suggestion(spark):
    row = (1, "a" * 12, "f.c", 0, "high", "Title", "memory", 0.8, "Why.", "Do this.", "x = 1;", [("line", "f.c:1")])
    schema = "seq int, id string, file string, line int, severity string, title string, category string, confidence double, rationale string, suggestion string, suggested_patch string, evidence array<struct<ev_type:string,ev_ref:string>>"
    r = fi.comment_body(spark.createDataFrame([row, (2, *row[1:9], None, None, None)], schema)).orderBy("seq").collect()
    assert "Suggestion: Do this." in r[0].body and r[0].body.index("Why.") < r[0].body.index("Do this.") < r[0].body.index("x = 1;") and r[0].line == 1
    assert "Suggestion" not in r[1].body


def test_answers_are_kept_on_disk(tmp_path):
    asked = []

    class Model:
        def chat(self, request):
            asked.append(request)
            return "answer"

    folder = str(tmp_path / "cache")
    assert rt.Cached(Model(), folder=folder).chat({"a": 1}) == "answer" == rt.Cached(Model(), folder=folder).chat({"a": 1}) and len(asked) == 1
    assert rt.Cached(Model(), folder=folder).chat({"a": 1, "schema": {}}) == "answer" and len(asked) == 2
    for f in (tmp_path / "cache").iterdir():
        f.write_text("{broken")
    assert rt.Cached(Model(), folder=folder).chat({"a": 1}) == "answer" and len(asked) == 3


def test_an_index_can_be_saved_over_itself(spark, tmp_path):
    folder, schemas = str(tmp_path / "index"), {"chunks": "id int", "vectors": "id int"}
    assert fs.load_index(spark, folder, schemas) is None
    fs.save_index(folder, chunks=spark.range(3).selectExpr("cast(id as int) id"))
    first = fs.load_index(spark, folder, schemas)
    fs.save_index(folder, chunks=first["chunks"].where("id > 0"))
    assert sorted(r.id for r in fs.load_index(spark, folder, schemas)["chunks"].collect()) == [1, 2] and first["chunks"].count() == 3
    assert fs.load_index(spark, folder, {"symbols": "id int"}) is None


def test_ancestors_over_lines_forks_and_merges(spark):
    edges = [(f"a{i}", f"a{i - 1}") for i in range(1, 40)] + [("b1", "a5"), ("b2", "b1"), ("m", "a39"), ("m", "b2"), ("n", "m"), ("o", "n"), ("q", "o"), ("q", "c9")] + [(f"c{i}", f"c{i - 1}") for i in range(1, 10)]
    up = {}
    for s, p in edges:
        up.setdefault(s, set()).add(p)

    def above(s):
        out, todo = set(), [s]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in out:
                    out.add(p)
                    todo.append(p)
        return out | {s}

    names = ["a0", "a3", "a5", "a6", "a39", "b1", "b2", "m", "n", "q", "c0", "c4", "c9", "nowhere"]
    pairs = [(h, x) for h in names for x in names]
    got = {tuple(r) for r in st.ancestor_pairs(spark.createDataFrame([*pairs, (None, "a0"), ("a0", None)], "head string, last string"), spark.createDataFrame([*edges, ("a0", None)], "sha string, parent string")).collect()}
    assert got == {(h, x) for h, x in pairs if x in above(h)}


def test_content_hashes_see_edits_of_equal_length(spark):
    rows = lambda t: spark.createDataFrame([(1, "f", "aa"), (2, "f", t)], "chunk_seq int, file string, digest string")
    hashes = [st.content_hashes(rows(t), ["file"]).first().hash for t in ("bb", "bc", "bb")]
    assert hashes[0] == hashes[2] != hashes[1]


def test_configurations_are_a_bounded_list(spark):
    cases = spark.createDataFrame([("c",), ("d",)], "case_id string")
    some = spark.createDataFrame([("x", "full"), ("y", "full"), ("z", "")], "id string, ablation string")
    assert ev.every_run(cases, some).count() == 4 and ev.every_run(cases, some.limit(0)).count() == 0
    with pytest.raises(ValueError, match="more than"):
        ev.every_run(cases, spark.range(200).selectExpr("cast(id as string) ablation"))


def test_diff_source_precedence(spark, tmp_path):
    (tmp_path / "d.patch").write_text("diff")
    said = lambda args: " ".join(args)
    assert fs.diff_text(spark, str(tmp_path / "d.patch"), "a..b", "main", said) == "diff"
    assert fs.diff_text(spark, None, "a..b", "main", said).endswith("--unified=3 a..b") and fs.diff_text(spark, base="main", run=said).endswith("main...HEAD") and fs.diff_text(spark, run=said).endswith(" HEAD")
    with pytest.raises(ValueError):
        fs.diff_text(spark)
