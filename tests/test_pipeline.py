import json
from pathlib import Path

import pytest

from siltstone.__main__ import main
from siltstone.sources.files import load_index, load_memory
from siltstone.operators import pipeline as pl

DATA = Path("/root/testdata/sf0.001")


def test_context_of_a_review(spark):
    diff = "diff --git a/a.c b/a.c\n@@ -1,1 +10,2 @@\n x\n+y\ndiff --git a/go.sum b/go.sum\n@@ -1 +1 @@\n+z\ndiff --git a/old.c b/old.c\ndeleted file mode 1\n@@ -1,2 +3,1 @@\n-x\n"
    symbols = spark.createDataFrame([("p", "a.c", "f", 5, 11), ("p", "a.c", "g", 12, 20), ("p", "old.c", "h", 1, 9)], "p string, file string, name string, start_line int, end_line int")
    signals = spark.createDataFrame([("p", "a.c", 14), ("p", "a.c", 15), ("q", "a.c", 11)], "p string, file string, line int")
    c = pl.review_context(spark.createDataFrame([("p", diff)], "p string, text string"), "p", symbols, signals)
    assert {r.file for r in c["hunks"].collect()} == {"a.c", "old.c"}
    assert [r.name for r in c["symbols"].collect()] == ["f"] and [r.line for r in c["signals"].collect()] == [14]


def test_review_of_findings(spark):
    schema = "seq bigint, case_id string, id string, file string, line int, rank int, severity string, confidence double"
    raw = spark.createDataFrame([(1, "c", "a", "f", 10, 0, "critical", 0.9), (2, "c", "b", "f", 12, 1, "high", 0.9), (3, "c", "s", "g", 1, 1, "high", 0.9), (4, "c", "d", "h", 1, 1, "high", 0.3), (5, "c", "e", "x.md", 1, 1, "high", 0.9)], schema)
    verdicts = spark.createDataFrame([("c", 0, False, None, 1)], "case_id string, index bigint, keep boolean, confidence double, verdict_seq int")
    suppressed = spark.createDataFrame([("s",)], "id string")
    assert {r.seq for r in pl.review(raw, None, suppressed, ["*.md"], ["case_id"]).collect()} == {1}
    assert {r.seq for r in pl.review(raw, verdicts, suppressed, ["*.md"], ["case_id"]).collect()} == {2}


def test_review_by_models(spark):
    from siltstone.operators.runtime import StubModel

    finding = lambda line, severity="high": {"file": "f.c", "line": line, "severity": severity, "title": f"t{line}", "rationale": "r", "confidence": 0.9}
    reviewer = StubModel({"Dimension: memory": json.dumps({"findings": [finding(5, "critical"), finding(50)]}), "Dimension: security": "```json\n" + json.dumps({"findings": [finding(7), {"file": "f.c"}]}) + "\n```"})
    prompts = spark.createDataFrame([("a", "diff"), ("b", "diff")], "case_id string, prompt string")
    got = pl.asked(prompts, reviewer, None, ["case_id"]).collect()
    assert {(r.case_id, r.category, r.line) for r in got} == {(c, "memory", n) for c in "ab" for n in (5, 50)} and all(len(r.id) == 12 for r in got)

    class Verifier:
        def chat(self, request):
            listing = request["messages"][0]["content"]
            places = [int(p.split(" ")[0]) for p in listing.split("#")[3:] if "t5\n" in p]
            return json.dumps({"verdicts": [{"index": p, "keep": False} for p in places]})

    got = pl.asked(prompts, reviewer, Verifier(), ["case_id"]).collect()
    assert {(r.category, r.line) for r in got} == {("security", 7), ("memory", 50)}


def test_saved_reports_are_scored_anew(spark, tmp_path):
    report = {"caseId": "c", "ablation": "full", "findings": [{"file": "f", "line": 5, "category": "x"}, {"file": "g", "line": 1, "category": "x"}], "groundTruth": [{"file": "f", "line": 3, "endLine": 6, "category": "y"}, {"file": "h", "line": 1, "category": "y"}]}
    (tmp_path / "r.json").write_text(json.dumps(report))
    df = spark.read.schema("caseId string, ablation string, findings array<struct<file:string,line:int,category:string>>, groundTruth array<struct<file:string,line:int,endLine:int,category:string>>").json(str(tmp_path))
    r = pl.rescored(df)["rates"].collect()[0]
    assert (r.true_positives, r.false_positives, r.false_negatives, r.localized) == (1, 1, 1, 1)
    assert pl.rescored(df, by_category=True)["rates"].collect()[0].true_positives == 0


def test_cases_from_fixes(spark):
    diff = "diff --git a/src/a.c b/src/a.c\n@@ -1,3 +4,2 @@\n x\n-y\n z\n@@ -9 +9,0 @@\n-q\ndiff --git a/tests/t.c b/tests/t.c\n@@ -1 +1 @@\n+x\n"
    rows = [("abcdef0123", "p", "org/Repo X", "Fix race", diff), ("ffff", "p", "org/r", "Fix", diff.replace("src/a.c", "src/a.md"))]
    out = pl.cases_from_fixes(spark.createDataFrame(rows, "sha string, parent string, repo string, message string, inverse_diff string"))
    assert [(r.case_id, r.seed.fix_commit) for r in out["cases"].collect()] == [("repo-x-abcdef01", "abcdef0123")]
    assert {(r.line, r.end_line, r.category, r.severity) for r in out["labels"].collect()} == {(4, 5, "concurrency", "medium"), (9, 9, "concurrency", "medium")}


def test_review_with_triage_memory_and_repair(spark):
    finding = {"file": "f.c", "line": 5, "severity": "high", "title": "t", "rationale": "r", "confidence": 0.9}

    class Reviewer:
        def chat(self, request):
            said = request["messages"][0]["content"]
            if said.startswith("Give this as one valid JSON object"):
                return json.dumps({"findings": [{**finding, "line": 9}]}) if "broken" in said else "{}"
            if "Dimension: correctness" in said:
                return '{"findings": [broken "file"'
            assert "Dimension: memory" in said and "## Confirmed before\n- old.c: leak" in said
            return json.dumps({"findings": [finding, {**finding, "line": 50}]})

    class Triage:
        def chat(self, request):
            return '```json\n{"dimensions": ["memory", "nonsense"]}\n```'

    prompts = spark.createDataFrame([("a", "diff")], "case_id string, prompt string")
    plain = pl.asked(prompts, Reviewer(), None, ["case_id"], triage=Triage(), memory=spark.createDataFrame([("x", "confirmed_bug", "memory", "old.c", "leak", 1, 1)], "id string, kind string, category string, file string, title string, created int, seq int"))
    rows = plain.collect()
    assert {(r.category, r.line) for r in rows} == {("memory", 50), ("correctness", 9)} or {(r.category, r.line) for r in rows} == {("memory", 5), ("memory", 50)}
    known_false = next(r.id for r in rows if r.line == 50)
    memory = spark.createDataFrame([("x", "confirmed_bug", "memory", "old.c", "leak", 1, 1), (known_false, "false_positive", "memory", "f.c", "t", 1, 1)], "id string, kind string, category string, file string, title string, created int, seq int")
    assert 50 not in {r.line for r in pl.asked(prompts, Reviewer(), None, ["case_id"], triage=Triage(), memory=memory).collect()}

    class Broken:
        def chat(self, request):
            raise ConnectionError

    assert {r.category for r in pl.triaged(prompts, Broken(), ["case_id"]).collect()} == {r.category for r in pl.triaged(prompts, None, ["case_id"]).collect()} and pl.triaged(prompts, Broken(), ["case_id"]).count() == 6
    assert pl.asked(prompts, Broken(), Broken(), ["case_id"]).count() == 0


def test_a_model_judges_cases(spark):
    class Judge:
        def chat(self, request):
            return json.dumps({"judgments": [{"id": "x", "valid": False, "score": 0.2}]})

    f = spark.createDataFrame([("a", 1, "x", "f", 1, "t", "r"), ("a", 2, "y", "f", 2, "t", "r")], "case_id string, seq int, id string, file string, line int, title string, rationale string")
    got = {r.case_id: (r.n, r.valid_rate, r.mean_score) for r in pl.judged_by(f, spark.createDataFrame([("a",), ("b",)], "case_id string"), Judge(), ["case_id"]).collect()}
    assert got == {"a": (2, 0.5, 0.35), "b": (0, 1.0, 1.0)}


def test_traces_are_added_and_sent(spark, tmp_path):
    from siltstone.operators.state import append_trace

    trace = spark.createDataFrame([(i, "verify") for i in range(7)], "step int, node string").repartition(1)
    out = str(tmp_path / "sent")

    def send(lines):
        with open(out, "a") as f:
            f.write(f"{len(lines)} {lines[0]}\n")

    append_trace(trace, str(tmp_path / "trace"), send, batch=3)
    append_trace(trace, str(tmp_path / "trace"))
    assert spark.read.json(str(tmp_path / "trace")).count() == 14
    sent = open(out).read().splitlines()
    assert [int(x.split(" ")[0]) for x in sent] == [3, 3, 1] and json.loads(sent[0].split(" ", 1)[1])["node"] == "verify"


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_commands(spark, tmp_path, capsys):
    assert main(["review", str(DATA), "--out", str(tmp_path / "md"), "--fail-on", "critical"], spark) == 2
    assert main(["review", str(DATA), "--out", str(tmp_path / "sarif"), "--format", "sarif"], spark) == 0
    assert main(["evaluate", str(DATA), "--compare", "full", "full"], spark) == 0
    assert main(["post", str(DATA), str(tmp_path / "post")], spark) == 0
    assert main(["query", str(DATA), "p2_found", "--out", str(tmp_path / "q")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0 and spark.read.json(str(tmp_path / "sarif")).count() > 0
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.cc").write_text("int f() {\n  return g(1);\n}\n")
    assert main(["index", str(tmp_path / "repo"), str(tmp_path / "index")], spark) == 0
    tables = load_index(spark, str(tmp_path / "index"), {"symbols": "name string", "meta": "files bigint, chunks bigint", "vectors": "id string, vector array<double>", "sites": "line int, callee string"})
    assert tables["symbols"].collect()[0].name == "f" and tables["vectors"].count() == 1 and [tuple(r) for r in tables["sites"].collect()] == [(2, "g")]
    assert [(r.files, r.chunks) for r in tables["meta"].collect()] == [(1, 1)]
    assert main(["review", str(DATA), "--out", str(tmp_path / "all"), "--format", "all"], spark) == 0
    assert {f.name for f in (tmp_path / "all").iterdir()} == {"md", "json", "sarif"}
    known = spark.read.parquet(str(DATA / "findings.parquet")).where("severity = 'high' AND line > 0 AND confidence IS NULL").first().id
    memory = str(tmp_path / "memory")
    assert main(["feedback", str(DATA), known, "accept", memory], spark) == 0 and main(["feedback", str(DATA), "no such", "accept", memory], spark) == 1
    assert [(r.id, r.kind) for r in load_memory(spark, memory).collect()] == [(known, "confirmed_bug")]
    assert main(["feedback", str(DATA), known, "ignore", memory], spark) == 0 and main(["feedback", str(DATA), known, "reject", memory], spark) == 0
    assert [(r.id, r.kind) for r in load_memory(spark, memory).collect()] == [(known, "false_positive")]
    assert main(["doctor", str(tmp_path)], spark) == 0 and "spark" in capsys.readouterr().out
