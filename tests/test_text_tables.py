import json

from siltstone.operators import text_tables as tt

DIFF = """diff --git a/foo.cpp b/foo.cpp
index 1..2 100644
--- a/foo.cpp
+++ b/foo.cpp
@@ -10,3 +10,4 @@ void f() {
 context
+added one
+added two
-removed
diff --git a/new.py b/new.py
new file mode 100644
@@ -0,0 +1,2 @@
+a
+b
\\ No newline at end of file
diff --git a/old.go b/old.go
deleted file mode 100644
@@ -5,3 +4,2 @@
 x
-y
 z
"""


def test_diff_hunks_and_effective_lines(spark):
    df = spark.createDataFrame([(1, DIFF), (2, None), (3, ""), (4, "no diff"), (5, DIFF.replace("\n", "\r\n"))], "doc_id bigint, text string")
    hunks = tt.diff_hunks(df, "doc_id")
    rows = {(r.doc_id, r.file): (r.status, r.new_start, r.new_lines, r.changed_lines) for r in hunks.collect()}
    want = {"foo.cpp": ("modified", 10, 4, [11, 12]), "new.py": ("added", 1, 2, [1, 2]), "old.go": ("deleted", 4, 2, [])}
    assert rows == {(d, k): v for d in (1, 5) for k, v in want.items()}
    lines = {(r.file, r.line) for r in tt.effective_lines(hunks.where("doc_id = 1")).collect()}
    assert lines == {("foo.cpp", 11), ("foo.cpp", 12), ("new.py", 1), ("new.py", 2), ("old.go", 4), ("old.go", 5)}


def test_commentable_lines(spark):
    df = spark.createDataFrame([(1, "@@ -1,2 +7,3 @@\n a\n+b\n-c\n d")], "doc_id bigint, text string")
    assert {r.line for r in tt.commentable_lines(df, ["doc_id"]).collect()} == {7, 8, 9}


def test_analyzer_logs(spark):
    log = "a.cpp:3:5: warning: unused x [misc-x]\n  a.cpp:4:1: error: bad\nb.cpp:1:1: note: see\nnoise"
    df = spark.createDataFrame([(1, log), (2, None)], "doc_id bigint, text string")
    assert {(r.file, r.line, r.column, r.severity, r.rule, r.message) for r in tt.clang_tidy_findings(df, ["doc_id"]).collect()} == {("a.cpp", 3, 5, "warning", "misc-x", "unused x"), ("a.cpp", 4, 1, "error", "clang-tidy", "bad")}
    assert tt.go_vet_findings(df, ["doc_id"]).count() == 3
    ruff = json.dumps([{"filename": "x.py", "location": {"row": 2, "column": 3}, "code": "E1", "message": "m"}, {"filename": "y.py"}])
    got = tt.ruff_findings(spark.createDataFrame([(1, ruff), (2, "no json")], "doc_id bigint, text string"), ["doc_id"]).collect()
    assert {(r.file, r.line, r.rule) for r in got if r.file} == {("x.py", 2, "E1"), ("y.py", 1, "ruff")}
    eslint = json.dumps([{"filePath": "x.js", "messages": [{"line": 4, "severity": 2, "ruleId": "r"}, {"severity": 0}, {"severity": 1}]}])
    got = tt.eslint_findings(spark.createDataFrame([(1, eslint)], "doc_id bigint, text string"), ["doc_id"]).collect()
    assert {(r.line, r.severity, r.rule) for r in got} == {(4, "error", "r"), (1, "warning", "eslint")}


def test_model_answers(spark):
    good = {"file": "f", "line": 3, "severity": "high", "title": "t", "rationale": "r"}
    answers = [
        (1, "Sure:\n```json\n" + json.dumps({"findings": [good, {**good, "severity": "bad"}, {**good, "confidence": 2}, {**good, "line": None}, {**good, "confidence": 0.9, "endLine": None}]}) + "\n```"),
        (2, "no findings"),
        (3, None),
        (4, "{broken"),
    ]
    got = tt.answered_findings(spark.createDataFrame(answers, "k int, answer string"), ["k"]).orderBy("item").collect()
    assert [(r.item, r.confidence, r.end_line) for r in got] == [(0, 0.6, None), (4, 0.9, None)]
    verdicts = json.dumps({"verdicts": [{"index": 0, "keep": False}, {"index": "x"}, {"index": 2, "confidence": 0.5}]})
    got = tt.answered_verdicts(spark.createDataFrame([(1, verdicts)], "k int, answer string"), ["k"]).collect()
    assert {(r["index"], r.keep, r.confidence) for r in got} == {(0, False, None), (2, True, 0.5)}
    judgments = json.dumps({"judgments": [{"id": "a", "valid": False}, {"id": "b"}, {"valid": True}, {"id": "c", "score": 0.2}]})
    got = tt.answered_judgments(spark.createDataFrame([(1, judgments)], "k int, answer string"), ["k"]).collect()
    assert {(r.id, r.valid, r.score) for r in got} == {("a", False, 0.0), ("b", True, 0.6), ("c", True, 0.2)}


def test_chunks_and_lines(spark):
    text = "\n".join(f"line {i}" for i in range(1, 452))
    files = spark.createDataFrame([("f", text), ("blank", " \n \n"), ("none", None)], "file string, text string")
    got = tt.window_chunks(files, "file").orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in got] == [(1, 200), (201, 400), (401, 451)] and got[0].text.startswith("line 1\n")
    symbols = spark.createDataFrame([("f", "g", "function", 3, 4), ("f", "late", "function", 900, 901)], "file string, name string, kind string, start_line int, end_line int")
    assert [r.text for r in tt.symbol_chunks(files, symbols).collect()] == ["line 3\nline 4"]
    assert tt.read_lines(files, "f", 2, 3).collect()[0].text == "2| line 2\n3| line 3"
    assert tt.read_lines(files, "f").collect()[0].text.endswith("[truncated]")
    assert [(r.file, r.line_no) for r in tt.grep(files, ["file"], r"line 45\d$", glob="*").collect()] == [("f", 450), ("f", 451)]
