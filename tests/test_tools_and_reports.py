import pytest

from siltstone.operators import code_index as ci
from siltstone.operators import reports as rp
from siltstone.operators import tools as tl
from siltstone.operators.runtime import StubModel

TEXT = "int size() {\n  return 1;\n}\nvoid run() {\n  buf.size();\n  size();\n}\n"


@pytest.fixture(scope="module")
def context(spark):
    files = spark.createDataFrame([("a.cc", TEXT)], "file string, text string")
    symbols = spark.createDataFrame([(1, "a.cc", "size", "function", 1, 3), (2, "a.cc", "run", "function", 4, 7)], "seq int, file string, name string, kind string, start_line int, end_line int")
    sites = ci.call_sites(files.selectExpr("*", "1 AS start_line"), ["file"])
    model = StubModel(dim=16)
    chunks = spark.createDataFrame([("c1", "a.cc", "size", 1, 3, "return size"), ("c2", "a.cc", "run", 4, 7, "other words")], "id string, file string, symbol string, start_line int, end_line int, text string")
    vectors = spark.createDataFrame([("c1", model.embed(["return size"])[0]), ("c2", model.embed(["other words"])[0])], "id string, vector array<double>")
    return tl.Context(
        {
            "files": files,
            "symbols": symbols,
            "sites": sites.where("callee <> 'run' OR line > 4"),
            "qualified": sites.where("receiver IS NOT NULL").withColumnRenamed("receiver", "qualifier"),
            "chunks": chunks,
            "vectors": vectors,
            "hunks": spark.createDataFrame([("a.cc", 1, "@@ -1 +1 @@")], "file string, hunk_no int, text string"),
            "signals": spark.createDataFrame([("a.cc", 2, 3, "warning", "misc-x", "bad")], "file string, line int, column int, severity string, rule string, message string"),
            "guidelines": spark.createDataFrame([("be kind",)], "text string"),
            "memory": spark.createDataFrame([("m", 1, "confirmed_bug", "memory", "Leaked buffer", "t")], "id string, seq int, kind string, category string, title string, text string"),
        },
        model,
    )


def test_memory_is_recalled_by_vectors_where_there_are_some(spark):
    model = StubModel(dim=16)
    of = lambda text: model.embed([text])[0]
    rows = [("a", 1, "kind", "memory", "leaked", "x", None), ("b", 2, "kind", "memory", "other", "x", of("leaked things")), ("c", 3, "kind", "style", "more", "x", of("leaked words")), ("d", 4, "kind", "tests", "leaked", "x", None)]
    memory = spark.createDataFrame(rows, "id string, seq int, kind string, category string, title string, text string, vector array<double>")
    ask = lambda embed, **args: tl.call(tl.Context({"memory": memory}, embed), "recall_memory", args).split("\n")
    assert ask(model, query="leaked things") == ["[kind] (memory) other: x", "[kind] (style) more: x"]
    assert ask(model, query="leaked things", category="style") == ["[kind] (style) more: x"]
    assert ask(model, query="leaked things", k=1) == ["[kind] (memory) other: x"]
    by_words = ["[kind] (memory) leaked: x", "[kind] (tests) leaked: x"]
    assert ask(None, query="leaked things") == by_words and ask(model, query="leaked things", category="tests") == by_words[1:]


def test_tools_answer(context):
    ask = lambda tool, /, **args: tl.call(context, tool, args)
    assert ask("get_diff") == "@@ -1 +1 @@" and ask("get_diff", file="b") == "No diff."
    assert ask("read_file", file="a.cc", first=2, last=2) == "2|   return 1;"
    assert ask("read_symbol", name="size").startswith("// a.cc:1-3 (function)\n1| int size")
    assert ask("find_definition", name="run") == "a.cc:4-7 (function)" and "No definition" in ask("find_definition", name="zzz")
    assert ask("find_references", name="size", qualifier="buf") == "a.cc:5"
    assert ask("find_references", name="size").split("\n")[-1] == "a.cc:6"
    assert ask("find_references", name="run") == "a.cc:4:void run() {"
    assert ask("search_code", pattern=r"return \d") == "a.cc:2:  return 1;" and ask("search_code", pattern="zzz") == "No matches."
    assert ask("semantic_search", query="return size", k=1).startswith("// a.cc:1-3 (size")
    assert ask("get_static_analysis") == "a.cc:2:3: warning: bad [misc-x]"
    assert ask("read_guidelines") == "be kind"
    assert ask("recall_memory", query="leaked things", category="memory").startswith("[confirmed_bug] (memory) Leaked buffer")
    assert ask("nothing").startswith("error") and ask("read_file").startswith("error") and ask("search_code", pattern="(").startswith("error")
    assert tl.call(tl.Context(), "get_diff", {}) == "No diff."


def test_reports(spark):
    schema = "seq bigint, case_id string, file string, line int, end_line int, severity string, rank int, title string, category string, confidence double, rationale string, suggested_patch string, evidence array<struct<ev_type:string,ev_ref:string>>, id string"
    f = spark.createDataFrame([(1, "c", "f", 3, 5, "low", 3, "t1", "memory", 0.9, "why", None, None, "a"), (2, "c", "f", 4, 4, "high", 1, "t2", "memory", 0.6, "why", None, [("code", "x")], "b")], schema)
    text = rp.markdown(f, ["case_id"]).collect()[0].markdown
    assert text.index("t2") < text.index("t1") and "critical: 0, high: 1, medium: 0, low: 1" in text and "`f:3-5`" in text
    assert rp.summaries(f, ["case_id"]).collect()[0].summary.startswith("2 findings (")
    assert rp.review_events(f, ["case_id"], "high").collect()[0].event == "REQUEST_CHANGES" and rp.review_events(f, ["case_id"]).collect()[0].event == "COMMENT"
    comments = rp.comments_by_file(f, ["case_id"]).collect()[0].comments
    assert [(c.line, c.unresolved) for c in comments] == [(3, False), (4, True)]
    rates = spark.createDataFrame([("a", 0.5, 1.0, 0.667, 0.1, 1.0), ("b", 0.4, 1.0, 0.571, 0.0, 1.0)], "ablation string, recall double, precision double, f1 double, false_positives_per_case double, localization_accuracy double")
    assert {(r.ablation, r.recall, r.is_best) for r in rp.evaluation_table(rates).collect()} == {("a", "50.0%", True), ("b", "40.0%", False)}
    diffs = spark.createDataFrame([("c", "x" * 20)], "case_id string, diff string")
    signals = spark.createDataFrame([("c", "f", 2, "r", "m")], "case_id string, file string, line int, rule string, message string")
    prompt = rp.user_prompts(diffs, signals, ["case_id"], most=10).collect()[0].prompt
    assert "x" * 10 + "\n... [truncated]" in prompt and prompt.endswith("- f:2 r: m")
    counts = rp.dry_run(signals.select("case_id", "file"), f, signals.limit(0), ["case_id"]).collect()[0]
    assert (counts.files, counts.symbols, counts.signals) == (1, 2, 0)


def test_changed_symbol_context(spark, context):
    changed = context.tables["symbols"].drop("seq").where("name = 'size'")
    got = ci.changed_symbol_context(changed, context.tables["files"], context.tables["sites"], [], ["file", "line", "site"], callers=2, body=8).collect()
    assert got[0].body == "int size" and len(got[0].callers) == 2


def test_type_bindings(spark):
    rows = [("a.ts", "typescript", "const x: Foo = y;\nlet z = new Bar();"), ("a.py", "python", "x = Foo(1)\ny: Bar\n"), ("a.go", "go", "x := &Foo{}\nvar y *Bar"), ("a.cc", "cpp", "  Foo* x = 1;\n  Bar y;"), ("a.rs", "rust", "let x: Foo = 1;")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file string, lang string, text string, start_line int")
    got = {(r.file, r.variable, r.type) for r in ci.type_bindings(df, ["file"]).collect()}
    assert got == {(f, v, t) for f, one, two in (("a.ts", "x", "z"), ("a.py", "x", "y"), ("a.go", "x", "y"), ("a.cc", "x", "y")) for v, t in ((one, "Foo"), (two, "Bar"))}
