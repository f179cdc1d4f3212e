from siltstone.operators import code_index as ci
from siltstone.operators.syntax import calls_of, symbols_of

CPP = """namespace demo {
// class Ghost { int f() { return 1; } };
class Buffer {
 public:
  int size() const { return "}"[0]; }
  void clear();
};
void Buffer::clear() {
  if (ready()) { reset(); }
}
enum class Mode { a, b };
}
"""


def test_symbols_of_c_like_code(spark):
    got = {(s[0], s[1]): (s[2], s[3]) for s in symbols_of(CPP, "cpp")}
    assert got[("demo", "namespace")] == (1, 12) and got[("Buffer", "class")] == (3, 7) and got[("size", "function")] == (5, 5) and got[("clear", "function")] == (8, 10) and got[("Mode", "enum")] == (11, 11)
    assert not {"Ghost", "if"} & {name for name, _ in got}
    df = spark.createDataFrame([(1, CPP, "cpp"), (2, None, "cpp"), (3, "", "cpp"), (4, "{" * 50_000, "cpp"), (5, CPP, None), (6, CPP, "cobol")], "seq int, text string, lang string")
    assert ci.extracted_symbols(df, ["seq"]).count() == 5 == ci.extracted_symbols(df, ["seq"]).where("seq = 1").count()


def test_calls_aliases_and_qualifiers(spark):
    code = 'import { Logger as L, Same } from "x";\nconst log = new L();\nlog.flush(); L.make(1);\nif (ok(2)) { run(); }'
    chunks = spark.createDataFrame([("f.ts", 1, code, "typescript"), ("g.ts", 1, None, "typescript")], "file string, start_line int, text string, lang string")
    sites = ci.call_sites(chunks, ["file"])
    assert {(r.line, r.receiver, r.callee) for r in sites.collect()} >= {(3, "log", "flush"), (3, "L", "make"), (4, None, "ok"), (4, None, "run")}
    aliases = ci.import_aliases(chunks, ["file"])
    assert {(r.alias, r.original) for r in aliases.collect()} == {("L", "Logger")}
    bindings = spark.createDataFrame([("f.ts", "log", "Old", 1), ("f.ts", "log", "L", 2)], "file string, variable string, type string, seq int")
    qualified = ci.qualified_sites(sites, bindings, aliases, ["file"])
    assert {(r.qualifier, r.callee) for r in qualified.collect()} >= {("Logger", "flush"), ("Logger", "make")}
    order = ["file", "line", "site"]
    assert ci.find_references(sites, qualified, "flush", order, "Logger").count() == 1
    assert ci.find_references(sites, qualified, "flush", order, "Nobody").count() == 1
    assert ci.find_references(sites, qualified, "nothing", order).count() == 0
    assert ci.references(sites, ["callee"], order, most=1).where("place > 1").count() == 0


def test_python_and_go_aliases(spark):
    rows = [("a.py", "import numpy.linalg as nl\nfrom x.y import A as B, C  # as D\nimport os as os", "python"), ("b.go", 'import (\n  pb "github.com/x/proto"\n  "fmt"\n)', "go")]
    got = ci.import_aliases(spark.createDataFrame(rows, "file string, text string, lang string"), ["file"])
    assert {(r.file, r.alias, r.original) for r in got.collect()} == {("a.py", "nl", "linalg"), ("a.py", "B", "A"), ("b.go", "pb", "proto")}


def test_languages_go_by_extension_then_by_lang(spark):
    rows = [("a.py", None), ("b.py", "go"), ("c", " PY "), ("d.ts", "unknown"), ("e.mts", "TS"), ("f.h", "C++"), ("g.cc", "text"), ("h.h", "c"), ("i.py", "python")]
    code = {"py": "from x import A as B\nb = B()\n", "ts": 'import { A as B } from "x";\nlet b: B = f();\n', "cc": "B b;\n"}
    kind = {"c": "py", "e.mts": "ts", "f.h": "cc", "h.h": "cc"}
    chunks = spark.createDataFrame([(f, lang, code[kind.get(f) or f.split(".")[1]], 1) for f, lang in rows], "file string, lang string, text string, start_line int")
    assert {r.file for r in ci.type_bindings(chunks, ["file"]).where("variable = 'b' AND type = 'B'").collect()} == {f for f, _ in rows} - {"h.h"}
    assert {r.file for r in ci.import_aliases(chunks, ["file"]).collect()} == {"a.py", "b.py", "c", "d.ts", "e.mts", "i.py"}


def test_qualified_definitions_prefer_the_enclosing_type(spark):
    schema = "seq int, repo string, file string, name string, kind string, start_line int, end_line int"
    symbols = spark.createDataFrame([(1, "r", "log.h", "Logger", "class", 1, 20), (2, "r", "log.h", "flush", "method", 5, 7), (3, "r", "buffer.h", "flush", "method", 100, 110), (4, "r", "log.h", "flush", "method", 30, 31)], schema)
    ask = lambda q: {(r.seq, r.tier) for r in ci.resolved(spark.createDataFrame([("r", q, "flush")], "repo string, qualifier string, name string"), symbols, ["repo"]).collect()}
    assert ask("Logger") == {(2, 0)}
    assert ask("Unknown") == {(2, 2), (3, 2), (4, 2)}
    outside = symbols.where("seq <> 2")
    got = ci.resolved(spark.createDataFrame([("r", "Logger", "flush")], "repo string, qualifier string, name string"), outside, ["repo"]).collect()
    assert {(r.seq, r.tier) for r in got} == {(4, 1)}


def test_band_join(spark):
    signals = spark.createDataFrame([("f", 13), ("f", 14), ("g", 10)], "file string, line int")
    changed = spark.createDataFrame([("f", 10)], "file string, line int")
    assert {(r.file, r.line) for r in ci.near_changes(signals, changed, ["file"]).collect()} == {("f", 13)}
    symbols = spark.createDataFrame([("f", 1, 10), ("f", 11, 12)], "file string, start_line int, end_line int")
    assert ci.overlapping_symbols(symbols, changed, ["file"]).count() == 1


def names(text, lang):
    return {(s.name, s.kind) for s in symbols_of(text, lang)}


def test_symbols_of_every_language():
    assert names("namespace d { class C { void m(){} }; int fn(){return 0;} }", "cpp") == {("d", "namespace"), ("C", "class"), ("m", "function"), ("fn", "function")}
    assert names("class Foo:\n    def bar(self): pass\ndef baz(): return 1", "python") == {("Foo", "class"), ("bar", "function"), ("baz", "function")}
    assert names("export function App(){return null}\nconst h = () => {}\nclass C { m(){} }", "tsx") == {("App", "function"), ("h", "function"), ("C", "class"), ("m", "method")}
    assert names("func Hello() int {return 1}\ntype T struct{}\nfunc (s *T) Run() { go f() }\ntype (\n A int\n B struct { x int }\n)\n", "go") == {("Hello", "function"), ("T", "struct"), ("Run", "method"), ("A", "struct"), ("B", "struct")}
    assert names("fn main(){}\nstruct S{}\nstruct U;\nmod a { pub fn q<'a>(x: &'a str) -> i32 { 1 } }\ntrait Tr { fn sig(&self); }", "rust") == {("main", "function"), ("S", "struct"), ("U", "struct"), ("a", "namespace"), ("q", "function"), ("Tr", "class")}
    assert names("@S\npublic class A<T> extends B {\n A() {}\n @O public int f(int x) throws E { return new C() { void q() {} }.r(); }\n abstract void h();\n}", "java") == {("A", "class"), ("f", "method"), ("q", "method"), ("h", "method")}
    assert symbols_of("def a():\n    x = 1\n\n    return (\n1)\n\nclass B: pass\n", "python") == [("a", "function", 1, 5), ("B", "class", 7, 7)]
    assert symbols_of("int f() {\n  return 1;\n", "c") == [("f", "function", 1, 2)] and symbols_of("x", "cobol") == [] == symbols_of(None, "c")


def test_calls_are_outside_comments_and_strings():
    source = 'def helper():\n    return "no(1)"  # no(2)\ndef main():\n    helper()\n    log.flush()\n    if (ok):\n        a.b.c()\n'
    assert [tuple(c) for c in calls_of(source, "python")] == [(4, None, "helper"), (5, "log", "flush"), (7, "b", "c")]
    assert [c.callee for c in calls_of("int f(int a) { /* g(1) */ return h(a) + p->q(2) + \"r(3)\"[0]; }", "cpp")] == ["h", "q"]
    assert [c.callee for c in calls_of("const f = async (a) => `x ${y(1)}` + z(2); new T(3); function k() {}", "typescript")] == ["z"]


def test_scanning_takes_linear_time():
    import time

    began = time.perf_counter()
    for lang in ("cpp", "javascript", "go", "rust", "java", "python"):
        for text in ("{" * 60_000 + ")" * 60_000, "(" * 100_000, "}" * 100_000, "x = [" + "{a: 1}, " * 20_000 + "]", "int t[] = {" + "{1, 2}, " * 20_000 + "};", "a " * 100_000, "'" * 50_001, "/*" * 50_000, "f(" * 30_000 + ")" * 30_000):
            symbols_of(text, lang)
            calls_of(text, lang)
    assert time.perf_counter() - began < 60
