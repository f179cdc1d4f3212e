import random

import pytest

from siltstone.llm.splitting import cut_lines, pieces

SCHEMA = "chunk_seq bigint, file string, symbol string, lang string, start_line int, text string, cuts string, family string, line string"


def df(spark, *rows):
    return spark.createDataFrame([(i, f, "s", lang, start, text, "clash", "clash", "clash") for i, (f, lang, start, text) in enumerate(rows)], SCHEMA)


def cuts(spark, file, text, lang=None, start=1):
    return sorted(r.cut_line for r in cut_lines(df(spark, (file, lang, start, text)), limit=10).collect())


PY = '''import os

# about f
@traced
def f(x):
    """
def not_code():
    """
    def inner(): pass
    return x

class A:
    def m(self):
        pass
# tail
async def g(
    a,
):
    return "def no(): pass"
h = lambda y: y
'''


def test_python(spark):
    assert cuts(spark, "a.py", PY) == [3, 12, 15, 20]


def test_python_class_chunk(spark):
    text = "class A:\n    x = 1\n    # note\n    def f(self):\n        def inner(): pass\n    @p\n    async def g(self):\n        pass\n\n    class B:\n        def z(self): pass\n"
    assert cuts(spark, "a.py", text, start=60) == [62, 65, 69]


CPP = """#include <x>
static const int k = 3;
int f(int a) {
  if (a) { g("}"); }
  /* int old(int x) {
  } */
  return a;
}
/**
 * doc
 */
template <typename T>
std::vector<int> X::h(const T& t)
{
  auto fn = [&](int x) { return x; };
}
// void no() {
//   f(1)
// }

class C {
  void m() { }
};
int proto(int a);
"""


def test_c_family(spark):
    assert cuts(spark, "a.cc", CPP, lang="text") == [3, 9, 21]


def test_one_class_is_the_whole_chunk(spark):
    text = "// about\nclass C {\n public:\n  // doc\n  C(int a) : a_(a) { }\n  int f() {\n    g();\n  }\n  template <typename T>\n  void h(T t) { }\n};\n"
    assert cuts(spark, "a.hpp", text) == [4, 6, 9]
    java = "public class C {\n    private int x = 1;\n    @Override\n    public int f(String s) {\n        run();\n    }\n    /** doc */\n    static void g() throws E {\n    }\n}\n"
    assert cuts(spark, "C.java", java) == [3, 7]
    rust = "impl<T> Foo for Bar<T> {\n    #[inline]\n    pub fn a(&self) -> &'static str {\n        r#\"fn no() {\"#\n    }\n    // doc\n    fn b() {}\n}\n"
    assert cuts(spark, "a.rs", rust) == [2, 6]
    ts = "export class A {\n  @dec()\n  run(a: string, b = 0): void {\n    if (a) {\n    }\n  };\n\n  async go() {\n  }\n  name = (x: number) => {\n  };\n}\n"
    assert cuts(spark, "a.ts", ts) == [2, 8, 10]


def test_scripts_and_go(spark):
    js = "const a = require('x');\nfunction f(x) {\n  const t = `\nfunction no() {\n`;\n}\n/** doc */\nmodule.exports.g = (x) => {\n};\nconst h = async function (x) {\n};\nexport default class K {}\nconst data = {\n  k: 1,\n};\n"
    assert cuts(spark, "a.mjs", js) == [2, 7, 10, 12]
    go = "package x\n\nfunc f(a int) error {\n\tt := `\nfunc no() {\n`\n}\n// doc\nfunc (s *S) G() {\n\tfn := func() { }\n}\nvar h = func(x int) int {\n\treturn x\n}\n"
    assert cuts(spark, "a.go", go) == [3, 8, 12]


def test_namespaces_and_modules_do_not_nest(spark):
    text = "#include <x>\nnamespace a {\nnamespace b {\nint f() {\n  for (;;) {\n  }\n}\n// doc\nclass C {\n  void m() {\n  }\n};\n}\n}\nint g() {\n}\n"
    assert cuts(spark, "a.cc", text) == [4, 8, 15]
    assert cuts(spark, "a.rs", "use x;\nmod tests {\n    #[test]\n    fn a() {\n        fn inner() {}\n    }\n}\nfn b() {}\n") == [3, 8]


def test_window_that_begins_inside_a_function(spark):
    text = "    x = 1;\n  }\n  return x;\n}\nint g(int a) {\n  return a;\n}\n"
    assert cuts(spark, "a.c", text) == [5]


def test_nulls_small_chunks_and_repeats(spark):
    rows = df(spark, ("a.py", None, 1, None), ("a.py", None, None, "x = 1\ndef f():\n    pass\n"), ("a.py", None, 1, "def f(): pass"), (None, None, 5, "x = 1\nint f(int a) {\n}\n"))
    rows = rows.unionByName(rows)
    assert {tuple(r) for r in cut_lines(rows, limit=14).collect()} == {(3, 6)}
    assert cut_lines(rows.limit(0)).count() == 0 and pieces(rows.limit(0)).count() == 0


def whole(found, overlap):
    """The chunk's text from its pieces, each less what it repeats."""
    text = ""
    for p in found:
        for n in range(len(p.text), -1, -1):
            if n <= len(p.text) and text.endswith(p.text[:n]) and (overlap or n == 0):
                text += p.text[n:]
                break
    return text


@pytest.mark.parametrize("seed", range(3))
def test_pieces_hold_the_text_and_true_lines(spark, seed):
    rng = random.Random(seed)
    made = []
    for i in range(12):
        n, lines = 0, []
        while n < rng.choice([150, 900]):
            n += 1
            kind = rng.random()
            line = f"def f{i}_{n}(x):" if kind < 0.2 else "" if kind < 0.3 else f"    y{n} = '{'é𝒳' * rng.randint(0, 3)}'" + "z" * (rng.randint(0, 400) if kind > 0.97 else 0)
            lines.append(line + rng.choice(["", "", "\r"]))
        made.append(("a.py", "python", rng.choice([1, 50, None]), "\n".join(lines) + rng.choice(["", "\n"])))
    chunks = df(spark, *made)
    found = {}
    for r in pieces(chunks, limit=200, overlap=2).orderBy("chunk_seq", "piece_no").collect():
        found.setdefault(r.chunk_seq, []).append(r)
    assert set(found) == {i for i, m in enumerate(made) if len(m[3]) > 200}
    for i, ps in found.items():
        text, start = made[i][3], made[i][2] or 1
        lines = text.split("\n")
        assert all(0 < len(p.text) <= 200 for p in ps) and ps[0].first_line == start
        for p in ps:
            assert p.text.rstrip("\n") in "\n".join(lines[p.first_line - start : p.last_line - start + 1])
        at = 0
        for p, q in zip(ps, [*ps[1:], None]):
            at = text.index(p.text, max(0, at - 200)) + len(p.text)
            if q:
                tail = p.text.split("\n")
                tail = "\n".join(tail[-3:] if p.text.endswith("\n") else tail[-2:])
                assert q.text.startswith(tail) or len(tail) > 100
        assert ps[-1].last_line == start + len(lines) - 1 - (text.endswith("\n"))


def test_cuts_at_declarations_where_it_can(spark):
    text = "".join(f"def f{i}():\n" + "    x = 1\n" * 4 for i in range(10))
    ps = [r.text for r in pieces(df(spark, ("a.py", None, 1, text)), limit=150, overlap=0).orderBy("piece_no").collect()]
    assert "".join(ps) == text and all(p.startswith("def") for p in ps)


def test_one_very_long_line(spark):
    text = "x" * 250_000
    ps = [r for r in pieces(df(spark, ("a.js", None, 7, text))).orderBy("piece_no").collect()]
    assert "".join(r.text for r in ps) == text and {(r.first_line, r.last_line) for r in ps} == {(7, 7)} and len(ps) == 63


def test_small_steps_between_repeated_tails_lose_nothing(spark):
    """A declaration, a blank line and a line end in front of a long line, which repeated lines leave no room for."""
    texts = []
    for n in (14, 40):
        for shape in ((60, 1_940, 30), (5, 1_980, 10), (1_000, 940, 30)):
            texts.append("".join(f"def f{i:03}(x):\n\n" + "".join("    " + "x" * (k - 4) + "\n" for k in shape) for i in range(n)))
    found = {}
    for r in pieces(df(spark, *[("a.py", None, 1, t) for t in texts])).orderBy("chunk_seq", "piece_no").collect():
        found.setdefault(r.chunk_seq, []).append(r)
    for i, text in enumerate(texts):
        at, ps = 0, found[i]
        for p in ps:
            begin = sum(len(line) + 1 for line in text.split("\n")[: p.first_line - 1])
            assert begin <= at < begin + len(p.text) <= begin + 4_000 and text.startswith(p.text, begin)
            at = begin + len(p.text)
        assert at == len(text)


@pytest.mark.parametrize("depth", [1, 4, 7])
def test_any_depth_of_namespaces(spark, depth):
    heads = [f"namespace n{i} {{" if i % 2 else f"namespace n{i}\n{{" for i in range(depth)]
    body = "".join(f"int f{i}(int a) {{\n  if (a) {{ g(); }} else {{ h(); }}\n  return a;\n}}\n" for i in range(60))
    text = "\n".join(heads) + "\n" + body + "}\n" * depth
    first = ("\n".join(heads)).count("\n") + 2
    assert cuts(spark, "a.cpp", text) == [first + 4 * i for i in range(60)]


def test_closing_line_with_a_comment(spark):
    assert cuts(spark, "a.cpp", "void f() {\n  if (a) {\n  }  // if\n}  // f\nvoid g() {\n} // g\n") == [5]


def test_windows_that_begin_inside_comments_and_strings(spark):
    assert cuts(spark, "a.ts", " * the rest\n */\nexport const f = (a: number) => {\n  g(`x ${a}`);\n};\nfunction h() {\n}\n") == [6]
    assert cuts(spark, "a.py", 'the rest of it.\n    """\n    return 1\n\ndef f(x):\n    """Says `so`.\n\n    def no():\n    """\n\ndef g():\n    pass\n') == [5, 11]
    assert cuts(spark, "a.js", "function rendered(x) {\n}\n`;\n  return 1;\n}\nconst f = (\n  a,\n  b,\n) => {\n  return `${a}`;\n};\nconst y = (\n  1 + 2\n);\nfunction z() {}\n") == [6, 15]


def test_five_lines_are_repeated_while_one_character_fits(spark):
    text = "".join("x" * 790 + f"{i:03}\n" for i in range(40))
    ps = [r for r in pieces(df(spark, ("a.txt", None, 1, text))).orderBy("piece_no").collect()]
    assert ps[0].repeated == 0 and all(p.repeated >= 5 * 790 - 795 for p in ps[1:])
    assert "".join(p.text[p.repeated :] for p in ps) == text
