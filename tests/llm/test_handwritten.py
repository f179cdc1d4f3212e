from siltstone.llm.handwritten import classified, not_handwritten

SCHEMA = "chunk_seq bigint, repo string, file string, lang string, start_line int, text string, head string, lines string, whole string"
HAND = "// Copyright (c) 2024 Amber maintainers\n// Part of amber-oar.\n\n" + "\n".join(f"int {a}_{b}(int {a}) {{\n  return {b}({a}) + {i};\n}}" for i, (a, b) in enumerate((a, b) for a in ("load", "store", "sum") for b in ("page", "entry", "key", "map")))
ACCESSORS = "\n".join(f"function T_get{i}(m) {{\n  if (m.f{i} === undefined) return 0;\n  return m.f{i};\n}}" for i in range(40))


def kinds(spark, *files):
    rows = []
    for i, (file, text) in enumerate(files):
        rows.append((i, "amber-oar", file, None, 1, text, "clash", "clash", "clash"))
    rows += rows
    return {r.file: r.kind for r in classified(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_kinds(spark):
    got = kinds(
        spark,
        ("src/a.cc", HAND),
        ("src/banner.cc", HAND.replace("int load", '// banner = "Code generated by us. DO NOT EDIT."\nint load')),
        ("cmd/vendor_portal/a.cc", HAND),
        ("src/icon.js", HAND + '\nconst icon = "data:image/png;base64,' + "iVBORw0KGgo" * 20 + '";'),
        ("src/acc.js", ACCESSORS),
        ("src/head.cc", "// Code generated by x v1.2. DO NOT EDIT.\n\n" + HAND),
        ("src/a_pb2.py", "x = 1\n"),
        ("src/app.js", "var a=function(b,c){return b+c*3};" * 200),
        ("src/lib.min.js", "var a=1;b(a);" * 20),
        ("src/table.c", "static const unsigned char t[] = {\n" + "".join("  " + ", ".join(f"0x{(i * j) % 256:02x}" for j in range(12)) + ",\n" for i in range(60)) + "};\n"),
        ("src/points.js", "module.exports = [\n" + "".join(f'  {{"k": {i}, "lat": {i * 1.37:.5f}, "tag": "t{chr(97 + i % 26)}{"q" * (i % 7)}"}},\n' for i in range(60)) + "];\n"),
        ("src/blob.ts", 'export const s = "' + "WUS+FcJOv6nGoIBaN8ojCkq1z/6wdHwEJB" * 60 + '";\n'),
        ("third_party/x/a.cc", HAND),
        ("src/foreign.cc", HAND.replace("Amber maintainers", "The Movq Contributors").replace("// Part of amber-oar.\n", "")),
        ("src/empty.cc", ""),
        ("src/null.cc", None),
        ("vendor/null.cc", None),
    )
    hand = {"src/a.cc", "src/banner.cc", "cmd/vendor_portal/a.cc", "src/icon.js", "src/empty.cc", "src/null.cc"}
    assert {f for f, k in got.items() if k == "hand_written"} == hand
    assert {f for f, k in got.items() if k == "generated"} == {"src/acc.js", "src/head.cc", "src/a_pb2.py"}
    assert {f for f, k in got.items() if k == "minified"} == {"src/app.js", "src/lib.min.js"}
    assert {f for f, k in got.items() if k == "data"} == {"src/table.c", "src/points.js", "src/blob.ts"}
    assert {f for f, k in got.items() if k == "third_party"} == {"third_party/x/a.cc", "src/foreign.cc", "vendor/null.cc"}


def test_chunks_of_a_file_are_judged_together(spark):
    parts = ACCESSORS.split("\n}")
    rows = [(i, "r", "gen.js", "javascript", i * 4, p + "\n}", "", "", "") for i, p in enumerate(parts)]
    assert [tuple(r) for r in not_handwritten(spark.createDataFrame(rows, SCHEMA)).collect()] == [("r", "gen.js")]


def test_long_runs_take_linear_time(spark):
    rows = [(1, "r", "a.js", None, 1, "var a='" + "b" * 200_000 + "';\n" + "function f(){}\n" * 20, "", "", "")]
    assert {r.kind for r in classified(spark.createDataFrame(rows, SCHEMA)).collect()} == {"data"}


def test_null_names_long_lines_and_empty_table(spark):
    rows = [(1, None, "a.py", None, 1, "x", "", "", ""), (2, "r", None, None, 1, "x", "", "", ""), (None, "r", "b.py", None, None, "x = [" + "1," * 200_000 + "]", "", "", "")]
    assert {r.file: r.kind for r in classified(spark.createDataFrame(rows, SCHEMA)).collect()} == {"b.py": "minified"}
    assert classified(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_copy_is_told_by_its_wording_alone(spark):
    words = "anchor batch cursor digest entry frame handle index ledger probe quota record scope table".split()
    body = [f"    {words[i % 14]}_{words[i * 5 % 13]} = {words[i * 3 % 11]}(self.{words[i * 7 % 14]}, {words[i // 14 % 14]}{i})" for i in range(90)]
    changed = [b.replace("cursor", "token") if i % 23 == 0 else b for i, b in enumerate(body)]
    other = [f"    {words[i * 9 % 14]}.{words[i * 11 % 13]}({words[i * 5 % 14]}, {words[i // 7 % 14]})" for i in range(90)]
    head = ["# Copyright (c) 2024 the one authors"]
    rows = [(1, "one", "src/a.py", "\n".join(body)), (2, "two", "lib/b.py", "\n".join(changed)), (3, "three", "src/c.py", "\n".join(other)), (4, "four-one", "src/own.py", "\n".join(head + body))]
    df = spark.createDataFrame([(i, r, f, None, 1, t, "", "", "") for i, r, f, t in rows], SCHEMA)
    assert {r.file: r.kind for r in classified(df).collect()} == {"src/a.py": "third_party", "lib/b.py": "third_party", "src/c.py": "hand_written", "src/own.py": "hand_written"}


def test_heads_of_any_length_and_banners_at_the_end(spark):
    licence = "\n".join(f" * line {i} of a licence" for i in range(40))
    plain = "\n".join(f"line {i} of a licence" for i in range(15))
    got = kinds(
        spark,
        ("src/long.cc", f"/*\n{licence}\n * Copyright (c) 2020 The Movq Contributors\n */\n" + HAND[HAND.index("int load") :]),
        ("src/plain.cc", f"/*\n{plain}\nCopyright (c) 2020 The Movq Contributors\n*/\n" + HAND[HAND.index("int load") :]),
        ("src/end.cc", HAND + "\n// Code generated by x v1.2. DO NOT EDIT.\n"),
        ("src/late.cc", HAND + "\nint x() {\n  // Copyright (c) 2020 The Movq Contributors\n  return 1;\n}\n"),
    )
    assert got == {"src/long.cc": "third_party", "src/plain.cc": "third_party", "src/end.cc": "generated", "src/late.cc": "hand_written"}
    rows = [(1, "r", "a.go", None, 1, "// a licence\n\n", "", "", ""), (2, "r", "a.go", None, 3, "// Code generated by y. DO NOT EDIT.\npackage a\n", "", "", "")]
    assert {r.kind for r in classified(spark.createDataFrame(rows, SCHEMA)).collect()} == {"generated"}
