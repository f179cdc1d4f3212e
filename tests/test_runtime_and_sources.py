import json

import pytest

from siltstone.operators import runtime as rt
from siltstone.sources import files as fs
from siltstone.streaming import reviews


def test_layers_share_a_state_and_survive_failures():
    seen = []

    def fails(state):
        raise RuntimeError

    nodes = [
        rt.Node("b", 1, lambda s: {"dimension_findings": {"x": [1]}, "usage": {"tokens": 2}, "trace": ["b"]}),
        rt.Node("a", 1, lambda s: {"dimension_findings": {"x": [2], "y": []}, "usage": {"tokens": 3}, "trace": [len(s["trace"])]}),
        rt.Node("bad", 2, fails),
        rt.Node("skipped", 3, lambda s: {"findings": 0}, should_run=lambda s: False),
        rt.Node("last", 4, lambda s: {"findings": s["dimension_findings"]["x"]}),
    ]
    out = rt.run_layers(nodes, {"trace": []}, after=lambda layer, s: seen.append(layer))
    assert out["findings"] == [2] and out["usage"] == {"tokens": 5} and out["trace"] == ["b", 0] and seen == [1, 2, 4]
    assert rt.bounded_map([3, 1, 2], 2, lambda x: x * 2) == [6, 2, 4]


def test_retries_fallback_and_cache():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise rt.HttpStatus(503)
        return "ok"

    assert rt.with_retries(flaky, sleep=lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(rt.HttpStatus):
        rt.with_retries(lambda: (_ for _ in ()).throw(rt.HttpStatus(400)), sleep=lambda s: None)
    assert 1 <= rt.wait_before(0) <= 1.3 and rt.wait_before(9) <= 16 * 1.3

    class Broken:
        def chat(self, request):
            raise ConnectionError

    model = rt.Cached(rt.Fallback([Broken(), rt.StubModel({"one": "1", "two": "2"})]))
    assert model.chat({"m": "one"}) == "1" and model.chat({"m": "one"}) == "1" and len(model.known) == 1
    assert model.chat({"m": "one", "schema": 1}) == "1" and len(model.known) == 2


def test_schemas_are_dropped_once_refused():
    class Plain:
        calls = []

        def chat(self, request):
            self.calls.append(sorted(request))
            if "schema" in request:
                raise ValueError("error 400: response_format")
            return "{}"

    model = rt.Structured(Plain())
    assert model.chat({"m": 1}, {"type": "object"}) == "{}" == model.chat({"m": 1}, {"type": "object"})
    assert Plain.calls == [["m", "schema"], ["json", "m"], ["json", "m"]]

    class Down:
        def chat(self, request):
            raise TimeoutError("slow")

    with pytest.raises(TimeoutError):
        rt.Structured(Down()).chat({}, {"type": "object"})


def test_embedding_isolates_the_failing_text(spark):
    class Picky(rt.StubModel):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return super().embed(texts)

    got = rt.embed_all(Picky(dim=4), ["a", "bad", "b", " "], 4)
    assert got[1] == [0.0] * 4 and got[0] != [0.0] * 4 and len(got) == 4
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    assert {r.id: len(r.vector) for r in rt.embedded(df, rt.StubModel(dim=8), dim=8).collect()} == {1: 8, 2: 8}
    answers = rt.answered(spark.createDataFrame([(1, "say one")], "id int, prompt string"), rt.StubModel({"one": "1"}), ["id"]).collect()
    assert answers[0].answer == "1"


def test_triage_repair_and_tools():
    assert rt.chosen_dimensions('x {"dimensions": ["memory", "nope"]}') == ["memory", "correctness"]
    assert rt.chosen_dimensions("no") == rt.DIMENSIONS == rt.chosen_dimensions('{"dimensions": []}')
    assert rt.needs_repair('the "file" is', 0) and not rt.needs_repair("all fine", 0)

    class Asks:
        n = 0

        def chat(self, request):
            self.n += 1
            return json.dumps({"tool": "t", "args": {}}) if request.get("tools") != [] and self.n < 20 else "done"

    model = Asks()
    assert rt.tool_loop(model, {"t": lambda a: "r"}, {"messages": []}) == "done" and model.n == 9


def test_repository_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / ".git").mkdir()
    for name in ("src/a.PY", "src/b.txt", "node_modules/c.js", ".git/d.py", "e.go"):
        (tmp_path / name).write_text("x = 1\n")
    got = {r.file: (r.lang, len(r.hash)) for r in fs.scanned(spark, str(tmp_path)).collect()}
    assert got == {"src/a.PY": ("python", 40), "e.go": ("go", 40)}
    assert fs.guidelines(spark, str(tmp_path)).count() == 0
    (tmp_path / "CONTRIBUTING.md").write_text("be kind")
    (tmp_path / "STYLE.md").write_text("y" * 9000)
    text = fs.guidelines(spark, str(tmp_path)).collect()[0].text
    assert text.startswith("# CONTRIBUTING.md\nbe kind\n\n# STYLE.md\nyyy") and text.endswith("[truncated]") and len(text) == 8000 + len("\n... [truncated]")
    globs = fs.ignore_globs(spark.createDataFrame([(" a/** ",), ("# no",), ("",)], "value string"))
    assert [r.glob for r in globs.collect()] == ["a/**"]


def test_cases_and_saved_findings(spark, tmp_path):
    for i, body in (("b", {"id": "b", "groundTruth": [{"file": "f", "line": 1}]}), ("a", {"id": "a", "labelSource": "negative"})):
        (tmp_path / i).mkdir()
        (tmp_path / i / "case.json").write_text(json.dumps(body))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "case.json").write_text("{broken")
    assert [(r.id, r.labelSource, r.repo) for r in fs.cases(spark, str(tmp_path)).collect()] == [("a", "negative", "."), ("b", "real", ".")]
    one = {"id": "1", "file": "f", "line": 2}
    docs = spark.createDataFrame([(json.dumps([one]),), ("﻿" + json.dumps({"findings": [one, one]}),), (json.dumps(one),), ("no",)], "value string")
    assert fs.saved_findings(spark, docs).count() == 4


def test_index_round_trip_and_settings(spark, tmp_path):
    schemas = {"chunks": "id string, text string", "vectors": "id string, vector array<float>"}
    assert fs.load_index(spark, str(tmp_path), schemas) is None
    fs.save_index(str(tmp_path), chunks=spark.createDataFrame([("a", "t")], schemas["chunks"]))
    back = fs.load_index(spark, str(tmp_path), schemas)
    assert back["chunks"].count() == 1 and back["vectors"].count() == 0
    (tmp_path / "s.toml").write_text("retries = 5\nname = 'file'\n")
    got = fs.settings({"retries": 3, "name": "default", "cache": True}, str(tmp_path / "s.toml"), {"SILTSTONE_CACHE": "no", "SILTSTONE_NAME": ""})
    assert got == {"retries": 5, "name": "file", "cache": False}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "finding_seq bigint, created_at timestamp, kind string"
    spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP '2025-01-01 00:00:00', 'a'), (1L, TIMESTAMP '2025-01-01 00:00:01', 'a'), (2L, TIMESTAMP '2025-01-01 00:20:00', 'b') t(finding_seq, created_at, kind)").coalesce(1).write.parquet(src)
    once = reviews.once_delivered(spark.readStream.schema(schema).parquet(src))
    q = once.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 2
    counts = reviews.windowed_counts(spark.readStream.schema(schema).parquet(src), "created_at", ["kind"], "10 minutes", "1 minute")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.kind, r.n) for r in spark.table("counts").collect()] == [("a", 2)]
    s = "key string, last_sha string, run_id string, updated int"
    record = reviews.recording(str(tmp_path / "state"))
    record(spark.createDataFrame([("k", "1", "r", 1), ("k", "2", "r", 2)], s), 0)
    record(spark.createDataFrame([("j", "1", "r", 1)], s), 1)
    record(spark.createDataFrame([("j", "1", "r", 1)], s), 1)
    assert {(r.key, r.last_sha) for r in spark.read.parquet(str(tmp_path / "state" / "v1")).collect()} == {("k", "2"), ("j", "1")}
