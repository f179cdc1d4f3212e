import numpy as np
import pandas as pd

from siltstone.llm import knn

SCHEMA = "id string, vector array<float>, tile int, other string"


def brute(rows, k=5, least=-2.0):
    seen = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            seen[i] = v
    ids = sorted(seen)
    if not ids:
        return set()
    x = np.array([seen[i] for i in ids], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for a, i in enumerate(ids):
        near = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-round(s[a, b], 12), ids[b]))[:k]
        out |= {(i, ids[b]) for b in near if s[a, b] >= least}
    return out


def clustered(rng, n, spread):
    rows = []
    while len(rows) < n:
        centre = rng.normal(size=64) * rng.uniform(0.5, 5)
        for _ in range(rng.integers(1, 9)):
            rows.append((f"v{len(rows):05d}", (centre + rng.normal(size=64) * spread).astype(np.float32).tolist(), 0, ""))
    return rows


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "TILE_ROWS", 90)
    rows = clustered(np.random.default_rng(2), 400, 0.5)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.id, r.other) for r in knn.most_similar(df).collect()} == brute(rows)
    want = {tuple(sorted(p)) for p in brute(rows, least=0.85)}
    assert {tuple(r) for r in knn.similar_pairs(df).collect()} == want and len(want) > 100


def test_unusable_vectors_copies_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = clustered(rng, 60, 0.3)
    copy = rng.normal(size=64).astype(np.float32).tolist()
    rows += [(f"copy{i:03d}", copy, 0, "") for i in range(200)]
    rows += [("null", None, 0, ""), ("zero", [0.0] * 64, 0, ""), ("short", [1.0] * 48, 0, ""), ("nan", [float("nan")] + [1.0] * 63, 0, ""), ("inf", [float("inf")] + [1.0] * 63, 0, ""), ("hole", [None] + [1.0] * 63, 0, ""), (None, [1.0] * 64, 0, "")]
    rows += [rows[0], rows[70]]
    got = {(r.id, r.other) for r in knn.most_similar(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert {b for a, b in got if a == "copy100"} == {f"copy{i:03d}" for i in range(5)}


def test_tiny_and_empty_tables(spark):
    one = [("a", [1.0] * 64, 0, "")]
    assert knn.most_similar(spark.createDataFrame([], SCHEMA)).count() == 0
    assert knn.most_similar(spark.createDataFrame(one, SCHEMA)).count() == 0
    two = [*one, ("b", [-1.0] * 64, 0, "")]
    assert {(r.id, r.other, round(r.cos, 6)) for r in knn.most_similar(spark.createDataFrame(two, SCHEMA)).collect()} == {("a", "b", -1.0), ("b", "a", -1.0)}


def test_blocks_within_a_pair_of_tiles(monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    rows = clustered(np.random.default_rng(8), 120, 0.4)
    for pair in ((0, 0), (0, 1)):
        tiles = [0 if pair == (0, 0) else i % 2 for i in range(len(rows))]
        codes, factor, left = knn.quantised(knn.unit_rows(np.array([r[1] for r in rows])))
        frame = pd.DataFrame({"id": [r[0] for r in rows], "code": [c.tobytes() for c in codes], "factor": factor, "left": left, "tile": tiles})
        got = knn.tile_pairs(5, float("-inf"))(pair, frame)
        best = brute(rows, k=len(rows))
        x = {r[0]: np.array(r[1], float) / np.linalg.norm(r[1]) for r in rows}
        want = set()
        for i, t in zip(frame["id"], tiles):
            near = sorted((b for a, b in best if a == i and (pair == (0, 0) or tiles[list(frame["id"]).index(b)] != t)), key=lambda b: (-round(float(x[i] @ x[b]), 12), b))[:5]
            want |= {(i, b) for b in near}
        found = set(zip(got["id"], got["other"]))
        assert found >= want and len(got) == len(found)  # candidates: the nearest are among them
        assert all(low <= x[a] @ x[b] <= high for a, b, low, high in got.itertuples(index=False))


def test_int8_margin_is_a_bound():
    rng = np.random.default_rng(0)
    unit = knn.unit_rows(rng.normal(size=(200, 64)))
    codes, factor, left = knn.quantised(unit)
    assert codes.dtype == np.int8
    about = knn.int8_product()(codes, codes) * np.outer(factor, factor)
    assert (np.abs(unit @ unit.T - about) <= left[:, None] + left + np.outer(left, left) + 1e-12).all()


def test_products_are_exact_sums(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-127, 128, (n, 64)).astype(np.int8) for n in (70, 33))
    want = a.astype(np.int64) @ b.astype(np.int64).T
    got = knn.int8_product()(a, b)
    assert got.dtype == np.int32 and (got == want).all()
    monkeypatch.setitem(__import__("sys").modules, "onnxruntime", None)
    assert (knn.int8_product()(a, b) == want).all()


def test_heaps_keep_all_that_can_be_nearest():
    rng = np.random.default_rng(3)
    true = rng.uniform(-1, 1, (40, 300))
    about = (true + rng.uniform(-0.02, 0.02, true.shape)).astype(np.float32)
    for down in (False, True):
        near = knn.Nearest(40, 5, float("-inf"), 0.02)
        for at in range(0, 300, 60):
            part = about[:, at : at + 60]
            near.absorb(np.ascontiguousarray(part.T) if down else part, at, down)
        row, col, _ = near.kept()
        kept = set(zip(row.tolist(), col.tolist()))
        assert all((r, int(c)) in kept for r in range(40) for c in np.argsort(-true[r])[:5])
        assert len(kept) < 40 * 40
