"""Most similar vectors for every vector, by a block matrix join of int8 codes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from heapq import heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import staged

#: Rows of a tile (with its partner it bounds a task's memory) and of a block of products within, which stays in a core's cache.
TILE_ROWS, BLOCK_ROWS = 65_536, 1_024
#: Sums of products of codes below this are whole numbers in float32 too.
WHOLE_FLOAT = 1 << 24


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles; the greatest entry is taken out first, so that squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, the factor of each row's codes, and the length of what they leave of it."""
    factor = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / factor[:, None]).astype(np.int8)
    left = np.sqrt(np.square(unit - codes * factor[:, None]).sum(axis=1))
    return codes, factor, left


def coded(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with the codes, factor and left of their vectors as further columns."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            codes, factor, left = quantised(unit_rows(x))
            more = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor), pa.array(left)]
            yield pa.record_batch([*batch.columns, *more], names=[*batch.schema.names, "code", "factor", "left"])

    return each


def int8_product() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The products of the int8 rows of one matrix with those of another, summed exactly: int32 by the processor's int8 instructions (a graph of one
    node, on one thread), or whole numbers in float32 where nothing is installed that multiplies int8, or the processor doesn't do so exactly."""
    kind = lambda a: np.float32 if a.shape[1] * 127 * 127 < WHOLE_FLOAT else np.int64
    by_float = lambda a, b: a.astype(kind(a)) @ b.astype(kind(a)).T
    try:
        import onnxruntime
    except ImportError:
        return by_float

    def number(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    def field(place: int, value: int | bytes) -> bytes:
        return number(place << 3) + number(value) if isinstance(value, int) else number(place << 3 | 2) + number(len(value)) + value

    def matrix(name: bytes, kind: int, *sides: bytes) -> bytes:
        shape = b"".join(field(1, field(2, side)) for side in sides)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    # in the ONNX format 2 is uint8, 3 int8 and 6 int32; processors multiply unsigned codes with signed ones, so one side's are shifted and a zero point
    # takes that back
    node = field(1, b"a") + field(1, b"b") + field(1, b"zero") + field(2, b"y") + field(4, b"MatMulInteger")
    sides = [matrix(b"a", 2, b"n", b"k"), matrix(b"b", 3, b"k", b"m"), matrix(b"zero", 2)]
    graph = field(1, node) + field(2, b"product") + b"".join(field(11, x) for x in sides) + field(12, matrix(b"y", 6, b"n", b"m"))
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    session = onnxruntime.InferenceSession(field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13)), options, providers=["CPUExecutionProvider"])
    zero = np.array(128, np.uint8)
    by_int8 = lambda a, b: session.run(None, {"a": a.view(np.uint8) ^ zero, "b": np.ascontiguousarray(b.T), "zero": zero})[0]
    # some older processors cut sums of two products at 16 bits: there the greatest codes give it away
    far = np.repeat(np.array([[127], [-127]], np.int8), 64, axis=1)
    return by_int8 if (by_int8(far, far) == by_float(far, far)).all() else by_float


class Nearest:
    """What can be among the k nearest columns of some rows, judged by approximate cosines that are off by at most margin.

    Each row has a heap of its k greatest approximate cosines. The k-th nearest column has a true cosine of at least the heap's root less the
    margin, so a column whose approximate cosine is less than the root by more than two margins is not among the nearest.
    """

    def __init__(self, n: int, k: int, least: float, margin: float) -> None:
        self.k, self.margin = k, margin
        self.heaps: list[list[float]] = [[] for _ in range(n)]
        self.floor = np.full(n, least - margin, np.float32)
        self.seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def absorb(self, cosines: np.ndarray, first: int, down: bool = False) -> None:
        """cosines: approximate ones of all rows with the columns first, first + 1, ...; down: its columns are the rows."""
        m = cosines.shape[not down]
        if m > 2 * self.k and np.isneginf(self.floor).any():
            # the block's k greatest alone give floors that hold, so only little of a first block enters the heaps
            kth = np.partition(cosines, m - self.k, axis=int(not down)).take(m - self.k, axis=int(not down))
            self.floor = np.maximum(self.floor, kth - np.float32(2 * self.margin))
        at = np.flatnonzero(cosines >= (self.floor[None, :] if down else self.floor[:, None]))
        for some in range(0, len(at), 1 << 20):
            i, j = np.divmod(at[some : some + (1 << 20)], cosines.shape[1])
            rows, cols = (j, i) if down else (i, j)
            self.take(rows, cols + first, cosines[i, j])

    def least_product(self, factor: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The least whole product of codes by which each row can still meet its floor, with any of the other factors."""
        return np.clip(np.floor(self.floor / (factor * np.where(self.floor >= 0, others.max(), others.min()))) - 1, -(2**31), 2**31 - 1).astype(np.int32)

    def take(self, rows: np.ndarray, cols: np.ndarray, found: np.ndarray) -> None:
        """Approximate cosines of some rows with some columns: those that meet the floors are kept and enter the heaps."""
        keep = (found >= self.floor[rows]) & ~np.isneginf(found)
        if not keep.any():
            return
        rows, cols, found = rows[keep], cols[keep], found[keep]
        self.seen.append((rows, cols, found))
        k, heaps = self.k, self.heaps
        for row, cosine in zip(rows.tolist(), found.tolist()):
            heap = heaps[row]
            if len(heap) < k:
                heappush(heap, cosine)
            elif cosine > heap[0]:
                heapreplace(heap, cosine)
        for row in set(rows.tolist()):
            if len(heaps[row]) == k:
                self.floor[row] = max(self.floor[row], np.float32(heaps[row][0] - 2 * self.margin))

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and approximate cosine of what the floors leave at the end."""
        if not self.seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        row, col, cosine = (np.concatenate(c) for c in zip(*self.seen))
        keep = cosine >= self.floor[row]
        return row[keep], col[keep], cosine[keep]


def tile_pairs(k: int, least: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A task on one pair of tiles: what can be among the k nearest of each row within the partner tile, with bounds of its cosine."""

    def blocks(n: int) -> list[slice]:
        return [slice(i, min(n, i + BLOCK_ROWS)) for i in range(0, n, BLOCK_ROWS)]

    def each(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        product = int8_product()
        sides = []
        for t in (i, j) if i != j else (i,):
            own = frame[frame["tile"] == t]
            codes = np.frombuffer(b"".join(own["code"]), np.int8).reshape(len(own), -1)
            sides.append((own["id"].to_numpy(), codes, own["factor"].to_numpy(np.float32), float(own["left"].max() if len(own) else 0)))
        (ids_a, a, factor_a, left_a), (ids_b, b, factor_b, left_b) = sides[0], sides[-1]
        margin = left_a + left_b + left_a * left_b + 1e-5
        out = []
        if len(a) and len(b):
            of_b = [Nearest(s.stop - s.start, k, least, margin) for s in blocks(len(b))]
            for s in blocks(len(a)):
                of_a = Nearest(s.stop - s.start, k, least, margin) if i != j else of_b[s.start // BLOCK_ROWS]
                for t, nearest_b in zip(blocks(len(b)), of_b):
                    if i == j and t.start < s.start:
                        continue
                    whole, own = product(a[s], b[t]), i == j and s == t
                    if own or np.isneginf(of_a.floor).any() or np.isneginf(nearest_b.floor).any():
                        cosines = whole * factor_b[t] * factor_a[s][:, None]
                        if own:
                            np.fill_diagonal(cosines, -np.inf)
                        of_a.absorb(cosines, t.start)
                        if not own:
                            nearest_b.absorb(cosines, s.start, down=True)
                        continue
                    # whole numbers are compared with whole ones, and only what either side can use is turned into cosines
                    some = whole >= of_a.least_product(factor_a[s], factor_b[t])[:, None]
                    some |= whole >= nearest_b.least_product(factor_b[t], factor_a[s])[None, :]
                    at = np.flatnonzero(some)
                    if len(at):
                        row, col = np.divmod(at, whole.shape[1])
                        found = whole[row, col] * factor_b[t][col] * factor_a[s][row]
                        of_a.take(row, col + t.start, found)
                        nearest_b.take(col, row + s.start, found)
                if i != j:
                    row, col, cosine = of_a.kept()
                    out.append((ids_a[row + s.start], ids_b[col], cosine))
            for t, nearest_b in zip(blocks(len(b)), of_b):
                row, col, cosine = nearest_b.kept()
                out.append((ids_b[row + t.start], ids_a[col], cosine))
        ids, others, cosine = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, object), np.zeros(0, object), np.zeros(0))
        cosine = cosine.astype(np.float64)
        return pd.DataFrame({"id": ids, "other": others, "low": cosine - margin, "high": cosine + margin})

    return each


def exact(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a, b and the cosine of their vectors v_a and v_b in doubles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (unit_rows(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)) for c in ("v_a", "v_b"))
            cosine = np.minimum(1.0, np.einsum("ij,ij->i", x, y))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(cosine)], names=["a", "b", "cos"])

    return each


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """id and vector of rows with dim finite numbers that are not all zero, each id once."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col("id").isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0))
    return good.select("id", "vector").dropDuplicates(["id"])


def most_similar(vectors: DataFrame, k: int = 5, least: float = float("-inf"), dim: int = 64) -> DataFrame:
    """For every usable vector the k others of the greatest cosine, at least `least`; ties go to the smaller id.

    The vectors are dealt into tiles by a hash, and every pair of tiles is one task: int32 products of int8 codes give each cosine up to
    the lengths of what quantisation left. A heap of the k greatest for each row rules out what this bound can, first within the task, then
    over all tasks; only the pairs that are left are recomputed from the floats and ranked. The result is exact, not approximate.
    Work grows with the square of the number of distinct vectors (64 multiply-adds of int8 a pair, each pair once), memory by tile; the
    codes, a quarter of the floats, move once for each tile, the floats only for surviving pairs.

    Equal vectors form a class and enter the products once. A row needs k neighbours at most, so k + 1 members of a class stand for
    it as neighbours while every member gets its own result: a third of all rows may be copies of one vector.

    Null, short, long, zero or non-finite vectors and null ids take no part; a repeated id counts once (its copies are taken to be
    equal). An empty table gives no rows. Returns id, other, cos.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors, dim), "vectors")
    classes = rows.groupBy("vector").agg(F.min("id").alias("class"), F.count("*").alias("n"))
    kinds = f"vector array<float>, class {rows.schema['id'].dataType.simpleString()}, n bigint, code binary, factor double, left double"
    classes = staged(classes.mapInArrow(coded(dim), kinds), "vector-classes")
    count = classes.count()
    cores = spark.sparkContext.defaultParallelism
    tiles = max(1, math.ceil(count / TILE_ROWS), min(math.ceil(math.sqrt(4 * cores)), math.ceil(count / BLOCK_ROWS)))
    tile = F.pmod(F.xxhash64("class"), F.lit(tiles)).cast("int")
    partners = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    dealt = classes.select(F.col("class").alias("id"), "code", "factor", "left", tile.alias("tile")).select("*", partners.alias("with"))
    paired = dealt.select("id", "code", "factor", "left", "tile", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"))
    pairs = tiles * (tiles + 1) // 2
    spread = paired.repartition(pairs, F.col("i"), F.col("j"))
    bounded = spread.groupBy("i", "j").applyInPandas(tile_pairs(k, least), "id string, other string, low double, high double")
    # over all tiles: the k-th greatest lower bound is a floor of the k-th cosine
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("low")))
    floor = F.max(F.when(F.col("_place") == k, F.col("low"))).over(Window.partitionBy("id"))
    left = bounded.withColumn("_place", place).withColumn("_floor", floor).where(F.col("_floor").isNull() | (F.col("high") >= F.col("_floor")))
    open_pairs = left.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    of = lambda side: classes.select(F.col("class").alias(side), F.col("vector").alias(f"v_{side}"))
    known = open_pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "v_a", "v_b").mapInArrow(exact(dim), "a string, b string, cos double").where(F.col("cos") >= least)
    known = known.select("cos", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("_x")).select("_x.*", "cos")
    by_class = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    nearest = staged(known.withColumn("_rank", F.row_number().over(by_class)).where(F.col("_rank") <= k).drop("_rank"), "nearest")
    copied = classes.where("n > 1").select("vector", "class")
    members = rows.join(copied, "vector").select("id", "class")
    members = staged(members, "vector-copies")
    donors = members.withColumn("_rank", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("_rank") <= k + 1)
    donors = donors.select(F.col("class").alias("other"), F.col("id").alias("donor"))
    others = nearest.join(donors, "other", "left").select("id", F.coalesce("donor", "other").alias("other"), "cos")
    own = donors.select(F.col("other").alias("id"), F.col("donor").alias("other"), F.lit(1.0).alias("cos"))
    ranked = others.unionByName(own).withColumn("_rank", F.row_number().over(by_class)).where(F.col("_rank") <= k + 1)
    spread_out = ranked.join(members.select(F.col("class").alias("id"), F.col("id").alias("member")), "id", "left")
    spread_out = spread_out.select(F.coalesce("member", "id").alias("id"), "other", "cos").where("id <> other")
    return spread_out.withColumn("_rank", F.row_number().over(by_class)).where(F.col("_rank") <= k).drop("_rank")


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.85, dim: int = 64) -> DataFrame:
    """Pairs id_a < id_b of a cosine of at least `least` in which one is among the k most similar of the other."""
    near = most_similar(vectors, k, least, dim)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
