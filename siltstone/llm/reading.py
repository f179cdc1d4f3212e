"""Reading level of documents, by a Rasch-style model of document levels and word difficulties."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import staged

#: The kinds of documents that are prose, and the ends of the scale of bands.
PROSE_KINDS = ["guideline", "design_note", "tutorial", "postmortem"]
FIRST_BAND, LAST_BAND = 1, 5

#: Levels are estimated on a grid that reaches half a band beyond the scale.
STEP = 0.1
GRID = np.round(np.arange(FIRST_BAND - 0.5, LAST_BAND + 0.5 + STEP / 2, STEP), 3)
MIDDLE = (FIRST_BAND + LAST_BAND) / 2

#: Most rated samples that are read to the driver.
SAMPLE_ROWS = 10_000
#: A sentence's length is one observation of a few, each worth this many of a word; spread of the prior of a difficulty.
SENTENCE_WEIGHT, PRIOR = 2.0, 1.0
#: Levels and difficulties are fitted in turn until documents move by less than STILL of a band on average; MOST_TURNS is far beyond what that
#: takes. Within a turn the items' totals by level are renewed ROUNDS times, each after STEPS of Newton's for every item: a turn need not end the
#: inner fit, for the next one goes on with it.
STILL, MOST_TURNS, ROUNDS, STEPS = 0.07, 20, 4, 4
#: Items whose difficulties are broadcast: the most frequent ones; others are joined, and they are too rare for a hot key.
HEAD_ITEMS = 200_000

FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
HEADING = re.compile(r"^[ \t]*(?:#+|//+)([^\n]*)", re.M)
LINE_START = re.compile(r"^[ \t]*(?:[*+-][ \t]+|\d+[.)][ \t]+|>[ \t]*)", re.M)
NOISE = re.compile(r"(?<!\S)\S*?[/_`\d]\S*?(?=[.!?:;,)]*(?:\s|\Z))")
SENTENCE_END = re.compile(r"[.!?]+(?=\s|\Z)|\n[ \t]*\n")
WORD = re.compile(r"[a-z]+(?:'[a-z]+)?")


def occurrences(text: str) -> Counter:
    """Words of the prose of a text and, as "#k", its sentences by length class; code blocks, the marks of headings and lists, identifiers and paths aside."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").lower()
    text = FENCE.sub("\n\n", text)
    # a heading has words, but is no sentence whose length would tell anything
    found = Counter(w for h in HEADING.findall(text) for w in WORD.findall(NOISE.sub(" ", h)))
    text = NOISE.sub(" ", LINE_START.sub("\n\n", HEADING.sub("\n\n", text)))
    for sentence in SENTENCE_END.split(text):
        words = WORD.findall(sentence)
        if len(words) > 1:
            found.update(words)
            found[f"#{min(15, int(2.5 * np.log2(len(words))))}"] += 1
    return found


def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [occurrences(t) for t in frame["text"]]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "items": [list(c) for c in found], "counts": [list(c.values()) for c in found]})


def grid_place(levels: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((levels - GRID[0]) / STEP), 0, len(GRID) - 1).astype(int)


def newton(counts: np.ndarray, a: np.ndarray, b: np.ndarray, exposure: np.ndarray, log_z: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Newton's steps towards the a and b of each item (row of counts, by level) under the rate exp(a + b x) / Z(x), with a normal prior on b."""
    x = GRID - MIDDLE
    for _ in range(steps):
        rate = exposure * np.exp(a[:, None] + np.outer(b, x) - log_z)
        to_a, to_b = counts.sum(1) + 0.1 - rate.sum(1), counts @ x - rate @ x - PRIOR * b
        aa, ab, bb = rate.sum(1) + 0.1, rate @ x, rate @ (x * x) + PRIOR
        d = aa * bb - ab * ab + 1e-9
        a, b = a + np.clip((bb * to_a - ab * to_b) / d, -1, 1), b + np.clip((aa * to_b - ab * to_a) / d, -1, 1)
    return a, b


class Samples:
    """The rated samples: their occurrences, bands and a first fit on them alone."""

    def __init__(self, samples: DataFrame, rater: str) -> None:
        usable = samples.where((F.col("rater") == rater) & F.col("band").between(FIRST_BAND, LAST_BAND) & F.col("text").isNotNull())
        rows = usable.select("sample_id", "band", "text").dropDuplicates(["sample_id"]).orderBy("sample_id").limit(SAMPLE_ROWS).collect()
        self.found = [occurrences(r["text"]) for r in rows]
        self.bands = np.array([r["band"] for r in rows], float)
        self.items = sorted({w for c in self.found for w in c})
        place, where = {w: i for i, w in enumerate(self.items)}, grid_place(self.bands)
        self.counts = np.zeros((len(self.items), len(GRID)))
        for c, g in zip(self.found, where):
            for w, n in c.items():
                self.counts[place[w], g] += n
        self.a, self.b = np.log(self.counts.sum(1) + 0.1), np.zeros(len(self.items))
        self.log_z = np.zeros((2, len(GRID)))
        sentence = np.array([w[0] == "#" for w in self.items], bool)
        for block in (0, 1):
            own = sentence == bool(block)
            counts, exposure = self.counts[own], self.counts[own].sum(0)
            a, b = self.a[own] - np.log(max(1.0, exposure.sum())), self.b[own]
            for _ in range(ROUNDS * 3):
                self.log_z[block] = np.log(np.exp(a[:, None] + np.outer(b, GRID - MIDDLE)).sum(0)) if own.any() else 0
                a, b = newton(counts, a, b, exposure, self.log_z[block], 1)
            self.a[own], self.b[own] = a, b

    def rows(self) -> list[tuple]:
        return [(i, list(c), list(c.values())) for i, c in enumerate(self.found)]

    def tallies(self) -> list[tuple]:
        return [(w, int(g), float(self.counts[i, g])) for i, w in enumerate(self.items) for g in np.flatnonzero(self.counts[i])]


ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


def exploded(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, F.explode(F.arrays_zip("items", "counts")).alias("_x")).select(*more, F.col("_x.items").alias("item"), F.col("_x.counts").alias("n"))


def is_sentence(item: Column) -> Column:
    return F.startswith(item, F.lit("#"))


def levels_of(rows: DataFrame, difficulties: DataFrame, log_z: np.ndarray) -> DataFrame:
    """doc_id, place (where on the grid each document's likelihood is greatest, given the difficulties), fit (the logarithm of that likelihood) and n.

    difficulties has item, a, b and rare. What isn't rare is broadcast; the occurrences of rare items are joined, and then added up by document.
    """
    each = exploded(rows, "doc_id")
    tagged = each.join(F.broadcast(difficulties.where(~F.col("rare")).select("item", "a", "b")), "item", "left")
    rare = difficulties.where("rare").select("item", "a", "b")
    known = tagged.where("b IS NOT NULL").unionByName(tagged.where("b IS NULL").drop("a", "b").join(rare, "item"))
    weight = F.when(is_sentence(F.col("item")), F.lit(SENTENCE_WEIGHT)).otherwise(F.lit(1.0)) * F.col("n")
    log_z = log_z.tolist()
    sums = known.groupBy("doc_id").agg(
        F.sum(weight * F.col("b")).alias("s"), F.sum(weight * F.col("a")).alias("sa"), F.sum(F.when(is_sentence(F.col("item")), 0.0).otherwise(weight)).alias("n0"), F.sum(F.when(is_sentence(F.col("item")), weight).otherwise(0.0)).alias("n1")
    )
    # one expression as text: thousands of calls into the JVM would take longer than the job
    likely = [f"struct(s * {x - MIDDLE!r}D - n0 * {log_z[0][g]!r}D - n1 * {log_z[1][g]!r}D AS l, {g} AS place)" for g, x in enumerate(GRID.tolist())]
    best = sums.select("doc_id", F.expr(f"array_max(array({', '.join(likely)}))").alias("best"), "sa", (F.col("n0") + F.col("n1")).alias("n"))
    return best.select("doc_id", "best.place", (F.col("sa") + F.col("best.l")).alias("fit"), "n")


def counts_of(found: pd.Series) -> np.ndarray:
    """Rows of counts by place of the grid, from lists of (place, n)."""
    counts = np.zeros((len(found), len(GRID)))
    for i, own in enumerate(found):
        for x in own:
            counts[i, x["place"]] = x["n"]
    return counts


def fitted_items(frame: pd.DataFrame, exposure: np.ndarray, totals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and block of each item of a frame (item, found), after the rounds whose log totals are given."""
    counts, block = counts_of(frame["found"]), frame["item"].str.startswith("#").to_numpy(bool).astype(int)
    total = np.maximum(1.0, exposure.sum(1))
    a, b = np.log(counts.sum(1) / total[block]), np.zeros(len(frame))
    for k in (0, 1):
        own = block == k
        for log_z in totals:
            a[own], b[own] = newton(counts[own], a[own], b[own], exposure[k], log_z[k])
    return a, b, block


def difficulties_of(rows: DataFrame, levels: DataFrame, sample_tallies: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """item, a, b and rare under the given levels, and the logarithms of both blocks' totals by level.

    An item's a and b follow from its own counts and the rounds' totals, so a round is one pass that returns the next totals and nothing is shuffled
    but those; the difficulties are written once.
    """
    tallies = exploded(rows.join(levels.select("doc_id", "place"), "doc_id"), "place").groupBy("item", "place").agg(F.sum("n").cast("double").alias("n"))
    tallies = tallies.unionByName(sample_tallies).groupBy("item", "place").agg(F.sum("n").alias("n"))
    # at most one entry for each place of the grid
    found = tallies.groupBy("item").agg(F.collect_list(F.struct("place", "n")).alias("found"), F.floor(F.log2(F.sum("n")) * 4).cast("int").alias("often"))
    table = staged(found, "tallies")
    exposure = np.zeros((2, len(GRID)))
    for r in table.select("item", F.explode("found").alias("x")).groupBy(is_sentence(F.col("item")).cast("int").alias("block"), F.col("x.place").alias("place")).agg(F.sum("x.n").alias("n")).collect():
        exposure[r["block"], r["place"]] = r["n"]
    x = GRID - MIDDLE
    totals = [np.zeros((2, len(GRID)))]
    for _ in range(ROUNDS):

        def summed(frames: Iterator[pd.DataFrame], totals: list[np.ndarray] = list(totals)) -> Iterator[pd.DataFrame]:
            for frame in frames:
                a, b, block = fitted_items(frame, exposure, totals)
                e = np.exp(a[:, None] + np.outer(b, x))
                yield pd.DataFrame({"block": np.repeat([0, 1], len(x)), "place": np.tile(np.arange(len(x)), 2), "z": np.concatenate([e[block == k].sum(0) for k in (0, 1)])})

        log_z = np.zeros_like(totals[0])
        for r in table.select("item", "found").mapInPandas(summed, "block int, place int, z double").groupBy("block", "place").agg(F.sum("z").alias("z")).collect():
            log_z[r["block"], r["place"]] = np.log(r["z"]) if r["z"] > 0 else 0.0
        totals.append(log_z)

    def final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a, b, _ = fitted_items(frame, exposure, totals[:-1])
            yield pd.DataFrame({"item": frame["item"], "a": a, "b": b, "often": frame["often"]})

    fitted = staged(table.mapInPandas(final, "item string, a double, b double, often int"), "difficulties")
    left, least = HEAD_ITEMS, -(2**31)
    for r in sorted(fitted.groupBy("often").count().collect(), key=lambda r: -r["often"]):
        if r["count"] > left:
            least = r["often"] + 1
            break
        left -= r["count"]
    return fitted.select("item", "a", "b", (F.col("often") < least).alias("rare")), log_z


def bands_of_grid(heights: np.ndarray, levels: np.ndarray, bands: np.ndarray) -> list[int]:
    """The band of each place of the grid: a mixture of one normal a band, fitted to the levels of all documents (heights) and, with
    their bands given, the samples'."""
    present = [b for b in range(FIRST_BAND, LAST_BAND + 1) if (bands == b).any()]
    mean = np.array([levels[bands == b].mean() for b in present])
    spread = np.array([max(STEP, levels[bands == b].std()) for b in present])
    share = np.ones(len(present)) / len(present)
    fixed = np.array([[(bands == b)[levels == x].sum() for b in present] for x in GRID], float)

    def density() -> np.ndarray:
        d = np.log(share / spread) - 0.5 * ((GRID[:, None] - mean) / spread) ** 2
        return np.exp(d - d.max(1, keepdims=True))

    for _ in range(50):
        d = density()
        r = d / d.sum(1, keepdims=True) * heights[:, None] + fixed
        n = r.sum(0)
        mean = (r * GRID[:, None]).sum(0) / n
        spread = np.sqrt((r * (GRID[:, None] - mean) ** 2).sum(0) / n + STEP**2 / 4)
        share = n / n.sum()
    return [present[k] for k in np.maximum.accumulate(density().argmax(1))]


def reading_levels(documents: DataFrame, level_samples: DataFrame, rater: str = "rater-a") -> DataFrame:
    """doc_id and band (int) of English prose documents with a letter in their text.

    The model: in a document of level t an occurrence is item w with probability exp(a_w + b_w t) / Z(t), b_w being the item's
    difficulty; words are one block of items and lengths of sentences another. Levels and difficulties are fitted in turn: given
    difficulties, a document's level is the place on a grid where its likelihood is greatest, and given levels, each item's a and b
    come from its counts by level, added up over all documents. The rated samples, whose levels stay fixed, begin and anchor it.
    A mixture fitted to the levels of all documents and the samples then says where one band ends.

    The samples read to the driver are bounded by SAMPLE_ROWS, everything else covers all documents: what reaches the driver is
    by place of the grid. The difficulties of the HEAD_ITEMS most frequent items are broadcast, all others joined; fitting ends by convergence.

    A null lang, kind, id or text, or a text without a letter, gives no row; a document with no known word gets the middle band; without
    rated samples there is no scale and band is null. A repeated doc_id gets one row.
    """
    spark = documents.sparkSession
    prose = documents.where((F.col("lang") == "en") & F.col("doc_kind").isin(PROSE_KINDS) & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull()).select("doc_id", "text")
    samples = Samples(level_samples, rater)
    if not samples.found:
        return prose.select("doc_id", F.lit(None).cast("int").alias("band")).distinct()
    rows = staged(prose.mapInPandas(counted, ROW), "occurrences")
    sample_rows = spark.createDataFrame(samples.rows(), ROW)
    sample_tallies = spark.createDataFrame(samples.tallies(), "item string, place int, n double")
    log_z = samples.log_z
    difficulties = spark.createDataFrame([(w, float(a), float(b), False) for w, a, b in zip(samples.items, samples.a, samples.b)], "item string, a double, b double, rare boolean")
    levels = staged(levels_of(rows, difficulties, log_z), "levels")
    for _ in range(MOST_TURNS):
        difficulties, log_z = difficulties_of(rows, levels, sample_tallies)
        before, levels = levels, staged(levels_of(rows, difficulties, log_z), "levels")
        moved = levels.join(before.select("doc_id", F.col("place").alias("was")), "doc_id").agg(F.avg(F.abs(F.col("place") - F.col("was")))).first()[0]
        if moved is None or moved * STEP < STILL:
            break
    of_samples = {r["doc_id"]: r["place"] for r in levels_of(sample_rows, difficulties, log_z).collect()}
    known = np.array(sorted(of_samples))
    heights = np.zeros(len(GRID))
    for r in levels.groupBy("place").count().collect():
        heights[r["place"]] = r["count"]
    bands = bands_of_grid(heights, GRID[[of_samples[i] for i in known]], samples.bands[known])
    by_place = F.array(*[F.lit(b) for b in bands])
    return rows.select("doc_id").distinct().join(levels, "doc_id", "left").select("doc_id", F.coalesce(F.get(by_place, F.col("place")), F.lit(int(MIDDLE))).alias("band"))
