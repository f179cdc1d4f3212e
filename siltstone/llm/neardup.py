"""Near-duplicate records with small edits, by multi-index hashing of fingerprints."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import clean_path
from siltstone.session import staged

#: A fingerprint has SEGMENTS segments of four 16-bit symbols; a segment is one bigint.
SEGMENTS, SYMBOLS = 8, 4
#: Classes that share a form beyond which the form is hot: its pairs are compared by blocks of so many, within the join.
HOT_FORM = 1_000
LANE = 0xFFFF

WORD = re.compile(r"[a-z0-9_]+")


class WordHashes(dict):
    """64-bit hashes of words; emptied when it has grown to a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(words: list[list[str]], run: int, hashes: WordHashes) -> np.ndarray:
    """(len(words), SEGMENTS) int64: of each list, which has at least run words, min-wise symbols of its runs of words."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(counts.sum()))
    shingle = np.zeros(max(0, len(flat) - run + 1), np.uint64)
    for k in range(run):
        shingle = mixed(shingle * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - run + 1 + k])
    ends = np.cumsum(counts)
    keep = np.ones(len(shingle), bool)
    for k in range(1, run):
        keep[(ends[:-1] - k)] = False
    shingle = shingle[keep]
    starts = np.concatenate([[0], np.cumsum(counts - run + 1)[:-1]])
    out = np.zeros((len(words), SEGMENTS), np.uint64)
    rng = np.random.default_rng(7)
    for i in range(SEGMENTS * SYMBOLS):
        xor, odd = rng.integers(0, 2**63, 2, dtype=np.uint64)
        least = np.minimum.reduceat((shingle ^ xor) * (odd * np.uint64(2) + np.uint64(1)), starts)
        out[:, i // SYMBOLS] |= (least & np.uint64(LANE)) << np.uint64(16 * (i % SYMBOLS))
    return out.view(np.int64)


def fingerprinted(run: int, least_words: int):
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            words = [WORD.findall(t.lower()) for t in frame["text"]]
            keep = np.fromiter((len(w) >= max(run, least_words) for w in words), bool, len(words))
            words = [w for w, k in zip(words, keep) if k]
            out = pd.DataFrame({"id": frame["id"][keep], "place": frame["place"][keep]})
            if not words:
                continue
            digests = np.array([divmod(xxhash.xxh3_128_intdigest(" ".join(w)), 2**64) for w in words], np.uint64).view(np.int64)
            out["d0"], out["d1"] = digests[:, 0], digests[:, 1]
            codes = fingerprints(words, run, hashes)
            for s in range(SEGMENTS):
                out[f"s{s}"] = codes[:, s]
            yield out

    return each


def run_sets(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct (text, run) of all texts as sorted whole numbers text * n + run, where each text's begin, and n, the number of different runs."""
    words: dict[str, int] = {}
    cut = [[words.setdefault(w, len(words)) for w in WORD.findall(t.lower())] for t in texts]
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = np.fromiter((w for ws in cut for w in ws), np.int64, int(counts.sum()))
    ends = np.cumsum(counts)
    code = flat
    for k in range(1, run):
        # numbers of the runs of k + 1 words: a run's number and the next word's, numbered anew
        code = np.unique(code[: len(flat) - k] * max(1, len(words)) + flat[k:], return_inverse=True)[1] if len(flat) > k else np.zeros(0, np.int64)
    whole = np.arange(len(code)) + run <= np.repeat(ends, counts)[: len(code)]
    of = np.repeat(np.arange(len(cut)), counts)[: len(code)][whole]
    n = int(code.max(initial=0)) + 1
    keys = np.unique(of * n + code[whole])
    return keys, np.searchsorted(keys, np.arange(len(cut) + 1) * n), n


def agreeing(run: int, least: float):
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            place, texts = pd.factorize(pd.concat([frame["text_a"], frame["text_b"]], ignore_index=True))
            a, b = place[: len(frame)], place[len(frame) :]
            keys, starts, n = run_sets(list(texts), run)
            size = np.diff(starts)
            # all runs of every a, looked up among those of its b
            pair = np.repeat(np.arange(len(frame)), size[a])
            within = np.arange(len(pair)) - np.repeat(np.cumsum(size[a]) - size[a], size[a])
            wanted = keys[starts[a[pair]] + within] % n + b[pair] * n
            found = np.searchsorted(keys, wanted)
            both = np.bincount(pair, (found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == wanted), len(frame)) if len(keys) else np.zeros(len(frame))
            yield frame.loc[both >= least * (size[a] + size[b] - both), ["a", "b"]]

    return each


class NearDuplicates:
    """Rows of one place whose wording agrees, as links between classes of equal wording.

    records has id (bigint), place (bigint, a hash of where near-duplicates are sought) and text (not null). Agreement is the Jaccard
    similarity of the sets of runs of `run` words; rows with fewer than least_words words take no part.

    A fingerprint has 8 segments of 4 min-wise symbols. For each segment the Hamming ball of radius 1 is enumerated as its four
    wildcard forms, one symbol left out: two segments share a form exactly if they differ in one symbol at most. Rows that
    share a form of a segment (the table is an equi-join on place, segment, form) are compared over the complete fingerprint, and
    those at a distance of at most far symbols of 32 by the exact similarity of their texts. At a similarity of 0.6 a segment
    matches with probability 0.475, so one of eight does with 0.994; at 0.7 with 0.9998.

    Equal wordings form a class first and only its least id is compared, so a group of copies costs one row; the join is on 64-bit
    keys, each of a small set of rows even where one place holds a third of all rows. A form that boilerplate makes hot is
    compared in blocks, see hot_pairs.
    """

    def __init__(self, records: DataFrame, run: int, least: float, least_words: int, far: int = 22) -> None:
        codes = [f"s{s}" for s in range(SEGMENTS)]
        kinds = ", ".join(f"{c} bigint" for c in ["id", "place", "d0", "d1", *codes])
        self.rows = staged(records.select("id", "place", "text").mapInPandas(fingerprinted(run, least_words), kinds), "fingerprints")
        same = ["place", "d0", "d1"]
        classes = self.rows.groupBy(*same).agg(F.min("id").alias("class_id"), F.max("id").alias("_last"), *[F.min(c).alias(c) for c in codes])
        self.classes = staged(classes, "classes")
        many = self.classes.where(F.col("class_id") < F.col("_last")).select(*same, "class_id")
        #: id, class_id of the rows other than their class's least
        self.copies = self.rows.select("id", *same).join(many, same).where(F.col("id") != F.col("class_id")).select("id", "class_id").distinct()
        forms = F.array(
            *[
                F.xxhash64("place", F.lit(s * SYMBOLS + k), F.col(f"s{s}").bitwiseAND(F.lit(~(LANE << (16 * k)) if k < 3 else (1 << 48) - 1)))
                for s in range(SEGMENTS)
                for k in range(SYMBOLS)
            ]
        )
        probes = self.classes.select("class_id", F.explode(forms).alias("form"))
        # forms that only one class has, most of them, go before anything is joined
        shared = staged(probes.withColumn("n", F.count("*").over(Window.partitionBy("form"))).where("n > 1"), "shared-forms")
        cold = shared.where(F.col("n") <= HOT_FORM)
        candidates = cold.select(F.col("class_id").alias("a"), "form").join(cold.select(F.col("class_id").alias("b"), "form"), "form").where("a < b").select("a", "b").distinct()
        code_of = lambda side: self.classes.select(F.col("class_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in codes])
        lanes = [
            F.when(F.shiftright(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")), 16 * k).bitwiseAND(F.lit(LANE)) != 0, 1).otherwise(0) for c in codes for k in range(SYMBOLS)
        ]
        close = reduce(lambda x, y: x + y, lanes) <= far
        near = candidates.join(code_of("a"), "a").join(code_of("b"), "b").where(close).select("a", "b")
        self.near = staged(near.unionByName(self.hot_pairs(shared.where(F.col("n") > HOT_FORM), code_of, close)).distinct(), "near")
        texts = records.select("id", "text").dropDuplicates(["id"])
        touched = self.near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = texts.join(touched, "id", "left_semi")
        both = self.near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        #: a, b: ids of classes that agree, a < b
        self.links = both.mapInPandas(agreeing(run, least), "a bigint, b bigint")

    @staticmethod
    def hot_pairs(hot: DataFrame, code_of: Callable[[str], DataFrame], close: Column) -> DataFrame:
        """Near pairs (a, b) among the classes that share a hot form.

        The classes of a form are dealt into blocks of about HOT_FORM, and every pair of blocks is a key of the join, so no task has more than
        two of them; the complete distance is part of the join, so pairs that it rules out are never rows.
        """
        blocks = F.ceil(F.col("n") / HOT_FORM).cast("int")
        own = F.pmod(F.xxhash64("class_id"), blocks).cast("int")
        others = F.explode(F.sequence(F.lit(0), blocks - 1))
        dealt = hot.select("class_id", "form", own.alias("own"), others.alias("other"))
        left = dealt.select(F.col("class_id").alias("a"), "form", F.col("own").alias("i"), F.col("other").alias("j")).join(code_of("a"), "a")
        right = dealt.select(F.col("class_id").alias("b"), "form", F.col("other").alias("i"), F.col("own").alias("j")).join(code_of("b"), "b")
        return left.join(right, ["form", "i", "j"]).where((F.col("a") < F.col("b")) & close).select("a", "b")

    def pairs(self) -> DataFrame:
        """All pairs (a, b), a < b, of rows that agree, those within a class included."""
        own = self.copies.select(F.col("class_id").alias("id"), "class_id").distinct()
        members = self.copies.unionByName(own)
        links = staged(self.links, "links")
        spread = links
        for side in ("a", "b"):
            of = members.select(F.col("class_id").alias(side), F.col("id").alias(f"{side}_id"))
            spread = spread.join(of, side, "left").withColumn(f"{side}_id", F.coalesce(f"{side}_id", side))
        between = spread.select("a_id", "b_id")
        within = members.select("class_id", F.col("id").alias("a_id")).join(members.select("class_id", F.col("id").alias("b_id")), "class_id").where("a_id < b_id").select("a_id", "b_id")
        return between.unionByName(within).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))

    def membership(self) -> DataFrame:
        """One row per row with wording: id, class_id and n_links, the number of other classes its class agrees with."""
        links = staged(self.links, "links")
        degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
        classes = self.classes.select("place", "d0", "d1", "class_id")
        rows = self.rows.select("id", "place", "d0", "d1").distinct().join(classes, ["place", "d0", "d1"])
        return rows.join(degree, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def finding_duplicates(findings: DataFrame, least: float = 0.6, run: int = 3, least_words: int = 20) -> NearDuplicates:
    """Findings of one path that say nearly the same. Null title or rationale is empty; rows without finding_seq or file take no part;
    a row delivered twice counts once; an empty table gives no pairs."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("rationale", F.lit("")))
    known = findings.where(F.col("finding_seq").isNotNull() & F.col("file").isNotNull())
    return NearDuplicates(known.select(F.col("finding_seq").alias("id"), F.xxhash64(clean_path(F.col("file"))).alias("place"), text.alias("text")), run, least, least_words)
