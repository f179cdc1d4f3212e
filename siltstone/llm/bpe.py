"""Encoding of the whole corpus by byte-pair merges, replayed over a vocabulary of words."""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import staged

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"

#: What counts as white space, and how the byte-level tokenizer cuts a text into words.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Words of the corpus that are merged once for all of it and broadcast with their ids: the most frequent ones, of at most LONGEST_KEPT characters
#: (so the broadcast has at most about 100 MB); words over which one inverted index spans, and others kept with their ids by one task.
HEAD_WORDS, LONGEST_KEPT, INDEX_WORDS, KEPT_WORDS = 200_000, 64, 50_000, 200_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file by id; a token's id is the rank of its merge."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    return [token for _, token in ranked]


class MergeReplay:
    """All merges over a set of words at once: a rank's merge is applied wherever its pair stands, rank by rank."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens, self.ids = tokens, {t: i for i, t in enumerate(tokens)}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.merged: dict[int, int] = {}

    def rank(self, a: int, b: int) -> int:
        """The token that a and b make, or -1."""
        key = a << 20 | b
        made = self.merged.get(key)
        if made is None:
            made = self.merged[key] = self.ids.get(self.tokens[a] + self.tokens[b], -1)
        return made

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word.

        Symbols of all words stand in one array, a barrier after each word. The index maps a rank to the positions where its pair
        begins. The least rank is taken from the heap, its pair is merged at each of its positions from left to right, and only
        the pairs with the two neighbours enter the index anew.
        """
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        start = self.single[raw]
        start[ends] = -1
        symbols = start.tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = defaultdict(list)
        rank = self.rank
        for i in np.flatnonzero((start[:-1] >= 0) & (start[1:] >= 0)).tolist():
            if (r := rank(symbols[i], symbols[i + 1])) >= 0:
                index[r].append(i)
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            for i in sorted(index.pop(r)):
                j, a = after[i], symbols[i]
                if a < 0 or symbols[j] < 0 or rank(a, symbols[j]) != r:
                    continue
                symbols[i], symbols[j] = r, -2
                k = after[i] = after[j]
                before[k] = i
                if symbols[k] >= 0 and (made := rank(r, symbols[k])) >= 0:
                    if made not in index:
                        heappush(heap, made)
                    index[made].append(i)
                p = before[i]
                if p >= 0 and symbols[p] >= 0 and (made := rank(symbols[p], r)) >= 0:
                    if made not in index:
                        heappush(heap, made)
                    index[made].append(p)
        left = np.array(symbols, np.int32)
        left = left[left != -2]
        cuts = np.flatnonzero(left == -1)
        flat = left.tolist()
        return [flat[a:b] for a, b in zip([0, *(cuts[:-1] + 1).tolist()], cuts.tolist())]


class CorpusEncoder:
    """Texts to ids; head words and those of earlier batches are known, those new to a batch are merged together."""

    def __init__(self, tokens: list[bytes], head: dict[str, list[int]] | None = None) -> None:
        self.replay, self.head = MergeReplay(tokens), head or {}
        self.words, self.ascii_words = regex.compile(WORDS).findall, regex.compile(ASCII_WORDS).findall
        self.known: dict[str, list[int]] = dict(self.head)

    def encode(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        if len(self.known) > len(self.head) + KEPT_WORDS:
            self.known = dict(self.head)
        known = self.known
        cut = [(self.ascii_words if t.isascii() else self.words)(t) if t else [] for t in texts]
        new = list({w for ws in cut for w in ws if w not in known})
        if new:
            known.update(zip(new, self.replay.encode([w.encode("utf-8", "replace") for w in new])))
        return cut

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts; null and empty ones have none."""
        cut = self.encode(texts)
        of = self.known.__getitem__
        lists = [list(chain.from_iterable(map(of, ws))) for ws in cut]
        offsets = np.zeros(len(lists) + 1, np.int32)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        values = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
        for w in [w for ws in cut for w in ws if len(w) > LONGEST_KEPT]:
            self.known.pop(w, None)
        return offsets, values


def frequent_words(documents: DataFrame, text: str, most: int) -> DataFrame:
    """word of the most frequent words of all texts, `most` at most.

    Words are counted on the map side first. How often a word must occur follows from a histogram of the counts by quarters of powers of two, so nothing is
    sorted and no task takes more than its share. Java's letters and digits may differ from the encoder's in rare characters: a word
    that is cut otherwise here is not looked up there, which changes no id.
    """
    words = documents.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORDS), 0)).alias("word")).where(F.length("word") <= LONGEST_KEPT)
    level = F.floor(F.log2("n") * 4).cast("int")
    counted = staged(words.groupBy("word").agg(F.count("*").alias("n")).withColumn("level", level), "corpus-words")
    left, least = most, 0
    for r in sorted(counted.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        if r["count"] > left:
            least = r["level"] + 1
            break
        left -= r["count"]
    return counted.where(F.col("level") >= least).select("word")


def merged_words(words: DataFrame, tokens: Broadcast) -> DataFrame:
    """word and ids of distinct words: each task replays all merges over its words, INDEX_WORDS of them in one inverted index."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, waiting = MergeReplay(tokens.value), []

        def replayed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(waiting, pa.string()), pa.array(replay.encode([w.encode() for w in waiting]), pa.list_(pa.int32()))], names=["word", "ids"])

        for records in batches:
            waiting += records.column(0).to_pylist()
            if len(waiting) >= INDEX_WORDS:
                yield replayed()
                waiting = []
        if waiting:
            yield replayed()

    return words.repartition(words.sparkSession.sparkContext.defaultParallelism, "word").mapInArrow(each, "word string, ids array<int>")


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", batch: int = 512) -> DataFrame:
    """key and ids (array<int>) of every row: the byte-pair ids of its text without special tokens.

    A null or empty text gives an empty list; text that spells a special token is plain text. Rows map one to one, whatever they hold.

    The merges are replayed over the words of the whole corpus: each of its HEAD_WORDS most frequent words enters an inverted index from rank to
    positions once, and every merge is applied there in rank order, touching only neighbours. Their ids are broadcast, a bounded table. Rarer
    words, if there are more, are merged by the task that meets them, through an index over all the new words of `batch` rows: joining
    their ids back to their places would move the documents, and they are too rare for their merges to be shared.
    """
    tokens = documents.sparkSession.sparkContext.broadcast(read_ranks(path))
    # at most HEAD_WORDS rows
    merged = merged_words(frequent_words(documents, text, HEAD_WORDS), tokens).toArrow()
    head = documents.sparkSession.sparkContext.broadcast(dict(zip(merged.column("word").to_pylist(), merged.column("ids").to_pylist())))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CorpusEncoder(tokens.value, head.value)
        for records in batches:
            for at in range(0, records.num_rows, batch):
                part = records.slice(at, batch)
                offsets, values = encoder.ids(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(each, f"{key} {kind}, ids array<int>")
