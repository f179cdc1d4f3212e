"""Search by vector and by keyword."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.review import keywords
from siltstone.session import small, staged

#: Rows of a tile of the collection and of a block of queries; the two and their products fit into one task.
TILE_ROWS, QUERY_ROWS = 65_536, 2_048
#: Records and characters of a block of keyword search, and queries that meet it at once.
BLOCK_RECORDS, BLOCK_CHARS, BLOCK_QUERIES = 20_000, 32_000_000, 100_000
#: Bytes of the rows of frequent words in a block of keyword search, one byte a record.
ROW_BYTES = 32_000_000
#: What can hold a keyword in a lower-cased text.
HOLDER = re.compile(r"[a-z0-9_]{4,}")


def _scores(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def matrix(frame: pd.DataFrame, n: int) -> np.ndarray:
        out = np.zeros((len(frame), n))
        for i, v in enumerate(frame["vector"]):
            out[i, : len(v)] = v
        norm = np.sqrt(np.square(out).sum(1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    def each(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        queries = queries.rename(columns={"q_id": "id", "q_vector": "vector"})
        rows = rows.rename(columns={"r_id": "id", "r_vector": "vector"}).sort_values("id", kind="stable")
        n = max(max(map(len, queries["vector"])), max(map(len, rows["vector"])))
        a, b = matrix(queries, n), matrix(rows, n)
        product = a @ b.T
        keep = min(k, product.shape[1])
        # all columns at least as good as the k-th, so that ties are settled by id
        kth = np.partition(product, product.shape[1] - keep, axis=1)[:, -keep]
        q, c = np.nonzero(product >= kth[:, None] - 1e-9)
        found = pd.DataFrame({"query": queries["id"].to_numpy()[q], "id": rows["id"].to_numpy()[c], "score": product[q, c]})
        return found.assign(r=found["score"].round(9)).sort_values(["query", "r", "id"], ascending=[True, False, True]).groupby("query").head(k)[["query", "id", "score"]]

    return each


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """For each query (id, vector) the k rows (id, vector) of the greatest cosine: query, id, score, place (from 1).

    Brute force in blocks: every block of queries meets every tile of rows once as a matrix product, keeps k a query, and the
    kept are ranked. Ties (to 9 digits) go to the smaller id; a zero vector scores 0 with everything; null vectors take no part.
    """
    n_rows, n_queries = rows.count(), queries.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, math.ceil(n_rows / TILE_ROWS), min(cores, math.ceil(n_rows / QUERY_ROWS)))
    blocks = max(1, math.ceil(n_queries / QUERY_ROWS))
    placed = lambda df, side, own, n_own, other, n_other: df.where(F.col("vector").isNotNull()).select(
        F.col("id").alias(f"{side}_id"), F.col("vector").alias(f"{side}_vector"), F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
    )
    q = placed(queries, "q", "block", blocks, "tile", tiles).groupBy("block", "tile")
    r = placed(rows, "r", "tile", tiles, "block", blocks).groupBy("block", "tile")
    q_type, r_type = queries.schema["id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    found = q.cogroup(r).applyInPandas(_scores(k), f"query {q_type}, id {r_type}, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _recalled(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def postings(texts: list[str], numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The records of each term, terms one after the other, and where each term begins."""
        lengths: dict[str, set[int]] = {}
        for t in numbers:
            lengths.setdefault(t[:4], set()).add(len(t))
        # a term is one run of word characters, so it stands in a text where it stands in a word of it; every word is taken apart once
        held: dict[str, set[int]] = {}
        term, record = array("i"), array("i")
        for j, said in enumerate(texts):
            own: set[int] = set()
            for word in set(HOLDER.findall(said)):
                if (has := held.get(word)) is None:
                    has = held[word] = {numbers[t] for i in range(len(word) - 3) for n in lengths.get(word[i : i + 4], ()) if (t := word[i : i + n]) in numbers}
                own |= has
            term.extend(own)
            record.extend(repeat(j, len(own)))
        term = np.frombuffer(term, np.int32) if term else np.empty(0, np.int32)
        record = np.frombuffer(record, np.int32) if record else np.empty(0, np.int32)
        return record[np.argsort(term, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(numbers)))])

    def each(queries: pa.Table, records: pa.Table) -> pa.Table:
        records = records.take(pc.sort_indices(records, [("seq", "ascending"), ("id", "ascending")], null_placement="at_start"))
        asked: dict[tuple[str, ...], list[int]] = {}  # equal wordings are scored once
        for i, terms in enumerate(queries["terms"].to_pylist()):
            asked.setdefault(tuple(sorted(terms)), []).append(i)
        numbers = {t: i for i, t in enumerate(dict.fromkeys(t for terms in asked for t in terms))}
        n, query, found, scores = len(records), array("q"), array("q"), array("q")
        if n and numbers:
            at, starts = postings(records["said"].to_pylist(), numbers)
            rows = {}
            for t in np.argsort(-np.diff(starts), kind="stable")[: ROW_BYTES // n].tolist():
                rows[t] = np.zeros(n, np.uint8)
                rows[t][at[starts[t] : starts[t + 1]]] = 1
            kind = np.min_scalar_type(max(map(len, asked)))
            for terms, who in asked.items():
                score = np.zeros(n, kind)
                for t in map(numbers.__getitem__, terms):
                    if t in rows:
                        score += rows[t]
                    else:
                        score[at[starts[t] : starts[t + 1]]] += 1
                for _ in range(min(k, n)):
                    best = int(score.argmax())  # the first of the greatest, and records are in order of seq
                    if not score[best]:
                        break
                    query.extend(who)
                    found.extend(repeat(best, len(who)))
                    scores.extend(repeat(int(score[best]), len(who)))
                    score[best] = 0
        query, found = pa.array(query, pa.int64()), pa.array(found, pa.int64())
        return pa.table({"query_id": queries["query_id"].take(query), "id": records["id"].take(found), "seq": records["seq"].take(found), "score": pa.array(scores, pa.int64())})

    return each


def keyword_recall(queries: DataFrame, memory: DataFrame, k: int = 3) -> DataFrame:
    """For each query (query_id, category, query) the k records of its category with the most query words in title or text (as parts of words, repeats
    counted; at least one): query_id, id, score, place. Ties go to the smaller seq, then id.

    The records of a category are dealt by their hash into blocks of about BLOCK_RECORDS and BLOCK_CHARS, its queries into blocks of about BLOCK_QUERIES,
    and every block of queries meets every block of records once, so a category with a third of all records spreads over many tasks. There each word of the
    records is taken apart once; a query adds up the rows of its words (a byte a record) and keeps k. Memory is read twice: for the sizes, and for its texts.
    """
    terms = queries.select("query_id", "category", keywords(F.col("query")).alias("terms")).where("category IS NOT NULL AND size(terms) > 0")
    pool = memory.where("category IS NOT NULL").select("id", "seq", "category", F.lower(F.concat_ws(" ", "title", "text")).alias("said"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_RECORDS, F.sum(F.length("said")) / BLOCK_CHARS, F.lit(1.0))).cast("int")
    sizes = pool.groupBy("category").agg(blocks.alias("blocks")).join(terms.groupBy("category").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks")), "category")
    sizes = small(staged(sizes, "recall-blocks"))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["category", "query_block", "block"]
    q = terms.join(sizes, "category").select("category", dealt("query_blocks", "query_id", "terms").alias("query_block"), every("blocks").alias("block"), "query_id", "terms").groupBy(*keys)
    r = pool.join(sizes, "category").select("category", every("query_blocks").alias("query_block"), dealt("blocks", "id", "seq").alias("block"), "id", "seq", "said").groupBy(*keys)
    types = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", *(f"{c} {memory.schema[c].dataType.simpleString()}" for c in ("id", "seq")), "score bigint"]
    scored = q.cogroup(r).applyInArrow(_recalled(k), ", ".join(types))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq", "id"))
    return scored.withColumn("place", place).where(F.col("place") <= k).drop("seq")
