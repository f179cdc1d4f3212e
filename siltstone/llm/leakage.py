"""Evaluation texts leaking into training text, by a prefix-filtered join of word runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import small, staged

#: Words of a shingle.
SHINGLE = 3


def words_of(text: Column) -> Column:
    """The maximal runs of a-z and 0-9 of the lower-cased text."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """The hash of each SHINGLE consecutive words, by position."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - (SHINGLE - 1))), lambda w, i: F.xxhash64(*[w, *[F.get(words, i + k) for k in range(1, SHINGLE)]])
    )


def prefixes_of(windows: DataFrame, hits: DataFrame, run: int) -> DataFrame:
    """The rarest shingle of each item window, by the number of documents it stands in: item_id, variant, window_at, offset and shingle.

    Windows one of whose shingles stands in no document have none.
    """
    frequency = hits.select("doc_id", "shingle").distinct().groupBy("shingle").agg(F.count("*").alias("df"))
    reach = run - SHINGLE + 1
    ahead = Window.partitionBy("item_id", "variant").orderBy("item_pos").rowsBetween(Window.currentRow, reach - 1)
    ranked = windows.join(frequency, "shingle", "left").withColumn("rarity", F.struct(F.coalesce("df", F.lit(0).cast("long")).alias("df"), F.col("item_pos").alias("at"), F.col("shingle").alias("shingle")))
    chosen = ranked.withColumn("rarest", F.min("rarity").over(ahead)).where((F.col("item_pos") + run <= F.col("item_size")) & (F.col("rarest.df") > 0))
    return chosen.select("item_id", "variant", F.col("item_pos").alias("window_at"), (F.col("rarest.at") - F.col("item_pos")).alias("offset"), F.col("rarest.shingle").alias("shingle"))


def leaked(documents: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """Documents that hold at least `run` consecutive words of an item, in order with no word between: doc_id, item_id, each once.

    A window of `run` words of an item is held only if all its shingles are, so its rarest one by document frequency over the
    whole corpus is a necessary prefix of length one. Positions of item shingles in the documents are found by an equi-join on
    hashes and counted; only the prefixes are joined to them, which fixes where the window would lie in the document, and places where it
    doesn't fit are ruled out by position and length. What is left, one row for each document, item and diagonal with its window
    places, is verified on the words themselves: the documents that have such a row are read again, and the words of the two windows
    must be equal one by one. A document's words are never shuffled while its candidates are within session.BROADCAST_ROWS.

    Item-side tables and candidates are broadcast only while their counted rows are within session.BROADCAST_ROWS. Documents are never collected
    or grouped: a source or a copied text with a third of all rows is a third of independent rows. Null, empty and shorter texts
    of either side hold nothing; a repeated id of either side is compared with each of its texts; empty tables give no rows.
    """
    item_words = items.select("item_id", words_of(F.col("text")).alias("words")).where((F.size("words") >= run) & F.col("item_id").isNotNull())
    item_words = staged(item_words.select("item_id", F.xxhash64("words").alias("variant"), "words").distinct(), "item-words")
    windows = item_words.select("item_id", "variant", F.size("words").alias("item_size"), F.posexplode(shingles_of(F.col("words"))).alias("item_pos", "shingle"))
    windows = staged(windows, "item-shingles")
    wanted = windows.select("shingle").distinct()
    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * run - 1)).select("doc_id", F.xxhash64("text").alias("doc_variant"), "text")
    places = texts.withColumn("words", words_of(F.col("text"))).where(F.size("words") >= run)
    places = places.select("doc_id", "doc_variant", F.size("words").alias("doc_size"), F.posexplode(shingles_of(F.col("words"))).alias("doc_pos", "shingle"))
    hits = staged(places.join(small(wanted), "shingle"), "shingle-hits")
    prefixes = staged(prefixes_of(windows, hits, run), "item-prefixes")
    begin = F.col("doc_pos") - F.col("offset")
    likely = hits.join(small(prefixes), "shingle").where((begin >= 0) & (begin + run <= F.col("doc_size")))
    # along one diagonal a document and an item may have many windows in common; their places in the item tell those in the document
    line = ["doc_id", "doc_variant", "item_id", "variant"]
    candidates = likely.select(*line, (begin - F.col("window_at")).alias("diagonal"), "window_at").groupBy(*line, "diagonal").agg(F.sort_array(F.collect_set("window_at")).alias("places"))
    candidates = staged(candidates, "leak-candidates")
    again = texts.join(small(candidates), ["doc_id", "doc_variant"]).join(small(item_words.withColumnRenamed("words", "item_words")), ["item_id", "variant"])
    # within an array of one, the words of a document are made once and not for every place
    same = lambda words: F.exists("places", lambda at: F.slice(words, F.col("diagonal") + at + 1, run) == F.slice("item_words", at + 1, run))
    return again.where(F.exists(F.array(words_of(F.col("text"))), same)).select("doc_id", "item_id").distinct()
