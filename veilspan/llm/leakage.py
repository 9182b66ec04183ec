"""Evaluation passages inside a training corpus: a distributed positional inverted index.

The corpus is tokenised once into postings (doc, position, term) and stored. Only terms that
occur in the test items are kept: no other posting can take part in a match, and the test
vocabulary is small next to the corpus. A match of ``n`` consecutive item words puts all of
them at the same distance between item offset and document position, so for every window of
``n`` item words the lists of its terms, shifted by their offsets, must meet. The shortest
list of each window - its rarest words, by counts over the whole corpus - gives the candidate
alignments; the other lists are intersected only at these. Since hits of a single term meet
every item offset that holds it, the lists that start the intersection are those of two
adjacent words: each posting also keeps a hash of the word that follows it.

That shortcut holds for whole windows only: a window with altered words lacks the pairs they
stand in. Proximity matches start from all runs of words that so many words in place must
hold (three words for 10 of 13) and compare every alignment that has enough of them.

A word is a maximal run of letters and digits in lower case; everything else separates.
Null and empty texts hold no words; items shorter than ``n`` words cannot leak. A repeated
item id or document id is taken as one text per row: matches of any row count for the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.let import let
from veilspan.session import durable

#: Words in a row that make a leak.
WINDOW = 13
#: Rows up to which a table of test terms or anchors is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: Aligned words of a window that make a proximity match.
NEAR = 10


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a stored table of at most ``BROADCAST_ROWS`` rows; else leave the join to the planner."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _word_rows(df: DataFrame, text: str, *keys: Column) -> DataFrame:
    """One row per word: keys, pos, term and a hash of the word after it (null for the last)."""
    listed = df.where(F.col(text).isNotNull()).select(*keys, words(F.col(text)).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("term"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("next"))
    return listed.select(*[c for c in listed.columns if c != "w"], F.posexplode(pairs).alias("pos", "pair")).select(
        *[c for c in listed.columns if c != "w"], "pos", F.col("pair.term").alias("term"), F.when(F.col("pair.next").isNotNull(), F.xxhash64("pair.next")).alias("next_id")
    )


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, copy, offset, term, term_id, next_id) of every word of the items; ``copy`` tells texts of one id apart."""
    rows = _word_rows(items, text, F.col(item).alias("item_id"), F.xxhash64(F.col(text)).alias("copy")).withColumnRenamed("pos", "offset")
    return durable(rows.distinct().withColumn("term_id", F.xxhash64("term")), "terms")


def postings(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: (doc_id, pos, term_id, next_id) of every corpus word that is a test term."""
    vocabulary = durable(terms.select("term", "term_id").distinct(), "vocabulary")
    rows = _word_rows(docs, text, F.col(doc).alias("doc_id"))
    return durable(rows.join(_small(vocabulary), "term").select("doc_id", "pos", "term_id", "next_id"), "postings")


def anchors(terms: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, copy, offset, term_id, next_id) of the rarest pair of adjacent words of every window.

    A window with a pair the corpus lacks cannot match as a whole and gives no anchor.
    """
    pairs = durable(terms.where("next_id IS NOT NULL").select("term_id", "next_id").distinct(), "pairs")
    counts = durable(index.join(_small(pairs), ["term_id", "next_id"]).groupBy("term_id", "next_id").agg(F.count("*").alias("n")), "counts")
    line = Window.partitionBy("item_id", "copy").orderBy("offset")
    inside = line.rowsBetween(0, window - 2)
    ranked = terms.join(_small(counts), ["term_id", "next_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return (
        ranked.withColumn("full", F.count("*").over(line.rowsBetween(0, window - 1)))
        .withColumn("best", F.min(F.struct("n", "offset", "term_id", "next_id")).over(inside))
        .where((F.col("full") == window) & (F.col("best.n") > 0))
        .select("item_id", "copy", "best.offset", "best.term_id", "best.next_id")
        .distinct()
    )


def alignments(terms: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, copy, delta, offset) of every item word met at a candidate alignment.

    Around each anchor hit the ``window - 1`` item words to either side are looked up in the
    index at their shifted positions; every full window that holds the anchor lies in there.
    """
    marks = durable(anchors(terms, index, window), "anchors")
    hits = index.join(_small(marks), ["term_id", "next_id"]).select("doc_id", "item_id", "copy", (F.col("pos") - F.col("offset")).alias("delta"), F.col("offset").alias("at"))
    near = _small(terms.select("item_id", "copy", "offset", "term_id"))
    wanted = (
        hits.join(near, ["item_id", "copy"])
        .where(F.abs(F.col("offset") - F.col("at")) < window)
        .select("doc_id", "item_id", "copy", "delta", "offset", (F.col("delta") + F.col("offset")).alias("pos"), "term_id")
        .distinct()
    )
    return wanted.join(index.select("doc_id", "pos", "term_id"), ["doc_id", "pos", "term_id"]).select("doc_id", "item_id", "copy", "delta", "offset")


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id) of the documents that hold ``window`` consecutive words of an item."""
    terms = item_terms(items, item, text)
    met = alignments(terms, postings(docs, terms, doc, text), window)
    line = Window.partitionBy("doc_id", "item_id", "copy", "delta").orderBy("offset")
    runs = met.withColumn("island", F.col("offset") - F.row_number().over(line)).groupBy("doc_id", "item_id", "copy", "delta", "island").agg(F.count("*").alias("run"))
    return runs.where(F.col("run") >= window).select("doc_id", "item_id").distinct()


def gram_size(window: int, near: int) -> tuple[int, int]:
    """(n, k): ``near`` words in place within ``window`` always hold at least ``k`` runs of ``n`` words.

    The words out of place cut the window into at most ``window - near + 1`` runs of words in
    place, so the longest has at least ``near`` over that many words; runs shorter than ``n``
    hold at most ``n - 1`` of the words each.
    """
    cuts = window - near + 1
    n = -(-near // cuts)
    return n, near - (n - 1) * cuts


def _word_ids(df: DataFrame, key: str, text: str, name: str, copy: str) -> DataFrame:
    """(name, copy, w): the hashed words of each text; ``copy`` tells texts of one key apart."""
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias(name), F.xxhash64(text).alias(copy), F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("w"))


def _grams(ids: DataFrame, n: int, at: str) -> DataFrame:
    """One row per run of ``n`` words: keys, its place and its hash."""
    keys = [c for c in ids.columns if c != "w"]
    parts = F.arrays_zip(*[F.slice("w", k + 1, F.greatest(F.size("w"), F.lit(1))).alias(f"g{k}") for k in range(n)])
    rows = ids.where(F.size("w") >= n).select(*keys, F.size("w").alias("_n"), F.posexplode(parts).alias(at, "_gram"))
    return rows.where(F.col(at) <= F.col("_n") - n).select(*keys, at, F.xxhash64(*[F.col(f"_gram.g{k}") for k in range(n)]).alias("gram"))


def _best(same: Column, window: int) -> Column:
    """struct(run, hits) of an array of 0 and 1: the longest run of 1, the most within ``window`` places."""
    pairs = let(same, lambda m: F.arrays_zip(m.alias("now"), F.slice(F.concat(F.array_repeat(F.lit(0), window), m), 1, F.size(m)).alias("old")))
    zero = F.struct(*[F.lit(0).alias(c) for c in ("run", "hits", "tail", "inside")])

    def step(acc: Column, x: Column) -> Column:
        tail, inside = (acc["tail"] + 1) * x["now"], acc["inside"] + x["now"] - x["old"]
        return F.struct(F.greatest(acc["run"], tail).alias("run"), F.greatest(acc["hits"], inside).alias("hits"), tail.alias("tail"), inside.alias("inside"))

    return F.aggregate(pairs, zero, step, lambda acc: F.struct(acc["run"].alias("run"), acc["hits"].alias("hits")))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Exact and proximity matches, the best of each document and item.

    (doc_id, item_id, match_type, run, hits): ``run`` is the longest run of consecutive item
    words met in order, ``hits`` the most aligned words within one window, both over the
    alignments that match. 'exact' means a run of at least ``window``; 'proximity' at least
    ``near`` words of a window in place. Every such alignment holds the runs of ``gram_size``,
    so the alignments with that many are all there are to compare word by word.
    """
    n, least = gram_size(window, near)
    corpus = durable(_word_ids(docs, doc, text, "doc_id", "doc_copy").distinct(), "words")
    listed = durable(_word_ids(items, item, text, "item_id", "copy").where(F.size("w") >= window).distinct(), "items")
    starts = durable(_grams(listed, n, "offset"), "grams")
    keys = ["doc_id", "doc_copy", "item_id", "copy", "delta"]
    hits = _grams(corpus, n, "pos").join(_small(starts), "gram").withColumn("delta", F.col("pos") - F.col("offset"))
    near_by = hits.groupBy(*keys).agg(F.count("*").alias("_k"), F.min("offset").alias("_a"), F.max("offset").alias("_z"))
    # The least number of runs counts only where all of them fit in one window.
    near_by = near_by.where((F.col("_k") >= least) & ((F.col("_k") > least) | (F.col("_z") - F.col("_a") <= window - n)))
    pairs = near_by.join(corpus, ["doc_id", "doc_copy"]).join(_small(listed.withColumnRenamed("w", "item_w")), ["item_id", "copy"])
    # Every window that matches and every run of n words lies between these places.
    first = F.greatest(F.lit(0), -F.col("delta"), F.col("_a") - (window - n))
    length = F.least(F.size("item_w"), F.size("w") - F.col("delta"), F.col("_z") + window) - first
    same = F.zip_with(F.slice("item_w", first + 1, length), F.slice("w", first + F.col("delta") + 1, length), lambda a, b: (a == b).cast("int"))
    good = lambda b: (b["run"] >= window) | (b["hits"] >= near)
    best = let(same, lambda m: F.when(F.aggregate(m, F.lit(0), lambda x, y: x + y) >= near, F.filter(F.array(_best(m, window)), good)))
    return (
        pairs.select("doc_id", "item_id", F.inline(best))
        .groupBy("doc_id", "item_id")
        .agg(F.max("run").alias("run"), F.max("hits").alias("hits"))
        .select("doc_id", "item_id", F.when(F.col("run") >= window, "exact").otherwise("proximity").alias("match_type"), "run", "hits")
    )
