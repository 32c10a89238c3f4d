"""The best documents of each item by relevance, with bounds in place of scores for most pairs.

Relevance is 0.7 of the coverage (the weight of the document's terms that the item names, over the weight of all) and 0.3 of
the stem cosine. Both are sums over common terms or stems of an item's factor and a document's impact, so the greatest impact
in a bucket of documents bounds what any of them can add. Buckets hold documents of about one stem norm and one number of terms,
which keeps bounds close. The search:

1. Documents at the head of the items' impact-ordered lists are scored; an item's k-th best so far is its threshold.
2. Buckets whose bounds cannot reach the threshold are left out. In the others the lists of the item's terms are read; lists of
   stems only where stems alone can reach it, and then without the weak stems that together cannot; a document stays if what it has of
   the others, with all that the weak ones can add, reaches it.
3. The most promising documents are scored to raise the threshold; those whose bound still reaches it are scored in the end.

Every document that could be among the best k, ties by rounding included, is scored by the same expression as ``relevance``, so the
result is that of scoring all pairs. Pairs without a common term or stem are absent, as there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.durable import Scratch, written
from lodestone.operators.similarity import relevance

#: Documents from the head of each list, and documents of each item that are scored for a threshold, as multiples of k.
HEAD, TRIED = 4, 6
#: What rounding to four places can hide.
SLACK = 1.5e-4
COVERAGE, COSINE = 0.7, 0.3


class Search:
    """Tables of one search; all but the lists are no larger than the items."""

    def __init__(self, named: DataFrame, weights: DataFrame, x: DataFrame, y: DataFrame, k: int, here: Scratch) -> None:
        self.k, self.here = k, here
        self.terms = here.written(weights.select("doc_id", F.col("term").alias("f"), "w10"), "doc_terms")
        self.stems = here.written(y.select("doc_id", F.col("stem").alias("f"), "n"), "doc_stems")
        self.item_terms = here.written(named.select("item_id", F.col("canonical").alias("f")).distinct(), "item_terms")
        norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("item_id")))
        self.item_stems = here.written(x.select("item_id", F.col("stem").alias("f"), F.col("n").alias("nx"), (F.col("n") / norm).alias("q")), "item_stems")
        stem_stats = self.stems.groupBy("doc_id").agg(F.sum(F.col("n") * F.col("n")).alias("sy"))
        term_stats = self.terms.groupBy("doc_id").agg(F.sum("w10").alias("total"), F.count("*").alias("m"))
        bucket = F.coalesce(F.floor(2 * F.log2("sy")), F.lit(-1)) * 16 + F.least(F.coalesce("m", F.lit(0)), F.lit(15))
        self.docs = here.written(stem_stats.join(term_stats, "doc_id", "full").withColumn("bucket", bucket.cast("int")), "doc_stats")
        self.term_lists = here.written(self._lists(self.terms, self.item_terms, F.col("w10") / F.col("total"), "w10"), "term_lists")
        self.stem_lists = here.written(self._lists(self.stems, self.item_stems, F.col("n") / F.sqrt("sy"), "n"), "stem_lists")
        here.drop(self.terms, self.stems)  # the lists have what items can share
        best = lambda t: t.groupBy("f", "bucket").agg(F.max("d").alias("most"))
        self.term_bounds = here.written(self.item_terms.join(best(self.term_lists), "f"), "term_bounds")
        self.stem_bounds = here.written(self.item_stems.join(best(self.stem_lists), "f").select("item_id", "f", "bucket", "q", (F.col("q") * F.col("most")).alias("most")), "stem_bounds")
        upper = lambda t, name: t.groupBy("item_id", "bucket").agg(F.least(F.sum("most"), F.lit(1.0)).alias(name))
        both = upper(self.term_bounds, "cover").join(upper(self.stem_bounds, "like"), ["item_id", "bucket"], "full")
        self.bounds = here.written(both.fillna(0.0), "bounds")

    def _lists(self, rows: DataFrame, of: DataFrame, impact: Column, own: str) -> DataFrame:
        """(f, bucket, doc_id, d, own) of the terms or stems that items have; ``own`` is their weight or count."""
        return rows.join(of.select("f").distinct(), "f").join(self.docs, "doc_id").select("f", "bucket", "doc_id", impact.alias("d"), own)

    def scores(self, pairs: DataFrame) -> DataFrame:
        """(item_id, doc_id, score, bp) of ``pairs``, a written table; the lists have all terms and stems that a pair can have in common."""
        hit = pairs.join(self.item_terms, "item_id").join(self.term_lists, ["doc_id", "f"]).groupBy("item_id", "doc_id").agg(F.sum("w10").alias("hit"))
        coverage = hit.join(self.docs.select("doc_id", "total"), "doc_id")
        dots = pairs.join(self.item_stems, "item_id").join(self.stem_lists, ["doc_id", "f"]).groupBy("item_id", "doc_id").agg(F.sum(F.col("nx") * F.col("n")).alias("dot"))
        sizes = self.item_stems.groupBy("item_id").agg(F.sum(F.col("nx") * F.col("nx")).alias("sx"))
        cosine = dots.join(sizes, "item_id").join(self.docs.select("doc_id", "sy"), "doc_id").withColumn("cosine", F.col("dot") / (F.sqrt("sx") * F.sqrt("sy")))
        return relevance(coverage, cosine.select("item_id", "doc_id", "cosine"))

    def thresholds(self, scored: DataFrame) -> DataFrame:
        """(item_id, least) that a k-th best of ``scored`` proves; -1 for items with fewer."""
        rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("bp"), "doc_id"))
        kth = scored.withColumn("r", rank).where(F.col("r") == self.k).select("item_id", (F.col("bp") / 10_000 - SLACK).alias("least"))
        every = self.item_terms.select("item_id").unionByName(self.item_stems.select("item_id")).distinct()
        return every.join(kth, "item_id", "left").fillna(-1.0)

    def head(self, lists: DataFrame) -> DataFrame:
        top = F.row_number().over(W.partitionBy("f").orderBy(F.desc("d"), "doc_id"))
        return lists.withColumn("r", top).where(F.col("r") <= HEAD * self.k).select("f", "doc_id", "d")

    def promising(self, pairs: DataFrame, by: str) -> DataFrame:
        """The items' first pairs by ``by``."""
        rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc(by), "doc_id"))
        return self.here.written(pairs.withColumn("r", rank).where(F.col("r") <= TRIED * self.k).select("item_id", "doc_id"), "promising")

    def candidates(self) -> DataFrame:
        """(item_id, doc_id) of all pairs that may be among an item's best k; a written table."""
        seeds = self.item_terms.join(self.head(self.term_lists), "f").select("item_id", "doc_id", (COVERAGE * F.col("d")).alias("part"))
        seeds = seeds.unionByName(self.item_stems.join(self.head(self.stem_lists), "f").select("item_id", "doc_id", (COSINE * F.col("q") * F.col("d")).alias("part")))
        tried = self.promising(seeds.groupBy("item_id", "doc_id").agg(F.sum("part").alias("part")), "part")
        least = self.here.written(self.thresholds(self.scores(tried)), "thresholds")

        live = self.bounds.join(least, "item_id")
        covered = live.where(COVERAGE * F.col("cover") + COSINE * F.col("like") >= F.col("least")).where("cover > 0")
        found = covered.join(self.item_terms, "item_id").join(self.term_lists, ["f", "bucket"]).groupBy("item_id", "doc_id", "like", "least").agg(F.sum("d").alias("cover"))
        most = COVERAGE * F.col("cover") + COSINE * F.col("like")
        found = self.here.written(found.withColumn("most", most).where(F.col("most") >= F.col("least")).select("item_id", "doc_id", "most"), "covered")

        alone = live.where(COSINE * F.col("like") >= F.col("least")).select("item_id", "bucket", "least").join(self.stem_bounds, ["item_id", "bucket"])
        rest = F.sum("most").over(W.partitionBy("item_id", "bucket").orderBy("most", "f"))  # of this stem and all weaker ones
        strong = alone.withColumn("rest", rest).where(COSINE * F.col("rest") >= F.col("least"))
        weak = F.min(F.col("rest") - F.col("most")).over(W.partitionBy("item_id", "bucket"))  # of the stems that are left out
        met = strong.withColumn("weak", weak).select("item_id", "bucket", "f", "q", "weak", "least").join(self.stem_lists, ["f", "bucket"])
        met = met.groupBy("item_id", "doc_id", "weak", "least").agg(F.sum(F.col("q") * F.col("d")).alias("like"))
        most = COSINE * (F.col("like") + F.col("weak"))  # of a document without a common term; the others are in ``found`` if they can be
        other = self.here.written(met.withColumn("most", most).where(F.col("most") >= F.col("least")).select("item_id", "doc_id", "most"), "uncovered")

        both = found.unionByName(other)
        again = self.promising(both.groupBy("item_id", "doc_id").agg(F.max("most").alias("most")), "most")
        higher = self.thresholds(self.scores(again)).withColumnRenamed("least", "higher")
        kept = both.join(higher, "item_id").where(F.col("most") >= F.col("higher")).select("item_id", "doc_id")
        return self.here.written(kept.unionByName(tried).unionByName(again).distinct(), "candidates")


def top_relevant(named: DataFrame, weights: DataFrame, x: DataFrame, y: DataFrame, k: int = 3) -> DataFrame:
    """(item_id, doc_id, bp, r): each item's k best documents by relevance, ties by id.

    ``named`` (item_id, canonical) closed under implication, ``weights`` (doc_id, term, w10), ``x`` (item_id, stem, n) and ``y``
    (doc_id, stem, n).
    """
    with Scratch() as here:
        search = Search(named, weights, x, y, k, here)
        rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("bp"), "doc_id"))
        return written(search.scores(search.candidates()).withColumn("r", rank).where(F.col("r") <= k), "top_relevant")
