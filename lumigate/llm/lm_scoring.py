"""Cross-entropy difference: how much likelier a document is under a target model than under the background.

Two byte n-gram models of the same order and estimator share one vocabulary (the byte alphabet with
the border symbol, and the n-grams of the whole corpus as the wanted set, so that each
position has a value under both). The background is counted on every document, the target on
every trusted one, found by a join of the labels on doc_id.
A document's score is the mean over its bytes of the target's loss minus the background's;
lower is nearer to the target.

Defined cases: a null or empty text has no score (null); with no trusted document the target is
uniform; repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lm, shared

NONE = [np.zeros(0, dtype=np.int64)]


def trusted_rows(rows: DataFrame, labels: DataFrame, steps: shared.Steps) -> DataFrame:
    """Every row whose doc_id is trusted. Rows that a key filter clears are not shuffled; the others meet the labels by doc_id."""
    good = steps.write(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "good")
    key = F.xxhash64("doc_id").alias("id_key")
    _, maybe = shared.split_by_keys(rows.select("*", key), "id_key", good.select(key), steps)
    return maybe.drop("id_key").join(shared.broadcast_if_small(good), "doc_id", "left_semi")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, difference (nats a byte)."""

    def scored(rows: DataFrame, steps: shared.Steps) -> DataFrame:
        requests = lm.gram_requests(rows, NONE, steps)
        every = lm.each_request(requests).groupBy("gram").agg(F.sum("times").alias("all"))
        trusted = lm.each_request(lm.gram_requests(trusted_rows(rows, labels, steps), NONE, steps)).groupBy("gram").agg(F.sum("times").alias("target"))
        counts = every.join(trusted, "gram", "left").select("gram", "all", F.coalesce("target", F.lit(0)).alias("target"))
        counts = steps.write(counts, "counts")
        wanted = counts.select("gram")
        target = lm.kneser_ney(counts.select("gram", F.col("target").alias("c")), wanted, steps).withColumnRenamed("logp", "t")
        background = lm.kneser_ney(counts.select("gram", F.col("all").alias("c")), wanted, steps).withColumnRenamed("logp", "b")
        values = target.join(background, "gram").select("gram", (F.col("b") - F.col("t")).alias("value"))
        return lm.block_scores(rows, requests, values)

    scores = lm.twice_alike(lm.keyed(docs), scored)
    return scores.select("doc_id", "n_bytes", F.when(F.col("n_bytes") > 0, F.col("total") / F.col("n_bytes")).alias("difference"))
