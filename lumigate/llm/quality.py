"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model's n-grams are counted on every trusted document. Sharded count joins give each
document's perplexity per byte, and each language's quantile over all trusted documents is
its threshold.

Defined cases: a null or empty text has no perplexity and is rejected; a null or rare language
(under LEAST_TRUSTED trusted documents) takes the quantile over all of them; with no trusted
document nothing with text is rejected; repeated rows get equal results; an empty table gives no rows;
other columns are ignored by `classify` and kept by `kept`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranked import exact_quantiles
from . import lm, shared

LEAST_TRUSTED = 30
QUANTILE, MARGIN = 0.995, 1.02
PRIOR_BYTES = 100  # so many bytes of a language's mean loss stand before each text, as a few bytes tell little


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(id) of every trusted document, once."""
    return labels.select(F.col("doc_id").cast("long").alias("id"), "quality").filter("quality = 1 and id is not null").select("id").distinct()


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, whole: bool = False) -> DataFrame:
    """doc_id, row_key (doc_id and text hashed), lang, perplexity, threshold, keep; whole: text and row (the other columns) too."""

    def scored(rows: DataFrame, steps: shared.Steps) -> DataFrame:
        trusted = shared.members(steps.write(trusted_ids(labels), "good"), rows.select(F.col("doc_id").alias("id")), steps)
        requests = lm.gram_requests(rows, trusted, steps)
        counts = steps.write(lm.each_request(requests).groupBy("gram").agg(F.sum("picked").alias("c")), "counts")
        values = lm.kneser_ney(counts, counts.select("gram"), steps).select("gram", F.col("logp").alias("value"))
        return lm.block_scores(rows, requests, values)

    scores = lm.twice_alike(lm.keyed(docs, "lang", whole=whole), scored)
    good = trusted_ids(labels).withColumnRenamed("id", "doc_id")
    known = scores.select("doc_id", "lang", "total", "n_bytes").filter("n_bytes > 0").join(good, "doc_id", "left_semi")
    spark = docs.sparkSession
    with shared.Steps(spark) as steps:
        known = steps.write(known.drop("doc_id"), "known")  # numbers of trusted documents
        loss = (-F.sum("total") / F.sum("n_bytes")).alias("loss")
        losses = known.groupBy("lang").agg(loss, F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_TRUSTED).filter("lang is not null")
        losses = steps.write(losses.select("lang", "loss"), "losses")
        overall_loss = known.agg(loss).first()["loss"]

        def perplexity(df: DataFrame) -> DataFrame:
            prior = F.coalesce("loss", F.lit(overall_loss).cast("double"), F.lit(0.0))
            shrunk = F.exp((F.lit(PRIOR_BYTES) * prior - F.col("total")) / (F.col("n_bytes") + PRIOR_BYTES))
            return df.withColumn("perplexity", F.when(F.col("n_bytes") > 0, shrunk))

        known = steps.write(perplexity(known.join(shared.broadcast_if_small(losses, "lang"), "lang", "left")).select("lang", "perplexity"), "known")
        overall = exact_quantiles(known, "perplexity", quantile).first()["quantile"]
        cuts = exact_quantiles(known, "perplexity", quantile, ["lang"]).filter(F.col("n") >= LEAST_TRUSTED).filter("lang is not null")
        cuts = cuts.select("lang", (F.col("quantile") * margin).alias("cut"))
        limits = losses.join(cuts, "lang", "full")
        limits = shared.written(limits, "limits")  # a row a language with trusted documents
    out = perplexity(scores.join(shared.broadcast_if_small(limits, "lang"), "lang", "left"))
    out = out.withColumn("threshold", F.coalesce("cut", F.lit(None if overall is None else overall * margin).cast("double")))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    more = ["text", "row"] if whole else []
    return out.select("doc_id", "row_key", "lang", "perplexity", "threshold", keep.alias("keep"), *more)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Per document: doc_id, row_key, lang, perplexity, threshold, keep."""
    return judged(docs, labels, quantile, margin)


def kept(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """The rows of docs that are not rejected, with the same columns; texts travel once, in their blocks, and nothing is joined back to them."""
    return shared.unboxed(judged(docs, labels, quantile, margin, whole=True).filter("keep"), docs)
