"""Incremental screening: new drafts from a folder of JSON lines are screened per micro-batch, by the whole cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import clean_post, shown_posts
from quillspark.operators import screen
from quillspark.sources.staging import stage

DRAFT = "draft_id string, case_id string, text string, status string"


def screen_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, refusal: str, corpus: DataFrame | None = None, prompts: DataFrame | None = None) -> StreamingQuery:
    """Each new file of drafts goes to the sink once, with its reason; runs until what is there is done.

    ``corpus``: post_raw of real posts that no draft may repeat, ``prompts``: case_id and user_text whose shown posts no draft
    may copy; without them these reasons do not occur.  A batch that is run again after a failure overwrites its own folder.
    """
    none = F.lit(False)

    def batch(df: DataFrame, number: int) -> None:
        d = df.withColumn("post", clean_post(F.col("text")))
        if prompts is not None:
            d = d.join(prompts.select("case_id", shown_posts(F.col("user_text")).alias("shown")), "case_id", "left")
        else:
            d = d.withColumn("shown", F.array().cast("array<string>"))
        d = stage(d, "batch")
        hit = screen.overlap(d, "draft_id", "post", corpus, "post_raw").withColumn("hit", F.lit(True)) if corpus is not None else None
        j = d.join(hit, "draft_id", "left") if hit is not None else d.withColumn("hit", none)
        reason = screen.cheap_reason(F.col("post"), F.col("status"), refusal, F.col("hit"), screen.shares_gram(F.col("post"), F.col("shown")))
        screen.screened(j.withColumn("reason", reason), "post", "shown", "reason").drop("post", "shown", "hit").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    drafts = spark.readStream.schema(DRAFT).json(source)
    return drafts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
