"""An extension: submissions linked to people as they arrive.

Each micro-batch is linked like a batch (J10) and appended; people and identifiers are read anew
for each batch, so people made by one batch are found by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.linkage import link_submissions

SUBMISSION = "submission_id long, name string, phone string"


def link_stream(spark: SparkSession, source: str, out: str, checkpoint: str):
    """A query that links the JSON files that arrive in `source`; tables below `out` begin with
    people (person_id, full_name, primary_phone, match_confidence, match_reason) and identifiers, each in
    folders epoch=N, of which what was there before has a negative one."""

    stream = spark.readStream.schema(SUBMISSION).json(source)
    return stream.writeStream.foreachBatch(batch_writer(spark, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_writer(spark: SparkSession, out: str):
    """The function that links and appends one micro-batch."""

    def batch(df: DataFrame, epoch: int) -> None:
        # A batch that runs again after a failure must not see what it has written before, and replaces it.
        people, ids = (spark.read.parquet(f"{out}/{t}").where(F.col("epoch") < epoch) for t in ("people", "identifiers"))
        linked, new_people, new_ids = link_submissions(df, people, ids)
        for table, rows in (("submissions", linked), ("people", new_people), ("identifiers", new_ids)):
            rows.write.mode("overwrite").parquet(f"{out}/{table}/epoch={epoch}")

    return batch
