"""Drift of a stream against a reference table: marginals per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mirrorframe.operators.quality import counted, marginals
from mirrorframe.plans.infer import infer_table


def watch(reference: DataFrame, stream: DataFrame, out: str, checkpoint: str, *, on_drift: Callable[[int, list], None] | None = None, limit: float = 0.2) -> StreamingQuery:
    """Starts a query that appends each micro-batch's marginals, with batch_id, as Parquet below out. A batch is written once: a repeated one overwrites its own folder. The reference is counted once, when the query starts."""
    columns = infer_table("reference", reference).columns
    known = counted(reference, columns)

    def score(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            found = marginals(reference, batch, columns, known).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            found.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
            if on_drift:
                bad = batch.sparkSession.read.parquet(f"{out}/batch_id={batch_id}").filter((F.col("metric") != "verbatim") & (F.col("score") > limit)).collect()
                if bad:
                    on_drift(batch_id, bad)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
