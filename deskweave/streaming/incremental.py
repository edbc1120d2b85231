"""Triage of messages as they arrive, one micro-batch at a time.

The batch plan runs unchanged on every micro-batch.  The stream's checkpoint
remembers which input was consumed, so a restarted run picks up where the last
one stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.runs import Scorers, triage_run
from ..plans.triage import TriageSettings, triage_batch
from ..sources.tables import append_new, read_cache

VERDICTS = T.StructType([T.StructField("verdict_key", T.StringType()), T.StructField("resolves_problem", T.BooleanType()), T.StructField("reason", T.StringType())])


def triage_available(messages: DataFrame, corpus: DataFrame, settings: TriageSettings, verdict_cache: DataFrame,
                     output: str, checkpoint: str, drafts: DataFrame | None = None, scorers: Scorers | None = None,
                     predictions: DataFrame | None = None, verdict_store: str | None = None) -> StreamingQuery:
    """Process everything that has arrived and stop; call again for later arrivals.

    ``messages`` is a streaming frame with the columns of the batch plan.  Each
    micro-batch owns one folder below ``output`` and rewrites it when repeated,
    so a retry never doubles records.  ``output`` and ``checkpoint`` must be on
    shared storage.

    With ``scorers``, intents missing from ``predictions`` and verdicts missing from ``verdict_cache`` are asked
    for, and new verdicts are added to ``verdict_store``, which later micro-batches read as well.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        target = f"{output}/batch={batch_id}"
        spark = batch.sparkSession
        batch.persist()
        try:
            if scorers is None:
                triage_batch(batch, corpus, settings, verdict_cache, drafts=drafts)[0].write.mode("overwrite").parquet(target)
                return
            known = verdict_cache.select(*VERDICTS.names)
            if verdict_store:
                known = known.unionByName(read_cache(spark, verdict_store, VERDICTS)).dropDuplicates(["verdict_key"])
            stored = predictions if predictions is not None else batch.select("id").limit(0).selectExpr("id", "'' AS predicted_intent", "0D AS confidence")
            run = triage_run(batch, corpus, settings, scorers, stored, known, drafts)
            run.records.write.mode("overwrite").parquet(target)
            if verdict_store:
                append_new(run.verdicts, verdict_store, read_cache(spark, verdict_store, VERDICTS), "verdict_key")
        finally:
            batch.unpersist()

    return (
        messages.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
