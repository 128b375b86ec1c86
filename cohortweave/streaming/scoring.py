"""Scoring records as they arrive, with an ensemble chosen beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cohortweave.plans.prediction import Ensemble


def score_stream(ensemble: Ensemble, records: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Score a stream of new records into Parquet files.

    Scoring keeps no state, so a restart from the checkpoint continues where it
    stopped, and every record is written once. Processes what there is and stops.
    """
    scored = ensemble.score(records)
    return (
        scored.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
