"""Matching of arriving jobs: each micro-batch of current skills is scored against the standing targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import RunParams
from ..operators.matching import best_match, matches, skill_pairs
from ..operators.selection import pair_scores, ranking, selection


def match_stream(current_skills: DataFrame, target_skills: DataFrame, targets: DataFrame, params: RunParams, sink: str, checkpoint: str) -> StreamingQuery:
    """Append the selection of every arriving batch of whole jobs to the Parquet table ``sink``.

    The batch number is a partition of the sink and is overwritten when a batch is repeated, so results stay exact after a failure.
    """

    def run(batch: DataFrame, number: int) -> None:
        pairs = skill_pairs(batch.unionByName(target_skills, allowMissingColumns=True), params)
        done = selection(ranking(pair_scores(matches(best_match(pairs)), params), targets))
        done.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return current_skills.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
