"""Progress of what a session runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def job_progress(spark: SparkSession) -> DataFrame:
    """(job, stage, tasks, done, failed, share) of the stages that run now, a row each; none if nothing runs.

    What the driver's status tracker knows: it is asked from another thread than the one that runs the job.
    """
    tracker, rows = spark.sparkContext.statusTracker(), []
    for job in sorted(tracker.getActiveJobsIds()):
        info = tracker.getJobInfo(job)
        for stage in sorted(info.stageIds) if info else []:
            s = tracker.getStageInfo(stage)
            if s:
                rows.append((job, stage, s.numTasks, s.numCompletedTasks, s.numFailedTasks, s.numCompletedTasks / s.numTasks if s.numTasks else 1.0))
    return spark.createDataFrame(rows, "job int, stage int, tasks int, done int, failed int, share double")


def remaining_seconds(share: float, elapsed: float) -> float | None:
    """The time left at the pace so far; None before anything is done."""
    return elapsed * (1 - share) / share if share > 0 else None
