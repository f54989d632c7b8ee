"""Job history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed, the meaning of DATEDIFF(SECOND)."""
    a = F.floor(F.unix_micros(end.cast("timestamp")) / F.lit(1000000))
    return a - F.floor(F.unix_micros(start.cast("timestamp")) / F.lit(1000000))


def job_history(jobs: DataFrame, executions: DataFrame) -> DataFrame:
    """Executions with their job's name and duration."""
    return jobs.join(executions, "job_id").withColumn("duration_seconds", seconds_between(F.col("start_time"), F.col("end_time")))


def sla_breaches(history: DataFrame, minutes: int = 10) -> DataFrame:
    """Successful executions that took longer than allowed."""
    return history.where((F.col("lifecycle") == "Succeeded") & (F.col("duration_seconds") > minutes * 60))


def job_fanout(jobs: DataFrame, executions: DataFrame, steps: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Executions with steps, target groups and members."""
    return (
        jobs.join(executions, "job_id")
        .join(steps, "job_id", "left")
        .join(groups, "target_group_id", "left")
        .join(members, "target_group_id", "left")
    )


def job_success_rate(executions: DataFrame) -> DataFrame:
    """Total, successful and percent."""
    total, good = F.count(F.lit(1)), F.count_if(F.col("lifecycle") == "Succeeded")
    pct = F.try_divide(good * F.lit(100.0), total).cast("decimal(5,2)").cast("double")
    return executions.agg(total.alias("total_executions"), good.alias("success_count"), pct.alias("success_pct"))


def job_retries(jobs: DataFrame, executions: DataFrame) -> DataFrame:
    """Executions, retried ones and most attempts per job."""
    per = executions.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col("attempts") > 1).alias("retried_runs"), F.max("attempts").alias("max_attempts")
    )
    return jobs.join(per, "job_id")


def job_failure_trend(jobs: DataFrame, executions: DataFrame) -> DataFrame:
    """Failures per job and day."""
    failed = executions.where(F.col("lifecycle").isin("Failed", "TimedOut"))
    per = failed.groupBy("job_id", F.to_date("create_time").cast("string").alias("failure_day")).agg(F.count(F.lit(1)).alias("failures"))
    return jobs.join(per, "job_id")
