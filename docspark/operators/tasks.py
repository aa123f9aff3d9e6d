"""A table of tasks: queue, listing, leases, retries, clean-up. OLTP locking isn't Spark's business: what can be claimed is a predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def queue(tasks: DataFrame, n: int, status: str = "pending") -> DataFrame:
    """The n tasks to do next: largest priority, then oldest, then smallest id."""
    return tasks.where(F.col("status") == status).orderBy(F.col("priority").desc(), "created_at", "task_id").limit(n)


def listing(tasks: DataFrame, skip: int = 0, n: int = 100, **equal) -> DataFrame:
    """Newest first; every given column has to be equal."""
    for column, value in equal.items():
        if value is not None:
            tasks = tasks.where(F.col(column) == value)
    return tasks.orderBy(F.col("created_at").desc(), "task_id").offset(skip).limit(n)


def expired(tasks: DataFrame, now: Column, status: str = "processing") -> DataFrame:
    return tasks.where((F.col("status") == status) & (F.col("lock_expires_at") < now))


def claimable(now: Column) -> Column:
    return (F.col("status") == "pending") | ((F.col("status") == "processing") & (F.col("lock_expires_at") < now))


#: Errors that trying again doesn't mend; any other, unknown ones too, may be gone the next time.
FINAL_ERRORS = ["validation_error", "authentication_error", "authorization_error", "not_found", "invalid_input", "file_not_found"]


def retry_delay(retries: Column, base: float = 60.0, most: float = 3600.0) -> Column:
    """Seconds, doubling."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), retries))


def without_old(tasks: DataFrame, before: Column, statuses: list[str]) -> DataFrame:
    """What is left when tasks of these states created before a time are deleted."""
    return tasks.where(~(F.col("status").isin(statuses) & (F.col("created_at") < before)))


def delete_cascade(gone: DataFrame, *tables: DataFrame, key: str = "doc_id") -> list[DataFrame]:
    """Each table without the rows of keys in `gone`."""
    return [t.join(gone.select(key), key, "left_anti") for t in tables]


def created(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """`tasks` with the rows of `new` whose task_id isn't there; missing columns are null."""
    return tasks.unionByName(new.join(tasks.select("task_id"), "task_id", "left_anti"), allowMissingColumns=True)


def updated(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """`tasks` with the values of `changes` (task_id and some columns) where these aren't null."""
    fields = [c for c in changes.columns if c != "task_id"]
    named = changes.select("task_id", *[F.col(c).alias(f"new {c}") for c in fields])
    both = tasks.join(named, "task_id", "left")
    return both.select(*[F.coalesce(F.col(f"`new {c}`"), F.col(c)).alias(c) if c in fields else F.col(c) for c in tasks.columns])


def state(tasks: DataFrame, now: Column) -> DataFrame:
    """`tasks` with is_locked, is_expired (a lease that is over), can_retry and seconds from start to end, null without both."""
    lease = F.col("lock_expires_at")
    seconds = (F.col("completed_at").cast("double") - F.col("started_at").cast("double"))
    return tasks.withColumns({
        "is_locked": F.coalesce(lease > now, F.lit(False)), "is_expired": F.coalesce(lease <= now, F.lit(False)), "can_retry": F.col("retry_count") < F.col("max_retries"), "seconds": seconds,
    })


def failed(tasks: DataFrame, failures: DataFrame, now: Column, base: float = 60.0) -> DataFrame:
    """`tasks` after `failures` (task_id, error_type, error_message), with `delay`: seconds until the next attempt, null for tasks that didn't fail or don't come again.

    A task with attempts left (retry_count, max_retries) whose error isn't final goes back to pending: one more attempt is counted, and its lease, worker, start, step and progress are taken back, as
    far as there are such columns. Others become dead letters. Of several failures of a task the first by type counts.
    """
    one = failures.groupBy("task_id").agg(F.min(F.struct("error_type", "error_message")).alias("failure"))
    both = tasks.join(one, "task_id", "left")
    fails = F.col("failure").isNotNull()
    again = fails & (F.col("retry_count") < F.col("max_retries")) & ~F.coalesce(F.col("failure.error_type").isin(FINAL_ERRORS), F.lit(False))
    reset = {"status": F.lit("pending"), "retry_count": F.col("retry_count") + 1, "last_retry_at": now, "error_message": F.col("failure.error_message"), "progress": F.lit(0.0)}
    reset |= {c: F.lit(None) for c in ("worker_id", "lock_expires_at", "started_at", "current_step")}
    dead = {"status": F.lit("dead_letter"), "error_message": F.col("failure.error_message"), "completed_at": now}

    def of(c: str) -> Column:
        kind, out = tasks.schema[c].dataType, F.col(c)
        if c in reset:
            out = F.when(again, reset[c].cast(kind)).otherwise(out)
        return F.when(fails & ~again, dead[c].cast(kind)).otherwise(out).alias(c) if c in dead else out.alias(c)

    return both.select(*[of(c) for c in tasks.columns], F.when(again, retry_delay(F.col("retry_count"), base)).alias("delay"))
