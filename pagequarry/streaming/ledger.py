"""Streams over append-only ledgers and event tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import rules
from ..sources.io import CANDIDATE, EVENT


def events(spark: SparkSession, folder: str, schema: str = EVENT) -> DataFrame:
    """A folder of JSON-line files as a stream; new files are read as they come."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def normalized(stream: DataFrame) -> DataFrame:
    """Unknown statuses count as ok, unknown roles as Scribe."""
    return stream.withColumns({
        "status": F.when(F.col("status").isin(rules.STATUSES), F.col("status")).otherwise("ok"),
        "agent_role": F.when(F.col("agent_role").isin(rules.ROLES), F.col("agent_role")).otherwise("Scribe"),
        "at": F.to_timestamp("timestamp"),
    })


def progress(stream: DataFrame) -> DataFrame:
    """For each run the number of events of each status, its latest action and progress; for update or complete mode."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in rules.STATUSES]
    return stream.groupBy("run_id").agg(*counts, F.max_by("action", "at").alias("latest_action"), F.max("progress_current").alias("progress_current"), F.max("progress_total").alias("progress_total"))


def append(stream: DataFrame, folder: str, checkpoint: str):
    """Appends the stream to a ledger of JSON files, each event once, partitioned by run."""
    return stream.writeStream.format("json").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).partitionBy("run_id").trigger(availableNow=True).start()


def candidates_once(spark: SparkSession, folder: str, late: str = "7 days") -> DataFrame:
    """Candidates, each (doi, field) once within the watermark: state is dropped behind it."""
    stream = spark.readStream.schema(CANDIDATE).json(folder).withColumns({"at": F.to_timestamp("proposed_at"), "doi_key": F.lower("doi")})
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["doi_key", "field"])


def latest_claims(stream: DataFrame) -> DataFrame:
    """The last claim of each task by time."""
    return stream.groupBy("task_id").agg(F.max_by(F.struct("status", "agent_id", "claimed_at"), "claimed_at").alias("c")).select("task_id", "c.*")


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Progress lines of text logs such as ``[12/100] 10.1/x ok 35ms``: done, total, doi, status, ms."""
    pattern = r"^\[(\d+)/(\d+)\]\s+(\S+)\s+(\w+)\s+([\d.]+)ms"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return spark.readStream.text(folder).where(F.regexp_like("value", F.lit(pattern))).select(part(1).cast("int").alias("done"), part(2).cast("int").alias("total"), part(3).alias("doi"), part(4).alias("status"), part(5).cast("double").alias("ms"))


def windowed(stream: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Beyond what the harness has: tumbling windows with a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Beyond what the harness has: sessions by gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n"))


def append_once(stream: DataFrame, folder: str, checkpoint: str, keys: list[str]):
    """Appends rows whose ``keys`` the ledger doesn't hold yet, each once, however often a batch is replayed.

    A batch writes one folder of its own number and overwrites what an earlier try left there; what it compares with are the
    other batches' rows. So a batch that is run again after a crash, before or after its write, adds nothing. Of equal keys within a
    batch the earliest by ``timestamp`` stays, where there is such a column. Null keys count as equal.
    """
    first = [F.col("timestamp")] if "timestamp" in stream.columns else []

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        packed = F.struct(*batch.columns)
        new = batch.groupBy(*keys).agg((F.min_by(packed, first[0]) if first else F.first(packed)).alias("r")).select("r.*")
        known = ledger(spark, folder, batch.schema).where(F.col("batch") != number).select(*[F.col(k).alias(f"__{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & new[k].eqNullSafe(known[f"__{k}"])
        new.join(known, same, "left_anti").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of a ledger that ``append_once`` wrote, with the ``batch`` of each; none where there is no folder yet."""
    wanted = T.StructType([*[f for f in schema.fields if f.name != "batch"], T.StructField("batch", T.LongType())])
    return spark.read.schema(wanted).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], wanted)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of a table's whole versions, ascending: those whose write was committed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def replace(df: DataFrame, folder: str) -> int:
    """Replaces a table as a whole: readers of ``current`` see the old rows until the new ones are committed, then these. ``df`` may read the table itself. Returns the version's number."""
    number = max(versions(df.sparkSession, folder), default=0) + 1
    df.write.mode("overwrite").parquet(f"{folder}/version={number}")
    return number


def current(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """The rows of the table's last whole version; none without one."""
    found = versions(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder}/version={found[-1]}") if found else spark.createDataFrame([], schema)


CLAIM = "task_id string, status string, agent_id string, claimed_at timestamp"


def claims_with_expiry(stream: DataFrame, hours: float = 24, late: str = "1 hour") -> DataFrame:
    """The last claim of each task by time, as it changes, and ``reopened`` once the watermark passes a claim by ``hours``; for update mode.

    ``stream`` has the columns of ``CLAIM``. State is one claim for each open task and goes when it is done, released or reopened. A
    claim that is older than the one held changes nothing; of equal times the greater agent, then status, holds.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["task_id", "status", "agent_id", "claimed_at"]
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "reopened", None, pd.Timestamp(held[2], unit="us"))], columns=names)
            return
        best = state.get if state.exists else None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if pd.isna(r.claimed_at):
                    continue
                seen = (r.status or "", r.agent_id or "", int(r.claimed_at.value // 1000))
                if best is None or (seen[2], seen[1], seen[0]) > (best[2], best[1], best[0]):
                    best = seen
        if best is None:
            return
        if best[0] in ("done", "released"):
            if state.exists:
                state.remove()
        else:
            state.update(best)
            state.setTimeoutTimestamp(max(best[2] // 1000 + int(hours * 3_600_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], best[0], best[1] or None, pd.Timestamp(best[2], unit="us"))], columns=names)

    rows = stream.select("task_id", "status", "agent_id", "claimed_at").withWatermark("claimed_at", late)
    return rows.groupBy("task_id").applyInPandasWithState(step, CLAIM, "status string, agent_id string, micros long", "update", GroupStateTimeout.EventTimeTimeout)
