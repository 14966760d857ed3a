"""Sliding-log rate limiting, inactivity sessions and masked streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mask import masked

DECISION = "client string, request_id long, at double, allowed boolean"


def decide(times: np.ndarray, log: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Decisions on requests in order, and the log after them. A refused request is not logged, so refusals do not
    prolong themselves; that is why a windowed count would not do."""
    out, start = [], 0
    log = list(log)
    for t in times.tolist():
        while start < len(log) and not t - log[start] < seconds:
            start += 1
        allowed = len(log) - start < limit
        if allowed:
            log.append(t)
        out.append(allowed)
    return out, log[start:]


def rate_limit(requests: DataFrame, limit: int = 60, seconds: float = 60.0) -> DataFrame:
    """Batch decisions for (client, request_id, at): at most `limit` allowed requests of a client in any `seconds`.

    Clients are dealt by hash and their requests sorted by time and id; the log, `limit` times at most, is all that
    a client needs, so one with very many requests streams through its task.
    """
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, log = None, []
        for batch in batches:
            clients, times = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            allowed: list[bool] = []
            start = 0
            while start < len(clients):
                stop = start
                while stop < len(clients) and clients[stop] == clients[start]:
                    stop += 1
                if start or clients[0] != current:
                    log = []
                current = clients[start]
                own, log = decide(times[start:stop], log, limit, seconds)
                allowed += own
                start = stop
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(allowed, pa.bool_())], names=["client", "request_id", "at", "allowed"])

    plain = requests.select(F.coalesce(F.col("client").cast("string"), F.lit("unknown")).alias("client"), F.col("request_id").cast("long").alias("request_id"), F.col("at").cast("double").alias("at"))
    return plain.repartition(parts, "client").sortWithinPartitions("client", "at", "request_id").mapInArrow(run, DECISION)


def rate_limit_stream(requests: DataFrame, limit: int = 60, seconds: float = 60.0) -> DataFrame:
    """The same on a stream of (client, request_id, at). Within a micro-batch a client's requests are sorted by time;
    later ones follow as they arrive. A client's log is dropped after `seconds` without requests."""
    state = T.StructType([T.StructField("log", T.ArrayType(T.DoubleType()))])
    schema = T.StructType([T.StructField("client", T.StringType()), T.StructField("request_id", T.LongType()), T.StructField("at", T.DoubleType()), T.StructField("allowed", T.BooleanType())])

    def run(key, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "request_id"], kind="stable")
        allowed, log = decide(rows["at"].to_numpy(), list(group.get[0]) if group.exists else [], limit, seconds)
        group.update((log,))
        group.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"].to_numpy(), "at": rows["at"].to_numpy(), "allowed": allowed})

    plain = requests.select(F.coalesce(F.col("client").cast("string"), F.lit("unknown")).alias("client"), F.col("request_id").cast("long").alias("request_id"), F.col("at").cast("double").alias("at"))
    return plain.groupBy("client").applyInPandasWithState(run, schema, state, "append", "ProcessingTimeTimeout")


def idle_sessions(requests: DataFrame, client: str, at: str, minutes: int = 30) -> DataFrame:
    """Sessions that end after `minutes` without a request, as a mapping's lifetime does."""
    window = F.session_window(F.col(at).cast("timestamp"), f"{minutes} minutes")
    return requests.groupBy(F.col(client), window.alias("session")).agg(F.count("*").alias("requests")).select(client, F.col("session.start").alias("started"), F.col("session.end").alias("ended"), "requests")


def masked_stream(df: DataFrame, types: dict[str, str], salt: str) -> DataFrame:
    """Masks are stateless expressions, so a stream is masked like a table."""
    return df.select(*(masked(F.col(f"`{f.name}`"), f.dataType, types.get(f.name), salt, f.name).alias(f.name) for f in df.schema.fields))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share; where none is set and Spark runs inside one process, a
    temporary folder."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def gathered(stream: DataFrame) -> DataFrame:
    """All rows that a stream has now, from Parquet files in the shared folder: executors write them, and none pass
    through the driver."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
