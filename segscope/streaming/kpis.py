"""KPIs kept current over a stream.

``kpis`` (D4) is made of additive aggregates only, so the same transform runs
on a streaming DataFrame; Structured Streaming keeps the running state in its
checkpoint (under the session's shared checkpoint folder) and re-emits the
complete result at each trigger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.indicators import kpis
from ..session import checkpoint_dir


def kpis_stream(stream: DataFrame, initial: str, committed: str) -> DataFrame:
    """The streaming KPI DataFrame (complete output mode)."""
    return kpis(stream, initial, committed)


def run_available(spark: SparkSession, result: DataFrame, name: str | None = None) -> DataFrame:
    """Process everything available now (``availableNow`` trigger) into an
    in-memory table and return it. For production, point ``foreachBatch`` at a
    table instead; the memory sink is for one-row summaries like this one."""
    name = name or f"kpis_{uuid.uuid4().hex[:8]}"
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    q = (result.writeStream.outputMode("complete").format("memory").queryName(name)
               .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def file_stream(spark: SparkSession, directory: str, file_glob: str, schema) -> DataFrame:
    """A Parquet file stream over the files of ``directory`` matching ``file_glob``."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
                 .option("maxFilesPerTrigger", 1).parquet(directory))
