"""Reading and writing tables and reports.

A "workbook" is a folder of datasets (one sub-folder or file per sheet);
reports are written as named datasets instead of spreadsheet sheets.
Writes go through ``DataFrameWriter`` (distributed, one file per task);
per-cluster sheets become ``partitionBy`` folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean

FORMATS = ("csv", "parquet", "json", "orc")


def read_table(spark: SparkSession, path: str, format: str = "csv", do_clean: bool = True,
               schema=None) -> DataFrame:
    """A1: read one table (CSV with a header and inferred types; Parquet, JSON,
    ORC as stored), then clean it (B1 + B2)."""
    if format not in FORMATS:
        raise ValueError(f"unsupported format {format!r} (use one of {FORMATS})")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if format == "csv":
        df = r.option("header", True).option("inferSchema", schema is None).option("encoding", "UTF-8").csv(path)
    else:
        df = r.format(format).load(path)
    return clean(df) if do_clean else df


def _format_of(name: str) -> str | None:
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return ext if ext in FORMATS else None


def read_book(spark: SparkSession, directory: str, format: str | None = None, do_clean: bool = True) -> dict[str, DataFrame]:
    """A2/A3: every dataset under ``directory`` (one per sheet), cleaned, keyed
    by name. An entry in an unknown format is an error."""
    # listed through the Hadoop file system, so any store that Spark reads will do
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    book = {}
    for entry in sorted(x.getPath().getName() for x in fs.listStatus(path)):
        if entry.startswith((".", "_")):
            continue
        fmt = format or _format_of(entry)
        if fmt is None:
            raise ValueError(f"unsupported format for {entry!r}")
        name = entry.rsplit(".", 1)[0]
        book[name] = read_table(spark, f"{directory.rstrip('/')}/{entry}", fmt, do_clean)
    return book


def write_table(df: DataFrame, path: str, format: str = "csv", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """A5/A10: export a table (CSV with a header, or Parquet/JSON/ORC)."""
    if format not in FORMATS:
        raise ValueError(f"unsupported format {format!r}")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if format == "csv":
        w = w.option("header", True)
    w.format(format).save(path)


def export_consolidated(path: str, format: str = "csv", **results: DataFrame) -> None:
    """A10: the results of the segmentations stacked (K1) and exported in one step."""
    from ..operators.combine import consolidate
    write_table(consolidate(**results), path, format)


def write_text_report(path: str, summary: DataFrame, documents: DataFrame, stats: DataFrame,
                      keywords: DataFrame, label: str, metadata: dict | None = None,
                      format: str = "parquet") -> list[str]:
    """The text-cluster report as datasets: summary, documents with their
    cluster, statistics, keywords, one folder per cluster (partitioned), and
    technical metadata."""
    parts = {"summary": summary, "documents": documents, "statistics": stats, "keywords": keywords}
    for name, df in parts.items():
        write_table(df, f"{path}/{name}", format)
    write_table(documents, f"{path}/by_cluster", format, partition_by=[label])
    spark = summary.sparkSession
    meta = metadata or {}
    md = spark.createDataFrame([(str(k), str(v)) for k, v in meta.items()] or [("method", "")], "key string, value string")
    write_table(md, f"{path}/metadata", format)
    return list(parts) + ["by_cluster", "metadata"]


def write_pareto_csv(path: str, summary: DataFrame, key_items: DataFrame, full: DataFrame) -> None:
    """Pareto export — summary block, key elements, full table."""
    write_table(summary, f"{path}/summary", "csv")
    write_table(key_items, f"{path}/key_items", "csv")
    write_table(full, f"{path}/full", "csv")


def write_pareto_report(path: str, summary: DataFrame, recommendations: DataFrame, key_items: DataFrame,
                        kpis: DataFrame, format: str = "parquet") -> None:
    """Pareto report — summary, recommendations, key elements, KPIs."""
    for name, df in (("summary", summary), ("recommendations", recommendations),
                     ("key_items", key_items), ("kpis", kpis)):
        write_table(df, f"{path}/{name}", format)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for intermediate writes under the shared checkpoint folder."""
    from ..session import checkpoint_dir
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:8]}"
