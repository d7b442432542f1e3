"""Saved progress documents: one JSON object per file, channels as a map.

Reading accepts the nested document of one run; corrupt documents are set apart with a reason. The
rows feed :mod:`palaver.operators.progress`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators import clean
from palaver.schema import EXPANDED, PROGRESS

_CHANNEL = "struct<status:string,last_message_ts:string,message_count:bigint,expanded_threads:array<string>>"
DOCUMENT = (
    f"export_id string, workspace_url string, channels map<string,{_CHANNEL}>, "
    "search_query string, created_at string, updated_at string, format string"
)
PAGE_SIZE = 1000
CHANNELS_PER_DOCUMENT = 100


def read_documents(spark: SparkSession, path: str, files: str = "*", lines: bool = True) -> DataFrame:
    """One row per readable document, with the defaults of missing members.

    The defaults read what :func:`write_documents` saves, a document per line; documents of
    several lines each are read with ``files="*.json", lines=False``.
    """
    raw = _read(spark, path, files, lines).filter("_corrupt IS NULL")
    return raw.select(
        F.coalesce("export_id", F.regexp_replace("file_name", r"\.json$", "")).alias("export_id"),
        F.coalesce("workspace_url", F.lit("")).alias("workspace_url"),
        "channels",
        "search_query",
        F.coalesce("created_at", F.lit("")).alias("created_at"),
        F.coalesce("updated_at", F.lit("")).alias("updated_at"),
        F.coalesce("format", F.lit("json")).alias("format"),
    )


def rejected_documents(spark: SparkSession, path: str, files: str = "*", lines: bool = True) -> DataFrame:
    """``file, content, reason`` of the documents :func:`read_documents` cannot read; together they are all documents."""
    raw = _read(spark, path, files, lines).filter("_corrupt IS NOT NULL")
    whole = F.try_parse_json("_corrupt").isNotNull()
    reason = F.when(whole, F.lit("a member has another type")).otherwise(F.lit("no JSON"))
    return raw.select(F.col("file_name").alias("file"), F.col("_corrupt").alias("content"), reason.alias("reason"))


def _read(spark: SparkSession, path: str, files: str, lines: bool) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(path, wholetext=not lines)
    filled = text.filter(F.trim(F.col("value")) != "").select("_metadata.file_name", "value")
    parsed = filled.withColumn("d", F.from_json("value", f"{DOCUMENT}, _corrupt string", options))
    # what is no object at all has neither members nor a corrupt record
    corrupt = F.when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), F.col("value"))
    return parsed.select("d.*", "file_name", corrupt.alias("_broken")).drop("_corrupt").withColumnRenamed("_broken", "_corrupt")


def progress(documents: DataFrame) -> DataFrame:
    """``PROGRESS`` rows. Runs without channels keep one row with a null channel."""
    rows = documents.select("*", F.explode_outer("channels").alias("channel", "entry")).select(
        "export_id",
        "workspace_url",
        "channel",
        F.when(F.col("channel").isNotNull(), F.coalesce("entry.status", F.lit("pending"))).alias("status"),
        F.coalesce("entry.last_message_ts", F.lit("")).alias("last_message_ts"),
        F.coalesce("entry.message_count", F.lit(0)).alias("message_count"),
        "search_query",
        "created_at",
        "updated_at",
        "format",
    )
    # A run saved in several documents repeats its channel rows.
    return clean.first_seen(rows, ("export_id", "channel"), (F.desc("updated_at"), F.desc("message_count")))


def expanded(documents: DataFrame) -> DataFrame:
    """``EXPANDED`` rows: the set of expanded thread ids in long form."""
    return (
        documents.select("export_id", F.explode("channels").alias("channel", "entry"))
        .select("export_id", "channel", F.explode("entry.expanded_threads").alias("parent_ts"))
        .distinct()
    )


def write_documents(progress: DataFrame, expanded: DataFrame, path: str, page_size: int = PAGE_SIZE) -> str:
    """Save runs as documents in the nested shape, one JSON line each.

    The expanded ids of a channel are spread by hash over enough documents to keep
    each array near ``page_size``, and so are the channels of a run; reading merges
    them again. A run with few channels and expanded threads is a single document.
    Earlier documents of the same runs are replaced, those of other runs stay.
    """
    saved = documents(progress, expanded, page_size, run_column="run")
    saved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").text(path)
    return path


def append_progress(progress: DataFrame, path: str) -> None:
    """Add a save to the progress table; :func:`palaver.operators.progress.latest` finds the newest."""
    progress.write.mode("append").parquet(path)


def documents(progress: DataFrame, expanded: DataFrame, page_size: int = PAGE_SIZE, run_column: str | None = None) -> DataFrame:
    keys = ["export_id", "channel"]
    pages = expanded.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / page_size).alias("_pages"))
    sliced = (
        expanded.join(pages, keys)
        .withColumn("page", F.pmod(F.xxhash64("parent_ts"), F.col("_pages")))
        .groupBy(*keys, "page")
        .agg(F.sort_array(F.collect_set("parent_ts")).alias("expanded_threads"))
    )
    # Page 0 always exists and so carries channels without expanded threads.
    first = progress.select(*keys, F.lit(0).cast("bigint").alias("page"))
    slots = first.unionByName(sliced.select(*keys, "page")).distinct()
    sizes = progress.groupBy("export_id").agg(F.ceil(F.count(F.lit(1)) / CHANNELS_PER_DOCUMENT).alias("_groups"))
    entries = (
        slots.join(progress, keys)
        .join(sliced, [*keys, "page"], "left")
        .join(sizes, "export_id")
        .withColumn("group", F.pmod(F.xxhash64("channel"), F.col("_groups")))
    )
    entry = F.struct(
        "status",
        "last_message_ts",
        "message_count",
        F.coalesce("expanded_threads", F.array().cast("array<string>")).alias("expanded_threads"),
    )
    runs = entries.groupBy("export_id", "page", "group").agg(
        F.first("workspace_url").alias("workspace_url"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", entry.alias("entry"))))).alias("channels"),
        F.first("search_query").alias("search_query"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.first("format").alias("format"),
    )
    document = F.struct(
        "export_id", "workspace_url", "channels", "search_query", "created_at", "updated_at", "format"
    )
    run = [F.col("export_id").alias(run_column)] if run_column else []
    return runs.select(*run, F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], PROGRESS), spark.createDataFrame([], EXPANDED)
