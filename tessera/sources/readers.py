"""Readers: artifact trees, subsystem catalogs, feedback logs, training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes that are text whatever the bytes say.
TEXT_SUFFIXES = (".md", ".txt", ".py", ".proto", ".yml", ".yaml", ".json", ".ini", ".cfg", ".toml", ".sql")
# Columns of a training set, in order.
FIELDS = (
    "request_id", "timestamp", "rank", "query", "result_count", "chunk_id", "artifact_path", "artifact_type", "subsystem",
    "vector_score", "adjusted_score", "signal_subsystem_affinity", "signal_relationship_count", "signal_supporting_bonus",
    "signal_coverage_missing", "graph_context_present", "feedback_vote", "feedback_note", "context_json",
    "metadata_request_id", "metadata_graph_context_included", "metadata_warnings_count",
)

FEEDBACK_SCHEMA = """
request_id string, timestamp string, rank string, query string, result_count string, chunk_id string, artifact_path string,
artifact_type string, subsystem string, vector_score string, adjusted_score string,
signals struct<subsystem_affinity: string, relationship_count: string, supporting_bonus: string, coverage_missing: string>,
graph_context_present string, feedback_vote string, feedback_note string,
metadata struct<request_id: string, graph_context_included: string, warnings: string>, context string
"""

CATALOG_ENTRY = "struct<description: string, criticality: string, owner: string, domain: string, tags: array<string>, labels: array<string>, paths: array<string>, includes: array<string>, dependencies: array<string>, depends_on: array<string>, depends_on_subsystems: array<string>>"


#: Prefixes of the paths that are read.
INCLUDE = ("docs", "src", "tests", ".codacy")
BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def textual(files: DataFrame, *keep: str) -> DataFrame:
    """``files(path, bytes)`` that are text in UTF-8, as ``(path, content)`` with plain line ends, and the columns ``keep``."""
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    plain = suffix.isin(*TEXT_SUFFIXES) | ~F.contains(F.substring("bytes", 1, 1024), F.lit(b"\x00"))
    content = F.regexp_replace(F.decode("bytes", "UTF-8"), "\r\n?", "\n")
    return files.where(plain & F.is_valid_utf8(F.col("bytes").cast("string"))).select("path", content.alias("content"), *keep)


def relative(files: DataFrame, root: str, include: tuple[str, ...], modified: str | None = None) -> DataFrame:
    """``binaryFile`` rows whose path below ``root`` begins with one of the prefixes: (path, bytes), and the time as modified."""
    base = root.rstrip("/") + "/"
    at = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    start = "/" + base.partition("://")[2].lstrip("/") if "://" in base else base
    rows = files.select(F.substr(at, F.lit(len(start) + 1)).alias("path"), F.col("content").alias("bytes"), *([F.col(modified).alias("modified")] if modified else []))
    keep = F.lit(False)
    for prefix in include:
        keep = keep | F.startswith("path", F.lit(prefix))
    return rows.where(keep)


def read_artifacts(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE) -> DataFrame:
    """Text files of a tree whose relative path begins with one of the prefixes: (path, content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.rstrip("/") + "/")
    return textual(relative(files, root, include))


def read_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first catalog that parses: ord, name, key_lower, description, criticality, owner, domain, tags, labels, patterns, dependencies."""
    for path in paths:
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {CATALOG_ENTRY}>").alias("m"), "value")
        if raw.where("m is not null").limit(1).count():
            return catalog_rows(raw)
    return catalog_rows(spark.createDataFrame([], "value string").select(F.from_json("value", f"map<string, {CATALOG_ENTRY}>").alias("m"), "value"))


def catalog_rows(raw: DataFrame) -> DataFrame:
    first = lambda *names: F.coalesce(*(F.when(F.size(f"e.{n}") > 0, F.col(f"e.{n}")) for n in names), F.array().cast("array<string>"))
    rows = raw.where("m is not null").select(F.posexplode("m").alias("ord", "name", "e"))
    none = F.array().cast("array<string>")
    return rows.select(
        "ord", "name", F.lower("name").alias("key_lower"), "e.description", "e.criticality", "e.owner", "e.domain",
        F.coalesce("e.tags", none).alias("tags"), F.coalesce("e.labels", none).alias("labels"),
        first("paths", "includes").alias("patterns"), first("dependencies", "depends_on", "depends_on_subsystems").alias("dependencies"),
    )


def parse_feedback_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of JSON ``lines(value)``, and one row with the numbers of accepted and rejected lines."""
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", FEEDBACK_SCHEMA + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"))
    good = F.col("e").isNotNull() & F.col("e._corrupt_record").isNull()
    stats = parsed.agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"))
    return parsed.where(good).select("e.*").drop("_corrupt_record"), stats


def read_feedback(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Feedback events of JSON lines; blank and malformed lines are left out, and counted."""
    return parse_feedback_lines(spark.read.text(path))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Training set of CSV or JSON lines; rows without a numeric vote are left out."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    elif kind in ("jsonl", "json"):
        rows = spark.read.json(path, mode="FAILFAST")
    else:
        raise ValueError(f"unsupported training set: {path}")
    if lacking := [f for f in FIELDS if f not in rows.columns]:
        raise ValueError(f"training set lacks columns: {lacking}")
    return rows.where(F.col("feedback_vote").cast("string").try_cast("double").isNotNull())


def write_dataset(df: DataFrame, path: str) -> None:
    """Write a training set by its path's suffix."""
    if path.endswith(".csv"):
        df.write.csv(path, header=True, escape='"')
    elif path.endswith((".jsonl", ".json")):
        df.write.json(path, ignoreNullFields=False)
    else:
        raise ValueError(f"unsupported training set: {path}")
