"""Artifacts, chunks and ledgers."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from .lookup import first_pattern


def source_prefixes(paths: DataFrame) -> list[str]:
    """``src`` and its direct child folders; a small list, one entry a source package."""
    parts = F.split("path", "/")
    found = paths.where((parts[0] == "src") & (F.size(parts) > 2)).select(F.concat(F.lit("src/"), parts[1]).alias("p")).distinct()
    return ["src", *sorted(r["p"] for r in found.collect())]


def describe(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """``files(path, content, …)`` with type, subsystem and entities."""
    return files.withColumns(
        {
            "artifact_type": T.artifact_type(F.col("path")),
            "subsystem": T.normalise_name(T.infer_subsystem(F.col("path"), prefixes)),
            "message_entities": T.message_entities(F.col("content")),
            "telemetry_signals": T.telemetry_signals(F.col("content")),
        }
    )


@F.pandas_udf(StringType())
def _translated(patterns: pd.Series) -> pd.Series:
    # Java's mark of the very end is the one in lower case.
    return patterns.map(lambda p: None if p is None else re.sub(r"\\[Zz]\Z", r"\\z", fnmatch.translate(p)))


def glob_regex(pattern: Column) -> Column:
    """A shell pattern, with ``*``, ``?``, ``[abc]`` and ``[!abc]``, as a regular expression of the whole text."""
    return F.concat(F.lit("^"), _translated(pattern))


def attach_catalog(artifacts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each artifact with its catalog entry: by subsystem name, else the first entry whose pattern fits its path.

    Patterns meet paths on their literal beginnings or ends, so a catalog may have many.
    """
    named = artifacts.join(catalog.withColumnsRenamed({c: f"c_{c}" for c in catalog.columns}), F.lower("subsystem") == F.col("c_key_lower"), "left")
    rest = named.where("c_ord is null").select(*artifacts.columns)
    patterns = catalog.select("ord", F.explode("patterns").alias("p")).select("ord", F.trim("p").alias("p")).where("p <> ''")
    patterns = patterns.select("ord", "p", F.rtrim(F.col("p"), F.lit("*/")).alias("base"), glob_regex(F.col("p")).alias("glob"))
    hit = first_pattern(rest, patterns)
    by_path = rest.join(hit, "path", "left").join(catalog.withColumnsRenamed({c: f"c_{c}" for c in catalog.columns}), F.col("hit_ord") == F.col("c_ord"), "left").drop("hit_ord")
    both = named.where("c_ord is not null").unionByName(by_path.select(*named.columns))
    out = both.withColumn("subsystem", F.coalesce("c_name", "subsystem")).withColumnRenamed("c_criticality", "subsystem_criticality")
    return out.withColumn("catalog_tags", F.concat(F.coalesce("c_tags", F.array().cast("array<string>")), F.coalesce("c_labels", F.array().cast("array<string>")))).drop(*(f"c_{c}" for c in catalog.columns if c != "criticality"))


def attach_commits(artifacts: DataFrame, commits: DataFrame, as_of: int | None = None) -> DataFrame:
    """The last commit of each path, up to a time: ``commits(path, commit, ts)``."""
    rows = commits if as_of is None else commits.where(F.col("ts") <= as_of)
    last = rows.groupBy("path").agg(F.max(F.struct("ts", "commit")).alias("c")).select("path", F.col("c.commit").alias("git_commit"), F.col("c.ts").alias("git_timestamp"))
    return artifacts.drop("git_commit", "git_timestamp").join(last, "path", "left")


def chunk(artifacts: DataFrame, window: int = T.DEFAULT_WINDOW, overlap: int = T.DEFAULT_OVERLAP) -> DataFrame:
    """One row per chunk: the artifact's columns but its content, with sequence, text, chunk_id, content_digest, namespace."""
    step = T.step_of(window, overlap)
    rest = [c for c in artifacts.columns if c != "content"]
    # Only chunks leave the task, not the outer text.
    rows = artifacts.where(~T.is_blank(F.col("content"))).select(*rest, F.posexplode(T.windows(F.col("content"), window, step)).alias("sequence", "text"))
    return rows.withColumns(
        {
            "chunk_id": F.concat_ws("::", "path", "sequence"),
            "content_digest": F.sha2(F.concat_ws(":", "path", "sequence", "text"), 256),
            "namespace": T.namespace(F.col("path")),
        }
    )


def embed(chunks: DataFrame, embedder=None) -> DataFrame:
    """Chunks with point_id and vector; ``embedder(text column) -> array column`` is the code-point one by default."""
    vector = (embedder or T.hash_embed)(F.col("text"))
    return chunks.withColumn("point_id", T.point_id(F.col("content_digest"))).withColumn("vector", vector.cast("array<float>"))


def model_embedder(factory):
    """An embedder from ``factory() -> encode(list of texts) -> list of vectors``, built once a worker."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series(list(model(texts.tolist())))

    return encode


def artifact_breakdown(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("artifact_type").agg(F.count("*").alias("n_artifacts"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("path").agg(F.count("*").alias("chunk_count"))


LEDGER = ("path", "artifact_type", "subsystem", "digest", "git_commit", "git_timestamp", "chunk_count", "coverage_ratio", "last_seen")


def classify(artifacts: DataFrame, ledger: DataFrame, incremental: bool = True) -> DataFrame:
    """Artifacts with digest, and state ``skipped`` (unchanged since the ledger), ``changed`` or ``new``."""
    old = ledger.select("path", F.col("digest").alias("old_digest"), F.col("chunk_count").alias("old_chunk_count"), F.col("coverage_ratio").alias("old_coverage"))
    rows = artifacts.withColumn("digest", F.sha2(F.col("content"), 256)).join(old, "path", "left")
    same = (F.col("digest") == F.col("old_digest")) & F.col("old_chunk_count").isNotNull() & F.lit(incremental)
    state = F.when(same, "skipped").when(F.col("old_digest").isNotNull(), "changed").otherwise("new")
    coverage = F.when(same, F.coalesce("old_coverage", F.when(F.col("old_chunk_count") > 0, 1.0).otherwise(0.0)))
    return rows.withColumn("state", state).withColumn("chunk_count", F.when(same, F.col("old_chunk_count"))).withColumn("coverage_ratio", coverage).drop("old_digest", "old_chunk_count", "old_coverage")


def removed_artifacts(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Ledger rows whose path is gone."""
    return previous.join(current.select("path"), "path", "left_anti").withColumn("status", F.lit("deleted"))


def merge_ledger(classified: DataFrame, counts: DataFrame, run_ts: float) -> DataFrame:
    """Next ledger: skipped rows keep their counts, the others take those of this run."""
    joined = classified.withColumnRenamed("chunk_count", "kept_count").withColumnRenamed("coverage_ratio", "kept_ratio").join(counts, "path", "left")
    fresh = F.coalesce("chunk_count", F.lit(0))
    skipped = F.col("state") == "skipped"
    columns = {c: F.col(c) for c in LEDGER if c in joined.columns} | {
        "chunk_count": F.when(skipped, F.col("kept_count")).otherwise(fresh),
        "coverage_ratio": F.when(skipped, F.col("kept_ratio")).otherwise(F.when(fresh > 0, 1.0).otherwise(0.0)),
        "last_seen": F.lit(float(run_ts)),
    }
    return joined.select(*(columns.get(c, F.lit(None).cast("string")).alias(c) for c in LEDGER))


def diff_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    """``added``, ``removed`` or ``changed`` paths of two ``(path, digest)`` tables."""
    both = old.select("path", F.col("digest").alias("a")).join(new.select("path", F.col("digest").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")
