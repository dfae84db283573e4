"""The knowledge-corpus tables as views of the example tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts as A
from ..operators import graph as G
from ..sources.stores import cut_lineage

#: Epoch seconds at which the example views are read.
NOW = 1_703_000_000
PREFIXES = ["src", "src/app"]

# ord, name, criticality, patterns, dependencies of the example catalog.
CATALOG = [
    (0, "Src0", "high", ["docs/src0/", "tests/src0/*"], ["Src1", "src2"]),
    (1, "Src1", "medium", ["docs/src1/", "tests/src1/"], ["Src2", "Src1"]),
    (2, "Src2", "low", ["docs/src2*/"], []),
    (3, "Src3", "critical", ["tests/src3/"], ["Src0"]),
    (4, "Archive", None, ["docs/src1*", "*.yml"], ["Src3"]),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(o, n, n.lower(), f"Part {n}", c, f"team-{c}" if c else "", f"domain-{o % 2}", [f"tag-{n.lower()}"], [" "], p, d) for o, n, c, p, d in CATALOG]
    return spark.createDataFrame(rows, "ord int, name string, key_lower string, description string, criticality string, owner string, domain string, tags array<string>, labels array<string>, patterns array<string>, dependencies array<string>")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: docs, sources, tests and configuration."""
    d = table(spark, sf_dir, "documents")
    kind, s, i = F.pmod("doc_id", F.lit(5)), F.col("source"), F.col("doc_id").cast("string")
    path = F.when(kind == 0, F.concat(F.lit("docs/"), s, F.lit("/"), i, F.lit(".md"))).when(kind == 3, F.concat(F.lit("tests/"), s, F.lit("/test_"), i, F.lit(".py"))).when(kind == 4, F.concat(F.lit(".codacy/"), s, F.lit("/"), i, F.lit(".yml"))).otherwise(F.concat(F.lit("src/app/"), s, F.lit("/"), i, F.lit(".py")))
    content = F.when(kind.isin(1, 2), F.concat("text", F.lit(" Msg"), s, F.lit("Message Telemetry"), s)).otherwise(F.col("text"))
    return d.select("doc_id", "source", path.alias("path"), content.alias("content"), (F.lit(1_700_000_000) + 3600 * F.col("doc_id")).alias("git_timestamp"))


FILES_SQL = """
files AS (
  SELECT doc_id, source, CASE doc_id % 5
      WHEN 0 THEN 'docs/' || source || '/' || doc_id || '.md'
      WHEN 3 THEN 'tests/' || source || '/test_' || doc_id || '.py'
      WHEN 4 THEN '.codacy/' || source || '/' || doc_id || '.yml'
      ELSE 'src/app/' || source || '/' || doc_id || '.py' END AS path,
    CASE WHEN doc_id % 5 IN (1, 2) THEN text || ' Msg' || source || 'Message Telemetry' || source ELSE text END AS content,
    1700000000 + 3600 * doc_id AS git_timestamp
  FROM documents)
"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with types, entities and catalog subsystems."""
    return A.attach_catalog(A.describe(files(spark, sf_dir), PREFIXES), catalog(spark))


def _sql_list(rows) -> str:
    return ", ".join(rows)


_CAT = _sql_list(f"({o}, '{n}', {'NULL' if c is None else repr(c)})" for o, n, c, _, _ in CATALOG)
_PAT = _sql_list(f"({o}, '{p.rstrip('*/')}', '{p.replace('*', '%')}')" for o, _, _, ps, _ in CATALOG for p in ps)
_DEP = _sql_list(f"('{n}', '{d[:1].upper() + d[1:] if d.islower() else d}')" for _, n, _, _, ds in CATALOG for d in ds)

ARTIFACTS_SQL = f"""{FILES_SQL},
cat(ord, name, criticality) AS (VALUES {_CAT}),
pat(ord, base, lk) AS (VALUES {_PAT}),
dep(name, dependency) AS (VALUES {_DEP}),
typed AS (
  SELECT *, CASE doc_id % 5 WHEN 0 THEN 'doc' WHEN 3 THEN 'test' WHEN 4 THEN 'config' ELSE 'code' END AS artifact_type,
    CASE doc_id % 5 WHEN 0 THEN 'DesignDoc' WHEN 3 THEN 'TestCase' WHEN 4 THEN 'ConfigFile' ELSE 'SourceFile' END AS label,
    CASE WHEN doc_id % 5 IN (1, 2) THEN 'S' || substr(source, 2) END AS sub0
  FROM files),
hits AS (SELECT t.path, min(p.ord) AS ord FROM typed t JOIN pat p ON (p.base <> '' AND starts_with(t.path, p.base)) OR t.path LIKE p.lk GROUP BY t.path),
art AS (
  SELECT t.doc_id, t.source, t.path, t.content, t.git_timestamp, t.artifact_type, t.label,
    coalesce(c1.name, c2.name, t.sub0) AS subsystem, coalesce(c1.criticality, c2.criticality) AS subsystem_criticality
  FROM typed t LEFT JOIN cat c1 ON lower(t.sub0) = lower(c1.name)
  LEFT JOIN hits h ON c1.name IS NULL AND h.path = t.path LEFT JOIN cat c2 ON c2.ord = h.ord)
"""

EDGES_SQL = f"""{ARTIFACTS_SQL},
deps AS (SELECT DISTINCT d.name, d.dependency FROM dep d JOIN art a ON a.subsystem = d.name WHERE d.name <> d.dependency),
edges AS (
  SELECT DISTINCT * FROM (
    SELECT label || ':' || path AS src, CASE label WHEN 'SourceFile' THEN 'BELONGS_TO' WHEN 'DesignDoc' THEN 'DESCRIBES' ELSE 'VALIDATES' END AS type, 'Subsystem:' || subsystem AS dst
      FROM art WHERE subsystem IS NOT NULL AND label IN ('SourceFile', 'DesignDoc', 'TestCase')
    UNION ALL SELECT 'Subsystem:' || name, 'DEPENDS_ON', 'Subsystem:' || dependency FROM deps
    UNION ALL SELECT 'Subsystem:' || subsystem, 'IMPLEMENTS', 'IntegrationMessage:Msg' || source || 'Message' FROM art WHERE label = 'SourceFile'
    UNION ALL SELECT 'Subsystem:' || subsystem, 'EMITS', 'TelemetryChannel:Telemetry' || source FROM art WHERE label = 'SourceFile'
    UNION ALL SELECT label || ':' || path, 'DECLARES', 'IntegrationMessage:Msg' || source || 'Message' FROM art WHERE label = 'SourceFile')),
nodes AS (
  SELECT label || ':' || path AS id, label, path AS key, NULL AS name, path, subsystem FROM art
  UNION ALL SELECT 'Subsystem:' || n, 'Subsystem', n, n, NULL, NULL FROM (SELECT DISTINCT subsystem AS n FROM art WHERE subsystem IS NOT NULL UNION SELECT dependency FROM deps)
  UNION ALL SELECT DISTINCT 'IntegrationMessage:Msg' || source || 'Message', 'IntegrationMessage', 'Msg' || source || 'Message', 'Msg' || source || 'Message', NULL, NULL FROM art WHERE label = 'SourceFile'
  UNION ALL SELECT 'TelemetryChannel:Telemetry' || source, 'TelemetryChannel', 'Telemetry' || source, 'Telemetry' || source, NULL, max_by(subsystem, path) FROM art WHERE label = 'SourceFile' GROUP BY source)
"""


def chunked_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with chunks."""
    a, c = artifacts(spark, sf_dir), catalog(spark)
    chunks = cut_lineage(A.chunk(a.select("path", "artifact_type", "content")).select("path", "artifact_type", "chunk_id"))
    a = cut_lineage(a.drop("content"))
    return cut_lineage(G.build_nodes(a, c, chunks)), cut_lineage(G.build_edges(a, c, chunks))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without chunks, each built once."""
    a, c = cut_lineage(artifacts(spark, sf_dir).drop("content")), catalog(spark)
    return cut_lineage(G.build_nodes(a, c)), cut_lineage(G.build_edges(a, c))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("path", "doc_id", "git_timestamp", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    return f.select("path", F.concat(F.lit("c"), "doc_id", F.lit("-"), "j").alias("commit"), (F.col("git_timestamp") + 1000 * F.col("j")).alias("ts"))


def prior_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with some digests altered, some rows missing and some paths that are gone."""
    f = files(spark, sf_dir)
    digest = F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.sha2("content", 256))
    count = F.when(F.col("doc_id") % 17 != 0, F.ceil(F.length("content") / 800).cast("long"))
    old = f.where("doc_id % 11 <> 0").select("path", digest.alias("digest"), count.alias("chunk_count"), F.when(F.col("doc_id") % 5 != 1, 1.0).alias("coverage_ratio"))
    gone = f.where("doc_id % 13 = 0").select(F.concat(F.lit("docs/gone/"), "doc_id").alias("path"), F.lit("gone").alias("digest"), F.lit(1).cast("long").alias("chunk_count"), F.lit(1.0).alias("coverage_ratio"))
    return old.unionByName(gone)


LEDGER_SQL = f"""{FILES_SQL},
ledger AS (
  SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(content) END AS digest,
    CASE WHEN doc_id % 17 <> 0 THEN CAST(ceil(length(content) / 800.0) AS BIGINT) END AS chunk_count, CASE WHEN doc_id % 5 <> 1 THEN 1.0 END AS coverage_ratio
  FROM files WHERE doc_id % 11 <> 0
  UNION ALL SELECT 'docs/gone/' || doc_id, 'gone', 1, 1.0 FROM files WHERE doc_id % 13 = 0),
states AS (
  SELECT f.path, f.content, sha256(f.content) AS digest, l.digest AS old_digest, l.chunk_count, l.coverage_ratio,
    CASE WHEN l.digest = sha256(f.content) AND l.chunk_count IS NOT NULL THEN 'skipped' WHEN l.digest IS NOT NULL THEN 'changed' ELSE 'new' END AS state
  FROM files f LEFT JOIN ledger l USING (path))
"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as feedback rows of the training schema, with ``seq``."""
    c = table(spark, sf_dir, "conversations")
    votes = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    n = F.length("text")
    rows = c.join(votes, c["conv_id"] == votes["doc_id"], "left")
    return rows.select(
        F.col("conv_id").cast("string").alias("request_id"),
        F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("conv_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("turn").alias("rank"),
        F.col("text").alias("query"),
        F.concat_ws(":", "conv_id", "turn").alias("chunk_id"),
        F.col("role").alias("subsystem"),
        (n % 100 / F.lit(100.0)).alias("vector_score"),
        (n % 90 / F.lit(100.0)).alias("adjusted_score"),
        (n % 3 / F.lit(2.0)).alias("signal_subsystem_affinity"),
        (n % 7).cast("double").alias("signal_relationship_count"),
        (n % 5 / F.lit(10.0)).alias("signal_supporting_bonus"),
        (n % 2).cast("double").alias("signal_coverage_missing"),
        F.lit(1.0).alias("graph_context_present"),
        F.lit(1.0).alias("metadata_graph_context_included"),
        (n % 4).cast("double").alias("metadata_warnings_count"),
        (F.col("q") * (1 + F.col("turn") % 5)).cast("double").alias("feedback_vote"),
        F.when(F.col("turn") % 2 == 0, F.lit("noted")).alias("feedback_note"),
        F.concat(F.lit('{"turn":'), "turn", F.lit("}")).alias("context_json"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )


FEEDBACK_SQL = """
votes AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
fb AS (
  SELECT CAST(conv_id AS VARCHAR) AS request_id, turn AS rank, text AS query, conv_id || ':' || turn AS chunk_id, role AS subsystem,
    1700000000 + 60 * conv_id AS epoch, length(text) % 100 / 100.0::DOUBLE AS vector_score, length(text) % 90 / 100.0::DOUBLE AS adjusted_score,
    length(text) % 3 / 2.0::DOUBLE AS signal_subsystem_affinity, (length(text) % 7)::DOUBLE AS signal_relationship_count,
    length(text) % 5 / 10.0::DOUBLE AS signal_supporting_bonus, (length(text) % 2)::DOUBLE AS signal_coverage_missing,
    1.0::DOUBLE AS graph_context_present, 1.0::DOUBLE AS metadata_graph_context_included, (length(text) % 4)::DOUBLE AS metadata_warnings_count,
    (q * (1 + turn % 5))::DOUBLE AS feedback_vote, CASE WHEN turn % 2 = 0 THEN 'noted' END AS feedback_note,
    '{"turn":' || turn || '}' AS context_json, conv_id * 1000 + turn AS seq
  FROM conversations LEFT JOIN votes ON conv_id = doc_id)
"""


def search_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every vector whose id is divisible by 20, with a text of ``benchmark`` where there is one) and all vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    texts = table(spark, sf_dir, "benchmark").select((20 * F.col("item_id")).alias("query_id"), F.col("text").alias("query"))
    queries = e.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id").join(texts, "query_id", "left")
    return queries, e.withColumnRenamed("vec_id", "chunk_id")


SEARCH_SQL = "vecs AS (SELECT * FROM embeddings), qs AS (SELECT vec_id AS query_id, embedding, b.text AS query FROM embeddings LEFT JOIN benchmark b ON vec_id = 20 * b.item_id WHERE vec_id % 20 = 0)"
