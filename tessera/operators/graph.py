"""Property graph of artifacts, subsystems, messages, telemetry channels and chunks.

Nodes have the columns of ``NODE`` with ``id = label:key``; edges are distinct ``(src, type, dst)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import node_label, normalise_name
from ..sources.stores import cut_lineage
from .lookup import best, containing

NODE = ("id", "label", "key", "name", "path", "subsystem", "criticality", "description", "git_timestamp", "owner", "domain", "tags", "labels")
_KINDS = {"git_timestamp": "long", "tags": "array<string>", "labels": "array<string>"}
#: Edge types that tie an artifact to its subsystem.
OWNING = ("BELONGS_TO", "DESCRIBES", "VALIDATES")
ORPHAN_LABELS = ("DesignDoc", "SourceFile", "TestCase", "ConfigFile", "Artifact", "Chunk", "IntegrationMessage", "TelemetryChannel")


def _nodes(df: DataFrame, label: Column, key: Column, **values: Column) -> DataFrame:
    cols = {"label": label, "key": key} | values
    rows = df.select(*(cols[c].alias(c) if c in cols else F.lit(None).cast(_KINDS.get(c, "string")).alias(c) for c in NODE if c != "id"))
    return rows.where("key is not null").withColumn("id", F.concat_ws(":", "label", "key")).select(*NODE)


def artifact_nodes(artifacts: DataFrame) -> DataFrame:
    return _nodes(artifacts, node_label(F.col("artifact_type")), F.col("path"), path=F.col("path"), subsystem=F.col("subsystem"), git_timestamp=F.col("git_timestamp"))


def subsystem_nodes(artifacts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Subsystems of artifacts and of catalog dependencies, with the catalog's properties."""
    names = artifacts.select(F.col("subsystem").alias("name")).unionByName(dependency_pairs(artifacts, catalog).select(F.col("dependency").alias("name")))
    names = names.where("name is not null").distinct().withColumn("key_lower", F.lower("name"))
    # An empty property is no property.
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    listed = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    given = {c: filled(c) for c in ("criticality", "description", "owner", "domain") if c in catalog.columns} | {c: F.when(F.size(listed(c)) > 0, listed(c)) for c in ("tags", "labels") if c in catalog.columns}
    known = catalog.groupBy("key_lower").agg(F.min_by(F.struct(*(v.alias(c) for c, v in given.items())), "ord").alias("p"))
    return _nodes(names.join(known, "key_lower", "left"), F.lit("Subsystem"), F.col("name"), name=F.col("name"), **{c: F.col(f"p.{c}") for c in given})


def dependency_pairs(artifacts: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(name, dependency)`` of the catalog entries that artifacts use; a self-dependency is dropped."""
    used = artifacts.select(F.col("subsystem").alias("name")).where("name is not null").distinct()
    listed = catalog.select("key_lower", F.explode("dependencies").alias("dependency")).withColumn("dependency", normalise_name(F.col("dependency")))
    pairs = used.join(listed, F.lower(used["name"]) == listed["key_lower"]).select("name", "dependency")
    return pairs.where(F.col("dependency").isNotNull() & (F.col("dependency") != F.col("name"))).distinct()


def entity_nodes(artifacts: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Message, telemetry and chunk nodes; a channel's subsystem is that of its last path."""
    messages = artifacts.select(F.explode("message_entities").alias("k")).distinct()
    channels = artifacts.select(F.explode("telemetry_signals").alias("k"), "subsystem", "path").groupBy("k").agg(F.max_by("subsystem", F.when(F.col("subsystem").isNotNull(), F.col("path"))).alias("subsystem"))
    out = _nodes(messages, F.lit("IntegrationMessage"), F.col("k"), name=F.col("k")).unionByName(_nodes(channels, F.lit("TelemetryChannel"), F.col("k"), name=F.col("k"), subsystem=F.col("subsystem")))
    return out if chunks is None else out.unionByName(_nodes(chunks, F.lit("Chunk"), F.col("chunk_id")))


def build_nodes(artifacts: DataFrame, catalog: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    return artifact_nodes(artifacts).unionByName(subsystem_nodes(artifacts, catalog)).unionByName(entity_nodes(artifacts, chunks))


def build_edges(artifacts: DataFrame, catalog: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """All edges, each once."""
    label = node_label(F.col("artifact_type"))
    own = F.concat_ws(":", label, F.col("path"))
    sub = F.concat(F.lit("Subsystem:"), F.col("subsystem"))
    owning = F.when(label == "SourceFile", "BELONGS_TO").when(label == "DesignDoc", "DESCRIBES").when(label == "TestCase", "VALIDATES")

    def edges(df: DataFrame, src: Column, kind: Column, dst: Column) -> DataFrame:
        return df.select(src.alias("src"), kind.alias("type"), dst.alias("dst")).where("src is not null and type is not null and dst is not null")

    said = artifacts.select("*", F.explode("message_entities").alias("k"))
    heard = artifacts.select("*", F.explode("telemetry_signals").alias("k"))
    message, channel = F.concat(F.lit("IntegrationMessage:"), F.col("k")), F.concat(F.lit("TelemetryChannel:"), F.col("k"))
    parts = [
        edges(artifacts, own, owning, sub),
        edges(dependency_pairs(artifacts, catalog), F.concat(F.lit("Subsystem:"), F.col("name")), F.lit("DEPENDS_ON"), F.concat(F.lit("Subsystem:"), F.col("dependency"))),
        edges(said, sub, F.lit("IMPLEMENTS"), message),
        edges(heard, sub, F.lit("EMITS"), channel),
        edges(said.where(label == "SourceFile"), own, F.lit("DECLARES"), message),
    ]
    if chunks is not None:
        parts.append(edges(chunks, F.concat_ws(":", node_label(F.col("artifact_type")), F.col("path")), F.lit("HAS_CHUNK"), F.concat(F.lit("Chunk:"), F.col("chunk_id"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def check_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations: ids that several nodes have, and edge ends without a node."""
    twice = nodes.groupBy("id").count().where("count > 1").select(F.lit("duplicate node").alias("violation"), "id")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return twice.unionByName(ends.join(nodes.select("id"), "id", "left_anti").select(F.lit("missing node").alias("violation"), "id"))


def orphan_nodes(nodes: DataFrame, edges: DataFrame, label: str | None = None) -> DataFrame:
    """Nodes without an owning edge to a subsystem."""
    if label is not None and label not in ORPHAN_LABELS:
        raise ValueError(f"label cannot be an orphan: {label}")
    tied = edges.where(F.col("type").isin(*OWNING) & F.startswith("dst", F.lit("Subsystem:"))).select(F.col("src").alias("id")).distinct()
    rows = nodes.where(F.col("label").isin(*([label] if label else ORPHAN_LABELS)))
    return rows.join(tied, "id", "left_anti")


def both_ways(edges: DataFrame) -> DataFrame:
    """``(id, type, direction, other)`` of every edge, from either end."""
    out = edges.select(F.col("src").alias("id"), "type", F.lit("OUT").alias("direction"), F.col("dst").alias("other"))
    return out.unionByName(edges.select(F.col("dst").alias("id"), "type", F.lit("IN").alias("direction"), F.col("src").alias("other")))


def node_relationships(ids: DataFrame, nodes: DataFrame, edges: DataFrame, direction: str = "outgoing", limit: int = 50) -> DataFrame:
    """Up to ``limit`` neighbours of each id, by type, then neighbour."""
    ways = both_ways(edges)
    if direction != "all":
        ways = ways.where(F.col("direction") == ("IN" if direction == "incoming" else "OUT"))
    rows = ids.select("id").distinct().join(nodes.select("id"), "id").join(ways, "id")
    place = F.row_number().over(Window.partitionBy("id").orderBy("type", "other", "direction"))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def subsystem_artifacts(names: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """The first artifacts of each subsystem, by path: name, path, artifact_id, relation."""
    owned = edges.where(F.col("type").isin(*OWNING)).join(names.select("name", F.concat(F.lit("Subsystem:"), "name").alias("dst")), "dst")
    rows = owned.join(nodes.select(F.col("id").alias("src"), "path"), "src").select("name", "path", F.col("src").alias("artifact_id"), F.col("type").alias("relation"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("path", "artifact_id", "relation"))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def subsystem_neighbourhood(names: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes within ``depth`` hops of each subsystem, over any edge: name, id, hops, first_type, first_direction, path.

    One shortest path a node, the smallest by text among equals. The loop runs ``depth`` times; a
    node enters the frontier of a source once.
    """
    ways = both_ways(edges)
    start = names.select("name", F.concat(F.lit("Subsystem:"), "name").alias("id"))
    seen = start.select("name", "id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("first_type"), F.lit(None).cast("string").alias("first_direction"), F.col("id").alias("path"))
    front = seen
    for hop in range(1, depth + 1):
        step = front.join(ways, "id").select(
            "name", F.col("other").alias("id"), F.coalesce("first_type", "type").alias("first_type"), F.coalesce("first_direction", "direction").alias("first_direction"), F.concat_ws(" > ", "path", "other").alias("path")
        )
        best = step.groupBy("name", "id").agg(F.min(F.struct("path", "first_type", "first_direction")).alias("b"))
        fresh = best.join(seen.select("name", "id"), ["name", "id"], "left_anti")
        front = cut_lineage(fresh.select("name", "id", F.lit(hop).alias("hops"), "b.first_type", "b.first_direction", "b.path"))
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


#: Parts over which the neighbours of a node are dealt.
SLOTS = 64


def subsystem_graph(names: DataFrame, edges: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What lies within ``depth`` hops of each subsystem, over any edge: nodes, edges and paths.

    Nodes: name, id, hops, relationship and direction of the path's first edge, and total, the number of nodes of
    the name. Edges: those on the chosen paths, each once: name, source, target, type, direction (``OUT`` if the
    edge leads from source to target). Paths: name, id, step from 1, source, target, type, direction. Of the edges
    that lead to a node with the fewest hops, the one from the smallest id is chosen, then by type and direction.
    Names without edges have no rows; repeated ones count once.

    A node enters the frontier of a name once and keeps its chosen edge alone; no path is carried along. A hub's
    edges are dealt over slots, so they are joined in many tasks.
    """
    ways = cut_lineage(both_ways(edges).withColumn("slot", F.pmod(F.xxhash64("other"), F.lit(SLOTS))))
    slots = cut_lineage(ways.select("id", "slot").distinct())
    none = F.lit(None).cast("string")
    start = names.select("name", F.concat(F.lit("Subsystem:"), "name").alias("id")).distinct()
    seen = start.select("name", "id", F.lit(0).alias("hops"), none.alias("source"), none.alias("type"), none.alias("way"), none.alias("relationship"), none.alias("direction"))
    front = seen
    for hop in range(1, depth + 1):
        step = front.select("name", "id", "relationship", "direction").join(slots, "id").join(ways.withColumnRenamed("direction", "way"), ["id", "slot"])
        chosen = F.struct(F.col("id").alias("source"), "type", "way", F.coalesce("relationship", "type").alias("relationship"), F.coalesce("direction", "way").alias("direction"))
        best = step.groupBy("name", F.col("other").alias("id")).agg(F.min(chosen).alias("b"))
        fresh = best.join(seen.select("name", "id"), ["name", "id"], "left_anti")
        front = cut_lineage(fresh.select("name", "id", F.lit(hop).alias("hops"), "b.*"))
        seen = seen.unionByName(front)
    found = seen.where("hops > 0")
    totals = found.groupBy("name").agg(F.count("*").alias("total"))
    nodes = found.select("name", "id", "hops", "relationship", "direction").join(totals, "name")
    chain = found.select("name", F.col("id").alias("target"), F.col("hops").alias("step"), "source", "type", F.col("way").alias("direction"))
    # Paths are read backwards: each edge of a path is the chosen one of the node that it leads to.
    # Many paths lead through a hub, so they are dealt over slots, and so is its edge, where there are paths to meet it.
    paths = chain.select("name", F.col("target").alias("id"), "step", "source", "target", "type", "direction")
    edge = paths
    for _ in range(1, depth):
        at = edge.select("name", "id", F.col("source").alias("target")).withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(SLOTS)))
        dealt = at.select("name", "target", "slot").distinct().join(chain, ["name", "target"])
        edge = at.join(dealt, ["name", "target", "slot"]).select("name", "id", "step", "source", "target", "type", "direction")
        paths = paths.unionByName(edge)
    return nodes, chain.select("name", "source", "target", "type", "direction"), paths


def path_depth(nodes: DataFrame, edges: DataFrame, max_depth: int = 4) -> DataFrame:
    """Hops from each node to its nearest subsystem over owning and chunk edges; null beyond ``max_depth``."""
    ways = both_ways(edges.where(F.col("type").isin(*OWNING, "HAS_CHUNK"))).select("id", "other").distinct()
    seen = nodes.where("label = 'Subsystem'").select("id", F.lit(0).alias("depth"))
    front = seen
    for hop in range(1, max_depth + 1):
        fresh = front.join(ways, "id").select(F.col("other").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = cut_lineage(fresh.select("id", F.lit(hop).alias("depth")))
        seen = seen.unionByName(front)
    return nodes.select("id", "label").join(seen, "id", "left")


def page(df: DataFrame, keys: list[Column], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page in order of the first present key, then the others; and one row: total, next_offset (null after a page that isn't full)."""
    full = F.count("*") - offset >= limit
    info = df.agg(F.count("*").alias("total"), F.when(full, offset + limit).cast("long").alias("next_offset"))
    return df.orderBy(F.coalesce(*keys), *keys).offset(offset).limit(limit), info


def entity_search(terms: DataFrame, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """Subsystems by name, documents and sources by path that hold a term, the best of each term.

    Terms meet nodes through an index of the names' and paths' letters.
    """
    text = F.when(F.col("label") == "Subsystem", F.col("name")).when(F.col("label").isin("DesignDoc", "SourceFile"), F.col("path"))
    score = F.when(F.col("label") == "Subsystem", 0.95).when(F.col("label") == "DesignDoc", 0.85).otherwise(0.80)
    named = nodes.select("id", "label", text.alias("text"), score.alias("score"), F.coalesce("description", text).alias("snippet"))
    return best(containing(terms, named), limit).select("term", "id", "label", "score", "snippet", "place")


#: Rows of a range of the page directory, and ranges, at most: each is a folder to list and a row that comes to the driver.
PAGE_ROWS, MAX_RANGES = 100_000, 200


def write_pages(df: DataFrame, keys: list[Column], path: str, rows: int = PAGE_ROWS) -> None:
    """A snapshot in the order of ``page``, in ranges of about ``rows`` rows, and how many rows each range has.

    There are ``MAX_RANGES`` ranges at most; of more rows a range has more.
    """
    order = [F.coalesce(*keys), *keys]
    n = max(1, min(MAX_RANGES, -(-df.count() // rows)))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    ordered.withColumn("place", F.monotonically_increasing_id()).write.partitionBy("range").parquet(f"{path}/rows")
    spark = df.sparkSession
    spark.read.parquet(f"{path}/rows").groupBy("range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/ranges")


def read_page(spark: SparkSession, path: str, offset: int, limit: int) -> tuple[DataFrame, int, int | None]:
    """A page of a written snapshot, the total, and the next offset (None after a page that isn't full).

    Only the ranges that the page lies in are read; one row per range comes to the driver.
    """
    before, wanted, skip = 0, [], 0
    for r in sorted(spark.read.parquet(f"{path}/ranges").collect(), key=lambda r: r["range"]):
        if before + r["n"] > offset and before < offset + limit:
            skip = skip if wanted else offset - before
            wanted.append(r["range"])
        before += r["n"]
    # Only the folders of these ranges are listed; after the last row there is none.
    found = spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/range={r}" for r in wanted or [0]))
    rows = found.orderBy("range", "place").offset(max(0, skip)).limit(limit if wanted else 0).drop("range", "place")
    return rows, before, offset + limit if before - offset >= limit else None
