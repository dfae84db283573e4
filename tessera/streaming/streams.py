"""Streams: feedback tail, incremental ingest, sliding search health, counters, last runs."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.text import estimate_chunks, is_blank
from ..operators import artifacts as A
from ..operators.graph import build_edges, build_nodes
from ..operators.feedback import flatten_events
from ..operators.telemetry import health_aggregates
from ..sources.keyed import KeyedStore
from ..sources.readers import BINARY_FILES, INCLUDE, parse_feedback_lines, relative, textual
from ..sources.stores import cut_lineage


def stream_feedback(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Training rows of an append-only log; a replayed (request, rank) counts once within ``late``."""
    lines = spark.readStream.text(path)
    events = parse_feedback_lines(lines)[0].withColumn("event_time", F.try_to_timestamp("timestamp"))
    once = events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["request_id", "rank"])
    return flatten_events(once)


STORED_LEDGER = "path string, artifact_type string, subsystem string, message_entities array<string>, telemetry_signals array<string>, digest string, chunk_count long, coverage_ratio double, epoch int"
STORED_CHUNKS = "path string, sequence int, text string, chunk_id string, content_digest string, namespace string, point_id string, vector array<float>, epoch int"


def ledger_store(spark: SparkSession, store: str) -> KeyedStore:
    """What is known of each path."""
    return KeyedStore(spark, f"{store}/ledger", STORED_LEDGER, ("path",))


def chunk_store(spark: SparkSession, store: str) -> KeyedStore:
    """Chunks by point id; all chunks of a path lie in one bucket."""
    return KeyedStore(spark, f"{store}/chunks", STORED_CHUNKS, ("point_id",), by="path")


def stored_ledger(spark: SparkSession, store: str) -> DataFrame:
    """The ledger row of each path."""
    return ledger_store(spark, store).read()


def stored_chunks(spark: SparkSession, store: str) -> DataFrame:
    """The chunks of each path's last ingest, one for each point id."""
    return chunk_store(spark, store).read()


def stored_graph(spark: SparkSession, store: str, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of what is stored: paths that are gone have none."""
    rows = stored_ledger(spark, store)
    files = rows.withColumns({"git_commit": F.lit(None).cast("string"), "git_timestamp": F.lit(None).cast("long")})
    chunks = stored_chunks(spark, store).select("path", "chunk_id").join(rows.select("path", "artifact_type"), "path")
    return build_nodes(files, catalog, chunks), build_edges(files, catalog, chunks)


def ingest_batch(store: str, window: int = 1000, overlap: int = 200, embedder=None, prefixes: tuple[str, ...] = ("src",)) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds changed files' chunks, vectors and ledger rows to ``store``.

    Only the ledger buckets of the batch's paths are read, and a batch writes what it changes and no more; one
    that runs again changes nothing. A store belongs to one checkpoint. ``batch`` has path, content and modified;
    of rows of one path the last counts.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # The batch is written as it comes, so that its source runs once; then texts move once, to their paths, and meet the ledger there.
        given = cut_lineage(batch.select("path", "content", "modified"))
        files = given.groupBy("path").agg(F.max_by("content", "modified").alias("content"))
        ledger, chunks = ledger_store(spark, store), chunk_store(spark, store)
        known = ledger.read(ledger.touched(given)).select("path", "digest", "chunk_count", "coverage_ratio")
        # Several jobs read what changed, so it is written once for all.
        states = cut_lineage(A.classify(A.describe(files, list(prefixes)), known).where("state <> 'skipped'"))
        fresh = A.embed(A.chunk(states.select("path", "content"), window, overlap), embedder)
        chunks.write(fresh.withColumn("epoch", F.lit(epoch)), states, name=f"batch-{epoch}")
        count = F.when(is_blank(F.col("content")), 0).otherwise(estimate_chunks(F.col("content"), window, overlap))
        done = states.withColumn("chunk_count", count.cast("long")).withColumn("coverage_ratio", F.when(F.col("chunk_count") > 0, 1.0).otherwise(0.0))
        ledger.write(done.withColumn("epoch", F.lit(epoch)), name=f"batch-{epoch}")

    return run


def removal_batch(store: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that takes removed paths (rows of ``listing_changes``) out of ``store``."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        gone = cut_lineage(batch.where("change = 'removed'").select("path").distinct())
        if not gone.isEmpty():
            chunk_store(spark, store).write(drop=gone, name=f"gone-{epoch}")
            ledger_store(spark, store).write(drop=gone, name=f"gone-{epoch}")

    return run


class _Listed(StatefulProcessor):
    """What the last listing of each path of a bucket said of it, and a timer for the first listing that lacks some.

    A bucket's paths are read and written as one list, so what a listing costs is in proportion to its rows, and the
    calls to the state store are in proportion to the buckets.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "path string, digest string, at long")

    def _held(self) -> dict:
        return {p: (d, at) for p, d, at in self.last.get()} if self.last.exists() else {}

    def _put(self, held: dict) -> None:
        if held:
            self.last.put([(p, d, at) for p, (d, at) in held.items()])
        else:
            self.last.clear()

    def _rows(self, found: list):
        import pandas as pd

        return pd.DataFrame(found, columns=["path", "change", "digest", "listed_at"])

    def handleInputRows(self, key, rows, timerValues):
        newest: dict = {}
        for pdf in rows:
            for p, d, at in zip(pdf["path"], pdf["digest"], pdf["at"].tolist(), strict=True):
                if p not in newest or at > newest[p][1]:
                    newest[p] = (d, at)
        held, times, found = self._held(), set(), []
        for p, (d, at) in newest.items():
            old = held.get(p)
            # A listing that is read again says nothing new.
            if old is None or at > old[1]:
                held[p] = (d, at)
                times.add(at)
                if old is None or old[0] != d:
                    found.append((p, "added" if old is None else "changed", d, at))
        if times:
            self._put(held)
            for at in times:
                self.handle.registerTimer(at)
        if found:
            yield self._rows(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, at = self._held(), expiredTimerInfo.getExpiryTimeInMs()
        gone = [(p, "removed", d, last) for p, (d, last) in held.items() if last == at]
        if gone:
            for p, *_ in gone:
                del held[p]
            self._put(held)
            yield self._rows(gone)

    def close(self) -> None:
        pass


#: Buckets of paths that a stream of listings is followed in; fixed by a stream's checkpoint.
LISTED_BUCKETS = 256


def listing_changes(listings: DataFrame, spread: str = "1 minute", buckets: int = LISTED_BUCKETS) -> DataFrame:
    """``added``, ``changed`` and ``removed`` paths of a stream of listings ``(path, digest, listed_at)``.

    A listing names every path with one time; its rows come within ``spread`` of each other in event time, and
    listings further apart. A path is removed when a later listing has come without it: as the watermark passes a
    listing, the timer of its bucket finds the paths that no later one has named. Rows of a listing read again change
    nothing. State is one row a path, a list for each of ``buckets``; it needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``). ``listed_at`` of a removal is the last listing that had the path.
    """
    rows = listings.withWatermark("listed_at", spread).select("path", "digest", "listed_at", F.unix_millis("listed_at").alias("at"), F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket"))
    out = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Listed(), outputStructType="path string, change string, digest string, listed_at long", outputMode="Append", timeMode="EventTime")
    return out.withColumn("listed_at", F.timestamp_millis("listed_at"))


def ingest_stream(texts: DataFrame, store: str, checkpoint: str, window: int = 1000, overlap: int = 200, embedder=None, trigger: dict | None = None, prefixes: tuple[str, ...] = ("src",)) -> StreamingQuery:
    """Keep ``store`` up to date with a stream of ``(path, content, modified)``; the running query.

    ``trigger`` is that of ``DataStreamWriter.trigger``; by default the query ends when all there is has been read.
    """
    writer = texts.select("path", "content", "modified").writeStream.foreachBatch(ingest_batch(store, window, overlap, embedder, prefixes))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_ingest(spark: SparkSession, root: str, store: str, checkpoint: str, include: tuple[str, ...] = INCLUDE, **options) -> StreamingQuery:
    """Watch a tree of files and keep ``store`` up to date with new and changed ones: ``ingest_stream`` of the tree.

    Spark tells files by path and time, so a changed file is read again; an unchanged text is skipped by
    its digest. This stream doesn't see removed files; ``listing_changes`` does, from listings of the tree.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("recursiveFileLookup", "true").load(root)
    return ingest_stream(textual(relative(files, root, include, "modificationTime"), "modified"), store, checkpoint, **options)


def stream_removals(changes: DataFrame, store: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Take the paths that ``listing_changes`` finds removed out of ``store``; the running query."""
    writer = changes.writeStream.foreachBatch(removal_batch(store)).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_search_health(events: DataFrame, hit, miss, failed, latency, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sliding search health, for any output mode; rows later than ``late`` are left out. A row is in each window that it falls in."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n"), *health_aggregates(hit, miss, failed, latency))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "hit_ratio", "failure_ratio", "p95_latency")


def health_panes(events: DataFrame, hit, miss, failed, latency, pane: str = "1 minute", k: int = 200) -> DataFrame:
    """Counts and a latency sketch of each pane of ``ts``, a batch or a stream with a watermark.

    The sketch's size follows from ``k``. Its quantiles are exact for up to ``k`` rows; beyond, their rank is off by
    no more than ``2.3 / k ** 0.9`` of all rows, in 99 of 100 cases.
    """
    return events.groupBy(F.window("ts", pane).alias("pane")).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"), F.count_if(failed).alias("failures"), F.kll_sketch_agg_double(latency.cast("double"), F.lit(k)).alias("sketch"),
    )


def windows_of_panes(panes: DataFrame, window: str, slide: str, k: int = 200) -> DataFrame:
    """Search health of the sliding windows that ``panes`` make up: panes are merged, so no row is in several windows."""
    n, hits, misses, failures = (F.sum(c) for c in ("n", "hits", "misses", "failures"))
    out = panes.groupBy(F.window("pane", window, slide).alias("w")).agg(
        n.alias("n"), (hits / F.greatest(hits + misses, F.lit(1))).alias("hit_ratio"), (failures / F.greatest(n, F.lit(1))).alias("failure_ratio"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
    )
    p95 = F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.95)))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "hit_ratio", "failure_ratio", p95.alias("p95_latency"))


def exact_windows(events: DataFrame, hit, miss, failed, latency, window: str, slide: str, pane: str) -> DataFrame:
    """Search health of sliding windows with the exact P95, from panes that count each latency.

    A pane has one row for each of its latencies, a window one with the latencies of its panes and their numbers.
    """
    counts = events.groupBy(F.window("ts", pane).alias("pane"), latency.cast("double").alias("latency")).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"), F.count_if(failed).alias("failures"),
    )
    n, hits, misses, failures = (F.sum(c) for c in ("n", "hits", "misses", "failures"))
    known = F.collect_list(F.when(F.col("latency").isNotNull(), F.struct("latency", "n")))
    out = counts.groupBy(F.window("pane", window, slide).alias("w")).agg(
        n.alias("n"), (hits / F.greatest(hits + misses, F.lit(1))).alias("hit_ratio"), (failures / F.greatest(n, F.lit(1))).alias("failure_ratio"), F.array_sort(known).alias("known"),
    )
    total = F.aggregate("known", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    # A decimal share, so that 0.95 of 20 rows are 19. The place is carried along, where a column would be computed for each latency.
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("at"), F.ceil(F.lit(Decimal("0.95")) * total).cast("long").alias("place"))

    def step(a, x):
        upto = a["upto"] + x["n"]
        return F.struct(upto.alias("upto"), F.when(a["at"].isNull() & (upto >= a["place"]), x["latency"]).otherwise(a["at"]).alias("at"), a["place"].alias("place"))

    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "hit_ratio", "failure_ratio", F.aggregate("known", start, step)["at"].alias("p95_latency"))


def stream_health_windows(events: DataFrame, hit, miss, failed, latency, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes", pane: str | None = None, k: int = 200, exact: bool = False) -> DataFrame:
    """Sliding search health from panes, for append mode: a window comes once, when it is over. Rows later than ``late`` are left out.

    State is one row a pane (by default a slide) and one a window, each with a sketch of bounded size; with ``exact``
    the P95 is exact, and state is one row for each latency of a pane.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    if exact:
        return exact_windows(events, hit, miss, failed, latency, window, slide, pane or slide)
    return windows_of_panes(health_panes(events, hit, miss, failed, latency, pane or slide, k), window, slide, k)


def stream_score_drift(results: DataFrame, window: str = "15 minutes", slide: str = "1 minute", late: str = "10 minutes", band: float = 0.2) -> DataFrame:
    """Mean of adjusted less base score in sliding windows, from sums of panes, and whether it leaves the band."""
    rows = results.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    delta = F.col("adjusted_score") - F.col("base_score")
    panes = rows.groupBy(F.window("ts", slide).alias("pane")).agg(F.count(delta).alias("n"), F.sum(delta).alias("delta"))
    out = panes.groupBy(F.window("pane", window, slide).alias("w")).agg(F.sum("n").alias("n"), (F.sum("delta") / F.sum("n")).alias("mean_delta"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean_delta", (F.abs("mean_delta") > band).alias("outside_band"))


class _Held(StatefulProcessor):
    """The windows in a row that breach a rule."""

    def __init__(self, slide_ms: int):
        self.slide = slide_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first long, last long, n long, worst double, fired boolean")

    def _row(self, key, state: str, run):
        import pandas as pd

        return pd.DataFrame({"rule": [key[0]], "state": [state], "first_window": [run[0]], "last_window": [run[1]], "n_windows": [run[2]], "worst": [run[3]]})

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        pdf = pd.concat(list(rows)).sort_values("window_start")
        run = self.run.get() if self.run.exists() else None
        for start, breach, value, least, highest in zip(*(pdf[c] for c in ("window_start", "breach", "value", "least", "highest")), strict=True):
            at = int(start.timestamp() * 1000)
            if run is not None and at <= run[1]:
                continue  # read again
            if run is not None and (not breach or at != run[1] + self.slide):
                if run[4]:
                    yield self._row(key, "resolved", run)
                run = None
            if breach:
                worst = value if run is None else (max if highest else min)(run[3], value)
                run = (run[0] if run else at, at, (run[2] if run else 0) + 1, float(worst), bool(run and run[4]))
                if not run[4] and run[2] >= least:
                    run = (*run[:4], True)
                    yield self._row(key, "fired", run)
        if run is None:
            self.run.clear()
        else:
            self.run.update(run)
            # A window that never comes ends the run when the one after it is over.
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(run[1] + 2 * self.slide)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.run.exists():
            run = self.run.get()
            if expiredTimerInfo.getExpiryTimeInMs() == run[1] + 2 * self.slide:
                self.run.clear()
                if run[4]:
                    yield self._row(key, "resolved", run)

    def close(self) -> None:
        pass


def stream_alerts(windows: DataFrame, rules: dict[str, tuple], slide_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Alerts that hold, from a stream of windows: rule, state (``fired`` or ``resolved``), first_window, last_window, n_windows, worst.

    ``rules`` are those of ``alert_episodes``. A rule fires as soon as every window for its time breaches, and is
    resolved when a window does well or none comes any more; state is one run a rule. Windows come in order, or at
    least in order from batch to batch. Needs the RocksDB state store.
    """
    cases = [
        F.struct(F.lit(name).alias("rule"), F.coalesce(breach, F.lit(False)).alias("breach"), value.cast("double").alias("value"), F.lit(max(1, -(-seconds // slide_seconds))).alias("least"), F.lit(worst == "max").alias("highest"))
        for name, (breach, value, worst, seconds) in rules.items()
    ]
    rows = windows.withColumn("window_start", F.col("window_start").cast("timestamp")).withWatermark("window_start", late).select("window_start", F.explode(F.array(*cases)).alias("c")).select("window_start", "c.*")
    out = rows.groupBy("rule").transformWithStateInPandas(
        statefulProcessor=_Held(slide_seconds * 1000), outputStructType="rule string, state string, first_window long, last_window long, n_windows long, worst double", outputMode="Append", timeMode="EventTime"
    )
    return out.withColumns({c: F.timestamp_millis(c) for c in ("first_window", "last_window")})


def stream_counters(events: DataFrame, labels: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts of each combination of labels."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *labels).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *labels, "n")


def stream_last_run(runs: DataFrame) -> DataFrame:
    """Status and time of each profile's last run, for update or complete mode."""
    return runs.groupBy("profile").agg(F.max_by("success", "ts").alias("success"), F.max("ts").alias("last_run"))
