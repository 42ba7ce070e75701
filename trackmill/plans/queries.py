"""The user-facing queries over one store, each a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.functions.checks import require_limit, require_run_id
from trackmill.operators.comparison import compare, document_metrics, scorecard
from trackmill.operators.ranking import (
    matching,
    newest_run_with_tracks,
    top_tracks,
    with_envelope,
)
from trackmill.operators.runs import newest_first, parsed, summarize_documents
from trackmill.operators.tracks import nest_positions, statistics
from trackmill.sources import documents, tables
from trackmill.sources.csv_tables import read_evaluated

# Largest page sizes.
MAXIMUM_TRACKS = 1000
MAXIMUM_RUNS = 500


@dataclass(frozen=True)
class Store:
    """Where runs and tracks live: tables below ``root``, else archived files.

    The run table, when it exists, is authoritative and never mixed with the
    JSON folder. The current tracks are those of the newest run with stored
    tracks, else the CSV.
    """

    spark: SparkSession
    root: str
    history: str | None = None
    tracks_csv: str | None = None

    @property
    def run_source(self) -> str:
        """``table`` or ``json``."""
        return "table" if tables.has_runs(self.spark, self.root) else "json"

    def _documents(self, limit: int | None = None) -> DataFrame:
        """Full documents, newest first by the rule of the active source."""
        if self.run_source == "table":
            runs = tables.read_runs(self.spark, self.root)
            ordered = runs.orderBy(*newest_first(runs)).select("run_id", "manifest_json")
            return ordered if limit is None else ordered.limit(limit)
        if self.history is None:
            return self.spark.createDataFrame([], "run_id string, manifest_json string")
        listed = documents.list_manifests(self.spark, self.history, limit)
        return listed.select("run_id", "manifest_json")

    def _snapshot(self) -> tuple[DataFrame, str]:
        """Current tracks (with their ``run_id``, null for the CSV) and their source."""
        if self.run_source == "table":
            runs = tables.read_runs(self.spark, self.root)
            newest = newest_run_with_tracks(runs, tables.read_track_counts(self.spark, self.root)).take(1)
            if newest:
                return tables.read_tracks(self.spark, self.root, newest[0].run_id), "table"
        if self.tracks_csv is None:
            raise FileNotFoundError("no stored tracks and no evaluated-track CSV")
        rows = read_evaluated(self.spark, self.tracks_csv)
        return rows.withColumn("run_id", F.lit(None).cast("string")), "csv"

    def _run_tracks(self, run_id: str) -> DataFrame:
        return tables.read_tracks(self.spark, self.root, require_run_id(run_id))

    def _page(self, tracks, quality, minimum_confidence, limit) -> DataFrame:
        require_limit(limit, MAXIMUM_TRACKS)
        matches = matching(tracks, quality, minimum_confidence)
        page = nest_positions(top_tracks(matches, limit))
        return with_envelope(page, matches, limit).orderBy(
            F.desc("average_confidence"), "track_id"
        )

    def current_statistics(self) -> DataFrame:
        """Totals, level counts and label counts of the current tracks."""
        tracks, source = self._snapshot()
        return statistics(tracks).withColumn("storage_source", F.lit(source))

    def current_tracks(
        self, quality: str | None = None, minimum_confidence: float = 0.0, limit: int = 100
    ) -> DataFrame:
        """Best current tracks with the size of the whole match."""
        tracks, source = self._snapshot()
        page = self._page(tracks, quality, minimum_confidence, limit)
        return page.withColumn("storage_source", F.lit(source))

    def current_track(self, track_id: int) -> DataFrame:
        """One current track; no row when it does not exist."""
        tracks, _ = self._snapshot()
        return nest_positions(tracks.where(F.col("track_id") == track_id)).limit(1)

    def runs(self, limit: int = 50) -> DataFrame:
        """Compact records of the newest runs."""
        require_limit(limit, MAXIMUM_RUNS)
        return summarize_documents(self._documents(limit)).withColumn(
            "storage_source", F.lit(self.run_source)
        )

    def run_count(self) -> DataFrame:
        """Number of runs in the active source."""
        if self.run_source == "table":
            return tables.read_runs(self.spark, self.root).agg(F.count("*").alias("run_count"))
        if self.history is None:
            return self.spark.createDataFrame([(0,)], "run_count bigint")
        return documents.count_manifests(self.spark, self.history)

    def latest_run(self) -> DataFrame:
        """Document of the run that started last, finished or not."""
        if self.run_source == "table":
            started = tables.read_runs(self.spark, self.root)
        else:
            m = F.col("m.started_at_utc")
            started = parsed(self._documents()).withColumn("started_at_utc", m)
        newest = [F.col("started_at_utc").desc_nulls_last(), F.desc("run_id")]
        return started.orderBy(*newest).limit(1).select("run_id", "manifest_json")

    def run(self, run_id: str) -> DataFrame:
        """Document of one run; no row when it does not exist."""
        wanted = F.col("run_id") == require_run_id(run_id)
        if self.run_source == "table":
            shard = F.col("run_shard") == tables.run_shard(F.lit(run_id))
            runs = tables.scan_runs(self.spark, self.root).where(shard & wanted)
            return runs.select("run_id", "manifest_json")
        if self.history is None:
            return self._documents()
        found = documents.read_manifest(self.spark, self.history, run_id)
        return found.select("run_id", "manifest_json")

    def run_statistics(self, run_id: str) -> DataFrame:
        """Statistics of one run's tracks."""
        return statistics(self._run_tracks(run_id))

    def run_tracks(
        self,
        run_id: str,
        quality: str | None = None,
        minimum_confidence: float = 0.0,
        limit: int = 100,
    ) -> DataFrame:
        """Best tracks of one run with the size of the whole match."""
        return self._page(self._run_tracks(run_id), quality, minimum_confidence, limit)

    def run_track(self, run_id: str, track_id: int) -> DataFrame:
        """One track of one run; no row when it does not exist."""
        return nest_positions(self._run_tracks(run_id).where(F.col("track_id") == track_id))

    def _pair(self, baseline: str, candidate: str) -> tuple[DataFrame, DataFrame]:
        require_run_id(baseline)
        require_run_id(candidate)
        if baseline == candidate:
            raise ValueError("baseline and candidate must be different runs")
        both = self.run(baseline).unionByName(self.run(candidate))
        metrics = parsed(both).select("run_id", *document_metrics(F.col("m")))
        pairs = self.spark.createDataFrame(
            [(baseline, candidate)], "baseline_run_id string, candidate_run_id string"
        )
        return pairs, metrics

    def comparison(self, baseline: str, candidate: str) -> DataFrame:
        """Metric-by-metric comparison; no rows when either run is unknown."""
        return compare(*self._pair(baseline, candidate)).orderBy("ord")

    def comparison_summary(self, baseline: str, candidate: str) -> DataFrame:
        """Counts of available, improved, regressed and unchanged metrics."""
        return scorecard(*self._pair(baseline, candidate))
