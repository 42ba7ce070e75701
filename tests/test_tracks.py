import itertools
import math
import random
from collections import Counter

import pytest
from fixtures import OBSERVATION_SCHEMA, TRACK_SEVEN, evaluated, frame, observation, summary

from trackmill.functions.grading import StableThresholds
from trackmill.operators import ranking, tracks, validation
from trackmill.schemas import EVALUATED_COLUMNS, SUMMARY_COLUMNS


def observed(spark, rows):
    return spark.createDataFrame(rows, OBSERVATION_SCHEMA)


def graded(spark, rows):
    return frame(spark, rows, EVALUATED_COLUMNS)


def test_summary_of_one_track(spark):
    row = tracks.summarize(observed(spark, TRACK_SEVEN)).first()
    assert (row.dominant_label, row.observation_count) == ("person", 3)
    assert (row.first_frame, row.last_frame) == (1, 3)
    assert (row.duration_seconds, row.average_confidence) == (0.2, 0.7)
    assert row.displacement_pixels == 50.0
    assert (row.start_center_x, row.end_center_y) == (100.0, 240.0)


def by_hand(rows):
    """The summary definition, one track at a time."""
    result = {}
    rows = sorted(rows, key=lambda r: (r[0], r[4]))
    for key, group in itertools.groupby(rows, key=lambda r: (r[0], r[4])):
        ordered = sorted(group, key=lambda r: (r[1], r[2]))
        first, last = ordered[0], ordered[-1]
        mean = sum(round(r[6] * 10000) for r in ordered) / 10000 / len(ordered)
        far = math.sqrt((last[11] - first[11]) ** 2 + (last[12] - first[12]) ** 2)
        result[key] = (
            Counter(r[5] for r in ordered).most_common(1)[0][0], len(ordered), first[1], last[1],
            round(max(0.0, last[3] - first[3]), 3), round(mean, 4), round(far, 2),
        )
    return result


def test_summary_against_brute_force_with_ties_and_a_hot_track(spark):
    rng = random.Random(5)
    rows = []
    for seq in range(3000):
        track = 1 if seq % 3 == 0 else rng.randrange(2, 60)  # a third of all rows on one track
        rows.append(observation(
            track, rng.randrange(40), rng.randrange(1000) / 100, rng.choice("abc"),
            rng.randrange(10001) / 10000, rng.randrange(5000) / 100, rng.randrange(5000) / 100,
            run=f"run-{track % 2}", seq=seq,
        ))
    rng.shuffle(rows)
    got = tracks.summarize(observed(spark, rows).repartition(9)).collect()
    assert {
        (r.run_id, r.track_id): (
            r.dominant_label, r.observation_count, r.first_frame, r.last_frame,
            r.duration_seconds, r.average_confidence, r.displacement_pixels,
        )
        for r in got
    } == by_hand(rows)


def test_label_tie_goes_to_the_label_seen_first(spark):
    rows = [
        observation(1, 5, 0.5, "car", 0.5, 0.0, 0.0),
        observation(1, 2, 0.2, "bus", 0.5, 0.0, 0.0),
        observation(1, 2, 0.2, "van", 0.5, 0.0, 0.0, seq=1),
    ]
    assert tracks.summarize(observed(spark, rows)).first().dominant_label == "bus"


def test_observations_without_positions(spark):
    rows = observed(spark, TRACK_SEVEN)
    assert tracks.summarize(rows.drop("seq")).collect() == tracks.summarize(rows).collect()


def test_time_running_backwards_gives_zero_duration(spark):
    rows = [observation(1, 1, 3.0, "car", 0.5, 0.0, 0.0), observation(1, 2, 1.0, "car", 0.5, 0.0, 0.0)]
    assert tracks.summarize(observed(spark, rows)).first().duration_seconds == 0.0


@pytest.mark.parametrize(
    ("count", "seconds", "mean", "level", "reason"),
    [
        (20, 1.5, 0.75, "stable", "Persistent track with sufficient average confidence"),
        (4, 0.1, 0.55, "tentative", "Track requires more persistence or confidence"),
        (1, 0.0, 0.30, "weak", "too few observations; low average confidence"),
        (1, 0.0, 0.90, "weak", "too few observations"),
        (9, 0.0, 0.10, "weak", "low average confidence"),
        (5, 0.2, 0.50, "stable", "Persistent track with sufficient average confidence"),
        (9, 9.0, math.nan, "weak", "insufficient duration"),
    ],
)
def test_grades(spark, count, seconds, mean, level, reason):
    rows = frame(spark, [summary(7, count, seconds, mean)], SUMMARY_COLUMNS)
    row = tracks.evaluate(rows).first()
    assert (row.quality_level, row.quality_reason) == (level, reason)


def test_grading_keeps_every_row(spark):
    rows = [summary(7, 20, 1.5, 0.75), summary(7, 4, 0.1, 0.55), summary(7, 1, 0.0, 0.3)]
    counts = tracks.quality_counts(tracks.evaluate(frame(spark, rows, SUMMARY_COLUMNS))).first()
    assert (counts.stable, counts.tentative, counts.weak, counts.total) == (1, 1, 1, 3)


def test_thresholds(spark):
    rows = frame(spark, [summary(7, 20, 1.5, 0.75)], SUMMARY_COLUMNS)
    strict = StableThresholds(observations=21)
    assert tracks.evaluate(rows, strict).first().quality_level == "tentative"
    for bad in ({"observations": 0}, {"duration": -1.0}, {"confidence": 1.5}):
        with pytest.raises(ValueError):
            StableThresholds(**bad)


def test_counts_keep_unknown_levels_in_the_total(spark):
    rows = [evaluated(i, level) for i, level in enumerate(["stable", "stable", "odd", "weak"])]
    row = tracks.quality_counts(graded(spark, rows)).first()
    assert (row.stable, row.tentative, row.weak, row.total) == (2, 0, 1, 4)


def test_nested_positions_round_trip(spark):
    rows = graded(spark, [evaluated(1)])
    nested = tracks.nest_positions(rows)
    assert nested.first().start_position.x == 100.0
    assert tracks.flatten_positions(nested).select(rows.columns).collect() == rows.collect()


def test_statistics(spark):
    rows = [evaluated(1, label="car"), evaluated(2, label="bus"), evaluated(3, "weak", label="car")]
    got = {(r.section, r.name): r.value for r in tracks.statistics(graded(spark, rows)).collect()}
    assert got == {
        ("total", "tracks"): 3, ("quality", "stable"): 2, ("quality", "tentative"): 0,
        ("quality", "weak"): 1, ("label", "car"): 2, ("label", "bus"): 1,
    }
    ordered = tracks.ordered_label_counts(graded(spark, rows)).collect()
    assert [(r.dominant_label, r.track_count) for r in ordered] == [("car", 2), ("bus", 1)]


def test_filters_and_order(spark):
    rows = graded(spark, [evaluated(1, mean=0.9), evaluated(2, mean=0.7), evaluated(3, "weak", 0.4),
                          evaluated(4, mean=0.9)])
    kept = ranking.top_tracks(ranking.matching(rows, "stable", 0.8), 10).collect()
    assert [r.track_id for r in kept] == [1, 4]
    assert [r.track_id for r in ranking.top_tracks(rows, 3).collect()] == [1, 4, 2]
    page = ranking.with_envelope(ranking.top_tracks(rows, 2), rows, 2).first()
    assert (page.total_matching, page.returned) == (4, 2)
    for bad in (lambda: ranking.matching(rows, "odd"), lambda: ranking.matching(rows, None, 1.1),
                lambda: ranking.top_tracks(rows, 0)):
        with pytest.raises(ValueError):
            bad()


def test_top_tracks_per_run(spark):
    rows = graded(spark, [evaluated(i, mean=i / 10, run=f"run-{i % 2}") for i in range(8)])
    got = ranking.top_tracks_per_run(rows, 2).collect()
    assert sorted((r.run_id, r.place, r.track_id) for r in got) == [
        ("run-0", 1, 6), ("run-0", 2, 4), ("run-1", 1, 7), ("run-1", 2, 5)]


def test_newest_run_without_tracks_is_skipped(spark):
    runs = spark.createDataFrame(
        [("run-a", "2026-01-01T14:00"), ("run-b", "2026-01-01T15:00"), ("run-c", None)],
        "run_id string, finished_at_utc string",
    )
    rows = graded(spark, [evaluated(1, run="run-a"), evaluated(1, run="run-c")])
    assert ranking.newest_run_with_tracks(runs, rows).first().run_id == "run-a"


def test_violations(spark):
    rows = [
        evaluated(1), evaluated(-1), evaluated(2, "odd"), evaluated(3, mean=1.5),
        evaluated(4, mean=math.nan), evaluated(5, observation_count=-1),
        evaluated(6, dominant_label=None),
    ]
    got = validation.with_violations(graded(spark, rows)).orderBy("track_id").collect()
    assert [len(r.violations) for r in got] == [1, 0, 1, 1, 1, 1, 1]


def test_duplicates_and_orphans(spark):
    rows = graded(spark, [evaluated(1), evaluated(1), evaluated(2), evaluated(1, run="run-b")])
    found = validation.duplicate_keys(rows).collect()
    assert [(r.run_id, r.track_id, r.copies) for r in found] == [("run-a", 1, 2)]
    problems = validation.run_track_problems(rows).collect()
    assert [(r.run_id, r.problem) for r in problems] == [("run-a", validation.DUPLICATE_TEXT)]
    known = spark.createDataFrame([("run-a",)], "run_id string")
    assert [r.run_id for r in validation.orphans(rows, known).collect()] == ["run-b"]
