"""op9's two lengths in one pass, and strings that repeat in slices."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from trackmill.llm import registry, suffixes


def plain(texts, length):
    """Runs of every text by plain search."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in raw for p in range(len(d) - length + 1))
    out = []
    for data in raw:
        runs = []
        for p in range(len(data) - length + 1):
            if seen[data[p : p + length]] > 1:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + length
                else:
                    runs.append([p, p + length])
        out.append(runs)
    return out


def expected(texts):
    for i, (text, runs, short) in enumerate(zip(texts, plain(texts, 400), plain(texts, 200), strict=True)):
        data, kept = (text or "").encode(), b""
        for start, end in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)], strict=True):
            kept += data[start:end]
        yield i, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in short)


def words(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(3, 8))) for _ in range(n))


def texts():
    passage, long = words("passage", 52), words("long", 130)
    assert 200 < len(passage) < 400 < len(long)
    near = words("near", 90)
    return [
        words(1, 60) + " " + passage + " " + words(2, 60),
        passage + " " + words(3, 30),
        words(4, 100) + " " + passage,  # at the text's end a window of 400 bytes doesn't fit
        words(5, 20) + long + words(6, 20),
        words(7, 20) + long + words(8, 20) + long[:300],
        words(9, 80),
        words(10, 80),
        near + " one " + words(11, 40),
        near + " two " + words(11, 40),
        passage,
        passage,
        "the " * 150 + words(12, 20),
        words(13, 20) + "the " * 70 + words(14, 20),
        "é" * 180,
        passage[:199],
        "",
        None,
    ]


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_query_finds_passages_of_fifty_words_beside_the_contract(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 2_000)
    if hot == 1:
        monkeypatch.setattr(suffixes, "SLICE", 3)
        monkeypatch.setattr(suffixes, "PART_WINDOWS", 300)
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["op9_suffix_array_dedup"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_removed_200"]
    assert sorted(map(tuple, found.collect())) == list(expected(texts()))
    caught = {r.doc_id for r in found.filter("n_removed_200 > 0").collect()}
    assert caught >= {0, 1, 2} and not caught & {5, 6, 14}


def test_runs_do_not_depend_on_how_hot_suffixes_are_sliced(spark, monkeypatch):
    """Spark may hand over rows in any order each time that it reads them."""
    whole = suffixes._gathered

    def shuffled(batches, size):
        held = list(batches)
        if held:
            rows = pa.concat_batches(held)
            order = random.SystemRandom().sample(range(rows.num_rows), rows.num_rows)
            yield from whole(iter([rows.take(pa.array(order))]), size)

    monkeypatch.setattr(suffixes, "HOT", 1)
    monkeypatch.setattr(suffixes, "SLICE", 4)
    monkeypatch.setattr(suffixes, "_gathered", shuffled)
    shared = [words(f"shared {i}", 60) for i in range(12)]
    rows = [f"{i} {words(i, 10)} {shared[i // 2]} {words(-i, 10)}" for i in range(24)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.runs for r in suffixes.repeated_spans(frame, 200, 64).collect()}
    covered = [set().union(*(range(a, b) for a, b in found[i])) for i in range(24)]
    assert covered == [set().union(*(range(a, b) for a, b in runs)) for runs in plain(rows, 200)]
