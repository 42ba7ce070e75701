"""What the operators find against all that there is to find."""

from itertools import combinations, product

import numpy as np
import pytest

from trackmill.llm import chunks, decontamination


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 18])
def test_benchmark_finds_all_substitution_patterns(spark, n):
    """All patterns of a whole item with 0.8 of its words, and those with one word less, which must not be found."""
    item = [f"w{i}" for i in range(n)]
    most = n - -(-4 * n // 5)
    rows = [(p, " ".join("x" if i in p else w for i, w in enumerate(item))) for p in combinations(range(n), most)]
    beyond = [(p, " ".join("x" if i in p else w for i, w in enumerate(item))) for p in list(combinations(range(n), most + 1))[:50]]
    frame = spark.createDataFrame([(i, f"a b {t} c") for i, (_, t) in enumerate(rows + beyond)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {r.doc_id for r in decontamination.overlaps(frame, benchmark).collect()}

    def best(pattern):
        run = top = 0
        for i in range(n):
            run = max(0, run + (decontamination.SUBSTITUTION if i in pattern else 1))
            top = max(top, run)
        return top

    also = {len(rows) + i for i, (p, _) in enumerate(beyond) if best(p) >= decontamination.SCORE}
    assert found == set(range(len(rows))) | also


def test_masks_lose_no_window():
    """Every pattern of three substitutions in ten words, and of one in five to nine, leaves a mask's words whole."""
    for n, most in [(10, 3)] + [(n, 1) for n in range(5, 10)] + [(n, 0) for n in range(1, 5)]:
        masks = decontamination.MASKS[max(k for k in decontamination.MASKS if k <= n)]
        for changed in combinations(range(n), most):
            assert any(all(at + i < n and at + i not in changed for i in m) for m in masks for at in range(n)), (n, changed)


def test_words_that_many_items_share_make_no_hits(spark):
    items = [(i, f"a{i} of the b{i} c{i}") for i in range(300)]
    rows = [(i, " ".join(f"of the d{i} e{j}" for j in range(20))) for i in range(200)] + [(500, "x a7 of the other c7 y")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert [(r.doc_id, r.item_id, r.doc_start, r.n_matched) for r in found] == [(500, 7, 1, 4)]


def test_items_over_the_ends_of_documents(spark):
    """A document begins or ends inside an item: the part that is there has 0.8 of the words."""
    rows = []
    for n in (5, 8, 10, 14, 20, 33):
        words = [f"w{n}x{i}" for i in range(n)]
        for cut in range(n // 5 + 2):
            rows += [(n, n - cut, -cut, " ".join(words[cut:])), (n, n - cut, 0, " ".join(words[: n - cut]))]
    frame = spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in {r[0] for r in rows}], "item_id long, text string")
    expected = {(i, n, m, at) for i, (n, m, at, _) in enumerate(rows) if 5 * m >= 4 * n or m >= decontamination.SCORE}
    assert {(r.doc_id, r.item_id, r.n_matched, r.doc_start) for r in decontamination.overlaps(frame, benchmark).collect()} == expected


@pytest.mark.parametrize("n", [21, 40, 60])
def test_benchmark_finds_stretches_with_evenly_spread_substitutions(spark, n):
    item = [f"w{i}" for i in range(n)]
    patterns = []
    for gap, first in product(range(3, 9), range(8)):
        patterns.append({i for i in range(first, n, gap)})
    rows = [(k, " ".join("x" if i in p else w for i, w in enumerate(item))) for k, p in enumerate(patterns)]
    expected = set()
    for k, p in enumerate(patterns):
        run = top = 0
        for i in range(n):
            run = max(0, run + (decontamination.SUBSTITUTION if i in p else 1))
            top = max(top, run)
        if top >= decontamination.SCORE or 5 * (n - len(p)) >= 4 * n:
            expected.add(k)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontamination.overlaps(frame, benchmark).collect()} == expected != set()


def test_repeated_passages_are_found_whole(spark):
    """Passages of 50 to 60 short words in different surroundings: nearly all, and up to their last byte."""
    random = np.random.default_rng(11)
    words = lambda n: " ".join("".join(chr(97 + c) for c in random.integers(0, 26, random.integers(2, 8))) for _ in range(n))
    passages = [words(int(random.integers(50, 61))) for _ in range(400)]
    rows = [(2 * i + j, f"{words(20)} {j} {p} {j} {words(20)}") for i, p in enumerate(passages) for j in (0, 1)]
    found = {r.doc_id: r.n_removed for r in chunks.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = [found[2 * i + 1] == len(p) + 2 for i, p in enumerate(passages)]
    assert all(found[2 * i] == 0 for i in range(400)) and sum(whole) >= 394, sum(whole)
    assert all(found[2 * i + 1] in (0, len(p) + 2) for i, p in enumerate(passages))


def test_growth_goes_on_beyond_the_first_context(spark, monkeypatch):
    random = np.random.default_rng(12)
    words = lambda n: " ".join("".join(chr(97 + c) for c in random.integers(0, 26, 6)) for _ in range(n))
    passage = words(60)
    rows = [(i, f"{words(30)} {i} {passage} {i} {words(30)}") for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, chunks.repeated_spans(frame).collect()))
    assert [r[2] for r in whole] == [0] + [len(passage) + 2] * 3
    monkeypatch.setattr(chunks, "CONTEXT", 2)
    monkeypatch.setattr(chunks, "WIDER", 8)
    assert sorted(map(tuple, chunks.repeated_spans(frame).collect())) == whole


def test_copies_of_short_documents_are_removed(spark):
    rows = [(1, "a short text"), (2, "a short text"), (3, "another"), (2, "a short text"), (5, "a short text and more"), (6, "")]
    found = chunks.documents_to_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in found) == [(1, 0, 0), (2, 12, 1), (2, 12, 1), (3, 0, 0), (5, 0, 0), (6, 0, 0)]
