"""Operator 3: quality rules and gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BYTE_VALUES, pieces, prefix_hash, shingles, span_hash, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars", "n_lines", "n_upper", "n_digits", "n_stops", "n_distinct_words", "n_bangs")
#: Features of the trees, and the direction in which the predicted quality may move with each (0: free).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "stop_share": 0,
    "distinct_share": 0,
    "bang_share": -1,
    "words_per_line": 0,
}
#: At most so many labelled documents, those with the smallest id hashes, train the trees.
SAMPLE = 20_000
SEED = 17

_SYMBOL, _UPPER, _DIGIT, _STOP, _BANG, _LEAD = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_STOP[[ord(c) for c in ".,;:?"]] = True
_BANG[ord("!")] = True
_LEAD[:] = True
_LEAD[128:192] = False  # continuation bytes of UTF-8 begin no code point


def statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS and MORE of the texts whose bytes lie between the offsets."""
    n = len(offsets) - 1
    starts, ends, counts = words(raw, offsets)
    out = {"n_words": np.diff(counts)}
    total = lambda mask: _between(np.concatenate(([0], np.cumsum(mask))), offsets)
    lead = _LEAD[raw]
    code_points = np.concatenate(([0], np.cumsum(lead)))
    in_words = np.concatenate(([0], np.cumsum(code_points[ends] - code_points[starts])))
    out["word_chars"] = _between(in_words, counts)
    prefix = prefix_hash(BYTE_VALUES[raw])
    hashes = span_hash(prefix, starts, ends)
    row = np.repeat(np.arange(n), out["n_words"])
    out["n_dup_lines"], out["n_lines"] = _lines(raw, offsets, prefix, starts)
    out["n_repeat_words"] = _repeated_words(hashes, counts, row)
    out["n_distinct_words"] = np.bincount(row[_first_of_equal(row, hashes)], minlength=n)
    for name, kind in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_stops", _STOP), ("n_bangs", _BANG)):
        out[name] = total(kind[raw])
    out["n_chars"] = _between(code_points, offsets)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _between(sums: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _first_of_equal(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices of the first of each (row, hash)."""
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    return order[new]


def _lines(raw: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of their text, and all lines with a word."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    stop = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
    row = np.repeat(np.arange(n), np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=n)[:n] + 1)
    held = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, row = begin[held], stop[held], row[held]
    full = np.bincount(row, minlength=n)
    distinct = np.bincount(row[_first_of_equal(row, span_hash(prefix, begin, stop))], minlength=n)
    return full - distinct, full


def _repeated_words(hashes: np.ndarray, counts: np.ndarray, row: np.ndarray, width: int = 5) -> np.ndarray:
    """Words that stand in a window of five words found twice or more in the text."""
    n = len(counts) - 1
    windows, bounds = shingles(hashes, counts, width)
    if len(windows) == 0:
        return np.zeros(n, np.int64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((windows, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (windows[order][1:] == windows[order][:-1])
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = (np.arange(len(windows)) - bounds[owner] + counts[owner])[twice]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + width, len(hashes)), -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(row[covered], minlength=n)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES for each text."""
    share = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack(
        [
            np.log1p(s["n_words"]),
            share(s["word_chars"], s["n_words"]),
            share(s["n_symbols"], s["n_chars"]),
            share(s["n_dup_lines"], s["n_lines"]),
            share(s["n_repeat_words"], s["n_words"]),
            share(s["n_upper"], s["n_chars"]),
            share(s["n_digits"], s["n_chars"]),
            share(s["n_stops"], s["n_words"]),
            share(s["n_distinct_words"], s["n_words"]),
            share(s["n_bangs"], s["n_words"]),
            share(s["n_words"], s["n_lines"]),
        ]
    )


@dataclass
class Trees:
    """A boosted ensemble as flat node arrays: node i of all trees lies at index i."""

    bias: float
    roots: np.ndarray
    feature: np.ndarray  # -1 in leaves
    threshold: np.ndarray
    left: np.ndarray  # the right child is next to it
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality; all rows walk down a tree together."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                down = self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at])
                at = np.where(f < 0, at, down)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


@dataclass
class _Growing:
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def add(self) -> int:
        for part, empty in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.value, 0.0)):
            part.append(empty)
        return len(self.value) - 1


def fit(
    x: np.ndarray,
    y: np.ndarray,
    directions: list[int],
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    least: float = 2.0,
    shrink: float = 1.0,
) -> Trees:
    """Newton boosting on the logistic loss with histograms.

    A split on a feature with direction +1 or -1 is taken only if the child values keep
    that order, and passes the middle of both values down as a bound to its children, so
    the whole ensemble is monotone in that feature. ``least``: hessian a leaf must hold.
    """
    positive = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(positive / (1 - positive)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]) if len(x) else x.astype(int)
    grown, roots = _Growing(), []
    margin = np.full(len(x), bias)
    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        roots.append(grown.add())
        todo = [(roots[-1], np.arange(len(x)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            g, h = gradient[rows].sum(), hessian[rows].sum()
            own = float(np.clip(-g / (h + shrink), low, high))
            grown.value[node] = rate * own
            split = _best(binned[rows], gradient[rows], hessian[rows], directions, edges, low, high, least, shrink) if level < depth else None
            if split is None:
                margin[rows] += grown.value[node]
                continue
            f, b, a_left, a_right = split
            left, right = grown.add(), grown.add()
            grown.feature[node], grown.threshold[node], grown.left[node] = f, float(edges[f][b]), left
            goes = binned[rows, f] <= b
            middle = (a_left + a_right) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[directions[f]]
            todo += [(left, rows[goes], level + 1, *bounds[0]), (right, rows[~goes], level + 1, *bounds[1])]
    return Trees(
        bias,
        np.array(roots, int),
        np.array(grown.feature or [-1]),
        np.array(grown.threshold or [0.0]),
        np.array(grown.left or [0]),
        np.array(grown.value or [0.0]),
        depth,
    )


def _best(binned, gradient, hessian, directions, edges, low, high, least, shrink):
    best, found = 1e-6, None
    g, h = gradient.sum(), hessian.sum()
    for f, edge in enumerate(edges):
        if not len(edge):
            continue
        gl = np.cumsum(np.bincount(binned[:, f], gradient, len(edge) + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], hessian, len(edge) + 1))[:-1]
        a = np.clip(-gl / (hl + shrink), low, high)
        b = np.clip(-(g - gl) / (h - hl + shrink), low, high)
        gain = _gain(gl, hl, a, shrink) + _gain(g - gl, h - hl, b, shrink) - _gain(g, h, np.clip(-g / (h + shrink), low, high), shrink)
        gain[(hl < least) | (h - hl < least) | ((b - a) * directions[f] < 0)] = 0
        at = int(np.argmax(gain))
        if gain[at] > best:
            best, found = gain[at], (f, at, float(a[at]), float(b[at]))
    return found


def _gain(g, h, a, shrink):
    return -(g * a + 0.5 * (h + shrink) * a * a)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from labelled documents.

    The only bound on data in this operator: of all labels, the ``sample`` with the
    smallest hash of their id are used, whatever the size of the corpus. Repeated ids
    count with each row; labels without a document or with a null are ignored. Without
    both classes the trees are empty and every score is the same.
    """
    chosen = (
        labels.filter("doc_id is not null and quality is not null")
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
        .limit(sample)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    data = measure(rows, carry=("doc_id", "quality")).toPandas().sort_values("doc_id")
    x = features({c: data[c].to_numpy() for c in (*COUNTS, *MORE)})
    return fit(x, data["quality"].to_numpy(float), list(FEATURES.values()))


def measure(rows: DataFrame, carry: tuple[str, ...] = ("doc_id",), trees: Trees | None = None) -> DataFrame:
    """``carry`` and the statistics of each text, and with ``trees`` its score."""
    added = [*(T.StructField(c, T.LongType()) for c in (*COUNTS, *MORE)), *([T.StructField("score", T.DoubleType())] if trees else [])]
    schema = T.StructType([*(rows.schema[c] for c in carry), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in pieces(batch):
                s = statistics(raw, offsets)
                kept = [batch.column(c).slice(first, end - first) for c in carry]
                score = [pa.array(trees.score(features(s)))] if trees else []
                yield pa.RecordBatch.from_arrays(kept + [pa.array(s[c]) for c in (*COUNTS, *MORE)] + score, schema.names)

    return rows.select(*(c for c in carry if c != "text"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def grade(documents: DataFrame, trees: Trees, threshold: float = 0.35, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, the base statistics, base_failed, score and kept for every document.

    Null and empty texts have zero words and fail the base rule. Columns outside of ``carry`` are not
    read, and none of it may have the name of a result. Repeated rows are graded each. An empty table gives no rows.
    """
    # One step measures and scores: a second one behind it would give every task another Python worker and carry the texts through it.
    scored = measure(documents, carry, trees)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def documents_to_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract of query op3."""
    return grade(documents, train(documents, labels)).select("doc_id", *COUNTS, "base_failed", "score", "kept")
