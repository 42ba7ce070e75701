"""Operator 1: toxicity categories by a classifier chain of linear models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BYTE_VALUES, lowered, mix, pieces, prefix_hash, span_hash, words

#: Hashed word features.
SLOTS = 1 << 18
#: Beginnings of so many bytes of longer words are features of their own.
BEGINNINGS = (6, 7, 8)
#: At most so many labelled documents, those with the smallest id hashes, train the chain.
SAMPLE = 4_000
FOLDS = 4
SEED = 29
#: Words that name a category inside labelled toxic documents; the chain learns its own weights for all words.
CATEGORIES = {
    "insult": ("idiot", "moron", "clown", "loser", "scum", "trash"),
    "contempt": ("pathetic", "worthless", "disgusting", "stupid"),
}
#: The last link of the chain: the given label.
LAST = "toxic"

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[65:91] = _WORD_BYTE[97:123] = True
_WORD_BYTE[128:] = True


def word_slots(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the lower-cased words and word beginnings of each text, their weights and the row bounds.

    ASCII punctuation separates words. A weight grows with the share of the words that
    have the feature, so long clean texts that hold one by chance differ from toxic ones.
    """
    plain = lowered(raw)
    plain = np.where(_WORD_BYTE[plain], plain, np.uint8(32))
    starts, ends, counts = words(plain, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    prefix = prefix_hash(BYTE_VALUES[plain])
    found = [row * SLOTS + _slot(span_hash(prefix, starts, ends))]
    for n in BEGINNINGS:
        long = ends - starts > n
        head = span_hash(prefix, starts[long], starts[long] + n)
        found.append(row[long] * SLOTS + _slot(mix(head + np.uint64(n))))
    pairs, times = np.unique(np.concatenate(found), return_counts=True)
    size = np.diff(counts)[pairs // SLOTS]
    return pairs % SLOTS, np.log1p(100 * times / size), np.searchsorted(pairs, np.arange(len(offsets)) * SLOTS)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(SLOTS)).astype(np.int64)


@dataclass
class Chain:
    """Linear models in order; model i also reads the probabilities of the models before it."""

    names: list[str]
    weights: np.ndarray  # (models, SLOTS), float32
    links: np.ndarray  # (models, models): weight of each earlier probability
    bias: np.ndarray

    def probabilities(self, slots: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bounds) - 1, len(self.names)))
        for i in range(len(self.names)):
            margin = _row_sums(self.weights[i], slots, values, bounds) + self.bias[i]
            out[:, i] = _sigmoid(margin + out[:, :i] @ self.links[i, :i])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _row_sums(weights: np.ndarray, slots: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(weights[slots] * values, dtype=np.float64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _telling(slots: np.ndarray, row: np.ndarray, y: np.ndarray, least: int, most: int) -> np.ndarray:
    """The ``most`` features in at least ``least`` rows that differ most between the classes, by chi-square."""
    n, positive = len(y), y.sum()
    have = np.bincount(slots, minlength=SLOTS).astype(float)
    hit = np.bincount(slots, y[row], SLOTS)
    expected = have * positive / n
    spread = expected * (1 - positive / n) * np.maximum(1 - have / n, 1 / n)
    score = np.where(have >= least, (hit - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    chosen = np.argsort(-score, kind="stable")[:most]
    return np.sort(chosen[score[chosen] > 4])


def fit_linear(slots, values, bounds, extra, y, rounds: int = 150, rate: float = 0.3, shrink: float = 1e-4, least: int = 5, most: int = 1000):
    """Logistic regression by AdaGrad on all rows at once, classes weighted evenly: word weights, link weights, bias."""
    n = len(bounds) - 1
    weights, v, b = np.zeros(SLOTS, np.float32), np.zeros(extra.shape[1]), 0.0
    if not 0 < y.sum() < n:
        return weights, v, 30.0 if n and y.sum() else -30.0
    row = np.repeat(np.arange(n), np.diff(bounds))
    used = _telling(slots, row, y, least, most)
    at = np.searchsorted(used, slots)
    held = used[np.minimum(at, len(used) - 1)] == slots if len(used) else np.zeros(len(slots), bool)
    row, at, x = row[held], at[held], values[held]
    w = np.zeros(len(used))
    gw, gv, gb = np.full(len(used), 1e-8), np.full(extra.shape[1], 1e-8), 1e-8
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        margin = np.bincount(row, w[at] * x, n) + extra @ v + b
        error = weight * (_sigmoid(margin) - y) / n
        dw = np.bincount(at, error[row] * x, len(used)) + shrink * w
        dv, db = extra.T @ error + shrink * v, error.sum()
        gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
        w, v, b = w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv), b - rate * db / np.sqrt(gb)
    weights[used] = w
    return weights, v, b


def fit_chain(slots, values, bounds, targets: dict[str, np.ndarray], fold: np.ndarray) -> Chain:
    """Train the models in order.

    A later model must not see probabilities that an earlier one gives to its own training
    rows. So each model is trained once per fold on the other folds to get out-of-fold
    probabilities, which feed the later models, and once on all rows for use.
    """
    n, names = len(bounds) - 1, list(targets)
    earlier = np.zeros((n, 0))
    weights, links, bias = [], np.zeros((len(names), len(names))), []
    for i, name in enumerate(names):
        y = targets[name].astype(float)
        held_out = np.zeros(n)
        for k in np.unique(fold):
            inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            w, v, b = fit_linear(*_rows(slots, values, bounds, inside), earlier[inside], y[inside])
            margin = _row_sums(w, *_rows(slots, values, bounds, outside))
            held_out[outside] = _sigmoid(margin + earlier[outside] @ v + b)
        w, v, b = fit_linear(slots, values, bounds, earlier, y)
        weights.append(w)
        links[i, :i] = v
        bias.append(b)
        earlier = np.column_stack((earlier, held_out))
    return Chain(names, np.array(weights), links, np.array(bias))


def _rows(slots, values, bounds, chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(bounds)[chosen]
    new = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(new[-1]) - np.repeat(new[:-1], sizes) + np.repeat(bounds[chosen], sizes)
    return slots[at], values[at], new


def category(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether the text has one of the words."""
    return F.lower(text).rlike(r"(?<![a-z0-9])(" + "|".join(terms) + r")(?![a-z0-9])")


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, categories: dict[str, tuple[str, ...]] | None = None) -> Chain:
    """A chain from labelled documents.

    The only bound on data in this operator: of all labels, the ``sample`` with the
    smallest hash of their id are used. A labelled document has a category if it is toxic
    and holds one of the category's words; the last target is the label itself. Labels
    with nulls or without a document are ignored, null texts have no words.
    """
    categories = CATEGORIES if categories is None else categories
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .select("doc_id", "toxic")
        .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
        .limit(sample)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    text = F.coalesce("text", F.lit(""))
    rows = rows.select(
        "doc_id",
        "text",
        F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int").alias("fold"),
        *[(category(text, terms) & (F.col("toxic") == 1)).cast("int").alias(f"is_{name}") for name, terms in categories.items()],
        (F.col("toxic") == 1).cast("int").alias(f"is_{LAST}"),
    )
    names = [*categories, LAST]
    schema = "doc_id long, fold int, " + ", ".join(f"is_{n} int" for n in names) + ", slots array<int>, values array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in pieces(batch):
                slots, values, bounds = word_slots(raw, offsets)
                parts = pa.array(bounds.astype(np.int32))
                lists = [pa.ListArray.from_arrays(parts, pa.array(x)) for x in (slots.astype(np.int32), values.astype(np.float32))]
                kept = [batch.column(c).slice(first, end - first) for c in ("doc_id", "fold", *(f"is_{n}" for n in names))]
                yield pa.RecordBatch.from_arrays([*kept, *lists], ["doc_id", "fold", *(f"is_{n}" for n in names), "slots", "values"])

    data = rows.mapInArrow(run, schema).toPandas().sort_values("doc_id")
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in data["slots"]], dtype=np.int64)))
    slots = np.concatenate([np.zeros(0, np.int64), *data["slots"]]).astype(np.int64)
    values = np.concatenate([np.zeros(0), *data["values"]])
    return fit_chain(slots, values, bounds, {n: data[f"is_{n}"].to_numpy() for n in names}, data["fold"].to_numpy())


def classify(documents: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, a probability per category in chain order, and ``is_toxic`` by the last one.

    Whole texts are scored. Null and empty texts have no words and get the bias alone, so
    they count as clean. Repeated rows are scored each, other columns are not read, an
    empty table gives no rows.
    """
    schema = "doc_id long, n_features long, " + ", ".join(f"p_{n} double" for n in chain.names)
    shared = documents.sparkSession.sparkContext.broadcast(chain)  # SLOTS weights per category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, end, raw, offsets in pieces(batch):
                slots, values, bounds = word_slots(raw, offsets)
                p = model.probabilities(slots, values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(np.diff(bounds)), *(pa.array(p[:, i]) for i in range(len(model.names)))],
                    ["doc_id", "n_features", *(f"p_{n}" for n in model.names)],
                )

    scored = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
    return scored.withColumn("is_toxic", (F.col("n_features") > 0) & (F.col(f"p_{chain.names[-1]}") >= threshold))


def documents_to_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Query op1: every document with the probabilities of the chain."""
    return classify(documents, train(documents, labels))
