"""Operator 9: repeated byte strings of documents by range-partitioned suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BYTE_VALUES, pieces, prefix_hash, small_batches, span_hash, stored

#: Length of the strings, and of the leading gram by which suffixes are chosen and dealt.
LENGTH = 400
GRAM = 96
#: A shorter length, of which fifty words of running text have more, and the gram for it.
PASSAGE, PASSAGE_GRAM = 200, 64
#: A bucket gets suffixes of about so many bytes; a gram with more suffixes than HOT is resolved by counting digests instead.
BUCKET_BYTES = 3 << 20
HOT = 5_000
#: Suffixes with hot grams that are compared in a slice, and digests that a task compares of all slices.
SLICE = 1_000
PART_WINDOWS = 500_000
CUT_COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
_RECORD = np.dtype([("key", "V16"), ("start", "<i4"), ("known", "<i4"), ("a", "<i8"), ("b", "<i8")])
_WINDOW = np.dtype([("key", "V16"), ("start", "<i4")])
_RUN = np.dtype([("key", "V16"), ("start", "<i4"), ("end", "<i4")])
_SECOND = BYTE_VALUES[::-1].copy()
_PLACE_BITS = np.uint64(28)


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, place, gram hash and first and last window start of each anchor; places count from the row's begin.

    The anchor of a window of ``length`` bytes is the gram in it with the smallest hash,
    the leftmost of equal ones. It depends on the window's bytes alone, so equal windows
    have equal anchors at equal distances.
    """
    n, wide = len(raw), length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n)
    if not (at + length <= ends).any():
        return none
    hashes = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    inside = np.flatnonzero(at + gram <= ends)
    hashes[inside] = span_hash(prefix_hash(BYTE_VALUES[raw]), inside, inside + gram)
    keys = (hashes >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
    padded = np.full(-(-(n + wide) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, wide)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.flatnonzero(at + length <= ends)
    chosen = (np.minimum(backward[windows], forward[windows + wide - 1]) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    last = np.concatenate((new[1:], [len(chosen)])) - 1
    place = chosen[new]
    row = np.searchsorted(offsets, place, side="right") - 1
    begin = offsets[row]
    return row, place - begin, hashes[place].view(np.int64), windows[new] - begin, windows[last] - begin


def _leading(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first eight bytes of suffixes as a number in their order."""
    eight = raw[places[:, None] + np.arange(8)] if len(places) else np.zeros((0, 8), np.uint8)
    return (eight.astype(np.uint8).copy().view(">u8").ravel() ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in pieces(batch):
                row, place, hashes, low, high = anchors(raw, offsets, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(first, end - first).take(pa.array(row)),
                        pa.array(hashes),
                        pa.array(_leading(raw, offsets[row] + place)),
                        *(pa.array(x.astype(np.int32)) for x in (place, low, high)),
                    ],
                    ["key", "gram", "lead", "place", "low", "high"],
                )

    return texts.select("key", "text").mapInArrow(run, "key binary, gram long, lead long, place int, low int, high int")


def repeated_spans(
    documents: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = ("doc_id",), passage: int | None = None
) -> DataFrame:
    """``keep``, text, starts and ends of the maximal removed runs of every row, in UTF-8 bytes.

    A byte is removed if a string of ``length`` bytes covers it that starts anywhere else
    as well. A suffix can begin such a string only if its anchor gram occurs elsewhere, so
    only suffixes with a repeated anchor are dealt, each for all windows of its anchor: range
    partitioned by their leading bytes with splitters taken from all repeated grams, sorted in the
    bucket by gram, then by what follows (as digests), and compared with their neighbours. Equal
    strings have equal grams and never meet a bucket's boundary. Grams with more than HOT suffixes
    are kept out of the buckets: their strings are compared by 128-bit digests, first within a slice of
    the suffixes at hand, then one of each digest and slice with those of other slices. Both ways give the same answer.

    With ``passage``, a shorter length that is above ``gram``, there is a column ``passages`` as well: the
    runs under strings of that length. Anchors are those of the shorter strings then: equal strings of ``length`` bytes begin
    with equal shorter ones, so they have equal anchors too, and the same suffixes, cut longer, serve both.

    Equal texts are handled once; texts found twice are removed whole from ``length`` bytes on. Null
    and empty texts have no runs. Repeated rows, null ids and any other columns are allowed; an empty table gives no rows.
    """
    lengths = (length,) if passage is None else (passage, length)
    least = lengths[0]
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Never null, which Spark can't tell from unhex: a filter on it would make the shuffle of the texts differ between the joins.
    name = F.coalesce(F.substring(F.unhex(F.sha2(data, 256)), 1, 16), F.lit(b""))
    rows = documents.select(*keep, data.alias("text"), name.alias("key"))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    whole = copies.filter("copies > 1").select("key", F.lit(True).alias("whole"))
    # Two steps read the anchors; hashing all bytes for each would cost more than keeping their rows.
    with small_batches(documents.sparkSession):
        found = stored(_anchor_rows(rows.filter(F.octet_length("text") >= least), least, gram), "anchors")
    where = F.struct("key", "place")
    grams = found.groupBy("gram").agg(F.min(where).alias("a"), F.max(where).alias("b"), F.min("lead").alias("lead"), F.count(F.lit(1)).alias("n"))
    grams = stored(grams.filter("a <> b").select("gram", "lead", (F.col("n") > HOT).alias("hot"), "n"), "grams")
    facts = grams.agg(F.sum(F.when(~F.col("hot"), F.col("n"))).alias("n"), F.sum(F.when(F.col("hot"), F.col("n"))).alias("hot")).first()
    buckets = max(1, -(-(facts["n"] or 0) * (length + (least - gram) // 2) // BUCKET_BYTES))
    shares = [i / buckets for i in range(1, buckets)]
    splitters = (grams.filter("not hot").agg(F.percentile_approx("lead", shares, 100 * buckets).alias("s")).first()["s"] or []) if shares else []
    marks = found.join(grams.select("gram", "hot"), "gram").groupBy("key").agg(
        F.collect_set(F.struct("gram", "hot", "lead", "place", "low", "high")).alias("anchors")
    )
    marks = stored(marks, "marks")
    joined = rows.join(marks, "key")

    def anchored(hot: bool) -> DataFrame:
        """Texts that have anchors with hot grams, or others; only such texts leave the join.

        All columns stay until then, so that Spark uses the shuffle of the texts again in the last join.
        """
        return joined.select(*rows.columns, "anchors").filter(F.exists("anchors", lambda a: a["hot"] == F.lit(hot)))

    cutter = _cutter(lengths, splitters, True)
    cold = anchored(False).mapInArrow(_cutter(lengths, splitters, False), "key binary, bucket int, gram long, lead long, start int, windows int, content binary")
    cold = cold.groupBy("bucket").applyInPandas(_resolver(lengths), "key binary, length int, start int, end int")
    parts = max(1, -(-(facts["hot"] or 0) * ((least - gram) // 2) // PART_WINDOWS))
    digester = _digester(lengths, parts, SLICE)
    # One step cuts and digests: a second one behind it would give every task another Python worker and carry the suffixes through it.
    # What a slice repeats by itself goes the same way as its digests: read twice, the rows could be sliced in two ways, and
    # windows that each way leaves to the other would be lost.
    digests = anchored(True).mapInArrow(lambda batches: digester(_gathered(cutter(batches), SLICE)), "part int, runs binary, records binary")
    met = digests.groupBy("part").applyInPandas(_matcher(parts, len(lengths)), "owner int, runs binary, windows binary")
    hot = met.groupBy("owner").applyInPandas(_gatherer(lengths), "key binary, length int, start int, end int")
    columns = {length: "runs"} if passage is None else {length: "runs", passage: "passages"}
    found_runs = cold.unionByName(hot).groupBy("key").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("length") == n, F.struct("start", "end")))).alias(c) for n, c in columns.items()]
    )
    marked = rows.join(found_runs.join(whole, "key", "full"), "key", "left")
    size = F.octet_length("text")
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), size.alias("end")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    copied = F.coalesce("whole", F.lit(False))
    chosen = [F.when(copied & (size >= n), all_of_it).otherwise(F.coalesce(c, empty)).alias(c) for n, c in columns.items()]
    return marked.select(*keep, "text", *chosen)


def _cutter(lengths: tuple[int, ...], splitters: list[int], hot: bool):
    """The suffixes of hot anchors, or of the others.

    A string of the longest length repeats only if all shorter ones in it do. So a content goes beyond the shortest length
    only for windows that are followed by as many windows of repeated anchors as such a string has.
    """
    bounds = np.array(splitters, np.int64)
    least, longest = lengths[0], lengths[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for at in range(batch.num_rows):
                name = batch.column("key")[at].as_py()
                if name == last:  # copies stand together behind the join; those that don't are told by their place later
                    continue
                last = name
                text = batch.column("text")[at].as_py().encode()
                own = sorted(batch.column("anchors")[at].as_py(), key=lambda a: -a["low"])
                before = reach = -1
                contents = []
                for a in own:  # from the text's end
                    reach = reach if a["high"] + 1 == before else a["high"]
                    before = a["low"]
                    far = min(a["high"], reach - (longest - least))
                    end = far + longest if far >= a["low"] else 0
                    contents.append(text[a["low"] : max(a["high"] + least, end)])
                chosen = [(a, c) for a, c in zip(own, contents, strict=True) if a["hot"] == hot]
                lead = np.array([a["lead"] for a, _ in chosen], np.int64)
                bucket = np.full(len(chosen), -1) if hot else np.searchsorted(bounds, lead, side="right")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(chosen), pa.binary()),
                        pa.array(bucket.astype(np.int32)),
                        pa.array([a["gram"] for a, _ in chosen], pa.int64()),
                        pa.array(lead),
                        pa.array([a["low"] for a, _ in chosen], pa.int32()),
                        pa.array([a["high"] - a["low"] + 1 for a, _ in chosen], pa.int32()),
                        pa.array([c for _, c in chosen], pa.binary()),
                    ],
                    ["key", "bucket", "gram", "lead", "start", "windows", "content"],
                )

    return run


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``size`` rows, the last one excepted."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def _windows(contents: pd.Series, windows: pd.Series, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window its begin in the joined contents, its content's number and its place there. At a text's end a content has fewer."""
    sizes = contents.str.len().to_numpy().astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    counts = np.clip(sizes - length + 1, 0, windows.to_numpy())
    owner = np.repeat(np.arange(len(contents)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return begins[owner] + inside, owner, inside


def _joined(at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of neighbouring windows of one content."""
    if not len(at):
        return at, at
    breaks = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(owner[at]) != 0)))
    return at[breaks], at[np.concatenate((np.flatnonzero(breaks)[1:], [len(at)])) - 1]


def _resolver(lengths: tuple[int, ...]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["key", "start"]).sort_values(["lead", "gram"], ignore_index=True)
        parts = {n: ([], [], []) for n in lengths}
        for at in range(0, len(group), 400):
            some = group.iloc[at : at + 400]
            prefix = prefix_hash(BYTE_VALUES[np.frombuffer(b"".join(some["content"]), np.uint8)])
            for length, (digests, owners, places) in parts.items():
                begins, owner, inside = _windows(some["content"], some["windows"], length)
                digests.append(span_hash(prefix, begins, begins + length))
                owners.append((owner + at).astype(np.int32))
                places.append(inside.astype(np.int32))
        found = []
        for length, arrays in parts.items():
            digest, owner, inside = (np.concatenate(x) for x in arrays)
            gram = group["gram"].to_numpy()[owner]
            order = np.lexsort((digest, gram))
            same = (digest[order][1:] == digest[order][:-1]) & (gram[order][1:] == gram[order][:-1])
            twice = np.zeros(len(order), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            first, last = _joined(np.flatnonzero(twice), owner)
            start = group["start"].to_numpy()[owner[first]]
            runs = {"key": group["key"].to_numpy()[owner[first]], "length": length, "start": start + inside[first], "end": start + inside[last] + length}
            found.append(pd.DataFrame(runs))
        return pd.concat(found)

    return run


def _packed(rows: np.ndarray, part: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The parts that rows have, and the bytes of the rows of each."""
    rows = rows[np.argsort(part, kind="stable")]
    here, counts = np.unique(part, return_counts=True)
    ends = np.cumsum(counts)
    return here.tolist(), [rows[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]


def _owners(keys: np.ndarray, owners: int) -> np.ndarray:
    return (keys.copy().view("<u8")[::2] % np.uint64(owners)).astype(np.int64)


def _digester(lengths: tuple[int, ...], parts: int, size: int):
    """Runs of what a slice repeats by itself, packed by their texts, and one record of each digest in it, packed by part.

    Each length has its own parts: those whose remainder by the number of lengths is its place among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                group = batch.slice(at, size).to_pandas().drop_duplicates(["key", "start"]).sort_values(["key", "start"], ignore_index=True)
                keys = np.frombuffer(b"".join(group["key"]), "V16")
                raw = np.frombuffer(b"".join(group["content"]), np.uint8)
                prefixes = [prefix_hash(v[raw]) for v in (BYTE_VALUES, _SECOND)]
                for number, length in enumerate(lengths):
                    begins, owner, inside = _windows(group["content"], group["windows"], length)
                    a, b = (span_hash(p, begins, begins + length).view(np.int64) for p in prefixes)
                    order = np.lexsort((b, a))
                    new = np.ones(len(order), bool)
                    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
                    one = order[new]
                    count = np.diff(np.concatenate((np.flatnonzero(new), [len(order)])))
                    twice = np.zeros(len(order), bool)
                    twice[order] = np.repeat(count > 1, count)
                    start = group["start"].to_numpy()[owner] + inside
                    # Windows of neighbouring anchors of one text make one run.
                    text = group["key"].ne(group["key"].shift()).cumsum().to_numpy()[owner]
                    stretch = np.cumsum(np.diff(text, prepend=0).astype(bool) | (np.diff(start, prepend=start[:1]) != 1))
                    first, last = _joined(np.flatnonzero(twice), stretch)
                    runs = np.empty(len(first), _RUN)
                    runs["key"], runs["start"], runs["end"] = keys[owner[first]], start[first], start[last] + length
                    records = np.empty(len(one), _RECORD)
                    records["key"], records["start"], records["known"] = keys[owner[one]], start[one], count > 1
                    records["a"], records["b"] = a[one], b[one]
                    near, near_runs = _packed(runs, _owners(runs["key"], parts) * len(lengths) + number)
                    here, packed = _packed(records, a[one] % parts * len(lengths) + number)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(near + here, pa.int32()),
                            pa.array(near_runs + [None] * len(here), pa.binary()),
                            pa.array([None] * len(near) + packed, pa.binary()),
                        ],
                        ["part", "runs", "records"],
                    )

    return run


def _matcher(owners: int, lengths: int):
    """Windows whose digest other slices have as well, packed by their texts. Windows that their own slice repeats are in its runs, which pass."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        records = np.frombuffer(b"".join(group["records"].dropna()), _RECORD)
        place = np.stack([records["key"].copy().view("<i8").reshape(-1, 2)[:, i] for i in (0, 1)] + [records["start"].astype(np.int64)])
        order = np.lexsort((*place, records["b"], records["a"]))
        records, place = records[order], place[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (records["a"][1:] != records["a"][:-1]) | (records["b"][1:] != records["b"][:-1])
        begins = np.flatnonzero(new)
        counts = np.diff(np.concatenate((begins, [len(order)])))
        ends = begins + counts - 1
        known = np.maximum.reduceat(records["known"], begins) if len(begins) else begins
        elsewhere = (place[:, begins] != place[:, ends]).any(axis=0) | (known > 0)
        found = records[np.repeat(elsewhere, counts) & (records["known"] == 0)]
        windows = np.empty(len(found), _WINDOW)
        windows["key"], windows["start"] = found["key"], found["start"]
        part = int(group["part"].iloc[0])
        here, packed = _packed(windows, _owners(found["key"], owners) * lengths + part % lengths)
        runs = group["runs"].dropna().tolist()  # dealt by their texts already
        return pd.DataFrame(
            {"owner": [part] * len(runs) + here, "runs": runs + [None] * len(here), "windows": [None] * len(runs) + packed},
            columns=["owner", "runs", "windows"],
        )

    return run


def _gatherer(lengths: tuple[int, ...]):
    """The runs that the windows of each text make, of all parts, and those that came as such."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        length = lengths[int(group["owner"].iloc[0]) % len(lengths)]
        near = np.frombuffer(b"".join(group["runs"].dropna()), _RUN)
        windows = np.frombuffer(b"".join(group["windows"].dropna()), _WINDOW)
        name = windows["key"].copy().view("<u8").reshape(-1, 2)
        order = np.lexsort((windows["start"], name[:, 1], name[:, 0]))
        windows, name = windows[order], name[order]
        start = windows["start"].astype(np.int64)
        breaks = np.ones(len(start), bool)
        breaks[1:] = (name[1:] != name[:-1]).any(axis=1) | (start[1:] > start[:-1] + 1)
        first = np.flatnonzero(breaks)
        last = np.concatenate((first[1:], [len(start)]))[: len(first)] - 1
        keys = [k.tobytes() for k in (*near["key"], *windows["key"][first])]
        starts, ends = np.concatenate((near["start"], start[first])), np.concatenate((near["end"], start[last] + length))
        return pd.DataFrame({"key": keys, "length": length, "start": starts, "end": ends})

    return run


def _merged(runs: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of such that are sorted by start."""
    out: list[tuple[int, int]] = []
    for r in runs:
        if out and r["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["end"]))
        else:
            out.append((r["start"], r["end"]))
    return out


def cut_texts(
    documents: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = ("doc_id",), passage: int | None = None
) -> DataFrame:
    """``keep``, text (what remains, incomplete characters at cuts dropped), n_bytes, n_removed, n_spans, kept_sha256.

    With ``passage``, a shorter length, also n_removed_<passage>: the bytes that strings of that length would remove.
    """
    spans = repeated_spans(documents, length, gram, keep, passage)
    numbers = ["n_bytes", "n_removed", "n_spans", *([] if passage is None else [f"n_removed_{passage}"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out: dict[str, list] = {n: [] for n in ("text", *numbers, "kept_sha256")}
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data = text.encode()
                kept, last, merged = [], 0, _merged(runs)
                for start, end in merged:
                    kept.append(data[last:start])
                    last = end
                rest = b"".join([*kept, data[last:]])
                out["text"].append(rest.decode("utf-8", "ignore"))
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(rest))
                out["n_spans"].append(len(merged))
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            if passage is not None:
                out[numbers[-1]] = [sum(end - start for start, end in _merged(runs)) for runs in batch.column("passages").to_pylist()]
            kinds = {"text": pa.string(), "kept_sha256": pa.string()}
            arrays = [pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], [*keep, *out])

    added = [("text", T.StringType()), *((n, T.LongType()) for n in numbers), ("kept_sha256", T.StringType())]
    schema = T.StructType([*(spans.schema[c] for c in keep), *(T.StructField(n, kind) for n, kind in added)])
    return spans.mapInArrow(run, schema)


def documents_to_cuts(documents: DataFrame) -> DataFrame:
    """The columns that the contract of query op9 fixes."""
    return cut_texts(documents).select(*CUT_COLUMNS)


def documents_to_cuts_and_passages(documents: DataFrame) -> DataFrame:
    """Query op9: the contract's columns, and n_removed_200, as strings of 400 bytes don't see repeated passages of fifty words."""
    cuts = cut_texts(documents, gram=PASSAGE_GRAM, passage=PASSAGE)
    return cuts.select(*CUT_COLUMNS, f"n_removed_{PASSAGE}")
