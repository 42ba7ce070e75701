"""Operator 13: alignment of two tokenizers by Arrow tables, pair counts merged by Spark.

A text is a blank and the text itself; the tokens of either tokenizer cut its bytes. Each end
of a token is a key (document, end). The full outer join of both sides' keys has one row for
every pair of tokens that overlap, a *link*: a text's bytes between two neighbouring keys belong
to one token of each side, and no two such stretches to the same two. Keys of both sides cut the
text into *groups*. All of this is Arrow: lists of tokens are flattened with their parents'
indices, lengths become ends by cumulative sums that start anew in every document, Acero joins
the keys, ``Table.group_by`` counts the pairs of a block of texts.

Spark merges the counts of all blocks, and every block asks for the counts of its own pairs:
a pair is asked for once per block however often it occurs, so no pair is a hot key. Blocks
have a bounded number of links; a text with more spans several. A null or empty text, or one that
a tokenizer does not give back byte by byte, has no tokens. Rows with equal ids are documents of
their own, null ids too; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points that are tokenized and joined at a time.
SLICE = 1 << 20
#: Links of a block.
BLOCK = 1 << 22
#: Remembered words of a worker, and words tokenized by one call.
KNOWN, TOGETHER = 400_000, 2_000
#: Both tokenizers begin a new token at a blank between other characters, whatever stands around it.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")


def byte_level_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """How a tokenizer encodes a blank and a text, and the bytes of each id."""

    def __init__(self, parts: dict[int, bytes], encode):
        self.encode = encode
        self.parts = pa.array([parts.get(i, b"") for i in range(max(parts, default=-1) + 1)], pa.binary())
        self.sizes = pc.cast(pc.binary_length(self.parts), pa.int64())
        self.names = pa.array([str(i) for i in range(len(self.parts))], pa.string())


def byte_level(path: str) -> Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    alphabet = byte_level_alphabet()
    parts = {}
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        parts[i] = bytes(alphabet[c] for c in token)
    return Side(parts, lambda text: tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids)


def sentence_pieces(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    parts = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            parts[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i)):
            parts[i] = piece.replace("▁", " ").encode()
    return Side(parts, lambda text: model.encode(text, num_threads=1))


class Lexicon:
    """Token ids of both sides for words, remembered across slices up to KNOWN words."""

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.lists = [pa.array([], pa.list_(pa.int32())) for _ in self.sides]
        self.good = np.zeros(0, bool)
        self.fresh: list[list[pa.ListArray]] = []
        self.fresh_good: list[np.ndarray] = []

    def lookup(self, words: list[str]) -> np.ndarray:
        """Places of the words; ``lists`` and ``good`` hold them."""
        if len(self.index) > KNOWN:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        # Words that a CUT may follow and precede first: together they are a text, so one call tokenizes many.
        new.sort(key=lambda w: not w or w[0].isspace() or w[-1] == " ")
        plain = sum(bool(w) and not w[0].isspace() and w[-1] != " " for w in new)
        for first in [*range(0, plain, TOGETHER), *range(plain, len(new))]:
            end = min(first + TOGETHER, plain) if first < plain else first + 1
            if not self._learn(new[first:end]):
                for word in new[first:end]:
                    self._learn([word])
        if new:
            self.lists = [pa.concat_arrays(x) for x in zip(self.lists, *self.fresh)]
            self.good = np.concatenate([self.good, *self.fresh_good])
            self.fresh, self.fresh_good = [], []
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


    def _learn(self, words: list[str]) -> bool:
        """Tokens of words encoded as one text; false if they do not give its bytes back, then the words must be learned alone."""
        raw = [b" " + w.encode() for w in words]
        whole, ends = b"".join(raw), np.cumsum([len(w) for w in raw])
        lists, good = [], True
        for side in self.sides:
            ids = pa.array(np.array(side.encode(" ".join(words)), np.int32))
            parts = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), side.parts.take(ids))
            at = np.concatenate(([0], np.cumsum(np.asarray(side.sizes.take(ids)))))
            offsets = np.searchsorted(at, ends)
            good &= pc.binary_join(parts, b"")[0].as_py() == whole and np.array_equal(at[np.minimum(offsets, len(ids))], ends)
            offsets = offsets if good else np.full(len(words), len(ids))
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], offsets)), pa.int32()), ids))
        if not good and len(words) > 1:
            return False
        self.fresh.append(lists)
        self.fresh_good.append(np.full(len(words), good))
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        return True


@cache
def lexicon(a_path: str, b_path: str) -> Lexicon:
    return Lexicon(byte_level(a_path), sentence_pieces(b_path))


def windows(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in stretches of about ``size`` code points that end at a CUT, without the blank there."""
    first = 0
    while len(text) - first > size:
        found = CUT.search(text, first + size)
        if found is None:
            break
        yield text[first : found.start()]
        first = found.end()
    yield text[first:] if first else text


class Aligned:
    """What is found in some texts: per text good, n_a, n_b, n_groups, n_links; links (a and b) and groups in order of the texts."""

    def __init__(self, texts: list[str], words: Lexicon):
        parts = [CUT.split(t) for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = words.lookup([w for p in parts for w in p])
        document = np.repeat(np.arange(len(texts)), counts)
        self.good = np.bincount(document, ~words.good[at], len(texts)) == 0
        at, document = at[self.good[document]], document[self.good[document]]
        sides = [self._ends(pa.array(at), document, words.lists[n], side) for n, side in enumerate(words.sides)]
        left, right = (t.rename_columns(["document", "end", name]) for t, name in zip(sides, "ab"))
        joined = left.join(right, ["document", "end"], join_type="full outer", use_threads=False)
        joined = joined.take(pc.sort_indices(joined, [("document", "ascending"), ("end", "ascending")])).combine_chunks()
        a, b = joined.column("a").combine_chunks(), joined.column("b").combine_chunks()
        both = np.asarray(pc.and_(a.is_valid(), b.is_valid()))
        self.a = np.asarray(pc.fill_null_backward(a))
        self.b = np.asarray(pc.fill_null_backward(b))
        owner = np.asarray(joined.column("document"))
        self.n_a, self.n_b = (np.bincount(np.asarray(t.column("document")), minlength=len(texts)) for t in sides)
        self.n_links = np.bincount(owner, minlength=len(texts))
        self.n_groups = np.bincount(owner[both], minlength=len(texts))
        # Tokens of a side up to each common end: those keys of the join that the side has.
        bounds = [np.cumsum(np.asarray(x.is_valid()))[both] for x in (a, b)]
        self.groups = self._names([t.column(2) for t in sides], bounds, words)

    @staticmethod
    def _ends(at: pa.Array, document: np.ndarray, lists: pa.ListArray, side: Side) -> pa.Table:
        """document, end and id of every token: ends count from the beginning of the document."""
        tokens = lists.take(at)
        ids = pc.list_flatten(tokens)
        owner = pc.take(pa.array(document), pc.list_parent_indices(tokens))
        ends = np.asarray(pc.cumulative_sum(side.sizes.take(ids)))
        owners = np.asarray(owner)
        first = np.flatnonzero(np.diff(owners, prepend=-1))
        before = np.concatenate(([0], ends))[first]
        begun = np.repeat(before, np.diff(np.append(first, len(owners))))
        return pa.table({"document": owner, "end": pa.array(ends - begun), "id": ids})

    def _names(self, ids: list, bounds: list[np.ndarray], words: Lexicon) -> pa.Array:
        """`a1,a2|b1` for each group, joined by semicolons for each text."""
        texts, comma, semicolon, bar = [], *(pa.scalar(c, pa.large_string()) for c in ",;|")
        for column, ends, side in zip(ids, bounds, words.sides):
            offsets = pa.array(np.concatenate(([0], ends)), pa.int64())
            names = pa.LargeListArray.from_arrays(offsets, side.names.take(column.combine_chunks()).cast(pa.large_string()))
            texts.append(pc.binary_join(names, comma))
        groups = pc.binary_join_element_wise(*texts, bar)
        offsets = pa.array(np.concatenate(([0], np.cumsum(self.n_groups))), pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, groups), semicolon)


class _Document:
    """A row while its windows are aligned."""

    def __init__(self, doc_id, keep: bool):
        self.doc_id = doc_id
        self.good, self.begun = True, False
        self.counts = np.zeros(4, np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.digest = hashlib.sha256()
        self.groups: list[str] | None = [] if keep else None

    def add(self, found: Aligned, n: int, links: tuple[np.ndarray, np.ndarray]) -> None:
        if not found.good[n]:
            self.good = False
        if not self.good:
            self.links = []
            return
        self.counts += (found.n_a[n], found.n_b[n], found.n_groups[n], found.n_links[n])
        self.links.append(links)
        text = found.groups[n].as_py()
        if self.begun:
            self.digest.update(b";")
        self.digest.update(text.encode())
        if self.groups is not None:
            self.groups.append(text)
        self.begun = True


class _Blocks:
    """Rows gathered to blocks of at least ``least`` links."""

    def __init__(self, schema: pa.Schema, partition: int, least: int):
        self.schema, self.partition, self.least = schema, partition, least
        self.number = self.rows = self.size = 0
        self.waiting: list[tuple] = []

    def take(self, found: _Document) -> Iterator[pa.RecordBatch]:
        row = self._id(self.rows)
        self.rows += 1
        if found.good and found.begun:
            groups = ";".join(found.groups) if found.groups is not None else None
            facts = (row, found.doc_id, *found.counts.tolist(), found.digest.hexdigest(), groups)
        else:
            found.links = []
            facts = (row, found.doc_id, 0, 0, 0, 0, "", None if found.groups is None else "")
        for links in found.links or [(np.zeros(0, np.int32), np.zeros(0, np.int32))]:
            self.waiting.append((facts, *links))
            facts = (*facts[:-1], None)
            self.size += len(links[0]) + 16
            if self.size >= self.least:
                yield from self.flush()

    def _id(self, n: int) -> int:
        return (self.partition << 33) + n

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.waiting:
            return
        a, b = (np.concatenate([w[n] for w in self.waiting]).astype(np.int64) for n in (1, 2))
        pairs = pa.array(a << 32 | b).dictionary_encode()
        counted = pa.table({"pair": pairs.indices}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
        codes = np.asarray(pairs.dictionary)
        fields = [pa.array(codes >> 32, pa.int32()), pa.array(codes & 0xFFFFFFFF, pa.int32()), counted.column("count_all").combine_chunks()]
        asked = pa.StructArray.from_arrays(fields, ["a", "b", "n"])
        bounds = np.cumsum([0] + [len(w[1]) for w in self.waiting])
        links = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs.indices.cast(pa.int32()))
        block = self._id(self.number)
        facts = list(zip(*(w[0] for w in self.waiting)))
        names = [f.name for f in self.schema]
        columns = [pa.array([block] * len(links), pa.int64())]
        columns += [pa.array(list(v), self.schema.field(name).type) for name, v in zip(names[1:], facts)]
        columns += [links, pa.nulls(len(links), self.schema.field("pairs").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        if len(codes):
            alone = [pa.nulls(1, f.type) for f in self.schema]
            alone[0] = pa.array([block], pa.int64())
            alone[-1] = pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), asked)
            yield pa.RecordBatch.from_arrays(alone, schema=self.schema)
        self.number, self.size, self.waiting = self.number + 1, 0, []


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _schema(doc_id: T.DataType) -> T.StructType:
    long, pair = T.LongType(), T.StructType().add("a", "integer").add("b", "integer").add("n", "long")
    out = T.StructType().add("block", long).add("row", long).add("doc_id", doc_id)
    for name in _COUNTS:
        out = out.add(name, long)
    out = out.add("groups_sha256", "string").add("groups", "string")
    return out.add("links", T.ArrayType(T.IntegerType())).add("pairs", T.ArrayType(pair))


def aligned(
    documents: DataFrame,
    a_path: str = BYTE_LEVEL,
    b_path: str = PIECES,
    keep_groups: bool = False,
    slice_size: int = SLICE,
    block_size: int = BLOCK,
) -> DataFrame:
    """Blocks of aligned documents, written once: rows of documents and one row a block with its distinct pairs.

    Document rows: block, row (one value a document), doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, groups (`a1,a2|b1;a3|b2,b3`, null unless kept), links (places in the block's
    pairs). A document with many links has several rows. Pair rows: block, pairs (a, b, n).
    ``slice_size``: code points tokenized and joined at a time; ``block_size``: links of a block.
    The vocabulary files must be readable at their paths on every executor.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _schema(documents.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon(a_path, b_path)
        blocks = _Blocks(to_arrow_schema(schema), TaskContext.get().partitionId(), block_size)
        open_: list[tuple[_Document, str, bool]] = []

        def settle() -> Iterator[pa.RecordBatch]:
            found = Aligned([text for _, text, _ in open_], words)
            bounds = np.cumsum(np.concatenate(([0], found.n_links)))
            for n, (document, _, last) in enumerate(open_):
                span = slice(bounds[n], bounds[n + 1])
                document.add(found, n, (found.a[span], found.b[span]))
                if last:
                    yield from blocks.take(document)
            open_.clear()

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                document, text = _Document(doc_id, keep_groups), text.as_py()
                if not text:
                    yield from blocks.take(document)
                    continue
                rest = windows(text, slice_size)
                window = next(rest)
                while window is not None:
                    later = next(rest, None)
                    open_.append((document, window, later is None))
                    size += len(window)
                    window = later
                    if size >= slice_size:
                        yield from settle()
                        size = 0
        if open_:
            yield from settle()
        yield from blocks.flush()

    return stored(documents.select("doc_id", "text").mapInArrow(run, schema), "aligned")


def _questions(blocks: DataFrame) -> DataFrame:
    return blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair")).select("block", "place", "pair.*")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n (links of the pair in all documents), is_best (no other a has more links with this b)."""
    counts = _questions(blocks).groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("is_best"))


def alignments(blocks: DataFrame) -> DataFrame:
    """One row per document of ``aligned``: doc_id, counts, n_best, count_sum, groups_sha256, groups."""
    answers = _questions(blocks).drop("n").join(pair_counts(blocks), ["a", "b"]).select(F.col("block").alias("asked_by"), "place", "n", "is_best")
    rows = blocks.where("pairs is null").drop("pairs")
    facts = ["row", "doc_id", *_COUNTS, "groups_sha256", "groups"]
    schema = T.StructType([rows.schema[c] for c in facts]).add("n_best", "long").add("count_sum", "long")

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        links = rows.column("links").combine_chunks()
        place, bounds = np.asarray(pc.list_flatten(links)), np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(links)))))
        known = np.zeros((2, len(answers)), np.int64)
        known[:, np.asarray(answers.column("place"))] = np.asarray(answers.column("is_best")), np.asarray(answers.column("n"))
        sums = [np.diff(np.concatenate(([0], np.cumsum(values[place])))[bounds]) for values in known]
        out = rows.select(facts)
        return out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    scored = rows.groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(score, schema)
    keys = [c for c in facts if c != "groups"]
    total = scored.groupBy(*keys).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups").alias("groups"))
    return total.drop("row")


def documents_to_alignment(documents: DataFrame, a_path: str = BYTE_LEVEL, b_path: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    found = alignments(aligned(documents, a_path, b_path))
    return found.select("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")
