"""Operator 10: SentencePiece encoding and decoding by a max-plus scan over chunks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of a chunk; longer texts are cut and their chunks spread over tasks.
CHUNK = 16_384
#: Scores are whole numbers, so sums do not depend on the order of addition.
SCALE = 1 << 20
#: Score of a byte piece, below every other piece.
BYTE_SCORE = -20 * SCALE
#: Words that a task remembers, about 200 bytes each, and code points up to which words are looked up together.
CACHE, WORD = 100_000, 64
#: Words that are looked up at once, and about how many code points of cut texts.
WORDS, TOGETHER = 10_000, 1 << 20
NEVER = -(1 << 60)
SPACE = "▁"
#: Letters and digits, and the other signs but blanks and line breaks.
_LETTER, _SIGN = r"[^\W_²³¹]", r"(?:[^\w \n]|[_²³¹])"


class Vocabulary:
    """Pieces as they stand in texts (a blank for the mark of word beginnings), their ids and scores.

    The file ranks its pieces; the score of rank r is -log(r + 2), what word frequencies by
    rank suggest, so the best path prefers few and frequent pieces.
    """

    def __init__(self, pieces: dict[str, int], byte_ids: list[int]):
        self.byte_ids = byte_ids
        self.ids = pieces
        order = sorted(pieces, key=pieces.get)
        self.scores = {p: -round(SCALE * math.log(r + 2)) for r, p in enumerate(order)}
        self.texts = {i: p.encode() for p, i in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        #: Nested by characters; the empty key holds the score of the piece that ends there.
        self.trie: dict = {}
        for piece, score in self.scores.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        last = max(self.texts, default=-1) + 1
        parts = [self.texts.get(i, b"") for i in range(last)]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.longest = max(map(len, pieces), default=1)
        #: No piece spans a blank after another character, or a line break: paths meet there.
        self.meets = not any(re.search(r"[^ ] |\n", p) for p in pieces)
        #: Nor a letter or digit next to another sign: they meet there as well.
        self.parts = self.meets and not any(re.search(f"{_LETTER}{_SIGN}|{_SIGN}{_LETTER}", p) for p in pieces)
        self._number_trie()

    def _number_trie(self) -> None:
        """The trie as sorted numbers of its edges (node times letters plus letter), with the node and the piece each leads to."""
        self.letters = np.array(sorted({ord(c) for p in self.ids for c in p}), np.uint32)
        number = {chr(c): i for i, c in enumerate(self.letters)}
        edges, nodes = [], [(self.trie, "")]
        for at, (node, text) in enumerate(nodes):
            for c, below in node.items():
                if c:
                    edges.append((at * len(number) + number[c], len(nodes), self.ids.get(text + c, -1)))
                    nodes.append((below, text + c))
        self.edges, self.child, self.piece = np.array(sorted(edges), np.int64).reshape(-1, 3).T.astype(np.int32 if len(nodes) * len(number) < 1 << 31 else np.int64)
        self.score_of = np.full(max(self.ids.values(), default=-1) + 1, NEVER, np.int64)
        for piece, score in self.scores.items():
            self.score_of[self.ids[piece]] = score

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = {}, [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.setdefault(piece.replace(SPACE, " "), i)
        return cls(pieces, byte_ids)

    def paths(self, text: str, entry: dict[int, int], last: int) -> tuple[list[int], list[int]]:
        """Best score to reach each place from the entry places and the piece begin it came from; pieces begin before ``last``."""
        n, root = len(text), self.trie
        best, back = [NEVER] * (n + 1), [-1] * (n + 1)
        for at, score in entry.items():
            best[at] = score
        for at in range(min(last, n)):
            here = best[at]
            if here == NEVER:
                continue
            node = root
            for end in range(at, n):
                node = node.get(text[end])
                if node is None:
                    break
                if "" in node:
                    score = here + node[""]
                    if score > best[end + 1]:
                        best[end + 1], back[end + 1] = score, at
            if "" not in root.get(text[at], ()):
                score = here + BYTE_SCORE * len(text[at].encode())
                if score > best[at + 1]:
                    best[at + 1], back[at + 1] = score, at
        return best, back

    def segment(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best paths through the texts, as ``paths`` and ``trace`` find them, and how many each has; a place of all texts at a time."""
        slow = {i: t for i, t in enumerate(texts) if len(t) > WORD}
        texts = ["" if i in slow else t for i, t in enumerate(texts)]
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), sizes)
        letter = np.searchsorted(self.letters, points).astype(self.edges.dtype)
        known = letter < len(self.letters)
        known[known] = self.letters[letter[known]] == points[known]
        at, node, width = np.arange(len(points)), np.zeros(len(points), self.edges.dtype), self.edges.dtype.type(len(self.letters))
        left = np.repeat(begins + sizes, sizes) - at
        alone = np.zeros(len(points), bool)  # code points that are a piece
        found = []
        for size in range(1, self.longest + 1):
            open_ = left[at] >= size
            at, node = at[open_], node[open_]
            open_ = known[at + size - 1]
            at, node = at[open_], node[open_]
            edge = node * width + letter[at + size - 1]
            place = np.minimum(np.searchsorted(self.edges, edge), max(len(self.edges) - 1, 0))
            there = self.edges[place] == edge if len(self.edges) else np.zeros(len(edge), bool)
            at, place = at[there], place[there]
            node, piece = self.child[place], self.piece[place]
            ends = piece >= 0
            found.append((at[ends], np.full(ends.sum(), size), piece[ends]))
            if size == 1:
                alone[at[ends]] = True
        start, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        # A text has a place more than code points. Pieces that begin earlier come first, so the longest of equally good ones stays.
        begin, inside = start + owner[start], start - begins[owner[start]]
        inside = inside.astype(np.uint8 if WORD < 256 else np.int64)
        order = np.argsort(inside, kind="stable")
        begin, size, piece = begin[order], size[order], piece[order]
        bounds = np.searchsorted(inside[order], np.arange(sizes.max(initial=0) + 1))
        best = np.full(len(points) + len(texts), NEVER, np.int64)
        best[begins + np.arange(len(texts))] = 0
        back = np.zeros(len(best), np.int64)
        gain, end = self.score_of[piece], begin + size
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            score = best[begin[low:high]] + gain[low:high]
            better = np.flatnonzero(score > best[end[low:high]])
            best[end[low + better]] = score[better]
            back[end[low + better]] = low + better
        rare = np.zeros(len(texts), bool)  # with code points that become bytes
        rare[owner[~alone]] = True
        row = np.flatnonzero(~rare & (sizes > 0))
        place, rows, ids = (begins + sizes + np.arange(len(texts)))[row], [row[:0]], [row[:0]]
        while len(row):
            rows.append(row)
            ids.append(piece[back[place]])
            place = begin[back[place]]
            on = place > begins[row] + row
            row, place = row[on], place[on]
        slow |= {i: texts[i] for i in np.flatnonzero(rare).tolist()}
        for i, text in slow.items():
            _, back = self.paths(text, {0: 0}, len(text))
            found = self.trace(text, back, 0, len(text))
            rows.insert(1, np.full(len(found), i))
            ids.insert(1, np.array(found, np.int64))
        rows, ids = np.concatenate(rows[::-1]), np.concatenate(ids[::-1])
        order = np.argsort(rows.astype(np.uint16) if len(texts) < 1 << 16 else rows, kind="stable")
        return ids[order].astype(np.int32), np.bincount(rows, minlength=len(texts))

    def trace(self, text: str, back: list[int], start: int, end: int) -> list[int]:
        out: list[int] = []
        while end > start:
            at = back[end]
            piece = self.ids.get(text[at:end])
            if piece is None:
                out.extend(self.byte_ids[b] for b in reversed(text[at:end].encode()))
            else:
                out.append(piece)
            end = at
        return out[::-1]

    def decode(self, ids) -> bytes:
        """The bytes of the pieces; ids outside the vocabulary have none."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        sizes = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.flat[np.arange(sizes.sum()) + np.repeat(shift, sizes)].tobytes()


_UNIT = re.compile(r" *[^ \n]+| +|\n")
_PART = re.compile(rf" *{_LETTER}+| *{_SIGN}+| +|\n")


class _Numbers(dict):
    """Words by number, in the order in which they were first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes stretches between meeting places, each word once while it is remembered. A task has its own: what outlives it weighs on other stages."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.seen = _Numbers()
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def units(self, text: str) -> list[str]:
        if not self.vocabulary.meets:
            return [text] * bool(text)
        return (_PART if self.vocabulary.parts else _UNIT).findall(text)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > CACHE:
            self._forget()
        numbers, stops = [], []
        for text in texts:
            numbers.extend(map(self.seen.__getitem__, self.units(text)))
            stops.append(len(numbers))
        self._learn()
        numbers = np.array(numbers, np.int64)
        begins = self.ends[numbers]
        sizes = self.ends[numbers + 1] - begins
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.ids[np.arange(ends[-1]) + np.repeat(begins - ends[:-1], sizes)]
        return np.split(flat, ends[stops[:-1]]) if texts else []

    def _learn(self) -> None:
        """The ids of new words, behind those of the others."""
        new, self.seen.new = self.seen.new, []
        parts = [self.ids], [self.ends]
        for at in range(0, len(new), WORDS):
            ids, sizes = self.vocabulary.segment(new[at : at + WORDS])
            parts[0].append(ids)
            parts[1].append(parts[1][-1][-1] + np.cumsum(sizes))
        self.ids, self.ends = (np.concatenate(x) for x in parts)

    def _cuts(self, text: str, first: int, last: int) -> tuple[int, int]:
        """The first and last meeting place in a range, or -1."""
        if not self.vocabulary.meets:
            return -1, -1
        places = (range(max(first, 1), min(last, len(text) - 1) + 1), range(min(last, len(text) - 1), max(first, 1) - 1, -1))
        return tuple(next((at for at in order if _meets(text, at)), -1) for order in places)

    def transfer(self, text: str, size: int) -> np.ndarray:
        """Best scores from entering ``i`` code points late to leaving ``j`` code points late.

        ``text`` has up to longest - 1 code points behind the chunk of ``size`` for pieces
        that reach over its end. All paths run through the first and the last meeting place;
        what lies between adds the same to every entry, changes no choice and is left out.
        """
        m = self.vocabulary.longest
        out = np.full((m, m), NEVER, np.int64)
        first, last = self._cuts(text, m, size)
        leave = lambda best: np.array([best[size + j] if size + j < len(best) else NEVER for j in range(m)])
        if first >= 0:
            tail = leave([NEVER] * last + self.vocabulary.paths(text[last:], {0: 0}, size - last)[0])
        for i in range(m):
            if i >= size:  # entering behind the chunk
                out[i, i - size] = 0
            elif first >= 0:
                head = self.vocabulary.paths(text[i:first], {0: 0}, first - i)[0][-1]
                out[i] = np.where(tail > NEVER, head + tail, NEVER)
            else:
                out[i] = leave(self.vocabulary.paths(text, {i: 0}, size)[0])
        return out

    def between(self, text: str, size: int, enter: int, leave: int) -> tuple[np.ndarray, str, np.ndarray]:
        """Ids of the best path through a chunk with known states at both ends: behind the first ones come those of the text in the middle."""
        none = np.zeros(0, np.int32)
        if enter >= size:
            return none, "", none
        first, last = self._cuts(text, max(enter, 1), size)
        end = size + leave
        if first < 0:
            _, back = self.vocabulary.paths(text, {enter: 0}, size)
            return np.array(self.vocabulary.trace(text, back, enter, end), np.int32), "", none
        head, tail = text[enter:first], text[last:]
        _, back = self.vocabulary.paths(head, {0: 0}, len(head))
        before = np.array(self.vocabulary.trace(head, back, 0, len(head)), np.int32)
        _, back = self.vocabulary.paths(tail, {0: 0}, size - last)
        return before, text[first:last], np.array(self.vocabulary.trace(tail, back, 0, end - last), np.int32)


def _meets(text: str, at: int) -> bool:
    return text[at - 1] == "\n" or text[at] == "\n" or (text[at] == " " and text[at - 1] != " ")


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    sums = a[:, :, None] + b[None, :, :]
    return np.maximum(sums.max(axis=1), NEVER)


def states(matrices: list[np.ndarray]) -> list[int]:
    """State before each chunk and behind the last one (0), on a best path from state 0."""
    before = [np.full((1, len(matrices[0])), NEVER, np.int64)]
    before[0][0, 0] = 0
    for m in matrices:
        before.append(combine(before[-1], m))
    found = [0]
    for reach, m in zip(before[-2::-1], matrices[::-1], strict=True):
        found.append(int(np.argmax(reach[0] + m[:, found[-1]])))
    return found[::-1]


def encode(documents: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids and round_trip of every document.

    A blank is put before each text that is not empty, as the vocabulary's own library
    does; an empty text has no ids. The ids are those of the path with the largest sum of
    piece scores; characters without a piece become byte pieces. ``round_trip`` tells
    whether decoding the ids gives the text. Null texts have zero characters and null ids. Repeated
    rows are encoded each, other columns are not read.

    Texts above ``chunk`` code points are cut, equal ones once. Each chunk yields a matrix of
    best scores between boundary states (how far the last piece reaches over the
    boundary). The matrices of a text, about 2 kB each, are combined in order, which fixes a state at
    every boundary; then every chunk is traced back by itself, in any task.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)  # fixed size: the vocabulary

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in _slices(batch):
                texts = part.column(1).to_pylist()
                spaced = [" " + text if text else "" for text in texts]
                ids = [None if t is None else x for t, x in zip(texts, encoder.encode_all(spaced), strict=True)]
                n_chars = [len(text or "") for text in texts]
                right = [None if x is None else _same(encoder.vocabulary, x, t) for x, t in zip(ids, spaced, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_chars, pa.int64()), _lists(ids), pa.array(right, pa.bool_())],
                    ["doc_id", "n_chars", "ids", "round_trip"],
                )

    read = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    long = F.coalesce(F.char_length("text"), F.lit(0)) >= chunk
    short = read.filter(~long).mapInArrow(plain, f"doc_id {kind}, n_chars long, ids array<int>, round_trip boolean")
    giant = read.filter(long).withColumn("digest", F.sha2("text", 256))
    distinct = giant.dropDuplicates(["digest"]).select("digest", "text")
    cut = _cutter(chunk, vocabulary.longest)
    pieces = distinct.mapInArrow(cut, "digest string, chunk int, size int, text string")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in cut(batches):
            found = [encoder.transfer(t, n).tobytes() for t, n in zip(batch.column("text").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("chunk"), pa.array(found, pa.binary())], ["digest", "chunk", "matrix"])

    # One step cuts and measures: a second one behind it would give every task another Python worker.
    matrices = distinct.mapInArrow(measure, "digest string, chunk int, matrix binary")

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        side = math.isqrt(len(group["matrix"].iloc[0]) // 8)
        found = states([np.frombuffer(m, np.int64).reshape(side, side) for m in group["matrix"]])
        return pd.DataFrame({"digest": group["digest"], "chunk": group["chunk"], "enter": found[:-1], "leave": found[1:]})

    bounds = matrices.groupBy("digest").applyInPandas(scan, "digest string, chunk int, enter int, leave int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in (part for b in batches for part in _slices(b, max(1, TOGETHER // chunk))):
            given = [*zip(*(batch.column(c).to_pylist() for c in ("text", "size", "enter", "leave")), strict=True)]
            heads, middles, tails = zip(*(encoder.between(*x) for x in given), strict=True)
            ids = [np.concatenate(x) for x in zip(heads, encoder.encode_all(middles), tails, strict=True)]
            right = [_same(encoder.vocabulary, x, text[enter : size + leave]) for x, (text, size, enter, leave) in zip(ids, given, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("chunk"), _lists(ids), pa.array(right, pa.bool_())],
                ["digest", "chunk", "ids", "round_trip"],
            )

    traced = pieces.join(bounds, ["digest", "chunk"]).mapInArrow(trace, "digest string, chunk int, ids array<int>, round_trip boolean")
    whole = traced.groupBy("digest").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"),
        F.min("round_trip").alias("round_trip"),
    )
    named = giant.select("doc_id", "digest", F.char_length("text").cast("long").alias("n_chars"))
    joined = named.join(whole, "digest").select("doc_id", "n_chars", "ids", "round_trip")
    return short.unionByName(joined).select(
        "doc_id", "n_chars", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip"
    )


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text from doc_id and ids. Null ids give null, ids outside the vocabulary give nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else shared.value.decode(ids)[1:] for ids in batch.column(1).to_pylist()]
            decoded = [None if t is None else t.decode("utf-8", "replace") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def _same(vocabulary: Vocabulary, ids: np.ndarray, text: str) -> bool:
    return vocabulary.decode(ids) == text.encode()


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _lists(ids: list) -> pa.ListArray:
    sizes = [0 if x is None else len(x) for x in ids]
    bounds = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    values = pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)]).astype(np.int32))
    missing = pa.array([x is None for x in ids], pa.bool_())
    return pa.ListArray.from_arrays(bounds, values, mask=missing)


def _cutter(chunk: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = " " + text
                starts = range(0, len(text), chunk)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([digest] * len(starts)),
                        pa.array(range(len(starts)), pa.int32()),
                        pa.array([min(chunk, len(text) - s) for s in starts], pa.int32()),
                        pa.array([text[s : s + chunk + longest - 1] for s in starts]),
                    ],
                    ["digest", "chunk", "size", "text"],
                )

    return run


def documents_to_pieces(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """Query op10: every document encoded, decoded and compared."""
    return encode(documents, Vocabulary.load(model))
