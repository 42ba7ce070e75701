"""Alignment of two tokenizers against a loop over the bytes of each text."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trackmill.llm import alignment, registry

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, block int, links string, n_a string, pairs int, groups int"
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(alignment.BYTE_LEVEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    alphabet = alignment.byte_level_alphabet()

    def tokens(text):
        """Ids and bytes of both sides of a whole text, encoded by the libraries in one call; none if the bytes differ."""
        raw = (" " + text).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(alphabet[c] for c in first.id_to_token(i))) for i in a]
        b = []
        for i in second.encode(text):
            piece = second.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or any(b"".join(x for _, x in side) != raw for side in (a, b)):
            return [], []
        return a, b

    return tokens


def spans(side):
    at, out = 0, []
    for i, raw in side:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def expected(rows, tokens):
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = map(spans, tokens(text or ""))
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]] if len(a) < 3000 else quick(a, b)
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        groups, first = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, e, i in side if first <= s and e <= end) for side in (a, b)) if len(a) < 3000 else None)
            first = end
        counts.update(links)
        found.append((doc_id, len(a), len(b), ends, links, groups))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (doc_id, n_a, n_b, len(ends), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest(groups, n_a))
        for doc_id, n_a, n_b, ends, links, groups in found
    ]


def quick(a, b):
    """The same links for a long text: both lists are in order."""
    out, j = [], 0
    for x in a:
        while b[j][1] <= x[0]:
            j += 1
        k = j
        while k < len(b) and b[k][0] < x[1]:
            out.append((x[2], b[k][2]))
            k += 1
    return out


def digest(groups, n):
    if not n:
        return ""
    return None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()


def key(row):
    return tuple((x is None, x) for x in row)


def check(frame, tokens):
    got = alignment.documents_to_alignment(frame)
    assert tuple(got.columns) == NAMES
    got = sorted(map(tuple, got.collect()), key=key)
    want = sorted(expected([tuple(r) for r in frame.select("doc_id", "text").collect()], tokens), key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(w[7] in (None, g[7]) for g, w in zip(got, want))


@pytest.fixture(scope="module")
def odd(spark):
    words = "the alignment of tokenizers is, in general, 12.5 % harder than it's thought; naïve Übergrößen 漢字 emoji 🙂 don't\n\n\tcode_x = f(y)  # z "
    pick = random.Random(4)
    pieces = [" ", "  ", "\n", " \n", "\n ", "\t", " ", " ", "\x1c", "a", "B.", "é", "🙂", "'s", "12", "_", "\x00", "\x85"]
    mixed = ["".join(pick.choice(pieces) for _ in range(pick.randrange(1, 60))) for _ in range(300)]
    texts = [None, "", " ", "  ", "\n", " x", "x ", "▁", "a ▁b", "x▁ y", "<|endoftext|> and <s> </s> <unk> <0x41>", "Ａ ﬁ", "́e", words, words, words * 40]
    rows = [(i, t, "r", 1, "l", "n", 2, 3) for i, t in enumerate([*texts, *mixed])]
    rows += [rows[13], (None, words, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_sample_table(spark, tokenizers):
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"), tokenizers)


def test_odd_rows(odd, tokenizers):
    check(odd, tokenizers)


def test_text_in_windows_and_blocks(spark, odd):
    """Texts cut into many windows, spread over many blocks, give the same rows; a bad window empties its whole text."""
    rows = odd.select("doc_id", "text").collect()
    rows += [(900, "the cat sat on the mat " * 3000), (901, "good words here " * 500 + "▁ bad"), (902, "x" * 5000 + " tail")]
    frame = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    want = sorted(map(tuple, alignment.documents_to_alignment(frame).collect()), key=key)
    blocks = alignment.aligned(frame, slice_size=300, block_size=500)
    assert blocks.select("block").distinct().count() > 50
    got = alignment.alignments(blocks).select(*NAMES)
    assert sorted(map(tuple, got.collect()), key=key) == want


def test_forgotten_words(monkeypatch):
    """Few remembered words give the same tokens."""
    texts = ["one two three four", "two three five", "six ▁ seven", "one two"]
    words = alignment.lexicon(alignment.BYTE_LEVEL, alignment.PIECES)
    whole = alignment.Aligned(texts, words)
    monkeypatch.setattr(alignment, "KNOWN", 2)
    for n, text in enumerate(texts):
        alone = alignment.Aligned([text], words)
        assert alone.good[0] == whole.good[n] and alone.groups[0] == whole.groups[n]


def test_windows_keep_the_text():
    for text in ("", "a b c d e f g h i j k l m n o p", "x" * 50, "one  two   three four five  six seven", " lead and trail and more  "):
        assert " ".join(alignment.windows(text, 10)) == text


def test_pair_counts_and_groups(spark, tokenizers):
    rows = [(1, "the naïve cat"), (2, "the cat, the cat"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = alignment.aligned(frame, keep_groups=True)
    counts = Counter()
    for _, text in rows[:2]:
        counts.update(quick(*map(spans, tokenizers(text))))
    assert {(r.a, r.b): r.n for r in alignment.pair_counts(blocks).collect()} == counts
    for row in alignment.alignments(blocks).collect():
        assert row.groups_sha256 == (hashlib.sha256(row.groups.encode()).hexdigest() if row.n_a else "")


def test_empty_table_and_text_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.documents_to_alignment(empty).collect() == []
    named = spark.createDataFrame([("a", "the cat")], "doc_id string, text string")
    assert alignment.documents_to_alignment(named).first().doc_id == "a"


def test_every_document_has_a_row(spark):
    found = registry.QUERIES["op13_cross_tokenizer_alignment"](spark, FOLDER)
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert found.count() == documents.count()
    totals = found.agg(F.sum("n_links"), F.sum(F.col("n_a") + F.col("n_b") - F.col("n_groups"))).first()
    assert totals[0] == totals[1]
