"""The operators against plainer versions of themselves, and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.llm import chunks, decontamination, pieces, quality, registry, sharding, similarity, suffixes, toxicity, url_filters, wrappers

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, key string, runs int, n_words int, shard int, source string, lang string, n_chars int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega "
    long = " ".join(f"word{i % 977}x{i % 131}" for i in range(9000))
    texts = [None, "", " \n\t", "one", "one two three", base * 3, base * 3, base * 3 + "end", long, long + " tail", "é" * 500, "a" * 1500, "▁ \x00 漢字\n" * 60]
    rows = [(i, t, "k", 1, 2, 3, "s", None, 0) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def key(row):
    return tuple((x is None, x) for x in row)


def same(frame, rows):
    assert sorted(map(tuple, frame.collect()), key=key) == sorted(rows, key=key)


def shingle_set(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    size = max(1, len(words) - k + 1) if words else 0
    return frozenset(tuple(words[i : i + k]) for i in range(size))


def classes(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    smallest = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[root(i)].append(doc)
    return [(doc, len(sets[i]), min(smallest[root(i)], default=doc)) for i, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_components(odd, empty, k, num, den):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    same(similarity.components(odd, k, num, den), classes(rows, k, num, den))
    assert similarity.components(empty, k, num, den).count() == 0


def test_components_of_the_documents_and_of_a_large_group(spark, documents):
    words = [f"w{i}" for i in range(120)]
    copies = [(10_000 + i, " ".join(words[:i % 110] + ["other" + str(i)] + words[i % 110 + 1 :])) for i in range(90)]
    rows = [(r.doc_id, r.text) for r in documents.limit(120).collect()] + copies
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(similarity.documents_to_components(frame), classes(rows, 4, 85, 100))


@pytest.mark.parametrize("block", [similarity.BLOCK, 8])
def test_chain_in_one_region_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(shared + [f"d{j}" for j in range(4 * i, 4 * i + 60)])) for i in range(40) if i not in (11, 12, 13)]
    found = similarity.documents_to_components(spark.createDataFrame(rows, "doc_id long, text string"))
    same(found, classes(rows, 4, 85, 100))


def cut(rows, length):
    seen = Counter(t.encode()[p : p + length] for t in rows for p in range(len(t.encode()) - length + 1))
    out = []
    for t in rows:
        data, covered = t.encode(), bytearray(len(t.encode()))
        for p in range(len(data) - length + 1):
            if seen[data[p : p + length]] > 1:
                covered[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(data, covered, strict=True) if not y)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_repeated_strings(odd, empty, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    if hot == 1:
        monkeypatch.setattr(suffixes, "SLICE", 3)
        monkeypatch.setattr(suffixes, "PART_WINDOWS", 300)
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    expected = [(i, *x) for (i, _), x in zip(rows, cut([t for _, t in rows], 400), strict=True)]
    same(suffixes.documents_to_cuts(odd), expected)
    assert suffixes.documents_to_cuts(empty).count() == 0


def test_words_made_to_collide_are_told_apart(spark):
    """Thue and Morse's word and its complement have equal polynomial hashes modulo 2^64 in every base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    frame = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = similarity.documents_to_components(frame(one, two, two)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(0, 0), (1, 1), (2, 1)]
    for text in (f"{one}\n{two}", f"{one}\n{one}"):
        row = quality.measure(frame(text)).first()
        assert (row.n_words, row.n_dup_lines) == (2, int(one in text.split("\n")[1]))
    pair = (f"{one} 1", f"{two} 2")
    same(suffixes.documents_to_cuts(frame(*pair)), [(i, *x) for i, x in enumerate(cut(pair, 400))])
    short = "short lines of"
    assert [r.n_removed for r in chunks.documents_to_repeats(frame(one[:64] + short, two[:64] + short)).collect()] == [0, 0]


def statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    symbols = sum(c in quality.SYMBOLS for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def test_quality(spark, odd, empty, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    same(quality.measure(odd.select("doc_id", "text")).select("doc_id", *quality.COUNTS), [(r.doc_id, *statistics(r.text)) for r in odd.collect()])
    trees = quality.train(documents, labels.filter("doc_id % 4 <> 0"))
    held = quality.grade(documents, trees).join(labels.filter("doc_id % 4 = 0"), "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in held]) > 0.9
    assert quality.documents_to_quality(empty, labels).count() == 0
    assert quality.documents_to_quality(odd, labels.limit(0)).count() == odd.count()


def test_trees_are_monotone():
    random = np.random.default_rng(3)
    x = random.random((600, 2))
    trees = quality.fit(x, (x[:, 0] + 0.3 * random.random(600) < 0.6).astype(float), [-1, 0])
    grid = np.column_stack((np.linspace(0, 1, 50), np.full(50, 0.5)))
    assert (np.diff(trees.score(grid)) <= 1e-12).all()


def test_toxicity(spark, odd, empty, documents):
    large = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    chain = toxicity.train(large, labels.filter("doc_id % 4 <> 0"))
    assert chain.names[-1] == "toxic" and chain.links[2, :2].any()
    held = toxicity.classify(large, chain).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    assert np.mean([r.is_toxic == (r.toxic == 1) for r in held]) > 0.9
    assert toxicity.classify(empty, chain).count() == 0
    assert toxicity.classify(odd, chain).count() == odd.count()
    assert toxicity.documents_to_toxicity(odd, labels.limit(0)).filter("is_toxic").count() == 0


def test_url_filters(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y", "https://example.org/en/12#t", "http://example.org/en/2", "http://org", "http://org/", "x://b.com/fr/1", "x://b.com/de/://q", "http://forg/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string")
    database = duckdb.connect()
    database.register("source", pages.toPandas())
    database.execute("CREATE TABLE pages AS SELECT page_id, nullif(url, 'none') AS url FROM source")
    same(url_filters.pages_to_verdicts(pages).select("host", "page_id", "path", "rule", "verdict"), database.sql(f"SELECT host, page_id, path, rule, verdict FROM ({url_filters.SQL})").fetchall())
    assert url_filters.pages_to_verdicts(pages.limit(0)).count() == 0


def test_nested_rules_take_the_stack(spark):
    rules = [("com", "", "a"), ("b.com", "", "b"), ("b.com", "/x", "c"), ("b.com", "/x/y", "d"), ("c.com", "/z", "e"), (None, "/", "f"), ("b.com", "/x", "c")]
    urls = ["s://b.com/w", "s://b.com/x/yy", "s://b.com/xz", "s://a.b.com/x", "s://d.com/", "s://bb.com/x", "s://c.com/z1", "s://c.com/y", "s://net/"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    found = {r.url: r.verdict for r in url_filters.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), default="none").collect()}
    assert [found[u] for u in urls] == ["b", "d", "c", "c", "a", "a", "e", "a", "none"]


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><header><h1>Site</h1></header><nav><a href=/>home</a></nav>
<div class="cookie-notice">We use cookies</div><article class=post><h2>Title &amp; more</h2><p>One <b>bold</b>ly<br>two<p>three &lt;tag&gt; <div class="ad">buy</div>
<form><input></form><ul><li>item one<li>item&nbsp;two</ul><section id="comments"><p>first!</p></section></article><aside>related</aside><footer>end</footer></body></html>"""


def test_pages(spark):
    other = PAGE.replace("<aside>related</aside>", "").replace("One", "Uno")
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", other), (3, None, None), (4, "http://h/4", ""), (5, "x", "<p>only <i>text</i></p>"), (1, "http://h/1", PAGE)]
    found = wrappers.pages_to_texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    text = "Title & more One boldly two three <tag> item one item two"
    same(found, [(i, u, t, len(t)) for (i, u, _), t in zip(rows, [text, text.replace("One", "Uno"), "", "", "only text", text], strict=True)])
    assert wrappers.pages_to_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    one, two = (wrappers.shape(wrappers.parse(p)) for p in (PAGE, other))
    assert "(<aside>#text</>)?" in wrappers.expression(wrappers.merge(one, two))
    assert ")+" in wrappers.expression(one)


def test_sharding(odd, empty, documents):
    for frame, shards in ((odd, 4), (documents, 40)):
        rows = sharding.documents_to_shards(frame, shards).collect()
        assert len(rows) == frame.count() and {r.shard for r in rows} <= set(range(shards))
        for shard in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)
    assert sharding.documents_to_shards(empty).count() == 0


def test_equal_rows_are_spread(spark):
    copies = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    counts = [r["count"] for r in sharding.documents_to_shards(copies, 8).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) < 50


def test_chunks(odd, empty, documents):
    found = {r.doc_id: r for r in chunks.repeated_spans(documents).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    for i, r in found.items():
        assert r.n_bytes == len(texts[i]) and r.n_removed == sum(s.length for s in r.spans)
        others = b"\xff".join(t for j, t in sorted(texts.items()) if j < i)
        for s in r.spans:
            part = texts[i][s.start : s.start + s.length]
            assert s.length >= chunks.LEAST_RUN and all(part[k : k + 16] in others + texts[i][: s.start + k + 15] for k in range(0, s.length - 16, 16))
    assert chunks.repeated_spans(odd).count() == odd.count()
    assert chunks.repeated_spans(empty).count() == 0


def test_shifted_passage_is_found(spark):
    random = np.random.default_rng(5)
    words = lambda n: " ".join("".join(chr(97 + c) for c in random.integers(0, 26, 6)) for _ in range(n))
    passage = words(60)
    rows = [(1, f"{words(40)} {passage} {words(30)}"), (2, f"{words(7)} {passage} {words(50)}"), (3, words(90))]
    found = {r.doc_id: r.n_removed for r in chunks.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == found[3] == 0 and 200 < found[2] <= len(passage) + 2


def test_benchmark(spark, odd, empty, documents):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    runs = defaultdict(set)
    for r in benchmark.collect():
        words = tokens(r.text)
        for i in range(len(words) - 15):
            runs[tuple(words[i : i + 16])].add(r.item_id)
    truth = {(r.doc_id, i) for r in documents.collect() for w in [tokens(r.text)] for k in range(len(w) - 15) for i in runs.get(tuple(w[k : k + 16]), ())}
    found = {(r.doc_id, r.item_id) for r in decontamination.overlaps(documents, benchmark).collect()}
    assert truth and truth <= found
    assert decontamination.overlaps(odd, benchmark).count() == decontamination.overlaps(empty, benchmark).count() == 0
    assert decontamination.overlaps(documents, benchmark.limit(0)).count() == 0


def test_substitutions_and_shuffled_seeds(spark, monkeypatch):
    item = [f"w{i}" for i in range(40)]
    changed = [w if i % 9 != 4 else "other" for i, w in enumerate(item)]
    rows = [(1, "a b c " + " ".join(changed) + " d"), (2, " ".join(f"v{i}" for i in range(60))), (None, " ".join(item))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, "five words make an item"), (None, None)], "item_id long, text string")
    for limit in (decontamination.BROADCAST_BYTES, -1):
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
        found = {(r.doc_id, r.item_id, r.doc_start) for r in decontamination.overlaps(frame, benchmark).collect()}
        assert found == {(1, 7, 3), (None, 7, 0)}
        assert [r.doc_id for r in decontamination.clean(frame, benchmark).collect()] == [2]


def test_pieces(odd, empty, documents):
    vocabulary = pieces.Vocabulary.load()
    encoder = pieces.Encoder(vocabulary)
    for frame, chunk in ((odd, 50), (documents, 700)):
        texts = Counter((r.doc_id, r.text) for r in frame.collect())
        encoded = pieces.encode(frame, vocabulary, chunk)
        assert Counter(map(tuple, pieces.decode(encoded, vocabulary).collect())) == texts
        assert encoded.filter("not round_trip").count() == 0
        for r in encoded.limit(40).join(frame.dropDuplicates(["doc_id"]), "doc_id").select("ids", "text").collect():
            score = lambda ids: sum(vocabulary.scores.get(vocabulary.texts[i].decode("utf-8", "ignore"), pieces.BYTE_SCORE) if i not in vocabulary.byte_ids else pieces.BYTE_SCORE for i in ids)
            assert score(r.ids or []) == score(encoder.encode(" " + r.text).tolist() if r.text else [])
    assert pieces.encode(empty, vocabulary).count() == 0


def test_words_found_together_equal_words_found_alone(monkeypatch):
    vocabulary = pieces.Vocabulary.load()
    random = np.random.default_rng(3)
    signs = np.array(list(" \n\t.,(_²»—”01AaBbeinorst\u00e9\u00ff\u0438\u4e2d\U0001f600"))
    texts = ["", "x" * 63, "x" * 64, "ab " * 40, *("".join(random.choice(signs, n)) for n in random.integers(0, 90, 400))]

    def alone(text):
        _, back = vocabulary.paths(text, {0: 0}, len(text))
        return vocabulary.trace(text, back, 0, len(text))

    encoder = pieces.Encoder(vocabulary)
    for most in (pieces.CACHE, 5):  # the second one forgets its words again and again
        monkeypatch.setattr(pieces, "CACHE", most)
        assert [x.tolist() for part in (texts[:200], texts[200:]) for x in encoder.encode_all(part)] == [alone(t) for t in texts]
    ids, sizes = vocabulary.segment(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [alone(t) for t in texts]
    # Fewer lookups by Python: signs behind a word make no other word of it.
    assert encoder.units(" word, word. (word)") == [" word", ",", " word", ".", " (", "word", ")"]


def test_transfer_is_associative():
    random = np.random.default_rng(1)
    a, b, c = (random.integers(-50, 0, (5, 5)) for _ in range(3))
    assert (pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))).all()


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline(spark, documents):
    import corpus_pipeline

    docs = documents
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == documents.columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == kept


def test_anchors_are_found_once(odd, monkeypatch):
    plans, stored = [], suffixes.stored

    def watched(rows, purpose):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return stored(rows, purpose)

    monkeypatch.setattr(suffixes, "stored", watched)
    suffixes.repeated_spans(odd, 40, 8)
    assert sum("MapInArrow" in p for p in plans) == 1
