"""License scans against every rule tried on every text, and the SQL in DuckDB."""

import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackmill.llm import licenses, registry

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, words string, places int, n_words string, normal string, hints int, labels int"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    """Words, all places and the places that stay, by every rule and every pair."""
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    normal = f" {'  '.join(words)} " if words else "  "
    places = []
    for rule in licenses.RULES:
        for m in re.finditer(rule.regex, normal):
            start = normal[: m.start()].count(" ") // 2
            places.append((start, start + m[0].count(" ") // 2, rule.priority, rule.order, rule.label))
    kept = [p for p in places if not any(inside(p, q) for q in places)]
    return words, places, kept


def inside(p, q):
    better = q[2] < p[2] or (q[2] == p[2] and (q[1] - q[0] > p[1] - p[0] or (q[:2] == p[:2] and q[3] < p[3])))
    return q[0] <= p[0] and q[1] >= p[1] and better


def expected(doc_id, text):
    words, places, kept = plain(text)
    joined = " ".join(words)
    base = []
    for phrase, label in licenses.BASE:
        size = len(phrase.split())
        base += [(i, label) for i in range(len(words)) if " ".join(words[i : i + size]) == phrase]
    starts, base_labels = [i for i, _ in base], {label for _, label in base}
    labels = base_labels | {p[4] for p in kept}
    score = licenses.WEIGHTS[min(p[2] for p in kept)] if kept else 0.0
    assert joined or not places
    return (
        doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
    )


def key(row):
    return tuple((x is None, x) for x in row)


def check(frame):
    got = licenses.documents_to_licenses(frame)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = [expected(*r) for r in frame.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def odd(spark):
    """Texts made of rules' own words, so that detections nest and overlap; nulls, empty and long texts, repeated rows."""
    pick = random.Random(9)
    bits = [licenses.GRANTS, *(r[2] for r in licenses._rows(licenses.FAMILIES)), *(p for p, _ in licenses.BASE)]
    bits += [r[2] for r in licenses._rows(licenses.LINKS)] + [r[2] for r in licenses._rows(licenses.NOTICES)]
    bits += [f"SPDX-License-Identifier: {r[3]}" for r in licenses._rows(licenses.FAMILIES)] + ["GNU", "license", "2.0", "und", "über"]

    def said(phrase):
        phrase = re.sub(r"\(([^()]*)\)(\??)", lambda m: "" if m[2] and pick.random() < 0.5 else pick.choice(m[1].split("|")), phrase)
        phrase = re.sub(r"[()?|]", " ", phrase).replace(".*", pick.choice(["", "the Foundation", "x " * 12, "x " * 13]))
        return pick.choice([str.upper, str.title, str])(phrase)

    texts = [pick.choice([" ", "-", ", ", "\n"]).join(said(pick.choice(bits)) for _ in range(pick.randrange(1, 25))) for _ in range(150)]
    texts += [None, "", " \n-", "MIT", "mit license", "the MIT-License", "ＭＩＴ license", "É mit licensé", "\x01 mit license \x02", "cc by cc by cc-by-4.0"]
    texts += ["a" * 100_000, "cc by sa 4.0 under gnu general public license v3; " * 300, "word " * 20_000 + "apache license"]
    rows = [(i, t, "w", 1, "n", "x", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "mit license", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_sample_table(spark):
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_odd_rows(odd):
    check(odd)


def test_sql_on_odd_rows(odd):
    documents = pa.Table.from_pylist([r.asDict() for r in odd.select("doc_id", "text").where("length(text) < 5000 or text is null").collect()])
    connection = duckdb.connect()
    connection.register("documents", documents)
    got = connection.execute(licenses.SQL).fetchall()
    want = [expected(r["doc_id"], r["text"]) for r in documents.to_pylist()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_query_equals_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    frame = registry.QUERIES["op11_license_scans"](spark, FOLDER)
    assert sorted(map(tuple, frame.collect())) == sorted(connection.execute(registry.SQL["op11_license_scans"]).fetchall())


def test_detections_of_a_text_with_many(spark):
    """The running maxima over thousands of detections, against all pairs."""
    pick = random.Random(2)
    phrases = ["cc by nc sa 4.0", "cc by sa", "cc by", "mit license", "released under the mit license", "gnu gpl v2", "x"]
    text = " ".join(pick.choice(phrases) for _ in range(1500))
    row = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    _, places, kept = plain(text)

    def spans(found):
        return sorted((d.start, -d.neg_end, d.priority, d.order, d.label) for d in found)

    assert len(row.places) > 1500
    assert spans(row.places) == sorted(places) and spans(row.detections) == sorted(kept)


def test_every_rule_needs_its_keyword_and_can_match():
    assert len(licenses.RULES) > 300
    for rule in licenses.RULES:
        branches = re.sub(r"\(\?:(?:[^()]|\((?:[^()])*\))*\)\?", "", rule.regex)  # without what may lack
        assert f" {rule.keyword} " in branches, rule
        assert "''" not in rule.regex and "'" not in rule.regex


def test_own_rules(spark):
    mine = [licenses.Rule(0, licenses.NAME, "house", "house", licenses.pattern("house (license|terms) (v 2)?"))]
    found = licenses.scanned(spark.createDataFrame([(1, "The House Terms, v.2 and house license")], "doc_id long, text string"), found=mine).first()
    assert [(d.start, -d.neg_end, d.label) for d in found.detections] == [(1, 5, "house"), (6, 8, "house")]


def test_plan_has_no_shuffle_and_no_python(odd):
    plan = licenses.documents_to_licenses(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert licenses.documents_to_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_labels_of_known_lines(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0.": ("apache", "apache,apache-2.0", 0.9),
        "SPDX-License-Identifier: GPL-3.0-or-later": ("", "gpl-3.0", 1.0),
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": ("", "cc-by-nc-sa-4.0", 0.95),
        "Licensed under CC BY-NC 4.0.": ("cc-by", "cc-by,cc-by-nc-4.0", 0.9),
        "He was admitted by the licensing board.": ("", "", 0.0),
    }
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = {r.doc_id: (r.base_labels, r.labels, r.score) for r in licenses.documents_to_licenses(frame).collect()}
    assert [rows[i] for i in range(len(lines))] == list(lines.values())
    assert licenses.documents_to_licenses(frame).where(F.col("n_base") > 0).count() == 2
