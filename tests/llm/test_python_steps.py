"""No Python step reads straight from another: each would hold a worker of its own in every task."""

import gc
import re

import pyarrow as pa

from trackmill.llm import pieces, quality, similarity, suffixes
from trackmill.llm.shared import BATCH_ROWS

CHAIN = re.compile(r"MapInArrow[^\n]*\n(?:[ :+-]*(?:Project|Filter)[^\n]*\n)*[ :+-]*MapInArrow")


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def rows(spark):
    texts = [" ".join(f"word{i % (40 + d)}" for i in range(200)) for d in range(4)] + ["", None]
    return spark.createDataFrame([(d, t, d % 2) for d, t in enumerate(texts)], "doc_id long, text string, quality int")


def test_quality_measures_and_scores_in_one_step(spark):
    documents = rows(spark)
    trees = quality.train(documents, documents.select("doc_id", "quality"))
    graded = quality.grade(documents, trees, carry=("doc_id", "text"))
    assert plan(graded).count("MapInArrow") == 1
    scores = {r.doc_id: r.score for r in graded.collect()}
    measured = quality.measure(documents).toPandas()
    x = quality.features({c: measured[c].to_numpy() for c in (*quality.COUNTS, *quality.MORE)})
    assert scores == dict(zip(measured["doc_id"], trees.score(x)))


def test_hot_suffixes_are_cut_and_digested_in_one_step(spark):
    found = suffixes.repeated_spans(rows(spark), 40, 8)
    assert "MapInArrow" in plan(found)
    assert not CHAIN.search(plan(found))


def test_texts_are_handed_over_in_small_batches_and_the_setting_is_restored(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    for module in (similarity, suffixes):

        def watched(frame, purpose, stored=module.stored):
            if "MapInArrow" in plan(frame):
                seen.append((purpose, int(spark.conf.get(name))))
            return stored(frame, purpose)

        monkeypatch.setattr(module, "stored", watched)
    similarity.documents_to_components(rows(spark))
    suffixes.repeated_spans(rows(spark), 40, 8)
    assert {p for p, _ in seen} == {"jaccard", "anchors"}
    assert max(n for _, n in seen) <= BATCH_ROWS
    assert spark.conf.get(name) == before


def test_tokens_are_found_without_a_step_behind_a_step(spark):
    encoded = pieces.encode(rows(spark), pieces.Vocabulary.load(), 50)
    assert "MapInArrow" in plan(encoded)
    assert not CHAIN.search(plan(encoded))


def test_no_words_are_remembered_behind_a_task(spark):
    pieces.encode(rows(spark).repartition(4), pieces.Vocabulary.load(), 50).collect()

    def held(batches):
        found = sum(type(x).__name__ == "Encoder" for x in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([found] * batch.num_rows, pa.int64())], ["n"])

    assert {r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}
