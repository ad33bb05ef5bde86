"""Each stage of the pipeline on small tables, against plain versions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_ops import DOCS, frame, near_copies, prose, toxic_docs


@pytest.fixture
def tables(spark, tmp_path):
    """documents and labels of a small corpus."""
    toxic = toxic_docs(200)
    rows = [(i, t) for i, t, _ in toxic] + [(None if d is None else 1000 + d, t) for d, t in near_copies(2)]
    docs = frame(spark, rows).withColumn("lang", F.expr("element_at(array('de','en','es','fr'), cast(pmod(coalesce(doc_id, 0), 4) as int) + 1)"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in toxic] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), {i for i, _, x in toxic if x}


def test_toxic_documents_go_and_clean_ones_stay(spark, tables):
    path, docs, toxic = tables
    kept = corpus_pipeline.reject_toxic(spark, docs, path)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.select("doc_id").exceptAll(kept.select("doc_id")).collect()}
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 2


def test_one_of_each_class_stays(spark, tables):
    path, docs, _ = tables
    kept = corpus_pipeline.one_of_near_duplicates(spark, docs, path)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {c for _, n, c in brute.jaccard(rows) if n} | {d for d, n, _ in brute.jaccard(rows) if not n}
    assert {r.doc_id for r in kept.collect()} == want
    # a row for each class of texts with words, though classes may share a doc_id, and for each row without words
    sets = [brute.shingles(t) for _, t in rows]
    classes = {c for c, s in zip(brute.classes_of(sets), sets, strict=True) if s}
    assert kept.count() == len(classes) + sum(not s for s in sets)


def test_classes_that_share_a_doc_id_keep_a_row_each(spark):
    texts = [" ".join(prose(i, 40, 5000)) for i in range(8)]
    near = texts[0].rsplit(" ", 1)[0] + " other"
    rows = [(3, texts[0]), (5, near), (5, texts[1]), (5, texts[2]), (0, texts[3]), (0, texts[7]), *[(None, t) for t in texts[3:7]], (None, texts[4]), (None, None), (None, "")]
    docs = frame(spark, rows).repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_near_duplicates(spark, docs, "").collect()]
    want = [(3, texts[0]), (5, texts[1]), (5, texts[2]), (0, texts[3]), (0, texts[7]), *[(None, t) for t in texts[4:7]], (None, None), (None, "")]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_passages_are_cut_and_no_document_goes(spark, tables):
    path, docs, _ = tables
    cut = corpus_pipeline.cut_passages(spark, docs, path)
    assert cut.columns == docs.columns and dict(cut.dtypes) == dict(docs.dtypes) and cut.count() == docs.count()
    want = brute.substring_dedup([(r.doc_id, r.text) for r in docs.collect()])
    lengths = sorted(n - k for n, k, _ in (want[r.doc_id, r.text or ""] for r in docs.collect()))
    assert sorted(len(brute.space_words(r.text)) for r in cut.collect()) == lengths


def test_mixing_keeps_every_document(spark, tables):
    path, docs, _ = tables
    mixed = corpus_pipeline.mix_languages(spark, docs, path)
    assert mixed.columns == docs.columns
    assert docs.select("doc_id").distinct().exceptAll(mixed.select("doc_id").distinct()).count() == 0
    assert mixed.count() >= docs.count()


def test_columns_of_any_name_come_through(spark, tables):
    path, docs, _ = tables
    names = ["_copies", "_rank", "_words", "_id", "_digest", "_own_digest", "_copy", "row", "rank", "copies", "digest", "score", "score_", "n_words", "n_removed", "kept_sha256", "id", "without", "of_text", "n_tokens", "ids", "ids_", "rate", "own_id", "a.b"]
    odd = docs.where("doc_id < 24 or doc_id > 1040").coalesce(2).select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, path)
        if name == "tokens":
            assert len({c.lower() for c in out.columns}) == len(out.columns) and out.count() == odd.count()
            continue
        assert out.columns == odd.columns
        for r in out.collect():
            assert [r[c] for c in names] == [f"{c}:{-1 if r.doc_id is None else r.doc_id}" for c in names]


def test_the_whole_run(spark, tables):
    path, docs, _ = tables
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "ids", "n_tokens", "ids_sha256"} <= set(out.columns)
    assert out.where("size(ids) <> n_tokens").count() == 0 and out.count() > 100
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "tokens"]


def test_a_run_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
