"""The pipeline against a stage-by-stage recomputation, and on odd rows."""

import hashlib

import corpus_pipeline
from shelfwatch.llm.toxicity import learn_from, Matcher
from shelfwatch.session import cut_lineage
from tests.llm.test_dedup import expected_components, expected_repeats

SMALL = "/root/testdata/sf0.001"


def test_stages_on_documents(spark, byte_level):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = cut_lineage(stages["toxicity"](spark, docs, SMALL))
    matcher = Matcher(learn_from(spark, SMALL, docs))
    expected = {r.doc_id: r.text for r in docs.collect() if matcher.score(r.text)[0] < 0.7}
    assert {r.doc_id: r.text for r in clean.collect()} == expected and clean.columns == docs.columns

    single = cut_lineage(stages["minhash near-dedup"](spark, clean, SMALL))
    groups = expected_components(expected, 5, 80)
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in groups.items() if d == c}

    cut = cut_lineage(stages["suffix-array dedup"](spark, single, SMALL))
    before = {r.doc_id: r.text for r in single.collect()}
    removed = dict(zip(before, expected_repeats(list(before.values()))))
    after = {r.doc_id: r for r in cut.collect()}
    for doc_id, text in before.items():
        if removed[doc_id][1] == 0:
            assert after[doc_id].text == text
        elif doc_id in after:
            assert len(text.encode()) - len(after[doc_id].text.encode()) in range(removed[doc_id][1] - 6 * removed[doc_id][2], removed[doc_id][1] + 1)
            assert after[doc_id].n_chars == len(after[doc_id].text)

    mixed = cut_lineage(stages["mixing to target weights"](spark, cut, SMALL))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(after)
    encoded = stages["bpe encoding and decoding"](spark, mixed, SMALL).collect()
    assert len(encoded) == mixed.count()
    assert all(r.decoded_sha256 == hashlib.sha256(after[r.doc_id].text.encode()).hexdigest() and r.n_tokens == len(r.ids) for r in encoded)


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs):
    for frame, least in ((odd_docs, 6), (no_docs, 0)):
        docs = frame.withColumnRenamed("size", "digest").withColumnRenamed("score", "n_chars")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:3]:
            docs = cut_lineage(stage(spark, docs, SMALL))
            assert docs.columns == columns, name
        assert docs.count() >= least
        for name, stage in corpus_pipeline.STAGES[3:]:
            docs = cut_lineage(stage(spark, docs, SMALL))


def near_dedup(spark, rows):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n string")
    out = dict(corpus_pipeline.STAGES)["minhash near-dedup"](spark, docs, SMALL)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    assert near_dedup(spark, [(1, a), (5, a), (5, b)]) == [(1, a), (5, b)]
    assert near_dedup(spark, [(1, a), (5, a + " more"), (7, b)]) == [(1, a), (7, b)]
    assert near_dedup(spark, [(5, b), (1, b), (1, a), (1, a), (3, a + " end")] + [(9, "alone")] * 4) == [(1, a), (1, b), (9, "alone")]
    odd = [(2, None), (2, ""), (2, None), (None, a), (None, a), (4, a)]
    assert near_dedup(spark, odd) == sorted([(2, None), (2, ""), (None, a), (None, a), (4, a)], key=str)


def test_last_stages_keep_odd_rows_as_said(spark):
    stages = dict(corpus_pipeline.STAGES)
    rows = [(1, None, "s"), (2, "  ", "s"), (3, "some words", None), (3, "some words", None), (None, "more words", "s"), (None, None, None)]
    docs = spark.createDataFrame([(*r, "en", "clash") for r in rows], "doc_id long, text string, source string, lang string, position string")
    mixed = stages["mixing to target weights"](spark, docs, SMALL).collect()
    assert {(r.doc_id, r.text) for r in mixed} == {(3, "some words"), (None, "more words")} and len(mixed) >= 3
    encoded = stages["bpe encoding and decoding"](spark, docs, SMALL).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in encoded) == [("1", False), ("2", True), ("3", True), ("3", True), ("None", False), ("None", True)]
    assert all(len(r.ids) == r.n_tokens for r in encoded)
