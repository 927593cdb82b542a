import corpus_pipeline
from annolake.llm import decontaminate, jaccard, mixing, quality, tokens
from annolake.llm.queries import POWERS, TOKENIZER, quality_labels, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    """Each stage against its operator's own decisions on what the stage before kept."""
    docs = table(spark, SF, "documents").cache()
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF).cache()
        steps[name] = (docs, kept)
        if name != "token_output":
            assert kept.columns == docs.columns
            assert kept.exceptAll(docs).count() == 0
        docs = kept
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = steps["quality_classifier"]
    assert ids(after) == ids(quality.classify(before, quality_labels(spark, SF)).filter("predicted = 1"))
    before, after = steps["near_duplicates"]
    assert ids(after) == ids(jaccard.join(before).filter("doc_id = component_id"))
    before, after = steps["benchmark_decontamination"]
    leaked = {r.doc_id for r in decontaminate.leaks(before, table(spark, SF, "benchmark")).collect()}
    assert leaked and ids(after) == [i for i in ids(before) if i not in leaked]
    before, after = steps["source_mixing"]
    assert ids(after) == ids(mixing.mix(before, POWERS).filter("sampled"))
    before, after = steps["token_output"]
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, tokens.encode_corpus(before, TOKENIZER).collect()))
    assert ids(after) == ids(before)


def test_run_and_names(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "benchmark_decontamination",
                                                      "source_mixing", "token_output"]
    rows = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
