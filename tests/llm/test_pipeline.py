import os
from urllib.parse import urlparse

import corpus_pipeline

from epochal.llm.common import scratch, written
from epochal.llm.quality import quality

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, SF), "test")
        assert after.columns == docs.columns and 0 < after.count() <= seen
        docs, seen = after, after.count()
    rows = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_clashing_columns_null_ids_repeats_and_empty_tables(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    docs = spark.createDataFrame([(r.doc_id, r.text, i, "mine", None) for i, r in enumerate(rows)] + [(None, rows[0].text, 60, "mine", 2.5), (rows[1].doc_id, rows[1].text, 61, "mine", None)], "doc_id long, text string, n_words long, kept string, p_good double")
    for kept in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = written(stage(spark, kept, SF), "test")
            assert kept.columns == docs.columns
            assert {r.kept for r in kept.collect()} <= {"mine"}
        given = {r.n_words: (r.doc_id, r.p_good) for r in docs.collect()}
        assert all(given[r.n_words] == (r.doc_id, r.p_good) for r in kept.collect())


def test_stages_do_what_brute_force_says(spark):
    """Each stage on its own input: what goes, what stays and how texts change."""
    import test_decontaminate
    import test_neardup
    import test_packing
    import test_pii
    import test_quality

    from epochal.llm.quality import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        found = written(stages[name](spark, docs, SF), "test")
        return found, {r.doc_id: r.text for r in found.collect()}

    verdict = {r.doc_id: r for r in quality(docs, carry=["doc_id"]).collect()}
    docs, good = after("quality", docs)
    for i, text in texts.items():
        n, _, _, _, repeated = test_quality.brute(text)
        assert verdict[i].base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert (i in good) == verdict[i].kept == (not verdict[i].base_failed and verdict[i].p_good >= 0.5)
    assert all(texts[i] == t for i, t in good.items())

    docs, single = after("near-dedup", docs)
    assert set(single) == {i for i, (_, _, kept) in test_neardup.brute(sorted(good.items())).items() if kept}
    assert all(good[i] == t for i, t in single.items())

    docs, clean = after("decontamination", docs)
    for i, text in single.items():
        n, hit, _, _, _ = test_decontaminate.brute(text, items)
        assert i in clean or hit > 0
        assert not hit or i not in clean or test_decontaminate.brute(clean[i], items)[1] == 0
        assert hit or clean[i] == text
        assert hit <= n / 2 or i not in clean

    docs, hidden = after("pii", docs)
    assert set(hidden) == set(clean)
    for i, text in clean.items():
        assert not test_pii.brute(hidden[i])
        assert test_pii.brute(text) or hidden[i] == text or "<secret>" in hidden[i] or "<number>" in hidden[i]

    rows = stages["packing"](spark, docs, SF).collect()
    test_packing.check(hidden, rows)


def test_near_duplicates_leave_without_a_shuffle_of_texts(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text), (2, "another text of its own"), (None, text), (3, text), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (corpus_pipeline.MOST_DROPPED, 0):
        monkeypatch.setattr(corpus_pipeline, "MOST_DROPPED", most)
        found = corpus_pipeline.keep_one_of_each(spark, docs, SF)
        assert ("hashpartitioning" in found._jdf.queryExecution().executedPlan().toString()) == (most == 0)
        assert sorted((r.doc_id or 0, r.text or "") for r in found.collect()) == sorted((i or 0, t or "") for i, t in rows if i != 3)


def test_a_run_leaves_the_last_stage_alone(spark):
    base = os.path.dirname(urlparse(scratch(spark, "any")).path)
    tables = lambda: {f for f in (os.listdir(base) if os.path.exists(base) else ()) if f.startswith("pipeline-")}
    before = tables()
    assert corpus_pipeline.run(spark, SF).count() > 0
    (left,) = tables() - before
    assert left.startswith("pipeline-pii-")


def test_quality_leaves_no_copy_of_all_documents(spark):
    base = os.path.dirname(urlparse(scratch(spark, "any")).path)
    tables = lambda: set(os.listdir(base)) if os.path.exists(base) else set()
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), tables()
    found = corpus_pipeline.keep_good(spark, docs, SF)
    stored = quality(docs).where("kept")
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in stored.collect())
    assert len(tables() - before) == 1  # what ``stored`` alone wrote
