import corpus_pipeline
from quadrille.llm import decontaminate
from tests.llm import brute


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    bench = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = docs.cache()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf_dir).cache()
        ids, old = [r["doc_id"] for r in after.collect()], {r["doc_id"]: r["text"] for r in before.collect()}
        assert set(ids) <= set(old)
        if k < 4:
            assert after.columns == columns
        if k == 0:
            known = [d for d in labels if d in old]
            assert sum((d in ids) == bool(labels[d]) for d in known) > 0.9 * len(known)
        if k == 1:
            # five words and a similarity of 0.8, by all pairs
            sets = {d: brute.shingles(t, 5) for d, t in old.items()}
            assert sorted(ids) == sorted({min(group) for group in brute.similar_classes(sets, 0.8)})
        if k == 2:
            held = {d for d, t in old.items() if any(i in decontaminate.normal(t) for i in bench)}
            assert not held & set(ids) and set(old) - set(ids) >= held
        if k == 4:
            assert sorted(ids) == sorted(r["doc_id"] for r in before.collect())
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == before.count()
