import collections

import corpus_pipeline
from tessera.llm import isolation
from tessera.llm.store import materialize
from tests.llm.test_duplicates import bag, similarity
from tests.llm.test_models import base_spans


def test_stages_take_effect(spark, sf):
    d, table = sf
    docs, seen = table("documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, d), name)
        seen[name] = docs
        if name != "cost_packing":
            assert docs.columns == before.columns
    judged = isolation.judge(table("documents"), table("labels"))
    assert {r.doc_id for r in seen["quality_rules"].collect()} == {r.doc_id for r in judged.where("kept").select("row.doc_id").collect()}
    kept, all_of = ({r.doc_id: r.text for r in seen[n].collect()} for n in ("minhash_near_dedup", "quality_rules"))
    bags = {i: bag(t) for i, t in kept.items()}
    ids = sorted(bags)
    assert not any(similarity(bags[a], bags[b]) >= 0.8 for i, a in enumerate(ids) for b in ids[i + 1 :])
    gone = set(all_of) - set(kept)
    assert gone and all(any(similarity(bag(all_of[g]), bag(all_of[k])) >= 0.8 for k in all_of if k != g) for g in gone)
    clean = {r.doc_id: r for r in seen["secret_scan"].collect()}
    assert set(clean) == set(kept)
    for i, r in clean.items():
        assert not base_spans(r.text) and (r.text == kept[i] if not base_spans(kept[i]) else "[SECRET]" in r.text) and r.n_chars == len(r.text)
    copies = collections.Counter(r.doc_id for r in seen["pareto_mix"].collect())
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    packed = seen["cost_packing"].collect()
    assert {r.doc_id for r in packed} == set(copies) and all(r.length == len(r.tokens) for r in packed)


def test_stages_on_odd_documents(spark, odd, nothing, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert (docs.count() > 0) is (start is odd)


def test_registered_queries(spark, sf):
    import __spark_entry__ as entry

    names = {n.partition("_")[0] for n in entry.queries() if n.startswith("op") and n[2].isdigit()}
    assert names == {f"op{i}" for i in range(1, 11)} and "pipeline" in entry.queries()
    for name, query in entry.queries().items():
        if name.startswith("op") and name[2].isdigit():
            first = "query_id" if name.startswith("op8_") else "doc_id"
            assert query(spark, sf[0]).schema[first].dataType.simpleString() == "bigint"
