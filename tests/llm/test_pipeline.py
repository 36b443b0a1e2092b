import re

import corpus_pipeline
from folioscope.llm import op5_toxicity, op6_secrets, op8_mixing

from .test_copies import brute
from .test_models import brute_spans
from .test_tokens import check_packing


def test_stages_on_their_own_inputs(spark, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    kept = stages["toxicity"](spark, docs, small)
    toxic = {r[0] for r in op5_toxicity.severity(docs, op5_toxicity.learn(docs, labels)).where("toxic").select("doc_id").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - toxic
    single = stages["near_dedup"](spark, kept, small)
    want = brute([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80, 100)
    assert {r["doc_id"] for r in single.collect()} == {i for i, v in want.items() if v[2]}
    clean = stages["secrets"](spark, single, small)
    assert clean.count() == single.count() and clean.schema == docs.schema
    assert not any(brute_spans(r["text"]) for r in clean.collect())
    mixed = stages["mixing"](spark, clean, small)
    copies = {r["doc_id"]: r["copies"] for r in op8_mixing.mix(op8_mixing.sized(clean)).collect()}
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in copies.items() if n}
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in clean.collect())
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed.collect()) > 1.3 * words
    once = mixed.dropDuplicates(["doc_id"])
    check_packing(stages["packing"](spark, once, small).collect(), [(r["doc_id"], r["text"]) for r in once.collect()])
    assert stages["packing"](spark, mixed, small).count() >= mixed.count()


def test_near_dedup_keeps_one_of_repeated_rows(spark, odd, small):
    more = [(9, "another text of nine"), (None, "no id here at all"), (None, "no id either"), (None, None), (None, None), *[(20, "said again and again and again")] * 50]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = {tuple(r) for r in docs.where("doc_id is null or doc_id not in (4, 6)").collect()}
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, small).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    whole = dict(corpus_pipeline.STAGES)["near_dedup"](spark, odd, small)
    assert whole.schema == odd.schema and whole.where("doc_id = 9").count() == 1


def test_run_is_its_stages(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert rows.count() > 100 and "sequence_id" in rows.columns


def test_odd_rows_pass_all_stages(spark, odd, small):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert name == "packing" or docs.columns == odd.columns
    empty = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, small)
    assert docs.count() > 0 and empty.collect() == []
    assert op6_secrets.PLACEHOLDER
