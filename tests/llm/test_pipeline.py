"""The pipeline's stages, one after the other, against plain Python."""

import hashlib

import public_tokenizers as P

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    import corpus_pipeline as cp
    from tallframe.llm import bpe, decontam, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    m = decontam.Matcher(bench)
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near_dedup":
            assert set(after.values()) <= set(before.values()) and len(set(after.values())) == len(after)
        if name == "decontamination":
            assert set(after) == {k for k, t in before.items() if not m.find(t)}
        if name == "secrets":
            assert after == {k: secrets.redact_text(t) for k, t in before.items()}
            assert not any(secrets.base_spans(t.replace("[SECRET]", " ")) for t in after.values())
    got = {r.doc_id: r for r in cp.STAGES[-1][1](spark, docs, SF).collect()}
    c = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for k, t in after.items():
        (ids,) = c.encode_bytes([t])
        assert got[k].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_empty_tables(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs = spark.createDataFrame([], docs.schema)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0
