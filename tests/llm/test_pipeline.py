import zlib

import numpy as np

import corpus_pipeline
from cargolens.llm import decontaminate, quality, simhash, token_files

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    """Every stage over the small tables against its own definition, row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.select("doc_id", "text").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontamination", "mixing", "token_files"]

    out = stages["quality"](spark, docs, SF)
    assert out.columns == docs.columns
    model = quality.fit(docs, labels)
    want = {r.doc_id for r in seen if model.score(quality.terms(r.text)[None])[0] >= quality.THRESHOLD}
    kept = sorted((r.doc_id, r.text) for r in out.collect())
    assert {d for d, _ in kept} == want

    out2 = stages["near_dedup"](spark, out, SF)
    assert out2.columns == docs.columns
    left = {r.doc_id for r in out2.collect()}
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) or {0} for d, t in kept}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    ids = [d for d, _ in kept]
    for d in ids:
        before = [e for e in ids if e < d and like(e, d)]
        assert before if d not in left else not [e for e in before if e in left]

    out3 = stages["decontamination"](spark, out2, SF)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = dict(kept)
    brute = decontaminate.brute_force([(d, texts[d]) for d in left], bench)
    clean = {d for d, x in brute.items() if not x[4]}
    assert {r.doc_id for r in out3.collect()} == clean and out3.columns == docs.columns

    out4 = stages["mixing"](spark, out3, SF).cache()
    assert {r.doc_id for r in out4.collect()} == clean and out4.columns == docs.columns

    rows = sorted((r.doc_id, r.text) for r in out4.collect())
    final = sorted(tuple(r) for r in stages["token_files"](spark, out4, SF).collect())
    e, at, want5 = token_files.Encoder(token_files.default_tokenizer()), 0, []
    for d, t in rows:
        data = e.encode([t])[0] + np.array([2], "<u4").tobytes()
        want5.append((d, at, len(data) // 4, zlib.crc32(data)))
        at += len(data) // 4
    assert final == sorted(want5)


def test_run_goes_through_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50
