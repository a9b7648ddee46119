import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from attestor.llm import byte_bpe, toxicity
from tests.llm.test_near_copies import components_of


def test_stages_against_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    seen = [spark.read.parquet(f"{d}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], d)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    rows = [frame.collect() for frame in seen]
    assert all(frame.columns == seen[0].columns for frame in seen[1:-1])

    model = toxicity.fit(toxicity.labelled_documents(seen[0], spark.read.parquet(f"{d}/labels.parquet")))
    link = model.scorer()
    assert sorted(r.doc_id for r in rows[1]) == sorted(r.doc_id for r in rows[0] if model.above(np.array([link(r.text or "")]))[0, 0] < toxicity.REJECT)

    groups = defaultdict(list)
    for r in rows[1]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in rows[2]) == sorted(min(g)[1] for g in groups.values())

    same = components_of([(r.doc_id, r.text or "") for r in rows[2]])  # five-word shingles, similarity 0.8
    assert sorted(r.doc_id for r in rows[3]) == sorted(set(same.values())) and len(rows[3]) < len(rows[2])

    before, after = (Counter(r.doc_id for r in rows[k]) for k in (3, 4))
    assert set(after) <= set(before) and max(after.values()) <= 2
    words = lambda k: sum(len(r.text.split()) for r in rows[k])
    assert abs(words(4) - 1.5 * words(3)) < 0.02 * words(3) + 20 * 5000 * 0.02

    assert Counter(r.doc_id for r in rows[5]) == after
    assert all(r.exact for r in rows[5])
    text = {r.doc_id: r.text for r in rows[3]}
    bpe = byte_bpe.encoder(*byte_bpe.default_files())
    assert all(bytes(r.token_ids) == bpe.encode(text[r.doc_id]) and r.n_tokens * 4 == len(r.token_ids) for r in rows[5])
    assert sorted(map(str, corpus_pipeline.run(spark, d).drop("token_ids").collect())) == sorted(map(str, seen[-1].drop("token_ids").collect()))


def test_nulls_repeats_and_no_rows(spark):
    d = "/root/testdata/sf0.001"
    extra = [(None, None, None, None, None), (None, None, None, None, None), (0, "", "en", "src0", 0), (0, "", "en", "src0", 0)]
    table = spark.read.parquet(f"{d}/documents.parquet")
    docs = table.unionByName(spark.createDataFrame(extra, table.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
    last = corpus_pipeline.encode(spark, docs, d)
    assert last.where("not exact").count() == 0 and last.count() > 0
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, table.limit(0), d).count() == 0
    assert corpus_pipeline.drop_toxic(spark, table.limit(0), d).count() == 0
