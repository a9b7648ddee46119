import numpy as np
import pandas as pd

from attestor.llm import toxicity


def nll(weights, thresholds, x, grades):
    edge = np.r_[-np.inf, thresholds, np.inf]
    link = x @ weights
    cdf = lambda z: 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return -np.mean(np.log(cdf(edge[grades + 1] - link) - cdf(edge[grades] - link)))


def test_fit_reaches_the_minimum():
    rng = np.random.default_rng(0)
    x = rng.poisson(0.7, (3000, 4)).astype(float)
    truth, cuts = np.array([2.0, 1.0, 0.5, 0.0]), np.array([1.0, 2.5, 4.0])
    grades = (x @ truth + rng.logistic(size=3000) > cuts[:, None]).sum(axis=0)
    at, columns = np.nonzero(x)
    weights, thresholds = toxicity.fit_links(at, columns, x[at, columns], grades, 4, l2=0.0)
    assert np.abs(weights - truth).max() < 0.25 and np.abs(thresholds - cuts).max() < 0.25 and (np.diff(thresholds) > 0).all()
    best = nll(weights, thresholds, x, grades)
    for _ in range(200):
        other = np.maximum(weights + rng.normal(0, 0.05, 4), 0)
        assert nll(other, np.sort(thresholds + rng.normal(0, 0.05, 3)), x, grades) > best - 1e-3


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    documents = spark.read.parquet(f"{d}/documents.parquet")
    rows = documents.join(labels, "doc_id").select("doc_id", "text", "toxic")
    model = toxicity.fit(rows.where("pmod(xxhash64(text), 2) = 0").select("text", "toxic"))
    test = rows.where("pmod(xxhash64(text), 2) = 1").withColumnRenamed("toxic", "label")
    got = toxicity.score(test, model).select("label", "toxic", "severity", "grade").toPandas()
    found, false = got[got.label == 1].toxic.mean(), got[got.label == 0].toxic.mean()
    assert found > 0.8 and false < 0.02, (found, false)
    assert got[got.label == 1].severity.mean() > 10 * got[got.label == 0].severity.mean()


def test_edge_rows(spark):
    words = ["bad worse worst"] * 30 + ["good fine"] * 60
    labelled = spark.createDataFrame([(w + f" text{i % 7}", int(w[0] == "b"), 0) for i, w in enumerate(words)] + [(None, None, 0), ("bad", None, 1), ("", 0, 1), (None, 0, 1)], "text string, toxic int, label int")
    model = toxicity.fit(labelled)
    rows = [(1, "bad worst", "k"), (1, "bad worst", "k"), (2, None, None), (None, "", "k"), (3, "good " * 100_000, "k"), (4, "fine " * 50_000 + "bad bad worst worse", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["2", "3", "None"]
    assert toxicity.keep_clean(docs.limit(0), model).count() == 0
    scored = toxicity.score(docs.drop("severity"), model).toPandas()
    assert (scored.severity.between(0, toxicity.GRADES - 1)).all() and isinstance(scored, pd.DataFrame)
    nothing = toxicity.fit(labelled.where("toxic = 0"))
    assert toxicity.keep_clean(docs, nothing).count() == len(rows)


def test_query_covers_every_document(spark):
    d = "/root/testdata/sf0.001"
    got = toxicity.op1_toxicity(spark, d)
    assert {"doc_id", "severity", "kept"} <= set(got.columns)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").collect())
