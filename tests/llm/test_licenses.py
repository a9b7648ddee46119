import random
import re
from math import log

import duckdb
import pytest
from pyspark.sql import functions as F

from attestor.llm import licenses

SCHEMA = "doc_id long, text string"
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_scan(rows):
    """The query's rows, every template tried at every word."""
    bodies = [plain_words(t) for _, t in rows]
    weight = {w: log((len(rows) + 1) / (sum(w in set(b) for b in bodies) + 1)) + 1 for t in licenses.TEMPLATES for w in t.words}
    out = []
    for (doc, _), body in zip(rows, bodies):
        at = [(i, label) for label, phrase in PHRASES.items() for i in range(len(body)) if body[i: i + len(phrase.split())] == phrase.split()]
        found, best = set(), 0.0
        for t in licenses.TEMPLATES:
            (q, first), *others = t.phrases
            for i in range(len(body)):
                if tuple(body[i: i + len(first)]) != first:
                    continue
                off = i - q
                near = lambda p, w: any(off + p + s >= 0 and tuple(body[off + p + s: off + p + s + len(w)]) == w for s in range(-licenses.SLACK, licenses.SLACK + 1))
                if all(near(p, w) for p, w in others):
                    share = sum(weight[w] for j, w in enumerate(t.words) if 0 <= off + j < len(body) and body[off + j] == w) / sum(weight[w] for w in t.words)
                    if share >= licenses.MIN_SCORE:
                        found.add(t.label)
                        best = max(best, round(share, 6))
        places = [i for i, _ in at]
        base = {label for _, label in at}
        out.append((doc, len(body), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), pytest.approx(best, abs=2e-6)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def query(spark, folder, rows, **extra):
    spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in extra]).write.parquet(f"{folder}/documents.parquet")
    out = licenses.op11_license_scan(spark, str(folder))
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_query_against_brute_force_and_sql(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = sorted(tuple(r) for r in licenses.op11_license_scan(spark, d).collect())
    assert got == plain_scan([(r.doc_id, r.text) for r in docs.collect()])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    assert got == sorted(con.execute(f"select {', '.join(COLUMNS)} from ({licenses.ORACLES['op11_license_scan']})").fetchall())
    assert {"mit", "apache-2", "cc-by-nc", "gpl-3"} <= {r[6] for r in got}


def test_planted_notices(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for k, t in enumerate(licenses.TEMPLATES):
        text = list(t.words)
        rows.append((10 * k, "Début. " + " ".join(text).upper() + " end"))
        rows.append((10 * k + 1, " ".join(w if any(q <= j < q + len(p) for q, p in t.phrases) or rng.random() < 0.7 else "changed" for j, w in enumerate(text))))
        if len(t.phrases) > 1:
            q, p = t.phrases[1]
            rows.append((10 * k + 2, " ".join(text[:q] + ["other"] * len(p) + text[q + len(p):])))  # without its second key phrase
            rows.append((10 * k + 3, " ".join(text[:q] + ["more"] * 5 + text[q:])))  # moved, but near
            rows.append((10 * k + 4, " ".join(text[:q] + ["more"] * 40 + text[q:])))  # too far
    rows += [(1000, "the mit license, under the MIT-License under_the mit license"), (1001, "cc by nc by cc by nc cc by nc"), (1002, "license version 2 apache"), (1003, "under the mit licenseé")]
    got = query(spark, tmp_path, rows)
    assert got == plain_scan(rows)
    base, labels = ({r[0]: r[c] for r in got} for c in (5, 6))
    for k, t in enumerate(licenses.TEMPLATES):
        assert t.label in labels[10 * k].split(",")
        if len(t.phrases) > 1:
            by_phrase = t.label in base[10 * k + 2].split(",")  # a base phrase stands in the notice
            assert (t.label in labels[10 * k + 2].split(",")) == by_phrase and t.label in labels[10 * k + 3].split(",")


def test_odd_rows(spark, tmp_path):
    rows = [(None, "Under the MIT License."), (1, None), (2, ""), (3, " \t\n--"), (4, "x" * 100_000), (5, "Under the MIT License. " * 20_000), (6, "Under the MIT License."), (6, "Under the MIT License."),
            (7, "İ 中文 под лицензией cc by nc"), (8, "word " * 100_000 + "Apache License, Version 2.0"), (9, "\x00cc\x7fby\x00nc 𝔸")]
    assert query(spark, tmp_path, rows, w=1, found=1, held=1, id=1, _row=1) == plain_scan(rows)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


def test_no_python_and_one_small_exchange(spark):
    rows = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
