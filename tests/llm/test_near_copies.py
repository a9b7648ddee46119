import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm import near_copies, simhash
from attestor.llm.common import ROW, with_row


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted(seed=3, groups=60):
    """(id, text): originals, and copies with words changed one by one down to a similarity from 0.7 to 0.95."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        rows.append(" ".join(words))
        least, copy = (0.8, 0.85, 0.9, 0.95, 0.7)[g % 5], list(words)
        for at in rng.permutation(len(words)):
            trial = copy[:at] + [f"new{at}"] + copy[at + 1:]
            if jaccard(shingles(rows[-1]), shingles(" ".join(trial))) < least:
                break
            copy = trial
        rows.append(" ".join(copy))
    return list(enumerate(rows))


def components_of(rows):
    sets, label = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or (a | b and 10 * len(a & b) >= 8 * len(a | b))) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("block", [near_copies.BLOCK, 3])
def test_planted_copies_against_brute_force(spark, block):
    rows = planted()
    hub = rows[0][1].split()
    rows += [(1000 + k, " ".join(hub[:7 * k] + ["x"] + hub[7 * k + 1:])) for k in range(8)]
    rows += [(2000, ""), (2001, " \t"), (2002, "one two"), (2003, "One two"), (2004, "one three")]
    want = components_of(rows)
    got = near_copies.near_groups(with_row(spark.createDataFrame(rows, "doc_id long, text string")), block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert sorted(r.doc_id for r in got if r.kept) == sorted(set(want.values()))


def test_stage_finds_copies_at_similarities_from_80_to_95(spark):
    rows = planted()
    sets = dict((i, shingles(t)) for i, t in rows)
    near = [i for i in range(0, len(rows), 2) if jaccard(sets[i], sets[i + 1]) >= 0.8]
    assert len(near) == 48
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert {i for i, _ in rows} - kept == {i + 1 for i in near}


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(None, None), (None, None), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert near_copies.keep_one(docs).count() == 2
    assert near_copies.near_groups(with_row(docs.limit(0))).drop(ROW).count() == 0


def test_fingerprints_give_candidates_and_sets_decide(spark):
    words = " ".join(f"w{i}" for i in range(400))
    loose = "a b c " * 80
    rows = [(1, words), (2, words + " x"), (3, loose + "x1 x2 x3 x4 x5 x6 x7 x8"), (4, loose + "y1 y2 y3 y4 y5 y6 y7 y8"), (5, ""), (6, "quite another text of a few words")]
    text = dict(rows)
    for a, b in ((1, 2), (3, 4)):
        assert (simhash.fingerprint(text[a]) ^ simhash.fingerprint(text[b])).bit_count() <= 4
    docs = with_row(spark.createDataFrame(rows, "doc_id long, text string")).localCheckpoint()
    signed = near_copies.signatures(docs, "doc_id", "text").localCheckpoint()
    marks = {r.mark: r.id for r in signed.collect()}
    close = near_copies.fingerprint_links(docs, signed, "doc_id", "text").localCheckpoint()
    assert {frozenset((marks[r.a], marks[r.b])) for r in close.collect()} == {frozenset((1, 2)), frozenset((3, 4))}
    unbanded = signed.withColumn("keys", F.slice("keys", 1, 0))
    assert {frozenset((marks[r.a], marks[r.b])) for r in near_copies.similar(docs, unbanded, "text", close).collect()} == {frozenset((1, 2))}
