import re
from collections import Counter

from attestor.llm import quality


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))


TEXTS = [None, "", " \n\t", "a", "a b c", "a b c d", "a b c a b c", "a a a a", "x y x y x", "ä # * |<> $\n\nä # * |<> $\n x\n", "the cat sat " * 5000, "w " * 3, "a\x0bb\x0cc\rd", "\x1c a b c \x1c a b c",
         " ".join(f"w{i % 1009}" for i in range(30_000)), "a b c d e b c d z a b", "one two three\none two three\nONE TWO THREE", "A B C " * 30]


def test_measurements(spark):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(TEXTS)] + [(0, None, 1, "z"), (None, "a b", 2, "z")], "doc_id long, text string, n_words int, _m string")
    got = quality.ledger(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(TEXTS[r.doc_id]), TEXTS[r.doc_id]
    assert quality.ledger(docs.limit(0)).count() == 0


def test_policies_and_ablations_agree_with_counting(spark):
    rows = quality.ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "fail_bits")
    bits = [r.fail_bits for r in rows.collect()]
    names = list(quality.RULES)
    for policy, rules in quality.POLICIES.items():
        mask = quality.mask_of(rules)
        assert quality.apply_policy(rows, policy).where("kept").count() == sum(b & mask == 0 for b in bits)
        got = {r.rule: r for r in quality.ablations(rows, policy).collect()}
        assert set(got) == set(rules)
        for rule in rules:
            bit = 1 << names.index(rule)
            assert got[rule].fails == sum(b & bit != 0 for b in bits)
            assert got[rule].fails_alone == sum(b & mask == bit for b in bits)
            assert got[rule].kept_without == sum(b & mask & ~bit == 0 for b in bits)


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.1"
    rows = quality.op8_quality_ledger(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    kept = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) <= 0.001 * kept[1, True]
    assert kept.get((0, False), 0) >= 0.9 * (kept.get((0, False), 0) + kept.get((0, True), 0))
