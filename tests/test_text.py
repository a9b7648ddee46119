import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.functions.digests import uuid5
from attestor.functions.versions import version_at_least


def one(spark, column, **values):
    return spark.createDataFrame([values], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_selection_words_keep_scripts_and_drop_stop_words(spark):
    assert set(one(spark, tx.word_set(F.col("t")), t="Größe Café the хранение 储存")) == {"grösse", "café", "хранение", "储", "存"}


def test_identifiers_are_not_units(spark):
    assert one(spark, tx.identifiers(F.col("t")), t="12 V input for A-100 and ab12") == ["a-100", "ab12"]


def test_values_keep_sign_ratio_range_and_unit(spark):
    got = one(spark, tx.literal_values(F.col("t")), t="2:1 then 1:2, -20 °C, −20 °C, 12 公斤, 3–5 days, a12")
    assert got == ["2:1 then", "1:2", "-20 °c", "−20 °c", "12 公斤", "3–5 days"]


def test_lexemes_follow_suffix_rules_and_concepts(spark):
    words = set(one(spark, tx.lexemes(F.col("t")), t="Batteries stopping tested boxes glass ﬁt"))
    assert {"batteries", "battery", "stop", "stope", "test", "teste", "boxe", "glass", "fit"} <= words
    assert set(one(spark, tx.lexemes(F.col("t")), t="stored items")) == {"concept:storage", "items", "item"}


def test_masked_qualifiers_compare_without_values(spark):
    a = one(spark, tx.masked_qualifiers(F.col("t")), t="Keep 3 days after opening.")
    b = one(spark, tx.masked_qualifiers(F.col("t")), t="Keep 45 days after opening.")
    assert a == b and len(a) == 1


def test_term_counts_match_a_counter(spark):
    from collections import Counter

    words = "b a b c a b".split()
    got = one(spark, tx.term_counts(tx.tokens(F.col("t"))), t=" ".join(words))
    assert {r["term"]: r["tf"] for r in got} == Counter(words)


def test_delivery_tokens_count_signs(spark):
    assert one(spark, tx.delivery_tokens(F.col("t")), t='{"a":1}') == 7


def test_uuid5_equals_the_standard_library(spark):
    import uuid

    space = "c72ec9bf-67c6-540f-b008-8698e3f57210"
    for name in ("0", "17", "node:ü"):
        assert one(spark, uuid5(F.col("n"), F.col("v")), n=space, v=name) == str(uuid.uuid5(uuid.UUID(space), name))


def test_versions_compare_by_number(spark):
    ok = version_at_least(F.col("a"), F.col("b"))
    assert one(spark, ok, a="2.10", b="2.1") and one(spark, ok, a="2.1.0", b="2.1") and not one(spark, ok, a="2.0", b="2.1")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abÄ ß.-9_", max_size=30), min_size=1, max_size=5))
def test_corpus_tokens_equal_python(texts):
    import re

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(i, unicodedata.normalize("NFC", t)) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: list(r["w"]) for r in rows.select("i", tx.tokens(F.col("t")).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [w.casefold() for w in re.findall(r"[\w]+(?:[.-][\w]+)*", t.casefold())]
