"""Text columns: token rules, identifiers, values, qualifiers, lexemes.

Every function takes and returns Columns, so the work stays in the JVM. The only
exception is :func:`nfkc`, because Spark has no Unicode normalisation function.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: they must equal the reference's for equal results. ---------------
TOKEN_RULES = {
    # development scorer: ASCII words with punctuation, single ideographs
    "dev": r"[A-Za-z0-9_.:/+-]+|[一-鿿]",
    # offline corpus: Unicode words joined by dot or dash
    "corpus": r"[\p{L}\p{N}_]+(?:[.-][\p{L}\p{N}_]+)*",
    # evidence selection: Unicode words without ideographs, ideographs one by one
    "selection": (
        r"[\p{L}\p{N}&&[^㐀-鿿]]+(?:[._:/+\-][\p{L}\p{N}&&[^㐀-鿿]]+)*"
        r"|[㐀-鿿]"
    ),
    # delivery token counting: selection words plus every punctuation sign
    "delivery": (
        r"[\p{L}\p{N}&&[^㐀-鿿]]+(?:[._:/+\-][\p{L}\p{N}&&[^㐀-鿿]]+)*"
        r"|[㐀-鿿]|[^\p{L}\p{N}_\s]"
    ),
}
SELECTION_STOP = (
    "a an the of for to and or is are be in on at by with what which how does do "
    "can could would please tell me about information available this that it its "
    "的 了 吗 是 有 哪 些 什 么 请 问"
).split()
FACET_STOP = ["long", "much", "many", "should", "want", "know", "give", "tell", "please"]
ASSOCIATION_STOP = ["a", "an", "the", "is", "are", "can", "with", "to", "and", "of", "does", "what", "which"]
VALUE_PATTERN = (
    r"(?U)(?<!\w)[+\-−﹣－﹢＋]?\d+(?:[.,]\d+)?(?:\s*[:/–-]\s*\d+(?:[.,]\d+)?)*\s*(?:[%°]*[\w&&[^\d_]]+|[%°]+)?"
)
NEGATIONS = ["no", "not", "never", "without", "except", "unless", "不", "无", "除"]
DECISION_NEGATIONS = ["no", "not", "never", "without", "cannot", "prohibited", "forbidden", "不", "无", "禁止"]
QUALIFIER = r"(?iU)\b(?:if|when|unless|except|only|provided|after|before)\b|如果|仅在|除外"
DECISION_QUALIFIER = (
    r"(?iU)\b(?:if|when|unless|except|only|provided|after|before|sealed|opened|opening)\b|如果|仅在|除外|密封|开封后"
)
IDENTIFIER = r"^(?:[a-z][a-z0-9]*(?:[-_./:][a-z0-9]+)+|[a-z]{1,12}\d{2,})$"
CONCEPTS = {
    "concept:storage": ["store", "stored", "storage", "refrigerate", "refrigerated", "refrigeration"],
    "concept:shipping": ["ship", "shipped", "shipping", "deliver", "delivered", "delivery", "courier"],
}
CONCEPT_STEMS = {
    "concept:storage": ["stor", "refrigerat", "refrigerate"],
    "concept:shipping": ["ship", "shipp", "shipe", "deliver"],
}
# -------------------------------------------------------------------------------------


def fold(text: Column) -> Column:
    """Case folding: lower case with sharp s written out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def strip(text: Column) -> Column:
    """Trim every white-space character, line breaks included, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Collapse white space to single blanks."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def tokens(text: Column, rule: str = "corpus") -> Column:
    """All tokens in order, with repeats (F1)."""
    source = F.lower(text) if rule == "dev" else text if rule == "delivery" else fold(text)
    return F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(TOKEN_RULES[rule]), F.lit(0))


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def word_set(text: Column) -> Column:
    """Distinct selection tokens without stop words."""
    return F.array_except(tokens(text, "selection"), string_array(SELECTION_STOP))


def identifiers(text: Column) -> Column:
    """Delimited ids, or a letter prefix with two or more digits (F2)."""
    return F.filter(word_set(text), lambda t: t.rlike(IDENTIFIER) & t.rlike(r"\d"))


def identifier_terms(text: Column) -> Column:
    """Words that mix a digit with an ASCII letter; the looser form used for chunks (F2)."""
    return F.filter(word_set(text), lambda t: t.rlike(r"\p{Nd}") & t.rlike("[a-z]"))


def term_counts(token_array: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, built inside the row.

    Sorting brings equal terms together, and a term's count is the distance between
    the starts of two runs, so no row leaves its partition to be counted.
    """
    ordered = F.array_sort(token_array)

    def runs(s: Column) -> Column:
        return F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i).otherwise(F.lit(-1))),
            lambda i: i >= 0,
        )

    def counted(s: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda start, j: F.struct(
                F.get(s, start).alias("term"),
                (F.coalesce(F.get(starts, j + 1), F.size(s)) - start).cast("long").alias("tf"),
            ),
        )

    return let(ordered, lambda s: let(runs(s), lambda starts: counted(s, starts)))


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: a one-element array is transformed by ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_values(text: Column) -> Column:
    """Numbers in order, with sign, ratio, range and unit."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(VALUE_PATTERN), F.lit(0)), lambda v: squeeze(fold(v))
    )


def qualifier_sentences(text: Column) -> Column:
    """Sentences that carry a restriction, folded and sorted."""
    parts = F.filter(F.split(text, r"[\n.!?。！？]"), lambda p: p.rlike(QUALIFIER))
    return F.array_sort(F.transform(parts, lambda p: strip(fold(p))))


def masked_qualifiers(text: Column) -> Column:
    """Restricting sentences with their values masked, so only the restriction compares."""
    parts = F.filter(F.split(text, r"[\n.!?。！？]"), lambda p: p.rlike(DECISION_QUALIFIER))
    return F.array_sort(
        F.transform(parts, lambda p: squeeze(F.regexp_replace(fold(p), VALUE_PATTERN, "<value>")))
    )


def condition_clauses(text: Column) -> Column:
    """Clauses that carry a restriction, in order."""
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?。！？])\s+|\n+"), strip)
    return F.filter(parts, lambda p: (F.length(p) > 0) & p.rlike(DECISION_QUALIFIER))


def _normalize_batch(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Unicode compatibility form. ASCII texts, which it leaves as they are, are not sent to Python."""
    odd = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(F.pandas_udf(_normalize_batch, "string")(odd), text)


def _stem_pair(word: Column, cut: int) -> Column:
    stem = F.substring(word, F.lit(1), F.length(word) - cut)
    last, before = F.substring(word, F.length(word) - cut, F.lit(1)), F.substring(word, F.length(word) - cut - 1, F.lit(1))
    doubled = (F.length(word) - cut > 3) & (last == before)
    base = F.when(doubled, F.substring(word, F.lit(1), F.length(word) - cut - 1)).otherwise(stem)
    return F.array(base, F.concat(base, F.lit("e")))


def _variants(word: Column) -> Column:
    none = F.expr("cast(array() as array<string>)")
    size = F.length(word)
    suffixed = F.concat(
        F.array(word),
        F.when(word.endswith("ies"), F.array(F.concat(F.substring(word, F.lit(1), size - 3), F.lit("y")))).otherwise(none),
        F.when(word.endswith("ing"), _stem_pair(word, 3)).when(word.endswith("ed"), _stem_pair(word, 2)).otherwise(none),
        F.when(word.endswith("s") & ~word.endswith("ss"), F.array(F.substring(word, F.lit(1), size - 1))).otherwise(none),
    )
    # most words have no suffix rule; they leave before any stem is built
    return F.when((size > 4) & word.rlike("^[a-z]*(?:ing|ed|s)$"), suffixed).otherwise(F.array(word))


def lexemes(text: Column, normalize: bool = True) -> Column:
    """Tokens plus suffix variants, with two concept groups collapsed to one name each."""
    words = F.array_distinct(F.flatten(F.transform(word_set(nfkc(text) if normalize else text), _variants)))

    def collapse(concept: str, members: list[str]):
        gone = string_array(members + CONCEPT_STEMS[concept])
        return lambda w: F.when(F.arrays_overlap(w, string_array(members)),
                                F.array_union(F.array_except(w, gone), F.array(F.lit(concept)))).otherwise(w)

    for concept, members in CONCEPTS.items():
        words = let(words, collapse(concept, members))
    return words


def polarity(lexeme_array: Column) -> Column:
    return F.arrays_overlap(lexeme_array, string_array(DECISION_NEGATIONS))


def delivery_tokens(text: Column) -> Column:
    """Token count of a delivered view."""
    return F.size(tokens(text, "delivery"))
