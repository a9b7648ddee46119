"""License scans (operator 11): a positional index of rare licence words. DataFrame functions only.

Templates are short licence notices with key phrases that must be there. Document frequencies of all template words, over the whole corpus, say
which word of each phrase is rare. A file looks up the rare words it holds; where two rare words of a phrase stand at their places to each
other, the phrase is verified word by word; a phrase places its template in the file, the template's other key phrases are verified near their places,
and the score is the share of the template's weight (IDF) that stands where it should.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import read, whole

# Characters that end a word, after A-Z are lower-cased.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# Fixed values of the contract: phrases that give a label wherever they stand.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
# Fixed values, from the licences' own notices: label, notice, and the key phrases that must be there.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "except in compliance with the license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("source and binary forms", "provided that the following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose", "permission to use copy modify")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "licensed under the gnu lesser general public license version", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
SLACK = 8  # words that a key phrase may stand off its place
MIN_SCORE = 0.5


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]  # place in the notice, words
    base: bool = False


def template(label: str, notice: str, phrases, base: bool = False) -> Template:
    text = tuple(notice.split())
    found = []
    for phrase in phrases:
        p = tuple(phrase.split())
        found.append((next(i for i in range(len(text)) if text[i: i + len(p)] == p), p))
    return Template(label, text, tuple(found), base)


TEMPLATES = tuple(template(label, phrase, (phrase,), True) for label, phrase in BASE) + tuple(template(*n) for n in NOTICES)


def words_of(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, GAP), "")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_weights(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[str, float]:
    """IDF of every template word over all documents; one count per template word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    present = F.array_intersect(words_of(whole(text_col)), strings(vocabulary))
    # A first, empty word counts the documents, so that one pass gives both.
    counts = docs.select(F.explode(F.concat(F.array(F.lit("")), present)).alias("word")).groupBy("word").count().collect()
    n = {r["word"]: r["count"] for r in counts}
    return {w: log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1 for w in vocabulary}


def rare_places(phrase: tuple[str, ...], weights: dict[str, float]) -> list[int]:
    """Places of the phrase's words, the rarest first (ties: the smaller word, then the first place)."""
    return sorted(range(len(phrase)), key=lambda q: (-weights[phrase[q]], phrase[q], q))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, min_score: float = MIN_SCORE, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``base`` (label and first word of each base phrase) and ``matches`` (label, first word and score of each placed template of ``min_score`` or more).

    All is made in the row: no join, no shuffle, and memory in proportion to the text. Only files that hold all words of some phrase are looked into, and
    each look-up is bounded by the templates, so the work is linear in the text whatever it repeats. A null text is empty and has no words. Repeated
    rows are judged each by itself; other columns are ignored. An empty table gives no rows.
    """
    weights = weights or word_weights(docs, text_col, templates)
    phrases = sorted({p for t in templates for _, p in t.phrases})
    numbers = {p: k for k, p in enumerate(phrases)}
    entries: dict[str, list[Column]] = {}
    possible = []
    body = docs.select(F.col(id_col).alias("id"), words_of(whole(text_col)).alias("w"))
    body = body.select("id", "w", F.array_intersect("w", strings(sorted({w for p in phrases for w in p}))).alias("held"))
    for p in phrases:
        first, second = (rare_places(p, weights) * 2)[:2]
        entries.setdefault(p[first], []).append(F.struct(F.lit(numbers[p]).alias("phrase"), F.lit(first).alias("at"), F.lit(second - first).alias("apart"), F.lit(p[second]).alias("second"), strings(p).alias("words")))
        holds = F.lit(True)
        for q in dict.fromkeys(p[q] for q in rare_places(p, weights)):  # the rarest word is asked for first
            holds = holds & F.array_contains("held", q)
        possible.append(F.when(holds, F.lit(p[first])))
    body = body.withColumn("rare", F.array_distinct(F.array_compact(F.array(*possible))))

    # Places of rare words, then phrases whose two rarest words stand right, then whole phrases.
    index = F.create_map(*[c for word, found in sorted(entries.items()) for c in (F.lit(word), F.array(*found))])
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains("rare", F.get("w", i)))
    starts = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(F.element_at(index, F.get("w", i)), lambda e: F.coalesce((i + e["apart"] >= 0) & (F.get("w", i + e["apart"]) == e["second"]), F.lit(False))),
        lambda e: F.struct((i - e["at"]).alias("start"), e["phrase"].alias("phrase"), e["words"].alias("words")))))
    stands = lambda start, phrase: (start >= 0) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size(phrase)) == phrase)
    found = F.transform(F.filter(starts, lambda x: stands(x["start"], x["words"])), lambda x: F.struct(x["start"], x["phrase"]))
    none = F.array().cast("array<struct<start:int,phrase:int>>")
    body = body.withColumn("found", F.when(F.size("rare") > 0, found).otherwise(none))

    # Templates as data: each is placed by its first key phrase.
    def as_data(t: Template) -> Column:
        place, phrase = t.phrases[0]
        others = F.array(*[F.struct(F.lit(q).alias("at"), strings(p).alias("words")) for q, p in t.phrases[1:]]) if t.phrases[1:] else F.array().cast("array<struct<at:int,words:array<string>>>")
        return F.struct(F.lit(t.label).alias("label"), F.lit(numbers[phrase]).alias("phrase"), F.lit(place).alias("at"), others.alias("others"), strings(t.words).alias("words"),
                        F.array(*[F.lit(weights[w]) for w in t.words]).alias("weights"), F.lit(sum(weights[w] for w in t.words)).alias("total"))

    known = F.array(*[as_data(t) for t in templates])
    near = F.sequence(F.lit(-SLACK), F.lit(SLACK))

    def score(t: Column, start: Column) -> Column:
        standing = F.transform(t["words"], lambda w, j: F.coalesce((start + j >= 0) & (F.get("w", start + j) == w), F.lit(False)))
        return F.round(F.aggregate(F.zip_with(standing, t["weights"], lambda s, x: F.when(s, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / t["total"], 6)

    placed = F.flatten(F.transform(known, lambda t: F.transform(
        F.filter("found", lambda x: (x["phrase"] == t["phrase"]) & F.forall(t["others"], lambda o: F.exists(near, lambda s: stands(x["start"] - t["at"] + o["at"] + s, o["words"])))),
        lambda x: F.struct(t["label"].alias("label"), (x["start"] - t["at"]).alias("first_word"), score(t, x["start"] - t["at"]).alias("score")))))
    bases = F.create_map(*[c for t in templates if t.base for c in (F.lit(numbers[t.phrases[0][1]]), F.lit(t.label))])
    none = F.array().cast("array<struct<label:string,first_word:int,score:double>>")
    body = body.withColumn("matches", F.when(F.size("found") > 0, F.filter(placed, lambda x: x["score"] >= min_score)).otherwise(none))
    hits = F.filter(F.transform("found", lambda x: F.struct(F.element_at(bases, x["phrase"]).alias("label"), x["start"].alias("first_word"))), lambda x: x["label"].isNotNull())
    return body.select(F.col("id").alias(id_col), F.size("w").cast("long").alias("n_words"), hits.alias("base"), "matches")


def op11_license_scan(spark, d):
    rows = scan(read(spark, d, "documents"))
    label = lambda x: x["label"]
    at = F.transform("base", lambda x: x["first_word"].cast("long"))
    found = F.transform("base", label)
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(found, F.transform("matches", label)))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda x: x["score"])), F.lit(0.0)).alias("score"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_template(k: int, t: Template) -> str:
    others = ", ".join(f"{{'q': {q}, 'w': {_sql_list(p)}}}" for q, p in t.phrases[1:])
    rest = f"[{others}]" if others else "[]::struct(q integer, w varchar[])[]"
    return f"({k}, '{t.label}', {_sql_list(t.words)}, {t.phrases[0][0]}, {_sql_list(t.phrases[0][1])}, {rest}, {t.base})"


QUERIES = {"op11_license_scan": op11_license_scan}
ORACLES = {"op11_license_scan": rf"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from documents),
t(tid, label, words, q, phrase, others, base) as (values {", ".join(_sql_template(k, t) for k, t in enumerate(TEMPLATES))}),
tw as (select tid, unnest(words) as w, unnest(range(0, len(words))) as j from t),
f as (select w, count(*) as df from (select distinct doc_id, w from (select doc_id, unnest(words) as w from d) where w in (select w from tw)) group by w),
g as (select tw.tid, tw.w, tw.j, ln(((select count(*) from d) + 1) / (coalesce(f.df, 0) + 1)) + 1 as weight from tw left join f using (w)),
p as (select doc_id, unnest(words) as w, unnest(range(0, len(words))) as i from d),
c as (select p.doc_id, t.tid, t.label, t.base, t.others, p.i - t.q as off, p.i, d.words from p join t on p.w = t.phrase[1] join d using (doc_id) where d.words[p.i + 1 : p.i + len(t.phrase)] = t.phrase),
v as (select * from c where coalesce(list_bool_and(list_transform(others, lambda o: list_bool_or(list_transform(range(-{SLACK}, {SLACK} + 1), lambda s: off + o.q + s >= 0 and words[off + o.q + s + 1 : off + o.q + s + len(o.w)] = o.w)))), true)),
s as (select v.doc_id, v.tid, v.label, v.off, round(sum(case when v.off + g.j >= 0 and v.words[v.off + g.j + 1] = g.w then g.weight else 0 end) / sum(g.weight), 6) as score from v join g using (tid) group by all),
b as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels, list(distinct label) as found from c where base group by doc_id),
m as (select doc_id, max(score) as score, list(distinct label) as found from s where score >= {MIN_SCORE} group by doc_id)
select doc_id, len(d.words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(m.found, [])))), ',') as labels, coalesce(m.score, 0.0)::double as score
from d left join b using (doc_id) left join m using (doc_id)
"""}
