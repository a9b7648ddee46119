import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import line_join
from attestor.llm.common import with_row


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def edited(draw, line, n):
    line = list(line)
    for _ in range(n):
        at, kind = draw.randrange(len(line)), draw.randrange(3)
        line[at: at + (kind < 2)] = [draw.choice("abx")] * (kind > 0)
    return "".join(line)


@settings(max_examples=400, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.integers(1, 4))
def test_within_is_the_edit_distance(a, b, edits):
    assert line_join.within(a, b, edits) == (distance(a, b) <= edits)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3), st.integers(9, 40))
def test_pairs_within_share_their_first_key(seed, edits, n):
    draw = random.Random(seed)
    a = "".join(draw.choices("ab", k=n))
    b = edited(draw, a, draw.randint(0, edits))
    long, short = sorted((a, b), key=lambda x: (len(x), x), reverse=True)
    key = line_join.first_key(long, short, edits)
    assert (key, True) in set(line_join.entry_keys(short, edits)) and key in {k for k, _ in line_join.entry_keys(long, edits)}


def brute(rows, edits, min_chars):
    texts = defaultdict(list)
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                texts[line.strip(" \t\n\x0b\x0c\r")].append((i is None, i or 0, n))
    names, root, links = list(texts), {t: t for t in texts}, defaultdict(int)
    top = lambda t: t if root[t] == t else top(root[t])
    for i, a in enumerate(names):
        for b in names[:i]:
            if min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = defaultdict(lambda: (True, 1 << 60, 0))
    for t in names:
        least[top(t)] = min(least[top(t)], *texts[t])
    return sorted((*place, least[top(t)], links[t]) for t in names for place in texts[t])


@pytest.mark.parametrize("block,edits", [(1500, 2), (4, 2), (4, 1)])
def test_classes_and_links(spark, block, edits):
    draw = random.Random(block + edits)
    bases = ["".join(draw.choices("abcdefgh ", k=draw.randint(20, 60))) for _ in range(12)]
    rows = [(i, "\n".join(edited(draw, draw.choice(bases), draw.randint(0, 3)) for _ in range(draw.randint(0, 6)))) for i in range(60)]
    rows += [(None, bases[0] + "\n\n \t\nshort\nshor"), (100, None), (101, ""), (102, "short\r\nshort"), (103, "long line of words " * 2000 + "\nlong line of words " + "long line of words " * 1999)]
    docs = with_row(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, h int"))
    got = line_join.line_classes(docs, block=block, edits=edits).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.line_no, (r.class_id is None, r.class_id or 0, r.class_line), r.n_links) for r in got) == brute(rows, edits, 20)
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_id, r.class_line)) for r in got)
    assert line_join.line_classes(docs.limit(0)).count() == 0


def test_repeated_rows_keep_one_line(spark):
    docs = with_row(spark.createDataFrame([(1, "the very same line of text")] * 3, "doc_id long, text string"))
    assert sorted(r.kept for r in line_join.line_classes(docs).collect()) == [False, False, True]


def test_keys_of_many_lines_are_those_of_their_parts():
    draw = random.Random(4)
    lines = ["".join(draw.choices("ab é\U0001F600", k=n)) for n in (20, 21, 333, 20, 47)]
    keys, own, line = line_join.keys_of(lines, 2)
    long = "xy" * line_join.SPAN  # longer than what is hashed together
    for at, text in [*enumerate(lines), (None, long)]:
        wanted = [(line_join.key_of(text[a:b], seed), bool(mine)) for seed, a, b, mine in line_join.cuts(len(text), 2).tolist()]
        assert wanted == line_join.entry_keys(text, 2)
        assert at is None or wanted == [(k, o) for k, o, i in zip(keys.tolist(), own.tolist(), line.tolist()) if i == at]
    assert len(set(keys.tolist())) > 50


def test_keys_are_made_once(spark, monkeypatch):
    seen, real = spark.sparkContext.accumulator(0), line_join.entries

    def counted(lines, edits):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return real(lines.mapInArrow(run, lines.schema), edits)

    monkeypatch.setattr(line_join, "entries", counted)
    docs = with_row(spark.createDataFrame([(i, f"a line that differs in its number only {i % 7}") for i in range(30)], "doc_id long, text string"))
    found = line_join.line_classes(docs).collect()
    assert {(r.class_id, r.n_links) for r in found} == {(0, 6)} and seen.value == 30
