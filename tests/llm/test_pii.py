import hashlib
import random
import re

from pyspark.sql import functions as F

from attestor.llm import pii
from attestor.llm.common import with_row

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "phone" and not 10 <= len(digits) <= 15 \
                    or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def texts():
    draw = random.Random(7)
    parts = ["a@b.c", "x.y@mail7.example.com", "a@b.c_d@e.f", "@", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "001.2.3.4", "0000000300.1.1.1", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+12",
             "+1 +1 555 123 4567", "+44 20 7946 0958 ", "é", "\U0001f642", "\n", " ", "-", "12345678901234567890", "..", "a.b@c..d.e", "5 5", "x" * 30, "1" * 40, "%+-@a-b.c-d", "\x1c", "99"]
    return [None, "", "no digits", "1 " * 20_000, "a" * 20_000 + "@", "1" * 50_000, "+1" + " 1" * 6000, ("a@b.c " * 3000), "9." * 10_000] + ["".join(draw.choices(parts, k=draw.randint(1, 12))) for _ in range(400)]


def test_base_spans(spark):
    rows = [(i, t, "k", 1) for i, t in enumerate(texts())]
    docs = with_row(spark.createDataFrame([*rows, (None, "a@b.c", "k", 1), (None, "a@b.c", "k", 1)], "doc_id long, text string, base string, s int"))
    got = pii.find(docs).select("doc_id", pii.joined(F.col("base")).alias("base"), *[f"n_{k}" for k in pii.KINDS]).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = "email:0:5" if r.doc_id is None else plain(rows[r.doc_id][1])
        assert r.base == want, (rows[r.doc_id][1][:200], r.base[:200], want[:200])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [want.count(f"{k}:") for k in pii.KINDS]
    assert pii.find(docs.limit(0)).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    draw = random.Random(3)

    def card():
        body = "".join(draw.choices("0123456789", k=15))
        return next(body + c for c in "0123456789" if luhn(body + c))

    rows = [f"pay with {card()} now" for _ in range(30)] + [f"serial number {draw.randint(10**15, 10**16 - 1)}x9 stays" for _ in range(20)]
    broken = card()
    rows.append("pay with " + broken[:-1] + str((int(broken[-1]) + 1) % 10) + " now")  # fails the check, stands where cards stand
    rows.append("see page 1234567890 with nothing")
    docs = with_row(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    got = {r.doc_id: r.spans for r in pii.find(docs).select("doc_id", pii.joined(F.col("spans")).alias("spans")).collect()}
    assert all(got[i] == "card:9:25" for i in range(30))
    assert got[50] == "id:9:25" and not any(got[i] for i in [*range(30, 50), 51])


def test_query_over_the_table(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in pii.op5_personal_data(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        base = plain(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got.pop(r.doc_id).spans.split(","))
    assert not got
