import re
from itertools import combinations

from pyspark.sql import functions as F

from attestor.llm import url_rules
from attestor.llm.common import with_row

URLS = [None, "", "no scheme", "http://a.com", "http://A.COM/", "https://www.example.com/en/1", "https://x.www.example.com/en/", "http://m.example.com/en/2?q", "http://example.com/fr/", "http://net/es/1", "http://b.net/fr/#x",
        "http://b.net/FR/", "http://notnet/es/", "x://y://z.net/es/", "http://a.net?/es/", "http://É.COM/x\ny", "://com/", "http://com#/en/", "ftp://example.org/en/?a=1&b=2"]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None)


def no_rules(spark):
    return spark.createDataFrame([], "rule_id long, items array<string>, confidence double, pages long, anchor string")


def test_fixed_rules(spark):
    pages = with_row(spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[5], "h"), (None, URLS[5], "h")], "page_id long, url string, host string"))
    got = url_rules.judge(pages, no_rules(spark)).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule, verdict = plain(URLS[5] if r.page_id is None else URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert url_rules.judge(pages.limit(0), no_rules(spark)).count() == 0


def test_mined_rules_match_brute_force(spark):
    rows = []
    for i in range(600):
        spam, lang = i % 5 == 0, ("en", "de", "xx")[i % 3]
        rows.append((f"https://{'win' if spam else f'h{i % 4}'}.example.org/{lang}/{i}?k{i % 2}=1", spam and lang != "de" or i % 97 == 0))
    table = spark.createDataFrame(rows, "url string, bad boolean")
    url = F.col("url")
    items = table.select("url", "bad", url_rules.tokens(url, url_rules.host_of(url), url_rules.path_of(url)).alias("items"))
    data = [(set(r["items"]), r.bad) for r in items.collect()]
    rate = sum(b for _, b in data) / len(data)
    every = {c for have, bad in data if bad for k in range(1, len(have) + 1) for c in combinations(sorted(have), k)}
    good = {}
    for c in every:
        hit = [b for have, b in data if have.issuperset(c)]
        if sum(hit) >= 20 and sum(hit) / len(hit) >= 0.75 and sum(hit) / len(hit) / rate >= 2:
            good[c] = sum(hit) / len(hit)
    want = {c: v for c, v in good.items() if not any(good.get(tuple(x for x in c if x != y), 0) >= v for y in c if len(c) > 1)}
    mined = url_rules.mine(items)
    got = {tuple(r["items"]): r for r in mined.collect()}
    assert want and {c: round(r.confidence, 9) for c, r in got.items()} == {c: round(v, 9) for c, v in want.items()}
    judged = url_rules.judge(with_row(table.withColumn("page_id", F.monotonically_increasing_id())), mined, fixed=()).collect()
    blocked = {u for u, have in zip([r[0] for r in rows], [h for h, _ in data]) if any(have.issuperset(c) for c in want)}
    assert {r.host + r.path for r in judged if r.verdict == "block"} == {"".join(plain(u)[:2]) for u in blocked} and blocked
    assert url_rules.mine(items.where("not bad")).count() == 0 and url_rules.mine(items.limit(0)).count() == 0


def test_query_over_the_table(spark):
    d = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in url_rules.op4_url_rules(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        host, path, rule, verdict = plain(r.url)
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, rule) and got[r.page_id].verdict == (verdict or got[r.page_id].verdict)


def test_many_redundant_rules_and_many_pages_leave_general_and_rare_rules(spark):
    hosts = [([f"t{h}.{k}" for k in range(12)] + ["scheme=https"], True) for h in range(30) for _ in range(25)]
    general = [(["path=general", f"path={i}", "scheme=https"], i % 5 > 0) for i in range(50)]
    rare = [(["path=rare", f"path=r{i}", "scheme=https"], True) for i in range(20)]
    good = [(["path=good", f"path=g{i}", "scheme=https"], False) for i in range(5180)]
    items = spark.createDataFrame(hosts + general + rare + good, "items array<string>, bad boolean")
    got = {tuple(r["items"]): (round(r.confidence, 9), r.pages) for r in url_rules.mine(items).collect()}
    want = {(f"t{h}.{k}",): (1.0, 25) for h in range(30) for k in range(12)} | {("path=general",): (0.8, 40), ("path=rare",): (1.0, 20)}
    assert got == want
