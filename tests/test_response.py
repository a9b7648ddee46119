from attestor.operators import postings
from attestor.plans import decisions, response, retrieval

D = "/root/testdata/sf0.001"


def test_a_response_asks_each_index_once(spark, monkeypatch):
    calls, ranked = [], postings.ranked
    monkeypatch.setattr(postings, "ranked", lambda *a, **k: calls.append(a) or ranked(*a, **k))
    response.response_diagnostics(spark, D)
    assert len(calls) == 2
    response.delivered_hits(spark, D)
    assert len(calls) == 4


def test_identifiers_are_found_once(spark, monkeypatch):
    calls, found = [], retrieval.identified_documents
    monkeypatch.setattr(retrieval, "identified_documents", lambda *a: calls.append(a) or found(*a))
    assert retrieval.exact_identifier_search(spark, D).count() > 0 and len(calls) == 1


def test_budgets_leave_no_cached_plans_in_plans(spark):
    plan = decisions.fit_budget(spark, D)._jdf.queryExecution().toString()
    assert "InMemoryRelation" not in plan and len(plan) < 200_000
