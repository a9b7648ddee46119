import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.operators import versions
from attestor.sources import files, projection
from attestor.sources.stored import commit_tables, read_committed
from attestor.streaming import jobs


def test_jsonl_is_strict_and_names_only_the_file(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "ok.jsonl").write_text('{"id":"a","n":1}\n\n{"id":"b","n":2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "ok.jsonl"), schema, 2).count() == 2
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "ok.jsonl"), schema, 1)
    for body in ('{"id":"a","n":1}\n{"id":', '{"id":"a","secret":1}\n'):
        (tmp_path / "bad.jsonl").write_text(body)
        with pytest.raises(Exception, match="invalid_bad.jsonl"):
            files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()


def test_originals_are_stored_once_and_results_are_not_overwritten(spark, tmp_path):
    for name, body in (("a.txt", "x"), ("b.txt", "x"), ("c.md", "y")):
        (tmp_path / name).write_text(body)
    got = sorted(r["uri"].rsplit("/", 1)[1] for r in files.read_originals(spark, str(tmp_path)).select("uri").collect())
    assert got == ["a.txt", "c.md"]
    target = str(tmp_path / "out")
    files.write_result(spark.range(3).toDF("x"), target)
    with pytest.raises(Exception):
        files.write_result(spark.range(3).toDF("x"), target)
    files.write_result(spark.range(4).toDF("x"), target, overwrite=True)
    assert spark.read.parquet(target).count() == 4


def test_missing_recordings_are_errors(spark):
    recordings = spark.sql("select 'keyword' as method, 'q' as query, cast(null as array<double>) as vector, array('b', 'a') as kb_ids, cast(null as struct<x:string>) as filters, "
                           "array(named_struct('id', 1, 'score', 2.0D), named_struct('id', 2, 'score', 1.0D)) as hits, 2 as captured_limit")
    asked = recordings.select(F.lit(1).alias("request_id"), "method", "query", "vector", F.array(F.lit("a"), F.lit("b")).alias("kb_ids"), "filters")
    rows, missing = files.recorded_candidates(recordings, asked, 2)
    assert [(r["chunk_id"], r["rank"]) for r in rows.collect()] == [(1, 1), (2, 2)] and missing.count() == 0
    assert files.recorded_candidates(recordings, asked, 3)[1].count() == 1


def test_generation_is_rebuilt_and_proven(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "k", "v", f"t{i}", f"s{i}") for i in range(5)], "chunk_id int, kb_id string, version_id string, source_text string, search_text string")
    path = str(tmp_path / "g")
    problems = projection.rebuild_generation(chunks, lambda texts: [[1.0, float(len(t))] for t in texts], path, 2)
    assert problems.count() == 0 and projection.read_generation(spark, path).where("vector[1] = 2").count() == 5
    with pytest.raises(Exception):
        projection.rebuild_generation(chunks.limit(2), lambda texts: [[float("nan")]] * len(texts), path)
    assert projection.read_generation(spark, path).count() == 5  # the one before stays visible
    assert projection.rebuild_generation(chunks.limit(3), lambda texts: [[0.0, 0.0]] * len(texts), path).count() == 0
    assert projection.read_generation(spark, path).count() == 3 and projection.read_generation(spark, path, 0).count() == 5


def graph_tables(spark, nodes, hash_="h1", source=None):
    return {"nodes": spark.createDataFrame([("v1", key, i) for i, key in enumerate(nodes)], "version_id string, node_key string, ordinal int"),
            "units": spark.createDataFrame([("v1", 1)], "version_id string, chunk_id int"),
            "graphs": spark.createDataFrame([("v1", hash_, source)], "version_id string, source_hash string, source_version_id string")}


def test_tree_store_refuses_what_does_not_belong_together(spark, tmp_path):
    chunks = spark.createDataFrame([("v1", 1)], "version_id string, chunk_id int")
    owners = spark.createDataFrame([("v1", "d1", "h1"), ("v0", "d1", "h0"), ("w", "d2", "h2")], "version_id string, document_id string, content_sha256 string")
    path = str(tmp_path / "t")
    cases = [(chunks.withColumn("chunk_id", F.lit(2)), {}, "document_graph_units_mismatch"), (chunks, {"hash_": "other"}, "document_graph_source_hash_mismatch"),
             (chunks, {"source": "w"}, "document_graph_lineage_must_stay_in_document"), (chunks, {"source": "unknown"}, "document_graph_lineage_must_stay_in_document")]
    for have, odd, code in cases:
        assert {r.code for r in projection.write_graph(graph_tables(spark, "ab", **odd), have, path, owners).collect()} == {code}
    with pytest.raises(ValueError):
        projection.read_graph(spark, path, "v1")
    assert projection.write_graph(graph_tables(spark, "ab", source="v0"), chunks, path, owners).count() == 0
    assert [r["node_key"] for r in projection.read_graph(spark, path, "v1").collect()] == ["a", "b"]


def test_a_failure_after_the_first_table_leaves_the_old_set_visible(spark, tmp_path):
    chunks, path = spark.createDataFrame([("v1", 1)], "version_id string, chunk_id int"), str(tmp_path / "t")
    projection.write_graph(graph_tables(spark, "ab"), chunks, path)
    broken = graph_tables(spark, "xyz")
    broken["graphs"] = broken["graphs"].withColumn("source_hash", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        projection.write_graph(broken, chunks, path)
    assert [r["node_key"] for r in projection.read_graph(spark, path, "v1").collect()] == ["a", "b"]
    projection.write_graph(graph_tables(spark, "xyz"), chunks, path)
    assert projection.read_graph(spark, path, "v1").count() == 3 and projection.read_graph(spark, path, "v1", commit=0).count() == 2


def test_a_package_holds_rows_of_one_committed_state(spark, tmp_path):
    path = str(tmp_path / "p")
    table = spark.createDataFrame([(1, "k", "one"), (2, "k", "two")], "chunk_id int, kb_id string, source_text string")
    commit_tables({"chunks": table}, path)
    asked = spark.createDataFrame([("q", ["k"], [1, 2], ["e"]), ("r", ["k"], [1, 3], ["e"]), ("s", ["k", "x"], [1], [])], "request_id string, kb_ids array<string>, chunk_ids array<int>, entity_ids array<string>")
    nodes, known = spark.createDataFrame([(1, "n1"), (1, "n0"), (2, "n2")], "chunk_id int, node_id string"), spark.createDataFrame([("e", "k", "lamp")], "entity_id string, kb_id string, name string")
    bases = spark.createDataFrame([("k", 7, 2)], "kb_id string, content_revision long, acl_revision long")
    visible = read_committed(spark, path, "chunks", 0)
    commit_tables({"chunks": table.where("chunk_id = 1")}, path)
    got = {r.request_id: r for r in versions.evidence_snapshot(asked, visible, nodes, known, bases).collect()}
    assert [(c.chunk_id, c.source_text) for c in got["q"].chunk_rows] == [(1, "one"), (2, "two")] and [n.node_id for n in got["q"].node_rows] == ["n0", "n1", "n2"]
    assert got["q"].entity_rows[0].name == "lamp" and tuple(got["q"].revisions[0]) == ("k", 7, 2)
    assert (got["r"].failure, got["r"].chunk_rows) == ("evidence_snapshot_changed", None) and got["s"].failure == "knowledge_base_not_found"
    assert read_committed(spark, path, "chunks").count() == 1


def stream_of(spark, folder, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_publication_stream_ignores_older_events_and_matches_the_batch(spark, tmp_path):
    schema = "document_id string, seq long, kind string, version_id string"
    parts = [[("d", 5, "publish", "v5"), ("e", 1, "publish", "v1")], [("d", 3, "publish", "v3"), ("e", 2, "delete", None)]]
    query = jobs.stream_publications(stream_of(spark, str(tmp_path / "in"), parts, schema), str(tmp_path / "state"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    got = {r["document_id"]: r["active_version_id"] for r in jobs.read_publications(spark, str(tmp_path / "state")).collect()}
    assert got == {"d": "v5", "e": None}
    assert got == {r["document_id"]: r["active_version_id"] for r in jobs.publication_state(spark.createDataFrame(parts[0] + parts[1], schema)).collect()}


def test_ingest_stream_keeps_the_first_of_each_key(spark, tmp_path):
    schema = "principal_id string, kb_id string, idempotency_key string, ts timestamp, body string"
    at = __import__("datetime").datetime(2024, 1, 1)
    parts = [[("p", "k", "i1", at, "a"), ("p", "k", "i1", at, "a")], [("p", "k", "i1", at, "a"), ("p", "k", "i2", at, "b")]]
    seen = str(tmp_path / "seen")
    query = jobs.stream_ingest(stream_of(spark, str(tmp_path / "in"), parts, schema), lambda df, epoch: df.write.mode("append").parquet(seen), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sorted(r["idempotency_key"] for r in spark.read.parquet(seen).collect()) == ["i1", "i2"]


def test_old_switch_events_remove_only_superseded_versions(spark):
    events = spark.createDataFrame([("d", "publication_switched"), ("x", "document_deleted")], "document_id string, kind string")
    versions = spark.createDataFrame([("d", "v1", "superseded"), ("d", "v2", "published"), ("d", "v3", "ready")], "document_id string, version_id string, status string")
    assert sorted((r["document_id"], r["version_id"] or "") for r in jobs.tombstones(events, versions).collect()) == [("d", "v1"), ("x", "")]


def test_job_stream_retries_then_fails(spark, tmp_path):
    schema = "job_id string, seq long, ts timestamp, kind string"
    at = __import__("datetime").datetime(2024, 1, 1)
    parts = [[("j", 1, at, "queued"), ("j", 2, at, "claimed"), ("j", 3, at, "error")], [("j", 4, at, "claimed"), ("j", 5, at, "error"), ("j", 6, at, "claimed"), ("j", 7, at, "error"), ("k", 1, at, "claimed")]]
    states = jobs.stream_job_state(stream_of(spark, str(tmp_path / "in"), parts, schema))
    query = states.writeStream.outputMode("update").format("memory").queryName("job_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    deadline = time.time() + 90
    while time.time() < deadline and spark.sql("select count(*) from job_rows where job_id = 'k'").first()[0] == 0:
        time.sleep(1)
    query.stop()
    rows = {(r["job_id"], r["seq"]): (r["status"], r["attempts"]) for r in spark.sql("select * from job_rows").collect()}
    assert rows[("j", 3)] == ("queued", 1) and rows[("j", 7)] == ("failed", 3) and rows[("k", 1)] == ("running", 1)
    batch = {r["job_id"]: (r["status"], r["attempts"]) for r in jobs.job_state(spark.createDataFrame(parts[0] + parts[1], schema)).collect()}
    assert batch == {"j": ("failed", 3), "k": ("running", 1)}


def test_a_small_batch_rewrites_its_buckets_only_and_may_run_again(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "document_id string, seq long, kind string, version_id string"
    events = [(f"d{i % 400}", i, "delete" if i % 7 == 0 else "publish", f"v{i}") for i in range(1000)]
    first = spark.createDataFrame(events, schema)
    jobs.merge_publications(first, 0, path, 64)
    few = spark.createDataFrame([(f"d{i}", 2000 + i, "publish", f"w{i}") for i in range(8)] + [("new", 1, "publish", "n"), ("d9", 0, "publish", "late")], schema)
    want = {tuple(r) for r in jobs.publication_state(first.unionByName(few)).select("document_id", "active_version_id", "seq").collect()}
    for _ in range(2):  # an epoch that runs again starts from the same state
        jobs.merge_publications(few, 1, path, 64)
        assert len([p for p in (tmp_path / "state" / "data" / "epoch=1").iterdir() if p.name.startswith("bucket=")]) <= 10
        assert {tuple(r) for r in jobs.read_publications(spark, path).select("document_id", "active_version_id", "seq").collect()} == want
    # files of an epoch without its manifest do not count
    jobs.merge_publications(spark.createDataFrame([("d1", 9999, "delete", None)], schema), 2, path, 64)
    (tmp_path / "state" / "manifest" / "epoch=2" / "_SUCCESS").unlink()
    assert {tuple(r) for r in jobs.read_publications(spark, path).select("document_id", "active_version_id", "seq").collect()} == want
