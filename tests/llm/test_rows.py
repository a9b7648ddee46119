from pyspark.sql import functions as F

from attestor.llm import dedup, line_join, mixing, near_copies, pii, simhash, toxicity, url_rules
from attestor.llm.common import ROW, only_rows, read, with_row


def passes(spark, tagged):
    """The numbered rows under two ways to split the files."""
    seen = []
    for most in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", most)
        try:
            seen.append(sorted((r[ROW], r.id) for r in tagged.select("*").where("id >= 0").collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    return seen


def test_numbers_do_not_depend_on_splits(spark, tmp_path):
    spark.range(30_000).select("id", F.md5(F.col("id").cast("string")).alias("text")).repartition(5).write.option("parquet.block.size", 65_536).parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for docs in (table, table.where("id % 3 < 2").select("id", "text"), table.select("id").unionByName(table.select("id")), table.select("id").repartition(7)):
        first, second = passes(spark, with_row(docs))
        assert first == second
        assert len({row for row, _ in first}) == len(first) == docs.count()


def test_empty_tables_have_no_numbers(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "t"))
    assert with_row(spark.read.parquet(str(tmp_path / "t"))).count() == 0
    assert with_row(spark.range(9).limit(0)).count() == 0


CLASHING = ["_row", "_ROW_", "__row", "_path", "_index", "_file", "_metadata", "id", "h", "key", "fp", "word", "a.b", "with `tick`"]


def clashing(spark, folder, name):
    """A table of the given data, stored with extra columns that the operators use as names of their own."""
    table = read(spark, "/root/testdata/sf0.001", name)
    table.select("*", *[F.lit(c).alias(c) for c in CLASHING if c.lower() not in table.columns]).write.parquet(f"{folder}/{name}.parquet")
    return table, read(spark, folder, name)


def test_extra_columns_may_have_any_name(spark, tmp_path):
    table, extra = clashing(spark, str(tmp_path), "documents")
    for made in (dedup.exact_groups, pii.find, line_join.line_classes):
        plain, other = (sorted(map(str, made(with_row(x)).drop(ROW).collect())) for x in (table, extra))
        assert plain == other and plain, made.__module__
    for made in (near_copies.keep_one, simhash.keep_one, mixing.sample_rows, lambda x: only_rows(with_row(x), dedup.exact_groups(with_row(x)).where("kept"))):
        out = made(extra)
        assert out.columns == extra.columns
        assert sorted(r.doc_id for r in made(table).select("doc_id").collect()) == sorted(r.doc_id for r in out.select("doc_id").collect())
        assert out.where(F.col("_row") != "_row").isEmpty() and out.where(F.col("__row") != "__row").isEmpty()
    labels = toxicity.labelled_documents(extra, read(spark, "/root/testdata/sf0.001", "labels"))
    assert toxicity.keep_clean(extra, toxicity.fit(labels)).columns == extra.columns


def test_pages_may_have_any_extra_column(spark, tmp_path):
    rules = spark.createDataFrame([(1, ["host=example.org"], 0.9, 30, "host=example.org")], "rule_id long, items array<string>, confidence double, pages long, anchor string")
    plain, other = (sorted(map(str, url_rules.judge(with_row(x), rules).drop(ROW).collect())) for x in clashing(spark, str(tmp_path), "pages"))
    assert plain == other and plain
