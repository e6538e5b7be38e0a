import corpus_pipeline
from pagelens.llm import decontaminate, secret_scan, simhash

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            sizes.append(docs.count())
    toxic, near, leak, secret = sizes[1:]
    assert sizes[0] > toxic > near > leak == secret
    assert toxic > 0.85 * sizes[0]
    final = spark.read.parquet(str(tmp_path / "secrets"))
    after = simhash.near_duplicates(spark.read.parquet(str(tmp_path / "near_duplicates")))
    assert after.where("component_id <> doc_id").count() == 0
    assert decontaminate.leaks(final, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert secret_scan.scan(final).where("size(spans) > 0").count() == 0
    packed = spark.read.parquet(str(tmp_path / "packing"))
    assert packed.select("doc_id").distinct().count() == secret


def test_stages_on_odd_rows(spark, odd, tmp_path):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == odd.columns
    assert docs.count() > 0
    empty = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
