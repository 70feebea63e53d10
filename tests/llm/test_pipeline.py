import corpus_pipeline
from conftest_llm import prose

from orrery.llm import queries


def test_stages(spark, make, odd, tmp_path):
    base = [(i, prose(i, 150)) for i in range(60)]
    rows = [*base, (100, base[0][1]), (101, base[1][1].replace("w", "W", 2)), (102, base[2][1] + " " + prose(900, 100)), (103, prose(901, 80) + " " + " ".join(base[3][1].split()[:70]))]
    rows += [(200 + i, "\n".join(w.upper() + "!!" for w in prose(300 + i, 40).split())) for i in range(25)] + [(None if i is None else 500 + i, t) for i, t in odd]
    docs = make(rows, clashing=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(25)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "MinHash near-dedup", "suffix-array dedup", "packing"]
    ids = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{i}")
            docs = spark.read.parquet(f"{tmp_path}/{i}")
            ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not ids[0] & set(range(200, 225)) and set(range(60)) <= ids[0]
    assert set(range(60)) <= ids[1]
    assert not ids[2] & {100, 101} and set(range(60)) <= ids[2]
    cut = docs.filter("doc_id = 103").first()
    assert cut.text.split() == prose(901, 80).split()
    assert corpus_pipeline.run(spark, str(tmp_path)).agg({"n_tokens": "sum"}).first()[0] == out.agg({"n_tokens": "sum"}).first()[0]


def test_empty_tables(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_named():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
