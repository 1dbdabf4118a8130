import hashlib

import corpus_pipeline
from tidemark.llm import queries
from tidemark.llm.common import written

SF = "/root/testdata/sf0.001"


def test_each_stage_against_its_plain_form(spark, documents):
    """Each stage's rows follow from its operator's rows for the stage's own input."""
    from tidemark.llm import language, line_dedup, near_dedup, packing, quality

    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF))
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "packing":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language_id":
            model = language.fit(language.training_rows(docs))
            assert set(after) == {r["doc_id"] for r in language.predict(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= language.REJECT_BELOW}
        elif name == "quality_rules":
            assert set(after) == {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
        elif name == "line_dedup":
            want = {r["doc_id"]: r["kept_sha256"] for r in line_dedup.digest(docs).collect()}
            assert {k: hashlib.sha256(t.encode()).hexdigest() for k, t in after.items()} == want
        elif name == "near_dedup":
            assert set(after) == {r["doc_id"] for r in near_dedup.near_duplicates(docs, corpus_pipeline.NEAR).collect() if r["kept"]}
            assert all(before[k] == t for k, t in after.items())
        else:
            assert {r["doc_id"] for r in out.collect()} == set(before)
            assert out.count() == packing.packed(docs).count()
        docs = out


def test_run_and_names(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "line_dedup", "near_dedup", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert [int(k[2:].split("_")[0]) for k in queries.queries()] == list(range(1, 14))


def test_stages_take_odd_and_no_rows(spark, odd, empty):
    for df in (odd, empty):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "item", "bin_id", "capacity", "start", "size"]


def test_tables_can_be_cleared(spark):
    from pathlib import Path

    from tidemark.llm.common import clear, own_folder

    assert written(spark.range(5)).count() == 5
    folder = Path(own_folder(spark).removeprefix("file://"))
    assert any(folder.iterdir())
    clear(spark)
    assert not folder.exists() and written(spark.range(3)).count() == 3


def test_oracles(spark):
    """The SQL gives what the queries give."""
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        cur = c.execute(sql)
        names = [d[0] for d in cur.description]
        got = sorted(map(tuple, queries.queries()[name](spark, SF).select(*names).collect()), key=repr)
        assert got == sorted(map(tuple, cur.fetchall()), key=repr), name
