import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(df: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    text = df[names].astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan"}).apply(lambda s: s.str.replace(r"\.0$", "", regex=True))
    return text.sort_values(names).reset_index(drop=True)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    pd.testing.assert_frame_equal(plain(got, names), plain(want, names))


@pytest.mark.parametrize("name", ["q_mer_rows", "q_vad_segments", "q_offset_align", "q_log_parse", "q_median_filter", "q_lcp_prev", "q_beam_topk"])
def test_no_python_where_spark_is_enough(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_only_needed_columns_are_read(spark):
    plan = catalogue.queries()["q_eval_unmatched"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "n_chars" not in plan


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without the optional subpackage and its pipeline the entry still imports and has all other queries."""
    import shutil

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "tidemark/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    (tmp_path / "tidemark/llm/__pycache__").rmdir()
    (tmp_path / "tidemark/llm").rmdir()
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    shutil.copy(root / "corpus_pipeline.py", tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
