"""Every query that SQL can express gives DuckDB's rows; the rest are checked for what they promise."""

import math
import os
import subprocess
import sys

import duckdb
import pytest
from segmill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return repr(x + 0.0)
    return str(x)


def rows(table):
    names = sorted(table.column_names)
    columns = [table[n].to_pylist() for n in names]
    return names, sorted(tuple(map(plain, r)) for r in zip(*columns))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_equal_the_oracle(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toArrow()) == rows(duck.sql(catalog.SQL[name]).to_arrow_table())


def test_no_sketch_for_each_user(spark):
    plan = catalog.QUERIES["delegated_approx_distinct"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Aggregate(keys=" in line and "user_id" in line.partition("functions=")[0]]
    assert keyed and not [line for line in keyed if "approx_count_distinct" in line]


def test_recall_asks_for_every_twentieth_vector(spark, monkeypatch):
    asked, recall = [], catalog.knn.recall

    def counted(found, exact, k):
        asked.append(sorted(r["qid"] for r in exact.select("qid").distinct().collect()))
        return recall(found, exact, k)

    monkeypatch.setattr(catalog.knn, "recall", counted)
    catalog.QUERIES["recall_approximate"](spark, SF)
    assert asked == [sorted(r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").collect())]


def test_small_world_is_capped_and_repeatable(spark):
    first, again = ({tuple(r) for r in catalog.QUERIES["small_world_graph"](spark, SF).collect()} for _ in range(2))
    assert first == again
    per = {}
    for node, pos, neighbor in first:
        assert node != neighbor and 1 <= pos <= 16 and 0 <= neighbor < 500
        per.setdefault(node, []).append(neighbor)
    assert len(per) == 500 and all(len(v) == len(set(v)) for v in per.values())


def test_entry_module_stands_without_the_pipeline(tmp_path):
    """Without the subpackage llm and the pipeline, and without a session, the module is imported."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "segmill"), tmp_path / "segmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
