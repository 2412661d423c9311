from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
from maskwork.plans.catalogue import ORACLES, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, name):
    got = QUERIES[name](spark, data)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = db.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    place = [want.columns.index(c) for c in columns]
    b = sorted(repr([plain(r[i]) for i in place]) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert (rows == []) == (name == "native_against_arrow")
    if name == "round_trip_full":
        assert all(r.same for r in rows)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_everything_else_works_without_the_training_data_part(tmp_path):
    for p in ("__spark_entry__.py", "maskwork"):
        os.symlink(ROOT / p, tmp_path / p) if p.endswith(".py") else (tmp_path / p).mkdir()
    for p in (ROOT / "maskwork").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "maskwork" / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}, timeout=120)
