import math

import duckdb
import pytest

from strandwork.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# Slow in DuckDB; smaller tests cover them.
SLOW = {"linguistic_complexity", "six_frame_translation", "mirna_targets", "restriction_digest", "geary_autocorrelation", "moran_autocorrelation", "autocorrelation", "ctd_descriptors", "quasi_sequence_order", "pseudo_composition", "microsatellites", "protein_features"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, list):
        return tuple(map(norm, x))
    return x


@pytest.mark.parametrize("name", [n for n in catalog.ORACLE_SQL if n not in SLOW])
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    out = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in columns)) for r in out.fetchall())
    assert got == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "strandwork", tmp_path / "strandwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'gc_content' in q and 'pipeline' not in q"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
