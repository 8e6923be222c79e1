import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["g1_hotspots", "e13_find_sql_object", "e17_api_surface", "g5_communities", "h9_anomalies", "i3_fold_runs", "c8_postgres_edges", "b14_import_summary",
          "f2_shortest_path", "e7_relevance_search", "e6_substring_search", "e14_find_glue_jobs", "c9_all_frameworks", "c16_yaml_jobs", "h2_folded_counts", "g15_overview_documents", "d3_sweep_edges"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 25


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(names)

    def norm(rows, columns):
        at = {c: i for i, c in enumerate(columns)}
        return sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in (r[at[c]] for c in order)) for r in rows)

    assert sorted(df.columns) == order
    assert norm(df.collect(), df.columns) == norm(cur.fetchall(), names)


def test_queries_can_be_listed_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, oracles = map(int, out.stdout.split())
    assert queries >= oracles > 100


def test_library_works_without_the_training_data_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = str(tmp_path / "repo")
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, trained = out.stdout.split()
    assert int(n) > 130 and trained == "False"


def test_a_folder_without_the_package_is_no_training_data(tmp_path):
    """An empty ``llm`` folder, such as a cache left behind, and a broken package leave the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name, text in (("left", None), ("broken", "import no_such_module\n")):
        copy = str(tmp_path / name)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
        os.makedirs(f"{copy}/loomgraph/llm/__pycache__")
        if text:
            with open(f"{copy}/loomgraph/llm/__init__.py", "w") as f:
                f.write(text)
        code = "import __spark_entry__ as e; print(len(e.queries()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0 and int(out.stdout) > 130, out.stderr
