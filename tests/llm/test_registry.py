import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_one_query_for_each_operator():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert {x for x in __spark_entry__.oracle_sql() if x.startswith("op")} == {"op1_mix_sources", "op3_decontaminate", "op4_drop_common_lines"}


def test_entry_without_the_subpackage(tmp_path):
    """The other queries stay when the pipeline and the llm folders are gone."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'get_votes' in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_import_errors_are_not_hidden(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    (copy / "ideolens" / "llm" / "words.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert run.returncode and "no_such_module" in run.stderr
