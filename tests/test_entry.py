import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names_in(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)}, timeout=120)
    assert out.returncode == 0, out.stderr
    return [line.split() for line in out.stdout.splitlines()[-2:]]


def copied(tmp_path):
    for x in ("prosegauge", "__spark_entry__.py", "corpus_pipeline.py"):
        here = os.path.join(ROOT, x)
        if os.path.exists(here):
            (shutil.copytree if os.path.isdir(here) else shutil.copy)(here, tmp_path / x)
    return tmp_path


def test_without_llm(tmp_path):
    folder = copied(tmp_path)
    shutil.rmtree(folder / "prosegauge/llm", ignore_errors=True)
    queries, oracles = names_in(folder)
    assert "sentence_split" in queries and "pipeline" not in queries and not [q for q in queries if q.startswith("op")]
    assert set(oracles) <= set(queries)


def test_without_the_pipeline(tmp_path):
    folder = copied(tmp_path)
    (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    assert "pipeline" not in names_in(folder)[0]


def test_llm_that_cannot_be_imported(tmp_path):
    folder = copied(tmp_path)
    (folder / "public_tokenizers.py").write_text("raise ImportError('absent')\n")
    assert "sentence_split" in names_in(folder)[0]
