"""The entry file with and without the optional parts, and the shared folder."""

import os
import shutil
import subprocess
import sys

import pytest

from cragline import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, set(o) <= set(q))"


def said(folder, code=SAY):
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": str(folder)})
    return done.returncode, done.stdout.split(), done.stderr


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_the_optional_folder(tmp_path, with_pipeline):
    away = ["llm", "__pycache__", ".git"] + ([] if with_pipeline else ["corpus_pipeline.py"])
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(*away))
    code, out, err = said(tmp_path / "copy")
    assert code == 0, err
    assert int(out[0]) > 90 and out[1:] == ["0", "False", "True"]
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300)
    assert collected.returncode == 0, collected.stdout


def test_errors_inside_a_part_are_not_caught(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns("__pycache__", ".git", "llm"))
    os.makedirs(tmp_path / "copy/cragline/llm")
    (tmp_path / "copy/cragline/llm/__init__.py").write_text("")
    (tmp_path / "copy/cragline/llm/queries.py").write_text("import no_such_library")
    code, _, err = said(tmp_path / "copy")
    assert code != 0 and "no_such_library" in err


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Session())
