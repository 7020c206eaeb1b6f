"""The registry with and without the training-data package."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q, set(o) <= set(q))"


def asked(folder: str, before: str = "", **more: str) -> list[str]:
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", before + ASK], cwd=folder, env=own | more, capture_output=True, text=True, check=True).stdout.split()


@pytest.mark.parametrize("gone", [["gaugeworks/llm", "corpus_pipeline.py"], ["gaugeworks/llm"], ["corpus_pipeline.py"]])
def test_registry_without_the_package(tmp_path, gone):
    shutil.copytree(f"{TOP}/gaugeworks", tmp_path / "gaugeworks", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{TOP}/{name}"):
            shutil.copy(f"{TOP}/{name}", tmp_path)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    for more in ({}, {"PYTHONPATH": TOP}):  # what lies elsewhere on the path counts for nothing
        n, own, pipeline, known = asked(str(tmp_path), **more)
        assert int(n) >= 66 and (own, pipeline, known) == ("0", "False", "True")


@pytest.mark.parametrize("needed", ["zstandard", "ahocorasick", "public_tokenizers", "numpy"])
def test_registry_without_a_dependency(needed):
    n, own, pipeline, known = asked(TOP, f"import sys; sys.modules[{needed!r}] = None; ")
    assert int(n) >= 66 and (own, pipeline, known) == ("0", "False", "True")
