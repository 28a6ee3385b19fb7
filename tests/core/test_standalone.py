"""The engine without the training-data subpackage, and its command line."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


def test_works_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "quillmesh", tmp_path / "quillmesh", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert not any(n.startswith('op') or n == 'pipeline' for n in q) and len(q) > 40; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_training_data_operators():
    for path in ROOT.glob("quillmesh/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


@pytest.fixture
def graph(tmp_path):
    path = tmp_path / "graph.txt"
    path.write_text("a\nb\nc\nd\n" + "".join(f"{i} {j}\n" for i in range(30) for j in range(i + 1, 30) if (i * 7 + j * 3) % 5 < 2))
    return str(path)


def test_command_line(spark, graph, tmp_path, capsys):
    from quillmesh.__main__ import main

    few = ["--k", "3", "--neighbors", "4", "--mini-batch", "6", "--heldout-ratio", "0.1", "--ppx-interval", "1"]
    assert main(["--file", graph, *few, "--max-iters", "1", "--checkpoint", str(tmp_path / "c"), "--metrics", str(tmp_path / "m")]) == 0
    assert "ppx[0]" in (out := capsys.readouterr().out) and "ppx[1]" in out
    assert main(["--resume", str(tmp_path / "c"), "--max-iters", "1"]) == 0
    assert "ppx[2]" in capsys.readouterr().out
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    assert main(["--file", graph, *few, "--dump", str(tmp_path / "d")]) == 0
    assert main(["--load", str(tmp_path / "d"), *few, "--max-iters", "1", "--no-prefetch"]) == 0
    assert "ppx[1]" in capsys.readouterr().out
