import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).parent.parent


def test_entry_gives_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["n_rows", "n_bytes"] and df.first().n_rows == 1500


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_corpus_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "blockloom"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "blockloom" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'csv_bz2_scan' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})


def test_tests_pass_without_the_corpus_folders(tmp_path):
    """With the subpackage, the pipeline and their tests gone, the other tests run; a few of each file stand for all."""
    for name in ("__spark_entry__.py", "blockloom", "tests", "bench.py"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "blockloom" / "llm"), str(tmp_path / "tests" / "llm")], check=True)
    chosen = "vectors or resolve or every_oracle or entry_gives or checksums or (duckdb and (csv_bz2_scan or parallel_ranges or error_names))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-k", chosen, "tests"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]
    assert "error" not in run.stdout.splitlines()[-1]


def test_command_line(tmp_path, spark):
    import bz2

    (tmp_path / "a.bz2").write_bytes(bz2.compress(b"one\ntwo\n" * 30_000, 1))
    out = subprocess.run([sys.executable, "-m", "blockloom", "cat", str(tmp_path / "a.bz2")], cwd=REPO, capture_output=True, check=True)
    assert out.stdout == b"one\ntwo\n" * 30_000
    out = subprocess.run([sys.executable, "-m", "blockloom", "cat"], cwd=REPO, input=bz2.compress(b"x"), capture_output=True, check=True)
    assert out.stdout == b"x"
    out = subprocess.run([sys.executable, "-m", "blockloom", "report", str(tmp_path / "a.bz2")], cwd=REPO, capture_output=True, check=True, text=True)
    assert "240000 bytes, 60000 lines, parallel" in out.stdout and "MB/s" in out.stdout and "  one\n  two\n  one" in out.stdout
