import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout) > 300, said.stderr[-500:]


def test_nothing_imports_the_corpus_operators():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert not any(w in p.read_text() for w in ("tessera.llm", ".llm ", "import llm")), p
