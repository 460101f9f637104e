import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract
from caselattice import plans


def test_every_sql_has_a_query_and_the_core_stands_alone():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    core = Path(plans.__file__).resolve().parents[1]
    for path in core.rglob("*.py"):
        if "llm" not in path.relative_to(core).parts:
            assert not re.search(r"(?:from|import)[ .\w]*\bllm\b|import_module\(.*llm", path.read_text()), path


def test_the_core_is_listed_without_a_library_of_the_optional_part():
    code = "import sys; sys.modules['tokenizers'] = None; sys.modules['ahocorasick'] = None; sys.modules['numpy.nothing'] = None\nimport __spark_entry__ as e, caselattice\nsys.modules['caselattice.llm'] = None\nprint(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=str(Path(contract.__file__).parent), capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0 and int(done.stdout) == len(plans.queries()), done.stderr[-500:]


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
    assert sys.version_info >= (3, 10)


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = str(Path(contract.__file__).parent)
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr[-500:]
