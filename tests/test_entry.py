import os
import subprocess
import sys

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.abspath(e.__file__))


def test_the_entry_query_returns_rows(spark):
    assert e.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_registry_stands_without_the_corpus_operators(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('lodestrata.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'storage_stats' in e.queries() and 'pipeline' not in e.queries() and not any(n.startswith('op') for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
