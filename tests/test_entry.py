"""The driver contract, with and without the training-data subpackage."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as E

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDDEN = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in %r:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Hide())
sys.path.insert(0, %r)
import __spark_entry__ as e
names = set(e.queries())
assert "readings_labels" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
assert set(e.oracle_sql()) <= names
"""


@pytest.mark.parametrize("absent", [("corpus_pipeline", "wearline.llm"), ("xxhash",), ("public_tokenizers", "wearline.llm.queries", "corpus_pipeline")])
def test_entry_without_the_subpackage_or_what_it_needs(absent):
    subprocess.run([sys.executable, "-c", HIDDEN % (absent, REPO)], check=True, timeout=120)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_flagship(spark):
    assert E.entry(spark).count() == 3
