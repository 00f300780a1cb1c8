"""The entry point, and what may import what."""

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_registered():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 150 and set(sql) <= set(queries) and all(map(callable, queries.values()))


def test_flagship(spark):
    if Path("/root/testdata/sf0.001").exists():
        got = __spark_entry__.entry(spark)
        assert got.columns == ["image_id", "c0", "n"] and got.count() > 0


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "rasterloom").rglob("*.py"):
        if path.parent.name != "llm":
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", path.read_text(), re.M), path
