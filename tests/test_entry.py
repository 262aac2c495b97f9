import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql_agree():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 100 and set(o) <= set(q)


def test_nothing_outside_imports_the_corpus_operators():
    for p in (ROOT / "grainmill").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for n in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
            assert not any("llm" in x for x in names), p
