import ast
import pathlib

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "keelstone").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("keelstone.llm") for n in names), path


def test_entry_gives_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["qid", "id", "score", "rank"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
