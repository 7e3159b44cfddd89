import ast
from pathlib import Path

ROOT = Path(__file__).parent.parent / "repeatloom"


def test_nothing_outside_imports_the_training_data_operators():
    for f in ROOT.rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n.split(".") for n in names), f


def test_no_local_checkpoint():
    assert not any("localCheckpoint" in f.read_text() for f in ROOT.rglob("*.py"))
