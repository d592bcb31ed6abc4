"""The library stands without rookery.llm, and nothing outside names it but the driver's entry."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def imports(path: Path) -> set[str]:
    out = set()
    for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
        if isinstance(node, ast.Import):
            out |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            out |= {node.module, *(f"{node.module}.{a.name}" for a in node.names)}
    return out


def test_nothing_else_imports_llm():
    for path in (ROOT / "rookery").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any(m.startswith("rookery.llm") for m in imports(path)), path


def test_features_do_not_see_labels():
    """What derives features imports neither the truth's evaluation nor the model."""
    for name in ("features", "windows", "tfidf", "blocking"):
        assert not imports(ROOT / f"rookery/operators/{name}.py") & {"rookery.operators.evaluate", "rookery.operators.model"}
