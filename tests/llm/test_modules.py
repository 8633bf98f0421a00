"""No module of the operators defines a name twice: the later definition would silently replace the earlier one."""

import ast
from collections import Counter
from pathlib import Path

import slantree.llm


def test_no_definition_is_replaced():
    for path in Path(slantree.llm.__file__).parent.glob("*.py"):
        for scope in [ast.parse(path.read_text()), *(n for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ClassDef))]:
            names = Counter(n.name for n in scope.body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
            assert not [n for n, k in names.items() if k > 1], path.name
