"""Python by its own parser; files that don't parse fall back to an indentation scan."""

from __future__ import annotations

import ast
import re

from symquarry.extract.base import Symbol

_CONSTANT = re.compile(r"[A-Z0-9_]*[A-Z][A-Z0-9_]*")


def python(text: str) -> list[Symbol]:
    """Classes, functions, methods (directly in a class), and module-level capital names with a value."""
    try:
        tree = ast.parse(text.lstrip("\ufeff"))
    except (SyntaxError, ValueError, RecursionError):
        return _by_indent(text)
    out: list[Symbol] = []

    def walk(node: ast.AST, scope: tuple[str, ...], in_class: bool, top: bool) -> None:
        for child in ast.iter_child_nodes(node):
            joined = ".".join(scope) or None
            if isinstance(child, ast.ClassDef):
                out.append(Symbol(child.lineno, "class", child.name, joined))
                walk(child, (*scope, child.name), True, False)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(Symbol(child.lineno, "method" if in_class else "func", child.name, joined))
                walk(child, (*scope, child.name), False, False)
            elif top and isinstance(child, (ast.Assign, ast.AnnAssign)):
                targets = child.targets if isinstance(child, ast.Assign) else [child.target]
                if child.value is not None:
                    for target in targets:
                        if isinstance(target, ast.Name) and _CONSTANT.fullmatch(target.id):
                            out.append(Symbol(child.lineno, "const", target.id))
            elif not isinstance(child, ast.expr):
                walk(child, scope, in_class, top)

    walk(tree, (), False, True)
    return out


def _by_indent(text: str) -> list[Symbol]:
    out: list[Symbol] = []
    stack: list[tuple[int, str, str]] = []
    for n, line in enumerate(text.split("\n"), 1):
        m = re.match(r"([ \t]*)(?:(class|(?:async[ \t]+)?def)[ \t]+(\w+)|([A-Z0-9_]*[A-Z][A-Z0-9_]*)[ \t]*(?::[^=]+)?=(?!=))", line)
        if not m:
            continue
        indent = len(m[1].expandtabs())
        if m[4] and not indent:
            out.append(Symbol(n, "const", m[4]))
        if m[3]:
            while stack and stack[-1][0] >= indent:
                stack.pop()
            kind = "class" if m[2] == "class" else "method" if stack and stack[-1][1] == "class" else "func"
            out.append(Symbol(n, kind, m[3], ".".join(s[2] for s in stack) or None))
            stack.append((indent, kind, m[3]))
    return out
