"""Ruby by an indentation-free scanner of block openers and ends."""

from __future__ import annotations

import re

from symquarry.extract.base import Symbol

_NAME = r"[A-Za-z_]\w*[?!=]?"
_BLIND = re.compile(r"""(?<![\w?])\?\\?\S(?!\w)|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|(?<=[\s(,=~])/(?![\s=])(?:\\.|[^/\\\n])+/[imxounse]*|%[qQwWiI]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})|(?:(?<=\s)|^)#.*""")
_OPENER = re.compile(r"(?:^|[;=(,|&\[{]|\breturn\b|\bthen\b|\belse\b|\bdo\b)\s*(?:if|unless|case|begin|while|until|for)\b|\bdo\b(?!\s*:)(?=\s*(?:\||$|;|#|\S))")
_HEREDOC = re.compile(r"<<([~-]?)(['\"`]?)([A-Za-z_]\w*)\2")


def ruby(text: str) -> list[Symbol]:
    """Classes, modules, methods, plain constants and attributes, with the written names of their scopes."""
    out: list[Symbol] = []
    stack: list[tuple[str, str | None]] = []
    until: list[str] = []
    comment = False
    for n, raw in enumerate(text.split("\n"), 1):
        if raw.startswith("=begin") or comment:
            comment = not raw.startswith("=end")
            continue
        if until:
            if raw.strip() == until[0]:
                until.pop(0)
            continue
        if raw.startswith("__END__"):
            break
        until += [m[3] for m in _HEREDOC.finditer(raw) if m[1] or m[3].isupper()]
        line = _BLIND.sub(lambda m: " " if m[0].startswith("#") else '""', raw)
        for part in re.split(r";", line):
            _statement(part, n, stack, out)
    return out


def _scope(stack: list[tuple[str, str | None]]) -> str | None:
    return "::".join(name for kind, name in stack if kind in ("class", "module") and name) or None


def _statement(part: str, n: int, stack: list, out: list[Symbol]) -> None:
    s = part.strip()
    opened = False
    if m := re.match(r"class\s*<<\s*(\S+)", s):
        stack.append(("singleton", None))
        opened = True
    elif m := re.match(r"(class|module)\s+((?:::)?[A-Z]\w*(?:::[A-Z]\w*)*)", s):
        out.append(Symbol(n, m[1], m[2], _scope(stack)))
        stack.append((m[1], m[2]))
        opened = True
    elif m := re.match(rf"(?:(?:private|protected|public|module_function|private_class_method|memoize)\s+)?def\s+(?:(self)\s*\.\s*|([A-Za-z_]\w*)\s*\.\s*)?({_NAME}|[^\s(\w]+)", s):
        near = next((k for k, _ in reversed(stack) if k in ("class", "module", "singleton")), None)
        name = m[3]
        if name.endswith("=") and re.match(r"=\s", s[m.end(3) - 1 :]) and not s[m.end(3) :].startswith("("):
            name = name[:-1]
        if not m[2]:
            kind = "smethod" if m[1] or near == "singleton" else "method"
            out.append(Symbol(n, kind, name, _scope(stack)))
        rest = s[m.start(3) + len(name) :]
        endless = re.match(r"\s*(?:\([^)]*\))?\s*=(?![=~])", rest)
        if not endless:
            stack.append(("def", None))
            opened = True
    else:
        if m := re.match(r"([A-Z]\w*)\s*(?:\|\||&&)?=(?![=~>])", s):
            out.append(Symbol(n, "const", m[1], _scope(stack)))
        if m := re.match(r"(?:(?:private|protected|public)\s+)?attr_(?:accessor|reader|writer)\b\s*\(?(.*)", s):
            out.extend(Symbol(n, "method", a, _scope(stack)) for a in re.findall(r"(?<!:):([A-Za-z_]\w*[?!]?)", m[1]))
        for _ in _OPENER.finditer(re.sub(r"\b(?:while|until|for)\b(.*)\bdo\b", r"while\1", s) if re.match(r"(?:while|until|for)\b", s) else s):
            stack.append(("block", None))
    ends = len(re.findall(r"(?<![.\w:])end(?![\w?!:])", s))
    if opened and not ends and re.search(r"(?<!\w)do\b", s) and not s.startswith(("class", "module", "def")):
        stack.append(("block", None))
    for _ in range(min(ends, len(stack))):
        stack.pop()
