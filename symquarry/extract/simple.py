"""Line-oriented languages: Markdown, Make, Dockerfile and shell."""

from __future__ import annotations

import re

from symquarry.extract.base import Lines, Symbol, mask

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_NOT_PARAGRAPH = re.compile(r" {0,3}(?:#{1,6}(?:\s|$)|>|[-*+]\s|\d{1,9}[.)]\s|(?:[-*_][ \t]*){3,}$|<)|(?: {4}|\t)|\|")


def markdown(text: str) -> list[Symbol]:
    """ATX and setext headings, trimmed; empty ones and fenced code don't count."""
    out, fence, paragraph = [], None, []
    for n, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        f = _FENCE.match(line)
        if fence:
            if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not f[2].strip():
                fence = None
            continue
        if f and not (f[1][0] == "`" and "`" in f[2]):
            fence, paragraph = f[1], []
            continue
        if m := _ATX.match(line):
            name = (m[2] or "").strip()
            if name.strip("#"):
                out.append(Symbol(n, "heading", name))
            paragraph = []
        elif paragraph and _SETEXT.match(line):
            if name := "\n".join(t.strip() for _, t in paragraph).strip():
                out.append(Symbol(paragraph[0][0], "heading", name))
            paragraph = []
        elif not line.strip() or (not paragraph and _NOT_PARAGRAPH.match(line)):
            paragraph = []
        else:
            paragraph.append((n, line))
    return out


def _logical_lines(text: str):
    """(first line number, line) with continued lines joined."""
    held, first = "", None
    for n, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        first = n if first is None else first
        if line.endswith("\\"):
            held += line[:-1] + " "
            continue
        yield first, held + line
        held, first = "", None
    if held:
        yield first, held


_ASSIGN = re.compile(r"\s*(?:(?:export|override|private|unexport)\s+)*([^\s:#=+?!]+)\s*(?:::?:?=|\?=|\+=|!=|=)")
_RULE = re.compile(r"([^\t#=:][^#=:]*?)\s*&?::?(?!=)")


def make(text: str) -> list[Symbol]:
    """Words of a rule's targets, and variables by any assignment; special and pattern targets don't count."""
    out, defining = [], False
    for n, line in _logical_lines(text):
        if defining:
            defining = not re.match(r"\s*endef\b", line)
            continue
        if line.startswith("\t") or not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.match(r"\s*(?:override\s+)?define\s+([^\s=:+?!]+)", line):
            defining = True
            out.append(Symbol(n, "env", m[1]))
        elif m := _ASSIGN.match(line):
            out.append(Symbol(n, "env", m[1]))
        elif (m := _RULE.match(line)) and not re.match(r"\s*(?:-?include|sinclude|ifn?eq|ifn?def|else|endif|vpath)\b", line):
            out += [Symbol(n, "target", t) for t in m[1].split() if "%" not in t and not re.fullmatch(r"\.[A-Z_]+", t)]
    return out


def dockerfile(text: str) -> list[Symbol]:
    """FROM images as written, ARG names and every ENV name."""
    out = []
    held: list[tuple[int, str]] = []
    for n, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        if line.lstrip().startswith("#") or (held and not line.strip()):
            continue
        held.append((n, line.rstrip("\\") if line.endswith("\\") else line))
        if line.endswith("\\"):
            continue
        out += _instruction(held)
        held = []
    return out + (_instruction(held) if held else [])


def _instruction(held: list[tuple[int, str]]) -> list[Symbol]:
    m = re.match(r"\s*([A-Za-z]+)\s+(.*)$", held[0][1])
    if not m:
        return []
    word, parts = m[1].upper(), [(held[0][0], m[2]), *held[1:]]
    whole = " ".join(p for _, p in parts)
    if word == "FROM":
        image = re.sub(r"^(?:--\S+\s+)+", "", whole.strip()).split()
        return [Symbol(held[0][0], "image", image[0])] if image else []
    if word == "ARG":
        return [Symbol(n, "arg", a) for n, p in parts for a in re.findall(r"(?:^|\s)([A-Za-z_]\w*)(?==|\s|$)", _unquoted(p))]
    if word == "ENV":
        first = whole.split()
        if first and "=" not in first[0]:
            return [Symbol(held[0][0], "env", first[0])]
        return [Symbol(n, "env", a) for n, p in parts for a in re.findall(r"(?:^|\s)([A-Za-z_][\w.-]*)=", _unquoted(p))]
    return []


def _unquoted(text: str) -> str:
    return re.sub(r'"(?:\\.|[^"\\])*"|\'[^\']*\'', '""', text)


_SHELL_BLIND = re.compile(r"""\\.|'[^']*'|"(?:\\.|[^"\\])*"|(?<![^\s;&|(])#[^\n]*|<<-?\s*(['"]?)(\w+)\1[^\n]*\n(?:.*\n)*?[ \t]*\2(?=\n|$)""")
_SHELL = re.compile(
    r"(?P<fn>(?:^|(?<=[;&|\n{(]))[ \t]*(?:function[ \t]+(?P<f1>[^\s(){};&|]+)(?:[ \t]*\([ \t]*\))?|(?P<f2>[^\s(){};&|=$\"']+)[ \t]*\([ \t]*\))\s*(?P<open>[{(]))"
    r"|(?P<var>(?:^|(?<=[\s;&|({]))(?P<name>[A-Za-z_]\w*)(?:\[[^\]\n]*\])?\+?=(?!=))|(?P<b>[{}])",
    re.M,
)


def bash(text: str) -> list[Symbol]:
    """Functions in both forms, and variables assigned outside of functions."""
    code, lines = mask(text, _SHELL_BLIND), Lines(text)
    out, depth, inside = [], 0, []
    for m in _SHELL.finditer(code):
        if m["fn"]:
            name = m["f1"] or m["f2"]
            out.append(Symbol(lines.at(m.start("f1") if m["f1"] else m.start("f2")), "func", name))
            if m["open"] == "{":
                depth += 1
                inside.append(depth)
        elif m["var"]:
            if not inside:
                out.append(Symbol(lines.at(m.start("name")), "env", m["name"]))
        elif m["b"] == "{":
            depth += m.start() == 0 or code[m.start() - 1] != "$"
        elif depth and not _in_expansion(code, m.start()):
            if inside and inside[-1] == depth:
                inside.pop()
            depth -= 1
    return out


def _in_expansion(code: str, at: int) -> bool:
    start = code.rfind("${", max(0, code.rfind("\n", 0, at)), at)
    return start >= 0 and "}" not in code[start:at]
