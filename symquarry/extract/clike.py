"""C, Rust and Erlang by scanners over masked code."""

from __future__ import annotations

import re

from symquarry.extract.base import Lines, Symbol, closing, mask

_C_BLIND = re.compile(r"""/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""")
_C_WORDS = frozenset("if for while switch return sizeof do else case defined __attribute__ alignof _Alignof typeof".split())


def c(text: str) -> list[Symbol]:
    """Function definitions, bodied structs, unions and enums, typedef names and macros, by line."""
    code, lines, out = mask(text, _C_BLIND), Lines(text), []
    for m in re.finditer(r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)", code, re.M):
        out.append(Symbol(lines.at(m.start()), "const", m[1]))
    plain = re.sub(r"^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: re.sub(r"[^\n]", " ", m[0]), code, flags=re.M)
    for m in re.finditer(r"\b(?:struct|union|enum)\s+(?:__attribute__\s*\(\(.*?\)\)\s*)?([A-Za-z_]\w*)\s*\{", plain):
        out.append(Symbol(lines.at(m.start()), "class", m[1]))
    for m in re.finditer(r"\btypedef\b", plain):
        end, names, depth, i = len(plain), [], 0, m.end()
        while i < len(plain):
            if plain[i] in "{([":
                i = closing(plain, i, {"{": "{}", "(": "()", "[": "[]"}[plain[i]])
            elif plain[i] == ";":
                end = i
                break
            i += 1
        body = plain[m.end() : end]
        pointer = re.search(r"\(\s*\*+\s*(?:const\s+)?([A-Za-z_]\w*)", re.sub(r"\{[^{}]*\}", "", body))
        if pointer:
            names = [pointer[1]]
        else:
            while re.search(r"\{[^{}]*\}|\([^()]*\)|\[[^\[\]]*\]", body):
                body = re.sub(r"\{[^{}]*\}|\([^()]*\)|\[[^\[\]]*\]", " ", body)
            names = [n[-1] for n in (re.findall(r"[A-Za-z_]\w*", part) for part in body.split(",")) if n]
        out += [Symbol(lines.at(m.start()), "class", n) for n in names]
    depth, last, i = 0, 0, 0
    while i < len(plain):
        ch = plain[i]
        if ch == "{":
            head = plain[last:i]
            f = re.search(r"([A-Za-z_]\w*)\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)[^();=]*$", head)
            linkage = re.search(r'\bextern\s*"[^"]*"\s*$', head)
            if f and f[1] not in _C_WORDS and not re.search(r"\btypedef\b", head):
                start = last + len(head) - len(head.lstrip())
                out.append(Symbol(lines.at(start), "func", f[1]))
                i = closing(plain, i)
                last = i + 1
            elif linkage:
                last = i + 1
            elif not re.search(r"=\s*$", head) and not re.search(r"\b(struct|union|enum)\b", head):
                i = closing(plain, i)
                last = i + 1
            else:
                i = closing(plain, i)
        elif ch in ";}":
            last = i + 1
        i += 1
    return sorted(out, key=lambda s: s.line)


_RUST_BLIND = re.compile(
    r"""(?P<code>'(?:[a-zA-Z_]\w*)\b(?!'))|//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/|b?r(#*)"[\s\S]*?"\2|b?"(?:\\[\s\S]|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'"""
)
_RUST = re.compile(
    r"\b(?:(?P<mod>mod)\s+(?P<m>\w+)\s*(?P<mo>[{;])|(?P<impl>impl)\b(?=\s*[<A-Za-z_&(\[!:])|(?P<type>struct|enum|union|trait|type)\s+(?P<t>[A-Za-z_]\w*)"
    r"|(?P<val>const|static)\s+(?:mut\s+)?(?P<c>[A-Za-z_]\w*)\s*:|macro_rules!\s*(?P<mac>\w+)|fn\s+(?P<f>\w+))|(?P<b>[{}])"
)


def rust(text: str) -> list[Symbol]:
    """Modules, types, constants, macros and functions; methods stand directly in an impl."""
    code, lines, out = mask(text, _RUST_BLIND), Lines(text), []
    stack: list[tuple[str, str | None]] = []  # what each open brace belongs to
    pos = 0

    def scope() -> str | None:
        return "::".join(n for k, n in stack if k in ("mod", "impl") and n) or None

    while m := _RUST.search(code, pos):
        pos = m.end()
        at = lines.at(m.start())
        if m["b"] == "{":
            stack.append(("block", None))
        elif m["b"]:
            if stack:
                stack.pop()
        elif m["mod"]:
            out.append(Symbol(at, "module", m["m"], scope()))
            if m["mo"] == "{":
                stack.append(("mod", m["m"]))
        elif m["impl"]:
            if stack and stack[-1][0] == "fnhead":
                continue
            brace = code.find("{", pos)
            if brace < 0:
                break
            head = code[pos:brace]
            if re.match(r"\s*<", head):
                head = head[_angle(head, head.index("<")) :]
            head = re.split(r"\bwhere\b", head)[0]
            name = re.split(r"\bfor\b(?!\s*<)", head)[-1].strip()
            if ";" in head or not name:
                continue
            stack.append(("impl", re.sub(r"<[\s\S]*", "", name).strip().lstrip("&").strip()))
            pos = brace + 1
        elif m["type"]:
            inside_impl = stack and stack[-1][0] == "impl"
            if m["type"] == "union" and not re.match(r"\s*(?:<|\{|where)", code[m.end() :]):
                continue
            out.append(Symbol(at, "class", m["t"], scope()))
            if m["type"] == "type" or inside_impl and m["type"] == "type":
                end = code.find(";", pos)
                pos = end if end >= 0 else pos
        elif m["val"]:
            if m["c"] != "_" and not (stack and stack[-1][0] == "params"):
                out.append(Symbol(at, "const", m["c"], scope()))
        elif m["mac"]:
            out.append(Symbol(at, "func", m["mac"], scope()))
            opened = re.compile(r"[({\[]").search(code, pos)
            if opened:
                pos = closing(code, opened.start(), {"(": "()", "{": "{}", "[": "[]"}[opened[0]]) + 1
        else:
            end, i, depth = None, pos, 0
            while i < len(code):
                if code[i] in "([":
                    depth += 1
                elif code[i] in ")]":
                    depth -= 1
                elif not depth and code[i] in "{;":
                    end = i
                    break
                i += 1
            if end is not None and code[end] == "{":
                kind = "method" if stack and stack[-1][0] == "impl" else "func"
                out.append(Symbol(at, kind, m["f"], scope()))
                stack.append(("fn", None))
                pos = end + 1
            elif end is not None:
                pos = end + 1
    return out


def _angle(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "<") - (text[i] == ">" and text[i - 1] != "-")
        if not depth:
            return i + 1
    return len(text)


_ERL_BLIND = re.compile(r"""%[^\n]*|"(?:\\[\s\S]|[^"\\])*"|\$\\?.""")
_ATOM = r"(?:[a-z][\w@]*|'(?:\\.|[^'\\\n])*')"


def _arity(code: str, opened: int) -> int:
    end, depth, commas = closing(code, opened, "()"), 0, 0
    body = code[opened + 1 : end]
    for ch in body:
        depth += (ch in "([{") - (ch in ")]}")
        commas += ch == "," and not depth
    return commas + 1 if body.strip() else 0


def erlang(text: str) -> list[Symbol]:
    """Module, records, types, macros, and each function of a name and arity at its first clause."""
    code, lines, out, seen = mask(text, _ERL_BLIND), Lines(text), [], set()
    start = 0
    for end in [m.end() for m in re.finditer(r"\.(?=\s|\Z)", code)] + [len(code)]:
        form, lead = code[start:end], start
        lead += len(form) - len(form.lstrip())
        form = form.strip()
        start = end
        if m := re.match(rf"-\s*module\s*\(\s*({_ATOM})", form):
            out.append(Symbol(lines.at(lead), "module", m[1]))
        elif m := re.match(rf"-\s*record\s*\(\s*({_ATOM})", form):
            out.append(Symbol(lines.at(lead), "class", m[1]))
        elif m := re.match(rf"-\s*(?:type|opaque|nominal)\s+({_ATOM})\s*\(", form):
            out.append(Symbol(lines.at(lead), "class", m[1]))
        elif m := re.match(r"-\s*define\s*\(\s*([A-Za-z_]\w*)", form):
            out.append(Symbol(lines.at(lead), "const", m[1]))
        elif m := re.match(rf"({_ATOM})\s*\(", form):
            key = m[1], _arity(form, m.end() - 1)
            if key not in seen:
                seen.add(key)
                out.append(Symbol(lines.at(lead), "func", m[1]))
    return out
