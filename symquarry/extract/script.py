"""JavaScript and TypeScript by a scanner over masked code."""

from __future__ import annotations

import re

from symquarry.extract.base import Lines, Symbol, closing, mask

_BLIND = re.compile(
    r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`|(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[dgimsuvy]*"""
)
_ID = r"[A-Za-z_$][\w$]*"
_DECL = re.compile(
    rf"(?P<b>[{{}}])|(?<![\w$.])(?:(?P<cls>(?:abstract\s+)?class)\s+(?P<c>{_ID})|(?P<fn>(?:async\s+)?function\s*\*?)\s*(?P<f>{_ID})\s*(?=[<(])"
    rf"|(?P<bind>const|let|var)\s+(?=[\w$\[{{])|(?P<ts>interface|enum|type)\s+(?P<t>{_ID})(?=\s*[<{{=]|\s+extends\b)|(?P<ns>namespace|module)\s+(?P<n>[\w$.]+|[\"'][^\"'\n]*[\"'])\s*(?=\{{))"
)
_MEMBER = re.compile(
    rf"(?:(?:public|private|protected|static|readonly|abstract|override|declare|async|get|set|accessor)\s+(?=[\w$\[#*\"']))*\*?\s*(?P<m>#?{_ID}|\"[^\"\n]*\"|'[^'\n]*')\s*\??\s*(?=[<(])"
)
_LITERAL = re.compile(r"[\"'`{\[/]|-?\d|\.\d|(?:true|false|null|undefined)\s*(?:;|,|\n|$|as\b)")
_NOT_MEMBER = frozenset("if for while switch catch return new function".split())


def javascript(text: str) -> list[Symbol]:
    """Classes, their methods, functions, and top-level bindings to functions or literal constants."""
    return _Scanner(text, typed=False).run()


def typescript(text: str) -> list[Symbol]:
    """As JavaScript, with interfaces, type aliases, enums, namespaces and signatures."""
    return _Scanner(text, typed=True).run()


class _Scanner:
    def __init__(self, text: str, typed: bool):
        self.raw, self.code, self.lines, self.typed = text, mask(text, _BLIND), Lines(text), typed
        self.out: list[Symbol] = []

    def run(self) -> list[Symbol]:
        self.block(0, len(self.code), None, True)
        return self.out

    def add(self, at: int, kind: str, name: str, scope: str | None) -> None:
        self.out.append(Symbol(self.lines.at(at), kind, name, scope))

    def block(self, pos: int, end: int, scope: str | None, top: bool) -> None:
        """Statements of a block; ``top``: bindings count here."""
        code, depth = self.code, 0
        while m := _DECL.search(code, pos, end):
            pos = m.end()
            if m["b"]:
                depth += 1 if m["b"] == "{" else -1
            elif m["cls"]:
                brace = self.body(pos, end)
                self.add(m.start(), "class", m["c"], scope)
                if brace is not None:
                    stop = closing(code, brace)
                    self.members(brace + 1, min(stop, end), m["c"] if not self.typed or not scope else f"{scope}.{m['c']}")
                    pos = stop + 1
            elif m["fn"]:
                self.add(m.start(), "func", m["f"], scope)
                stop = self.after_head(pos, end)
                if stop is not None:
                    self.block(stop + 1, min(closing(code, stop), end), scope, False)
                    pos = closing(code, stop) + 1
            elif m["bind"]:
                pos = self.bindings(m, pos, end, scope, top and depth == 0)
            elif m["ts"]:
                if self.typed and self.statement_start(m.start()):
                    self.add(m.start(), "class", m["t"], scope)
                    if m["ts"] != "type":
                        brace = self.body(pos, end)
                        pos = closing(code, brace) + 1 if brace is not None else pos
                    else:
                        pos = self.skip(pos, end)
            elif m["ns"] and self.typed:
                name = self.raw[m.start("n") : m.end("n")].strip("\"'")
                brace = code.index("{", pos)
                self.add(m.start(), "module", name, scope)
                stop = closing(code, brace)
                self.block(brace + 1, min(stop, end), f"{scope}.{name}" if scope else name, True)
                pos = stop + 1

    def statement_start(self, at: int) -> bool:
        before = self.code[:at].rstrip()
        return not before or before[-1] in ";{}\n)" or re.search(r"\b(?:export|declare|default|const)$", before) is not None or "\n" in self.code[len(before) : at]

    def body(self, pos: int, end: int) -> int | None:
        """The brace that opens a class or interface body, past type arguments."""
        depth = 0
        for i in range(pos, end):
            ch = self.code[i]
            depth += (ch in "(<[") - (ch in ")]" or (ch == ">" and self.code[i - 1] != "="))
            if ch == "{" and depth <= 0:
                return i
            if ch == ";" and depth <= 0:
                return None
        return None

    def after_head(self, pos: int, end: int) -> int | None:
        """The brace that opens the body after a parameter list; None for a signature."""
        opened = self.code.find("(", pos, end)
        if opened < 0:
            return None
        i, angle = closing(self.code, opened, "()") + 1, 0
        typed = False
        while i < end:
            ch = self.code[i]
            if ch == "{":
                if typed and re.search(r"[:|&,<]\s*$", self.code[:i][-40:]):
                    i = closing(self.code, i)
                elif angle <= 0:
                    return i
            elif ch in "([":
                i = closing(self.code, i, "()" if ch == "(" else "[]")
            elif ch == ":":
                typed = True
            elif ch in "<>":
                angle += 1 if ch == "<" else -(self.code[i - 1] != "=")
            elif ch == ";" or ch == "}" or (ch == "\n" and self.typed and angle <= 0 and re.match(r"\s*(?:[\w$@#}\[]|$)", self.code[i + 1 : i + 80]) and not self.code[:i].rstrip().endswith((":", "|", "&", "=>", ")")) and typed):
                return None
            i += 1
        return None

    def members(self, pos: int, end: int, owner: str) -> None:
        """Methods that stand directly in a class body."""
        code = self.code
        while pos < end:
            ch = code[pos]
            if ch == "@":
                m = re.compile(rf"@[\w$.]+\s*").match(code, pos)
                pos = m.end() if m else pos + 1
                if pos < end and code[pos] == "(":
                    pos = closing(code, pos, "()") + 1
                continue
            m = _MEMBER.match(code, pos, end) if re.match(r"[\w$#*\"']", ch) else None
            if m and m["m"] not in _NOT_MEMBER:
                name = self.raw[m.start("m") : m.end("m")]
                stop = self.after_head(m.end(), end)
                signature = stop is None
                if not signature or self.typed:
                    self.add(pos, "method", name, owner)
                if stop is not None:
                    close = closing(code, stop)
                    self.block(stop + 1, min(close, end), None, False)
                    pos = close + 1
                else:
                    pos = closing(code, code.index("(", m.end() - 1), "()") + 1
                    pos = self.skip(pos, end)
            elif re.match(r"[\w$#*\"']", ch):
                m = re.compile(r"(?:static\s*)?\{").match(code, pos)
                pos = closing(code, m.end() - 1) + 1 if m else self.skip(pos, end)
            elif ch in "{[(":
                pos = closing(code, pos, {"{": "{}", "[": "[]", "(": "()"}[ch]) + 1
            else:
                pos += 1

    def skip(self, pos: int, end: int) -> int:
        """Past one declaration: to its semicolon, or to a line end outside brackets that nothing continues."""
        code = self.code
        while pos < end:
            ch = code[pos]
            if ch in "{[(":
                pos = closing(code, pos, {"{": "{}", "[": "[]", "(": "()"}[ch])
            elif ch == ";" or ch == "}":
                return pos + (ch == ";")
            elif ch == "\n":
                after = code[pos + 1 : end].lstrip()
                if not re.search(r"(?:=>|[=+\-*/%&|^?:,<.]|\b(?:extends|as|in|of|typeof|instanceof|new|await))\s*$", code[max(0, pos - 30) : pos]) and not re.match(r"(?:[.?:+*/%&|^,=)\]]|-(?!-)|<(?!/)|(?:as|in|instanceof|extends)\b)", after):
                    return pos + 1
            pos += 1
        return end

    def bindings(self, m: re.Match, pos: int, end: int, scope: str | None, count: bool) -> int:
        """The declarators of a binding; initialisers are never searched."""
        code = self.code
        while True:
            d = re.compile(rf"\s*(?P<name>{_ID})\s*").match(code, pos, end)
            if not d:
                return self.skip(pos, end)
            i = d.end()
            if i < end and code[i] in "!:":
                i = self.annotation(i + 1, end)
            stop = self.declarator_end(i, end)
            if i < end and code[i] == "=" and code[i + 1 : i + 2] != "=" and count:
                value, written = code[i + 1 : stop].lstrip(), self.raw[i + 1 : stop].lstrip()
                line_at = m.start() if pos == m.end() else d.start("name")
                if re.match(rf"(?:async\s+)?(?:function\b|(?:<[^=]*>\s*)?\(|{_ID}\s*=>)", value) and self.is_function(value):
                    self.add(line_at, "func", d["name"], scope)
                elif m["bind"] == "const" and _LITERAL.match(written + "\n") and self.is_literal(value):
                    self.add(line_at, "const", d["name"], scope)
            if stop < end and code[stop] == ",":
                pos = stop + 1
                continue
            return stop

    def annotation(self, pos: int, end: int) -> int:
        code, depth = self.code, 0
        while pos < end:
            ch = code[pos]
            if ch in "{[(":
                pos = closing(code, pos, {"{": "{}", "[": "[]", "(": "()"}[ch])
            elif ch == "=" and code[pos + 1 : pos + 2] == ">":
                pos += 1
            elif ch in "=;" and depth <= 0:
                return pos
            elif ch in "<>":
                depth += 1 if ch == "<" else -1
            elif ch == "," and depth <= 0:
                return pos
            pos += 1
        return end

    def declarator_end(self, pos: int, end: int) -> int:
        stop = self.skip(pos, end)
        code, i = self.code, pos
        generic = re.compile(r"=\s*(?:async\s*)?<[^=()]*>(?=\s*\()").match(code, pos, stop) if self.typed else None
        i = generic.end() if generic else i
        while i < stop:
            if code[i] in "{[(":
                i = closing(code, i, {"{": "{}", "[": "[]", "(": "()"}[code[i]])
            elif code[i] == ",":
                return i
            i += 1
        return stop

    def is_function(self, value: str) -> bool:
        if re.match(r"(?:async\s+)?function\b", value):
            return True
        arrow = re.match(rf"(?:async\s+)?{_ID}\s*=>", value)
        if arrow:
            return True
        opened = value.index("(")
        rest = value[closing(value, opened, "()") + 1 :].lstrip()
        return rest.startswith("=>") or (self.typed and rest.startswith(":") and "=>" in rest)

    def is_literal(self, value: str) -> bool:
        """The value is one literal, not an expression that begins with one."""
        value = value.rstrip().rstrip(";").rstrip()
        if not value:
            return True  # a pattern literal, which is masked
        if value[0] in "{[":
            rest = value[closing(value, 0, "{}" if value[0] == "{" else "[]") + 1 :].strip()
        elif value[0] in "\"'`":
            rest = value[value.index(value[0], 1) + 1 :].strip() if value.count(value[0]) > 1 else ""
        else:
            rest = re.sub(r"^(?:[\d.][\w.]*|true\b|false\b|null\b|undefined\b)", "", value).strip()
        return rest == ""
