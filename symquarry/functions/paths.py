"""File names, languages, modes and ignore rules as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and extensions by language, and interpreters.
BASENAMES = {"make": ("Makefile", "GNUmakefile", "makefile"), "ruby": ("Rakefile", "Gemfile", "config.ru"), "dockerfile": ("Dockerfile",)}
EXTENSIONS = {
    "ruby": ("rb", "rake", "gemspec"), "bash": ("sh", "bash"), "rust": ("rs",), "erlang": ("erl", "hrl"), "c": ("c", "h"), "make": ("mk",),
    "yaml": ("yml", "yaml"), "markdown": ("md", "markdown"), "dockerfile": ("dockerfile",), "javascript": ("js", "jsx", "mjs", "cjs"),
    "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "python": ("py", "pyi"),
}
INTERPRETERS = {"ruby": ("ruby",), "bash": ("bash", "sh", "dash", "zsh"), "python": ("python",)}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _chosen(value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for lang, names in table.items():
        out = F.when(value.isin(*names), lang).otherwise(out)
    return out


def detect_language(path: Column) -> Column:
    """By file name, then by the extension after the last dot; case matters; null if neither tells."""
    base = basename(path)
    ext = F.when(base.contains("."), F.substring_index(base, ".", -1))
    named = F.coalesce(_chosen(base, BASENAMES), F.when(base.startswith("Dockerfile."), "dockerfile"))
    return F.coalesce(named, _chosen(ext, EXTENSIONS))


def shebang_language(first_line: Column) -> Column:
    """By the interpreter of a ``#!`` line, through env, without a version suffix."""
    words = F.filter(F.split(F.substring(first_line, 3, 1 << 20), r"\s+"), lambda w: w != "")
    first = F.substring_index(F.get(words, F.lit(0)), "/", -1)
    interpreter = F.when(first == "env", F.get(words, F.lit(1))).otherwise(first)
    plain = F.regexp_replace(interpreter, r"[0-9.]+$", "")
    return F.when(first_line.startswith("#!"), _chosen(plain, INTERPRETERS))


def is_regular_file(mode: Column) -> Column:
    """Git modes of regular files; links and submodules are not."""
    return mode.bitwiseAND(0o170000) == 0o100000


def octal(mode: Column) -> Column:
    return F.conv(mode, 8, 10).cast("int")


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: ``*`` and ``?`` stay within a component, ``**`` crosses them."""
    out, i = "", 0
    depth = 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"invalid ignore glob '{glob}'")
            body = glob[i + 1 : end]
            out += "(?!/)[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 1
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"invalid ignore glob '{glob}'")
    return f"^{out}$"


def ignored(path: Column, entries: list[str]) -> Column:
    """Whether a repository-relative path matches an entry: path part, ``glob:`` or ``regex:``."""
    out = F.lit(False)
    for entry in entries:
        if entry.startswith("glob:"):
            out = out | path.rlike(glob_regex(entry[5:]))
        elif entry.startswith("regex:"):
            try:
                re.compile(entry[6:])
            except re.error as e:
                raise ValueError(f"invalid ignore regex '{entry[6:]}'") from e
            out = out | path.rlike(entry[6:])
        elif part := entry.strip("/"):
            out = out | F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{part}/")
    return out
