"""Choosing a hit in a terminal: the feed goes to a picker program, and its answer back to a place in a file.

Only the few rows of a feed and one local file reach the driver; ranking and painting are plans.
"""

from __future__ import annotations

import shlex
import subprocess
import textwrap

from pyspark.sql import DataFrame

from symquarry.functions.names import paint_line
from symquarry.plans import parser, render, search
from symquarry.schema import KINDS
from symquarry.sources.config import PickConfig

#: What a shell reports for a program that was interrupted.
ABORTED = 130
#: Columns 1 to 3 of the feed are for the machine.
ARGUMENTS = ("--delimiter", "\t", "--with-nth", "4,5,6", "--ansi", "--no-sort")


def sigils(width: int = 60) -> str:
    """All kinds with their sigil, in lines of at most ``width`` characters, for help texts."""
    return "\n".join(textwrap.wrap(" ".join(f"@{k}" for k in KINDS), width, break_on_hyphens=False))


def feed(symbols: DataFrame, repos: DataFrame, text: str, config: PickConfig, abbreviations: dict[str, str] | None = None) -> list[str]:
    """Lines of the picker's feed, best first: the landing view for empty input, painted hits otherwise."""
    rows = search.candidates(symbols, repos, text, config.limit, config.landing, abbreviations)
    words = parser.parse(repos, text, abbreviations).words() if text.strip() else []
    return [r.feed for r in render.pick_feed(rows, words, config.match_highlight).collect()]


def pick(symbols: DataFrame, repos: DataFrame, text: str, config: PickConfig, abbreviations: dict[str, str] | None = None, program: str = "fzf") -> tuple[int, str, str | None]:
    """(exit code, key, target): runs the picker over the feed of ``text``.

    The key is one of ``config.expect`` if that ended the choice, else empty. Without a choice the
    target is null and the code that of an interrupted program. A query that doesn't parse is an error before anything runs.
    """
    parser.parse(repos, text, abbreviations)
    command = [program, *ARGUMENTS, *(["--expect", ",".join(config.expect)] if config.expect else []), *config.fzf_args]
    lines = feed(symbols, repos, text, config, abbreviations)
    done = subprocess.run(command, input="\n".join(lines).encode(), stdout=subprocess.PIPE, check=False)
    answer = done.stdout.decode("utf-8", "replace").splitlines()
    key = answer.pop(0) if config.expect and answer else ""
    if not answer:
        return ABORTED, key, None
    return 0, key, target(repos, answer[0])


def target(repos: DataFrame, line: str) -> str | None:
    """``root/path[:line]`` of a line of the feed; null for one without its columns or of an unknown repository."""
    columns = line.split("\t")
    if len(columns) < 3:
        return None
    root = repos.where(repos["name"] == columns[0]).orderBy("id").select("root").first()
    return f"{root.root}/{columns[1]}" + (f":{columns[2]}" if columns[2] else "") if root else None


def highlighted(path: str, template: str) -> list[str] | None:
    """Lines of a file as a highlighter prints them; null if none is set or it fails.

    The command runs in a shell, with the quoted path for ``{file}`` or at its end.
    """
    if not template.strip():
        return None
    quoted = shlex.quote(path)
    command = template.replace("{file}", quoted) if "{file}" in template else f"{template} {quoted}"
    done = subprocess.run(["sh", "-c", command], capture_output=True, check=False)
    return done.stdout.decode("utf-8", "replace").splitlines() if done.returncode == 0 else None


def preview(path: str, line: int | None, config: PickConfig) -> list[str]:
    """Lines of a file, highlighted if that works and else as they are, the chosen one painted."""
    lines = highlighted(path, config.highlighter)
    if lines is None:
        return render.preview_file(path, line, config.highlight)
    return [paint_line(t, config.highlight) if n == line else t for n, t in enumerate(lines, 1)]
