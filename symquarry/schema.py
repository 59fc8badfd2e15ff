"""Vocabulary and table schemas of the symbol index."""

from __future__ import annotations

SCHEMA_VERSION = "1"

# Kinds in the order of messages, and in the order of ranking.
KINDS = ("class", "module", "method", "smethod", "const", "func", "target", "key", "heading", "image", "arg", "env", "file")
KIND_RANKING = ("class", "module", "file", "method", "func", "smethod", "const", "target", "arg", "heading", "env", "key", "image")
UNKNOWN_RANK = 99

REPOS = "id long, name string, root string, head string, dirty boolean, indexed_at long"
FILES = "id long, repo_id long, path string, path_norm string, mtime_ns long, size long, lang string"
SYMBOLS = "id long, repo_id long, file_id long, line int, kind string, name string, scope string, name_norm string, qual_norm string, path string, path_norm string"
