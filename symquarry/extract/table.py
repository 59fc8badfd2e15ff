"""The table function: file contents in, symbol rows out, in Arrow batches."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symquarry.extract import clike, python, ruby, script, simple, yaml_keys
from symquarry.extract.base import Symbol

EXTRACTORS = {
    "ruby": ruby.ruby, "bash": simple.bash, "rust": clike.rust, "erlang": clike.erlang, "c": clike.c, "make": simple.make, "yaml": yaml_keys.yaml_keys,
    "markdown": simple.markdown, "dockerfile": simple.dockerfile, "javascript": script.javascript, "typescript": script.typescript, "tsx": script.typescript,
    "python": python.python,
}
#: Bytes of contents that Python holds at once; a larger file is a slice of its own.
SLICE_BYTES = 8 << 20
_STRUCT = pa.list_(pa.struct([("line", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("scope", pa.string())]))


def extract(lang: str | None, content: bytes, resolve_yaml: bool = True) -> list[Symbol]:
    """Symbols of one file; an unknown language has none."""
    text = content.decode("utf-8", "replace")
    if lang == "yaml":
        return yaml_keys.yaml_keys(text, resolve_yaml)
    return EXTRACTORS[lang](text) if lang in EXTRACTORS else []


def slices(batches, column: int):
    """Arrow batches in slices of about SLICE_BYTES bytes of one binary column."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, side="right"))
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def extract_symbols(files: DataFrame, *, lang_col: str = "lang", content_col: str = "content", resolve_yaml: bool = True) -> DataFrame:
    """Every symbol of every file: the columns of ``files`` but the content, then ordinal, line, kind, name and scope.

    A file whose extraction fails, or without a language or content, gives no rows; it never fails the run.
    """
    kept = [c for c in files.columns if c != content_col]
    inputs = files.select(*kept, F.col(content_col).cast("binary").alias(content_col))
    lang, content = inputs.columns.index(lang_col), len(kept)
    schema = inputs.select(*kept, F.lit(None).cast("array<struct<line:int,kind:string,name:string,scope:string>>").alias("__symbols")).schema

    def run(batches):
        for batch in slices(batches, content):
            found = []
            for language, data in zip(batch.column(lang).to_pylist(), batch.column(content).to_pylist()):
                try:
                    found.append([s._asdict() for s in extract(language, data, resolve_yaml)] if language and data else [])
                except Exception as e:  # one file never fails a run
                    print(f"extraction failed: {e}", file=sys.stderr)
                    found.append([])
            yield pa.RecordBatch.from_arrays([*batch.columns[:content], pa.array(found, _STRUCT)], names=[*kept, "__symbols"])

    rows = inputs.mapInArrow(run, schema)
    return rows.select(*kept, F.posexplode("__symbols").alias("ordinal", "__s")).select(*kept, "ordinal", "__s.*")
