"""Benchmark decontamination: an FM-index per batch of a training shard, searched for benchmark windows.

Words outside the benchmark's vocabulary can't belong to a window: in the indexed text they are
separators, and runs of known words shorter than the shortest window are left out. That changes no
result. Documents stay where they are: there is no shuffle, and a hot passage only lengthens the
occurrence lists of the batches that hold it.

Benchmark items are dealt out into blocks of bounded size in the shared folder. A task reads the
blocks one after the other for each batch of documents and unites what they hit row by row, so
neither the driver nor a task holds more than a block, and the number of blocks changes no result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symquarry.llm.fm_index import FmIndex
from symquarry.llm.store import bounded_batches, new_path, parts, shared_files

WINDOW = 10
#: Bytes of text that one index covers (a longer document has its own).
BATCH_BYTES = 16 << 20
#: Bytes of benchmark text in a block, which a task holds as words and windows.
BLOCK_BYTES = 4 << 20
#: Byte table: ASCII outside 0-9 and a-z becomes a space (after lower-casing).
_SPACED = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_RESULT = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
_TYPE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_SPACED).split()


class Windows:
    """The distinct windows of a block of items, with the items that hold each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        by_length: dict[int, list[np.ndarray]] = {}
        for name, words in items:
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words))
            n = min(window, len(ids))
            views = np.lib.stride_tricks.sliding_window_view(ids, n)
            by_length.setdefault(n, []).append(np.column_stack((views, np.full(len(views), number[name], np.int32))))
        self.shortest = min(by_length, default=1)
        self.phrases: dict[int, np.ndarray] = {}
        #: For each length, where the items of each phrase begin, and the items.
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, stacked in by_length.items():
            rows = np.unique(np.concatenate(stacked), axis=0)
            fresh = np.concatenate(([True], (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)))
            self.phrases[n] = rows[fresh, :-1].astype(np.int64)
            self.held[n] = (np.append(np.flatnonzero(fresh), len(rows)), rows[:, -1])


def _runs(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of known words that a window can fit in."""
    known = np.concatenate(([False], ids > 0, [False]))
    edge = np.flatnonzero(known[1:] != known[:-1])
    start, end = edge[::2], edge[1::2]
    long_ = end - start >= least
    return start[long_], end[long_]


class _Found:
    """Hits of a batch of documents: word counts, hit places and items, united over blocks."""

    def __init__(self, texts: pa.Array):
        self.words = [words_of(doc.as_py()) for doc in texts]
        self.counts = [len(w) for w in self.words]
        self.begin = np.concatenate(([0], np.cumsum(self.counts))).astype(np.int64)
        #: How many hits begin less how many end at each word; a document's last entry is the next one's first.
        self.edges = np.zeros(int(self.begin[-1]) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in self.counts]

    def search(self, windows: Windows) -> None:
        """Indexes the runs of known words and adds what the block's windows hit."""
        find = windows.vocabulary.get
        text, owner, word = array("i", [0]), array("i", [-1]), array("q", [0])
        for number, words in enumerate(self.words):
            ids = np.fromiter(map(find, words, repeat(0)), np.int32, len(words))
            begin = int(self.begin[number])
            for s, e in zip(*_runs(ids, windows.shortest)):
                text.frombytes(ids[s:e].tobytes())
                text.append(0)
                owner.extend(repeat(number, int(e - s) + 1))
                word.extend(range(begin + int(s), begin + int(e) + 1))
        if len(text) == 1:
            return
        symbols, owners, places = np.frombuffer(text, np.int32), np.frombuffer(owner, np.int32), np.frombuffer(word, np.int64)
        index = FmIndex(symbols, len(windows.vocabulary))
        for length, phrases in windows.phrases.items():
            who, at = index.locate(*index.search(phrases))
            np.add.at(self.edges, places[at], 1)
            np.add.at(self.edges, places[at] + length, -1)
            begin, held = windows.held[length]
            for p in np.unique(owners[at].astype(np.int64) * len(phrases) + who).tolist():
                number, phrase = divmod(p, len(phrases))
                self.items[number].update(windows.names[i] for i in held[begin[phrase] : begin[phrase + 1]].tolist())

    def spans(self) -> list[list[dict]]:
        """Merged [start, end) ranges of hit words of each document."""
        hit = np.concatenate(([False], np.cumsum(self.edges[:-1]) > 0, [False]))
        hit_before = hit[1:] != hit[:-1]
        # A hit never crosses a document's end, but two may meet there.
        cut = self.begin[1:-1][hit[self.begin[1:-1]] & hit[self.begin[1:-1] + 1]]
        starts = np.union1d(np.flatnonzero(hit_before & hit[1:]), cut)
        ends = np.union1d(np.flatnonzero(hit_before & hit[:-1]), cut)
        out: list[list[dict]] = [[] for _ in self.counts]
        owners = np.searchsorted(self.begin, starts, side="right") - 1
        for s, e, number in zip(starts.tolist(), ends.tolist(), owners.tolist()):
            begin = int(self.begin[number])
            out[number].append({"start": s - begin, "end": e - begin})
        return out


@lru_cache(maxsize=8)
def _listed(folder: str) -> list[str]:
    fs, base = shared_files(folder)
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.Directory)


def _blocks(folder: str, window: int) -> Iterator[Windows]:
    """The blocks of a benchmark in turn; a worker keeps the last one it read."""
    for path in _listed(folder):
        yield _block(folder, path, window)


@lru_cache(maxsize=1)
def _block(folder: str, path: str, window: int) -> Windows:
    fs, _ = shared_files(folder)
    items = []
    for f in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                table = pq.read_table(source)
            items += zip(table.column("item").to_pylist(), map(words_of, table.column("text").to_pylist()))
    return Windows([(name, words) for name, words in items if words], window)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int, id_col: str, text_col: str) -> str:
    """Writes the items to the shared folder, dealt by hash into blocks of about ``block_bytes`` of text; returns the folder."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("text"))
    items = items.where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    folder = new_path(benchmark.sparkSession, "benchmark")
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    items.repartition(int(min(blocks, 1000)), "block").write.partitionBy("block").parquet(folder)
    return folder


def _all_found(folder: str, window: int, texts: pa.Array) -> _Found:
    found = _Found(texts)
    for block in _blocks(folder, window):
        found.search(block)
    return found


def _scan(folder: str, window: int):
    def run(batches):
        for batch in parts(batches, 4096, BATCH_BYTES):
            found = _all_found(folder, window, batch.column(1))
            items = [sorted(x) for x in found.items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.counts, pa.int64()), pa.array(found.spans(), _TYPE.field(2).type), pa.array(items, _TYPE.field(3).type)],
                schema=_TYPE,
            )

    return run


def _unhit(folder: str, window: int, column: int):
    def run(batches):
        for batch in parts(batches, 4096, BATCH_BYTES):
            items = _all_found(folder, window, batch.column(column).cast(pa.binary())).items
            yield batch.filter(pa.array([not x for x in items], pa.bool_()))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items) for each row of ``docs``.

    spans: merged [start, end) word ranges hit by a window of any item; items: ids of the items
    with a window in the document, sorted as strings. An item shorter than a window is one window,
    one without words none. Null texts have no words. Repeated items count once by id, a null id as
    an empty one; repeated rows are each reported; an empty benchmark hits nothing.
    """
    picked = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(_scan(benchmark_blocks(benchmark, block_bytes, item_col, item_text), window), _RESULT)


def contamination_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from :func:`contamination`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit word, unchanged and in place; contaminated rows go.

    Null and empty texts and repeated clean rows stay; an empty table gives an empty one.
    """
    folder = benchmark_blocks(benchmark, block_bytes, item_col, item_text)
    return bounded_batches(docs).mapInArrow(_unhit(folder, window, docs.columns.index(text_col)), docs.schema)
