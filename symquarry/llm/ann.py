"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one full-dimensional word from each of several codebooks,
found by a beam search over the codebooks, and kept as one byte a codebook plus the norm of the sum.
A query makes one table of inner products with all words; a row's score is a sum of table entries
over its norm. The best rows of each batch are scored again with the exact cosine.

The words of the first codebook are coarse cells as well: the index lies in the order of cells, and
a query is scored against the rows of its ``probes`` nearest cells only.

Codebooks are fitted on a bounded sample (``sample_rows``); every row is indexed. Equal vectors are
one index row with their smallest ids, so that a vector held by a third of all rows costs one.
Queries lie in blocks in the shared folder; one pass over the index reads them block by block.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symquarry.llm.store import new_path, shared_files, shuffle_partitions, written

#: Codebooks and the words in each (a byte); beams kept while encoding.
BOOKS, WORDS, BEAM = 8, 256, 8
#: Cells that a query looks into (all: fewer lose neighbours among vectors without clusters, see the README),
#: rows of a batch that are scored exactly, queries of a block, rows of a batch.
PROBES, RERANK, BLOCK, BATCH = WORDS, 400, 256, 8192


class Codebooks:
    """Residual codebooks over unit vectors."""

    def __init__(self, sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 11):
        rng = np.random.default_rng(seed)
        rest, fitted = sample.astype(np.float64), []
        for _ in range(books):
            words_now = min(words, len(rest))
            centres = rest[rng.choice(len(rest), words_now, replace=False)].copy()
            for _ in range(12):
                near = _nearest(rest, centres)
                sums = np.zeros_like(centres)
                np.add.at(sums, near, rest)
                many = np.bincount(near, minlength=words_now)
                centres[many > 0] = sums[many > 0] / many[many > 0, None]
            rest = rest - centres[_nearest(rest, centres)]
            fitted.append(np.vstack((centres, np.zeros((words - words_now, centres.shape[1])))))
        self.books = np.array(fitted, np.float32)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norms of the sums): a beam search that keeps the ``beam`` best partial sums."""
        n, dim = x.shape
        rest, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            kept = rest.shape[1]
            # |rest - word|^2 without |rest|^2 would not compare across beams: keep it.
            d = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
            d = d.reshape(n, kept * len(book))
            take = min(beam, d.shape[1])
            best = np.argpartition(d, take - 1, axis=1)[:, :take]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1)
            parent, word = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
            codes = np.concatenate((np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)), axis=2)
        norms = np.linalg.norm(x - rest[:, 0], axis=1)
        return codes[:, 0], np.maximum(norms, 1e-12).astype(np.float32)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(query, book, word): inner products."""
        return np.einsum("qd,bwd->qbw", queries.astype(np.float32), self.books)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    size = (centres**2).sum(1)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmin(size - 2 * x[i : i + 4096] @ centres.T, axis=1)
    return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(-1, dim)


def valid(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _gathered(batches, rows: int):
    """Batches joined to about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _encoder(books: Codebooks, dim: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _vectors(part.column(1), dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                codes, norms = books.encode(x)
                columns = [part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(_nearest(x, books.books[0]), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "vector", "codes", "norm", "cell"])

    return run


def build_index(rows: DataFrame, k: int, *, sample_rows: int = 20_000, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Codebooks | None, int]:
    """(index table, codebooks, dimensions) over every valid row.

    Index: ids (the k + 1 smallest of equal vectors), vector, codes, norm, cell, in the order of
    cells. Vectors of another length than the one that most have can't be compared and take no part.
    """
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = good.where(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    lengths = good.select(F.size("vector").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return good, None, 0
    dim = lengths[0].d
    good = good.where(F.size("vector") == dim).distinct()
    # The k + 1 smallest ids of each vector: the rank limit is applied before the shuffle as well.
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    equal = good.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    equal = written(equal.select("ids", "vector"), "ann-vectors")
    n = equal.count()
    share = int(1_000_000 * min(1.0, sample_rows / max(n, 1)))
    picked = equal.where(F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1_000_000)) < max(share, 1)).select("vector").limit(2 * sample_rows)
    sample = _vectors(_column(picked.toArrow().combine_chunks(), "vector"), dim)
    if not len(sample):
        sample = _vectors(_column(equal.select("vector").limit(1).toArrow().combine_chunks(), "vector"), dim)
    sample = sample[np.lexsort(sample.T[::-1])]
    books = Codebooks(sample / np.linalg.norm(sample, axis=1, keepdims=True), seed=seed)
    schema = "ids array<long>, vector array<double>, codes binary, norm float, cell int"
    index = equal.mapInArrow(_encoder(books, dim), schema)
    order = [F.col("cell"), F.xxhash64("codes")]
    ranged = index.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions("cell")
    return written(ranged, "ann-index"), books, dim


class _Queries:
    """A block of queries: unit vectors, tables of inner products, and who looks into each cell."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, books: Codebooks, probes: int):
        self.ids, self.vectors, self.lengths = ids, vectors, np.linalg.norm(vectors, axis=1)
        unit = vectors / self.lengths[:, None]
        self.tables = books.tables(unit)
        cells = books.books[0].astype(np.float64)
        far = (cells**2).sum(1) - 2 * unit @ cells.T
        probes = min(probes, far.shape[1])
        near = np.argpartition(far, probes - 1, axis=1)[:, :probes]
        self.of_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}

    def rough(self, codes: np.ndarray, norms: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """(query, row): table scores; rows of cells that a query doesn't look into have -inf."""
        out = np.full((len(self.ids), len(codes)), -np.inf, np.float32)
        edges = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            who = self.of_cell.get(int(cells[a]))
            if who is not None:
                score = np.zeros((len(who), b - a), np.float32)
                for book in range(codes.shape[1]):
                    score += self.tables[who, book][:, codes[a:b, book]]
                out[who, a:b] = score / norms[a:b]
        return out


@lru_cache(maxsize=4)
def _listed(folder: str) -> list[str]:
    fs, base = shared_files(folder)
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.path.endswith(".parquet"))


def _searcher(folder: str, books: Codebooks, dim: int, k: int, probes: int, rerank: int):
    """For each query and batch of index rows: the exact k best of the ``rerank`` best by table scores."""
    blocks: dict[str, _Queries] = {}

    def block_of(path: str) -> _Queries:
        if path not in blocks:
            if len(blocks) >= 16:
                blocks.clear()
            with shared_files(folder)[0].open_input_file(path) as f:
                table = pq.read_table(f).combine_chunks()
            blocks[path] = _Queries(_column(table, "vec_id").to_numpy(), _vectors(_column(table, "vector"), dim), books, probes)
        return blocks[path]

    def run(batches):
        for batch in _gathered(batches, BATCH):
            x = _vectors(_column(batch, "vector"), dim)
            size = np.linalg.norm(x, axis=1)
            codes = np.frombuffer(b"".join(_column(batch, "codes").to_pylist()), np.uint8).reshape(len(x), -1)
            norms, cells = _column(batch, "norm").to_numpy(), _column(batch, "cell").to_numpy()
            ids = _column(batch, "ids").to_pylist()
            for path in _listed(folder):
                yield _best_of_batch(block_of(path), x, size, codes, norms, cells, ids, k, rerank)

    return run


def _best_of_batch(asked: _Queries, x, size, codes, norms, cells, ids, k: int, rerank: int) -> pa.RecordBatch:
    out: list[tuple[int, int, float]] = []
    rough = asked.rough(codes, norms, cells)
    few = np.argpartition(-rough, rerank - 1, axis=1)[:, :rerank] if len(x) > rerank else np.broadcast_to(np.arange(len(x)), rough.shape)
    hit = np.take_along_axis(rough, few, 1) > -np.inf
    for q in np.flatnonzero(hit.any(axis=1)).tolist():
        rows = few[q][hit[q]]
        exact = (x[rows] @ asked.vectors[q]) / (size[rows] * asked.lengths[q])
        own, found = int(asked.ids[q]), {}
        last = None
        for at in np.argsort(-exact, kind="stable").tolist():
            score = float(exact[at])
            if len(found) >= k and score < last:
                break
            last = score
            for i in ids[rows[at]]:
                if i != own:
                    found.setdefault(i, score)  # an id that repeats counts with its nearest vector
        out += [(own, i, s) for i, s in sorted(found.items(), key=lambda f: (-f[1], f[0]))[:k]]
    columns = list(zip(*out)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def search(rows: DataFrame, is_query: Column, *, k: int = 5, probes: int = PROBES, rerank: int = RERANK, sample_rows: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest other rows by cosine, ties to the smaller id.

    Invalid vectors (see :func:`valid`) and rows without an id take no part; an empty table finds
    nothing. An id that repeats is one candidate, with its nearest vector, and one query, with the
    least of its vectors. With fewer than k candidates in the cells looked into those are returned;
    tables of so few vectors that every cell is looked into return all.
    """
    index, books, dim = build_index(rows, k, sample_rows=sample_rows, id_col=id_col, vector_col=vector_col)
    schema = "query_id long, vec_id long, score double"
    if books is None:
        found = rows.sparkSession.createDataFrame([], schema)
    else:
        asked = rows.where(is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        asked = asked.where(F.col("vec_id").isNotNull() & valid(F.col("vector")) & (F.size("vector") == dim)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
        asked = written(asked, "ann-queries")
        blocks = max(1, -(-asked.count() // BLOCK))
        folder = new_path(rows.sparkSession, "ann-blocks")
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(min(blocks, 1000), "block").write.partitionBy("block").parquet(folder)
        found = index.mapInArrow(_searcher(folder, books, dim, k, probes, rerank), schema)
    # Each id once with its best score, then the k best; both are cut before the shuffle as well.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
