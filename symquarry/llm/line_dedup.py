"""Line dedup: winnowed line hashes as fingerprints, joined by position, extended to whole repeated runs.

Lines are the units; a line of more than PIECE words is cut into pieces, so that a passage inside a
long line is found as well. A cut stands before each word whose hash is the least of some PIECE
successive words of its line: where two lines share a passage, they are cut alike inside it, and no
piece is longer than PIECE words.

1. Winnowing: a fingerprint is the hash of GRAM successive pieces. Of each WINDOW successive
   fingerprints of a document the least is selected.
2. Selected fingerprints that occur again are joined with their first occurrence by (doc_id, row,
   position); a common passage costs a row per occurrence and never a pair.
3. Later matches that go on without a gap along the same first document are one chain. Both ends of
   a chain are extended piece by piece while that document agrees (30 bits of the pieces' hashes, and
   their words): a run ends, and the next match inside it begins, within WINDOW - 1 pieces.
4. Chains that meet are a run; runs of LEAST_WORDS words are deleted.

Guarantee: of any ASSURED words in a row that two places share at least one fingerprint is selected in
both. The later place loses all but up to 2 * PIECE - 1 words at either end, and, only where a
fingerprint next to an end or a gap first occurred in a third document that doesn't go on alike, up
to WINDOW - 1 pieces there. (The first and last PIECE - 1 words may be cut differently, and one piece
reaches beyond them; between them are at least ASSURED - 4 * PIECE + 3 words, so GRAM + WINDOW - 1
pieces.) Shorter runs, down to LEAST_WORDS, go where the selection meets them; what goes always
occurs before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symquarry.llm.store import bounded_batches, discard, parts, split_join, written

#: Words of a piece, pieces of a fingerprint, fingerprints of which one is selected, words of a run.
PIECE, GRAM, WINDOW, LEAST_WORDS = 4, 5, 6, 20
#: Words of a shared passage that is found for sure.
ASSURED = PIECE * (GRAM + WINDOW - 2) + 4 * PIECE - 2
#: Texts are told apart by so many buckets of their hash when those that lose words are sought out: what is broadcast has a row a bucket at most.
BUCKETS = 1 << 20
_U = np.uint64
_UNITS = "doc_id long, row long, pieces array<int>, at array<int>, grams array<long>"
_CHAIN = "start int, end int, f_doc long, f_row long, f_start int, f_end int"
_LISTS = ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in _CHAIN.split(", "))
_BEFORE, _AFTER = ([f"{side}{k}" for k in range(1, WINDOW)] for side in "ba")
_AROUND = f"row long, doc_id long, {_CHAIN}, first_word int, last_word int, " + ", ".join(f"{c} int" for c in (*_BEFORE, *_AFTER))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _odd(n: int, seed: int) -> np.ndarray:
    """n odd numbers that look random."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTES, _PLACES = _odd(256, 1), _odd(max(PIECE, GRAM), 2)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _least(values: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Marks the last least value of each ``width`` successive places of one group."""
    marked = np.zeros(len(values), bool)
    if len(values) >= width:
        whole = np.flatnonzero(group[: len(group) - width + 1] == group[width - 1 :])
        if len(whole):
            views = np.lib.stride_tricks.sliding_window_view(values[::-1], width)[len(values) - width - whole]
            marked[whole + width - 1 - views.argmin(axis=1)] = True
    return marked


def _word_hashes(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of words of these sizes that lie behind each other; some at a time, as a byte takes some numbers meanwhile."""
    spread, ends = _odd(int(sizes.max(initial=0)), 3), np.cumsum(sizes)
    out = np.empty(len(sizes), np.uint64)
    for k in range(0, len(sizes), 50_000):
        mine = sizes[k : k + 50_000]
        low, begin = int(ends[k] - sizes[k]), np.cumsum(mine) - mine
        within = np.arange(int(mine.sum())) - np.repeat(begin, mine)
        out[k : k + 50_000] = np.add.reduceat(_BYTES[letters[low : low + len(within)]] * spread[within], begin)
    return _mixed(out + sizes.astype(np.uint64))


class Cut:
    """The words and pieces of some texts (binary): hashes, where each begins, and the text each belongs to.

    All texts are cut at once, on their bytes; words are what stands between ASCII white space.
    """

    def __init__(self, texts: pa.Array | list):
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()), b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None and len(texts) else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        letter = ~_SPACE[data]
        fresh = np.ones(len(data) + 1, bool)
        fresh[1:-1] = ~letter[:-1]
        fresh[bounds] = True  # whatever begins or ends a text
        start = np.flatnonzero(letter & fresh[:-1])
        ends = np.zeros(len(data) + 1, bool)
        ends[bounds] = True
        after = np.append(~letter, True)[1:] | ends[1:]
        sizes = np.flatnonzero(letter & after) + 1 - start
        self.words = len(start)
        text_of_word = np.searchsorted(bounds, start, side="right") - 1
        line = np.searchsorted(np.flatnonzero(data == 10), start) + text_of_word
        hashes = _word_hashes(data[letter], sizes)
        self.first = np.flatnonzero(_least(hashes, line, PIECE) | np.concatenate(([True], line[1:] != line[:-1]))[: self.words])
        self.sizes = np.diff(np.append(self.first, self.words))
        within = np.arange(self.words) - np.repeat(self.first, self.sizes)
        summed = np.add.reduceat(hashes * _PLACES[within], self.first) if self.words else hashes
        self.hashes = _mixed(summed + self.sizes.astype(np.uint64))
        self.owner = text_of_word[self.first]
        #: Where the pieces and words of each text begin.
        self.text_at = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.words_at = np.searchsorted(text_of_word, np.arange(len(texts) + 1))

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """(pieces at which selected fingerprints begin, their hashes), over all texts."""
        n = len(self.hashes) - GRAM + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = np.zeros(n, np.uint64)
        for k in range(GRAM):
            grams += self.hashes[k : k + n] * _PLACES[k]
        grams = _mixed(grams)
        inside = np.flatnonzero(self.owner[:n] == self.owner[GRAM - 1 :])
        owner, grams = self.owner[inside], grams[inside]
        chosen = _least(grams, owner, WINDOW)
        # A text with fewer fingerprints than a window has its least one selected.
        begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))[: len(owner)])
        for b, m in zip(begin.tolist(), np.diff(np.append(begin, len(owner))).tolist()):
            if m < WINDOW:
                chosen[b + m - 1 - int(grams[b : b + m][::-1].argmin())] = True
        return inside[chosen], grams[chosen]

    def short_hashes(self) -> np.ndarray:
        """30 bits of each piece's hash above its number of words less one."""
        return ((self.hashes & _U(0xFFFFFFFC)) | (self.sizes - 1).astype(np.uint64)).astype(np.uint32).view(np.int32)


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _units(batches):
    for batch in parts(batches, size=1 << 20):
        cut = Cut(batch.column(2))
        at, grams = cut.fingerprints()
        owner = cut.owner[at]
        selected = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        columns = [
            batch.column(0), batch.column(1), _lists(cut.short_hashes(), cut.text_at, pa.int32()),
            _lists((at - cut.text_at[owner]).astype(np.int32), selected, pa.int32()), _lists(grams.view(np.int64), selected, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "pieces", "at", "grams"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, text): row is a hash of the text, which tells texts of one doc_id apart."""
    text = F.col(text_col).cast("binary")
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _chains(batches):
    """Of each text's later matches the chains."""
    for batch in batches:
        offsets = batch.column(2).offsets.to_numpy()
        flat = batch.column(2).flatten()
        at, f_doc, f_row, f_at = (flat.field(k).to_numpy() for k in range(4))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        order = np.lexsort((at, owner))
        at, f_doc, f_row, f_at, owner = (x[order] for x in (at, f_doc, f_row, f_at, owner))
        step = np.diff(at)
        goes_on = (owner[1:] == owner[:-1]) & (f_doc[1:] == f_doc[:-1]) & (f_row[1:] == f_row[:-1]) & (step == np.diff(f_at)) & (step <= GRAM)
        begin, end = np.flatnonzero(np.concatenate(([True], ~goes_on))[: len(at)]), np.flatnonzero(np.concatenate((~goes_on, [True]))[: len(at)])
        upto = np.searchsorted(owner[begin], np.arange(batch.num_rows + 1))
        found = (at[begin], at[end] + GRAM, f_doc[begin], f_row[begin], f_at[begin], f_at[end] + GRAM)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        columns = [batch.column(0), batch.column(1), *(_lists(x, upto, k) for x, k in zip(found, kinds))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", *(c.split()[0] for c in _CHAIN.split(", "))])


def _around(batches):
    """For each stretch of pieces asked for: its words, and the pieces before and after it, outward."""
    names = [c.split()[0] for c in _AROUND.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            pieces, asked = part.column("pieces"), part.column("asked")
            held, begin = pieces.flatten().to_numpy(), (pieces.offsets.to_numpy() - pieces.offsets[0].as_py()).astype(np.int64)
            words = np.concatenate(([0], np.cumsum((held & 3) + 1)))
            owner = np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))
            flat = asked.flatten()
            low, high = begin[owner], begin[owner + 1]
            start, end = low + flat.field(0).to_numpy(), low + flat.field(1).to_numpy()
            padded = np.append(held, held.dtype.type(0))
            inside = lambda place: pa.array(padded[np.clip(place, 0, len(held))], mask=(place < low) | (place >= high))
            columns = [part.column("row").take(pa.array(owner)), part.column("doc_id").take(pa.array(owner)), *(flat.field(k) for k in range(6))]
            columns += [pa.array((words[x] - words[low]).astype(np.int32)) for x in (start, end)]
            columns += [inside(start - k) for k in range(1, WINDOW)] + [inside(end + k - 1) for k in range(1, WINDOW)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _merged(least_words: int):
    """Of each text's stretches of words the runs of ``least_words`` words or more; texts without one give no row."""

    def run(batches):
        for batch in batches:
            offsets = batch.column(2).offsets.to_numpy()
            flat = batch.column(2).flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            apart = owner.astype(np.int64) << 32
            start, end = flat.field(0).to_numpy() + apart, flat.field(1).to_numpy() + apart
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            begin = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1]))[: len(start)])
            last = np.append(begin[1:], len(start))[: len(begin)] - 1
            start, end = start[begin], end[last]
            long_ = end - start >= least_words
            start, end, of = start[long_], end[long_], start[long_] >> 32
            who = np.unique(of)
            upto = np.searchsorted(of, np.append(who, batch.num_rows))
            low = of << 32
            columns = [batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), _lists(start - low, upto, pa.int32()), _lists(end - low, upto, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "starts", "ends"])

    return run


def _agreeing(own: list[str], other: list[str]) -> F.Column:
    """Words of the pieces, outward, while those of both sides agree."""
    words = F.lit(0)
    for x, y in reversed(list(zip(own, other))):
        words = F.when(F.col(x) == F.col(y), F.col(x).bitwiseAND(3) + 1 + words).otherwise(0)
    return words


def repeated_runs(docs: DataFrame, *, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, starts, ends): for each text with later repeated runs their ranges of words, end exclusive.

    row is a hash of the text. Texts are never shuffled here.
    """
    units = written(_rows(docs, id_col, text_col).where("doc_id is not null").mapInArrow(_units, _UNITS), "lines-units")
    selected = units.select("doc_id", "row", F.explode(F.arrays_zip("at", "grams")).alias("s")).select("doc_id", "row", "s.at", F.col("s.grams").alias("gram"))
    first = selected.groupBy("gram").agg(F.min(F.struct("doc_id", "row", "at")).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = split_join(selected, first, "gram").where(
        (F.col("row") != F.col("f.row")) | (F.col("doc_id") != F.col("f.doc_id")) | (F.col("at") >= F.col("f.at") + GRAM)
    )
    match = F.struct("at", F.col("f.doc_id").alias("f_doc"), F.col("f.row").alias("f_row"), F.col("f.at").alias("f_at"))
    texts = later.select("row", "doc_id", match.alias("m")).groupBy("row", "doc_id").agg(F.collect_set("m").alias("m"))
    names = [c.split()[0] for c in _CHAIN.split(", ")]
    chains = written(texts.mapInArrow(_chains, f"row long, doc_id long, {_LISTS}"), "lines-chains")
    # Both places of a chain ask for the pieces around them: a row a text meets its own pieces.
    own = chains.select("row", "doc_id", F.explode(F.arrays_zip(*names)).alias("c")).select("row", "doc_id", "c.*")
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    theirs = own.select(
        F.col("f_row").alias("row"), F.col("f_doc").alias("doc_id"), F.col("f_start").alias("start"), F.col("f_end").alias("end"),
        *[null(c, "long") for c in ("f_doc", "f_row")], *[null(c, "int") for c in ("f_start", "f_end")],
    )
    asked = own.union(theirs).groupBy("row", "doc_id").agg(F.collect_set(F.struct(*names)).alias("asked"))
    around = written(split_join(units.select("row", "doc_id", "pieces"), asked, ["row", "doc_id"]).mapInArrow(_around, _AROUND), "lines-around")
    other = around.where("f_doc is null").select(
        F.col("row").alias("f_row"), F.col("doc_id").alias("f_doc"), F.col("start").alias("f_start"), F.col("end").alias("f_end"), *[F.col(c).alias(f"f_{c}") for c in (*_BEFORE, *_AFTER)]
    )
    both = split_join(around.where("f_doc is not null"), other.distinct(), ["f_row", "f_doc", "f_start", "f_end"])
    run = F.struct(
        (F.col("first_word") - _agreeing(_BEFORE, [f"f_{c}" for c in _BEFORE])).alias("start"), (F.col("last_word") + _agreeing(_AFTER, [f"f_{c}" for c in _AFTER])).alias("end")
    )
    runs = both.select("row", "doc_id", run.alias("run")).groupBy("row", "doc_id").agg(F.collect_set("run").alias("runs"))
    runs = written(runs.mapInArrow(_merged(least_words), "row long, doc_id long, starts array<int>, ends array<int>"), "lines-runs")
    for table in (units, chains, around):
        discard(table)
    return runs


def without_words(text: bytes, gone: list[tuple[int, int]]) -> tuple[int, bytes]:
    """(lines that went whole, text without the ranges of words).

    A line that goes whole goes with its line break, and white space before a deleted end of a line goes too.
    """
    out, lines, word, k = [], 0, 0, 0
    for line in text.split(b"\n"):
        found = line.split()
        begin, word = word, word + len(found)
        while k < len(gone) and gone[k][1] <= begin:
            k += 1
        hit, j = [], k
        while found and j < len(gone) and gone[j][0] < word:
            hit.append((max(gone[j][0] - begin, 0), min(gone[j][1] - begin, len(found))))
            j += 1
        if hit and hit[0] == (0, len(found)):
            lines += 1
            continue
        out.append(_without(line, found, hit) if hit else line)
    return lines, b"\n".join(out)


def _without(line: bytes, words: list[bytes], hit: list[tuple[int, int]]) -> bytes:
    places, at = [], 0
    for w in words:
        at = line.index(w, at)
        places.append(at)
        at += len(w)
    kept, at = [], 0
    for a, b in hit:
        kept.append(line[at : places[a]])
        at = places[b] if b < len(words) else len(line)
    kept.append(line[at:])
    joined = b"".join(kept)
    return joined.rstrip() if hit[-1][1] == len(words) else joined


def _delete(batches):
    for batch in parts(batches, size=2 << 20):
        rows = []
        for doc_id, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in range(4))):
            gone = list(zip(starts, ends)) if starts else []
            whole, left = without_words(text, gone) if gone else (0, text)
            n_lines = 0 if text is None else text.count(b"\n") + 1
            rows.append((doc_id, n_lines, whole, sum(b - a for a, b in gone), ",".join(f"{a}-{b}" for a, b in gone), left))
        columns = list(zip(*rows)) or [()] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_lines", "n_removed", "words_removed", "removed", "text"])


def dedup_lines(docs: DataFrame, *, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, words_removed, removed, text) for each row of ``docs``, text without later repeated runs.

    n_lines: lines of the text; n_removed: those that went whole; removed: the ranges of words that
    went, ``start-end`` from 0, end exclusive. Words compare as they stand, without the white space
    between them. Documents go by doc_id, texts of one doc_id by their hash: each is a document of its own, while
    equal rows lose the same words. Within one text a repeat counts only from beyond the first
    occurrence. A null text stays null with 0 lines, an empty one has one line; rows with a null doc_id stay as they are.

    Only texts in a bucket of hashes with one that loses words are shuffled; the others stay in place.
    """
    runs = repeated_runs(docs, least_words=least_words, id_col=id_col, text_col=text_col)
    bucket = F.pmod(F.xxhash64("doc_id", "row"), F.lit(BUCKETS)).alias("bucket")
    hit = F.broadcast(runs.select(bucket).distinct())
    rows = _rows(docs, id_col, text_col).select("*", bucket)
    sought = split_join(rows.join(hit, "bucket", "left_semi"), runs, ["row", "doc_id"], "left").select("doc_id", "text", "starts", "ends")
    schema = "doc_id long, n_lines long, n_removed long, words_removed long, removed string, text binary"
    cleaned = sought.mapInArrow(_delete, schema).withColumn("text", F.col("text").cast("string"))
    text = F.col("text").cast("string")
    zero = F.lit(0).cast("long")
    lines = F.when(text.isNull(), zero).otherwise(F.regexp_count(text, F.lit("\n")).cast("long") + 1)
    return cleaned.union(
        rows.join(hit, "bucket", "left_anti").select("doc_id", lines.alias("n_lines"), zero.alias("n_removed"), zero.alias("words_removed"), F.lit("").alias("removed"), text.alias("text"))
    )
