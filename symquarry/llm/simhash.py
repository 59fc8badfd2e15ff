"""SimHash fingerprints and near-duplicate classes by ball hashing that meets in the middle.

Fingerprints are computed in Arrow batches. Links (3 or fewer differing bits) are found without
ever listing the pairs of a group:

1. A pair at distance 3 or less differs in at most one bit of its upper or of its lower 32 bits.
   Every distinct fingerprint emits the ball of radius 1 around either half; only fingerprints that
   share such a key with another one go on, flagged with the half that met.
2. Those emit all variants of the whole fingerprint within half the radius: the fingerprint itself,
   its 64 one-bit variants and, where its parity is odd, the two-bit variants inside the half opposite
   a flagged one (a pair at distance 3 has one odd member; where one half differs by a bit at most,
   the other holds two of the three flips).
3. Variants are shuffled. All that meet at a variant are within 3 bits of the least member that is
   one bit away or less, so each bucket gives a star, not its pairs; every link is verified by its
   bit count, and connected components join the stars. Geometry bounds a bucket by the variants of
   one fingerprint, whatever the number of documents.
"""

from __future__ import annotations

import math
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symquarry.llm.components import connected_components
from symquarry.llm.store import bounded_batches, discard, parts, split_join, written

SEED = 42
_LANES = np.uint64(0x0101010101010101)
_TWO_LOW = [(1 << i) | (1 << j) for i in range(32) for j in range(i)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of every run of hashes that ends at ``ends``; an empty run gives zero."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    sizes = ends - starts
    out = np.zeros(len(ends), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    # One byte lane per bit: blocks of at most 255 hashes can't overflow a lane.
    blocks = -(-sizes[full] // 255)
    owner = np.repeat(np.arange(len(full)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    cuts = starts[full][owner] + nth * 255
    first = np.cumsum(blocks) - blocks
    half = sizes[full][:, None]
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            on = (2 * counts[:, byte] > half[:, 0]).astype(np.uint64)
            out[full] |= on << np.uint64(8 * byte + bit)
    return out


def _hash_batches(shingle: int):
    join, digest = b" ".join, xxhash.xxh64_intdigest

    def run(batches):
        for batch in parts(batches):
            hashes, ends = array("Q"), []
            for text in batch.column(1).to_pylist():
                words = (text or b"").lower().split()
                if len(words) >= shingle:
                    hashes.extend(map(digest, map(join, zip(*(words[i:] for i in range(shingle)))), repeat(SEED)))
                elif words:
                    hashes.append(digest(join(words), SEED))
                ends.append(len(hashes))
            found = _majority(np.frombuffer(hashes, np.uint64), np.array(ends, np.int64)) if len(hashes) else np.zeros(len(ends), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row of ``docs``; a null text has no words, so fingerprint zero.

    ASCII letters are lower-cased and words split at ASCII white space, over the whole text.
    """
    picked = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(_hash_batches(shingle), "doc_id long, fp long")


def _half_balls(fps: DataFrame) -> DataFrame:
    """(fp, half, key, own): the ball of radius 1 around each half; own is 1 at the centre."""
    masks = F.array(*[F.lit(m).cast("long") for m in (0, *(1 << i for i in range(32)))])
    halves = ((1, F.shiftrightunsigned("fp", 32)), (2, F.col("fp").bitwiseAND(0xFFFFFFFF)))
    balls = [
        fps.select("fp", F.explode(masks).alias("m")).select(
            "fp",
            F.lit(half).alias("half"),
            value.bitwiseXOR(F.col("m")).bitwiseOR(F.lit((half - 1) << 32)).alias("key"),
            (F.col("m") == 0).cast("int").alias("own"),
        )
        for half, value in halves
    ]
    return balls[0].union(balls[1])


def links(fps: DataFrame) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (column fp) that connect all within 3 bits."""
    # Spark's size estimates don't know what explode() multiplies: without the hints it would broadcast.
    balls = _half_balls(fps)
    met = balls.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own_max")).where("n > 1 and own_max = 1")
    flagged = split_join(balls.hint("merge"), met.select("key"), "key").groupBy("fp").agg(
        F.max((F.col("half") == 1).cast("int")).alias("upper"), F.max((F.col("half") == 2).cast("int")).alias("lower")
    )
    near = written(flagged, "simhash-near")

    one = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    close = near.select("fp", F.explode(one).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    centre = close.groupBy("v").agg(F.min("fp").alias("c"), F.count("*").alias("n"))
    inner = close.hint("merge").join(centre.where("n > 1").drop("n"), "v").select("fp", "c")

    odd = near.where(F.bit_count("fp") % 2 == 1)
    low = F.array(*[F.lit(m).cast("long") for m in _TWO_LOW])
    # Halves that nearly agree leave at least two of three flips to the other half.
    far = odd.where("upper = 1").select("fp", F.explode(low).alias("m")).union(
        odd.where("lower = 1").select("fp", F.explode(low).alias("m")).select("fp", F.shiftleft("m", 32).alias("m"))
    )
    outer = far.select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v")).hint("merge").join(centre.select("v", "c"), "v").select("fp", "c")
    pairs = inner.union(outer).where("fp <> c").distinct()
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("c"))) <= 3).select(F.col("fp").alias("src"), F.col("c").alias("dst"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for each row of ``docs``.

    component_id: the least doc_id reachable over links of 3 or fewer bits, the row's own included.
    Equal fingerprints are one node, so copies cost one row. Rows with a null doc_id take part in
    links and get their class; a class of null doc_ids only has a null component_id. Repeated rows
    are returned as often as they come; empty tables give no rows.
    """
    own = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    member = written(connected_components(links(nodes.select("fp"))), "simhash-members")
    label = nodes.join(member, nodes.fp == member.node).groupBy("component").agg(F.min("rep").alias("least"))
    named = member.join(label, "component").select(F.col("node").alias("fp"), "least")
    reps = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    # Written, the join with a hot fingerprint's documents is one that adaptive execution can split.
    return own.join(written(reps, "simhash-reps"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# --- one document of each group of copies ---

#: Words of a shingle and the similarity that makes a copy.
COPY_SHINGLE, COPY_SIMILARITY = 5, 0.8
#: The share of two sets' sizes that sets so similar have in common.
COPY_SHARED = COPY_SIMILARITY / (1 + COPY_SIMILARITY)
#: One document in so many is counted to find common shingles, of which at most so many are kept.
COMMON_ONE_IN, COMMON_KEPT = 16, 250_000
_EPS = 1e-9
_TRAITS = "doc_id long, fp long, words_hash long, n long, keys array<long>"


def _shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the shingles of COPY_SHINGLE words, ascending; fewer words are one shingle."""
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < COPY_SHINGLE:
        return np.array([digest(join(words), SEED)], np.uint64)
    grams = map(join, zip(*(words[i:] for i in range(COPY_SHINGLE))))
    return np.unique(np.fromiter(map(digest, grams, repeat(SEED)), np.uint64, len(words) - COPY_SHINGLE + 1))


def _prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first hashes of a set, as many as it takes for any two sets of COPY_SIMILARITY to share one.

    The order is one for all sets: by the level of commonness, then by hash. Any such order finds all
    pairs; with common shingles last, few dissimilar sets meet.
    """
    size = len(hashes) - math.ceil(COPY_SIMILARITY * len(hashes) - 1e-9) + 1
    known, level = common
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == hashes, level[at], 0), kind="stable")]
    return hashes[:size]


def _all_shingles(batches):
    for batch in parts(batches):
        sets = [_shingle_hashes((text or b"").lower().split()).view(np.int64) for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], names=["key"])


def _common_shingles(picked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, levels) of shingles that several sampled documents hold. They only order the keys."""
    sample = picked.where(F.pmod(F.xxhash64("doc_id"), F.lit(COMMON_ONE_IN)) == 0).select("text")
    counts = sample.mapInArrow(_all_shingles, "key long").groupBy("key").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "key").limit(COMMON_KEPT).toArrow()
    known = rows.column("key").to_numpy().astype(np.int64).view(np.uint64)
    level = np.log2(rows.column("count").to_numpy().astype(np.float64)).astype(np.uint8)
    order = np.argsort(known)
    return known[order], level[order]


def _trait_batches(shingle: int, common: tuple[np.ndarray, np.ndarray]):
    fingerprint = _hash_batches(shingle)

    def run(batches):
        for batch in parts(batches):
            fps = next(fingerprint(iter([batch]))).column(1)
            hashes, sizes, keys = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").lower().split()
                hashes.append(_signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)))
                shingles = _shingle_hashes(words)
                sizes.append(len(shingles))
                keys.append(_prefix(shingles, common).view(np.int64))
            columns = [batch.column(0), fps, pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "words_hash", "n", "keys"])

    return run


def _shingle_sets(batches):
    for batch in parts(batches):
        sets = [_shingle_hashes((text or b"").lower().split()).view(np.int64) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])


def _need(m: Column, n: Column) -> Column:
    """Shingles that sets of these sizes share at least if they are so similar."""
    return F.ceil(F.lit(COPY_SHARED) * (m + n) - _EPS)


def _enough_keys(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share as many keys as the similarity implies.

    Shared shingles up to the end of the prefix that ends first are in both prefixes; beyond it there
    are at most ceil(0.8 n) - 1 of its set.
    """
    one = nodes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("keys").alias("keys_b"))
    two = nodes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("keys").alias("keys_a"))
    both = pairs.join(one, "b").join(two, "a")
    shared = F.size(F.array_intersect("keys_a", "keys_b"))
    beyond = F.ceil(F.lit(COPY_SIMILARITY) * F.greatest("n_a", "n_b") - _EPS) - 1
    return both.where(shared >= _need(F.col("n_a"), F.col("n_b")) - beyond).select("a", "b")


def _alike(picked: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst): the pairs (a, b) whose shingle sets have COPY_SIMILARITY, checked exactly."""
    pairs = written(_enough_keys(pairs, nodes), "copies-candidates")
    asked = written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "copies-asked")
    sets = picked.select(F.col("doc_id").alias("id"), "text").join(asked, "id").mapInArrow(_shingle_sets, "id long, shingles array<long>")
    sets = written(sets, "copies-shingles")
    checked = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a"
    )
    both = F.size(F.array_intersect("x", "y"))
    alike = both >= F.lit(COPY_SIMILARITY) * (F.size("x") + F.size("y") - both) - _EPS
    found = written(checked.where(alike).select(F.col("a").alias("src"), F.col("b").alias("dst")), "copies-links")
    discard(sets)
    return found


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _indexed(n: Column) -> Column:
    """How many first keys the smaller set of a pair needs to show: it shares 0.8 / 0.9 of its size at least."""
    return n - F.ceil(F.lit(2 * COPY_SHARED) * n - _EPS) + 1


def _may_be_alike(less: str, more: str) -> Column:
    """Whether a key at places of two sets (structs of n, rep, pos, the smaller first) may be the first of enough shared ones."""
    x, y = (lambda c: F.col(f"{less}.{c}")), (lambda c: F.col(f"{more}.{c}"))
    rest = F.least(x("n") - x("pos"), y("n") - y("pos"))
    return (x("pos") < _indexed(x("n"))) & (x("n") >= F.lit(COPY_SIMILARITY) * y("n") - _EPS) & (rest >= _need(x("n"), y("n")))


def _star(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of each key with its hub c."""
    rows = split_join(members, hubs, "key").where("s.rep <> c.rep")
    rows = rows.select(F.least("s", "c").alias("less"), F.greatest("s", "c").alias("more"))
    return rows.where(_may_be_alike("less", "more")).select(F.col("less.rep").alias("a"), F.col("more.rep").alias("b"))


def _open_members(members: DataFrame, found: DataFrame) -> tuple[DataFrame, int, int]:
    """(key, s, comp) of keys that documents of several classes share; their rows and pairs across classes."""
    classes = written(connected_components(found), "copies-classes")
    labelled = members.join(classes, F.col("s.rep") == classes.node, "left").select("key", "s", F.coalesce("component", "s.rep").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    still = written(split_join(labelled, mixed, "key"), "copies-open")
    of_key = still.groupBy("key", "comp").agg(F.count("*").cast("double").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    row = of_key.agg(F.sum("m").alias("rows"), F.sum((F.col("m") * F.col("m") - F.col("mm")) / 2).alias("pairs")).first()
    return still, int(row.rows or 0), int(row.pairs or 0)


def _across(still: DataFrame) -> DataFrame:
    """Pairs (a, b) across classes for which a shared key leaves the similarity possible."""
    x = still.where(F.col("s.pos") < _indexed(F.col("s.n"))).select("key", F.col("s").alias("less"), F.col("comp").alias("p"))
    y = still.select("key", F.col("s").alias("more"), F.col("comp").alias("q"))
    rows = x.hint("merge").join(y, "key").where((F.col("p") != F.col("q")) & (F.col("less") < F.col("more")) & _may_be_alike("less", "more"))
    return rows.select(F.col("less.rep").alias("a"), F.col("more.rep").alias("b"))


def copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, keep_id): classes of documents whose words agree, or whose five-word shingles agree to 0.8 or more.

    Candidates are SimHash links of 3 bits or fewer between whole documents and, since edits that keep
    that similarity can flip more bits, documents that share one of the first shingle hashes of their
    sets: any two that are so similar do (prefix filter). Stars come first: each key's documents with
    one of them, which joins a large group by a row per document, and again around other documents
    while that pays. Then documents of different classes that share a key are compared, unless their
    sizes or the places of the key in the two sets rule the similarity out, so no link is left out.
    Every candidate is checked exactly. keep_id is the smallest doc_id of the class. Rows without a
    doc_id take no part; rows that repeat one with other texts belong to the classes of all of them.
    """
    picked = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("doc_id is not null")
    traits = written(picked.mapInArrow(_trait_batches(shingle, _common_shingles(picked)), _TRAITS), "copies-traits")
    # Equal words: one node, its smallest document.
    nodes = traits.groupBy("words_hash").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("fp", "n", "keys"), "doc_id").alias("t"))
    nodes = written(nodes.select("words_hash", "rep", "t.fp", "t.n", "t.keys"), "copies-nodes")
    by_fp = written(nodes.groupBy("fp").agg(F.min("rep").alias("first")), "copies-fps")
    same_fp = nodes.join(by_fp, "fp").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    near = links(by_fp.select("fp"))
    near = near.join(by_fp.select(F.col("fp").alias("src"), F.col("first").alias("a")), "src").join(by_fp.select(F.col("fp").alias("dst"), F.col("first").alias("b")), "dst")
    held = nodes.select("n", "rep", F.posexplode("keys").alias("pos", "key")).select("key", F.struct("n", "rep", "pos").alias("s"))
    again = held.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = written(split_join(held.hint("merge"), again, "key"), "copies-members")
    star = _star(members, members.groupBy("key").agg(F.min_by("s", "s.rep").alias("c")))
    done = written(_ordered(same_fp.union(near.select("a", "b")).union(star)), "copies-pairs")
    found = _alike(picked, nodes, done)
    still, rows, left = _open_members(members, found)
    turn, before = 0, math.inf
    # Stars only spare pairs inside large groups: they stop where they don't pay, and what is left is compared.
    while left > 8 * rows and left < 0.9 * before:
        turn, before = turn + 1, left
        # Another hub, drawn by a hash that changes with the turn.
        hubs = still.groupBy("key").agg(F.min_by("s", F.struct(F.xxhash64("s.rep", F.lit(turn)), "s.rep")).alias("c"))
        more = written(_ordered(_star(still.drop("comp"), hubs)).join(done, ["a", "b"], "left_anti"), "copies-pairs")
        discard(still)
        found, done = found.union(_alike(picked, nodes, more)), done.union(more)
        still, rows, left = _open_members(members, found)
    if left:
        rest = written(_ordered(_across(still)).join(done, ["a", "b"], "left_anti"), "copies-pairs")
        found = found.union(_alike(picked, nodes, rest))
    classes = connected_components(found)
    label = nodes.join(classes, nodes.rep == classes.node, "left").select("words_hash", F.coalesce("component", "rep").alias("keep_id"))
    label = written(label, "copies-labels")
    for spent in (nodes, by_fp, members):
        discard(spent)
    return traits.select("doc_id", "words_hash").join(label, "words_hash").select("doc_id", "keep_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their class of copies, with the columns of ``docs``.

    Rows without a doc_id stay; rows that repeat the smallest doc_id of a class all stay. Only ids
    of the rows that go are joined back.
    """
    classes = copy_classes(docs, id_col, text_col, shingle)
    gone = written(classes.where("doc_id > keep_id").select(F.col("doc_id").alias("__gone")).distinct(), "simhash-gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
