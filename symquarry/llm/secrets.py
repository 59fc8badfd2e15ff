"""Secret scans: fixed patterns plus sliding-window entropy over candidate strings; SQL functions only.

Entropy: every candidate (a maximal run of key characters, long enough) gets the character class it
fits, hex or base64. A window slides over it; counts per character and the sum of c*log2(c) change
by the character that enters and the one that leaves. Candidates whose best window reaches the
entropy of their class are secrets unless the allow-list suppresses them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short as a whole has no longer part, so these lengths can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LEAST_VALUE = 6
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Suppressed candidates: UUIDs; numbers, dates and rules; documented example keys.
ALLOWED = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[0-9+/_=-]+$|(?i:EXAMPLE(KEY)?$)"
#: Suppressed as well: words joined by signs or capitals (paths, identifiers). Without its words such a string has no digit and no two letters in a row.
WORDS, NO_WORDS = r"[A-Z]?[a-z]{2,}|[A-Z]{3,}", r"[0-9]|[A-Za-z]{2}"
HEX_ONLY = r"^[0-9a-fA-F]+$"
WINDOW = 20
HEX_CHARS = "0123456789abcdef"
KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character that the best window of a class must reach.
HEX_BITS, KEY_BITS = 3.0, 3.8

_SPAN = "struct<start:bigint,kind:int,end:bigint,found:string>"


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _located(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Spans of the matches in code points: the gaps that split() leaves and the matches add up to positions.

    With a ``value_group``, matches whose group is shorter than LEAST_VALUE are dropped.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

    def spans(x: Column) -> Column:
        rows = F.zip_with(
            F.zip_with(x["found"], x["ends"], lambda m, e: F.struct(m.alias("m"), e.alias("e"))),
            x["value"],
            lambda r, v: F.struct((r["e"] - F.length(r["m"])).alias("start"), F.lit(kind).alias("kind"), r["e"].alias("end"), F.when(F.length(v) >= LEAST_VALUE, r["m"]).alias("found")),
        )
        return F.filter(rows, lambda r: r["found"].isNotNull()).cast(f"array<{_SPAN}>")

    held = F.struct(found.alias("found"), gaps.alias("gaps"), value.alias("value"))
    with_ends = lambda x: F.struct(
        x["found"].alias("found"), x["value"].alias("value"),
        running_sums(F.zip_with(x["found"], x["gaps"], lambda m, g: (F.length(m) + F.length(g)).cast("long"))).alias("ends"),
    )
    return F.when(text.rlike(pattern), _let(held, lambda x: _let(with_ends(x), spans))).otherwise(_none())


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable is not expanded again inside another lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(values: Column) -> Column:
    """Sums of an array of longs up to and with each element.

    In blocks of about the square root of the length: sums of blocks, sums before each block, then
    sums inside a block. So no step rebuilds an array, and the work is the power 1.5 of the length.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def blocked(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), F.lit(1))
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int"))
        return _let(F.struct(v.alias("v"), size.alias("size"), F.transform(numbers, lambda b: total(F.slice(v, b * size + 1, size))).alias("sums")), before)

    def before(x: Column) -> Column:
        sums = F.transform(x["sums"], lambda _, b: total(F.slice(x["sums"], F.lit(1), b)))
        return _let(F.struct(x["v"].alias("v"), x["size"].alias("size"), sums.alias("before")), inside)

    def inside(x: Column) -> Column:
        block = lambda i: F.floor(i / x["size"]).cast("int")
        return F.transform(x["v"], lambda _, i: F.element_at(x["before"], block(i) + 1) + total(F.slice(x["v"], block(i) * x["size"] + 1, i % x["size"] + 1)))

    return _let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(blocked(v)))


def _c_log_c(count: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(WINDOW + 2)]), count + 1)


def best_window_bits(found: Column, chars: str) -> Column:
    """The largest Shannon entropy, in bits a character, of any window of WINDOW characters of ``found``.

    The state holds a count per character of the class, one letter each in a string, and the sum of
    c*log2(c). The entering and the leaving character change one count each. Shorter strings give 0.
    """
    codes = F.transform(F.filter(F.split(found, ""), lambda ch: ch != ""), lambda ch: F.position(ch, F.lit(chars)))
    gone = F.concat(F.array_repeat(F.lit(0), WINDOW), F.slice(codes, 1, F.greatest(F.size(codes) - WINDOW, F.lit(0))))
    moves = F.zip_with(codes, gone, lambda i, o: F.struct(i.alias("i"), F.coalesce(o, F.lit(0)).alias("o")))
    zero = ord("A")
    count = lambda counts, place: F.ascii(F.substring(counts, place, F.lit(1))) - zero
    put = lambda counts, place, n: F.overlay(counts, F.char(n + zero), place)

    def step(acc: Column, move: Column) -> Column:
        grown = F.struct(put(acc["counts"], move["i"], count(acc["counts"], move["i"]) + 1).alias("counts"), count(acc["counts"], move["i"]).alias("old"))
        return _let(grown, lambda g: left(acc, move["o"], g))

    def left(acc: Column, out: Column, g: Column) -> Column:
        s = acc["s"] + _c_log_c(g["old"] + 1) - _c_log_c(g["old"])
        last = F.when(out > 0, count(g["counts"], out)).otherwise(F.lit(1))
        s = s - _c_log_c(last) + _c_log_c(last - 1)
        counts = F.when(out > 0, put(g["counts"], out, last - 1)).otherwise(g["counts"])
        n = acc["n"] + 1
        bits = F.when(n >= WINDOW, F.lit(math.log2(WINDOW)) - s / WINDOW).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), s.alias("s"), n.alias("n"), F.greatest(acc["best"], bits).alias("best"))

    begin = F.struct(F.lit("A" * len(chars)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))
    return F.aggregate(moves, begin, step, lambda acc: acc["best"])


def _secret_like(found: Column) -> Column:
    is_hex = found.rlike(HEX_ONLY)
    bits = F.when(is_hex, best_window_bits(F.lower(found), HEX_CHARS)).otherwise(best_window_bits(found, KEY_CHARS))
    words = ~F.regexp_replace(found, WORDS, "/").rlike(NO_WORDS)
    return F.when(found.rlike(ALLOWED) | words, F.lit(False)).otherwise(bits >= F.when(is_hex, F.lit(HEX_BITS)).otherwise(F.lit(KEY_BITS)))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, entropy) for each row of ``docs``: arrays of (start, kind, end, found).

    base: matches of the fixed patterns, leftmost and non-overlapping per kind; entropy: candidates
    outside of every base span. Positions are code points, end exclusive; kind numbers KINDS. A null
    or empty text has no spans; repeated rows are each returned. No row leaves its partition.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    text = F.col("t")
    base = F.concat(_located(text, ASSIGN, 0, 2), _located(text, ACCESS, 1), _located(text, HEX, 2))
    rows = rows.select("doc_id", "t", F.array_sort(base).alias("base"))
    spans = F.filter(_located(text, CANDIDATE, 3), lambda c: _secret_like(c["found"]))
    outside = F.filter(
        spans, lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"]))
    )
    return rows.select("doc_id", "base", outside.alias("entropy"))


def _listed(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from :func:`secrets`."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
    )
