"""Removal of byte passages that occur again, by interval expansion on a Burrows-Wheeler transform (operator 11).

Every window of `length` bytes has an anchor inside it, the run of `anchor` bytes with the smallest hash (the first of equal ones), so
equal windows have equal anchors at equal places. Neighbouring windows with one anchor make a fragment, and windows can be equal only
if their fragments share an anchor. Anchors are counted over all texts; a fragment whose anchor is nowhere else is done, as is one
whose anchor always comes with the same fragment. The other fragments, each distinct one once, are dealt by anchor to shards of
bounded size.

A shard sorts the suffixes of its fragments, takes the Burrows-Wheeler transform and expands intervals breadth first: the intervals of
strings of one byte, then of each byte before them, and so on. An interval whose left edge has no value yet gives it one, the common
prefix of the two suffixes there, so prefixes come by increasing value and expansion stops at `length`. Edges without a value join
suffixes that share a whole window.

Anchors that more than `group` distinct fragments share are split: their windows are halved by their place relative to the anchor, and
a half goes on with the bytes that all its windows hold as its key. At a single window the key is the window, so every group ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import Tables, batches_of, grown, handed_back, mixed


@dataclass(frozen=True)
class Repeats:
    """Bytes of a window, of an anchor, of texts looked at together, distinct fragments of one anchor in a shard, bytes of a shard."""

    length: int = 400
    anchor: int = 200
    lot: int = 1 << 18
    group: int = 2_000
    shard_bytes: int = 2_000_000


#: Odd multiplier of the rolling hash (a fixed value), and bits of a place in a lot.
BASE, PLACE_BITS = 0x9E3779B97F4A7C15, 24


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
    return out[:n]


def anchors(data: np.ndarray, config: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window's anchor, and the hash of the run of `anchor` bytes at each place."""
    size, n = 1 << (len(data) - 1).bit_length(), len(data) - config.anchor + 1
    letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * _powers(BASE, size)[: len(data)], out=sums[1:])
    hashes = mixed((sums[config.anchor :] - sums[: -config.anchor]) * _powers(pow(BASE, -1, 2**64), size)[:n])
    low = np.uint64((1 << PLACE_BITS) - 1)
    ranked = hashes & ~low | np.arange(n, dtype=np.uint64)
    span = config.length - config.anchor + 1
    rows = np.concatenate([ranked, np.full(-n % span, 2**64 - 1, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return (np.minimum(ahead[: n - span + 1], behind[span - 1 : n]) & low).astype(np.int64), hashes


def fragments(texts: list[bytes], config: Repeats):
    """(number of the text, place, windows, place of the anchor in it, hash of the anchor, hash of the bytes) of the fragments of texts that hold a window."""
    import xxhash

    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    places, hashes = anchors(np.frombuffer(data, np.uint8), config)
    inside = np.zeros(len(data) + 1, np.int64)
    inside[starts] += 1
    inside[ends - config.length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(inside)[: len(places)])
    at = places[windows]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    begin, end, at = windows[first], windows[last] + config.length, at[first]
    seen = memoryview(data)
    own = np.fromiter((xxhash.xxh3_64_intdigest(seen[i:j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(at))
    text = np.searchsorted(starts, begin, "right") - 1
    return text, begin - starts[text], end - begin - config.length + 1, at - begin, hashes[at].view(np.int64), own.view(np.int64)


def _found(config: Repeats):
    """Fragments of a batch of texts (h, twice, text), in lots; a text larger than a lot comes in parts that share all but one byte of a window."""

    def run(batches):
        for batch in batches:
            units, held = [], 0

            def rows(units=units, batch=batch):
                text, at, size, off, a, f = fragments([x[2] for x in units], config)
                row, base = np.array([x[0] for x in units]), np.array([x[1] for x in units])
                cells = [pa.array(x.astype(np.int32)) for x in (at + base[text], size, off)]
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row[text])) for k in (0, 1)), *cells, pa.array(a), pa.array(f)], ["h", "twice", "at", "size", "off", "a", "f"])

            for row, text in enumerate(batch.column(2).to_pylist()):
                for base in range(0, len(text) - config.length + 1, config.lot):
                    units.append((row, base, text[base : base + config.lot + config.length - 1]))
                    held += len(units[-1][2])
                    if held >= config.lot:
                        yield rows()
                        units.clear()
                        held = 0
            if units:
                yield rows()

    return run


def suffix_order(symbols: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least, by doubling. left: symbols before the end mark (0); what follows a mark does not count."""
    n, packed = len(symbols), 7
    key, padded = np.zeros(n, np.int64), np.concatenate([symbols, np.zeros(packed, np.uint16)])
    for j in range(packed):
        key <<= 9
        key |= padded[j : n + j]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1], [True]])
    rank = np.zeros(n + depth, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new[:-1], np.arange(n, dtype=np.int32), 0))
    slots, known = np.flatnonzero(~(new[:-1] & new[1:])).astype(np.int32), packed
    while known < depth:
        slots = slots[left[order[slots]] >= known]
        if not len(slots):
            break
        some = order[slots]
        key = rank[some] * np.int64(n + 1) + rank[some + known]
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[slots] = some
        new = np.concatenate([[True], key[1:] != key[:-1], [True]])
        rank[some] = np.maximum.accumulate(np.where(new[:-1], slots, 0))
        slots = slots[~(new[:-1] & new[1:])]
        known *= 2
    return order


def prefix_edges(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the order, and its end, whether the suffixes on both sides share fewer than `length` symbols.

    Breadth-first expansion: an interval [lo, hi) holds the suffixes that begin with one string; the rows of each symbol in its
    part of the transform lead to the interval of the string with that symbol before it. End marks are never put before a string.
    """
    n = len(symbols)
    bwt = symbols[order - 1]
    by = np.argsort(bwt, kind="stable").astype(np.int32)
    listed = bwt[by]
    to = np.empty(n, np.int32)
    to[by] = np.arange(n, dtype=np.int32)
    same = listed[1:] == listed[:-1]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by[1:][same]] = by[:-1][same]
    after[by[:-1][same]] = by[1:][same]
    edge = np.zeros(n + 1, bool)
    edge[n] = True
    lo = np.flatnonzero(np.concatenate([[True], ~same]))
    hi = np.append(lo[1:], n)
    lo, hi = lo[listed[lo] > 0], hi[listed[lo] > 0]
    edge[lo] = True
    for _ in range(length - 1):
        size = hi - lo
        if not len(size):
            break
        rows = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        own = bwt[rows] > 0
        lo, hi = np.sort(to[rows[own & (before[rows] < np.repeat(lo, size))]]), np.sort(to[rows[own & (after[rows] >= np.repeat(hi, size))]]) + 1
        new = ~edge[lo]
        lo, hi = lo[new].astype(np.int64), hi[new].astype(np.int64)
        edge[lo] = True
    return edge


def repeated_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, place) of the windows of `length` bytes that start more than once in these texts, in order."""
    sizes = np.array([len(t) + 1 for t in texts])
    symbols = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(sizes) - 1
    symbols[ends] = 0
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    left = (ends[text] - np.arange(len(symbols))).astype(np.int32)
    order = suffix_order(symbols, left, length)
    number = np.cumsum(prefix_edges(symbols, order, length)[:-1], dtype=np.int32)
    again = np.zeros(len(symbols), bool)
    again[order] = np.bincount(number)[number] > 1
    hit = np.flatnonzero(again & (left >= length))
    return text[hit], hit - (ends - sizes + 1)[text[hit]]


def _expanded(length: int):
    """A shard's pieces (a, f, at, text) -> runs of windows [s, e) of fragment (a, f) that occur again."""

    def run(pieces: pa.Table) -> pa.Table:
        text, at = repeated_windows(pieces.column("text").to_pylist(), length)
        first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        rows, base = pa.array(text[first]), pieces.column("at").to_numpy()[text[first]]
        return pa.table({"a": pieces.column("a").take(rows), "f": pieces.column("f").take(rows), "s": pa.array((base + at[first]).astype(np.int32)), "e": pa.array((base + at[last] + 1).astype(np.int32))})

    return run


def _halved(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """Pieces cut where the place of their windows relative to the anchor passes a multiple of width, with what all windows of a part hold as key."""
    parts = pieces.select("a", "f", "at", "size", "off", "text", F.explode(F.expr(f"sequence((off - size + 1) div {width}, off div {width})")).alias("part"))
    parts = parts.withColumns({"top": F.expr(f"cast(least(off, part * {width} + {width - 1}) as int)"), "low": F.expr(f"cast(greatest(off - size + 1, part * {width}) as int)")})
    parts = parts.select("a", "f", F.expr("at + off - top").alias("at"), F.expr("top - low + 1").alias("size"), F.col("top").alias("off"), F.expr(f"substring(text, off - top + 1, top - low + {length})").alias("text"), "part")
    core = F.expr(f"substring(text, cast(off - part * {width} as int) + 1, {length - width + 1})")
    return parts.withColumns({"k1": F.xxhash64(core, "part"), "k2": F.xxhash64(F.lit(1), core, "part")}).drop("part")


def _settled(pieces: DataFrame, config: Repeats, tables: Tables) -> tuple[list[DataFrame], list[DataFrame]]:
    """(pieces for shards, runs already known) of pieces whose anchor has too many fragments for a shard."""
    ready, runs, width = [], [], 1 << (config.length - config.anchor).bit_length()
    while not pieces.isEmpty():
        width //= 2
        cut = tables.stored(_halved(pieces, width, config.length), "halves")
        groups = cut.groupBy("k1", "k2").agg(F.count("*").alias("n"), *(f(F.xxhash64(x, "text")).alias(f"{f.__name__}{k}") for k, x in enumerate((F.lit(2), F.lit(3))) for f in (F.min, F.max)))
        alike = F.expr("min0 = max0 and min1 = max1")
        told = tables.stored(cut.join(grown(groups.where("n > 1")), ["k1", "k2"]).withColumn("alike", alike), "halves")
        tables.drop(cut)
        runs.append(told.where("alike").select("a", "f", F.col("at").alias("s"), F.expr("at + size").alias("e")))
        ready.append(told.where(~F.col("alike") & (F.col("n") <= config.group)).select("k1", "k2", "a", "f", "at", "text"))
        pieces = told.where(~F.col("alike") & (F.col("n") > config.group)).select("a", "f", "at", "size", "off", "text")
    return ready, runs


def _kept(length: int):
    """(h, text, runs of windows) -> (h, n_bytes, spans, kept): maximal removed runs of bytes, and the other bytes."""

    def run(batches):
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own, done, rest = [], 0, []
                for s, e in sorted((r["s"], r["e"] + length - 1) for r in runs):
                    if own and s <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], e)
                    else:
                        own.append({"start": s, "end": e})
                for x in own:
                    rest.append(text[done : x["start"]])
                    done = x["end"]
                spans.append(own)
                kept.append(b"".join([*rest, text[done:]]))
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["h", "n_bytes", "spans", "kept"])

    return run


def text_key(text_col: str = "text"):
    """Key of a text: 128 bits of its SHA-256; null is the empty text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)), 1, 16)


def without_repeats(docs: DataFrame, config: Repeats = Repeats(), text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """(h, n_bytes, spans, kept) of each distinct text of docs that loses bytes: its key, removed runs [start, end) and what is left, as bytes.

    A byte goes if a string of `length` bytes over it also starts anywhere else, in its own text or another row's, so all of a
    text of that size that stands in two rows goes. Matches never cross rows. Null, blank and shorter texts lose nothing and are
    not in the result; nor does the id or any other column of docs matter. A text is a unit of work: its runs meet in one row.
    """
    spark, tables = docs.sparkSession, tables or Tables(docs.sparkSession)
    length = config.length
    whole = docs.select(text_key(text_col).alias("h"), F.col(text_col).cast("string").cast("binary").alias("text")).where(F.octet_length("text") >= length)
    texts = tables.bucketed(whole.groupBy("h").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("twice")), "texts", "h")
    tables.drop(but=tuple(tables.paths.values()))
    with batches_of(spark):
        found = tables.stored(texts.select("h", "twice", "text").mapInArrow(lambda b: handed_back(_found(config)(b)), "h binary, twice boolean, at int, size int, off int, a bigint, f bigint"), "fragments")
    copies = F.sum(F.col("twice").cast("int") + 1).alias("n")
    again = tables.stored(found.groupBy("a").agg(copies, F.min("f").alias("lo"), F.max("f").alias("hi")).where("n > 1").select("a", F.expr("lo <> hi").alias("unlike")), "anchors")
    seen = tables.stored(found.join(grown(again), "a"), "seen")
    tables.drop(found, again)

    unlike = seen.where("unlike")
    wanted = unlike.groupBy("a", "f").agg(copies, F.min(F.struct("h", "at", "size", "off")).alias("place"))
    wanted = tables.stored(wanted.select("a", "f", "n", "place.*"), "wanted")
    crowded = wanted.groupBy("a").count().where(F.col("count") > config.group).select("a", F.lit(True).alias("crowded"))
    lists = wanted.join(grown(crowded), "a", "left").groupBy("h").agg(F.collect_list(F.struct("a", "f", "at", "size", "off", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("own"))
    cut = F.expr(f"transform(own, x -> struct(x.a, x.f, x.size, x.off, x.crowded, substring(text, x.at + 1, x.size + {length - 1}) as text))")
    pieces = texts.join(grown(lists), "h").select(F.explode(cut).alias("x")).select("x.*").withColumn("at", F.lit(0))
    pieces = tables.stored(pieces, "pieces")
    ready, runs = _settled(pieces.where("crowded"), config, tables)
    ready.append(pieces.where("not crowded").select(F.col("a").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "a", "f", "at", "text"))
    for more in ready[:-1]:
        ready[-1] = ready[-1].unionByName(more)
    size = ready[-1].agg(F.sum(F.length("text"))).first()[0] or 0
    shards = ready[-1].select(F.pmod(F.xxhash64("k1", "k2"), F.lit(max(1, math.ceil(size / config.shard_bytes)))).alias("shard"), "a", "f", "at", "text")
    runs.append(tables.stored(shards.groupBy("shard").applyInArrow(_expanded(length), "a bigint, f bigint, s int, e int"), "runs"))
    runs.append(wanted.where("n > 1").select("a", "f", F.lit(0).alias("s"), F.col("size").alias("e")))
    for more in runs[:-1]:
        runs[-1] = runs[-1].unionByName(more)
    hits = seen.where("not unlike").select("h", F.col("at").alias("s"), F.expr("at + size").alias("e"))
    hits = hits.unionByName(unlike.join(grown(runs[-1]), ["a", "f"]).select("h", F.expr("at + s").alias("s"), F.expr("at + e").alias("e")))
    lost = hits.groupBy("h").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    return texts.join(grown(lost), "h").select("h", "text", "runs").mapInArrow(_kept(length), "h binary, n_bytes int, spans array<struct<start: int, end: int>>, kept binary")


def summaries(docs: DataFrame, config: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): a row per row of docs, repeated and null ids too."""
    tables = Tables(docs.sparkSession)
    lost = without_repeats(docs, config, text_col, tables)
    removed = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)")
    with batches_of(docs.sparkSession):
        told = Tables(docs.sparkSession).stored(lost.select("h", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "removed")
    tables.drop()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("own"), text_key(text_col).alias("h"))
    out = own.join(grown(told), "h", "left")
    none = F.lit(0).cast("bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))
