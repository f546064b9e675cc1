"""Language-model scores from a hierarchical Pitman-Yor model (operator 10).

Each word has a restaurant for the words that follow it; the end token stands before a text's first word and after its last. A
table of such a context restaurant is a customer of the one word restaurant, their parent. The base measure of the word restaurant
spells words character by character, by a hierarchy of restaurants: each pair of preceding characters has one, those that end in the
same character share a parent, and all parents share the root. A table of the word restaurant is a customer of the spelling
restaurants, and a table of a child is a customer of its parent.

Gibbs sweeps seat all customers anew, given the table totals of the last sweep. Words lie in buckets of their hashes and pairs in
buckets of theirs, each a row of arrays in the order of the hash. A bucket of words tells every bucket of pairs the tables and
probabilities of the words that it holds pairs of; there the pairs are seated, and the tables by first and second word go back, in the
same order. A pair seen once has one table in every sweep, so only pairs seen again are seated. Characters outside the `symbols` most
frequent ones share one symbol, so the spelling counts are a cube of at most (symbols + 2)^3 numbers whatever the corpus, and only that
cube meets on the driver. Sweeps after `burn_in` are averaged into the predictive probability.

Texts are read once. A chunk of documents becomes sequences over its own word list, and the sorted hashes of its distinct pairs, as
gaps, with their counts. Buckets of hashes count them over the corpus and tell every chunk which of its pairs were seen never, once or
again, and which of those it is to name; so a frequent pair costs some bits per chunk, not an entry per occurrence, and both words of
a pair are written down once.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import Tables, batches_of, binary, handed_back, mixed, new_path, removed, words_of


@dataclass(frozen=True)
class PitmanYor:
    """Sweeps, those not averaged, most frequent characters with a symbol of their own, strengths of words, spellings and context restaurants, spelling discounts by context length, base share of the end token, seed, tokens and words in a chunk, bytes of text for each bucket of pairs."""

    sweeps: int = 5
    burn_in: int = 2
    symbols: int = 110
    strength: float = 10.0
    spelling_strength: float = 2.0
    context_strength: float = 2.0
    spelling_discounts: tuple = (0.1, 0.4, 0.6)
    end_share: float = 1e-3
    seed: int = 5
    chunk_tokens: int = 4_000_000
    chunk_words: int = 600_000
    bucket_bytes: int = 16_000_000


#: Symbol of the end of a word (also before its start), and of characters without a symbol of their own (fixed values).
END, OTHER = 0, 1
#: Code points that share OTHER evenly (a fixed value of Unicode).
CODE_POINTS = 0x110000
#: The end token as a word (no word of a text is empty) and the seed of word hashes (fixed values).
END_WORD, HASH_SEED = b"", 42


class _Index(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, seed=HASH_SEED) for w in words), np.uint64, len(words))


def pair_hashes(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(u + np.uint64(0x9E3779B97F4A7C15)) + w)


def planes(x: np.ndarray) -> bytes:
    """An integer array with its bytes by rank, zstd-compressed: bytes of a high rank are mostly zero."""
    data = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""
    return pa.compress(data, "zstd", asbytes=True)


def from_planes(data: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def several(arrays: list[np.ndarray], dtype: str = "<i8") -> bytes:
    """Arrays of one length in one value."""
    return planes(np.concatenate(arrays).astype(dtype))


def from_several(data: bytes, count: int, n: int, dtype: str = "<i8") -> np.ndarray:
    return from_planes(data, dtype, count * n).reshape(count, n)


def rising(x: np.ndarray) -> bytes:
    """Ascending places, as gaps."""
    return planes(np.diff(x, prepend=0).astype("<i4"))


def from_rising(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_planes(data, "<i4", n))


#: Rows between chunks, buckets of words and buckets of pairs: what they are, the bucket, the chunk or bucket they come from or go to, entries, arrays.
PACKED = "kind string, at int, who bigint, n bigint, a binary, b binary"
PACKED_TYPES = {"kind": pa.string(), "at": pa.int32(), "who": pa.int64(), "n": pa.int64(), "a": pa.binary(), "b": pa.binary()}


def packed(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(PACKED_TYPES)
    return pa.table({k: pa.array(x, t) for (k, t), x in zip(PACKED_TYPES.items(), columns, strict=True)})


def unpacked(table: pa.Table, by: str) -> dict[str, list[tuple]]:
    """A group's rows by kind, as (by, n, a, b) in the order of by."""
    out = {k: [] for k in ("told", "key", "mass", "answer", "count", "name", "pairs", "say", "ts", "word", "once", "ask", "vocab", "asked", "held", "state", "seat", "cell")}
    for kind, *row in zip(*(table.column(c).to_pylist() for c in ("kind", by, "n", "a", "b")), strict=True):
        if kind in out:
            out[kind].append(tuple(row))
    for x in out.values():
        x.sort(key=lambda row: row[0])
    return out


def by_bucket(sorted_hashes: np.ndarray, bits: int):
    """(bucket, slice) of each bucket that has hashes: buckets are ranges of hashes."""
    edges = np.searchsorted(sorted_hashes >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
    return [(int(k), slice(int(edges[k]), int(edges[k + 1]))) for k in np.flatnonzero(np.diff(edges))]


def _steps(sequences: list[np.ndarray]):
    """(word before, word after, steps of each text): every text steps from the end token over its words to the end token."""
    sizes = np.fromiter((len(x) + 1 for x in sequences), np.int64, len(sequences))
    before, after = np.zeros(sizes.sum(), np.int32), np.zeros(sizes.sum(), np.int32)
    if len(sequences):
        all_ = np.concatenate(sequences)
        ends = np.cumsum(sizes) - 1
        inner = np.ones(len(after), bool)
        inner[ends] = False
        after[inner] = all_
        inner[:] = True
        inner[ends - sizes + 1] = False
        before[inner] = all_
    return before, after, sizes


def _first_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_values)), bool), sorted_values[1:] != sorted_values[:-1]]))


def _distinct_pairs(sequences: list[np.ndarray], held: np.ndarray, hashes: np.ndarray):
    """(hash, count in training documents) of a chunk's distinct pairs, in the order of the hash."""
    before, after, sizes = _steps(sequences)
    h = pair_hashes(hashes[before], hashes[after])
    apart = np.sort(h[np.repeat(held, sizes)])
    h.sort()
    at = _first_of(h)
    n = np.diff(np.append(at, len(h)))
    h = h[at]
    at = _first_of(apart)
    n[np.searchsorted(h, apart[at])] -= np.diff(np.append(at, len(apart)))
    return h, n


def _chunk_pairs(sequences: list[np.ndarray], hashes: np.ndarray, ranks: bool):
    """(numbers of a pair's two words, the pair of each step if asked for, steps of each text), pairs in the order of their hash."""
    before, after, sizes = _steps(sequences)
    h = pair_hashes(hashes[before], hashes[after])
    order = np.argsort(h)
    h = h[order]
    at = _first_of(h)
    first, pair = order[at], None
    if ranks:
        pair = np.empty(len(order), np.int64)
        pair[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
    return before[first], after[first], pair, sizes


def _chunked(config: PitmanYor, bits: int):
    """Documents as word numbers of their chunk, then the chunk's word hashes, and its words and pairs by bucket, with their counts in training documents."""

    def run(batches):
        chunk, index, seen, kind = TaskContext.get().partitionId() << 24, _Index({END_WORD: 0}), 0, pa.int64()
        sequences, held_out = [], []

        def closed():
            held = np.array(held_out, bool)
            listed = list(index)
            hashes = _hashes(listed)
            train = [x for x, out in zip(sequences, held_out, strict=True) if not out]
            counts = np.bincount(np.concatenate([*train, np.empty(0, np.int32)]), minlength=len(listed))
            counts[0] += len(train)
            order = np.argsort(hashes)
            rows = [("key", 0, chunk, len(listed), hashes.tobytes(), None)]
            for k, x in by_bucket(hashes[order], bits):
                own = order[x]
                rows.append(("word", k, chunk, len(own), b"\n".join([listed[i] for i in own.tolist()]), planes(counts[own])))
            h, n = _distinct_pairs(sequences, held, hashes)
            for k, x in by_bucket(h, bits):
                rows.append(("pair", k, chunk, x.stop - x.start, planes(np.diff(h[x], prepend=np.uint64(0))), planes(n[x].astype("<i4"))))
            for at in range(0, len(rows), 100):
                table = packed(rows[at : at + 100])
                yield from table.append_column("id", pa.nulls(len(table), kind)).append_column("held_out", pa.nulls(len(table), pa.bool_())).to_batches()

        for batch in batches:
            kind = batch.column(0).type
            lists = []
            for own in map(words_of, binary(batch.column(1))):
                lists.append(np.fromiter(map(index.__getitem__, own), np.int32, len(own)))
                seen += len(own)
            sequences += lists
            held_out += batch.column(2).to_pylist()
            table = packed([("doc", 0, chunk, len(x), planes(x), None) for x in lists])
            yield from table.append_column("id", batch.column(0)).append_column("held_out", batch.column(2)).to_batches()
            if seen > config.chunk_tokens or len(index) > config.chunk_words:
                yield from closed()
                chunk, index, seen = chunk + 1, _Index({END_WORD: 0}), 0
                sequences, held_out = [], []
        if sequences:
            yield from closed()

    return run


#: What a chunk is told of a pair: seen never in training, once, once and the chunk's to name, again, again and the chunk's to name.
NEVER, ONCE, OWN_ONCE, AGAIN, OWN_AGAIN = range(5)


def _counted(table: pa.Table) -> pa.Table:
    """Of a bucket of pairs: for each chunk its pairs' states in the order of the hash, and the places of those seen again in the bucket's list; the counts of that list."""
    at_, table = table.column("at")[0].as_py(), table.sort_by("who")
    sizes = table.column("n").to_numpy()
    h = np.concatenate([np.cumsum(from_planes(x, "<u8", n), dtype=np.uint64) for x, n in zip(table.column("a").to_pylist(), sizes, strict=True)])
    own = np.concatenate([from_planes(x, "<i4", n) for x, n in zip(table.column("b").to_pylist(), sizes, strict=True)])
    _, first, at = np.unique(h, return_index=True, return_inverse=True)
    c = np.bincount(at, own, len(first)).astype(np.int64)
    place = np.cumsum(c > 1) - 1
    state = np.where(c > 1, AGAIN, np.where(c == 1, ONCE, NEVER))[at].astype(np.uint8)
    state[first[c > 0]] += 1
    place, again, edges = place[at], c[c > 1], np.cumsum([0, *sizes])
    rows = [("count", at_, 0, len(again), planes(again), None)]
    for who, i, j in zip(table.column("who").to_pylist(), edges, edges[1:], strict=False):
        told = state[i:j]
        rows.append(("told", at_, who, j - i, planes(told), rising(place[i:j][told >= AGAIN])))
    return packed(rows)


def _states(told: list[tuple]) -> list[np.ndarray]:
    return [from_planes(a, "u1", n) for _, n, a, _ in told]


def _parted(rows: pa.Table):
    """(documents of a chunk, their sequences, what else is in the group by kind)."""
    is_doc = pa.compute.equal(rows.column("kind"), "doc")
    docs = rows.filter(is_doc)
    return docs, [from_planes(x, "<i4", n) for x, n in zip(docs.column("a").to_pylist(), docs.column("n").to_pylist(), strict=True)], unpacked(rows.filter(pa.compute.invert(is_doc)), "at")


def _named(bits: int):
    """Both words' hashes of the pairs seen again that a chunk is to name, for their buckets; for the buckets of its words, how many of the pairs seen once that it is to name begin and end with each."""

    def run(rows: pa.Table) -> pa.Table:
        _, sequences, got = _parted(rows)
        who = rows.column("who")[0].as_py()
        hashes = np.frombuffer(got["key"][0][2], np.uint64)
        u, w, _, _ = _chunk_pairs(sequences, hashes, False)
        out, start, once = [], 0, np.zeros(len(u), bool)
        for (at, n, _, spots), x in zip(got["told"], _states(got["told"]), strict=True):
            own = np.flatnonzero(x == OWN_AGAIN) + start
            many = x[x >= AGAIN]
            once[start : start + n] = x == OWN_ONCE
            if len(own):
                out.append(("name", at, who, len(own), rising(from_rising(spots, len(many))[many == OWN_AGAIN]), np.concatenate([hashes[u[own]], hashes[w[own]]]).tobytes()))
            start += n
        order = np.argsort(hashes)
        begins, ends = (np.bincount(x[once], minlength=len(hashes))[order] for x in (u, w))
        out += [("once", k, who, x.stop - x.start, planes(begins[x].astype("<i4")), planes(ends[x].astype("<i4"))) for k, x in by_bucket(hashes[order], bits)]
        return packed(out)

    return run


def _linked(bits: int):
    """A bucket's pairs seen again, with their words numbered in the order of the hash; each bucket of words is asked for those it holds, and told in how many of the pairs they are first and second."""

    def run(table: pa.Table) -> pa.Table:
        at, got = table.column("at")[0].as_py(), unpacked(table, "who")
        _, n, counts, _ = got["count"][0]
        if not n:
            return packed([])
        c = from_planes(counts, "<i8", n)
        names = np.empty((2, n), np.uint64)
        for _, k, spots, both in got["name"]:
            names[:, from_rising(spots, k)] = np.frombuffer(both, np.uint64).reshape(2, k)
        words, number = np.unique(names.ravel(), return_inverse=True)
        u, w = number.reshape(2, n)
        first, second = np.bincount(u, minlength=len(words)), np.bincount(w, minlength=len(words))
        rows = [("pairs", at, 0, n, planes(c), several([u, w], "<i4")), ("fact", TWICE, 0, int((c == 2).sum()), None, None)]
        for k, x in by_bucket(words, bits):
            rows.append(("ask", k, at, x.stop - x.start, planes(np.diff(words[x], prepend=np.uint64(0))), several([first[x], second[x]])))
        return packed(rows)

    return run


#: Sums over all buckets: training tokens, distinct words, customers of the word restaurant, words with one and with two of them, pairs seen once and twice, tables of the word restaurant.
TOKENS, WORDS, CUSTOMERS, WORD_ONCE, WORD_TWICE, ONE, TWICE, TABLES = range(8)


def _vocabulary(table: pa.Table) -> pa.Table:
    """A bucket's words of the training documents, in the order of the hash, with their counts and first seating; where each bucket of pairs and each chunk has its words in this list; characters of the words."""
    at, got = table.column("at")[0].as_py(), unpacked(table, "who")
    listed = [w for _, _, blob, _ in got["word"] for w in blob.split(b"\n")]
    h, first, number = np.unique(_hashes(listed), return_index=True, return_inverse=True)
    c = np.bincount(number, np.concatenate([from_planes(x, "<i8", n) for _, n, _, x in got["word"]])).astype(np.int64)
    once = [np.bincount(number, np.concatenate([from_planes(x[k], "<i4", x[1]) for x in got["once"]])).astype(np.int64)[c > 0] for k in (2, 3)]
    known = c > 0
    place, h, c = np.cumsum(known) - 1, h[known], c[known]
    words = [listed[i] for i in first[known].tolist()]
    tables, customers = (x.copy() for x in once)
    rows = []
    for who, n, gaps, counts in got["ask"]:
        pos = np.searchsorted(h, np.cumsum(from_planes(gaps, "<u8", n), dtype=np.uint64))
        more = from_several(counts, 2, n)
        tables[pos] += more[0]
        customers[pos] += more[1]
        rows.append(("asked", at, who, n, rising(pos), None))
    start = 0
    for who, n, _, _ in got["word"]:
        own = number[start : start + n]
        rows.append(("held", at, who, n, planes(known[own].astype("u1")), rising(place[own][known[own]])))
        start += n
    if len(words):
        rows.append(("vocab", at, 0, len(words), b"\n\n".join(words), several([c, *once])))
        rows.append(("state", at, 0, len(words), several([tables, customers, np.ones(len(words), np.int64)]), None))
        codes, n = np.unique(np.frombuffer(b"".join(words).decode("utf-8", "replace").encode("utf-32-le"), "<u4"), return_counts=True)
        rows += [("char", int(k), 0, int(x), None, None) for k, x in zip(codes, n, strict=True)]
    facts = {TOKENS: c.sum(), WORDS: len(words), CUSTOMERS: customers.sum(), WORD_ONCE: (customers == 1).sum(), WORD_TWICE: (customers == 2).sum(), ONE: once[0].sum()}
    return packed(rows + [("fact", k, 0, int(x), None, None) for k, x in facts.items()])


def tables_served(customers: np.ndarray, pull: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables after seating each dish's customers one by one; pull = (strength + discount * tables in the restaurant) * base probability.

    A customer opens a table with chance pull / (seated - discount * tables + pull); the first always does. From the 16th on,
    customers come in groups of a sixteenth of those seated, each group with the chance at its start.
    """
    t = (customers > 0).astype(np.int64)
    k, left = 1, np.flatnonzero(customers > 1)
    while len(left):
        group = max(1, k // 16)
        p = pull[left] / np.maximum(k - discount * t[left] + pull[left], 1e-300)
        t[left] += rng.binomial(np.minimum(group, customers[left] - k), np.minimum(p, 1.0))
        k += group
        left = left[customers[left] > k]
    return t


@dataclass(frozen=True)
class Seating:
    """What a sweep leaves for all words: logarithms of the spelling cube (None before the first), tables and customers of the word restaurant, and its discount."""

    cube: np.ndarray | None
    tables: float
    customers: float
    discount: float

    def pull(self, config: PitmanYor) -> float:
        return config.strength + self.discount * self.tables

    def probability(self, config: PitmanYor, base: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discount * tables + self.pull(config) * np.exp(base)) / (config.strength + self.customers)


def symbol_table(symbols: dict[int, int]) -> np.ndarray:
    table = np.full(CODE_POINTS, OTHER, np.uint8)
    for code, symbol in symbols.items():
        table[code] = symbol
    return table


def spelled(words: bytes, table: np.ndarray):
    """(symbols, starts, pads) of words parted by two line feeds: one array of symbols, each word after two ENDs; pads are the second ENDs."""
    codes = np.frombuffer(("\n\n" + words.decode("utf-8", "replace") + "\n\n").encode("utf-32-le"), "<u4")
    symbols = table[codes].astype(np.int64)
    ends = np.flatnonzero(codes == 10)
    symbols[ends] = END
    pads = ends[1::2]
    return symbols, pads[:-1] + 1, pads


def _base_logs(words: bytes, table: np.ndarray, cube, end_share: float):
    """(logarithms of the words' base probabilities, where the end token is)."""
    symbols, starts, pads = spelled(words, table)
    ended = pads[1:] - starts == 1
    if cube is None:
        logs = np.full(len(starts), -20.0)
    else:
        each = np.zeros(len(symbols))
        each[2:] = cube[symbols[:-2], symbols[1:-1], symbols[2:]]
        each[2:][symbols[2:] == OTHER] -= math.log(CODE_POINTS)
        each[pads] = 0.0
        logs = np.add.reduceat(each, starts)
    return np.where(ended, math.log(end_share), logs + math.log1p(-end_share)), ended


def _cells(words: bytes, t: np.ndarray, table: np.ndarray, a: int):
    """The symbols of the spellings of words' tables, as (cells of the cube, tables)."""
    symbols, starts, pads = spelled(words, table)
    weight = np.concatenate([np.zeros(2, np.int64), np.repeat(t, np.diff(starts, append=len(symbols)))])
    weight[pads] = 0
    weight[starts[pads[1:] - starts == 1]] = 0  # the end token is not spelled
    cells = np.bincount((symbols[:-2] * a + symbols[1:-1]) * a + symbols[2:], weight[2:], a**3).astype(np.int64)
    live = np.flatnonzero(cells)
    return live, cells[live]


def _said(config: PitmanYor, shared):
    """What a bucket of words tells each bucket of pairs of its words: tables of their restaurants, probabilities in the word restaurant."""

    def run(table: pa.Table) -> pa.Table:
        at, got = table.column("at")[0].as_py(), unpacked(table, "who")
        symbols, seating = shared.value
        if not got["vocab"]:
            return packed([])
        _, n, words, _ = got["vocab"][0]
        tables, c1, t1 = from_several(got["state"][0][2], 3, n)
        base, _ = _base_logs(words, symbol_table(symbols), seating.cube, config.end_share)
        p1 = seating.probability(config, base, c1, t1).astype("<f4")
        places = [(who, from_rising(gaps, k)) for who, k, gaps, _ in got["asked"]]
        return packed([("say", who, at, len(x), planes(tables[x]), planes(p1[x])) for who, x in places])

    return run


def _seat_pairs(config: PitmanYor, sweep: int, discount: float, keep: bool):
    """Seats a bucket's pairs seen again, given the last sweep's tables of their context and probability of their word; tells each bucket of words the tables by first and by second word."""

    def run(table: pa.Table) -> pa.Table:
        at, got = table.column("at")[0].as_py(), unpacked(table, "who")
        _, n, counts, numbers = got["pairs"][0]
        c, (u, w) = from_planes(counts, "<i8", n), from_several(numbers, 2, n, "<i4")
        tables = np.concatenate([from_planes(x, "<i8", k) for _, k, x, _ in got["say"]])
        p = np.concatenate([from_planes(x, "<f4", k) for _, k, _, x in got["say"]]).astype(float)
        t = tables_served(c, (config.context_strength + discount * tables[u]) * p[w], discount, np.random.default_rng([config.seed, sweep, 0, at]))
        first, second = (np.bincount(x, t, len(p)).astype(np.int64) for x in (u, w))
        rows, start = [("ts", at, sweep, n, planes(t), None)] * keep, 0
        for who, k, _, _ in got["say"]:
            rows.append(("seat", who, at, k, planes(first[start : start + k]), planes(second[start : start + k])))
            start += k
        return packed(rows)

    return run


#: Parts of the spelling cube that are summed apart.
CUBE_PARTS = 8


def _seat_words(config: PitmanYor, sweep: int, shared):
    """Seats a bucket's words, their customers being the tables of the context restaurants; the cells of the spelling cube that their tables fill."""

    def run(table: pa.Table) -> pa.Table:
        at, got = table.column("at")[0].as_py(), unpacked(table, "who")
        symbols, seating = shared.value
        if not got["vocab"]:
            return packed([])
        _, n, words, counts = got["vocab"][0]
        _, tables, c1 = from_several(counts, 3, n)
        spots = {who: from_rising(gaps, k) for who, k, gaps, _ in got["asked"]}
        for who, k, first, second in got["seat"]:
            tables[spots[who]] += from_planes(first, "<i8", k)
            c1[spots[who]] += from_planes(second, "<i8", k)
        codes = symbol_table(symbols)
        base, _ = _base_logs(words, codes, seating.cube, config.end_share)
        t1 = tables_served(c1, seating.pull(config) * np.exp(base), seating.discount, np.random.default_rng([config.seed, sweep, 1, at]))
        a = len(symbols) + 2
        live, t = _cells(words, t1, codes, a)
        part = live * CUBE_PARTS // a**3
        rows = [("state", at, sweep, n, several([tables, c1, t1]), None), ("fact", TABLES, 0, int(t1.sum()), None, None), ("fact", CUSTOMERS, 0, int(c1.sum()), None, None)]
        rows += [("cell", k, at, int((part == k).sum()), rising(live[part == k]), planes(t[part == k])) for k in np.unique(part).tolist()]
        return packed(rows)

    return run


def _added(table: pa.Table) -> pa.Table:
    """A part of the spelling cube, summed over the buckets of words."""
    at, got = table.column("at")[0].as_py(), unpacked(table, "who")["cell"]
    cells = np.concatenate([from_rising(x, n) for _, n, x, _ in got])
    t = np.bincount(cells - cells.min(), np.concatenate([from_planes(x, "<i8", n) for _, n, _, x in got])).astype(np.int64)
    live = np.flatnonzero(t)
    return packed([("cell", at, 0, len(live), rising(live + cells.min()), planes(t[live]))])


def seat_spelling(counts: np.ndarray, config: PitmanYor, totals: list, rng):
    """One sweep from the longest contexts to the root: (cube of log probabilities, table totals by level)."""
    a = counts.shape[0]
    d = config.spelling_discounts
    uniform = np.full(a, 1.0 / a)
    root_base = totals[3] if totals else [np.broadcast_to(uniform, (a, a)), uniform]
    t3, t2 = np.zeros_like(counts), np.zeros((a, a), np.int64)
    held = totals or [np.zeros((a, a)), np.zeros(a), 0.0]
    live = np.nonzero(counts)
    pull = (config.spelling_strength + d[2] * held[0][live[0], live[1]]) * root_base[0][live[1], live[2]]
    t3[live] = tables_served(counts[live], pull, d[2], rng)
    n2 = t3.sum(axis=0)
    live2 = np.nonzero(n2)
    t2[live2] = tables_served(n2[live2], (config.spelling_strength + d[1] * held[1][live2[0]]) * root_base[1][live2[1]], d[1], rng)
    n1 = t2.sum(axis=0)
    t1 = tables_served(n1, (config.spelling_strength + d[0] * held[2]) * uniform, d[0], rng)
    s = config.spelling_strength
    p1 = (n1 - d[0] * t1 + (s + d[0] * t1.sum()) * uniform) / (s + n1.sum())
    p2 = (n2 - d[1] * t2 + (s + d[1] * t2.sum(axis=1, keepdims=True)) * p1[None, :]) / (s + n2.sum(axis=1, keepdims=True))
    p3 = (counts - d[2] * t3 + (s + d[2] * t3.sum(axis=2, keepdims=True)) * p2[None, :, :]) / (s + counts.sum(axis=2, keepdims=True))
    return np.log(p3).astype(np.float32), [t3.sum(axis=2), t2.sum(axis=1), float(t1.sum()), [p2, p1]]


def _answers(config: PitmanYor, shared):
    """For each chunk's words of a bucket in the order of the hash: count, and tables and probability of every sample; the sums of the bucket's base probabilities."""

    def run(table: pa.Table) -> pa.Table:
        at, got = table.column("at")[0].as_py(), unpacked(table, "who")
        symbols, seatings = shared.value
        n, numbers, chances, rows = 0, np.zeros((1 + len(seatings), 0), np.int64), np.zeros((len(seatings), 0), np.float32), []
        if got["vocab"]:
            _, n, words, counts = got["vocab"][0]
            codes, numbers, chances, spelt = symbol_table(symbols), [from_several(counts, 3, n)[0]], [], []
            for seating, (_, _, state, _) in zip(seatings, got["state"], strict=True):
                tables, c1, t1 = from_several(state, 3, n)
                base, ended = _base_logs(words, codes, seating.cube, config.end_share)
                numbers.append(tables)
                chances.append(seating.probability(config, base, c1, t1))
                spelt.append(np.exp(base)[~ended].sum())
            numbers, chances = np.stack(numbers), np.array(chances).reshape(len(seatings), n)
            rows.append(("spelt", at, -1, len(spelt), np.array(spelt).tobytes(), None))
        for who, k, mask, gaps in got["held"]:
            known = np.flatnonzero(from_planes(mask, "u1", k))
            x = from_rising(gaps, len(known))
            ints, floats = np.zeros((len(numbers), k), np.int64), np.zeros((len(chances), k), "<f4")
            ints[:, known], floats[:, known] = numbers[:, x], chances[:, x]
            rows.append(("answer", at, who, k, several(list(ints)), planes(floats.ravel())))
        return packed(rows)

    return run


def _masses(samples: int):
    """For each chunk's pairs of a bucket that were seen again, customers and every sample's tables, in the order of the hash."""

    def run(table: pa.Table) -> pa.Table:
        at, got = table.column("at")[0].as_py(), unpacked(table, "who")
        held = np.zeros((samples + 1, 0), "<i8")
        for _, n, counts, _ in got["pairs"]:
            held = np.stack([from_planes(x, "<i8", n) for x in (counts, *(t for _, _, t, _ in got["ts"]))])
        rows = []
        for (who, n, states, spots), x in zip(got["told"], _states(got["told"]), strict=True):
            rows.append(("mass", at, who, n, states, planes(held[:, from_rising(spots, int((x >= AGAIN).sum()))].ravel())))
        return packed(rows)

    return run


def _mass(told: list[tuple], samples: int, discount: float) -> np.ndarray:
    """Customers less discounts in every sample, for a chunk's pairs in the order of the hash."""
    out = []
    for (_, _, _, data), state in zip(told, _states(told), strict=True):
        many = state >= AGAIN
        held = from_several(data, samples + 1, int(many.sum()))
        mass = np.tile(np.where((state == ONCE) | (state == OWN_ONCE), 1 - discount, 0.0), (samples, 1))
        mass[:, many] = np.maximum(held[0] - discount * held[1:], 0.0)
        out.append(mass)
    return np.concatenate([*out, np.empty((samples, 0))], axis=1)


def _sum_up(unknown: list[float], low: float, discount: float, config: PitmanYor, n_train: int):
    """The sums of a chunk's documents, from the chunk's answers by word and by pair in the order of the hash."""

    def run(rows: pa.Table) -> pa.Table:
        docs, sequences, got = _parted(rows)
        samples = len(unknown)
        hashes = np.frombuffer(got["key"][0][2], np.uint64)
        order = np.argsort(hashes)
        context, tables, p1 = np.zeros(len(hashes)), np.zeros((samples, len(hashes))), np.zeros((samples, len(hashes)))
        ints = np.concatenate([from_several(a, samples + 1, n) for _, n, a, _ in got["answer"]], axis=1)
        context[order], tables[:, order] = ints[0], ints[1:]
        p1[:, order] = np.concatenate([from_several(b, samples, n, "<f4") for _, n, _, b in got["answer"]], axis=1)
        known, base = context > 0, np.log10((context + 0.1) / low)
        p1[:, ~known] = np.array(unknown)[:, None]
        if not known[0]:  # no training document: the end token has its base share
            p1[:, 0] = config.end_share
        share = (config.context_strength + discount * tables) / (config.context_strength + context)
        u, w, pair, sizes = _chunk_pairs(sequences, hashes, True)
        chance = np.zeros(len(u))
        mass = _mass(got["mass"], samples, discount)
        for k in range(samples):
            chance += mass[k] / (config.context_strength + context[u]) + share[k][u] * p1[k][w]
        starts = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(x[pair], starts) for x in (known[w].astype(np.int64), base[w], np.log10(chance / samples))]
        n = docs.num_rows
        return pa.table({"id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(docs.column("n").to_numpy() + 1), "n_known": pa.array(sums[0]), "train_tokens": pa.array(np.full(n, n_train, np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    return run


def scores(docs: DataFrame, config: PitmanYor = PitmanYor(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row per row of docs, scores as log10.

    A document is held out of training if crc32 of its id as text is divisible by 10; a null id counts as empty text. Null or
    blank texts hold the end token alone. Without any training document both models fall back to their base. Words are never
    dropped, whatever their length or count. As in the base, words unseen in training are one event: what a new table has left
    after the spellings of all known words. Other columns are not read.
    """
    spark, kept = docs.sparkSession, Tables(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("held_out", F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 10 == 0)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, math.ceil(math.log2(1 + size / config.bucket_bytes)))
    path = new_path(spark, "chunks")
    schema = f"{PACKED}, id {kind}, held_out boolean"
    with batches_of(spark):
        rows.mapInArrow(lambda b: handed_back(_chunked(config, bits)(b)), schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)

    columns = ["kind", "at", "who", "n", "a", "b"]

    def chunks(*kinds, more=()):
        return spark.read.schema(schema).parquet(path).where(F.col("kind").isin(*kinds)).select(*columns, *more)

    def grouped(key, run, *frames):
        joined = frames[0]
        for x in frames[1:]:
            joined = joined.unionByName(x, allowMissingColumns=True)
        return joined.groupBy(key).applyInArrow(run, PACKED)

    def of(frame, *kinds):
        return frame.where(F.col("kind").isin(*kinds)).select(*columns)

    def facts_of(*frames):
        found = [of(x, "fact").groupBy("at").agg(F.sum("n").alias("n")).collect() for x in frames]
        return Counter({r["at"]: r["n"] for x in found for r in x})

    def from_chunks():
        return chunks("doc", more=("id", "held_out")).unionByName(chunks("key"), allowMissingColumns=True)

    told = kept.parted(grouped("at", _counted, chunks("pair")), "told")
    removed(spark, f"{path}/kind=pair")
    kept.swept()
    named = kept.parted(grouped("who", _named(bits), from_chunks(), of(told, "told")), "named")
    kept.swept()
    links = kept.parted(grouped("at", _linked(bits), of(told, "count"), of(named, "name")), "links")
    words = kept.parted(grouped("at", _vocabulary, chunks("word"), of(named, "once"), of(links, "ask")), "vocabulary")
    kept.drop(named)
    removed(spark, f"{path}/kind=word")

    facts = facts_of(words, links)
    n_train, n_words = facts[TOKENS], facts[WORDS]

    def discount_of(n1, n2):
        return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5

    discount, own = discount_of(facts[WORD_ONCE], facts[WORD_TWICE]), discount_of(facts[ONE], facts[TWICE])
    low = n_train + 0.1 * (n_words + 1)
    codes = of(words, "char").groupBy("at").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "at").limit(config.symbols)
    symbols = {r["at"]: k + 2 for k, r in enumerate(codes.collect())}
    a = len(symbols) + 2
    rng = np.random.default_rng(config.seed)
    seating, totals, sampled = Seating(None, float(n_words), float(facts[CUSTOMERS]), discount), [], []
    state = words
    for sweep in range(1, config.sweeps + 1):
        keep, shared = sweep > config.burn_in, spark.sparkContext.broadcast((symbols, seating))
        said = grouped("at", _said(config, shared), of(words, "vocab", "asked"), of(state, "state"))
        seated = kept.parted(grouped("at", _seat_pairs(config, sweep, own, keep), of(links, "pairs"), said), "seated")
        before, state = state, kept.parted(grouped("at", _seat_words(config, sweep, shared), of(words, "vocab", "asked"), of(seated, "seat")), "state")
        if before is not words and not any(before is x for _, _, x in sampled):
            kept.drop(before)
        cube = np.zeros(a**3, np.int64)
        for r in grouped("at", _added, of(state, "cell")).collect():
            cube[from_rising(r.a, r.n)] = from_planes(r.b, "<i8", r.n)
        cube, totals = seat_spelling(cube.reshape(a, a, a), config, totals, rng)
        facts = facts_of(state)
        seating = Seating(cube, float(facts[TABLES]), float(facts[CUSTOMERS]), discount)
        if keep:
            sampled.append((seating, seated, state))
        else:
            kept.drop(seated)

    shared = spark.sparkContext.broadcast((symbols, [x for x, _, _ in sampled]))
    answers = kept.parted(grouped("at", _answers(config, shared), of(words, "vocab", "held"), *(of(x, "state") for _, _, x in sampled)), "answers")
    spelt = sum((np.frombuffer(r.a) for r in of(answers, "spelt").orderBy("at").collect()), np.zeros(len(sampled)))
    unknown = [max(x.pull(config) / (config.strength + x.customers) * (1 - config.end_share - s), 1e-12) for (x, _, _), s in zip(sampled, spelt.tolist(), strict=True)]
    masses = kept.parted(grouped("at", _masses(len(sampled)), of(told, "told"), of(links, "pairs"), *(of(x, "ts") for _, x, _ in sampled)), "masses")
    kept.drop(but=(answers, masses))
    joined = from_chunks().unionByName(of(answers, "answer"), allowMissingColumns=True).unionByName(of(masses, "mass"), allowMissingColumns=True)
    out = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return joined.groupBy("who").applyInArrow(_sum_up(unknown, low, own, config, n_train), out).withColumnRenamed("id", id_col)
