"""Benchmark passages in documents (operator 9): one Aho-Corasick automaton over normalised windows of the items.

Texts are normalised to words of a-z, 0-9 and non-ASCII characters. Every run of `window` words of an item (or a shorter item as
a whole) is a pattern of word numbers; a document is scanned once, and hits are mapped back to places in the original text.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import Tables, binary, small_batches

#: Bytes that part words (fixed values of the contract): ASCII without digits and letters. The rest keeps, with A-Z lowered.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if b in SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Words of items in one automaton, which then has at most `window` nodes a word. More items are scanned in rounds, so what is sent
#: to the executors and what a worker holds have this bound (150,000 words took 92 MB).
MOST_WORDS = 200_000


def normalised(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def patterns(items: list[bytes], window: int) -> tuple[dict[bytes, int], dict[tuple, list[int]]]:
    """(numbers of words, pattern of such numbers -> numbers of the items that hold it)."""
    numbers: dict[bytes, int] = {}
    out: dict[tuple, list[int]] = {}
    for k, text in enumerate(items):
        words = [numbers.setdefault(w, len(numbers) + 1) for w in normalised(text)]
        for at in range(max(1, len(words) - window + 1) if words else 0):
            hits = out.setdefault(tuple(words[at : at + window]), [])
            if not hits or hits[-1] != k:
                hits.append(k)
    return numbers, out


def automaton(items: list[bytes], window: int):
    """(numbers of words, automaton over sequences of them, whose values are (words in the pattern, numbers of items))."""
    import ahocorasick

    numbers, found = patterns(items, window)
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    while found:  # patterns go as they are taken in, so memory holds them once
        words, hits = found.popitem()
        machine.add_word(words, (len(words), tuple(hits)))
    if len(machine):
        machine.make_automaton()
    return numbers, machine


#: The automaton that a worker keeps over its tasks, by the round's name.
_machines: dict = {}

_WORD = re.compile(b"[^" + re.escape(SEPARATORS) + b"]+")
_RANGE = [("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]


def merged(ranges: list[tuple]) -> list[tuple]:
    """Ranges (first, last, ...) of word numbers joined where they touch or overlap; further places join likewise."""
    out: list[tuple] = []
    for r in sorted(ranges):
        if out and r[0] <= out[-1][1] + 1:
            out[-1] = (out[-1][0], *((out[-1][1:]) if r[1] <= out[-1][1] else (r[1], *out[-1][2:3], *r[3:])))
        else:
            out.append(r)
    return out


def _placed(text: bytes, ranges: list[tuple]) -> list[tuple]:
    """Ranges of word numbers with their places in the original text (code points, end exclusive)."""
    places, out, at, points = [m.span() for m in _WORD.finditer(text)], [], 0, 0
    for a, b in ranges:
        start, end = places[a][0], places[b][1]
        points += len(text[at:start].decode("utf-8"))
        length = len(text[start:end].decode("utf-8"))
        out.append((a, b, points, points + length))
        at, points = end, points + length
    return out


def _scan(shared, name: str, window: int):
    """(id, mark, n_words, ranges, items) of every row: hit words with their places, and the items found."""

    def run(batches):
        if name not in _machines:
            _machines.clear()
            _machines[name] = automaton([t for _, t in shared.value], window)
        numbers, machine = _machines[name]
        names = [x for x, _ in shared.value]
        for batch in batches:
            marks, counts, ranges, found = [], [], [], []
            for text in binary(batch.column(1)):
                words = normalised(text)
                got, who = [], set()
                if words and len(machine):
                    for end, (n, hits) in machine.iter(tuple([numbers.get(w, 0) for w in words])):
                        got.append((end - n + 1, end))
                        who.update(hits)
                marks.append(xxhash.xxh64_intdigest(text) - 2**63 if text is not None else None)
                counts.append(len(words))
                ranges.append([dict(zip(("first", "last", "start", "end"), r, strict=True)) for r in _placed(text, merged(got))] if got else [])
                found.append(sorted(names[h] for h in who))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(pa.struct(_RANGE))), pa.array(found, pa.list_(pa.string()))], ["id", "mark", "n_words", "ranges", "items"])

    return run


def _report(batches):
    """Counts and spans of rows whose ranges and items came together from one round or several."""
    for batch in batches:
        hit, spans, items = [], [], []
        for ranges, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            own = merged([tuple(r.values()) for r in ranges])
            hit.append(sum(r[1] - r[0] + 1 for r in own))
            spans.append([{"start": r[2], "end": r[3]} for r in own])
            items.append(sorted(set(found)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)], ["id", "n_words", "n_hit", "items", "spans"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """(id, n_words, n_hit, items array<string> sorted, spans array<struct<start,end>>): one row per row of docs.

    Null or wordless texts have no words and no hits, on either side; null items are left out. A null item id counts as the
    string "null". Items that share a window are all named. Rows that repeat an id stay rows. Other columns are not read.
    More than most_words words of items go in rounds over the texts; only the rounds' numbers are brought together.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    tests = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    total = tests.agg(F.sum(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x80-\x{10FFFF}]+")))).first()[0] or 0
    rounds = -(-total // most_words) or 1
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, mark bigint, n_words bigint, ranges array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>, items array<string>"
    found = None
    for r in range(rounds):
        some = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(rounds)) == r).collect()  # about most_words words
        shared = spark.sparkContext.broadcast([(x.item, x.text.encode()) for x in some])
        one = rows.mapInArrow(_scan(shared, uuid.uuid4().hex, window), schema)
        if rounds > 1:
            one = tables.stored(one, "scanned")
        found = one if found is None else found.union(one)
    if rounds > 1:  # equal rows have equal numbers, so they meet in one group and part again
        found = found.groupBy("id", "mark", "n_words").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"), F.count("*").alias("seen"))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.expr(f"cast(seen / {rounds} as int)"))))
    out = found.select("id", "n_words", "ranges", "items").mapInArrow(_report, f"id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>")
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans")
