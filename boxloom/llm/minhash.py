"""Near-duplicate documents by min-max hashing (operator 3).

Each of `permutations` hash functions gives two signature values, its smallest and its largest over a document's shingles, so
64 functions give 128 values, of which 16 bits each are kept. Bands of 4 values send documents to buckets; a pair with similarity
0.8 misses all 32 bands with probability (1 - 0.8^4)^32 = 5e-8. The bands together are the whole signature, so a candidate pair whose
signatures agree in far too few values (7 standard deviations below the least similarity) is put aside without its sets. All other
candidates are confirmed on full shingle sets.

Documents with equal sets are one node from the start. A bucket's nodes are first compared with one of them, the hub: the node that
meets most others in its buckets, which in a group of edited copies is their original. Links give components. Buckets that still hold
several components go on with those of their nodes that can link at all, and there blocks of nodes meet blocks of nodes, as products of
0/1 shingle matrices. So a large group of copies costs a comparison per member, no pair list is made within a group, and no candidate
that could join two components is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import Tables, WordHashes, binary, grown, handed_back, shingle_hashes, small_batches, words_of
from boxloom.llm.graph import components


@dataclass(frozen=True)
class MinMax:
    """Words in a shingle, least similarity in percent, bands (of 4 values each), seed, nodes in a block."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    seed: int = 7
    block: int = 256

    @property
    def permutations(self) -> int:
        return self.bands * 2

    @property
    def least_equal(self) -> int:
        """Signature values in which a pair of the least similarity agrees, less 7 standard deviations."""
        n, p = 4 * self.bands, self.percent / 100
        return max(1, int(n * p - 7 * (n * p * (1 - p)) ** 0.5))


def signature(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Smallest values under every permutation, then largest ones. Long documents are taken in slices, so memory is bounded."""
    low, high = np.full(len(mult), 2**64 - 1, np.uint64), np.zeros(len(mult), np.uint64)
    for at in range(0, len(shingles), 4096):
        x = mult[:, None] * shingles[None, at : at + 4096] + add[:, None]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.concatenate([low, np.roll(high, len(high) // 4)])


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band: 16 bits of 4 values, two smallest and two largest, all of different permutations."""
    parts = values.astype(np.uint16).reshape(4, bands)
    return np.ascontiguousarray(parts.T).view(np.int64).ravel()


def _sign(config: MinMax):
    def run(batches):
        rng = np.random.default_rng(config.seed)
        mult = rng.integers(0, 2**63, config.permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, config.permutations, dtype=np.uint64)
        hashes = WordHashes()
        for batch in batches:
            n, keys, bands, ends = [], [], [], [0]
            for text in binary(batch.column(1)):
                s = shingle_hashes(words_of(text), config.shingle, hashes)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    bands.append(band_keys(signature(s, mult, add), config.bands))
                ends.append(ends[-1] + (config.bands if len(s) else 0))
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "n", "key", "bands"])

    return run


#: Bits of the map of wanted ids that goes to the executors: 4 MB, whatever the corpus.
MAP_BITS = 1 << 25


def _map_of(ids: DataFrame) -> np.ndarray:
    """A bit map of hashed ids, of fixed size: it leaves out what is not wanted, save for chance hits, which a join by set sorts out."""
    spots = ids.select(F.pmod(F.xxhash64("id"), F.lit(MAP_BITS)).alias("h")).select(F.expr("h div 32768").alias("part"), F.expr("h % 32768").alias("bit"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in spots.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _sets(config: MinMax, shared):
    """(key, shingles) of the texts whose hashed id is in the shared map."""

    def run(batches):
        hashes, bits = WordHashes(), shared.value
        for batch in batches:
            h = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((bits[h >> 3] >> (h & 7)) & 1 == 1))
            sets = [shingle_hashes(words_of(text), config.shingle, hashes) for text in binary(batch.column(1))]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "shingles"])

    return run


def _compare(config: MinMax):
    """Links between the asking and the asked nodes of two blocks, from products of their 0/1 shingle matrices in slices."""

    def run(table):
        asks = np.array(table.column("asks").to_pylist(), bool)
        nodes, comps = table.column("node").to_numpy(), table.column("component").to_numpy()
        lists = table.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        q, t = np.flatnonzero(asks), np.flatnonzero(~asks)
        out_a, out_b = nodes[:0], nodes[:0]
        if len(q) and len(t):
            row = np.repeat(np.arange(len(sizes)), sizes)
            _, at, seen = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
            keep = seen[at] > 1  # a shingle of one node is in no intersection
            row, at = row[keep], np.unique(at[keep], return_inverse=True)[1]
            order = np.argsort(at, kind="stable")
            row, at = row[order], at[order]
            both = np.zeros((len(q), len(t)), np.float32)
            for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
                i, j = np.searchsorted(at, [lo, lo + 4096])
                x = np.zeros((len(sizes), 4096), np.float32)
                x[row[i:j], at[i:j] - lo] = 1.0
                both += x[q] @ x[t].T
            inter = np.rint(both).astype(np.int64)
            union = sizes[q][:, None] + sizes[t][None, :] - inter
            a, b = np.nonzero((inter * 100 >= union * config.percent) & (comps[q][:, None] != comps[t][None, :]))
            # one link from each asking node to each component is as good as all
            _, first = np.unique(a * (len(sizes) + 1) + np.unique(comps[t], return_inverse=True)[1][b], return_index=True)
            out_a, out_b = nodes[q[a[first]]], nodes[t[b[first]]]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _block_links(open_: DataFrame, sets: DataFrame, config: MinMax, tables: Tables) -> DataFrame:
    """links(a, b) between nodes of different components in the buckets open_(band, node, component).

    Buckets that share nodes form one group. Its nodes outside the group's largest component ask all others, block against block.
    """
    ties = open_.join(grown(open_.groupBy("band").agg(F.min("node").alias("head"))), "band").select(F.col("node").alias("a"), F.col("head").alias("b")).where("a <> b")
    groups = components(ties, tables).select("node", F.col("component").alias("group"))
    nodes = tables.stored(open_.select("node", "component").distinct().join(grown(groups), "node"), "grouped")
    main = nodes.groupBy("group", "component").agg(F.count("*").alias("c")).groupBy("group").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("all"), (F.sum("c") - F.max("c")).alias("few"))
    main = main.select("group", "main", F.ceil(F.col("all") / config.block).cast("int").alias("nt"), F.ceil(F.col("few") / config.block).cast("int").alias("na")).where("na > 0")
    placed = nodes.join(grown(main), "group").join(grown(sets), "node")
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    columns = ["group", "qa", "qt", "asks", "node", "component", "shingles"]
    asking = placed.where("component <> main").withColumn("asks", F.lit(True)).withColumn("qa", spot("na")).withColumn("qt", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)))
    asked = placed.withColumn("asks", F.lit(False)).withColumn("qt", spot("nt")).withColumn("qa", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    return asking.select(columns).union(asked.select(columns)).groupBy("group", "qa", "qt").applyInArrow(_compare(config), "a bigint, b bigint")


def _several(open_: DataFrame) -> DataFrame:
    """Those rows of open_(band, node, component, ...) whose bucket holds more than one component."""
    ends = open_.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return open_.join(grown(ends.select("band")), "band", "left_semi")


def _able(open_: DataFrame, sets: DataFrame, config: MinMax) -> DataFrame:
    """open_ without nodes that can link to no other component: too many of their shingles are in no other component of open_."""
    left = open_.select("node", "component").distinct()
    seen = left.join(grown(sets), "node").select("node", "component", F.explode("shingles").alias("shingle"))
    both = seen.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    met = seen.join(grown(both), "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("met"))
    return open_.join(grown(met), "node").where(F.col("met") * 100 >= F.col("n") * config.percent).drop("met")


#: Equal values of the signatures ba and bb, for SQL.
_EQUAL = "aggregate(zip_with(ba, bb, (x, y) -> x ^ y), 0, (s, z) -> s + if(z & 65535 = 0, 1, 0) + if(z & 4294901760 = 0, 1, 0) + if(z & 281470681743360 = 0, 1, 0) + if(shiftrightunsigned(z, 48) = 0, 1, 0))"


def _hub_pairs(members: DataFrame, nodes: DataFrame, config: MinMax) -> DataFrame:
    """pairs(a, b) of every bucket's hub and other nodes whose sizes and signatures allow a link."""
    degree = members.groupBy("node").agg(F.sum("width").alias("degree"))
    ranked = members.join(grown(degree), "node").select("band", "node", "n", F.struct("degree", F.xxhash64("node").alias("h"), F.col("node").alias("a"), F.col("n").alias("na")).alias("hub"))
    hubs = ranked.groupBy("band").agg(F.max("hub").alias("hub")).select("band", "hub.a", "hub.na")
    fits = (F.col("a") != F.col("node")) & (F.least("n", "na") * 100 >= F.greatest("n", "na") * config.percent)
    pairs = members.join(grown(hubs), "band").where(fits).select("a", F.col("node").alias("b")).distinct()
    signs = nodes.select("node", "bands")
    pairs = pairs.join(grown(signs.select(F.col("node").alias("a"), F.col("bands").alias("ba"))), "a").join(grown(signs.select(F.col("node").alias("b"), F.col("bands").alias("bb"))), "b")
    return pairs.where(F.expr(_EQUAL) >= config.least_equal).select("a", "b")


def near_duplicates(docs: DataFrame, config: MinMax = MinMax(), id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row of docs.

    Null or blank texts have no shingles and link with nothing. Rows that repeat an id are compared each by its own text. A row
    without an id takes part through its text: its component is the smallest id of its group, null if there is none, and it is kept
    only then. Other columns are not read, so their names cannot clash. The result reads two of `tables`, which nothing else may use.
    """
    spark, tables = docs.sparkSession, tables or Tables(docs.sparkSession)
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    signed = tables.stored(texts.mapInArrow(lambda b: handed_back(_sign(config)(b)), f"id {kind}, n bigint, key binary, bands array<bigint>"), "signed")
    distinct = signed.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = tables.stored(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("width")).where("width > 1")
    members = tables.stored(banded.join(grown(shared), "band"), "members")

    wanted = members.select("node").distinct().join(grown(nodes.select("node", "key", "least")), "node")
    wanted = tables.stored(wanted, "wanted")
    shared = spark.sparkContext.broadcast(_map_of(wanted.select(F.col("least").alias("id"))))
    read = texts.select(F.pmod(F.xxhash64("id"), F.lit(MAP_BITS)).alias("h"), "text").mapInArrow(_sets(config, shared), "key binary, shingles array<bigint>")
    sets = tables.stored(read.join(grown(wanted.select("key", "node")), "key").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    pairs = tables.stored(_hub_pairs(members, nodes, config), "pairs")
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = pairs.join(grown(left), "a").join(grown(right), "b").where(both * 100 >= (F.size("sa") + F.size("sb") - both) * config.percent).select("a", "b")
    comp = components(links, tables)

    open_ = members.join(grown(comp), "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    open_ = tables.stored(_several(open_), "open")
    open_ = tables.stored(_several(_able(open_, sets, config)), "able")
    if not open_.isEmpty():
        more = _block_links(open_, sets, config, tables)
        comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), tables)

    named = nodes.select("key", "node", "least").join(grown(comp), "node", "left").select("key", "least", F.coalesce("component", "node").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    labelled = tables.stored(named.join(grown(first), "component").select("key", "first"), "labelled")
    tables.drop(but=(signed, labelled))
    out = signed.select("id", "n", "key").join(grown(labelled), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("first"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
