"""Near-duplicate vectors (operator 4): spherical k-means cells, blocked cosine products inside cells, one vector kept per group.

Vectors of one label (and one length) are assigned to the cell of the nearest centre. A pair may lie across a border, so a vector
is also a guest of every cell whose border is near enough: if y lies in cell j, then y.(cj - ci) >= 0, and a vector x of cell i
within the link angle t of y has x.(ci - cj) <= sin(t) |ci - cj|. Each vector therefore meets all its partners in its own cell, and
the result is exact. Equal vectors are one row from the start. Cells that are still large are split in the same way, as long as that
makes them smaller, so their number grows with the label. A cell is cut into blocks, and a task compares two blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import Tables, small_batches
from boxloom.llm.graph import components


@dataclass(frozen=True)
class Cells:
    """Least cosine, vectors aimed at in a cell, most parts a cell is split into at once, vectors that place their centres, vectors assigned in a task, share of a cell that a part may have to be split again, rounds of k-means, vectors in a block, seed."""

    cosine: float = 0.93
    in_cell: int = 2000
    parts: int = 64
    sample: int = 8192
    lot: int = 4096
    shrink: float = 0.7
    rounds: int = 8
    block: int = 512
    seed: int = 3


def usable(vector) -> np.ndarray | None:
    """The vector in double precision, or None where it links with nothing: null, empty, zero, or not all finite numbers."""
    if vector is None or len(vector) == 0 or any(v is None for v in vector):
        return None
    x = np.array(vector, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _keys(batches):
    for batch in batches:
        vectors = [None if label is None else usable(v) for v, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        raw = [None if v is None else v.astype("<f8").tobytes() for v in vectors]
        keys = [None if b is None else xxhash.xxh3_128_digest((v + 0.0).astype("<f8").tobytes()) for b, v in zip(raw, vectors, strict=True)]
        dims = [None if v is None else len(v) for v in vectors]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "key", "dim", "vector"])


def _units(table) -> np.ndarray:
    x = np.stack([np.frombuffer(b, "<f8") for b in table])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(config: Cells):
    """Spherical k-means on the sample of one cell: its centres, in one row."""

    def run(key, table):
        table = table.sort_by("node")
        x = _units(table.column("vector").to_pylist())
        k = max(1, min(config.parts, len(x), -(-table.column("total")[0].as_py() // config.in_cell)))
        rng = np.random.default_rng(config.seed)
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(config.rounds if k > 1 else 0):
            own = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
        columns = {"label": [key[0].as_py()], "dim": [key[1].as_py()], "cell": [key[2].as_py()], "centres": [[v.astype("<f8").tobytes() for v in c]]}
        return pa.table(columns, schema=pa.schema([("label", table.schema.field("label").type), ("dim", pa.int32()), ("cell", pa.int64()), ("centres", pa.list_(pa.binary()))]))

    return run


def _assign(config: Cells):
    """A lot of a cell's vectors, each in the part of its nearest centre and, as a guest, in those whose border is near enough."""
    reach = math.sin(min(math.acos(max(-1.0, min(1.0, config.cosine))) + 1e-9, math.pi / 2))

    def run(table, centres):
        names = ["label", "dim", "cell", "total", "node", "copies", "vector", "home"]
        part, at, homes = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows), table.column("home").to_numpy(zero_copy_only=False)
        if table.num_rows and centres.num_rows:
            c = np.stack([np.frombuffer(b, "<f8") for b in centres.column("centres")[0].as_py()])
            gaps = np.sqrt(np.maximum(2 - 2 * np.clip(c @ c.T, -1, 1), 0))
            dots = _units(table.column("vector").to_pylist()) @ c.T
            own = np.argmax(dots, axis=1)
            near = dots[at, own][:, None] - dots <= reach * gaps[own] + 1e-12
            near[at, own] = True
            rows, part = np.nonzero(near)
            homes, at = homes[rows] & (part == own[rows]), rows
        out = table.select(names[:-1]).take(pa.array(at))
        return out.append_column("home", pa.array(homes, pa.bool_())).append_column("part", pa.array(part, pa.int64()))

    return run


def _cells(nodes: DataFrame, label: str, config: Cells, tables: Tables) -> DataFrame:
    """(label, dim, cell, node, copies, vector, home): every vector at home in one cell and a guest of others."""
    keys, columns = ["label", "dim", "cell"], ["label", "dim", "cell", "node", "copies", "vector", "home"]
    left = nodes.select("label", "dim", F.lit(0).cast("bigint").alias("cell"), "node", "copies", "vector", F.lit(True).alias("home"))
    limit, done = F.lit(float("inf")), None
    while True:
        sizes = left.groupBy(keys).agg(F.count("*").alias("total"), F.count_if("home").alias("own"), F.min(limit).alias("limit"))
        sizes = tables.stored(sizes, "sizes")
        large = (F.col("total") > 2 * config.in_cell) & (F.col("own") > 0) & (F.col("total") <= F.col("limit"))
        rest = left.join(sizes.where(~large).select(keys), keys, "left_semi").select(columns)
        done = rest if done is None else done.union(rest)
        if sizes.where(large).isEmpty():
            return done
        split = left.drop("limit").join(sizes.where(large).select(*keys, "total"), keys)
        drawn = F.pmod(F.xxhash64(F.lit(config.seed), "node"), F.lit(1 << 30)) < F.lit(0.8 * config.sample * (1 << 30)) / F.col("total")
        centres = tables.stored(split.where(drawn).select(*keys, "node", "total", "vector").groupBy(keys).applyInArrow(_centres(config), f"label {label}, dim int, cell bigint, centres array<binary>"), "centres")
        lots = F.ceil(F.col("total") / config.lot).cast("int")
        ask = split.withColumn("lot", F.pmod(F.xxhash64("node"), lots).cast("int")).groupBy(*keys, "lot")
        given = centres.join(sizes.select(*keys, "total"), keys).select(*keys, "centres", F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot")).groupBy(*keys, "lot")
        made = ask.cogroup(given).applyInArrow(_assign(config), f"label {label}, dim int, cell bigint, total bigint, node bigint, copies bigint, vector binary, home boolean, part bigint")
        made = made.select("label", "dim", F.xxhash64("cell", "part").alias("cell"), "node", "copies", "vector", "home", (F.col("total") * config.shrink).alias("limit"))
        left, limit = tables.stored(made, "cells"), F.col("limit")


def _compare(config: Cells, node_type):
    """Links of a block's own vectors with another block of the cell: per vector the links counted, and trees of the linked ones."""

    def run(table):
        asks = np.array(table.column("asks").to_pylist())
        x = np.stack([np.frombuffer(b, "<f8") for b in table.column("vector").to_pylist()])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norms = np.linalg.norm(x, axis=1)
        nodes, copies = np.array(table.column("node").to_pylist()), table.column("copies").to_numpy()
        q, t = np.flatnonzero(asks), np.flatnonzero(~asks)
        out_node, out_links, out_root = [], [], []
        if len(q) and len(t):
            linked = x[q] @ x[t].T >= config.cosine * np.outer(norms[q], norms[t])
            linked &= nodes[q][:, None] != nodes[t][None, :]
            count = linked @ copies[t]
            low_q, low_t = nodes[q].copy(), nodes[t].copy()
            big = np.iinfo(np.int64).max
            rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            sub = linked[np.ix_(rows, columns)]
            while len(rows):  # smallest node reachable inside the two blocks
                new_q = np.minimum(low_q[rows], np.where(sub, low_t[columns][None, :], big).min(axis=1))
                new_t = np.minimum(low_t[columns], np.where(sub, new_q[:, None], big).min(axis=0))
                same = (new_q == low_q[rows]).all() and (new_t == low_t[columns]).all()
                low_q[rows], low_t[columns] = new_q, new_t
                if same:
                    break
            out_node = [*nodes[q][rows].tolist(), *nodes[t][columns].tolist()]
            out_links = [*count[rows].tolist(), *[0] * len(columns)]
            out_root = [*low_q[rows].tolist(), *low_t[columns].tolist()]
        return pa.table({"node": pa.array(out_node, pa.int64()), "links": pa.array(out_links, pa.int64()), "root": pa.array(out_root, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, config: Cells = Cells(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept): a row per row of vectors. Ids are cast to 64-bit integers.

    Rows link if their labels are equal and not null, their lengths are equal, and their cosine in double precision is at least
    config.cosine. Vectors that are null, zero, or hold null or non-finite numbers link with nothing. Rows that repeat an id are
    vectors of their own, each with the links and the component of its vector. A null id takes part through its vector, and where none of a group has an id
    the component is null; a row without an id is kept only then. Centres are placed on a bounded sample of each cell; every vector is compared.
    Other columns are not read.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)
    small_batches(spark, 2000)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    label = rows.schema["label"].dataType.simpleString()
    keyed = tables.stored(rows.mapInArrow(_keys, f"id bigint, label {label}, key binary, dim int, vector binary"), "keyed")
    nodes = keyed.where("key is not null").groupBy("label", "dim", "key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # a node is a number of the vector, as rows may repeat or lack an id; it is written once, so it stays the same
    nodes = tables.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    placed = _cells(nodes, label, config, tables)
    held = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("all"), F.count_if(F.col("home")).alias("own"))
    held = held.select("label", "dim", "cell", F.ceil(F.col("all") / config.block).cast("int").alias("targets"), F.ceil(F.col("own") / config.block).cast("int").alias("askers"))
    cut = placed.join(held, ["label", "dim", "cell"]).where("askers > 0")
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asking = cut.where("home").withColumn("a", spot("askers")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("targets") - 1))).withColumn("asks", F.lit(True))
    asked = cut.withColumn("t", spot("targets")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("askers") - 1))).withColumn("asks", F.lit(False))
    columns = ["label", "dim", "cell", "a", "t", "asks", "node", "copies", "vector"]
    pairs = asking.select(columns).union(asked.select(columns))
    found = tables.stored(pairs.groupBy("label", "dim", "cell", "a", "t").applyInArrow(_compare(config, label), "node bigint, links bigint, root bigint"), "found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), tables)
    smallest = groups.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    named = groups.join(smallest, "component").select("node", "first")
    facts = nodes.select("label", "dim", "key", "node", "least", "copies").join(links, "node", "left").join(named, "node", "left")
    facts = facts.select("label", "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "least").alias("component"))
    facts = tables.stored(facts, "facts")
    tables.drop(but=(keyed, facts))
    out = keyed.select("id", "label", "dim", "key").join(facts, ["label", "dim", "key"], "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
