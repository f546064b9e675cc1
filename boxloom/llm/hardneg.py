"""Hard negatives by threshold joins on inverted indexes (operator 12).

Anchors meet all vectors in blocks: every vector stands in one shard of bounded size and every anchor in one block of bounded size, and
a task joins a block with a shard. A task orders dimensions by their energy in the shard and indexes a vector's leading bands of
dimensions only as far as the norm of the rest could still lift it over the lowest threshold; the bound is Cauchy-Schwarz, so what is
left out of the index cannot matter. Partial scores grow band by band over the rows that the index still holds, and a pair is dropped
once the product of the remaining norms cannot reach the anchor's threshold. Pairs that stay are scored exactly, in integers.

Thresholds start near the top of an anchor's windows and go down, twice as far each time, until every window of the anchor is full or
lies wholly above the threshold. The best of all shards are then merged, at most as many rows per window and shard as are asked for.
Positives are found the same way, in a window without bounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import Tables, grown


@dataclass(frozen=True)
class HardNegatives:
    """Anchors are ids divisible by `every`; positives of an anchor, negatives of a positive, their least and most share of its score in percent; anchors in a block, vectors in a shard, dimensions in a band."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    block: int = 8_192
    shard: int = 8_192
    band: int = 8


class Index:
    """Rows of a shard by decreasing energy of their dimensions, with the norms of what follows each band."""

    def __init__(self, rows: np.ndarray, band: int):
        floats = rows.astype(np.float64)
        self.dims = np.argsort(-(floats**2).sum(axis=0), kind="stable")
        self.band, self.rows = band, rows[:, self.dims]
        self.rest = self.norms(floats[:, self.dims])
        self.most = float(self.rest[:, 0].max(initial=0.0))

    def norms(self, rows: np.ndarray) -> np.ndarray:
        """Norm from each band on, then 0."""
        squares = (rows.astype(np.float64) ** 2)[:, ::-1].cumsum(axis=1)[:, ::-1]
        return np.sqrt(np.concatenate([squares[:, :: self.band], np.zeros((len(rows), 1))], axis=1))

    def above(self, queries: np.ndarray, rest: np.ndarray, least: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the allowed pairs whose score is not below the query's threshold; others may be among them."""
        norm = rest[:, 0]
        slack = 1e-9 * norm * self.most + 1e-6
        reach = float(((least - slack) / np.maximum(norm, 1e-300)).min())
        bands = (self.rest[:, :-1] >= reach).sum(axis=1) if reach > 0 else np.full(len(self.rows), self.rest.shape[1] - 1)
        live = np.argsort(-bands, kind="stable")
        live = live[bands[live] > 0]
        bands = bands[live]
        score, alive = np.zeros((len(queries), len(live)), queries.dtype), allowed[:, live]
        for g in range(self.rest.shape[1] - 1):
            held = int(np.searchsorted(-bands, -g, "left"))  # the rows whose index goes beyond band g
            if not held:
                break
            part = slice(g * self.band, (g + 1) * self.band)
            score[:, :held] += queries[:, part] @ self.rows[live[:held], part].T
            alive[:, :held] &= score[:, :held] + rest[:, g + 1, None] * self.rest[live[:held], g + 1] >= (least - slack)[:, None]
            some = alive.any(axis=0)
            if some.mean() < 0.7:
                live, bands, score, alive = live[some], bands[some], score[:, some], alive[:, some]
        q, x = np.nonzero(alive)
        whole = bands[x] == self.rest.shape[1] - 1
        exact = score[q, x]
        x = live[x]
        for at in range(0, len(q), 50_000):
            cut = np.flatnonzero(~whole[at : at + 50_000]) + at
            exact[cut] = (queries[q[cut]] * self.rows[x[cut]]).sum(axis=1)
        return q, x, exact


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices in a type in which sums of products are exact integers."""
    top = [max([1, *map(abs, (int(m.min(initial=0)), int(m.max(initial=0))))]) for m in matrices]
    most = top[0] * top[1] * max(1, matrices[0].shape[1])
    if most >= 2**63:
        raise ValueError("scores pass 64 bits")
    return [m.astype(np.float64 if most < 2**52 else np.longdouble) for m in matrices]


def _searched(config: HardNegatives, alike: bool):
    """A block of anchors (r, id, label, v, windows) and a shard (x, x_id, x_label, x_v) -> the shard's best rows in each anchor's windows."""
    most = config.positives if alike else config.negatives

    def run(block: pa.Table, shard: pa.Table) -> pa.Table:
        if not (block.num_rows and shard.num_rows):  # a side without rows comes without columns
            kind = block.schema.field("id").type if block.num_rows else shard.schema.field("x_id").type
            return pa.schema([("a", pa.int64()), ("anchor_id", kind), ("w", pa.int32()), ("x", pa.int64()), ("x_id", kind), ("score", pa.int64())]).empty_table()
        found: dict[str, list] = {c: [] for c in ("a", "w", "x", "score")}
        vectors, asked = shard.column("x_v").to_pylist(), block.column("v").to_pylist()
        width = max(1, *map(len, vectors), *map(len, asked))
        rows, queries = _exact(_matrix(vectors, width), _matrix(asked, width))
        index = Index(rows, config.band)
        queries = queries[:, index.dims]
        rest = index.norms(queries)
        ids = shard.column("x_id").to_pylist()
        there = (shard.column("x_label").to_numpy(), shard.column("x").to_numpy(), np.array([x is None for x in ids]), np.array([x or 0 for x in ids], np.int64))
        asking = (block.column("label").to_numpy(), block.column("r").to_numpy(), block.column("windows").to_pylist())
        for at in range(0, len(queries), 128):
            _tile(index, most, alike, slice(at, at + 128), queries, rest, there, asking, found)
        a, x = pa.array(found["a"], pa.int64()), pa.array(found["x"], pa.int64())
        return pa.table({"a": block.column("r").take(a), "anchor_id": block.column("id").take(a), "w": pa.array(found["w"], pa.int32()), "x": shard.column("x").take(x), "x_id": shard.column("x_id").take(x), "score": pa.array(found["score"], pa.int64())})

    return run


def _tile(index: Index, most: int, alike: bool, part: slice, queries, rest, shard, block, found) -> None:
    """Adds the best rows of some anchors; thresholds go down until their windows are full."""
    labels, own, nameless, ids = shard
    a_labels, a_own, windows = block[0][part], block[1][part], block[2][part]
    queries, rest = queries[part], rest[part]
    reach = rest[:, 0] * index.most + 1
    bounds = [[(-r if w["lo"] is None else w["lo"], r if w["hi"] is None else w["hi"], w["w"]) for w in ws if w["lo"] is None or w["lo"] <= w["hi"]] for ws, r in zip(windows, reach, strict=True)]
    active = np.array([q for q, ws in enumerate(bounds) if ws], np.int64)
    top = np.array([min(reach[q], max(w[1] for w in ws)) if ws else 0.0 for q, ws in enumerate(bounds)])
    bottom = np.array([max(-reach[q], min(w[0] for w in ws)) if ws else 0.0 for q, ws in enumerate(bounds)])
    share = 1 / 16
    while len(active):
        least = np.maximum(bottom[active], top[active] - share * np.maximum(top[active] - bottom[active], 0))
        if share >= 1:
            least = bottom[active]
        allowed = (a_labels[active, None] == labels[None, :]) == alike
        if alike:
            allowed &= a_own[active, None] != own[None, :]
        q, x, score = index.above(queries[active], rest[active], least, allowed)
        order = np.lexsort((own[x], ids[x], nameless[x], -score, q))
        q, x, score = q[order], x[order], score[order]
        edges = np.searchsorted(q, np.arange(len(active) + 1))
        left = []
        for k, a in enumerate(active.tolist()):
            mine = slice(edges[k], edges[k + 1])
            values, chosen = score[mine], []
            for lo, hi, w in bounds[a]:
                best = np.flatnonzero((values >= max(lo, least[k])) & (values <= hi))[:most]
                if len(best) < most and least[k] > lo and share < 1:
                    break
                chosen.append((w, best))
            if len(chosen) < len(bounds[a]):
                left.append(a)
                continue
            for w, best in chosen:
                found["a"] += [part.start + a] * len(best)
                found["w"] += [w] * len(best)
                found["x"] += x[mine][best].tolist()
                found["score"] += [int(s) for s in values[best]]
        active, share = np.array(left, np.int64), share * 2


def _best(anchors: DataFrame, vectors: DataFrame, config: HardNegatives, alike: bool, shards: int, blocks: int) -> DataFrame:
    """(a, anchor_id, w, rank, x_id, score): the best rows of each anchor's windows over all shards."""
    asked = anchors.withColumns({"block": F.pmod(F.xxhash64("r"), F.lit(blocks).cast("bigint")), "shard": F.expr(f"explode(sequence(0L, {shards - 1}L))")})
    there = vectors.select(F.col("id").alias("x_id"), F.col("label").alias("x_label"), F.col("v").alias("x_v"), F.col("r").alias("x")).withColumns({"shard": F.pmod(F.xxhash64("x"), F.lit(shards).cast("bigint")), "block": F.expr(f"explode(sequence(0L, {blocks - 1}L))")})
    kind = vectors.schema["id"].dataType.simpleString()
    found = asked.groupBy("block", "shard").cogroup(there.groupBy("block", "shard")).applyInArrow(_searched(config, alike), f"a bigint, anchor_id {kind}, w int, x bigint, x_id {kind}, score bigint")
    rank = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), F.asc_nulls_last("x_id"), "x"))
    return found.withColumn("rank", rank).where(F.col("rank") <= (config.positives if alike else config.negatives)).drop("x")


def hard_negatives(vectors: DataFrame, config: HardNegatives = HardNegatives(), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first negatives of each anchor and positive.

    vectors holds arrays of integers; the score of two rows is their inner product, higher ones come first, ties by the smaller id,
    null ids last. Anchors are the rows whose id is divisible by `every`. Rows without a label or a vector, or with a null in it, take no
    part; a shorter vector counts as padded with zeros, an empty one scores 0. Rows that repeat an id, or are equal altogether, are rows
    of their own. Scores beyond 64 bits are an error. Other columns are not read.
    """
    tables = Tables(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<bigint>").alias("v"))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    rows = tables.stored(rows.withColumn("r", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where(F.col("id") % config.every == 0)
    n, asked = rows.count(), anchors.count()
    shards, blocks = max(1, math.ceil(n / config.shard)), max(1, math.ceil(asked / config.block))
    window = "struct<w: int, lo: bigint, hi: bigint>"
    open_ = anchors.withColumn("windows", F.array(F.struct(F.lit(0).alias("w"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"))).cast(f"array<{window}>"))
    positives = tables.stored(_best(open_, rows, config, True, shards, blocks).select("a", F.col("rank").alias("w"), F.col("x_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scaled = "cast(positive_score as decimal(28,0)) * {} / 100"
    windows = positives.select("a", F.struct("w", F.expr(f"cast(ceil({scaled.format(config.low)}) as bigint)").alias("lo"), F.expr(f"cast(floor({scaled.format(config.high)}) as bigint)").alias("hi")).cast(window).alias("window"))
    windows = windows.groupBy(F.col("a").alias("r")).agg(F.collect_list("window").alias("windows"))
    negatives = _best(anchors.join(grown(windows), "r"), rows, config, False, shards, blocks)
    out = negatives.join(grown(positives), ["a", "w"])
    return out.select("anchor_id", "positive_id", "rank", F.col("x_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows of embeddings that take part: components become floor(256 * x), rows with an id divisible by 7 get the next label of ten."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fit).select("vec_id", label.alias("label"), vector.alias("vector"))
