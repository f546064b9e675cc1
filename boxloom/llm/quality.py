"""Quality classifier without labels (operator 8).

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of vote patterns, which
Spark gathers from all documents, estimates how often each labeller votes what on good and on bad documents (Dawid and Skene, 1979),
and so the chance that a pattern's documents are good. These chances train a logistic scorer on hashed features of words, fitted on
a bounded sample of documents; it scores every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import binary, handed_back, small_batches

GOOD, BAD, SILENT = 1, 0, 2
_UPPER, _LOWER, _DIGITS = (bytes(range(a, b)) for a, b in ((0x41, 0x5B), (0x61, 0x7B), (0x30, 0x3A)))
_PLAIN = bytes([*_UPPER, *_LOWER, *_DIGITS, *b" \t\n\v\f\r.,;:!?'\"()-", *range(0x80, 0x100)])
_ODD = frozenset(b"#$%&*+/<=>@\\^_`|~")
_ENDS = (b".", b"!", b"?", b'"', b":", b"\xe2\x80\xa6")


@dataclass(frozen=True)
class Quality:
    """Buckets of hashed features, documents the scorer is fitted on and their distinct features (at most), passes over them, step, decay, least chance to be kept, seed."""

    buckets: int = 1 << 16
    sample: int = 6000
    features: int = 20_000_000
    passes: int = 200
    step: float = 4.0
    decay: float = 1e-4
    least: float = 0.5
    seed: int = 11


def measures(text: bytes, words: list[bytes]) -> dict[str, float]:
    """Figures of a text that has words; the labellers judge by them."""
    n, size = len(words), len(text)
    lines = [x for x in (y.strip() for y in text.split(b"\n")) if x]
    letters = n and size - len(text.translate(None, _UPPER)) + size - len(text.translate(None, _LOWER))
    caps = size - len(text.translate(None, _UPPER))
    return {
        "symbols": len(text.translate(None, _PLAIN)) / size,
        "capitals": caps / letters if letters >= 30 else 0.0,
        "bare": sum(1 for w in words if not w.strip(_OTHERS)) / n,
        "tails": sum(1 for w in words if w[-1:] == w[-2:-1] and w[-1] in _ODD) / n,
        "short": sum(1 for w in words if len(w) <= 4 and w.strip(_OTHERS) == w) / n if n >= 20 else 0.15,
        "repeats": sum(map(eq, words, words[1:])) / n,
        "variety": len(set(words)) / n**0.9,
        "length": (size - n) / n,
        "ends": max(sum(1 for x in lines if x.endswith(_ENDS)) / max(1, len(lines)), 0.7 if len(lines) < 4 else 0.0),
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "shouts": (text.count(b"!!") + text.count(b"??")) / n,
    }


_OTHERS = bytes(b for b in range(128) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39))
#: (figure, bad from, good up to) or, with a minus sign, (figure, bad up to, good from); between them a labeller is silent.
LABELLERS = (
    ("symbols", 0.10, 0.03),
    ("tails", 0.15, 0.02),
    ("-short", 0.08, 0.18),
    ("capitals", 0.50, 0.15),
    ("bare", 0.20, 0.05),
    ("repeats", 0.15, 0.03),
    ("-variety", 0.35, 0.80),
    ("length", 14.0, 9.0),
    ("-ends", 0.50, 0.90),
    ("lines", 0.40, 0.15),
    ("shouts", 0.10, 0.01),
)


def votes(m: dict[str, float]) -> list[int]:
    out = []
    for name, bad, good in LABELLERS:
        v = m[name.lstrip("-")]
        if name[0] == "-":
            out.append(BAD if v <= bad else GOOD if v >= good else SILENT)
        else:
            out.append(BAD if v >= bad else GOOD if v <= good else SILENT)
    return out


_RUNS = re.compile(r"(.)\1+")


class Features:
    """Hashed features: of each word its shape, first and last three characters; of the text its measures in steps."""

    def __init__(self, buckets: int, most: int = 100_000):
        self.buckets, self.most, self.known = buckets, most, {}

    def _slot(self, name: bytes) -> int:
        return xxhash.xxh32_intdigest(name) % self.buckets

    def made(self, word: bytes) -> tuple[int, int, int]:
        """Features of a word, not kept at hand."""
        said = word.decode("utf-8", "replace")
        shape = _RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in said))
        return self._slot(b"s" + shape.encode()), self._slot(b"p" + said[:3].encode()), self._slot(b"e" + said[-3:].encode())

    def of_word(self, word: bytes) -> tuple[int, int, int]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > self.most:
                self.known = {}
            self.known[word] = got = self.made(word)
        return got

    def of_text(self, m: dict[str, float]) -> list[int]:
        return [self._slot(f"m{k}:{round(v, 1) if k != 'length' else int(v / 2)}".encode()) for k, v in m.items()]


def _vote(batches):
    """Vote patterns as text, one digit per labeller; null for a text without words."""
    for batch in batches:
        out = []
        for text in binary(batch.column(1)):
            words = text.split() if text else []
            out.append("".join(map(str, votes(measures(text, words)))) if words else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "pattern"])


def accuracies(patterns: dict[str, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[str, float]]:
    """(share of good documents, chance of each vote by labeller and class, chance that a pattern is good), by EM.

    At most 3^labellers patterns, whatever the corpus. Starts from the share of good votes.
    """
    names = sorted(patterns)
    v = np.array([[int(c) for c in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    good = ((v == GOOD).sum(axis=1) + 0.5) / ((v != SILENT).sum(axis=1) + 1.0)
    good = np.clip(good**2, 0.01, 0.99)
    share, table = 0.5, None
    for _ in range(rounds):
        share = np.clip((n * good).sum() / n.sum(), 1e-3, 1 - 1e-3)
        table = np.empty((v.shape[1], 2, 2))
        for j in range(v.shape[1]):
            for k in (GOOD, BAD):
                at = v[:, j] == k
                table[j, GOOD, k] = (n[at] * good[at]).sum() + 1.0
                table[j, BAD, k] = (n[at] * (1 - good[at])).sum() + 1.0
            table[j] /= table[j].sum(axis=1, keepdims=True)
        logs = np.append(np.log(table), np.zeros((v.shape[1], 2, 1)), axis=2)  # silence says nothing
        j = np.arange(v.shape[1])
        up = np.log(share) + logs[j, GOOD, v].sum(axis=1)
        down = np.log(1 - share) + logs[j, BAD, v].sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(down - up, -700, 700)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return float(share), table, dict(zip(names, good.tolist(), strict=True))


def _featured(shared, config: Quality):
    """Features of documents that have words, with the chance that their vote pattern is good."""

    def run(batches):
        features, chance = Features(config.buckets), shared.value
        for batch in batches:
            ids, slots, values, good = [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                words = text.split() if text else []
                if not words:
                    continue
                own, counts = np.unique(np.array([f for w in words for f in features.of_word(w)], np.int64), return_counts=True)
                m = measures(text, words)
                extra = features.of_text(m)
                ids.append(name)
                good.append(chance["".join(map(str, votes(m)))])
                slots.append([*own.tolist(), *extra])
                values.append([*(counts / len(words)).tolist(), *[0.5] * len(extra)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(good, pa.float64())], ["id", "slots", "values", "good"])

    return run


def fitted(slots: np.ndarray, values: np.ndarray, ends: np.ndarray, good: np.ndarray, config: Quality) -> np.ndarray:
    """Weights of a logistic scorer (the last is the constant), by gradient steps on soft labels, both classes weighing alike.

    Document k has the features slots[ends[k] : ends[k + 1]], at least one. They are taken some documents at a time, so that besides
    them little memory is needed.
    """
    w = np.zeros(config.buckets + 1)
    if not len(good):
        return w
    weight = good / max(good.sum(), 1e-9) + (1 - good) / max((1 - good).sum(), 1e-9)
    weight /= weight.sum()
    speed = np.zeros_like(w)
    for _ in range(config.passes):
        slope = config.decay * w
        for lo in range(0, len(good), 500):
            e = ends[lo : lo + 501]
            at, x, own = slots[e[0] : e[-1]], values[e[0] : e[-1]], good[lo : lo + 500]
            z = np.add.reduceat(w[at] * x, e[:-1] - e[0]) + w[-1]
            error = weight[lo : lo + 500] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - own)
            slope[:-1] += np.bincount(at, np.repeat(error, np.diff(e)) * x, config.buckets)
            slope[-1] += error.sum()
        speed = 0.9 * speed - config.step * slope
        w = w + speed
    return w


def _scored(shared, config: Quality, names: list[str], text_col: str):
    def run(batches):
        weights = shared.value.tolist()
        features = Features(config.buckets)
        known: dict[bytes, float] = {}
        for batch in batches:
            out = []
            for text in binary(batch.column(batch.schema.names.index(text_col))):
                words = text.split() if text else []
                if not words:
                    out.append(0.0)
                    continue
                if len(known) > features.most:
                    known = {}
                for w in {w for w in words if w not in known}:
                    known[w] = sum(weights[f] for f in features.made(w))
                z = sum(map(known.__getitem__, words)) / len(words) + 0.5 * sum(weights[f] for f in features.of_text(measures(text, words))) + weights[-1]
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in names), pa.array(out, pa.float64())], [*names, "quality_score"])

    return run


def train(docs: DataFrame, config: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text"):
    """(weights, share of good documents, vote table): votes of all documents, a scorer fitted on a sample of at most config.sample
    documents with config.features distinct features in all."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = {r.pattern: r["count"] for r in rows.mapInArrow(_vote, f"id {kind}, pattern string").where("pattern is not null").groupBy("pattern").count().collect()}
    if not counts:
        return np.zeros(config.buckets + 1), 0.0, None
    share, table, chance = accuracies(counts)
    total = sum(counts.values())
    # a sample by hash, a little below the bound on average, so that it keeps to it
    part = min(1.0, 0.9 * config.sample / total)
    sample = rows.where((F.pmod(F.xxhash64(F.lit(config.seed), "id"), F.lit(1 << 30)) / float(1 << 30) < part) & (F.length("text") > 0))
    shared = docs.sparkSession.sparkContext.broadcast(chance)  # at most 3^labellers numbers
    made = sample.select("id", "text").mapInArrow(_featured(shared, config), f"id {kind}, slots array<int>, values array<float>, good double").orderBy("id").limit(config.sample)
    upto = F.sum(F.size("slots")).over(Window.orderBy("id", "good").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # of at most config.sample rows
    made = made.withColumn("upto", upto).where(F.col("upto") <= config.features).select("slots", "values", "good").toArrow()
    slots, values = (made.column(c).combine_chunks() for c in ("slots", "values"))
    ends = np.concatenate([[0], np.cumsum(slots.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    return fitted(slots.flatten().to_numpy(), values.flatten().to_numpy(), ends, made.column("good").to_numpy(), config), share, table


def scored(docs: DataFrame, weights: np.ndarray, config: Quality = Quality(), text_col: str = "text") -> DataFrame:
    """docs with quality_score, the chance to be good: every row and column, texts not shuffled. Null or blank texts score 0.

    A column of the input that is named quality_score gives way to the new one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [c for c in docs.columns if c != "quality_score"]
    shared = spark.sparkContext.broadcast(weights)  # config.buckets + 1 numbers
    return docs.select(names).mapInArrow(lambda b: handed_back(_scored(shared, config, names, text_col)(b)), docs.select(names).schema.add("quality_score", "double"))


def classified(docs: DataFrame, config: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with quality_score and keep (score at least config.least). Null or blank texts are not kept."""
    weights, _, _ = train(docs, config, id_col, text_col)
    return scored(docs, weights, config, text_col).withColumn("keep", F.col("quality_score") >= config.least)
