"""Operator 11 against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from boxloom.llm import queries, repeats

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, h string, n int, spans int"
SMALL = repeats.Repeats(length=20, anchor=8, lot=150, group=3, shard_bytes=400)


def brute(texts, length):
    """Per text (bytes, bytes removed, runs, SHA-256 of the rest)."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, x in zip(t, gone, strict=False) if not x)
        out.append((len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def awkward():
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    common, line = letters(70), letters(14)
    texts = [letters(rng.randrange(200)) + common[rng.randrange(30) :] + letters(rng.randrange(60)) for _ in range(60)]
    texts += [letters(30) + line + letters(30) for _ in range(40)]  # a line shorter than a window, everywhere
    base = letters(300)
    texts += [base[:k] + "X" + base[k + 1 :] for k in rng.sample(range(300), 40)] + [base] * 12
    texts += ["a" * 400, "a" * 45, "ab" * 100, "abc" * 7, letters(2000), "\0" * 30 + letters(9) + "\0" * 30, "", None, " ", "x" * 19, "y" * 20, "y" * 20, "z" * 20, "w" * 21]
    return texts


@pytest.mark.parametrize("texts", [awkward(), [None, ""], ["q" * 19]], ids=["awkward", "blank", "short"])
def test_op11_brute_force(spark, texts):
    docs = spark.createDataFrame([(k if k % 9 else None, t, "x", k, 1) for k, t in enumerate(texts)], SCHEMA)
    got = Counter(tuple(r) for r in repeats.summaries(docs, SMALL).collect())
    assert got == Counter((k if k % 9 else None, *x) for k, x in enumerate(brute(texts, 20)))


def test_op11_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_suffix_dedup(spark, SF).collect()}
    assert got == dict(zip([d.doc_id for d in docs], brute([d.text for d in docs], 400), strict=True))
    assert sum(x[1] for x in got.values()) > 0


def test_op11_spans_and_texts(spark):
    docs = spark.createDataFrame([(1, "-" + "p" * 5 + "0123456789abcdefghij" + "q", "", 0, 0), (2, "é0123456789abcdefghij", "", 0, 0)], SCHEMA)
    got = {bytes(r.kept).decode(): [(s.start, s.end) for s in r.spans] for r in repeats.without_repeats(docs, SMALL).collect()}
    assert got == {"-pppppq": [(6, 26)], "é": [(2, 22)]}


def test_op11_passages_by_bytes_not_words(spark):
    """A passage of over 50 words goes where it has 400 bytes, and stays below; n_bytes tells neither."""
    rng = random.Random(7)
    said = lambda n, k: " ".join("".join(rng.choice("abcdefghij") for _ in range(k)) for _ in range(n))
    long, short = said(55, 8), said(55, 5)
    texts = [f"{said(40, 6)} 1{long}2 {said(9, 6)}", f"{said(3, 6)} 3{long}4 {said(70, 6)}", f"{said(20, 6)} 5{short}6", f"{said(8, 6)} 7{short}8 {said(5, 6)}"]
    docs = spark.createDataFrame([(k, t, "x", k, 1) for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.summaries(docs).collect()}
    assert len(short) < 400 < len(long) and [got[k][:2] for k in range(4)] == [(len(t), len(long) * (k < 2)) for k, t in enumerate(texts)]
    assert got == dict(enumerate(brute(texts, 400)))


def test_op11_nothing(spark):
    assert repeats.summaries(spark.createDataFrame([], SCHEMA), SMALL).count() == 0


def test_op11_leaves_session_and_catalog(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, tables = spark.conf.get(key), len(spark.catalog.listTables())
    repeats.summaries(spark.createDataFrame([(1, "k" * 60, "", 0, 0)], SCHEMA), SMALL).collect()
    assert (spark.conf.get(key), len(spark.catalog.listTables())) == (before, tables)


@pytest.mark.parametrize("seed", range(20))
def test_op11_expansion(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))).encode() for _ in range(12)]
    texts += [texts[0][: len(texts[0]) // 2 + 1], b"a" * 30, b"\xff" * 12, b"\0" * 12]
    length = rng.randrange(2, 14)
    text, at = repeats.repeated_windows(texts, length)
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    assert list(zip(text.tolist(), at.tolist(), strict=True)) == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]
