"""Operator 13 against sorted lists and sets."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from boxloom.llm import queries, turntrie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, key int, n int, parent int"


def rem(c):
    """c % 20 with the sign of c."""
    return c % 20 if c >= 0 else -(-c % 20)


def rebuilt(rows):
    """Conversation id -> [(role, text)] after rebuilding."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - rem(c), [])[:h] + v[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += not children[k]
    ends = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(convs[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], ends(k)) for k, m in members.items())


def trie(spark, rows, config=turntrie.Trie()):
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    return sorted(tuple(r)[1:] for r in turntrie.rebuilt_trie(frame, config).collect())


def awkward():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 90), *range(-45, -20), 2**62, -(2**62), 1000001]:
        if c % 23:
            rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi there", "ok", "", None, "a\tb  c", "é 日本"])) for t in range(rng.randrange(1, 7))]
    rows += [(3, None, "user", "first"), (3, None, None, None), (7, 2, "user", "same turn"), (7, 2, "user", "same turn"), (7, 2, "bot", "same turn")]
    rows += [(200, t, "user", f"turn {t} " * 3) for t in range(300)] + [(201, t, "user", f"turn {t} " * 3) for t in range(290)]
    rows += [(c, 0, "user", "hot first turn") for c in range(400, 480)]
    return rows + [(None, 1, "user", "nobody's"), (600, 0, "us", "er1"), (620, 0, "user", "1"), (5000, 1, "user", "x " * 50_000)]


@pytest.mark.parametrize("config", [turntrie.Trie(), turntrie.Trie(conversations=5, turns=40)], ids=["whole", "many shards"])
def test_op13_brute_force(spark, config):
    assert trie(spark, awkward(), config) == brute(awkward())


def test_op13_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in queries.op13_turn_trie(spark, SF).collect()) == brute(rows)


def test_op13_nothing_and_turnless(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, None, None, None)]) == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # its one turn is before its head's end, and the head is absent
    assert trie(spark, [(c, 0, "user", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_op13_walk_without_spark():
    nodes = turntrie.shard_nodes([4, 6, 9], [[b"a", b"b"], [b"a"], [b"a", b"b"]], [[1, 2], [1], [1, 2]])
    assert [nodes[c] for c in ("parent", "depth", "n", "conv_id", "ends")] == [[-1, 0, 1], [0, 1, 2], [3, 3, 2], [4, 4, 4], ["", "6", "4,9"]]
