import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from turnlake.llm import trie
from turnlake.llm.queries import op13_prefix_trie
from turnlake.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, base string, depth int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """The contract, one node at a time."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = []
    for p, m in members.items():
        below = [x for x in members if x[: len(p)] == p]
        children = [x for x in below if len(x) == len(p) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children), len(leaves), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed=3):
    rng = random.Random(seed)
    rows = []
    texts = ["hi", "é 漢", "", None, "long " * 40, "bye"]
    for c in [*range(0, 30), *range(95, 130), 200, 301, 307, 312, 100_000, 100_050, -5, -1, -100, -130, -150, -199]:
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", None])
            rows.append((c, turn if rng.random() < 0.95 else None, role, rng.choice(texts)))
    rows += [(40 + i, t, "user", f"same {t}") for i in range(12) for t in range(7)]  # copies
    rows += [(60, t, "user", str(t)) for t in range(120)] + [rows[0], rows[0], (None, 1, "user", "no id")]
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "other tie"), (7, 3, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", 9) for r in rows], SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("held", [1, 7, trie.HELD_NODES])
def test_against_brute_force(spark, monkeypatch, held):
    rows = made()
    monkeypatch.setattr(trie, "HELD_NODES", held)
    assert found(prefix_trie(frame(spark, rows))) == brute(rows)


def test_families_of_one_task(monkeypatch):
    """However little a task holds, the parts of a node add up, and the lists of
    ends of a node don't overlap and ascend."""
    rows = sorted((c - (abs(c) % 100) * (1 if c >= 0 else -1), c, t) for c in [-199, -150, -100, -5, 0, 3, 40, 99, 100, 101] for t in range(4))
    for held in (1, 3, 1_000):
        monkeypatch.setattr(trie, "HELD_NODES", held)
        made = trie._Families()
        for base, c, t in sorted(rows, key=lambda r: (r[0], r[1] != r[0], r[1], r[2])):
            made.turn(base, c, b"%d" % t, 1)
        made.end(), made.flush()
        ends = defaultdict(list)
        for name, *_, own in made.done:
            if own:
                ends[name].append(own)
        for lists in ends.values():
            flat = [c for x in sorted(lists) for c in x]
            assert flat == sorted(flat)
        assert sorted(c for lists in ends.values() for x in lists for c in x) == sorted({r[1] for r in rows})


def test_nothing(spark):
    assert prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_prefix_trie(spark, sf)) == brute(rows)
