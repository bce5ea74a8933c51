"""The conversation trie against a plain dictionary of prefixes."""

import math
import random
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import numpy as np
import pytest

from waymark.llm import prefix_trie as trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    conversations = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            conversations[c].append((turn is not None, turn or 0, md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in conversations.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, items string")
    return sorted([tuple(r) for r in trie.prefix_trie(df).select(*COLUMNS).collect()], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations_over_many_blocks(spark, monkeypatch, seed):
    """Blocks of two names, three positions and two ids, so that every level, remote answer and stream is used."""
    monkeypatch.setattr(trie, "NAMES", 2)
    monkeypatch.setattr(trie, "POSITIONS", 3)
    monkeypatch.setattr(trie, "IDS", 2)
    rng, rows = random.Random(seed), []
    for c in [None, -150, -100, *range(0, 330, 5)]:
        for t in range(rng.choice([0, 1, 2, 3, 7, 20])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", "", None, "zé"])))
    rows += [(700 + k, j, "u", "hot") for k in range(9) for j in range(9)]
    assert found(spark, rows + rows[:5]) == plain(rows + rows[:5])


def test_none_one_and_turnless(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "u", "x")]) == []
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    for rows in ([(5, 1, None, None)], [(turnless, 0, "u", "gone")], [(turnless, 0, "u", "gone"), (300, 1, "u", "a long text" * 5000)]):
        assert found(spark, rows) == plain(rows)


def test_nearest_smaller_values_across_blocks():
    rng = random.Random(4)
    lcp = [-1] + [rng.randrange(4) for _ in range(40)]
    ids = [rng.randrange(1000) for _ in lcp]
    minima = np.array([min(lcp[a : a + 7]) for a in range(0, len(lcp), 7)])
    least = np.array([min(ids[a : a + 7]) for a in range(0, len(ids), 7)])
    for block in range(len(minima)):
        a = 7 * block
        nodes = trie.block_nodes(block, a, np.array(lcp[a : a + 7]), np.array(ids[a : a + 7]), minima, least)
        for rep, v, left, right, l_block, r_block in zip(*(nodes[c] for c in ("rep", "v", "l", "r", "l_block", "r_block")), strict=True):
            before = max((p for p in range(rep) if lcp[p] < v), default=None)
            after = min((p for p in range(rep + 1, len(lcp)) if lcp[p] < v), default=None)
            assert left == before or (left is None and (before is None or before // 7 == l_block))
            assert right == after or (right is None and (after is None or after // 7 == r_block))
