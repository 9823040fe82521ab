"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from bugsieve.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, pos long, depth long, h1 long"


def sequences(rows, rebuild):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r or "", x or ""))
    for mine in convs.values():
        mine.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1], hashlib.sha256(q[2].encode()).digest()))
    said = {c: [q[1:] for q in mine] for c, mine in convs.items()}
    if not rebuild:
        return said
    out = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = said.get(base, [])[:h] + said[c][h:]
    return out


def plain_nodes(rows, rebuild=True):
    said = sequences(rows, rebuild)
    members = {}
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def gain(node):
        return (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0

    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += gain(node)
    return sorted(
        (
            min(members[n]), len(n), min(members[n[:-1]]) if n else -(10**9), len(members[n]), len(children.get(n, [])),
            leaves[n], saved[n],
            hashlib.sha256(",".join(str(c) for c in sorted(members[n]) if len(said[c]) == len(n)).encode()).hexdigest(),
        )
        for n in members
    )


def found(spark, rows, rebuild=True, **more):
    given = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    got = trie.with_ends(trie.prefix_trie(given, rebuild=rebuild, **more))
    assert got.columns.count("depth") == 1
    return sorted(
        tuple(-(10**9) if r[c] is None else r[c] for c in names) for r in got.select(*names).collect()
    )


def random_rows(seed, n_convs, longest, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n_convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, words)))))
    return rows


@pytest.mark.parametrize("shard_nodes", [1 << 18, 9])
def test_random_conversations(spark, shard_nodes):
    rows = random_rows(1, 120, 7)
    assert found(spark, rows, shard_nodes=shard_nodes) == plain_nodes(rows)


def test_without_rebuilding_and_long_chains(spark):
    rows = random_rows(2, 30, 5) + [(200, t, "user", f"w {t}") for t in range(700)]
    rows += [(201, t, "user", f"w {t}") for t in range(650)] + [(202, t, "user", f"w {t if t < 400 else -t}") for t in range(500)]
    assert found(spark, rows, rebuild=False, shard_nodes=100) == plain_nodes(rows, False)


def test_nulls_repeats_copies_and_missing_heads(spark):
    rows = [(5, 1, "user", "no head"), (21, 0, None, None), (21, None, "user", "first"), (None, 1, "user", "x"), (-7, 1, "a", "b c")]
    rows += [(c, t, "user", f"copy {t}") for c in range(40, 60) for t in range(4)]
    rows += [(61, 3, "user", "again")] * 5 + [(0, 1, "", ""), (0, 1, None, None)]
    assert found(spark, rows) == plain_nodes(rows)
    assert found(spark, rows, rebuild=False, shard_nodes=3) == plain_nodes(rows, False)


def test_empty_table_and_turnless_conversations(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(lone, 0, "user", "gone")]
    assert found(spark, rows) == plain_nodes(rows) and len(found(spark, rows)) == 1


def test_very_long_text(spark):
    rows = [(c, t, "user", "word " * 100_000 + "é" * t) for c in (1, 2) for t in range(3)]
    assert found(spark, rows) == plain_nodes(rows)


@pytest.mark.parametrize("seed", range(6))
def test_findclose(seed):
    rng = np.random.default_rng(seed)
    opens = rng.random(5000) < (0.5 if seed % 2 else 0.52)
    seq = trie.Parentheses(opens)
    places = np.flatnonzero(opens)
    want, stack = {}, []
    for i, o in enumerate(opens):
        if o:
            stack.append(i)
        elif stack:
            want[stack.pop()] = i
    assert seq.findclose(places).tolist() == [want.get(i, -1) for i in places]


def test_findclose_of_deep_and_tiny_sequences():
    deep = np.repeat([True, False], 4000)
    assert trie.Parentheses(deep).findclose(np.arange(4000)).tolist() == list(range(7999, 3999, -1))
    assert trie.Parentheses(np.array([True])).findclose(np.array([0])).tolist() == [-1]
    assert trie.Parentheses(np.array([True, False])).findclose(np.array([0])).tolist() == [1]
