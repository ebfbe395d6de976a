from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from costspark.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The trie by dictionaries: {prefix: (conv_id, parent's, n_convs, children, leaves, saved, ends)}."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, tie), (role, text)))
    members = defaultdict(list)
    for c, turns in convs.items():
        said = tuple(t for _, t in sorted(turns))
        for d in range(len(said) + 1):
            members[said[:d]].append((c, len(said) == d))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        ends = ",".join(str(c) for c, end in sorted(members[p]) if end)
        out[p] = [
            min(members[p])[0], len(p), min(members[p[:-1]])[0] if p else None, len(members[p]), len(kids[p]),
            sum(out[k][5] for k in kids[p]) or 1, own + sum(out[k][6] for k in kids[p]), hashlib.sha256(ends.encode()).hexdigest(),
        ]
    return sorted(map(tuple, out.values()), key=str)


def found(spark, rows, schema=SCHEMA, **how):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in pt.prefix_trie(spark.createDataFrame(rows, schema), **how).select(*names).collect()), key=str)


def talk(rng, n, length, words):
    rows = []
    for c in rng.sample(range(-n, 3 * n), n):
        for t in range(rng.randint(1, length)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(words)))
    return rows


def test_queue_spills_in_order():
    rng = random.Random(1)
    queue, want = pt.SpillingHeap(7), []
    for _ in range(400):
        if rng.random() < 0.6 or not want:
            item = (rng.randint(0, 20), rng.randint(0, 5))
            queue.push(item)
            want.append(item)
        else:
            assert queue.peek() == min(want)
            assert queue.pop() == min(want)
            want.remove(min(want))
    assert queue.runs and [queue.pop() for _ in want] == sorted(want) and queue.peek() is None


@pytest.mark.parametrize("weight, levels, held", [(50_000, 256, 100), (6, 2, 3), (1, 3, 2)])
def test_equals_dictionaries(spark, weight, levels, held):
    rng = random.Random(weight)
    rows = talk(rng, 60, 9, ["a b", "", "c", "d\te  f"])
    steps = pt.number_turns(spark.createDataFrame(rows, SCHEMA))
    members = steps.where("at = 0").selectExpr("conv", "n AS length")
    steps = steps.selectExpr("conv", "slice", "at + 1 AS depth", "n AS length", "digest", "words")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = pt.build_trie(steps, members, weight, levels, held).select(*names).collect()
    assert sorted(map(tuple, nodes), key=str) == plain(rows)


def test_hot_beginning_and_long_copies(spark):
    rows = [(c, t, "user", f"x{t} y" if t < 3 else f"{c} {t}") for c in range(40) for t in range(5)]
    rows += [(c, t, "user", "x0 y" if t == 0 else f"long {t}") for c in (100, 101) for t in range(90)]
    rows += [(200 + c, 0, "user", "x0 y") for c in range(30)]  # equal conversations
    assert found(spark, rows, shard_weight=20, levels=8) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 5, "user", "é " * 3000),
        (2, 1, "user", "first"), (2, 1, "user", "first"), (None, 0, "user", "no id"), (3, 2, "assistant", "first"),
        (4, 7, "tie", "b"), (4, 7, "tie", "a"),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, rows[6:7]) == []
    clash = [(1, 0, "user", "t", 5, "s", True), (2, 0, "user", "t", 6, "u", False)]
    got = found(spark, clash, "conv_id long, turn int, role string, text string, depth int, slice string, top boolean")
    assert got == plain([r[:4] for r in clash])
