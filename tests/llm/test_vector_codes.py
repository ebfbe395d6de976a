from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest

from costspark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts, entries, rounds, scale):
    """Codebooks and codes by loops over Python integers."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[1]))
    whole = lambda x: Fraction(x) * scale // 1
    ints = [[whole(x) for x in v] for _, v, *_ in kept]
    step = len(ints[0]) // parts
    cut = [[v[p * step : (p + 1) * step] for v in ints] for p in range(parts)]
    books = [list(own[:entries]) for own in cut]

    def assign():
        out = []
        for own, book in zip(cut, books):
            d = [[sum((a - b) ** 2 for a, b in zip(x, e)) for e in book] for x in own]
            out.append([(row.index(min(row)), min(row)) for row in d])
        return out

    for _ in range(rounds):
        for own, book, found in zip(cut, books, assign()):
            for j in range(len(book)):
                mine = [x for x, (k, _) in zip(own, found) if k == j]
                if mine:
                    book[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    codes = sorted(
        (r[0], "".join(f"{f[i][0]:02x}" for f in found), sum(f[i][1] for f in found)) for i, r in enumerate(kept)
    )
    return books, codes


def coded(spark, rows, schema=SCHEMA, **how):
    df = spark.createDataFrame(rows, schema)
    books = vc.learn_codebooks(df, **how)
    return books, sorted((tuple(r) for r in vc.encode_vectors(df, books).collect()), key=str)


@pytest.mark.parametrize("size", [1, 2**12, 2**28, 2**40, 2**58])
def test_products_are_exact(size):
    rng = random.Random(size)
    a = [[rng.randint(-size, size) for _ in range(16)] for _ in range(9)]
    b = [[rng.randint(-(2**62) // (17 * size) - 1, 2**62 // (17 * size)) for _ in range(16)] for _ in range(5)]
    got = vc.products(np.array(a, np.int64), np.array(b, np.int64))
    assert got.tolist() == [[sum(x * y for x, y in zip(r, c)) for c in b] for r in a]
    bits = 22
    for m in vc.limbs(np.array(a, np.int64), bits):
        assert abs(m).max() <= 2**bits
    assert (sum(m.astype(np.int64) << (bits * i) for i, m in enumerate(vc.limbs(np.array(a, np.int64), bits))) == a).all()


def test_nearest_takes_the_first_of_ties_at_any_size():
    for scale in (1, 2**35, 2**58):
        x = vc.tight([[0, 3 * scale], [scale, scale]])
        books = vc.tight([[0, 2 * scale], [0, 4 * scale], [scale, scale], [scale, scale]])
        best, far = vc.nearest(x, books)
        assert best.tolist() == [0, 2] and far == [scale**2, 0]


def test_equals_plain_loops(spark):
    rng = random.Random(5)
    near = lambda: [rng.choice([rng.uniform(-1, 1), rng.uniform(-50, 50)]) for _ in range(8)]
    rows = [(i, near(), i % 3) for i in range(120)]
    rows += [(7, rows[7][1], 1), (8, near(), 2)]  # repeated row, repeated id
    books, got = coded(spark, rows, parts=4, entries=16, rounds=3)
    want_books, want = plain(rows, 4, 16, 3, 1024)
    assert books.parts == want_books and got == sorted(want, key=str)


def test_huge_components(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 8, 17, 30]) for _ in range(4)], 0) for i in range(40)]
    books, got = coded(spark, rows, parts=2, entries=8, rounds=2)
    want_books, want = plain(rows, 2, 8, 2, 1024)
    assert books.parts == want_books
    assert got == sorted(((i, c, e if e < 2**63 else None) for i, c, e in want), key=str)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1),
        (5, [0.5, 0.0, 0.0, 0.0], None), (6, [1.0, 2.0], 1), (None, [0.5, 0.0, 0.0, 1.0], None), (9, [], 1),
    ]
    books, got = coded(spark, rows, parts=4, entries=2, rounds=1)
    assert books.width == 4 and {g[0]: g[1:] for g in got} == {
        5: ("00000000", 0), 6: (None, None), None: ("00000001", 0), 9: (None, None),
    }
    books, got = coded(spark, rows[:4])
    assert books.parts == [[], [], [], []] and got == []
    books, got = coded(spark, [])
    assert got == [] and len(books.sha256()) == 64
    books, got = coded(spark, [(1, [1.0, 2.0, 3.0], 0)])  # no four equal parts
    assert got == [(1, None, None)]


def test_clashing_names_and_decoding(spark):
    rows = [(1, [0.5, -0.25], "a", 1, 2), (2, [0.75, 0.0], "b", 3, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, k0 string, v int, n0 int")
    books = vc.learn_codebooks(df, parts=2, rounds=0)
    out = vc.encode_vectors(df, books, keep=("k0", "v"))
    assert out.columns == ["vec_id", "k0", "v", "code", "error"]
    back = {r["vec_id"]: (r["k0"], r["v"], r["decoded"]) for r in vc.decode_vectors(out, books).collect()}
    assert back == {1: ("a", 1, [0.5, -0.25]), 2: ("b", 3, [0.75, 0.0])}
    with pytest.raises(ValueError):
        vc.learn_codebooks(df, scale=1000)
