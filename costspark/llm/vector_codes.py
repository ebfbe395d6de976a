"""Vectors as short codes: exact integer k-means per part, distances from limb-split matrix products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A float64 holds every integer up to here, an int64 every one below 2^63.
EXACT = 53
WORD = 1 << 63
# Sums cross the shuffle as digits to this base, so that Spark adds them as whole numbers.
DIGIT = 40


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` (int64) as float64 arrays l with x = sum of l[i] * 2^(bits * i).

    All but the last are in [0, 2^bits); the last has the sign.
    """
    out = []
    while x.size and max(int(x.max()), -int(x.min())) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of ``a`` and ``b`` (int64), exact whenever they lie in int64.

    Limbs are so narrow that each float64 product stays below 2^53.  They are added in
    int64, which counts modulo 2^64: what leaves the range on the way comes back.
    """
    bits = (EXACT - max(1, a.shape[1]).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    right = [m.T for m in limbs(b, bits)]
    for i, left in enumerate(limbs(a, bits)):
        for j, m in enumerate(right):
            if bits * (i + j) < 64:
                out += (left @ m).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """For each row of ``x`` the first nearest entry and the squared distance, exact for integers of any size."""
    width = max(1, x.shape[1])
    top = lambda m: int(abs(m).max()) if m.size else 0
    if x.dtype != object and entries.dtype != object and width * (top(x) + top(entries)) ** 2 < WORD:
        squares = lambda m: (m * m).sum(1)
        d = squares(x)[:, None] + squares(entries)[None, :] - 2 * products(x, entries)
        best = d.argmin(1)
        return best, d[np.arange(len(d)), best].tolist()
    best, far = np.zeros(len(x), np.int64), []
    for i, row in enumerate(x.astype(object)):  # Python integers
        d = ((entries.astype(object) - row) ** 2).sum(1).tolist()
        best[i] = d.index(min(d))
        far.append(min(d))
    return best, far


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite float64: int64, or Python integers where one is too large for that.

    ``scale`` is a power of two, so the product is exact.
    """
    if not x.size or np.abs(x).max() < (1 << 60) / scale:
        return np.floor(x * scale).astype(np.int64)
    whole = lambda v: int(np.floor(v * scale)) if abs(v) < 2.0**52 else int(v) * scale
    return np.array([[whole(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def tight(rows: list[list[int]]) -> np.ndarray:
    """Integers as int64 if all are small, as Python integers else."""
    small = all(-(1 << 60) < v < 1 << 60 for row in rows for v in row)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), len(rows[0]) if rows else 0)


@dataclass(frozen=True)
class Codebooks:
    """``parts[p][j]``: the components of entry j of part p, integers at ``scale``."""

    parts: list[list[list[int]]]
    scale: int
    width: int

    def sha256(self) -> str:
        numbers = (str(v) for part in self.parts for entry in part for v in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, fine)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow list column: which rows are usable, which of these have ``width``, and their components."""
    ends = np.array(column.offsets, np.int64)
    ends = ends - ends[0]
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    size = np.diff(ends)
    null = np.array(column.is_null())
    size[null] = 0
    start = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    fine = ~null & (bad[start[1:]] == bad[start[:-1]])
    whole = fine & (size == width)
    rows = flat[(start[:-1][whole, None] + np.arange(width)[None, :])] if width else np.zeros((int(whole.sum()), 0))
    return fine, whole, rows


def _sums(x: np.ndarray, best: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the rows of ``x`` by entry."""
    if x.dtype != object and x.size and int(np.abs(x).max()) * len(x) >= WORD:
        x = x.astype(object)
    total = np.zeros((entries, x.shape[1]), x.dtype)
    np.add.at(total, best, x)
    return total, np.bincount(best, minlength=entries)


def _round(vectors: DataFrame, vector_col: str, books: Codebooks, rows_at_once: int) -> Codebooks:
    """One round: parts are assigned, entries replaced by the floor of their parts' mean."""
    tables = [tight(p) for p in books.parts]
    width, scale, n = books.width, books.scale, len(tables)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[None, np.zeros(len(t), np.int64)] for t in tables]
        for batch in batches:
            _, _, rows = _matrix(batch.column(0), width)
            for at in range(0, len(rows), rows_at_once):
                x = integers(rows[at : at + rows_at_once], scale)
                for part, own, table in zip(np.split(x, n, axis=1), held, tables):
                    total, count = _sums(part, nearest(part, table)[0], len(table))
                    # Python integers across batches: no sum is too large.
                    own[0] = total.astype(object) if own[0] is None else own[0] + total.astype(object)
                    own[1] += count
        entry, digit, values = [], [], []
        first = 0
        for (total, count), table in zip(held, tables):
            for j in np.flatnonzero(count).tolist():
                numbers, i = [int(count[j]), *total[j].tolist()], 0
                while any(numbers):
                    low = [v & ((1 << DIGIT) - 1) if abs(v) >> DIGIT else v for v in numbers]
                    entry.append(first + j)
                    digit.append(i)
                    values.append(low)
                    numbers, i = [(v - w) >> DIGIT for v, w in zip(numbers, low)], i + 1
            first += len(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(entry, pa.int32()), pa.array(digit, pa.int32()), pa.array(values, pa.list_(pa.int64()))],
            ["entry", "digit", "numbers"],
        )

    found = vectors.select(vector_col).mapInArrow(partial, "entry int, digit int, numbers array<bigint>")
    sums = [F.sum(F.get("numbers", F.lit(i))).alias(f"n{i}") for i in range(width // n + 1)]
    totals: dict[int, list[int]] = {}
    for entry, digit, *numbers in found.groupBy("entry", "digit").agg(*sums).collect():  # as many as entries
        own = totals.setdefault(entry, [0] * len(numbers))
        totals[entry] = [v + (w << (DIGIT * digit)) for v, w in zip(own, numbers)]
    parts, first = [], 0
    for part in books.parts:
        mean = lambda t: [v // t[0] for v in t[1:]]
        parts.append([mean(totals[first + j]) if first + j in totals else e for j, e in enumerate(part)])
        first += len(part)
    return Codebooks(parts, scale, width)


def learn_codebooks(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    rows_at_once: int = 4096,
) -> Codebooks:
    """Codebooks of the ``parts`` equal consecutive parts of floor(``scale`` * vector).

    They start as the parts of the ``entries`` rows of smallest id (null ids last, ties by the vector;
    fewer rows give fewer entries).  Each of ``rounds`` rounds assigns every part to its nearest
    entry (ties to the lower index) and replaces an entry by the floor of the mean of its parts; unused
    entries stay.  All in integers, so the result depends on neither order nor partitions.

    ``scale`` is a power of two, ``entries`` at most 256.  Null and non-finite vectors take no
    part, nor do those of another length than the first row has; without rows, or where that
    length can't be divided by ``parts``, there are no entries.  A round reads ``vectors``
    once; what comes to the driver is as large as the codebooks.
    """
    if scale & (scale - 1) or not 0 < entries <= 256:
        raise ValueError("scale must be a power of two, entries 1 to 256")
    held = vectors.where(usable(F.col(vector_col)))
    one = held.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    order = [F.col("id").asc_nulls_last(), "v"]
    head = one.orderBy(*order).limit(1).collect()
    width = len(head[0]["v"]) if head else 0
    if not width or width % parts:
        return Codebooks([[] for _ in range(parts)], scale, width)
    first = [r["v"] for r in one.where(F.size("v") == width).orderBy(*order).limit(entries).collect()]
    x = integers(np.array(first, np.float64), scale)
    books = Codebooks([p.tolist() for p in np.split(x, parts, axis=1)], scale, width)
    for _ in range(rounds):
        books = _round(vectors, vector_col, books, rows_at_once)
    return books


def encode_vectors(
    vectors: DataFrame,
    books: Codebooks,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    keep: tuple[str, ...] = (),
    rows_at_once: int = 4096,
) -> DataFrame:
    """``id_col``, the columns ``keep``, ``code`` and ``error`` of every usable vector; repeated rows stay repeated.

    ``code`` has two hex digits a part, the index of its nearest entry; ``error`` is the squared
    distance summed over parts.  A vector of another length than the codebooks' has null for both, and
    an error beyond a long is null.  No shuffle: each task codes its rows.
    """
    tables = [tight(p) for p in books.parts]
    width, scale, n = books.width, books.scale, len(books.parts)
    fields = [vectors.schema[c].dataType.simpleString() for c in (id_col, *keep)]
    schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(fields)), "code string, error bigint"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, whole, rows = _matrix(batch.column(batch.num_columns - 1), width)
            codes: list[str | None] = []
            errors: list[int | None] = []
            for at in range(0, len(rows) if all(map(len, tables)) else 0, rows_at_once):
                x = integers(rows[at : at + rows_at_once], scale)
                found = [nearest(p, t) for p, t in zip(np.split(x, n, axis=1), tables)]
                codes += ["".join(f"{j:02x}" for j in row) for row in zip(*(b.tolist() for b, _ in found))]
                errors += [e if (e := sum(row)) < WORD else None for row in zip(*(d for _, d in found))]
            places = np.flatnonzero(whole)[: len(codes)]
            code, error = np.full(len(fine), None, object), np.full(len(fine), None, object)
            code[places], error[places] = codes, errors
            kept = [c.filter(pa.array(fine)) for c in batch.columns[:-1]]
            last = [pa.array(code[fine].tolist(), pa.string()), pa.array(error[fine].tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *last], [*(f"k{i}" for i in range(len(kept))), "code", "error"])

    rows = vectors.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate((id_col, *keep))), F.col(vector_col).alias("v"))
    out = rows.mapInArrow(coded, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate((id_col, *keep))), "code", "error")


def decode_vectors(codes: DataFrame, books: Codebooks, code_col: str = "code", out: str = "decoded") -> DataFrame:
    """``codes`` with the vector that each code stands for (its entries over ``scale``); null for a null code."""
    flat = [[v / books.scale for v in e] for part in books.parts for e in part]
    starts = np.cumsum([0, *map(len, books.parts)]).tolist()

    @F.udf("array<double>", useArrow=True)
    def decoded(code: str | None):
        if code is None:
            return None
        return [v for p, s in enumerate(starts[:-1]) for v in flat[s + int(code[2 * p : 2 * p + 2], 16)]]

    return codes.withColumn(out, decoded(F.col(code_col)))
