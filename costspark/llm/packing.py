"""Documents cut and packed into sequences of a fixed number of tokens."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costspark.llm.tokens import public_path, word_ids
from costspark.runtime import materialise, scratch_path

CAPACITY = 2048
BLOCK = 256
SWEPT = "kind string, part int, rank long, uid long, length int, seq long, offset int"


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = 0,
    keep_ids: bool = False,
) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity``; the last may be shorter.

    Returns ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, with ``keep_ids``, ``ids``.
    A null or empty text is the end id alone.
    """
    path = tokenizer or public_path("word_bpe_49k.json")
    id_type = docs.schema[id_col].dataType
    end, width = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows, pieces, starts, lengths, sums, kept = [], [], [], [], [], []
                for row, data in enumerate(encode(part.column(1).to_pylist())):
                    data += end
                    for k, begin in enumerate(range(0, len(data), width)):
                        ids = data[begin : begin + width]
                        rows.append(row)
                        pieces.append(k)
                        starts.append(begin // 4)
                        lengths.append(len(ids) // 4)
                        sums.append(crc32(ids))
                        if keep_ids:
                            kept.append(memoryview(ids).cast("I").tolist())
                out = [part.column(0).take(pa.array(rows)), pa.array(pieces, pa.int32())]
                out += [pa.array(x, pa.int64()) for x in (starts, lengths, sums)]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out, names = [*out, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    ids = ", ids array<bigint>" if keep_ids else ""
    schema = f"id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long{ids}"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def _sweep(capacity: int, alone: bool):
    """A pass over one range of documents and gaps, the largest first: each document takes the
    smallest gap of this range that holds it, and what is left of the gap stays open.

    ``alone``: the range is all there is, so a document without a gap opens a sequence.
    Otherwise it is handed on with its rank, and so are gaps that are still as large as
    the range's smallest entry; what has become smaller waits for the next round.
    """

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        open_by_size: dict[int, list[int]] = {}
        sizes: list[int] = []
        handed, low = 0, capacity

        def put(size: int, seq: int) -> None:
            if size in open_by_size:
                open_by_size[size].append(seq)
            elif size:
                insort(sizes, size)
                open_by_size[size] = [seq]

        for batch in batches:
            out = []
            for kind, uid, length in zip(batch["kind"].tolist(), batch["uid"].tolist(), batch["length"].tolist()):
                low = length
                if kind == "gap":
                    put(length, uid)
                    continue
                k = bisect_left(sizes, length)
                if k < len(sizes):
                    size = sizes[k]
                    seq = open_by_size[size].pop()
                    if not open_by_size[size]:
                        del open_by_size[size], sizes[k]
                elif alone:
                    size, seq = capacity, uid
                else:
                    out.append(("doc", part, handed, uid, length, None, None))
                    handed += 1
                    continue
                out.append(("placed", part, None, uid, length, seq, capacity - size))
                put(size - length, seq)
            yield _rows(out)
        rank, out = 0, []
        for size in sizes:
            for seq in open_by_size[size]:
                out.append(("gap" if size >= low else "rest", part, rank if size >= low else None, None, size, seq, None))
                rank += size >= low
        yield _rows(out)

    return sweep


def _rows(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in SWEPT.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"part": "Int32", "rank": "Int64", "uid": "Int64", "length": "Int32", "seq": "Int64", "offset": "Int32"})


def _plan(parts: list[dict], capacity: int) -> tuple[list[tuple], int]:
    """Which documents left over in a range take which gaps left over in ranges above.

    ``parts``: per range, the largest first, n_placed, n_docs, sum_docs, max_doc, n_gaps, min_gap
    and sum_gaps (with those that wait).
    The gaps above form a stack with the smallest on top.  A gap takes as many documents as
    the smallest gap holds of the largest document.  Returns (part, first rank, end rank,
    part of the gaps or -1 to open, first gap rank, documents a gap) and the number of
    documents left for the next round.
    """
    stack: list[list[int]] = []  # part, next rank, ranks left, smallest size
    plan, unserved = [], []
    for p in parts:
        at = 0
        while at < p["n_docs"] and stack:
            top = stack[-1]
            each = max(1, top[3] // p["max_doc"])
            n = min(p["n_docs"] - at, top[2] * each)
            plan.append((p["part"], at, at + n, top[0], top[1], each))
            used = -(-n // each)
            top[1], top[2], at = top[1] + used, top[2] - used, at + n
            if not top[2]:
                stack.pop()
        if at < p["n_docs"]:
            unserved.append((p, at))
        if p["n_gaps"]:
            stack.append([p["part"], 0, p["n_gaps"], p["min_gap"]])
    # Without a gap now: as many of the largest open a sequence as all of them need, less what is
    # left of gaps already open; if the round has placed nothing, that isn't deducted.
    total = sum(p["sum_docs"] * (p["n_docs"] - at) / p["n_docs"] for p, at in unserved)
    served = sum(p["sum_docs"] for p in parts) - total
    held = sum(p["sum_gaps"] for p in parts) - served
    if plan or any(p["n_placed"] for p in parts):
        need, left = max(0, int(-(-(total - held) // capacity))), 0
    else:
        need, left = max(1, int(-(-total // capacity))), 0
    for p, at in unserved:
        n = min(need, p["n_docs"] - at)
        if n:
            plan.append((p["part"], at, at + n, -1, 0, 1))
        need, left = need - n, left + p["n_docs"] - at - n
    return plan, left


def _across(swept: DataFrame, plan: list[tuple], capacity: int) -> DataFrame:
    """The planned matches between ranges, by rank: rows (kind, uid, length, seq, offset)."""
    spark = swept.sparkSession
    # At most three rows a range, whatever the number of documents.
    table = F.broadcast(spark.createDataFrame(plan or [(-1, 0, 0, -1, 0, 1)], "p int, a long, b long, q int, c long, each int"))
    docs = swept.where("kind = 'doc'").join(
        table, (F.col("part") == F.col("p")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")), "left"
    )
    none = F.lit(None)
    waiting = docs.where("q IS NULL").select(F.lit("doc").alias("kind"), "uid", "length", none.cast("long").alias("seq"), none.cast("int").alias("offset"))
    opened = docs.where("q = -1").select(
        F.inline(
            F.array(
                F.struct(F.lit("placed").alias("kind"), F.col("uid"), F.col("length"), F.col("uid").alias("seq"), F.lit(0).alias("offset")),
                F.struct(F.lit("gap").alias("kind"), F.col("uid"), (F.lit(capacity) - F.col("length")).alias("length"), none.cast("long").alias("seq"), none.cast("int").alias("offset")),
            )
        )
    )
    served = (
        docs.where("q >= 0")
        .select("q", (F.col("c") + F.expr("(rank - a) div each")).alias("gap_rank"), F.struct("rank", "uid", "length").alias("doc"))
        .groupBy("q", "gap_rank")
        .agg(F.array_sort(F.collect_list("doc")).alias("docs"))
    )
    gaps = swept.where("kind = 'gap'").select("part", F.col("rank").alias("of"), "seq", F.col("length").alias("size"))
    met = gaps.join(served, (F.col("part") == F.col("q")) & (F.col("of") == F.col("gap_rank")), "left")
    taken = lambda docs: F.aggregate(docs, F.lit(0), lambda s, d: s + d["length"])
    before = lambda i: taken(F.slice("docs", F.lit(1), i))
    placed = F.transform(
        F.coalesce("docs", F.array().cast("array<struct<rank:bigint,uid:bigint,length:int>>")),
        lambda d, i: F.struct(F.lit("placed").alias("kind"), d["uid"].alias("uid"), d["length"].alias("length"), F.col("seq").alias("seq"), (F.lit(capacity) - F.col("size") + before(i)).alias("offset")),
    )
    rest = F.struct(F.lit("gap").alias("kind"), F.col("seq").alias("uid"), (F.col("size") - F.coalesce(taken(F.col("docs")), F.lit(0))).alias("length"), none.cast("long").alias("seq"), none.cast("int").alias("offset"))
    matched = met.select(F.inline(F.concat(placed, F.array(rest))))
    return waiting.unionByName(opened).unionByName(matched)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, rows_a_task: int = 100_000) -> DataFrame:
    """Sequences for ``pieces`` (uid, length): (uid, seq, offset), each sequence gapless from 0.

    Pieces over half the capacity open a sequence each, the others are matched in rounds.
    A round sorts documents and gaps by size into ranges, sweeps every range on its own, then
    matches what the ranges leave over: documents of a smaller range take gaps of larger
    ones by rank.  Gaps are updated and the next round begins.  The number of ranges
    follows the number of rows; when one is enough, its sweep ends the work.  Each round's
    result is a table; the driver sees seven numbers a range.
    """
    spark = pieces.sparkSession
    large = F.col("length") > capacity // 2
    done = [pieces.where(large).select("uid", F.col("uid").alias("seq"), F.lit(0).alias("offset"))]
    state = pieces.select(
        F.when(large, F.lit("gap")).otherwise(F.lit("doc")).alias("kind"),
        "uid",
        F.when(large, F.lit(capacity) - F.col("length")).otherwise(F.col("length")).cast("int").alias("length"),
    )
    while True:
        is_doc = F.col("kind") == "doc"
        found = state.agg(F.count_if(is_doc).alias("docs"), F.min(F.when(is_doc, F.col("length"))).alias("least")).first()
        if not found["docs"]:
            break
        state = state.where((F.col("kind") == "doc") | (F.col("length") >= found["least"]))
        ranges = max(1, -(-state.count() // rows_a_task))
        order = [F.col("length").desc(), F.col("kind").desc(), F.col("uid")]  # gaps before documents of their size
        sorted_ = (state.repartition(1) if ranges == 1 else state.repartitionByRange(ranges, *order)).sortWithinPartitions(*order)
        swept = materialise(sorted_.mapInPandas(_sweep(capacity, ranges == 1), SWEPT), scratch_path(spark, "swept"))
        done.append(swept.where("kind = 'placed'").select("uid", "seq", "offset"))
        if ranges == 1:
            break
        doc, gap = F.col("kind") == "doc", F.col("kind") == "gap"
        size = F.col("length").cast("long")
        parts = swept.groupBy("part").agg(
            F.count_if(doc).alias("n_docs"),
            F.coalesce(F.sum(F.when(doc, size)), F.lit(0)).alias("sum_docs"),
            F.max(F.when(doc, size)).alias("max_doc"),
            F.count_if(gap).alias("n_gaps"),
            F.min(F.when(gap, size)).alias("min_gap"),
            F.coalesce(F.sum(F.when(gap | (F.col("kind") == "rest"), size)), F.lit(0)).alias("sum_gaps"),
            F.count_if(F.col("kind") == "placed").alias("n_placed"),
        )
        plan, left = _plan([r.asDict() for r in sorted(parts.collect(), key=lambda r: r["part"])], capacity)
        crossed = materialise(_across(swept, plan, capacity), scratch_path(spark, "crossed"))
        done.append(crossed.where("kind = 'placed'").select("uid", "seq", "offset"))
        if not left:
            break
        rest = swept.where("kind = 'rest'").select(F.lit("gap").alias("kind"), F.col("seq").alias("uid"), "length")
        state = rest.unionByName(crossed.where("kind <> 'placed'").select("kind", "uid", "length"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, rows_a_task: int = 100_000, **options) -> DataFrame:
    """Pieces of all documents (``token_pieces``) with ``sequence_id`` and ``offset``.

    Every row of ``docs`` is a document, repeated ids included.  Full pieces are a sequence
    by themselves; no piece is larger than a sequence, so all find a place.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, id_col, text_col, capacity=capacity, **options)
    # Written once, so that the numbers of the pieces hold from here on.
    pieces = materialise(pieces.withColumn("uid", F.monotonically_increasing_id()), scratch_path(spark, "pieces"))
    part = pieces.where(F.col("length") < capacity).select("uid", "length")
    placed = best_fit(part, capacity, rows_a_task).withColumnRenamed("uid", "_uid")
    return (
        pieces.join(placed, F.col("uid") == F.col("_uid"), "left")
        .withColumn("sequence_id", F.coalesce("seq", "uid"))
        .withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long"))
        .drop("uid", "_uid", "seq")
    )
