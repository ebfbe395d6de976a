"""Tries over conversations: nodes by prefix, subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costspark.runtime import materialise, scratch_path

# Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "a", "b"]
TOTALS = ["n_children", "n_leaves", "saved"]


class SpillingHeap:
    """A priority queue of tuples that holds at most ``limit`` in memory.

    What is beyond goes out as sorted runs, which are read back from their fronts: into the
    folders where Spark itself spills, as files without a name that end with the task.
    """

    def __init__(self, limit: int) -> None:
        self.limit, self.heap, self.fronts, self.runs = limit, [], [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        folders = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
        run = tempfile.TemporaryFile(dir=folders[len(self.runs) % len(folders)] if folders else None)
        for item in sorted(self.heap):
            pickle.dump(item, run, pickle.HIGHEST_PROTOCOL)
        run.seek(0)
        self.heap = []
        self.runs.append(run)
        self._advance(len(self.runs) - 1)

    def _advance(self, i: int) -> None:
        try:
            heapq.heappush(self.fronts, (pickle.load(self.runs[i]), i))
        except EOFError:
            self.runs[i].close()

    def peek(self) -> tuple | None:
        heads = [*self.heap[:1], *(item for item, _ in self.fronts[:1])]
        return min(heads) if heads else None

    def pop(self) -> tuple:
        if not self.fronts or (self.heap and self.heap[0] <= self.fronts[0][0]):
            return heapq.heappop(self.heap)
        item, i = heapq.heappop(self.fronts)
        self._advance(i)
        return item


def time_forward(nodes: DataFrame, shard: list[str], top: str, held: int = 200_000) -> DataFrame:
    """``nodes`` with n_children, n_leaves and saved of their subtrees, as far as their shard goes.

    ``nodes`` has depth, a, b (the key), pa, pb (the parent's), own_leaves, own_saved, what has come from
    other shards (in_children, in_leaves, in_saved), and may have more columns.  Rows of equal
    ``shard`` columns are one shard; where ``top`` holds, the row's total stays here.

    Spark sorts each task's nodes by reverse level order (deepest first, then key), outside memory
    where need be.  A node takes the messages that wait for it from the priority queue, adds its own
    values and sends the sum forward to its parent, whose turn is later; the queue
    holds at most ``held`` messages in memory.
    """
    extra = [c for c in nodes.columns if c not in ("n_children", "n_leaves", "saved")]
    fields = [nodes.schema[c] for c in extra]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), *(f"{t} bigint" for t in TOTALS)])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingHeap(held)
        names = [*KEY, "pa", "pb", "own_leaves", "own_saved", "in_children", "in_leaves", "in_saved", top]
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for depth, a, b, up_a, up_b, leaves, saved, more, more_leaves, more_saved, stays in zip(
                *(batch.column(n).to_pylist() for n in names)
            ):
                children, leaves, saved = more, leaves + more_leaves, saved + more_saved
                me = (-depth, a, b)
                while (first := queue.peek()) is not None and first[:3] == me:
                    _, _, _, m_leaves, m_saved = queue.pop()
                    children, leaves, saved = children + 1, leaves + m_leaves, saved + m_saved
                if not stays:
                    queue.push((1 - depth, up_a, up_b, leaves, saved))
                for column, value in zip(out, (children, leaves, saved)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in extra), *(pa.array(c, pa.int64()) for c in out)], [*extra, *TOTALS]
            )

    dealt = nodes.select(*extra).repartition(*shard) if shard else nodes.select(*extra).repartition(1)
    return dealt.sortWithinPartitions(F.desc("depth"), "a", "b").mapInArrow(forward, schema)


def number_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row a turn: conv, slice, at (place in the conversation from 0), n (its turns), first (of its slice),
    digest (of role and text), words.

    Turns go by ``turn_col`` (null first; ties by digest, repeated rows stay); null role and text are
    empty; rows without a conversation id take no part.  Rows are dealt by ranges of (id, turn), so
    that a conversation of any length spreads over tasks; its part in one range is a slice, and
    what comes before a slice is added from the slices' counts.  Texts end here.
    """
    spark = turns.sparkSession
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    short = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    short = materialise(short, scratch_path(spark, "trie-turns"))
    order = ["conv", "turn", "digest"]
    dealt = short.repartitionByRange(*order).withColumn("slice", F.spark_partition_id())
    dealt = materialise(dealt, scratch_path(spark, "trie-slices"))
    slices = dealt.groupBy("conv", "slice").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv").orderBy("slice")
    slices = slices.select(
        "conv",
        "slice",
        F.coalesce(F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
        F.sum("size").over(Window.partitionBy("conv")).alias("n"),
    )
    own = F.row_number().over(Window.partitionBy("conv", "slice").orderBy("turn", "digest"))
    placed = dealt.withColumn("own", own).join(slices, ["conv", "slice"])
    numbered = placed.select(
        "conv", "slice", (F.col("earlier") + F.col("own") - 1).alias("at"), "n", (F.col("own") == 1).alias("first"), "digest", "words"
    )
    return materialise(numbered, scratch_path(spark, "trie-numbered"))


def _paths(steps: DataFrame) -> DataFrame:
    """The node of each step: key (depth, a, b) and parent's key.

    a and b are sums modulo 2 (XOR) of hashes of (depth, digest) over the prefix, 128 bits together.  They
    run inside slices first; the sums of earlier slices are added, so no conversation meets in one task.
    """
    mixed = steps.select("*", *(F.xxhash64(F.lit(seed), "depth", "digest").alias(f"m{c}") for c, seed in (("a", 1), ("b", 2))))
    run = Window.partitionBy("conv", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    slices = mixed.groupBy("conv", "slice").agg(*(F.bit_xor(f"m{c}").alias(f"s{c}") for c in "ab"))
    before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("conv", "slice", *(F.coalesce(F.bit_xor(f"s{c}").over(before), F.lit(0)).alias(f"e{c}") for c in "ab"))
    inside = mixed.select("*", *(F.bit_xor(f"m{c}").over(run).alias(f"r{c}") for c in "ab"))
    keyed = inside.join(slices, ["conv", "slice"])
    keyed = keyed.select("*", *(F.col(f"r{c}").bitwiseXOR(F.col(f"e{c}")).alias(c) for c in "ab"))
    return keyed.select(
        "conv", "depth", "length", "words", "a", "b", *(F.col(c).bitwiseXOR(F.col(f"m{c}")).alias(f"p{c}") for c in "ab")
    )


def build_trie(steps: DataFrame, members: DataFrame, shard_weight: int = 50_000, levels: int = 256, held: int = 200_000) -> DataFrame:
    """The nodes of the trie of the members' sequences.

    ``steps``: conv, slice, depth (from 1), length (of the member's sequence), digest, words.
    ``members``: conv (one row each, an integer id), length (0 allowed).  A node is a distinct prefix, the root the empty one.

    Returns per node depth, a, b (its key), pa, pb (its parent's, null for the root), conv_id (smallest member),
    parent_conv_id, n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (sum over the
    subtree of (n_convs - 1) times the words of a node's last item) and ends_sha256 (digest of the ids
    that end at the node, ascending, joined by commas).  No members, no rows.

    Shards: a node's weight is the number of steps of its members from it on, at least its subtree's size.
    Nodes of at most ``shard_weight`` are light; a shard is a largest light subtree.  Light shards are
    done first.  Their roots' totals, summed per parent, come to the heavy nodes, which are cut into blocks of
    ``levels`` levels: each block's own sum, then the blocks' roots in one ordered pass (a
    row for each block), then the blocks again with what their lower blocks sent.
    """
    spark = steps.sparkSession
    paths = materialise(_paths(steps), scratch_path(spark, "trie-paths"))
    grouped = [F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words")]
    inner = paths.groupBy(*KEY, "pa", "pb").agg(*grouped, F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    key = lambda n: [F.lit(0).cast("bigint").alias(n[0]), F.lit(0).cast("bigint").alias(n[1])]
    none = [F.lit(None).cast("bigint").alias(c) for c in ("pa", "pb")]
    root = (
        members.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("weight"))
        .where("n_convs > 0")
        .select(F.lit(0).cast("bigint").alias("depth"), *key("ab"), *none, "conv_id", "n_convs", F.lit(0).cast("bigint").alias("words"), "weight")
    )
    nodes = inner.withColumn("depth", F.col("depth").cast("bigint")).unionByName(root)
    nodes = nodes.select(
        *KEY, "pa", "pb", "conv_id", "n_convs", "weight",
        (F.col("weight") == F.col("n_convs")).cast("bigint").alias("own_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"),
    )
    nodes = materialise(nodes, scratch_path(spark, "trie-nodes"))
    nothing = [F.lit(0).cast("bigint").alias(f"in_{t}") for t in ("children", "leaves", "saved")]

    # A light node has at most shard_weight members and steps below it, so neither join has a hot key.
    light = (F.col("weight") <= shard_weight) & (F.col("depth") > 0)
    small = nodes.where(light)
    places = paths.select("conv", F.col("depth").cast("bigint").alias("depth"), "a", "b")
    starts = places.join(small.select(*KEY), KEY).groupBy("conv").agg(F.min(F.struct(*KEY)).alias("s"))
    starts = starts.select(F.col("conv").alias("conv_id"), *(F.col(f"s.{c}").alias(f"s_{c}") for c in KEY))
    sharded = small.join(starts, "conv_id").withColumn("top", F.col("depth") == F.col("s_depth"))
    done = time_forward(sharded.select("*", *nothing), ["s_a", "s_b"], "top", held)
    done = materialise(done, scratch_path(spark, "trie-light"))
    sent = _to_parents(done.where("top"))

    corner = lambda up: (F.floor(F.col("depth") / levels) * levels - up).cast("bigint")
    corners = places.where((F.col("depth") % levels == 0) & (F.col("depth") > 0))
    corners = corners.select(F.col("conv").alias("conv_id"), F.col("depth").alias("c_depth"), F.col("a").alias("c_a"), F.col("b").alias("c_b"))

    def with_corner(rows: DataFrame, up: int) -> DataFrame:
        """``rows`` with the key of the root of their block, or of the block ``up`` levels higher."""
        met = rows.withColumn("c_depth", corner(up)).join(corners, ["conv_id", "c_depth"], "left")
        return met.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("c_a", "c_b")})  # none: the root

    heavy = with_corner(nodes.where(~light), 0).withColumn("top", F.col("depth") == F.col("c_depth"))
    heavy = materialise(heavy, scratch_path(spark, "trie-heavy"))
    part = time_forward(_receive(heavy, sent), ["c_depth", "c_a", "c_b"], "top", held).where("top")
    part = part.drop("own_leaves", "own_saved", "c_depth", "c_a", "c_b").withColumnsRenamed({"n_leaves": "own_leaves", "saved": "own_saved"})
    part = materialise(part.drop("n_children"), scratch_path(spark, "trie-blocks"))
    across = with_corner(part, levels).select(
        (F.col("depth") / levels).cast("bigint").alias("depth"), "a", "b", F.col("c_a").alias("pa"), F.col("c_b").alias("pb"),
        "own_leaves", "own_saved", *nothing, (F.col("depth") == 0).alias("top"),
        F.col("depth").alias("own_depth"), F.col("pa").alias("own_pa"), F.col("pb").alias("own_pb"),
    )
    across = time_forward(across, [], "top", held).where("own_depth > 0")
    across = across.select(F.col("own_depth").alias("depth"), F.col("own_pa").alias("pa"), F.col("own_pb").alias("pb"), "n_leaves", "saved")
    rest = time_forward(_receive(heavy, sent.unionByName(_to_parents(across))), ["c_depth", "c_a", "c_b"], "top", held)

    columns = [*KEY, "pa", "pb", "conv_id", "n_convs", *TOTALS]
    found = done.select(*columns).unionByName(rest.select(*columns))
    found = materialise(found, scratch_path(spark, "trie-totals"))
    # The parents are distinct rows, so Spark can split a hot one's children.
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id")
    )
    ends = paths.where("depth = length")
    ends = ends.select(F.col("depth").cast("bigint").alias("depth"), "a", "b", "conv")
    turnless = members.where("length = 0").select(F.lit(0).cast("bigint").alias("depth"), *key("ab"), "conv")
    digests = end_digests(ends.unionByName(turnless))
    out = found.join(above, ["depth", "pa", "pb"], "left").join(digests, KEY, "left")
    return out.select(
        *KEY, "pa", "pb", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _to_parents(tops: DataFrame) -> DataFrame:
    """What shard roots send to their parents' nodes, one row a parent."""
    return tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved").alias("in_saved")
    )


def _receive(nodes: DataFrame, sent: DataFrame) -> DataFrame:
    """``nodes`` with what was sent to them, 0 where nothing was."""
    names = ["in_children", "in_leaves", "in_saved"]
    summed = sent.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in names))
    return nodes.join(summed, KEY, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in names})


def end_digests(ends: DataFrame) -> DataFrame:
    """Per node (depth, a, b) the SHA-256 of the ids in ``conv``, ascending, joined by commas.

    The ids of a node stream through one task in order, since a digest is made of one sequence; nothing of
    them is held but the state of the digest.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*KEY, "ends_sha256"])

        for batch in batches:
            found = []
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in [*KEY, "conv"])):
                if key != at:
                    if at is not None:
                        found.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield rows(found)
        if at is not None:
            yield rows([(*at, state.hexdigest())])

    ordered = ends.select(*KEY, "conv").repartition(*KEY).sortWithinPartitions(*KEY, "conv")
    return ordered.mapInArrow(digest, "depth bigint, a bigint, b bigint, ends_sha256 string")


def prefix_trie(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    shard_weight: int = 50_000,
    levels: int = 256,
) -> DataFrame:
    """The trie of the conversations as they are: ``number_turns``, then ``build_trie``."""
    numbered = number_turns(turns, conv_col, turn_col, role_col, text_col)
    steps = numbered.select("conv", "slice", (F.col("at") + 1).alias("depth"), F.col("n").alias("length"), "digest", "words")
    members = numbered.where("at = 0").select("conv", F.col("n").alias("length"))
    return build_trie(steps, members, shard_weight, levels)
