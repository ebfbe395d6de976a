"""Documents whose word n-grams overlap: MinHash bands and exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costspark.runtime import materialise, scratch_path

WORD = re.compile(r"\w+")
SEED = np.random.default_rng(20240501)
STEPS = SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted hashes (64 bits) of a text's distinct runs of ``n`` words.

    Words are runs of letters, digits and underscores in lower case.  A text of fewer
    words is one run of all of them; a text without words has none.
    """

    def __init__(self, n: int, most: int = 500_000):
        self.n, self.most, self.words = n, most, {}

    def __call__(self, text: str) -> np.ndarray:
        listed = WORD.findall(text.lower())
        if not listed:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > self.most:
            known = self.words = {}
        for w in set(listed).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, listed), np.uint64, len(listed))
        n = min(self.n, len(codes))
        total = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            total += _mixed(codes[j : len(codes) - n + 1 + j]) * STEPS[j]
        return np.unique(_mixed(total))


def depth_for(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """Length of the matched prefixes: shortened from ``deepest`` until a pair at the threshold
    shares one in at least one tree with probability ``recall``."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def prefixes(shingles: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One hash for each tree: the first ``depth`` min-hashes of its label."""
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, trees * depth, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    low = np.full(trees * depth, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 1024):
        h = x[k : k + 1024] * a
        h ^= h >> np.uint32(15)
        h *= b | np.uint32(1)
        np.minimum(low, h.min(axis=0), out=low)
    label = low.astype(np.uint64).reshape(trees, depth)
    total = np.arange(1, trees + 1, dtype=np.uint64) * STEPS[60]
    for j in range(depth):
        total = _mixed(total + label[:, j] * STEPS[j])
    return total.view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): label is the smallest node that a path reaches.

    Labels take the smallest label beside them, then that label's own label, until none
    changes.  Each round is a table; hot nodes combine map-side.
    """
    spark = edges.sparkSession
    both = materialise(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        scratch_path(spark, "edges"),
    )
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), scratch_path(spark, "labels"))
    while True:
        beside = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(beside, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        # A table on each side lets Spark split the many nodes that share a label.
        taken = materialise(taken, scratch_path(spark, "taken"))
        found = materialise(
            taken.join(jump, F.col("label") == F.col("at")).select("node", "was", F.least("label", "beyond").alias("label")),
            scratch_path(spark, "labels"),
        )
        labels = found.select("node", "label")
        if found.where("label <> was").isEmpty():
            return labels


def links_within(sets: list[np.ndarray], threshold: float, columns: int = 4096) -> np.ndarray:
    """Which of ``sets`` (sorted hashes) have a Jaccard similarity of ``threshold`` and more."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, int)
    runs = np.diff(np.r_[first, len(every)])
    keep = np.repeat(runs > 1, runs)  # what only one set has can't be shared
    owner, column = owner[keep], np.repeat(np.cumsum(runs > 1) - 1, runs)[keep]
    shared = np.zeros((n, n), np.float64)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [k, k + columns])
        block = np.zeros((n, columns), np.float32)
        block[owner[a:b], column[a:b] - k] = 1
        shared += block @ block.T
    linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest place that links reach from each place."""
    root = np.arange(len(linked))
    while len(root):
        low = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1))
        if (low == root).all():
            break
        root = low
    return root


def _verify(words: int, threshold: float):
    """Per block of two tiles: the links of each set in documents, and ties between sets.

    A block of one tile ties each set to the smallest that links reach.  A block of two ties only the
    smallest sets of the tiles' own components, to the smallest that links reach in both: what lies
    below them is tied in the blocks of one tile.  So a group of near copies gives a tie for
    each set and one for each pair of tiles.
    """

    def checked(rows: list[tuple], shingles: Shingles) -> Iterator[tuple]:
        one: dict[tuple, tuple] = {}
        for rep, digest, tile, copies, text in rows:
            if (rep, digest) not in one:
                own = shingles(text)
                if blake2b(own.tobytes(), digest_size=16).digest() == digest:
                    one[rep, digest] = (tile, copies, own)
        keys = sorted(one)
        tiles = np.array([one[k][0] for k in keys])
        copies = np.array([one[k][1] for k in keys], np.int64)
        linked = links_within([one[k][2] for k in keys], threshold)
        root, told = _roots(linked), np.ones(len(keys), bool)
        if len(set(tiles.tolist())) > 1:  # pairs of the same tile are counted in its own block
            inside = linked & (tiles[:, None] == tiles[None, :])
            told = _roots(inside) == np.arange(len(keys))
            linked &= ~inside
        for i, (key, links) in enumerate(zip(keys, (linked @ copies).tolist())):
            yield (*key, links, *(keys[root[i]] if told[i] and root[i] != i else (None, None)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, at, rows = Shingles(words), None, []
        kind = None

        def table(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [[]] * 5
            kinds = [kind, pa.binary(), pa.int64(), kind, pa.binary()]
            names = ["rep", "digest", "links", "root_rep", "root_digest"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for b in batches:
            kind = b.schema.field("rep").type
            found: list[tuple] = []
            listed = {n: b.column(n).to_pylist() for n in b.schema.names}
            keys = zip(listed["l_rep"], listed["l_digest"], listed["i"], listed["j"])
            for key, *row in zip(keys, *(listed[n] for n in ("rep", "digest", "tile", "copies", "text"))):
                if key != at:
                    found += checked(rows, shingles)
                    at, rows = key, []
                rows.append(tuple(row))
            yield table(found)
        if rows:
            yield table(list(checked(rows, shingles)))

    return verify


def near_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    trees: int = 32,
    deepest: int = 10,
    recall: float = 0.999,
    tile: int = 256,
) -> DataFrame:
    """Links between documents whose runs of ``words`` words have a Jaccard similarity of ``threshold``.

    Returns one row per row of ``docs``: ``id_col``, ``class_id`` (the smallest id that links
    lead to), ``n_links`` (other documents linked to this one, copies included), ``set_id`` (the smallest
    id with the same runs), ``stays`` (false for all rows of a class but those of its smallest id and set) and
    ``text_hash`` (xxhash64 of the text, which tells the rows of an id apart).  Ids are of any type that
    Spark orders.  A document without words links to none and stays.  A row without an id has null
    class and set and stays.  Rows that repeat an id count each, each with the links of its own text.

    Documents with equal sets of runs are one from the start, named by smallest id and digest.  The others
    meet if they share a prefix in any of ``trees`` bands; a bucket ties its members to its smallest one, and
    what is tied together is compared in full: exact similarities of all pairs, in blocks of
    two tiles of ``tile`` sets, of which counts and few ties leave the task.
    """
    spark = docs.sparkSession
    depth = depth_for(threshold, trees, deepest, recall)
    id_type = docs.schema[id_col].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in batches:
            digests, keys = [], []
            for text in b.column(1).to_pylist():
                own = shingles(text)
                digests.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                keys.append(prefixes(own, trees, depth) if len(own) else np.empty(0, np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, flat)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digests, pa.binary()), lists, b.column(2)], names=["id", "digest", "keys", "hash"]
            )

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    signed_rows = texts.mapInArrow(signed, f"id {id_type}, digest binary, keys array<bigint>, hash bigint")
    every = materialise(signed_rows, scratch_path(spark, "signed"))
    first = F.min(F.struct("id", "hash"))
    sets = (
        every.where("id IS NOT NULL AND digest IS NOT NULL").groupBy("digest")
        .agg(first.alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
        .select(F.struct(F.col("first.id").alias("rep"), "digest").alias("node"), F.col("first.hash").alias("hash"), "copies", "keys")
    )
    sets = materialise(sets, scratch_path(spark, "sets"))
    leaves = sets.select("node", F.explode("keys").alias("key"))
    hubs = leaves.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    hubs = materialise(hubs, scratch_path(spark, "hubs"))
    # A set is tied to its smallest hub, and its other hubs to that one: distinct, so a large group has few of these.
    met = leaves.join(hubs, "key").groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    met = met.select("node", "hubs", F.array_min("hubs").alias("b"))
    met = materialise(met, scratch_path(spark, "met"))
    ties = met.select(F.col("node").alias("a"), "b").unionByName(met.select(F.explode("hubs").alias("a"), "b").distinct())
    tied = components(ties.where("a <> b"))
    tiles = tied.groupBy("label").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    tiles = materialise(tiles, scratch_path(spark, "tiles"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    members = (
        tied.join(tiles, "label").withColumn("tile", own)
        .join(sets.select("node", "copies", "hash"), "node")
        .select("node.rep", "node.digest", F.col("hash").alias("of"), "label", "tile", "tiles", "copies")
    )
    members = materialise(members, scratch_path(spark, "members"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    same = (F.col("id") == F.col("rep")) & (F.col("hash") == F.col("of"))
    blocks = (
        # Members grow with the documents: never sent to every executor, also where they are few.
        texts.join(members.hint("merge"), same)
        .select("rep", "digest", F.col("label.rep").alias("l_rep"), F.col("label.digest").alias("l_digest"), "tile", "copies", "text", other)
        .withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
        .repartition("l_rep", "l_digest", "i", "j").sortWithinPartitions("l_rep", "l_digest", "i", "j", "rep", "digest")
    )
    schema = f"rep {id_type}, digest binary, links bigint, root_rep {id_type}, root_digest binary"
    found = blocks.mapInArrow(_verify(words, threshold), schema)
    found = found.select(
        F.struct("rep", "digest").alias("of"),
        "links",
        F.when(F.col("root_digest").isNotNull(), F.struct(F.col("root_rep").alias("rep"), F.col("root_digest").alias("digest"))).alias("root"),
    )
    found = materialise(found, scratch_path(spark, "links"))
    links = found.groupBy("of").agg(F.sum("links").alias("links"))
    classes = components(found.where("root IS NOT NULL").select(F.col("of").alias("a"), F.col("root").alias("b")))
    known = (
        sets.select("node", "copies")
        .join(links, F.col("node") == F.col("of"), "left")
        .join(classes.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
        .withColumn("label", F.coalesce("label", "node"))
        .select(
            F.col("node.digest").alias("d"),
            F.col("label.rep").alias("class_id"),
            (F.col("label.digest") == F.col("node.digest")).alias("smallest"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.col("node.rep").alias("set_id"),
        )
    )
    known = materialise(known, scratch_path(spark, "classes"))
    has = F.col("id").isNotNull()
    joined = every.join(known, (F.col("digest") == F.col("d")) & has, "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("set_id", "id").alias("set_id"),
        F.coalesce(F.col("smallest") & (F.col("id") == F.col("class_id")), F.lit(True)).alias("stays"),
        F.col("hash").alias("text_hash"),
    )
