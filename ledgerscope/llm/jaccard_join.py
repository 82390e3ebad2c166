"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles. Texts with equal sets form one node, so copies
are joined once. In each run a node picks every shingle with probability 1 / (threshold *
size) and goes into the bucket of each picked one; two sets of similarity ``threshold`` share
one pick on average. A bucket of up to ``leaf_rows`` nodes is compared by brute force, a larger
one is split again by a fresh choice, up to ``depth`` times; what is then still large, such
as a large group of near copies, is compared in tiles. Picks are a hash of the path so far, which
begins with the run, and the shingle: all texts choose alike, every path chooses anew, and
nothing is sent but paths until the leaves are known.

Runs repeat until a pair at the threshold is met with probability ``recall`` even if its
buckets were split to the last level: the chance p to share a path of k levels is p = 1 - exp(-q),
with q the chance for k - 1 levels. Every met pair is then compared on whole sets (32 bits per
shingle). A pair that meets in several leaves is counted in the first of them only.

Results: ``class_id`` is the smallest id of the connected group, ``n_links`` the number of other
documents at least ``threshold`` similar, copies included. No list of pairs is made: a leaf returns
one row per linked node.

Defined results: texts of one to four words are one shingle; texts without words, null included,
are classes of their own. Rows of one id are documents of their own. A class of null ids
only has a null id. Other columns may have any names and come back as they were.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerscope.llm.texts import combine, mix, packed, plain, row_key, scan_words, small_batches, text_chunks, unpacked
from ledgerscope.session import new_folder, write_and_read

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.97
DEPTH, LEAF_ROWS, TILE_ROWS = 3, 256, 512
_BLOCK = 1 << 18
_DENSE = 32
_TOLERANCE = 1e-9


def runs_needed(recall: float, depth: int) -> int:
    """Runs after which a pair that shares one pick per level on average has met with this probability."""
    chance = 1.0
    for _ in range(depth):
        chance = 1.0 - math.exp(-chance)
    return max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - chance)))


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Per text its distinct shingle hashes, sorted."""
    words = scan_words(data, bounds)
    hashes, first = combine(words.hashes, SHINGLE), words.first
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(hashes[a:b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(combine(words.hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_name(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def picks(sets: list[np.ndarray], depth: int, runs: int, threshold: float) -> list[pa.ListArray]:
    """Per set its tree of paths, one array per level: level 1 has the lists of level 0's children, and so on.

    A choice depends on the path so far, which stands for run and level too, and on the shingle.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    limits = np.minimum(2.0 ** 64 / (threshold * np.maximum(sizes, 1)), 2.0 ** 64 - 2048).astype(np.uint64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    begins = np.cumsum(sizes) - sizes
    paths, owner = np.tile(np.arange(runs, dtype=np.uint64), len(sets)), np.repeat(np.arange(len(sets)), runs)
    values, offsets = [], []
    for level in range(depth):
        salts = mix(paths + np.uint64(1)) | np.uint64(1)
        first = np.searchsorted(owner, np.arange(len(sets) + 1)).tolist()
        up, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, s in enumerate(sets):
            step = max(1, _BLOCK // max(len(s), 1))
            for low in range(first[i] if len(s) else first[i + 1], first[i + 1], step):
                hits = np.flatnonzero(np.multiply.outer(salts[low:min(low + step, first[i + 1])], s) < limits[i])
                up.append(hits // len(s) + low)
                at.append(hits % len(s) + begins[i])
        up, at = np.concatenate(up), np.concatenate(at)
        owner, n = owner[up], len(paths)
        paths = mix(flat[at] ^ salts[up])
        values.append(paths.view(np.int64))
        offsets.append(np.searchsorted(owner, np.arange(len(sets) + 1)) if level == 0 else np.searchsorted(up, np.arange(n + 1)))
    out = []
    for level in range(depth):
        nested = pa.array(values[level])
        for k in reversed(range(level + 1)):
            nested = pa.ListArray.from_arrays(pa.array(offsets[k], pa.int32()), nested)
        out.append(nested)
    return out


def _describe(batches: Iterator[pa.RecordBatch], depth: int, runs: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row0 = 0
        for data, bounds in text_chunks(batch.column(0)):
            sets = shingle_sets(data, bounds)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(row0, n), batch.column(2).slice(row0, n), pa.array([set_name(s) for s in sets], pa.binary()),
                 *picks(sets, depth, runs, threshold)],
                names=["id", "key", "node", *[f"p{level}" for level in range(depth)]])
            row0 += n


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, bounds in text_chunks(batch.column(0)):
            sets = [s for s in shingle_sets(data, bounds) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_name(s) for s in sets], pa.binary()), pa.array([(s >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary())],
                names=["node", "members"])


def leaves_of(nodes: DataFrame, depth: int, leaf_rows: int) -> DataFrame:
    """(leaf, node, size): the buckets of two nodes or more that are not split further."""
    spark = nodes.sparkSession

    def spread(df: DataFrame, k: int) -> DataFrame:
        """A row per path of level ``k``, with the paths below it only."""
        below = F.explode(F.arrays_zip(*[f"p{j}" for j in range(k, depth)])).alias("x")
        return df.select("node", below).select("node", F.col(f"x.p{k}").alias("path"), *[f"x.p{j}" for j in range(k + 1, depth)])

    level, found = spread(nodes, 0), None
    for k in range(depth):
        level = write_and_read(level, new_folder(spark, "paths"))
        # Written before they are joined, at every size by sorting: such a join can split a path that very many nodes share.
        sizes = write_and_read(level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), new_folder(spark, "path-sizes"))
        held = level.join(sizes.hint("merge"), "path")
        done = F.lit(True) if k == depth - 1 else F.col("size") <= leaf_rows
        leaves = held.where(done).select(F.col("path").alias("leaf"), "node", "size")
        found = leaves if found is None else found.unionByName(leaves)
        if k == depth - 1 or sizes.where(F.col("size") > leaf_rows).isEmpty():
            break
        level = spread(held.where(~done), k + 1)
    return found


def distinct_leaves(leaves: DataFrame) -> DataFrame:
    """One of the leaves that hold the same nodes."""
    content = leaves.groupBy("leaf", "size").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s1"),
                                                 F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(20,0)")).alias("s2"))
    kept = content.groupBy("size", "s1", "s2").agg(F.min("leaf").alias("leaf")).select("leaf")
    kept = write_and_read(kept, new_folder(leaves.sparkSession, "leaf-names"))
    return leaves.join(kept.hint("merge"), "leaf", "left_semi")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes of a bounded number of sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    heads = np.flatnonzero(np.diff(flat.astype(np.int64), prepend=-1))
    counts = np.diff(np.append(heads, len(flat)))
    out = np.zeros((n, n), np.float32)
    for size in range(2, min(_DENSE, n) + 1):  # shingles of few sets: their pairs; of many: a matrix product
        at = heads[counts == size]
        if len(at):
            members = row[at[:, None] + np.arange(size)]
            a, b = np.triu_indices(size, 1)
            out += np.bincount((members[:, a] * n + members[:, b]).ravel(), minlength=n * n).reshape(n, n)
    out += out.T
    wide = np.flatnonzero(counts > _DENSE)
    for low in range(0, len(wide), 2048):
        part = wide[low:low + 2048]
        grid = np.zeros((n, len(part)), np.float32)
        for j, k in enumerate(part):
            grid[row[heads[k]:heads[k] + counts[k]], j] = 1.0
        out += grid @ grid.T
    np.fill_diagonal(out, sizes)
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have at least this Jaccard similarity."""
    sizes = np.array([len(s) for s in sets], np.float64)
    common = common_counts(sets).astype(np.float64)
    out = common + _TOLERANCE >= threshold * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(out, False)
    return out


def smallest_reached(pairs: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix the smallest row of its connected part."""
    label = np.arange(len(pairs))
    while True:
        lower = np.minimum(label, np.where(pairs, label[None, :], len(pairs)).min(axis=1, initial=len(pairs)))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Input sorted by (leaf, low, high): one cell of a leaf at a time, at most two tiles of nodes."""
    held: list[dict] = []

    def cell() -> pa.RecordBatch | None:
        sets = [np.frombuffer(r["members"], "<u4") for r in held]
        leaf, across = held[0]["leaf"], held[0]["low"] != held[0]["high"]
        pairs = linked(sets, threshold)
        if across:
            tile = np.array([r["tile"] for r in held])
            pairs &= tile[:, None] != tile[None, :]
        if not pairs.any():
            return None
        earlier = sorted({x for r in held for x in r["leaves"] if x < leaf})
        first = pairs
        if earlier:
            column, grid = {x: j for j, x in enumerate(earlier)}, np.zeros((len(held), len(earlier)), np.float32)
            for i, r in enumerate(held):
                grid[i, [column[x] for x in r["leaves"] if x < leaf]] = 1.0
            first = pairs & (grid @ grid.T == 0)
        copies = np.array([r["copies"] for r in held], np.int64)
        links, root, some = first @ copies, smallest_reached(pairs), np.flatnonzero(pairs.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array([held[i]["node"] for i in some], pa.binary()), pa.array([held[root[i]]["node"] for i in some], pa.binary()),
             pa.array(links[some], pa.int64())], names=["node", "root", "links"])

    at = None
    for batch in batches:
        for r in batch.to_pylist():
            here = (r["leaf"], r["low"], r["high"])
            if here != at and held:
                found = cell()
                if found is not None:
                    yield found
                held = []
            at = here
            held.append(r)
    if held and (found := cell()) is not None:
        yield found


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (node, root): one label per connected group.

    Each round gives a node the smallest of itself and its neighbours and contracts the edges
    accordingly. Nodes are digests, so a constant share of them vanishes per round.
    """
    spark = edges.sparkSession
    edges = edges.where(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    edges = write_and_read(edges, new_folder(spark, "edges"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        smallest = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("from"), F.least("a", "b").alias("to"))
        smallest = write_and_read(smallest, new_folder(spark, "smallest"))
        nodes = nodes.join(smallest, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label"))
        one = edges.join(smallest, F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b")
        two = one.join(smallest, F.col("b") == F.col("from")).select("a", F.col("to").alias("b"))
        edges = write_and_read(two.where(F.col("a") != F.col("b")).distinct(), new_folder(spark, "edges"))
    return nodes


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL,
                    depth: int = DEPTH, leaf_rows: int = LEAF_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, key, node, class_id, n_links, label) per row; ``key`` is :func:`row_key` of the text, ``label`` names the class."""
    spark, runs = docs.sparkSession, runs_needed(recall, depth)
    small_batches(spark)
    texts = docs.select(plain(text_col).alias("_text"), plain(id_col).alias("id"), row_key(plain(text_col)).alias("key"))
    kind = texts.schema["id"].dataType.simpleString()
    levels = ", ".join(f"p{k} " + "array<" * (k + 1) + "bigint" + ">" * (k + 1) for k in range(depth))
    rows = write_and_read(texts.mapInArrow(partial(_describe, depth=depth, runs=runs, threshold=threshold),
                                           f"id {kind}, key bigint, node binary, {levels}"), new_folder(spark, "nodes"))
    found = rows.where(F.col("node").isNotNull())
    copies = found.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    nodes = found.dropDuplicates(["node"]).select("node", *[f"p{k}" for k in range(depth)])
    leaves = write_and_read(distinct_leaves(leaves_of(nodes, depth, leaf_rows)), new_folder(spark, "leaves"))
    active = leaves.groupBy("node").agg(F.collect_list(F.struct("leaf", "size")).alias("at")).join(copies, "node")
    sets = texts.select("_text").mapInArrow(_sets, "node binary, members binary").groupBy("node").agg(F.first("members").alias("members"))
    tiles = F.ceil(F.col("l.size") / tile_rows).cast("int")
    members = active.join(sets, "node").select("node", "members", "copies", F.transform("at", lambda x: x["leaf"]).alias("leaves"), F.explode("at").alias("l")).select(
        "node", "members", "copies", "leaves", F.col("l.leaf").alias("leaf"), tiles.alias("tiles"),
        F.pmod(F.xxhash64("l.leaf", "node"), tiles).cast("int").alias("tile"))
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "node", "members", "copies", "leaves", "leaf", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    compared = cells.repartition("leaf", "low", "high").sortWithinPartitions("leaf", "low", "high").mapInArrow(
        partial(_compare, threshold=threshold), "node binary, root binary, links bigint")
    compared = write_and_read(compared, new_folder(spark, "links"))
    label = connected(compared.select("node", "root"))
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    known = copies.join(label, "node", "left").join(links, "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    smallest = found.groupBy("node").agg(F.min("id").alias("first")).join(known.select("node", "label"), "node").groupBy("label").agg(
        F.min("first").alias("class_id"))
    judged = known.join(smallest, "label")
    out = rows.select("id", "key", "node").join(judged, "node", "left")
    return out.select("id", "key", "node", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "label")


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, that of the smallest id (by the hash of its text among equal ids); texts without words all stay."""
    classes = jaccard_classes(docs, id_col, text_col, **options)
    place = F.struct(F.col("id").isNull().alias("no"), "id", "key")
    first = classes.where(F.col("node").isNotNull()).groupBy("label").agg(F.min(place).alias("p"))
    wordless = classes.where(F.col("node").isNull()).select("id", "key").distinct()
    keep = first.select(F.col("p.id").alias("kept_id"), F.col("p.key").alias("kept_key"), F.lit(True).alias("one")).union(
        wordless.select("id", "key", F.lit(False)))
    # One hash of id and text deals both sides out, so copies spread and repeats of a row meet where they were joined.
    keep = keep.withColumn("to", F.xxhash64("kept_key", F.col("kept_id").isNull(), "kept_id"))
    keyed = docs.select(packed(docs), plain(id_col).alias("id"), row_key(plain(text_col)).alias("key"))
    keyed = keyed.withColumn("from", F.xxhash64("key", F.col("id").isNull(), "id"))
    kept = keyed.join(keep, (F.col("from") == F.col("to")) & (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id")))
    again = F.when(F.col("one"), F.lit(0)).otherwise(F.monotonically_increasing_id())  # wordless rows all differ
    return kept.withColumn("again", again).dropDuplicates(["from", "key", "kept_id", "again"]).select(*unpacked(docs))


def jaccard_digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links per document."""
    return jaccard_classes(docs.select("doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id", "n_links")
