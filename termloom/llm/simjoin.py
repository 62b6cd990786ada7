"""Set similarity components: groups of colliding items, compared in blocks by sketch, then exactly on whole sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from termloom.llm import shingles
from termloom.llm.common import Cuts
from termloom.llm.components import components

#: Items that a task compares with each other at a time, in whole arrays; a larger group is dealt into blocks of about so many.
SMALL = 1024
#: Shingles that a block holds when sets are compared, beyond its largest set.
WEIGHT = 1 << 20
#: Levels of branching; a node that is still wide there is compared block by block.
DEPTH = 6
#: Members of a wide group that every block of it gets.
PIVOTS = 6
#: Bits of the sieve that texts pass before they are shuffled to the exact check.
SIEVE_BITS = 24
#: The screen before the exact check lets pass what is within so many standard deviations of the threshold.
SIGMAS = 5.0
#: Columns of the shingle matrix that are multiplied at a time.
CHUNK = 1 << 11
LINK = StructType([StructField("a", LongType()), StructField("b", LongType())])


def sieve(rows: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> DataFrame:
    """The rows whose hash may be among the wanted ones, before they are shuffled; none that is wanted is lost.

    The wanted hashes set bits of 512 bitmaps of 4 KB, whatever their number: that is all that is
    broadcast. On a very large table the bits fill up and the sieve lets more through; the join
    that follows decides in any case.
    """
    place = lambda c: F.pmod(F.col(c), F.lit(1 << SIEVE_BITS)) + 1
    maps = wanted.select(place(wanted_column).alias("g_place")).groupBy(F.bitmap_bucket_number("g_place").alias("g_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("g_place")).alias("g_bits"))
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring(F.col("g_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(column)) == F.col("g_bucket"))
    return joined.filter(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*[rows[c] for c in rows.columns])


# ---- what a task does with a block


def blocks(batches) -> Iterator:
    """Record batches of one (key, block) each, from batches sorted by these first two columns."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        key, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]
        for i, j in zip(edges, edges[1:], strict=False):
            yield batch.slice(i, j - i)
        held = batch.slice(edges[-1])
    if held is not None:
        yield held


def joining(linked: np.ndarray, rows: np.ndarray, comps: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (rows x all items) as many as join the components (comps: one of each item): pairs of places."""
    out, root = [], comps.copy()
    for r, i in zip(linked, rows.tolist(), strict=True):
        there = np.flatnonzero(r)
        found, first = np.unique(root[there], return_index=True)
        for f, j in zip(found.tolist(), there[first].tolist(), strict=True):
            if f != root[i]:
                out.append((i, j))
                root[root == f] = root[i]
    return out


def likely(marks: np.ndarray, sizes: np.ndarray, rows: np.ndarray, threshold: float) -> np.ndarray:
    """rows x all: whether the sketches leave it possible that two sets reach the threshold.

    Of the bins that not both sets leave empty, a part equal to the similarity is equal on average.
    Its variance at the threshold is that of bins drawn without replacement from the union, so small
    sets are compared almost exactly.
    """
    out = np.zeros((len(rows), len(marks)), bool)
    used = marks != 0
    for n, i in enumerate(rows.tolist()):
        bins = np.count_nonzero(used | used[i], axis=1)
        same = np.count_nonzero((marks == marks[i]) & used[i], axis=1)
        both = np.maximum((sizes + sizes[i]) / (1 + threshold), 2.0)  # the union's size at the threshold
        spread = np.maximum((1 + 1 / (both - 1)) / bins - 1 / (both - 1), 0) * threshold * (1 - threshold)
        near = np.minimum(sizes, sizes[i]) >= threshold * np.maximum(sizes, sizes[i])
        out[n] = near & (same >= bins * (threshold - SIGMAS * np.sqrt(spread)) - 1)
    return out


def exactly(sets: list[np.ndarray], rows: np.ndarray, percent: int) -> np.ndarray:
    """rows x all: whether 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = np.zeros((len(rows), len(sets)), np.int64)
    if len(sets) <= 4:
        for n, i in enumerate(rows.tolist()):
            shared[n] = [len(np.intersect1d(sets[i], s, assume_unique=True)) for s in sets]
    else:
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1  # what stands in one set only is in no intersection
        keep = times[at] > 1
        owner, at = owner[keep], number[at[keep]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, CHUNK):
            i, j = np.searchsorted(at, (low, low + CHUNK))
            has = np.zeros((len(sets), min(CHUNK, int(at[-1]) + 1 - low)), np.float32)
            has[owner[i:j], at[i:j] - low] = 1
            shared += (has[rows] @ has.T).astype(np.int64)
    return 100 * shared >= percent * (sizes[rows][:, None] + sizes - shared)


def block_links(kernel: Callable[[object, np.ndarray], np.ndarray]):
    """For mapInArrow: of rows (key, block, node, comp, out, payload ...) the links that join components.

    kernel(batch, rows) says which items each of the rows, the `out` ones, is linked with.
    """
    import pyarrow as pa

    def run(batches):
        found: list[tuple[int, int]] = []
        for batch in blocks(batches):
            node, comp, out = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            rows = np.flatnonzero(out)
            if len(node) < 2 or not len(rows) or (comp == comp[0]).all():
                continue
            found += [(int(node[i]), int(node[j])) for i, j in joining(kernel(batch, rows), rows, comp)]
            if len(found) > 1 << 16:
                yield _batch(found)
                found = []
        yield _batch(found)

    def _batch(pairs):
        ab = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(ab[:, 0], ab[:, 1])), pa.array(np.minimum(ab[:, 0], ab[:, 1]))], names=["a", "b"])

    return run


def by_sketch(percent: int):
    def kernel(batch, rows):
        marks = np.stack([np.frombuffer(m, np.uint8) for m in batch.column(5).to_pylist()])
        return likely(marks, batch.column(6).to_numpy(zero_copy_only=False).astype(np.float64), rows, percent / 100)

    return kernel


def by_set(k: int, percent: int):
    return lambda batch, rows: exactly(shingles.sets(batch.column(5).to_pylist(), k), rows, percent)


# ---- groups: (key, node) rows; a group's members are those of equal keys


def _sized(groups: DataFrame, cuts: Cuts, weights: DataFrame | None = None) -> DataFrame:
    """(key, node, members, g) of the groups of two members or more, of groups with equal members one: g is the number of its blocks.

    Counts are made before the shuffle; the joins read plain tables, whose large partitions Spark can split.
    """
    own = groups if weights is None else groups.join(weights, "node")
    weight = F.lit(0) if weights is None else F.sum("n")
    counted = own.groupBy("key").agg(F.count(F.lit(1)).alias("members"), weight.alias("weight"), F.sum(F.shiftright(F.xxhash64("node", F.lit(7)), 24)).alias("s"), F.bit_xor(F.xxhash64("node")).alias("x")).filter("members > 1")
    least = F.least("members", F.greatest(F.ceil(F.col("members") / SMALL), F.ceil(F.col("weight") / WEIGHT)))
    kept = cuts.cut(counted.groupBy("members", "s", "x").agg(F.min("key").alias("key"), F.first("weight").alias("weight")).select("key", "members", least.cast("int").alias("g")))
    out = cuts.cut(groups.join(kept, "key").select("key", "node", "members", "g"))
    cuts.drop(kept)
    return out


def _dealt(groups: DataFrame) -> DataFrame:
    """(key, block, node, comp, out): each group in g blocks; of a wide one about PIVOTS members, by luck, stand in all its blocks."""
    own = F.pmod(F.xxhash64("node", F.lit(17)), F.col("g")).cast("int")
    small = groups.filter("g = 1").select("key", F.lit(0).alias("block"), "node")
    wide = groups.filter("g > 1")
    luck = F.pmod(F.xxhash64("node", "key", F.lit(23)), F.lit(1 << 30)).cast("double") * F.col("members") < float(PIVOTS << 30)
    at = F.explode(F.when(luck, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(own)))
    return small.unionByName(wide.select("key", at.alias("block"), "node")).select("key", "block", "node", F.col("node").alias("comp"), F.lit(True).alias("out"))


def _opened(groups: DataFrame, labels: DataFrame, cuts: Cuts) -> DataFrame:
    """(key, node, g, comp, outside, out) of the wide groups with two components or more: how many members are outside the largest, and which."""
    named = cuts.cut(groups.filter("g > 1").join(labels, "node", "left").select("key", "node", "g", F.coalesce("label", "node").alias("comp")))
    sizes = cuts.cut(named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all_n")).select("key", F.col("main.comp").alias("main"), (F.col("all_n") - F.col("main.n")).alias("outside")).filter("outside > 0")
    out = cuts.cut(named.join(main, "key").select("key", "node", "g", "comp", "outside", (F.col("comp") != F.col("main")).alias("out")))
    cuts.drop(named, sizes)
    return out


def _crossed(opened: DataFrame) -> DataFrame:
    """(key, block, node, comp, out): the members outside a group's largest component meet all its members, block by block."""
    h = F.ceil(F.col("outside") / SMALL).cast("int")
    h = F.when(F.col("g") * SMALL > 4 * F.col("outside"), h).otherwise(F.col("g"))  # as many where sets, not members, make the blocks
    rows = opened.withColumn("h", h)
    own = F.pmod(F.xxhash64("node", F.lit(17)), F.col("g")).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(29)), F.col("h")).cast("int")
    to_all = rows.filter("out").select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda b: b * F.col("h") + mine)).alias("block"), "node", "comp", F.lit(True).alias("out"))
    all_to = rows.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda b: own * F.col("h") + b)).alias("block"), "node", "comp", F.lit(False).alias("out"))
    return to_all.unionByName(all_to)


def _compared(rows: DataFrame, payload: DataFrame, kernel) -> DataFrame:
    joined = rows.join(payload, "node").select("key", "block", "node", "comp", "out", *[c for c in payload.columns if c != "node"])
    return joined.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(block_links(kernel), LINK)


def similar_components(items: DataFrame, texts_of: Callable[[DataFrame], DataFrame], k: int, percent: int, cuts: Cuts, branch: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """(node, label) for the nodes that have a link; the label is the smallest node of the component.

    `items` (a written table) has a distinct set each: node (a number), n (its size), keys (array: the
    groups in which it is compared) and sketch (see shingles.bins). texts_of(nodes) gives (node,
    text) of given nodes. branch(key, c) makes a child's key from a node's key and the item's `mins`.

    1. Groups of equal keys are compared by sketch, each in one task; of the pairs that may reach the
       threshold only as many come back as join components: at most one for each member, whatever the
       number of pairs. A wide group is dealt into blocks that share some pivots, so near copies of
       one text come together at linear cost. Where more than SMALL members stay outside its largest
       component, a wide group branches by further minwise values chosen by its path, 1 / threshold
       of them on average, or, at DEPTH, where there is no branch(), or where fewer stay outside, they
       meet all its members, block by block.
    2. The components so found hold all links. Each is a group whose whole sets are compared exactly;
       one that is too wide for a task is taken apart into the groups of 1 again. Texts are shuffled
       once for most documents.

    No pair is made as a row, and none is given up for a group's size.
    """
    sketched = items.select("node", "sketch", "n")
    keyed = items.select("node", F.explode("keys").alias("key"))
    links: list[DataFrame] = []
    leaves: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        groups = _sized(keyed, cuts)
        leaves.append(groups)
        links.append(cuts.cut(_compared(_dealt(groups), sketched, by_sketch(percent))))
        if groups.filter("g > 1").isEmpty():
            break
        labels = components(reduce(DataFrame.union, links), cuts)
        opened = _opened(groups, labels, cuts)
        if opened.isEmpty():
            break
        wide = F.col("outside") > SMALL if branch is not None and depth < DEPTH else F.lit(False)
        links.append(cuts.cut(_compared(_crossed(opened.filter(~wide)), sketched, by_sketch(percent))))
        further = opened.filter(wide).select("key", "node")
        if branch is None or further.isEmpty():
            break
        second = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1000)) < int(1000 * (100 / percent - 1))
        children = F.when(second, F.array(branch(F.col("key"), 0), branch(F.col("key"), 1))).otherwise(F.array(branch(F.col("key"), 0)))
        keyed = further.join(items.select("node", "mins"), "node").select("node", F.explode(children).alias("key"))
    loose = components(reduce(DataFrame.union, links), cuts)
    if loose.isEmpty():
        return loose
    return _confirmed(loose, leaves, items.select("node", "n"), texts_of, k, percent, cuts)


def _confirmed(loose: DataFrame, leaves: list[DataFrame], weights: DataFrame, texts_of, k: int, percent: int, cuts: Cuts) -> DataFrame:
    """The components of the links that hold on whole sets, inside the components `loose`."""
    texts = cuts.cut(texts_of(loose.select("node")))
    sized = _sized(loose.select(F.col("label").alias("key"), "node"), cuts, weights)
    wide = sized.filter("g > 1").select("node", F.col("key").alias("label"))
    parts = sized.filter("g = 1")
    if not wide.isEmpty():
        apart = [x.select("key", "node").join(wide, "node").select(F.xxhash64("key", "label").alias("key"), "node") for x in leaves]
        parts = cuts.cut(parts.unionByName(_sized(reduce(DataFrame.union, apart), cuts, weights)))
    links = cuts.cut(_compared(_dealt(parts), texts, by_set(k, percent)))
    if not parts.filter("g > 1").isEmpty():
        opened = _opened(parts, components(links, cuts), cuts)
        if not opened.isEmpty():
            links = links.union(cuts.cut(_compared(_crossed(opened), texts, by_set(k, percent))))
    out = components(links, cuts)
    cuts.drop(texts)
    return out
