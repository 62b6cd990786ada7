"""Near-duplicate documents by a chosen-path set similarity join over minwise values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import shingles
from termloom.llm.common import Cuts, fresh, map_texts
from termloom.llm.simjoin import sieve, similar_components

#: Minwise values of a document, and the level of the trees at which nodes are first looked at.
MINS, LEVEL = 48, 3
#: A link at the threshold shares no node of any tree with this probability at most.
MISS = 1e-5


def trees(threshold: float) -> int:
    """As many as miss a pair at the threshold with probability MISS at most: in a tree it stays together with threshold ** LEVEL."""
    return int(np.ceil(np.log(MISS) / np.log(1 - threshold**LEVEL)))


def signatures(texts: list[str], k: int, hasher: shingles.MinHash, n_trees: int) -> list:
    groups = shingles.sets(texts, k)
    full = [i for i, g in enumerate(groups) if len(g)]
    digest, mins, keys, sketch = ([None] * len(groups) for _ in range(4))
    if full:
        values = hasher.values([groups[i] for i in full])
        nodes = shingles.paths(values, n_trees, LEVEL)
        for row, i in enumerate(full):
            digest[i], mins[i], keys[i], sketch[i] = shingles.digest(groups[i]), values[row].view("int32"), nodes[row], shingles.bins(groups[i])
    return [[len(g) for g in groups], digest, mins, keys, sketch]


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose sets of k-word shingles satisfy 100 * intersection >= percent * union, and find the components.

    Returns the id, `g_hash` (xxhash64 of the text), `n_shingles`, `component_id` (smallest id of
    the component) and `stays` (true for the component's first row by id, then text hash; rows equal
    in id and text are one). Texts with equal sets make one item, so copies cost no comparisons.

    A null or text without words has an empty set, is linked with nothing and stays. Null ids come
    last in order: a component of null ids only has a null id. Other columns are not read. An empty
    table gives an empty table. Intermediate tables are written to the shared folder of the cluster.

    A link at the threshold shares no tree node with probability MISS at most; where a wide node must
    branch, each level keeps it with about the threshold on each of its paths. The screen by sketch
    gives up what lies SIGMAS standard deviations below.
    """
    cuts = Cuts(docs.sparkSession, "neardup")
    hasher, n_trees = shingles.MinHash(MINS), trees(percent / 100)
    fields = "n_shingles long, digest binary, mins array<int>, keys array<long>, sketch binary"
    rows = docs.select(F.col(id_col).alias("g_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("g_hash"), F.col(text_col).alias("g_body"))
    signed = cuts.cut(map_texts(rows, "g_id", "g_body", lambda ts: signatures(ts, k, hasher, n_trees), fields, setup=None, carry=("g_hash",)))
    who = F.struct(F.col("g_id").isNull().alias("no_id"), "g_id", "g_hash")
    full = signed.filter("digest IS NOT NULL")
    reps = full.groupBy("digest").agg(F.min(who).alias("who")).select("digest", F.col("who.g_id").alias("r_id"), F.col("who.g_hash").alias("r_hash"))
    first = full.join(reps, "digest").filter(F.col("g_id").eqNullSafe(F.col("r_id")) & (F.col("g_hash") == F.col("r_hash"))).dropDuplicates(["digest"])
    # numbers are given as the table is written and stay: no later stage makes them anew
    items = cuts.cut(first.select(F.monotonically_increasing_id().alias("node"), "digest", "g_id", "g_hash", F.col("n_shingles").alias("n"), "mins", "keys", "sketch"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = items.select("node", F.col("g_id").alias("w_id"), F.col("g_hash").alias("w_hash")).join(nodes, "node")
        near = sieve(rows, "g_hash", wanted, "w_hash")
        return near.join(wanted, near["g_id"].eqNullSafe(wanted["w_id"]) & (near["g_hash"] == wanted["w_hash"])).select("node", F.col("g_body").alias("text"))

    def branch(key, c):
        at = F.pmod(F.xxhash64(key, F.lit(c)), F.lit(MINS)).cast("int")
        return F.xxhash64(key, F.lit(c), at, F.get("mins", at))

    labels = similar_components(items, texts_of, k, percent, cuts, branch)
    named = cuts.cut(items.select("node", "digest", who.alias("who")).join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"), "who"))
    heads = named.groupBy("label").agg(F.min("who").alias("head"))
    of_node = cuts.cut(named.join(heads, "label").select("digest", "head"))
    own = signed.select("g_id", "g_hash", "n_shingles", "digest").join(of_node, "digest", "left")
    stays = F.col("digest").isNull() | (F.col("g_id").eqNullSafe(F.col("head.g_id")) & (F.col("g_hash") == F.col("head.g_hash")))
    component = F.when(F.col("digest").isNull(), F.col("g_id")).otherwise(F.col("head.g_id"))
    return own.select(F.col("g_id").alias(id_col), "g_hash", "n_shingles", component.alias("component_id"), stays.alias("stays"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all columns, of which one of each component stays: the first by id. Rows equal in id and text become one."""
    th, wid, wh = fresh(docs, "g_texthash", "g_wid", "g_whash")
    good = near_components(docs, id_col, text_col, k, percent).filter("stays").select(F.col(id_col).alias(wid), F.col("g_hash").alias(wh))
    hashed = docs.withColumn(th, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    kept = hashed.join(good, F.col(f"`{id_col}`").eqNullSafe(F.col(wid)) & (F.col(th) == F.col(wh)), "left_semi")
    return kept.dropDuplicates([id_col, th]).select(*[F.col(f"`{c}`") for c in docs.columns])
