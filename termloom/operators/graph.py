"""The IS-A graph: edges, neighbours, closure, reduction, cycles.

Graphs may have cycles, so nothing here uses recursive SQL, which does not end on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.cuts import Cuts
from termloom.functions import constants as K


def is_a_edges(relationships: DataFrame) -> DataFrame:
    """(child, parent) of the active inferred IS-A rows, each once; ends need not exist as concepts."""
    rows = relationships.filter(F.col("active") & (F.col("typeId") == K.IS_A) & (F.col("characteristicTypeId") == K.INFERRED))
    return rows.select(F.col("sourceId").alias("child"), F.col("destinationId").alias("parent")).distinct()


def transitive_closure(edges: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """(descendant, ancestor) for every path of one edge or more, so a concept on a cycle is its own ancestor.

    Paths double in each round, so the rounds are the logarithm of the longest path. New pairs come
    from the last round's new pairs only: (new then known) and (known then new). Each round's new pairs are
    written to the shared folder beside those known; the loop ends when a round adds nothing.
    """
    cuts = cuts or Cuts(edges.sparkSession, "closure")
    known = cuts.cut(edges.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor")).distinct())
    new = known
    while True:
        left = lambda df: df.select("descendant", F.col("ancestor").alias("via"))
        right = lambda df: df.select(F.col("descendant").alias("via"), "ancestor")
        found = left(new).join(right(known), "via")
        if new is not known:
            found = found.unionByName(left(known).join(right(new), "via"))
        fresh = cuts.cut(found.select("descendant", "ancestor").distinct().join(known, ["descendant", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            cuts.drop(fresh)
            return known
        known, new = cuts.together(known, fresh), fresh


def reach(edges: DataFrame, seeds: DataFrame, down: bool = True, cuts: Cuts | None = None) -> DataFrame:
    """Ids of the descendants (down) or ancestors of the seeds (a column `id`), by frontiers: the cost follows what is reached, not the graph.

    A seed is in the result if a path of one edge or more leads back to it or from another seed.
    """
    cuts = cuts or Cuts(edges.sparkSession, "reach")
    near, far = ("parent", "child") if down else ("child", "parent")
    step = edges.select(F.col(near).alias("id"), F.col(far).alias("next"))
    frontier, parts = seeds.select("id").distinct(), None
    while True:
        nxt = frontier.join(step, "id").select(F.col("next").alias("id")).distinct()
        if parts is not None:
            nxt = nxt.join(parts, "id", "left_anti")
        frontier = cuts.cut(nxt)
        if frontier.isEmpty():
            return parts if parts is not None else frontier
        parts = frontier if parts is None else parts.unionByName(frontier)


def ancestors(edges: DataFrame, concept: int) -> DataFrame:
    """Strict ancestors; the concept itself is left out even on a cycle."""
    seed = edges.sparkSession.createDataFrame([(concept,)], "id long")
    return reach(edges, seed, down=False).filter(F.col("id") != concept)


def descendants(edges: DataFrame, concept: int) -> DataFrame:
    seed = edges.sparkSession.createDataFrame([(concept,)], "id long")
    return reach(edges, seed, down=True).filter(F.col("id") != concept)


def is_ancestor_of(edges: DataFrame, a: int, b: int) -> bool:
    """Whether a path leads from b up to a; on a cycle a concept is its own ancestor here."""
    seed = edges.sparkSession.createDataFrame([(b,)], "id long")
    return not reach(edges, seed, down=False).filter(F.col("id") == a).isEmpty()


def subsumes(edges: DataFrame, a: int, b: int) -> bool:
    return a == b or is_ancestor_of(edges, a, b)


def bulk_subsumes(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with `outcome`: equivalent, subsumes, subsumed-by or not-subsumed."""
    down = closure.select(F.col("ancestor").alias("a"), F.col("descendant").alias("b"), F.lit(True).alias("g_down"))
    up = closure.select(F.col("descendant").alias("a"), F.col("ancestor").alias("b"), F.lit(True).alias("g_up"))
    outcome = F.when(F.col("a") == F.col("b"), "equivalent").when(F.col("g_down"), "subsumes").when(F.col("g_up"), "subsumed-by").otherwise("not-subsumed")
    return pairs.join(down, ["a", "b"], "left").join(up, ["a", "b"], "left").withColumn("outcome", outcome).drop("g_down", "g_up")


def proximal(closure: DataFrame) -> DataFrame:
    """(child, parent) pairs with no other ancestor of the child below the parent. Of equivalent parents none is proximal."""
    strict = closure.filter("descendant <> ancestor")
    first = strict.select(F.col("descendant").alias("child"), F.col("ancestor").alias("between"))
    second = strict.select(F.col("descendant").alias("between"), F.col("ancestor").alias("parent"))
    passed = first.join(second, "between").select("child", "parent").distinct()
    return strict.select(F.col("descendant").alias("child"), F.col("ancestor").alias("parent")).join(passed, ["child", "parent"], "left_anti")


def core(edges: DataFrame, cuts: Cuts) -> DataFrame:
    """What is left of a written table of edges when those that lead to a top or start at a bottom are taken away, round
    by round, while a round takes a tenth or more of them. Edges on cycles always stay; a hierarchy without any is soon empty."""
    rest, size = edges, edges.count()
    while size:
        starts, ends = rest.select(F.col("child").alias("parent")).distinct(), rest.select(F.col("parent").alias("child")).distinct()
        inner = cuts.cut(rest.join(starts, "parent", "left_semi").join(ends, "child", "left_semi").select("child", "parent"))
        if rest is not edges:
            cuts.drop(rest)
        rest, size, before = inner, inner.count(), size
        if size > 0.9 * before:
            break
    return rest


def cyclic(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Ids on a cycle that known concepts (column `id`) lead to. Only the core of the graph is closed."""
    cuts = Cuts(edges.sparkSession, "cyclic")
    edges = cuts.cut(edges.select("child", "parent").distinct())
    rest = core(edges, cuts)
    if rest.isEmpty():
        return rest.select(F.col("child").alias("id"))
    loops = transitive_closure(rest, cuts).filter("descendant = ancestor").select(F.col("ancestor").alias("id"))
    above = reach(edges, concepts, down=False, cuts=cuts)
    return loops.join(above.unionByName(concepts.select("id")).distinct(), "id", "left_semi")
