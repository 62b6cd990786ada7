"""Necessary normal form: proximal parents and the attributes that nothing stronger makes redundant."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.cuts import Cuts
from termloom.operators import el
from termloom.operators.graph import proximal, transitive_closure


@dataclass
class NormalForms:
    """is_a (concept, parent); attributes (concept, grp, type_id, destination_id); skipped (kind, id), each once."""

    is_a: DataFrame
    attributes: DataFrame
    skipped: DataFrame
    named: DataFrame


def normal_forms(axioms: DataFrame, sound: bool = False) -> NormalForms:
    """Classify the axioms, then reduce each named concept.

    A concept's candidates are its own stated groups (each value outside groups is a group 0 of one)
    and those of the concepts above it along proximal parents. A group goes if another of the
    concept's groups covers it: each of its values has one in the other whose role and filler are the
    same or more special. This is a preorder, so what is left is its maximal classes; of groups that
    cover each other the concept's own comes first, then the one stated lowest in the hierarchy,
    then the smaller id. Values inside one group are left as stated.
    """
    cuts = Cuts(axioms.sparkSession, "nnf")
    c = el.classify(axioms, sound)
    below = cuts.cut(c.subsumption)
    strict = below.select(F.col("sub").alias("descendant"), F.col("sup").alias("ancestor"))
    is_a = cuts.cut(proximal(strict).select(F.col("child").alias("concept"), "parent"))
    above = transitive_closure(is_a.select(F.col("concept").alias("child"), "parent"), cuts)

    depth = below.groupBy(F.col("sub").alias("owner")).count()
    own = c.flat.filter("kind = 'own'").select(F.col("a").alias("owner"), "grp", F.col("r").alias("type_id"), F.col("b").alias("destination_id"))
    singles = own.filter("grp = 0").select("owner", F.array(F.struct("type_id", "destination_id")).alias("parts"), F.lit(True).alias("zero"))
    groups = own.filter("grp <> 0").groupBy("owner", "grp").agg(F.array_sort(F.collect_list(F.struct("type_id", "destination_id"))).alias("parts")).select("owner", "parts", F.lit(False).alias("zero"))
    stated = cuts.cut(singles.unionByName(groups).distinct().join(depth, "owner", "left").withColumn("depth", F.coalesce("count", F.lit(0))).drop("count"))

    heirs = above.filter("descendant <> ancestor").select(F.col("descendant").alias("concept"), F.col("ancestor").alias("owner")).union(c.named.select("concept", F.col("concept").alias("owner")))
    ranked = F.struct((F.col("owner") != F.col("concept")).alias("inherited"), (-F.col("depth")).alias("up"), "owner", (~F.col("zero")).alias("grouped"), "parts")
    # equal groups of several owners are one candidate, of the first rank
    candidates = cuts.cut(heirs.join(stated, "owner").groupBy("concept", "zero", "parts").agg(F.min(ranked).alias("rank")).withColumn("gid", F.xxhash64("zero", F.to_json("parts"))))

    role_up = transitive_closure(c.flat.filter("kind = 'role'").select(F.col("a").alias("child"), F.col("b").alias("parent")), cuts)
    values = candidates.select("concept", "gid", F.explode("parts").alias("p")).select("concept", "gid", "p.type_id", "p.destination_id").distinct()
    roles = role_up.select(F.col("descendant").alias("type_id"), F.col("ancestor").alias("type_up"))
    wider = values.join(roles, "type_id").select("concept", "gid", F.col("type_up").alias("type_id"), "destination_id").unionByName(values).distinct()
    fillers = below.select(F.col("sub").alias("destination_id"), F.col("sup").alias("filler_up"))
    covers = wider.join(fillers, "destination_id").select("concept", "gid", "type_id", F.col("filler_up").alias("destination_id")).unionByName(wider).distinct()
    size = values.groupBy("concept", "gid").agg(F.count(F.lit(1)).alias("n"))
    met = covers.withColumnRenamed("gid", "by").join(values, ["concept", "type_id", "destination_id"]).filter("by <> gid").groupBy("concept", "gid", "by").agg(F.count(F.lit(1)).alias("met"))
    covered = cuts.cut(met.join(size, ["concept", "gid"]).filter("met = n").select("concept", "gid", "by"))
    mutual = covered.select("concept", F.col("gid").alias("by"), F.col("by").alias("gid"), F.lit(True).alias("mutual"))
    rank = candidates.select("concept", "gid", "rank")
    weaker = (
        covered.join(mutual, ["concept", "gid", "by"], "left")
        .join(rank, ["concept", "gid"]).join(rank.select("concept", F.col("gid").alias("by"), F.col("rank").alias("by_rank")), ["concept", "by"])
        .filter("mutual IS NULL OR by_rank < rank").select("concept", "gid").distinct()
    )
    kept = candidates.join(weaker, ["concept", "gid"], "left_anti")
    number = F.row_number().over(Window.partitionBy("concept").orderBy("parts"))  # a concept's own few groups
    numbered = kept.filter("NOT zero").select("concept", number.alias("grp"), "parts").unionByName(kept.filter("zero").select("concept", F.lit(0).alias("grp"), "parts"))
    attributes = numbered.select("concept", "grp", F.explode("parts").alias("p")).select("concept", "grp", "p.type_id", "p.destination_id")
    skipped = c.flat.filter("kind = 'skipped'").select(F.regexp_replace("text", "^profile ", "").alias("kind"), F.col("a").alias("id")).distinct()
    return NormalForms(is_a, attributes, skipped, c.named)
