"""Expression constraints compiled to lazy DataFrames of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.cuts import Cuts
from termloom.functions import constants as K
from termloom.operators import graph
from termloom.operators.snapshot import Snapshot
from termloom.plans.ecl import Attribute, Compound, Filtered, Group, Logic, MemberOf, Refined, Simple, parse

STATUS = {"PRIMITIVE": K.PRIMITIVE, "DEFINED": K.DEFINED}


def compare(left: Column, op: str, right) -> Column:
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


class Compiler:
    """compile(tree) makes a DataFrame with one column `id`, each id once. Equal parts of a tree are compiled once.

    Sets are joined as semi and anti joins; whether a side is broadcast is left to the optimiser,
    which knows its size when it runs.
    """

    def __init__(self, snapshot: Snapshot):
        self.s, self.memo, self.written = snapshot, {}, None

    def __call__(self, text: str) -> DataFrame:
        tree = parse(text)
        if isinstance(tree, Refined):  # focus, types and values all ask for the known ids: they are written once
            self.written = Cuts(self.s.spark, "known").cut(self.s.concepts.select("id"))
        return self.compile(tree)

    def compile(self, tree) -> DataFrame:
        if tree not in self.memo:
            make = {Simple: self.simple, MemberOf: self.member_of, Compound: self.compound, Refined: self.refined, Filtered: self.filtered}[type(tree)]
            self.memo[tree] = make(tree)
        return self.memo[tree]

    @property
    def known(self) -> DataFrame:
        return self.s.concepts.select("id") if self.written is None else self.written

    def related(self, concept: int, down: bool, direct: bool) -> DataFrame:
        if direct:
            return self.s.children(concept) if down else self.s.parents(concept)
        if "closure" in self.s.__dict__:  # it has been made: no need to walk
            here, there = ("ancestor", "descendant") if down else ("descendant", "ancestor")
            return self.s.closure.filter((F.col(here) == concept) & (F.col(there) != concept)).select(F.col(there).alias("id"))
        return graph.descendants(self.s.edges, concept) if down else graph.ancestors(self.s.edges, concept)

    def simple(self, t: Simple) -> DataFrame:
        down, direct, itself = t.op[:1] == "<", t.op.endswith("!"), not t.op or t.op[:2] in ("<<", ">>")
        if t.concept is None:
            if itself:
                return self.known
            end = F.col("child" if down else "parent").alias("id")  # < *: has a parent; > *: has a child
            return self.known.join(self.s.edges.select(end), "id", "left_semi")
        own = self.known.filter(F.col("id") == t.concept)
        if not t.op:
            return own
        found = self.related(t.concept, down, direct)
        return found.unionByName(own).distinct() if itself else found.distinct()

    def member_of(self, t: MemberOf) -> DataFrame:
        return self.s.refset_members(t.refset)

    def compound(self, t: Compound) -> DataFrame:
        parts = [self.compile(x) for x in t.items]
        if t.op == "OR":
            return reduce(DataFrame.unionByName, parts).distinct()
        how = "left_semi" if t.op == "AND" else "left_anti"
        return reduce(lambda a, b: a.join(b, "id", how), parts)

    def filtered(self, t: Filtered) -> DataFrame:
        """Filters test the concept's own row, so ids that are no concepts go, whatever the filter."""
        rows = self.s.concepts.join(self.compile(t.inner), "id", "left_semi")
        for f in t.filters:
            negated = f.op == "!="
            if f.field == "active":
                test = F.lit(True) if f.value == "*" else F.col("active") == F.lit(f.value == "TRUE")
                rows = rows.filter(~test if negated else test)
            elif f.field == "definitionStatus":
                test = F.col("definitionStatusId").isin([STATUS[v] for v in f.value])
                rows = rows.filter(~test if negated else test)
            elif f.field == "moduleId":
                rows = rows.join(self.compile(f.value).withColumnRenamed("id", "moduleId"), "moduleId", "left_anti" if negated else "left_semi")
            else:
                rows = rows.filter(reduce(Column.__or__, [compare(F.col("effectiveTime"), f.op, v) for v in f.value]))
        return rows.select("id")

    # ---- refinements: rows that match a constraint are tagged with its number, all constraints' rows
    # are counted in one aggregate, and the counts are joined to the focus from the left, so that a
    # concept without rows has counts of 0

    def facts(self) -> DataFrame:
        rows = self.s.relationships.filter(F.col("active") & (F.col("characteristicTypeId") == K.INFERRED))
        return rows.select("sourceId", "destinationId", F.col("relationshipGroup").alias("grp"), "typeId")

    def typed(self, rows: DataFrame, name) -> DataFrame:
        """The rows whose type the constraint `name` selects. That of a plain concept is a filter too, which reaches the scan."""
        if isinstance(name, Simple) and not name.op and name.concept is not None:
            rows = rows.filter(F.col("typeId") == name.concept)
        return rows.join(self.compile(name).withColumnRenamed("id", "typeId"), "typeId", "left_semi")

    def matching(self, a: Attribute) -> DataFrame:
        """(id, grp) of the rows that satisfy an attribute constraint, a row each."""
        if a.kind == "expression":
            own, other = ("destinationId", "sourceId") if a.reverse else ("sourceId", "destinationId")
            rows = self.typed(self.facts(), a.name)
            rows = rows.join(self.compile(a.value).withColumnRenamed("id", other), other, "left_semi")
            return rows.select(F.col(own).alias("id"), "grp")
        rows = self.typed(self.s.concretes.filter(F.col("active") & (F.col("characteristicTypeId") == K.INFERRED)), a.name)
        if a.kind == "number":
            # != counts the equal rows and denies the count
            test = (F.col("value.value_type") == "Number") & compare(F.col("value.num"), "=" if a.op == "!=" else a.op, float(a.value))
        else:
            test = (F.col("value.value_type") == "String") & F.col("value.value").isin(list(a.value))
        return rows.filter(test).select(F.col("sourceId").alias("id"), F.col("relationshipGroup").alias("grp"))

    def counts(self, attributes: list[Attribute], keys: list[str]) -> DataFrame:
        tagged = [self.matching(a).withColumn("tag", F.lit(i)) for i, a in enumerate(attributes)]
        return reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(*[F.count_if(F.col("tag") == i).alias(f"n{i}") for i in range(len(attributes))])

    def group_counts(self, g: Group) -> DataFrame:
        """(id, n): in how many groups other than 0 the body holds, by that group's rows alone."""
        attributes: list[Attribute] = []
        holds = self.condition(g.body, attributes, [])
        counts = self.counts(attributes, ["id", "grp"]).filter("grp <> 0")
        if not self.holds_empty(g.body):
            counts = counts.filter(holds)
            if all(a.kind == "expression" and not a.reverse for a in attributes):  # groups with a match are groups of relationships
                return counts.groupBy("id").count()
        universe = self.facts().filter("grp <> 0").select(F.col("sourceId").alias("id"), "grp").distinct()
        if not self.holds_empty(g.body):
            return counts.join(universe, ["id", "grp"], "left_semi").groupBy("id").count()
        return universe.join(counts, ["id", "grp"], "left").filter(holds).groupBy("id").count()

    def holds_empty(self, r) -> bool:
        """Whether a group's body holds where no row matches any of its constraints."""
        if isinstance(r, Logic):
            return (all if r.op == "AND" else any)(self.holds_empty(x) for x in r.items)
        return (r.low <= 0) != (isinstance(r, Attribute) and r.op == "!=")

    def condition(self, r, attributes: list[Attribute], groups: list[Group]) -> Column:
        if isinstance(r, Logic):
            parts = [self.condition(x, attributes, groups) for x in r.items]
            return reduce(Column.__and__ if r.op == "AND" else Column.__or__, parts)
        if isinstance(r, Group):
            groups.append(r)
            n = F.coalesce(F.col(f"g{len(groups) - 1}"), F.lit(0))
        else:
            attributes.append(r)
            n = F.coalesce(F.col(f"n{len(attributes) - 1}"), F.lit(0))
        test = (n >= r.low) if r.high is None else n.between(r.low, r.high)
        return ~test if isinstance(r, Attribute) and r.op == "!=" else test

    def refined(self, t: Refined) -> DataFrame:
        attributes: list[Attribute] = []
        groups: list[Group] = []
        holds = self.condition(t.refinement, attributes, groups)
        rows = self.compile(t.focus)
        if attributes:
            rows = rows.join(self.counts(attributes, ["id"]), "id", "left")
        for i, g in enumerate(groups):
            rows = rows.join(self.group_counts(g).withColumnRenamed("count", f"g{i}"), "id", "left")
        return rows.filter(holds).select("id")


def evaluate(snapshot: Snapshot, text: str) -> DataFrame:
    """The ids that a constraint selects. Raises EclError for text that is no constraint."""
    return Compiler(snapshot)(text)
