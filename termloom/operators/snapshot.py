"""The latest state of a release, and its full history, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.cuts import Cuts
from termloom.functions import constants as K
from termloom.operators import graph, versioning
from termloom.sources import rf2
from termloom.sources.schemas import MEMBERS, RECORDS


class Snapshot:
    """Tables by record type, one row for each id.

    A table may be given as a function that makes it, called when it is first asked for.
    Components keep inactive latest rows; members whose latest row is inactive are dropped, so an
    inactive newest member hides an older active one.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]]):
        self.spark, self._tables = spark, tables

    @classmethod
    def of_rows(cls, spark: SparkSession, rows: dict[str, DataFrame]) -> Snapshot:
        """Resolve versions: the greatest time wins, on a tie the row that arrived first."""
        out = {}
        for name, df in rows.items():
            df = df if "arrival" in df.columns else df.withColumn("arrival", F.monotonically_increasing_id())
            last = versioning.latest(df)
            out[name] = last.filter("active") if RECORDS[name].is_member else last
        return cls(spark, out)

    @classmethod
    def load(cls, spark: SparkSession, root: str, release_type: str = "Snapshot") -> tuple[Snapshot, rf2.LoadReport]:
        rows, report = rf2.load_release(spark, root, release_type)
        return cls.of_rows(spark, rows), report

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.createDataFrame([], RECORDS[name].schema)
        elif not isinstance(self._tables[name], DataFrame):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    @property
    def concepts(self) -> DataFrame:
        return self.table("concept")

    @property
    def descriptions(self) -> DataFrame:
        return self.table("description")

    @property
    def relationships(self) -> DataFrame:
        return self.table("relationship")

    @property
    def concretes(self) -> DataFrame:
        return self.table("concrete")

    def row(self, name: str, ident) -> DataFrame:
        """The row of one id: concept, description, relationship, concrete or any member type."""
        return self.table(name).filter(F.col("id") == ident)

    def is_active(self, concept: int) -> bool:
        return not self.row("concept", concept).filter("active").isEmpty()

    def active_concepts(self) -> DataFrame:
        return self.concepts.filter("active")

    def concept_count(self) -> int:
        return self.concepts.count()

    def descriptions_of(self, concept: int) -> DataFrame:
        return self.descriptions.filter(F.col("conceptId") == concept)

    def fsn(self) -> DataFrame:
        """(id, fsn): of several active fully specified names the one of the lowest id."""
        rows = self.descriptions.filter(F.col("active") & (F.col("typeId") == K.FSN))
        return rows.groupBy(F.col("conceptId").alias("id")).agg(F.min_by("term", "id").alias("fsn"))

    @cached_property
    def acceptability(self) -> DataFrame:
        """(refsetId, descriptionId, acceptabilityId) of active language members; of duplicates the one of the lowest member id."""
        rows = self.table("language").groupBy("refsetId", F.col("referencedComponentId").alias("descriptionId"))
        return rows.agg(F.min_by("acceptabilityId", "id").alias("acceptabilityId"))

    def preferred_terms(self, language_refset: int) -> DataFrame:
        """(id, term): the active synonym that the language refset prefers; of several the one of the lowest id."""
        wanted = self.acceptability.filter((F.col("refsetId") == language_refset) & (F.col("acceptabilityId") == K.PREFERRED)).select(F.col("descriptionId").alias("id"))
        rows = self.descriptions.filter(F.col("active") & (F.col("typeId") == K.SYNONYM)).join(wanted, "id", "left_semi")
        return rows.groupBy(F.col("conceptId").alias("id")).agg(F.min_by("term", "id").alias("term"))

    def display(self, language_refset: int | None = None) -> DataFrame:
        """(id, display): preferred term, else fully specified name."""
        names = self.fsn()
        if language_refset is None:
            return names.select("id", F.col("fsn").alias("display"))
        return names.join(self.preferred_terms(language_refset), "id", "full").select("id", F.coalesce("term", "fsn").alias("display"))

    def relationships_of(self, source: int) -> DataFrame:
        return self.relationships.filter(F.col("sourceId") == source)

    def relationships_to(self, destination: int) -> DataFrame:
        return self.relationships.filter(F.col("destinationId") == destination)

    def concretes_of(self, source: int) -> DataFrame:
        return self.concretes.filter(F.col("sourceId") == source)

    @cached_property
    def edges(self) -> DataFrame:
        """The IS-A edges, written once: walks read them in every round."""
        return Cuts(self.spark, "edges").cut(graph.is_a_edges(self.relationships))

    @cached_property
    def closure(self) -> DataFrame:
        return graph.transitive_closure(self.edges)

    def parents(self, concept: int) -> DataFrame:
        return self.edges.filter(F.col("child") == concept).select(F.col("parent").alias("id"))

    def children(self, concept: int) -> DataFrame:
        return self.edges.filter(F.col("parent") == concept).select(F.col("child").alias("id"))

    def ancestors(self, concept: int) -> DataFrame:
        return graph.ancestors(self.edges, concept)

    def descendants(self, concept: int) -> DataFrame:
        return graph.descendants(self.edges, concept)

    def subsumes(self, a: int, b: int) -> bool:
        return graph.subsumes(self.edges, a, b)

    @cached_property
    def membership(self) -> DataFrame:
        """(refsetId, referencedComponentId) of the active members of all types, each once."""
        out = None
        for r in MEMBERS:
            if r.name in self._tables:
                rows = self.table(r.name).select("refsetId", "referencedComponentId")
                out = rows if out is None else out.unionByName(rows)
        return (out if out is not None else self.table("simple").select("refsetId", "referencedComponentId")).distinct()

    def refset_members(self, refset: int) -> DataFrame:
        return self.membership.filter(F.col("refsetId") == refset).select(F.col("referencedComponentId").alias("id"))

    def is_member(self, refset: int, component: int) -> bool:
        return not self.refset_members(refset).filter(F.col("id") == component).isEmpty()

    def refset_ids(self) -> DataFrame:
        return self.membership.select(F.col("refsetId").alias("id")).distinct()

    def members(self, kind: str, refset: int | None = None, component: int | None = None) -> DataFrame:
        """Active rows of one member type, of one refset and one referenced component if given."""
        rows = self.table(kind)
        if refset is not None:
            rows = rows.filter(F.col("refsetId") == refset)
        return rows if component is None else rows.filter(F.col("referencedComponentId") == component)

    def owl_expressions(self) -> DataFrame:
        return self.table("owl_expression")

    def validate(self) -> dict[str, DataFrame]:
        """Ids by fault; inactive rows count too. Concrete values are not checked."""
        known = Cuts(self.spark, "known").cut(self.concepts.select("id"))
        miss = lambda rows, col: rows.join(known.withColumnRenamed("id", col), col, "left_anti").select("id")
        return {
            "dangling_descriptions": miss(self.descriptions, "conceptId"),
            "dangling_sources": miss(self.relationships, "sourceId"),
            "dangling_destinations": miss(self.relationships, "destinationId"),
            "cyclic_concepts": graph.cyclic(self.edges, known),
        }

    def issues(self) -> DataFrame:
        """(fault, n): the number of findings of each kind, 0 among them."""
        counts = [df.agg(F.lit(name).alias("fault"), F.count(F.lit(1)).alias("n")) for name, df in self.validate().items()]
        return reduce(DataFrame.unionByName, counts)

    def issue_count(self) -> int:
        return self.issues().agg(F.sum("n")).first()[0]

    def is_clean(self) -> bool:
        return all(df.isEmpty() for df in self.validate().values())


class History:
    """All versions of concepts, descriptions and relationships, from Full files."""

    KINDS = ("concept", "description", "relationship")

    def __init__(self, rows: dict[str, DataFrame]):
        self.rows = rows

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> tuple[History, rf2.LoadReport]:
        rows, report = rf2.load_release(spark, root, "Full")
        for name in set(report.loaded) - set(cls.KINDS):
            report.skipped += [(p, "history holds concepts, descriptions and relationships only") for p in report.loaded.pop(name)]
        return cls({k: v for k, v in rows.items() if k in cls.KINDS}), report

    def versions(self, kind: str, ident: int) -> DataFrame:
        return versioning.history(self.rows[kind], ident)

    def at(self, kind: str, ident: int, time: int) -> DataFrame:
        return versioning.as_of(self.rows[kind].filter(F.col("id") == ident), time)

    def snapshot_at(self, spark: SparkSession, time: int) -> Snapshot:
        return Snapshot(spark, {k: versioning.as_of(v, time) for k, v in self.rows.items()})
