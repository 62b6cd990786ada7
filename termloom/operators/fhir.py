"""Terminology operations: subsumes, lookup, expand, in bulk and for single codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import constants as K
from termloom.functions.ids import IdError, parse_id
from termloom.operators import graph
from termloom.operators.nnf import NormalForms
from termloom.operators.snapshot import Snapshot

# fixed values: the code system's address and name
SYSTEM = "http://snomed.info/sct"
SYSTEM_NAME = "SNOMED CT"


class FhirError(ValueError):
    """kind: UnsupportedSystem, UnknownCode, UnsupportedProperty, MissingClassification, UnsupportedValueSet or InvalidEcl."""

    def __init__(self, kind: str, value):
        super().__init__(f"{kind}: {value}")
        self.kind, self.value = kind, value


def check(snapshot: Snapshot, system: str, *codes: int) -> None:
    if system != SYSTEM:
        raise FhirError("UnsupportedSystem", system)
    known = {r["id"] for r in snapshot.concepts.filter(F.col("id").isin(list(codes))).select("id").collect()}
    for code in codes:
        if code not in known:
            raise FhirError("UnknownCode", code)


def subsumes(snapshot: Snapshot, system: str, a: int, b: int) -> str:
    check(snapshot, system, a, b)
    if a == b:
        return "equivalent"
    if snapshot.subsumes(a, b):
        return "subsumes"
    return "subsumed-by" if snapshot.subsumes(b, a) else "not-subsumed"


def designations(snapshot: Snapshot, language_refset: int | None = None) -> DataFrame:
    """(id, language, value, use) of active descriptions other than text definitions."""
    rows = snapshot.descriptions.filter(F.col("active") & (F.col("typeId") != K.TEXT_DEFINITION)).select(F.col("conceptId").alias("id"), F.col("languageCode").alias("language"), F.col("term").alias("value"), F.col("id").alias("descriptionId"))
    if language_refset is None:
        return rows.select("id", "language", "value", F.lit("Unspecified").alias("use"))
    use = F.when(F.col("acceptabilityId") == K.PREFERRED, "Preferred").when(F.col("acceptabilityId") == K.ACCEPTABLE, "Acceptable").otherwise("Unspecified")
    own = snapshot.acceptability.filter(F.col("refsetId") == language_refset)
    return rows.join(own, "descriptionId", "left").select("id", "language", "value", use.alias("use"))


DEFAULT = ("inactive", "moduleId", "sufficientlyDefined")
FORMS = ("normalForm", "normalFormTerse")


def lookup(snapshot: Snapshot, codes: DataFrame | None = None, language_refset: int | None = None, properties: tuple[str, ...] = (), forms: NormalForms | None = None) -> DataFrame:
    """One row for each known code (column `id`; None: all concepts): display, definition, designations, and a column for each property."""
    wanted = properties or DEFAULT
    for p in wanted:
        if p not in (*DEFAULT, *FORMS):
            raise FhirError("UnsupportedProperty", p)
        if p in FORMS and forms is None:
            raise FhirError("MissingClassification", p)
    rows = snapshot.concepts if codes is None else snapshot.concepts.join(codes.select("id").distinct(), "id", "left_semi")
    texts = snapshot.descriptions.filter(F.col("active") & (F.col("typeId") == K.TEXT_DEFINITION)).groupBy(F.col("conceptId").alias("id")).agg(F.min_by("term", "id").alias("definition"))
    named = designations(snapshot, language_refset).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("language", "value", "use"))).alias("designation"))
    out = rows.join(snapshot.display(language_refset), "id", "left").join(texts, "id", "left").join(named, "id", "left")
    made = {"inactive": ~F.col("active"), "moduleId": F.col("moduleId"), "sufficientlyDefined": F.col("definitionStatusId") == K.DEFINED}
    for p in wanted:
        if p in FORMS:
            out = out.join(render(snapshot, forms, language_refset, p == "normalFormTerse").withColumnRenamed("form", p), "id", "left")
            made[p] = F.coalesce(p, F.lit(""))
    return out.select("id", "display", "definition", F.coalesce("designation", F.array().cast("array<struct<language:string,value:string,use:string>>")).alias("designation"), *[made[p].alias(p) for p in wanted])


def lookup_one(snapshot: Snapshot, system: str, code: int, version: str | None = None, **options) -> dict:
    check(snapshot, system, code)
    row = lookup(snapshot, snapshot.spark.createDataFrame([(code,)], "id long"), **options).first()
    return {"name": SYSTEM_NAME, "version": version, **row.asDict(recursive=True)}


def render(snapshot: Snapshot, forms: NormalForms, language_refset: int | None = None, terse: bool = False) -> DataFrame:
    """(id, form): focus concepts joined by +, then values outside groups and groups in braces; terse has no terms and no blanks."""
    names = snapshot.display(language_refset)

    def named(df: DataFrame, col: str) -> DataFrame:
        ref = F.col(col).cast("string")
        if terse:
            return df.withColumn(f"{col}_ref", ref)
        own = names.select(F.col("id").alias(col), F.col("display").alias(f"{col}_name"))
        return df.join(own, col, "left").withColumn(f"{col}_ref", F.when(F.col(f"{col}_name").isNull(), ref).otherwise(F.concat(ref, F.lit(" |"), F.col(f"{col}_name"), F.lit("|"))))

    plus, comma, equals, colon, opened, closed = ("+", ",", "=", ":", "{", "}") if terse else (" + ", ", ", " = ", " : ", "{ ", " }")
    text = lambda items, sep: F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["s"]), sep)
    focus = named(forms.is_a, "parent").groupBy(F.col("concept").alias("id")).agg(text(F.struct("parent", F.col("parent_ref").alias("s")), plus).alias("focus"))
    values = named(named(forms.attributes, "type_id"), "destination_id").withColumn("s", F.concat("type_id_ref", F.lit(equals), "destination_id_ref"))
    groups = values.groupBy("concept", "grp").agg(text(F.struct("type_id", "destination_id", "s"), comma).alias("s"))
    groups = groups.withColumn("s", F.when(F.col("grp") == 0, F.col("s")).otherwise(F.concat(F.lit(opened), "s", F.lit(closed))))
    refined = groups.groupBy(F.col("concept").alias("id")).agg(text(F.struct("grp", "s"), comma).alias("refined"))
    return focus.join(refined, "id", "full").select("id", F.concat(F.coalesce("focus", F.lit("")), F.when(F.col("refined").isNull(), "").otherwise(F.concat(F.lit(colon), "refined"))).alias("form"))


def parse_value_set(url: str) -> tuple[str, object]:
    """('all' | 'isa' | 'refset' | 'refsets' | 'ecl', argument) of an implicit value set's address; nothing is percent-decoded."""
    base, mark, query = url.partition("?")
    if mark and base != SYSTEM:
        raise FhirError("UnsupportedSystem", base)
    if mark and query == "fhir_vs":
        return "all", None
    if mark and query == "fhir_vs=refset":
        return "refsets", None
    for kind in ("isa", "refset", "ecl"):
        head = f"fhir_vs={kind}/"
        if mark and query.startswith(head):
            value = query[len(head) :]
            if kind == "ecl":
                return kind, value
            try:
                return kind, parse_id(value)
            except IdError:
                break
    raise FhirError("UnsupportedValueSet", url)


def value_set(snapshot: Snapshot, url: str) -> DataFrame:
    """The ids of an implicit value set."""
    from termloom.plans.compiler import Compiler
    from termloom.plans.ecl import EclError, Simple

    kind, value = parse_value_set(url)
    if kind == "all":
        return snapshot.concepts.select("id")
    if kind == "refsets":
        return snapshot.refset_ids()
    if kind == "refset":
        return snapshot.refset_members(value)
    compiler = Compiler(snapshot)
    if kind == "isa":
        return compiler.compile(Simple("<<", value))
    try:
        return compiler(value)
    except EclError as e:
        raise FhirError("InvalidEcl", e) from None


@dataclass
class Expansion:
    total: int
    offset: int
    contains: DataFrame  # id, display, and designation if asked for; in order of the ids


def expansion(snapshot: Snapshot, ids: DataFrame, active_only: bool = False, text: str | None = None) -> DataFrame:
    """The ids that are left: active ones, with an active description of any type that contains the text, letter case aside."""
    if active_only:
        ids = ids.join(snapshot.active_concepts().select("id"), "id", "left_semi")
    if text is not None:
        hits = snapshot.descriptions.filter(F.col("active") & F.lower("term").contains(text.lower())).select(F.col("conceptId").alias("id"))
        ids = ids.join(hits, "id", "left_semi")
    return ids


def expand(snapshot: Snapshot, url: str, active_only: bool = False, text: str | None = None, offset: int = 0, count: int | None = None, language_refset: int | None = None, include_designations: bool = False) -> Expansion:
    """A page of a value set in order of the ids; the offset is held to the total."""
    ids = expansion(snapshot, value_set(snapshot, url), active_only, text)
    total = ids.count()
    offset = min(offset, total)
    page = ids.orderBy("id").offset(offset)
    page = page if count is None else page.limit(count)
    out = page.join(snapshot.display(language_refset), "id", "left")
    if include_designations:
        own = designations(snapshot, language_refset).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("language", "value", "use"))).alias("designation"))
        out = out.join(own, "id", "left").withColumn("designation", F.coalesce("designation", F.array().cast("array<struct<language:string,value:string,use:string>>")))
    return Expansion(total, offset, out.orderBy("id"))


def bulk_subsumes(snapshot: Snapshot, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of known codes with their outcome."""
    return graph.bulk_subsumes(snapshot.closure, pairs)
