"""Registered queries over release files, point lookups, rendered forms and the completion rules, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.cuts import checkpoint_root, remove
from termloom.functions import constants as K
from termloom.functions import ids as I
from termloom.functions import values as V
from termloom.operators import el, fhir, graph, nnf, owl
from termloom.operators.snapshot import History, Snapshot
from termloom.plans import starmap as M
from termloom.plans.compiler import Compiler
from termloom.plans.ecl import EclError
from termloom.plans.slate import FOLD, MEMBERS, VERHOEFF, as_items, filled, query, stated, taxonomy
from termloom.sources import rf2
from termloom.sources.schemas import MEMBERS as MEMBER_TYPES
from termloom.sources.schemas import RECORDS, Record


class Folder:
    """A folder of release files in the shared folder, removed once the result that needs it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{checkpoint_root(spark)}/release-{uuid.uuid4().hex}"
        self.root = f"{self.base}/files"

    def settle(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.base}/out")
        remove(self.spark, self.root)
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/out")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def check_digits(body: str) -> str:
    """SQL: the id that a text of digits makes with its check digit, as text."""
    return f"({body} || inv.t[CAST({FOLD.format(s=body, first=1)} + 1 AS BIGINT)])"


# ---- release files: customers as rows of every record type

OWNERS = f"WITH {VERHOEFF}, b AS (SELECT c_custkey AS k, c_name AS name, CAST({M.CUSTOMER} + c_custkey AS VARCHAR) || '00' AS body FROM customer), c AS (SELECT k, name, {check_digits('body')} AS sid FROM b, d, p, inv)"


def key() -> Column:
    return F.col("c_custkey")


def uuid_of(h: Column) -> Column:
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in UUID_PARTS])


UUID_PARTS = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
SETS = [str(M.code(9500 + j)) for j in range(3)]


def raw_field(record: Record, i: int) -> Column:
    """The text of a field in a customer's row."""
    name, kind = record.fields[i]
    if name in ("id", "referencedComponentId") and kind == "S":
        return M.concept(key() + M.CUSTOMER).cast("string")
    if name == "refsetId":
        return F.get(F.array(*[F.lit(x) for x in SETS]), (key() % 3).cast("int"))
    if kind == "V":
        return F.when(key() % 2 == 0, F.concat(F.lit("#"), key().cast("string"))).otherwise(F.concat(F.lit('"'), "c_name", F.lit('"')))
    return {
        "S": lambda: F.lit(str(M.code(9000 + i))),
        "T": lambda: (key() % 28 + 20240101 + i % 3).cast("string"),
        "B": lambda: (1 - key() % 2).cast("string"),
        "U": lambda: F.concat(F.lit("+"), (key() % 1000 + i).cast("string")),
        "X": lambda: F.concat("c_name", F.lit(f' "{name}" ')),
        "x": lambda: F.when(key() % 3 == 0, "").otherwise(F.col("c_name")),
        "I": lambda: F.upper(uuid_of(F.md5(F.concat(F.lit(f"{record.name} {name} "), key().cast("string"))))),
    }[kind]()


def json_field(record: Record, i: int) -> str:
    """SQL of the field's part of the JSON object."""
    name, kind = record.fields[i]
    h = f"md5('{record.name} {name} ' || k)"
    if kind == "V":
        return """'"valueType":"' || CASE WHEN k % 2 = 0 THEN 'number","value":"' || k ELSE 'string","value":"' || name END || '"'"""
    if name in ("id", "referencedComponentId") and kind == "S":
        made = "sid"
    elif name == "refsetId":
        made = f"{SETS}[k % 3 + 1]"
    else:
        made = {
            "S": f"'{M.code(9000 + i)}'", "T": f"(k % 28 + {20240101 + i % 3})", "B": "CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END", "U": f"(k % 1000 + {i})",
            "X": f"name || ' \\\"{name}\\\" '", "x": "CASE WHEN k % 3 = 0 THEN '' ELSE name END", "I": " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in UUID_PARTS),
        }[kind]
    return f"'\"{name}\":' || {made}" if kind in "BU" else f"'\"{name}\":\"' || {made} || '\"'"


def release_rows(spark: SparkSession, sf_dir: str, record: Record) -> DataFrame:
    return M.read(spark, sf_dir, "customer").select(*[raw_field(record, i).alias(n) for i, n in enumerate(record.header)])


def write_all(spark: SparkSession, sf_dir: str, root: str) -> None:
    """A release with a file group of each of the 22 record types."""
    for record in RECORDS.values():
        rf2.write_records(release_rows(spark, sf_dir, record), record, root)


def json_sql(record: Record) -> str:
    return f"SELECT '{record.name}' AS record, '{{' || " + " || ',' || ".join(json_field(record, i) for i in range(len(record.fields))) + " || '}' AS value FROM c"


@query(f"{OWNERS} " + " UNION ALL ".join(json_sql(r) for r in RECORDS.values()), projected=False)
def release_json(spark, sf_dir):
    """Files of all 22 record types, written, found, typed and given back as JSON."""
    folder = Folder(spark)
    write_all(spark, sf_dir, folder.root)
    rows, _ = rf2.load_release(spark, folder.root)
    return folder.settle(union([rf2.to_json(rows[name], RECORDS[name]).select(F.lit(name).alias("record"), "value") for name in rows]))


@query("SELECT unnest([" + ", ".join(f"'{r}'" for r in RECORDS) + "]) AS name, 'loaded' AS outcome, (SELECT count(*) FROM customer)::BIGINT AS n UNION ALL VALUES ('notes.txt', 'unrecognized file name: Structure', 0), ('sct2_Concept_Full_INT_20241301.txt', 'unrecognized file name: VersionDate(20241301)', 0), ('der2_zzRefset_OddSnapshot_INT_20240101.txt', 'no record type for zzRefset Odd', 0)", projected=False)
def release_report(spark, sf_dir):
    """What a load reads, by record type, and what it passes over; rows of another release type and files of other kinds are not told."""
    folder = Folder(spark)
    write_all(spark, sf_dir, folder.root)
    rf2.write_records(release_rows(spark, sf_dir, RECORDS["concept"]), RECORDS["concept"], folder.root, "Delta")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder.root).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("notes.txt", "sub/sct2_Concept_Full_INT_20241301.txt", "sub/der2_zzRefset_OddSnapshot_INT_20240101.txt", "image.png"):
        system.create(path(f"{folder.root}/{name}")).close()
    rows, report = rf2.load_release(spark, folder.root)
    counts = [df.agg(F.lit(name).alias("name"), F.lit("loaded").alias("outcome"), F.count(F.lit(1)).alias("n")) for name, df in rows.items()]
    skipped = spark.createDataFrame([(p.rsplit("/", 1)[1], why, 0) for p, why in report.skipped], "name string, outcome string, n long")
    return folder.settle(union([*counts, skipped]))


KINDS = ", ".join(f"'{r.name}'" for r in MEMBER_TYPES)


@query(f"SELECT unnest([{KINDS}]) AS kind, 'refset' AS by, count(*)::BIGINT AS n, min({M.CUSTOMER} + c_custkey) AS low, max({M.CUSTOMER} + c_custkey) AS high FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT unnest([{KINDS}]), 'component', 1, {M.CUSTOMER} + 12, {M.CUSTOMER} + 12", projected=False)
def members_typed(spark, sf_dir):
    """Active members of each of the 18 member types, of one refset and of one component, from a loaded release."""
    folder = Folder(spark)
    write_all(spark, sf_dir, folder.root)
    s, _ = Snapshot.load(spark, folder.root)
    item = I.item_identifier(F.col("referencedComponentId"))
    frames = []
    for r in MEMBER_TYPES:
        for by, rows in (("refset", s.members(r.name, refset=M.code(9500))), ("component", s.members(r.name, component=M.code(M.CUSTOMER + 12)))):
            frames.append(rows.agg(F.lit(r.name).alias("kind"), F.lit(by).alias("by"), F.count(F.lit(1)).alias("n"), F.min(item).alias("low"), F.max(item).alias("high")))
    return folder.settle(union(frames))


@query("SELECT c_custkey AS item, c_name || ' \"owlExpression\" ' AS expression FROM customer WHERE c_custkey % 2 = 0", projected=False)
def owl_expressions(spark, sf_dir):
    """The expressions that a loaded release's active OWL members hold."""
    folder = Folder(spark)
    rf2.write_records(release_rows(spark, sf_dir, RECORDS["owl_expression"]), RECORDS["owl_expression"], folder.root)
    s, _ = Snapshot.load(spark, folder.root)
    return folder.settle(s.owl_expressions().select((I.item_identifier(F.col("referencedComponentId")) - M.CUSTOMER).alias("item"), F.col("owlExpression").alias("expression")))


#: Two versions of each customer, in files that sort as A and B; some tie in time. Of members, B holds inactive versions of every fifth.
VERSIONED = f"v AS (SELECT {M.CUSTOMER} + c_custkey AS item, 20240101 + c_custkey % 3 AS t, true AS active, true AS defined, 0 AS arrival FROM customer UNION ALL SELECT {M.CUSTOMER} + c_custkey, 20240101 + 2 * (c_custkey % 2), c_custkey % 4 <> 0, false, 1 FROM customer)"


def write_versions(spark: SparkSession, sf_dir: str, root: str, release_type: str) -> None:
    customers, ident = M.read(spark, sf_dir, "customer"), M.concept(key() + M.CUSTOMER).cast("string")
    module = F.lit(str(M.code(9001)))
    for tag, time, active, status in (("A", key() % 3 + 20240101, F.lit("1"), K.DEFINED), ("B", key() % 2 * 2 + 20240101, F.when(key() % 4 != 0, "1").otherwise("0"), K.PRIMITIVE)):
        cols = [ident, time.cast("string"), active, module, F.lit(str(status))]
        rf2.write_records(customers.select(*[c.alias(n) for c, n in zip(cols, RECORDS["concept"].header, strict=True)]), RECORDS["concept"], root, release_type, tag)
    member = uuid_of(F.md5(key().cast("string")))
    for tag, rows, active in (("A", customers, "1"), ("B", customers.filter(key() % 5 == 0), "0")):
        cols = [member, F.lit("20240101" if tag == "A" else "20240102"), F.lit(active), module, F.lit(str(M.code(9500))), ident]
        rf2.write_records(rows.select(*[c.alias(n) for c, n in zip(cols, RECORDS["simple"].header, strict=True)]), RECORDS["simple"], root, release_type, tag)


@query(f"WITH {VERSIONED} SELECT 'concept' AS kind, item, t::INTEGER AS time, active, defined FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY t DESC, arrival) AS r FROM v) WHERE r = 1 UNION ALL SELECT 'simple', {M.CUSTOMER} + c_custkey, 20240101, true, NULL FROM customer WHERE c_custkey % 5 <> 0", projected=False)
def release_latest(spark, sf_dir):
    """The latest state of a release of several files: the greatest time, of ties the first file; a member's inactive newest version hides it."""
    folder = Folder(spark)
    write_versions(spark, sf_dir, folder.root, "Snapshot")
    s, _ = Snapshot.load(spark, folder.root)
    row = lambda kind, df, ident, defined: df.select(F.lit(kind).alias("kind"), I.item_identifier(F.col(ident)).alias("item"), F.col("effectiveTime").alias("time"), "active", defined.alias("defined"))
    return folder.settle(row("concept", s.concepts, "id", V.is_sufficiently_defined(F.col("definitionStatusId"))).unionByName(row("simple", s.table("simple"), "referencedComponentId", F.lit(None).cast("boolean"))))


@query(f"WITH {VERSIONED} SELECT 'at' AS what, item, t::INTEGER AS time, active, defined FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY t DESC, arrival DESC) AS r FROM v WHERE t <= 20240102) WHERE r = 1 UNION ALL SELECT 'versions', item, t, active, defined FROM v WHERE item = {M.CUSTOMER} + 5 UNION ALL SELECT 'one', item, t, active, defined FROM v WHERE item = {M.CUSTOMER} + 5 AND arrival = 1", projected=False)
def release_history(spark, sf_dir):
    """Full files: the state of all concepts at a time, the versions of one, and its state at a time."""
    folder = Folder(spark)
    write_versions(spark, sf_dir, folder.root, "Full")
    h, report = History.load(spark, folder.root)
    if not report.skipped:
        raise ValueError("members are not history")
    row = lambda what, df: df.select(F.lit(what).alias("what"), I.item_identifier(F.col("id")).alias("item"), F.col("effectiveTime").alias("time"), "active", V.is_sufficiently_defined(F.col("definitionStatusId")).alias("defined"))
    one = M.code(M.CUSTOMER + 5)
    return folder.settle(union([row("at", h.snapshot_at(spark, 20240102).concepts), row("versions", h.versions("concept", one)), row("one", h.at("concept", one, 20240103))]))


#: Names and what becomes of them: type, summary, release type, language, country and date, or the fault.
FILE_NAMES = {
    "sct2_Concept_Snapshot_INT_20240101.txt": ("Concept", "", "Snapshot", None, "INT", 20240101, None),
    "sct2_Description_Full-en_GB1000000_20231231.txt": ("Description", "", "Full", "en", "GB1000000", 20231231, None),
    "der2_cRefset_LanguageDelta-es-419_INT_20240101.txt": ("cRefset", "Language", "Delta", "es-419", "INT", 20240101, None),
    "der2_iisssccRefset_ExtendedMapSnapshot_INT_20240101.txt": ("iisssccRefset", "ExtendedMap", "Snapshot", None, "INT", 20240101, None),
    "sct2_Concept_Snapshot_INT_20240101.csv": (None,) * 6 + ("Extension",),
    "sct2_Concept_Snapshot_INT.txt": (None,) * 6 + ("Structure",),
    "xsct2_Concept_Snapshot_INT_20240101.txt": (None,) * 6 + ("FileType",),
    "sct2_Concept_Snap_INT_20240101.txt": (None,) * 6 + ("ReleaseType",),
    "sct2_Concept_Snapshot_INT_20240132.txt": (None,) * 6 + ("VersionDate",),
}
NAMES = ("name", "content", "summary", "release_type", "language", "country", "version", "fault")


def literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], names: tuple[str, ...]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({', '.join(names)})"


@query(values([(n, *v) for n, v in FILE_NAMES.items()], NAMES), projected=False)
def release_names(spark, sf_dir):
    rows = []
    for name in FILE_NAMES:
        try:
            p = rf2.parse_file_name(name)
            rows.append((name, p.content_type, p.summary, p.release_type, p.language_code, p.country_namespace, p.version_date, None))
        except rf2.FileNameError as e:
            rows.append((name, None, None, None, None, None, None, e.kind))
    return spark.createDataFrame(rows, "name string, content string, summary string, release_type string, language string, country string, version int, fault string")


# ---- point lookups


@query(
    f""", {MEMBERS} SELECT 'row' AS what, 30000007::BIGINT AS value UNION ALL SELECT 'active', count(*) FROM orders WHERE o_orderkey = 1 AND o_orderstatus <> 'F'
 UNION ALL SELECT 'description', 300000070 + n FROM (VALUES (0), (1), (2)) t(n) UNION ALL SELECT 'target', {M.PART} + l_partkey FROM lineitem WHERE l_orderkey = 1 UNION ALL SELECT 'target', {M.SUPPLIER} + l_suppkey FROM lineitem WHERE l_orderkey = 1
 UNION ALL SELECT 'target', {M.CUSTOMER} + o_custkey FROM orders WHERE o_orderkey = 1 UNION ALL SELECT 'target', 6000 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) FROM orders WHERE o_orderkey = 1
 UNION ALL SELECT 'concrete', l_linenumber FROM lineitem, (VALUES (0), (1)) t(n) WHERE l_orderkey = 1 UNION ALL SELECT 'ancestor', count(*) FROM clo WHERE d = 30000007 AND a = 1002 UNION ALL SELECT 'ancestor of itself', 0
 UNION ALL SELECT 'subsumes itself', 1 UNION ALL SELECT 'member', count(*) FROM mem WHERE refset = {M.QUALITY} AND component = {M.TEXT} + 3 UNION ALL SELECT 'member', count(*) FROM mem WHERE refset = 8011 AND component = {M.CUSTOMER} + 2
 UNION ALL SELECT 'concepts', count(*) FROM concept"""
)
def point_lookups(spark, sf_dir):
    """Row, activity, descriptions, relationships, concrete values, ancestry and membership of single components."""
    s, part, order = M.snapshot(spark, sf_dir), M.code(30000007), M.code(M.ORDER + 1)
    tell = lambda what, df, col: df.select(F.lit(what).alias("what"), col.cast("long").alias("value"))
    one = [
        ("active", s.is_active(order)), ("ancestor", graph.is_ancestor_of(s.edges, M.code(1002), part)), ("ancestor of itself", graph.is_ancestor_of(s.edges, part, part)), ("subsumes itself", s.subsumes(part, part)),
        ("member", s.is_member(M.code(M.QUALITY), I.compose_id(M.TEXT + 3, "Description"))), ("member", s.is_member(M.code(8011), M.code(M.CUSTOMER + 2))), ("concepts", s.concept_count()),
    ]
    return union([
        tell("row", s.row("concept", part), I.item_identifier(F.col("id"))), tell("description", s.descriptions_of(part), I.item_identifier(F.col("id"))),
        tell("target", s.relationships_of(order), I.item_identifier(F.col("destinationId"))), tell("concrete", s.concretes_of(order), F.col("relationshipGroup")),
        spark.createDataFrame([(w, int(v)) for w, v in one], "what string, value long"),
    ])


@query(
    """SELECT 'fsn' AS what, (SELECT count(*) FROM part) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT 'synonym', 2 * (SELECT count(*) FROM part) UNION ALL SELECT 'is_a', count(*) FROM isa
 UNION ALL SELECT 'inferred', (SELECT count(*) FROM isa) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') UNION ALL SELECT 'preferred', count(*) FROM part UNION ALL SELECT 'acceptable', count(*) FROM part"""
)
def component_predicates(spark, sf_dir):
    s = M.snapshot(spark, sf_dir)
    tell = lambda what, df, test: df.agg(F.lit(what).alias("what"), F.count_if(test).alias("n"))
    d, r, m = s.descriptions, s.relationships, s.table("language")
    return union([tell("fsn", d, V.is_fsn(F.col("typeId"))), tell("synonym", d, V.is_synonym(F.col("typeId"))), tell("is_a", r, V.is_is_a(F.col("typeId"))), tell("inferred", r, V.is_inferred(F.col("characteristicTypeId"))), tell("preferred", m, V.is_preferred(F.col("acceptabilityId"))), tell("acceptable", m, ~V.is_preferred(F.col("acceptabilityId")))])


# ---- terminology operations


@query(
    f""", {MEMBERS} SELECT 'all' AS form, item FROM concept UNION ALL SELECT DISTINCT 'refsets', refset FROM mem UNION ALL SELECT 'refset', component FROM mem WHERE refset = 8011
 UNION ALL SELECT 'isa', d FROM clo WHERE a = 2001 UNION ALL SELECT 'isa', 2001 UNION ALL SELECT 'ecl', child FROM isa WHERE parent = 1002"""
)
def value_sets(spark, sf_dir):
    """The implicit value sets of every form of address."""
    s = M.snapshot(spark, sf_dir)
    forms = {"all": "fhir_vs", "refsets": "fhir_vs=refset", "refset": f"fhir_vs=refset/{M.code(8011)}", "isa": f"fhir_vs=isa/{M.code(2001)}", "ecl": f"fhir_vs=ecl/<! {M.code(1002)}"}
    return union([as_items(fhir.value_set(s, f"{fhir.SYSTEM}?{q}")).withColumn("form", F.lit(form)) for form, q in forms.items()])


@query(f"SELECT {M.TEXT} + doc_id AS item, text AS definition, 0::BIGINT AS designations FROM documents", projected=False)
def lookup_definitions(spark, sf_dir):
    """Text definitions, of documents taken as concepts; they are no designations."""
    s, docs = M.snapshot(spark, sf_dir), M.read(spark, sf_dir, "documents").select(M.concept(F.col("doc_id") + M.TEXT).alias("id"))
    of_docs = docs.select("id", F.lit(20240101).alias("effectiveTime"), F.lit(True).alias("active"), F.lit(M.code(M.ROOT)).alias("moduleId"), F.lit(K.PRIMITIVE).alias("definitionStatusId"))
    s._tables["concept"] = s.concepts.unionByName(of_docs)
    return fhir.lookup(s, docs).select(I.item_identifier(F.col("id")).alias("item"), "definition", F.size("designation").cast("long").alias("designations"))


def form(name: str, plus: str, comma: str, equals: str, colon: str, opened: str, closed: str, ref: str) -> str:
    """SQL tables that render the normal forms."""
    return f"""{name}_focus(c, s) AS (SELECT concept, string_agg({ref}, '{plus}' ORDER BY parent) FROM prox JOIN refs r ON parent = item GROUP BY concept),
{name}_group(c, grp, s) AS (SELECT concept, grp, CASE WHEN grp = 0 THEN '' ELSE '{opened}' END || string_agg(t.sid || '{equals}' || {ref}, '{comma}' ORDER BY type_id, destination_id) || CASE WHEN grp = 0 THEN '' ELSE '{closed}' END
 FROM attr JOIN refs t ON t.item = type_id JOIN refs r ON r.item = destination_id GROUP BY concept, grp),
{name}_refined(c, s) AS (SELECT c, string_agg(s, '{comma}' ORDER BY grp) FROM {name}_group GROUP BY c),
{name}(c, form) AS (SELECT f.c, f.s || coalesce('{colon}' || r.s, '') FROM {name}_focus f LEFT JOIN {name}_refined r ON f.c = r.c)"""


@query(
    f""", {VERHOEFF}, {taxonomy()}, attr AS ({stated()}),
 names(item, name) AS (SELECT {M.PART} + p_partkey, p_name || ' (part)' FROM part UNION ALL SELECT 3000 + n_nationkey, n_name || ' (nation)' FROM nation UNION ALL SELECT 2000 + r_regionkey, r_name || ' (region)' FROM region),
 bodies AS (SELECT item, CAST(item AS VARCHAR) || '00' AS body FROM concept WHERE item < {M.CUSTOMER}), refs AS (SELECT item, {check_digits('body')} AS sid, name FROM bodies LEFT JOIN names USING (item), d, p, inv),
 {form("terse", "+", ",", "=", ":", "{", "}", "r.sid")}, {form("long", " + ", ", ", " = ", " : ", "{ ", " }", "r.sid || coalesce(' |' || r.name || '|', '')")}
 SELECT item, coalesce(long.form, '') AS "normalForm", coalesce(terse.form, '') AS "normalFormTerse" FROM concept LEFT JOIN long ON long.c = item LEFT JOIN terse ON terse.c = item"""
)
def lookup_normal_forms(spark, sf_dir):
    """The normal form of every concept as text, with terms and terse."""
    forms = nnf.normal_forms(M.axioms(spark, sf_dir))
    return fhir.lookup(M.snapshot(spark, sf_dir), properties=("normalForm", "normalFormTerse"), forms=forms).select(I.item_identifier(F.col("id")).alias("item"), "normalForm", "normalFormTerse")


# ---- faults that texts and calls are refused with

FAULTS = [
    ("ecl", "< {1003} ;", "UnexpectedChar", 9), ("ecl", "< {1003} AND", "UnexpectedToken", None), ("ecl", "{1003} AND {1002} OR {1001}", "MixedOperators", None), ("ecl", "{1003} MINUS {1002} MINUS {1001}", "ExclusionTakesTwoOperands", None),
    ("ecl", "< 1003", "InvalidSctId", 2), ("ecl", "< {1003} |open", "UnterminatedTerm", 9), ("ecl", "< {1003} /* open", "UnterminatedComment", 9), ("ecl", '< {1003} : {7006} = "A', "UnterminatedString", 20), ("ecl", '* {{ C effectiveTime = "20241301" }}', "InvalidEffectiveTime", None),
    ("owl", "SubClassOf(:{1003} :{1002}", "UnexpectedEof", None), ("owl", "SubClassOf(:{1003} :{1002}) x", "TrailingInput", None), ("owl", "SubClassOf(:12 :{1002})", "InvalidSctId", 11), ("owl", "Other(:{1003})", "UnknownKeyword", 0), ("owl", "SubClassOf(:{1003} ;)", "UnexpectedChar", None),
    ("owl", 'SubClassOf(:{1003} DataHasValue(:{7004} "1', "UnterminatedString", None), ("owl", "SubClassOf :{1003}", "UnexpectedToken", None),
    ("fhir", "other?fhir_vs", "UnsupportedSystem", None), ("fhir", "http://snomed.info/sct?fhir_vs=other", "UnsupportedValueSet", None), ("fhir", "http://snomed.info/sct?fhir_vs=ecl/<", "InvalidEcl", None),
]


@query(values([(a, t, k, p) for a, t, k, p in FAULTS], ("area", "text", "fault", "pos")).replace("SELECT *", "SELECT area, text, fault, CAST(pos AS INTEGER) AS pos"), projected=False)
def refused(spark, sf_dir):
    """The fault of each text; the place where it was asked for."""
    s, rows = M.snapshot(spark, sf_dir), []
    for area, text, _, pos in FAULTS:
        made = filled(text)
        try:
            {"ecl": Compiler(s), "owl": owl.parse, "fhir": lambda u: fhir.value_set(s, u)}[area](made)
            rows.append((area, text, None, None))
        except (EclError, owl.OwlError, fhir.FhirError) as e:
            # ids are longer than the item numbers that stand for them here
            at = getattr(e, "pos", None)
            rows.append((area, text, e.kind, None if pos is None else len(text) - len(made) + at if "{" in text[: pos + 1] else at))
    return spark.createDataFrame(rows, "area string, text string, fault string, pos int")


@query(
    f"""SELECT 'equivalent' AS outcome, 'subsumes 1' AS what UNION ALL SELECT 'subsumes', 'subsumes 2' UNION ALL SELECT 'subsumed-by', 'subsumes 3' UNION ALL SELECT 'not-subsumed', 'subsumes 4' UNION ALL SELECT 'UnknownCode', 'subsumes 5' UNION ALL SELECT 'UnsupportedSystem', 'subsumes 6'
 UNION ALL SELECT p_name || ' (part)', 'display' FROM part WHERE p_partkey = 7 UNION ALL SELECT 'UnknownCode', 'lookup' UNION ALL SELECT 'UnsupportedProperty', 'property' UNION ALL SELECT 'MissingClassification', 'normal form'""",
    projected=False,
)
def single_operations(spark, sf_dir):
    """subsumes and lookup of single codes, with their refusals."""
    s, rows = M.snapshot(spark, sf_dir), []
    a, b, c, part, none = M.code(1001), M.code(2001), M.code(2002), M.code(30000007), M.code(9999)
    calls = [(f"subsumes {i}", lambda x=x: fhir.subsumes(s, *x)) for i, x in enumerate([(fhir.SYSTEM, a, a), (fhir.SYSTEM, a, b), (fhir.SYSTEM, b, a), (fhir.SYSTEM, b, c), (fhir.SYSTEM, a, none), ("other", a, b)], 1)]
    calls += [("display", lambda: fhir.lookup_one(s, fhir.SYSTEM, part)["display"]), ("lookup", lambda: fhir.lookup_one(s, fhir.SYSTEM, none)), ("property", lambda: fhir.lookup(s, properties=("other",))), ("normal form", lambda: fhir.lookup(s, properties=("normalForm",)))]
    for what, call in calls:
        try:
            rows.append((what, call()))
        except fhir.FhirError as e:
            rows.append((what, e.kind))
    return spark.createDataFrame(rows, "what string, outcome string")


# ---- completion rules: conjunctions, role hierarchy, chains, transitive roles, equivalence

BOTH, DEFINED, SAME, OTHER, CHAINED, REACHED, RAISED = range(9100, 9107)


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axioms over all parts, customers and suppliers that need every rule:

    products of one type and brand; a class defined as a type placed by a region; two equivalent classes; a chain of roles;
    a transitive role along every fifth nation; a role below another that a general inclusion asks for; and what is skipped or does not parse.
    """
    ref = lambda c: F.concat(F.lit(":"), M.concept(c).cast("string"))
    some = lambda role, filler: F.concat(F.lit(f" ObjectSomeValuesFrom(:{M.code(role)} "), filler, F.lit("))"))
    sub = lambda left, right: F.concat(F.lit("SubClassOf("), left, right).alias("owlExpression")
    part, nation = M.read(spark, sf_dir, "part"), M.read(spark, sf_dir, "nation")
    own, brand = ref(F.col("p_partkey") + M.PART), M.brand_item("p_brand")
    fixed = [
        "SubClassOf(ObjectIntersectionOf(:{4001} :{5013}) :{9100})", "EquivalentClasses(:{9101} ObjectIntersectionOf(:{4002} ObjectSomeValuesFrom(:{7001} :{2001})))", "EquivalentClasses(:{9102} :{9103})", "SubClassOf(:{4003} :{9102})",
        "SubObjectPropertyOf(ObjectPropertyChain(:{7002} :{7001}) :{7003})", "SubClassOf(ObjectSomeValuesFrom(:{7003} :{2002}) :{9104})", "TransitiveObjectProperty(:{7000})", "SubClassOf(ObjectSomeValuesFrom(:{7000} :{3024}) :{9105})",
        "SubObjectPropertyOf(:{7002} :{7004})", "SubClassOf(ObjectSomeValuesFrom(:{7004} :{5013}) :{9106})", "ReflexiveObjectProperty(:{7003})", "SubDataPropertyOf(:{7004} :{7006})", "SubClassOf(:{4001}",
    ]
    out = union([
        M.is_a(spark, sf_dir).filter(F.col("child") < M.ORDER).select(sub(ref(F.col("child")), F.concat(F.lit(" "), ref(F.col("parent")), F.lit(")")))),
        part.select(sub(own, some(M.PLACED_BY, ref(F.pmod(F.col("p_size"), F.lit(25)) + 3000)))), part.select(sub(own, some(M.HAS_PART, ref(brand)))),
        part.select("p_brand").distinct().select(sub(ref(brand), some(M.PLACED_BY, ref(F.pmod(brand, F.lit(5)) + 2000)))),
        nation.filter("n_nationkey < 20").select(sub(ref(F.col("n_nationkey") + 3000), some(M.LINE, ref(F.col("n_nationkey") + 3005)))),
        part.filter("p_size < 5").select(sub(own, F.concat(F.lit(f' DataHasValue(:{M.code(M.QUANTITY)} "'), F.col("p_size").cast("string"), F.lit('"^^xsd:integer))')))),
        spark.createDataFrame([(filled(x),) for x in fixed], "owlExpression string"),
    ])
    return out.select(F.md5("owlExpression").alias("id"), "owlExpression")


BRAND = "CAST(substr(p_brand, 7) AS BIGINT)"
RULED = f"""up(child, parent) AS (SELECT child, parent FROM isa WHERE child < {M.ORDER}
 UNION SELECT {M.PART} + p_partkey, {BOTH} FROM part WHERE p_type = '{M.PART_TYPES[0]}' AND {BRAND} = 13
 UNION SELECT {M.PART} + p_partkey, {DEFINED} FROM part JOIN nation ON n_nationkey = p_size % 25 WHERE p_type = '{M.PART_TYPES[1]}' AND (n_regionkey = 1 OR {BRAND} % 5 = 1)
 UNION SELECT {M.PART} + p_partkey, {CHAINED} FROM part WHERE {BRAND} % 5 = 2 UNION SELECT {M.PART} + p_partkey, {RAISED} FROM part WHERE {BRAND} = 13
 UNION SELECT 3000 + n_nationkey, {REACHED} FROM nation WHERE n_nationkey IN (4, 9, 14, 19) UNION VALUES ({DEFINED}, 4002), ({SAME}, {OTHER}), ({OTHER}, {SAME}), (4003, {SAME})),
sup(d, a) AS (SELECT child, parent FROM up UNION SELECT s.d, u.parent FROM sup s JOIN up u ON s.a = u.child)"""


@query(f", {RULED} SELECT d AS sub, a AS sup FROM sup WHERE d <> a")
def el_rules(spark, sf_dir):
    return as_items(el.classify(rules(spark, sf_dir)).subsumption, "sub", "sup")


@query(
    f"""SELECT 'ConcreteValue' AS what, {M.QUANTITY}::BIGINT AS item, count(*)::BIGINT AS n FROM part WHERE p_size < 5 HAVING count(*) > 0 UNION ALL VALUES ('ReflexiveProperty', {M.HAS_SUPPLIER}, 1), ('DataProperty', {M.QUANTITY}, 1), ('error', NULL, 1), ('equivalent', {OTHER}, 1), ('below itself', NULL, 1), ('below', NULL, 1), ('not below', NULL, 0)
 UNION ALL SELECT 'subsumer', unnest([4002, {M.PRODUCT}, {M.ROOT}]), 1""",
    projected=False,
)
def el_answers(spark, sf_dir):
    """What a classification skipped and could not read, and its answers on single concepts."""
    c = el.classify(rules(spark, sf_dir))
    tell = lambda what, df: df.select(F.lit(what).alias("what"), I.item_identifier(F.col("concept")).alias("item"), F.lit(1).cast("long").alias("n"))
    skipped = c.skipped.groupBy("kind", "id").count().select(F.col("kind").alias("what"), I.item_identifier(F.col("id")).alias("item"), F.col("count").alias("n"))
    facts = [("error", None, c.errors.count()), ("below itself", None, int(c.is_subsumed_by(M.code(9999), M.code(9999)))), ("below", None, int(c.is_subsumed_by(M.code(4003), M.code(OTHER)))), ("not below", None, int(c.is_subsumed_by(M.code(4002), M.code(DEFINED))))]
    return union([skipped, tell("subsumer", c.subsumers(M.code(DEFINED))), tell("equivalent", c.equivalent_to(M.code(SAME))), spark.createDataFrame(facts, "what string, item long, n long")])
