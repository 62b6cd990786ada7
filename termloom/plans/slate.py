"""The registered queries over the terminology projection, each with the SQL that it must equal."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import constants as K
from termloom.functions import ids as I
from termloom.functions import values as V
from termloom.operators import el, fhir, graph, nnf, versioning
from termloom.plans import starmap as M
from termloom.plans.compiler import Compiler
from termloom.sources import rf2
from termloom.sources.schemas import RECORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, projected: bool = True):
    """Register a function by its name; `sql` may use the projection's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {M.PROJECTION} {sql}" if projected else sql
        return f

    return add


def as_items(df: DataFrame, *cols: str) -> DataFrame:
    """Ids as the item numbers that they were composed from."""
    return df.select(*[I.item_identifier(F.col(c)).alias("item" if c == "id" else c) for c in cols or ("id",)])


# ---- identifiers and values

VERHOEFF = f"""
digits(s) AS (SELECT CAST(x AS VARCHAR) FROM (SELECT o_orderkey * 1000 + o_custkey + 100000 AS x FROM orders)),
d(t) AS (SELECT {I.PRODUCT}), p(t) AS (SELECT {[x for row in I.PLACES for x in row]}), inv(t) AS (SELECT {I.INVERSE})
"""
FOLD = "list_reduce(list_prepend(0, list_transform(range(1, length({s}) + 1), lambda i: p.t[CAST(((i - 1 + {first}) % 8) * 10 + CAST(substr({s}, length({s}) - i + 1, 1) AS BIGINT) + 1 AS BIGINT)])), lambda c, x: d.t[CAST(c * 10 + x + 1 AS BIGINT)])"


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 1000 + F.col("o_custkey") + 100000).cast("string").alias("s"))


@query(f"WITH {VERHOEFF} SELECT s, {FOLD.format(s='s', first=0)} = 0 AS valid, CAST(inv.t[CAST({FOLD.format(s='s', first=1)} + 1 AS BIGINT)] AS VARCHAR) AS digit FROM digits, d, p, inv", projected=False)
def verhoeff(spark, sf_dir):
    return numbers(spark, sf_dir).select("s", I.verhoeff_valid(F.col("s")).alias("valid"), I.verhoeff_digit(F.col("s")).alias("digit"))


@query(f"WITH {VERHOEFF}, b AS (SELECT c_custkey, CAST({M.CUSTOMER} + c_custkey AS VARCHAR) || '00' AS short, CAST(1 + c_custkey AS VARCHAR) || lpad(CAST(1000124 + c_nationkey AS VARCHAR), 7, '0') || '12' AS long FROM customer) SELECT c_custkey, CAST(short || inv.t[CAST({FOLD.format(s='short', first=1)} + 1 AS BIGINT)] AS BIGINT) AS concept_id, CAST(long || inv.t[CAST({FOLD.format(s='long', first=1)} + 1 AS BIGINT)] AS BIGINT) AS extension_id FROM b, d, p, inv", projected=False)
def sctid_compose(spark, sf_dir):
    c = M.read(spark, sf_dir, "customer")
    return c.select("c_custkey", I.composed_id(F.col("c_custkey") + M.CUSTOMER).alias("concept_id"), I.composed_id(F.col("c_custkey") + 1, "Relationship", F.col("c_nationkey") + 1000124).alias("extension_id"))


@query(f"WITH {VERHOEFF}, b AS (SELECT c_custkey, CAST(1 + c_custkey AS VARCHAR) || lpad(CAST(1000124 + c_nationkey AS VARCHAR), 7, '0') || '12' AS long, c_nationkey FROM customer) SELECT c_custkey, 'Relationship' AS component, 12 AS part, true AS long_format, CAST(1000124 + c_nationkey AS INTEGER) AS namespace, CAST(1 + c_custkey AS BIGINT) AS item, CAST(inv.t[CAST({FOLD.format(s='long', first=1)} + 1 AS BIGINT)] AS INTEGER) AS check_digit FROM b, d, p, inv", projected=False)
def sctid_decompose(spark, sf_dir):
    i = F.col("extension_id")
    return sctid_compose(spark, sf_dir).select("c_custkey", I.component_type(i).alias("component"), I.partition(i).alias("part"), I.is_long_format(i).alias("long_format"), I.namespace(i).alias("namespace"), I.item_identifier(i).alias("item"), I.check_digit(i).alias("check_digit"))


@query(
    f"""WITH {VERHOEFF}, raw AS (
 SELECT s FROM digits UNION ALL SELECT '0' || s FROM digits UNION ALL SELECT substr(s, 1, 5) FROM digits UNION ALL SELECT s || 'x' FROM digits UNION ALL SELECT s || s || s FROM digits),
 v AS (SELECT s, length(s) AS n, s SIMILAR TO '[0-9]+' AS ok, CASE WHEN s SIMILAR TO '[0-9]+' AND length(s) BETWEEN 6 AND 18 THEN {FOLD.format(s='s', first=0)} = 0 END AS good FROM raw, d, p),
 e AS (SELECT s, n, CASE WHEN NOT n BETWEEN 6 AND 18 THEN 'InvalidLength(' || n || ')' WHEN NOT ok THEN 'NonDigit' WHEN s LIKE '0%' THEN 'LeadingZero' WHEN NOT good THEN 'CheckDigit'
  WHEN CAST(substr(s, n - 2, 2) AS INTEGER) % 10 > 2 OR CAST(substr(s, n - 2, 2) AS INTEGER) > 12 THEN 'InvalidPartition(' || CAST(substr(s, n - 2, 2) AS INTEGER) || ')'
  WHEN CAST(substr(s, n - 2, 2) AS INTEGER) >= 10 AND n < 11 THEN 'InvalidLength(' || n || ')' END AS error FROM v)
 SELECT error, count(*)::BIGINT AS n, max(CASE WHEN error IS NULL THEN CAST(s AS BIGINT) END) AS largest FROM e GROUP BY error""",
    projected=False,
)
def sctid_validate(spark, sf_dir):
    s = F.col("s")
    raw = numbers(spark, sf_dir).select(F.explode(F.array(s, F.concat(F.lit("0"), s), F.substring(s, 1, 5), F.concat(s, F.lit("x")), F.concat(s, s, s))).alias("s"))
    return raw.select(I.id_error(s).alias("error"), I.parsed_id(s).alias("id")).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("largest"))


@query(
    """WITH t AS (SELECT strftime(o_orderdate, '%Y%m') || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') AS s FROM orders)
 SELECT s, CASE WHEN d BETWEEN 1 AND 31 THEN CAST(s AS INTEGER) END AS time, CASE WHEN d BETWEEN 1 AND 31 THEN CAST(substr(s, 1, 4) AS INTEGER) END AS y, CASE WHEN d BETWEEN 1 AND 31 THEN CAST(substr(s, 5, 2) AS INTEGER) END AS m, CASE WHEN d BETWEEN 1 AND 31 THEN d END AS d, count(*)::BIGINT AS n
 FROM (SELECT s, CAST(substr(s, 7, 2) AS INTEGER) AS d FROM t) GROUP BY ALL""",
    projected=False,
)
def effective_time(spark, sf_dir):
    s = F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lpad((F.col("o_custkey") % 40).cast("string"), 2, "0"))
    t = F.col("time")
    return M.read(spark, sf_dir, "orders").select(s.alias("s")).withColumn("time", V.time(F.col("s"))).groupBy("s", "time", V.year(t).alias("y"), V.month(t).alias("m"), V.day(t).alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT unnest(['#' || CAST(l_quantity AS INTEGER), '#-' || CAST(l_quantity AS INTEGER) || '.', '#.' || CAST(l_quantity AS INTEGER), '#+1', '#1.2.' || CAST(l_quantity AS INTEGER), '"' || l_returnflag || '"', '"' || l_returnflag, l_returnflag, '']) AS s FROM lineitem)
 SELECT s, CASE WHEN s = '' THEN 'Empty' WHEN s LIKE '#+%' OR s LIKE '#1.2.%' THEN 'InvalidNumber' WHEN s LIKE '"_' THEN 'UnterminatedString' WHEN s NOT LIKE '#%' AND s NOT LIKE '"%' THEN 'Malformed' END AS error,
 CASE WHEN s LIKE '#%' AND s NOT LIKE '#+%' AND s NOT LIKE '#1.2.%' THEN 'Number' WHEN s LIKE '"%"' AND length(s) > 1 THEN 'String' END AS value_type,
 CASE WHEN s LIKE '#%' AND s NOT LIKE '#+%' AND s NOT LIKE '#1.2.%' THEN CAST(substr(s, 2) AS DOUBLE) END AS num, count(*)::BIGINT AS n FROM t GROUP BY ALL""",
    projected=False,
)
def concrete_values(spark, sf_dir):
    q, f = F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag")
    made = F.array(F.concat(F.lit("#"), q), F.concat(F.lit("#-"), q, F.lit(".")), F.concat(F.lit("#."), q), F.lit("#+1"), F.concat(F.lit("#1.2."), q), F.concat(F.lit('"'), f, F.lit('"')), F.concat(F.lit('"'), f), f, F.lit(""))
    v = V.concrete_value(F.col("s"))
    return M.read(spark, sf_dir, "lineitem").select(F.explode(made).alias("s")).groupBy("s", V.concrete_error(F.col("s")).alias("error"), v["value_type"].alias("value_type"), v["num"].alias("num")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT p_partkey, p_name || ' (' || p_type || ')  ' AS fsn FROM part) SELECT p_partkey, regexp_extract(rtrim(fsn), '\\(([^(]*)\\)$', 1) AS tag, CAST(NULL AS VARCHAR) AS no_tag FROM t", projected=False)
def semantic_tag(spark, sf_dir):
    term = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")  "))
    return M.read(spark, sf_dir, "part").select("p_partkey", V.semantic_tag(term, F.lit(K.FSN)).alias("tag"), V.semantic_tag(term, F.lit(K.SYNONYM)).alias("no_tag"))


@query(
    """WITH t AS (SELECT o_orderkey, unnest([upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 21, 12)), md5(CAST(o_orderkey AS VARCHAR)), '+' || o_orderkey, CAST(4294967290 + o_orderkey AS VARCHAR), '1', '']) AS s FROM orders)
 SELECT o_orderkey, s, CASE WHEN length(s) = 36 THEN lower(s) END AS member_id, CASE WHEN s = '1' THEN true END AS flag,
 CASE WHEN s SIMILAR TO '[+]?[0-9]{1,10}' AND CAST(ltrim(s, '+') AS BIGINT) < 4294967296 THEN CAST(ltrim(s, '+') AS BIGINT) END AS unsigned, CASE WHEN s <> '' THEN s END AS text FROM t""",
    projected=False,
)
def field_validators(spark, sf_dir):
    h = F.md5(F.col("o_orderkey").cast("string"))
    uuid = F.upper(F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    raw = F.array(uuid, h, F.concat(F.lit("+"), F.col("o_orderkey").cast("string")), (F.col("o_orderkey") + 4294967290).cast("string"), F.lit("1"), F.lit(""))
    s = F.col("s")
    flag = F.when(V.active(s), True)
    return M.read(spark, sf_dir, "orders").select("o_orderkey", F.explode(raw).alias("s")).select("o_orderkey", "s", V.member_id(s).alias("member_id"), flag.alias("flag"), V.unsigned(s).alias("unsigned"), V.non_empty(s).alias("text"))


# ---- versions: events as the versions of their users


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), M.ymd(F.col("ts")).alias("effectiveTime"), F.col("event_id").alias("arrival"), "event_type", "value")


VERSIONS = "e AS (SELECT user_id AS id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS \"effectiveTime\", event_id AS arrival, event_type, value FROM events)"


@query(f'WITH {VERSIONS} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "effectiveTime" DESC, arrival) AS r FROM e) WHERE r = 1', projected=False)
def snapshot_latest(spark, sf_dir):
    return versioning.latest(versions(spark, sf_dir))


@query(f"WITH {VERSIONS} SELECT * FROM e WHERE id IN (3, 8, 46)", projected=False)
def history_versions(spark, sf_dir):
    return versioning.history(versions(spark, sf_dir), [3, 8, 46])


@query(f'WITH {VERSIONS} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "effectiveTime" DESC, arrival DESC) AS r FROM e WHERE "effectiveTime" <= 20240115) WHERE r = 1', projected=False)
def as_of_bulk(spark, sf_dir):
    return versioning.as_of(versions(spark, sf_dir), 20240115)


@query(
    f'WITH {VERSIONS}, p AS (SELECT c_custkey AS id, CAST(20240101 + c_custkey % 28 AS INTEGER) AS "at" FROM customer) SELECT id, "at", "effectiveTime", arrival, event_type, value FROM (SELECT p.id, p."at", e.* EXCLUDE (id), row_number() OVER (PARTITION BY p.id, p."at" ORDER BY e."effectiveTime" DESC, e.arrival DESC) AS r FROM p LEFT JOIN e ON p.id = e.id AND e."effectiveTime" <= p."at") WHERE r = 1',
    projected=False,
)
def as_of_join(spark, sf_dir):
    probes = M.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 28 + 20240101).cast("int").alias("at"))
    return versioning.as_of_join(probes, versions(spark, sf_dir))


# ---- hierarchy


@query("SELECT DISTINCT child, parent FROM isa")
def hierarchy_edges(spark, sf_dir):
    return as_items(M.snapshot(spark, sf_dir).edges, "child", "parent")


@query("SELECT d AS descendant, a AS ancestor FROM clo")
def closure_all(spark, sf_dir):
    return as_items(M.snapshot(spark, sf_dir).closure, "descendant", "ancestor")


@query("SELECT a AS item FROM clo WHERE d = 30000007")
def ancestors_of(spark, sf_dir):
    return as_items(M.snapshot(spark, sf_dir).ancestors(M.code(30000007)))


@query("SELECT d AS item FROM clo WHERE a = 1001")
def descendants_of(spark, sf_dir):
    return as_items(M.snapshot(spark, sf_dir).descendants(M.code(1001)))


@query("SELECT parent AS item, 'parent' AS side FROM isa WHERE child = 30000007 UNION ALL SELECT child, 'child' FROM isa WHERE parent = 1002")
def parents_children(spark, sf_dir):
    s = M.snapshot(spark, sf_dir)
    return as_items(s.parents(M.code(30000007))).withColumn("side", F.lit("parent")).unionByName(as_items(s.children(M.code(1002))).withColumn("side", F.lit("child")))


@query(
    f"""SELECT a, b, CASE WHEN a = b THEN 'equivalent' WHEN EXISTS (SELECT 1 FROM clo WHERE clo.a = q.a AND clo.d = q.b) THEN 'subsumes' WHEN EXISTS (SELECT 1 FROM clo WHERE clo.d = q.a AND clo.a = q.b) THEN 'subsumed-by' ELSE 'not-subsumed' END AS outcome
 FROM (SELECT {M.CUSTOMER} + c_custkey AS a, 2000 + c_custkey % 5 AS b FROM customer UNION ALL SELECT 3000 + c_custkey % 25, {M.CUSTOMER} + c_custkey FROM customer UNION ALL SELECT {M.CUSTOMER} + c_custkey, {M.CUSTOMER} + c_custkey FROM customer) q"""
)
def bulk_subsumes(spark, sf_dir):
    k = F.col("c_custkey")
    own = M.concept(k + M.CUSTOMER)
    pairs = M.read(spark, sf_dir, "customer").select(F.explode(F.array(F.struct(own.alias("a"), M.concept(k % 5 + 2000).alias("b")), F.struct(M.concept(k % 25 + 3000).alias("a"), own.alias("b")), F.struct(own.alias("a"), own.alias("b")))).alias("p")).select("p.*")
    out = fhir.bulk_subsumes(M.snapshot(spark, sf_dir), pairs)
    return out.select(I.item_identifier(F.col("a")).alias("a"), I.item_identifier(F.col("b")).alias("b"), "outcome")


@query("SELECT child, parent FROM (SELECT d AS child, a AS parent FROM clo) c WHERE NOT EXISTS (SELECT 1 FROM clo x JOIN clo y ON x.a = y.d WHERE x.d = c.child AND y.a = c.parent)")
def proximal_parents(spark, sf_dir):
    return as_items(graph.proximal(M.snapshot(spark, sf_dir).closure), "child", "parent")


# ---- reference sets and descriptions

MEMBERS = f"""mem(refset, component) AS (
 SELECT {M.QUALITY}, {M.TEXT} + doc_id FROM labels WHERE quality = 1 UNION SELECT {M.TOXIC}, {M.TEXT} + doc_id FROM labels WHERE toxic = 1
 UNION SELECT {M.SEGMENT} + list_position({list(M.SEGMENTS)}, c_mktsegment), {M.CUSTOMER} + c_custkey FROM customer
 UNION SELECT {M.ENGLISH}, 300000001 + p_partkey * 10 FROM part UNION SELECT {M.ENGLISH}, 300000002 + p_partkey * 10 FROM part)"""


@query(f", {MEMBERS} SELECT refset AS \"refsetId\", component AS \"referencedComponentId\" FROM mem")
def membership(spark, sf_dir):
    return as_items(M.snapshot(spark, sf_dir).membership, "refsetId", "referencedComponentId")


@query(f", {MEMBERS} SELECT component AS item FROM mem WHERE refset = {M.QUALITY}")
def refset_members(spark, sf_dir):
    return as_items(M.snapshot(spark, sf_dir).refset_members(M.code(M.QUALITY)))


@query(f", {MEMBERS} SELECT DISTINCT refset AS item FROM mem")
def refset_ids(spark, sf_dir):
    return as_items(M.snapshot(spark, sf_dir).refset_ids())


@query(f"SELECT {M.PART} + p_partkey AS item, CASE WHEN p_size > 40 THEN p_brand || ' ' || p_name ELSE p_name END AS term FROM part")
def preferred_terms(spark, sf_dir):
    return M.snapshot(spark, sf_dir).preferred_terms(M.code(M.ENGLISH)).select(I.item_identifier(F.col("id")).alias("item"), "term")


@query(f"SELECT {M.PART} + p_partkey AS item, p_name || ' (part)' AS fsn FROM part UNION ALL SELECT 3000 + n_nationkey, n_name || ' (nation)' FROM nation UNION ALL SELECT 2000 + r_regionkey, r_name || ' (region)' FROM region")
def fully_specified_names(spark, sf_dir):
    return M.snapshot(spark, sf_dir).fsn().select(I.item_identifier(F.col("id")).alias("item"), "fsn")


@query("SELECT 40000000 + l_orderkey AS source, 30000000 + l_partkey AS destination, l_linenumber::BIGINT AS grp, l_linestatus = 'O' AS active FROM lineitem WHERE l_partkey = 7")
def relationships_to(spark, sf_dir):
    rows = M.snapshot(spark, sf_dir).relationships_to(M.code(30000007))
    return rows.select(I.item_identifier(F.col("sourceId")).alias("source"), I.item_identifier(F.col("destinationId")).alias("destination"), F.col("relationshipGroup").alias("grp"), "active")


@query("SELECT count(*)::BIGINT AS concepts, count(*) FILTER (WHERE active)::BIGINT AS active, count(*) FILTER (WHERE defined)::BIGINT AS defined FROM concept")
def concept_counts(spark, sf_dir):
    return M.snapshot(spark, sf_dir).concepts.agg(F.count(F.lit(1)).alias("concepts"), F.count_if("active").alias("active"), F.count_if(V.is_sufficiently_defined(F.col("definitionStatusId"))).alias("defined"))


# ---- validation

#: A copy of the terminology in which some references dangle and some IS-A rows make cycles.
BROKEN = 7


def broken(spark: SparkSession, sf_dir: str):
    s = M.snapshot(spark, sf_dir)
    gone = I.item_identifier(F.col("id"))
    s._tables["concept"] = s.concepts.filter(~(gone.between(M.CUSTOMER, M.SUPPLIER - 1) & (gone % BROKEN == 0)) & ~(gone.between(M.PART, M.ORDER - 1) & (gone % BROKEN == 1)))
    s._tables["relationship"] = s.relationships.withColumn("id", I.item_identifier(F.col("sourceId")) * 10 + I.item_identifier(F.col("typeId")) % 10)
    return s


@query(
    f"""SELECT DISTINCT 'destination' AS fault, ({M.ORDER} + o_orderkey) * 10 + 1 AS id FROM orders WHERE ({M.CUSTOMER} + o_custkey) % {BROKEN} = 0
 UNION SELECT 'destination', ({M.ORDER} + l_orderkey) * 10 + 2 FROM lineitem WHERE ({M.PART} + l_partkey) % {BROKEN} = 1
 UNION SELECT 'source', ({M.CUSTOMER} + c_custkey) * 10 + {(K.IS_A // 1000) % 10} FROM customer WHERE ({M.CUSTOMER} + c_custkey) % {BROKEN} = 0
 UNION SELECT 'source', ({M.PART} + p_partkey) * 10 + {(K.IS_A // 1000) % 10} FROM part WHERE ({M.PART} + p_partkey) % {BROKEN} = 1
 UNION SELECT 'description', 300000000 + p_partkey * 10 + n FROM part, (VALUES (0), (1), (2)) t(n) WHERE ({M.PART} + p_partkey) % {BROKEN} = 1
 UNION SELECT 'description', {M.TEXT} + doc_id FROM documents""",
    projected=False,
)
def validate_dangling(spark, sf_dir):
    found = broken(spark, sf_dir).validate()
    tag = lambda name, fault, col: found[name].select(F.lit(fault).alias("fault"), col.alias("id"))
    return tag("dangling_descriptions", "description", I.item_identifier(F.col("id"))).unionByName(tag("dangling_sources", "source", F.col("id"))).unionByName(tag("dangling_destinations", "destination", F.col("id"))).distinct()


@query(
    f"""SELECT 'dangling_destinations' AS fault, (SELECT count(*) FROM orders WHERE ({M.CUSTOMER} + o_custkey) % {BROKEN} = 0) + (SELECT count(*) FROM lineitem WHERE ({M.PART} + l_partkey) % {BROKEN} = 1) AS n
 UNION ALL SELECT 'dangling_sources', (SELECT count(*) FROM customer WHERE ({M.CUSTOMER} + c_custkey) % {BROKEN} = 0) + 2 * (SELECT count(*) FROM part WHERE ({M.PART} + p_partkey) % {BROKEN} = 1)
 UNION ALL SELECT 'dangling_descriptions', 3 * (SELECT count(*) FROM part WHERE ({M.PART} + p_partkey) % {BROKEN} = 1) + (SELECT count(*) FROM documents)
 UNION ALL SELECT 'cyclic_concepts', 0""",
    projected=False,
)
def validate_issues(spark, sf_dir):
    return broken(spark, sf_dir).issues()


@query(
    f"""WITH RECURSIVE n AS (SELECT {M.CUSTOMER} + o_custkey AS child, {M.CUSTOMER} + (o_custkey * 7 + 1) % 150 AS parent FROM orders WHERE o_custkey < 150),
 e AS (SELECT DISTINCT child, parent FROM n), c(d, a) AS (SELECT child, parent FROM e UNION SELECT c.d, e.parent FROM c JOIN e ON c.a = e.child) SELECT d AS item FROM c WHERE d = a""",
    projected=False,
)
def validate_cycles(spark, sf_dir):
    o = M.read(spark, sf_dir, "orders").filter("o_custkey < 150")
    edges = o.select(M.concept(F.col("o_custkey") + M.CUSTOMER).alias("child"), M.concept((F.col("o_custkey") * 7 + 1) % 150 + M.CUSTOMER).alias("parent")).distinct()
    return as_items(graph.cyclic(edges, M.snapshot(spark, sf_dir).concepts.select("id")))


#: Customers in a group, within which validate_cycles_all makes edges: paths stay as short at every size.
GROUP = 150


@query(
    f"""WITH RECURSIVE n AS (SELECT {M.CUSTOMER} + o_custkey AS child, {M.CUSTOMER} + o_custkey - o_custkey % {GROUP} + (o_custkey * 7 + 1) % {GROUP} AS parent FROM orders),
 e AS (SELECT DISTINCT child, parent FROM n), c(d, a) AS (SELECT child, parent FROM e UNION SELECT c.d, e.parent FROM c JOIN e ON c.a = e.child) SELECT d AS item FROM c WHERE d = a""",
    projected=False,
)
def validate_cycles_all(spark, sf_dir):
    """validate_cycles over the orders of all customers."""
    k = F.col("o_custkey")
    parent = k - k % GROUP + (k * 7 + 1) % GROUP
    edges = M.read(spark, sf_dir, "orders").select(M.concept(k + M.CUSTOMER).alias("child"), M.concept(parent + M.CUSTOMER).alias("parent")).distinct()
    return as_items(graph.cyclic(edges, M.snapshot(spark, sf_dir).concepts.select("id")))


# ---- expression constraints: {n} stands for the id of item n

DOWN = "(SELECT d FROM clo WHERE a = {0})"
DOWN_SELF = "(SELECT d FROM clo WHERE a = {0} UNION SELECT {0})"
ORDERS = "SELECT item FROM concept c WHERE item IN (SELECT d FROM clo WHERE a = 1003)"
LOW = "SELECT item FROM concept c WHERE item IN (SELECT d FROM clo WHERE a = 6001)"


def of(alias: str, type_: str, value: str | None = None) -> str:
    """The number of facts of a concept c by type and value."""
    return f"(SELECT count(*) FROM rel r WHERE r.src = c.item AND r.type {type_}" + (f" AND r.dst {value})" if value else ")")


CONSTRAINTS = {
    "ecl_self": ("{3003}", "SELECT 3003::BIGINT AS item"),
    "ecl_desc": ("< {2001}", f"SELECT d AS item FROM {DOWN.format(2001)}"),
    "ecl_desc_or_self": ("<< {2001} |region|", f"SELECT d AS item FROM {DOWN_SELF.format(2001)}"),
    "ecl_child": ("<! {1002}", "SELECT child AS item FROM isa WHERE parent = 1002"),
    "ecl_child_or_self": ("<<! {2001}", "SELECT child AS item FROM isa WHERE parent = 2001 UNION SELECT 2001"),
    "ecl_anc": ("> {30000007}", "SELECT a AS item FROM clo WHERE d = 30000007"),
    "ecl_anc_or_self": (">> {30000007}", "SELECT a AS item FROM clo WHERE d = 30000007 UNION SELECT 30000007"),
    "ecl_parent": (">! {30000007}", "SELECT parent AS item FROM isa WHERE child = 30000007"),
    "ecl_parent_or_self": (">>! {30000007}", "SELECT parent AS item FROM isa WHERE child = 30000007 UNION SELECT 30000007"),
    "ecl_wildcard": ("*", "SELECT item FROM concept"),
    "ecl_wildcard_desc": ("< *", "SELECT item FROM concept WHERE item IN (SELECT child FROM isa)"),
    "ecl_wildcard_anc": ("> *", "SELECT item FROM concept WHERE item IN (SELECT parent FROM isa)"),
    "ecl_wildcard_desc_or_self": ("<< *", "SELECT item FROM concept"),
    "ecl_wildcard_anc_or_self": (">> *", "SELECT item FROM concept"),
    "ecl_wildcard_child": ("<! *", "SELECT item FROM concept WHERE item IN (SELECT child FROM isa)"),
    "ecl_wildcard_parent": (">! *", "SELECT item FROM concept WHERE item IN (SELECT parent FROM isa)"),
    "ecl_wildcard_child_or_self": ("<<! *", "SELECT item FROM concept"),
    "ecl_wildcard_parent_or_self": (">>! *", "SELECT item FROM concept"),
    "ecl_memberof": ("^ {8011}", f"SELECT {M.CUSTOMER} + c_custkey AS item FROM customer WHERE c_mktsegment = 'AUTOMOBILE'"),
    "ecl_and": ("< {4001} AND < {5013}", f"SELECT {M.PART} + p_partkey AS item FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#13'"),
    "ecl_or": ("< {4001} OR < {5013}", f"SELECT {M.PART} + p_partkey AS item FROM part WHERE p_type = 'ECONOMY' OR p_brand = 'Brand#13'"),
    "ecl_minus": ("< {2001} MINUS ^ {8011}", f"SELECT d AS item FROM {DOWN.format(2001)} WHERE d NOT IN (SELECT {M.CUSTOMER} + c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')"),
    "ecl_refine_eq": ("< {1003} : {7001} = << {3005}", f"{ORDERS} AND {of('c', '= 7001', f'IN {DOWN_SELF.format(3005)}')} >= 1"),
    "ecl_refine_ne": ("< {6001} : {7001} != << {2001}", f"{LOW} AND NOT {of('c', '= 7001', f'IN {DOWN_SELF.format(2001)}')} >= 1"),
    "ecl_refine_card": ("< {1003} : [2..*] {7002} = < {4002}", f"{ORDERS} AND {of('c', '= 7002', f'IN {DOWN.format(4002)}')} >= 2"),
    "ecl_refine_zero_card": ("< {1003} : [0..0] {7002} = *", f"{ORDERS} AND {of('c', '= 7002')} = 0"),
    "ecl_refine_max_card": ("< {6002} : [0..1] {7002} = *", f"SELECT item FROM concept c WHERE item IN {DOWN.format(6002)} AND {of('c', '= 7002')} <= 1"),
    "ecl_refine_reverse": ("< {5013} : R {7002} = < {6002}", f"SELECT {M.PART} + p_partkey AS item FROM part WHERE p_brand = 'Brand#13' AND EXISTS (SELECT 1 FROM rel r WHERE r.dst = {M.PART} + p_partkey AND r.type = 7002 AND r.src IN {DOWN.format(6002)})"),
    "ecl_refine_attr_hier": ("< {6001} : [6..*] << {7000} = *", f"{LOW} AND {of('c', 'IN (7000, 7002, 7003)')} >= 6"),
    "ecl_refine_wild_attr": ("< {6001} : [0..1] * = *", f"{LOW} AND {of('c', 'IN (SELECT item FROM concept)')} <= 1"),
    "ecl_refine_num": ("< {1003} : {7004} > #49", f"{ORDERS} AND item IN (SELECT src FROM lines WHERE qty > 49)"),
    "ecl_refine_num_ne": ("< {6001} : {7004} != #10", f"{LOW} AND item NOT IN (SELECT src FROM lines WHERE qty = 10)"),
    "ecl_refine_num_card": ("< {1003} : [2..3] {7004} <= #12.5", f"{ORDERS} AND (SELECT count(*) FROM lines l WHERE l.src = c.item AND qty <= 12.5) BETWEEN 2 AND 3"),
    "ecl_refine_str": ('< {6001} : {7006} = "A"', f"{LOW} AND item IN (SELECT src FROM lines WHERE flag = 'A')"),
    "ecl_refine_str_ne": ('< {6001} : {7006} != "A"', f"{LOW} AND item NOT IN (SELECT src FROM lines WHERE flag = 'A')"),
    "ecl_refine_strset": ('< {6001} : [3..*] {7006} = ("A" "N")', f"{LOW} AND (SELECT count(*) FROM lines l WHERE l.src = c.item AND flag IN ('A', 'N')) >= 3"),
    "ecl_group": ("< {1003} : { {7002} = << {4001}, {7003} = << {3001} }", f"{ORDERS} AND EXISTS (SELECT r.grp FROM rel r JOIN rel q ON r.src = q.src AND r.grp = q.grp WHERE r.src = c.item AND r.type = 7002 AND r.dst IN {DOWN_SELF.format(4001)} AND q.type = 7003 AND q.dst IN {DOWN_SELF.format(3001)} AND r.grp <> 0)"),
    "ecl_group_card": ("< {6001} : [3..*] { {7002} = * }", f"{LOW} AND (SELECT count(DISTINCT grp) FROM rel r WHERE r.src = c.item AND r.type = 7002 AND grp <> 0) >= 3"),
    "ecl_group_none": ("< {6001} : [0..0] { {7002} = < {4001} }", f"{LOW} AND NOT EXISTS (SELECT 1 FROM rel r WHERE r.src = c.item AND r.type = 7002 AND grp <> 0 AND r.dst IN {DOWN.format(4001)})"),
    "ecl_group_concrete": ('< {1003} : { {7004} >= #45, {7006} = "A" }', f"{ORDERS} AND EXISTS (SELECT 1 FROM lines l JOIN lines m ON l.src = m.src AND l.grp = m.grp WHERE l.src = c.item AND l.qty >= 45 AND m.flag = 'A')"),
    "ecl_group_or": ('< {6003} : { {7004} = #1 OR {7002} = < {5001} }', f"SELECT item FROM concept c WHERE item IN {DOWN.format(6003)} AND EXISTS (SELECT 1 FROM lines l WHERE l.src = c.item AND (l.qty = 1 OR l.part IN {DOWN.format(5001)}))"),
    "ecl_and_or_nested": ("< {1003} : ({7001} = << {2000} OR {7001} = << {2002}), {7004} > #48", f"{ORDERS} AND ({of('c', '= 7001', f'IN {DOWN_SELF.format(2000)}')} >= 1 OR {of('c', '= 7001', f'IN {DOWN_SELF.format(2002)}')} >= 1) AND item IN (SELECT src FROM lines WHERE qty > 48)"),
    "ecl_nested_value": ("< {1003} : {7001} = (< {2001} : R {7001} = < {6001})", f"{ORDERS} AND EXISTS (SELECT 1 FROM rel r WHERE r.src = c.item AND r.type = 7001 AND r.dst IN {DOWN.format(2001)} AND r.dst IN (SELECT q.dst FROM rel q WHERE q.type = 7001 AND q.src IN {DOWN.format(6001)}))"),
    "ecl_filter_active": ("< {1003} {{ C active = false }}", f"{ORDERS} AND NOT active"),
    "ecl_filter_any": ("^ {8001} {{ C active = * }}", "SELECT item FROM concept WHERE false"),
    "ecl_filter_defstatus": ("< {1002} {{ C definitionStatus = defined }}", f"SELECT item FROM concept WHERE item IN {DOWN.format(1002)} AND defined"),
    "ecl_filter_module": ("* {{ C moduleId = {1001} }}", "SELECT item FROM concept WHERE module = 1001"),
    "ecl_filter_module_not": ("* {{ C moduleId != ({1001} OR {1003}) }}", "SELECT item FROM concept WHERE module NOT IN (1001, 1003)"),
    "ecl_filter_time": ('* {{ C effectiveTime >= "19990101" }}', "SELECT item FROM concept WHERE time >= 19990101"),
    "ecl_filter_time_set": ('* {{ C effectiveTime = ("19980601" "20010101" "19970228") }}', "SELECT item FROM concept WHERE time IN (19980601, 20010101, 19970228)"),
    "ecl_filter_time_not": ('* {{ C effectiveTime != ("19980601" "20240101") }}', "SELECT item FROM concept WHERE time <> 19980601 OR time <> 20240101"),
    "ecl_filter_chain": ('< {1003} {{ C active = true, effectiveTime < "19980101" }} {{ C definitionStatus != defined }} : {7004} > #40', f"{ORDERS} AND active AND time < 19980101 AND NOT defined AND item IN (SELECT src FROM lines WHERE qty > 40)"),
}


def filled(text: str) -> str:
    return re.sub(r"\{(\d+)\}", lambda m: str(M.code(int(m[1]))), text)


def constraint(name: str, text: str, sql: str) -> None:
    def run(spark, sf_dir):
        return as_items(Compiler(M.snapshot(spark, sf_dir))(filled(text)))

    run.__name__ = name
    query(sql)(run)


for _name, (_text, _sql) in CONSTRAINTS.items():
    constraint(_name, _text, _sql)


# ---- terminology operations


@query("SELECT item, coalesce(CASE WHEN p_size > 40 THEN p_brand || ' ' || p_name ELSE p_name END, '') AS display FROM (SELECT d AS item FROM clo WHERE a = 4001) JOIN part ON item = 30000000 + p_partkey ORDER BY item LIMIT 20 OFFSET 10")
def expand_page(spark, sf_dir):
    s = M.snapshot(spark, sf_dir)
    page = fhir.expand(s, f"{fhir.SYSTEM}?fhir_vs=ecl/< {M.code(4001)}", offset=10, count=20, language_refset=M.code(M.ENGLISH)).contains
    return page.select(I.item_identifier(F.col("id")).alias("item"), "display")


@query(f"SELECT {M.PART} + p_partkey AS item FROM part WHERE contains(p_name, 'widget') OR contains(lower(p_brand || ' ' || p_name), 'brand#1 ')")
def expand_filter(spark, sf_dir):
    s = M.snapshot(spark, sf_dir)
    ids = fhir.value_set(s, f"{fhir.SYSTEM}?fhir_vs=isa/{M.code(M.PRODUCT)}")
    return as_items(fhir.expansion(s, ids, active_only=True, text="WIDGET").unionByName(fhir.expansion(s, ids, text="brand#1 ")).distinct())


@query(
    f"""SELECT {M.PART} + p_partkey AS item, CASE WHEN p_size > 40 THEN p_brand || ' ' || p_name ELSE p_name END AS display, CAST(NULL AS VARCHAR) AS definition, false AS inactive, {M.PRODUCT}::BIGINT AS "moduleId", p_size >= 25 AS "sufficientlyDefined", 3::BIGINT AS designations,
 CASE WHEN p_size > 40 THEN p_brand || ' ' || p_name ELSE p_name END AS preferred FROM part""",
    projected=False,
)
def lookup_bulk(spark, sf_dir):
    s = M.snapshot(spark, sf_dir)
    codes = M.read(spark, sf_dir, "part").select(M.concept(F.col("p_partkey") + M.PART).alias("id"))
    preferred = F.get(F.filter("designation", lambda d: d["use"] == "Preferred"), F.lit(0))["value"]
    return fhir.lookup(s, codes, language_refset=M.code(M.ENGLISH)).select(I.item_identifier(F.col("id")).alias("item"), "display", "definition", "inactive", I.item_identifier(F.col("moduleId")).alias("moduleId"), "sufficientlyDefined", F.size("designation").cast("long").alias("designations"), preferred.alias("preferred"))


@query("SELECT '{\"id\":\"' || item || '\",\"effectiveTime\":\"' || time || '\",\"active\":' || active || ',\"moduleId\":\"' || module || '\",\"definitionStatusId\":\"' || CASE WHEN defined THEN '900000000000073002' ELSE '900000000000074008' END || '\"}' AS value FROM concept")
def ndjson_concepts(spark, sf_dir):
    rows = M.snapshot(spark, sf_dir).concepts.withColumns({"id": I.item_identifier(F.col("id")), "moduleId": I.item_identifier(F.col("moduleId"))})
    return rf2.to_json(rows, RECORDS["concept"])


# ---- classification

TAXONOMY = f"""up(child, parent) AS (
 SELECT child, parent FROM isa WHERE child < {M.PART + 300} AND NOT child BETWEEN {M.CUSTOMER + 200} AND {M.SUPPLIER - 1} AND NOT child BETWEEN {M.SUPPLIER + 200} AND {M.PART - 1}
 -- what is placed by a nation of region 1, or by region 1 itself, is a transaction
 UNION SELECT {M.PART} + p_partkey, {M.TRANSACTION} FROM part WHERE p_partkey < 300 AND p_size % 2 = 0 AND (SELECT n_regionkey FROM nation WHERE n_nationkey = p_size % 25) = 1
 UNION SELECT DISTINCT 5000 + CAST(substr(p_brand, 7) AS BIGINT), {M.TRANSACTION} FROM part WHERE p_partkey < 300 AND (5000 + CAST(substr(p_brand, 7) AS BIGINT)) % 5 = 1),
sup(d, a) AS (SELECT child, parent FROM up UNION SELECT s.d, u.parent FROM sup s JOIN up u ON s.a = u.child)"""


@query(f", {TAXONOMY} SELECT d AS sub, a AS sup FROM sup")
def el_subsumption(spark, sf_dir):
    return as_items(el.classify(M.axioms(spark, sf_dir, first=True)).subsumption, "sub", "sup")


@query(f", {TAXONOMY} SELECT d AS concept, a AS parent FROM sup s WHERE NOT EXISTS (SELECT 1 FROM sup x JOIN sup y ON x.a = y.d WHERE x.d = s.d AND y.a = s.a)")
def nnf_is_a(spark, sf_dir):
    return as_items(nnf.normal_forms(M.axioms(spark, sf_dir, first=True)).is_a, "concept", "parent")


@query(
    f"""SELECT {M.PART} + p_partkey AS concept, 1 AS grp, {M.HAS_SUPPLIER}::BIGINT AS type_id, 3000::BIGINT + p_size % 25 AS destination_id FROM part WHERE p_partkey < 300
 UNION ALL SELECT {M.PART} + p_partkey, 0, {M.PLACED_BY}, 3000 + p_size % 25 FROM part WHERE p_partkey < 300 AND p_size % 2 = 0
 UNION ALL SELECT {M.PART} + p_partkey, 0, {M.PLACED_BY}, 2000 + CAST(substr(p_brand, 7) AS BIGINT) % 5 FROM part WHERE p_partkey < 300 AND NOT (p_size % 2 = 0 AND (SELECT n_regionkey FROM nation WHERE n_nationkey = p_size % 25) = CAST(substr(p_brand, 7) AS BIGINT) % 5)
 UNION ALL SELECT DISTINCT 5000 + CAST(substr(p_brand, 7) AS BIGINT), 0, {M.PLACED_BY}, 2000 + CAST(substr(p_brand, 7) AS BIGINT) % 5 FROM part WHERE p_partkey < 300"""
)
def nnf_attributes(spark, sf_dir):
    return nnf.normal_forms(M.axioms(spark, sf_dir, first=True)).attributes.select(*[I.item_identifier(F.col(c)).alias(c) for c in ("concept", "type_id", "destination_id")], "grp")


# the same over all parts, customers and suppliers


def taxonomy(first: str = "true", parts: str = "true") -> str:
    """What the axioms imply, of the edges and parts that two conditions leave."""
    return f"""up(child, parent) AS (
 SELECT child, parent FROM isa WHERE child < {M.ORDER} AND {first}
 -- what is placed by a nation of region 1, or by region 1 itself, is a transaction
 UNION SELECT {M.PART} + p_partkey, {M.TRANSACTION} FROM part JOIN nation ON n_nationkey = p_size % 25 WHERE {parts} AND p_size % 2 = 0 AND n_regionkey = 1
 UNION SELECT DISTINCT 5000 + CAST(substr(p_brand, 7) AS BIGINT), {M.TRANSACTION} FROM part WHERE {parts} AND (5000 + CAST(substr(p_brand, 7) AS BIGINT)) % 5 = 1),
sup(d, a) AS (SELECT child, parent FROM up UNION SELECT s.d, u.parent FROM sup s JOIN up u ON s.a = u.child),
prox(concept, parent) AS (SELECT d, a FROM sup s WHERE NOT EXISTS (SELECT 1 FROM sup x JOIN sup y ON x.a = y.d WHERE x.d = s.d AND y.a = s.a))"""


def stated(parts: str = "true") -> str:
    """The attributes of the normal forms."""
    return f"""SELECT {M.PART} + p_partkey AS concept, 1 AS grp, {M.HAS_SUPPLIER}::BIGINT AS type_id, 3000::BIGINT + p_size % 25 AS destination_id FROM part WHERE {parts}
 UNION ALL SELECT {M.PART} + p_partkey, 0, {M.PLACED_BY}, 3000 + p_size % 25 FROM part WHERE {parts} AND p_size % 2 = 0
 UNION ALL SELECT {M.PART} + p_partkey, 0, {M.PLACED_BY}, 2000 + CAST(substr(p_brand, 7) AS BIGINT) % 5 FROM part JOIN nation ON n_nationkey = p_size % 25 WHERE {parts} AND NOT (p_size % 2 = 0 AND n_regionkey = CAST(substr(p_brand, 7) AS BIGINT) % 5)
 UNION ALL SELECT DISTINCT 5000 + CAST(substr(p_brand, 7) AS BIGINT), 0, {M.PLACED_BY}, 2000 + CAST(substr(p_brand, 7) AS BIGINT) % 5 FROM part WHERE {parts}"""


@query(f", {taxonomy()} SELECT d AS sub, a AS sup FROM sup")
def el_subsumption_all(spark, sf_dir):
    return as_items(el.classify(M.axioms(spark, sf_dir)).subsumption, "sub", "sup")


@query(f", {taxonomy()} SELECT concept, parent FROM prox")
def nnf_is_a_all(spark, sf_dir):
    return as_items(nnf.normal_forms(M.axioms(spark, sf_dir)).is_a, "concept", "parent")


@query(stated())
def nnf_attributes_all(spark, sf_dir):
    return nnf.normal_forms(M.axioms(spark, sf_dir)).attributes.select(*[I.item_identifier(F.col(c)).alias(c) for c in ("concept", "type_id", "destination_id")], "grp")
