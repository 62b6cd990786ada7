"""A terminology made from the star schema: its entities as concepts, its keys as relationships.

Concepts are composed from item numbers, so a query can give results back as items. The same
projection stands as SQL in PROJECTION, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import constants as K
from termloom.functions import ids as I
from termloom.operators.snapshot import Snapshot

PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ROOT, GEOGRAPHY, PRODUCT, TRANSACTION, ATTRIBUTE = 1000, 1001, 1002, 1003, 1004
LINE, PLACED_BY, HAS_PART, HAS_SUPPLIER, QUANTITY, FLAG = 7000, 7001, 7002, 7003, 7004, 7006
QUALITY, TOXIC, SEGMENT, ENGLISH = 8001, 8002, 8010, 8020
FIXED = [(GEOGRAPHY, ROOT), (PRODUCT, ROOT), (TRANSACTION, ROOT), (ATTRIBUTE, ROOT), (LINE, ATTRIBUTE), (PLACED_BY, ATTRIBUTE), (QUANTITY, ATTRIBUTE), (FLAG, ATTRIBUTE), (HAS_PART, LINE), (HAS_SUPPLIER, LINE)]
FIXED += [(4001 + i, PRODUCT) for i in range(len(PART_TYPES))] + [(6000 + i, TRANSACTION) for i in range(1, 6)]
CUSTOMER, SUPPLIER, PART, ORDER, TEXT = 10_000_000, 20_000_000, 30_000_000, 40_000_000, 50_000_000


def code(item: int) -> int:
    return I.compose_id(item)


def concept(item: Column) -> Column:
    """0, which is no id, stands for null: a join on an id that cannot be null does not compose it once more to test that."""
    return F.coalesce(I.composed_id(item.cast("long")), F.lit(0).cast("long"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ymd(t: Column) -> Column:
    return F.date_format(t, "yyyyMMdd").cast("int")


def type_item(col: str) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in PART_TYPES]), F.col(col)) + 4000


def brand_item(col: str) -> Column:
    return F.substring(F.col(col), 7, 9).cast("int") + 5000


def priority_item(col: str) -> Column:
    return F.substring(F.col(col), 1, 1).cast("int") + 6000


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, active, time, module, defined) of every concept."""
    t = lambda name: read(spark, sf_dir, name)
    plain = lambda df, item, module: df.select(item.cast("long").alias("item"), F.lit(True).alias("active"), F.lit(20240101).alias("time"), F.lit(module).alias("module"), F.lit(False).alias("defined"))
    fixed = spark.createDataFrame([(i, p) for i, p in [(ROOT, 0), *FIXED]], "item long, up long")
    branch = F.when(F.col("item").isin(LINE, PLACED_BY, HAS_PART, HAS_SUPPLIER, QUANTITY, FLAG), ATTRIBUTE).when(F.col("up") == 0, F.col("item")).when(F.col("up") == ROOT, F.col("item")).otherwise(F.col("up"))
    out = fixed.select("item", F.lit(True).alias("active"), F.lit(20240101).alias("time"), branch.cast("int").alias("module"), F.lit(False).alias("defined"))
    out = out.unionByName(plain(t("region"), F.col("r_regionkey") + 2000, GEOGRAPHY)).unionByName(plain(t("nation"), F.col("n_nationkey") + 3000, GEOGRAPHY))
    out = out.unionByName(plain(t("customer"), F.col("c_custkey") + CUSTOMER, GEOGRAPHY)).unionByName(plain(t("supplier"), F.col("s_suppkey") + SUPPLIER, GEOGRAPHY))
    out = out.unionByName(plain(t("part").select("p_brand").distinct(), brand_item("p_brand"), PRODUCT))
    out = out.unionByName(t("part").select((F.col("p_partkey") + PART).alias("item"), F.lit(True).alias("active"), F.lit(20240101).alias("time"), F.lit(PRODUCT).alias("module"), (F.col("p_size") >= 25).alias("defined")))
    return out.unionByName(t("orders").select((F.col("o_orderkey") + ORDER).alias("item"), (F.col("o_orderstatus") != "F").alias("active"), ymd(F.col("o_orderdate")).alias("time"), F.lit(TRANSACTION).alias("module"), F.lit(False).alias("defined")))


def is_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent) as items."""
    t = lambda name: read(spark, sf_dir, name)
    pair = lambda df, a, b: df.select(a.cast("long").alias("child"), b.cast("long").alias("parent"))
    out = spark.createDataFrame(FIXED, "child long, parent long")
    out = out.unionByName(pair(t("region"), F.col("r_regionkey") + 2000, F.lit(GEOGRAPHY))).unionByName(pair(t("nation"), F.col("n_nationkey") + 3000, F.col("n_regionkey") + 2000))
    out = out.unionByName(pair(t("customer"), F.col("c_custkey") + CUSTOMER, F.col("c_nationkey") + 3000)).unionByName(pair(t("supplier"), F.col("s_suppkey") + SUPPLIER, F.col("s_nationkey") + 3000))
    out = out.unionByName(pair(t("part").select("p_brand").distinct(), brand_item("p_brand"), F.lit(PRODUCT)))
    out = out.unionByName(pair(t("part"), F.col("p_partkey") + PART, type_item("p_type"))).unionByName(pair(t("part"), F.col("p_partkey") + PART, brand_item("p_brand")))
    return out.unionByName(pair(t("orders"), F.col("o_orderkey") + ORDER, priority_item("o_orderpriority")))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IS-A rows, orders' customers, and each line's part and supplier in a group of the line's number."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    live, inferred, order = F.col("l_linestatus") == "O", F.col("l_returnflag") != "R", F.col("l_orderkey") + ORDER

    def facts(df: DataFrame, source: Column, other: Column, group: Column, kind: int, active: Column = F.lit(True), inferred: Column = F.lit(True)) -> DataFrame:
        return df.select(source.cast("long").alias("source"), other.cast("long").alias("other"), group.cast("long").alias("relationshipGroup"), F.lit(kind).alias("typeId"), active.alias("active"), inferred.alias("inferred"))

    rows = (
        facts(is_a(spark, sf_dir), F.col("child"), F.col("parent"), F.lit(0), K.IS_A)
        .unionByName(facts(orders, F.col("o_orderkey") + ORDER, F.col("o_custkey") + CUSTOMER, F.lit(0), code(PLACED_BY)))
        .unionByName(facts(lines, order, F.col("l_partkey") + PART, F.col("l_linenumber"), code(HAS_PART), live, inferred))
        .unionByName(facts(lines, order, F.col("l_suppkey") + SUPPLIER, F.col("l_linenumber"), code(HAS_SUPPLIER), live, inferred))
    )
    return rows.select(
        F.lit(None).cast("long").alias("id"), F.lit(20240101).alias("effectiveTime"), "active", F.lit(code(ROOT)).alias("moduleId"), concept(F.col("source")).alias("sourceId"), concept(F.col("other")).alias("destinationId"),
        "relationshipGroup", "typeId", F.when(F.col("inferred"), K.INFERRED).otherwise(K.STATED).alias("characteristicTypeId"), F.lit(K.EXISTENTIAL).alias("modifierId"),
    )


def concretes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's quantity as a number and its return flag as a string, in the line's group."""
    number = F.struct(F.lit("Number").alias("value_type"), F.col("l_quantity").cast("int").cast("string").alias("value"), F.col("l_quantity").cast("double").alias("num"))
    text = F.struct(F.lit("String").alias("value_type"), F.col("l_returnflag").alias("value"), F.lit(None).cast("double").alias("num"))
    both = F.array(F.struct(F.lit(code(QUANTITY)).alias("typeId"), number.alias("value")), F.struct(F.lit(code(FLAG)).alias("typeId"), text.alias("value")))
    return read(spark, sf_dir, "lineitem").select(
        concept(F.col("l_orderkey") + ORDER).alias("sourceId"), F.col("l_linenumber").cast("long").alias("relationshipGroup"), (F.col("l_linestatus") == "O").alias("active"),
        F.when(F.col("l_returnflag") != "R", K.INFERRED).otherwise(K.STATED).alias("characteristicTypeId"), F.inline(both).alias("typeId", "value"),
    )


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def texts(df: DataFrame, item: Column, about: Column, kind: int, term: Column, language: Column = F.lit("en")) -> DataFrame:
        return df.select(item.cast("long").alias("item"), about.cast("long").alias("about"), language.alias("languageCode"), F.lit(kind).alias("typeId"), term.alias("term"))

    part, nation, region = (read(spark, sf_dir, t) for t in ("part", "nation", "region"))
    number, about = F.col("p_partkey") * 10 + 300_000_000, F.col("p_partkey") + PART
    rows = (
        texts(part, number, about, K.FSN, F.concat("p_name", F.lit(" (part)")))
        .unionByName(texts(part, number + 1, about, K.SYNONYM, F.col("p_name")))
        .unionByName(texts(part, number + 2, about, K.SYNONYM, F.concat("p_brand", F.lit(" "), "p_name")))
        .unionByName(texts(nation, F.col("n_nationkey") * 10 + 3_000_000, F.col("n_nationkey") + 3000, K.FSN, F.concat("n_name", F.lit(" (nation)"))))
        .unionByName(texts(region, F.col("r_regionkey") * 10 + 2_000_000, F.col("r_regionkey") + 2000, K.FSN, F.concat("r_name", F.lit(" (region)"))))
        .unionByName(texts(read(spark, sf_dir, "documents"), F.col("doc_id") + TEXT, F.col("doc_id") + TEXT, K.TEXT_DEFINITION, F.col("text"), F.col("lang")))
    )
    return rows.select(
        I.composed_id(F.col("item"), "Description").alias("id"), F.lit(20240101).alias("effectiveTime"), F.lit(True).alias("active"), F.lit(code(ROOT)).alias("moduleId"), concept(F.col("about")).alias("conceptId"),
        "languageCode", "typeId", "term", F.lit(K.SYNONYM).alias("caseSignificanceId"),
    )


def simple_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts by quality and toxicity (descriptions), customers by segment (concepts)."""
    labels = read(spark, sf_dir, "labels")
    texts = labels.filter("quality = 1").select(F.lit(code(QUALITY)).alias("refsetId"), "doc_id").unionByName(labels.filter("toxic = 1").select(F.lit(code(TOXIC)).alias("refsetId"), "doc_id"))
    segment = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(SEGMENTS, 1) for x in (s, code(SEGMENT + i))]), F.col("c_mktsegment"))
    customers = read(spark, sf_dir, "customer").select(segment.alias("refsetId"), concept(F.col("c_custkey") + CUSTOMER).alias("referencedComponentId"))
    return texts.select("refsetId", I.composed_id(F.col("doc_id") + TEXT, "Description").alias("referencedComponentId")).unionByName(customers).withColumn("active", F.lit(True))


def language_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a part's two synonyms the plain name is preferred, the one with the brand acceptable; of large parts the other way round."""
    swap = F.when(F.col("p_size") > 40, 1).otherwise(0)
    rows = read(spark, sf_dir, "part").select((F.col("p_partkey") * 10 + 300_000_001).alias("item"), swap.alias("swap"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    rows = rows.select(I.composed_id(F.col("item") + F.col("n"), "Description").alias("referencedComponentId"), F.when(F.col("n") == F.col("swap"), K.PREFERRED).otherwise(K.ACCEPTABLE).alias("acceptabilityId"))
    return rows.withColumns({"id": F.col("referencedComponentId").cast("string"), "refsetId": F.lit(code(ENGLISH)), "active": F.lit(True)})


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(
        concept(F.col("item")).alias("id"), F.col("time").alias("effectiveTime"), "active", concept(F.col("module")).alias("moduleId"),
        F.when(F.col("defined"), K.DEFINED).otherwise(K.PRIMITIVE).alias("definitionStatusId"),
    )


def snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The whole terminology; each table is planned when a query first asks for it."""
    made = {"concept": concepts, "relationship": relationships, "concrete": concretes, "description": descriptions, "simple": simple_members, "language": language_members}
    return Snapshot(spark, {name: (lambda f=f: f(spark, sf_dir)) for name, f in made.items()})


def axioms(spark: SparkSession, sf_dir: str, first: bool = False) -> DataFrame:
    """OWL axioms (id, owlExpression) over the geography and the products: parts below their type and brand, groups
    and values outside groups, a role hierarchy, and a general inclusion. Orders are left out. `first` takes parts
    below 300 and customers and suppliers below 200 only, as the SQL of three queries does."""
    ref = lambda c: F.concat(F.lit(":"), concept(c).cast("string"))
    up, part = is_a(spark, sf_dir).filter(F.col("child") < ORDER), read(spark, sf_dir, "part")
    if first:
        up = up.filter((F.col("child") < PART + 300) & ~F.col("child").between(CUSTOMER + 200, SUPPLIER - 1) & ~F.col("child").between(SUPPLIER + 200, PART - 1))
        part = part.filter("p_partkey < 300")
    tree = up.select(F.concat(F.lit("SubClassOf("), ref(F.col("child")), F.lit(" "), ref(F.col("parent")), F.lit(")")).alias("owlExpression"))
    some = lambda role, filler: F.concat(F.lit(f"ObjectSomeValuesFrom(:{code(role)} "), filler, F.lit(")"))
    nation = ref(F.pmod(F.col("p_size"), F.lit(25)) + 3000)
    grouped = part.select(F.concat(F.lit("SubClassOf("), ref(F.col("p_partkey") + PART), F.lit(f" ObjectSomeValuesFrom(:{K.ROLE_GROUP} "), some(HAS_SUPPLIER, nation), F.lit("))")).alias("owlExpression"))
    brand = part.select("p_brand").distinct().select(F.concat(F.lit("SubClassOf("), ref(brand_item("p_brand")), F.lit(" "), some(PLACED_BY, ref(F.pmod(brand_item("p_brand"), F.lit(5)) + 2000)), F.lit(")")).alias("owlExpression"))
    own = part.filter("p_size % 2 = 0").select(F.concat(F.lit("SubClassOf("), ref(F.col("p_partkey") + PART), F.lit(" "), some(PLACED_BY, nation), F.lit(")")).alias("owlExpression"))
    fixed = [
        f"SubObjectPropertyOf(:{code(HAS_SUPPLIER)} :{code(LINE)})",
        f"SubClassOf(ObjectSomeValuesFrom(:{code(PLACED_BY)} :{code(2001)}) :{code(TRANSACTION)})",
    ]
    out = tree.unionByName(grouped).unionByName(brand).unionByName(own).unionByName(spark.createDataFrame([(x,) for x in fixed], "owlExpression string"))
    return out.select(F.md5("owlExpression").alias("id"), "owlExpression")


PROJECTION = f"""
fixed(child, parent) AS (VALUES {", ".join(f"({a}::BIGINT, {b}::BIGINT)" for a, b in FIXED)}),
types(t, i) AS (VALUES {", ".join(f"('{t}', {4001 + i}::BIGINT)" for i, t in enumerate(PART_TYPES))}),
brands AS (SELECT DISTINCT 5000 + CAST(substr(p_brand, 7) AS BIGINT) AS item FROM part),
isa(child, parent) AS (
  SELECT * FROM fixed UNION ALL SELECT 2000 + r_regionkey, {GEOGRAPHY} FROM region UNION ALL SELECT 3000 + n_nationkey, 2000 + n_regionkey FROM nation
  UNION ALL SELECT {CUSTOMER} + c_custkey, 3000 + c_nationkey FROM customer UNION ALL SELECT {SUPPLIER} + s_suppkey, 3000 + s_nationkey FROM supplier
  UNION ALL SELECT item, {PRODUCT} FROM brands UNION ALL SELECT {PART} + p_partkey, i FROM part JOIN types ON p_type = t
  UNION ALL SELECT {PART} + p_partkey, 5000 + CAST(substr(p_brand, 7) AS BIGINT) FROM part
  UNION ALL SELECT {ORDER} + o_orderkey, 6000 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) FROM orders),
concept(item, active, time, module, defined) AS (
  SELECT {ROOT}::BIGINT, true, 20240101, {ROOT}, false
  UNION ALL SELECT child, true, 20240101, CASE WHEN child BETWEEN 7000 AND 7999 THEN {ATTRIBUTE} WHEN parent = {ROOT} THEN child ELSE parent END, false FROM fixed
  UNION ALL SELECT 2000 + r_regionkey, true, 20240101, {GEOGRAPHY}, false FROM region UNION ALL SELECT 3000 + n_nationkey, true, 20240101, {GEOGRAPHY}, false FROM nation
  UNION ALL SELECT {CUSTOMER} + c_custkey, true, 20240101, {GEOGRAPHY}, false FROM customer UNION ALL SELECT {SUPPLIER} + s_suppkey, true, 20240101, {GEOGRAPHY}, false FROM supplier
  UNION ALL SELECT item, true, 20240101, {PRODUCT}, false FROM brands UNION ALL SELECT {PART} + p_partkey, true, 20240101, {PRODUCT}, p_size >= 25 FROM part
  UNION ALL SELECT {ORDER} + o_orderkey, o_orderstatus <> 'F', CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER), {TRANSACTION}, false FROM orders),
lines AS (SELECT {ORDER} + l_orderkey AS src, l_linenumber AS grp, {PART} + l_partkey AS part, {SUPPLIER} + l_suppkey AS supp, l_quantity AS qty, l_returnflag AS flag FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R'),
rel(src, dst, grp, type) AS (
  SELECT {ORDER} + o_orderkey, {CUSTOMER} + o_custkey, 0, {PLACED_BY} FROM orders UNION ALL SELECT src, part, grp, {HAS_PART} FROM lines UNION ALL SELECT src, supp, grp, {HAS_SUPPLIER} FROM lines),
clo(d, a) AS (SELECT child, parent FROM isa UNION SELECT c.d, i.parent FROM clo c JOIN isa i ON c.a = i.child)
"""
