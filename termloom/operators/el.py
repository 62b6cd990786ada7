"""EL classification: completion rules as joins, run to a fixpoint on what is new in each round."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.cuts import Cuts
from termloom.operators import owl
from termloom.operators.graph import transitive_closure


def flat_rows(axioms: DataFrame, sound: bool = False) -> DataFrame:
    """Parse and normalise axioms (columns id, owlExpression) in parallel, one row for each piece."""
    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(owl.FLAT)
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}

    def run(batches):
        for batch in batches:
            rows = [r for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in owl.flatten(i, t or "", sound)]
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=types[f.dataType.simpleString()]) for c, f in zip(cols, schema, strict=True)], names=schema.names)

    return axioms.select(F.col("id").cast("string"), "owlExpression").mapInArrow(run, schema)


@dataclass
class Classification:
    """subsumption (sub, sup): strict, named only. named (concept). skipped (kind, id): one row a visit. errors (text)."""

    subsumption: DataFrame
    named: DataFrame
    skipped: DataFrame
    errors: DataFrame
    flat: DataFrame

    def subsumers(self, concept: int) -> DataFrame:
        return self.subsumption.filter(F.col("sub") == concept).select(F.col("sup").alias("concept"))

    def is_subsumed_by(self, sub: int, sup: int) -> bool:
        return sub == sup or not self.subsumption.filter((F.col("sub") == sub) & (F.col("sup") == sup)).isEmpty()

    def equivalent_to(self, concept: int) -> DataFrame:
        back = self.subsumption.filter(F.col("sup") == concept).select(F.col("sub").alias("concept"))
        return self.subsumers(concept).join(back, "concept", "left_semi")


def _minus(df: DataFrame, *known: DataFrame) -> DataFrame:
    out = df.distinct()
    for k in known:
        out = out.join(k, df.columns, "left_anti")
    return out


def saturate(flat: DataFrame, cuts: Cuts) -> DataFrame:
    """(x, a): x is below a, for every class name x. Atomic subsumptions are closed once by path doubling;
    each round then derives from new facts only, and what it derives is closed at once, so the rounds
    follow the depth of existential reasoning and not that of the hierarchy."""
    part = lambda kind: flat.filter(F.col("kind") == kind)
    names = part("class").select("a").distinct()
    nf1 = part("nf1").select("rule", "a", "b", "n").distinct()
    atomic = nf1.filter("n = 1").select(F.col("a").alias("child"), F.col("b").alias("parent"))
    closed = transitive_closure(atomic, cuts)
    up = cuts.cut(closed.select(F.col("descendant").alias("a"), F.col("ancestor").alias("up")).union(names.select("a", F.col("a").alias("up"))).distinct())
    many = cuts.cut(nf1.filter("n > 1"))
    nf2 = cuts.cut(part("nf2").select("a", "r", "b").distinct())
    nf3 = cuts.cut(part("nf3").select("a", "r", F.col("b").alias("c")).distinct())
    roles, chains = cuts.cut(part("role").select(F.col("a").alias("r"), F.col("b").alias("t")).distinct()), cuts.cut(part("chain").select(F.col("a").alias("r"), F.col("b").alias("s"), F.col("r").alias("t")).distinct())
    has_many, has_roles, has_chains = not many.isEmpty(), not roles.isEmpty(), not chains.isEmpty()
    s = cuts.cut(up.select(F.col("a").alias("x"), F.col("up").alias("a")))
    ds, r, dr = s, None, None
    while True:
        # x below a, a below some r.b: a pair
        pairs = ds.join(nf2, "a").select("x", "r", F.col("b").alias("y"))
        if dr is not None:
            if has_roles:
                pairs = pairs.union(dr.join(roles, "r").select("x", F.col("t").alias("r"), "y"))
            if has_chains:
                left = lambda d: d.select("x", "r", F.col("y").alias("z"))
                right = lambda d: d.select(F.col("x").alias("z"), F.col("r").alias("s"), "y")
                step = lambda p, q: left(p).join(chains, "r").join(right(q), ["z", "s"]).select("x", F.col("t").alias("r"), "y")
                pairs = pairs.union(step(dr, r)).union(step(r, dr))
        new_r = cuts.cut(_minus(pairs, *([r] if r is not None else [])))
        all_r = cuts.together(r, new_r) if r is not None else new_r
        # a pair to y, y below a, some r.a below c: x below c
        meets = lambda p, q: p.join(q.select(F.col("x").alias("y"), "a"), "y").join(nf3, ["a", "r"]).select("x", F.col("c").alias("a"))
        found = meets(new_r, s)
        if r is not None:
            found = found.union(meets(r, ds))
        if has_many:
            # all conjuncts of a rule met: count them for the rules that a new fact touches
            touched = ds.join(many, "a").select("x", "rule").distinct()
            met = touched.join(many, "rule").join(s, ["x", "a"]).groupBy("x", "rule", "b", "n").count().filter("count = n")
            found = found.union(met.select("x", F.col("b").alias("a")))
        raised = found.distinct().join(up, "a").select("x", F.col("up").alias("a"))
        new_s = cuts.cut(_minus(raised, s))
        new_any = not new_s.isEmpty()
        if not new_any and new_r.isEmpty():
            return s
        grown = cuts.together(s, new_s) if new_any else s
        s, ds, r, dr = grown, new_s, all_r, new_r


def classify(axioms: DataFrame, sound: bool = False) -> Classification:
    """Classify axioms (columns id, owlExpression). An axiom that does not parse is reported and left out."""
    cuts = Cuts(axioms.sparkSession, "classify")
    flat = cuts.cut(flat_rows(axioms, sound))
    s = saturate(flat, cuts)
    skipped = flat.filter((F.col("kind") == "skipped") & ~F.col("text").startswith("profile ")).select(F.col("text").alias("kind"), F.col("a").alias("id"))
    return Classification(
        s.filter("x > 0 AND a > 0 AND x <> a").select(F.col("x").alias("sub"), F.col("a").alias("sup")),
        flat.filter("kind = 'class' AND a > 0").select(F.col("a").alias("concept")).distinct(),
        skipped, flat.filter("kind = 'error'").select("text"), flat,
    )
