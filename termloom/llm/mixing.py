"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import fresh


def uniform(seed: int, *cols: Column) -> Column:
    """A number between 0 and 1, both excluded, from the hash of the seed and the columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def poisson_table(rate: Column) -> Column:
    """Cumulative Poisson probabilities for 0, 1, 2 ... to where the rest is below 2^-53; sums of logarithms, so that no rate underflows."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.when(k > 0, F.ln(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)
        p = F.when(rate > 0, F.exp(k * F.ln(rate) - rate - log)).otherwise(F.when(k == 0, 1.0).otherwise(0.0))
        total = acc["sum"] + p
        return F.struct(log.alias("log"), total.alias("sum"), F.array_append(acc["out"], total).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["out"])


def poisson_mix(docs: DataFrame, weights: Mapping[str, float], other_weight: float = 0.0, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """Replicate documents so that each source's share of the characters is its weight in expectation, and shuffle all rows.

    A source's mean repetition rate is epochs * all characters * its weight / its characters; each
    document's count inverts the Poisson distribution of that mean at a uniform number hashed from
    seed and id. Sources that `weights` does not name, null among them, form one pool with
    `other_weight`. Weights of sources without characters are left out and the others scaled to sum 1.

    Returns the columns of `docs`, then `copy_no` (1, 2 ...), `n_copies` and `shuffle_key`; an
    underscore goes before a name that `docs` has. Rows are dealt to partitions by the hash of
    `shuffle_key` and sorted by it. A null text has no characters but may be repeated. Rows with
    equal ids (or null ids) draw equal counts. An empty table gives an empty table.

    Only the rates are broadcast: one row for each entry of `weights` at most, and the pool's.
    """
    if not weights and other_weight <= 0:
        raise ValueError("some weight must be positive")
    if min([*weights.values(), other_weight]) < 0:
        raise ValueError("weights must not be negative")
    group, size, want, rate, cdf, u, n = fresh(docs, "g_group", "g_size", "g_want", "g_rate", "g_cdf", "g_u", "g_n")
    copy_no, n_copies, key = fresh(docs, "copy_no", "n_copies", "shuffle_key")
    named = F.col(source_col).isin(*weights) if weights else F.lit(False)
    groups = F.when(named, F.concat(F.lit("="), F.col(source_col))).otherwise(F.lit("*"))
    wants = F.create_map(*[x for k, v in [*((f"={k}", v) for k, v in weights.items()), ("*", other_weight)] for x in (F.lit(k), F.lit(float(v)))])
    sizes = (
        docs.groupBy(groups.alias(group)).agg(F.sum(F.coalesce(F.char_length(text_col), F.lit(0))).cast("double").alias(size))
        .withColumn(want, F.when(F.col(size) > 0, F.element_at(wants, F.col(group))).otherwise(0.0))
    )
    sums = sizes.agg(F.sum(size).alias("all_size"), F.sum(want).alias("all_want"))
    rates = (
        sizes.crossJoin(F.broadcast(sums))  # a single row beside len(weights) + 1 rows
        .withColumn(rate, F.when(F.col(want) > 0, F.lit(float(epochs)) * F.col("all_size") * F.col(want) / F.col("all_want") / F.col(size)).otherwise(0.0))
        .select(group, poisson_table(F.col(rate)).alias(cdf))
    )
    drawn = (
        docs.withColumns({group: groups, u: uniform(seed, F.col(id_col))})
        .join(F.broadcast(rates), group)
        .withColumn(n, F.size(F.filter(cdf, lambda c: c <= F.col(u))))
        .filter(F.col(n) > 0)
    )
    return (
        drawn.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy_no), F.col(n).alias(n_copies))
        .withColumn(key, F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy_no).cast("string"))), 1, 15), 16, 10).cast("long"))
        .repartition(F.col(key))
        .sortWithinPartitions(key)
    )


#: The mixture of the registered query: the large web source held down, three sources raised, the rest as one pool.
WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.08}
OTHER = 0.52

ORACLE = """
WITH w(source, want) AS (VALUES ('src0', 0.20::DOUBLE), ('src1', 0.10), ('src2', 0.10), ('src3', 0.08)),
d AS (SELECT d.*, coalesce('=' || w.source, '*') AS g, coalesce(w.want, 0.52::DOUBLE) AS want FROM documents d LEFT JOIN w ON d.source = w.source),
s AS (SELECT g, any_value(want) AS want, sum(coalesce(length(text), 0))::DOUBLE AS size FROM d GROUP BY g HAVING sum(coalesce(length(text), 0)) > 0),
r AS (SELECT g, (SELECT sum(size) FROM s) * want / (SELECT sum(want) FROM s) / size AS rate FROM s),
p AS (SELECT g, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS cdf FROM r, generate_series(0, 200) t(k)),
u AS (SELECT doc_id, source, text, g, (CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d),
n AS (SELECT u.doc_id, u.source, u.text, (SELECT count(*) FROM p WHERE p.g = u.g AND p.cdf <= u.u)::INTEGER AS n FROM u)
SELECT doc_id, source, text, c::INTEGER AS copy_no, n AS n_copies,
  CAST('0x' || substr(md5('order17:' || doc_id || ':' || c), 1, 15) AS BIGINT) AS shuffle_key
FROM (SELECT doc_id, source, text, n, unnest(generate_series(1, n)) AS c FROM n WHERE n > 0)
"""
