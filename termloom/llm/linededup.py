"""Line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ASCII_SPACE, LOWER, UPPER, fresh

#: A frequent line may be in a third of all documents; its rows are spread over so many join keys.
SALTS = 16


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop lines whose key has `min_chars` code points or more and is in `min_docs` documents or more.

    The document with the largest id that holds such a key keeps all its lines of that key.
    Returns every column of `docs` with the text replaced, then `n_lines` (before dropping),
    `n_dropped`; where `docs` has columns of these names already, an underscore goes before ours.

    A null text counts as empty and becomes "". Rows without an id count as one document, which is
    never the one that keeps. Rows with the same id count as one document; each has its own lines
    judged. An empty table gives an empty table. Ties cannot occur: ids decide.
    """
    gid, th, pos, line, kh, salt, lines, gone, keep, n_docs = fresh(docs, "g_id", "g_text", "g_pos", "g_line", "g_key", "g_salt", "g_lines", "g_gone", "g_keep", "g_docs")
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = (
        docs.select(F.col(id_col).alias(gid), F.xxhash64(text).alias(th), F.posexplode(F.split(text, "\n", -1)).alias(pos, line))
        .withColumn(line, line_key(F.col(line)))
        .filter(F.char_length(line) >= min_chars)
        .select(gid, th, pos, F.unhex(F.md5(line)).alias(kh))
    )
    # documents first, keys second: neither shuffle meets a hot key, as the second is summed before it
    frequent = (
        keyed.select(kh, gid).distinct()
        .groupBy(kh).agg(F.count(F.lit(1)).alias(n_docs), F.max(gid).alias(keep))
        .filter(F.col(n_docs) >= min_docs)
        .select(kh, keep, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    )
    dropped = (
        keyed.withColumn(salt, F.pmod(F.hash(gid, pos), F.lit(SALTS)))
        .join(frequent, [kh, salt])
        .filter(~F.col(gid).eqNullSafe(F.col(keep)))
        .groupBy(gid, th).agg(F.collect_set(pos).alias(gone))
    )
    out = docs.withColumns({lines: F.split(text, "\n", -1), th: F.xxhash64(text)}).alias("d").join(
        dropped.alias("x"), F.col(f"d.{id_col}").eqNullSafe(F.col(f"x.{gid}")) & (F.col(f"d.{th}") == F.col(f"x.{th}")), "left"
    )
    gone_c, lines_c = F.coalesce(F.col(gone), F.array().cast("array<int>")), F.col(lines)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines_c) - 1), gone_c), lambda i: F.get(lines_c, i)), "\n")
    kept = F.when(F.col(gone).isNull(), F.coalesce(F.col(f"d.{text_col}"), F.lit(""))).otherwise(kept)
    return out.select(
        *[kept.alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c) for c in docs.columns],
        F.size(lines_c).cast("long").alias(n_lines),
        F.size(gone_c).cast("long").alias(n_dropped),
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.line, k.pos, f.keep IS NOT NULL AND f.keep <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
