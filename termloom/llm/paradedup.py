"""Substring deduplication by paragraph MinHash banding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import passages, shingles
from termloom.llm.common import Cuts, fresh, map_texts
from termloom.llm.simjoin import sieve, similar_components

#: Minwise values in a band, and the probability at most with which a pair at the threshold shares no band.
ROWS, MISS = 2, 1e-4
#: Minwise values that a paragraph may need; a threshold below 0.35 would take more.
MOST = 150
#: Bins of a paragraph's sketch.
BINS = 128
#: Bytes of a paragraph's digest.
DIGEST = 12


def tune(threshold: float, miss: float = MISS, rows: int = ROWS) -> int:
    """The fewest bands of `rows` values that miss a pair at the threshold with probability `miss` at most."""
    return int(np.ceil(np.log(miss) / np.log(1 - threshold**rows)))


def spans(text: str) -> list[tuple[int, int]]:
    """Starts and ends of the paragraphs, which newlines separate."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """sets x bands: a hash of each band's number and ROWS minwise values."""
    bands = values.shape[1] // ROWS
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(values), 1))
    for r in range(ROWS):
        out = shingles.mix(out * shingles.BASE + values[:, r::ROWS][:, :bands])
    return out.view(np.int64)


def paragraphs(texts: list[str], k: int, min_words: int, hasher: shingles.MinHash) -> list[list]:
    """For each text: position, start, end, words, digest, size of the set, band keys and sketch of its paragraphs of `min_words` or more."""
    found: list[list] = [[] for _ in texts]
    where, parts = [], []
    for i, t in enumerate(texts):
        for pos, (a, b) in enumerate(spans(t)):
            if b - a >= 2 * min_words - 1 and (n := len(t[a:b].encode().split())) >= min_words:
                where.append((i, pos, a, b, n))
                parts.append(t[a:b])
    if parts:
        groups = shingles.sets(parts, k)
        keys = band_keys(hasher.values(groups))
        for (i, pos, a, b, n), g, v in zip(where, groups, keys, strict=True):
            found[i].append({"pos": pos, "start": a, "end": b, "n_words": n, "digest": shingles.digest(g, DIGEST), "n": len(g), "keys": v, "sketch": shingles.bins(g, BINS)})
    return [found]


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, min_words: int = 30) -> DataFrame:
    """Find paragraphs that repeat, exactly or nearly: sets of k-word shingles with 100 * intersection >= percent * union.

    One row for each paragraph of `min_words` words or more whose class has other paragraphs: the id,
    `g_hash` (xxhash64 of the text), `pos` (of the paragraph), `start`, `end` (code points, end
    excluded), `n_words`, `class_doc`, `class_start` (the class's first paragraph by id, text hash
    and place) and `removed` (all but that one). Rows equal in id and text are one document.

    A null or empty text has no paragraphs. `percent` must be 35 or more. Null ids come last in order. Other columns are not read.
    An empty table gives an empty table. Intermediate tables are written to the shared folder.
    """
    cuts = Cuts(docs.sparkSession, "paradedup")
    bands = tune(percent / 100)
    if bands * ROWS > MOST:
        raise ValueError("the threshold is too low for these bands")
    hasher = shingles.MinHash(ROWS * bands)
    rows = docs.select(F.col(id_col).alias("g_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("g_hash"), F.col(text_col).alias("g_body"))
    found = map_texts(rows, "g_id", "g_body", lambda ts: paragraphs(ts, k, min_words, hasher), "p array<struct<pos:int,start:int,end:int,n_words:int,digest:binary,n:int,keys:array<long>,sketch:binary>>", carry=("g_hash",), budget=1 << 18)
    signed = found.select("g_id", "g_hash", F.inline("p"))
    who = F.struct(F.col("g_id").isNull().alias("no_id"), "g_id", "g_hash", "pos", "start")
    signed = cuts.cut(signed)
    reps = signed.groupBy("digest").agg(F.min(who).alias("who"))
    first = signed.join(reps, "digest").filter(who.eqNullSafe(F.col("who"))).dropDuplicates(["digest"])
    # numbers are given as the table is written and stay: no later stage makes them anew
    items = cuts.cut(first.select(F.monotonically_increasing_id().alias("node"), "digest", "who", "n", "keys", "sketch"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = items.select("node", "who").join(nodes, "node").groupBy(F.col("who.g_id").alias("w_id"), F.col("who.g_hash").alias("w_hash")).agg(F.collect_list(F.struct(F.col("who.pos").alias("pos"), "node")).alias("p"))
        near = sieve(rows, "g_hash", wanted, "w_hash")
        lines = near.join(wanted, near["g_id"].eqNullSafe(wanted["w_id"]) & (near["g_hash"] == wanted["w_hash"])).select(F.split("g_body", "\n", -1).alias("lines"), "p")
        return lines.select("lines", F.inline("p")).select("node", F.get("lines", "pos").alias("text"))

    labels = similar_components(items, texts_of, k, percent, cuts)
    named = cuts.cut(items.select("node", "digest", "who").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"), "who"))
    heads = named.groupBy("label").agg(F.min("who").alias("head"))
    of_node = named.join(heads, "label").select("digest", "label", "head")
    plain = signed.select("g_id", "g_hash", "pos", "start", "end", "n_words", "digest").distinct()
    sizes = plain.groupBy("digest").count().join(of_node, "digest")
    classes = cuts.cut(sizes.groupBy("label").agg(F.sum("count").alias("n"), F.first("head").alias("head")).filter("n > 1").join(of_node.select("label", "digest"), "label").select("digest", "head"))
    out = plain.join(classes, "digest")
    return cuts.settle(out.select(
        F.col("g_id").alias(id_col), "g_hash", "pos", "start", "end", "n_words",
        F.col("head.g_id").alias("class_doc"), F.col("head.start").alias("class_start"),
        (~who.eqNullSafe(F.col("head"))).alias("removed"),
    ))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 50) -> DataFrame:
    """Passages that repeat inside longer lines or over several short ones, in the columns of repeated_paragraphs(); `pos` is null.

    They are runs of `run` words or more that repeat word for word (see passages.repeated_runs); of
    an edited passage only the unedited stretches of that length are found.
    """
    out = passages.repeated_runs(docs, id_col, text_col, run)
    return out.select(id_col, "g_hash", F.lit(None).cast("int").alias("pos"), "start", "end", "n_words", "class_doc", "class_start", "removed")


def paragraph_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with all columns, without their removed paragraphs; the other paragraphs stay in order, joined by newlines."""
    th, wid, wh, gone, lines = fresh(docs, "g_texthash", "g_wid", "g_whash", "g_gone", "g_lines")
    drop = repeated_paragraphs(docs, id_col, text_col, **options).filter("removed").groupBy(F.col(id_col).alias(wid), F.col("g_hash").alias(wh)).agg(F.collect_set("pos").alias(gone))
    hashed = docs.withColumns({th: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), lines: F.split(F.col(f"`{text_col}`"), "\n", -1)})
    out = hashed.join(drop, F.col(f"`{id_col}`").eqNullSafe(F.col(wid)) & (F.col(th) == F.col(wh)), "left")
    kept: Column = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(F.col(lines), i)), "\n")
    return out.select(*[(F.when(F.col(gone).isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
