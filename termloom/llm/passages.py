"""Runs of words that stand more than once in the documents, wherever lines begin and end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm import shingles
from termloom.llm.common import Cuts, map_texts, slices
from termloom.llm.simjoin import sieve


def windows(texts: list[str], run: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each text: the place of its first word among the words of all, and of each window of `run` words a hash and a mark.

    The mark is the least hash of the half as long word runs inside: windows of equal words have
    equal marks, and neighbours mostly share theirs.
    """
    h, ends = shingles.words(texts)
    half = (run + 1) // 2
    least = grams = shingles.grams(h, half)
    whole = shingles.mix(grams[: max(len(h) - run + 1, 0)] * shingles.BASE + grams[run - half :][: max(len(h) - run + 1, 0)])
    span, step = run - half + 1, 1
    while 2 * step <= span:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    if step < span:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    out, start = [], 0
    for end in ends.tolist():
        n = max(end - start - run + 1, 0)
        out.append((start, whole[start : start + n].view(np.int64), least[start : start + n].view(np.int64)))
        start = end
    return out


def marks(texts: list[str], run: int) -> list[list]:
    """The marks of each text, and whether one of its windows stands there twice."""
    out = []
    for _, whole, least in windows(texts, run):
        _, first, times = np.unique(whole, return_index=True, return_counts=True)
        twice = np.unique(least[first[times > 1]])
        found = np.unique(least)
        out.append([{"mark": m, "twice": t} for m, t in zip(found.tolist(), np.isin(found, twice).tolist(), strict=True)])
    return [out]


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 50) -> DataFrame:
    """Find every run of `run` words or more all of whose windows of `run` words stand elsewhere too, in another document or the same.

    Words are compared with A-Z lower-cased; what white space is between them does not count. One
    row for each longest such run: the id, `g_hash`, `start`, `end` (code points, end excluded),
    `n_words`, `class_doc`, `class_start` (where its first window stands first, by id, text hash and
    place) and `removed`: runs of first occurrences and of later ones are kept apart. Rows equal in id
    and text are one document. Windows are counted, not paired, so a group's size does not matter:

    1. Each document gives its windows' marks, about two for each run // 2 words; marks that stand in one text, once, drop out.
    2. Equal texts are one text. Of texts with a mark that is left, and of those that several documents hold, neighbouring windows
       of one mark make a segment. Of a segment that stands twice all windows do; inside a passage that repeats, all segments do.
    3. Only where a mark has several segments, at the ends of passages, are windows counted, once for each different segment.
    """
    cuts = Cuts(docs.sparkSession, "passages")
    rows = docs.select(F.col(id_col).alias("g_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("g_hash"), F.col(text_col).alias("g_body"))
    found = map_texts(rows, "g_id", "g_body", lambda ts: marks(ts, run), "p array<struct<mark:long,twice:boolean>>", carry=("g_hash",), budget=1 << 18)
    found = cuts.cut(found.filter(F.size("p") > 0))
    who = F.struct(F.col("g_id").isNull().alias("no_id"), "g_id")
    holders = cuts.cut(found.select("g_id", "g_hash").distinct())
    firsts = holders.groupBy("g_hash").agg(F.min(who).alias("first"), (F.count(F.lit(1)) > 1).alias("many"))
    marked = found.select("g_hash", F.inline("p"))
    shared = cuts.cut(marked.groupBy("mark").agg(F.min("g_hash").alias("a"), F.max("g_hash").alias("b"), F.bool_or("twice").alias("twice")).filter("a <> b OR twice").select("mark"))
    hits = marked.distinct().join(shared, "mark").groupBy("g_hash").agg(F.collect_list("mark").alias("marks"))
    wanted = firsts.join(hits, "g_hash", "left").filter("many OR marks IS NOT NULL").select(F.col("g_hash").alias("w_hash"), "first", "many", "marks")
    # numbers in the order of ids and hashes, given as the table is written
    wanted = cuts.cut(wanted.orderBy("first", "w_hash").select(F.monotonically_increasing_id().alias("doc"), "*"))
    cuts.drop(shared, found)
    near = sieve(rows, "g_hash", wanted, "w_hash")
    texts = near.join(wanted, (near["g_hash"] == wanted["w_hash"]) & near["g_id"].eqNullSafe(wanted["first.g_id"])).select("doc", "g_body", "many", "marks")
    made = cuts.cut(texts.mapInArrow(_segments_of(run), SEGMENT))
    place = F.struct("doc", "at", "start")
    segs = made.groupBy("mark", "seg").agg(F.min(place).alias("head"), F.max(F.struct("doc", "at")).alias("last"), F.bool_or("many").alias("held"), F.bool_or("twice").alias("twice"), F.max("n").alias("n"))
    again = (F.col("head.doc") != F.col("last.doc")) | (F.col("head.at") != F.col("last.at")) | F.col("held")
    segs = cuts.cut(segs.select("mark", "seg", "head", "n", "twice", again.alias("again")))
    mixed = cuts.cut(segs.groupBy("mark").agg(F.count(F.lit(1)).alias("c"), F.bool_or("twice").alias("t")).filter("c > 1 OR t").select("mark"))
    whole = segs.filter("again").join(mixed, "mark", "left_anti").select("seg", F.col("head").alias("seg_head"), F.lit(True).alias("own"), F.lit(0).alias("low"), (F.col("n") - 1).alias("high"), "head")
    found, *own_rows = _pieces(made, segs.join(mixed, "mark", "left_semi"), cuts)
    pieces = cuts.cut(whole.unionByName(found))
    occurs = made.select("doc", "many", "at", "seg", "start", "s", "e").join(pieces, "seg")
    first = F.col("own") & (F.col("doc") == F.col("seg_head.doc")) & (F.col("at") == F.col("seg_head.at"))
    repeated = cuts.cut(occurs.select("doc", "many", (F.col("at") + F.col("low")).alias("at"), (F.col("at") + F.col("high")).alias("to"), (F.col("start") + F.get("s", "low")).alias("start"), (F.col("start") + F.get("e", "high")).alias("end"), "head", (~first).alias("removed")))
    cuts.drop(made, segs, mixed, pieces, *own_rows)
    lead = F.min(F.struct("at", "start", "head")).alias("f")
    extent = (F.max("end").alias("end"), (F.max("to") - F.min("at") + run).alias("n_words"))
    numbers = wanted.select("doc", "w_hash", "first")
    # runs of the documents that hold a text first: pieces follow each other without a gap
    ordered = Window.partitionBy("doc", "removed").orderBy("at")
    opens = F.coalesce(F.col("at") > F.lag("to").over(ordered) + 1, F.lit(True)).cast("int")
    own = repeated.withColumn("opens", opens).withColumn("island", F.sum("opens").over(ordered)).groupBy("doc", "removed", "island").agg(lead, *extent).join(numbers, "doc").select(F.col("first.g_id").alias("g_id"), F.col("w_hash").alias("g_hash"), "f", "end", "n_words", "removed")
    # the others that hold it: all of it stands elsewhere first
    copies = repeated.filter("many").groupBy("doc").agg(lead, *extent).join(numbers, "doc")
    other = holders.join(copies, (F.col("g_hash") == F.col("w_hash")) & ~F.col("g_id").eqNullSafe(F.col("first.g_id"))).select("g_id", "g_hash", "f", "end", "n_words", F.lit(True).alias("removed"))
    heads = wanted.select(F.col("doc").alias("h_doc"), F.col("first.g_id").alias("class_doc"))
    out = own.unionByName(other).join(heads, F.col("f.head.doc") == F.col("h_doc"))
    return cuts.settle(out.select(F.col("g_id").alias(id_col), "g_hash", "f.start", "end", "n_words", "class_doc", F.col("f.head.start").alias("class_start"), "removed"))


def _pieces(made: DataFrame, segs: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame]:
    """(seg, seg_head, own, low, high, head): of segments whose marks others share, the stretches of windows that stand elsewhere too.

    `own`: in its first occurrence the segment is where these windows stand first. Also returns the written windows.
    """
    heads = segs.select(F.col("head.doc").alias("doc"), F.col("head.at").alias("at"), "again", "head")
    rows = made.select("doc", "at", "seg", "start", "w", "s").join(heads, ["doc", "at"])
    rows = rows.select("seg", "again", F.col("head").alias("seg_head"), "doc", "at", "start", F.posexplode(F.arrays_zip("w", "s")).alias("off", "z"))
    rows = cuts.cut(rows.select("seg", "again", "seg_head", "off", F.col("z.w").alias("window"), F.struct("doc", (F.col("at") + F.col("off")).alias("at"), (F.col("start") + F.col("z.s")).alias("start")).alias("place")))
    classes = rows.groupBy("window").agg(F.min("place").alias("head"), F.max("place").alias("last"), F.bool_or("again").alias("again"))
    classes = classes.filter((F.col("head") != F.col("last")) | F.col("again")).select("window", "head")
    found = rows.join(classes, "window").select("seg", "seg_head", "off", "head", (F.col("head") == F.col("place")).alias("own"))
    island = F.col("off") - F.row_number().over(Window.partitionBy("seg", "own").orderBy("off"))
    runs = found.withColumn("island", island).groupBy("seg", "own", "island").agg(F.first("seg_head").alias("seg_head"), F.min("off").alias("low"), F.max("off").alias("high"), F.min(F.struct("off", "head")).alias("f"))
    return runs.select("seg", "seg_head", "own", "low", "high", F.col("f.head").alias("head")), rows


#: A segment of a text: n windows from word `at` on, which have one mark. w: their hashes; s, e: where they start and end, from `start`.
SEGMENT = "doc long, many boolean, mark long, seg long, at int, n int, twice boolean, start int, w array<long>, s array<int>, e array<int>"


def _segments_of(run: int):
    """Of rows (doc, text, many, marks): the segments with one of the marks, all those of a text that many hold."""
    import pyarrow as pa

    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def segments(doc, many, marks, base, whole, least, starts, ends):
        low = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        n = np.diff(np.append(low, len(least)))
        keep = np.ones(len(low), bool) if many else np.isin(least[low], marks)
        if not keep.any():
            return None
        inside = np.arange(len(least)) - np.repeat(low, n)
        seg = np.add.reduceat(shingles.mix(whole.view(np.uint64) + inside.astype(np.uint64) * shingles.BASE), low).view(np.int64)
        twice = np.zeros(len(low), bool)
        if len(np.unique(whole)) < len(whole):
            twice = np.array([keep[i] and len(np.unique(whole[a : a + m])) < m for i, (a, m) in enumerate(zip(low.tolist(), n.tolist(), strict=True))])
        at = np.flatnonzero(np.repeat(keep, n))
        begin = starts[base + low]
        shift = np.repeat(begin, n)[at]
        low, n = low[keep], n[keep]
        one = np.ones(len(low), np.int64)
        return one * doc, one * many, least[low], seg[keep], low, n, twice[keep], begin[keep], whole[at], starts[base + at] - shift, ends[base + at + run - 1] - shift

    def batch_of(found):
        cols = [np.concatenate(c) for c in zip(*found, strict=True)]
        offsets = pa.array(np.concatenate(([0], np.cumsum(cols[5]))).astype(np.int32))
        flat = [pa.array(c, t) for c, t in zip(cols[:8], (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()), strict=True)]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c, t)) for c, t in zip(cols[8:], (pa.int64(), pa.int32(), pa.int32()), strict=True)]
        return pa.RecordBatch.from_arrays([*flat, *lists], names=names)

    def each(batches):
        for batch in batches:
            bodies, docs, many = (batch.column(i).to_pylist() for i in (1, 0, 2))
            for a, b in slices(bodies, 1 << 18):
                starts, ends = shingles.word_bounds(bodies[a:b])
                found = []
                for i, (base, whole, least) in enumerate(windows(bodies[a:b], run), a):
                    marks = None if many[i] else batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                    if len(whole) and (got := segments(docs[i], many[i], marks, base, whole, least, starts, ends)):
                        found.append(got)
                if found:
                    yield batch_of(found)

    return each
