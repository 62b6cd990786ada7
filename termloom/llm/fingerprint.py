"""Document fingerprints by content-defined chunking."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DatetimeType, NumericType, StructField, StructType, _parse_datatype_string

from termloom.llm.common import map_texts

#: Bytes: the least size of a chunk, the size from which cuts get likelier, the largest size.
LEAST, NORMAL, MOST = 32, 96, 512
#: A strict cut comes every 256 bytes on average, a loose one every 32.
STRICT, LOOSE = np.uint32(0xFF << 24), np.uint32(0x1F << 24)
#: Bytes of a text that are hashed at a time.
BLOCK = 1 << 20
#: The gear: a fixed 32-bit number for each byte, drawn from a digest of the byte.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest()) for b in range(256)], np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + GEAR[byte] at each byte: what is over 31 bytes back has been shifted out, so five doublings make it."""
    h, step = GEAR[data], 1
    while step < 32:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def boundaries(raw: bytes) -> list[int]:
    """Ends of the chunks: the first strict cut between LEAST and NORMAL, else the first loose one up to MOST, else MOST."""
    n, strict, loose = len(raw), [], []
    for at in range(0, n, BLOCK):
        low = max(0, at - 31)
        h = rolling(np.frombuffer(raw, np.uint8, min(n, at + BLOCK) - low, low))[at - low :]
        soft = np.flatnonzero((h & LOOSE) == 0)
        loose.append(soft + at + 1)
        strict.append(soft[(h[soft] & STRICT) == 0] + at + 1)
    if not n:
        return []
    hard, soft = np.concatenate(strict).tolist(), np.concatenate(loose).tolist()
    out, start, i, j = [], 0, 0, 0
    hard.append(n + MOST)
    soft.append(n + MOST)
    while n - start > LEAST:
        while hard[i] < start + LEAST:
            i += 1
        if hard[i] <= start + NORMAL:
            end = hard[i]
        else:
            while soft[j] < start + NORMAL:
                j += 1
            end = min(soft[j], start + MOST)
        if end >= n:
            break
        out.append(end)
        start = end
    return [*out, n]


def chunks(text: str) -> dict[str, int]:
    """Digest to length in bytes of the distinct chunks of a text."""
    raw, out, start = text.encode(), {}, 0
    for end in boundaries(raw):
        out[xxhash.xxh64_hexdigest(raw[start:end])] = end - start
        start = end
    return out


def packed(fp: dict[str, int]) -> str:
    """A fingerprint as text: digest-length in order of the digests, joined by commas."""
    return ",".join([f"{d}-{fp[d]}" for d in sorted(fp)])


def unpacked(fp: str) -> dict[str, int]:
    return {x[:16]: int(x[17:]) for x in fp.split(",")} if fp else {}


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Length shared, as a part of the smaller fingerprint: how far one text contains the other. Two empty texts are alike."""
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / min(sum(a.values()), sum(b.values()))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns the id and `fingerprint` of each whole text; a null text counts as empty, whose fingerprint is empty."""
    return map_texts(docs, id_col, text_col, lambda ts: [[packed(chunks(t)) for t in ts]], "fingerprint string")


def neighbours(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 2000, most_ranges: int = 20_000) -> DataFrame:
    """Rows dealt into ranges of falling ids and sorted, each range followed by the first row of the next (marked `g_extra`).

    The bounds are quantiles of the ids (`most_ranges` at most, a documented accuracy of 1 / most_ranges), of strings
    those of a sample of 20 * most_ranges ids at most on average, so no range holds much more than its share unless one id repeats. Null ids come last.
    """
    spark = docs.sparkSession
    rng, extra, order = "g_range", "g_extra", "g_order"
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("g_text"))
    ids = docs.select(id_col)
    count = ids.count()
    n = max(1, min(most_ranges, count // rows_per_range))
    if n == 1:
        cuts = []
    elif isinstance(docs.schema[id_col].dataType, NumericType | DatetimeType):
        cuts = sorted(set(ids.select(F.percentile_approx(id_col, [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    else:  # ids that have no quantiles: every 20th of those that a hash draws, about 20 a range
        drawn = F.pmod(F.xxhash64(id_col), F.lit(count)) < 20 * n
        cuts = [r[0] for r in ids.filter(F.col(id_col).isNotNull() & drawn).distinct().orderBy(id_col).collect()][20::20]
    # ranges count from the largest ids; literals, so that a task that runs again deals out alike
    bound = F.array(*[F.lit(c) for c in cuts]) if cuts else None
    where = F.lit(0) if bound is None else F.lit(len(cuts)) - F.size(F.filter(bound, lambda c: c <= F.col(id_col)))
    where = F.when(F.col(id_col).isNull(), len(cuts)).otherwise(where).cast("int")
    ranged = base.withColumn(rng, where)
    first = dict(ids.withColumn(rng, where).groupBy(rng).agg(F.max(id_col)).collect())  # a row for each range
    used = sorted(first)
    before = {r: used[i - 1] for i, r in enumerate(used)}  # the row also ends the range before; the very first one ends the last
    heads = F.create_map(*[x for r in used for x in (F.lit(r), F.lit(first[r]))]) if used else None
    prior = F.create_map(*[x for r in used for x in (F.lit(r), F.lit(before[r]))]) if used else None
    if used:
        is_head = F.col(id_col).eqNullSafe(F.element_at(heads, F.col(rng)))
        here = F.struct(F.col(rng).alias(rng), F.lit(False).alias(extra))
        there = F.struct(F.element_at(prior, F.col(rng)).alias(rng), F.lit(True).alias(extra))
        ranged = ranged.withColumn("g_at", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))))
        ranged = ranged.select(id_col, "g_text", F.col(f"g_at.{rng}").alias(rng), F.col(f"g_at.{extra}").alias(extra))
    else:
        ranged = ranged.withColumn(extra, F.lit(False))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return ranged.withColumn(order, F.xxhash64("g_text")).repartition(parts, rng).sortWithinPartitions(rng, extra, F.col(id_col).desc_nulls_last(), order)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text: the last third replaced by the start of the next text in falling id order (after the last: the first).

    Returns the id, `n_chars`, `edited_sha256`, `fingerprint`, `edited_fingerprint`, `near_edited`
    and `near_next` (likeness to the edited text's and to the next text's fingerprint).

    A null text counts as empty. Rows with equal ids follow each other by their text's hash; null
    ids come last. A table of one row is its own next. Other columns are not read; an empty table
    gives an empty table. Texts are shuffled once, each range's first row twice.
    """
    import pyarrow as pa

    made = _parse_datatype_string("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *made.fields])
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def pair(text, fp, following, following_fp):
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        efp = chunks(edited)
        return n, hashlib.sha256(edited.encode()).hexdigest(), packed(fp), packed(efp), likeness(fp, efp), likeness(fp, following_fp)

    def run(batches):
        last, ids, rows, size, ended = None, [], [], 0, None

        def flush():
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types))], names=schema.names)

        for batch in batches:
            texts, ranges, extras = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i, text in enumerate(texts):
                if extras[i] and ended == ranges[i]:
                    continue  # another row with the id of the first
                fp = chunks(text)
                if last and last[2] == ranges[i]:
                    ids.append(last[3])
                    rows.append(pair(last[0], last[1], text, fp))
                    size += len(last[0])
                    if size > 1 << 20:
                        yield flush()
                        ids, rows, size = [], [], 0
                if extras[i]:
                    last, ended = None, ranges[i]
                else:
                    last = (text, fp, ranges[i], batch.column(0).slice(i, 1))
        if rows:
            yield flush()

    return neighbours(docs, id_col, text_col).select(id_col, "g_text", "g_range", "g_extra").mapInArrow(run, schema)
