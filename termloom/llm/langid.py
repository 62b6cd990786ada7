"""Language identification by multilingual mixture inference."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import filter_texts, map_texts

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (1, 2, 3, 4)
#: Buckets of hashed n-grams.
BITS = 17
BUCKETS = 1 << BITS
#: Words whose likelihoods a task keeps; it starts anew when full.
CACHE = 200_000
UNKNOWN = "und"


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' character n-grams, the words' ends marked, and the word that each belongs to."""
    text = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), "<u4").astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    buckets, owners, h = [], [], np.zeros(len(text), np.uint32)
    for n in ORDERS:
        # h holds the hash of the n - 1 characters from each place on
        h = (h[: len(text) - n + 1] ^ text[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append(((h[inside] * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)).astype(np.int32))
        owners.append(owner[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters; numerals and marks that the pattern takes for letters go."""
    found = WORD.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [w for x in found if (w := "".join(filter(str.isalpha, x)))]


class Languages:
    """Smoothed n-gram log-likelihoods of each language, as one table: buckets x languages."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        mass = counts + 0.05
        self.table = np.log(mass / mass.sum(axis=0)).astype(np.float32)

    @classmethod
    def of(cls, names: list[str], table: np.ndarray) -> Languages:
        self = cls.__new__(cls)
        self.names, self.table = names, table
        return self

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """words x languages: the mean log-likelihood of a word's n-grams times its letters, so that each letter counts once."""
        at, owner = grams(words)
        sums = [np.bincount(owner, self.table[at, k], len(words)) for k in range(len(self.names))]
        scale = np.fromiter(map(len, words), np.float64, len(words)) / np.bincount(owner, minlength=len(words))
        return np.stack(sums, axis=1) * scale[:, None]


def mixture(logs: np.ndarray, counts: np.ndarray, chosen: list[int], rounds: int = 60) -> tuple[np.ndarray, float]:
    """Proportions of the chosen languages by expectation-maximisation over words, and their log-likelihood."""
    x = logs[:, chosen]
    top = x.max(axis=1)
    p = np.exp(x - top[:, None])
    share, before, total = np.full(len(chosen), 1 / len(chosen)), -np.inf, counts.sum()
    for _ in range(rounds):
        mix = p @ share
        found = float(counts @ (np.log(mix) + top))
        if found - before < 1e-4 * max(1.0, abs(found) * 1e-4):
            break
        before = found
        share = share * (counts / mix @ p) / total
    return share, found


def infer(logs: np.ndarray, counts: np.ndarray, penalty: float = 6.0) -> dict[int, float]:
    """Languages and proportions: languages are added to the best one while that raises the log-likelihood less a penalty for each, penalty * ln(words)."""
    single = counts @ logs
    chosen = [int(single.argmax())]
    share, found = np.ones(1), float(single[chosen[0]])
    cost = penalty * np.log(counts.sum() + 1)
    while len(chosen) < logs.shape[1]:
        best = None
        have = logs[:, chosen].max(axis=1)
        bound = counts @ np.maximum(logs, have[:, None])  # no mixture with that language is likelier
        for k in np.flatnonzero(bound - found > cost).tolist():
            if k not in chosen:
                s, f = mixture(logs, counts, [*chosen, k])
                if f - found > cost and (best is None or f > best[1]):
                    best = [*chosen, k], f, s
        if best is None:
            break
        chosen, found, share = best
    return dict(zip(chosen, share.tolist(), strict=True))


class Predictor:
    """Keeps the likelihoods of the words met so far; starts anew when CACHE is full."""

    def __init__(self, model: Languages):
        self.model, self.index, self.rows = model, {}, np.zeros((0, len(model.names)))

    def proportions(self, texts: list[str]) -> list[dict[str, float]]:
        """Language to proportion for each text; empty for a text without letters."""
        if not self.model.names:
            return [{} for _ in texts]
        if len(self.index) > CACHE:
            self.index, self.rows = {}, self.rows[:0]
        index, found = self.index, [words_of(t) for t in texts]
        at = [[index.setdefault(w, len(index)) for w in words] for words in found]
        if len(index) > len(self.rows):
            new = list(index)[len(self.rows) :]
            self.rows = np.concatenate([self.rows, self.model.likelihoods(new)])
        out = []
        for places in at:
            if not places:
                out.append({})
                continue
            used, counts = np.unique(np.array(places, np.int64), return_counts=True)
            out.append({self.model.names[k]: s for k, s in infer(self.rows[used], counts.astype(np.float64)).items()})
        return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, most_languages: int = 500, seed: int = 5) -> Languages:
    """Count n-grams in about `per_language` distinct texts of each language, drawn by their hash; fewer where a language has fewer.

    `per_language` and `most_languages`, beyond which it fails, bound what the driver gathers. Rows with
    a null language or text are left out.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("g_lang"), F.col(text_col).alias("g_text"))
    sizes = rows.select("g_lang", F.xxhash64("g_text").alias("g_hash")).distinct().groupBy("g_lang").count().limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    names = sorted(r["g_lang"] for r in sizes)
    if not names:
        return Languages([], np.zeros((BUCKETS, 0)))
    part = F.create_map(*[x for r in sizes for x in (F.lit(r["g_lang"]), F.lit(min(1.0, per_language / r["count"])))])
    luck = F.pmod(F.xxhash64("g_text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.filter(luck < F.element_at(part, F.col("g_lang"))).distinct()

    def count(batches):
        import pyarrow as pa

        words: dict[str, dict[str, int]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = words.setdefault(lang, {})
                for w in words_of(text):
                    seen[w] = seen.get(w, 0) + 1
        for lang, seen in words.items():
            if not seen:
                continue
            place, owner = grams(list(seen))
            counts = np.bincount(place, np.array(list(seen.values()))[owner], BUCKETS).astype(np.int64)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    summed = drawn.repartition(16, F.xxhash64("g_text")).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((BUCKETS, len(names)))
    for i, name in enumerate(names):
        own = summed[summed["lang"] == name]
        table[own["bucket"].to_numpy(), i] = own["n"].to_numpy()
    return Languages(names, table)


def detect(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Infer each whole text's language mixture.

    Returns the id, the `carry` columns, `lang_pred` (the language of the largest proportion; the
    first by name on a tie), `score` (its proportion) and `langs` (all chosen languages with their
    proportions, largest first). A null text or one without letters is `und` with score 0. Other
    columns are not read; repeated rows give repeated rows; an empty table gives an empty table. A
    model of no language calls every text `und`.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.names, model.table))  # BUCKETS x languages, bounded by most_languages

    def setup():
        return Predictor(Languages.of(*shared.value))

    def apply(p: Predictor, texts: list[str]) -> list:
        rows = [sorted(x.items(), key=lambda x: (-x[1], x[0])) for x in p.proportions(texts)]
        return [[r[0][0] if r else UNKNOWN for r in rows], [min(1.0, r[0][1]) if r else 0.0 for r in rows], [",".join(f"{k}:{v:.4f}" for k, v in r) for r in rows]]

    return map_texts(docs, id_col, text_col, apply, "lang_pred string, score double, langs string", setup=setup, carry=carry)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def keep_languages(docs: DataFrame, model: Languages, accepted: list[str] | None = None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, whose largest language is accepted (None: any of the model) and makes up `least` of the text or more.

    Of equal proportions the first by name counts, as in detect(). A null text or one without letters goes; repeated
    rows are judged alike; an empty table gives an empty table.
    """
    names, tab = model.names, docs.sparkSession.sparkContext.broadcast(model.table)
    wanted = set(names if accepted is None else accepted)

    def keep(p: Predictor, texts: list[str]) -> list[bool]:
        best = [min(x.items(), key=lambda x: (-x[1], x[0]), default=(UNKNOWN, 0.0)) for x in p.proportions(texts)]
        return [k in wanted and v >= least for k, v in best]

    return filter_texts(docs, text_col, keep, setup=lambda: Predictor(Languages.of(names, tab.value)))
