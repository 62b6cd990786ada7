"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import filter_texts, map_texts

FEATURES = ("log_chars", "letters", "upper", "digits", "spaces", "stops", "symbols", "other", "log_words", "word_length", "word_spread", "long_words", "odd_words", "distinct", "lines", "repeated_lines")


def byte_classes() -> np.ndarray:
    """256 x 7: which of the classes upper, lower or beyond ASCII, digit, space, sentence mark, symbol, control each byte is in."""
    out = np.zeros((256, 7))
    for b in range(256):
        c = chr(b)
        k = 1 if b >= 128 or "a" <= c <= "z" else 0 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 if c in " \t\n\r\x0b\x0c" else 4 if c in ".,;:?!'\"-()" else 5 if 33 <= b < 127 else 6
        out[b, k] = 1
    return out


CLASSES = byte_classes()
ALNUM = CLASSES[:, :3].sum(axis=1) > 0


def measure(text: str) -> list[float]:
    """The FEATURES of a text."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(raw, np.uint8)
    upper, lower, digits, spaces, stops, symbols, control = np.bincount(data, minlength=256) @ CLASSES
    words = raw.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    odd = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-2:-1] not in (b"", b".") and not w[-2:-1].isalnum() and w[-2] < 128 for w in words)
    lines = raw.split(b"\n")
    count = max(1, len(words))
    return [
        np.log1p(n), (upper + lower) / n, upper / max(1, upper + lower), digits / n, spaces / n, stops / n, symbols / n, control / n,
        np.log1p(len(words)), sizes.mean(), sizes.std(), (sizes > 20).sum() / count, odd / count,
        len(set(words)) / count, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines),
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([measure(t) for t in texts]).reshape(len(texts), len(FEATURES))


def digitise(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


@dataclass
class Gam:
    """Lookup tables: a bin's addition for each feature, and for each chosen pair of features."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, out = digitise(x, self.edges), np.full(len(x), self.bias)
        for i, t in enumerate(self.tables):
            out += t[bins[:, i]]
        wide = digitise(x, self.coarse) if self.pairs else None
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[wide[:, i], wide[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def shallow(g: np.ndarray, h: np.ndarray, leaves: int, lam: float) -> np.ndarray:
    """The step of a tree of at most `leaves` leaves on one feature's bins, from sums of gradients and curvatures by bin."""
    cuts, cg, ch = [0, len(g)], np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + lam)
    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = (cg[c] - cg[a]) ** 2 / (ch[c] - ch[a] + lam) + (cg[b] - cg[c]) ** 2 / (ch[b] - ch[c] + lam) - value(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(c[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + lam)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """Gain and step of the best tree that cuts a pair's table once in each feature."""
    cg, ch = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    best, step = 0.0, np.zeros_like(g)
    m, n = g.shape
    for i in range(1, m):
        for j in range(1, n):
            cells = [(cg[b, d] - cg[a, d] - cg[b, c] + cg[a, c], ch[b, d] - ch[a, d] - ch[b, c] + ch[a, c], a, b, c, d) for a, b in ((0, i), (i, m)) for c, d in ((0, j), (j, n))]
            gain = sum(x * x / (y + lam) for x, y, *_ in cells) - cg[m, n] ** 2 / (ch[m, n] + lam)
            if gain > best:
                best, step = gain, np.zeros_like(g)
                for x, y, a, b, c, d in cells:
                    step[a:b, c:d] = x / (y + lam)
    return best, step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 30, bins: int = 48, pair_bins: int = 8, n_pairs: int = 6, leaves: int = 3, rate: float = 0.15, lam: float = 2.0) -> Gam:
    """Boost shallow trees on one feature after the other, round by round; then the pairs whose quadrants explain most of what is left."""
    share = np.clip((y.sum() + 1) / (len(y) + 2), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    edges, coarse = [quantiles(x[:, i], bins) for i in range(x.shape[1])], [quantiles(x[:, i], pair_bins) for i in range(x.shape[1])]
    model = Gam(bias, edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [])
    if len(set(y.tolist())) < 2:
        return model
    b, out = digitise(x, edges), np.full(len(y), bias)
    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-out))
            step = rate * shallow(np.bincount(b[:, i], y - p, len(table)), np.bincount(b[:, i], p * (1 - p), len(table)), leaves, lam)
            table += step
            out += step[b[:, i]]
    w = digitise(x, coarse)
    shape = lambda i, j: (len(coarse[i]) + 1, len(coarse[j]) + 1)

    def sums(i, j):
        p, at, (m, n) = 1 / (1 + np.exp(-out)), w[:, i] * shape(i, j)[1] + w[:, j], shape(i, j)
        return np.bincount(at, y - p, m * n).reshape(m, n), np.bincount(at, p * (1 - p), m * n).reshape(m, n)

    gains = sorted(((quadrants(*sums(i, j), lam)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * quadrants(*sums(i, j), lam)[1]
            table += step
            out += step[w[:, i], w[:, j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 20_000, seed: int = 3) -> Gam:
    """Fit on labelled documents, at most `most_rows` of them, chosen by the hash of their ids.

    The bound makes the ids safe to broadcast and the features safe to gather: len(FEATURES)
    numbers a row. Null ids, null labels and labels without a document are left out; an id that is
    labelled twice counts twice. Without rows the model scores 0.5 throughout.
    """
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("g_id"), F.col(label_col).cast("int").alias("g_label"))
        .orderBy(F.xxhash64("g_id", F.lit(seed)), "g_id", "g_label").limit(most_rows)
    )
    rows = docs.select(F.col(id_col).alias("g_id"), F.coalesce(F.col(text_col), F.lit("")).alias("g_body")).join(F.broadcast(chosen), "g_id")
    got = map_texts(rows, "g_label", "g_body", lambda ts: [matrix(ts).tolist()], "x array<double>").toPandas()
    if got.empty:
        return Gam(0.0, [], [], [], [], [])
    order = np.lexsort([*np.stack(got["x"].tolist()).T, got["g_label"]])  # gathered in any order, fitted in one
    return fit(np.stack(got["x"].tolist())[order], got["g_label"].to_numpy()[order].astype(float))


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Returns the id, `score` (0 to 1, higher: better) and `predicted` (1 from `threshold` on) of each whole text.

    A null text scores as an empty one, whose features are all 0. Other columns are not read, so
    labels, languages and sources cannot enter a score; repeated rows give repeated rows; an empty
    table gives an empty table.
    """

    def apply(texts: list[str]) -> list:
        s = model.score(matrix(texts))
        return [s.tolist(), (s >= threshold).astype(int).tolist()]

    return map_texts(docs, id_col, text_col, apply, "score double, predicted int")


def keep_quality(docs: DataFrame, model: Gam, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, with all columns, that score `threshold` or more."""
    return filter_texts(docs, text_col, lambda ts: (model.score(matrix(ts)) >= threshold).tolist())
