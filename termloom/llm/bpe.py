"""Byte-level BPE by tree concatenation."""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import map_texts

#: Characters whose classes the two tokenizer libraries hold alike (a test compares them one by one); other texts take the slower library.
PLAIN = re.compile(r"[^\x00-ɏ‐-‧€]")
#: Where every split of the pretokenizer begins a piece, whatever stands before: after an ASCII letter or digit, at an ASCII character of another class.
SYNC = re.compile(r"(?<=[A-Za-z])(?=[\x00-@\[-`{-\x7f])|(?<=[0-9])(?=[\x00-/:-\x7f])")
WINDOW = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """One vocabulary: encode and decode; join() makes the encoding of a concatenation from those of its parts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_alphabet()
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.is_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.fast = self._fast(data, vocab, letters)

    def _fast(self, data: dict, vocab: dict, letters: dict):
        """The faster library on the same ranks, if the file is of the plain kind that it can express."""
        import tiktoken

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        pre = data.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not data.get("normalizer") and not data["model"].get("ignore_merges")
        rising = [vocab[a + b] for a, b in merges]
        singles = max(vocab[c] for c in letters)
        simple = not any(t[k] for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        if not (plain and simple and rising == sorted(rising) and rising[0] > singles and len(vocab) == 256 + len(set(rising))):
            raise ValueError("only byte-level vocabularies whose ids follow their merges are supported")
        ranks = {self.bytes[i]: i for i in vocab.values()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the pretokenizer of byte-level files
        return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """The encoding of a text, special tokens in it included."""
        if PLAIN.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        if not self.is_special or not self.is_special.search(text):
            return self.fast.encode_ordinary(text)
        out, at = [], 0
        for m in self.is_special.finditer(text):
            out += [*self.fast.encode_ordinary(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.fast.encode_ordinary(text[at:])

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")

    def pieces(self, text: str) -> list[tuple[int, int]]:
        return [span for _, span in self.slow.pre_tokenizer.pre_tokenize_str(text)]

    def _after(self, ids: np.ndarray, n: int) -> int:
        """How many ids the first n bytes take; -1 if no id ends there."""
        ends = np.cumsum(self.size[ids])
        k = int(np.searchsorted(ends, n)) + 1 if n else 0
        return k if not n or k <= len(ids) and ends[k - 1] == n else -1

    def _inside_special(self, text: str, at: int) -> bool:
        if not self.is_special:
            return False
        reach = max(map(len, self.special))
        low = max(0, at - reach + 1)
        return any(m.start() + low < at < m.end() + low for m in self.is_special.finditer(text[low : at + reach - 1]))

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """The encoding of left + right from theirs: windows around the join grow until they begin and end where both sides must split."""
        if not left or not right:
            return b if not left else a
        reach = max([1, *map(len, self.special)])
        window = WINDOW
        while True:
            low, high = max(0, len(left) - window), min(len(right), window)
            s1 = max((m.start() for m in SYNC.finditer(left, low, len(left) - reach) if not self._inside_special(left, m.start())), default=None)
            s2 = next((m.start() for m in SYNC.finditer(right, reach, high) if not self._inside_special(right, m.start())), None)
            if (s1 is not None or not low) and (s2 is not None or high == len(right)):
                break
            window *= 2
        s1, s2 = s1 or 0, len(right) if s2 is None else s2
        tail, head = left[s1:], right[:s2]
        i, j = self._after(a, len(left[:s1].encode())), self._after(b, len(head.encode()))
        if len(tail) + len(head) <= 4 * WINDOW or (self.is_special and self.is_special.search(tail + head)):
            middle = np.array(self.encode(tail + head), np.int32)
        else:
            middle = self._join_run(tail, a[i:], head, b[:j])
        return np.concatenate([a[:i], middle, b[j:]])

    def _join_run(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """Join a long run in which no split is certain: pieces on which both sides agree stay; the piece across the join is joined token by token."""
        p, spans, ls, rs = len(left), self.pieces(left + right), self.pieces(left), self.pieces(right)
        k = 0
        while k < min(len(spans), len(ls)) and spans[k] == ls[k]:
            k += 1
        n = 0
        while n < min(len(spans) - k, len(rs)) and spans[-1 - n] == (rs[-1 - n][0] + p, rs[-1 - n][1] + p):
            n += 1
        text = left + right
        out = [a[: self._after(a, len(text[: spans[k - 1][1]].encode()))] if k else a[:0]]
        for s, e in spans[k : len(spans) - n]:
            if s < p < e and ls[-1] == (s, p) and rs[0] == (0, e - p):
                head = self._after(a, len(left[:s].encode()))
                tail = self._after(b, len(right[: e - p].encode()))
                out.append(self._join_piece(a[head:], b[:tail]))
            else:
                out.append(np.array(self.fast._encode_single_piece(text[s:e].encode()), np.int32))
        rest = self._after(b, len(right.encode()) - len(text[spans[-n][0] :].encode())) if n else len(b)
        return np.concatenate([*out, b[rest:]])

    def _join_piece(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Re-encode growing windows of one piece around the join until the first and the last token agree with both sides.

        A sequence of tokens is the encoding of its bytes if every two neighbours are the encoding of
        theirs; so agreement at both ends proves the whole.
        """
        k = 8
        while True:
            x, y = a[-k:], b[:k]
            got = np.array(self.fast._encode_single_piece(b"".join([self.bytes[i] for i in [*x, *y]])), np.int32)
            left_ok = len(x) == len(a) or got[0] == x[0]
            right_ok = len(y) == len(b) or got[-1] == y[-1]
            if left_ok and right_ok and (len(got) > 1 or len(x) == len(a) and len(y) == len(b)):
                return np.concatenate([a[: len(a) - len(x)], got, b[len(y) :]])
            k *= 2

    def merge(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """The tree: neighbours are joined level by level."""
        while len(parts) > 1:
            pairs = [(x[0] + y[0], self.join(x[0], x[1], y[0], y[1])) for x, y in zip(parts[::2], parts[1::2], strict=False)]
            parts = pairs + parts[len(pairs) * 2 :]
        return parts[0][1] if parts else np.zeros(0, np.int32)

    def tree(self, text: str, leaf: int) -> np.ndarray:
        return self.merge([(t, np.array(self.encode(t), np.int32)) for t in (text[i : i + leaf] for i in range(0, len(text), leaf))])


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def id_lists(rows: list) -> "pa.Array":  # noqa: F821
    import pyarrow as pa

    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 1 << 15, decode: bool = False) -> DataFrame:
    """Encode whole texts; equal to the tokenizers library on the same file, with no special tokens added.

    Texts longer than `leaf_chars` are cut into that many characters; the parts are encoded by
    different tasks, and a tree of joins makes the whole text's encoding from theirs, exactly.
    `path` names a byte-level vocabulary file that every executor has.

    Returns the id and `ids` (array<int>); with `decode`, also `decoded`, the ids decoded again. A
    null or empty text has no ids. Repeated rows give repeated rows. Other columns are not read. An
    empty table gives an empty table. The order of rows is not kept.
    """
    fields = "ids array<int>" + ", decoded string" * decode

    def whole(bpe: Bpe, texts: list[str]) -> list:
        rows = [bpe.encode(t) for t in texts]
        return [id_lists(rows), *([[bpe.decode(r) for r in rows]] if decode else [])]

    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), text.alias("g_text"))
    short = map_texts(base.filter(F.char_length("g_text") <= leaf_chars), id_col, "g_text", whole, fields, setup=lambda: load(path))
    long = base.filter(F.char_length("g_text") > leaf_chars)
    parts = (
        long.withColumn("g_key", F.md5("g_text"))
        .withColumn("g_part", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("g_text") - 1) / leaf_chars).cast("int"))))
        .select(id_col, "g_key", "g_part", F.substring(F.col("g_text"), F.col("g_part") * leaf_chars + 1, F.lit(leaf_chars)).alias("g_text"))
        .repartition(F.col("g_key"), F.col("g_part"))
    )
    leaves = map_texts(parts, id_col, "g_text", lambda bpe, texts: [texts, id_lists([bpe.encode(t) for t in texts])], "g_leaf string, g_ids array<int>", setup=lambda: load(path), carry=("g_key", "g_part"))
    schema = short.schema

    def grow(pdf):
        import pandas as pd

        bpe = load(path)
        times = int((pdf["g_part"] == 0).sum())  # rows that are repeated have equal parts
        pdf = pdf.drop_duplicates("g_part").sort_values("g_part")
        ids = bpe.merge([(t, np.asarray(i, np.int32)) for t, i in zip(pdf["g_leaf"], pdf["g_ids"], strict=True)])
        row = {schema.names[0]: [pdf[id_col].iloc[0]] * times, "ids": [ids] * times}
        return pd.DataFrame(row | ({"decoded": [bpe.decode(ids)] * times} if decode else {}))

    return short.unionByName(leaves.groupBy(id_col, "g_key").applyInPandas(grow, schema))


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode lists of ids. Returns the id and `decoded`; null or empty lists decode to ""; bytes that are no UTF-8 become U+FFFD."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([encoded.schema[id_col], StructField("decoded", StringType())])

    def run(batches):
        bpe = load(path)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.decode(x or ()) for x in part.column(1).to_pylist()], pa.string())], names=schema.names)

    return encoded.select(encoded[id_col], encoded[ids_col]).mapInArrow(run, schema)
