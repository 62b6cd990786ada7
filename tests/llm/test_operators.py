"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on edge cases."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import bpe, fingerprint, langid, linededup, media, mixing, neardup, paradedup, quality, secrets, shingles, simjoin
from termloom.llm.components import components
from termloom.llm.common import Cuts
from termloom.llm.queries import vocabulary
from tests.llm.conftest import prose

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# ---- BPE


def test_bpe_equals_the_library_whatever_the_cut(docs):
    tok = bpe.load(vocabulary())
    want = Counter((i, tuple(tok.slow.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows_of(docs))
    for leaf in (1 << 15, 64):
        out = bpe.bpe_encode(docs, vocabulary(), leaf_chars=leaf, decode=True)
        assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in out.collect()) == want


def test_bpe_tree_on_unsplit_text():
    tok, rng = bpe.load(vocabulary()), random.Random(2)
    parts = ["ab", "a", "'ll", "'", " ", "  ", "\n", "1", "é", "漢字", "🙂", "!?", "<|endoftext|>", "<|endof", "text|>", " and", " ", "x" * 30]
    for _ in range(400):
        t = "".join(rng.choice(parts[: rng.choice([2, 5, len(parts)])]) for _ in range(rng.randint(0, 60)))
        for leaf in (1, 7, 100):
            assert tok.tree(t, leaf).tolist() == tok.slow.encode(t, add_special_tokens=False).ids
    long = "".join(rng.choice("abcdefgh") for _ in range(50_000))
    assert tok.tree(long, 1000).tolist() == tok.slow.encode(long).ids


def test_plain_characters_split_alike():
    tok = bpe.load(vocabulary())
    for c in map(chr, range(0x2100)):
        if not bpe.PLAIN.search(c):
            t = f"a{c}b {c}1{c} {c}  {c}.{c}{c}"
            assert tok.fast.encode_ordinary(t) == tok.slow.encode(t, add_special_tokens=False).ids, hex(ord(c))


def test_bpe_decode_and_empty_tables(spark, empty):
    assert bpe.bpe_encode(empty, vocabulary(), decode=True).count() == 0
    ids = spark.createDataFrame([(1, [31373, 995]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.bpe_decode(ids, vocabulary()).orderBy("doc_id").collect()] == ["hello world", "", ""]


# ---- quality


def test_gam_learns_main_effects_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0.2) ^ ((x[:, 1] > 0) & (x[:, 2] > 0))).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert model.pairs and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85
    assert quality.fit(x[:0], y[:0]).score(x).std() == 0


def test_quality_scores(spark, docs, empty):
    rng = random.Random(3)
    good, bad = [prose(rng, 80) for _ in range(60)], [" | ".join(prose(rng, 2) for _ in range(20)) for _ in range(60)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (7, None), (999, 1)], "doc_id long, quality int")
    model = quality.train(table.filter("doc_id % 3 <> 0"), labels)
    out = quality.score(table.filter("doc_id % 3 = 0"), model).collect()
    assert np.mean([(r["score"] > 0.5) == (r["doc_id"] < 60) for r in out]) > 0.9
    got = quality.score(docs, model)
    assert got.count() == docs.count() and got.columns == ["doc_id", "score", "predicted"]
    assert quality.score(empty, model).count() == 0 and quality.keep_quality(docs, model).columns == docs.columns
    assert quality.score(docs, quality.train(empty, labels)).select("score").distinct().collect()[0]["score"] == 0.5


# ---- secrets


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2)) + body


def test_secrets_base_and_confirmed(spark, docs, empty):
    rng = random.Random(5)
    number = lambda k: der(2, b"\x01" + rng.randbytes(k))
    rsa = der(0x30, der(2, b"\0") + number(64) + der(2, b"\1\0\1") + b"".join(number(k) for k in (64, 32, 32, 32, 32, 32)))
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, rsa))
    field = lambda b: len(b).to_bytes(4) + b
    ssh = secrets.OPENSSH + field(b"none") * 2 + field(b"") + (1).to_bytes(4) + field(b"p" * 40) + field(b"q" * 90)
    b64 = lambda b: base64.b64encode(b).decode()
    url = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    token = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': '1'})}.abcDEF"
    for k in (rsa, pkcs8):
        assert [x[1] for x in secrets.confirmed_spans(f"see {b64(k)} here")] == [3] and [x[1] for x in secrets.confirmed_spans(k.hex())] == [3]
        assert not secrets.confirmed_spans(b64(k[:-1])) and not secrets.confirmed_spans(b64(k[:-1] + b"xx"))
    assert len(secrets.confirmed_spans(b64(ssh))) == 1 and not secrets.confirmed_spans(b64(ssh[:-3]))
    armoured = f"-----BEGIN RSA PRIVATE KEY-----\n{re.sub('(.{64})', chr(92) + 'g<1>' + chr(10), b64(rsa))}\n-----END RSA PRIVATE KEY-----"
    assert secrets.confirmed_spans(f"é {armoured}") == [(2, 3, 2 + len(armoured))]
    assert secrets.confirmed_spans(f"x {token} y") == [(2, 4, 2 + len(token))]
    assert not secrets.confirmed_spans(f"{url({'typ': 'JWT'})}.{url({})}.x") and not secrets.confirmed_spans("eyJhbGciOiJub25.abc.def")
    t = f"Password: hunter22, api_key='abc' TOKEN = \"x/y+z=.\" AKIA{'A' * 16} AKIAshort {'0a' * 12} {'f' * 23} ſecret=abcdefgh token: token=abcdef"
    got = secrets.joined(sorted(secrets.base_spans(t)))
    kinds = [k.split(":")[0] for k in got.split(",")]
    assert kinds == ["assign", "assign", "access", "hex", "assign"]
    out = secrets.secret_scan(docs)
    assert out.count() == docs.count() and secrets.secret_scan(empty).count() == 0
    special = secrets.secret_scan(spark.createDataFrame([(1, f"{t} {token} {b64(rsa)}"), (1, f"{t} {token} {b64(rsa)}"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert special[0] == special[1] and (special[0]["n_assign"], special[0]["n_access"], special[0]["n_key"], special[0]["n_jwt"]) == (3, 1, 1, 1) and special[2]["spans"] == ""


# ---- mixing


def test_mixing_counts_and_shares(spark, docs, empty):
    out = mixing.poisson_mix(docs, {"src1": 0.5, "src2": 0.25}, 0.25, seed=9)
    assert out.columns[: len(docs.columns)] == docs.columns and mixing.poisson_mix(empty, {"a": 1.0}).count() == 0
    big = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"))
    mixed = mixing.poisson_mix(big, {"s0": 0.6, "s1": 0.3}, 0.1)
    sizes = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = big.agg(F.sum(F.length("text"))).first()[0]
    for s, w in (("s0", 0.6), ("s1", 0.3), ("s2", 0.1)):
        assert abs(sizes[s] / total - w) < 0.05
    one = mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_copies").alias("m"), F.max("copy_no").alias("c")).collect()
    assert all(r["n"] == r["m"] == r["c"] for r in one)
    u = [r[0] for r in big.select(mixing.uniform(17, F.col("doc_id"))).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02
    for rate in (0.0, 0.3, 5.0, 900.0):
        cdf = spark.range(1).select(mixing.poisson_table(F.lit(rate))).first()[0]
        assert abs(cdf[-1] - 1) < 1e-9 and abs(cdf[0] - np.exp(-rate)) < 1e-12
    pytest.raises(ValueError, mixing.poisson_mix, docs, {})


# ---- language


def test_mixture_inference(spark, docs, empty):
    rng = random.Random(6)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "uvwxy"}
    word = lambda k: "".join(rng.choice(alphabets[k]) for _ in range(rng.randint(2, 7)))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    rows = [(i, text(k, 60), k) for i, k in enumerate(list(alphabets) * 40)] + [(900, None, "aa"), (901, "abc", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["aa", "bb", "cc"]
    tests = [(i, text(k, 40), k) for i, k in enumerate(list(alphabets) * 20)]
    out = {r["doc_id"]: r for r in langid.detect(spark.createDataFrame(tests, "doc_id long, text string, lang string"), model).collect()}
    assert np.mean([out[i]["lang_pred"] == k for i, _, k in tests]) > 0.95
    mixed = langid.Predictor(model).proportions([f"{text('aa', 70)} {text('cc', 30)}"])[0]
    assert set(mixed) == {"aa", "cc"} and abs(mixed["aa"] - 0.7) < 0.1
    got = langid.detect(docs, model)
    assert got.count() == docs.count() and {r["lang_pred"] for r in got.filter("doc_id = 5000").collect()} == {"und"} and langid.detect(empty, model).count() == 0
    kept = langid.keep_languages(docs, model)
    assert kept.columns == docs.columns and kept.filter("text IS NULL OR text RLIKE '^[0-9 ]*$'").count() == 0
    nothing = langid.train(empty)
    assert {r["lang_pred"] for r in langid.detect(docs, nothing).collect()} == {"und"} and langid.keep_languages(docs, nothing).count() == 0


# ---- line deduplication


def test_line_dedup(docs, empty):
    rows = rows_of(docs)
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 40:
                holders[key(s)].add(i)
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [s for s in lines if key(s) not in keep or keep[key(s)] == i]
        want[(i, "\n".join(left), len(lines), len(lines) - len(left))] += 1
    out = linededup.line_dedup(docs)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"]
    assert bag(out.select("doc_id", "text", "_n_lines", "n_dropped")) == want and sum(x[3] for x in want) >= 5
    assert linededup.line_dedup(empty).count() == 0


def test_language_sample_counts_a_text_once(spark):
    rows = [("en", "the same words")] * 30 + [("en", f"some other text {i}") for i in range(5)]
    many, once = (langid.train(spark.createDataFrame(r, "lang string, text string"), per_language=20) for r in (rows, sorted(set(rows))))
    assert np.array_equal(many.table, once.table) and many.table.max() > many.table.min()


# ---- near duplicates


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(sets, percent):
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_near_components_and_dedup(spark, docs, empty):
    rows = rows_of(docs)
    for k, percent in ((3, 85), (5, 80)):
        sets = [shingle_set(t, k) for _, t in rows]
        label = brute_components(sets, percent)
        smallest = defaultdict(list)
        for (i, _), c in zip(rows, label, strict=True):
            smallest[c].append(i)
        want = Counter((i, len(s), min((x for x in smallest[c] if x is not None), default=None) if s else i) for (i, _), s, c in zip(rows, sets, label, strict=True))
        out = neardup.near_components(docs, k=k, percent=percent)
        assert bag(out.select("doc_id", "n_shingles", "component_id")) == want
    kept = neardup.near_dedup(docs)
    assert kept.columns == docs.columns and neardup.near_dedup(empty).count() == 0 and neardup.near_components(empty).count() == 0
    groups = {c for c, s in zip(label, sets, strict=True) if s}
    assert kept.filter("text RLIKE '[^ \\t\\n\\r]'").count() == len(groups)


def test_large_near_copy_group_is_one_component(spark):
    """A star: every copy is linked with the centre, hardly any with each other."""
    rng = random.Random(8)
    centre = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(centre))]
    for i in range(1, 500):
        w = list(centre)
        for _ in range(9):
            w[rng.randrange(400)] = f"v{rng.random()}"
        rows.append((i, " ".join(w)))
    sets = [shingle_set(t, 3) for _, t in rows]
    label = brute_components(sets, 85)
    out = neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == dict(enumerate(label))


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    label = {x: x for p in pairs if p[0] != p[1] for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    out = components(spark.createDataFrame(pairs, "a long, b long"), Cuts(spark, "test"))
    assert {r["node"]: r["label"] for r in out.collect()} == label


def test_sieve_loses_nothing(spark):
    rows = spark.range(3000).select(F.col("id"), F.xxhash64("id").alias("h"))
    wanted = rows.filter("id % 10 = 3").select(F.col("h").alias("w"))
    got = {r["id"] for r in simjoin.sieve(rows, "h", wanted, "w").collect()}
    assert {i for i in range(3000) if i % 10 == 3} <= got and len(got) < 310
    assert simjoin.sieve(rows, "h", wanted.limit(0), "w").count() == 0


def test_shingle_hashes():
    texts = ["A b  c\td", "a B c d", "a b c", "", "x", "one two three four five six"]
    for k in (1, 2, 3, 5):
        got = shingles.sets(texts, k)
        assert [len(g) for g in got] == [len(shingle_set(t, k)) for t in texts]
        assert (got[0] == got[1]).all()
    assert np.array_equal(shingles.sets(["a b", "b a", "ab"], 2)[0], shingles.sets(["a b"], 2)[0]) and shingles.sets(["a b"], 2)[0][0] != shingles.sets(["b a"], 2)[0][0]
    long = " ".join(f"w{i}" for i in range(150_000))
    assert len(shingles.sets([long], 3)[0]) == 149_998


# ---- paragraphs


def test_paragraphs(spark, docs, empty):
    rows, seen = [], set()
    for i, t in rows_of(docs):
        if (i, t) in seen:
            continue
        seen.add((i, t))
        at = 0
        for pos, line in enumerate((t or "").split("\n")):
            if len(line.encode().split()) >= 10:
                rows.append(((i is None, i or 0), at, shingle_set(line, 5), pos))
            at += len(line) + 1
    label = brute_components([r[2] for r in rows], 80)
    classes = defaultdict(list)
    for r, c in zip(rows, label, strict=True):
        classes[c].append(r[:2])
    want = Counter((r[0], r[1], len(classes[c])) for r, c in zip(rows, label, strict=True) if len(classes[c]) > 1)
    out = paradedup.repeated_paragraphs(docs, min_words=10)
    got = out.collect()
    sizes = Counter((r["class_doc"], r["class_start"]) for r in got)
    assert Counter(((r["doc_id"] is None, r["doc_id"] or 0), r["start"], sizes[(r["class_doc"], r["class_start"])]) for r in got) == want and len(want) > 20
    assert sum(not r["removed"] for r in got) == len(sizes)
    clean = paradedup.paragraph_dedup(docs, min_words=10)
    assert clean.columns == docs.columns and clean.count() == docs.count() and paradedup.repeated_paragraphs(empty).count() == 0
    pytest.raises(ValueError, paradedup.repeated_paragraphs, docs, percent=30)


def test_repeated_passages(spark, docs, empty):
    """Passages inside long lines and wrapped into short ones, against all windows counted one by one."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, other = words(60), words(49)
    rows = [
        (1, " ".join(["é🙂", *words(100), *passage, *words(200)])),
        (2, "\n".join(" ".join(x) for x in (words(9), passage[:20], passage[20:41], passage[41:], words(9)))),
        (3, " ".join([*words(30), *other, *words(30)])), (4, " ".join([*words(70), *other])),
        (5, " ".join([*passage[5:56], *words(3), *passage[5:56]]).upper()), (6, " ".join(words(300))), (7, None), (8, "x " * 120), (9, "x " * 120),
    ]
    for run, table in ((50, [*rows, rows[0]]), (13, rows_of(docs))):
        frame = spark.createDataFrame(table, "doc_id long, text string")
        spots = defaultdict(list)
        for i, t in set(table):
            found = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
            w = [(t or "")[a:b].translate(ASCII_LOWER) for a, b in found]
            for at in range(len(w) - run + 1):
                spots[tuple(w[at : at + run])].append((i, t, found[at][0], found[at + run - 1][1]))
        want = {(i, t, p) for s in spots.values() if len(s) > 1 for i, t, a, b in s for p in range(a, b)}
        texts = {(r["doc_id"], r["g_hash"]): r["text"] for r in frame.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("g_hash")).collect()}
        got = paradedup.repeated_passages(frame, run=run).collect()
        assert {(r["doc_id"], texts[r["doc_id"], r["g_hash"]], p) for r in got for p in range(r["start"], r["end"])} == want and want
        assert all(len(texts[r["doc_id"], r["g_hash"]][r["start"] : r["end"]].encode().split()) == r["n_words"] >= run for r in got)
        heads = {p for r in got if not r["removed"] for p in ((r["doc_id"], x) for x in range(r["start"], r["end"]))}
        assert all((r["class_doc"], r["class_start"]) in heads for r in got)
        if run == 50:
            assert {r["doc_id"] for r in got} == {1, 2, 5, 8, 9} and {r["class_doc"] for r in got if r["doc_id"] in (2, 5)} == {1}
            assert [(r["start"], r["end"], r["class_doc"], r["removed"]) for r in got if r["doc_id"] == 9] == [(0, 239, 8, True)]
    assert paradedup.repeated_passages(empty).count() == 0


# ---- media


def test_images():
    rng = np.random.default_rng(3)
    gray, rgb = rng.integers(0, 256, (7, 13), dtype=np.uint8), rng.integers(0, 256, (5, 6, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(gray))[:, :, 0] == gray).all() and (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert (media.decode(b"P6 # note\n6 5\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(("P3\n6 5\n255\n" + " ".join(map(str, rgb.ravel()))).encode()) == rgb).all()
    assert (media.decode(("P2\n13 7 255\n" + "\n".join(map(str, gray.ravel()))).encode())[:, :, 0] == gray).all()
    bits = rng.integers(0, 2, (3, 11), dtype=np.uint8)
    assert (media.decode(b"P4\n11 3\n" + np.packbits(bits, axis=1).tobytes())[:, :, 0] == 1 - bits).all()
    assert (media.decode(("P1\n11 3\n" + "".join(map(str, bits.ravel()))).encode())[:, :, 0] == 1 - bits).all()
    deep = rng.integers(0, 65536, (2, 3), dtype=np.uint16)
    assert (media.decode(b"P5 3 2 65535\n" + deep.astype(">u2").tobytes())[:, :, 0] == deep).all()
    small = media.area_resize(gray.astype(float), 3, 4)
    fine = np.repeat(np.repeat(gray.astype(float), 3, 0), 4, 1).reshape(3, 7, 4, 13).mean((1, 3))
    assert np.allclose(small, fine) and len(media.difference_hash(gray)) == 16
    import io

    assert np.load(io.BytesIO(media.npy_tile(rgb))).shape == (16, 16, 3)
    assert media.features(b"P5 9 9 255\nxx")[5] and media.features(b"")[5] and media.features(b"BM")[5]


def test_text_media(docs, empty, spark):
    for r in media.text_media(docs).join(docs.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").collect():
        raw = (r["t"] or "").encode()
        if len(raw) == r["n_bytes"]:
            body = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
            assert r["payload_bytes"] == len(body) and r["payload_sha256"] == hashlib.sha256(body).hexdigest() and r["tail_crc32"] == zlib.crc32(body[-64:])
    assert media.text_media(docs).count() == docs.count() and media.text_media(empty).count() == 0
    files = spark.createDataFrame([(1, bytearray(media.encode_pgm(np.zeros((3, 3))))), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.media_features(files).collect()}
    assert got[1]["width"] == 3 and got[1]["error"] is None and got[2]["error"] and got[3]["width"] == 0


# ---- fingerprints


def test_chunks():
    rng = random.Random(10)
    raw = prose(rng, 20_000).encode()
    ends = fingerprint.boundaries(raw)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and sizes.max() <= fingerprint.MOST and sizes[:-1].min() >= fingerprint.LEAST
    h, slow = fingerprint.rolling(np.frombuffer(raw[:500], np.uint8)), 0
    for i, b in enumerate(raw[:500]):
        slow = (slow * 2 + int(fingerprint.GEAR[b])) % 2**32
        assert h[i] == slow
    text = raw.decode()
    shifted = fingerprint.likeness(fingerprint.chunks(text), fingerprint.chunks("shift " + text))
    assert shifted > 0.98 and fingerprint.likeness({}, {}) == 1 and fingerprint.likeness({}, {"a": 1}) == 0
    fp = fingerprint.chunks(text)
    assert fingerprint.unpacked(fingerprint.packed(fp)) == fp and fingerprint.unpacked("") == {}


def test_fingerprint_edits_of_string_ids(spark):
    rows = [(f"k{i:05d}", prose(random.Random(i), 200)) for i in range(5000)]
    got = {r["id"]: r for r in fingerprint.fingerprint_edits(spark.createDataFrame([*rows, (None, "x")], "id string, text string"), "id").collect()}
    assert len(got) == 5001
    for (i, t), (_, following) in zip(rows[:0:-1], rows[-2::-1], strict=True):
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


@pytest.mark.parametrize("per_range", [2000, 7])
def test_fingerprint_edits(docs, empty, per_range, monkeypatch):
    real = fingerprint.neighbours
    monkeypatch.setattr(fingerprint, "neighbours", lambda d, i, t: real(d, i, t, rows_per_range=per_range))
    table = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(((i, t or "") for i, t in rows_of(table)), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(table).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        a, b = fingerprint.chunks(t), fingerprint.chunks(edited)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.packed(a), fingerprint.packed(b))
        assert r["near_edited"] == fingerprint.likeness(a, b) and r["near_next"] == fingerprint.likeness(a, fingerprint.chunks(following))
    assert fingerprint.fingerprint_edits(docs).count() == docs.count() and fingerprint.fingerprint_edits(empty).count() == 0
    assert fingerprint.fingerprint(docs).count() == docs.count()
