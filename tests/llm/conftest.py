import random

import pytest

WORDS = [a + b for a in ("tha", "ren", "edi", "ous", "ble", "wer", "ion", "sto") for b in ("n", "re", "ing", "ed", "ly", "s")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Prose, exact and near copies, shared lines, tiny and odd texts."""
    rng = random.Random(4)
    base = ["\n".join(prose(rng, rng.randint(8, 60)) for _ in range(rng.randint(1, 5))) for _ in range(24)]
    near = []
    for t in base[:8]:
        words = t.split(" ")
        for _ in range(3):
            w = list(words)
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            near.append(" ".join(w))
    line = prose(rng, 40)
    shared = [f"{prose(rng, 30)}\n{' ' * (i % 3)}{line.upper() if i % 2 else line}\t\n{prose(rng, 20)}" for i in range(7)]
    odd = ["", " \n\t", "a", "a b", "\n\n\n", "é" * 50, "漢字かな交じり文。" * 30, "x" * 900, "🙂 <|endoftext|> end", "12 34"]
    return [*base, *near, *shared, *odd, base[3], base[3], ""]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with a null text, a null id, null labels, a repeated row, and columns whose names clash with outputs."""
    rows = [(i * 3 % 997, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 5 else None, len(t), "mine", "theirs", 1.0) for i, t in enumerate(texts)]
    rows += [(5000, None, "en", "src1", 0, "a", "b", 2.0), (None, texts[0], "en", "src1", 5, "a", "b", 2.0), (None, None, None, None, None, None, None, None), rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string, g_text string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
