"""Small tables with what operators must stand: nulls, empty and long texts, repeated rows, clashing column names."""

import random

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep bigint, blob string, label string, key bigint, id bigint, start bigint"
WORDS = [f"w{k}" for k in range(400)] + ["The", "end.", "Österreich", "naïve", "日本語", "it's", "x=1", "!!", "12345"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(rng: random.Random, text: str, share: float) -> str:
    return " ".join(rng.choice(WORDS) + "q" if rng.random() < share else w for w in text.split(" "))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 40, 200, 800, 6000)]
    out: list[tuple[int | None, str | None]] = []
    for text in base:
        out += [(None, text), (None, text.upper())]
        out += [(None, changed(rng, text, s)) for s in (0.003, 0.01, 0.02, 0.05, 0.3)]
    out += [(None, t) for t in (None, "", " \n\t", "one", "ONE", "one two", "one two ", "a b c", " ", "a b \x0bc", "<|endoftext|> tail", "zero\x00byte", "😀 smile")]
    out += [(None, prose(rng, rng.randint(5, 60))) for _ in range(40)]
    out = [(k * 7 % 101 + 100 * (k // 101), t) for k, (_, t) in enumerate(out)]
    return [*out, out[2], out[2], (out[3][0], "another text under the same id"), (None, base[1]), (None, None)]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(d, t, "en", "hot", None, 1, "b", "l", 2, 3, 4) for d, t in rows], DOC_SCHEMA)
