import itertools
import os
import random
import re
import time

import zstandard

from tidewatch.llm import common, compression_rules, filter_audit
from tests.llm import tables

SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(11)
    clean = [tables.prose(rng, n) for n in (60, 300, 3000)]
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") + " " * (k % 9 == 8) for k in range(9000))
    binary = "".join(chr(rng.randrange(0x3400, 0x9000)) + " " * (k % 5 == 4) for k in range(9000))
    odd = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "x\ny\nx\nx\n \n \n", "a\r\na\na\r\n", "#*$%&|<> <p>", "Ünï ß 日本 ünï", "Cat cat CAT dog " * 20, "same line here\n" * 400, clean[2] + "\n" + "very same words " * 3000]
    return [*clean, noise, binary, *odd, *[tables.prose(rng, rng.randint(1, 90)) for _ in range(30)]]


def test_quality_rules_equal_brute_force(spark):
    own = texts()
    got = {r.doc_id: r for r in compression_rules.quality_rules(tables.documents(spark, list(enumerate(own)))).collect()}
    assert len(got) == len(own)
    for d, text in enumerate(own):
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = {w for w in set(windows) if windows.count(w) > 1} if len(windows) < 4000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
        covered = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)), d
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)
        raw = text.encode()
        if raw:
            assert r.ratio == len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw))
    assert [got[k].kept for k in range(3)] == [True] * 3
    bands = compression_rules.CompressionBands()
    assert bands.judged(os.urandom(20_000))[-1] == "INCOMPRESSIBLE" and bands.judged(b"so and so " * 900)[-1] == "REPETITIVE"
    mixed = own[2].encode() + b"so and so " * 1200
    assert bands.judged(mixed)[-1] in ("REPETITIVE", "REPETITIVE_CHUNKS")
    tail = own[2].encode() + os.urandom(10_000)
    assert bands.judged(tail)[-1] in ("INCOMPRESSIBLE", "INCOMPRESSIBLE_CHUNKS")


def test_chunks_cover_the_text():
    bands = compression_rules.CompressionBands(chunk=100)
    for n in (1, 49, 99, 100, 149, 150, 199, 200, 1049, 1050):
        raw = os.urandom(n)
        parts = bands.chunks(raw)
        assert b"".join(parts) == raw and (len(parts) == 1 or all(50 <= len(p) < 150 for p in parts))


def test_quality_rules_edges(spark):
    began = time.time()
    long = "word " * 400_000 + "\n" * 400_000
    rows = compression_rules.quality_rules(tables.documents(spark, [(1, long), (1, long), (None, None)])).collect()
    assert len(rows) == 3 and time.time() - began < 20 and not any(r.kept for r in rows)
    assert [(r.n_words, r.ratio, r.kept) for r in rows if r.doc_id is None] == [(0, None, False)]
    assert compression_rules.quality_rules(tables.documents(spark, [])).count() == 0


def brute(docs, labels):
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)
        rows.append((s or "", {k for k, v in fails.items() if v}, any(x == d is not None and q == 1 for x, q, _ in labels), any(x == d is not None and t1 == 1 for x, _, t1 in labels)))
    out, value = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] and bool(r[1] & set(order[:k])) for r in own)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                value[part, f] = value.get((part, f), 0) + len(gone)
    return {k: (*v, value[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def shown(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


SCHEMA = "doc_id bigint, text string, source string, part string, mask int, fp bigint, run bigint, q string"


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(3)
    own = [*texts(), "one two", "one two"]
    docs = [(d, rng.choice(own), rng.choice(["hot", "hot", None, "", "b"])) for d in range(300)]
    docs += [(d, own[0], "hot") for d in range(300, 700)] + [(7, docs[7][1], "b"), (7, docs[7][1], "b"), (7, "other", "b"), (None, own[0], "hot"), (None, "only null", "b"), (None, "only null", "b")]
    rng.shuffle(docs)
    labels = [(d, rng.randint(0, 1), rng.randint(0, 1)) for d in range(0, 700, 2)] + [(4, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(d, t, s, "x", 1, 2, 3, "y") for d, t, s in docs], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = brute(docs, labels)
    assert shown(filter_audit.filter_audit(df, marks)) == want and len(want) == 600 * len({s or "" for _, _, s in docs})
    # many small tasks, so that runs of copies span boundaries
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        rows = filter_audit.masked(df)
        assert shown(filter_audit.audit(filter_audit.counters(rows, marks))) == want
        halves = [filter_audit.counters(rows.where(c), marks) for c in ("part = 'b'", "part <> 'b'")]
        assert shown(filter_audit.audit(filter_audit.merged(*halves))) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert filter_audit.filter_audit(df.where("false"), marks).count() == 0


def test_filter_audit_equals_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = duckdb.sql(filter_audit.OP12_SQL).df()
    got = filter_audit.op12_filter_audit(spark, folder).toPandas()
    key = ["part", "filter_order", "step"]
    a, b = (x[sorted(x.columns)].sort_values(key).reset_index(drop=True) for x in (want, got))
    assert len(a) and a.equals(b.astype(a.dtypes.to_dict()))
