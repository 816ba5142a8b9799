import random

import pytest

from tidewatch.operators import fragments as fr

NS = fr.NS
SCHEMA = "received_ns bigint, sequence bigint, source_id string, tag string, total int, number int, sequence_id string, channel string, payload string, fill_bits int"


def one_by_one(rows, ends_at):
    """The rules, a part after the other, with all keys in sight: (received_ns, sequence, payload, fill_bits, code)."""
    open_, out = {}, []
    for t, seq, source, tag, total, number, sid, channel, payload, fill in sorted(rows):
        for key in [k for k, b in open_.items() if t - b["last"] > fr.TIMEOUT_NS]:
            out.append((t, open_.pop(key)["first"], None, None, "INCOMPLETE_FRAGMENT"))
        if total == 1:
            continue
        key = (source, tag, sid, channel, total)
        b = open_.get(key)
        if b and number in b["parts"]:
            if b["parts"][number] == payload:
                continue
            del open_[key]
            if number > 1:
                out.append((t, seq, None, None, "INVALID_FRAGMENT"))
                continue
            out.append((t, b["first"], None, None, "INCOMPLETE_FRAGMENT"))
        b = open_.setdefault(key, {"first": seq, "parts": {}, "fill": 0, "last": t})
        b["parts"][number], b["last"] = payload, t
        if number == total:
            b["fill"] = fill
        if len(b["parts"]) == total:
            out.append((t, seq, "".join(b["parts"][k] for k in sorted(b["parts"])), b["fill"], None))
            del open_[key]
    return sorted((*out, *((ends_at, b["first"], None, None, "INCOMPLETE_FRAGMENT") for b in open_.values())), key=str)


def feed(seed, n=500, step=12.0, keys=3):
    """Sentences of one to three parts: parts get lost, repeated, changed, swapped, and quiet hours lie between."""
    rng, rows, t = random.Random(seed), [], 1_704_067_200.0
    for k in range(n):
        t += rng.expovariate(1 / step) + (3 * 3600 if rng.random() < 0.01 else 0)
        total = rng.choice((1, 2, 2, 2, 3))
        sid, channel, body = str(rng.randrange(keys)), rng.choice("AB"), f"p{rng.randrange(6)}"
        numbers = [p for p in range(1, total + 1) if rng.random() > 0.08]
        numbers += [p for p in numbers if rng.random() < 0.1]
        if rng.random() < 0.3:
            rng.shuffle(numbers)
        for j, p in enumerate(numbers):
            text = f"{body}{p}" if rng.random() > 0.03 else f"x{k}"
            rows.append((int((t + j * rng.choice((0, 0.05, 1, 9))) * NS), len(rows), "s", "!AIVDM", total, p, sid, channel, text, 2 if p == total else 0))
    return rows


def shown(df):
    return sorted(((r.received_ns, r.sequence, r.payload, r.fill_bits, r.code) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "slice_s", "rounds"), [(1, 600, 3), (2, 60, 3), (3, 20, 1), (4, 20, 0)])
def test_slices_equal_one_by_one(spark, seed, slice_s, rounds):
    rows = feed(seed)
    df = spark.createDataFrame(random.Random(9).sample(rows, len(rows)), SCHEMA).repartition(5)
    last = max(r[0] for r in rows) + 5 * NS
    clock = df.selectExpr("received_ns", "true AS is_fragment").union(spark.createDataFrame([(last, False)], "received_ns bigint, is_fragment boolean"))
    want = one_by_one(rows, last)
    assert {w[4] for w in want} == {None, "INCOMPLETE_FRAGMENT", "INVALID_FRAGMENT"}
    assert shown(fr.assembled_parts(df.where("total > 1"), clock, slice_s * NS, rounds=rounds)) == want


def test_a_timeout_is_noticed_by_any_sentence(spark):
    rows = [(0, 0, "s", "!AIVDM", 2, 1, "9", "A", "ABC", 0), (31 * NS, 1, "s", "!AIVDM", 1, 1, "", "A", "XYZ", 0), (90 * NS, 2, "s", "!AIVDM", 2, 2, "9", "A", "DEF", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    clock = df.selectExpr("received_ns", "true AS is_fragment")
    assert shown(fr.assembled_parts(df.where("total > 1"), clock)) == [(31 * NS, 0, None, None, "INCOMPLETE_FRAGMENT"), (90 * NS, 2, None, None, "INCOMPLETE_FRAGMENT")]
    assert fr.assembled_parts(df.where("false")).count() == 0


def test_fill_bits_do_not_tell_repeats_apart(spark):
    rows = [(0, 0, "s", "!AIVDM", 2, 2, "1", "A", "DEF", 2), (NS, 1, "s", "!AIVDM", 2, 2, "1", "A", "DEF", 4), (2 * NS, 2, "s", "!AIVDM", 2, 1, "1", "A", "ABC", 0)]
    assert shown(fr.assembled_parts(spark.createDataFrame(rows, SCHEMA))) == [(2 * NS, 2, "ABCDEF", 2, None)]


def test_older_rule(spark):
    def run(*parts):
        rows = [(int(t * NS), k, "s", "!AIVDM", total, n, "1", "A", p, f) for k, (t, total, n, p, f) in enumerate(parts)]
        got = fr.assembled_parts(spark.createDataFrame(rows, SCHEMA), machine=fr.OldAssembler, keys=["sequence_id", "channel"], timeout_ns=1 << 62, slice_ns=60 * NS)
        return sorted((r.received_ns // NS, r.payload, r.fill_bits) for r in got.collect())

    assert run((0, 2, 1, "ABC", 0), (4000, 2, 2, "DEF", 2)) == [(4000, "ABCDEF", 2)]  # no timeout
    assert run((0, 2, 2, "DEF", 2), (1, 2, 2, "XXX", 3), (2, 2, 1, "ABC", 0)) == [(2, "ABCDEF", 0)]  # what is there stays, the last fill counts
    assert run((0, 2, 1, "ABC", 0), (1, 3, 3, "GHI", 0), (2, 2, 2, "DEF", 2)) == []  # beyond the first part's number: all is dropped
