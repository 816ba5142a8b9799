import functools
import socket
import time

from pyspark.sql import functions as F

from tidewatch.functions import nmea
from tidewatch.streaming import input as live_input
from tidewatch.streaming import live, relay

NS = 1_000_000_000
START = 1_704_067_200 * NS


def rows(spark, folder):
    return spark.read.schema(relay.SCHEMA).parquet(str(folder)).orderBy("sequence").collect()


def test_datagrams_become_lines_of_files(spark, tmp_path):
    own = relay.Relay(str(tmp_path), port=0, every_s=0.1).start()
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(b"!one\r\n!two\n\n", own.socket.getsockname())
        s.sendto(b"!three \xff", own.socket.getsockname())
        until = time.time() + 10
        while own.sequence < 3 and time.time() < until:
            time.sleep(0.05)
    own.stop()
    got = rows(spark, tmp_path)
    assert [r.sentence for r in got] == ["!one", "!two", "!three �"] and [r.sequence for r in got] == [1, 2, 3]
    assert len({r.session for r in got}) == 1 and all(abs(r.received_ns - time.time_ns()) < 60 * NS for r in got)


def test_overflow_is_told_and_begins_a_session(spark, tmp_path):
    own = relay.Relay(str(tmp_path), most=3)
    taken = [own.offer(START + k * NS, f"!{k}") for k in range(6)]
    assert taken == [True] * 3 + [False] * 3
    own.drain()
    assert own.offer(START + 6 * NS, "!6")
    own.pause()
    assert not own.offer(START + 7 * NS, "!7")
    own.resume()
    own.offer(START + 8 * NS, "!8")
    own.stop()
    got = rows(spark, tmp_path)
    assert [r.sentence or r.code for r in got] == ["!0", "!1", "!2", "SOURCE_OVERFLOW", "!6", "LIVE_PAUSE", "!8"]
    assert [r.session - got[0].session for r in got] == [0, 0, 0, 1, 1, 2, 2]
    period = relay.exclusion_periods(spark.read.schema(relay.SCHEMA).parquet(str(tmp_path))).where("code = 'SOURCE_OVERFLOW'").first()
    assert (period.start_ns, period.end_ns, period.dropped) == (START + 3 * NS, START + 6 * NS, 3)
    late = relay.Relay(str(tmp_path / "late"), most=1)
    assert [late.offer(START, "!a"), late.offer(START, "!b")] == [True, False]
    late.stop()
    assert [(r.code, r.dropped) for r in rows(spark, tmp_path / "late")] == [(None, None), ("SOURCE_OVERFLOW", 1)]


def report(k):
    bits = lambda v, w: format(v & ((1 << w) - 1), f"0{w}b")
    b = bits(1, 6) + "00" + bits(431000001, 30) + bits(0, 4) + "0" * 8 + bits(50, 10) + "0" + bits(135 * 600000 + k, 28) + bits(34 * 600000, 27) + bits(100, 12) + bits(511, 9) + "0" * 31
    payload = "".join(nmea.ARMOUR[int(b[j : j + 6].ljust(6, "0"), 2)] for j in range(0, len(b), 6))
    body = f"AIVDM,1,1,,A,{payload},0"
    return f"!{body}*{functools.reduce(lambda a, c: a ^ ord(c), body, 0):02X}"


def test_from_datagrams_to_intervals(spark, tmp_path):
    """Lost lines cut the interval over them: it is no loss of radio."""
    own = relay.Relay(f"{tmp_path}/lines", most=3)
    for k in range(6):
        own.offer(START + 10 * k * NS, report(k))
    own.drain()
    for k in (6, 7):
        own.offer(START + 10 * k * NS, report(k))
    own.stop()
    before = {k: spark.conf.get(k) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")}
    live_input.ready(spark)
    try:
        first = live_input.live_outcomes(relay.read_relays(spark, f"{tmp_path}/lines")).writeStream.format("parquet").option("path", f"{tmp_path}/outcomes").option("checkpointLocation", f"{tmp_path}/s1").start()
        first.processAllAvailable()
        first.stop()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    outcomes = spark.read.parquet(f"{tmp_path}/outcomes")
    shown = relay.frame(outcomes).first()
    assert (shown.outcomes, shown.decoded, shown.diagnostics, shown.last_second) == (6, 5, 1, 1)
    stream = spark.readStream.schema(outcomes.schema).parquet(f"{tmp_path}/outcomes")
    second = live.write_intervals(live.live_intervals(live_input.live_reports(stream)), f"{tmp_path}/intervals", f"{tmp_path}/s2")
    second.processAllAvailable()
    second.stop()
    got = [(r.start_ns and (r.ts_ns - r.start_ns) // NS, r.reason) for r in spark.read.parquet(f"{tmp_path}/intervals").orderBy(F.col("ts_ns")).collect()]
    assert got == [(None, "FIRST_REPORT"), (10, None), (10, None), (40, "LIVE_PAUSE_BOUNDARY"), (10, None)]
