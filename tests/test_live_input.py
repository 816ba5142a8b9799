import random

from pyspark.sql import functions as F

from tidewatch.functions import nmea
from tidewatch.operators import fragments, ingest
from tidewatch.streaming import input as live_input

NS = 1_000_000_000
START = 1_704_067_200 * NS


def feed(spark, n=240):
    """Lines of position reports, static reports in two parts, repeats within and beyond a second, junk and lost parts."""
    rng = random.Random(4)
    bits = lambda v, w: format(v & ((1 << w) - 1), f"0{w}b")
    armour = lambda b: "".join(nmea.ARMOUR[int(b[k : k + 6].ljust(6, "0"), 2)] for k in range(0, len(b), 6))

    def line(payload, fill=0, total=1, number=1, sid="", good=True):
        body = f"AIVDM,{total},{number},{sid},A,{payload},{fill}"
        mark = 0
        for c in body:
            mark ^= ord(c)
        return f"!{body}*{mark if good else mark ^ 1:02X}"

    rows, t = [], 0.0
    put = lambda at, text: rows.append((START + int(at * 1000) * 1_000_000, f"{len(rows):06d}", text))
    for k in range(n):
        t += rng.choice((0.3, 2, 11, 40))
        mmsi = 431_000_000 + rng.randrange(3)
        report = armour(bits(1, 6) + "00" + bits(mmsi, 30) + bits(rng.randrange(3), 4) + "0" * 8 + bits(rng.randrange(2) * 50, 10) + "0" + bits(135 * 600000, 28) + bits(34 * 600000 + k % 2, 27) + bits(100, 12) + bits(511, 9) + "0" * 31)
        static = armour(bits(5, 6) + "00" + bits(mmsi, 30) + "00" + bits(9000000 + k % 5, 30) + "0" * 352 + "00")
        way = rng.randrange(8)
        if way < 3:
            put(t, line(report))
            if way == 1:
                put(t + 0.9, line(report))
                put(t + 1.8, line(report))
                put(t + 2.9, line(report))
        elif way == 3:
            put(t, line(report, good=False))
        elif way == 4:
            put(t, "hello")
        else:
            first, second = line(static[:60], 0, 2, 1, str(k % 3)), line(static[60:], 0, 2, 2, str(k % 3))
            for at, text in (((t, first),) if way == 5 else ((t, second), (t + 0.1, first)) if way == 6 else ((t, first), (t + 0.05, first), (t + rng.choice((0.1, 20, 35)), second))):
                put(at, text)
    rows.sort()
    return spark.createDataFrame(rows, "received_ns bigint, sequence string, sentence string")


def shown(df, timed=True):
    return sorted(((r.received_ns if timed or r.code != "INCOMPLETE_FRAGMENT" else None, r.sequence, r.payload, r.mmsi, r.imo, r.code) for r in df.select("received_ns", "sequence", "payload", "mmsi", "imo", "code").collect()), key=str)


def test_stream_and_batch_give_equal_outcomes(spark, tmp_path):
    batch = feed(spark)
    cuts = batch.approxQuantile("received_ns", [0.3, 0.6], 0.0)
    for k, part in enumerate((batch.where(F.col("received_ns") <= cuts[0]), batch.where((F.col("received_ns") > cuts[0]) & (F.col("received_ns") <= cuts[1])), batch.where(F.col("received_ns") > cuts[1]))):
        part.orderBy(F.rand(1)).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    before = {k: spark.conf.get(k) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")}
    live_input.ready(spark)
    try:
        stream = spark.readStream.schema(batch.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")

        def run():
            query = live_input.live_outcomes(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
            query.processAllAvailable()
            query.stop()

        run()
        run()  # from the checkpoint again: nothing comes twice
        left = live_input.unfinished(spark, f"{tmp_path}/state")
        got = spark.read.parquet(f"{tmp_path}/out").unionByName(left, allowMissingColumns=True)
        raw = batch.withColumn("source_id", F.lit("live"))
        framed = nmea.with_envelope(raw)
        rows = framed.where("NOT (code IS NULL AND total > 1)").select(*fragments.OUTCOME).unionByName(fragments.assembled_parts(framed.where("code IS NULL AND total > 1"), framed.selectExpr("received_ns", "code IS NULL AS is_fragment")))
        want = ingest.finished(rows)
        assert shown(got, timed=False) == shown(want, timed=False)
        codes = {r[5] for r in shown(want)}
        assert codes >= {None, "DUPLICATE", "INCOMPLETE_FRAGMENT", "CHECKSUM_INVALID", "INVALID_NMEA_FORMAT"} and left.count() > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
