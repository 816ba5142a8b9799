"""The older decoder, for comparison with figures made by it: no checksum, looser sentences, parts without a timeout, short messages read as far as they go.

Fields are null where the payload ends before them. Unlike ``nmea.decoded`` it keeps (0, 0), any station number and an IMO number of 0, and
takes type 18 from 133 bits; letters come from a shorter alphabet (no punctuation).
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import nmea
from tidewatch.functions.steps import held
from tidewatch.operators import fragments

#: Its letters: @, A to Z, a space, the ten digits, and spaces.
LETTERS = ("@" + string.ascii_uppercase + " " + string.digits).ljust(64)
KEYS = ["sequence_id", "channel"]


def envelope(lines: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Sentences with seven fields or more; a number that can't be read is 1, fill bits 0."""
    s = F.trim(F.col(sentence))
    df = held(lines.where(s.startswith("!AIVDM") | s.startswith("!AIVDO")), "f_", F.split(s, ",")).where(F.size("f_") >= 7)
    number = lambda k, other: F.coalesce(F.get("f_", F.lit(k)).try_cast("int"), F.lit(other))
    fill = F.coalesce(F.split(F.get("f_", F.lit(6)), r"\*")[0].try_cast("int"), F.lit(0))
    return df.select(*lines.columns, F.get("f_", F.lit(0)).alias("tag"), number(1, 1).alias("total"), number(2, 1).alias("number"), F.get("f_", F.lit(3)).alias("sequence_id"), F.get("f_", F.lit(4)).alias("channel"), F.get("f_", F.lit(5)).alias("payload"), fill.alias("fill_bits"))


def assembled(rows: DataFrame) -> DataFrame:
    """Whole payloads of ``envelope`` rows with received_ns, sequence and source_id, in order of arrival."""
    single = rows.where("total <= 1").withColumn("code", F.lit(None).cast("string")).select(*fragments.OUTCOME)
    return single.unionByName(fragments.assembled_parts(rows.where("total > 1"), machine=fragments.OldAssembler, keys=KEYS, timeout_ns=1 << 62)).drop("code")


def decoded(rows: DataFrame) -> DataFrame:
    """Messages of 38 bits and more with the fields that their length holds."""
    df = held(held(rows, "packed_", nmea.packed(F.col("payload"))), "b", nmea.words(F.col("packed_")))
    df = held(df.withColumn("n_bits", F.greatest(F.lit(0), F.length("payload") * 6 - F.greatest(F.lit(0), F.col("fill_bits")))), "message_type", nmea.unsigned(F.col("b"), 0, 6).cast("int"))
    df = held(df.where("n_bits >= 38 AND b IS NOT NULL"), "p", nmea._position_words(F.col("b"), F.col("message_type")))
    b, p, t, n = F.col("b"), F.col("p"), F.col("message_type"), F.col("n_bits")
    there = (t.isin(1, 2, 3) & (n >= 137)) | ((t == 18) & (n >= 133))
    units = (t == 18) & (n >= 147)
    static = lambda least, value: F.when((t == 5) & (n >= least), value)
    letters = lambda start, count: F.trim(F.replace(nmea.letters(b, start, count, LETTERS), F.lit("@"), F.lit(" ")))
    speed, course, head = nmea.unsigned(p, 50, 10), nmea.unsigned(p, 116, 12), nmea.unsigned(p, 128, 9)
    return df.withColumn("mmsi", nmea.unsigned(b, 8, 30).cast("int")).withColumns({
        "nav_status": F.when(there & (t != 18), nmea.unsigned(b, 38, 4)).cast("int"), "sog": F.when(there & (speed < 1023), speed / 10.0), "lon": F.when(there, nmea.signed(p, 61, 28) / 600000.0), "lat": F.when(there, nmea.signed(p, 89, 27) / 600000.0),
        "cog": F.when(there & (course < 3600), course / 10.0), "heading": F.when(there & (head < 360), head.cast("double")),
        "class_b_mode": F.when(units, F.when(nmea.unsigned(b, 141, 1) == 1, "CARRIER_SENSE").otherwise("SELF_ORGANIZING")), "assigned": F.when(units, nmea.unsigned(b, 146, 1) == 1),
        "imo": static(70, nmea.unsigned(b, 40, 30)).cast("int"), "call_sign": static(112, letters(70, 42)), "vessel_name": static(232, letters(112, 120)), "ship_type": static(240, nmea.unsigned(b, 232, 8)).cast("int"),
        "ship_length_m": static(270, nmea.unsigned(b, 240, 9) + nmea.unsigned(b, 249, 9)).cast("int"), "destination": static(422, letters(302, 120)),
    }).drop("b", "p", "packed_")


def messages(lines: DataFrame) -> DataFrame:
    """All steps: ``lines(received_ns, sequence, source_id, sentence)`` to messages."""
    return decoded(assembled(envelope(lines)))
