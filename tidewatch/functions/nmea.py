"""NMEA envelope, checksum and six-bit payloads as column expressions; no UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.steps import held

#: Characters of the six-bit values 0 to 63, fixed values: of the payload armour and of base64.
ARMOUR = "0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVW`abcdefghijklmnopqrstuvw"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

#: Six-bit text alphabet, a fixed value of the message format.
ALPHABET = "@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_ !\"#$%&'()*+,-./0123456789:;<=>?"


def checksum(body: Column) -> Column:
    """XOR of all characters as two upper-case hex digits."""
    return F.lpad(F.hex(F.aggregate(F.split(body, ""), F.lit(0), lambda a, c: a.bitwiseXOR(F.ascii(c)))), 2, "0")


def checksum_state(sentence: Column) -> Column:
    """VALID, INVALID, MISSING or MALFORMED."""
    marker = F.instr(F.reverse(sentence), "*")
    body = F.substring(sentence, F.lit(2), F.length(sentence) - marker - 1)
    given = F.upper(F.substring(sentence, F.length(sentence) - marker + 2, F.lit(10)))
    return F.when(marker == 0, "MISSING").when(~sentence.startswith("!") | ~given.rlike("^[0-9A-F]{2}$"), "MALFORMED").when(checksum(body) == given, "VALID").otherwise("INVALID")


def with_envelope(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Add the seven fields and ``code``: the first thing that is wrong, null for a good sentence."""
    s = F.col(sentence)
    parts = F.split(F.regexp_replace(s, r"\*[^*]*$", ""), ",", -1)
    df = held(df, "f_", parts)
    field = lambda k: F.get("f_", F.lit(k))
    df = df.withColumns({"tag": field(0), "total": field(1).try_cast("int"), "number": field(2).try_cast("int"), "sequence_id": field(3), "channel": field(4), "payload": field(5), "fill_bits": field(6).try_cast("int")})
    ints = F.col("total").isNull() | F.col("number").isNull() | F.col("fill_bits").isNull()
    ranges = F.col("total").between(1, 9) & F.col("number").between(1, F.col("total")) & F.col("fill_bits").between(0, 5) & ((F.col("fill_bits") == 0) | (F.col("number") == F.col("total")))
    df = held(df, "state_", checksum_state(s))
    state = F.col("state_")
    code = (
        F.when(F.size("f_") != 7, "INVALID_NMEA_FORMAT").when(~F.col("tag").isin("!AIVDM", "!AIVDO"), "UNSUPPORTED_NMEA_SENTENCE").when(ints, "INVALID_NMEA_FORMAT")
        .when(~ranges, "INVALID_FRAGMENT").when(F.col("payload") == "", "INVALID_NMEA_FORMAT").when(state != "VALID", F.concat(F.lit("CHECKSUM_"), state))
    )
    return held(df.drop("code"), "code", code).drop("f_", "state_")


def packed(payload: Column) -> Column:
    """The first 480 bits of an armoured payload as hex digits, zeros behind its end; null if a character is outside the alphabet.

    Both the armour and base64 spell six bits a character, so one translation unpacks the whole payload.
    """
    return F.when(payload.rlike("^[0-W`-w]+$"), F.hex(F.unbase64(F.translate(F.rpad(payload, 80, "0"), ARMOUR, BASE64))))


def words(digits: Column) -> Column:
    """Eight numbers of 60 bits of what ``packed`` gave; hold that in a column first, it would be computed for each of them."""
    return F.when(digits.isNotNull(), F.array(*[F.conv(F.substring(digits, 15 * k + 1, 15), 16, 10).cast("bigint") for k in range(8)]))


def unsigned(w: Column, start: int, n: int) -> Column:
    """``n`` bits, 60 at most, from bit ``start`` of ``words``."""
    first, skipped = divmod(start, 60)
    behind = 60 - skipped - n
    word = F.get(w, F.lit(first))
    if behind >= 0:
        return F.shiftright(word, behind).bitwiseAND(F.lit((1 << n) - 1))
    head = F.shiftleft(word.bitwiseAND(F.lit((1 << (n + behind)) - 1)), -behind)
    return head.bitwiseOR(F.shiftright(F.get(w, F.lit(first + 1)), 60 + behind))


def signed(w: Column, start: int, n: int) -> Column:
    v = unsigned(w, start, n)
    return F.when(v >= 1 << (n - 1), v - (1 << n)).otherwise(v)


def letters(w: Column, start: int, n: int, alphabet: str = ALPHABET) -> Column:
    """``n`` bits as six-bit text."""

    def letter(at: Column) -> Column:
        word, skipped = F.floor(at / 60).cast("int"), F.pmod(at, F.lit(60))
        low = F.when(skipped > 54, F.get(w, word + 1)).otherwise(F.lit(0).cast("bigint"))
        both = F.call_function("shiftleft", F.get(w, word).bitwiseAND(F.lit((1 << 59) - 1)), F.greatest(skipped - 54, F.lit(0))).bitwiseOR(F.call_function("shiftright", low, F.lit(114) - skipped))
        value = F.when(skipped > 54, both).otherwise(F.call_function("shiftright", F.get(w, word), F.lit(54) - skipped)).bitwiseAND(F.lit(63))
        return F.substring(F.lit(alphabet), value.cast("int") + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(start), F.lit(start + n - 6), F.lit(6)), letter), "")


def text(w: Column, start: int, n: int) -> Column:
    """Six-bit text: trailing @ and spaces go, inner @ become spaces, empty is null."""
    raw = letters(w, start, n)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(raw, "[@ ]+$", ""), "@", " ")), F.lit(""))


def _position_words(w: Column, message_type: Column) -> Column:
    """The first 180 bits laid out as in types 1 to 3: type 18 has the same fields four bits earlier."""
    moved = [F.shiftright(F.get(w, F.lit(k)), 4) if not k else F.shiftright(F.get(w, F.lit(k)), 4).bitwiseOR(F.shiftleft(F.get(w, F.lit(k - 1)).bitwiseAND(F.lit(15)), 56)) for k in range(3)]
    return F.when(message_type == 18, F.array(*moved)).when(message_type.isin(1, 2, 3), F.slice(w, 1, 3))


def decoded(df: DataFrame, payload: str = "payload", fill: str = "fill_bits") -> DataFrame:
    """Fields of types 1, 2, 3, 18, 5 and 24, and ``code`` for what can't be decoded."""
    df = held(held(df, "packed_", packed(F.col(payload))), "b", words(F.col("packed_"))).withColumn("n_bits", F.length(payload) * 6 - F.col(fill))
    b = F.col("b")
    df = held(df, "message_type", F.when(F.col("n_bits") >= 38, unsigned(b, 0, 6)).cast("int")).withColumn("mmsi", unsigned(b, 8, 30).cast("int"))
    df = held(df, "p", _position_words(b, F.col("message_type")))
    p = F.col("p")
    t = F.col("message_type")
    position_a, position_b = t.isin(1, 2, 3), t == 18
    part = unsigned(b, 38, 2)
    least = F.when(position_a, 137).when(position_b, 147).when(t == 5, 270).when((t == 24) & (part == 0), 160).when((t == 24) & (part == 1), 162)
    known = t.isin(1, 2, 3, 5, 18, 24)
    df = df.withColumns({"lon": signed(p, 61, 28) / 600000.0, "lat": signed(p, 89, 27) / 600000.0})
    speed, course, head = unsigned(p, 50, 10), unsigned(p, 116, 12), unsigned(p, 128, 9)
    bad_place = (F.abs("lat") > 90) | (F.abs("lon") > 180) | ((F.col("lat") == 0) & (F.col("lon") == 0))
    code = (
        F.when(b.isNull() | (F.col("n_bits") < 38), "DECODE_FAILED").when(~known, "UNSUPPORTED_MESSAGE_TYPE").when(~F.col("mmsi").between(1, 999_999_999), "INVALID_MMSI")
        .when(least.isNull() | (F.col("n_bits") < least), "DECODE_FAILED").when((position_a | position_b) & bad_place, "INVALID_POSITION")
    )
    aux = F.floor(F.col("mmsi") / 10_000_000) == 98
    length = F.when(t == 5, unsigned(b, 240, 9) + unsigned(b, 249, 9)).when((t == 24) & (part == 1) & ~aux, unsigned(b, 132, 9) + unsigned(b, 141, 9))
    return held(df, "code", code).withColumns({
        "sog": F.when(speed < 1023, speed / 10.0), "cog": F.when(course < 3600, course / 10.0), "heading": F.when(head < 360, head.cast("double")), "nav_status": F.when(position_a, unsigned(b, 38, 4)).cast("int"),
        "class_b_mode": F.when(position_b, F.when(unsigned(b, 141, 1) == 1, "CARRIER_SENSE").otherwise("SELF_ORGANIZING")), "assigned": F.when(position_b, unsigned(b, 146, 1) == 1),
        "imo": F.when(t == 5, F.nullif(unsigned(b, 40, 30), F.lit(0))).cast("int"), "call_sign": F.when(t == 5, text(b, 70, 42)).when((t == 24) & (part == 1), text(b, 90, 42)),
        "vessel_name": F.when(t == 5, text(b, 112, 120)).when((t == 24) & (part == 0), text(b, 40, 120)), "ship_type": F.when(t == 5, unsigned(b, 232, 8)).when((t == 24) & (part == 1), unsigned(b, 40, 8)).cast("int"),
        "ship_length_m": F.nullif(length, F.lit(0)).cast("int"), "destination": F.when((t == 5) & (F.col("n_bits") >= 422), text(b, 302, 120)),
        "vessel_class": F.when(t.isin(18, 24), "B").otherwise("A"),
    }).drop("b", "p", "n_bits", "packed_")


def to_bits(value: Column, n: int) -> Column:
    """Two's complement of a value as n binary digits."""
    return F.right(F.concat(F.lit("0" * n), F.bin(value.cast("bigint"))), F.lit(n))


def text_numbers(value: Column, n: int) -> list[tuple[Column, int]]:
    """Six-bit text of ``n`` bits as fields of ``laid_out``, ten letters a number; what is missing at the end becomes @, what is not in the alphabet a space."""
    count = n // 6
    shown = F.regexp_replace(F.rpad(F.left(F.coalesce(value, F.lit("")), F.lit(count)), -(-count // 20) * 20, "@"), "[^ -_]", " ")
    digits = F.hex(F.unbase64(F.translate(shown, ALPHABET, BASE64)))
    sizes = [6 * min(10, count - k) for k in range(0, count, 10)]
    return [(F.shiftright(F.conv(F.substring(digits, 15 * k + 1, 15), 16, 10).cast("bigint"), 60 - size), size) for k, size in enumerate(sizes)]


def text_bits(value: Column, n: int) -> Column:
    """The same as a bit string."""
    return F.concat(*[to_bits(v, size) for v, size in text_numbers(value, n)])


def laid_out(*fields: tuple[Column | int, int]) -> Column:
    """Payload of numbers of at most 60 bits, given with their widths, one behind the other and padded with zero bits to whole characters.

    They are shifted into numbers of 60 bits, as ``unsigned`` takes them out; bit strings took several times as long.
    """
    pieces: dict[int, list[Column]] = {}
    at = 0
    for value, n in fields:
        if not isinstance(value, int) or value:
            v = (F.lit(value) if isinstance(value, int) else value).cast("bigint").bitwiseAND(F.lit((1 << n) - 1))
            first, skipped = divmod(at, 60)
            behind = 60 - skipped - n
            pieces.setdefault(first, []).append(F.shiftleft(v, behind) if behind >= 0 else F.shiftright(v, -behind))
            if behind < 0:
                pieces.setdefault(first + 1, []).append(F.shiftleft(v.bitwiseAND(F.lit((1 << -behind) - 1)), 60 + behind))
        at += n
    digits = [F.lpad(F.hex(reduce(Column.bitwiseOR, pieces.get(k, [F.lit(0)]))), 15, "0") for k in range(-(-at // 120) * 2)]
    return F.left(F.translate(F.base64(F.unhex(F.concat(*digits))), BASE64, ARMOUR), F.lit(-(-at // 6)))


def armoured(b: Column) -> Column:
    """Payload of a bit string, padded with zero bits to whole characters."""
    pairs = F.ceil(F.length(b) / 120).cast("int")
    word = lambda k: F.lpad(F.conv(F.rpad(F.substring(b, k * 60 + 1, F.lit(60)), 60, "0"), 2, 16), 15, "0")
    digits = F.array_join(F.transform(F.sequence(F.lit(0), pairs * 2 - 1), word), "")
    return F.left(F.translate(F.base64(F.unhex(digits)), BASE64, ARMOUR), F.ceil(F.length(b) / 6).cast("int"))


def sentence(payload: Column, fill: Column | None = None, total: int = 1, number: int = 1, sequence_id: Column | None = None) -> Column:
    """A sentence with its checksum; of several parts if ``total`` says so."""
    head = F.concat(F.lit(f"AIVDM,{total},{number},"), sequence_id.cast("string") if sequence_id is not None else F.lit(""), F.lit(",A,"))
    body = F.concat(head, payload, F.lit(","), fill if fill is not None else F.lit("0"))
    return F.concat(F.lit("!"), body, F.lit("*"), checksum(body))
