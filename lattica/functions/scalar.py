"""Scalar functions on columns: casts that give null where a value does not fit, times as cyclic pairs, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 2048
NO_LIMIT = 9223372036854775807
#: Periods of the cyclic slots: second, minute, hour, weekday, day, month, day of the year.
PERIODS = (60, 60, 24, 7, 31, 12, 366)
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def as_long(c: Column) -> Column:
    return c.try_cast("bigint")


def as_double(c: Column) -> Column:
    return c.try_cast("double")


def as_text(c: Column) -> Column:
    return c.cast("string")


def as_boolean(c: Column) -> Column:
    return c.try_cast("boolean")


def as_time(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without zone, negative before."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), time)


def time_of(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr(EPOCH))


def zscore(x: Column, mean: Column | float, std: Column | float) -> Column:
    """(x - mean) / std, 0 where std is not above 0."""
    mean, std = (c if isinstance(c, Column) else F.lit(float(c)) for c in (mean, std))
    return F.when(x.isNull(), None).when(std > 0, (x - mean) / std).otherwise(F.lit(0.0))


def time_parts(time: Column) -> list[Column]:
    """Second, minute, hour, weekday from Monday, day, month and day of the year, all from 0."""
    return [F.second(time), F.minute(time), F.hour(time), F.weekday(time), F.day(time) - 1, F.month(time) - 1, F.dayofyear(time) - 1]


def time_vector(time: Column, mean: Column | float, std: Column | float) -> Column:
    """15 floats: sine and cosine of each part over its period, then the z-score of the microseconds; null for null."""
    out = []
    for part, period in zip(time_parts(time), PERIODS, strict=True):
        angle = part * F.lit(2 * 3.141592653589793 / period)
        out += [F.sin(angle), F.cos(angle)]
    out.append(zscore(micros(time).cast("double"), mean, std))
    return F.when(time.isNotNull(), F.array(*[x.cast("float") for x in out]))


def time_from_z(z: Column, mean: float, std: float) -> Column:
    return z * F.lit(std) + F.lit(mean)


def shown_time(us: Column, seconds: bool = False) -> Column:
    return F.when(us == NO_LIMIT, F.lit("MAX")).otherwise(F.date_format(time_of(us), "yyyy-MM-dd HH:mm" + ":ss" * seconds))


def truncated(text: Column, most: int = MOST_BYTES) -> Column:
    """text cut to at most so many bytes of UTF-8, at a character's boundary.

    The bytes before the cut are taken; if the byte behind it continues a character, that character's begin goes too.
    A byte continues one if it is 80 to BF, so at most three have to be looked at.
    """
    raw = text.cast("binary")
    byte = lambda at: F.hex(F.substring(raw, at, 1))
    goes_on = lambda at: byte(at).between("80", "BF")
    size = F.lit(most)
    for back in range(3):
        size = F.when(goes_on(most + 1 - back) if back == 0 else (size == most - back) & goes_on(most + 1 - back), most - back - 1).otherwise(size)
    cut = F.substring(raw, F.lit(1), size).cast("string")
    return F.when(F.octet_length(text) <= most, text).otherwise(cut)


def column_text(table: str, column: str, description: str | None) -> str:
    """What is embedded for a column."""
    return f"{column} of {table}: {description}" if description else f"{column} of {table}"


def category_text(column: str, value: Column) -> Column:
    return F.concat(F.lit(f"{column} is "), value)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def shortened(v: Column, size: int) -> Column:
    """The first components, scaled to a length of 1; zeros stay zeros."""
    head = F.slice(v, 1, size)
    n = norm(head)
    return F.transform(head, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float"))


def packed_bits(bits: list[bool]) -> bytes:
    """Bits of an exported mask, least significant first, padded to 8 bytes."""
    import numpy as np

    raw = np.packbits(np.asarray(bits, bool), bitorder="little").tobytes()
    return raw + b"\0" * (-len(raw) % 8)


def packed_rows(df: DataFrame, row: str, predicate: Column) -> DataFrame:
    """(byte, bits): a bitmap of the rows of which a predicate is true, eight rows a byte, the least significant first.

    Null counts as false; bytes without a row of df are absent. Rows must not repeat.
    """
    set_ = F.when(predicate, F.call_function("shiftleft", F.lit(1), (F.col(row) % 8).cast("int"))).otherwise(0)
    return df.groupBy(F.floor(F.col(row) / 8).alias("byte")).agg(F.sum(set_).cast("int").alias("bits"))


def bit_of(bits: Column, row: Column) -> Column:
    """Whether the row's bit is set in its byte."""
    return F.call_function("shiftright", bits, (row % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def bit(mask: bytes, i: int) -> bool:
    return bool(mask[i >> 3] >> (i & 7) & 1)
