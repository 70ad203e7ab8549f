"""Byte and bit expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_values(data: Column) -> Column:
    """Array of the unsigned bytes of a binary column."""
    text, n = F.hex(data), F.octet_length(data)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def bitcount(data: Column) -> Column:
    """Bits set in all bytes."""
    return F.aggregate(byte_values(data), F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b))


def getbit(data: Column, offset: int) -> Column:
    """Bit at offset, the highest of a byte first; 0 beyond the end."""
    byte = F.get(byte_values(data), F.lit(offset // 8))
    return F.coalesce(F.shiftright(byte, 7 - offset % 8).bitwiseAND(F.lit(1)), F.lit(0))


def setbit(data: Column, offset: int, bit: int) -> Column:
    """Bytes with one bit set or cleared, filled with zeros up to it."""
    raw = byte_values(data)
    padded = F.concat(raw, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(offset // 8 + 1) - F.size(raw))))
    mask = 1 << (7 - offset % 8)
    change = lambda b: b.bitwiseOR(F.lit(mask)) if bit else b.bitwiseAND(F.lit(255 - mask))
    return from_bytes(F.transform(padded, lambda b, i: F.when(i == offset // 8, change(b)).otherwise(b)))


def from_bytes(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), ""))


def bitop(op: str, a: Column, b: Column) -> Column:
    """Bytewise and, or, xor; the shorter side is filled with zeros. not takes a alone."""
    if op == "not":
        return from_bytes(F.transform(byte_values(a), lambda x: F.lit(255) - x))
    act = {"and": Column.bitwiseAND, "or": Column.bitwiseOR, "xor": Column.bitwiseXOR}[op]
    return from_bytes(F.zip_with(byte_values(a), byte_values(b), lambda x, y: act(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))))


def getrange(data: Column, start: int, end: int) -> Column:
    """Bytes start..end, both in, negative from the end."""
    n = F.octet_length(data)
    low = F.greatest(F.lit(0), (n + start) if start < 0 else F.lit(start))
    high = F.least(n - 1, (n + end) if end < 0 else F.lit(end))
    return F.substring(data, low + 1, F.greatest(F.lit(0), high - low + 1))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6372797.560856) -> Column:
    """Great-circle metres between points in degrees. The radius is a fixed value."""
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))


def geohash(lon: Column, lat: Column, length: int = 11) -> Column:
    """Base-32 geohash: bits of longitude and latitude in turn, five a letter."""
    n = length * 5
    cell = lambda x, low, high, bits: F.least(F.lit((1 << bits) - 1), F.floor((x - low) / (high - low) * (1 << bits))).cast("long")
    n_lon, n_lat = (n + 1) // 2, n // 2
    x, y = cell(lon, -180.0, 180.0, n_lon), cell(lat, -90.0, 90.0, n_lat)
    letters = F.lit("0123456789bcdefghjkmnpqrstuvwxyz")
    bit = lambda k: F.shiftright(x if k % 2 == 0 else y, (n_lon if k % 2 == 0 else n_lat) - 1 - k // 2).bitwiseAND(F.lit(1).cast("long"))
    out = []
    for at in range(0, n, 5):
        value = F.lit(0).cast("long")
        for k in range(at, at + 5):
            value = value * 2 + bit(k)
        out.append(F.substring(letters, (value + 1).cast("int"), F.lit(1)))
    return F.concat(*out)
