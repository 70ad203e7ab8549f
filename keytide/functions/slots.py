"""Hash slots, hash tags, slot lists and small text parsers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

N_SLOTS = 16384
#: Fixed value: the CRC-16 polynomial; start 0, no reflection.
CRC16_POLY = 0x1021


def _crc16_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ CRC16_POLY if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


def hash_tag(key: Column) -> Column:
    """What of a key is hashed: between the first { and the first } after it, if not empty; else the whole key."""
    return F.coalesce(F.nullif(F.regexp_extract(key, r"(?s)^[^{]*\{([^}]+)\}", 1), F.lit("")), key)


def crc16(data: Column) -> Column:
    """CRC-16 of a binary column, a table step a byte; read as Latin-1, each byte is a letter with its number as code."""
    table = F.lit(_crc16_table())
    letters = F.filter(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: c != "")

    def step(crc: Column, letter: Column) -> Column:
        return F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFF00)).bitwiseXOR(F.get(table, F.shiftright(crc, 8).bitwiseXOR(F.ascii(letter)).bitwiseAND(F.lit(0xFF))))

    return F.aggregate(letters, F.lit(0), step)


def hash_slot(key: Column) -> Column:
    """Slot of a string key: CRC-16 of its hash tag, modulo the number of slots."""
    return crc16(F.encode(hash_tag(key), "UTF-8")).bitwiseAND(F.lit(N_SLOTS - 1))


def slot_list(text: Column, dash: str = "-") -> Column:
    """Distinct slots of '0,5-10,16', ascending; null where the text isn't such a list, a slot is too large or a range descends."""
    parts = F.split(text, ",", -1)
    low = lambda p: F.split_part(p, F.lit(dash), F.lit(1)).cast("int")
    high = lambda p: F.when(F.contains(p, F.lit(dash)), F.split_part(p, F.lit(dash), F.lit(2))).otherwise(p).cast("int")
    shape = text.rlike(rf"^[0-9]{{1,5}}({dash}[0-9]{{1,5}})?(,[0-9]{{1,5}}({dash}[0-9]{{1,5}})?)*$")
    good = F.when(shape, F.forall(parts, lambda p: (low(p) <= high(p)) & (high(p) < N_SLOTS))).otherwise(F.lit(False))
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p)))))))


def slot_config_valid(text: Column) -> Column:
    """One slot or one lo:hi in range; the empty text means no slots."""
    low, high = F.split_part(text, F.lit(":"), F.lit(1)), F.split_part(text, F.lit(":"), F.lit(-1))
    number = lambda c: c.try_cast("long")
    return (text == "") | (text.rlike("^[0-9]+(:[0-9]+)?$") & (number(low) <= number(high)) & (number(high) < N_SLOTS))


def node_id(dbid: Column, number: Column) -> Column:
    return F.format_string("%s%08x", F.substring(dbid, 1, 32), number)


def address(text: Column) -> Column:
    """Struct (host, port) cut at the last colon; null if the port isn't in 1..65535. Hosts are cut at 255 characters."""
    port = F.regexp_extract(text, ":([0-9]+)$", 1).try_cast("int")
    host = F.regexp_extract(text, "^(.*):[0-9]+$", 1)
    return F.when(port.between(1, 65535), F.struct(F.substring(host, 1, 255).alias("host"), port.alias("port")))


def moved_address(reply: Column) -> Column:
    """The address in a redirect reply, with or without a slot: its last word."""
    return address(F.split_part(reply, F.lit(" "), F.lit(-1)))


def glob_to_regex(pattern: str) -> str:
    """A glob (* ? [set] \\x) as an anchored regular expression."""
    import re

    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[:1] == "^" else inner).replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_column(pattern: Column) -> Column:
    """Globs of * and ? as regular expressions, inside the JVM."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def addresses_joined(a: Column, b: Column) -> Column:
    """Two lists of addresses as one, each address at its first place."""
    return F.array_union(a, b)
