"""Wire codecs of log payloads. Bad input gives None, never a part of a row.

Fixed values, formats: an integer is a prefix letter, decimal digits and a line feed; a string is $, its length, a line
feed, its bytes and a line feed. A command array is *2, then *3 with asking, flags and access
list (empty: none), then its commands, each a count of strings. Functions of columns apply these through Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Bad(ValueError):
    """The bytes aren't what they should be."""


def put_int(prefix: bytes, value: int) -> bytes:
    return b"%c%d\n" % (prefix, value)


def put_str(value: bytes | None) -> bytes:
    """A string; none is written as the empty one."""
    return b"$%d\n%s\n" % (len(value or b""), value or b"")


class Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def line(self, prefix: bytes) -> bytes:
        end = self.data.find(b"\n", self.at)
        if end < 0 or self.data[self.at : self.at + 1] != prefix:
            raise Bad(f"no {prefix!r} at {self.at}")
        found, self.at = self.data[self.at + 1 : end], end + 1
        return found

    def int(self, prefix: bytes) -> int:
        digits = self.line(prefix)
        if not digits.isdigit():
            raise Bad(f"not a number: {digits!r}")
        return int(digits)

    def word(self) -> bytes:
        digits = self.line(b"$")
        if not digits.isdigit():
            raise Bad(f"not a length: {digits!r}")
        n = int(digits)
        found = self.data[self.at : self.at + n]
        if len(found) != n or self.data[self.at + n : self.at + n + 1] != b"\n":
            raise Bad("a string is cut short")
        self.at += n + 1
        return found

    def end(self) -> None:
        if self.at != len(self.data):
            raise Bad("bytes are left over")


def encode_commands(commands: Iterable[Iterable[bytes]], asking: bool = False, flags: int = 0, acl: bytes | None = None) -> bytes:
    commands = [list(c) for c in commands]
    head = put_int(b"*", 2) + put_int(b"*", 3) + put_int(b":", int(asking)) + put_int(b":", flags) + put_str(acl)
    return head + put_int(b"*", len(commands)) + b"".join(put_int(b"*", len(c)) + b"".join(map(put_str, c)) for c in commands)


def decode_commands(data: bytes) -> dict:
    c = Cursor(data)
    if c.int(b"*") != 2 or c.int(b"*") != 3:
        raise Bad("not a command array")
    asking, flags, acl = c.int(b":"), c.int(b":"), c.word()
    n = c.int(b"*")
    if not n:
        raise Bad("no commands")
    commands = []
    for _ in range(n):
        size = c.int(b"*")
        if not size:
            raise Bad("an empty command")
        commands.append([c.word() for _ in range(size)])
    c.end()
    return {"asking": bool(asking), "cmd_flags": flags, "acl": acl.decode("utf-8", "replace") if acl else None, "commands": commands}


def encode_import(term: int, session_key: int, entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    entries = list(entries)
    return b"".join([put_int(b"*", term), put_int(b"*", session_key), put_int(b"*", len(entries)), *(put_str(x) for e in entries for x in e)])


def decode_import(data: bytes) -> dict:
    c = Cursor(data)
    term, session, n = c.int(b"*"), c.int(b"*"), c.int(b"*")
    if not term or not n:
        raise Bad("no term or no keys")
    return {"term": term, "session_key": session, "entries": [(c.word(), c.word()) for _ in range(n)]}


def encode_lock_keys(keys: Iterable[bytes]) -> bytes:
    """Distinct keys in byte order, each ended by a zero byte; keys that hold one don't survive this format."""
    found = sorted(set(keys))
    return put_int(b"*", len(found)) + b"".join(k + b"\0" for k in found)


def decode_lock_keys(data: bytes) -> list[bytes]:
    c = Cursor(data)
    n = c.int(b"*")
    parts = data[c.at :].split(b"\0")
    if parts[-1] != b"" or len(parts) - 1 != n:
        raise Bad("another number of keys")
    return parts[:-1]


def encode_timeout(idx: int, error: bool) -> bytes:
    return put_int(b"*", idx) + put_int(b"*", int(error))


def decode_timeout(data: bytes) -> dict:
    c = Cursor(data)
    found = {"idx": c.int(b"*"), "error": bool(c.int(b"*"))}
    c.end()
    return found


def encode_shard_group(group: dict) -> str:
    """Lines: id, numbers of ranges and nodes, then each range (start, end, type, session key) and node (id, host:port)."""
    lines = [group["id"], len(group["slot_ranges"]), len(group["nodes"])]
    for r in group["slot_ranges"]:
        lines += [r["start"], r["end"], r["type"], r["session_key"]]
    for n in group["nodes"]:
        lines += [n["node_id"], f"{n['host']}:{n['port']}"]
    return "".join(f"{x}\n" for x in lines)


def decode_shard_group(text: str) -> dict:
    lines = text.split("\n")
    try:
        n_ranges, n_nodes = int(lines[1]), int(lines[2])
        if len(lines) != 4 + 4 * n_ranges + 2 * n_nodes or lines[-1] or len(lines[0]) > 32:
            raise Bad("another number of lines")
        ranges = [dict(zip(("start", "end", "type", "session_key"), map(int, lines[3 + 4 * k : 7 + 4 * k]))) for k in range(n_ranges)]
        nodes = []
        for k in range(n_nodes):
            name, where = lines[3 + 4 * n_ranges + 2 * k : 5 + 4 * n_ranges + 2 * k]
            host, _, port = where.rpartition(":")
            nodes.append({"node_id": name, "host": host, "port": int(port)})
    except (IndexError, ValueError) as e:
        raise Bad(str(e)) from e
    return {"id": lines[0], "slot_ranges": ranges, "nodes": nodes}


def int_length(value: Column) -> Column:
    """Room for an encoded integer: a prefix, its digits and a line feed, 22 from eight digits on."""
    digits = F.length(value.cast("string"))
    return F.when(digits > 7, 22).otherwise(digits + 2)


def decode_commands_column(data: Column) -> Column:
    """Struct (asking, cmd_flags, acl, commands) of a binary column; null fields where the bytes are bad."""
    names = ("asking", "cmd_flags", "acl", "commands")

    @F.pandas_udf("asking boolean, cmd_flags long, acl string, commands array<array<binary>>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                rows.append(decode_commands(bytes(x)) if x is not None else {})
            except Bad:
                rows.append({})
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return run(data)


def _line(prefix: str, number: Column) -> Column:
    return F.encode(F.concat(F.lit(prefix), number.cast("string"), F.lit("\n")), "UTF-8")


def encode_commands_column(commands: Column, asking: Column | None = None, flags: Column | None = None, acl: Column | None = None) -> Column:
    """Bytes of an array<array<binary>> column, inside the JVM; without an access list the empty one is written."""
    end, none = F.lit(b"\n"), F.lit(b"")
    listed = F.coalesce(F.encode(acl, "UTF-8"), none) if acl is not None else none
    head = F.concat(
        F.lit(b"*2\n*3\n"), _line(":", asking.cast("int") if asking is not None else F.lit(0)), _line(":", flags if flags is not None else F.lit(0)),
        _line("$", F.octet_length(listed)), listed, end, _line("*", F.size(commands)),
    )
    words = lambda c: F.aggregate(c, _line("*", F.size(c)), lambda a, x: F.concat(a, _line("$", F.octet_length(x)), x, end))
    return F.aggregate(commands, head, lambda a, c: F.concat(a, words(c)))


def _text(value: Column) -> Column:
    """A string with its length, as bytes."""
    raw = F.encode(value, "UTF-8")
    return F.concat(F.encode(F.concat(F.lit("$"), F.octet_length(raw), F.lit("\n")), "UTF-8"), raw, F.lit(b"\n"))


def import_column(term: Column, session_key: Column, entries: Column) -> Column:
    """Bytes of an import payload from an array of (key, payload), inside the JVM."""
    head = F.encode(F.concat(F.lit("*"), term, F.lit("\n*"), session_key, F.lit("\n*"), F.size(entries), F.lit("\n")), "UTF-8")
    return F.aggregate(entries, head, lambda a, e: F.concat(a, _text(e["key"]), _text(e["payload"])))


def timeout_column(idx: Column, error: Column) -> Column:
    """Bytes of a timeout payload, inside the JVM."""
    return F.encode(F.concat(F.lit("*"), idx, F.lit("\n*"), error.cast("int"), F.lit("\n")), "UTF-8")


def lock_keys_column(keys: Column) -> Column:
    """Bytes of a lock-key list, inside the JVM: distinct, in byte order, each ended by a zero byte."""
    found = F.array_sort(F.array_distinct(keys))
    return F.concat(F.encode(F.concat(F.lit("*"), F.size(found), F.lit("\n")), "UTF-8"), F.encode(F.array_join(F.transform(found, lambda k: F.concat(k, F.lit("\0"))), ""), "UTF-8"))


def shard_group_column(group: Column) -> Column:
    """Text of a shard group (id, slot_ranges, nodes), inside the JVM: a line a value."""
    ranges = F.transform(group["slot_ranges"], lambda r: F.concat_ws("\n", r["start"], r["end"], r["type"], r["session_key"]))
    nodes = F.transform(group["nodes"], lambda n: F.concat(n["node_id"], F.lit("\n"), n["host"], F.lit(":"), n["port"]))
    lines = F.concat(F.array(group["id"], F.size(group["slot_ranges"]).cast("string"), F.size(group["nodes"]).cast("string")), ranges, nodes)
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))
