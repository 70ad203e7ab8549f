"""Commands whose effect depends on the state before them, as an in-memory store that applies one command at a time.

It is the reference meaning for batch folds and streams: keytide.operators.orderedfold feeds it, in order, the commands
of a slot. Keys, fields and values are text; replies are None, integers, text or lists. Random choices are seeded by the entry.
"""

from __future__ import annotations

import inspect
import json
import math
import random
import re
from collections.abc import Callable

from keytide.functions.slots import glob_to_regex


class WrongType(Exception):
    """A command met a key of another type."""


class Failure(Exception):
    """A command was refused; its text is the reply."""


EMPTY = {"string": str, "hash": dict, "list": list, "set": set, "zset": dict, "geo": dict, "distinct": set}
_ACTIONS: dict[str, Callable] = {}
_SHAPES: dict[str, inspect.Signature] = {}


def command(*names: str) -> Callable:
    def add(f: Callable) -> Callable:
        for n in names:
            _ACTIONS[n] = f
            _SHAPES[n] = inspect.signature(f)
        return f

    return add


def number(text: str) -> int:
    try:
        return int(text)
    except ValueError:
        raise Failure("ERR value is not an integer or out of range") from None


def real(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        raise Failure("ERR value is not a valid float") from None
    if math.isnan(value):
        raise Failure("ERR value is not a valid float")
    return value


def syntax(good: bool) -> None:
    if not good:
        raise Failure("ERR syntax error")


def span(n: int, start: int, stop: int) -> slice:
    """The slice of start..stop, both in, negative from the end."""
    start = max(0, start + n if start < 0 else start)
    stop = stop + n if stop < 0 else stop
    return slice(start, max(start, min(stop, n - 1) + 1))


def render(score: float) -> str:
    if math.isinf(score):
        return "inf" if score > 0 else "-inf"
    return str(int(score)) if score == int(score) and abs(score) < 1e17 else repr(score)


class Store:
    """One keyspace. data: key -> (type, value); expire: key -> milliseconds; now: the time of the entry at hand, in milliseconds."""

    def __init__(self) -> None:
        self.data: dict[str, tuple[str, object]] = {}
        self.expire: dict[str, int] = {}
        self.idx = self.now = 0

    def of(self, key: str, kind: str, create: bool = False):
        found = self.data.get(key)
        if found is None:
            value = EMPTY[kind]()
            if create:
                self.data[key] = (kind, value)
            return value
        if found[0] != kind:
            raise WrongType(key)
        return found[1]

    def put(self, key: str, kind: str, value: object) -> None:
        self.data[key] = (kind, value)

    def drop(self, key: str) -> bool:
        self.expire.pop(key, None)
        return self.data.pop(key, None) is not None

    def tidy(self, key: str) -> None:
        found = self.data.get(key)
        if found is not None and found[0] != "string" and not found[1]:
            self.drop(key)

    def apply(self, idx: int, argv: list[str], now: int = 0):
        """The reply of a command; errors are text that begins with ERR or WRONGTYPE."""
        self.idx, self.now = idx, now
        name = argv[0].upper() if argv else ""
        action = _ACTIONS.get(name)
        if action is None:
            return "ERR unknown command"
        try:
            _SHAPES[name].bind(self, *argv[1:])
        except TypeError:
            return "ERR wrong number of arguments"
        try:
            return action(self, *argv[1:])
        except WrongType:
            return "WRONGTYPE Operation against a key holding the wrong kind of value"
        except Failure as e:
            return str(e)
        except (IndexError, ValueError, OverflowError):
            return "ERR syntax error"

    def rows(self) -> list[tuple[str, str, str | None, str | None]]:
        """(key, type, field or position, value) of everything, in byte order of keys."""
        out = []
        for key in sorted(self.data, key=str.encode):
            kind, value = self.data[key]
            if kind == "string":
                out.append((key, kind, None, value))
            elif kind == "list":
                out += [(key, kind, str(i), x) for i, x in enumerate(value)]
            elif kind == "geo":
                out += [(key, kind, m, f"{value[m][0]!r},{value[m][1]!r}") for m in sorted(value, key=str.encode)]
            elif kind == "distinct":
                out.append((key, kind, None, str(len(value))))
            elif kind == "set":
                out += [(key, kind, x, None) for x in sorted(value, key=str.encode)]
            else:
                out += [(key, kind, f, render(value[f]) if kind == "zset" else value[f]) for f in sorted(value, key=str.encode)]
        return out


# strings and counters


@command("GET")
def _get(s: Store, key):
    return s.of(key, "string") if key in s.data else None


#: What a time option counts, in milliseconds, and whether it counts from now.
TIMES = {"EX": (1000, True), "PX": (1, True), "EXAT": (1000, False), "PXAT": (1, False)}


def when(s: Store, option: str, text: str) -> int:
    unit, from_now = TIMES[option]
    return number(text) * unit + (s.now if from_now else 0)


@command("SET")
def _set(s: Store, key, value, *options):
    flags, due, left = set(), None, list(options)
    while left:
        word = left.pop(0).upper()
        syntax(word in ("NX", "XX", "GET", "KEEPTTL") or (word in TIMES and bool(left) and due is None))
        if word in TIMES:
            due = when(s, word, left.pop(0))
        flags.add(word)
    syntax(not {"NX", "XX"} <= flags and not ("KEEPTTL" in flags and due is not None))
    old = _get(s, key) if "GET" in flags else None
    if ("NX" in flags and key in s.data) or ("XX" in flags and key not in s.data):
        return old
    kept = s.expire.get(key)
    s.drop(key)
    s.put(key, "string", value)
    if due is not None or ("KEEPTTL" in flags and kept is not None):
        s.expire[key] = due if due is not None else kept
    return old if "GET" in flags else "OK"


@command("SETNX")
def _setnx(s: Store, key, value):
    if key in s.data:
        return 0
    s.put(key, "string", value)
    return 1


command("SETEX")(lambda s, key, time, value: _set(s, key, value, "EX", time))
command("PSETEX")(lambda s, key, time, value: _set(s, key, value, "PX", time))


@command("GETSET")
def _getset(s: Store, key, value):
    old = _get(s, key)
    _set(s, key, value)
    return old


@command("MGET")
def _mget(s: Store, *keys):
    return [s.data[k][1] if k in s.data and s.data[k][0] == "string" else None for k in keys]


@command("MSET")
def _mset(s: Store, *pairs):
    if not pairs or len(pairs) % 2:
        raise Failure("ERR wrong number of arguments")
    for k, v in zip(pairs[::2], pairs[1::2]):
        _set(s, k, v)
    return "OK"


@command("MSETNX")
def _msetnx(s: Store, *pairs):
    if not pairs or len(pairs) % 2:
        raise Failure("ERR wrong number of arguments")
    if any(k in s.data for k in pairs[::2]):
        return 0
    _mset(s, *pairs)
    return 1


@command("APPEND")
def _append(s: Store, key, value):
    s.put(key, "string", s.of(key, "string") + value)
    return len(s.data[key][1].encode())


@command("STRLEN")
def _strlen(s: Store, key):
    return len(s.of(key, "string").encode())


@command("GETRANGE")
def _getrange(s: Store, key, start, stop):
    raw = s.of(key, "string").encode()
    return raw[span(len(raw), number(start), number(stop))].decode("utf-8", "replace")


@command("SETRANGE")
def _setrange(s: Store, key, offset, value):
    raw, at, new = s.of(key, "string").encode("utf-8", "surrogateescape"), number(offset), value.encode()
    if new:
        raw = raw.ljust(at, b"\0")
        s.put(key, "string", (raw[:at] + new + raw[at + len(new) :]).decode("utf-8", "surrogateescape"))
    return max(len(raw), at + len(new) if new else 0)


def _add(s: Store, key, by: int):
    value = number(s.of(key, "string") or "0") + by
    s.put(key, "string", str(value))
    return value


command("INCR")(lambda s, k: _add(s, k, 1))
command("DECR")(lambda s, k: _add(s, k, -1))
command("INCRBY")(lambda s, k, n: _add(s, k, number(n)))
command("DECRBY")(lambda s, k, n: _add(s, k, -number(n)))


@command("INCRBYFLOAT")
def _incrbyfloat(s: Store, key, by):
    value = render(real(s.of(key, "string") or "0") + real(by))
    s.put(key, "string", value)
    return value


# bits of latin-1 text: one letter a byte


def _bytes(s: Store, key) -> bytearray:
    return bytearray(s.of(key, "string").encode("latin-1", "replace"))


@command("SETBIT")
def _setbit(s: Store, key, offset, bit):
    raw, at = _bytes(s, key), number(offset)
    raw.extend(b"\0" * (at // 8 + 1 - len(raw)))
    mask = 0x80 >> at % 8
    old = int(raw[at // 8] & mask > 0)
    raw[at // 8] = raw[at // 8] | mask if bit == "1" else raw[at // 8] & ~mask
    s.put(key, "string", raw.decode("latin-1"))
    return old


@command("GETBIT")
def _getbit(s: Store, key, offset):
    raw, at = _bytes(s, key), number(offset)
    return int(at // 8 < len(raw) and raw[at // 8] & 0x80 >> at % 8 > 0)


@command("BITCOUNT")
def _bitcount(s: Store, key):
    return sum(b.bit_count() for b in _bytes(s, key))


@command("BITOP")
def _bitop(s: Store, op, target, *keys):
    raws = [_bytes(s, k) for k in keys]
    n = max(map(len, raws))
    values = [int.from_bytes(r.ljust(n, b"\0"), "big") for r in raws]
    out = values[0]
    for v in values[1:]:
        out = out & v if op.upper() == "AND" else out | v if op.upper() == "OR" else out ^ v
    if op.upper() == "NOT":
        out ^= (1 << 8 * n) - 1
    s.put(target, "string", out.to_bytes(n, "big").decode("latin-1"))
    return n


# keys


@command("DEL", "UNLINK")
def _del(s: Store, *keys):
    return sum(s.drop(k) for k in keys)


@command("EXISTS", "TOUCH")
def _exists(s: Store, *keys):
    return sum(k in s.data for k in keys)


@command("TYPE")
def _type(s: Store, key):
    return s.data[key][0] if key in s.data else "none"


@command("RENAME")
def _rename(s: Store, key, new):
    if key not in s.data:
        raise Failure("ERR no such key")
    value, when = s.data[key], s.expire.get(key)
    s.drop(key)
    s.drop(new)
    s.data[new] = value
    if when is not None:
        s.expire[new] = when
    return "OK"


@command("RENAMENX")
def _renamenx(s: Store, key, new):
    if new in s.data:
        return 0
    _rename(s, key, new)
    return 1


@command("KEYS")
def _keys(s: Store, pattern):
    fits = re.compile(glob_to_regex(pattern)).match
    return sorted((k for k in s.data if fits(k)), key=str.encode)


def _expire(s: Store, key, due: int):
    if key not in s.data:
        return 0
    s.expire[key] = due
    return 1


command("EXPIRE")(lambda s, key, time: _expire(s, key, when(s, "EX", time)))
command("PEXPIRE")(lambda s, key, time: _expire(s, key, when(s, "PX", time)))
command("EXPIREAT")(lambda s, key, time: _expire(s, key, when(s, "EXAT", time)))
command("PEXPIREAT")(lambda s, key, time: _expire(s, key, when(s, "PXAT", time)))


@command("PERSIST")
def _persist(s: Store, key):
    return int(s.expire.pop(key, None) is not None)


def _left(s: Store, key, now: int) -> int:
    """Milliseconds that a key has left: -1 without expiry, -2 where it isn't there or its time has come."""
    if key not in s.data or s.expire.get(key, now + 1) <= now:
        return -2
    return s.expire[key] - now if key in s.expire else -1


@command("PTTL")
def _pttl(s: Store, key, as_of=None):
    """As of the entry's time, or of a time given in milliseconds."""
    return _left(s, key, s.now if as_of is None else number(as_of))


@command("TTL")
def _ttl(s: Store, key, as_of=None):
    """As of the entry's time, or of a time given in seconds."""
    left = _left(s, key, s.now if as_of is None else number(as_of) * 1000)
    return left if left < 0 else (left + 500) // 1000


@command("RANDOMKEY")
def _randomkey(s: Store):
    return random.Random(s.idx).choice(sorted(s.data)) if s.data else None


# hashes


@command("HSET", "HMSET")
def _hset(s: Store, key, *pairs):
    if not pairs or len(pairs) % 2:
        raise Failure("ERR wrong number of arguments")
    h = s.of(key, "hash", True)
    new = len(set(pairs[::2]) - h.keys())
    h.update(zip(pairs[::2], pairs[1::2]))
    return new


@command("HSETNX")
def _hsetnx(s: Store, key, field, value):
    if field in s.of(key, "hash"):
        return 0
    s.of(key, "hash", True)[field] = value
    return 1


@command("HDEL")
def _hdel(s: Store, key, *fields):
    h = s.of(key, "hash")
    n = sum(h.pop(f, None) is not None for f in fields)
    s.tidy(key)
    return n


@command("HINCRBY")
def _hincrby(s: Store, key, field, by):
    value = number(s.of(key, "hash").get(field, "0")) + number(by)
    s.of(key, "hash", True)[field] = str(value)
    return value


@command("HINCRBYFLOAT")
def _hincrbyfloat(s: Store, key, field, by):
    value = render(real(s.of(key, "hash").get(field, "0")) + real(by))
    s.of(key, "hash", True)[field] = value
    return value


command("HGET")(lambda s, k, f: s.of(k, "hash").get(f))
command("HMGET")(lambda s, k, *fs: [s.of(k, "hash").get(f) for f in fs])
command("HEXISTS")(lambda s, k, f: int(f in s.of(k, "hash")))
command("HLEN")(lambda s, k: len(s.of(k, "hash")))
command("HKEYS")(lambda s, k: sorted(s.of(k, "hash")))
command("HVALS")(lambda s, k: sorted(s.of(k, "hash").values()))
command("HGETALL")(lambda s, k: [x for f in sorted(s.of(k, "hash")) for x in (f, s.of(k, "hash")[f])])
command("HSTRLEN")(lambda s, k, f: len(s.of(k, "hash").get(f, "").encode()))


# lists


def _push(s: Store, key, values, left: bool, create: bool = True):
    if not values:
        raise Failure("ERR wrong number of arguments")
    if not create and key not in s.data:
        return 0
    items = s.of(key, "list", True)
    for v in values:
        items.insert(0, v) if left else items.append(v)
    return len(items)


command("LPUSH")(lambda s, k, *v: _push(s, k, v, True))
command("RPUSH")(lambda s, k, *v: _push(s, k, v, False))
command("LPUSHX")(lambda s, k, *v: _push(s, k, v, True, False))
command("RPUSHX")(lambda s, k, *v: _push(s, k, v, False, False))


def _pop(s: Store, key, left: bool):
    items = s.of(key, "list")
    if not items:
        return None
    value = items.pop(0 if left else -1)
    s.tidy(key)
    return value


def _pops(s: Store, key, count: str | None, pop: Callable, size: int):
    """One value, or with a count a list of as many as there are; none without the key."""
    if count is None:
        return pop()
    n = number(count)
    if n < 0:
        raise Failure("ERR value is out of range, must be positive")
    return [pop() for _ in range(min(n, size))] if size else None


command("LPOP")(lambda s, k, n=None: _pops(s, k, n, lambda: _pop(s, k, True), len(s.of(k, "list"))))
command("RPOP")(lambda s, k, n=None: _pops(s, k, n, lambda: _pop(s, k, False), len(s.of(k, "list"))))


def _bpop(s: Store, keys, left: bool):
    """The first of several lists that isn't empty gives one value; the last argument is the timeout. Nothing waits here: none is the reply at once."""
    key = next((k for k in keys[:-1] if s.of(k, "list")), None)
    return None if key is None else [key, _pop(s, key, left)]


command("BLPOP")(lambda s, *keys: _bpop(s, keys, True))
command("BRPOP")(lambda s, *keys: _bpop(s, keys, False))


@command("LMOVE", "BLMOVE")
def _lmove(s: Store, key, target, side="RIGHT", to="LEFT", *_):
    s.of(target, "list")
    value = _pop(s, key, side.upper() == "LEFT")
    if value is not None:
        _push(s, target, [value], to.upper() == "LEFT")
    return value


command("RPOPLPUSH", "BRPOPLPUSH")(lambda s, k, t, *_: _lmove(s, k, t))


@command("LRANGE")
def _lrange(s: Store, key, start, stop):
    items = s.of(key, "list")
    return items[span(len(items), number(start), number(stop))]


@command("LTRIM")
def _ltrim(s: Store, key, start, stop):
    items = s.of(key, "list")
    items[:] = items[span(len(items), number(start), number(stop))]
    s.tidy(key)
    return "OK"


@command("LINDEX")
def _lindex(s: Store, key, at):
    items, i = s.of(key, "list"), number(at)
    return items[i] if -len(items) <= i < len(items) else None


@command("LSET")
def _lset(s: Store, key, at, value):
    items, i = s.of(key, "list"), number(at)
    if not -len(items) <= i < len(items):
        raise Failure("ERR index out of range" if items else "ERR no such key")
    items[i] = value
    return "OK"


@command("LINSERT")
def _linsert(s: Store, key, where, pivot, value):
    items = s.of(key, "list")
    if not items:
        return 0
    if pivot not in items:
        return -1
    items.insert(items.index(pivot) + (where.upper() == "AFTER"), value)
    return len(items)


@command("LREM")
def _lrem(s: Store, key, count, value):
    items, n = s.of(key, "list"), number(count)
    places = [i for i, x in enumerate(items) if x == value]
    gone = places[n:] if n < 0 else places[:n] if n else places
    for i in reversed(gone):
        del items[i]
    s.tidy(key)
    return len(gone)


command("LLEN")(lambda s, k: len(s.of(k, "list")))


# sets


@command("SADD")
def _sadd(s: Store, key, *members):
    m = s.of(key, "set", True)
    n = len(set(members) - m)
    m.update(members)
    return n


@command("SREM")
def _srem(s: Store, key, *members):
    m = s.of(key, "set")
    n = len(m & set(members))
    m.difference_update(members)
    s.tidy(key)
    return n


@command("SMOVE")
def _smove(s: Store, key, target, member):
    s.of(target, "set")
    if not _srem(s, key, member):
        return 0
    _sadd(s, target, member)
    return 1


def _pick(s: Store, key, n: int) -> list[str]:
    """n distinct members, chosen by the entry's index."""
    members = sorted(s.of(key, "set"))
    return random.Random(s.idx).sample(members, min(n, len(members)))


@command("SPOP")
def _spop(s: Store, key, count=None):
    found = _pick(s, key, 1 if count is None else number(count))
    if found:
        _srem(s, key, *found)
    return found if count is not None else found[0] if found else None


@command("SRANDMEMBER")
def _srandmember(s: Store, key, count=None):
    """With a count below 0 members may repeat."""
    n = 1 if count is None else number(count)
    members = sorted(s.of(key, "set"))
    found = _pick(s, key, n) if n >= 0 else random.Random(s.idx).choices(members, k=-n if members else 0)
    return found if count is not None else found[0] if found else None


command("SCARD")(lambda s, k: len(s.of(k, "set")))
command("SISMEMBER")(lambda s, k, m: int(m in s.of(k, "set")))
command("SMEMBERS")(lambda s, k: sorted(s.of(k, "set")))


def _combine(s: Store, keys, act: str) -> set:
    sets = [set(s.of(k, "set")) for k in keys]
    return getattr(sets[0], act)(*sets[1:])


def _keep(s: Store, target, values: set):
    s.drop(target)
    if values:
        s.put(target, "set", values)
    return len(values)


for _name, _act in (("SUNION", "union"), ("SINTER", "intersection"), ("SDIFF", "difference")):
    command(_name)(lambda s, *ks, act=_act: sorted(_combine(s, ks, act)))
    command(_name + "STORE")(lambda s, t, *ks, act=_act: _keep(s, t, _combine(s, ks, act)))


# sorted sets


def _ordered(s: Store, key, reverse: bool = False) -> list[tuple[str, float]]:
    return sorted(s.of(key, "zset").items(), key=lambda x: (x[1], x[0].encode()), reverse=reverse)


@command("ZADD")
def _zadd(s: Store, key, *rest):
    """Options NX XX GT LT CH INCR stand before the pairs; with INCR the reply is the new score, or none."""
    left, flags = list(rest), set()
    while left and left[0].upper() in ("NX", "XX", "GT", "LT", "CH", "INCR"):
        flags.add(left.pop(0).upper())
    syntax(bool(left) and len(left) % 2 == 0 and not ("INCR" in flags and len(left) != 2))
    syntax(not ("NX" in flags and flags & {"XX", "GT", "LT"}) and not {"GT", "LT"} <= flags)
    pairs = [(m, real(v)) for v, m in zip(left[::2], left[1::2])]
    z, new, changed, reply = s.of(key, "zset", True), 0, 0, None
    for m, v in pairs:
        old = z.get(m)
        v = v + (old or 0.0) if "INCR" in flags else v
        if (old is None and "XX" in flags) or (old is not None and ("NX" in flags or ("GT" in flags and v <= old) or ("LT" in flags and v >= old))):
            continue
        new, changed = new + (old is None), changed + (old != v)
        z[m], reply = v, render(v)
    s.tidy(key)
    return reply if "INCR" in flags else changed if "CH" in flags else new


@command("ZINCRBY")
def _zincrby(s: Store, key, by, member):
    value = s.of(key, "zset").get(member, 0.0) + real(by)
    s.of(key, "zset", True)[member] = value
    return render(value)


@command("ZREM")
def _zrem(s: Store, key, *members):
    z = s.of(key, "zset")
    n = sum(z.pop(m, None) is not None for m in members)
    s.tidy(key)
    return n


def _zpop(s: Store, key, reverse: bool, n: int = 1):
    found = _ordered(s, key, reverse)[:n]
    for m, _ in found:
        _zrem(s, key, m)
    return [x for m, v in found for x in (m, render(v))]


command("ZPOPMIN")(lambda s, k, n="1": _zpop(s, k, False, number(n)))
command("ZPOPMAX")(lambda s, k, n="1": _zpop(s, k, True, number(n)))


def _bzpop(s: Store, keys, reverse: bool):
    """The first of several sorted sets that isn't empty gives one member; the last argument is the timeout."""
    key = next((k for k in keys[:-1] if s.of(k, "zset")), None)
    return None if key is None else [key, *_zpop(s, key, reverse)]


command("BZPOPMIN")(lambda s, *keys: _bzpop(s, keys, False))
command("BZPOPMAX")(lambda s, *keys: _bzpop(s, keys, True))
command("ZCARD")(lambda s, k: len(s.of(k, "zset")))
command("ZSCORE")(lambda s, k, m: render(s.of(k, "zset")[m]) if m in s.of(k, "zset") else None)


def _zrange(s: Store, key, start, stop, reverse: bool):
    found = _ordered(s, key, reverse)
    return [m for m, _ in found[span(len(found), number(start), number(stop))]]


def _zrank(s: Store, key, member, reverse: bool):
    names = [m for m, _ in _ordered(s, key, reverse)]
    return names.index(member) if member in names else None


def _between(text: str, value: float, low: bool) -> bool:
    edge = real(text.lstrip("("))
    return (value > edge if low else value < edge) if text.startswith("(") else (value >= edge if low else value <= edge)


def _by_score(s: Store, key, low, high) -> list[str]:
    return [m for m, v in _ordered(s, key) if _between(low, v, True) and _between(high, v, False)]


def _by_lex(s: Store, key, low, high) -> list[str]:
    above = lambda m: low == "-" or (low != "+" and (m.encode() >= low[1:].encode() if low[0] == "[" else m.encode() > low[1:].encode()))
    below = lambda m: high == "+" or (high != "-" and (m.encode() <= high[1:].encode() if high[0] == "[" else m.encode() < high[1:].encode()))
    return [m for m, _ in _ordered(s, key) if above(m) and below(m)]


command("ZRANGE")(lambda s, k, a, b: _zrange(s, k, a, b, False))
command("ZREVRANGE")(lambda s, k, a, b: _zrange(s, k, a, b, True))
command("ZRANK")(lambda s, k, m: _zrank(s, k, m, False))
command("ZREVRANK")(lambda s, k, m: _zrank(s, k, m, True))
command("ZRANGEBYSCORE")(lambda s, k, a, b: _by_score(s, k, a, b))
command("ZREVRANGEBYSCORE")(lambda s, k, b, a: _by_score(s, k, a, b)[::-1])
command("ZRANGEBYLEX")(lambda s, k, a, b: _by_lex(s, k, a, b))
command("ZREVRANGEBYLEX")(lambda s, k, b, a: _by_lex(s, k, a, b)[::-1])
command("ZCOUNT")(lambda s, k, a, b: len(_by_score(s, k, a, b)))
command("ZLEXCOUNT")(lambda s, k, a, b: len(_by_lex(s, k, a, b)))
command("ZREMRANGEBYSCORE")(lambda s, k, a, b: _zrem(s, k, *_by_score(s, k, a, b)))
command("ZREMRANGEBYLEX")(lambda s, k, a, b: _zrem(s, k, *_by_lex(s, k, a, b)))
command("ZREMRANGEBYRANK")(lambda s, k, a, b: _zrem(s, k, *_zrange(s, k, a, b, False)))


def _zstore(s: Store, target, count, rest, inter: bool):
    """Sources, then WEIGHTS and AGGREGATE SUM, MIN or MAX; a set counts 1 a member."""
    n = number(count)
    keys, left = rest[:n], list(rest[n:])
    weights, act = [1.0] * n, sum
    while left:
        word = left.pop(0).upper()
        if word == "WEIGHTS":
            weights, left = [real(x) for x in left[:n]], left[n:]
            syntax(len(weights) == n)
        else:
            syntax(word == "AGGREGATE" and bool(left) and left[0].upper() in ("SUM", "MIN", "MAX"))
            act = {"SUM": sum, "MIN": min, "MAX": max}[left.pop(0).upper()]
    sources = [dict.fromkeys(s.data[k][1], 1.0) if s.data.get(k, ("", 0))[0] == "set" else s.of(k, "zset") for k in keys]
    syntax(0 < n == len(sources))
    names = set.intersection(*map(set, sources)) if inter else set().union(*sources)
    out = {m: float(act([z[m] * w for z, w in zip(sources, weights) if m in z])) for m in names}
    s.drop(target)
    if out:
        s.put(target, "zset", out)
    return len(out)


command("ZUNIONSTORE")(lambda s, t, n, *rest: _zstore(s, t, n, rest, False))
command("ZINTERSTORE")(lambda s, t, n, *rest: _zstore(s, t, n, rest, True))


# pops from the first of several keys that isn't empty


def _first(s: Store, count, rest, kind: str) -> str | None:
    return next((k for k in rest[: number(count)] if s.of(k, kind)), None)


def _many(count, rest, side: str) -> tuple[bool, int]:
    """Whether the side is the one named, and the number after COUNT."""
    words = [x.upper() for x in rest[number(count) :]]
    syntax(bool(words) and len(words) in (1, 3) and (len(words) == 1 or words[1] == "COUNT"))
    return words[0] == side, number(words[2]) if len(words) == 3 else 1


def _lmpop(s: Store, count, rest):
    key = _first(s, count, rest, "list")
    left, n = _many(count, rest, "LEFT")
    return None if key is None else [key, *[_pop(s, key, left) for _ in range(min(n, len(s.of(key, "list"))))]]


def _zmpop(s: Store, count, rest):
    key = _first(s, count, rest, "zset")
    largest, n = _many(count, rest, "MAX")
    return None if key is None else [key, *_zpop(s, key, largest, n)]


command("LMPOP")(lambda s, n, *rest: _lmpop(s, n, rest))
command("BLMPOP")(lambda s, _timeout, n, *rest: _lmpop(s, n, rest))
command("ZMPOP")(lambda s, n, *rest: _zmpop(s, n, rest))
command("BZMPOP")(lambda s, _timeout, n, *rest: _zmpop(s, n, rest))


# places on the globe


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    u, v = math.sin(math.radians(b[1] - a[1]) / 2), math.sin(math.radians(b[0] - a[0]) / 2)
    return 2 * 6372797.560856 * math.asin(math.sqrt(u * u + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * v * v))


@command("GEOADD")
def _geoadd(s: Store, key, *triples):
    syntax(bool(triples) and len(triples) % 3 == 0)
    places = {m: (real(x), real(y)) for x, y, m in zip(triples[::3], triples[1::3], triples[2::3])}
    g = s.of(key, "geo", True)
    new = len(places.keys() - g.keys())
    g.update(places)
    return new


def _near(s: Store, key, centre, radius) -> list[str]:
    found = sorted((metres(centre, p), m) for m, p in s.of(key, "geo").items())
    return [m for d, m in found if d <= real(radius)]


@command("GEODIST")
def _geodist(s: Store, key, a, b):
    g = s.of(key, "geo")
    return f"{metres(g[a], g[b]):.4f}" if a in g and b in g else None


@command("GEORADIUSBYMEMBER")
def _by_member(s: Store, key, member, radius):
    g = s.of(key, "geo")
    if member not in g:
        raise Failure("ERR could not decode requested zset member")
    return _near(s, key, g[member], radius)


@command("GEOHASH")
def _geohash(s: Store, key, *members):
    g = s.of(key, "geo")
    return [geohash(*g[m]) if m in g else None for m in members]


def geohash(lon: float, lat: float, length: int = 11) -> str:
    bits = []
    bounds = [[-180.0, 180.0], [-90.0, 90.0]]
    for k in range(length * 5):
        side, value = bounds[k % 2], (lon, lat)[k % 2]
        middle = (side[0] + side[1]) / 2
        bits.append(int(value >= middle))
        side[value < middle] = middle
    letters = "0123456789bcdefghjkmnpqrstuvwxyz"
    return "".join(letters[int("".join(map(str, bits[i : i + 5])), 2)] for i in range(0, len(bits), 5))


command("GEOPOS")(lambda s, k, *ms: [f"{s.of(k, 'geo')[m][0]!r},{s.of(k, 'geo')[m][1]!r}" if m in s.of(k, "geo") else None for m in ms])
command("GEORADIUS")(lambda s, k, x, y, r: _near(s, k, (real(x), real(y)), r))


# distinct counts, exact


@command("PFADD")
def _pfadd(s: Store, key, *values):
    d = s.of(key, "distinct", True)
    before = len(d)
    d.update(values)
    return int(len(d) > before)


@command("PFMERGE")
def _pfmerge(s: Store, target, *keys):
    s.of(target, "distinct", True).update(*(s.of(k, "distinct") for k in keys))
    return "OK"


command("PFCOUNT")(lambda s, *ks: len(set().union(*(s.of(k, "distinct") for k in ks))))


# sorting and cursors


def _named(s: Store, pattern: str, item: str) -> str | None:
    """What a BY or GET pattern names for an item: a string, or with -> a field of a hash; # is the item."""
    if pattern == "#":
        return item
    key, _, field = pattern.partition("->")
    key = key.replace("*", item, 1)
    kind, value = s.data.get(key, ("", None))
    return value.get(field) if field and kind == "hash" else value if not field and kind == "string" else None


@command("SORT")
def _sort(s: Store, key, *options):
    left, by, gets, desc, alpha, first, n, target = list(options), None, [], False, False, 0, -1, None
    while left:
        word = left.pop(0).upper()
        syntax(word in ("ASC", "DESC", "ALPHA") or len(left) >= (2 if word == "LIMIT" else 1))
        if word == "LIMIT":
            first, n = number(left.pop(0)), number(left.pop(0))
        elif word == "BY":
            by = left.pop(0)
        elif word == "GET":
            gets.append(left.pop(0))
        elif word == "STORE":
            target = left.pop(0)
        else:
            syntax(word in ("ASC", "DESC", "ALPHA"))
            desc, alpha = (word == "DESC") if word != "ALPHA" else desc, alpha or word == "ALPHA"
    kind = s.data[key][0] if key in s.data else "list"
    items = list(s.of(key, kind)) if kind in ("list", "set", "zset") else s.of(key, "list")
    if by is None or "*" in by:
        weight = {x: x if by is None else _named(s, by, x) for x in items}
        try:
            rank = (lambda x: (weight[x] or "").encode()) if alpha else (lambda x: float(weight[x] or 0))
            items = sorted(items, key=lambda x: (rank(x), x.encode()), reverse=desc)
        except ValueError:
            raise Failure("ERR One or more scores can't be converted into double") from None
    items = items[max(first, 0) : max(first, 0) + n] if n >= 0 else items[max(first, 0) :]
    out = [_named(s, g, x) for x in items for g in gets] if gets else items
    if target is None:
        return out
    s.drop(target)
    if out:
        s.put(target, "list", [x or "" for x in out])
    return len(out)


def _scan(names, cursor: str, options) -> list[str]:
    """The next names after a cursor, which is the last name given before ('0' begins and ends)."""
    words = [o.upper() for o in options]
    n = number(options[words.index("COUNT") + 1]) if "COUNT" in words else 10
    fits = re.compile(glob_to_regex(options[words.index("MATCH") + 1])).match if "MATCH" in words else lambda _: True
    left = [x for x in sorted(names, key=str.encode) if cursor == "0" or x.encode() > cursor.encode()]
    page = left[:n]
    return [page[-1] if len(left) > n else "0", *(x for x in page if fits(x))]


command("SCAN")(lambda s, cursor, *o: _scan(s.data, cursor, o))
command("HSCAN")(lambda s, k, cursor, *o: _scan(s.of(k, "hash"), cursor, o))
command("SSCAN")(lambda s, k, cursor, *o: _scan(s.of(k, "set"), cursor, o))
command("ZSCAN")(lambda s, k, cursor, *o: _scan(s.of(k, "zset"), cursor, o))


@command("BITFIELD")
def _bitfield(s: Store, key, *steps):
    """GET uN at, SET uN at value and INCRBY uN at by, of unsigned fields at bit places."""
    raw, out, i = _bytes(s, key), [], 0
    while i < len(steps):
        act, width, at = steps[i].upper(), number(steps[i + 1][1:]), number(steps[i + 2])
        raw.extend(b"\0" * ((at + width + 7) // 8 - len(raw)))
        shift, mask = len(raw) * 8 - at - width, (1 << width) - 1
        whole = int.from_bytes(raw, "big")
        old = whole >> shift & mask
        new = old if act == "GET" else (number(steps[i + 3]) + (old if act == "INCRBY" else 0)) & mask
        raw = bytearray((whole & ~(mask << shift) | new << shift).to_bytes(len(raw), "big"))
        out.append(new if act == "INCRBY" else old)
        i += 3 if act == "GET" else 4
    s.put(key, "string", raw.decode("latin-1"))
    return out


#: Every command the store applies, and those that wait where there is nothing to pop.
COMMANDS = frozenset(_ACTIONS)
BLOCKING = frozenset(("BLPOP", "BRPOP", "BLMOVE", "BRPOPLPUSH", "BLMPOP", "BZPOPMIN", "BZPOPMAX", "BZMPOP"))


class BlockingStore(Store):
    """A store whose blocking commands wait, in order, until another command brings what they pop.

    Timeouts are entries of the log: TIMEOUT idx ends a waiter with none, UNBLOCK idx with an error, TERM cancels all of them.
    A command inside a transaction (its argument vector begins with MULTI) never waits.
    """

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[tuple[int, list[str]]] = []

    def entry(self, idx: int, argv: list[str], now: int = 0) -> list[tuple[int, int, object]]:
        """(index of the command, index of the entry that settled it, reply) of all that this entry settles."""
        name = argv[0].upper()
        if name in ("TIMEOUT", "UNBLOCK"):
            ended = [w for w in self.waiting if w[0] == int(argv[1])]
            self.waiting = [w for w in self.waiting if w[0] != int(argv[1])]
            return [(i, idx, None if name == "TIMEOUT" else "UNBLOCKED client unblocked via CLIENT UNBLOCK") for i, _ in ended]
        if name == "TERM":
            ended, self.waiting = self.waiting, []
            return [(i, idx, "CANCELLED") for i, _ in ended]
        in_multi = name == "MULTI"
        argv = argv[1:] if in_multi else argv
        reply = self.apply(idx, argv, now)
        if reply is None and argv[0].upper() in BLOCKING and not in_multi:
            self.waiting.append((idx, argv))
            return []
        return [(idx, idx, reply), *self.serve(idx, now)]

    def serve(self, idx: int, now: int) -> list[tuple[int, int, object]]:
        out, at = [], 0
        while at < len(self.waiting):
            waiter, argv = self.waiting[at]
            reply = self.apply(waiter, argv, now)
            if reply is None:
                at += 1
            else:
                # what it moved may be what an earlier one waits for
                del self.waiting[at]
                out.append((waiter, idx, reply))
                at = 0
        return out

    def dump(self) -> str:
        """Everything as text, for a state that outlives a batch."""
        plain = {k: [kind, sorted(v) if isinstance(v, set) else v] for k, (kind, v) in self.data.items()}
        return json.dumps({"data": plain, "expire": self.expire, "waiting": self.waiting})

    @classmethod
    def load(cls, text: str) -> BlockingStore:
        found, store = json.loads(text), cls()
        for k, (kind, v) in found["data"].items():
            store.data[k] = (kind, set(v) if kind in ("set", "distinct") else {m: tuple(x) for m, x in v.items()} if kind == "geo" else v)
        store.expire = found["expire"]
        store.waiting = [(i, argv) for i, argv in found["waiting"]]
        return store
