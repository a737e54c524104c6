"""Order-preserving key encodings and value encodings as native column expressions, with their inverses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
SECOND, MINUTE, HOUR, DAY = 1, 60, 3_600, 86_400
_LONG_MIN = -(1 << 63)


def _within(c: Column, low: str, high: str) -> Column:
    inside = c.isNull() | c.between(F.lit(low).cast("decimal(20,0)"), F.lit(high).cast("decimal(20,0)"))
    return F.when(inside, c).otherwise(F.raise_error(F.lit(f"value is not within [{low}, {high}]")).cast("decimal(20,0)"))


def _hex(c: Column, digits: int) -> Column:
    return F.unhex(F.lpad(F.hex(c), digits, "0"))


def _number(b: Column) -> Column:
    return F.conv(F.hex(b), 16, 10)


def encode_int(c: Column) -> Column:
    """Sign bit flipped, big-endian, 4 bytes."""
    return _hex(c.cast("int").cast("long").bitwiseXOR(F.lit(1 << 31)).bitwiseAND(F.lit(0xFFFFFFFF)), 8)


def decode_int(b: Column) -> Column:
    return (_number(b).cast("long") - F.lit(1 << 31)).cast("int")


def encode_long(c: Column) -> Column:
    """Sign bit flipped, big-endian, 8 bytes."""
    return _hex(c.cast("long").bitwiseXOR(F.lit(_LONG_MIN)), 16)


def decode_long(b: Column) -> Column:
    return (_number(b).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def encode_uint(c: Column) -> Column:
    return _hex(_within(c.cast("decimal(20,0)"), "0", str((1 << 32) - 1)).cast("long"), 8)


def decode_uint(b: Column) -> Column:
    return _number(b).cast("long")


def encode_ushort(c: Column) -> Column:
    return _hex(_within(c.cast("decimal(20,0)"), "0", "65535").cast("long"), 4)


def decode_ushort(b: Column) -> Column:
    return _number(b).cast("int")


def encode_ulong(c: Column) -> Column:
    checked = _within(c.cast("decimal(20,0)"), "0", str((1 << 64) - 1))
    return F.unhex(F.lpad(F.conv(checked.cast("string"), 10, 16), 16, "0"))


def decode_ulong(b: Column) -> Column:
    return _number(b).cast("decimal(20,0)")


def encode_timestamp(c: Column) -> Column:
    """Microseconds since the epoch as a long (an addition of ours)."""
    return encode_long(F.unix_micros(c))


@dataclass(frozen=True)
class Codec:
    """``default`` is what a missing or deleted entry decodes to where a default is asked for."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    default: int | None = None


CODECS: dict[str, Codec] = {
    "int": Codec(encode_int, decode_int, 0),
    "long": Codec(encode_long, decode_long, 0),
    "uint": Codec(encode_uint, decode_uint, 0),
    "ulong": Codec(encode_ulong, decode_ulong, 0),
    "ushort": Codec(encode_ushort, decode_ushort, 0),
    "string": Codec(lambda c: F.encode(c.cast("string"), "UTF-8"), lambda b: F.decode(b, "UTF-8")),
    "bytes": Codec(lambda c: c.cast("binary"), lambda b: b),
    "timestamp": Codec(encode_timestamp, lambda b: F.timestamp_micros(decode_long(b))),
}


def register(name: str, codec: Codec) -> None:
    """Add a codec of the user's own; its key encoding must sort bytewise like the value."""
    CODECS[name] = codec


def encode(c: Column, kind: str) -> Column:
    if kind not in CODECS:
        raise NotImplementedError(f"no codec for {kind!r}")
    return CODECS[kind].encode(c)


def decode(c: Column, kind: str, use_default: bool = False) -> Column:
    """The value, or null for none; with ``use_default`` 0 for numbers, so that absent looks like 0."""
    if kind not in CODECS:
        raise NotImplementedError(f"no codec for {kind!r}")
    out, default = CODECS[kind].decode(c), CODECS[kind].default
    return F.coalesce(out, F.lit(default).cast("long")) if use_default and default is not None else out


def encode_python(value: int | str | bytes, kind: str) -> bytes:
    """One key or value on the driver, byte for byte as :func:`encode`."""
    sizes = {"int": (4, 1 << 31), "long": (8, 1 << 63), "uint": (4, 0), "ulong": (8, 0), "ushort": (2, 0)}
    if kind in sizes:
        size, shift = sizes[kind]
        return (int(value) + shift).to_bytes(size, "big")
    if kind == "string":
        return str(value).encode()
    if kind == "bytes":
        return bytes(value)
    raise NotImplementedError(f"no codec for {kind!r}")


def concatenated(parts: Column) -> Column:
    """One value of an array of binary segments."""
    return F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))


def json_scalar(json: Column, path: str) -> Column:
    """UTF-8 of the scalar at ``path``, strings unescaped; null where there is none; objects and arrays fail."""
    token = F.get_json_object(json, path)
    nested = F.get_json_object(json, path + "[*]").isNotNull() | F.json_object_keys(token).isNotNull()
    scalar = F.when(token.rlike("^\\s*[\\[{]") & nested, F.raise_error(F.lit("objects and arrays are no values")).cast("string")).otherwise(token)
    return F.encode(scalar, "UTF-8")


def value_code(value: Column, is_tombstone: Column) -> Column:
    """0 for a tombstone, -1 for a live empty value, else the value's length."""
    return F.when(is_tombstone, 0).when(F.octet_length(value) == 0, -1).otherwise(F.octet_length(value))


def varint(c: Column) -> Column:
    """Groups of seven bits, low ones first, the high bit set on all but the last; of a long that isn't negative."""
    digits = F.ceil(F.length(F.bin(c)) / 7).cast("int")
    part = lambda k: F.call_function("shiftrightunsigned", c, k * 7).bitwiseAND(F.lit(127)) + F.when(k < digits - 1, F.lit(128)).otherwise(F.lit(0))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), digits - 1), lambda k: F.lpad(F.hex(part(k)), 2, "0")), ""))


def from_varint(b: Column) -> Column:
    """The long of a :func:`varint`."""
    byte = lambda k: F.conv(F.substring(F.hex(b), k * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127))
    return F.aggregate(F.sequence(F.lit(0), F.octet_length(b) - 1), F.lit(0).cast("long"), lambda a, k: a + F.call_function("shiftleft", byte(k), k * 7))


def version_key(key: Column, seq: Column) -> Column:
    """A byte 01, the key with 00 escaped as 00FF, 0000, and the inverted sequence: keys ascend, newest version first."""
    escaped = F.regexp_replace(F.regexp_replace(F.hex(key), "(..)", "$1 "), "00 ", "00FF ")
    return F.unhex(F.concat(F.lit("01"), F.replace(escaped, F.lit(" "), F.lit("")), F.lit("0000"), F.lpad(F.hex(F.bitwise_not(seq)), 16, "0")))


def version_key_parts(b: Column) -> tuple[Column, Column]:
    """(key, seq) of a :func:`version_key`."""
    h = F.hex(b)
    body = F.substring(h, F.lit(3), F.length(h) - 22)
    spaced = F.regexp_replace(body, "(..)", "$1 ")
    key = F.unhex(F.replace(F.replace(spaced, F.lit("00 FF "), F.lit("00 ")), F.lit(" "), F.lit("")))
    inverse = F.conv(F.substring(h, F.length(h) - 15, F.lit(16)), 16, 10).cast("decimal(20,0)")
    seq = (F.lit(str((1 << 64) - 1)).cast("decimal(20,0)") - inverse).cast("long")
    return key, seq


def workload_key(number: Column, size: int = 16) -> Column:
    """Eight bytes big-endian, then ASCII zeros up to ``size``."""
    return F.unhex(F.concat(F.lpad(F.hex(number), 16, "0"), F.lit("30" * max(0, size - 8))))
