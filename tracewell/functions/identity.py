"""Identities and instants: FNV-1a, CRC-32C, hex ids, names, UTC text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .numeric import fits

#: Fixed values of 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Fixed value: the Castagnoli polynomial, bits reversed.
CRC32C_POLYNOMIAL = 0x82F63B78
#: Texts of a batch that are taken one by one.
FEW = 16
NAME = r"^[A-Za-z0-9_][A-Za-z0-9_.:/@+-]{0,127}$"


def fnv1a64_of(data: bytes, h: int = FNV_OFFSET) -> int:
    for b in data:
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return h


def _folded(texts: pa.Array, state: np.ndarray, step, rest) -> np.ndarray:
    """The state of each text after all its bytes.

    All texts of a batch take a byte at a time by step, longest first, so those not at their end are a slice; once there are
    but FEW, each goes to its end by rest.
    """
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(data or b"", np.uint8)
    lengths = np.diff(ends)
    order = np.argsort(-lengths, kind="stable")
    starts, waiting = ends[:-1][order], np.sort(lengths)
    common = waiting[-FEW - 1] if len(waiting) > FEW else 0
    for i in range(common):
        n = len(waiting) - np.searchsorted(waiting, i, "right")
        state[:n] = step(state[:n], data[starts[:n] + i])
    for j, text in enumerate(order[:FEW]):
        state[j] = rest(data[starts[j] + common : ends[text + 1]].tobytes(), int(state[j]))
    out = np.empty_like(state)
    out[order] = state
    return out


def _fnv_bits(texts: pa.Array) -> pa.Array:
    prime = np.uint64(FNV_PRIME)
    return pa.array(_folded(texts, np.full(len(texts), FNV_OFFSET, np.uint64), lambda h, b: (h ^ b) * prime, fnv1a64_of).view(np.int64))


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 hex digits."""
    bits = F.arrow_udf(_fnv_bits, "long")(F.coalesce(text, F.lit("")))
    return F.when(text.isNotNull(), F.lpad(F.lower(F.hex(bits)), 16, "0"))


def crc32c_table() -> list[int]:
    """The remainder of each byte."""
    table = list(range(256))
    for _ in range(8):
        table = [(r >> 1) ^ (CRC32C_POLYNOMIAL if r & 1 else 0) for r in table]
    return table


def _crc32c_bits(texts: pa.Array) -> pa.Array:
    plain, ones = crc32c_table(), np.uint32(0xFFFFFFFF)
    table = np.array(plain, np.uint32)

    def rest(data: bytes, crc: int) -> int:
        for b in data:
            crc = plain[(crc ^ b) & 255] ^ (crc >> 8)
        return crc

    crc = _folded(texts, np.full(len(texts), ones, np.uint32), lambda c, b: table[(c ^ b) & 255] ^ (c >> 8), rest)
    return pa.array((crc ^ ones).astype(np.int64))


def crc32c(text: Column) -> Column:
    """CRC-32C of the UTF-8 bytes as BIGINT; 0 for an empty text."""
    return F.when(text.isNotNull(), F.arrow_udf(_crc32c_bits, "long")(F.coalesce(text, F.lit(""))))


def hex_id(number: Column) -> Column:
    """16 lower-case hex digits of a BIGINT's bits; NULL for 0, which is no identity."""
    return F.when(number != 0, F.lpad(F.lower(F.hex(number)), 16, "0"))


def parse_hex_id(text: Column) -> Column:
    """The bits of 16 hex digits as BIGINT; NULL where the text isn't an identity."""
    good = text.rlike("^[0-9a-f]{16}$") & (text != "0" * 16)
    high, low = (F.conv(F.substring(text, a, 8), 16, 10).cast("bigint") for a in (1, 9))
    return F.when(good, F.shiftleft(high, 32).bitwiseOR(low))


def valid_name(text: Column) -> Column:
    return F.coalesce(text.rlike(NAME), F.lit(False))


def format_utc(ns: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.nnnnnnnnnZ of any BIGINT; instants before 1970 are floored to their second. Needs session time zone UTC."""
    rest = F.pmod(ns, F.lit(1_000_000_000))
    seconds = F.call_function("div", ns, F.lit(1_000_000_000)) - F.when((ns < 0) & (rest != 0), 1).otherwise(0)  # ns - rest may leave a BIGINT
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"), F.lit("Z"))


def parse_utc(text: Column) -> Column:
    """Nanoseconds of such a text (0 to 9 digits of fraction); NULL where it isn't one or they don't fit a BIGINT."""
    pattern = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?Z$"
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)), F.lit("yyyy-MM-dd HH:mm:ss")))
    whole = seconds.cast("decimal(20,0)") * 1_000_000_000 + F.rpad(F.regexp_extract(text, pattern, 3), 9, "0").cast("bigint")
    return F.when(text.rlike(pattern), fits(whole))
