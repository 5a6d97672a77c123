"""Hash expressions: FNV-1a, buckets, membership fingerprints, tree indices."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The offset basis and prime of 32-bit FNV-1a, and the ring that every member builds.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
VNODES, SCHEME = 150, "ring-v1"


def fnv1a32(key: Column) -> Column:
    """FNV-1a over the key's UTF-8 bytes, as a long; null for null, the basis for the empty string."""
    bytes_ = F.split(F.decode(F.encode(key, "UTF-8"), "ISO-8859-1"), "")
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME, F.lit(1 << 32))
    return F.when(key == "", F.lit(FNV_BASIS).cast("long")).otherwise(F.aggregate(F.filter(bytes_, lambda c: c != ""), F.lit(FNV_BASIS).cast("long"), step))


def fnv1a32_py(key: str) -> int:
    """The same on the driver, for ring positions."""
    h = FNV_BASIS
    for b in key.encode():
        h = (h ^ b) * FNV_PRIME % (1 << 32)
    return h


def bucket_for(key: Column, buckets: int) -> Column:
    return fnv1a32(key) % F.lit(buckets)


def valid_bucket_count(n: Column) -> Column:
    """True for powers of four."""
    return (n > 0) & (F.bit_count(n) == 1) & ((F.length(F.bin(n)) - 1) % 2 == 0)


def fingerprint(members: Column, n: Column, vnodes: int = VNODES, scheme: str = SCHEME) -> Column:
    """SHA-256 of a membership (map of id to address) and the ring's parameters."""
    line = lambda e: F.concat(F.lit('member "'), e["key"], F.lit('" "'), e["value"], F.lit('"\n'))
    body = F.array_join(F.transform(F.array_sort(F.map_entries(members)), line), "")
    return F.sha2(F.concat(body, F.lit("n "), n.cast("string"), F.lit(f"\nvnodes {vnodes}\nscheme {scheme}\n")), 256)


def fingerprint_py(members: dict[str, str], n: int, vnodes: int = VNODES, scheme: str = SCHEME) -> str:
    """The same on the driver."""
    body = "".join(f'member "{k}" "{v}"\n' for k, v in sorted(members.items()))
    return hashlib.sha256(f"{body}n {n}\nvnodes {vnodes}\nscheme {scheme}\n".encode()).hexdigest()


def parent(i: Column) -> Column:
    return ((i - 1) / 2).cast("int")


def children(i: Column) -> tuple[Column, Column]:
    return 2 * i + 1, 2 * i + 2


def frame_crc_ok(payload: Column, crc: Column) -> Column:
    """Whether a log record's payload has the CRC-32 (IEEE) that its header says."""
    return F.crc32(payload) == crc
