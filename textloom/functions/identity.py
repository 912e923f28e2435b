"""Content-addressed identities, hash splits and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"
NUL = "\x00"


def sha(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(text, 256)


def stable_rank(*parts: Column) -> Column:
    """A rank that depends on nothing but its parts: the digest of the parts joined by U+001F."""
    return sha(F.concat_ws(UNIT, *parts))


def seeded(seed: str | int, *parts: Column) -> Column:
    """Digest of a seed and parts joined by U+0000."""
    return sha(F.concat_ws(NUL, F.lit(str(seed)), *parts))


def hash_below(digest: Column, share: float) -> Column:
    """Whether the first 64 bits of a digest lie below a share of their range; exact, by comparing hex of one width."""
    return F.substring(digest, 1, 16) < F.lit(f"{int(share * 2**64):016x}")


def hash_mod(digest: Column, modulus: int) -> Column:
    """The 256-bit number of a digest modulo a small one, folded digit by digit."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substr(digest, i, F.lit(1)), 16, 10).cast("bigint"))
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda total, digit: (total * 16 + digit) % modulus)


def split_of(digest: Column, bounds: tuple[tuple[str, int], ...] = (("train", 11514), ("dev", 13547), ("test", 16521))) -> Column:
    """The split whose bound is the first above the digest modulo the last bound."""
    place = hash_mod(digest, bounds[-1][1])
    chain = F.lit(bounds[-1][0])
    for name, bound in reversed(bounds[:-1]):
        chain = F.when(place < bound, F.lit(name)).otherwise(chain)
    return chain


def seed_31(*parts: Column) -> Column:
    """A 31-bit seed: the first 32 bits of the digest without the sign."""
    return (F.conv(F.substring(sha(F.concat_ws(NUL, *parts)), 1, 8), 16, 10).cast("bigint") % (1 << 31)).cast("bigint")


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with keys in order, nulls kept, and a line feed at the end."""
    ordered = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.concat(F.to_json(ordered, {"ignoreNullFields": "false"}), F.lit("\n"))


def parity(digest: Column) -> Column:
    """Parity of a digest's first byte."""
    return (F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 2).cast("int")
