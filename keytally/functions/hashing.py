"""Hash and +-1 random-variable families as Spark columns.

Every function takes columns (or plain ints for the seeds) and returns a column, so the
work stays in generated JVM code. Seeds are 31- or 32-bit integers; keys are folded to
31 bits first, which keeps every product inside a BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the hash families.
MASK31 = 0x7FFFFFFF
MASK32 = 0xFFFFFFFF
ODD_BITS = 0xAAAAAAAA
OWNER_SLOTS = 512


def _col(value: Column | int | str) -> Column:
    if isinstance(value, str):
        return F.col(value)
    return value if isinstance(value, Column) else F.lit(value).cast("long")


def fold31(key: Column | str) -> Column:
    """A 64-bit key folded to 31 bits; the identity below 2^31."""
    key = _col(key).cast("long")
    return key.bitwiseAND(MASK31).bitwiseXOR(F.shiftright(key, 31).bitwiseAND(MASK31))


def hash31(a, b, x) -> Column:
    """Linear hash modulo 2^31 - 1, for a, b and x below 2^31."""
    r = _col(a) * _col(x) + _col(b)
    return (F.shiftright(r, 31) + r).bitwiseAND(MASK31)


def fourwise(a, b, c, d, x) -> Column:
    """4-wise independent hash: a cubic polynomial evaluated by Horner's rule."""
    return hash31(hash31(hash31(a, b, x), c, x), d, x)


def cw2b(a, b, x, buckets: int) -> Column:
    """2-wise independent bucket in [0, buckets)."""
    return hash31(a, b, x) % F.lit(buckets).cast("long")


def cw4b(a, b, c, d, x, buckets: int) -> Column:
    """4-wise independent bucket in [0, buckets)."""
    return fourwise(a, b, c, d, x) % F.lit(buckets).cast("long")


def sign_of(bit: Column) -> Column:
    """+1 where the lowest bit is set, else -1."""
    return bit.bitwiseAND(1) * 2 - 1


def cw2(a, b, x) -> Column:
    """2-wise independent +-1 variable."""
    return sign_of(hash31(a, b, x))


def cw4(a, b, c, d, x) -> Column:
    """4-wise independent +-1 variable."""
    return sign_of(fourwise(a, b, c, d, x))


def _parity_sign(i0, bits: Column) -> Column:
    return sign_of(F.bit_count(bits).cast("long") + _col(i0))


def bch3(i0, i1, j) -> Column:
    """3-wise independent +-1 variable: parity of the seeded bits of j."""
    return _parity_sign(i0, _col(i1).bitwiseAND(_col(j)))


def eh3_bits(i1, j) -> Column:
    j = _col(j)
    pairs = j.bitwiseAND(F.shiftleft(j, 1)).bitwiseAND(ODD_BITS)
    return _col(i1).bitwiseAND(j).bitwiseXOR(pairs)


def eh3(i0, i1, j) -> Column:
    """3-wise independent +-1 variable from the extended Hamming code."""
    return _parity_sign(i0, eh3_bits(i1, j))


def bch5(i0, i1, i2, j) -> Column:
    """5-wise independent +-1 variable: linear and cubic terms, the cube modulo 2^32."""
    j = _col(j)
    square = (j * j).bitwiseAND(MASK32)
    # (square * j) may pass 2^62, so it is formed from the two halves of the square.
    low = square.bitwiseAND(0xFFFF) * j
    high = F.shiftright(square, 16) * j
    cube = (low + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK32)
    return _parity_sign(i0, _col(i1).bitwiseAND(j).bitwiseXOR(_col(i2).bitwiseAND(cube)))


def rm7(i0, seeds: Column, j) -> Column:
    """7-wise independent +-1 variable: a seeded quadratic form over the bits of j.

    ``seeds`` is an array of 32 numbers; number i weighs bit i itself (its own bit i) and
    the products of bit i with the higher bits.
    """
    j = _col(j)

    def term(acc: Column, i: Column) -> Column:
        above = F.lit(-1).cast("long") - (F.call_function("shiftleft", F.lit(1).cast("long"), i) - 1)
        seed = F.element_at(seeds, i + 1)
        on = F.call_function("shiftright", j, i).bitwiseAND(1)
        return acc + on * F.bit_count(seed.bitwiseAND(j).bitwiseAND(above)).cast("long")

    total = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), term)
    return sign_of(total + _col(i0))


def owner_of(key: Column | str, shards: int) -> Column:
    """The shard that owns an integer key: its slot of 512, modulo the number of shards."""
    return F.pmod(_col(key).cast("long").bitwiseAND(OWNER_SLOTS - 1), F.lit(shards).cast("long"))


def owner_by_hash(key: Column | str, shards: int) -> Column:
    """The shard that owns a key of any type, for any number of shards."""
    return F.pmod(F.xxhash64(_col(key)), F.lit(shards).cast("long"))


def key_to_int(key: Column | str) -> Column:
    """A string as a 28-bit number, for bucketing and signs; group by the string itself."""
    return F.conv(F.substring(F.md5(_col(key).cast("string")), 1, 7), 16, 10).cast("long")


def key_code(df: DataFrame, code: Column | None = None, key: str = "key") -> Column:
    """31-bit code of a stream's keys: the integers themselves, strings by ``key_to_int``, or
    ``code`` where one is given."""
    if code is None:
        text = isinstance(df.schema[key].dataType, StringType)
        code = key_to_int(key) if text else F.col(key)
    return fold31(code)


def row_hash(row_id: Column | str, seed: tuple[int, ...]) -> Column:
    """31-bit hash of a 62-bit row id; both halves count, so wide ids do not alias."""
    row_id = _col(row_id).cast("long")
    a, b, c, d, e = seed
    low = fourwise(a, b, c, d, row_id.bitwiseAND(MASK31))
    return hash31(e, low, F.shiftright(row_id, 31).bitwiseAND(MASK31))
