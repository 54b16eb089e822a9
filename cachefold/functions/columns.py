"""Column functions: saturating and integer arithmetic, stable hashes, cost formulas, small-float bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20
#: Fixed values of the cost model: microseconds a prefill token, a decode token, a running decode, a queued token.
PREFILL_US, DECODE_US, RUNNING_US, QUEUED_US = 45, 80, 1500, 4
#: Microseconds a MiB from each tier, for a block in the worker's own memory, and for leaving a domain.
TIER_US = {"hbm": 20, "remote_hbm": 20, "cpu_dram": 55, "local_ssd": 280, "object_store": 1800}
LOCAL_US, FAR_US = 5, 350
#: Tiers from fast to slow, and other names of them.
TIER_RANK = {"hbm": 0, "remote_hbm": 1, "cpu_dram": 2, "local_ssd": 3, "object_store": 4}
TIER_NAMES = {
    "hbm": ["hbm", "gpu", "gpu_memory", "vram"],
    "remote_hbm": ["remote_hbm", "remote_gpu"],
    "cpu_dram": ["cpu_dram", "cpu", "dram", "host"],
    "local_ssd": ["local_ssd", "nvme", "disk", "ssd"],
    "object_store": ["object_store", "s3", "blob"],
}


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def div_ceil(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as double; null over 0."""
    return F.when(whole != 0, 100.0 * part.cast("double") / whole.cast("double"))


def stable_hash(key: Column) -> Column:
    """32 bits of md5 as a long: the same in every engine."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(key: Column) -> Column:
    return stable_hash(key).cast("double") / float(1 << 32)


def by_value(column: Column, values: dict, otherwise: Column | None = None) -> Column:
    """CASE column WHEN ... THEN ... for a small fixed table."""
    out = None
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out if otherwise is None else out.otherwise(otherwise)


def tier_of(name: Column) -> Column:
    """A tier from any of its names, in any case; unknown names count as hbm."""
    low = F.lower(name)
    out = None
    for tier, names in TIER_NAMES.items():
        out = F.when(low.isin(names), tier) if out is None else out.when(low.isin(names), tier)
    return out.otherwise("hbm")


def transfer_us(tier: Column, size: Column, same_worker: Column, same_domain: Column) -> Column:
    """Microseconds to bring a block of ``size`` bytes from ``tier`` of another or the same worker."""
    rate = by_value(tier, TIER_US)
    move = rate * F.greatest(F.lit(1), div_ceil(size, MIB)) + F.when(same_worker | same_domain, 0).otherwise(FAR_US)
    return F.when(same_worker & (tier == "hbm"), LOCAL_US).otherwise(move).cast("long")


def small_float_up(size: Column) -> Column:
    """Bin of a size in a float with 3 mantissa bits, rounded up: every size in the bin fits its regions."""
    return F.when(size < 8, size).otherwise(_bin(size) + F.when(F.expr("0") != _rest(size), 1).otherwise(0)).cast("long")


def small_float_down(size: Column) -> Column:
    return F.when(size < 8, size).otherwise(_bin(size)).cast("long")


def _high_bit(size: Column) -> Column:
    """Place of the highest set bit, exact for all positive longs."""
    return F.length(F.bin(size)).cast("long") - 1


def _shifted(size: Column) -> Column:
    return F.call_function("shiftright", size, (_high_bit(size) - 3).cast("int"))


def _bin(size: Column) -> Column:
    return ((_high_bit(size) - 3 + 1) * 8 + _shifted(size).bitwiseAND(F.lit(7))).cast("long")


def _rest(size: Column) -> Column:
    return size - F.call_function("shiftleft", _shifted(size), (_high_bit(size) - 3).cast("int"))


def small_float_value(bin_: Column) -> Column:
    """The smallest size that a bin stands for."""
    exponent, mantissa = F.floor(bin_ / 8), bin_.bitwiseAND(F.lit(7))
    big = F.call_function("shiftleft", (mantissa + 8).cast("long"), (exponent - 1).cast("int"))
    return F.when(exponent == 0, mantissa).otherwise(big).cast("long")
