"""Order-preserving integer codes for doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps per doubling; one step is a relative difference of 2**(1/128) - 1, about 0.54 %.
STEPS = 128
#: Bits of a code; magnitudes from 2**-128 to 2**128 keep their order, others take the nearest end.
BITS = 16
ZERO = 1 << (BITS - 1)


def log_code(value: Column) -> Column:
    """A code in [1, 65535] that never falls as value rises; null for null and NaN.

    Zero has code 32768. Two values share a code only within one step of each other.
    """
    size = F.least(F.greatest(F.abs(value), F.lit(2.0**-128)), F.lit(2.0**128))
    step = F.least(F.floor(STEPS * (F.log2(size) + 128.0)).cast("int"), F.lit(ZERO - 2)) + 1
    return F.when(value.isNull() | F.isnan(value), F.lit(None).cast("int")).when(value == 0, F.lit(ZERO)).when(value > 0, F.lit(ZERO) + step).otherwise(F.lit(ZERO) - step)
