"""A bounded sample of labelled rows for the classifiers: the rows of the smallest hashes in each stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_RANGE = 1 << 32


def smallest_hashes(rows: DataFrame, strata: list[str], key: str, most: int, salt: str) -> tuple[list[Row], dict[tuple, int]]:
    """At most ``most`` rows of each stratum, and how many rows each has.  ``rows``: distinct keys; ``strata``: columns of few distinct values.

    A stratum's rows are thinned by their hashes first, to somewhat more than wanted, so that what is ranked is as small as the sample.
    """
    sizes = {tuple(r[s] for s in strata): r["count"] for r in rows.groupBy(*strata).count().collect()}
    place = F.pmod(F.xxhash64(F.lit(salt), key), F.lit(_RANGE))
    few = F.lit(False)
    for values, n in sizes.items():
        own = F.lit(True)
        for name, value in zip(strata, values, strict=True):
            own &= F.col(name).eqNullSafe(F.lit(value))
        few |= own & (place < int(_RANGE * min(1.0, 1.3 * (most + 100) / n)))
    nth = F.row_number().over(W.partitionBy(*strata).orderBy(place, key))
    return rows.filter(few).withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth").collect(), sizes
