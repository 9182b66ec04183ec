"""Bounded samples for fitting, chosen by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows drawn beyond the wanted number, since a share by hash is met only on average.
SPARE = 1.15


def hash_sample(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    """At most ``limit`` distinct rows, those with the lowest hash of ``by``.

    A count gives the share of hash values to keep, so about ``limit`` rows in all leave the
    map side, however many partitions there are; rows equal in all columns count once.
    """
    total = df.count()
    share = min(1.0, SPARE * limit / max(1, total))
    mark = F.pmod(F.xxhash64(*by), F.lit(1 << 30))
    return df.where(mark < int(share * (1 << 30))).distinct().orderBy(mark, *by).limit(limit)
