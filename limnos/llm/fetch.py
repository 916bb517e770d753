"""The texts of some documents, without moving the others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter that is broadcast: a megabyte at any size.
FILTER_BITS = 1 << 23


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` (64-bit digest) may be among those of ``wanted``: all that are, and few others.

    A key sets one bit of FILTER_BITS. An exact join follows; what is filtered
    out need not be shuffled for it. With very many keys the filter lets more
    rows through, and the join alone does the work.
    """
    spark = rows.sparkSession
    place = F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(FILTER_BITS))
    bits = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), cast(p & 63 as int))")).alias("bits"))
    words = np.zeros(FILTER_BITS >> 6, np.int64)
    for r in bits.collect():  # a row a word at most
        words[r["word"]] = r["bits"]
    shared = spark.sparkContext.broadcast(words.tobytes())

    @F.pandas_udf("boolean")
    def known(places: pd.Series) -> pd.Series:
        table = np.frombuffer(shared.value, np.int64)
        p = places.to_numpy()
        return pd.Series((table[p >> 6] >> (p & 63)) & 1 == 1)

    return rows.where(known(place))
