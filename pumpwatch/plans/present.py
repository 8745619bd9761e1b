"""Output edge of a registered query: portable column types.

DECIMAL → DOUBLE (the reference hands floats to its callers) and session
timestamps → TIMESTAMP_NTZ holding the UTC wall time, so a result compares
equal to a time-zone-naive SQL engine whatever the reader's local zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(df: DataFrame) -> DataFrame:
    cols = []
    changed = False
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c, changed = c.cast("double"), True
        elif isinstance(f.dataType, T.TimestampType):
            c, changed = c.cast("timestamp_ntz"), True
        cols.append(c.alias(f.name))
    return df.select(*cols) if changed else df
