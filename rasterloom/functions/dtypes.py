"""Cell and coordinate types."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark types that hold each numpy type; Spark has no unsigned integers.
SPARK = {
    "bool": "boolean", "int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int",
    "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double",
}


def spark_type(dtype: str) -> str:
    name = np.dtype(dtype).name
    if name not in SPARK:
        raise ValueError(f"cells of type {name} are not supported")
    return SPARK[name]


def cells_of(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda acc, n: acc * n.cast("long"))


def dim_dtype(shape: Column) -> Column:
    """The smallest unsigned type that holds the number of cells."""
    n = cells_of(shape)
    return F.when(n <= 0xFF, "uint8").when(n <= 0xFFFF, "uint16").when(n <= 0xFFFFFFFF, "uint32").otherwise("uint64")
