"""Tables whose schema isn't declared and may differ from file to file (D3, SRC-1: ``products``, ``order_item_refunds``).

Schema on read over all Parquet footers: columns are united by name (missing ones are NULL) and types of one column
widened to the smallest type that holds all of them.  Spark merges footers in a distributed job but stops
at two types of one column, so files are then halved until each part merges: ``k`` changes of type along the
sorted files cost about ``k * log2(files)`` merges, and only schemas reach the driver.  Parts of one schema are read
together, each cast to the united schema, in one plan with a scan per distinct schema.

Widening: integers to the longer one; decimals to one that holds both; integers with decimals likewise; numbers with
float or double to double (integers above 2**53 lose their last digits there); dates with timestamps to the timestamp;
anything else to text.  A nested column has to have one type (:class:`SchemaError` otherwise).  A table
without files, or a path that isn't there, raises as any Parquet read does; files without rows count
with their schema.
"""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickmetrics.sources.schema import SchemaError

_INTEGERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_DIGITS = dict(zip(("tinyint", "smallint", "int", "bigint"), (3, 5, 10, 19), strict=True))


def _decimal(t: T.DataType) -> tuple[int, int] | None:
    """Digits before and after the point."""
    if isinstance(t, T.DecimalType):
        return t.precision - t.scale, t.scale
    return (_DIGITS[t.simpleString()], 0) if t in _INTEGERS else None


def widen(a: T.DataType, b: T.DataType, column: str) -> T.DataType:
    """The smallest type of the rules above that holds values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if any(isinstance(t, T.ArrayType | T.MapType | T.StructType) for t in (a, b)):
        raise SchemaError(f"{column} is {a.simpleString()} in some files and {b.simpleString()} in others")
    if a in _INTEGERS and b in _INTEGERS:
        return max(a, b, key=_INTEGERS.index)
    da, db = _decimal(a), _decimal(b)
    if da and db:
        whole, scale = max(da[0], db[0]), max(da[1], db[1])
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    numbers = T.FloatType | T.DoubleType
    if (isinstance(a, numbers) or da) and (isinstance(b, numbers) or db):
        return T.DoubleType()
    times = [t for t in (a, b) if not isinstance(t, T.DateType)]
    if len(times) == 1 and isinstance(times[0], T.TimestampType | T.TimestampNTZType):
        return times[0]
    return T.StringType()


def united(schemas: list[T.StructType]) -> T.StructType:
    """Columns of all schemas by name (case doesn't tell them apart), in order of first appearance, all nullable."""
    out: dict[str, T.StructField] = {}
    for f in (f for s in schemas for f in s):
        key = f.name.lower()
        old = out.get(key)
        out[key] = T.StructField(old.name, widen(old.dataType, f.dataType, old.name)) if old else T.StructField(f.name, f.dataType)
    return T.StructType(list(out.values()))


def _merged(spark: SparkSession, root: str, files: list[str]) -> DataFrame | None:
    """A read of ``files`` over their merged schema, or None where two types of a column meet."""
    try:
        return spark.read.option("mergeSchema", True).option("basePath", root).parquet(*files)
    except (PySparkException, Py4JJavaError) as e:
        # CANNOT_MERGE_SCHEMAS, or CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE below it
        if "CANNOT_MERGE_" not in str(e):
            raise
        return None


def _parts(spark: SparkSession, root: str, files: list[str]) -> list[tuple[T.StructType, list[str]]]:
    df = spark.read.option("basePath", root).parquet(*files) if len(files) == 1 else _merged(spark, root, files)
    if df is not None:
        return [(df.schema, files)]
    half = len(files) // 2
    return _parts(spark, root, files[:half]) + _parts(spark, root, files[half:])


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of ``path`` with the united schema of all of them."""
    files = sorted(spark.read.parquet(path).inputFiles())
    if not files:
        return spark.read.parquet(path)
    by_schema: dict[str, tuple[T.StructType, list[str]]] = {}
    for schema, part in _parts(spark, path, files):
        by_schema.setdefault(schema.json(), (schema, []))[1].extend(part)
    schema = united([s for s, _ in by_schema.values()])

    def as_united(own: T.StructType, part: list[str]) -> DataFrame:
        df = spark.read.schema(own).option("basePath", path).parquet(*part)
        names = {f.name.lower(): f.name for f in own}
        return df.select(*[(F.col(f"`{names[f.name.lower()]}`") if f.name.lower() in names else F.lit(None))
                           .cast(f.dataType).alias(f.name) for f in schema])

    return reduce(DataFrame.unionByName, [as_united(*g) for g in by_schema.values()])
