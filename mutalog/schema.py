"""The two row shapes: what writers append and what readers see."""

from pyspark.sql import types as T

#: One version of one key. value NULL is a delete marker; seq orders versions inside a generation.
MUTATION = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("seq", T.LongType(), False),
        T.StructField("gen", T.LongType(), False),
        T.StructField("expires_at", T.TimestampType(), True),
    ]
)

#: What a reader sees: the newest live version of a key.
ENTRY = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])
