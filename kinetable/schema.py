"""Column layout of every table the library exchanges.

Position in an array is never implied by row order: each table carries explicit ids.  ``frame_id`` is dense
(0-based, no gaps) inside a sequence; ``vertex_id`` is dense inside a frame; ``k`` is a joint or bone number.
"""

from pyspark.sql import types as T

FRAME = ["seq_id", "frame_id"]
XYZ = ["x", "y", "z"]

POINTS = T.StructType([
    T.StructField("seq_id", T.StringType()), T.StructField("frame_id", T.LongType()),
    T.StructField("vertex_id", T.LongType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType()),
])
FACES = T.StructType([
    T.StructField("seq_id", T.StringType()), T.StructField("frame_id", T.LongType()),
    T.StructField("face_id", T.LongType()),
    T.StructField("v0", T.LongType()), T.StructField("v1", T.LongType()), T.StructField("v2", T.LongType()),
])
JOINTS = T.StructType([
    T.StructField("seq_id", T.StringType()), T.StructField("frame_id", T.LongType()), T.StructField("k", T.LongType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType()),
])
WEIGHTS = T.StructType([
    T.StructField("vertex_id", T.LongType()), T.StructField("k", T.LongType()), T.StructField("w", T.DoubleType()),
])
CAMERA = T.StructType([
    T.StructField("class_name", T.StringType()),
    T.StructField("extrinsic", T.ArrayType(T.DoubleType())),
    T.StructField("intrinsic", T.StructType([
        T.StructField("height", T.LongType()), T.StructField("width", T.LongType()),
        T.StructField("intrinsic_matrix", T.ArrayType(T.DoubleType())),
    ])),
    T.StructField("version_major", T.LongType()), T.StructField("version_minor", T.LongType()),
])
