"""Clip selection, padding, splits and frame or vertex subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import sized
from ..plans.ranking import position_in_order, top_k
from ..schema import FRAME


def lengths(df: DataFrame) -> DataFrame:
    """Number of frames per sequence; frame ids are dense, so the largest id tells it."""
    return df.groupBy("seq_id").agg((F.max("frame_id") + 1).alias("length"))


def crop(df: DataFrame, starts: DataFrame, t: int, rate: int = 1) -> DataFrame:
    """Frames start, start + rate, ... (``t`` at most) of each sequence, renumbered from 0."""
    off = F.col("frame_id") - F.col("start")
    kept = df.join(sized(starts.select("seq_id", "start"), "starts"), "seq_id").where(
        (off >= 0) & (off < t * rate) & (off % rate == 0))
    return kept.withColumn("frame_id", (off / rate).cast("long")).drop("start")


def epoch_starts(lens: DataFrame, epoch: Column | int, t: int, rate: int = 1) -> DataFrame:
    """Deterministic clip start of an epoch.  A sequence shorter than one clip starts at 0."""
    e = F.lit(epoch).cast("long") if isinstance(epoch, int) else epoch.cast("long")
    span = t * rate
    offset = (e % t) * rate
    whole = F.greatest(F.floor(F.col("length") / span), F.lit(1))
    raw = (e % whole) * span + offset
    start = F.when(raw + (t - 1) * rate >= F.col("length"), F.greatest(raw - 2 * offset, F.lit(0))).otherwise(raw)
    return lens.withColumn("start", F.when(F.col("length") < span, 0).otherwise(start).cast("long"))


def random_starts(lens: DataFrame, seed: int, t: int, rate: int = 1) -> DataFrame:
    """Uniform start drawn from a hash of the sequence id; 0 when the sequence is too short."""
    choices = F.greatest(F.col("length") - rate * (t - 1), F.lit(1))
    return lens.withColumn("start", F.pmod(F.xxhash64("seq_id", F.lit(seed)), choices).cast("long"))


def clip_windows(lens: DataFrame, t: int, rate: int = 1) -> DataFrame:
    """Every start the epochs can give, one row per epoch of a full cycle."""
    cycle = F.greatest(F.floor(F.col("length") / (t * rate)), F.lit(1)) * t
    epochs = lens.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), cycle - 1)))
    return epoch_starts(epochs, F.col("epoch"), t, rate)


def pad_last(df: DataFrame, lens: DataFrame, t: int, rate: int = 1) -> DataFrame:
    """Sequences shorter than t * rate get copies of their last frame until ``t`` frames exist.
    With a rate above 1 the crop may still be shorter than ``t``."""
    copies = F.greatest(F.lit(t) - F.col("length"), F.lit(0))
    short = sized(lens.where((F.col("length") < t * rate) & (copies > 0)), "short")
    last = df.join(short, "seq_id").where(
        F.col("frame_id") == F.col("length") - 1)
    extra = last.withColumn("frame_id", F.explode(F.sequence(F.col("length"), F.lit(t - 1).cast("long")))).drop("length")
    return df.unionByName(extra)


def limit_sequences(df: DataFrame, seed: int, n: int) -> DataFrame:
    """First ``n`` sequences of a seeded shuffle."""
    ids = df.select("seq_id").distinct()
    return df.join(ids.orderBy(F.xxhash64("seq_id", F.lit(seed)), "seq_id").limit(n), "seq_id", "left_semi")


def train_test_split(ids: DataFrame, seed: int, share: float = 0.9) -> DataFrame:
    """Seeded shuffle of the sequence ids; position / total <= share is training."""
    placed = position_in_order(
        ids.select("seq_id").distinct().withColumn("_h", F.xxhash64("seq_id", F.lit(seed))).withColumn("_all", F.lit(0)),
        ["_all"], ["_h", "seq_id"], "position")
    total = placed.agg(F.count(F.lit(1)).alias("n")).scalar()
    return placed.select("seq_id", "position", F.when(F.col("position") / total <= share, "train").otherwise("test").alias("split"))


def frame_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """Inclusive range; reaches the scan as a pushed filter."""
    return df.where(F.col("frame_id").between(first, last))


def even_ids(count: Column, n: int) -> Column:
    """``n`` whole numbers evenly spaced over 0 .. count - 1, truncated; the last one is exact."""
    step = (count - 1) / F.lit(float(max(n - 1, 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.when((i == n - 1) & F.lit(n > 1), count - 1).otherwise(F.floor(i * step)).cast("long"))


def subsample_frame_ids(lens: DataFrame, n: int, keep: Column) -> DataFrame:
    """At most ``n`` frames per sequence; if ``keep`` is missing it takes the first place."""
    ids = even_ids(F.col("length"), n)
    chosen = F.when(F.array_contains(ids, keep), ids).otherwise(
        F.concat(F.array(keep), F.slice(ids, 2, n - 1)))
    everything = F.sequence(F.lit(0).cast("long"), F.col("length") - 1)
    picked = F.when(F.col("length") > n, F.array_distinct(chosen)).otherwise(everything)
    return lens.select("seq_id", F.explode(picked).alias("frame_id"))


def subsample_frames(df: DataFrame, n: int, keep: Column) -> DataFrame:
    return df.join(subsample_frame_ids(lengths(df), n, keep), FRAME, "left_semi")


def subsample_vertices(df: DataFrame, n: int, even: bool = False) -> DataFrame:
    """Every (N div n)-th vertex of a frame, ``n`` at most; ``even`` spaces the ids over the whole range."""
    counts = df.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_n"))
    if even:
        ids = counts.where(F.col("_n") > n).select(*FRAME, F.explode(F.array_distinct(even_ids(F.col("_n"), n))).alias("vertex_id"))
        small = counts.where(F.col("_n") <= n).select(*FRAME)
        return df.join(ids, [*FRAME, "vertex_id"], "left_semi").unionByName(df.join(small, FRAME, "left_semi"))
    step = F.greatest(F.floor(F.col("_n") / n), F.lit(1))
    kept = (F.col("vertex_id") % step == 0) & (F.floor(F.col("vertex_id") / step) < n)
    return df.join(counts, FRAME).where(kept).drop("_n")


def sample_vertices_hash(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` random distinct vertices per frame, the same ones on every run."""
    return top_k(df.withColumn("_h", F.xxhash64("vertex_id", F.lit(seed))), FRAME, ["_h", "vertex_id"], n).drop("_h")


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """One point per cubic cell: the mean of its members."""
    cells = points.withColumns({c: F.floor(F.col(a) / size) for a, c in zip("xyz", ("ci", "cj", "ck"))})
    return cells.groupBy(*FRAME, "ci", "cj", "ck").agg(
        *[F.avg(a).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n"))


def mask_low_confidence(keypoints: DataFrame, threshold: float = 0.2, far: float = 1e4) -> DataFrame:
    """Keypoints below the threshold are moved to a far place, with intensity 1."""
    low = F.col("intensity") < threshold
    return keypoints.withColumns({
        **{a: F.when(low, far).otherwise(F.col(a)) for a in "xyz"},
        "intensity": F.when(low, 1.0).otherwise(F.col("intensity")),
    })


def retain_latest(df: DataFrame, n: int, column: str = "epoch") -> DataFrame:
    """Rows of the ``n`` newest epochs."""
    newest = df.select(column).distinct().orderBy(F.desc(column)).limit(n)
    return df.join(newest, column, "left_semi")


def yaw_align(points: DataFrame, rotvecs: DataFrame, starts: DataFrame) -> DataFrame:
    """Turn each clip by the yaw of its first frame: one matrix per sequence, applied to all its points."""
    from ..functions.rotation import add_yaw_matrix, matvec3

    first = rotvecs.join(starts.select("seq_id", "start"), "seq_id").where(F.col("frame_id") == F.col("start"))
    turn = add_yaw_matrix(first.select("seq_id", "rx", "ry", "rz"), "rx", "ry", "rz", "_r").select("seq_id", "_r")
    joined = points.join(turn, "seq_id")
    moved = matvec3(F.col("_r"), F.col("x"), F.col("y"), F.col("z"))
    return joined.withColumns(dict(zip("xyz", moved))).drop("_r")


# Clip settings per data set (frames per clip, conditioned frames, frame step, joints, map width).
GRID_SIZE = 64
CLIP_SETTINGS = [
    {"dataset": "dfaust", "Ttot": 10, "Tcond": 3, "sample_rate": 5, "nkeypoints": 24, "gaussian_sigma": None},
    {"dataset": "aist", "Ttot": 10, "Tcond": 3, "sample_rate": 2, "nkeypoints": 24, "gaussian_sigma": None},
    {"dataset": "animals", "Ttot": 10, "Tcond": 3, "sample_rate": 1, "nkeypoints": 24, "gaussian_sigma": 2.0},
    {"dataset": "panda", "Ttot": 10, "Tcond": 3, "sample_rate": 1, "nkeypoints": 12, "gaussian_sigma": None},
    {"dataset": "hanco", "Ttot": 10, "Tcond": 3, "sample_rate": 1, "nkeypoints": 28, "gaussian_sigma": 1.0},
]
# Every data set uses this longer clip when a pretrained model is refined.
REFINE_SETTINGS = {"Ttot": 20, "Tcond": 5}


def clip_settings(spark, refine: bool = False) -> DataFrame:
    """The settings as a table to join on ``dataset`` (five rows)."""
    extra = REFINE_SETTINGS if refine else {}
    schema = "dataset string, Ttot int, Tcond int, sample_rate int, nkeypoints int, gaussian_sigma double"
    rows = [tuple({**s, **extra}[c.split()[0]] for c in schema.split(", ")) for s in CLIP_SETTINGS]
    return spark.createDataFrame(rows, schema).withColumn("grid_size", F.lit(GRID_SIZE))


def clips_by_dataset(sequences: DataFrame, settings: DataFrame) -> DataFrame:
    """Clip frame count, step and start range of every sequence from its data set's settings."""
    span = F.col("Ttot") * F.col("sample_rate")
    return sequences.join(settings, "dataset").withColumn(
        "n_clips", F.greatest(F.floor(F.col("length") / span), F.lit(1)))
