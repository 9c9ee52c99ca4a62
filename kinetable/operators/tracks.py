"""Measures of joint tracks: separation, consistency, trajectories, heat maps, detection scores, metric logs.

The joints of a skeleton are a fixed small number (tens), so pairing the joints of one frame is bounded by the
schema.  Time is not bounded: everything over frames is a partial aggregate or a bounded run of frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import space
from ..plans.lineage import cut, sized
from ..plans.ranking import with_previous
from ..schema import FRAME

AXES = "xyz"


def frame_means(df: DataFrame, keys: list[str], cols: list[str], prefix: str = "mean_") -> DataFrame:
    """Mean over time joined back to every frame."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"{prefix}{c}") for c in cols])
    return df.join(sized(means, "means"), keys)


def displacement(kps: DataFrame) -> DataFrame:
    """Offset of every joint from its temporal mean."""
    m = frame_means(kps, ["seq_id", "k"], list(AXES))
    return m.select(*FRAME, "k", *[(F.col(c) - F.col(f"mean_{c}")).alias(c) for c in AXES])


def joint_pairs(kps: DataFrame, extra: tuple = ()) -> DataFrame:
    """All ordered joint pairs of each frame with the squared distance; ``extra`` columns come from the source."""
    a = kps.select(*FRAME, F.col("k").alias("src"), *[F.col(c).alias(f"a{c}") for c in AXES], *extra)
    b = kps.select(*FRAME, F.col("k").alias("dst"), *[F.col(c).alias(f"b{c}") for c in AXES])
    d2 = space.dist2(*[F.col(f"a{c}") for c in AXES], *[F.col(f"b{c}") for c in AXES])
    return a.join(b, FRAME).select(*FRAME, "src", "dst", *extra, d2.alias("d2"))


def temporal_separation(kps: DataFrame, sigma: float) -> DataFrame:
    """Per clip: mean Gaussian similarity of joint motions over distinct pairs."""
    gaps = joint_pairs(displacement(kps)).groupBy("seq_id", "src", "dst").agg(F.avg("d2").alias("d2"))
    k = F.sqrt(F.count(F.lit(1)).cast("double"))
    return gaps.groupBy("seq_id").agg(
        ((F.sum(space.gauss(F.col("d2"), sigma)) - k) / (k * (k - 1))).alias("separation"))


def influence(affinity: DataFrame, ver: int = 0) -> DataFrame:
    """Largest weight over the sheets; version 2 adds the transposed weight."""
    infl = affinity.groupBy("graph_id", "src", "dst").agg(F.max("w").alias("w"))
    if ver == 2:
        swapped = infl.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        infl = infl.unionByName(swapped).groupBy("graph_id", "src", "dst").agg(F.sum("w").alias("w"))
    return infl.withColumnRenamed("w", "infl")


def _pair_count(kps: DataFrame) -> DataFrame:
    n = kps.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*FRAME, (F.col("n") * F.col("n")).cast("double").alias("pairs"))


def graph_consistency(kps: DataFrame, affinity: DataFrame, ver: int = 0) -> DataFrame:
    """Per frame: mean of d2 * influence (local) and of |d2 - temporal mean d2| * influence (time), both weighted by
    the source's intensity for versions 0 and 2.  Pairs without influence count as 0 in the mean."""
    infl = influence(affinity, ver).withColumnRenamed("graph_id", "seq_id")
    linked = joint_pairs(kps, ("intensity",)).join(infl, ["seq_id", "src", "dst"])
    mean = linked.groupBy("seq_id", "src", "dst").agg(F.avg("d2").alias("mean_d2"))
    weight = F.col("infl") * F.col("intensity") if ver in (0, 2) else F.col("infl")
    sums = linked.join(mean, ["seq_id", "src", "dst"]).groupBy(*FRAME).agg(
        F.sum(F.col("d2") * weight).alias("l"), F.sum(F.abs(F.col("d2") - F.col("mean_d2")) * weight).alias("t"))
    return sums.join(_pair_count(kps), FRAME).select(
        *FRAME, (F.col("l") / F.col("pairs")).alias("local"), (F.col("t") / F.col("pairs")).alias("time"))


def affinity_complexity(affinity: DataFrame) -> DataFrame:
    """Sum over sheet pairs of (a_n a_m)^2 without the own square, over K * K.

    (sum a^2)^2 - sum a^4 per joint pair gives the sum over distinct sheets without pairing them."""
    k = affinity.groupBy("graph_id").agg(F.greatest(F.max("src"), F.max("dst")).alias("_k"))
    sq = F.col("w") * F.col("w")
    cell = affinity.groupBy("graph_id", "src", "dst").agg((F.sum(sq) * F.sum(sq) - F.sum(sq * sq)).alias("v"))
    total = cell.groupBy("graph_id").agg(F.sum("v").alias("v")).join(k, "graph_id")
    n = (F.col("_k") + 1).cast("double")
    return total.select("graph_id", (F.col("v") / (n * n)).alias("complexity"))


def motion(kps: DataFrame) -> DataFrame:
    """Velocity (where the frame before exists), acceleration (where the two before do) and the averaged intensities of
    every joint.  A missing frame breaks the track: nothing is measured across it."""
    cols = list(AXES) + ["intensity"]
    w = with_previous(kps, ["seq_id", "k"], "frame_id", {n: {c: f"{c}{n}" for c in cols} for n in (1, 2)})
    out = [*FRAME, F.col("k")]
    for c in AXES:
        out += [(F.col(c) - F.col(f"{c}1")).alias(f"v{c}"),
                ((F.col(c) - F.col(f"{c}1")) - (F.col(f"{c}1") - F.col(f"{c}2"))).alias(f"a{c}")]
    iv, iv1 = (F.col("intensity") + F.col("intensity1")) / 2, (F.col("intensity1") + F.col("intensity2")) / 2
    return w.select(*out, iv.alias("vi"), ((iv + iv1) / 2).alias("ai")).where(F.col("vx").isNotNull())


def next_frame(frames: DataFrame) -> DataFrame:
    """(t, min(t + 1, T - 1)) for every frame of a listing with dense ids."""
    last = frames.groupBy("seq_id").agg(F.max("frame_id").alias("_last"))
    return frames.join(last, "seq_id").select(*FRAME, F.least(F.col("frame_id") + 1, F.col("_last")).alias("next_id"))


def trajectory_similarity(kps: DataFrame, affinity: DataFrame, ver: int = 0) -> DataFrame:
    """Per sequence: (1 - cosine) / 2 of joint velocities and of accelerations, times influence (and the source's
    averaged intensity for versions 0 and 2), averaged over time and over K * K pairs."""
    m = motion(kps)
    infl = influence(affinity, ver).withColumnRenamed("graph_id", "seq_id")
    cols = [f"{p}{c}" for p in "va" for c in AXES]
    a = m.select(*FRAME, F.col("k").alias("src"), "vi", "ai", *[F.col(c).alias(f"s{c}") for c in cols])
    b = m.select(*FRAME, F.col("k").alias("dst"), *[F.col(c).alias(f"d{c}") for c in cols])
    pairs = a.join(b, FRAME).join(infl, ["seq_id", "src", "dst"])
    bend = lambda p: (1 - space.cosine3([F.col(f"s{p}{c}") for c in AXES], [F.col(f"d{p}{c}") for c in AXES])) / 2
    with_i = ver in (0, 2)
    vel = bend("v") * F.col("infl") * (F.col("vi") if with_i else 1)
    acc = bend("a") * F.col("infl") * (F.col("ai") if with_i else 1)
    per = pairs.groupBy("seq_id").agg(F.sum(vel).alias("v"), F.sum(acc).alias("a"))
    size = kps.groupBy("seq_id").agg((F.max("frame_id") + 1).cast("double").alias("t"), (F.max("k") + 1).cast("double").alias("n"))
    value = (F.col("v") / (F.col("t") - 1) + F.col("a") / (F.col("t") - 2)) / (F.col("n") * F.col("n"))
    return per.join(size, "seq_id").select("seq_id", value.alias("trajectory"))


def bone_lengths(kps: DataFrame, bones: DataFrame) -> DataFrame:
    """Child joined with its parent: distance per frame and bone; roots have none."""
    parent = kps.select(*FRAME, F.col("k").alias("parent"), *[F.col(c).alias(f"p{c}") for c in AXES])
    child = kps.join(bones.where((F.col("parent") >= 0) & (F.col("parent") != F.col("k"))), "k")
    d2 = space.dist2(*[F.col(c) for c in AXES], *[F.col(f"p{c}") for c in AXES])
    return child.join(parent, [*FRAME, "parent"]).select(*FRAME, "k", "parent", F.sqrt(d2).alias("length"))


def lower_median(df: DataFrame, keys: list[str], value: str, cuts: int = 512, rounds: int = 2) -> DataFrame:
    """Exact lower median (row (n - 1) div 2 of the sorted values) of each group.

    A quantile sketch, a partial aggregate of fixed size, brackets the median between two of ``cuts`` quantiles;
    exact counts below and inside the bracket confirm it (otherwise the whole range stays), and only the rows
    inside, about 3 / cuts of the group whatever its distribution, go to the next round.  The distinct values left
    after the rounds are tallied and walked to the wanted rank.
    """
    steps = [i / cuts for i in range(cuts + 1)]
    v = F.col(value)
    rows = cut(df.select(*keys, value).where(v.isNotNull()), "median")  # read several times below
    want = rows.groupBy(*keys).agg(F.floor((F.count(F.lit(1)) - 1) / 2).alias("_want"))
    for _ in range(rounds):
        box = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"),
                                      F.percentile_approx(value, steps, 10000).alias("_q")).join(want, keys)
        i = F.floor(F.col("_want") * cuts / F.col("_n")).cast("int")
        lo = F.get("_q", F.greatest(i - 1, F.lit(0)))
        hi = F.get("_q", F.least(i + 2, F.lit(cuts)))
        box = box.select(*keys, "_want", "_min", "_max", lo.alias("_lo"), hi.alias("_hi"))
        seen = rows.join(box, keys).groupBy(*keys, "_want", "_min", "_max", "_lo", "_hi").agg(
            F.sum((v < F.col("_lo")).cast("long")).alias("_below"),
            F.sum(v.between(F.col("_lo"), F.col("_hi")).cast("long")).alias("_in"))
        sure = (F.col("_below") <= F.col("_want")) & (F.col("_want") < F.col("_below") + F.col("_in"))
        pick = seen.select(*keys, F.when(sure, F.col("_lo")).otherwise(F.col("_min")).alias("_lo"),
                           F.when(sure, F.col("_hi")).otherwise(F.col("_max")).alias("_hi"),
                           (F.col("_want") - F.when(sure, F.col("_below")).otherwise(0)).alias("_want"))
        pick = sized(pick, "median-brackets")
        want = pick.select(*keys, "_want")
        rows = rows.join(pick.drop("_want"), keys).where(v.between(F.col("_lo"), F.col("_hi"))).select(*keys, value)
    tally = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    packed = tally.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(v.alias("v"), F.col("_c").alias("c")))).alias("h"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
    step = lambda acc, b: F.struct((acc["seen"] + b["c"]).alias("seen"), F.when(
        acc["v"].isNull() & (acc["seen"] + b["c"] > F.col("_want")), b["v"]).otherwise(acc["v"]).alias("v"))
    return packed.join(want, keys).select(*keys, F.aggregate("h", start, step)["v"].alias(f"median_{value}"))


def median_bone_lengths(kps: DataFrame, bones: DataFrame) -> DataFrame:
    """Lower median over time of each bone's length."""
    return lower_median(bone_lengths(kps, bones), ["seq_id", "k", "parent"], "length")


def closest_detection(joints_gt: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Nearest detected keypoint of every true joint in every frame; ties go to the lowest number."""
    g = joints_gt.select(*FRAME, F.col("k").alias("k_gt"), *[F.col(c).alias(f"g{c}") for c in AXES])
    d2 = space.dist2(*[F.col(f"g{c}") for c in AXES], *[F.col(c) for c in AXES])
    met = g.join(keypoints.select(*FRAME, "k", *AXES), FRAME).withColumn("d2", d2)
    return met.groupBy(*FRAME, "k_gt").agg(F.min_by("k", F.struct("d2", "k")).alias("k_det"))


def semantic_counts(joints_gt: DataFrame, keypoints: DataFrame) -> DataFrame:
    return closest_detection(joints_gt, keypoints).groupBy("k_gt", "k_det").agg(F.count(F.lit(1)).alias("n"))


def semantic_scores(counts: DataFrame) -> DataFrame:
    """Share of the most frequent detection per true joint; the final form divides every joint by the total of
    true joint 0."""
    first = counts.where("k_gt = 0").agg(F.sum("n").alias("n")).scalar()
    return counts.groupBy("k_gt").agg(
        (F.max("n") / F.sum("n")).alias("log_score"), (F.max("n") / first).alias("final_score"))


def soft_argmax(heat: DataFrame, keys: list[str], grid: int, dims: int = 3) -> DataFrame:
    """Keypoint per heat channel: expected grid coordinate under the heat, plus 1e-6 in every cell, and the mean
    heat relative to the strongest channel.  The floor is added per bin (grid ** (dims - 1) cells each), so
    absent cells need no rows."""
    floor = 1e-6 * grid ** (dims - 1)
    line = F.array(*[F.lit(-1.0) + F.lit(g) * F.lit(2.0 / (grid - 1)) for g in range(grid)])
    lin = lambda c: F.get(line, F.col(c).cast("int"))
    axes = list(zip("xyz", ("i", "j", "l")))[:dims]
    # expected value splits into the heat's own first moment and the floor's, which is 0 by symmetry
    agg = heat.groupBy(*keys, "k").agg(F.sum("h").alias("_h"), *[F.sum(F.col("h") * lin(c)).alias(f"_{a}") for a, c in axes])
    total = F.col("_h") + F.lit(floor * grid)
    coords = agg.select(*keys, "k", "_h", *[(F.col(f"_{a}") / total).alias(a) for a, _ in axes])
    top = coords.groupBy(*keys).agg(F.max("_h").alias("_top"))
    cells = float(grid ** dims)
    return coords.join(top, keys).select(
        *keys, "k", *[a for a, _ in axes],
        ((F.col("_h") / cells) / (F.col("_top") / cells + F.lit(1e-6))).alias("intensity"))


def heat_sparsity(heat: DataFrame, keys: list[str], grid: int, channels: int, dims: int = 3) -> DataFrame:
    """Mean over channels of the absolute mean heat of the dense grid."""
    per = heat.groupBy(*keys, "k").agg(F.abs(F.sum("h") / float(grid ** dims)).alias("m"))
    return per.groupBy(*keys).agg((F.sum("m") / float(channels)).alias("sparsity"))


def gaussian_render(kps: DataFrame, grid: int, sigma: float, radius: float | None = None) -> DataFrame:
    """Intensity times a separable Gaussian of width sigma / grid at every cell.  ``radius`` (in [-1, 1] units)
    drops cells farther than that along an axis before they are generated; the default is exact."""
    out = kps
    width = 2.0 * (sigma / grid) ** 2
    value = F.col("intensity")
    for a, c in zip(AXES, ("i", "j", "l")):
        lo, hi = F.lit(0), F.lit(grid - 1)
        if radius is not None:
            place = (F.col(a) + 1) / (2.0 / (grid - 1))
            reach = radius / (2.0 / (grid - 1))
            lo = F.least(F.greatest(F.ceil(place - reach), F.lit(0)), F.lit(grid - 1)).cast("int")
            hi = F.greatest(F.least(F.floor(place + reach), F.lit(grid - 1)), lo).cast("int")
        out = out.withColumn(c, F.explode(F.sequence(lo, hi)))
        d = space.grid_line(F.col(c), grid) - F.col(a)
        value = value * F.exp(-d * d / F.lit(width))
    return out.select(*FRAME, "k", "i", "j", "l", value.alias("g"))


def gaussian_combine(rendered: DataFrame, how: str = "max") -> DataFrame:
    """One map per frame from the maps of all keypoints: largest value, or the sum clipped to [0, 1]."""
    g = F.max("g") if how == "max" else F.greatest(F.least(F.sum("g"), F.lit(1.0)), F.lit(0.0))
    return rendered.groupBy(*FRAME, "i", "j", "l").agg(g.alias("g"))


def rest_pose_scores(points: DataFrame, joints: DataFrame, bones: DataFrame, rotations: DataFrame) -> DataFrame:
    """Geometric fitness of each frame as the rest pose; ``rotations`` has r, the 3x3 matrix of every joint."""
    lens = bone_lengths(joints, bones).groupBy(*FRAME).agg(
        F.stddev_pop("length").alias("ls"), F.avg("length").alias("lm"),
        F.sum(1 / (F.col("length") + 0.1)).alias("hs"))
    center = joints.groupBy(*FRAME).agg(
        *[F.avg(c).alias(f"j{c}") for c in AXES], F.count(F.lit(1)).alias("nj"),
        (sum((F.max(c) - F.min(c) for c in "yz"), F.max("x") - F.min("x")) / 3).alias("coverage"))
    spread = joints.join(center, FRAME).groupBy(*FRAME).agg(
        F.stddev_pop(space.norm3(*[F.col(c) - F.col(f"j{c}") for c in AXES])).alias("spread"))
    identity = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    off = F.sqrt(sum(((F.col("r")[i] - v) * (F.col("r")[i] - v) for i, v in list(enumerate(identity))[1:]),
                     (F.col("r")[0] - 1.0) * (F.col("r")[0] - 1.0)))
    turns = rotations.groupBy(*FRAME).agg(F.avg(off).alias("turn"))
    mesh = points.groupBy(*FRAME).agg(
        *[F.avg(c).alias(f"m{c}") for c in AXES],
        ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) * (F.max("z") - F.min("z"))).alias("volume"))
    all_ = mesh.join(center, FRAME).join(spread, FRAME).join(turns, FRAME).join(lens, FRAME, "left")
    stab = F.when(F.col("lm").isNull(), 0.0).otherwise(1 / (F.col("ls") / (F.col("lm") + 1e-6) + 0.01))
    rot = 1 / (F.col("turn") + 0.1)
    dist = F.when(F.col("nj") > 1, F.col("spread") * F.col("coverage")).otherwise(0.0)
    align = 1 / (space.norm3(*[F.col(f"j{c}") - F.col(f"m{c}") for c in AXES]) + 0.1)
    hier = F.coalesce("hs", F.lit(0.0)) / F.greatest(F.lit(1), F.col("nj"))
    compact = 1 / (F.col("volume") + 1e-6)
    score = 3.0 * stab + 2.0 * rot + 1.5 * dist + 1.0 * align + 1.0 * hier + 0.5 * compact
    return all_.select(*FRAME, stab.alias("stability"), rot.alias("rotation"), dist.alias("distribution"),
                       align.alias("alignment"), hier.alias("hierarchy"), compact.alias("compactness"), score.alias("score"))


def best_rest_pose(scores: DataFrame) -> DataFrame:
    """Frame with the highest score per sequence; the earliest wins a tie."""
    return scores.groupBy("seq_id").agg(F.max_by("frame_id", F.struct("score", -F.col("frame_id"))).alias("frame_id"))


def best_candidate(observed: DataFrame, samples: DataFrame) -> DataFrame:
    """Among sampled joint sets per frame, the one with the smallest summed squared distance to the observation."""
    o = observed.select(*FRAME, "k", *[F.col(c).alias(f"o{c}") for c in [*AXES, "intensity"]])
    gaps = [F.col(c) - F.col(f"o{c}") for c in [*AXES, "intensity"]]
    cost = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
    per = samples.join(o, [*FRAME, "k"]).groupBy(*FRAME, "sample").agg(F.sum(cost).alias("cost"))
    return per.groupBy(*FRAME).agg(F.min_by("sample", F.struct("cost", "sample")).alias("sample"), F.min("cost").alias("cost"))


def keypoint_recon_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Squared difference summed over joints and channels of each frame."""
    one = a.select(*FRAME, "k", *[F.col(c).alias(f"o{c}") for c in [*AXES, "intensity"]])
    gaps = [F.col(c) - F.col(f"o{c}") for c in [*AXES, "intensity"]]
    return b.join(one, [*FRAME, "k"]).groupBy(*FRAME).agg(F.sum(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])).alias("error"))


def metric_epoch_mean(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("epoch", "key").agg(F.avg("value").alias("value"))


# Loss terms; a term without a given weight counts once.
LOSS_TERMS = [
    "recon_loss", "sparsity_loss", "separation_loss", "vol_fit_reg", "kypt_const_loss", "local_const_loss",
    "time_const_loss", "sparsity_const_loss", "intensity_const_loss", "graph_traj_loss", "graph_vol_loss",
    "kl_kypt", "kypt_recon_loss", "gae_recon_loss", "topo_recon_loss",
]


def weighted_total(epoch_means: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of weight * mean per epoch; keys without a weight count once."""
    table = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    w = F.coalesce(F.try_element_at(table, F.col("key")), F.lit(1.0))
    return epoch_means.groupBy("epoch").agg(F.sum(F.col("value") * w).alias("total"))


def normal_kl_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean KL of posterior (m1, raw1) against prior (m2, raw2)."""
    return df.groupBy(*keys).agg(F.avg(space.normal_kl(F.col("m1"), F.col("raw1"), F.col("m2"), F.col("raw2"))).alias("kl"))
