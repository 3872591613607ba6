"""Nearest objects on the sky within a radius, over a tree of cells that is cut where the rows are dense.

The sky is cut into the six faces of a cube and each face into 4 x 4 cells again and again, where a cell holds many probes
or many targets. All probes of a cell that is not cut further search together: from the root, cells of targets are opened
step by step, and of them are kept those that may hold one of the k nearest within the radius, by the boxes around their
points and the probes. The kept targets then meet the cell's probes. So how many targets a probe meets depends on k, not
on how many lie within the radius, and no pair is missed: there are no special cases at 0 h and at the poles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle in degrees by the haversine formula."""
    a = F.pow(F.sin(F.radians(dec2 - dec1) / 2), F.lit(2)) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), F.lit(2))
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


#: Probes and targets that a cell may hold before it is cut.
PROBES, TARGETS = 256, 32
#: Steps of the tree: to a face, by place (to 0.1 seconds of arc), and by id where more lie at one place.
PLACE, BY_ID = 11, 3
STEPS = 1 + PLACE + BY_ID
#: Cells of a step up to which they are broadcast; more are joined by shuffles.
BROADCAST = 1 << 17
#: Cuts by declination of a dense cell before its slices.
CUTS = 64
#: Targets that a group of probes meets at a time; cells with more, which the tree cannot cut, are cut into slices.
DENSE = 4096


def nearest_on_sky(probes: DataFrame, targets: DataFrame, radius_deg: float, probe: tuple[str, str, str], target: tuple[str, str, str], k: int = 1) -> DataFrame:
    """probe id, target id, separation (degrees): the k nearest targets of each probe within the radius, ties to the smaller id.

    probe and target name id, ra and dec. Rows without coordinates match nothing. Small jobs, which count rows of cells, run
    when it is called. Of targets at exactly one place only the k smallest ids take part. A cell of the tree's last step
    with more than DENSE targets is cut by declination into slices of as many, and the k nearest of each slice meet.
    """
    p, t = _placed(probes, probe, "probe_id", "1"), _placed(targets, target, "target_id", "2")
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy("ra2", "dec2").orderBy("target_id"))).filter(F.col("_r") <= k).drop("_r")
    cut = _cut(p, t)
    p, t = _in_cells(p, cut), _in_cells(t, cut)
    tree = _tree(t, len(cut))
    near = _kept(p, tree, len(cut), radius_deg, k)
    ends = t.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("target_id", "ra2", "dec2")).alias("met")).filter(F.col("n") <= DENSE).drop("n")
    met = near.filter(F.col("n") <= DENSE).join(ends, "cell")
    met = met.withColumn("part", F.floor((F.sum("n").over(Window.partitionBy("group").orderBy("cell")) - F.col("n")) / DENSE))
    met = met.groupBy("group", "part").agg(F.flatten(F.collect_list("met")).alias("met"), F.first("reach").alias("reach"))
    both = p.withColumnRenamed("cell", "group").join(met, "group")
    at = F.transform("met", lambda c: F.struct(separation(F.col("ra1"), F.col("dec1"), c["ra2"], c["dec2"]).alias("separation"), c["target_id"].alias("target_id")))
    best = F.slice(F.array_sort(F.filter(at, lambda c: c["separation"] <= F.col("reach"))), 1, k)
    found = both.select("probe_id", F.explode(best).alias("c")).select("probe_id", "c.target_id", "c.separation")
    dense = tree.filter((F.col("cell") == F.col("above")) & (F.col("n") > DENSE)).select(F.col("cell").alias("zone"), F.lit(0).alias("cell"))
    if not dense.isEmpty():
        asked = p.withColumnRenamed("cell", "group").join(near.filter(F.col("n") > DENSE).select("group", F.col("cell").alias("zone")), "group").select("probe_id", "ra1", "dec1", "zone", F.lit(0).alias("cell"))
        there = t.select("target_id", "ra2", "dec2", F.col("cell").alias("zone"), F.lit(0).alias("cell")).join(F.broadcast(dense), ["zone", "cell"], "left_semi")
        pairs = _in_slices(asked, there, dense, radius_deg).withColumn("separation", separation(F.col("ra1"), F.col("dec1"), F.col("ra2"), F.col("dec2"))).filter(F.col("separation") <= radius_deg)
        first = F.row_number().over(Window.partitionBy("probe_id", "zone", "cell", "slice").orderBy("separation", "target_id"))
        found = found.unionByName(pairs.withColumn("_r", first).filter(F.col("_r") <= k).select("probe_id", "target_id", "separation"))
    order = Window.partitionBy("probe_id").orderBy("separation", "target_id")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select("probe_id", "target_id", "separation")


def _placed(df: DataFrame, names: tuple[str, str, str], key: str, n: str) -> DataFrame:
    """Id, ra, dec, the point on the unit sphere and its path: bits of its face of the cube, of both places on that and of its id."""
    df = df.select(F.col(names[0]).alias(key), F.pmod(F.col(names[1]).cast("double"), F.lit(360.0)).alias(f"ra{n}"), F.col(names[2]).cast("double").alias(f"dec{n}"))
    df = df.filter((F.abs(f"ra{n}") < math.inf) & (F.abs(f"dec{n}") < math.inf))
    ra, dec = F.radians(f"ra{n}"), F.radians(f"dec{n}")
    df = df.withColumns({"x": F.cos(dec) * F.cos(ra), "y": F.cos(dec) * F.sin(ra), "z": F.sin(dec)})
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    most = F.greatest(F.abs(x), F.abs(y), F.abs(z))
    axis = F.when(F.abs(x) == most, 0).when(F.abs(y) == most, 1).otherwise(2)
    df = df.withColumns({"axis": axis, "most": most})
    u, v, along = (F.when(F.col("axis") == 0, a).when(F.col("axis") == 1, b).otherwise(c) for a, b, c in ((y, x, x), (z, z, y), (x, y, z)))
    side = 1 << 2 * PLACE
    u, v = (F.least(F.floor((w / F.col("most") + 1) * (side // 2)), F.lit(side - 1)).cast("long") for w in (u, v))
    face = (F.col("axis") * 2 + (along < 0).cast("int")).cast("long")
    path = F.shiftleft(face, 4 * PLACE + 4 * BY_ID) + F.shiftleft(u, 2 * PLACE + 4 * BY_ID) + F.shiftleft(v, 4 * BY_ID) + F.pmod(F.xxhash64(key), F.lit(1 << 4 * BY_ID))
    # never null, so that no filter on it is planned, into which the planner would write all of the above again
    return df.withColumn("path", F.coalesce(path, F.lit(0).cast("long"))).drop("axis", "most")


def _at(step: int) -> Column:
    """The cell of a path at a step: that number and the leading bits of the face, of both places on it and of the id."""
    lead = lambda bits, n: (1 << bits) - (1 << bits - max(0, min(n, bits)))
    own = lead(2 * PLACE, 2 * (step - 1))
    mask = ((7 if step else 0) << 4 * PLACE | own << 2 * PLACE | own) << 4 * BY_ID | lead(4 * BY_ID, 4 * (step - 1 - PLACE))
    return F.col("path").bitwiseAND(F.lit(mask).cast("long")) + F.lit(step << 3 + 4 * PLACE + 4 * BY_ID).cast("long")


def _cut(p: DataFrame, t: DataFrame) -> list[DataFrame]:
    """Cells of each step of the tree that are cut; the counts of a few steps come from one job."""
    rows = p.select("path", F.lit(1).alias("n1"), F.lit(0).alias("n2")).unionByName(t.select("path", F.lit(0).alias("n1"), F.lit(1).alias("n2")))
    found: list[DataFrame] = []
    while len(found) < STEPS:
        low = len(found)
        high = min(STEPS - 1, low + (1 if low else 3))
        within = rows.join(found[-1], _at(low - 1) == F.col("cut"), "left_semi") if found else rows
        counts = within.withColumn("path", _at(high) - F.lit(high << 3 + 4 * PLACE + 4 * BY_ID).cast("long")).groupBy("path").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
        each = counts.select("n1", "n2", F.explode(F.array(*(F.struct(F.lit(i).alias("step"), _at(i).alias("cut")) for i in range(low, high + 1)))).alias("c"))
        cells = _held(each.groupBy("c.step", "c.cut").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).filter((F.col("n1") > PROBES) | (F.col("n2") > TARGETS)).select("step", "cut"))
        sizes = dict(cells.groupBy("step").count().collect())
        found += [_few(cells.filter(F.col("step") == i).select("cut"), sizes[i]) for i in range(low, high + 1) if i in sizes]
        if high not in sizes:
            break
    return found


def _held(df: DataFrame) -> DataFrame:
    """Rows that several jobs read: in spark.checkpoint.dir, which executors share, or cached where there is none."""
    context, found = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if found and not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


def _in_cells(df: DataFrame, cut: list[DataFrame]) -> DataFrame:
    """Rows with the step and the number of their cell: the first on their path that is not cut."""
    df = df.withColumns({"step": F.lit(0), "cell": _at(0)})
    for i, cells in enumerate(cut):
        inside = F.col("cut").isNotNull()
        df = df.join(cells, _at(i) == F.col("cut"), "left").withColumns({"step": F.when(inside, i + 1).otherwise(F.col("step")), "cell": F.when(inside, _at(i + 1)).otherwise(F.col("cell"))}).drop("cut")
    return df


def _box(*more: Column):
    return [f(c).alias(f"{c}{i}") for c in "xyz" for i, f in ((1, F.min), (2, F.max))] + list(more)


def _tree(t: DataFrame, steps: int) -> DataFrame:
    """Cells with targets, their number and box, and the cell above; a cell that is not cut lies below itself once more."""
    own = F.struct(F.col("step"), F.col("cell").alias("above"), F.col("cell"))
    ways = [F.when(F.col("step") >= i, F.struct(F.lit(i).alias("step"), _at(i - 1).alias("above"), _at(i).alias("cell"))) for i in range(1, steps + 1)]
    each = t.select("x", "y", "z", F.explode(F.array_compact(F.array(own, *ways))).alias("c"))
    return _held(each.groupBy("c.step", "c.above", "c.cell").agg(*_box(F.count(F.lit(1)).alias("n"))))


def _kept(p: DataFrame, tree: DataFrame, steps: int, radius: float, k: int) -> DataFrame:
    """group (a cell of probes), cell, n, reach (degrees): cells of targets that may hold one of the k nearest of a probe."""
    # chords; a separation's error by rounding grows without bound towards 180 degrees
    margin = 1e-11 if radius <= 120 else 1e-7
    widest = 2 * math.sin(math.radians(min(max(radius, 0.0), 180.0)) / 2)
    groups = p.groupBy(F.col("cell").alias("group")).agg(*_box())
    near = groups.withColumnsRenamed({f"{c}{i}": f"_{c}{i}" for c in "xyz" for i in (1, 2)}).withColumn("at", F.lit(0).cast("long"))
    box = [c for c in near.columns if c.startswith("_")]
    sizes = {(r["step"], r["own"]): r["count"] for r in tree.groupBy("step", (F.col("cell") == F.col("above")).alias("own")).count().collect()}
    low, high = F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        apart = F.greatest(F.lit(0.0), F.col(f"{c}1") - F.col(f"_{c}2"), F.col(f"_{c}1") - F.col(f"{c}2"))
        across = F.greatest(F.col(f"{c}2") - F.col(f"_{c}1"), F.col(f"_{c}2") - F.col(f"{c}1"))
        low, high = low + apart * apart, high + across * across
    for i in range(1, max(steps, 1) + 1):
        own = F.col("cell") == F.col("above")
        below = tree.filter((~own & (F.col("step") == i)) | (own & (F.col("step") < i))).drop("step")
        size = sum(n for (step, done), n in sizes.items() if (step < i if done else step == i))
        near = near.select("group", *box, "at").join(_few(below, size), F.col("at") == F.col("above")).select("group", *box, "cell", "n", F.sqrt(low).alias("low"), F.sqrt(high).alias("high"))
        near = near.filter(F.col("low") <= widest + margin)
        near = near.withColumn("sum", F.sum("n").over(Window.partitionBy("group").orderBy("high")))
        near = near.withColumn("bound", F.least(F.lit(widest), F.min(F.when(F.col("sum") >= k, F.col("high"))).over(Window.partitionBy("group"))) + margin)
        near = near.filter(F.col("low") <= F.col("bound")).select("group", *box, F.col("cell").alias("at"), "n", "bound")
    reach = F.least(F.lit(float(radius)), F.degrees(2 * F.asin(F.least(F.lit(1.0), F.col("bound") / 2))))
    return near.select("group", F.col("at").alias("cell"), "n", reach.alias("reach"))


def _in_slices(p: DataFrame, t: DataFrame, dense: DataFrame, radius: float) -> DataFrame:
    """Pairs of probes and targets by (zone, cell, slice); slice 0 alone in cells that are not dense.

    A dense cell is cut at quantiles of its targets' declination, from mergeable sketches; a cut with more than DENSE
    targets is dealt by their hashes into slices, all of which its probes visit. Broadcast are rows of dense cells and of
    their cuts: one at most for DENSE / CUTS targets."""
    dense = F.broadcast(dense.select("zone", "cell"))
    inside, outside = t.join(dense, ["zone", "cell"], "left_semi"), t.join(dense, ["zone", "cell"], "left_anti")
    spread = inside.groupBy("zone", "cell").agg(F.percentile_approx("dec2", F.array(*(F.lit(i / CUTS) for i in range(1, CUTS))), 4 * CUTS).alias("cuts"))
    spread = F.broadcast(spread)
    cut = F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col("dec2")))
    numbered = inside.join(spread, ["zone", "cell"]).withColumn("cut", cut)
    shares = numbered.groupBy("zone", "cell", "cut").agg(F.ceil(F.count(F.lit(1)) / F.lit(DENSE)).alias("shares"), F.min("dec2").alias("low"), F.max("dec2").alias("high"))
    shares = F.broadcast(shares)
    sliced = numbered.drop("cuts").join(shares.drop("low", "high"), ["zone", "cell", "cut"])
    sliced = sliced.withColumn("slice", (F.col("cut") * F.lit(1 << 32) + F.pmod(F.xxhash64("target_id", "ra2"), F.col("shares"))).cast("long")).drop("cut", "shares")
    asked = p.join(shares, ["zone", "cell"]).filter((F.col("dec1") + radius >= F.col("low")) & (F.col("dec1") - radius <= F.col("high")))
    asked = asked.withColumn("slice", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("shares").cast("long") - 1), lambda i: i + F.col("cut") * F.lit(1 << 32)))).drop("cut", "shares", "low", "high")
    plain = p.join(dense, ["zone", "cell"], "left_anti").withColumn("slice", F.lit(0).cast("long"))
    return asked.unionByName(plain).join(sliced.unionByName(outside.withColumn("slice", F.lit(0).cast("long"))), ["zone", "cell", "slice"])
