"""Nearest neighbours of places in the plane, exactly and without comparing all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cut import cut
from tessera.errors import ContractError
from tessera.operators.ids import ranked

#: Distinct places in one cell beyond which it is halved.
CROWD = 32


def _cell(x: str, low: float, side: Column) -> Column:
    return F.floor((F.col(x) - F.lit(low)) / side)


def nearest_distances(places: DataFrame) -> tuple[DataFrame, int]:
    """(x, y, m, distance) of every distinct place of (x, y), ``m`` of which coincide, and the number of all places.

    Places lie in square cells that are halved until few share one. A place looks
    at the three by three cells around its own: what it finds within one side is
    its nearest, else it looks again with cells of twice the side, which ends when
    one cell is as wide as everything. Places that coincide are at distance 0 and
    only ever stand as one row.
    """
    own = cut(places.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy("x", "y").agg(F.count("*").alias("m")).withColumn("id", F.monotonically_increasing_id()), "places")
    box = own.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.sum("m"), F.count("*"), F.count_if(F.isnan("x") | F.isnan("y") | F.col("x").isNull() | F.col("y").isNull() | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf")))).first()
    x0, x1, y0, y1, n, distinct, bad = box
    if bad:
        raise ContractError([f"{bad} places have no finite coordinates"])
    if not n or n < 2:
        raise ContractError(["a nearest neighbour needs at least two places"])
    wide = max(x1 - x0, y1 - y0)
    if wide == 0:
        return own.select("x", "y", "m", F.lit(0.0).alias("distance")), n
    unit = wide / max(1.0, distinct**0.5)
    side = lambda level: F.lit(unit) * F.pow(F.lit(2.0), -level)
    cells = lambda level: [_cell("x", x0, side(level)).alias("cx"), _cell("y", y0, side(level)).alias("cy")]
    open_, settled, level = own.select("id", "x", "y"), [], 0
    while True:
        here = cut(open_.select("*", *cells(F.lit(level))), "cells")
        full = here.groupBy("cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("cx", "cy")
        settled.append(here.join(full, ["cx", "cy"], "left_anti").select("id", "x", "y", F.lit(level).alias("level")))
        open_ = cut(here.join(full, ["cx", "cy"], "left_semi").select("id", "x", "y"), "crowded")
        if open_.isEmpty() or level == 60:
            settled.append(open_.withColumn("level", F.lit(level)))
            break
        level += 1
    seeking, found = cut(reduce(DataFrame.unionByName, settled), "seeking"), []
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    while not seeking.isEmpty():
        levels = [r[0] for r in seeking.select("level").distinct().collect()]  # halvings, at most some 60 besides as many doublings
        targets = own.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(F.array(*map(F.lit, levels))).alias("level"))
        targets = targets.select("other", "ox", "oy", "level", _cell("ox", x0, side(F.col("level"))).alias("cx"), _cell("oy", y0, side(F.col("level"))).alias("cy"))
        looks = seeking.select("*", *cells(F.col("level"))).select("id", "x", "y", "level", "cx", "cy", steps.alias("d")).select("id", "x", "y", "level", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
        far = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
        best = looks.join(targets, ["level", "cx", "cy"]).where("id <> other").groupBy("id").agg(F.min(far).alias("distance"))
        seen = cut(seeking.join(best, "id", "left"), "nearest")
        safe = F.coalesce(F.col("distance") <= side(F.col("level")), F.lit(False)) | ((side(F.col("level")) >= 2 * wide) & F.col("distance").isNotNull())
        found.append(seen.where(safe).select("id", "distance"))
        seeking = cut(seen.where(~safe).select("id", "x", "y", (F.col("level") - 1).alias("level")), "seeking")
    all_ = own.join(reduce(DataFrame.unionByName, found), "id")
    return all_.select("x", "y", "m", F.when(F.col("m") > 1, 0.0).otherwise(F.col("distance")).alias("distance")), n


def nearest_neighbour_ratio(places: DataFrame, spread: float = 1.0) -> DataFrame:
    """One row (n, median, ratio): the median distance to the nearest other place, and that over ``spread * sqrt(1 / n)``.

    The median is exact: distances are ranked, and of an even number the two in
    the middle are averaged. Fewer than two places, places that are not finite and
    a ``spread`` that is not above 0 are errors.
    """
    if not 0 < spread < float("inf"):
        raise ContractError([f"spread is {spread}, and must be a finite number above 0"])
    rows, n = nearest_distances(places)
    rows = cut(rows, "distances")
    zero = rows.where("m > 1").agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    middle = [k - zero + 1 for k in ((n - 1) // 2, n // 2)]
    if max(middle) < 1:
        value = 0.0
    else:
        order = ranked(rows.where("m = 1").select("distance", "x", "y"), ["distance", "x", "y"])
        at = {r["rank"]: r["distance"] for r in order.where(F.col("rank").isin(middle)).select("rank", "distance").collect()}
        value = sum(at.get(k, 0.0) for k in middle) / 2
    ideal = spread * (1.0 / n) ** 0.5
    return places.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(value).alias("median"), F.lit(value / ideal).alias("ratio"))
