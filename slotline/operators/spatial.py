"""Nearest-neighbour graph of sites and the context it gives to slot rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotline import fixed
from slotline.functions import columns as X
from slotline.operators.asof import asof_join
from slotline.session import stage

GRID_LEVELS = 24  # of the first pass
RINGS = 8  # radii that are tried for each place
DEEPEST = 60  # cell numbers fit in 64 bits; no two doubles share a cell that deep unless they are next to each other


def canonical_sites(
    df: DataFrame, key: str = "system_code", lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """One coordinate per site: the mean of what its rows report."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.avg(X.nan_to_null(lat)).alias(lat), F.avg(X.nan_to_null(lon)).alias(lon))
        .where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    )


def knn_graph(
    sites: DataFrame,
    k: int = fixed.NEIGHBOURS,
    key: str = "system_code",
    lat: str = "latitude",
    lon: str = "longitude",
    neighbour: str = "neighbor_code",
    floor: float = fixed.ERROR_FLOOR,
    crowd: int = 64,
) -> DataFrame:
    """Exact k nearest sites by Euclidean distance with normalised inverse-distance weights.

    Sites are laid on nested grids (level ``l`` splits the extent into ``2**l`` cells per side). Each place
    picks its finest level whose 3x3 block holds at least k + 1 sites; then its k nearest lie within
    2*sqrt(2) cells, so a 7x7 block of that level contains all of them. Counts by radius in the 3x3 block tell how far to look, so that of the 7x7 block
    only the cells within that radius are asked and only what lies within it is ranked. The candidates come from an equi join on (level, cell). Because the next finer
    block held fewer than k + 1 sites, a candidate meets only a bounded number of sources: the work is linear in the number of sites. A block that holds more than ``crowd`` sites at the finest level of the first pass is
    cut further, so that a spot of a millimetre in a country costs no more than the country. Sites sharing a coordinate
    are one place in the search, of which only the first k + 1 keys can ever be among the nearest
    (ties go to the smaller key), so a pile of co-located sites stays linear too.
    """
    at = stage(sites.select(key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon")), "sites")
    place = Window.partitionBy("_lat", "_lon").orderBy(key)
    places = stage(
        at.withColumn("_rank", F.row_number().over(place))
        .where(F.col("_rank") <= k + 1)
        .groupBy("_lat", "_lon")
        .agg(F.array_sort(F.collect_list(key)).alias("_keys")),
        "places",
    )
    frame = places.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_lat").alias("lat0"),
        F.min("_lon").alias("lon0"),
        F.greatest(F.max("_lat") - F.min("_lat"), F.max("_lon") - F.min("_lon"), F.lit(1e-12)).alias("side"),
    ).first()
    # Cells of the last of these levels are smaller than an even spread would need; fuller spots are cut further below.
    levels = min(GRID_LEVELS, 5 + math.ceil(math.log2(math.sqrt(max(frame["n"] or 1, 1)) + 1)))

    def cells(df: DataFrame, reach: int = 0) -> DataFrame:
        """Cell of each row at its ``_level``, or the block of cells around it."""
        step = f"({frame['side'] or 1.0!r}D / power(2D, _level))"
        x = f"CAST(floor((_lat - ({frame['lat0'] or 0.0!r}D)) / {step}) AS BIGINT)"
        y = f"CAST(floor((_lon - ({frame['lon0'] or 0.0!r}D)) / {step}) AS BIGINT)"
        if not reach:
            return df.withColumns({"_x": F.expr(x), "_y": F.expr(y)})
        shifts = f"explode(sequence({-reach}, {reach}))"
        return (
            df.withColumn("_dx", F.expr(shifts))
            .withColumn("_dy", F.expr(shifts))
            .withColumns({"_x": F.expr(f"{x} + _dx"), "_y": F.expr(f"{y} + _dy")})
            .drop("_dx", "_dy")
        )

    def choose(among: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
        """Cells of the places at levels ``low`` to ``high``, and per place its finest level with enough sites around and how many those are."""
        gridded = cells(among.withColumn("_level", F.explode(F.sequence(F.lit(low), F.lit(high)))))
        # Sites in the 3x3 block around every occupied cell, from one count per occupied cell.
        around = (
            gridded.groupBy("_level", "_x", "_y")
            .agg(F.sum(F.size("_keys")).alias("_in"))
            .withColumn("_dx", F.expr("explode(sequence(-1, 1))"))
            .withColumn("_dy", F.expr("explode(sequence(-1, 1))"))
            .groupBy("_level", (F.col("_x") + F.col("_dx")).alias("_x"), (F.col("_y") + F.col("_dy")).alias("_y"))
            .agg(F.sum("_in").alias("_in"))
        )
        # Level 0 is one cell over everything: the fallback when there are k or fewer other sites.
        picked = (
            gridded.join(around, ["_level", "_x", "_y"])
            .where((F.col("_in") >= k + 1) | (F.col("_level") == 0))
            .groupBy("_lat", "_lon")
            .agg(F.max(F.struct("_level", "_in")).alias("_p"))
            .select("_lat", "_lon", "_p._level", "_p._in")
        )
        return gridded, picked

    gridded, picked = choose(places, 0, levels)
    picked = stage(picked, "picked")
    crowded = lambda rows, level: rows.where((F.col("_level") == level) & (F.col("_in") > crowd))
    # Spots that are too full at the last level are cut further, they and what lies around them only, until no spot is.
    while levels < DEEPEST and not crowded(picked, levels).isEmpty():
        deep = stage(crowded(picked, levels).select("_lat", "_lon"), "deep")
        blocks = cells(deep.withColumn("_level", F.lit(levels)), reach=3).select("_x", "_y").distinct()
        near = cells(places.withColumn("_level", F.lit(levels))).join(blocks, ["_x", "_y"], "left_semi").select("_lat", "_lon", "_keys")
        last, levels = levels, min(levels + 8, DEEPEST)
        finer, again = choose(stage(near, "near"), last + 1, levels)
        gridded = gridded.unionByName(finer)
        better = again.join(deep, ["_lat", "_lon"], "left_semi").select("_lat", "_lon", F.col("_level").alias("_deeper"), F.col("_in").alias("_within"))
        picked = stage(
            picked.join(better, ["_lat", "_lon"], "left").select(
                "_lat", "_lon", F.coalesce("_deeper", "_level").alias("_level"), F.when(F.col("_deeper").isNotNull(), F.col("_within")).otherwise(F.col("_in")).alias("_in")
            ),
            "picked",
        )
    chosen = picked.drop("_in")
    # A table of the levels in use, at most ``DEEPEST`` rows: what lies on other levels need not move.
    used = [r["_level"] for r in chosen.select("_level").distinct().collect()]
    gridded = gridded.where(F.col("_level").isin(used))
    side = frame["side"] or 1.0
    step = f"({side!r}D / power(2D, _level))"
    distance = F.expr("sqrt(power(_lat - _slat, 2) + power(_lon - _slon, 2))")
    # The 3x3 block has k + 1 sites, so the least of some radii that reaches as many of them reaches all of the nearest. Counts need no sort.
    radius = lambda j: F.expr(f"{step} * {2.83 * j / RINGS!r}D")
    whole_block = F.expr(f"{step} * 6 + {1e-14 * side!r}D")  # where rounding counts or there are few sites
    beside = cells(chosen, reach=1).withColumnsRenamed({"_lat": "_slat", "_lon": "_slon"})
    rings = (
        beside.join(gridded.select("_level", "_x", "_y", "_lat", "_lon", F.size("_keys").alias("_n")), ["_level", "_x", "_y"])
        .withColumn("distance", distance)
        .groupBy("_slat", "_slon", "_level")
        .agg(*[F.sum(F.when(F.col("distance") <= radius(j), F.col("_n"))).alias(f"_r{j}") for j in range(1, RINGS + 1)])
        .withColumn("_reach", F.coalesce(*[F.when(F.col(f"_r{j}") >= k + 1, radius(j)) for j in range(1, RINGS + 1)], whole_block))
        .select("_slat", "_slon", "_level", "_reach")
    )

    # Only cells that the radius touches, with room for rounding; never more than the 7x7 block.
    def touched(at: str) -> Column:
        cell = lambda place, shift: f"CAST(floor({place} / {step}) AS BIGINT) {shift}"
        low = f"greatest({cell(f'({at} - _wide)', '')}, {cell(at, '- 3')})"
        return F.expr(f"explode(sequence({low}, least({cell(f'({at} + _wide)', '')}, {cell(at, '+ 3')})))")

    around = (
        stage(rings, "reach")
        .withColumn("_wide", F.col("_reach") * 1.000000001 + 1e-15 * side)
        .withColumn("_x", touched(f"(_slat - ({frame['lat0'] or 0.0!r}D))"))
        .withColumn("_y", touched(f"(_slon - ({frame['lon0'] or 0.0!r}D))"))
        .drop("_wide")
    )
    candidates = around.join(gridded, ["_level", "_x", "_y"]).withColumn("distance", distance).where(F.col("distance") <= F.col("_reach"))
    # k + 1 nearest keys of each place; a site then drops itself and keeps k.
    near = Window.partitionBy("_slat", "_slon").orderBy("distance", neighbour)
    listed = (
        candidates.select("_slat", "_slon", "distance", F.explode("_keys").alias(neighbour))
        .withColumn("_rank", F.row_number().over(near))
        .where(F.col("_rank") <= k + 1)
    )
    own = Window.partitionBy(key).orderBy("distance", neighbour)
    whole = Window.partitionBy(key)
    inverse = 1.0 / F.greatest(F.col("distance"), F.lit(floor))
    return (
        at.join(listed, (F.col("_lat") == F.col("_slat")) & (F.col("_lon") == F.col("_slon")))
        .where(F.col(key) != F.col(neighbour))
        .withColumn("_rank", F.row_number().over(own))
        .where(F.col("_rank") <= k)
        .withColumn("_inverse", inverse)
        .select(
            key,
            neighbour,
            "distance",
            (F.col("_inverse") / F.sum("_inverse").over(whole)).alias("weight"),
        )
    )


def neighbour_means(
    slots: DataFrame,
    edges: DataFrame,
    key: str = "system_code",
    neighbour: str = "neighbor_code",
    slot: str = "time_slot",
) -> DataFrame:
    """Weighted neighbour measures per (site, slot), from neighbours seen in the same slot.

    The edge table is not hinted: it is broadcast only if its measured size allows it.
    """
    seen = slots.select(
        F.col(key).alias(neighbour), slot, "utilization", "queue_length", "parking_stress_index"
    )
    weighted = lambda c: F.coalesce(F.sum(F.col("weight") * F.col(c)), F.lit(0.0))
    return (
        seen.join(edges, neighbour)
        .groupBy(key, slot)
        .agg(
            weighted("utilization").alias("neighbor_utilization_mean"),
            weighted("queue_length").alias("neighbor_queue_mean"),
            weighted("parking_stress_index").alias("neighbor_stress_mean"),
            F.avg("distance").alias("mean_neighbor_distance"),
        )
    )


def neighbour_context(
    slots: DataFrame, edges: DataFrame, key: str = "system_code", slot: str = "time_slot"
) -> DataFrame:
    """Slot rows with same-slot neighbour context; null where no neighbour reported."""
    return slots.join(neighbour_means(slots, edges, key=key, slot=slot), [key, slot], "left")


def asof_neighbour_context(
    asked: DataFrame,
    history: DataFrame,
    edges: DataFrame,
    key: str = "system_code",
    neighbour: str = "neighbor_code",
    time: str = "time_slot",
) -> DataFrame:
    """Context from each neighbour's newest row at or before the asked time.

    Neighbours without such a row add nothing to the sums, but the distance is
    divided by all edges of the site. ``asked`` is unique on (key, time).
    """
    per_edge = asked.select(key, time).distinct().join(edges, key)
    seen = history.select(
        F.col(key).alias(neighbour), time, "utilization", "queue_length", "parking_stress_index"
    )
    matched = asof_join(
        per_edge,
        seen,
        [neighbour],
        time,
        time,
        {
            "utilization": "_use",
            "queue_length": "_queue",
            "parking_stress_index": "_stress",
            time: "_seen_at",
        },
    )
    total = lambda c: F.coalesce(F.sum(F.col("weight") * F.col(c)), F.lit(0.0))
    context = matched.groupBy(key, time).agg(
        total("_use").alias("neighbor_utilization_mean"),
        total("_queue").alias("neighbor_queue_mean"),
        total("_stress").alias("neighbor_stress_mean"),
        (
            F.coalesce(F.sum(F.when(F.col("_seen_at").isNotNull(), F.col("distance"))), F.lit(0.0))
            / F.count(F.lit(1))
        ).alias("mean_neighbor_distance"),
    )
    names = [
        "neighbor_utilization_mean",
        "neighbor_queue_mean",
        "neighbor_stress_mean",
        "mean_neighbor_distance",
    ]
    return asked.join(context, [key, time], "left").fillna(0.0, subset=names)
