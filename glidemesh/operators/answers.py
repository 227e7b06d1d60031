"""Scoring, ranking and choice of sites for position fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glidemesh.functions import geo
from glidemesh.operators.resolve import near_pairs
from glidemesh.operators.rings import first_around, saved

#: More sites than a list can hold.
EVERY = 2**31 - 1


def score_pairs(sites: DataFrame, fixes: DataFrame, radius_m: float = 60_000.0, margin_m: float = 250.0) -> DataFrame:
    """Every fix against the sites within a radius of it: distance, bearing, ratio, reason.

    Grid cells join the two sides, so neither side is broadcast or crossed with the other. A fix
    stands in one cell, ``g``, which goes along: windows over ``(g, fix_id)`` need no more shuffle.
    """
    p = near_pairs(
        fixes.select("fix_id", "lat", "lon", "alt_m"), sites.select("src_seq", "lat", "lon", "kind", "difficulty", "elev_m"), radius_m, spread="right"
    )
    at = [F.col(c) for c in ("x.lat", "x.lon", "y.lat", "y.lon")]
    return p.select(
        "g",
        F.col("x.fix_id").alias("fix_id"),
        F.col("y.src_seq").alias("src_seq"),
        F.col("y.kind").alias("kind"),
        F.col("y.difficulty").alias("difficulty"),
        F.col("d").alias("distance_m"),
        geo.bearing_deg(*at).alias("bearing"),
        geo.glide_ratio(F.col("d"), F.col("x.alt_m"), F.col("y.elev_m"), margin_m).alias("ratio"),
        geo.usable_height(F.col("x.alt_m"), F.col("y.elev_m"), margin_m).alias("usable_m"),
        geo.glide_reason(F.col("x.alt_m"), F.col("y.elev_m"), margin_m).alias("reason"),
    )


def filter_difficulty(df: DataFrame, show_c: bool, show_d: bool) -> DataFrame:
    """Hide C or D on request; unrated sites show only where both show."""
    shown = ["A", "B"] + ["C"] * show_c + ["D"] * show_d
    known = F.col("difficulty").isin("A", "B", "C", "D")
    return df.where(F.col("difficulty").isin(shown) | (~known & F.lit(show_c and show_d)))


def _each_fix(df: DataFrame):
    """Windows of a fix, by its cell too where it is known, as the pairs are dealt by cells."""
    return Window.partitionBy(*(["g", "fix_id"] if "g" in df.columns else ["fix_id"]))


def rank_answers(df: DataFrame, ties: tuple[str, ...] = ("distance_m", "src_seq")) -> DataFrame:
    """Least ratio first, rows without one last, then by distance."""
    by = _each_fix(df).orderBy(F.asc_nulls_last("ratio"), *ties)
    return df.withColumn("rank", F.row_number().over(by).cast("long"))


def _metres(y) -> Column:
    return geo.haversine_m(F.col("p.lat"), F.col("p.lon"), y.lat, y.lon)


def _ranked_lists(sites: DataFrame, points: DataFrame, k: int, radius_m: float, margin_m: float, ties: tuple[str, ...] = ("distance_m", "src_seq")) -> DataFrame:
    """``(p, near)``: each point with its first ``k`` sites in order.

    Lists come in order by distance and ``src_seq``; those that hold sites too close to be told apart there,
    or have other ties, are put in order here. What is asked of a site is worked out where lists are taken apart.
    """
    in_order = ties == ("distance_m", "src_seq")
    lists = first_around(sites, points, k, radius_m, margin_m, ordered=in_order)
    ratio = lambda x: geo.glide_ratio(x.distance_m, F.col("p.alt_m"), x.y.elev_m, margin_m)
    part = {"distance_m": lambda x: x.distance_m, "src_seq": lambda x: x.y.src_seq}

    def told(near: Column) -> Column:
        measured = F.transform(near, lambda y: F.struct(_metres(y).alias("distance_m"), y.alias("y")))
        inside = F.filter(measured, lambda x: x.distance_m <= radius_m)
        rated = F.transform(inside, lambda x: F.struct(x.distance_m.alias("distance_m"), ratio(x).alias("ratio"), x.y.alias("y")))
        # arrays sort null parts first
        keyed = F.transform(rated, lambda x: F.struct(x.ratio.isNull().alias("none"), x.ratio.alias("ratio"), *[part[c](x).alias(f"t{i}") for i, c in enumerate(ties)], x.y.alias("y")))
        return F.transform(F.sort_array(keyed), lambda x: x.y)

    if not in_order:
        return lists.select("p", F.slice(told(F.col("near")), 1, k).alias("near"))
    stretch = lambda x: F.slice("near", x.begin + 1, x.size)
    every = F.flatten(F.transform("parts", lambda x: F.when(x.untold, told(stretch(x))).otherwise(stretch(x))))
    return lists.select("p", F.when(F.size("parts") > 0, F.slice(every, 1, k)).otherwise(F.col("near")).alias("near"))


def _places(fixes: DataFrame) -> DataFrame:
    """Fixes at one place and height as one, with its least ``fix_id`` and the ids of all of them."""
    known = fixes.where("lat is not null and lon is not null")
    return known.groupBy("lat", "lon", "alt_m").agg(F.min("fix_id").alias("fix_id"), F.collect_list("fix_id").alias("same"))


def _to_digits(x: Column, digits: int) -> Column:
    """``round(x, digits)``, by way of decimal numbers only where halves are near or numbers large."""
    up = x * 10**digits + 0.5
    plain = (up < 1e9) & (up > -1e9) & (F.abs(up - F.rint(up)) > 1e-6)
    return F.when(plain, F.floor(up) / 10.0**digits).otherwise(F.round(x, digits))


def all_answers(sites: DataFrame, fixes: DataFrame, radius_m: float = 60_000.0, margin_m: float = 250.0, digits: int | None = None) -> DataFrame:
    """``(fix_id, src_seq, rank, ratio)``: ``rank_answers(score_pairs(sites, fixes))``, every rank; ratios
    rounded to so many ``digits`` once a list.

    Rows are as many as pairs, but none is shuffled, spilled or sorted in a window: a fix's sites are
    ordered as a list in its row, and fixes at one place and height share a list.
    """
    lists = _ranked_lists(sites.select("src_seq", "lat", "lon", "elev_m"), _places(fixes), EVERY, radius_m, margin_m)
    each = lists.select("p", F.posexplode("near").alias("place", "y"))
    ratio = geo.glide_ratio(_metres(F.col("y")), F.col("p.alt_m"), F.col("y.elev_m"), margin_m)
    flat = each.select(F.col("p.same").alias("same"), F.col("y.src_seq").alias("src_seq"), (F.col("place") + 1).cast("long").alias("rank"), ratio.alias("ratio"))
    if digits is not None:
        flat = flat.withColumn("ratio", _to_digits(F.col("ratio"), digits))
    return flat.select(F.explode("same").alias("fix_id"), "src_seq", "rank", "ratio")


def count_answers(sites: DataFrame, fixes: DataFrame, radius_m: float = 60_000.0, margin_m: float = 250.0) -> DataFrame:
    """``(fix_id, reason, n, best)`` of ``score_pairs``: how many sites of each reason, and the least ratio.

    Fixes at one place and height are counted as one, sites at one place and height as one with a
    number, so copies on either side add no pairs.
    """
    spots = sites.groupBy("lat", "lon", "elev_m").agg(F.count("*").alias("n"))
    places = _places(fixes)
    p = near_pairs(places.drop("same"), spots, radius_m, spread="right").select(
        F.col("x.fix_id").alias("fix_id"),
        F.col("y.n").alias("n"),
        geo.glide_reason(F.col("x.alt_m"), F.col("y.elev_m"), margin_m).alias("reason"),
        geo.glide_ratio(F.col("d"), F.col("x.alt_m"), F.col("y.elev_m"), margin_m).alias("ratio"),
    )
    one = p.groupBy("fix_id", "reason").agg(F.sum("n").alias("n"), F.min("ratio").alias("best"))
    return one.join(places.select("fix_id", "same"), "fix_id").select(F.explode("same").alias("fix_id"), "reason", "n", "best")


def best_answers(
    sites: DataFrame, fixes: DataFrame, k: int, radius_m: float = 60_000.0, margin_m: float = 250.0, ties: tuple[str, ...] = ("distance_m", "src_seq")
) -> DataFrame:
    """The first ``k`` rows a fix of ``rank_answers(score_pairs(sites, fixes, radius_m), ties)``, without
    scoring the pairs that cannot be among them. Without height over any site, ``ties`` begin with
    the distance, or such fixes have no first rows but by chance of the ring.

    ``rings.first_around`` leaves ``k`` sites a fix, or few more; these are scored and ordered as a list
    in the fix's own row, so pairs are neither shuffled nor sorted in a window.
    """
    at = ["src_seq", "lat", "lon", "kind", "difficulty", "elev_m"]
    best = _ranked_lists(sites.select(*at), fixes.select("fix_id", "lat", "lon", "alt_m"), k, radius_m, margin_m, ties).select("p", F.posexplode("near").alias("place", "y"))
    flat = best.select("p", "place", "y", _metres(F.col("y")).alias("distance_m"))
    return flat.select(
        F.col("p.fix_id").alias("fix_id"),
        F.col("y.src_seq").alias("src_seq"),
        F.col("y.kind").alias("kind"),
        F.col("y.difficulty").alias("difficulty"),
        "distance_m",
        geo.bearing_deg(*[F.col(c) for c in ("p.lat", "p.lon", "y.lat", "y.lon")]).alias("bearing"),
        geo.glide_ratio(F.col("distance_m"), F.col("p.alt_m"), F.col("y.elev_m"), margin_m).alias("ratio"),
        geo.usable_height(F.col("p.alt_m"), F.col("y.elev_m"), margin_m).alias("usable_m"),
        geo.glide_reason(F.col("p.alt_m"), F.col("y.elev_m"), margin_m).alias("reason"),
        (F.col("place") + 1).cast("long").alias("rank"),
    )


def top_picks(df: DataFrame, k: int = 3, max_ratio: float = 25.0) -> DataFrame:
    """Grade A within the ratio, airfields first, then the least ratio: k a fix."""
    by = _each_fix(df).orderBy((F.col("kind") != "airfield").cast("int"), "ratio", "src_seq")
    good = df.where((F.col("difficulty") == "A") & (F.col("ratio") <= max_ratio))
    return good.withColumn("pick", F.row_number().over(by).cast("long")).where(F.col("pick") <= k)


def rest_list(ranked: DataFrame, picks: DataFrame, n: int = 120) -> DataFrame:
    """What is not picked, the first n of each fix."""
    rest = ranked.join(picks.select("fix_id", "src_seq"), ["fix_id", "src_seq"], "left_anti")
    by = Window.partitionBy("fix_id").orderBy("rank")
    return rest.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= n)


def rest_answers(sites: DataFrame, fixes: DataFrame, picks: int = 3, n: int = 120, radius_m: float = 60_000.0, margin_m: float = 250.0) -> DataFrame:
    """``(fix_id, src_seq, place)`` of ``rest_list`` over ``best_picks``: the first ``n`` that are not picked.

    They are among the first ``n + picks``. The picks go along with the fix, and what is left is taken
    from its list, so lists are not joined; fixes at one place and height share one.
    """
    places = _places(fixes)
    picked = saved(best_picks(sites, places, picks, radius_m=radius_m).groupBy("fix_id").agg(F.collect_list("src_seq").alias("picked")))
    lists = _ranked_lists(sites.select("src_seq", "lat", "lon", "elev_m"), places.join(picked, "fix_id", "left"), n + picks, radius_m, margin_m)
    taken = lambda x: F.coalesce(F.array_contains("p.picked", x.src_seq), F.lit(False))
    rest = F.transform(F.slice(F.filter("near", lambda x: ~taken(x)), 1, n), lambda x: x.src_seq)
    each = lists.select(F.col("p.same").alias("same"), F.posexplode(rest).alias("place", "src_seq"))
    return each.select(F.explode("same").alias("fix_id"), "src_seq", (F.col("place") + 1).cast("long").alias("place"))


def best_picks(sites: DataFrame, fixes: DataFrame, k: int = 3, max_ratio: float = 25.0, radius_m: float = 60_000.0) -> DataFrame:
    """``top_picks`` of all pairs, from the best ``k`` airfields and the best ``k`` other sites of grade A of each fix."""
    good = sites.where("difficulty = 'A'")
    airfield = F.coalesce(F.col("kind") == "airfield", F.lit(False))
    both = [best_answers(good.where(w), fixes, k, radius_m, ties=("src_seq",)) for w in (airfield, ~airfield)]
    return top_picks(both[0].unionByName(both[1]).drop("rank"), k, max_ratio)


def drift_beyond(scored: DataFrame, far_m: float, n: int) -> DataFrame:
    """``rank_drift`` from all scored pairs to those farther than ``far_m``, in one pass over the pairs.
    The best ``n`` or more of each fix do: what is better than one of them is among them."""
    each = ["g", "fix_id"] if "g" in scored.columns else ["fix_id"]
    order = [F.asc_nulls_last("ratio"), "distance_m", "src_seq"]
    far = F.col("distance_m") > far_m
    later = F.when(far, F.row_number().over(Window.partitionBy(*each, far).orderBy(*order)))
    both = rank_answers(scored.withColumn("_later", later)).where(F.col("rank") <= n)
    return both.groupBy("fix_id").agg(F.count("*").alias("held"), F.count_if(F.col("_later") > n).alias("sank"), F.count_if(F.col("_later").isNull()).alias("gone"))


def solve_targets(ranked: DataFrame, n: int = 80, lo_m: float = 15_000, hi_m: float = 90_000) -> DataFrame:
    """Per fix the number of targets among the first n ranked, and the radius that holds them."""
    far = F.max("distance_m") * 1.5
    return ranked.where((F.col("rank") <= n) & F.col("usable_m").isNotNull()).groupBy("fix_id").agg(
        F.count("*").alias("targets"), F.round(F.least(F.greatest(far, F.lit(float(lo_m))), F.lit(float(hi_m)))).cast("long").alias("radius_m")
    )


def targets_around(sites: DataFrame, fixes: DataFrame, n: int = 80, radius_m: float = 60_000.0, margin_m: float = 250.0) -> DataFrame:
    """``solve_targets`` of the first ``n`` ranked, which are taken from a list that fixes at one place and height share."""
    lists = _ranked_lists(sites.select("src_seq", "lat", "lon", "elev_m"), _places(fixes), n, radius_m, margin_m)
    each = lists.select("p", F.posexplode("near").alias("place", "y"))
    usable = geo.usable_height(F.col("p.alt_m"), F.col("y.elev_m"), margin_m)
    flat = each.select(F.col("p.same").alias("same"), (F.col("place") + 1).alias("rank"), _metres(F.col("y")).alias("distance_m"), usable.alias("usable_m"))
    return solve_targets(flat.select(F.explode("same").alias("fix_id"), "rank", "distance_m", "usable_m"), n)


def rank_drift(before: DataFrame, after: DataFrame, n: int) -> DataFrame:
    """Of each fix's first n before: how many fell below n after, or are gone."""
    a = before.where(F.col("rank") <= n).select("fix_id", "src_seq")
    b = after.select("fix_id", "src_seq", F.col("rank").alias("later"))
    j = a.join(b, ["fix_id", "src_seq"], "left")
    return j.groupBy("fix_id").agg(
        F.count("*").alias("held"), F.count_if(F.col("later") > n).alias("sank"), F.count_if(F.col("later").isNull()).alias("gone")
    )
