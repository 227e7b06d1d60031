"""Regional packs: membership, manifests, snapshots, documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _strips(edges: DataFrame, cell: float, slack: float) -> DataFrame:
    """Edges once for every row of cells that they touch, with the columns they touch there."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    row = lambda y: F.floor(y / cell).cast("long")
    e = edges.withColumn("row", F.explode(F.sequence(row(lo - slack), row(hi + slack))))
    # where the edge enters and leaves the row; a level one is in it as a whole
    y0, y9 = F.greatest(lo, F.col("row") * cell), F.least(hi, (F.col("row") + 1) * cell)
    x = lambda y: F.when(F.col("y1") == F.col("y2"), None).otherwise(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")))
    ends = [F.coalesce(x(y0), F.col("x1")), F.coalesce(x(y9), F.col("x2"))]
    col = lambda v: F.floor(v / cell).cast("long")
    return e.withColumns({"c0": col(F.least(*ends) - slack), "c1": col(F.greatest(*ends) + slack)})


def cell_cover(edges: DataFrame, cell: float = 0.25, slack: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """``(fence, row, col, border)`` of the cells in or on rings ``edges(fence, y1, x1, y2, x2)``, and
    the edges by the rows they touch.

    A cell that an edge touches is a border cell. Any other is inside or outside as a whole, as its
    middle is: along the middle of a row, the crossings of a ring pair up to what lies inside.
    """
    strips = _strips(edges, cell, slack)
    border = strips.select("fence", "row", F.explode(F.sequence("c0", "c1")).alias("col")).distinct()
    middle = (F.col("row") + 0.5) * cell
    cuts = strips.where((F.col("y1") > middle) != (F.col("y2") > middle))
    at = (F.col("x2") - F.col("x1")) * (middle - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    lists = cuts.groupBy("fence", "row").agg(F.sort_array(F.collect_list(at)).alias("x"))
    pairs = F.explode(F.expr("transform(sequence(0, size(x) div 2 - 1), i -> struct(x[2 * i] as a, x[2 * i + 1] as b))"))
    col = lambda v: F.floor(F.col(v) / cell).cast("long")
    whole = lists.where("size(x) > 1").select("fence", "row", pairs.alias("p")).select("fence", "row", F.explode(F.sequence(col("p.a"), col("p.b"))).alias("col"))
    inside = whole.distinct().join(border, ["fence", "row", "col"], "left_anti")
    cover = border.withColumn("border", F.lit(True)).unionByName(inside.withColumn("border", F.lit(False)))
    return cover, strips.select("fence", "row", "y1", "x1", "y2", "x2")


def in_fences(sites: DataFrame, edges: DataFrame, cell: float = 0.25) -> DataFrame:
    """``(src_seq, lon, fence)``: the rings that each site lies in, by ray casting with half-open edges.

    Sites meet the cells that cover the rings by cell; only those in border cells meet edges, those
    of their row. Rings do not reach over 180 degrees. Sites without a position are in none.
    """
    cover, strips = cell_cover(edges, cell)
    at = sites.select("src_seq", "lat", "lon", F.floor(F.col("lat") / cell).cast("long").alias("row"), F.floor(F.col("lon") / cell).cast("long").alias("col"))
    met = at.join(cover, ["row", "col"])
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (
        F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    )
    near = met.where("border").join(strips, ["fence", "row"]).where(crosses)
    odd = near.groupBy("src_seq", "lon", "fence").count().where("count % 2 = 1")
    return met.where("not border").select("src_seq", "lon", "fence").unionByName(odd.drop("count"))


def assign_packs(sites: DataFrame, packs: DataFrame, edges: DataFrame, most: int = 100_000, cell: float = 0.25) -> DataFrame:
    """``(src_seq, pack_id, pack_rank)``: by country, or by the ring that a pack is fenced with.

    Where ``packs`` has ``min_lon`` and ``max_lon``, a fenced pack holds only the sites between them,
    both included, so two packs may share a ring and overlap in a band; null is no bound. A pack with
    both selectors holds a site that meets both once. Packs and edges are what a job is set up with;
    more than ``most`` of them are refused.
    """
    n = packs.count() + edges.count()
    if n > most:
        raise ValueError(f"{n} packs and edges are more than {most}")
    by_country = sites.join(packs.where("country is not null"), "country").select("src_seq", "pack_id", "pack_rank")
    bound = lambda c: (F.col(c) if c in packs.columns else F.lit(None)).cast("double").alias(c)
    fenced = packs.where("fence is not null").select("pack_id", "pack_rank", "fence", bound("min_lon"), bound("max_lon"))
    hits = in_fences(sites, edges, cell).join(fenced, "fence")
    hits = hits.where(F.coalesce(F.col("lon") >= F.col("min_lon"), F.lit(True)) & F.coalesce(F.col("lon") <= F.col("max_lon"), F.lit(True)))
    return by_country.unionByName(hits.select("src_seq", "pack_id", "pack_rank")).distinct()


def first_pack(members: DataFrame) -> DataFrame:
    """A site in several packs belongs to the first published one."""
    return members.groupBy("src_seq").agg(F.min_by("pack_id", "pack_rank").alias("pack_id"))


def pack_manifest(members: DataFrame, media: DataFrame) -> DataFrame:
    """Per pack: sites, media items, distinct files and their bytes, each file once."""
    m = members.join(media, F.col("site") == F.col("src_seq"), "left")
    files = m.where("url is not null").groupBy("pack_id", "url").agg(F.max("bytes").alias("bytes"), F.count("*").alias("items"))
    totals = files.groupBy("pack_id").agg(F.sum("items").alias("media_items"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    sites = members.groupBy("pack_id").agg(F.countDistinct("src_seq").alias("sites"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sites.join(totals, "pack_id", "left").select("pack_id", "sites", zero("media_items"), zero("files"), zero("bytes"))


def selection_bytes(members: DataFrame, media: DataFrame, packs: list[str]) -> DataFrame:
    """Bytes of the files of a choice of packs, shared files once."""
    m = members.where(F.col("pack_id").isin(packs)).select("src_seq").distinct().join(media, F.col("site") == F.col("src_seq"))
    return m.groupBy("url").agg(F.max("bytes").alias("bytes")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def merge_media(media: DataFrame) -> DataFrame:
    """First of each URL per site, in order."""
    one = media.groupBy("site", "url").agg(F.min("pos").alias("pos"))
    return one.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("pos", "url"))).alias("l")).select(
        "site", F.transform("l", lambda x: x.url).alias("urls")
    )


def select_documents(editions: DataFrame, lang: str) -> DataFrame:
    """One edition per (code, slot): the preferred language, else the first of the others."""
    by = Window.partitionBy("code", "slot").orderBy((F.col("lang") != lang).cast("int"), "seq")
    return editions.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def ordered_documents(editions: DataFrame, lang: str, types: list[str]) -> DataFrame:
    """``(code, documents)``: for each code one edition's ``seq`` a slot, in reading order.

    ``editions`` are ``(seq, code, type, suffix, lang)``; a slot is a type and a suffix. Types that are
    not listed go; cases do not matter. The first edition in the preferred language stands for its
    slot, else the first of all. Slots come in the order of ``types``, then by the numbers in their
    suffix (none: 0), compared as numbers one by one, then as they first came. A list holds one code's slots.
    """
    kind = F.upper("type")
    e = editions.where(kind.isin([t.upper() for t in types])).withColumns({"type": kind, "_wanted": F.lower("lang") == lang.lower()})
    slots = e.groupBy("code", "type", "suffix").agg(F.min("seq").alias("first"), F.coalesce(F.min(F.when(F.col("_wanted"), F.col("seq"))), F.min("seq")).alias("seq"))
    numbers = F.transform(F.regexp_extract_all("suffix", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    place = F.when(F.size(numbers) > 0, numbers).otherwise(F.array(F.lit(0).cast("long")))
    rank = F.array_position(F.array(*[F.lit(t.upper()) for t in types]), F.col("type"))
    each = slots.groupBy("code").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), place.alias("place"), "first", "seq"))).alias("l"))
    return each.select("code", F.transform("l", lambda x: x.seq).alias("documents"))


def sync_files(wanted: DataFrame, held: DataFrame, drift: bool) -> DataFrame:
    """``(path, action)`` for files ``(path, bytes)``: ``fetch`` what is not held and, after a drift of
    versions, what is held with another size than wanted; ``keep`` the rest, ``evict`` what is not wanted.
    Sizes that are unknown or zero on either side are no reason to fetch."""
    w, h = wanted.select("path", F.col("bytes").alias("w"), F.lit(True).alias("want")), held.select("path", F.col("bytes").alias("h"), F.lit(True).alias("have"))
    other = F.coalesce((F.col("w") > 0) & (F.col("h") > 0) & (F.col("w") != F.col("h")), F.lit(False)) & F.lit(drift)
    action = F.when(F.col("want").isNull(), "evict").when(F.col("have").isNull() | other, "fetch").otherwise("keep")
    return w.join(h, "path", "full").select("path", action.alias("action"))


def prefer_source(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """The primary's rows, and the secondary's for keys that it lacks; where each came from."""
    rest = secondary.join(primary.select(key).distinct(), key, "left_anti")
    return primary.withColumn("origin", F.lit("primary")).unionByName(rest.withColumn("origin", F.lit("secondary")))


def pick_effective(cycles: DataFrame, by: str, day: str, today: str) -> DataFrame:
    """The latest date not after today, else the earliest to come."""
    t = F.lit(today).cast("date")
    d = F.col(day)
    return cycles.groupBy(by).agg(F.coalesce(F.max(F.when(d <= t, d)), F.min(F.when(d > t, d))).alias("effective"))


def diff_snapshots(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``(path, status)`` of all objects: new, changed, unchanged or stale."""
    l, r = local.select("path", F.col("hash").alias("l")), remote.select("path", F.col("hash").alias("r"))
    status = F.when(F.col("r").isNull(), "new").when(F.col("l").isNull(), "stale").when(F.col("l") == F.col("r"), "unchanged").otherwise("changed")
    return l.join(r, "path", "full").select("path", status.alias("status"))


def fingerprint(df: DataFrame, by: str) -> DataFrame:
    """SHA-256 of a group's sorted ``path:hash`` lines.

    Groups are dealt to tasks and sorted there; a digest is carried on line by line, so a task holds
    one line of a group at a time, however many there are.
    """
    key = df.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        out: list[tuple] = []
        done = lambda: pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], kind), pa.array([d for _, d in out], pa.string())], names=[by, "digest"])
        for batch in batches:
            kind = batch.schema.field(by).type
            for group, line in zip(batch[by].to_pylist(), batch["_line"].to_pylist()):
                if sha is not None and group == now:
                    sha.update(b"\n")
                else:
                    if sha is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = group, hashlib.sha256()
                sha.update(line.encode())
            if out:
                yield done()
                out = []
        if sha is not None:
            out.append((now, sha.hexdigest()))
            yield done()

    line = F.concat_ws(":", F.col("path").cast("string"), F.substring("hash", 1, 12))
    dealt = df.select(by, line.alias("_line")).repartition(by).sortWithinPartitions(by, "_line")
    return dealt.mapInArrow(run, f"`{by}` {key}, digest string")


def coverage_status(expected: DataFrame, held: DataFrame, by: str) -> DataFrame:
    """ready, incomplete or not downloaded, from the share of expected objects that are held."""
    j = expected.join(held.select("path").distinct().withColumn("here", F.lit(1)), "path", "left")
    n = j.groupBy(by).agg(F.count("*").alias("expected"), F.count("here").alias("held"))
    status = F.when(F.col("held") == F.col("expected"), "ready").when(F.col("held") > 0, "incomplete").otherwise("not-downloaded")
    return n.withColumn("status", status)


def longest_runway(runways: DataFrame) -> DataFrame:
    """The longest runway of each airport; the first of equals."""
    return runways.groupBy("airport").agg(F.max_by(F.struct("length_m", "heading"), F.struct("length_m", -F.col("src_seq"))).alias("r")).select("airport", "r.*")


def type_mix(df: DataFrame, top: int = 8) -> DataFrame:
    """The commonest types of each country."""
    n = df.groupBy("country", "type").agg(F.count("*").alias("n"))
    by = Window.partitionBy("country").orderBy(F.desc("n"), "type")
    return n.withColumn("place", F.row_number().over(by).cast("long")).where(F.col("place") <= top)


def drop_major(df: DataFrame, deny: list[str], keep: list[str], min_len: float = 2000.0) -> DataFrame:
    """Airfields too large to land at unasked go: listed ones, and long ones not excepted."""
    code = F.coalesce("code", F.lit(""))
    major = (F.col("kind") == "airfield") & (code.isin(deny) | (~code.isin(keep) & (F.coalesce("length_m", F.lit(0.0)) >= min_len)))
    return df.where(~major)


def check_sites(df: DataFrame) -> DataFrame:
    """Violations ``(rule, severity, n)`` of the expectations on a table of sites."""
    rules = [
        ("name-missing", "error", F.coalesce(F.trim("name"), F.lit("")) == ""),
        ("coordinates", "error", ~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)) | F.col("lat").isNull() | F.col("lon").isNull()),
        ("grade-unknown", "warning", ~F.col("difficulty").isin("A", "B", "C", "D")),
        ("heading-missing", "warning", F.col("heading_deg").isNull()),
    ]
    row = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), c.alias("bad")) for r, s, c in rules]))
    out = df.select(row.alias("v")).where("v.bad").groupBy("v.rule", "v.severity").agg(F.count("*").alias("n"))
    dup = df.groupBy("site_id").count().where("count > 1").agg(F.count("*").alias("n")).where("n > 0")
    return out.unionByName(dup.select(F.lit("id-repeated").alias("rule"), F.lit("error").alias("severity"), "n"))
