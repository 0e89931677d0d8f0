"""Tags: filters, merges, statistics and removal of overlapping duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motioncat.functions.boxes import BOX, geometry, iou, named, of_struct, tag_hash
from motioncat.operators.ordered import running
from motioncat.session import BROADCAST_ROWS, materialize, small_side

FRAME = ["filename", "frame_number"]
GROUP = [*FRAME, "value"]


def filter_tag_values(tags: DataFrame, values: list[str]) -> DataFrame:
    return tags.filter(F.col("value").isin(values)) if values else tags


def tag_stats(tags: DataFrame) -> DataFrame:
    """Numbers of tags, tagged frames and tagged videos, through one row per frame and per video."""
    frames = tags.groupBy(*FRAME).agg(F.count("*").alias("n"))
    videos = frames.groupBy("filename").agg(F.sum("n").alias("n"), F.count("*").alias("f"))
    zero = F.lit(0).cast("bigint")
    return videos.agg(
        F.coalesce(F.sum("n"), zero).alias("num_tags"),
        F.coalesce(F.sum("f"), zero).alias("num_tagged_frames"),
        F.count("*").alias("num_tagged_videos"),
    )


def _merge(sides: list[DataFrame], later_wins: bool) -> DataFrame:
    columns = sides[0].columns
    rest = [c for c in columns if c not in FRAME]
    rows = None
    for i, side in enumerate(sides):
        one = side.select(
            *FRAME, F.unhex(tag_hash()).alias("hash"), F.struct(F.lit(i).alias("side"), F.col("ord").alias("ord")).alias("_rank"),
            F.struct(*[c for c in rest if c != "ord"]).alias("_row"),
        )
        rows = one if rows is None else rows.unionByName(one)
    pick = F.max_by if later_wins else F.min_by
    won = rows.groupBy(*FRAME, "hash").agg(pick(F.struct("_rank", "_row"), "_rank").alias("w"))
    place = {c: F.col(c) if c in FRAME else F.col("w._rank.ord") if c == "ord" else F.col(f"w._row.{c}") for c in columns}
    return won.select(F.lower(F.hex("hash")).alias("hash"), F.col("w._rank.side").alias("side"), *[c.alias(n) for n, c in place.items()])


def merge_tags(*sides: DataFrame) -> DataFrame:
    """Union of two sides or more by (file, frame, hash); the last side wins."""
    return _merge(list(sides), later_wins=True).drop("side")


def merge_new_tags(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by (file, frame, hash); existing tags win. ``added`` marks the new ones."""
    return _merge([existing, incoming], later_wins=False).withColumn("added", F.col("side") == 1).drop("side")


def attach_tags(existing: DataFrame, incoming: DataFrame, clips: DataFrame, mode: str = "ADD") -> DataFrame:
    """Put incoming tags on the clips of the catalog, keeping (ADD) or dropping (REPLACE) the old ones."""
    names = clips.select("filename")
    matched = incoming.join(names, "filename", "left_semi")
    if mode.upper() == "ADD":
        return merge_new_tags(existing, matched).drop("added")
    if mode.upper() == "REPLACE":
        kept = existing.join(matched.select("filename"), "filename", "left_anti")
        return merge_new_tags(kept, matched).drop("added")
    raise ValueError(f"mode must be ADD or REPLACE, not {mode!r}")


def collect_clip_tags(tags: DataFrame, clips: DataFrame) -> DataFrame:
    return tags.join(clips.select("filename"), "filename", "left_semi")


def clear_tags(tags: DataFrame, clips: DataFrame) -> DataFrame:
    return tags.join(clips.select("filename"), "filename", "left_anti")


def join_tags_clips(tags: DataFrame, clips: DataFrame) -> DataFrame:
    """Tags with the columns of their clip; join sides are sized by the optimizer at run time."""
    return tags.join(clips, "filename")


def first_seen(tags: DataFrame) -> DataFrame:
    """Add ``is_new_track``: this is the first frame of the track in the clip."""
    first = tags.groupBy("filename", "track_id").agg(F.min("frame_number").alias("_first"))
    out = tags.join(first, ["filename", "track_id"], "left")
    return out.withColumn("is_new_track", F.col("frame_number") == F.col("_first")).drop("_first")


def consecutive_frames(tags: DataFrame) -> DataFrame:
    """(frame, next tagged frame) per file; the window sees each frame of a clip once."""
    frames = tags.select(*FRAME).distinct()
    following = F.lead("frame_number").over(Window.partitionBy("filename").orderBy("frame_number"))
    return frames.select(*FRAME, following.alias("next_frame")).filter("next_frame IS NOT NULL")


def _numbered_points(tags: DataFrame) -> DataFrame:
    """(_track, frame_number, ord, pos, point): the centres of each track, numbered from 1 over range partitions."""
    g = geometry()
    point = F.struct(g["center_x"].alias("x"), g["center_y"].alias("y"))
    track = F.struct("filename", "track_id")  # structs with a null field are equal, so no file is lost in joins
    points = tags.filter("track_id IS NOT NULL").select(track.alias("_track"), "frame_number", "ord", point.alias("point"))
    return running(points, ["_track"], ["frame_number", "ord"], {"pos": F.lit(1).cast("bigint")})


def track_paths(tags: DataFrame, chunk: int = 1000) -> DataFrame:
    """The centres of each track, each stored once: ``path`` holds the points from number ``first_pos`` on.

    A track of any length is cut into rows of at most ``chunk`` points, so no task holds it whole.
    """
    points = _numbered_points(tags).withColumn("_chunk", F.floor((F.col("pos") - 1) / chunk))
    parts = points.groupBy("_track", "_chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "point"))).alias("items"))
    return parts.select("_track.*", (F.col("_chunk") * chunk + 1).alias("first_pos"), F.col("items.point").alias("path"))


def track_path_index(tags: DataFrame, keep: int = 2000) -> DataFrame:
    """For each tag of a track the numbers of the first and last point of the path drawn with it (see ``track_paths``)."""
    pos = F.col("pos")
    first = F.greatest(pos - keep + 1, F.lit(1))
    return _numbered_points(tags).select("_track.*", "frame_number", "ord", first.alias("first_pos"), pos.alias("last_pos"))


def track_history(tags: DataFrame, keep: int = 2000, chunk: int = 4096) -> DataFrame:
    """Points drawn so far and the last ``keep`` centres of each track, per frame it appears in.

    Points meet in chunks of a track; the last ``keep`` - 1 of a chunk are also sent to the next one,
    so every path is a slice of one chunk with what precedes it. The result holds up to ``keep`` points
    a row; ``track_paths`` with ``track_path_index`` says the same with every point stored once.
    """
    chunk = max(chunk, keep)
    at = F.col("pos") - 1
    home = F.floor(at / chunk)
    reaches_on = at % chunk > chunk - keep
    copies = F.when(reaches_on, F.array(home, home + 1)).otherwise(F.array(home))
    points = _numbered_points(tags).withColumn("_chunk", F.explode(copies))
    item = F.struct("pos", "frame_number", "ord", "point")
    groups = points.groupBy("_track", "_chunk").agg(F.sort_array(F.collect_list(item)).alias("items"))
    groups = groups.select("_track", "_chunk", "items", F.get("items", F.lit(0))["pos"].alias("base"), F.col("items.point").alias("line"))
    own = F.filter("items", lambda i: F.floor((i["pos"] - 1) / chunk) == F.col("_chunk"))
    rows = groups.select("_track", "base", "line", F.explode(own).alias("p"))
    length = F.least(F.col("p.pos"), F.lit(keep)).cast("int")
    start = (F.col("p.pos") - length - F.col("base")).cast("int") + 2
    return rows.select(
        "_track.*", F.col("p.frame_number").alias("frame_number"), F.col("p.ord").alias("ord"), length.alias("points"),
        F.slice("line", start, length).alias("path"),
    )


# ---- overlapping duplicates ----

def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], above: Column | float, cell: int = 256) -> DataFrame:
    """Pairs with equal ``keys`` whose boxes have IoU greater than ``above``.

    Boxes go to the grid cells they cover, and a pair is kept in the one cell that holds
    the upper left corner of its intersection. A crowded frame is thus spread over cells,
    and only overlapping boxes meet.
    """

    def cells(df: DataFrame, side: str) -> DataFrame:
        lo, hi = F.floor(F.col("x1") / cell), F.floor(F.col("x2") / cell)
        top, low = F.floor(F.col("y1") / cell), F.floor(F.col("y2") / cell)
        spread = df.filter("x2 >= x1 AND y2 >= y1").withColumn("cx", F.explode(F.sequence(lo, hi)))
        return spread.withColumn("cy", F.explode(F.sequence(top, low))).alias(side)

    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "cx", "cy"]]
    home = (F.floor(F.greatest("a.x1", "b.x1") / cell) == F.col("a.cx")) & (
        F.floor(F.greatest("a.y1", "b.y1") / cell) == F.col("a.cy")
    )
    condition = home & (iou(named("a."), named("b.")) > above)
    for s in same:
        condition = condition & s
    return cells(a, "a").join(cells(b, "b"), condition)


def with_track_length(tags: DataFrame) -> DataFrame:
    """Add ``track_len``: tags of the track over all files; a missing id counts as id 0.

    Tags without an id are spread over the join, whatever their number, and get the one length of id 0.
    A moderate number of tracks is broadcast, so that no tag moves.
    """
    lengths = small_side(tags.filter("track_id IS NOT NULL").groupBy(F.col("track_id").alias("_t")).agg(F.count("*").alias("_n")))
    none = F.lit(0).cast("bigint")
    of_zero = F.coalesce(lengths.filter("_t = 0").agg(F.max("_n")).scalar(), none)
    key = F.coalesce(F.col("track_id"), F.pmod(F.xxhash64("ord"), F.lit(1024)))
    keyed = tags.withColumns({"_k": key, "_bare": F.col("track_id").isNull()})
    out = keyed.join(lengths.withColumn("_has", F.lit(False)), (F.col("_k") == F.col("_t")) & (F.col("_bare") == F.col("_has")), "left")
    return out.withColumn("track_len", F.when(F.col("_bare"), of_zero).otherwise(F.coalesce("_n", none))).drop("_t", "_n", "_k", "_bare", "_has")


def _distinct_boxes(tags: DataFrame) -> DataFrame:
    """One row per box of a frame and value: its first ``ord`` and its best tag.

    ``_alone`` is the ``ord`` of a tag whose box overlaps nothing, not even its equal, else null.

    Equal boxes overlap fully and have the same neighbours, so they can be combined before
    anything is compared. The best tag is on the longest track, the earliest among equals.
    """
    payload = [c for c in tags.columns if c not in [*GROUP, *BOX, "_alone"]]
    return tags.groupBy(*GROUP, *BOX, "_alone").agg(
        F.min("ord").alias("first_ord"),
        F.min_by(F.struct(*payload, *BOX), F.struct(-F.col("track_len"), F.col("ord"))).alias("best"),
    )


def _better(a: Column, b: Column) -> Column:
    earlier = (a["track_len"] == b["track_len"]) & (a["ord"] < b["ord"])
    return F.when((a["track_len"] > b["track_len"]) | earlier, a).otherwise(b)


def _fold_small(boxes: DataFrame, above: float) -> DataFrame:
    """Greedy pass over the boxes of one frame and value, in insertion order, inside the JVM."""
    item = F.struct("first_ord", *BOX, "best")
    groups = boxes.groupBy(*GROUP).agg(F.sort_array(F.collect_list(item)).alias("items"))
    none_yet = F.slice("items", 1, 0)

    def step(leaders: Column, box: Column) -> Column:
        hits = F.transform(leaders, lambda ld: iou(of_struct(ld), of_struct(box)) > above)
        at = F.array_position(hits, True) - 1

        def update(ld: Column, i: Column) -> Column:
            better = F.struct(ld["first_ord"].alias("first_ord"), *[ld[c].alias(c) for c in BOX], _better(box["best"], ld["best"]).alias("best"))
            return F.when(i == at, better).otherwise(ld)

        return F.when(at >= 0, F.transform(leaders, update)).otherwise(F.array_append(leaders, box))

    kept = groups.select(*GROUP, F.explode(F.aggregate("items", none_yet, step)).alias("k"))
    return kept.select(*GROUP, F.col("k.best").alias("best"))


def _rounds_large(boxes: DataFrame, above: float) -> DataFrame:
    """The same greedy result for crowded frames, by joins.

    A box is an anchor once no undecided earlier box overlaps it; boxes overlapping an
    anchor are settled. Every round decides at least the earliest box left in a group.
    Boxes are numbered in the order of group and insertion, so that rounds move numbers only.
    """
    order = [*GROUP, "first_ord"]
    boxes = materialize(boxes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "boxes")
    plain = boxes.select("id", "first_ord", *GROUP, *BOX)
    pairs = overlap_join(plain, plain, GROUP, above).filter(F.col("a.first_ord") < F.col("b.first_ord"))
    edges = materialize(pairs.select(F.col("a.id").alias("early"), F.col("b.id").alias("late")), "overlaps")
    anchors, open_ids, open_edges = None, boxes.select("id"), edges
    while True:
        blocked = open_edges.select(F.col("late").alias("id")).distinct()
        found = materialize(open_ids.join(blocked, "id", "left_anti"), "anchors")
        anchors = found if anchors is None else anchors.unionByName(found)
        settled = open_edges.join(found.withColumnRenamed("id", "early"), "early", "left_semi").select(F.col("late").alias("id"))
        done = found.unionByName(settled)
        open_ids = materialize(open_ids.join(done, "id", "left_anti"), "open")
        if open_ids.isEmpty():
            break
        still = open_ids.select("id")
        open_edges = materialize(
            open_edges.join(still.withColumnRenamed("id", "early"), "early", "left_semi")
            .join(still.withColumnRenamed("id", "late"), "late", "left_semi"),
            "overlaps",
        )
    to_anchor = edges.join(anchors.withColumnRenamed("id", "early"), "early", "left_semi")
    absorbed = to_anchor.join(anchors.withColumnRenamed("id", "late"), "late", "left_anti").groupBy("late").agg(F.min("early").alias("anchor"))
    assigned = absorbed.select(F.col("late").alias("id"), "anchor").unionByName(anchors.select("id", F.col("id").alias("anchor")))
    best = boxes.join(assigned, "id").groupBy("anchor").agg(
        F.min_by(F.struct(*GROUP, "best"), F.struct(-F.col("best.track_len"), F.col("best.ord"))).alias("w")
    )
    return best.select("w.*")


def nms_dedup(tags: DataFrame, above: float = 0.8, crowd: int = 256, clips: DataFrame | None = None) -> DataFrame:
    """Keep one tag per set of overlapping tags of a frame and value: the one on the longest track.

    With ``clips`` only tags of these clips are returned: lengths of tracks are taken over all tags, and the others move no further.

    Without any track id the tags are returned as they are. Frames with at most ``crowd``
    distinct boxes of a value are folded in place; fuller ones are settled by joins. A box
    without area overlaps nothing, not even its equal, and stays.

    Rows are counted first, which combines before the shuffle. Frames and values with at most
    ``crowd`` rows are moved once, whole; of the others equal boxes are combined on the way, and
    their boxes are counted where that leaves it open.
    """
    wanted = (lambda rows: rows) if clips is None else (lambda rows: collect_clip_tags(rows, clips))
    if above >= 1 or tags.filter("track_id IS NOT NULL").isEmpty():
        return wanted(tags)
    flat = F.coalesce((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), F.lit(True))
    tags = tags.withColumn("_alone", F.when(flat, F.col("ord")))
    many = materialize(wanted(tags.groupBy(*GROUP).count().filter(F.col("count") > crowd).select(*GROUP)), "crowded")
    measured = wanted(with_track_length(tags))
    if many.isEmpty():
        kept = _fold_small(_distinct_boxes(measured.repartition(*GROUP)), above)
    else:
        few = measured.join(many.hint("merge"), GROUP, "left_anti")
        if many.count() <= BROADCAST_ROWS:
            few = measured.join(F.broadcast(many), GROUP, "left_anti").repartition(*GROUP)
        boxes = materialize(_distinct_boxes(measured.join(many, GROUP, "left_semi")), "boxes")
        crowded = boxes.groupBy(*GROUP).count().filter(F.col("count") > crowd).select(*GROUP)
        kept = _fold_small(_distinct_boxes(few), above).unionByName(_fold_small(boxes.join(crowded, GROUP, "left_anti"), above))
        if not crowded.isEmpty():
            kept = kept.unionByName(_rounds_large(boxes.join(crowded, GROUP, "left_semi"), above))
    columns = [c for c in measured.columns if c != "_alone"]
    return kept.select(*[c if c in GROUP else F.col(f"best.{c}").alias(c) for c in columns])


def tag_database(sides: list[DataFrame], clips: DataFrame, above: float = 0.8) -> DataFrame:
    """Tag files merged in order, overlaps removed, and the tags of the catalog's clips kept.

    The merge is written once, as the removal of overlaps reads it several times. Overlaps lie within a clip, so those
    of clips outside the catalog are not looked for.
    """
    merged = materialize(merge_tags(*sides).drop("hash"), "merged-tags")
    return nms_dedup(merged, above, clips=clips).withColumn("hash", tag_hash())
