"""Discs, playlists, titles, assets: what a library holds and what its main features are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, stereo
from ..scratch import save
from .ranks import top_rows

PRIORITY = {"none": 0, "tab": 1, "anaglyph": 1, "sbs": 2, "mvc": 3}
DECOY_REPLAY = 1.5
#: Clips whose paths may be sent to every task.
PATHS = 1_000_000


def durations(segments: DataFrame) -> DataFrame:
    """Seconds and items of each playlist."""
    return segments.groupBy("disc_id", "playlist").agg((F.sum(F.col("out_45k") - F.col("in_45k")) / 45000.0).alias("duration_s"), F.count(F.lit(1)).alias("items"))


def playlists(segments: DataFrame) -> DataFrame:
    """Duration, items and ``decoy`` of each playlist: more than 1.5 times the length of its distinct segments.

    Repeats of a segment are counted in the first level, so a looping decoy shrinks before it is shuffled.
    """
    length = F.col("out_45k") - F.col("in_45k")
    distinct = segments.groupBy("disc_id", "playlist", "clip", "in_45k", "out_45k").agg(F.count(F.lit(1)).alias("n"))
    total, once = F.sum(length * F.col("n")), F.sum(length)
    out = distinct.groupBy("disc_id", "playlist").agg((total / 45000.0).alias("duration_s"), F.sum("n").alias("items"), total.alias("_total"), once.alias("_once"))
    return out.withColumn("decoy", (F.col("items") > 1) & (F.col("_once") > 0) & (F.col("_total") > DECOY_REPLAY * F.col("_once"))).drop("_total", "_once")


def decoys(segments: DataFrame) -> DataFrame:
    return playlists(segments).filter("decoy").select("disc_id", "playlist", "items", "duration_s")


def ranked(lists: DataFrame) -> DataFrame:
    """Non-decoys, then decoys, each longest first: ``rank`` from 1 within a disc."""
    real, fake = (lists.filter(F.col("decoy") == d).withColumn("part", F.lit(k)) for k, d in enumerate((False, True)))
    order = Window.partitionBy("disc_id").orderBy("part", F.col("duration_s").desc(), "playlist")
    return real.unionByName(fake).withColumn("rank", F.row_number().over(order)).select("disc_id", "playlist", "decoy", "duration_s", "rank")


def prefer_3d(lists: DataFrame) -> DataFrame:
    """``rank`` within each (disc, decoy) group, longest first, where equivalents with the 3D extension move forward.

    A place whose playlist lacks the extension swaps with the first later one that is equivalent (equal ``sequence`` or
    a duration within 1 %) and has it. Each swap depends on those before it, but none crosses a step of over 1 % between
    neighbours, so groups are cut there, and only pieces with playlists of both sorts are walked through.
    """
    import pandas as pd

    group = Window.partitionBy("disc_id", "decoy")
    w = group.orderBy(F.col("duration_s").desc(), "playlist")
    rows = lists.select("disc_id", "playlist", "decoy", "duration_s", "has_3d", "sequence").withColumn("rank", F.row_number().over(w))
    rows = rows.withColumn("_cut", (F.col("duration_s") < 0.9899 * F.lag("duration_s").over(w)).cast("int"))
    rows = rows.withColumn("_piece", F.coalesce(F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    piece = Window.partitionBy("disc_id", "decoy", "_piece")
    rows = rows.withColumn("_mixed", F.max("has_3d").over(piece) & ~F.min("has_3d").over(piece))

    def arrange(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("rank").itertuples(index=False))
        first = rows[0].rank
        spots = [k for k, r in enumerate(rows) if r.has_3d]  # those still ahead; what moves forward is not met again
        for i in range(len(rows)):
            here = rows[i]
            if spots and spots[0] <= i:
                del spots[0]
            if not spots:
                break
            if here.has_3d:
                continue
            same = lambda r: r.sequence == here.sequence or (here.duration_s > 0 and abs(r.duration_s - here.duration_s) <= 0.01 * here.duration_s)  # noqa: B023, E731
            if (k := next((k for k, j in enumerate(spots) if same(rows[j])), None)) is not None:
                j = spots.pop(k)
                rows[i], rows[j] = rows[j], rows[i]
        return pd.DataFrame([(r.disc_id, r.playlist, r.decoy, first + k) for k, r in enumerate(rows)], columns=["disc_id", "playlist", "decoy", "rank"])

    kinds = ", ".join(f"{c} {lists.schema[c].dataType.simpleString()}" for c in ("disc_id", "playlist", "decoy"))
    swapped = rows.filter("_mixed").groupBy("disc_id", "decoy", "_piece").applyInPandas(arrange, f"{kinds}, rank int")
    return rows.filter("NOT coalesce(_mixed, false)").select("disc_id", "playlist", "decoy", "rank").unionByName(swapped)


def _on(clips: DataFrame) -> list[str]:
    return ["disc_id", "clip"] if "disc_id" in clips.columns else ["clip"]


def resolve_segments(segments: DataFrame, clips: DataFrame, kind: str) -> DataFrame:
    """Playlist items whose clip of the kind exists, in order, with its path and that of the audio clip."""
    on = _on(clips)
    own = clips.filter(F.col("kind") == kind).select(*on, "path")
    audio = clips.filter(F.col("kind") == "m2ts").select(*on, F.col("path").alias("audio_path"))
    return segments.join(own, on).join(audio, on, "left")


def largest(clips: DataFrame, by: list[str]) -> DataFrame:
    """The largest clip of each group; one of unreadable size counts as -1, of equals the first path."""
    size = F.coalesce("size_bytes", F.lit(-1))
    return clips.groupBy(*by).agg(F.min_by("path", F.struct(-size, F.col("path"))).alias("path"), F.max(size).alias("size_bytes"))


def main_feature(segments: DataFrame, clips: DataFrame, extension: DataFrame | None = None) -> DataFrame:
    """Per disc the first playlist of the ranking with 3D clips, else with 2D clips, else the largest 3D or 2D file.

    ``extension`` lists the playlists (disc_id, playlist) with the 3D extension; among equivalent ones they rank first,
    within decoys and non-decoys each. Segments are read once: repeats are combined first, then clips of both kinds are
    met and each playlist is one row, which is written, as the ranking reads it twice. Few clips may have most of the
    segments, so their paths are sent to every task unless they are over ``PATHS`` clips.
    """
    on = _on(clips)
    paths = clips.filter(F.col("kind").isin("ssif", "m2ts")).groupBy(*on).agg(*[F.min(F.when(F.col("kind") == k, F.col("path"))).alias(f"_{k}") for k in ("ssif", "m2ts")])
    paths = save(paths, "paths")
    if paths.count() <= PATHS:
        paths = F.broadcast(paths)
    length = F.col("out_45k") - F.col("in_45k")
    item = F.xxhash64("item_no", "clip", "in_45k", "out_45k"), F.xxhash64("out_45k", "clip", "item_no", "in_45k")
    distinct = segments.groupBy("disc_id", "playlist", "clip", "in_45k", "out_45k").agg(F.count(F.lit(1)).alias("n"), F.min("item_no").alias("_first"), *[F.bit_xor(h).alias(f"_h{k}") for k, h in enumerate(item)])
    total, once = F.sum(length * F.col("n")), F.sum(length)
    found = [x for k in ("ssif", "m2ts") for x in (F.coalesce(F.sum(F.when(F.col(f"_{k}").isNotNull(), F.col("n"))), F.lit(0)).alias(f"{k}_clips"), F.min_by(f"_{k}", F.when(F.col(f"_{k}").isNotNull(), F.col("_first"))).alias(f"{k}_path"))]
    sums = [(total / 45000.0).alias("duration_s"), F.sum("n").alias("items"), total.alias("_total"), once.alias("_once"), F.struct(F.bit_xor("_h0"), F.bit_xor("_h1")).alias("sequence")]
    lists = distinct.join(paths, on, "left").groupBy("disc_id", "playlist").agg(*sums, *found)
    lists = lists.withColumn("decoy", (F.col("items") > 1) & (F.col("_once") > 0) & (F.col("_total") > DECOY_REPLAY * F.col("_once")))
    lists = save(lists, "lists")
    if extension is None:
        order = Window.partitionBy("disc_id").orderBy("decoy", F.col("duration_s").desc(), "playlist")
        lists = lists.withColumn("rank", F.row_number().over(order))
    else:
        has = extension.select("disc_id", "playlist").distinct().withColumn("has_3d", F.lit(True))
        marked = lists.join(has, ["disc_id", "playlist"], "left").withColumn("has_3d", F.coalesce("has_3d", F.lit(False)))
        marked = marked.withColumn("sequence", F.to_json("sequence"))
        lists = lists.join(prefer_3d(marked).drop("decoy"), ["disc_id", "playlist"])
    rank = F.struct("decoy", "rank")
    best = [F.struct(F.lit(p).alias("phase"), rank.alias("order"), F.lit(k).alias("kind"), F.col("playlist"), F.col(f"{k}_path").alias("path"), F.col(f"{k}_clips").alias("clips"), F.col("duration_s")) for p, k in enumerate(("ssif", "m2ts"))]
    choice = F.when(F.col("ssif_clips") > 0, best[0]).when(F.col("m2ts_clips") > 0, best[1])
    discs = lists.withColumn("_c", choice).groupBy("disc_id").agg(F.min_by("_c", F.when(F.col("_c").isNotNull(), F.struct("_c.phase", "_c.order"))).alias("c"))
    keys = [c for c in on if c != "clip"] or ["_one"]
    files = largest(clips, [*(c for c in on if c != "clip"), "kind"]).withColumn("_one", F.lit(1))
    spare = files.filter(F.col("kind").isin("ssif", "m2ts")).groupBy(*keys).agg(F.min_by(F.struct("kind", "path"), F.when(F.col("kind") == "ssif", 2).otherwise(3)).alias("f"))
    met = discs.withColumn("_one", F.lit(1)).join(spare, keys, "left").filter("c IS NOT NULL OR f IS NOT NULL")
    pick = lambda c, other: F.when(F.col("c").isNotNull(), F.col(f"c.{c}")).otherwise(other).alias(c)
    return met.select("disc_id", pick("phase", F.when(F.col("f.kind") == "ssif", 2).otherwise(3)), pick("kind", F.col("f.kind")), pick("playlist", F.lit(None)), pick("path", F.col("f.path")), pick("clips", F.lit(1).cast("bigint")), pick("duration_s", F.lit(0.0)))


def pair_clips(features: DataFrame, extension: DataFrame, clips: DataFrame) -> DataFrame:
    """Base clip with its dependent one: from the extension list, else the next number; both must exist."""
    on = _on(clips)
    keys = [c for c in on if c != "clip"]
    follow = F.lpad((F.col("clip").try_cast("int") + 1).cast("string"), 5, "0")
    owner = [c for c in ("disc_id", "clip") if c in features.columns and c in extension.columns]
    named = features.join(extension.select(*owner, F.col("dep_clip").alias("_listed")), owner, "left").withColumn("dep_clip", F.coalesce("_listed", follow)).drop("_listed")
    files = clips.filter("kind = 'm2ts'")
    base = files.select(*on, F.col("path").alias("base_path"))
    dep = files.filter("size_bytes > 0").select(*keys, F.col("clip").alias("dep_clip"), F.col("path").alias("dep_path"))
    return named.join(base, on).join(dep, [*keys, "dep_clip"])


def edl(segments: DataFrame) -> DataFrame:
    """The ordered list of segments of a feature, paths quoted by their UTF-8 length; empty for fewer than two."""
    path = F.regexp_replace("path", r"\\", "/")
    quoted = F.concat(F.lit("%"), F.octet_length(path).cast("string"), F.lit("%"), path, F.when(F.col("duration_s") > 0, F.concat(F.lit(",length="), F.format_string("%.3f", "duration_s"))).otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("item_no", quoted.alias("q"))))
    out = segments.filter("path IS NOT NULL").groupBy("disc_id", "playlist").agg(parts.alias("p"))
    return out.select("disc_id", "playlist", F.when(F.size("p") < 2, "").otherwise(F.concat(F.lit("edl://"), F.array_join("p.q", ";"))).alias("edl"))


def promote(evidence: DataFrame) -> DataFrame:
    """Fold stereo evidence of each title in order of ``seq``: (mode, eye_order) -> stereo_mode, eye_order, is_3d, has_mvc.

    A mode of at least the priority reached so far replaces the mode, and a known eye order comes with it.
    """
    rows = evidence.filter("mode IS NOT NULL AND mode <> ''").withColumn("_p", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("mode")), F.lit(0)))
    w = Window.partitionBy("title").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_leads", F.col("_p") >= F.max("_p").over(w))
    order = stereo.eye_order_norm(F.col("eye_order"))
    known = F.col("_leads") & (order != stereo.UNKNOWN)
    return rows.groupBy("title").agg(
        F.max_by("mode", F.struct("_p", "seq")).alias("stereo_mode"),
        F.coalesce(F.max_by(F.when(known, order), F.when(known, F.col("seq"))), F.lit(stereo.UNKNOWN)).alias("eye_order"),
        F.lit(True).alias("is_3d"), F.bool_or(F.col("mode") == "mvc").alias("has_mvc"),
    )


def any_audio(streams: DataFrame) -> DataFrame:
    return streams.groupBy("file").agg(F.bool_or(F.col("codec_type") == "audio").alias("has_audio"))


def stream_pids(programs: DataFrame, types: list[int]) -> DataFrame:
    """The distinct PIDs of the given stream types, sorted."""
    return programs.filter(F.col("stream_type").isin(types)).groupBy("program").agg(F.array_sort(F.collect_set("pid")).alias("pids"))


def fill_language(tracks: DataFrame, pid_lang: DataFrame) -> DataFrame:
    """Each track's language tag, else the disc's language of its PID."""
    disc = pid_lang.select("clip", "pid", F.col("lang").alias("_disc"))
    own = F.nullif(F.trim("lang"), F.lit(""))
    return tracks.join(disc, ["clip", "pid"], "left").withColumn("lang", F.coalesce(own, F.nullif(F.trim("_disc"), F.lit("")))).drop("_disc")


def manifest_missing(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Expected files that are absent or of another size."""
    return manifest.join(inventory.select("name", "bytes").distinct(), ["name", "bytes"], "left_anti")


def pack_status(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Installed and all files, missing bytes and completeness of each pack."""
    there = inventory.select("name", "bytes").distinct().withColumn("_there", F.lit(True))
    met = manifest.join(there, ["name", "bytes"], "left")
    has = F.col("_there").isNotNull()
    return met.groupBy("pack").agg(F.count_if(has).alias("installed"), F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.when(~has, F.col("bytes"))), F.lit(0)).alias("missing_bytes"), F.bool_and(has).alias("complete"))


def attested(assets: DataFrame, markers: DataFrame) -> DataFrame:
    """Adds ``attested``: the folder's marker list names the asset, in either case; a folder without a list attests all."""
    lists = markers.filter("name IS NOT NULL").groupBy("dir").agg(F.count(F.lit(1)).alias("_n"))
    named = markers.select("dir", F.lower("name").alias("_name")).distinct().withColumn("_hit", F.lit(True))
    base = F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1))
    met = assets.withColumn("_name", base).join(lists, "dir", "left").join(named, ["dir", "_name"], "left")
    return met.withColumn("attested", F.col("_n").isNull() | F.col("_hit").isNotNull()).drop("_name", "_n", "_hit")


def aspect_bucket(titles: DataFrame, shapes: DataFrame, side: int, min_saving: float = 0.10, max_error: float = 14.0) -> DataFrame:
    """The installed fixed shape that best fits each title's content ratio; null where none does.

    ``shapes`` is an inventory of installed assets, one row per file: it is met as one sorted array, never as a join.
    """
    good = shapes.filter((F.col("width") == side) & (F.col("width") % geometry.PATCH == 0) & (F.col("height") % geometry.PATCH == 0) & (F.col("height") > 0) & (F.col("height") <= F.col("width")))
    good = good.filter(1.0 - F.col("width") * F.col("height") / float(side * side) >= min_saving)
    # heights are multiples of the patch up to the side, so one name for each leaves at most side / patch shapes
    listed = [F.struct(F.lit(r["height"]).alias("height"), F.lit(r["name"]).alias("name")) for r in good.groupBy("height").agg(F.min(F.lower("name")).alias("name")).collect()]
    none = F.array().cast("array<struct<height: int, name: string>>")
    active = F.col("source_height") - F.col("crop_top") - F.col("crop_bottom")
    ratio = F.when((F.col("source_width") > 0) & (active > 0) & (F.col("crop_top") >= 0) & (F.col("crop_bottom") >= 0), F.col("source_width") / active)
    met = titles.withColumn("ratio", ratio).withColumn("_shapes", F.array(*listed) if listed else none)

    def key(s: Column) -> Column:
        error = F.abs(s["height"] - side / F.col("ratio"))
        return F.struct(error.alias("error"), F.abs(side / s["height"] / F.col("ratio") - 1.0).alias("ratio_error"), (-s["height"]).alias("h"), s["name"].alias("name"))

    best = F.array_min(F.filter(F.transform("_shapes", key), lambda k: k["error"] <= max_error))
    return met.select(*titles.columns, F.round("ratio", 6).alias("ratio"), best["name"].alias("shape"), (-best["h"]).cast("bigint").alias("shape_height"))


def dedup_ci(files: DataFrame, order: str = "seq") -> DataFrame:
    """A file listed in different case counts once; the first listed stays."""
    return top_rows(files.withColumn("_key", F.lower("name")), ["disc_id", "_key"], [order]).drop("_key")
