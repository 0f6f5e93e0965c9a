"""Packets, access units, extents and clocks of streams."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import save
from . import asof, scan
from .islands import runs_of

VCL_MOST, IDR, SPS, PPS = 31, 5, 7, 8


#: Least width of a stretch of time in which units are paired at once, in tolerances.
STRETCH = 16
FREE, HELD, ASKS = 0, 1, 2


def _take(times: list, seqs: list, holders: list, free: list, low: float, high: float, tolerance: float) -> tuple[list, list]:
    """Dependent units (sorted by time and seq, with the (seq, pts) that hold them) after the free base units have asked.

    A base unit asks for its nearest unit that is free or held by a later base unit, which then asks anew. One whose
    nearest unit could lie beyond ``low`` or ``high`` waits; those that find nothing are left out. Gives both.
    """
    starts = [k for k in range(len(times)) if not k or times[k] != times[k - 1]]
    ends = [*starts[1:], len(times)]
    values = [times[k] for k in starts]
    n = len(values)
    left, right = list(range(n + 1)), list(range(n + 1))  # next time with a unit to be had; left is moved up by one
    wait, todo = [], list(free)
    heapq.heapify(todo)

    def root(up: list, k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def spot(k: int, seq: int) -> int | None:
        """The first unit of a time that is to be had; its holders are in order, the free ones last."""
        x, y = starts[k], ends[k]
        at = bisect_right(holders, seq, x, y, key=lambda h: math.inf if h is None else h[0])
        return at if at < y else None

    while todo:  # in decode order, so what is not to be had for one is not for those after it
        seq, pts = heapq.heappop(todo)
        at = bisect_left(values, pts)
        best = None
        k = root(right, at)
        while k < n and values[k] - pts <= tolerance:
            if (i := spot(k, seq)) is not None:
                best = (values[k] - pts, seqs[i], i)
                break
            right[k] = k + 1
            k = root(right, k)
        k = root(left, at)
        while k > 0 and pts - values[k - 1] <= tolerance:
            if (i := spot(k - 1, seq)) is not None:
                best = min(best or (math.inf,), (pts - values[k - 1], seqs[i], i))
                break
            left[k] = k - 1
            k = root(left, k)
        seen = min(pts - low, high - pts)
        if seen <= (tolerance if best is None else best[0]):
            wait.append((seq, pts))
        elif best is not None:
            i = best[2]
            if holders[i] is not None:
                heapq.heappush(todo, holders[i])
            holders[i] = (seq, pts)
    return holders, wait


def pair_views(base: DataFrame, dep: DataFrame, tolerance: int = 1800, slice_rows: int = scan.SLICE) -> DataFrame:
    """Each base unit with the dependent one that it takes: one to one, in decode order.

    ``seq`` is the decode order of a stream, ``pts`` the time of a unit. From the first base unit on, each takes the
    dependent unit nearest in time that is still there, within the tolerance; of equally near ones the first in order.
    ``match`` is null where none is left.

    This is the one matching that is stable where all dependent units prefer earlier base units, so base units may ask
    in any order if an earlier one displaces a later one. Streams are cut into stretches of about ``slice_rows`` units,
    but of 16 tolerances at least; base units at a border wait and ask in the next round, whose borders lie half a
    stretch further. Pairs within the tolerance are never listed.
    """
    kinds = {name: df.select(name).schema[0].dataType.simpleString() for name, df in (("stream_id", base), ("seq", dep), ("pts", dep))} | {"_base": base.schema["seq"].dataType.simpleString(), "_at": base.schema["pts"].dataType.simpleString()}
    empty = {name: F.lit(0).cast(kinds[name]).alias(name) for name in ("seq", "pts", "_base", "_at")}
    good = [df.filter(F.col("stream_id").isNotNull() & F.col("pts").isNotNull() & ~F.isnan(F.col("pts").cast("double"))) for df in (base, dep)]
    asks = good[0].select("stream_id", empty["seq"], empty["pts"], F.col("seq").alias("_base"), F.col("pts").alias("_at"), F.lit(ASKS).alias("_kind"))
    units = asks.unionByName(good[1].select("stream_id", "seq", "pts", empty["_base"], empty["_at"], F.lit(FREE).alias("_kind")))
    time = F.when(F.col("_kind") == ASKS, F.col("_at")).otherwise(F.col("pts")).cast("double")
    sizes = units.groupBy("stream_id").agg(F.min(time).alias("_from"), F.max(time).alias("_to"), F.ceil(F.count(F.lit(1)) / slice_rows).alias("_many"))
    wide = F.greatest(F.lit(float(STRETCH * max(tolerance, 1))), 2.0 * F.ceil((F.col("_to") - F.col("_from") + 1) / F.col("_many") / 2))
    sizes = save(sizes.select("stream_id", "_from", "_to", wide.alias("_wide")), "sizes")
    state = ["_from", "_to", "_wide", "pts", "seq", "_base", "_at", "_kind"]
    kinds |= {"_from": "double", "_to": "double", "_wide": "double", "_kind": "int"}
    fields = ", ".join(f"{k} {kinds[k]}" for k in ["stream_id", *state])

    def solve(rows: list[tuple]) -> list[tuple]:
        """The rows of one stretch after its free base units have asked."""
        stream, stretch, shift, start, end, wide = rows[0][:6]
        here = sorted(r[6:] for r in rows if r[10] != ASKS)
        low = start + wide * (stretch - shift)
        high = low + wide
        low, high = -math.inf if low <= start else low, math.inf if high > end else high
        held = [r[2:4] if r[4] == HELD else None for r in here]
        held, wait = _take([r[0] for r in here], [r[1] for r in here], held, [r[8:10] for r in rows if r[10] == ASKS], low, high, tolerance)
        out = [(t, q, *(h or (0, 0)), HELD if h else FREE) for (t, q, *_), h in zip(here, held, strict=True)] + [(0, 0, *w, ASKS) for w in wait]
        return [(stream, start, end, wide, *r) for r in out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # streams are many and short as a rule, so a batch takes many of them; one may go on in the next batch
        rows, out = [], []
        for pdf in batches:
            for key, group in groupby(zip(*(pdf[c].tolist() for c in ("stream_id", "_stretch", "_shift", *state)), strict=True), key=lambda r: r[:2]):
                if rows and rows[0][:2] != key:
                    out += solve(rows)
                    rows = []
                rows += group
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["stream_id", *state])
                out = []
        if rows:
            out += solve(rows)
        yield pd.DataFrame(out, columns=["stream_id", *state])

    todo, done, shift = units.join(sizes, "stream_id"), [], 0.0
    while True:
        moved = F.when(F.col("_to") - F.col("_from") < F.col("_wide"), F.lit(0.0)).otherwise(F.lit(shift))
        placed = todo.withColumn("_shift", moved).withColumn("_stretch", F.floor((time - F.col("_from")) / F.col("_wide") + F.col("_shift")))
        now = save(placed.repartition("stream_id", "_stretch").sortWithinPartitions("stream_id", "_stretch").mapInPandas(run, fields), "paired")
        open_ = save(now.filter(F.col("_kind") == ASKS).select("stream_id").distinct(), "open")
        if open_.isEmpty():
            break
        done.append(now.join(open_, "stream_id", "left_anti"))
        todo, shift = now.join(open_, "stream_id", "left_semi"), 0.5 - shift
    pairs = reduce(DataFrame.unionByName, [*done, now]).filter(F.col("_kind") == HELD).select("stream_id", F.col("_base").alias("seq"), F.col("seq").alias("_dep"))
    found = pairs.join(dep.select(F.col("stream_id"), F.col("seq").alias("_dep"), F.struct(*dep.columns).alias("match")), ["stream_id", "_dep"]).drop("_dep")
    return base.join(found, ["stream_id", "seq"], "left")


def desync(pairs: DataFrame, limit: int = 3003, flag: int = 9000) -> DataFrame:
    """Action on pairs (base_pts, dep_pts): which side to drop when they part by more than ``limit`` ticks."""
    d = F.col("base_pts") - F.col("dep_pts")
    return pairs.withColumns({"action": F.when(d > limit, "drop_dep").when(d < -limit, "drop_base").otherwise("keep"), "flagged": F.abs(d) > flag})


def pair_equal(views: DataFrame, order: str = "seq", left_id: int = 0, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Pairs of consecutive views of equal pts, left by view id, and per stream its orphans and whether it failed.

    In a run of equal pts every first row waits and every second one completes a pair; an odd row left over is an
    orphan, and ``most`` orphans without a pair between them fail the stream.
    """
    runs = runs_of(views, ["stream_id"], [order], F.col("pts"))
    in_run = Window.partitionBy("stream_id", "run")
    rows = runs.withColumn("_n", F.count(F.lit(1)).over(in_run)).withColumn("_pair", F.floor((F.col("run_place") - 1) / 2))
    paired = F.col("run_place") <= F.col("_n") - F.col("_n") % 2
    two = rows.filter(paired).groupBy("stream_id", "run", "_pair").agg(F.min("pts").alias("pts"), F.min_by("view_id", order).alias("a"), F.max_by("view_id", order).alias("b"), F.min(order).alias("first"))
    swap = (F.col("b") == left_id) & (F.col("a") != left_id)
    pairs = two.select("stream_id", "first", "pts", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("left"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("right"))
    events = rows.select("stream_id", order, (~paired).alias("orphan"))
    streaks = runs_of(events, ["stream_id"], [order], F.col("orphan"))
    health = streaks.groupBy("stream_id").agg(F.count_if("orphan").alias("orphans"), F.bool_or(F.col("orphan") & (F.col("run_place") >= most)).alias("failed"))
    return pairs, health


def repair_poc(frames: DataFrame, dep_pool: DataFrame) -> DataFrame:
    """``dep`` of each frame: the pooled dependent view of its picture order count, else its own."""
    pool = dep_pool.groupBy("stream_id", "poc").agg(F.min("dep").alias("_pool"))
    return frames.join(pool, ["stream_id", "poc"], "left").withColumn("dep", F.coalesce("_pool", "dep")).drop("_pool")


def segment_offsets(segments: DataFrame, by: list[str], order: str = "item_no", seconds: str = "duration_s") -> DataFrame:
    """Adds ``offset_ms``: the sum of the rounded (half to even) lengths before a segment."""
    ms = F.bround(F.col(seconds) * 1000).cast("bigint")
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset_ms", F.coalesce(F.sum(ms).over(w), F.lit(0)))


def locate(times: DataFrame, segments: DataFrame, by: list[str], slice_ms: float = 3_600_000) -> DataFrame:
    """The segment of a global time, and the time inside it; negative times count as 0."""
    at = times.withColumn("t", F.greatest(F.lit(0), F.col("global_ms")))
    starts = segment_offsets(segments, by).select(*by, F.col("offset_ms").alias("t"), "item_no")
    met = asof.asof(at, starts, by, "t", slice_ms, tie=["item_no"])
    return met.withColumns({"item_no": F.col("match.item_no"), "local_ms": F.col("t") - F.col("match.t")}).drop("t", "match")


def extents_cumulative(base: DataFrame, dep: DataFrame, totals: DataFrame) -> DataFrame:
    """Base extents with ``unit_packet``, the start packet of the interleaved unit: the lengths of all extents of both streams before it.

    ``base`` and ``dep`` hold (clip, ext_no, start), one row for each extent; the last extent ends at the stream's total,
    or has no length. A base extent without a dependent one has no unit and counts for none. All rows of a clip are
    dealt once, by the clip; every later step has them there.
    """
    none = F.lit(None).cast("bigint")
    side = lambda df, k: df.select("clip", F.lit(k).alias("_side"), "ext_no", F.col("start").cast("bigint").alias("start"), none.alias("_base"), none.alias("_dep"))
    ends = totals.select("clip", F.lit(2).alias("_side"), none.alias("ext_no"), none.alias("start"), F.col("base_total").cast("bigint").alias("_base"), F.col("dep_total").cast("bigint").alias("_dep"))
    rows = side(base, 0).unionByName(side(dep, 1)).unionByName(ends).filter("clip IS NOT NULL").repartition("clip")
    whole = Window.partitionBy("clip")
    total = F.when(F.col("_side") == 0, F.max("_base").over(whole)).otherwise(F.max("_dep").over(whole))
    end = F.coalesce(F.lead("start").over(Window.partitionBy("clip", "_side").orderBy("ext_no")), total, F.col("start"))
    sized = rows.withColumn("_len", F.greatest(F.lit(0), end - F.col("start"))).filter("_side < 2")
    dep_len = F.max(F.when(F.col("_side") == 1, F.col("_len"))).over(Window.partitionBy("clip", "ext_no"))
    met = sized.withColumn("_dep_len", F.when(F.col("ext_no").isNotNull(), dep_len)).filter("_side = 0")
    before = Window.partitionBy("clip").orderBy("ext_no").rowsBetween(Window.unboundedPreceding, -1)
    unit = F.coalesce(F.sum(F.col("_len") + F.col("_dep_len")).over(before), F.lit(0))
    return met.select("clip", "ext_no", "start", F.when(F.col("_dep_len").isNotNull(), unit).alias("unit_packet"))


#: Clips with sync points that may be sent to every task.
ASKED = 1_000_000


def seek_table(points: DataFrame, base: DataFrame, dep: DataFrame, totals: DataFrame, slice_packets: float = 1 << 24) -> DataFrame:
    """Sync points (clip, pts_ms, byte_off) with the interleaved byte of the unit that holds each.

    Extents of clips that no point asks for are left out before they are dealt; units are written once, as the as-of join
    reads them several times.
    """
    asked = save(points.select("clip").filter("clip IS NOT NULL").distinct(), "asked")
    if asked.count() <= ASKED:
        base, dep, totals = (df.join(F.broadcast(asked), "clip", "left_semi") for df in (base, dep, totals))
    every = save(extents_cumulative(base, dep, totals), "units")
    at = points.withColumn("packet", F.floor(F.col("byte_off") / 192).cast("bigint"))
    met = asof.asof(at, every.withColumnRenamed("start", "packet"), ["clip"], "packet", slice_packets, tie=["ext_no"])
    return met.filter("match.unit_packet IS NOT NULL").select("clip", "pts_ms", F.col("match.ext_no").alias("ext_no"), (F.col("match.unit_packet") * 192).alias("ssif_byte"))


def pg_depth(gops: DataFrame, pid_seq: DataFrame) -> DataFrame:
    """Disparity of a graphics track per group of pictures, where it changes: the upper median of its offset sequence."""
    known = pid_seq.select("stream_id", F.col("seq_id").alias("_seq"))
    met = gops.join(known, "stream_id", "left")
    n = F.size("sequences")
    seq = F.when(F.coalesce(F.col("_seq"), F.lit(0)).between(0, n - 1), F.coalesce(F.col("_seq"), F.lit(0))).otherwise(0)
    row = F.array_sort(F.get("sequences", seq))
    rows = met.withColumn("disparity", 2.0 * F.get(row, F.floor(F.size(row) / 2).cast("int")) / 1920.0)
    before = F.lag("disparity").over(Window.partitionBy("stream_id").orderBy("gop_no"))
    return rows.withColumn("_before", before).filter(~F.col("disparity").eqNullSafe(F.col("_before"))).select("stream_id", "gop_no", "disparity")


def pts_normalise(aus: DataFrame, order: str = "seq") -> DataFrame:
    """pts from the first of its stream, by arrival."""
    first = F.first("pts").over(Window.partitionBy("stream_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return aus.withColumn("pts", F.col("pts") - first)


def assign_pts(frames: DataFrame, emitted: str = "emit_no", pts: str = "pts") -> DataFrame:
    """The k-th emitted frame of a stream with its k-th smallest pts."""
    times = scan.numbered(frames.select("stream_id", F.col(pts).alias("display_pts")), ["stream_id"], ["display_pts"], "_k")
    return scan.numbered(frames, ["stream_id"], [emitted], "_k").join(times, ["stream_id", "_k"]).drop("_k")


def layer_counts(nals: DataFrame) -> DataFrame:
    """Slices of pictures, those of the dependent view and its share, per stream."""
    vcl = F.col("nal_type") <= VCL_MOST
    out = nals.groupBy("stream_id").agg(F.count_if(vcl).alias("vcl"), F.count_if(vcl & (F.col("layer_id") > 0)).alias("dependent"))
    return out.withColumn("share", F.when(F.col("vcl") > 0, F.col("dependent") / F.col("vcl")).otherwise(0.0))


def au_class(nals: DataFrame) -> DataFrame:
    """Per access unit ``sync`` (idr, recovery or null) and whether it holds base and dependent slices."""
    t = F.col("nal_type")
    out = nals.groupBy("stream_id", "au_no").agg(F.bool_or(t == IDR).alias("_idr"), (F.bool_or(t == SPS) & F.bool_or(t == PPS)).alias("_rec"), F.bool_or(t.isin(14, 20)).alias("has_dependent"), F.bool_or(t.between(1, 8)).alias("has_base"))
    return out.withColumn("sync", F.when(F.col("_idr"), "idr").when(F.col("_rec"), "recovery")).drop("_idr", "_rec")


def valid_fragments(df: DataFrame, most: int = 4096) -> DataFrame:
    return df.filter(F.col("frag_cnt").between(1, most) & (F.col("frag_idx") >= 0) & (F.col("frag_idx") < F.col("frag_cnt")))


def reassemble(datagrams: DataFrame, arrival: str = "rx") -> DataFrame:
    """Complete payloads (session, seq, fragments, payload) of units whose fragments arrive without another unit between.

    One unit is under way in a session; a datagram of another seq abandons it for good, whatever of it arrives later
    begins anew. A unit is complete with as many distinct fragments as its first datagram says; of a fragment that comes
    twice the last counts, and what follows a complete unit begins another. Ids alone are walked through; payloads
    are only gathered for complete units.

    Datagrams are dealt by ranges of session and arrival, as many as they need, so a long session is many tasks; a run of
    one seq that goes on in the next range keeps the number of its first row.
    """
    from .frames import recurrence

    order = [arrival, "seq", "frag_idx"]
    tasks = scan.tasks_for(datagrams)
    sorted_ = valid_fragments(datagrams).repartitionByRange(tasks, "session", *order).sortWithinPartitions("session", *order)
    good = save(sorted_.withColumn("_id", F.monotonically_increasing_id()), "fragments")
    runs = _runs_of_seq(good.select("session", "seq", "frag_idx", "frag_cnt", "_id", F.shiftright("_id", 33).alias("_range")).repartition(tasks, "session", "_range"))
    # each run of equal seq begins without state, so a long session is walked in stretches of runs
    runs = runs.withColumn("_stretch", F.shiftright("_run", 14)).repartition(tasks, "session", "_stretch")

    def units(pdf):
        unit, have, need, run, out, done = 0, set(), 0, None, [], []
        for r, i, n in zip(pdf["_run"], pdf["frag_idx"], pdf["frag_cnt"], strict=True):
            if r != run or not have:
                run, have, need, unit = r, set(), n, unit + 1
                done.append(False)
            have.add(i)
            out.append(unit)
            if len(have) >= need:
                done[-1], have = True, set()
        return {"_unit": out, "_done": [done[u - 1] for u in out]}

    narrow = runs.select("session", "_stretch", "_run", "frag_idx", "frag_cnt", "_id")
    marked = recurrence(narrow, ["session", "_stretch"], ["_id"], "_unit int, _done boolean", units).filter("_done")
    met = marked.select("_id", "_stretch", "_unit").repartition(tasks, "_id").join(good.repartition(tasks, "_id"), "_id")
    met = met.select("session", "_stretch", "_unit", "seq", "frag_idx", "_id", "payload").repartition(tasks, "session", "_stretch", "_unit")
    last = met.groupBy("session", "_stretch", "_unit", "seq", "frag_idx").agg(F.max_by("payload", "_id").alias("payload"))
    parts = F.array_sort(F.collect_list(F.struct("frag_idx", "payload")))
    whole = last.groupBy("session", "_stretch", "_unit", "seq").agg(F.count(F.lit(1)).alias("fragments"), parts.alias("_p"))
    return whole.select("session", "seq", "fragments", F.array_join("_p.payload", "").alias("payload"))


def _runs_of_seq(rows: DataFrame) -> DataFrame:
    """``rows`` (session, seq, _id, _range) with ``_run``: the _id of the first row of its run of one seq, across ranges."""
    w = Window.partitionBy("session", "_range").orderBy("_id")
    starts = F.lag("_id").over(w).isNull() | ~F.lag("seq").over(w).eqNullSafe(F.col("seq"))
    local = rows.withColumn("_start", F.when(starts, F.col("_id")))
    heads = local.groupBy("session", "_range").agg(F.min_by("seq", "_id").alias("_first"), F.max_by("seq", "_id").alias("_last"), F.min("_id").alias("_from"), F.max("_start").alias("_own"), F.count("_start").alias("_n"))
    by = Window.partitionBy("session").orderBy("_range")
    heads = heads.withColumn("_goes_on", F.lag("_range").over(by).isNotNull() & F.lag("_last").over(by).eqNullSafe(F.col("_first")))
    begun = F.last(F.when((F.col("_n") > 1) | ~F.col("_goes_on"), F.col("_own")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    heads = heads.withColumn("_begun", begun).withColumn("_before", F.when(F.col("_goes_on"), F.lag("_begun").over(by)))
    changed = save(heads.filter("_before IS NOT NULL").select("_range", "_from", "_before"), "heads")
    run = F.last("_start", ignorenulls=True).over(w)
    numbered = local.withColumn("_run", run)
    # at most one run of each range goes on, the first of its session there
    met = numbered.join(F.broadcast(changed.withColumnRenamed("_from", "_run").drop("_range")), "_run", "left")
    return met.withColumn("_run", F.coalesce("_before", "_run")).drop("_start", "_before")


def av_action(frames: DataFrame, clock: DataFrame, offset_s: float = 0.0, slice_s: float = 3600) -> DataFrame:
    """What to do with each frame against the last audio clock: drop, ease, hold, nudge or none, and by how much."""
    met = asof.asof(frames, clock, ["session"], "t", slice_s)
    diff = F.col("pts_s") - (F.col("match.audio_s") - offset_s)
    action = F.when(diff.isNull(), "free").when(diff < -0.120, "drop").when(diff > 0.350, "hold").when(diff == 0.350, "hold").when(diff > 0.150, "ease").when(F.abs(diff) > 0.025, "nudge").otherwise("none")
    stretch = F.when(action == "ease", F.least((diff - 0.150) * 0.30, F.lit(0.012))).when(action == "nudge", F.greatest(F.lit(-0.008), F.least(F.lit(0.008), diff * 0.25))).otherwise(0.0)
    return met.withColumns({"diff_s": diff, "action": action, "stretch_s": stretch}).drop("match")


def late_drop(frames: DataFrame, clock: DataFrame, order: str = "t", slice_s: float = 3600, tie: list[str] | None = None) -> DataFrame:
    """Adds ``late`` and ``wait_ms`` against the audio clock; the bound follows the interval between frames.

    Frames of one time and pts follow one another in order of ``tie``.
    """
    met = asof.asof(frames, clock, ["session"], "t", slice_s)
    interval = F.greatest(F.lit(1.0), F.col("pts_ms") - F.lag("pts_ms").over(Window.partitionBy("session").orderBy(order, "pts_ms", *(tie or []))))
    bound = F.greatest(F.lit(45.0), F.least(F.lit(100.0), F.coalesce(interval, F.lit(1.0)) * 1.25))
    error = F.col("pts_ms") - F.col("match.audio_ms")
    rows = met.withColumns({"_bound": bound, "error_ms": error})
    late = F.coalesce(F.col("error_ms") < -F.col("_bound"), F.lit(False))
    return rows.withColumns({"late": late, "wait_ms": F.when(~late, F.least(F.greatest(F.col("error_ms"), F.lit(0.0)), F.lit(500.0)))}).drop("_bound", "match")


def crc_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per case the first frame whose checksums differ on the common prefix, and both lengths."""
    left, right = a.select("case_id", "frame_no", F.col("crc").alias("a")), b.select("case_id", "frame_no", F.col("crc").alias("b"))
    both = left.join(right, ["case_id", "frame_no"], "full")
    return both.groupBy("case_id").agg(F.min(F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")), F.col("frame_no"))).alias("first_mismatch"), F.count("a").alias("n_a"), F.count("b").alias("n_b")).withColumn("shorter_tail", F.col("n_a") != F.col("n_b"))


def monotone(ticks: DataFrame, by: list[str], order: list[str], value: str = "value") -> Column:
    """Running maximum within an epoch: small steps back are ignored."""
    return F.max(value).over(Window.partitionBy(*by, "epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
