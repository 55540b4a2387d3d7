"""Flight and network telemetry: frames, loads, transfers, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import VIEWS, cte, table, view
from ..functions import geo
from ..operators.joins import as_of
from ..registry import query

# Counters sampled by run, phases between marks, and processes.
VIEWS["samples"] = ("events", ["user_id AS run", "ts", "event_id", "CAST(floor(value*10) AS BIGINT) AS cpu", "CAST(event_id%5000 AS BIGINT) AS mem", "concat('t', CAST(event_id%4 AS VARCHAR(4))) AS thread", "concat('a=', CAST(CAST(floor(value*3000) AS BIGINT) AS VARCHAR(20)), ';b=', CAST(event_id*1000000 AS VARCHAR(20))) AS disks", "event_type='signup' AS opens"])
ORDERED = "PARTITION BY run ORDER BY ts, event_id"


def _w(*by: str):
    return Window.partitionBy(*by).orderBy("ts", "event_id")


@query(cte("frames") + ", r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY frame_ms, seq)-1 AS i, count(*) OVER (PARTITION BY run) AS n FROM frames WHERE state = 2) SELECT run, count(*) AS frames, round(sum(frame_ms)/1000, 5) AS seconds, round(avg(frame_ms), 4) AS mean, max(frame_ms) FILTER (i = n//2) AS p50, max(frame_ms) FILTER (i = CAST(floor(n*0.99e0) AS BIGINT)) AS p99, max(frame_ms) AS most, count(*) FILTER (frame_ms > 50) AS over_50, count(*) FILTER (frame_ms > 100) AS over_100, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY i DESC) FILTER (i >= n-5) AS worst FROM r GROUP BY run")
def ag15_frame_stats(spark, sf_dir):
    """Percentiles are values at an index of the sorted frames, not interpolated, from counts of equal values; the worst
    five are taken by part of a run, then of the parts' worst."""
    f = view(spark, sf_dir, "frames").where("state = 2")
    run = Window.partitionBy("run")
    r = f.groupBy("run", "frame_ms").agg(F.count("*").alias("k"))
    r = r.withColumn("n", F.sum("k").over(run)).withColumn("upto", F.sum("k").over(run.orderBy("frame_ms").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("frame_ms")))
    total = F.sum(F.col("frame_ms") * F.col("k"))
    over = lambda ms: F.coalesce(F.sum(F.when(F.col("frame_ms") > ms, F.col("k"))), F.lit(0))
    stats = r.groupBy("run").agg(
        F.max("n").alias("frames"), F.round(total / 1000, 5).alias("seconds"), F.round(total / F.max("n"), 4).alias("mean"), at(F.expr("n div 2")).alias("p50"), at(F.floor(F.col("n") * 0.99)).alias("p99"),
        F.max("frame_ms").alias("most"), over(50).alias("over_50"), over(100).alias("over_100"),
    )
    part = f.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(16)))
    top = part.withColumn("i", F.row_number().over(Window.partitionBy("run", "part").orderBy(F.desc("frame_ms"), F.desc("seq")))).where("i <= 5")
    five = F.slice(F.sort_array(F.collect_list(F.struct("frame_ms", "seq")), asc=False), 1, 5)
    worst = top.groupBy("run").agg(F.array_join(F.transform(five, lambda w: w["seq"].cast("string")), ",").alias("worst"))
    return stats.join(worst, "run")


@query(cte("frames") + "SELECT run, seq FROM frames f WHERE NOT EXISTS (SELECT 1 FROM frames s WHERE s.state = 1 AND s.seq%20 = 0 AND s.run = f.run AND f.path_s BETWEEN s.path_s AND s.path_s+1)")
def fl14_drop_shot_frames(spark, sf_dir):
    """Frames outside the second after any shot: an equi-join on whole seconds, then the exact test, then an anti join."""
    f = view(spark, sf_dir, "frames")
    shots = f.where("state = 1 AND seq%20 = 0").select("run", F.col("path_s").alias("shot"), F.explode(F.sequence(F.floor("path_s"), F.floor(F.col("path_s") + 1))).alias("sec"))
    hit = f.withColumn("sec", F.floor("path_s")).join(shots, ["run", "sec"]).where("path_s BETWEEN shot AND shot + 1").select("run", "seq")
    return f.select("run", "seq").join(hit, ["run", "seq"], "left_anti")


@query(cte("loads") + f", m AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER ({ORDERED}) AS load FROM loads) SELECT run, event_id, CAST(load AS BIGINT) AS load FROM m WHERE load > 0")
def fl15_drop_late_lines(spark, sf_dir):
    """Lines before a run's first start mark belong to the run before it."""
    return load_of_line(spark, sf_dir).where("load > 0").select("run", "event_id", "load")


def load_of_line(spark, sf_dir) -> DataFrame:
    marks = F.sum((F.col("event_type") == "signup").cast("long")).over(_w("run").rowsBetween(Window.unboundedPreceding, 0))
    return view(spark, sf_dir, "loads").withColumn("load", marks)


@query(cte("loads") + f"SELECT run, event_id, CAST(count(*) FILTER (event_type = 'signup') OVER ({ORDERED}) AS BIGINT) AS load FROM loads")
def wn2_load_of_line(spark, sf_dir):
    return load_of_line(spark, sf_dir).select("run", "event_id", "load")


@query(cte("loads") + f", g AS (SELECT run, event_id, date_diff('second', min(ts) OVER (PARTITION BY run), ts) AS since, date_diff('second', lag(ts) OVER ({ORDERED}), ts) AS gap FROM loads) SELECT run, event_id, since, gap FROM g WHERE gap > 60")
def wn3_arrival_gaps(spark, sf_dir):
    sec = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    g = view(spark, sf_dir, "loads").select("run", "event_id", (sec("ts") - sec(F.min("ts").over(Window.partitionBy("run")))).alias("since"), (sec("ts") - sec(F.lag("ts").over(_w("run")))).alias("gap"))
    return g.where("gap > 60")


@query(cte("loads") + f", m AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER ({ORDERED}) AS load FROM loads) SELECT run, tlat, tlon, CAST(load AS BIGINT) AS load, min(load) OVER (PARTITION BY run, tlat, tlon) < load AS again FROM (SELECT DISTINCT run, tlat, tlon, load FROM m)")
def wn4_loaded_again(spark, sf_dir):
    seen = load_of_line(spark, sf_dir).select("run", "tlat", "tlon", "load").distinct()
    return seen.withColumn("again", F.min("load").over(Window.partitionBy("run", "tlat", "tlon")) < F.col("load"))


@query(cte("loads") + ", d AS (SELECT DISTINCT run, event_id//3 AS v FROM loads), g AS (SELECT run, v, v - row_number() OVER (PARTITION BY run ORDER BY v) AS island FROM d) SELECT run, min(v) AS low, max(v) AS high FROM g GROUP BY run, island")
def wn5_span_text(spark, sf_dir):
    """Runs of consecutive values."""
    d = view(spark, sf_dir, "loads").selectExpr("run", "event_id div 3 AS v").distinct()
    g = d.withColumn("island", F.col("v") - F.row_number().over(Window.partitionBy("run").orderBy("v")))
    return g.groupBy("run", "island").agg(F.min("v").alias("low"), F.max("v").alias("high")).drop("island")


@query(cte("raster") + "SELECT r, round(avg(abs(alt-p)), 4) AS gradient, count(*) FILTER (abs(alt-p) > 200) AS edges FROM (SELECT *, lag(alt) OVER (PARTITION BY r ORDER BY c) AS p FROM raster WHERE alt > -32768) GROUP BY r")
def wn19_row_mean_gradient(spark, sf_dir):
    d = F.abs(F.col("alt") - F.lag("alt").over(Window.partitionBy("r").orderBy("c")))
    return view(spark, sf_dir, "raster").where("alt > -32768").withColumn("d", d).groupBy("r").agg(F.round(F.avg("d"), 4).alias("gradient"), F.count_if(F.col("d") > 200).alias("edges"))


@query(cte("samples") + f", m AS (SELECT run, ts AS t, event_id AS mark FROM samples WHERE event_id%50 = 0), o AS (SELECT * FROM samples WHERE event_id%50 <> 0) SELECT m.run, m.mark, s.event_id AS sample, s.cpu FROM m ASOF JOIN o s ON m.run = s.run AND m.t >= s.ts")
def jn12_nearest_sample(spark, sf_dir):
    """The last sample at or before a mark, by run."""
    s = view(spark, sf_dir, "samples")
    marks = s.where("event_id%50 = 0").select("run", "ts", F.col("event_id").alias("mark"))
    own = s.where("event_id%50 <> 0").select("run", "ts", F.col("event_id").alias("sample"), "cpu")
    return as_of(marks, own, "run", "ts", ["sample", "cpu"]).where("sample IS NOT NULL").select("run", "mark", "sample", "cpu")


@query(cte("samples") + f""", p AS (SELECT * FROM (SELECT run, count(*) FILTER (opens) OVER ({ORDERED}) AS phase, ts, event_id, cpu, mem, disks FROM samples) WHERE phase > 0),
e AS (SELECT run, phase, arg_min(cpu, struct_pack(a := ts, b := event_id)) AS a, arg_max(cpu, struct_pack(a := ts, b := event_id)) AS b, arg_min(disks, struct_pack(a := ts, b := event_id)) AS da, arg_max(disks, struct_pack(a := ts, b := event_id)) AS db, epoch(max(ts)) - epoch(min(ts)) AS span, list_sort(list(mem))[count(*)//2 + 1] AS median, max(mem) AS most, count(*) AS n FROM p GROUP BY ALL),
x AS (SELECT *, unnest(['a', 'b']) AS disk FROM e)
SELECT run, phase, disk, b - a AS cpu, round((b - a)/greatest(span, 1e-9), 6) + 0e0 AS cores, median, most, n, (CAST(regexp_extract(db, disk || '=(-?[0-9]+)', 1) AS BIGINT) - CAST(regexp_extract(da, disk || '=(-?[0-9]+)', 1) AS BIGINT))/1e9 + 0e0 AS gb FROM x""")
def ag16_phase_costs(spark, sf_dir):
    """By phase, which a mark opens, and disk: the counters' change from the first sample to the last, cores, median and most memory.

    Samples of equal memory are summed up before the window that finds the median."""
    marks = F.sum(F.col("opens").cast("long")).over(_w("run").rowsBetween(Window.unboundedPreceding, 0))
    p = view(spark, sf_dir, "samples").withColumn("phase", marks).where("phase > 0")
    sample = F.struct("ts", "event_id", "cpu", "disks")
    m = p.groupBy("run", "phase", "mem").agg(F.count("*").alias("k"), F.min(sample).alias("a"), F.max(sample).alias("b"))
    own = Window.partitionBy("run", "phase")
    m = m.withColumn("n", F.sum("k").over(own)).withColumn("upto", F.sum("k").over(own.orderBy("mem").rowsBetween(Window.unboundedPreceding, 0)))
    g = m.groupBy("run", "phase").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min(F.when(F.expr("upto > n div 2"), F.col("mem"))).alias("median"), F.max("mem").alias("most"), F.max("n").alias("n"))
    micros = lambda side: F.unix_micros(F.col(f"{side}.ts").cast("timestamp"))
    cpu, span = F.col("b.cpu") - F.col("a.cpu"), F.greatest((micros("b") - micros("a")) / 1e6, F.lit(1e-9))
    disks = lambda side: F.str_to_map(f"{side}.disks", F.lit(";"), F.lit("="))
    g = g.select("run", "phase", cpu.alias("cpu"), F.round(cpu / span, 6).alias("cores"), "median", "most", "n", disks("a").alias("before"), F.explode(disks("b")).alias("disk", "after"))
    return g.select("run", "phase", "disk", "cpu", "cores", "median", "most", "n", ((F.col("after").cast("long") - F.col("before")[F.col("disk")].cast("long")) / 1e9).alias("gb")).where("gb IS NOT NULL")


#: Threads told of a load, and cores a thread must lose in it to count as slowed.
TOLD, SLOWED_BY = 2, 0.05


def thread_rates(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """(run, load, thread, inside, outside): cores of every thread during each load, and outside all loads of its run.

    ``samples``: run, thread, ts, event_id, cpu (a counter of core seconds); ``spans``: run, load, t0, t1 (seconds), which
    do not overlap. What a counter has counted up to a time is that of the last sample at or before it, else of the
    thread's first; both ends of all loads find theirs in one pass over the sorted samples.
    """
    s = samples.select("run", "thread", F.unix_micros("ts").alias("at"), "event_id", "cpu")
    s = s.groupBy("run", "thread", "at").agg(F.max_by("cpu", "event_id").alias("cpu"))
    whole = s.groupBy("run", "thread").agg(F.min_by("cpu", "at").alias("first"), F.min("at").alias("from"), F.max("at").alias("till"), F.max_by("cpu", "at").alias("last"))
    asked = whole.select("run", "thread").join(spans, "run").select("run", "thread", "load", "t0", "t1", F.explode(F.array("t0", "t1")).alias("edge"))
    asked = asked.withColumn("at", (F.col("edge") * 1_000_000).cast("long")).withColumn("key", F.concat_ws("/", F.col("run").cast("string"), "thread"))
    found = as_of(asked, s.withColumn("key", F.concat_ws("/", F.col("run").cast("string"), "thread")).drop("run", "thread"), "key", "at", ["cpu"])
    during = found.join(whole, ["run", "thread"]).withColumn("cpu", F.coalesce("cpu", "first")).groupBy("run", "thread", "load", "t0", "t1").agg((F.max("cpu") - F.min("cpu")).alias("used"))
    sums = during.groupBy("run", "thread").agg(F.sum("used").alias("used_all"), F.sum(F.col("t1") - F.col("t0")).alias("s_all"))
    left = (F.col("till") - F.col("from")) / 1e6 - F.col("s_all")
    rest = sums.join(whole, ["run", "thread"]).select("run", "thread", F.when(left > 0, F.greatest(F.col("last") - F.col("first") - F.col("used_all"), F.lit(0)) / left).otherwise(0.0).alias("outside"))
    inside = F.when(F.col("t1") > F.col("t0"), F.col("used") / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    return during.select("run", "load", "thread", inside.alias("inside")).join(rest, ["run", "thread"])


# A thread's counter grows with the number of its samples; loads begin at every fortieth sample of a run and last four hours.
VIEWS["cores"] = ("events", ["user_id AS run", "ts", "event_id", "CAST(event_id AS DOUBLE)*(1+event_id%4*3)*(1+user_id%3) AS cpu", "concat('t', CAST(event_id%4 AS VARCHAR(4))) AS thread"])


@query(cte("cores") + f""", p AS (SELECT run, epoch(ts) AS t0, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS i FROM cores), sp AS (SELECT run, i//40 AS load, floor(t0) AS t0, least(floor(t0)+14400, coalesce(lead(floor(t0)) OVER (PARTITION BY run ORDER BY i), 1e18)) AS t1 FROM p WHERE i%40 = 1),
s AS (SELECT run, thread, epoch(ts) AS tt, arg_max(cpu, event_id) AS cpu FROM cores GROUP BY ALL), w AS (SELECT run, thread, arg_min(cpu, tt) AS first, min(tt) AS a, max(tt) AS b, arg_max(cpu, tt) AS last FROM s GROUP BY ALL),
u AS (SELECT w.run, w.thread, load, t0, t1, first, abs(coalesce((SELECT arg_max(cpu, tt) FROM s WHERE s.run = w.run AND s.thread = w.thread AND tt <= t1), first) - coalesce((SELECT arg_max(cpu, tt) FROM s WHERE s.run = w.run AND s.thread = w.thread AND tt <= t0), first)) AS used FROM w JOIN sp ON sp.run = w.run),
o AS (SELECT run, thread, sum(used) AS ua, sum(t1-t0) AS sa FROM u GROUP BY ALL), r AS (SELECT u.run, u.load, u.thread, used/(t1-t0) AS inside, CASE WHEN b-a-sa > 0 THEN greatest(last-w.first-ua, 0)/(b-a-sa) ELSE 0 END AS outside FROM u JOIN o USING (run, thread) JOIN w USING (run, thread)),
k AS (SELECT 'busiest' AS what, *, row_number() OVER (PARTITION BY run, load ORDER BY round(inside, 9) DESC, thread) AS rank FROM r WHERE inside > 0 UNION ALL SELECT 'slowed', *, row_number() OVER (PARTITION BY run, load ORDER BY round(inside-outside, 9), thread) FROM r WHERE inside < outside - {SLOWED_BY})
SELECT what, run, load, rank, thread, round(inside, 6) AS inside, round(outside, 6) AS outside FROM k WHERE rank <= {TOLD}""")
def ag17_thread_rates(spark, sf_dir):
    """By load the busiest threads, and those that it slows most."""
    c = view(spark, sf_dir, "cores").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_seconds("ts").cast("double")
    marks = c.select("run", at.alias("t0"), F.row_number().over(_w("run")).alias("i")).where("i%40 = 1")
    end = F.least(F.col("t0") + 14400, F.coalesce(F.lead("t0").over(Window.partitionBy("run").orderBy("i")), F.lit(1e18)))
    spans = marks.select("run", F.expr("bigint(i div 40)").alias("load"), "t0", end.alias("t1"))
    r = thread_rates(c, spans)
    place = lambda by: F.row_number().over(Window.partitionBy("run", "load").orderBy(by, "thread")).cast("long").alias("rank")
    busy = r.where("inside > 0").select(F.lit("busiest").alias("what"), "*", place(F.desc(F.round("inside", 9))))
    slow = r.where(F.col("inside") < F.col("outside") - SLOWED_BY).select(F.lit("slowed").alias("what"), "*", place(F.round(F.col("inside") - F.col("outside"), 9)))
    return busy.unionByName(slow).where(F.col("rank") <= TOLD).select("what", "run", "load", "rank", "thread", F.round("inside", 6).alias("inside"), F.round("outside", 6).alias("outside"))


@query(cte("samples") + "SELECT run, min(mem) AS least_free, max(cpu) AS worst_pressure, max(mem*2) AS most_swap FROM samples GROUP BY run")
def ag18_worst_readings(spark, sf_dir):
    return view(spark, sf_dir, "samples").groupBy("run").agg(F.min("mem").alias("least_free"), F.max("cpu").alias("worst_pressure"), (F.max("mem") * 2).alias("most_swap"))


@query(cte("frames") + "SELECT metric, round(max(v) FILTER (run = 1), 4) AS r1, round(max(v) FILTER (run = 2), 4) AS r2, round(max(v) FILTER (run = 3), 4) AS r3 FROM (SELECT run, unnest(['frames', 'mean', 'most']) AS metric, unnest([count(*)::DOUBLE, avg(frame_ms), max(frame_ms)]) AS v FROM frames WHERE run IN (1, 2, 3) GROUP BY run) GROUP BY metric")
def ag19_campaign_table(spark, sf_dir):
    """Runs side by side: the campaign names three of them."""
    m = view(spark, sf_dir, "frames").where("run IN (1, 2, 3)").groupBy("run").agg(F.count("*").cast("double").alias("n"), F.avg("frame_ms").alias("a"), F.max("frame_ms").alias("m"))
    long = m.select(F.concat(F.lit("r"), F.col("run").cast("string")).alias("run"), F.expr("stack(3, 'frames', n, 'mean', a, 'most', m) AS (metric, v)"))
    return long.groupBy("metric").pivot("run", ["r1", "r2", "r3"]).agg(F.round(F.max("v"), 4))


@query(cte("transfers") + ", r AS (SELECT code, time_total AS t, row_number() OVER (PARTITION BY code ORDER BY time_total, event_id) AS i, count(*) OVER (PARTITION BY code) AS n FROM transfers) SELECT code, count(*) AS n, min(t) AS least, round(avg(t), 6) AS mean, max(t) FILTER (i = ceil(0.5e0*n)) AS p50, max(t) FILTER (i = ceil(0.9e0*n)) AS p90, max(t) FILTER (i = ceil(0.99e0*n)) AS p99, max(t) AS most FROM r GROUP BY code")
def ag20_latency_summary(spark, sf_dir):
    """Nearest-rank percentiles from counts of equal times: a code's times are summed up before they meet in one window."""
    t = view(spark, sf_dir, "transfers").groupBy("code", F.col("time_total").alias("t")).agg(F.count("*").alias("k"))
    code = Window.partitionBy("code")
    r = t.withColumn("n", F.sum("k").over(code)).withColumn("upto", F.sum("k").over(code.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(p * F.col("n")), F.col("t")))
    return r.groupBy("code").agg(F.max("n").alias("n"), F.min("t").alias("least"), F.round(F.sum(F.col("t") * F.col("k")) / F.max("n"), 6).alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("t").alias("most"))


@query(cte("transfers") + "SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, round(sum(bytes)/1e6, 4) AS mb FROM transfers GROUP BY 1")
def ag21_rate_buckets(spark, sf_dir):
    w = view(spark, sf_dir, "transfers").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("requests"), F.round(F.sum("bytes") / 1e6, 4).alias("mb"))
    return w.select(F.col("window.start").alias("hour"), "requests", "mb")


@query(cte("transfers") + ", m AS (SELECT code, quantile_disc(time_total, 0.5) AS mid FROM transfers GROUP BY code), t AS (SELECT t.*, mid, row_number() OVER (PARTITION BY code ORDER BY time_total DESC, event_id) AS rn FROM transfers t JOIN m USING (code)) SELECT code, event_id, time_total, time_total > 3*mid AS straggler FROM t WHERE rn <= 8")
def ag22_straggler_report(spark, sf_dir):
    """The eight slowest of a code, and whether they pass three medians."""
    t = view(spark, sf_dir, "transfers")
    counts = t.groupBy("code", "time_total").agg(F.count("*").alias("k"))
    code = Window.partitionBy("code")
    upto = counts.withColumn("n", F.sum("k").over(code)).withColumn("upto", F.sum("k").over(code.orderBy("time_total").rowsBetween(Window.unboundedPreceding, 0)))
    mid = upto.where("upto >= ceil(n * 0.5)").groupBy("code").agg(F.min("time_total").alias("mid"))
    slow = t.withColumn("rn", F.row_number().over(code.orderBy(F.desc("time_total"), "event_id"))).where("rn <= 8")
    return slow.join(mid, "code").select("code", "event_id", "time_total", (F.col("time_total") > 3 * F.col("mid")).alias("straggler"))


@query(cte("fixes") + ", d AS (SELECT *, least(10.0e0, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY aircraft ORDER BY ts, event_id))) AS dt, CASE WHEN agl_m >= 3048 THEN 'high' ELSE 'low' END AS phase FROM fixes) SELECT aircraft, phase, round(sum(coalesce(dt, 0))/60, 3) AS minutes, round(sum(coalesce(dt, 0)) FILTER (gs_ms > 50)/60, 3) AS away_minutes, round(max(gs_ms), 4) AS farthest, min(agl_m) AS lowest FROM d GROUP BY ALL")
def ag31_camera_phases(spark, sf_dir):
    w = Window.partitionBy("aircraft").orderBy("ts", "event_id")
    dt = F.least(F.lit(10.0), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))) / 1e6)
    d = view(spark, sf_dir, "fixes").withColumn("dt", F.coalesce(dt, F.lit(0.0))).withColumn("phase", F.when(F.col("agl_m") >= 3048, "high").otherwise("low"))
    return d.groupBy("aircraft", "phase").agg(F.round(F.sum("dt") / 60, 3).alias("minutes"), F.round(F.sum(F.when(F.col("gs_ms") > 50, F.col("dt"))) / 60, 3).alias("away_minutes"), F.round(F.max("gs_ms"), 4).alias("farthest"), F.min("agl_m").alias("lowest"))


@query(cte("pixels") + ", g AS (SELECT cloud, px//32 AS block, abs(here - lag(here) OVER w) AS a, abs(src - lag(src) OVER w) AS b FROM pixels WINDOW w AS (PARTITION BY cloud ORDER BY px)) SELECT cloud, block, round(avg(a), 4) AS own, round(avg(b), 4) AS other, bool_or(a <> b) AS differs FROM g GROUP BY ALL")
def ag34_sharpness(spark, sf_dir):
    w = Window.partitionBy("cloud").orderBy("px")
    step = lambda n: F.abs(F.col(n) - F.lag(n).over(w))
    g = view(spark, sf_dir, "pixels").select("cloud", F.expr("px div 32").alias("block"), step("here").alias("a"), step("src").alias("b"))
    return g.groupBy("cloud", "block").agg(F.round(F.avg("a"), 4).alias("own"), F.round(F.avg("b"), 4).alias("other"), F.bool_or(F.col("a") != F.col("b")).alias("differs"))


@query(cte("loads") + ", m AS (SELECT run, min(ts) FILTER (event_type = 'signup') AS s, max(ts) FILTER (event_type = 'signup') AS e FROM loads GROUP BY run) SELECT m.run, date_diff('second', s, e) AS loading, date_diff('second', e, min(ts) FILTER (ts > e)) AS running FROM m JOIN loads l ON l.run = m.run GROUP BY m.run, s, e")
def ag47_start_split(spark, sf_dir):
    """From the first mark to the last, and on to the first line after it."""
    l, run = view(spark, sf_dir, "loads"), Window.partitionBy("run")
    mark = F.when(F.col("event_type") == "signup", F.col("ts"))
    m = l.withColumn("s", F.min(mark).over(run)).withColumn("e", F.max(mark).over(run))
    sec = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    return m.groupBy("run").agg((sec(F.max("e")) - sec(F.max("s"))).alias("loading"), (sec(F.min(F.when(F.col("ts") > F.col("e"), F.col("ts")))) - sec(F.max("e"))).alias("running"))


@query(cte("samples") + ", d AS (SELECT run, thread, event_id, (cpu - lag(cpu) OVER w)/nullif(epoch(ts) - epoch(lag(ts) OVER w), 0) AS rate FROM samples WINDOW w AS (PARTITION BY run, thread ORDER BY ts, event_id)) SELECT run, thread, event_id, round(rate, 5) AS rate FROM d WHERE rate > 0.05e0")
def ag48_busy_processes(spark, sf_dir):
    w = _w("run", "thread")
    dt = F.nullif((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))) / 1e6, F.lit(0.0))
    d = view(spark, sf_dir, "samples").withColumn("rate", (F.col("cpu") - F.lag("cpu").over(w)) / dt)
    return d.where(F.col("rate") > 0.05).select("run", "thread", "event_id", F.round("rate", 5).alias("rate"))


@query(cte("fixes") + "SELECT DISTINCT aircraft, CAST(a AS BIGINT) AS tlat, CAST((b+180+360)%360-180 AS BIGINT) AS tlon FROM fixes, LATERAL (SELECT unnest([-1, 0, 1]) AS i), LATERAL (SELECT unnest([-2, -1, 0, 1]) AS j), LATERAL (SELECT unnest([-0.25e0, 0.25e0]) AS h), LATERAL (SELECT unnest([-0.25e0, 0.25e0]) AS k), LATERAL (SELECT floor(lat+h)+i AS a, floor(lon+k+0.5e0)+j AS b)")
def st8_window_tiles(spark, sf_dir):
    """Tiles that may be held round a position: rows and columns at either end of the lag."""
    span = lambda low, high: F.explode(F.sequence(low.cast("long"), high.cast("long")))
    rows = span(F.floor(F.col("lat") - 0.25) - 1, F.floor(F.col("lat") + 0.25) + 1)
    cols = span(F.floor(F.col("lon") + 0.25) - 2, F.floor(F.col("lon") + 0.75) + 1)
    t = view(spark, sf_dir, "fixes").withColumn("tlat", rows).withColumn("b", cols)
    return t.select("aircraft", "tlat", geo.lon_wrap("b").cast("long").alias("tlon")).distinct()


@query(cte("fixes") + ", q AS (SELECT *, 1+event_id%7 AS pieces, gs_ms AS urgency FROM fixes), r AS (SELECT *, row_number() OVER w AS rn, sum(pieces) OVER (PARTITION BY aircraft ORDER BY urgency, event_id ROWS UNBOUNDED PRECEDING) AS upto FROM q WINDOW w AS (PARTITION BY aircraft ORDER BY urgency, event_id)) SELECT aircraft, event_id, CAST(upto AS BIGINT) AS upto FROM r WHERE rn = 1 OR upto <= 40")
def tk4_queue(spark, sf_dir):
    """The next work by urgency up to a budget of pieces; the first is always taken."""
    w = Window.partitionBy("aircraft").orderBy("gs_ms", "event_id")
    q = view(spark, sf_dir, "fixes").withColumn("rn", F.row_number().over(w)).withColumn("upto", F.sum(F.expr("1+event_id%7")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return q.where("rn = 1 OR upto <= 40").select("aircraft", "event_id", "upto")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, quantile_disc(value, 0.5) AS median FROM events GROUP BY user_id")
def ud3_nearest_rank(spark, sf_dir):
    """Nearest-rank median from counts of equal values, so that no user's events are gathered in one row."""
    t = table(spark, sf_dir, "events").groupBy("user_id", "value").agg(F.count("*").alias("k"))
    user, known = Window.partitionBy("user_id"), F.when(F.col("value").isNotNull(), F.col("k")).otherwise(0)
    r = t.withColumn("n", F.sum("k").over(user)).withColumn("valued", F.sum(known).over(user))
    r = r.withColumn("upto", F.sum(known).over(user.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("user_id").agg(F.max("n").alias("n"), F.min(F.when(F.col("upto") >= F.ceil(F.col("valued") / 2), F.col("value"))).alias("median"))
