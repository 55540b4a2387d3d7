"""Joins that Spark has no name for: range, nearest, as-of, connected components; small groups by the stream."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(low: Column, high: Column, size: float) -> Column:
    """Numbers of the grid cells that an interval meets."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def box_join(a: DataFrame, b: DataFrame, size: float, box_a: tuple, box_b: tuple) -> DataFrame:
    """Pairs of rows whose boxes (west, south, east, north) meet, touching counted in.

    Both sides are laid on a grid of ``size``; a pair that shares several cells is kept in the cell of its
    common south-west corner alone, so no distinct is needed. Choose ``size`` near the larger boxes' size:
    a cell then holds few rows of either side.
    """
    wa, sa, ea, na = (F.col(x) for x in box_a)
    wb, sb, eb, nb = (F.col(x) for x in box_b)
    a = a.withColumn("_cx", F.explode(cells(wa, ea, size))).withColumn("_cy", F.explode(cells(sa, na, size)))
    b = b.withColumn("_cx", F.explode(cells(wb, eb, size))).withColumn("_cy", F.explode(cells(sb, nb, size)))
    meet = (wa <= eb) & (wb <= ea) & (sa <= nb) & (sb <= na)
    own = (F.floor(F.greatest(wa, wb) / size) == F.col("_cx")) & (F.floor(F.greatest(sa, sb) / size) == F.col("_cy"))
    return a.join(b, ["_cx", "_cy"]).where(meet & own).drop("_cx", "_cy")


def as_of(left: DataFrame, right: DataFrame, by: str, on: str, values: Iterable[str], forward: bool = False) -> DataFrame:
    """Each left row with the last right row at or before it (``forward``: the first at or after it).

    One shuffle and one pass: both sides are united and a window carries the values over.
    """
    values = list(values)
    marked = left.withColumn("_side", F.lit(1)).unionByName(right.select(by, on, *values).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    frame = Window.partitionBy(by)
    if forward:
        frame = frame.orderBy(F.col(on).desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    else:
        frame = frame.orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.last(F.when(F.col("_side") == 0, F.struct(on, *values)), ignorenulls=True).over(frame)
    return marked.withColumn("_hit", packed).where("_side = 1").drop("_side", *values).select("*", *(F.col(f"_hit.{v}").alias(v) for v in values), F.col(f"_hit.{on}").alias(f"matched_{on}")).drop("_hit")


def first_in_budget(rows: DataFrame, by: str, order: list[str], size: str, budgets: DataFrame) -> DataFrame:
    """Rows of each key, in the order of the columns, as long as the sizes before a row sum up to less than the budget.

    ``budgets``: key, budget. Sizes are summed by the first column alone; a running sum over its values finds the
    one in which the budget ends, and only rows of that value are summed by the next column, and so on. So no
    task orders a key's rows, however few the keys are; put a coarse column (a day, a block of numbers) first. The
    columns together tell rows apart. What comes out is a filter on the rows: at or before the last row inside.
    """
    state, at = written(budgets.toDF(by, "left"), "budgets"), []
    for i, column in enumerate(order):
        inside = rows.join(state.select(by, *(F.col(f"e{k}").alias(order[k]) for k in range(i))), [by, *order[:i]], "left_semi") if i else rows
        sums = inside.groupBy(by, column).agg(F.sum(size).alias("s"))
        before = F.coalesce(F.sum("s").over(Window.partitionBy(by).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = sums.withColumn("before", before).join(state, by).where("before < left")
        last = ends.groupBy(by, *at).agg(F.max(F.struct(column, "before", "left")).alias("m"))
        state = written(last.select(by, *at, F.col(f"m.{column}").alias(f"e{i}"), (F.col("m.left") - F.col("m.before")).alias("left")), "budget-ends")
        at.append(f"e{i}")
    inside = F.lit(True)
    for column, edge in reversed(list(zip(order, at))):
        inside = (F.col(column) < F.col(edge)) | ((F.col(column) == F.col(edge)) & inside)
    return rows.join(state.drop("left"), by).where(inside).drop(*at)


def rows_at(rows: DataFrame, by: str, on: str, block: int, places: Callable[[Column], Column]) -> DataFrame:
    """Rows of each key that stand at certain places of its order by ``on`` (whole numbers, unique in a key).

    ``places``: from a key's number of rows to an array of places from 0. Rows are counted by blocks of ``block``
    numbers; only those of blocks that hold a place are put in order.
    """
    counts = written(rows.groupBy(by, F.expr(f"{on} div {block}").alias("_block")).agg(F.count("*").alias("n")), "block-counts")
    upto = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = counts.groupBy(by).agg(places(F.sum("n")).alias("_places"))
    held = counts.withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(total, by)
    inside = F.filter("_places", lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("n")))
    held = written(held.select(by, "_block", "_before", inside.alias("_places")).where(F.size("_places") > 0), "block-places")
    own = rows.withColumn("_block", F.expr(f"{on} div {block}")).join(held, [by, "_block"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(by, "_block").orderBy(on)) - 1
    return own.withColumn("_at", place).where(F.array_contains("_places", F.col("_at"))).drop("_block", "_before", "_places", "_at")


def in_groups(rows: DataFrame, by: list[str], order: list[str], step: Callable[[dict], dict], schema: str) -> DataFrame:
    """``step`` on each group's columns (arrays, in order): a grouped map for very many small groups.

    A window sorts the groups and marks where each begins; a task then cuts its batches there. So a group costs
    slices of arrays, not a batch of its own on the way to Python, and a task holds one batch and the group that
    goes on. The number of tasks is fixed: small rows may be much work, which their bytes don't tell the planner.
    Nulls of a number column come as NaN.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1

    def joined(pieces: list[dict]) -> dict:
        return {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for frame in frames:
            columns = {c: frame[c].to_numpy() for c in frame}
            edges = [*np.flatnonzero(columns.pop("_first")), len(frame)]
            part = lambda a, b: {c: v[a:b] for c, v in columns.items()}  # noqa: B023, E731
            if edges[0]:
                held.append(part(0, edges[0]))
            ended = [joined(held)] if held and len(edges) > 1 else []
            ended += [part(a, b) for a, b in pairwise(edges[:-1])]
            if len(edges) > 1:
                held = [part(*edges[-2:])]
            if ended:
                out = list(map(step, ended))
                yield pd.DataFrame({c: list(chain.from_iterable(o[c] for o in out)) for c in out[0]})
        if held:
            yield pd.DataFrame(step(joined(held)))

    return rows.repartition(parts, *by).withColumn("_first", first).mapInPandas(run, schema)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out to as many tasks as a shuffle has, by key: for few small rows, of one file, that become many or much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def shared_dir(df: DataFrame, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one in local runs that have none."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark._skyquilt_tmp = getattr(spark, "_skyquilt_tmp", None) or tempfile.mkdtemp(prefix="skyquilt-")
    return f"{root.rstrip('/')}/skyquilt/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives lost executors."""
    path = shared_dir(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that links reach, for every node of ``links`` but the roots themselves.

    In a round every node goes over to one of itself and its neighbours, the first in an order drawn anew by a
    hash, and links are drawn anew between the nodes that are left. On a path that halves the nodes, on denser
    graphs it leaves fewer, so tables shrink from round to round and rounds grow with the logarithm of the nodes.
    Every step is written, so a lost executor costs one step, and the joins back have plain exchanges on both
    sides, which lets the adaptive planner split a node with very many links.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(low, high).distinct(), "links")
    steps = []
    while True:
        place = lambda n: F.struct(F.xxhash64(F.lit(len(steps)), n).alias("h"), F.col(n).alias("n"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        steps.append(written(both.groupBy("a").agg(F.least(place("a"), F.min(place("b"))).alias("p")).select("a", F.col("p.n").alias("m")), "first"))
        moved = edges.join(steps[-1], "a").select("b", F.col("m").alias("c")).join(steps[-1].withColumnRenamed("a", "b"), "b")
        edges = written(moved.select(F.col("c").alias("a"), F.col("m").alias("b")).where("a <> b").select(low, high).distinct(), "links")
        if edges.isEmpty():
            break
    named = steps.pop()
    while steps:
        named = steps.pop().join(named.toDF("m", "name"), "m", "left").select("a", F.coalesce("name", "m").alias("m"))
        if len(steps) % 3 == 0:
            named = written(named, "named")
    roots = named.groupBy("m").agg(F.min("a").alias("root"))
    return named.join(roots, "m").where("a <> root").select(F.col("a").alias("node"), "root")


def ranked(links: DataFrame) -> DataFrame:
    """(node, first, place, closed): where every node stands in its chain or loop, counted from 0.

    ``links``: node, next (null where a chain ends); each node follows one other at most. A chain begins at the node
    that follows none, a loop at its smallest. By pointer doubling: in every round a node looks twice as far, so
    rounds grow with the logarithm of the longest, and no task ever holds a chain. First nodes look ahead: those whose
    sight ends stand on chains and leave; when the smallest node in sight changes for none of the rest, it is that of
    the loop. Loops are cut there, and nodes look back, adding up places, until they see a first one.
    """
    at = written(links.where("next IS NOT NULL").select("node", F.col("next").alias("to"), F.col("node").alias("low")), "ahead")
    rows = at.count()
    while rows:
        seen = at.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        new = written(at.join(seen, "to").select("node", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")), "ahead")
        before, (rows, moved) = rows, new.agg(F.count("*"), F.coalesce(F.count_if("moved"), F.lit(0))).first()
        at = new
        if rows == before and not moved:
            break
    loops = at.select("node", F.col("low").alias("cut"))
    back = links.where("next IS NOT NULL").select(F.col("next").alias("node"), F.col("node").alias("back"))
    own = links.select("node").join(back, "node", "left").join(loops, "node", "left")
    head = F.col("back").isNull() | F.coalesce(F.col("node") == F.col("cut"), F.lit(False))
    state = written(own.select("node", F.when(head, F.col("node")).otherwise(F.col("back")).alias("first"), F.when(head, 0).otherwise(1).cast("long").alias("place"), head.alias("done"), F.col("cut").isNotNull().alias("closed")), "back")
    ended, live = [state.where("done")], state.where("NOT done")
    while not live.isEmpty():
        every = live.select("node", "first", "place", "done")
        for part in ended:
            every = every.unionByName(part.select("node", "first", "place", "done"))
        seen = every.toDF("first", "first2", "place2", "done2")
        state = written(live.join(seen, "first").select("node", F.col("first2").alias("first"), (F.col("place") + F.col("place2")).alias("place"), F.col("done2").alias("done"), "closed"), "back")
        ended.append(state.where("done"))
        live = state.where("NOT done")
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out.select("node", "first", "place", "closed")
