"""Documents of bounded size, and aggregates that gather no group in one row."""

import hashlib
import json

import pyarrow as pa
import pytest

from skyquilt import catalog
from skyquilt.fixtures import view
from skyquilt.plans import maps, planning, scalar
from skyquilt.sources import queries

QUERIES = catalog.queries()


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "shared_dir", lambda df, name: f"{tmp_path}/{name}")
    return tmp_path


def test_documents_are_bounded(spark, sf_dir, folder, monkeypatch):
    monkeypatch.setattr(queries, "LOT", 200)
    QUERIES["src2_read_osm_json"](spark, sf_dir)
    sizes = [len(json.loads(line)["elements"]) for f in folder.glob("osm/part-*") for line in f.read_text().splitlines()]
    assert len(sizes) > 3 and max(sizes) <= 400
    QUERIES["src3_read_osm_xml"](spark, sf_dir)
    texts = [f.read_text() for f in folder.glob("osmxml/part-*")]
    assert all(t.count("<osm>") == 1 and t.strip().endswith("</osm>") for t in texts)
    assert max(t.count("<node ") + t.count("<way ") for t in texts) <= 400
    assert sum(t.count("<node ") + t.count("<way ") for t in texts) == sum(sizes)


def test_plans_are_bounded(spark, sf_dir, folder, monkeypatch):
    monkeypatch.setattr(queries, "LOT", 2)
    n = QUERIES["src10_read_flight_plan"](spark, sf_dir).where("form = 'fms'").count()
    sizes = [f.read_text().count("\n1 AP") for f in folder.glob("plans/fms/part-*")]
    assert max(sizes) <= 4 and sum(sizes) == 2 * n


def test_digest_gathers_no_group(spark, sf_dir):
    assert "collect_list" not in QUERIES["sc42_element_digest"](spark, sf_dir)._jdf.queryExecution().toString()
    own = [("a", "1"), ("a", "2"), ("a", "3"), ("b", "4")]
    batches = [pa.RecordBatch.from_pydict({"brand": [b for b, _ in p], "d": [d for _, d in p]}) for p in (own[:1], own[1:])]
    got = [r for b in scalar.group_digests(iter(batches)) for r in b.to_pylist()]
    assert [(r["brand"], r["digest"]) for r in got] == [("a", hashlib.sha256(b"123").hexdigest()), ("b", hashlib.sha256(b"4").hexdigest())]


def test_median_gathers_no_group(spark, sf_dir):
    assert "collect_list" not in QUERIES["ud3_nearest_rank"](spark, sf_dir)._jdf.queryExecution().toString()


def test_all_texts_and_names_are_written(spark, sf_dir, folder):
    QUERIES["snk4_write_terrain_text"](spark, sf_dir)
    texts = sorted(line for f in folder.glob("terrain/*/part-*") for line in f.read_text().splitlines())
    want = view(spark, sf_dir, "built").select("til_x", "til_y", "kind").distinct().collect()
    assert texts == sorted(f"TEX {r.til_x} {r.til_y} {r.kind}" for r in want)
    assert max(r.til_x for r in want) >= 320
    QUERIES["src8_read_texture_names"](spark, sf_dir)
    names = view(spark, sf_dir, "chunks").selectExpr("x div 256", "y div 256", "provider").distinct()
    assert sum(len(f.read_text().splitlines()) for f in folder.glob("names/part-*")) == 2 * names.count()


def test_pieces_of_a_provider_are_many_tasks(spark, sf_dir, folder):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        QUERIES["src7_read_chunks"](spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len({f.name.split("-")[1] for f in folder.glob("chunks/provider=EOX/*/part-*")}) > 1


def test_clipping_is_planned_once(spark, sf_dir):
    """A filter on the area would copy the whole cut into itself, and again for each corner."""
    assert QUERIES["ar4_clip_to_tile"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2


def test_legs_are_dealt_out(spark, sf_dir):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert planning.legs(spark, sf_dir).rdd.getNumPartitions() == parts
    assert planning.corridor(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(leg") == 1


def test_lamps_look_once(spark, sf_dir):
    """A lamp is one row of one join with the posts round it, and is not dealt out again by way and number."""
    plan = QUERIES["ag41_night_lamps"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [way#" in line and "nth#" in line.split("]")[0]]
    assert plan.count("Join LeftOuter") == 1


def test_corners_are_met_once(spark, sf_dir):
    """Both aggregates read triangles that have their corners; neither joins them anew."""
    assert QUERIES["ag7_mesh_measures"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


@pytest.mark.parametrize(("name", "most"), [("jn3_triangle_corners", 7), ("jn4_assign_textures", 6)])
def test_joins_carry_sums_of_corners(spark, sf_dir, name, most):
    """What a join with nodes takes from the triangles' side holds one corner's columns, however many are met."""
    todo, wide = [QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            wide.append(children[0].output().size())
        todo += children
    assert len(wide) >= 3 and max(wide) <= most


def test_samples_along_ways_are_no_rows(spark, sf_dir):
    """A way's points are dealt out once, by way, and only points and the pieces between them become rows, however fine the samples are."""
    plan = QUERIES["wn14_smooth_along"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(way") == 1 and "sequence(" not in plan
    ways = [(w, i, i * 1000.0, w * 1.0, 10.0 * (i % 2)) for w in range(3) for i in range(4)]
    own = spark.createDataFrame(ways, "way long, pos long, x double, y double, alt double")
    got = maps.smooth_along(own, "way", ["pos"], 1e-6, 500.0).where("way = 1").orderBy("pos").collect()  # three thousand million samples a way
    assert [round(r["smooth"], 4) for r in got] == [1.25, 8.75, 1.25, 8.75]
