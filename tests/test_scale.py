"""Operators that work block by block, square by square or piece by piece against brute force, with blocks small enough to be cut."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.functions import distance
from graphloom.operators import blocks, components, curate, geometry, graph, labels, metrics, nearest, places, raster
from graphloom.scratch import new_path, saved
from graphloom.sources import documents, readers, sinks
from graphloom.streaming.annotations import benchmarks_so_far, stream_benchmarks

# -- kernels ---------------------------------------------------------------------------------------------------------------------------------


def table_distance(a, b, costs):
    row = [0.0]
    for y in b:
        row.append(row[-1] + costs.insert.get(y, 1.0))
    for x in a:
        new = [row[0] + costs.delete.get(x, 1.0)]
        for j, y in enumerate(b):
            swap = 0.0 if x == y else costs.substitute.get(x, {}).get(y, 1.0)
            new.append(min(row[j + 1] + costs.delete.get(x, 1.0), new[j] + costs.insert.get(y, 1.0), row[j] + swap))
        row = new
    return row[-1]


def table_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("area", [2_000_000, 300])
def test_kernels_of_many_pairs(area, monkeypatch):
    monkeypatch.setattr(distance, "AREA", area)
    rng = random.Random(area)
    text = lambda n: "".join(rng.choice("abO0CcH8Be.2 é(😀") for _ in range(n))
    a = [text(rng.randint(0, 12)) for _ in range(300)] + ["", text(90), text(40), ""]
    b = [text(rng.randint(0, 12)) for _ in range(300)] + ["", text(70), text(101), "abc"]
    for costs in (distance.READER_COSTS, distance.UNIT_COSTS):
        assert distance.edit_distances(a, b, costs) == pytest.approx([table_distance(x, y, costs) for x, y in zip(a, b, strict=True)])
    assert distance.common_subsequences(a, b).tolist() == [table_subsequence(x, y) for x, y in zip(a, b, strict=True)]
    grams = lambda t, n: Counter(t[i : i + n] for i in range(len(t) - n + 1))
    assert distance.gram_matches(a, b, 4).tolist() == [[sum((grams(x, n) & grams(y, n)).values()) for n in (1, 2, 3, 4)] for x, y in zip(a, b, strict=True)]
    assert len(distance.edit_distances([], [])) == len(distance.common_subsequences([], [])) == len(distance.gram_matches([], [], 4)) == 0


# -- dictionaries ----------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weighted", [True, False])
def test_spelling_of_a_whole_table(spark, weighted):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("CHO2N0o3Bn8(.)") for _ in range(rng.randint(0, 9)))
    entries = sorted({word() for _ in range(150)} | {"C" * 70, "", "OEt", "0Et"})
    dictionary = [(e, rng.randint(1, 4), k) for k, e in enumerate(entries)]
    texts = [(t,) for t in {word() for _ in range(200)} | {"", "C" * 69 + "H", "C" * 80, "zzzz", "QEt", *entries[:20]}] + [(None,), ("OEt",)]
    got = labels.correct_spelling(spark.createDataFrame(texts, "text string"), spark.createDataFrame(dictionary, "entry string, population int, position int"), weighted)
    costs = distance.READER_COSTS if weighted else distance.UNIT_COSTS
    known, want = {e for e, _, _ in dictionary}, {}
    for (t,) in texts:
        want[t] = (t, None)
        if t is not None and t not in known:
            d, _, _, e = min((round(table_distance(t, e, costs), 6), -n, k, e) for e, n, k in dictionary)
            want[t] = (e, d)
    assert {r.text: (r.corrected, r.dist) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "Cross" not in plan and "NestedLoop" not in plan
    limit = 1.5
    near = labels.edit_candidates(spark.createDataFrame(texts, "text string"), spark.createDataFrame(dictionary, "entry string, population int, position int"), limit, weighted)
    pairs = {(t, e) for (t,) in texts if t is not None and t not in known for e in known if round(table_distance(t, e, costs), 6) < limit}
    assert {(r.text, r.entry) for r in near.collect()} == pairs


def test_bounds_are_never_above_the_distance():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeO0CcH8Be.2 (") for _ in range(rng.randint(0, 14)))
    for costs in (distance.READER_COSTS, distance.UNIT_COSTS):
        held = nearest.Entries.of([word() for _ in range(200)], costs)
        for text in [word() for _ in range(40)]:
            bounds = held.bounds(held.count([text])[0])
            assert all(b <= table_distance(text, e, costs) + 1e-9 for b, e in zip(bounds, held.texts, strict=True))


# -- points, boxes, links --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 6])
def test_nearest_by_widening_squares(spark, k):
    rng = random.Random(k)
    points = [("a", i, rng.randint(0, 900), rng.randint(0, 30)) for i in range(250)] + [("same", i, 5, 5) for i in range(40)] + [("two", 3, 0, 0), ("two", 9, 4000, 1), ("one", 0, 7, 7)]
    points += [("clump", i, rng.randint(0, 3), rng.randint(-3, 0)) for i in range(60)] + [("clump", 99, 100_000, -100_000)]
    kp = spark.createDataFrame(points, "image_id string, idx int, x int, y int")
    want = {}
    for image, b, x, y in points:
        lower = sorted((round(math.hypot(x - p, y - q), 6), e) for i, e, p, q in points if i == image and e < b)
        want |= {(image, b, rank): (e, d) for rank, (d, e) in enumerate(lower[:k], 1)}
    for most in (0, 100):
        got = geometry.nearest_lower(kp, k, most).collect()
        assert {(r.image_id, r.b, r["rank"]): (r.e, r.dist) for r in got} == want and len(got) == len(want)
    assert {tuple(r) for r in geometry.bond_size(kp, most=0).collect()} == {tuple(r) for r in geometry.bond_size(kp).collect()}


def links_of(seed, n):
    rng = random.Random(seed)
    links = [(rng.choice("xyz"), rng.randint(0, n), rng.randint(0, n)) for _ in range(n // 2)]
    return links + [("path", k, k + 1) for k in range(n)] + [("star", 0, k) for k in range(n)] + [("loop", 5, 5), ("big", 1, 2), ("big", 2**40, 2)]


@pytest.mark.parametrize(("most", "block"), [(None, 1_000_000), (3, 7), (1_000_000, 5)])
def test_components_of_images_of_any_size(spark, most, block, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
    links = links_of(most or 1, 60)
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, a, b in links:
        p, q = find((i, a)), find((i, b))
        up[max(p, q)] = min(p, q)
    got = components.components(spark.createDataFrame(links, "image_id string, a long, b long").repartition(3), most).collect()
    assert {(r.image_id, r.node): r.component for r in got} == {x: find(x)[1] for x in list(up)} and len(got) == len(up)


@pytest.mark.parametrize("most", [None, 10])
def test_merged_boxes_of_any_image(spark, most):
    rng = random.Random(6)
    boxes = [(rng.choice("abc"), i, x := rng.randint(-200, 900), y := rng.randint(0, 400), x + rng.randint(0, 60), y + rng.randint(0, 40)) for i in range(120)]

    def overlap(p, q):
        return max(p[0] - q[2], q[0] - p[2]) < 30 and p[1] < q[3] and q[1] < p[3]

    want = {}
    for image in "abc":
        now = {b[1]: b[2:] for b in boxes if b[0] == image}
        while True:
            pair = next(((a, b) for a in sorted(now) for b in sorted(now) if a < b and overlap(now[a], now[b])), None)
            if not pair:
                break
            p, q = now.pop(pair[0]), now.pop(pair[1])
            now[pair[0]] = (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))
        want |= {(image, k): v for k, v in now.items()}
    got = components.merge_boxes(spark.createDataFrame(boxes, "image_id string, box_id int, x0 int, y0 int, x1 int, y1 int"), most=most).collect()
    assert {(r.image_id, r.box_id): tuple(r)[2:] for r in got} == want


def test_maxima_by_blocks_and_by_joins(spark):
    rng = random.Random(8)
    cells = [(i, y, x, float(rng.randint(1, 4)), (y << 20) + x, rng.random() < 0.9) for i in "ab" for y in range(14) for x in range(14) if rng.random() < 0.8]
    df = spark.createDataFrame(cells, "image_id string, y int, x int, v double, cell long, open boolean")
    for n in (3, 5):
        assert sorted(map(tuple, raster._maxima(df, n).collect())) == sorted(map(tuple, raster._maxima(df, n, most=0).collect()))


def test_blocks_hold_whole_images(spark):
    rows = [(f"i{k % 7}", k) for k in range(500)]
    schema = "image_id string, n long, rows long"

    def count(table):
        import pyarrow as pa

        got = table.group_by("image_id").aggregate([("k", "count")])
        return pa.table({"image_id": got["image_id"], "n": got["k_count"], "rows": [table.num_rows] * got.num_rows})

    got = blocks.by_image(spark.createDataFrame(rows, "image_id string, k long").repartition(2), count, schema, block=40).collect()
    assert {r.image_id: r.n for r in got} == Counter(i for i, _ in rows) and len(got) == 7


@pytest.mark.parametrize("most", [0, 6, None])
def test_fragments_by_blocks_and_by_contraction(spark, most):
    rng = random.Random(12)
    nodes, edges, want = [], [], {}
    for k in range(8):
        here = set(rng.sample(range(9), rng.randint(1, 8)))
        links = [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randint(0, 6))]  # some to nodes that are not there
        part = {v: v for v in range(9)}
        for b, e in links:
            part = {v: part[b] if p == part[e] else p for v, p in part.items()}
        nodes += [(f"i{k}", v) for v in here]
        edges += [(f"i{k}", b, e) for b, e in links]
        want[f"i{k}"] = len({part[v] for v in here})
    nodes += [("nothing", None), (None, 1), (None, 2)]
    edges += [("no nodes", 1, 2)]
    frames = spark.createDataFrame(nodes, "image_id string, idx int"), spark.createDataFrame(edges, "image_id string, b int, e int")
    got = components.fragment_counts(*frames, most=most).collect()
    assert len(got) == 10 and {r.image_id: r.fragments for r in got} == want | {"nothing": 0, None: 2}


def test_status_goes_by_short_plans(spark, monkeypatch):
    joins = []

    def written(table, name):
        joins.append(table._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return saved(table, name)

    for module in (graph, components, blocks):
        monkeypatch.setattr(module, "saved", written)
    nodes = spark.createDataFrame([("a", k, 100 * k, 0, "R" if k == 1 else "C", "one") for k in range(4)], "image_id string, idx int, x int, y int, class string, text string")
    edges = spark.createDataFrame([("a", 0, 0, 1, "SINGLE"), ("a", 10, 2, 3, "SINGLE")], "image_id string, edge_id int, b int, e int, class string")
    boxes = spark.createDataFrame([("a", 0, 90, -5, 210, 5, "one")], "image_id string, box_id int, x0 int, y0 int, x1 int, y1 int, text string")
    frags = spark.createDataFrame([("one", 0, "N", 0)], "text string, pos int, symbol string, attach int")
    got = graph.molecule_status(nodes, edges, boxes, (frags, spark.createDataFrame([], "text string, p int, q int, class string")))
    assert [tuple(r) for r in got.collect()] == [("a", "merged")]
    assert max(joins) <= 16


def test_status_takes_texts_of_boxes(spark):
    # two parts until the two middle nodes, of different classes, are merged; what that node is called decides how it is expanded
    nodes = [(f"{kind}", k, 100 * k, 0, "C" if k % 2 else "O", None) for kind in ("split", "one", "unheard") for k in range(4)]
    edges = [(kind, 10 * b, b, b + 1, "SINGLE") for kind in ("split", "one", "unheard") for b in (0, 2)]
    boxes = [(kind, 0, 90, -5, 210, 5, kind) for kind in ("split", "one", "unheard")]
    frags = spark.createDataFrame([("split", 0, "C", 0), ("split", 1, "C", 1), ("one", 0, "N", 0)], "text string, pos int, symbol string, attach int")
    bonds = spark.createDataFrame([], "text string, p int, q int, class string")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = graph.molecule_status(frame(nodes, "image_id string, idx int, x int, y int, class string, text string"), frame(edges, "image_id string, edge_id int, b int, e int, class string"), frame(boxes, "image_id string, box_id int, x0 int, y0 int, x1 int, y1 int, text string"), (frags, bonds))
    # split apart again, the graph is accepted with its label as it is
    assert {r.image_id: r.status for r in got.collect()} == {"split": "unresolved", "one": "merged", "unheard": "merged"}


# -- places ----------------------------------------------------------------------------------------------------------------------------------


def test_places_within_hot_and_null_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, "", "x"]), rng.choice([None, *range(40)]), i) for i in range(900)] + [("hot", 5, -1)] * 200
    got = places.ranked(saved(spark.createDataFrame(rows, "g string, v int, i int"), "t").repartition(5), ["g"], ["v", "i"], "ranked").collect()
    want = {}
    for g, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        want.setdefault(g, []).append((v, i))
    assert sorted((str(r.g), r.place, str(r.v), r.i, r["size"]) for r in got) == sorted((str(g), k, str(v), i, len(x)) for g, x in want.items() for k, (v, i) in enumerate(x))


def test_slices_without_a_window_over_everything(spark):
    rows = spark.range(1000).select(((F.col("id") * 389) % 1000).alias("id"))
    got = curate.position_slice(rows, "id", 10, 15)
    assert sorted(map(tuple, got.collect())) == [(k, k) for k in range(11, 15)]
    assert curate.position_slice(rows.where("false"), "id", -1, 5).count() == 0


# -- documents -------------------------------------------------------------------------------------------------------------------------------


def test_json_of_one_document_in_pieces(spark, tmp_path):
    odd = ['a}b"{c\\', "[]", "", "x\\", "{", "}", '"', "\n", "é😀", 'images": [{']
    images = [{"width": 1, "height": 1, "image_filename": f"{k}{odd[k % len(odd)]}", "molfile_filename": "m", "smiles": odd[(k + 3) % len(odd)], "id": k, "license": 1, "date_captured": ""} for k in range(200)]
    notes = [{"image_id": k, "keypoints": [k, 2, 3], "iscrowd": 0} for k in range(0, 200, 2)]
    doc = {"info": {"description": "keypoints"}, "licenses": [{"id": 1, "name": "", "url": ""}], "images": images, "annotations": notes}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({**doc, "images": images[:3]}, indent=2, ensure_ascii=False))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("2000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = readers.read_coco(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        want = [(x["id"], x["image_filename"], x["smiles"], [x["id"], 2, 3]) for x in images + images[:3] if x["id"] % 2 == 0]
        assert sorted((r.image_id, r.image_filename, r.smiles, r.keypoints) for r in got) == sorted(want)
    scores = {t or "empty": {"correct": k % 2 == 0, "n": None if k == 3 else k, "names": [t, "x"]} for k, t in enumerate(odd)}
    (tmp_path / "map").mkdir()
    (tmp_path / "map" / "c.json").write_text(json.dumps(scores))
    (tmp_path / "map" / "d.json").write_text("{}")
    got = readers.read_score_map(spark, str(tmp_path / "map"), "correct:boolean,n:bigint,names:array<string>").collect()
    assert {r.image_id: {"correct": r.correct, "n": r.n, "names": r.names} for r in got} == scores


def test_written_documents_are_json_of_bounded_size(spark):
    rows = spark.range(500).select(F.col("id").alias("image_id"), (F.col("id") % 3 == 0).alias("good"), F.concat(F.lit('a"}\\'), F.col("id").cast("string")).alias("name"))
    path = new_path(spark, "maps")
    sinks.write_score_map(rows.withColumn("image_id", F.concat(F.lit('k"'), F.col("image_id").cast("string"))), path, document_bytes=5000)
    files = spark.read.text(path, wholetext=True).select("value").collect()
    found = [json.loads(f.value) for f in files]
    assert len(files) > 3 and max(len(f.value) for f in files) < 15_000
    assert {k: v for d in found for k, v in d.items()} == {f'k"{i}': {"good": i % 3 == 0, "name": 'a"}\\' + str(i)} for i in range(500)}
    empty = new_path(spark, "empty")
    sinks.write_score_map(rows.where("false"), empty)
    assert [json.loads(f.value) for f in spark.read.text(empty, wholetext=True).collect()] == [{}]
    assert documents.entries(spark, empty).count() == 0
    dictionary = spark.createDataFrame([("b", 2, ["x"]), ("a", 9, ["y", "z"]), ('q"', 2, [])], "label string, population int, smiles array<string>")
    path = new_path(spark, "dictionary")
    sinks.write_dictionary_json(dictionary, path)
    (only,) = spark.read.text(path, wholetext=True).collect()
    assert list(json.loads(only.value).items()) == [("a", {"population": 9, "smiles": ["y", "z"]}), ("b", {"population": 2, "smiles": ["x"]}), ('q"', {"population": 2, "smiles": []})]


def test_manifest_keeps_all_paths_unless_told(spark):
    images = spark.range(10_050).select(F.format_string("%06d.png", "id").alias("path"))
    a, b = new_path(spark, "all"), new_path(spark, "some")
    sinks.write_manifest(images, a)
    sinks.write_manifest(images, b, most=10)
    assert readers.read_manifest(spark, a).count() == 10_050
    assert sorted(r.path for r in readers.read_manifest(spark, b).collect()) == [f"{k:06d}.png" for k in range(10)]


# -- streams ---------------------------------------------------------------------------------------------------------------------------------


def test_stream_of_annotations_goes_on_after_a_stop(spark):
    rows = [(f"i{k}", ["CC", "CO", "", None][k % 4], k / 100) for k in range(90)]
    truth = [(f"i{k}", "even" if k % 2 == 0 else "odd", "CC" if k % 3 else "CO", 0.4) for k in range(80)]  # ten images are unknown
    known = {f: (b, s, c) for f, b, s, c in truth}
    truth = spark.createDataFrame(truth, "filename string, benchmark string, smi string, conf_least double")
    folder, out, log = (new_path(spark, x) for x in ("in", "out", "log"))
    schema = "smi string, conf double, `file-info` struct<filename: string, image_nbr: int>"

    def summary(files):
        scores = [(known[f][0], s not in (None, ""), s == known[f][1], c < known[f][2]) for f, s, c in {r[0]: r for r in files}.values() if f in known]
        return sorted(map(tuple, metrics.benchmark_summary(spark.createDataFrame(scores, "benchmark string, processed boolean, correct boolean, sentinel boolean")).collect()))

    for upto in (30, 30, 90):
        lot = rows[:30] if upto == 30 else rows[20:]  # the second lot is the first again, the third repeats ten images
        spark.createDataFrame([(s, c, (f, 1)) for f, s, c in lot], schema).repartition(4).write.mode("append").json(folder)
        stream_benchmarks(spark, folder, truth, out, log, chunk=3)
        assert sorted(map(tuple, benchmarks_so_far(spark, out).collect())) == summary(rows[:upto])
