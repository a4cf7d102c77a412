"""Small graphs with answers worked out by hand, and properties."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.distance import DELETE_COSTS, INSERT_COSTS, SUBSTITUTE_COSTS, edit_distance
from graphloom.functions.text import caption_flag, clean_label, has_exotic_atom, stem
from graphloom.operators import components, geometry, graph, metrics, raster
from graphloom.operators.small import small


def test_costs():
    assert edit_distance("0H", "OH", INSERT_COSTS, DELETE_COSTS, SUBSTITUTE_COSTS) == 0.1
    assert edit_distance("CH", "CH2", INSERT_COSTS, DELETE_COSTS, SUBSTITUTE_COSTS) == 0.6
    assert edit_distance("kitten", "sitting", {}, {}, {}) == 3
    assert edit_distance("", "", {}, {}, {}) == 0


def test_text(spark):
    rows = spark.createDataFrame([("a/b/x1.png", "^CO\\s2\\n", "[Se]C"), ("y.png", "", "CCO")], "path string, label string, smiles string")
    got = rows.select(stem(F.col("path")), clean_label(F.col("label")), has_exotic_atom(F.col("smiles"))).collect()
    assert [tuple(r) for r in got] == [("x1", "CO2", True), ("y", "", False)]
    flags = spark.createDataFrame([("Figure caption x", 1.0), ("CHCHCHCHCHCH", 1.0), ("xyz", 1.0), ("12", 0.9), ("12", 0.5), ("0", 0.9), ("a:", 0.1), ("CH", 1.0)], "t string, s double")
    assert [r[0] for r in flags.select(caption_flag(F.col("t"), F.col("s"))).collect()] == ["remove", "filter", "filter", "filter", None, None, "filter", None]


def test_components_agree_with_union_find(spark):
    rng = random.Random(4)
    links = [(str(i % 3), rng.randint(0, 40), rng.randint(0, 40)) for i in range(70)]
    links += [("path", k, k + 1) for k in range(60)]
    got = {(r[0], r[1]): r[2] for r in components.components(spark.createDataFrame(links, "image_id string, a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a, b in links:
        p, q = find((i, a)), find((i, b))
        parent[max(p, q)] = min(p, q)
    assert got == {x: find(x)[1] for x in list(parent)}


def test_merged_boxes_do_not_overlap(spark):
    rng = random.Random(5)
    boxes = [("a", i, x := rng.randint(0, 600), y := rng.randint(0, 300), x + 40, y + 25) for i in range(40)]
    merged = components.merge_boxes(spark.createDataFrame(boxes, "image_id string, box_id int, x0 int, y0 int, x1 int, y1 int"))
    assert geometry.overlapping_boxes(merged).count() == 0
    assert 0 < merged.count() <= 40


def test_expand_superatoms_by_hand(spark):
    nodes = spark.createDataFrame([("m", 0, "C", None), ("m", 1, "R", "Et"), ("m", 2, "R", "X")], "image_id string, idx int, class string, text string")
    edges = spark.createDataFrame([("m", 0, 0, 1, "SINGLE"), ("m", 1, 0, 2, "SINGLE")], "image_id string, edge_id int, b int, e int, class string")
    frag_nodes = spark.createDataFrame([("Et", 0, "C", 0), ("Et", 1, "C", None)], "text string, pos int, symbol string, attach int")
    frag_edges = spark.createDataFrame([("Et", 0, 1, "SINGLE")], "text string, p int, q int, class string")
    n, e = graph.expand_superatoms(nodes, edges, frag_nodes, frag_edges)
    assert sorted((r.idx, r["class"]) for r in n.collect()) == [(0, "C"), (2, "R"), (3, "C"), (4, "C")]
    assert sorted((r.b, r.e) for r in e.collect()) == [(0, 2), (0, 3), (3, 4)]


def test_rings_by_hand(spark):
    ring = [("m", 0, k, k, (k + 1) % 6, "AROMATIC" if k < 4 else "SINGLE") for k in range(6)]
    fused = [("m", 1, k, b, e, "SINGLE") for k, (b, e) in enumerate([(1, 0), (0, 6), (6, 7), (7, 1)])]
    rows = spark.createDataFrame(ring + fused, "image_id string, ring_id int, pos int, b int, e int, class string")
    got = {(r.b, r.e): r["class"] for r in graph.majority_ring_class(rows).collect()}
    assert all(got[min(k, (k + 1) % 6), max(k, (k + 1) % 6)] == "AROMATIC" for k in range(6))
    assert got[0, 6] == got[6, 7] == got[1, 7] == "SINGLE"
    edges = spark.createDataFrame([("m", 0, 1, "AROMATIC"), ("m", 1, 2, "AROMATIC"), ("m", 2, 0, "AROMATIC"), ("m", 2, 3, "AROMATIC")], "image_id string, b int, e int, class string")
    assert {(r.b, r.e): r["class"] for r in graph.aromatic_outside_rings(edges).collect()} == {(0, 1): "AROMATIC", (1, 2): "AROMATIC", (2, 0): "AROMATIC", (2, 3): "SINGLE"}


def test_molecule_status_by_hand(spark):
    nodes = [("ok", i, i * 100, 0, "C") for i in range(2)] + [("label", 0, 0, 0, "R"), ("label", 1, 100, 0, "C")]
    nodes += [("box", 0, 0, 0, "C"), ("box", 1, 10, 0, "C"), ("lone", 0, 0, 0, "C"), ("lone", 1, 100, 0, "C"), ("lone", 2, 900, 0, "C")]
    nodes += [("bad", i, i * 100, 0, "C") for i in range(4)]
    edges = [("ok", 0, 0, 1), ("label", 0, 0, 1), ("lone", 0, 0, 1), ("bad", 0, 0, 1), ("bad", 1, 2, 3)]
    boxes = [("box", 0, -5, -5, 20, 5)]
    got = graph.molecule_status(spark.createDataFrame(nodes, "image_id string, idx int, x int, y int, class string"), spark.createDataFrame(edges, "image_id string, edge_id int, b int, e int"), spark.createDataFrame(boxes, "image_id string, box_id int, x0 int, y0 int, x1 int, y1 int"))
    assert {r.image_id: r.status for r in got.collect()} == {"ok": "as_is", "label": "resolved", "box": "merged", "lone": "pruned", "bad": "sentinel"}


def test_molecule_status_resolves_labels(spark):
    nodes = [(image, i, i * 100, 0, "R" if i == 1 else "C", text if i == 1 else None) for image, text in (("pair", "pair"), ("split", "split"), ("none", "?")) for i in range(3)]
    edges = [(image, k, k, k + 1, "SINGLE") for image in ("pair", "split", "none") for k in range(2)]
    frag_nodes = [("pair", 0, "C", 0), ("pair", 1, "C", 1), ("split", 0, "C", 0), ("split", 1, "C", 1)]
    labels = spark.createDataFrame(frag_nodes, "text string, pos int, symbol string, attach int"), spark.createDataFrame([("pair", 0, 1, "SINGLE")], "text string, p int, q int, class string")
    graphs = spark.createDataFrame(nodes, "image_id string, idx int, x int, y int, class string, text string"), spark.createDataFrame(edges, "image_id string, edge_id int, b int, e int, class string")
    boxes = spark.createDataFrame([], "image_id string, box_id int, x0 int, y0 int, x1 int, y1 int")
    got = graph.molecule_status(*graphs, boxes, labels)
    assert {r.image_id: r.status for r in got.collect()} == {"pair": "resolved", "split": "unresolved", "none": "resolved"}


def test_dictionaries_are_counted_before_they_are_broadcast(spark):
    with pytest.raises(ValueError):
        small(spark.range(11), 10)
    assert small(spark.range(10), 10).count() == 10


def test_results_do_not_depend_on_partitions(spark):
    points = spark.createDataFrame([(str(i % 4), i // 4, (i * 37) % 101, (i * 53) % 97) for i in range(80)], "image_id string, idx int, x int, y int")
    rows = [sorted(map(tuple, geometry.propose_edges(points.repartition(n)).select("image_id", "b", "e", "dist").collect())) for n in (1, 8)]
    assert rows[0] == rows[1] and rows[0]


def test_text_scores_by_hand(spark):
    rows = spark.createDataFrame([("CCO", "CCO"), ("CCO", ""), ("CCCC", "CC")], "gt string, pred string")
    got = metrics.rouge_l(metrics.rouge_n(metrics.bleu(rows))).collect()
    assert got[0].bleu_1 == 1.0 and got[0].rouge_2 == 1.0 and got[0].rouge_l == 1.0
    assert got[1].bleu_average == 0.0 and got[1].rouge_1 == 0.0
    assert got[2].bleu_1 == 0.367879 and got[2].rouge_l == round(2 * 2 / 6, 6)


def test_compact_ids_have_no_gaps(spark):
    nodes = spark.createDataFrame([("a", i, "None" if i % 3 == 0 else "C") for i in range(10)], "image_id string, idx int, class string")
    edges = spark.createDataFrame([("a", i, i + 1, "SINGLE") for i in range(9)], "image_id string, b int, e int, class string")
    n, e = graph.apply_predictions(nodes, edges)
    assert sorted(r.idx for r in n.collect()) == list(range(6))
    assert sorted((r.b, r.e) for r in e.collect()) == [(0, 1), (2, 3), (4, 5)]


def test_peaks_of_long_bonds_are_found_again(spark):
    cells = [("long", 10, x, v) for x, v in ((10, 1.0), (15, 0.5), (60, 1.0), (66, 1.0), (110, 0.9))] + [("long", 60, 10, 0.7), ("long", 110, 110, 0.7), ("long", 10, 160, 0.05)]
    cells += [("short", 10, x, v) for x, v in ((10, 1.0), (15, 0.5), (20, 0.9), (22, 0.95))] + [("one", 5, 5, 0.4)]
    got = sorted((r.image_id, r.y, r.x) for r in raster.heatmap_peaks(spark.createDataFrame(cells, "image_id string, y int, x int, v double")).collect())
    long = [(10, 10), (10, 60), (10, 66), (10, 110), (60, 10), (110, 110)]
    assert got == [("long", *p) for p in long] + [("one", 5, 5)] + [("short", 10, x) for x in (10, 15, 22)]


def brute_maxima(cells, n):
    """Cells of plateaus, linked under n x n neighbourhoods, that touch no greater cell."""
    r, found, seen = n // 2, set(), set()
    for start in cells:
        if start in seen:
            continue
        plateau, stack, top = {start}, [start], True
        while stack:
            y, x = stack.pop()
            for near in ((y + dy, x + dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)):
                if cells.get(near, 0.0) > cells[start]:
                    top = False
                elif cells.get(near) == cells[start] and near not in plateau:
                    plateau.add(near)
                    stack.append(near)
        seen |= plateau
        found |= plateau if top else set()
    return found


def test_peaks_against_brute_force(spark):
    rng = random.Random(11)
    images = {}
    for k in range(12):
        side, blobs = ((30, 12), (400, 25))[k % 2]
        cells = {}
        for j in range(blobs):
            y, x = rng.randrange(side), rng.randrange(side)
            for _ in range(6 if side == 30 else 1 + (j % 5 == 0)):
                cells[(y + rng.randint(0, 9), x + rng.randint(0, 9))] = rng.choice([0.05, 0.3, 0.6, 0.6, 0.9])
        images[f"i{k}"] = cells
    rows = [(image, y, x, v) for image, cells in images.items() for (y, x), v in cells.items()]
    got = {(r.image_id, r.y, r.x) for r in raster.heatmap_peaks(spark.createDataFrame(rows, "image_id string, y int, x int, v double")).collect()}
    want, wide = set(), 0
    for image, cells in images.items():
        high = {c: v for c, v in cells.items() if v > 0.1}
        peaks = sorted(brute_maxima(high, 5))
        if 2 <= len(peaks) <= 300:
            nearest = [min(math.dist(a, b) for b in peaks[:i]) for i, a in enumerate(peaks) if i]
            if np.quantile(nearest, 0.75) > 35:
                peaks, wide = brute_maxima(high, 15), wide + 1
        want |= {(image, y, x) for y, x in peaks}
    assert got == want and 0 < wide < len(images)


def test_peaks_use_all_rows(spark):
    from graphloom.plans import catalog

    peaks = catalog.queries()["peaks"](spark, "/root/testdata/sf0.001")
    assert peaks.select("image_id").distinct().count() > 10 and peaks.agg(F.max("x")).first()[0] > 63


def test_text_metrics_against_brute_force(spark):
    import random
    from collections import Counter

    from graphloom.functions.distance import common_subsequence, edit_distance, gram_matches

    rng = random.Random(4)
    for _ in range(60):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 30))) for _ in range(2))
        grams = lambda t, n: Counter(t[i : i + n] for i in range(len(t) - n + 1))
        assert gram_matches([a], [b], 4)[0].tolist() == [(grams(a, n) & grams(b, n)).total() for n in (1, 2, 3, 4)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        cost = [[j for j in range(len(b) + 1)] if not i else [i] + [0] * len(b) for i in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
                cost[i + 1][j + 1] = min(cost[i][j] + (x != y), cost[i][j + 1] + 1, cost[i + 1][j] + 1)
        assert common_subsequence(a, b) == table[-1][-1]
        assert edit_distance(a, b, {}, {}, {}) == cost[-1][-1]


def test_grid_joins_against_brute_force(spark):
    import random

    from graphloom.operators import geometry
    from graphloom.operators.components import merge_boxes

    rng = random.Random(6)
    points = [(f"i{k % 2}", k, rng.randint(-150, 150), rng.randint(-150, 150)) for k in range(80)]
    boxes = [(f"i{k % 2}", k, x, y, x + rng.randint(0, 90), y + rng.randint(0, 90)) for k, (x, y) in enumerate((rng.randint(-150, 150), rng.randint(-150, 150)) for _ in range(14))]
    kp = spark.createDataFrame(points, "image_id string, idx int, x int, y int")
    frame = spark.createDataFrame(boxes, "image_id string, box_id int, x0 int, y0 int, x1 int, y1 int")
    held = {(i, b, k) for i, b, x0, y0, x1, y1 in boxes for j, k, x, y in points if i == j and x0 <= x <= x1 and y0 <= y <= y1}
    assert {tuple(r) for r in geometry.nodes_in_boxes(kp, frame, 1).collect()} == held
    meet = lambda p, q, m: max(p[0] - q[2], q[0] - p[2]) < m and p[1] < q[3] and q[1] < p[3]
    for margin in (0, 30):
        want = {(i, a, b) for i, a, *p in boxes for j, b, *q in boxes if i == j and a < b and meet(p, q, margin)}
        assert {tuple(r) for r in geometry.overlapping_boxes(frame, margin).collect()} == want
    merged = {}
    for i, b, *p in boxes:
        merged.setdefault(i, []).append((b, p))
    want = set()
    for i, left in merged.items():
        changed = True
        while changed:
            changed = False
            for p in left:
                hit = next((q for q in left if q is not p and meet(p[1], q[1], 10)), None)
                if hit:
                    left = [x for x in left if x is not p and x is not hit] + [(min(p[0], hit[0]), [min(p[1][0], hit[1][0]), min(p[1][1], hit[1][1]), max(p[1][2], hit[1][2]), max(p[1][3], hit[1][3])])]
                    changed = True
                    break
        want |= {(i, b, *p) for b, p in left}
    assert {tuple(r) for r in merge_boxes(frame, 10).collect()} == want
