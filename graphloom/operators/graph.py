"""Graph tables: nodes(image_id, idx, ...), edges(image_id, b, e, ...)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import forget, saved, ship
from .geometry import distance, points_in_boxes
from .small import small

#: Classes that mean "nothing here".
EMPTY_CLASSES = ["None", "Decoy"]
#: Most atoms, and most bonds, that the fragments of a dictionary may have together: they go to every task.
MOST_FRAGMENT_ROWS = 1_000_000
#: Writes a table that a long plan goes on from, or leaves it as it is.
Cut = Callable[[DataFrame, str], DataFrame]


def _uncut(table: DataFrame, name: str) -> DataFrame:
    return table


#: Symbols of drawn bonds, by bond type.
BOND_SYMBOLS = {"-": "SINGLE", "up": "SINGLE", "down": "SINGLE", "/": "SINGLE", "\\": "SINGLE", "=": "DOUBLE", "either": "DOUBLE", "#": "TRIPLE"}


def bonds_as_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(image_id, b, e): each bond becomes a node numbered after the atoms, in the order of edge_id, with a link from its first atom and one to
    its second."""
    atoms = nodes.groupBy("image_id").agg(F.count("*").alias("atoms"))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("edge_id")) - 1
    rows = edges.withColumn("__n", number).join(atoms, "image_id").withColumn("bond", F.col("atoms") + F.col("__n"))
    link = lambda b, e: F.struct(F.col(b).cast("long").alias("b"), F.col(e).cast("long").alias("e"))
    return rows.select("image_id", F.inline(F.array(link("b", "bond"), link("bond", "e"))))


def both_directions(edges: DataFrame) -> DataFrame:
    link = lambda b, e: F.struct(F.col(b).alias("b"), F.col(e).alias("e"))
    return edges.select("image_id", F.inline(F.array(link("b", "e"), link("e", "b"))))


def neighbors(edges: DataFrame) -> DataFrame:
    """(image_id, idx, neighbors): sorted distinct neighbours of every node that an edge touches."""
    return both_directions(edges).groupBy("image_id", F.col("b").alias("idx")).agg(F.array_sort(F.collect_set("e")).alias("neighbors"))


def incident_edges(edges: DataFrame) -> DataFrame:
    """(image_id, idx, edges): sorted ids of the edges (image_id, edge_id, b, e) at every node that one touches."""
    ends = edges.select("image_id", "edge_id", F.explode(F.array("b", "e")).alias("idx"))
    return ends.groupBy("image_id", "idx").agg(F.array_sort(F.collect_set("edge_id")).alias("edges"))


def degree(edges: DataFrame) -> DataFrame:
    """(image_id, idx, degree): edges at each node."""
    return both_directions(edges).groupBy("image_id", F.col("b").alias("idx")).agg(F.count("*").alias("degree"))


def compact_ids(nodes: DataFrame, edges: DataFrame, cut: Cut = _uncut) -> tuple[DataFrame, DataFrame]:
    """Both tables with node ids renumbered from 0 without gaps, in the old order; edges whose node is missing go."""
    new = cut(nodes.withColumn("new", F.row_number().over(Window.partitionBy("image_id").orderBy("idx")) - 1), "numbered")
    name = new.select("image_id", F.col("idx").alias("old"), "new")
    out = edges
    for end in ("b", "e"):
        out = out.join(name.select("image_id", F.col("old").alias(end), F.col("new").alias(f"__{end}")), ["image_id", end])
    out = out.drop("b", "e").withColumnRenamed("__b", "b").withColumnRenamed("__e", "e")
    return new.drop("idx").withColumnRenamed("new", "idx").select(*nodes.columns), out.select(*edges.columns)


def apply_predictions(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops nodes and edges of an empty predicted class (column class), and edges at a dropped node, then renumbers."""
    keep = ~F.col("class").isin(EMPTY_CLASSES)
    return compact_ids(nodes.where(keep), edges.where(keep))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(both_directions(edges).select("image_id", F.col("b").alias("idx")).distinct(), ["image_id", "idx"], "left_anti")


def remove_isolated(nodes: DataFrame, edges: DataFrame, cut: Cut = _uncut) -> tuple[DataFrame, DataFrame]:
    return compact_ids(nodes.join(isolated_nodes(nodes, edges).select("image_id", "idx"), ["image_id", "idx"], "left_anti"), edges, cut)


def merge_nodes(nodes: DataFrame, edges: DataFrame, held: DataFrame, named: DataFrame | None = None, texts: DataFrame | None = None, cut: Cut = _uncut) -> tuple[DataFrame, DataFrame]:
    """The nodes of each box (held: image_id, box_id, idx) become the first of them: R if the box's text is in the dictionary (named: image_id,
    box_id of such boxes), else the class that all have, else R. Where nodes have a text, that of a merged node is its box's (texts: image_id, box_id,
    text). Edges follow; loops and repeats in either direction go; ids are renumbered. A node in two boxes belongs to the first."""
    one = held.groupBy("image_id", "idx").agg(F.min("box_id").alias("box_id"))
    heads = one.groupBy("image_id", "box_id").agg(F.min("idx").alias("into"))
    into = cut(one.join(heads, ["image_id", "box_id"]).select("image_id", "idx", "into"), "into")
    if named is not None:
        heads = heads.join(named.select("image_id", "box_id", F.lit(True).alias("named")).distinct(), ["image_id", "box_id"], "left")
    else:
        heads = heads.withColumn("named", F.lit(False))
    if texts is not None:
        written = heads.join(texts.select("image_id", "box_id", F.struct("text").alias("__written")), ["image_id", "box_id"], "left").select("image_id", F.col("into").alias("idx"), "__written")
        nodes = nodes.join(written, ["image_id", "idx"], "left").withColumn("text", F.when(F.col("__written").isNotNull(), F.col("__written.text")).otherwise(F.col("text"))).drop("__written")
    known = heads.where("named").select("image_id", F.col("into").alias("idx"), "named")
    same = nodes.join(into, ["image_id", "idx"]).groupBy("image_id", F.col("into").alias("idx")).agg(F.when(F.min("class") == F.max("class"), F.min("class")).otherwise("R").alias("merged"))
    same = same.join(known, ["image_id", "idx"], "left").select("image_id", "idx", F.when(F.col("named"), "R").otherwise(F.col("merged")).alias("merged"))
    gone = into.where("idx != into").select("image_id", "idx")
    left = nodes.join(gone, ["image_id", "idx"], "left_anti").join(same, ["image_id", "idx"], "left").withColumn("class", F.coalesce("merged", "class")).select(*nodes.columns)
    left, moved = cut(left, "left"), edges
    for end in ("b", "e"):
        moved = moved.join(into.select("image_id", F.col("idx").alias(end), F.col("into").alias("__to")), ["image_id", end], "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    first = Window.partitionBy("image_id", F.least("b", "e"), F.greatest("b", "e")).orderBy("edge_id")
    moved = moved.where("b != e").withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*edges.columns)
    return compact_ids(left, cut(moved, "moved"), cut)


def graph_from_keypoints(kp: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of class None at the keypoints; edges with their midpoint and class None."""
    nodes = kp.select("image_id", "idx", "x", "y", F.lit("None").alias("class"))
    mid = lambda c: (F.col(f"b{c}") + F.col(f"e{c}")) / 2
    return nodes, edges.select("image_id", "b", "e", mid("x").alias("mx"), mid("y").alias("my"), F.lit("None").alias("class"))


def bond_type(symbol: Column) -> Column:
    """SINGLE, DOUBLE or TRIPLE of a drawn bond's symbol, else None."""
    names = F.create_map(*[F.lit(x) for k, v in BOND_SYMBOLS.items() for x in (k, v)])
    return F.coalesce(names[symbol], F.lit("None"))


def graph_from_annotation(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (image_id, id, element, charge, connecting_nodes): rows without connecting_nodes are atoms, the others bonds, whose element is the
    bond's symbol. An atom's symbol is R for a pseudoatom, else element with ",charge" where it has one; ids are ordinals."""
    atoms = rows.where("connecting_nodes is null").withColumn("idx", F.row_number().over(Window.partitionBy("image_id").orderBy("id")) - 1)
    symbol = F.when(F.col("element") == "pseudoatom", "R").when(F.coalesce("charge", F.lit(0.0)) != 0, F.concat("element", F.lit(","), F.col("charge").cast("int"))).otherwise(F.col("element"))
    nodes = atoms.select("image_id", "idx", symbol.alias("class"))
    name = atoms.select("image_id", F.col("id").alias("node"), "idx")
    edges = rows.where("connecting_nodes is not null").select("image_id", "id", F.col("connecting_nodes")[0].alias("n0"), F.col("connecting_nodes")[1].alias("n1"), bond_type(F.col("element")).alias("class"))
    for old, new in (("n0", "b"), ("n1", "e")):
        edges = edges.join(name.select("image_id", F.col("node").alias(old), F.col("idx").alias(new)), ["image_id", old])
    return nodes, edges.select("image_id", F.col("id").alias("edge_id"), "b", "e", "class")


def graph_from_bond_table(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """atoms (image_id, idx, symbol, charge): `*` is R, a charge is put behind the symbol. bonds (image_id, b, e, type, wedge): a wedge's direction
    overrides its type."""
    symbol = F.when(F.col("symbol") == "*", "R").when(F.col("charge") != 0, F.concat("symbol", F.lit(","), F.col("charge").cast("string"))).otherwise(F.col("symbol"))
    kind = F.when(F.col("wedge") == "BEGINWEDGE", "SOLID").when(F.col("wedge") == "BEGINDASH", "DASHED").otherwise(F.col("type"))
    return atoms.select("image_id", "idx", symbol.alias("class")), bonds.select("image_id", "b", "e", kind.alias("class"))


def first_bond_size(atoms: DataFrame, bonds: DataFrame, order: str) -> DataFrame:
    """(image_id, bond_size): the length of each image's first bond by `order`; atoms (image_id, idx, x, y), bonds (image_id, b, e)."""
    first = bonds.groupBy("image_id").agg(F.min(F.struct(order, "b", "e")).alias("bond")).select("image_id", F.col("bond.b").alias("b"), F.col("bond.e").alias("e"))
    for end in ("b", "e"):
        first = first.join(atoms.select("image_id", F.col("idx").alias(end), F.col("x").cast("double").alias(f"{end}x"), F.col("y").cast("double").alias(f"{end}y")), ["image_id", end])
    return first.select("image_id", distance(F.col("bx"), F.col("by"), F.col("ex"), F.col("ey")).alias("bond_size"))


def orient_wedges(edges: DataFrame) -> DataFrame:
    """edges with class and direction: DOWN swaps the ends; type SINGLE for wedges; stereo 1 for SOLID, 6 for DASHED, else 0."""
    wedge, down = F.col("class").isin("SOLID", "DASHED"), F.col("class").isin("SOLID", "DASHED") & (F.col("direction") == "DOWN")
    ends = [F.when(down, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("b", "e"), ("e", "b"))]
    stereo = F.when(F.col("class") == "SOLID", 1).when(F.col("class") == "DASHED", 6).otherwise(0)
    return edges.select("image_id", *ends, F.when(wedge, "SINGLE").otherwise(F.col("class")).alias("type"), stereo.alias("stereo"))


def class_lookup(rows: DataFrame, vocabulary: DataFrame, column: str = "class") -> DataFrame:
    """rows with class_id of the vocabulary (symbol, class_id), whose size is checked; unknown symbols get that of None."""
    none = vocabulary.where("symbol = 'None'").agg(F.min("class_id").alias("__none"))
    named = rows.join(small(vocabulary.withColumnRenamed("symbol", column)), column, "left")
    return named.join(F.broadcast(none), how="cross").withColumn("class_id", F.coalesce("class_id", "__none")).drop("__none")


def needs_label_reading(nodes: DataFrame, symbol: str = "R") -> DataFrame:
    """(image_id, needed): whether an image has a node whose label must be read."""
    return nodes.groupBy("image_id").agg(F.bool_or(F.col("class") == symbol).alias("needed"))


def neutralise(atoms: DataFrame) -> DataFrame:
    return atoms.withColumn("charge", F.lit(0))


def labels_on_nodes(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, idx, box_id): each R node, in order, takes the first box (by box_id, borders included) that contains it, if no node before has
    taken that box: so the first node of each box gets it."""
    first = points_in_boxes(boxes, nodes.where("class = 'R'").select("image_id", "idx", "x", "y")).groupBy("image_id", "idx").agg(F.min("box_id").alias("box_id"))
    return first.groupBy("image_id", "box_id").agg(F.min("idx").alias("idx")).select("image_id", "idx", "box_id")


def expand_superatoms(nodes: DataFrame, edges: DataFrame, frag_nodes: DataFrame, frag_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces each R node, whose text names a fragment, by it.

    nodes (image_id, idx, class, text), edges (image_id, edge_id, b, e, class), frag_nodes (text, pos, symbol, attach): attach is the ordinal of the
    attachment at that atom, null elsewhere; frag_edges (text, p, q, class). A node's edges, by edge_id, meet the fragment's attachments
    by ordinal; where their numbers differ the node stays. The fragments' size is checked. New ids follow the old; the replaced node goes; nothing is renumbered."""
    return _expanded(nodes, edges, small(frag_nodes, MOST_FRAGMENT_ROWS), small(frag_edges, MOST_FRAGMENT_ROWS))


def _expanded(nodes: DataFrame, edges: DataFrame, parts: DataFrame, bonds: DataFrame, cut: Cut = _uncut) -> tuple[DataFrame, DataFrame]:
    """expand_superatoms with fragments whose size is known to be small."""
    ends = edges.select("image_id", "edge_id", "b", "e", F.inline(F.array(F.struct(F.col("b").alias("idx"), F.lit("b").alias("end")), F.struct(F.col("e").alias("idx"), F.lit("e").alias("end")))))
    r = nodes.where("class = 'R' and text is not null").select("image_id", "idx", "text")
    at = cut(ends.join(r, ["image_id", "idx"]).withColumn("attach", F.row_number().over(Window.partitionBy("image_id", "idx").orderBy("edge_id")) - 1), "ends")
    have = at.groupBy("image_id", "idx", "text").agg(F.count("*").alias("have"))
    want = parts.groupBy("text").agg(F.count("attach").alias("want"), F.count("*").alias("size"))
    fit = have.join(F.broadcast(want), "text").where("have = want")
    last = nodes.groupBy("image_id").agg(F.max("idx").alias("last"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("image_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = cut(fit.withColumn("before", before).join(last, "image_id").select("image_id", F.col("idx").alias("old"), "text", (F.col("last") + 1 + F.col("before")).alias("base")), "base")
    grown = base.join(parts, "text").select("image_id", "old", (F.col("base") + F.col("pos")).alias("idx"), F.col("symbol").alias("class"), "attach")
    kept = nodes.join(base.select("image_id", F.col("old").alias("idx")), ["image_id", "idx"], "left_anti").select("image_id", F.col("idx").cast("long").alias("idx"), "class")
    new_nodes = kept.unionByName(grown.select("image_id", F.col("idx").cast("long").alias("idx"), "class"))
    joint = cut(at.select("image_id", "edge_id", "end", F.col("idx").alias("old"), "attach").join(grown.where("attach is not null").select("image_id", "old", "attach", "idx"), ["image_id", "old", "attach"]), "joint")
    out = edges
    for end in ("b", "e"):
        out = out.join(joint.where(F.col("end") == end).select("image_id", "edge_id", F.col("idx").alias("__to")), ["image_id", "edge_id"], "left").withColumn(end, F.coalesce("__to", end).cast("long")).drop("__to")
    inner = base.join(bonds, "text").select("image_id", (F.col("base") + F.col("p")).cast("long").alias("b"), (F.col("base") + F.col("q")).cast("long").alias("e"), "class")
    return new_nodes, out.select("image_id", "b", "e", "class").unionByName(inner)


def _low_links(edges: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Bridges of an undirected graph, without recursion."""
    near: dict[int, list[tuple[int, int]]] = {}
    for k, (b, e) in enumerate(edges):
        near.setdefault(b, []).append((e, k))
        near.setdefault(e, []).append((b, k))
    seen, low, bridges, clock = {}, {}, set(), 0
    for root in near:
        if root in seen:
            continue
        seen[root] = low[root] = clock
        clock += 1
        stack = [(root, -1, iter(near[root]))]
        while stack:
            node, came, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[node])
                    if low[node] > seen[up]:
                        bridges.add(edges[came])
            elif step[1] != came:
                to, k = step
                if to in seen:
                    low[node] = min(low[node], seen[to])
                else:
                    seen[to] = low[to] = clock
                    clock += 1
                    stack.append((to, k, iter(near[to])))
    return bridges


def per_image(rows: DataFrame, order: list[str], work: Callable[[str, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """work(image_id, the image's rows in order) for every image, many images a batch: for steps that are sequential within an image. One
    image's rows (image_id first) are in memory at a time, besides a batch."""
    ship(rows.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def stream(frames):
        held: list[tuple] = []
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    out += work(held[0][0], held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(work(held[0][0], held), columns=names)

    return rows.repartition("image_id").sortWithinPartitions("image_id", *order).mapInPandas(stream, schema)


def aromatic_outside_rings(edges: DataFrame) -> DataFrame:
    """edges (image_id, b, e, class): AROMATIC edges that lie in no ring (bridges) become SINGLE."""

    def fix(image: str, rows: list[tuple]) -> list[tuple]:
        bridges = _low_links([(b, e) for _, b, e, _ in rows])
        return [(image, b, e, "SINGLE" if c == "AROMATIC" and (b, e) in bridges else c) for _, b, e, c in rows]

    columns = edges.select("image_id", F.col("b").cast("long").alias("b"), F.col("e").cast("long").alias("e"), "class")
    return per_image(columns, ["b", "e"], fix, "image_id string, b long, e long, class string")


def majority_ring_class(rings: DataFrame) -> DataFrame:
    """rings (image_id, ring_id, pos, b, e, class), an edge for each row: where a ring's most common class (of equals the first met) is AROMATIC, all
    its edges become so. Rings go one after another: edges shared with an earlier ring are seen as it left them."""

    def fix(image: str, rows: list[tuple]) -> list[tuple]:
        now: dict[tuple, str] = {}
        by_ring: dict[int, list[tuple]] = {}
        for _, ring, _, b, e, c in rows:
            key = (min(b, e), max(b, e))
            now.setdefault(key, c)
            by_ring.setdefault(ring, []).append(key)
        for keys in by_ring.values():
            classes = [now[k] for k in keys]
            if max(dict.fromkeys(classes), key=classes.count) == "AROMATIC":
                now.update(dict.fromkeys(keys, "AROMATIC"))
        return [(image, b, e, c) for (b, e), c in now.items()]

    return per_image(rings.select("image_id", "ring_id", "pos", "b", "e", "class"), ["ring_id", "pos"], fix, "image_id string, b long, e long, class string")


def ring_profile(images: DataFrame, rings: DataFrame) -> DataFrame:
    """(image_id, largest_ring_size): 0 where an image has no ring."""
    size = rings.groupBy("image_id", "ring_id").count().groupBy("image_id").agg(F.max("count").alias("largest"))
    return images.select("image_id").join(size, "image_id", "left").select("image_id", F.coalesce("largest", F.lit(0)).cast("long").alias("largest_ring_size"))


def _fragments(nodes: DataFrame, edges: DataFrame, labels: tuple[DataFrame, DataFrame] | None, cut: Cut) -> DataFrame:
    """(image_id, raw, solved, needed): connected parts of each image's graph as it is and with its labels expanded (the same where it has no R
    node or nothing to expand it by). Both graphs go through one run, told apart by the first letter of their name."""
    from .components import fragment_counts

    needed = needs_label_reading(nodes)
    graphs = [("0", nodes, edges)]
    if labels is not None:
        with_r = needed.where("needed").select("image_id")
        more = [cut(d.join(with_r, "image_id", "left_semi"), "with_r") for d in (nodes, edges)]
        graphs.append(("1", *_expanded(*more, *labels, cut)))
    named = lambda d, kind, *ids: d.select(F.concat(F.lit(kind), "image_id").alias("image_id"), *[F.col(c).cast("long").alias(c) for c in ids])
    n, e = named(nodes, "0", "idx"), named(edges, "0", "b", "e")
    for kind, more_nodes, more_edges in graphs[1:]:
        n, e = n.unionByName(named(more_nodes, kind, "idx")), e.unionByName(named(more_edges, kind, "b", "e"))
    count = lambda kind: F.max(F.when(F.substring("image_id", 1, 1) == kind, F.col("fragments")))
    counts = fragment_counts(n, e)
    both = counts.groupBy(F.expr("substring(image_id, 2)").alias("image_id")).agg(count("0").alias("raw"), count("1").alias("solved"))
    out = saved(both.withColumn("solved", F.coalesce("solved", "raw")).join(needed, "image_id"), "fragments")
    forget(counts)
    return out


def molecule_status(nodes: DataFrame, edges: DataFrame, boxes: DataFrame, labels: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(image_id, status): how each image's graph is accepted.

    as_is: no R node and one fragment; resolved: one fragment once labels are expanded; merged: either of these once the nodes in boxes are merged;
    unresolved: one fragment if labels stay as they are; pruned: one fragment, expanded or not, once lone nodes are dropped; else sentinel. Each step starts over
    with the images that are left. labels: the frag_nodes and frag_edges of expand_superatoms, for nodes with a column text; without them
    an R node stays one node. The nodes in a box become R if its text (boxes may have a column text) names a fragment, and take that text."""
    from .geometry import nodes_in_boxes

    spent: list[DataFrame] = []

    def cut(table: DataFrame, name: str) -> DataFrame:
        spent.append(saved(table, name))
        return spent[-1]

    def counted(*graph: DataFrame) -> DataFrame:
        """_fragments(), and what it wrote on the way goes, from the driver's memory too."""
        begun = len(spent)
        out = _fragments(*graph, labels, cut)
        forget(*spent[begun:])
        del spent[begun:]
        spent.append(out)
        return out

    nodes, edges = cut(nodes, "nodes"), cut(edges, "edges")
    labels = tuple(small(d, MOST_FRAGMENT_ROWS) for d in labels) if labels is not None else None
    one = counted(nodes, edges)
    done = one.where("solved = 1").select("image_id", F.when(F.col("needed"), "resolved").otherwise("as_is").alias("status"))
    open_images = one.where("solved != 1").select("image_id")
    n, e = (cut(d.join(open_images, "image_id", "left_semi"), "open") for d in (nodes, edges))
    held = cut(nodes_in_boxes(n, boxes), "held")
    texts = boxes.select("image_id", "box_id", "text") if labels is not None and "text" in boxes.columns and "text" in nodes.columns else None
    named = texts.join(F.broadcast(labels[0].select("text").distinct()), "text", "left_semi") if texts is not None else None
    merged = tuple(cut(d, "merged") for d in merge_nodes(n, e, held, named, texts, cut))
    two = counted(*merged)
    done = done.unionByName(two.where("solved = 1 or raw = 1").select("image_id", F.when(F.col("solved") == 1, "merged").otherwise("unresolved").alias("status")))
    open_images = two.where("solved != 1 and raw != 1").select("image_id")
    pruned = tuple(cut(d, "pruned") for d in remove_isolated(*(d.join(open_images, "image_id", "left_semi") for d in merged), cut))
    three = counted(*pruned)
    done = done.unionByName(three.where("solved = 1 or raw = 1").select("image_id", F.lit("pruned").alias("status")))
    out = saved(one.select("image_id").join(done, "image_id", "left").select("image_id", F.coalesce("status", F.lit("sentinel")).alias("status")), "status")
    forget(*spent)
    return out
