"""Queries over graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as loops
from ..operators import geometry, graph, labels, metrics
from ..operators.geometry import nodes_in_boxes
from ..scratch import new_path
from ..sources import readers, sinks
from .point_queries import INKED, LOWER, NEAR, PROPOSED, SIZE
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

# nodes: lines of an order; edges: consecutive lines, and every third line with the first
NODES = "nodes as (select image_id, idx, case when q % 11 = 0 then 'None' when flag = 'R' then 'R' else flag || status end as class, q from {graph})"
EDGES = "edges as (select image_id, idx as edge_id, idx as b, idx + 1 as e, case when q % 13 = 0 then 'None' when q % 7 = 0 then 'AROMATIC' else 'SINGLE' end as class from {graph} g where exists (select 1 from {graph} h where h.image_id = g.image_id and h.idx = g.idx + 1) and q % 5 != 0)"


def _nodes(t):
    kind = F.when(F.col("q") % 11 == 0, "None").when(F.col("flag") == "R", "R").otherwise(F.concat("flag", "status"))
    return t.graph.select("image_id", "idx", kind.alias("class"), "q")


def _edges(t):
    after = t.graph.select("image_id", (F.col("idx") - 1).alias("idx"))
    kind = F.when(F.col("q") % 13 == 0, "None").when(F.col("q") % 7 == 0, "AROMATIC").otherwise("SINGLE")
    return t.graph.where("q % 5 != 0").join(after, ["image_id", "idx"], "left_semi").select("image_id", F.col("idx").alias("edge_id"), F.col("idx").alias("b"), (F.col("idx") + 1).alias("e"), kind.alias("class"))


@query(f"with {NODES}, {EDGES}, r as (select e.*, row_number() over (partition by image_id order by edge_id) - 1 + a.n as bond from edges e join (select image_id, count(*) as n from nodes group by 1) a using (image_id)) select image_id, cast(b as bigint) as b, bond as e from r union all select image_id, bond, cast(e as bigint) from r")
def bonds_as_nodes(t):
    return graph.bonds_as_nodes(_nodes(t), _edges(t))


@query(f"with {EDGES} select image_id, b, e from edges union all select image_id, e, b from edges")
def both_directions(t):
    return graph.both_directions(_edges(t))


@query(f"with {EDGES} select image_id, idx, list_sort(list(distinct o)) as neighbors from (select image_id, b as idx, e as o from edges union all select image_id, e, b from edges) group by 1, 2")
def neighbors(t):
    return graph.neighbors(_edges(t))


@query(f"with {EDGES} select image_id, idx, count(*) as degree from (select image_id, b as idx from edges union all select image_id, e from edges) group by 1, 2")
def degree(t):
    return graph.degree(_edges(t))


KEPT = "k as (select *, row_number() over (partition by image_id order by idx) - 1 as new from nodes where class not in ('None', 'Decoy'))"


@query(f"with {NODES}, {EDGES}, {KEPT} select e.image_id, x.new as b, y.new as e, e.class from edges e join k x on x.image_id = e.image_id and x.idx = e.b join k y on y.image_id = e.image_id and y.idx = e.e where e.class not in ('None', 'Decoy')")
def apply_predictions(t):
    edges = graph.apply_predictions(_nodes(t), _edges(t))[1]
    return edges.select("image_id", F.col("b").cast("long").alias("b"), F.col("e").cast("long").alias("e"), "class")


@query(f"with {NODES}, {KEPT} select image_id, new as idx, class from k")
def compact_nodes(t):
    return graph.apply_predictions(_nodes(t), _edges(t))[0].select("image_id", F.col("idx").cast("long").alias("idx"), "class")


LONE = "lone as (select image_id, idx from nodes n where not exists (select 1 from edges e where e.image_id = n.image_id and (e.b = n.idx or e.e = n.idx)))"


@query(f"with {NODES}, {EDGES}, {LONE} select image_id, idx from lone")
def isolated(t):
    return graph.isolated_nodes(_nodes(t), _edges(t)).select("image_id", "idx")


@query(f"with {NODES}, {EDGES}, {LONE} select image_id, row_number() over (partition by image_id order by idx) - 1 as idx, class from nodes n where not exists (select 1 from lone l where l.image_id = n.image_id and l.idx = n.idx)")
def remove_isolated(t):
    return graph.remove_isolated(_nodes(t), _edges(t))[0].select("image_id", F.col("idx").cast("long").alias("idx"), "class")


@query("""with recursive p as (select distinct cast(day as varchar) as image_id, b, e from {links}), s as (select image_id, b as x, e as y from p union all select image_id, e, b from p),
r as (select distinct image_id, x as node, x as seen from s union select r.image_id, r.node, s.y from r join s on s.image_id = r.image_id and s.x = r.seen)
select image_id, node, min(seen) as component from r group by 1, 2""")
def components(t):
    return loops.components(t.links.select(F.col("day").cast("string").alias("image_id"), F.col("b").alias("a"), F.col("e").alias("b")))


@query(f"with {NODES}, {EDGES} select image_id, count(*) - (select count(*) from edges e where e.image_id = n.image_id) as fragments from nodes n group by 1")
def fragments(t):
    return loops.fragment_counts(_nodes(t), _edges(t))  # the lines of an order make paths: fragments are nodes less edges


def _merged(t):
    nodes = t.kp.select("image_id", "idx", "x", "y", F.when(F.col("vec_id") % 3 == 0, "R").otherwise("C").alias("class"))
    edges = t.edges.select("image_id", (F.col("b") * 1000 + F.col("e")).alias("edge_id"), "b", "e")
    held, named = nodes_in_boxes(t.kp, t.boxes), t.boxes.where("x0 % 2 = 0").select("image_id", "box_id")
    return graph.merge_nodes(nodes, edges, held, named)


#: A node in several boxes belongs to the first; the first node of a box stands for all that belong to it.
MERGED = """h as (select image_id, box_id, idx from (select b.image_id, b.box_id, k.idx, count(*) over (partition by b.image_id, b.box_id) as n from {boxes} b join {kp} k on k.image_id = b.image_id and k.x between b.x0 and b.x1 and k.y between b.y0 and b.y1) where n >= 2),
o as (select image_id, idx, min(box_id) as box_id from h group by 1, 2), f as (select image_id, idx, box_id, min(idx) over (partition by image_id, box_id) as head from o),
c as (select k.image_id, k.idx, coalesce(head, k.idx) as head, box_id, case when vec_id % 3 = 0 then 'R' else 'C' end as class from {kp} k left join f on f.image_id = k.image_id and f.idx = k.idx),
n as (select image_id, head, case when bool_or(x0 % 2 = 0) then 'R' when min(class) = max(class) then min(class) else 'R' end as class from c left join (select image_id as bi, box_id as bb, x0 from {boxes}) b on bi = image_id and bb = box_id group by 1, 2),
z as (select image_id, head, class, row_number() over (partition by image_id order by head) - 1 as idx from n)"""


@query(f"with {MERGED} select image_id, idx, class from z")
def merged_nodes(t):
    return _merged(t)[0].select("image_id", F.col("idx").cast("long").alias("idx"), "class")


@query(f"""with {MERGED}, e as (select x.image_id, x.b * 1000 + x.e as edge_id, p.head as b, q.head as e from {{edges}} x join c p on p.image_id = x.image_id and p.idx = x.b join c q on q.image_id = x.image_id and q.idx = x.e),
k as (select *, row_number() over (partition by image_id, least(b, e), greatest(b, e) order by edge_id) as r from e where b != e)
select k.image_id, edge_id, p.idx as b, q.idx as e from k join z p on p.image_id = k.image_id and p.head = k.b join z q on q.image_id = k.image_id and q.head = k.e where r = 1""")
def merge_nodes(t):
    return _merged(t)[1].select("image_id", "edge_id", F.col("b").cast("long").alias("b"), F.col("e").cast("long").alias("e"))


@query("select image_id, idx, list_sort(list(distinct edge_id)) as edges from (select image_id, b * 1000 + e as edge_id, unnest([b, e]) as idx from {edges}) group by 1, 2")
def incident_edges(t):
    return graph.incident_edges(t.edges.select("image_id", (F.col("b") * 1000 + F.col("e")).alias("edge_id"), "b", "e"))


@query("select image_id, dist as bond_size from (select *, row_number() over (partition by image_id order by b * 1000 + e) as r from {edges}) where r = 1")
def first_bond(t):
    return graph.first_bond_size(t.kp, t.edges.select("image_id", (F.col("b") * 1000 + F.col("e")).alias("edge_id"), "b", "e"), "edge_id")


@query("""with f as (select k.image_id, k.idx, min(b.box_id) as box_id from {kp} k join {boxes} b on b.image_id = k.image_id and k.x between b.x0 and b.x1 and k.y between b.y0 and b.y1 where k.vec_id % 3 = 0 group by 1, 2)
select image_id, min(idx) as idx, box_id from f group by 1, 3""")
def label_on_nodes(t):
    nodes = t.kp.select("image_id", "idx", "x", "y", F.when(F.col("vec_id") % 3 == 0, "R").otherwise("C").alias("class"))
    return graph.labels_on_nodes(nodes, t.boxes)


@query(f"with {NODES} select image_id, bool_or(class = 'R') as needed from nodes group by 1")
def needs_label(t):
    return graph.needs_label_reading(_nodes(t))


_CODES = "['-', 'up', '=', '#', '\\', 'wavy']"
_TYPES = "['SINGLE', 'SINGLE', 'DOUBLE', 'TRIPLE', 'SINGLE', 'None']"


@query(f"""with a as (select image_id, row_number() over (partition by image_id order by idx) - 1 as new, idx from {{graph}} where idx % 4 != 0)
select g.image_id, g.idx as edge_id, x.new as b, y.new as e, {_TYPES}[g.q % 6 + 1] as class from {{graph}} g join a x on x.image_id = g.image_id and x.idx = g.idx - 1 join a y on y.image_id = g.image_id and y.idx = g.idx + 1 where g.idx % 4 = 0""")
def graph_build(t):
    return _built(t)[1].select("image_id", "edge_id", F.col("b").cast("long").alias("b"), F.col("e").cast("long").alias("e"), "class")


@query("""select image_id, row_number() over (partition by image_id order by idx) - 1 as idx, case when flag = 'R' then 'R' when q % 3 != 1 then flag || ',' || (q % 3 - 1) else flag end as class from {graph} where idx % 4 != 0""")
def graph_build_nodes(t):
    return _built(t)[0].select("image_id", F.col("idx").cast("long").alias("idx"), "class")


def _built(t):
    codes = F.array(*[F.lit(x) for x in ("-", "up", "=", "#", "\\", "wavy")])
    bond = F.col("idx") % 4 == 0
    rows = t.graph.select("image_id", F.col("idx").alias("id"), F.when(bond, F.element_at(codes, F.col("q") % 6 + 1)).when(F.col("flag") == "R", "pseudoatom").otherwise(F.col("flag")).alias("element"), (F.col("q") % 3 - 1).cast("double").alias("charge"), F.when(bond, F.array(F.col("idx") - 1, F.col("idx") + 1)).alias("connecting_nodes"))
    return graph.graph_from_annotation(rows)


@query("""select image_id, idx, case when flag = 'R' then 'R' when q % 3 - 1 != 0 then flag || ',' || (q % 3 - 1) else flag end as class from {graph}""")
def atom_symbols(t):
    atoms = t.graph.select("image_id", "idx", F.when(F.col("flag") == "R", "*").otherwise(F.col("flag")).alias("symbol"), (F.col("q") % 3 - 1).alias("charge"))
    return graph.graph_from_bond_table(atoms, t.graph.select("image_id", F.col("idx").alias("b"), F.col("idx").alias("e"), F.lit("SINGLE").alias("type"), F.lit("").alias("wedge")))[0]


@query("""select image_id, case when w in ('SOLID', 'DASHED') and d = 'DOWN' then e else b end as b, case when w in ('SOLID', 'DASHED') and d = 'DOWN' then b else e end as e, case when w in ('SOLID', 'DASHED') then 'SINGLE' else w end as type,
case w when 'SOLID' then 1 when 'DASHED' then 6 else 0 end as stereo from (select image_id, idx as b, idx + 1 as e, case when q % 4 = 0 then 'SOLID' when q % 4 = 1 then 'DASHED' else 'DOUBLE' end as w, case when flag = 'N' then 'DOWN' else 'UP' end as d from {graph})""")
def oriented_wedges(t):
    wedge = F.when(F.col("q") % 4 == 0, "BEGINWEDGE").when(F.col("q") % 4 == 1, "BEGINDASH")
    bonds = t.graph.select("image_id", F.col("idx").alias("b"), (F.col("idx") + 1).alias("e"), F.lit("DOUBLE").alias("type"), wedge.alias("wedge"), "flag")
    edges = graph.graph_from_bond_table(t.graph.select("image_id", "idx", F.col("flag").alias("symbol"), F.lit(0).alias("charge")), bonds)[1]
    named = edges.join(bonds.select("image_id", "b", F.when(F.col("flag") == "N", "DOWN").otherwise("UP").alias("direction")), ["image_id", "b"])
    return graph.orient_wedges(named)


@query(f"with {NODES} select image_id, idx, case class when 'AF' then 0 when 'NO' then 1 when 'R' then 2 else 9 end as class_id from nodes")
def class_ids(t):
    vocab = t.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(i).alias("class_id")) for s, i in (("AF", 0), ("NO", 1), ("R", 2), ("None", 9))])))
    return graph.class_lookup(_nodes(t), vocab).select("image_id", "idx", "class_id")


@query("select image_id, b, e, (bx + ex) / 2 as mx, (by + ey) / 2 as my, 'None' as class from {edges}")
def graph_edges(t):
    return graph.graph_from_keypoints(t.kp, t.edges)[1]


@query("select image_id, flag as symbol, cast(sum(case when q % 3 = 0 then 0 else q % 3 end) as bigint) as charged, cast(0 as bigint) as left_over, count(*) as atoms from {graph} group by 1, 2")
def neutralise(t):
    """What charge each image's elements had, and what is left of it."""
    before = t.graph.select("image_id", "idx", F.col("flag").alias("symbol"), (F.col("q") % 3).alias("charge"))
    both = graph.neutralise(before.withColumn("was", F.col("charge")))
    return both.groupBy("image_id", "symbol").agg(F.sum("was").alias("charged"), F.sum("charge").alias("left_over"), F.count("*").alias("atoms"))


def _fragments(t):
    """A two-atom fragment with one attachment for every return flag, from the table itself."""
    flags = t.lineitem.select(F.col("l_returnflag").alias("text")).distinct()
    atom = lambda pos, symbol, attach: F.struct(F.lit(pos).alias("pos"), symbol.alias("symbol"), F.lit(attach).cast("int").alias("attach"))
    nodes = flags.select("text", F.inline(F.array(atom(0, F.col("text"), 0), atom(1, F.concat("text", F.lit("2")), None))))
    return nodes, flags.select("text", F.lit(0).alias("p"), F.lit(1).alias("q"), F.lit("DOUBLE").alias("class"))


@query(f"""with {EDGES}, n as (select image_id, idx, case when idx = 1 then flag end as text from {{graph}}), fit as (select image_id from n where idx = 1 and exists (select 1 from edges e where e.image_id = n.image_id and e.b = 1)),
last as (select image_id, max(idx) as last from n group by 1)
select image_id, case when b = 1 and image_id in (from fit) then last + 1 else b end as b, e, class from edges join last using (image_id) union all select image_id, last + 1, last + 2, 'DOUBLE' from fit join last using (image_id)""")
def expand_superatoms(t):
    return _expanded(t)[1]


@query(f"""with {EDGES}, fit as (select image_id, flag from {{graph}} n where idx = 1 and exists (select 1 from edges e where e.image_id = n.image_id and e.b = 1)),
size as (select image_id, max(idx) as n from {{graph}} group by 1)
select image_id, cast(idx as bigint) as idx, case when idx = 1 then 'R' else 'C' end as class from {{graph}} where not (idx = 1 and image_id in (select image_id from fit))
union all select image_id, n + 1, flag from fit join size using (image_id) union all select image_id, n + 2, flag || '2' from fit join size using (image_id)""")
def expanded_nodes(t):
    return _expanded(t)[0]


def _expanded(t):
    nodes = t.graph.select("image_id", "idx", F.when(F.col("idx") == 1, "R").otherwise("C").alias("class"), F.when(F.col("idx") == 1, F.col("flag")).alias("text"))
    return graph.expand_superatoms(nodes, _edges(t), *_fragments(t))


@query(f"""with {EDGES}, size as (select image_id, max(idx) as n from {{graph}} group by 1), closed as (select image_id from size join (select image_id, count(*) as m from edges group by 1) using (image_id) where n >= 3 and m = n - 1),
every as (select image_id, b, e, class from edges union all select image_id, 1, n, 'AROMATIC' from size where n >= 3)
select image_id, cast(b as bigint) as b, cast(e as bigint) as e, case when class = 'AROMATIC' and image_id not in (select image_id from closed) then 'SINGLE' else class end as class from every""")
def non_ring(t):
    """Orders of three or more lines with a link from the first to the last: a ring if no link between is missing."""
    ends = t.graph.groupBy("image_id").agg(F.max("idx").alias("e")).where("e >= 3").select("image_id", F.lit(1).alias("b"), "e", F.lit("AROMATIC").alias("class"))
    return graph.aromatic_outside_rings(_edges(t).select("image_id", "b", "e", "class").unionByName(ends))


def _rings(t):
    """The lines of an order as one ring, and its first half again as another that shares edges with it."""
    ring = t.graph.select("image_id", F.lit(0).alias("ring_id"), F.col("idx").alias("pos"), F.col("idx").alias("b"), (F.col("idx") + 1).alias("e"), F.when(F.col("q") % 3 == 0, "SINGLE").otherwise("AROMATIC").alias("class"))
    return ring.unionByName(ring.where("pos <= 3").withColumn("ring_id", F.lit(1)))


@query("""with r as (select image_id, idx, case when q % 3 = 0 then 'SINGLE' else 'AROMATIC' end as class from {graph}),
one as (select image_id, count(*) filter (class = 'AROMATIC') as a, count(*) filter (class = 'SINGLE') as s, first(class order by idx) as f from r group by 1),
st as (select r.*, case when one.a > one.s or (one.a = one.s and one.f = 'AROMATIC') then 'AROMATIC' else r.class end as c1 from r join one using (image_id)),
two as (select image_id, count(*) filter (c1 = 'AROMATIC') as a, count(*) filter (c1 = 'SINGLE') as s, first(c1 order by idx) as f from st where idx <= 3 group by 1)
select st.image_id, cast(idx as bigint) as b, cast(idx + 1 as bigint) as e, case when idx <= 3 and (two.a > two.s or (two.a = two.s and two.f = 'AROMATIC')) then 'AROMATIC' else c1 end as class from st left join two using (image_id)""")
def ring_majority(t):
    return graph.majority_ring_class(_rings(t))


@query("select image_id, count(*) as largest_ring_size from {graph} group by 1")
def ring_profile(t):
    return graph.ring_profile(t.graph.select("image_id").distinct(), _rings(t))


def _counted(k: int, rows: str) -> str:
    """SQL: degrees and parts of the paths in rows (image_id, idx, r, split, nx), nx being 1 where a node is linked with the next."""
    return f"""d{k} as (select *, nx + coalesce(lag(nx) over (partition by image_id order by idx), 0) as degree from {rows}),
c{k} as (select image_id, count(*) - sum(nx) as raw, count(*) - sum(nx) + count(*) filter (r and split and degree = 2) as solved, bool_or(r) as r from d{k} group by 1)"""


@query(f"""with g as (select image_id, idx, flag = 'R' as r, l_partkey % 3 = 0 as split, idx % 3 = 1 and l_suppkey % 2 = 0 as boxed, l_suppkey // 2 % 4 as label, case when q % 5 != 0 and lead(idx) over (partition by image_id order by idx) is not null then 1 else 0 end as nx from {{graph}}),
{_counted(1, "g")},
h as (select *, case when coalesce(lag(boxed) over (partition by image_id order by idx), false) then idx - 1 else idx end as head from g),
m as (select image_id, head as idx, bool_or(r) or (count(*) = 2 and arg_min(label, idx) < 3) as r, case when count(*) = 2 then arg_min(label, idx) = 0 else bool_or(split) end as split, arg_max(nx, idx) as nx from h group by 1, 2),
{_counted(2, "m")},
p as (select image_id, count(*) - sum(nx) as raw from d2 where degree > 0 group by 1)
select c1.image_id, case when c1.solved = 1 then case when c1.r then 'resolved' else 'as_is' end when c2.solved = 1 then 'merged' when c2.raw = 1 then 'unresolved' when p.raw = 1 then 'pruned' else 'sentinel' end as status
from c1 join c2 on c2.image_id = c1.image_id left join p on p.image_id = c1.image_id""")
def molecule_status(t):
    """The lines of an order in a row, boxes around some pairs of neighbours; a label is two atoms apart, two linked atoms, one atom, or, of boxes, none that
    the dictionary has."""
    kinds = [F.lit(k) for k in ("split", "pair", "one")]
    at = (F.col("idx") * 100).alias("x")
    nodes = t.graph.select("image_id", "idx", at, F.lit(0).alias("y"), F.when(F.col("flag") == "R", "R").otherwise("C").alias("class"), F.get(F.array(*kinds), (F.col("l_partkey") % 3).cast("int")).alias("text"))
    boxes = t.graph.where("idx % 3 = 1 and l_suppkey % 2 = 0").selectExpr("image_id", "idx as box_id", "idx * 100 - 10 as x0", "-10 as y0", "idx * 100 + 110 as x1", "10 as y1", "element_at(array('split', 'pair', 'one', 'unheard of'), cast(l_suppkey div 2 % 4 + 1 as int)) as text")
    frag_nodes = t.spark.sql("select * from values ('split', 0, 'C', 0), ('split', 1, 'C', 1), ('pair', 0, 'C', 0), ('pair', 1, 'C', 1), ('one', 0, 'C', 0) as f(text, pos, symbol, attach)")
    frag_edges = t.spark.sql("select 'pair' as text, 0 as p, 1 as q, 'SINGLE' as class")
    return graph.molecule_status(nodes, _edges(t), boxes, (frag_nodes, frag_edges))


GRAPHED = f"""{LOWER}, {SIZE}, {NEAR}, {PROPOSED}, {INKED},
drawn as (select image_id, b, e from side s where exists (select 1 from {{ink}} i where i.image_id = s.image_id and i.x >= cx - floor(side / 2) and i.x < cx + side - floor(side / 2) and i.y >= cy - floor(side / 2) and i.y < cy + side - floor(side / 2))),
kept as (select image_id, idx, x, y, ((idx * 7 + x) % 5 + 5) % 5 = 1 as r, row_number() over (partition by image_id order by idx) - 1 as node from {{kp}} where ((idx * 7 + x) % 5 + 5) % 5 != 0),
bond as (select d.image_id, p.node as b, q.node as e from drawn d join kept p on p.image_id = d.image_id and p.idx = d.b join kept q on q.image_id = d.image_id and q.idx = d.e where (d.b + d.e) % 4 != 0),
taken as (select k.image_id, node, min(box_id) as box_id from kept k join {{boxes}} x on x.image_id = k.image_id and k.x between x0 and x1 and k.y between y0 and y1 where r group by 1, 2)"""


def _graphed(t):
    """Keypoints to predicted graphs: candidate edges with ink, predicted classes, empty ones dropped."""
    kp = geometry.cap_keypoints(t.kp)
    nodes, edges = graph.graph_from_keypoints(kp, geometry.propose_edges(kp, ink=t.ink))
    kind = F.pmod(F.col("idx") * 7 + F.col("x"), F.lit(5))
    nodes = nodes.withColumn("class", F.when(kind == 0, "None").when(kind == 1, "R").otherwise("C"))
    edges = edges.withColumn("class", F.when((F.col("b") + F.col("e")) % 4 == 0, "None").otherwise("SINGLE"))
    return graph.apply_predictions(nodes, edges)


def _count(df, name):
    return df.groupBy("image_id").agg(F.count("*").alias(name))


@query(f"""with recursive {GRAPHED},
ways as (select image_id, b, e from bond union all select image_id, e, b from bond),
reach as (select image_id, node, node as seen from kept union select reach.image_id, node, e from reach join ways on ways.image_id = reach.image_id and b = seen)
select n.image_id, atoms, coalesce(bonds, 0) as bonds, coalesce(labelled, 0) as labelled, fragments from (select image_id, count(*) as atoms from kept group by 1) n
left join (select image_id, count(*) as bonds from bond group by 1) using (image_id) left join (select image_id, count(distinct box_id) as labelled from taken group by 1) using (image_id)
left join (select image_id, count(distinct least_seen) as fragments from (select image_id, node, min(seen) as least_seen from reach group by 1, 2) group by 1) using (image_id)""")
def annotate(t):
    """From keypoints to a summary of each image's graph, with labels on nodes and fragments."""
    nodes, edges = _graphed(t)
    out = _count(nodes, "atoms").join(_count(edges, "bonds"), "image_id", "left").join(_count(graph.labels_on_nodes(nodes, t.boxes), "labelled"), "image_id", "left")
    return out.join(loops.fragment_counts(nodes, edges), "image_id", "left").na.fill(0, ["bonds", "labelled"])


#: What is read in a box: a brand, in half of the boxes with a letter in place of a digit.
READ = "'Brand#' || cast(box_id % 5 + 1 as string) || case when box_id % 2 = 0 then cast(box_id % 3 + 1 as string) else 'l' end"


@query(f"""with {GRAPHED}, held as (select image_id, box_id, min(node) as node from taken group by 1, 2), seen as (select image_id, node, {READ} as text from held),
fixed as (select s.text, coalesce(any_value(x.entry), first(d.entry order by levenshtein(s.text, d.entry), d.population desc, d.position)) as entry from (select distinct text from seen) s cross join {{dictionary}} d left join {{dictionary}} x on x.entry = s.text group by 1),
label as (select image_id, list(s.text order by node) as ocr, list(entry order by node) as found, count(*) as n from seen s join fixed using (text) group by 1),
atom as (select image_id, count(*) as atoms from kept group by 1), bonded as (select image_id, count(*) as bonds from bond group by 1)
select image_id as filename, 'A' || atoms || 'B' || coalesce(bonds, 0) as smi, round(1 - coalesce(n, 0) / atoms, 3) as conf, coalesce(found, []) as abbreviations, coalesce(ocr, []) as abbreviations_ocr, round(coalesce(bond_size, 100), 2) as bond_size
from atom left join bonded using (image_id) left join label using (image_id) left join size using (image_id)""")
def annotate_log(t):
    """The whole chain: graphs, bond sizes to their file, texts of boxes on nodes, spelling, and the annotation log, all read back. A toolkit would write the
    molecule; here its numbers of atoms and bonds stand for it."""
    nodes, edges = _graphed(t)
    sizes, log = new_path(t.spark, "bond-sizes"), new_path(t.spark, "annotations")
    sinks.write_bond_sizes(geometry.bond_size(geometry.cap_keypoints(t.kp)), sizes)
    placed = graph.labels_on_nodes(nodes, t.boxes)
    read = placed.select("image_id", "idx", F.expr(READ).alias("text"))
    fixed = labels.correct_spelling(read, t.dictionary.select("entry", "population", "position"), weighted=False)
    texts = fixed.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "corrected"))).alias("x"))
    rows = _count(nodes, "atoms").join(_count(edges, "bonds"), "image_id", "left").join(texts, "image_id", "left").na.fill(0, ["bonds"])
    none = F.array().cast("array<string>")
    found = [F.coalesce(F.col(f"x.{c}"), none).alias(name) for c, name in (("corrected", "abbreviations"), ("text", "abbreviations_ocr"))]
    smiles, conf = metrics.confidence_override(F.concat(F.lit("A"), "atoms", F.lit("B"), "bonds"), F.round(1 - F.coalesce(F.size("x"), F.lit(0)) / F.col("atoms"), 3))
    sinks.write_annotations(rows.select(smiles.alias("smiles"), conf.alias("conf"), F.col("image_id").alias("filename"), *found), log)
    back = readers.read_predictions(t.spark, log).select(F.col("`file-info`.filename").alias("filename"), "smi", "conf", "abbreviations", "abbreviations_ocr")
    return back.join(t.spark.read.schema("name string, bond_size double").json(sizes).withColumnRenamed("name", "filename"), "filename")
