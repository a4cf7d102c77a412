"""Views that map the given tables onto the shapes of image graphs, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Images are as many as the table has thousands of vectors, for each label, so none grows with it. `embedding#3` is the fourth value; other views are named in braces.
VIEWS = {
    "kp": "select cast(label as string) || '-' || cast(cast(floor(vec_id / 1000) as int) as string) as image_id, cast(row_number() over (partition by label, floor(vec_id / 1000) order by vec_id) - 1 as int) as idx, cast(floor(1000 * cast(embedding#0 as double)) as int) as x, cast(floor(1000 * cast(embedding#1 as double)) as int) as y, vec_id from {embeddings}",
    "pred": "select image_id, idx, cast(x + (vec_id * 7919) % 41 - 20 as int) as x, cast(y + (vec_id * 104729) % 41 - 20 as int) as y from {kp}",
    "ink": "select cast(label as string) || '-' || cast(cast(floor(vec_id / 1000) as int) as string) as image_id, cast(floor(1000 * cast(embedding#2 as double)) as int) as x, cast(floor(1000 * cast(embedding#3 as double)) as int) as y from {embeddings} union all select cast(label as string) || '-' || cast(cast(floor(vec_id / 1000) as int) as string) as image_id, cast(floor(1000 * cast(embedding#4 as double)) as int) as x, cast(floor(1000 * cast(embedding#5 as double)) as int) as y from {embeddings}",
    "boxes": "select image_id, idx as box_id, x - 20 - idx % 7 as x0, y - 15 - idx % 5 as y0, x + 20 + idx % 3 as x1, y + 15 + idx % 4 as y1 from {kp}",
    "edges": "select a.image_id, a.idx as b, b.idx as e, cast(a.x as double) as bx, cast(a.y as double) as by, cast(b.x as double) as ex, cast(b.y as double) as ey, round(sqrt((cast(a.x as double) - b.x) * (cast(a.x as double) - b.x) + (cast(a.y as double) - b.y) * (cast(a.y as double) - b.y)), 6) as dist from {kp} a join {kp} b on a.image_id = b.image_id and a.idx > b.idx and a.idx - b.idx <= 3",
    "links": "select cast(floor(((year(l_shipdate) - 1990) * 366 + dayofyear(l_shipdate)) / 7) as int) as week, year(l_shipdate) * 1000 + dayofyear(l_shipdate) as day, o_custkey as b, 1000000000 + l_suppkey as e, l_quantity, l_orderkey * 10 + l_linenumber as edge_id from {lineitem} join {orders} on l_orderkey = o_orderkey",
    "runs": "select cast(user_id as string) as image_id, event_id as step, value as conf, event_type as pred from {events}",
    "truth": "select d.doc_id, l.quality as gt, case when d.n_chars > 500 then 1 else 0 end as pred, d.source as batch, d.lang as kind from {documents} d join {labels} l on d.doc_id = l.doc_id where l.quality is not null",
    "pairs": "select d.doc_id as id, b.text as gt, coalesce(d.text, '') as pred from {documents} d join {benchmark} b on b.item_id = d.doc_id % 40",
    "dictionary": "select entry, population, cast(row_number() over (order by entry) as int) as position, smiles from (select p_brand as entry, count(*) as population, min(p_name) as smiles from {part} group by p_brand union all select p_type, count(*), min(p_name) from {part} group by p_type union all select n_name, count(*), min(n_name) from {nation} group by n_name) x",
    "noisy": "select distinct substring(p_brand, 1, cast(p_partkey % 7 as int)) || substring('abc1xyz', cast(p_partkey % 5 + 1 as int), 1) || substring(p_brand, cast(p_partkey % 7 + 2 as int)) as text from {part}",
    "graph": "select cast(o_orderkey as string) as image_id, cast(row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as int) as idx, l_returnflag as flag, l_linestatus as status, cast(l_quantity as int) as q, l_partkey, l_suppkey from {lineitem} join {orders} on l_orderkey = o_orderkey",
}


def _views(text: str) -> list[str]:
    return [v for v in dict.fromkeys(re.findall(r"\{(\w+)\}", text)) if v in VIEWS]


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    made = {} if made is None else made
    if name not in made:
        text = re.sub(r"#(\d+)", r"[\1]", VIEWS[name])
        needs = dict.fromkeys(re.findall(r"\{(\w+)\}", text))
        made[name] = spark.sql(text, **{v: view(spark, sf_dir, v, made) for v in needs})
    return made[name]


def _quoted(text: str) -> str:
    """The column `by`, which DuckDB takes for a keyword, in quotes."""
    return re.sub(r"(?<!order )(?<!partition )(?<!group )\bby\b", '"by"', text)


def oracle(text: str) -> str:
    """DuckDB SQL with the views that it names in braces as common table expressions."""
    order: list[str] = []

    def need(t: str) -> None:
        for v in _views(t):
            if v not in order:
                need(VIEWS[v])
                order.append(v)

    need(text)
    text = _quoted(text)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", re.sub(r"#(\d+)", lambda m: f"[{int(m[1]) + 1}]", t))
    views = ", ".join(f"{v} as ({plain(_quoted(VIEWS[v]))})" for v in order)
    body = plain(text).strip()
    if not views:
        return body
    return f"with {'recursive ' if body.startswith('with recursive') else ''}{views}" + (", " + re.sub(r"^with (recursive )?", "", body) if body.startswith("with") else " " + body)
