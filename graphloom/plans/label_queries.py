"""Queries over label text and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import labels
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

GROUPS = "g as (select replace(replace(replace(replace(replace(replace('^' || p_type || '\\s', '^', ''), '\\s', ''), '\\n', ''), '\\S', ''), '\\r', ''), chr(13), '') as label, p_brand as smiles from {part} where p_type not in ('a', 'O(H)') and not contains(p_type, ':') and not contains(p_brand, '.'))"


def _groups(t):
    raw = t.part.select(F.concat(F.lit("^"), "p_type", F.lit("\\s")).alias("label"), F.col("p_brand").alias("smiles"))
    clean = raw.withColumn("label", text.clean_label(F.col("label")))
    return clean.where(text.valid_label(F.col("label"), F.col("smiles")))


@query(f"with {GROUPS}, n as (select label, smiles, count(*) as n from g group by all) select label, cast(sum(n) as bigint) as population, first(smiles order by n desc, smiles) as smiles from n group by 1")
def dictionary_mine(t):
    return labels.dictionary_from_labels(_groups(t))


@query(f"with {GROUPS} select label, count(*) as population, list_sort(list(distinct smiles)) as smiles from g group by 1")
def dictionary_all(t):
    return labels.dictionary_all_smiles(_groups(t))


@query("select text, coalesce(first(entry order by d, population desc, position), text) as corrected from (select n.text, d.entry, d.population, d.position, levenshtein(n.text, d.entry) as d from {noisy} n left join {dictionary} d on levenshtein(n.text, d.entry) < 150 and not exists (select 1 from {dictionary} x where x.entry = n.text)) group by text")
def spelling(t):
    return labels.correct_spelling(t.noisy, t.dictionary.drop("smiles"), weighted=False).select("text", "corrected")


@query()
def spelling_weighted(t):
    return labels.correct_spelling(t.noisy, t.dictionary.drop("smiles")).select("text", "corrected", "dist")


CAPTION = """case when n > 10 and kept < n / 3 then 'remove' when n > 10 then 'filter' when n > 2 and kept < n / 2 then 'filter'
when regexp_matches(word, '^[0-9]+$') and regexp_matches(word, '[1-9]') and score >= 0.85 then 'filter' when n > 2 and commas > 2 then 'filter' when n = 2 and regexp_matches(word, '[():]') then 'filter' end"""


#: Every word of every document as a text found in a drawing; its score by where it stands.
WORDS = "words as (select doc_id, spot, word, (spot % 10) / 10.0 as score from (select doc_id, unnest(string_split(text, ' ')) as word, unnest(range(len(string_split(text, ' ')))) as spot from {documents}))"
FLAGGED = f"{WORDS}, flagged as (select doc_id, spot, {CAPTION} as flag from (select *, length(word) as n, length(regexp_replace(word, '[^CcNHOohn]', '', 'g')) as kept, length(word) - length(replace(word, ',', '')) as commas from words))"


def _words(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("spot", "word"))
    return rows.withColumn("score", (F.col("spot") % 10) / 10)


@query(f"with {FLAGGED} select doc_id, flag, count(*) as words, sum(spot) as places from flagged where flag is not null group by 1, 2")
def caption_flags(t):
    flags = _words(t).select("doc_id", "spot", text.caption_flag(F.col("word"), F.col("score")).alias("flag")).where("flag is not null")
    return flags.groupBy("doc_id", "flag").agg(F.count("*").alias("words"), F.sum("spot").alias("places"))


@query(f"with {FLAGGED} select doc_id, bool_or(flag is not null) as filter_masks, coalesce(list_sort(list(spot) filter (flag = 'remove')), []) as removed from flagged group by 1")
def caption_decision(t):
    return text.caption_decision(_words(t), "doc_id", "spot").select("doc_id", "filter_masks", F.col("removed").cast("array<long>").alias("removed"))


PARTS = "['C', 'S', 'F2', 'O2', 'Oz', 'N', 'Fz']"


@query(f"""select conv_id, turn, case when list_contains(parts, 'C') and list_has_any(parts, ['F2', 'Fz']) then 'CF2' when list_contains(parts, 'S') and list_has_any(parts, ['O2', '02', 'Oz', '0z']) then 'SO2' end as label
from (select conv_id, turn, [{PARTS}[length(text) % 7 + 1], {PARTS}[(conv_id + turn) % 7 + 1], {PARTS}[(conv_id * 3) % 7 + 1]] as parts from {{conversations}})""")
def fuse_parts(t):
    names = F.array(*[F.lit(x) for x in ("C", "S", "F2", "O2", "Oz", "N", "Fz")])
    pick = lambda e: F.element_at(names, (e % 7 + 1).cast("int"))
    rows = t.conversations.select("conv_id", "turn", F.array(pick(F.length("text")), pick(F.col("conv_id") + F.col("turn")), pick(F.col("conv_id") * 3)).alias("parts"))
    return rows.select("conv_id", "turn", text.fused_label(F.col("parts")).alias("label"))


_ATOMS = "['" + "', '".join(text.EXOTIC_ATOMS) + "']"
_TOKEN = text.SMILES_TOKEN


#: A string like SMILES for every word: an atom of its first two characters between carbons, chiral where it stands at every fifth place.
@query(f"""with w as (select doc_id, unnest(string_split(text, ' ')) as word, unnest(range(len(string_split(text, ' ')))) as spot from {{documents}}),
s as (select doc_id, 'CC[' || upper(left(word, 1)) || lower(substring(word, 2, 1)) || case when spot % 5 = 0 then '@H' else '' end || ']Br' as s from w where regexp_matches(word, '^[A-Za-z][A-Za-z]'))
select doc_id, count(*) as strings, count(*) filter (contains(s, '@')) as stereo, count(*) filter (list_has_any(list_transform(regexp_extract_all(s, '{_TOKEN}', 1), lambda x: regexp_replace(x, '[\\[\\]H@]', '', 'g')), {_ATOMS})) as exotic from s group by 1""")
def smiles_flags(t):
    words = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("spot", "word")).where(F.col("word").rlike("^[A-Za-z][A-Za-z]"))
    chiral = F.when(F.col("spot") % 5 == 0, "@H").otherwise("")
    s = F.concat(F.lit("CC["), F.upper(F.left("word", F.lit(1))), F.lower(F.substring("word", 2, 1)), chiral, F.lit("]Br"))
    one = lambda c: F.count(F.when(c, 1))
    return words.select("doc_id", s.alias("s")).groupBy("doc_id").agg(F.count("*").alias("strings"), one(text.has_stereo(F.col("s"))).alias("stereo"), one(text.has_exotic_atom(F.col("s"))).alias("exotic"))


BONDED = """b as (select l_orderkey as file, l_partkey as b, l_suppkey + 1000000 as e, case when l_returnflag = 'N' then 'DOUBLE' else 'SINGLE' end as type from {lineitem}),
g as (select distinct l_orderkey as file, l_linestatus as group_id, l_partkey as atom from {lineitem} where l_linenumber % 2 = 1)"""
_OUTSIDE = "select distinct g.file, g.group_id, other as atom from g join ends using (file, atom) where not exists (select 1 from g x where x.file = g.file and x.group_id = g.group_id and x.atom = other)"


def _attachments(t, exactly_one):
    bonds = t.lineitem.select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("b"), (F.col("l_suppkey") + 1_000_000).alias("e"), F.when(F.col("l_returnflag") == "N", "DOUBLE").otherwise("SINGLE").alias("type"))
    atoms = t.lineitem.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("file"), F.col("l_linestatus").alias("group_id"), F.col("l_partkey").alias("atom")).distinct()
    return labels.label_attachments(atoms, bonds, exactly_one)


@query(f"with {BONDED}, ends as (select file, b as atom, e as other from b where type = 'SINGLE' union all select file, e, b from b where type = 'SINGLE') {_OUTSIDE}")
def attachments(t):
    return _attachments(t, False)


@query(f"with {BONDED}, ends as (select file, b as atom, e as other from b union all select file, e, b from b) select file, group_id, min(atom) as atom from ({_OUTSIDE}) group by 1, 2 having count(*) = 1")
def single_attachments(t):
    return _attachments(t, True)


@query("select image_id, x, y, list_sort(list(idx)) as atoms from (select image_id, idx, cast(floor(x / 50.0) as int) as x, cast(floor(y / 50.0) as int) as y from {kp}) group by 1, 2, 3 having count(*) > 1")
def coincident(t):
    kp = t.kp.select("image_id", "idx", F.floor(F.col("x") / 50).cast("int").alias("x"), F.floor(F.col("y") / 50).cast("int").alias("y"))
    return labels.coincident_atoms(kp)


@query("select case when charge != 0 then symbol || ',' || charge else symbol end as symbol, count(*) as population from (select p_brand as symbol, cast(p_size % 3 - 1 as int) as charge from {part}) where symbol != 'Brand' || chr(35) || '11' group by 1")
def atom_population(t):
    atoms = t.part.select(F.col("p_brand").alias("symbol"), (F.col("p_size") % 3 - 1).cast("int").alias("charge"))
    return labels.atom_population(atoms, ["Brand#11"])


@query("select p_partkey, 'C' || p_size as symbol, cast(p_size % 5 - 2 as int) as charge, case when p_size % 2 = 0 then cast(p_size as int) end as isotope from {part}")
def symbol_parts(t):
    charged = F.concat(F.lit("C"), "p_size", F.lit(","), (F.col("p_size") % 5 - 2).cast("int").cast("string"))
    heavy = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("C;"), F.col("p_size").cast("string"))).otherwise("C")
    return t.part.select("p_partkey", text.symbol_part(charged, "symbol").alias("symbol"), text.symbol_part(charged, "charge").alias("charge"), text.symbol_part(heavy, "isotope").alias("isotope"))


@query("""select n.text, case when a.entry is not null then 'atom' when d.entry is not null then 'fragment' else 'alias' end as kind, coalesce(a.smiles, d.smiles, '[' || n.text || ']') as value
from (select text from {noisy} union select p_brand from {part} union select n_name from {nation}) n left join (select * from {dictionary} where position % 2 = 0) a on a.entry = n.text left join {dictionary} d on d.entry = n.text""")
def label_nodes(t):
    texts = t.noisy.union(t.part.select("p_brand")).union(t.nation.select("n_name")).distinct()
    entries = t.dictionary.select(F.col("entry").alias("text"), "smiles", "position")
    return labels.label_to_node(texts, entries.where("position % 2 = 0").select("text", F.col("smiles").alias("symbol")), entries)


@query("select entry, population, rank() over (order by population desc) as rank from (select entry, population from {dictionary} where not exists (select 1 from {nation} where n_name = entry) union all select n_name, n_nationkey from {nation})")
def dictionary_merge(t):
    right = t.nation.select(F.col("n_name").alias("entry"), F.col("n_nationkey").cast("long").alias("population"))
    merged = labels.merge_dictionaries(t.dictionary.select("entry", "population"), right, "entry")
    return labels.rank_dictionary(merged).select("entry", "population", F.col("rank").cast("long").alias("rank"))
