"""The pipeline's stages, one after the other, on the smallest tables."""

from __future__ import annotations

import numpy as np
import pytest

pytest.importorskip("graphloom.llm")
pipeline = pytest.importorskip("corpus_pipeline")

FOLDER = "/root/testdata/sf0.001"


def test_stages_with_repeated_ids(spark):
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda df: sorted((r.doc_id, r.text or "", r.n_chars) for r in df.collect())
    exact = [(1, "x"), (1, "y"), (2, "X"), (2, "z"), (3, "x"), (3, "x"), (4, ""), (5, None)]
    last = {}
    for i, t in exact:
        last[(t or "").lower()] = max(i, last.get((t or "").lower(), 0))
    assert kept(pipeline.exact_dedup(spark, table(exact), FOLDER)) == sorted((i, t or "", len(t or "")) for i, t in exact if last[(t or "").lower()] == i)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    good, bad = (docs.where(f"quality = {k} and n_chars > 300").orderBy("n_chars").first().text for k in (1, 0))
    marked = [(900_001, good), (900_001, bad), (900_002, bad), (900_002, bad), (900_003, good), (900_003, good), (900_004, None)]
    assert [r for r in kept(pipeline.good_quality(spark, table(marked), FOLDER)) if r[1]] == sorted((i, t, len(t)) for i, t in marked if t == good)
    own = lambda k: " ".join(f"{k}w{j}" for j in range(60))
    passage = own("p")[:120]
    texts = [(1, passage + own("a")), (2, passage + own("b")), (2, own("c")), (3, own("d")), (3, own("e")), (4, None)]
    want = [(i, t[120:] if t and t.startswith(passage) and i == 2 else t or "") for i, t in texts]
    assert kept(pipeline.repeat_dedup(spark, table(texts), FOLDER)) == sorted((i, t, len(t)) for i, t in want)


def test_stages_against_brute_force(spark, tmp_path):
    from graphloom.llm import quality
    from test_llm_operators import LOWER, brute_bytes, brute_components

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.quality in (0, 1)}
    stages, texts = dict(pipeline.STAGES), {r.doc_id: r.text for r in docs.collect()}

    def after(name, docs):
        stages[name](spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        return out, {r.doc_id: r.text for r in out.collect()}

    docs1, kept1 = after("quality", docs)
    ids = sorted(i for i in texts if i in labels)
    counts = quality.terms([texts[i] or "" for i in ids])
    space = quality.Space.fit(counts, np.array([labels[i] for i in ids], float), 48)
    for i, t in texts.items():
        vector = space.project(quality.terms([t or ""]))[0]
        near = sorted(((float(vector @ v), labels[j]) for j, v in zip(ids, space.vectors, strict=True)), reverse=True)[:15]
        weight = [max(c, 1e-6) ** 8 for c, _ in near]
        score = sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight)
        if abs(score - 0.5) > 0.01:
            assert (i in kept1) == (score >= 0.5)
    docs2, kept2 = after("exact_dedup", docs1)
    last = {}
    for i, t in kept1.items():
        low = (t or "").translate(LOWER)
        last[low] = max(i, last.get(low, i))
    assert set(kept2) == set(last.values())
    docs3, kept3 = after("near_dedup", docs2)
    assert set(kept3) == {i for i, (_, least) in brute_components(list(kept2.items()), 5, 80, 100).items() if least == i}
    docs4, kept4 = after("repeat_dedup", docs3)
    brute = brute_bytes(list(kept3.items()), 100)
    assert {i: t or "" for i, t in kept4.items()} == {i: np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") for i, (raw, gone) in brute.items()}
    pieces = stages["packing"](spark, docs4, FOLDER).collect()
    places = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == places.get(p.sequence_id, 0)
        places[p.sequence_id] = p.offset + p.length
    assert max(places.values()) <= 2048 and {p.doc_id for p in pieces} == set(kept4)
    for i in kept4:
        own = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == i)
        assert [s for s, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    pieces = pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert pipeline.run(spark, FOLDER).count() == pieces.count()


def test_workers_drop_tokenizers_of_other_stages(spark):
    """Spark keeps its worker processes; what packing left there isn't carried through the next stages."""
    import os

    import pyarrow as pa
    from graphloom.llm import words

    def probe(batches):
        held = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(words._coders)]), pa.array([held])], ["pid", "coders", "held"])

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(8)
    pipeline.packed(spark, docs, FOLDER).collect()
    probed = lambda: docs.select("doc_id").mapInArrow(probe, "pid long, coders long, held long").collect()
    packers = {r.pid for r in probed() if r.coders}
    assert packers
    for _ in range(3):
        pipeline.good_quality(spark, docs, FOLDER).collect()
    assert not [r.pid for r in probed() if r.coders and r.pid in packers]


def jobs_of(spark, work):
    """Jobs that Spark runs for work()."""
    import uuid

    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def test_steps_leave_little_to_the_driver(spark, monkeypatch):
    """Finished tables go without a job, a lookup without frequent keys asks once, and what teaching took is given back."""
    import os

    from graphloom.llm import common, quality

    table = common.saved(spark.range(50), "gone")
    path = common.shared_dir(spark).removeprefix("file://")
    here = lambda: [x for x in os.listdir(path) if x.startswith("gone-")]
    assert len(here()) == 1
    assert jobs_of(spark, lambda: common.forget(table))[0] == 0
    assert not here()

    rows = spark.range(3000).selectExpr("id % 700 as k", "id")
    weights = rows.groupBy("k").count()
    once, _ = jobs_of(spark, lambda: weights.agg({"count": "sum"}).first())
    asked, joined = jobs_of(spark, lambda: common.look_up(rows, "k", weights, "count"))
    assert asked == once and joined.count() == 3000
    frequent = spark.range(3000).selectExpr("case when id < 2000 then -1 else id end as k", "id")
    assert common.look_up(frequent, "k", frequent.groupBy("k").count(), "count").where("k = -1 and count = 2000").count() == 2000
    assert common.look_up(rows.limit(0), "k", weights.limit(0), "count").count() == 0

    given = []
    monkeypatch.setattr(quality, "give_back", lambda: given.append(1), raising=False)
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    quality.train(docs, labels, 50)
    assert given == [1]
