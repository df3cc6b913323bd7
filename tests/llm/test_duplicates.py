"""Operators 9 and 10, components, and the pipeline."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from emberlane.llm import common, near_dup, tiles, vectors
from emberlane.llm.components import components


def groups_by_hand(links, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups_by_hand(edges, {n for e in edges for n in e})
    assert all(got.get(n, n) == g for n, g in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes():
    texts = [b"", b" a  b\x0bc ", b"x" * 70_000 + b" y", "é ü".encode()]
    hashes, owner, size = common.hash_words(texts)
    words = [(i, w) for i, t in enumerate(texts) for w in t.split()]
    assert [(int(o), int(n)) for o, n in zip(owner, size)] == [(i, len(w)) for i, w in words]
    assert [int(h) for h in hashes] == [common._slow_hash(w) for _, w in words]


def variants(rnd, words, n, share):
    return [" ".join(rnd.choice(words) if rnd.random() < share else w for w in words) for _ in range(n)]


def test_op9_brute_force(spark):
    rnd = random.Random(9)
    vocabulary = ["w%d" % i for i in range(3000)]
    texts = [None, "", " \n", "one two", "ONE two", "one  two", "É x", "é x"]
    for _ in range(12):  # groups of near copies on either side of the threshold, some large
        base = rnd.choices(vocabulary, k=rnd.randint(20, 200))
        texts += variants(rnd, base, rnd.choice((3, 40)), rnd.choice((0.005, 0.02, 0.04, 0.08)))
    base = rnd.choices(vocabulary, k=150)
    texts += variants(rnd, base, 700, 0.02) + [" ".join(base)] * 300  # beyond one tile
    passage = " ".join(rnd.choices(vocabulary, k=60))
    texts += [f"{passage} {' '.join(rnd.choices(vocabulary, k=50))}" for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "one two", "x"), (None, "one two", "x")], "doc_id long, text string, n_shingles string")
    sets = [shingles_by_hand(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = groups_by_hand(links, range(len(texts)))
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_op9_odd_rows(odd_docs, no_docs):
    assert near_dup.near_duplicates(odd_docs).count() == odd_docs.count()
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_op9_same_as_sql(same_as_sql):
    same_as_sql(near_dup.op9_minhash_dedup, near_dup.ORACLE["op9_minhash_dedup"])


def test_op10_same_as_sql(same_as_sql):
    same_as_sql(vectors.op10_embedding_dedup, vectors.ORACLE["op10_embedding_dedup"])


def test_op10_brute_force(spark):
    rnd = np.random.default_rng(11)
    rows = [rnd.normal(size=32) for _ in range(900)]
    for spread, n in ((0.05, 1000), (0.15, 60), (0.25, 40)):  # one group beyond a tile
        centre = rnd.normal(size=32)
        rows += [centre + spread * rnd.normal(size=32) for _ in range(n)]
    rows += [rows[-1]] * 30 + [rows[-1] * 4.0] * 5
    x = np.stack(rows) / np.linalg.norm(rows, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    data = [(i, r.tolist(), i % 3) for i, r in enumerate(rows)] + [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 32, 0), (9004, [float("nan")] * 32, 0), (9005, [None] * 32, 0), (9006, [1.0, 2.0], 0), (9007, [1.0, 2.0], 0), (None, rows[0].tolist(), 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(data)
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert found.sum() >= 0.9 * near.sum() and (found <= near.sum(axis=1)).all()
    want = groups_by_hand(np.argwhere(near).tolist(), range(len(rows)))
    assert sum(got[i].component_id == want[i] for i in want) >= 0.97 * len(rows)
    assert all(got[i].n_links == 0 and got[i].kept for i in (9001, 9002, 9003, 9004, 9005, None))
    assert got[9006].n_links == got[9007].n_links == 1 and got[9007].component_id == 9006
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_op10_links_across_shards(spark, monkeypatch):
    """With one probe and small shards many linked vectors share none; their links are found all the same."""
    monkeypatch.setattr(vectors, "SHARD", 20)
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(400, 32))
    x = np.concatenate((base, base + 0.28 * rnd.normal(size=base.shape)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    home = (x @ vectors.fit_centroids(x, 40).T).argmax(axis=1)
    assert (near & (home[:, None] != home[None, :])).sum() >= 10
    monkeypatch.setattr(vectors, "LEAST_RECALL", 0.0)  # no second try with more probes
    rows = vectors.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), probes=1).collect()
    assert {r.vec_id: r.n_links for r in rows} == dict(enumerate(near.sum(axis=1).tolist()))


def test_op10_audit_draws_until_links_are_met(spark):
    """One linked pair among 3,000 vectors, one of them with many copies: the audit goes on drawing and counts vectors, not copies."""
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(3000, 32))
    x[1] = x[0] + 0.01 * rnd.normal(size=32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    reps = spark.createDataFrame([(i, r.astype("<f8").tobytes(), 50 if i == 0 else 1) for i, r in enumerate(x)], "doc long, unit binary, n long")
    assert vectors.audit(reps) == {0: 1, 1: 1}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    twice = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    for clash in ("kept", "score", "evidence", "predicted", "n_words", "words"):
        twice = twice.withColumn(clash, F.lit("mine"))
    columns = twice.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-dedup", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = common.materialize(stage(spark, twice, sf_dir))
        if i < 3:
            assert after.columns == columns and after.where("kept <> 'mine' or score <> 'mine' or words <> 'mine'").count() == 0
            assert after.count() <= twice.count()
            assert after.join(docs, ["doc_id", "text"], "left_semi").count() == after.where("doc_id is not null").count()
        twice = after
    assert corpus_pipeline.run(spark, sf_dir).agg(F.countDistinct("doc_id")).first()[0] > 50


def test_clusters_across_chunks(spark):
    """Long groups: documents that no chunk connects are still compared across components, and work stays in proportion for a group of copies."""
    rnd = np.random.default_rng(8)
    values = {1: np.unique(rnd.integers(0, 4000, 900)), 2: np.arange(700), 3: np.concatenate((np.full(900, 5000), [9000, 9001, 5001, 7000]))}
    rows = [(g, g * 10_000 + i, int(v).to_bytes(8, "little")) for g, vs in values.items() for i, v in enumerate(vs)]

    def work(docs, side, items):
        one, two = tiles.sides(side)
        at = np.array([int.from_bytes(i, "little") for i in items])
        linked = np.abs(at[one][:, None] - at[two][None, :]) <= 2
        linked &= docs[one][:, None] != docs[two][None, :]
        return tiles.forest(linked, docs[one], docs[two])

    data = spark.createDataFrame(rows, "g long, doc long, item binary")
    got = {r.v: r.component for r in tiles.clusters_of(data.select("g", "doc"), "g", lambda m: m.join(data, ["g", "doc"]), "item", work, 64).collect()}
    links = [(g * 10_000 + i, g * 10_000 + j) for g in (1, 2) for i in range(len(values[g])) for j in range(i + 1, min(i + 5, len(values[g]))) if values[g][j] - values[g][i] <= 2]
    links += [(30_000, 30_000 + i) for i in range(900)] + [(30_000, 30_902), (30_900, 30_901)]
    want = groups_by_hand(links, [d for _, d, _ in rows])
    assert {d: got.get(d, d) for _, d, _ in rows} == want


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rnd = np.random.default_rng(4)
    edges = [(0, int(x)) for x in rnd.permutation(3000)[:800]] + [(int(a), int(a) + 1) for a in range(5000, 5400)] + [(int(a), int(b)) for a, b in rnd.integers(6000, 9000, (1500, 2))] + [(7, 7)]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups_by_hand(edges, {v for e in edges for v in e})
    assert {v: got.get(v, v) for v in want} == want


def test_pipeline_keeps_every_text(spark):
    """Only rows equal in id and text are folded, and of near-duplicates one stays, as by brute force."""
    import corpus_pipeline

    rnd = random.Random(3)
    base = [" ".join("w%d" % rnd.randint(0, 5000) for _ in range(80)) for _ in range(6)]
    near = lambda t: t + " tail"
    rows = [(1, base[0]), (1, base[1]), (2, base[2]), (2, base[2]), (3, near(base[2])), (4, base[3]), (5, near(base[1])), (6, None), (6, base[4]), (7, base[5]), (8, base[5]), (None, base[0]), (None, base[0]), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "'k' as _key", "text", "'c' as c1")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, base[0]), (2, base[2]), (4, base[3]), (5, near(base[1])), (6, None), (6, base[4]), (7, base[5]), (None, base[0]), (None, base[0]), (9, "")], key=repr)
    alone = docs.where("doc_id <> 1 and doc_id <> 6")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, alone, "").collect()}
    assert got == {(2, base[2]), (4, base[3]), (5, near(base[1])), (7, base[5]), (9, "")}


def test_pipeline_stages_against_their_operators(spark, sf_dir):
    """What the first two stages keep is what the operators' columns say, row by row."""
    import corpus_pipeline

    from emberlane.llm import quality, toxicity

    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.labelled_rows(docs, labels))
    clean = {r.doc_id for r in docs.select("doc_id", "text").collect() if not r.text or 1 / (1 + np.exp(-(model.intercept + model.slope * (1 - np.exp(-toxicity.SATURATION * toxicity.Scorer(model.lexicon).evidence(r.text)))))) < 0.5}
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()} == clean
    field = quality.fit(quality.labelled_rows(docs, labels))
    good = {r.doc_id for r in quality.measure(docs, field).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_poor(spark, docs, sf_dir).collect()} == good


def test_pipeline_packs_in_one_python_pass_and_moves_no_text_of_single_ids(spark):
    """Two passes kept four Python workers in each executor, and every text was dealt out by id three times before near-dedup."""
    import corpus_pipeline

    from emberlane.llm import packing

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(1, "a b"), (2, "b"), (3, None)], "doc_id long, text string")
    assert "Exchange" not in plan(corpus_pipeline._keyed(docs))
    packed = corpus_pipeline.pack(spark, docs, "")
    assert plan(packed).count("MapInArrow") == 1
    assert sorted(packed.drop("sequence_id", "offset").collect()) == sorted(packing.digests(packing.pack(docs, corpus_pipeline.VOCABULARY)).drop("sequence_id", "offset").collect())
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None), (2, "b"), (3, "c"), (4, None), (4, None)], "doc_id long, text string")
    rows = corpus_pipeline._keyed(docs).collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == [(1, "a"), (2, ""), (2, "b"), (3, "c"), (4, "")]
    assert all(r["_key"] == r.doc_id if r.doc_id != 2 else r["_key"] > 4 for r in rows) and len({r["_key"] for r in rows}) == 5
