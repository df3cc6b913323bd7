"""Operator 10: near-duplicate embeddings by a robust-pruned flat graph.

1. Vectors become unit vectors in double precision. Equal ones form a class, which goes
   on as one vector with a count.
2. Centroids are fitted to a bounded sample, and every vector joins the shards of its
   PROBES nearest centroids, so shards overlap. A large shard is cut into tiles, and the
   pairs of tiles are worked on separately.
3. In each shard a graph is built: the nearest CANDIDATES of a vector are thinned by
   robust pruning to DEGREE neighbours, and edges are made to point both ways. The
   adjacency lists of all shards are united into one flat graph.
4. Each shard's vectors are searched for along that graph: greedily from the shard's
   medoids and the vector's own place, then on from everything within range, until
   nothing within range is left unexpanded. Every pair found is confirmed by its cosine
   in double precision, counted in the first shard that both share, and a spanning
   forest of the pairs gives the components.
5. Pairs that share no shard are looked for apart: every vector also goes, as a sketch of
   BITS signs, to the cells of all centroids nearly as near as its nearest (``cells_of``),
   and pairs in a cell whose sketches are near are confirmed by their cosine.
6. Recall is audited: vectors are drawn, and compared with all rows by brute force, until
   they hold LEAST_LINKS links or MOST_AUDITED are drawn. If their mean share of links
   found is below LEAST_RECALL, the work is done again with more probes and wider cells;
   if they hold no link at all, recall is logged as not measured.

Defined cases: null, empty, zero and non-finite vectors, and vectors with a null
component, link with nothing and are returned; vectors of different lengths are not
compared; a null vec_id is kept, unlinked, with a null component; rows that share a
vec_id count as rows of one component; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm.common import bounded_sample, drop_table, join_counted, materialize, table
from emberlane.llm.components import components
from emberlane.llm.tiles import Rows, forest, into_tiles, per_run, sides

COSINE = 0.95
#: Rows that centroids are fitted to, vectors to a shard, shards to a vector, vectors to a tile.
SAMPLE, SHARD, PROBES, TILE = 16_384, 800, 2, 768
#: Neighbours considered and kept by robust pruning, and its slack.
CANDIDATES, DEGREE, ALPHA = 48, 20, 1.2
#: Expansions without a better vector before a greedy search ends; entry points of a shard.
PATIENCE, ENTRIES = 6, 4
AUDITED, MOST_AUDITED, LEAST_LINKS, LEAST_RECALL = 64, 4096, 200, 0.95
#: Cells reach so many standard deviations of the difference of a linked pair; signs of a sketch, their greatest difference in a pair that is confirmed, sketches to a tile.
REACH, BITS, DIFFER, SKETCHES = 5.0, 128, 34, 4096


def unit_vectors(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec, unit): the unit vector as little-endian doubles, null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                unit = None
                if row and all(x is not None for x in row):
                    x = np.array(row, np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top  # so that the norm neither overflows nor vanishes
                        unit = (x / np.linalg.norm(x) + 0.0).astype("<f8").tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec", "unit"])

    return df.select(F.col(key).cast("bigint"), vector).mapInArrow(run, "vec bigint, unit binary")


def fit_centroids(rows: np.ndarray, k: int, *, rounds: int = 5) -> np.ndarray:
    """Spherical k-means over unit vectors."""
    k = max(1, min(k, len(rows)))
    centres = rows[np.random.Generator(np.random.PCG64(7)).permutation(len(rows))[:k]]
    for _ in range(rounds):
        owner = np.concatenate([(rows[at:at + 512] @ centres.T).argmax(axis=1) for at in range(0, len(rows), 512)])
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, rows)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _with_cosines(batch: pa.RecordBatch, centroids: dict[int, np.ndarray]) -> Iterator[tuple]:
    """The columns but the last, the unit vector, and its cosines to the centroids of its size, for each row of a batch; vectors of one size are multiplied many at a time."""
    units = batch.column(batch.num_columns - 1).to_pylist()
    others = [c.to_pylist() for c in batch.columns[:-1]]
    places: dict[int, list[int]] = {}
    for i, unit in enumerate(units):
        places.setdefault(len(unit) // 8, []).append(i)
    for size, of in places.items():
        for at in range(0, len(of), 256):
            some = of[at:at + 256]
            x = np.stack([np.frombuffer(units[i], "<f8") for i in some])
            for i, row, near in zip(some, x, x @ centroids[size].T):
                yield *(c[i] for c in others), row, near


def assign(reps: DataFrame, centroids: dict[int, np.ndarray], probes: int) -> DataFrame:
    """(shard, doc, item): a row for each shard that a vector is in.

    item packs as doubles: count of the class, this shard, number of shards, the shards, length, the unit vector.
    """
    base, bases = 0, {}
    for size, centres in sorted(centroids.items()):
        bases[size] = base
        base += len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, docs, items = [], [], []
            for doc, n, x, near in _with_cosines(batch, centroids):
                own = np.sort(np.argsort(-near, kind="stable")[:probes]) + bases[len(x)]
                shards += own.tolist()
                docs += [doc] * len(own)
                items += [np.concatenate(([n, s, len(own)], own, [len(x)], x)).astype("<f8").tobytes() for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(docs, pa.int64()), pa.array(items, pa.binary())], names=["shard", "doc", "item"])

    return reps.select("doc", "n", "unit").mapInArrow(run, "shard bigint, doc bigint, item binary")


def unpack(items: list[bytes]) -> tuple[np.ndarray, int, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """(counts, the items' shard, shards of each, unit vectors, neighbours) of packed items; what follows a vector are its neighbours' ids."""
    counts, shards, units, neighbours, shard = [], [], [], [], -1
    for item in items:
        n, shard, p = np.frombuffer(item, "<f8", 3).astype(np.int64).tolist()
        size = int(np.frombuffer(item, "<f8", 1, 24 + 8 * p)[0])
        counts.append(n)
        shards.append(np.frombuffer(item, "<f8", p, 24).astype(np.int64))
        units.append(np.frombuffer(item, "<f8", size, 32 + 8 * p))
        neighbours.append(np.frombuffer(item, "<i8", offset=32 + 8 * (p + size)))
    return np.array(counts, np.int64), shard, shards, np.stack(units), neighbours


def robust_prune(units: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each vector: again and again the nearest candidate, without the candidates that it is ALPHA times nearer to."""
    n = len(units)
    if n == 1:
        return [np.zeros(0, np.int64)]
    x = units.astype(np.float32)
    far = np.maximum(0, 2 - 2 * (x @ x.T))  # squared distances
    np.fill_diagonal(far, np.inf)
    m = min(CANDIDATES, n - 1)
    pool = np.argpartition(far, m - 1, axis=1)[:, :m]
    pool = np.take_along_axis(pool, np.argsort(np.take_along_axis(far, pool, 1), axis=1, kind="stable"), 1)
    own = np.take_along_axis(far, pool, 1)
    left = np.ones_like(pool, bool)
    kept: list[list[int]] = [[] for _ in range(n)]
    rows = np.arange(n)
    for _ in range(min(DEGREE, m)):
        some = left.any(axis=1)
        if not some.any():
            break
        first = left.argmax(axis=1)
        best = pool[rows, first]
        for i in np.flatnonzero(some).tolist():
            kept[i].append(int(best[i]))
        left[rows, first] = False
        left &= ALPHA**2 * far[best[:, None], pool] > own
    back: list[list[int]] = [[] for _ in range(n)]
    for i, others in enumerate(kept):
        for j in others:
            if len(back[j]) < DEGREE:
                back[j].append(i)
    return [np.array(sorted({*a, *b}), np.int64) for a, b in zip(kept, back)]


def build(docs: np.ndarray, side: np.ndarray, items: list[bytes]) -> Rows:
    """Edges of the graph of one shard or pair of tiles."""
    docs, once = np.unique(docs, return_index=True)
    units = unpack([items[i] for i in once])[3]
    return [(int(docs[i]), int(docs[j]), 0) for i, others in enumerate(robust_prune(units)) for j in others]


def range_search(units: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, entries: np.ndarray, cosine: float) -> np.ndarray:
    """found[q, v]: vectors within range of each query, met by a search along the graph.

    All queries step together. A query expands its best vector not yet expanded, greedily
    until PATIENCE expansions bring nothing better, and as long as that one is within range.
    """
    n, width = len(units), max(1, max((len(g) for g in graph), default=1))
    links = np.full((n, width), -1)
    for i, g in enumerate(graph):
        links[i, :len(g)] = g
    seen = np.full((len(queries), n), -2.0)  # cosines of the vectors met
    expanded = np.zeros((len(queries), n), bool)
    start = np.concatenate((np.broadcast_to(entries, (len(queries), len(entries))), queries[:, None]), axis=1)
    rows = np.arange(len(queries))
    np.put_along_axis(seen, start, np.einsum("qd,qkd->qk", units[queries], units[start]), 1)
    best, patience = seen.max(axis=1), np.full(len(queries), PATIENCE)
    active = rows
    while len(active):
        open_ = np.where(expanded[active], -3.0, seen[active])
        node = open_.argmax(axis=1)
        top = open_[np.arange(len(active)), node]
        go = (top > -2) & ((top >= cosine) | (patience[active] > 0))
        active, node = active[go], node[go]
        if not len(active):
            break
        expanded[active, node] = True
        near = links[node]
        fresh = (near >= 0) & (seen[active[:, None], near] <= -2)
        who, what = np.nonzero(fresh)
        target = near[who, what]
        q = active[who]
        value = np.einsum("ed,ed->e", units[queries[q]], units[target])
        seen[q, target] = value
        better = np.full(len(queries), -2.0)
        np.maximum.at(better, q, value)
        improved = better[active] > best[active]
        best[active] = np.maximum(best[active], better[active])
        patience[active] = np.where(improved, PATIENCE, patience[active] - 1)
    return seen >= cosine


def search(docs: np.ndarray, side: np.ndarray, items: list[bytes]) -> Rows:
    """Links of one shard or pair of tiles: (vector, -1, rows) and (vector, -2, vectors) for each vector, and a spanning forest as (a, b, 0)."""
    order = np.argsort(docs, kind="stable")
    docs, side, items = docs[order], side[order], [items[i] for i in order]
    counts, own, shards, units, neighbours = unpack(items)
    place = {int(d): i for i, d in enumerate(docs.tolist())}
    graph = [np.array([place[int(d)] for d in g.tolist() if int(d) in place], np.int64) for g in neighbours]
    centre = units.mean(axis=0)
    medoids = np.argsort(-(units @ centre), kind="stable")[:: max(1, len(units) // ENTRIES)][:ENTRIES]
    one, two = sides(side)
    if not len(one) or not len(two):
        return []
    found = range_search(units, graph, np.arange(len(docs)), medoids, COSINE)
    found |= found.T
    np.fill_diagonal(found, False)
    # a pair counts in the first shard that both are in
    width = max(len(s) for s in shards)
    table_ = np.full((len(docs), width), -1)
    for i, s in enumerate(shards):
        table_[i, :len(s)] = s
    earlier = np.zeros_like(found)
    for a in range(width):
        for b in range(width):
            earlier |= (table_[:, a, None] == table_[None, :, b]) & (table_[:, a, None] >= 0) & (table_[:, a, None] < own)
    found &= ~earlier
    linked = found[np.ix_(one, two)]
    total = linked @ counts[two]
    out = [(int(docs[i]), k, int(t)) for k, n in ((-1, total), (-2, linked.sum(axis=1))) for i, t in zip(one, n.tolist()) if t]
    if one is not two:
        out += [(int(docs[j]), k, int(t)) for k, n in ((-1, counts[one] @ linked), (-2, linked.sum(axis=0))) for j, t in zip(two, n.tolist()) if t]
    return out + forest(linked, docs[one], docs[two])


def cells_of(cosines: np.ndarray, centres: np.ndarray, reach: float) -> np.ndarray:
    """Places of the centroids in whose cells a vector with these cosines to them is compared.

    Let vectors u and v at distance r have the nearest centroids a and b. If v lies more than
    m |a - b| nearer to b than to a, and u as much nearer to a than to b, then u - v measures
    more than 2 m along a - b. So with m = r / 2 one of them is always in the other's cell; a
    difference without preferred direction has a standard deviation of r / sqrt(d) there.
    """
    r = np.sqrt(2 - 2 * COSINE)
    best = int(cosines.argmax())
    margin = r / 2 * min(1.0, reach / np.sqrt(centres.shape[1]))
    apart = np.linalg.norm(centres - centres[best], axis=1)
    return np.flatnonzero(cosines[best] - cosines <= margin * apart + 1e-9)


def sketches(reps: DataFrame, centroids: dict[int, np.ndarray], probes: int, reach: float) -> DataFrame:
    """(shard, doc, item): a row for each cell of a vector; item packs its length, its shards, and BITS signs against fixed directions."""
    base, bases = 0, {}
    for size, centres in sorted(centroids.items()):
        bases[size] = base
        base += len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = {size: np.random.Generator(np.random.PCG64(size)).normal(size=(BITS, size)) for size in centroids}
        for batch in batches:
            cells, docs, items = [], [], []
            for doc, x, near in _with_cosines(batch, centroids):
                own = np.sort(np.argsort(-near, kind="stable")[:probes]).astype("<i4") + bases[len(x)]
                item = np.array([len(own)], "<i4").tobytes() + own.astype("<i4").tobytes() + np.packbits(directions[len(x)] @ x > 0).tobytes()
                to = (cells_of(near, centroids[len(x)], reach) + bases[len(x)]).tolist()
                cells += to
                docs += [doc] * len(to)
                items += [item] * len(to)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(docs, pa.int64()), pa.array(items, pa.binary())], names=["shard", "doc", "item"])

    return reps.select("doc", "unit").mapInArrow(run, "shard bigint, doc bigint, item binary")


def near_sketches(docs: np.ndarray, side: np.ndarray, items: list[bytes]) -> Rows:
    """Pairs (a, b, 0), a < b, of one cell or pair of tiles that share no shard and whose sketches are near."""
    one, two = sides(side)
    if not len(one) or not len(two):
        return []
    p = max(int(np.frombuffer(i, "<i4", 1)[0]) for i in items)
    shards = np.full((len(items), p), -1)
    for i, item in enumerate(items):
        n = int(np.frombuffer(item, "<i4", 1)[0])
        shards[i, :n] = np.frombuffer(item, "<i4", n, 4)
    signs = np.unpackbits(np.stack([np.frombuffer(i[-(BITS // 8):], np.uint8) for i in items]), axis=1).astype(np.float32) * 2 - 1
    out: Rows = []
    for at in range(0, len(one), 512):
        part = one[at:at + 512]
        who, what = np.nonzero(signs[part] @ signs[two].T >= BITS - 2 * DIFFER)
        a, b = part[who], two[what]
        for i in range(0, len(a), 1 << 16):
            x, y = a[i:i + (1 << 16)], b[i:i + (1 << 16)]
            shared = ((shards[x][:, :, None] == shards[y][:, None, :]) & (shards[x] >= 0)[:, :, None]).any(axis=(1, 2))
            out += [(min(s, t), max(s, t), 0) for s, t in zip(docs[x[~shared]].tolist(), docs[y[~shared]].tolist()) if s != t]
    return list(set(out))


def stray_links(reps: DataFrame, centroids: dict[int, np.ndarray], probes: int, reach: float) -> DataFrame:
    """Links of vectors that share no shard, as rows like those of ``search``."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8")) >= COSINE for x, y in zip(a, b)], dtype=bool)

    placed = materialize(sketches(reps, centroids, probes, reach), name="sketches")
    counted = placed.join(placed.groupBy("shard").agg(F.count("*").alias("m")), "shard")
    pairs = per_run(into_tiles(counted, "m", "doc", SKETCHES), ["shard", "i", "j"], near_sketches, "item").select("a", "b").distinct()
    side = lambda name: reps.select(F.col("doc").alias(name), F.col("unit").alias(f"unit_{name}"), F.col("n").alias(f"n_{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(linked("unit_a", "unit_b"))
    row = lambda a, b, n: F.struct(F.col(a).alias("a"), b.cast("bigint").alias("b"), n.cast("bigint").alias("n"))
    rows = F.array(row("a", F.col("b"), F.lit(0)), *(r for x, y in (("a", "b"), ("b", "a")) for r in (row(x, F.lit(-1), F.col(f"n_{y}")), row(x, F.lit(-2), F.lit(1)))))
    return met.select(F.explode(rows).alias("r")).select("r.*")


def brute_force_links(reps: DataFrame, queries: DataFrame, cosine: float = COSINE) -> dict[int, int]:
    """Linked vectors, copies not counted, of each of a bounded set of queries (doc, unit) among all rows (doc, unit), by comparing everything in blocks."""
    held = [(r.doc, np.frombuffer(r.unit, "<f8")) for r in queries.collect()]
    by_size = {size: (np.array([d for d, u in held if len(u) == size]), np.stack([u for _, u in held if len(u) == size])) for size in {len(u) for _, u in held}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            docs, units = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for size, (ids, rows) in by_size.items():
                own = [i for i, u in enumerate(units) if len(u) == 8 * size]
                if own:
                    near = np.stack([np.frombuffer(units[i], "<f8") for i in own]) @ rows.T >= cosine
                    for doc, n in zip(ids.tolist(), (near & (docs[own][:, None] != ids[None, :])).sum(axis=0).tolist()):
                        if n:
                            total[doc] = total.get(doc, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["doc", "n"])

    return {r.doc: r.n for r in reps.select("doc", "unit").mapInArrow(run, "doc bigint, n bigint").groupBy("doc").agg(F.sum("n").alias("n")).collect()}


def audit(reps: DataFrame) -> dict[int, int]:
    """Links of audited vectors by brute force; more are drawn while they hold few."""
    rows = AUDITED
    while True:
        queries = bounded_sample(reps.select("doc", "unit"), "doc", rows)
        expected = brute_force_links(reps, queries)
        if sum(expected.values()) >= LEAST_LINKS or rows >= MOST_AUDITED:
            return expected
        rows *= 8


def near_duplicates(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", probes: int = PROBES, reach: float = REACH) -> DataFrame:
    """(key, n_links, component_id, kept) of each row."""

    @F.pandas_udf("binary")
    def with_neighbours(items: pd.Series, near: pd.Series) -> pd.Series:
        return pd.Series([bytes(i) + np.array([] if n is None else n, "<i8").tobytes() for i, n in zip(items, near)])

    vectors = materialize(unit_vectors(df, key=key, vector=vector), name="units")
    valid = vectors.where("unit is not null and vec is not null")
    classes = valid.groupBy("unit").agg(F.min("vec").alias("doc"), F.count("*").alias("n"))
    reps = materialize(classes.groupBy("doc").agg(F.max_by("unit", "n").alias("unit"), F.sum("n").alias("n")), name="reps")
    sizes = {r.size: r["count"] for r in reps.groupBy((F.octet_length("unit") / 8).cast("int").alias("size")).count().collect()}
    sample = [np.frombuffer(r.unit, "<f8") for r in bounded_sample(reps.select("doc", "unit"), "doc", SAMPLE).collect()]
    centroids = {}
    for size, n in sizes.items():
        rows = [u for u in sample if len(u) == size]
        centroids[size] = fit_centroids(np.stack(rows), -(-n // SHARD)) if rows else np.eye(1, size)
    expected = audit(reps)
    while True:
        placed = assign(reps, centroids, probes)
        counted = materialize(placed.join(placed.groupBy("shard").agg(F.count("*").alias("m")), "shard"), name="placed")
        tiled = into_tiles(counted, "m", "doc", TILE)
        edges = per_run(tiled, ["shard", "i", "j"], build, "item").select("a", "b").distinct()
        lists = edges.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("near"))
        graph = materialize(lists, name="graph")
        with_graph = counted.join(graph, counted.doc == graph.a, "left").select("shard", "m", "doc", with_neighbours("item", "near").alias("item"))
        near = per_run(into_tiles(with_graph, "m", "doc", TILE), ["shard", "i", "j"], search, "item")
        found = materialize(near.unionByName(stray_links(reps, centroids, probes, reach)), name="found")
        got = {r.a: r.n for r in found.where(F.col("b") == -2).where(F.col("a").isin(list(expected))).groupBy("a").agg(F.sum("n").alias("n")).collect()}
        recall = float(np.mean([got.get(doc, 0) / n for doc, n in expected.items()])) if expected else None
        logger = logging.getLogger(__name__)
        if recall is None:
            logger.warning("recall not measured: no link among %d vectors audited", MOST_AUDITED)
        else:
            logger.info("recall %.4f over %d links of %d vectors with %d probes", recall, sum(expected.values()), len(expected), probes)
        if recall is None or recall >= LEAST_RECALL or probes >= max((len(c) for c in centroids.values()), default=1):
            break
        drop_table(found)
        probes, reach = probes * 2, reach * 2
    counts = found.where("b = -1").groupBy(F.col("a").alias("doc")).agg(F.sum("n").alias("links"))
    groups = components(found.where("b >= 0").select("a", "b"))
    by_rep = classes.join(counts, "doc", "left").join(groups.withColumnRenamed("v", "doc"), "doc", "left").select("unit", F.col("n"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "doc").alias("component_id"))
    linked = join_counted(valid, by_rep, ["unit"], "n", vectors.count()).select("vec", "n_links", "component_id")
    alone = vectors.where("unit is null or vec is null").select("vec", F.lit(0).cast("bigint").alias("n_links"), F.col("vec").alias("component_id"))
    out = linked.unionByName(alone).select(F.col("vec").alias(key), "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
ORACLE = {
    "op10_embedding_dedup": """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
ok as (select * from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select distinct vec_id as v, vec_id as r from v union select b, r from reach join links on a = v)
select v.vec_id, coalesce(l.n, 0) as n_links, c.r as component_id, v.vec_id = c.r as kept
from v left join (select a, count(*) as n from links group by a) l on l.a = v.vec_id
join (select v, min(r) as r from reach group by v) c on c.v = v.vec_id"""
}
