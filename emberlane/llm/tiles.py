"""Work on groups of rows inside tasks, with long groups cut into tiles of bounded size.

``clusters_of`` finds the components of the links inside groups of documents without
comparing all pairs of a long group. First each group is cut into chunks, its least
document is put into all of them, and a chunk compares its own pairs: the work grows in
proportion to the group. Documents that are connected by then need no comparison. What
is left are pairs of documents of one group that lie in different components: only
those are compared, tile by tile, so that no link between them is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.common import drop_table, join_counted, materialize, shuffle_width, slices
from emberlane.llm.components import components

#: What a piece of work returns: rows (a, b, n).
Rows = list[tuple[int, int, int]]


def into_tiles(rows: DataFrame, count: str, doc: str, size: int) -> DataFrame:
    """Deals each group of ``count`` documents into tiles of about ``size`` by a hash, and a row to every pair of tiles that it is in.

    Adds ``i`` and ``j``, the pair, and ``side``: 0 in both tiles (i = j), 1 in the first, 2 in the second.
    """
    n = F.ceil(F.col(count) / F.lit(size)).cast("int")
    own = F.pmod(F.xxhash64(doc), F.col("tiles")).cast("int")
    dealt = rows.withColumn("tiles", n).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return dealt.select(*rows.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))


def into_chunks(rows: DataFrame) -> DataFrame:
    """Deals each group of ``n`` rows (doc, n, anchor, per, ...) into chunks of about ``per`` by a hash, the anchor into every chunk. Adds ``i``, the chunk, and ``side``, 0."""
    tiles = F.ceil(F.col("n") / F.col("per")).cast("int")
    own = F.pmod(F.xxhash64("doc"), tiles).cast("int")
    at = F.when(F.col("doc") == F.col("anchor"), F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(own))
    return rows.withColumn("i", F.explode(at)).withColumn("side", F.lit(0))


def across_components(rows: DataFrame, counts: DataFrame, group: str, total: int) -> DataFrame:
    """Deals long groups (group, doc, c, per, ...) into tiles of ``per`` documents, and a row to the pairs of tiles that may hold documents of different components ``c``.

    counts (group, c, per, n) has the sizes. A component of more than ``per`` documents has
    tiles of its own, which are not paired with each other; the documents of small
    components share tiles. Adds ``i``, ``j`` and ``side`` as ``into_tiles`` does.
    """
    big = F.col("n") > F.col("per")
    per_group = counts.groupBy(group).agg(F.sum(F.when(big, 0).otherwise(F.col("n"))).alias("n_small"))
    plan = materialize(counts.join(per_group, group).select(group, "c", "n", "n_small", big.alias("big")), name="parts")
    own = F.when(F.col("big"), F.xxhash64("c", F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / F.col("per"))))).otherwise(F.pmod(F.xxhash64("c"), F.ceil(F.col("n_small") / F.col("per"))))
    dealt = join_counted(rows, plan, [group, "c"], "n", total).withColumn("tile", own).withColumn("own", F.when(F.col("big"), F.col("c")))
    dealt = materialize(dealt.drop("n", "n_small", "big"), name="dealt")
    tiles = materialize(dealt.select(group, "tile", "own").distinct(), name="tile-list")
    other = tiles.select(group, F.col("tile").alias("tile2"), F.col("own").alias("own2"))
    pairs = tiles.join(other, group).where("(own is null and own2 is null and tile <= tile2) or (own is not null and own2 is not null and own <> own2 and tile < tile2) or (own is not null and own2 is null)")
    alone = F.col("own").isNull() & (F.col("tile") == F.col("tile2"))
    first = pairs.select(group, "tile", F.col("tile").alias("i"), F.col("tile2").alias("j"), F.when(alone, 0).otherwise(1).alias("side"))
    second = pairs.where(~alone).select(group, F.col("tile2").alias("tile"), F.col("tile").alias("i"), F.col("tile2").alias("j"), F.lit(2).alias("side"))
    return dealt.join(first.unionByName(second), [group, "tile"])


def clusters_of(members: DataFrame, group: str, attach: Callable[[DataFrame], DataFrame], carried: str, work: Callable, size: int, weight: int | None = None) -> DataFrame:
    """(v, component) of the links that ``work`` finds between documents that share a group of members (group, doc).

    ``attach`` adds the column ``carried`` to members that need it. With ``weight`` members
    have a column ``bytes`` too, and a chunk carries about so many.
    """
    members = materialize(members, name="members")
    sizes = members.groupBy(group).agg(F.count("*").alias("n"), F.min("doc").alias("anchor"), (F.sum("bytes") if weight else F.lit(0)).alias("load")).where("n > 1")
    per = F.greatest(F.lit(1), F.floor(F.least(F.lit(1.0), F.col("n") * F.lit((weight or 0) / size) / F.greatest("load", F.lit(1))) * size)) if weight else F.lit(size)
    sized = join_counted(members.select(group, "doc"), sizes.select(group, "n", "anchor", per.cast("bigint").alias("per")), [group], "n", members.count())
    sized = materialize(attach(sized), name="sized")
    drop_table(members)
    edges = materialize(per_run(into_chunks(sized), [group, "i"], work, carried).select("a", "b").distinct(), name="links")
    found = materialize(components(edges), name="clusters")
    drop_table(edges)
    long = sized.where(F.col("n") > F.col("per")).select(group, "doc", "per", carried)
    labelled = long.join(found.select(F.col("v").alias("doc"), F.col("component").alias("c")), "doc", "left").withColumn("c", F.coalesce("c", "doc"))
    counts = materialize(labelled.groupBy(group, "c").agg(F.count("*").alias("n"), F.max("per").alias("per")), name="counts")
    mixed = materialize(counts.groupBy(group).agg(F.count("*").alias("parts"), F.sum("n").alias("n_docs")).where("parts > 1"), name="mixed")
    if not mixed.isEmpty():
        total = mixed.agg(F.sum("n_docs")).first()[0]
        rest = join_counted(labelled, mixed.select(group, F.col("n_docs").alias("n")), [group], "n", total).drop("n")
        more = per_run(across_components(rest, counts.join(mixed.select(group), group, "left_semi"), group, total), [group, "i", "j"], work, carried).select("a", "b")
        both = materialize(components(found.select(F.col("v").alias("a"), F.col("component").alias("b")).union(more)), name="clusters")
        drop_table(found)
        found = both
    drop_table(sized)
    return found


def sides(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the documents of the first and second tile of a pair."""
    both = np.flatnonzero(of == 0)
    return (both, both) if len(both) else (np.flatnonzero(of == 1), np.flatnonzero(of == 2))


def per_run(rows: DataFrame, keys: list[str], work: Callable[[np.ndarray, np.ndarray, list[bytes]], Rows], carried: str) -> DataFrame:
    """Deals rows (keys, side, doc, carried) out by keys and gives each run of equal keys to ``work(docs, sides, values)``."""
    spread = rows.select(*keys, "side", "doc", carried).repartition(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_keys, held, out = len(keys), None, []
        for part in (part for batch in batches for part in slices(batch, n_keys + 2, rows=2048, size=4 << 20)):  # what is held of a batch is copied with the part after it
            now = pa.Table.from_batches([part])
            if held is not None:
                now = pa.concat_tables([held, now]).combine_chunks()
            codes = [now.column(i).to_numpy() for i in range(n_keys)]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1 if now.num_rows > 1 else np.zeros(0, np.int64)
            last = int(cuts[-1]) if len(cuts) else 0
            out += _runs(now.slice(0, last), [0, *cuts.tolist()], n_keys, work)
            held = now.slice(last)
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if held is not None:
            out += _runs(held, [0, held.num_rows], n_keys, work)
        if out:
            yield _batch(out)

    return spread.mapInArrow(run, "a bigint, b bigint, n bigint")


def _runs(rows: pa.Table, cuts: list[int], n_keys: int, work: Callable) -> Rows:
    if rows.num_rows == 0:
        return []
    sides_, docs, values = rows.column(n_keys).to_numpy(), rows.column(n_keys + 1).to_numpy(), rows.column(n_keys + 2)
    return [row for a, b in zip(cuts, cuts[1:]) if b > a for row in work(docs[a:b], sides_[a:b], values.slice(a, b - a).to_pylist())]


def _batch(rows: Rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "n"])


def forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> Rows:
    """Edges (a[i], b[j], 0) of a spanning forest of the links, grown from the first document not yet reached.

    Documents come in order of their ids, so that the same links in many runs give the
    same edges, which a distinct() then makes one.
    """
    out: Rows = []
    new_a, new_b = linked.any(axis=1), linked.any(axis=0)
    for root in range(len(a)):
        if not new_a[root]:
            continue
        new_a[root] = False
        rows = [root]
        while rows:
            columns = []
            for i in rows:
                for j in np.flatnonzero(linked[i] & new_b).tolist():
                    out.append((int(a[i]), int(b[j]), 0))
                    new_b[j] = False
                    columns.append(j)
            rows = []
            for j in columns:
                for i in np.flatnonzero(linked[:, j] & new_a).tolist():
                    out.append((int(a[i]), int(b[j]), 0))
                    new_a[i] = False
                    rows.append(i)
    return out
