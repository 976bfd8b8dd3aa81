"""Hard-negative mining by dual-tree search: trees over anchors and over candidates, walked in pairs.

Rows are placed by label and by a coarse tree of median cuts (fitted on a bounded sample; each row gets
a place), dealt to ranges of equal size, and each range becomes slices of at most SLICE rows, ordered as
the leaves of a balanced tree. A hot label or place is cut into many ranges, since the order goes on by
a hash of the id. Anchors travel in chunks of at most CHUNK. A cell is a slice and a chunk that have to
meet; it rebuilds both trees from their leaves, with a centre and a radius for each node, and walks them
down together: the inner products of two nodes lie within centre * centre +- (radii with the centres'
lengths and with each other), and a pair of nodes is dropped, with all anchors below it at once, if that
interval can't reach what its anchors still need. Of the leaf pairs that stay, those that some anchor of
the leaf can still gain by are scored exactly, the most promising first.

Two walks: the first finds each anchor's positives, with what its own slice holds as the bound to start
from; the second finds the negatives of all its positives, whose scores give intervals from the start.
Each cell leaves a few rows for each anchor; these are ranked in Spark. No row is dropped unscored but
by an interval that excludes it.

Cases: rows with a null id or label, or with a null vector or entry, or one that isn't finite, take no
part, nor do entries of 2**53 / scale or more, nor vectors whose dimension isn't that of most rows; of
rows that share an id the one with the largest label, then vector stays; equal scores go by the smaller
id; an anchor without other rows of its label has no positives and no rows; a positive with a negative
score has none, since its band is empty; an empty table gives no rows. Scores beyond 64 bits are an error.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, in_python, table, width
from .vectors import one_per_key, pack, quantised, unpack

SCALE = 256
#: Rows of a slice, and the fewest that are worth a slice of their own; anchors of a chunk; rows of a leaf of either tree; leaves scored at once.
SLICE, LEAST, CHUNK, LEAF, ANCHOR_LEAF, AT_ONCE = 32_768, 1_024, 8_192, 128, 32, 8
#: The coarse tree: rows it is fitted on, and its depth.
SAMPLE_ROWS, DEPTH = 4_096, 8
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


# --- trees


def leaf_order(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows in which each node of a balanced tree is a stretch, and where its leaves begin, with the end."""
    order, n = np.arange(len(x)), len(x)
    cuts = [0, n]
    while n and max(b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)) > leaf:
        finer = [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part, middle = order[a:b], (b - a) // 2
            if middle:
                along = x[part, x[part].var(0).argmax()]
                order[a:b] = part[np.argpartition(along, middle)]
                finer.append(a + middle)
            finer.append(b)
        cuts = finer
    return order, np.array(cuts if n else [0])


class Tree:
    """Levels of nodes from the root to the leaves; of each node the stretch of rows, centre, radius and range of labels."""

    def __init__(self, x: np.ndarray, label: np.ndarray, cuts: np.ndarray):
        self.x, self.label, self.levels = x, label, []
        while True:
            size = np.diff(cuts)
            centre = np.add.reduceat(x, cuts[:-1]) / size[:, None]
            away = np.sqrt(((x - np.repeat(centre, size, axis=0)) ** 2).sum(1))
            radius = np.maximum.reduceat(away, cuts[:-1]) * (1 + 1e-12)
            self.levels.append((cuts, centre, radius, np.sqrt((centre**2).sum(1)), np.minimum.reduceat(label, cuts[:-1]), np.maximum.reduceat(label, cuts[:-1])))
            if len(size) == 1:
                break
            cuts = np.append(cuts[:-1][::2], cuts[-1])
        self.levels.reverse()


def intervals(a, b, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest inner product that rows of a level's nodes i and of another's nodes j can have."""
    (_, ca, ra, la, _, _), (_, cb, rb, lb, _, _) = a, b
    middle, spread = np.einsum("ij,ij->i", ca[i], cb[j]), la[i] * rb[j] + lb[j] * ra[i] + ra[i] * rb[j]
    slack = 1e-9 * (la[i] * lb[j] + spread) + 1e-6  # what rounding may take
    return middle - spread - slack, middle + spread + slack


def _children(pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes their children on the next level, which has n nodes; and for each child the place of its parent."""
    both = np.concatenate([2 * pairs, 2 * pairs + 1])
    from_ = np.concatenate([np.arange(len(pairs))] * 2)
    there = both < n
    return both[there], from_[there]


class Found:
    """For the anchors of one leaf and each of their slots the best k so far, and the scores that are still needed."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        none = np.zeros(0, dtype=np.int64)
        self.best = [(none, none, none) for _ in range(low.shape[1])]

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for slot, held in enumerate(self.best):
            mine = np.flatnonzero((score >= self.low[row, slot]) & (score <= self.high[row, slot]))
            if not len(mine):
                continue
            r, s, i = (np.concatenate([h, new[mine]]) for h, new in zip(held, (row, score, ids), strict=True))
            order = np.lexsort((i, -s, r))
            r, s, i = r[order], s[order], i[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            top = place < self.k
            last = np.flatnonzero(place == self.k - 1)
            self.low[r[last], slot] = np.maximum(self.low[r[last], slot], s[last])
            self.best[slot] = r[top], s[top], i[top]


def dual_search(anchors: Tree, ids: np.ndarray, low: np.ndarray, high: np.ndarray, candidates: Tree, names: np.ndarray, same: bool, k: int) -> tuple[list[np.ndarray], int]:
    """anchor (its place), slot, name and score of the k best candidates for each slot with low <= score <= high; and the number of pairs scored.

    low, high: a row for each anchor, a column for each slot. same: candidates have the anchor's label, but not
    its id; otherwise they have another label.
    """
    cuts = anchors.levels[-1][0]
    i, j, up, down = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), 0, 0
    while True:
        a, b = anchors.levels[up], candidates.levels[down]
        least, most = intervals(a, b, i, j)
        need, top = np.minimum.reduceat(low.min(1), a[0][:-1]), np.maximum.reduceat(high.max(1), a[0][:-1])
        if same:
            meet = (a[4][i] <= b[5][j]) & (b[4][j] <= a[5][i])
        else:
            meet = ~((a[4][i] == a[5][i]) & (b[4][j] == b[5][j]) & (a[4][i] == b[4][j]))
        keep = meet & (most >= need[i]) & (least <= top[i])
        i, j = i[keep], j[keep]
        if up == len(anchors.levels) - 1 and down == len(candidates.levels) - 1:
            break
        if down < len(candidates.levels) - 1 and (down <= up or up == len(anchors.levels) - 1):
            down += 1
            j, parent = _children(j, len(candidates.levels[down][1]))
            i = i[parent]
        else:
            up += 1
            i, parent = _children(i, len(anchors.levels[up][1]))
            j = j[parent]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, dtype=np.int64)
    out, scored, leaves = [], 0, candidates.levels[-1][0]
    exact = np.abs(anchors.x).max(initial=0) * np.abs(candidates.x).max(initial=0) * anchors.x.shape[1] < 1 << 53
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(i)], strict=True):
        a, b = cuts[i[s]], cuts[i[s] + 1]
        found = Found(low[a:b], high[a:b], k)
        # What each anchor of the leaf can reach at most in each leaf of the candidates; the best go first.
        centre, radius = candidates.levels[-1][1][j[s:e]], candidates.levels[-1][2][j[s:e]]
        reach = anchors.x[a:b] @ centre.T
        own = np.sqrt((anchors.x[a:b] ** 2).sum(1))[:, None]
        reach += own * radius + 1e-9 * own * (radius + np.sqrt((centre**2).sum(1))) + 1e-6
        best = np.argsort(-reach.max(0))
        for at in range(0, len(best), AT_ONCE):
            some = best[at : at + AT_ONCE]
            some = some[(reach[:, some] >= found.low.min(1)[:, None]).any(0)]
            if not len(some):
                continue
            mine = j[s + some]
            rows = np.concatenate([np.arange(leaves[x], leaves[x + 1]) for x in mine.tolist()])
            scores = inner(anchors.x[a:b], candidates.x[rows], exact)
            scored += scores.size
            equal = anchors.label[a:b, None] == candidates.label[rows]
            fits = (equal & (ids[a:b, None] != names[rows])) if same else ~equal
            r, c = np.nonzero(fits & (scores >= found.low.min(1)[:, None]) & (scores <= high[a:b].max(1)[:, None]))
            found.add(r, scores[r, c], names[rows[c]])
        out += [(a + r, np.full(len(r), slot), n, v) for slot, (r, v, n) in enumerate(found.best)]
    none = np.zeros(0, dtype=np.int64)
    return [np.concatenate([o[c] for o in out]) if out else none for c in range(4)], scored


def inner(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers held as doubles, as 64-bit integers; exact: doubles hold all their sums."""
    if exact:
        return (a @ b.T).astype(np.int64)
    whole = [[int(e) for e in row] for row in a], [[int(e) for e in row] for row in b]
    return np.array([[sum(map(int.__mul__, p, q)) for q in whole[1]] for p in whole[0]], dtype=np.int64).reshape(len(a), len(b))


# --- slices


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each inner node of a tree, level by level, the entry that it cuts and where: at the sample's median of the widest."""
    n = (1 << depth) - 1
    entry, at, rows = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), {0: np.arange(len(sample))}
    for node in range(n):
        mine = rows.pop(node)
        if len(mine):
            entry[node] = sample[mine].var(0).argmax()
            along = sample[mine, entry[node]]
            at[node] = np.sort(along)[(len(along) - 1) // 2]
        more = sample[mine, entry[node]] > at[node]
        rows[2 * node + 1], rows[2 * node + 2] = mine[~more], mine[more]
    return entry, at


def _placed(dim: int, entry: np.ndarray, at: np.ndarray):
    def run(batches):
        for batch in batches:
            x = unpack(batch.column("x"), dim)
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), entry[node]] > at[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], names=[*batch.schema.names, "place"])

    return run


#: candidate lots: a leaf of a slice, its rows packed together; anchors: a row each, with the score that its own slice can bound it by.
LOTS = "slice long, leaf int, least long, most long, ids binary, labels binary, x array<binary>"
_LOT_NAMES = [c.split()[0] for c in LOTS.split(", ")]


def _sliced(dim: int, positives: int):
    """Of a task's rows, in order, slices: a row for each leaf (anchor null), then one for each of its anchors (leaf null)."""

    def lots(n: int, parts: list[pa.Table]):
        rows = pa.Table.from_batches(parts)
        ids, labels, x = rows.column("id").to_numpy(), rows.column("label").to_numpy(), unpack(rows.column("x"), dim).astype(np.float64)
        order, cuts = leaf_order(x, LEAF)
        ids, labels, x = ids[order], labels[order], x[order]
        least, most = int(labels.min()), int(labels.max())
        number = (TaskContext.get().partitionId() << 20) + n
        packed = pack(x.astype(np.int64)).to_pylist()
        leaves = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        yield {"slice": [number] * len(leaves), "leaf": list(range(len(leaves))), "least": [least] * len(leaves), "most": [most] * len(leaves), "ids": [ids[a:b].tobytes() for a, b in leaves], "labels": [labels[a:b].tobytes() for a, b in leaves], "x": [packed[a:b] for a, b in leaves]}
        asks = np.flatnonzero(rows.column("asks").to_numpy()[order])
        if not len(asks):
            return
        again, ends = leaf_order(x[asks], ANCHOR_LEAF)
        asks = asks[again]
        low, high = np.full((len(asks), 1), LOW), np.full((len(asks), 1), HIGH)
        (row, _, _, score), _ = dual_search(Tree(x[asks], labels[asks], ends), ids[asks], low, high, Tree(x, labels, cuts), ids, True, positives)
        full = np.flatnonzero(np.bincount(row, minlength=len(asks)) == positives)
        bound = np.full(len(asks), HIGH)
        np.minimum.at(bound, row, score)
        bound[np.setdiff1d(np.arange(len(asks)), full)] = LOW
        yield {"slice": [number] * len(asks), "anchor": ids[asks], "label": labels[asks], "bound": bound, "number": np.arange(len(asks)), "own": [packed[i] for i in asks.tolist()]}

    def rows(found: dict) -> pa.RecordBatch:
        n = len(found["slice"])
        return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name in found else pa.nulls(n, f.type) for f in _SLICED], schema=_SLICED)

    def run(batches):
        held, n, number = [], 0, 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, SLICE - n)
                batch = batch.slice(len(part))
                held.append(part)
                n += len(part)
                if n == SLICE:
                    yield from map(rows, lots(number, held))
                    held, n, number = [], 0, number + 1
        if n:
            yield from map(rows, lots(number, held))

    return run


_SLICED = pa.schema([("slice", pa.int64()), ("leaf", pa.int32()), ("least", pa.int64()), ("most", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.list_(pa.binary())), ("anchor", pa.int64()), ("label", pa.int64()), ("bound", pa.int64()), ("number", pa.int64()), ("own", pa.binary())])


def _cells(dim: int, same: bool, k: int):
    """Of a slice's leaves and a chunk's anchors (anchor, label, own, slots: ids with lowest and highest score) the best k of each slot."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = {"anchor": pa.array([], pa.int64()), "slot": pa.array([], pa.int64()), "found": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "scored": pa.array([], pa.int64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(none)
        left = left.sort_by("leaf")
        names, labels = (np.concatenate([np.frombuffer(b, dtype=np.int64) for b in left.column(c).to_pylist()]) for c in ("ids", "labels"))
        lots = left.column("x").combine_chunks()
        sizes = [len(b) // 8 for b in left.column("ids").to_pylist()]
        candidates = Tree(unpack(lots.flatten(), dim).astype(np.float64), labels, np.concatenate(([0], np.cumsum(sizes))))
        x = unpack(right.column("own"), dim).astype(np.float64)
        order, cuts = leaf_order(x, ANCHOR_LEAF)
        ids, own, asked = right.column("anchor").to_numpy()[order], right.column("label").to_numpy()[order], right.column("slots").to_pylist()
        slots = max(len(s) for s in asked)
        low, high, slot_ids = (np.full((len(order), slots), v) for v in (HIGH, LOW, 0))
        for r, at in enumerate(order.tolist()):
            for c, s in enumerate(asked[at]):
                slot_ids[r, c], low[r, c], high[r, c] = s["id"], s["low"], s["high"]
        (row, slot, name, score), scored = dual_search(Tree(x[order], own, cuts), ids, low, high, candidates, names, same, k)
        return pa.table({"anchor": ids[row], "slot": slot_ids[row, slot], "found": name, "score": score, "scored": np.concatenate(([scored], np.zeros(max(0, len(row) - 1), dtype=np.int64)))[: len(row)]})

    return run


def _met(lots: DataFrame, asking: DataFrame, pairs: DataFrame, dim: int, same: bool, k: int) -> DataFrame:
    """anchor, slot, found, score and rank: slices and chunks that `pairs` brings together, and the k best of all cells."""
    left = lots.join(pairs, "slice").select("slice", "chunk", "leaf", "ids", "labels", "x")
    right = asking.join(pairs, "chunk").select("slice", "chunk", "anchor", "label", "own", "slots")
    met = left.groupBy("slice", "chunk").cogroup(right.groupBy("slice", "chunk")).applyInArrow(_cells(dim, same, k), "anchor long, slot long, found long, score long, scored long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "found")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, key: str, label: str, column: str, asks, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    asks: a condition on rows of `vectors` that tells the anchors. An anchor's positives are the best rows of
    its label; a positive's negatives are the best rows of other labels with band[0] * positive_score <=
    100 * negative_score <= band[1] * positive_score.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(column).alias("vector"))
    rows, dim = quantised(named.where("id is not null and label is not null"), "vector", scale, "id", "label", "asks")
    rows = one_per_key(rows, "id", "label", "x")
    n, n_anchors = rows.agg(F.count("*"), F.count_if("asks")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("x").toArrow()
    n_slices = max(ceil(n / SLICE), min(width(spark), ceil(n / LEAST)))
    placed = rows.transform(in_python, _placed(dim, *_cuts(unpack(sample.column(0), dim), DEPTH)), "id long, label long, asks boolean, x binary, place long")
    dealt = placed.withColumn("deal", F.xxhash64("id")).repartitionByRange(n_slices, "label", "place", "deal").sortWithinPartitions("label", "place", "deal")
    sliced = durable(dealt.select("id", "label", "asks", "x").transform(in_python, _sliced(dim, positives), LOTS + ", anchor long, label long, bound long, number long, own binary"))
    lots = sliced.where("leaf is not null").select(*_LOT_NAMES)
    # Chunks gather the anchors of neighbouring slices; of each as many as leave a chunk within its bound.
    together = max(1, CHUNK * n_slices // n_anchors)
    share = max(1, CHUNK // together)
    chunk = F.floor(F.shiftright("slice", 20) / together) * (1 << 32) + F.floor(F.col("number") / share)
    anchors = sliced.where("leaf is null").select("anchor", "label", "own", "bound", chunk.cast("long").alias("chunk"))
    chunks = durable(anchors.groupBy("chunk").agg(F.min("label").alias("from_"), F.max("label").alias("to_")))
    slices = durable(lots.where("leaf = 0").select("slice", "least", "most"))

    meet = (F.col("from_") <= F.col("most")) & (F.col("least") <= F.col("to_"))
    pairs = durable(slices.join(chunks, meet).select("slice", "chunk"))
    asking = anchors.withColumn("slots", F.array(F.struct(F.lit(0).cast("long").alias("id"), F.col("bound").alias("low"), F.lit(HIGH).alias("high"))))
    best = durable(_met(lots, asking, pairs, dim, True, positives).select("anchor", F.col("found").alias("positive"), "score"))

    lowest = F.ceil(F.col("score") * F.lit(band[0]).cast("decimal(20,0)") / 100).cast("long")
    highest = F.floor(F.col("score") * F.lit(band[1]).cast("decimal(20,0)") / 100).cast("long")
    slots = best.select("anchor", F.struct(F.col("positive").alias("id"), lowest.alias("low"), highest.alias("high")).alias("slot")).where("slot.low <= slot.high")
    asking = anchors.join(slots.groupBy("anchor").agg(F.collect_list("slot").alias("slots")), "anchor")
    other = ~((F.col("from_") == F.col("to_")) & (F.col("least") == F.col("most")) & (F.col("from_") == F.col("least")))
    pairs = durable(slices.join(chunks, other).select("slice", "chunk"))
    found = _met(lots, asking, pairs, dim, False, negatives).withColumnRenamed("slot", "positive")
    scored = found.join(best.withColumnRenamed("score", "positive_score"), ["anchor", "positive"])
    return scored.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", label.alias("label"), "embedding"), "vec_id", "label", "embedding", F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank, s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""
