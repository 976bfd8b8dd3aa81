"""N-gram Jaccard join by grouped prefixes: which documents share nearly all their word shingles?

A document's set holds the hashes of its distinct shingles of WORDS words. Two documents link when
the intersection has at least PERCENT hundredths of the union; a component is what links connect.

1. Texts are read once, and kept as compressed lots in the shared folder. Documents with equal sets
   form a class, and one stands for all: copies cost nothing more.
2. All shingles have one order: by how many documents hold them, counted over all documents, then by
   hash. Each lot sends its different shingles, 48 bits each, to the tasks that hold their ranges, and
   gets a byte for each back: the number of documents, exact up to 16, in quarters of an octave
   above. Rare ones come first, so prefixes are telling; what a single document holds links nothing.
3. A class's prefix is as long as any partner must reach into. Classes with the same prefix and
   size are collapsed into one group. The packed exchange finds shingles in prefixes of several groups.
4. Members of these groups are compared with a few pivots of each such shingle, and of their own
   group. Sizes and places in the prefixes drop most pairs; the others are verified on the whole
   sets. That is linear in the postings, and joins a large group of near copies at once.
5. What links may be left run between different components. Shingles whose groups are all in one
   component are done; of the others, group pairs are formed across components only, filtered,
   expanded into members and verified. No link that could join components goes unverified.
   Parity bits of the sets, of which linked ones can differ in few, drop most pairs in the join.

Only step 5 can form more pairs than postings, and only of documents that hold a rare shingle
together and don't connect. Sets of 64-bit hashes stand for shingles throughout. Nothing is
broadcast; counts, lots and pairs meet in shuffles whatever their size.

Cases: a null or wordless text has an empty set and is linked with nothing; a text of fewer than
WORDS words is one shingle; of rows that share a doc_id the largest text stands for them; a null
doc_id is smaller than all others and gives a null component; an empty table gives an empty result;
`keep_one` keeps all columns whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import NO_ID, by_ranges, durable, fresh, in_python, is_void, one_per_id, one_row_per_id, table, width
from .components import components
from .exchange import LATER, SHARED, flagged, pack, runs_of, unpack

WORDS, PERCENT = 3, 90
#: Bytes of text in a lot, about; a longer text is a lot of its own.
LOT = 4 << 20
#: Bits of a shingle's hash that are left out where documents are counted.
DROPPED = np.uint64(16)
SECOND = bs.Hasher(0xB5026F5AA96619E9)
#: 64-bit words of a set's parity bits: two sets differ in as many shingles as bits, at least.
PARITY = 8
#: Postings of a shingle that meet all others of it in one task.
PART = 1_000
BITS = [f"s{i}" for i in range(PARITY)]


def shingle_sets(piece: bs.Piece, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, ascending within a text, and where each text's begin."""
    w = bs.words(piece)
    counts = w.counts
    at, h = bs.windows(w, k)
    doc = np.searchsorted(w.of, at, side="right") - 1
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = bs.WORDS.slices(bs.WORDS.sums(w.hash), w.of[short], w.of[short + 1])
        h, doc = np.concatenate((h, whole)), np.concatenate((doc, short))
    order = bs.order_within(doc, h)
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(piece) + 1))


def prefix_length(n, percent: int):
    """How many of n ordered shingles a partner must share one of."""
    return n - (percent * n + 99) // 100 + 1


MEASURED = "kind int, lot long, doc_id long, place int, n long, sig1 long, sig2 long, ids binary, sizes binary, texts binary"


def _measure(k: int):
    """Rows of documents (kind 0: lot, id, place in the lot, n, two signatures) and of lots (kind 1: ids, sizes and texts)."""

    def lot_row(number: int, ids: list, sizes: list, texts: list) -> pa.RecordBatch:
        blob = zstandard.ZstdCompressor(1).compress(b"".join(texts))
        zero = np.zeros(1, dtype=np.int64)
        packed = (np.concatenate(ids).tobytes(), np.concatenate(sizes).astype(np.uint32).tobytes(), blob)
        return _rows(zero + 1, zero + number, zero, zero, zero, zero, zero, [pa.array([x], pa.binary()) for x in packed])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, sizes, texts, held, docs = [], [], [], 0, 0
        for batch in batches:
            own = batch.column("doc_id").to_numpy()
            for piece in bs.pieces(batch.column("text")):
                h, of = shingle_sets(piece, k)
                m = len(piece)
                mine = own[piece.first : piece.first + m].astype(np.int64)
                a, b = (hasher.slices(hasher.sums(h), of[:-1], of[1:]).view(np.int64) for hasher in (bs.WORDS, SECOND))
                none = [pa.nulls(m, pa.binary())] * 3
                yield _rows(np.zeros(m), np.full(m, number), mine, docs + np.arange(m), np.diff(of), a, b, none)
                ids.append(mine)
                sizes.append(np.diff(piece.offsets))
                texts.append(piece.data.tobytes())
                held, docs = held + len(piece.data), docs + m
                if held >= LOT:
                    yield lot_row(number, ids, sizes, texts)
                    number, ids, sizes, texts, held, docs = number + 1, [], [], [], 0, 0
        if docs:
            yield lot_row(number, ids, sizes, texts)

    return run


def _rows(kind, lot, doc, place, n, a, b, blobs) -> pa.RecordBatch:
    numbers = [pa.array(np.asarray(x).astype(t)) for x, t in ((kind, np.int32), (lot, np.int64), (doc, np.int64), (place, np.int32), (n, np.int64), (a, np.int64), (b, np.int64))]
    return pa.RecordBatch.from_arrays([*numbers, *blobs], names=[c.split()[0] for c in MEASURED.split(", ")])


def _lots(batch: pa.RecordBatch):
    """Of each lot in a batch: its number, its documents' ids, and its texts as a column."""
    unpack_texts = zstandard.ZstdDecompressor()
    for lot, ids, sizes, texts in zip(*[batch.column(c).to_pylist() for c in ("lot", "ids", "sizes", "texts")], strict=True):
        offsets = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, dtype=np.uint32), dtype=np.int64)))
        data = pa.py_buffer(unpack_texts.decompress(texts) or b"\0")
        yield lot, np.frombuffer(ids, dtype=np.int64), pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), data)


COUNTED = "range int, lot long, keys binary, many binary"


def _send_keys(k: int, n_ranges: int):
    """A lot's different shingles as far as they are counted by, one row for each range: steps from key to key, and how many of the lot's documents hold each."""

    def run(batches):
        for batch in batches:
            for lot, _, texts in _lots(batch):
                key, many = np.unique(np.concatenate([shingle_sets(piece, k)[0] for piece in bs.pieces(texts)]) >> DROPPED, return_counts=True)
                place = range_of(key, n_ranges)
                cuts = np.append(runs_of(place), len(key))
                rows = []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    rows.append((int(place[a]), lot, pack(np.diff(key[a:b], prepend=np.uint64(0))), b"" if (many[a:b] == 1).all() else pack(many[a:b].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "lot", "keys", "many"])

    return run


def range_of(key: np.ndarray, n: int) -> np.ndarray:
    """The range of a key without its DROPPED bits; ascends with it."""
    high = np.uint64(32) - DROPPED
    return ((key >> high) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def level(many: np.ndarray) -> np.ndarray:
    """A byte for a number of documents: the number less 1 up to 16, then quarters of its octaves; it ascends with the number."""
    above = 15 + np.floor(4 * np.log2(np.maximum(many, 16) / 16))
    return np.where(many <= 16, many - 1, np.minimum(above, 255)).astype(np.uint8)


def _levels(batches):
    """From rows of COUNTED, sorted by range: each lot's keys' levels, in order, as lot, range and levels."""

    def finish(number: int, parts: list):
        key = np.concatenate([p[1] for p in parts])
        _, which = np.unique(key, return_inverse=True)
        many = np.bincount(which, weights=np.concatenate([p[2] for p in parts]))
        found, at = level(many)[which], 0
        rows = []
        for lot, keys, _ in parts:
            rows.append((lot, found[at : at + len(keys)].tobytes()))
            at += len(keys)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([number] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["lot", "range", "levels"])

    now, parts = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["range"] != now:
                if parts:
                    yield from finish(now, parts)
                now, parts = r["range"], []
            key = np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64)
            parts.append((r["lot"], key, unpack(r["many"], np.uint32) if r["many"] else np.ones(len(key), dtype=np.uint32)))
    if parts:
        yield from finish(now, parts)


PREFIXES = "doc_id long, n long, p1 long, p2 long, shingles binary, places binary"


def _prefixes(k: int, percent: int):
    """Of each document: n, two hashes of its prefix, the prefix's shingles that other documents hold, their places in it, and parity bits.

    Documents without such a shingle link with none and have no row. Shingles go by 8 bits of their level
    and 56 of their hash; should two share a number, prefixes only have more in common.
    """

    def run(batches):
        for batch in batches:
            for (_, ids, texts), parts in zip(_lots(batch), batch.column("levels").to_pylist(), strict=True):
                sets = [(piece.first, *shingle_sets(piece, k)) for piece in bs.pieces(texts)]
                key, which = np.unique(np.concatenate([h for _, h, _ in sets]) >> DROPPED, return_inverse=True)
                levels = np.frombuffer(b"".join(p["levels"] for p in sorted(parts, key=lambda p: p["range"])), dtype=np.uint8)[which]
                at = 0
                for first, h, of in sets:
                    yield from _piece_prefixes(ids[first:], h, of, levels[at : at + len(h)].astype(np.uint64), percent)
                    at += len(h)

    return run


def _piece_prefixes(ids, h, of, levels, percent: int):
    n = np.diff(of)
    doc = np.repeat(np.arange(len(n)), n)
    bit = (h >> np.uint64(64 - (64 * PARITY - 1).bit_length())).astype(np.int64)
    odd = np.bincount(doc * 64 * PARITY + bit, minlength=64 * PARITY * len(n)) & 1
    parity = np.packbits(odd.astype(bool).reshape(len(n), -1), axis=1).view(np.int64)
    rank = levels << np.uint64(56) | bs.mix(h) >> np.uint64(8)
    order = bs.order_within(doc, rank)
    rank, levels = rank[order], levels[order]
    place = np.arange(len(rank)) - np.repeat(of[:-1], n)
    length = prefix_length(n, percent)
    inside = place < np.repeat(length, n)
    told = np.flatnonzero(inside & (levels > 0))
    starts = np.searchsorted(told, of)
    some = np.flatnonzero(np.diff(starts))
    if not len(some):
        return
    a, b = (hasher.slices(hasher.sums(rank), of[:-1][some], (of[:-1] + length)[some]).view(np.int64) for hasher in (bs.WORDS, SECOND))
    named, places = bs.mix(rank[told]), place[told].astype(np.uint32)
    cut = list(zip(starts[some].tolist(), starts[some + 1].tolist(), strict=True))
    blobs = [pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (named, places)]
    yield pa.RecordBatch.from_arrays([pa.array(ids[: len(n)][some]), pa.array(n[some]), pa.array(a), pa.array(b), *blobs, *[pa.array(parity[some, i]) for i in range(PARITY)]], names=["doc_id", "n", "p1", "p2", "shingles", "places", *BITS])


def _emit_prefixes(batch: pa.RecordBatch):
    parts = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("shingles").to_pylist()]
    size = [len(p) for p in parts]
    key = np.concatenate(parts or [np.zeros(0, dtype=np.uint64)])
    return key, np.zeros(len(key), dtype=np.uint32), np.repeat(batch.column("doc_id").to_numpy(), size).astype(np.int64), np.concatenate([np.arange(s) for s in size] or [np.zeros(0, np.int64)])


def _post(batches):
    """One row for each shingle of a prefix that other groups have, too."""
    for batch in batches:
        shingles = [np.frombuffer(x, dtype=np.int64) for x in batch.column("shingles").to_pylist()]
        places = [np.frombuffer(x, dtype=np.uint32) for x in batch.column("places").to_pylist()]
        ords = [np.frombuffer(x, dtype=np.uint32) for x in batch.column("ords").to_pylist()]
        size = [len(o) for o in ords]
        if sum(size):
            rep = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), size))  # noqa: B023,E731
            picked = lambda xs: np.concatenate([x[o] for x, o in zip(xs, ords, strict=True)])  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays([pa.array(picked(shingles)), rep("doc_id"), rep("n"), pa.array(picked(places).astype(np.int64))], names=["shingle", "grp", "n", "place"])


def _sets(k: int):
    """doc_id and shingles of the documents at `asked` places of lots."""

    def run(batches):
        for batch in batches:
            for (_, ids, texts), asked in zip(_lots(batch), batch.column("asked").to_pylist(), strict=True):
                asked = np.sort(np.array(asked))
                for piece in bs.pieces(texts.take(pa.array(asked))):
                    h, of = shingle_sets(piece, k)
                    sets = [h[a:b].tobytes() for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asked[piece.first : piece.first + len(piece)]]), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            links = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                common = int((q[at] == p).sum())
                links.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(links, pa.bool_())], names=["a", "b", "linked"])

    return run


def possible(n1, j1, n2, j2, percent: int):
    """Whether sets of n1 and n2 shingles can link, if the ones at j1 and j2 are the first that they share.

    They need percent / (100 + percent) of n1 + n2 in common, and all that they have comes from there on.
    """
    near = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    return near & ((100 + percent) * F.least(n1 - j1, n2 - j2) >= percent * (n1 + n2))


def alike(percent: int):
    """Whether the parity bits of two sets (n, s*; n2, ts*) allow a link; unknown bits do. Linked sets differ in few shingles."""
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"t{b}"))) for b in BITS), F.lit(0))
    return F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("n2")), F.lit(True))


@dataclass
class _Grouped:
    """What steps 1 to 3 make: lots, rows (document, set and place in a lot), classes, members (class and group) and postings (shingle and group)."""

    lots: DataFrame
    rows: DataFrame
    classes: DataFrame
    members: DataFrame
    postings: DataFrame


#: What makes sets equal.
SAME = ["n", "sig1", "sig2"]


def _grouped(docs: DataFrame, k: int, percent: int) -> _Grouped:
    n_ranges = 4 * width(docs.sparkSession)
    measured = durable(one_per_id(docs).transform(in_python, _measure(k), MEASURED))
    lots = measured.where("kind = 1").select("lot", "ids", "sizes", "texts")
    rows = measured.where("kind = 0").select("doc_id", *SAME, "lot", "place")
    classes = durable(rows.where("n > 0").groupBy(SAME).agg(F.min("doc_id").alias("class_id")))

    counted = by_ranges(lots.transform(in_python, _send_keys(k, n_ranges), COUNTED), "range").transform(in_python, _levels, "lot long, range int, levels binary")
    levels = counted.groupBy("lot").agg(F.collect_list(F.struct("range", "levels")).alias("levels"))
    prefixes = lots.join(levels, "lot").transform(in_python, _prefixes(k, percent), f"{PREFIXES}, " + ", ".join(f"{b} long" for b in BITS))
    standing = durable(prefixes.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id"))
    members = standing.select(F.col("doc_id").alias("member"), "n", "p1", "p2", *BITS)
    groups = members.groupBy("n", "p1", "p2").agg(F.min("member").alias("grp"), F.count("*").alias("size"))
    members = durable(members.join(groups, ["n", "p1", "p2"]).select("member", "grp", "n", "size", *BITS))
    heads = standing.join(members.where("member = grp").select(F.col("member").alias("doc_id")), "doc_id")
    shared = flagged(heads, _emit_prefixes, LATER | SHARED)
    postings = durable(heads.join(shared.select("doc_id", "ords"), "doc_id").transform(in_python, _post, "shingle long, grp long, n long, place long"))
    return _Grouped(lots, rows, classes, members, postings)


def _parities(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a group's only member's set allows, for either side; groups of several let all pass until they are expanded."""
    parity = members.where("size = 1").select("grp", *BITS)
    return parity, parity.select(F.col("grp").alias("grp2"), *[F.col(b).alias(f"t{b}") for b in BITS])


def _allowed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of members whose own parity bits allow a link."""
    bits_a = members.select(F.col("member").alias("a"), "n", *BITS)
    bits_b = members.select(F.col("member").alias("b"), F.col("n").alias("n2"), *[F.col(b).alias(f"t{b}") for b in BITS])
    return pairs.join(bits_a, "a").join(bits_b, "b").where(alike(percent)).select("a", "b")


def _verified(g: _Grouped, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs with whether they link; sets are made of those documents only that are in some pair."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(g.rows.select("doc_id", "lot", "place"), "doc_id")
    asked = asked.groupBy("lot").agg(F.collect_list("place").alias("asked"))
    # Lots go through a shuffle, at any size, so that what is measured on little data is what runs on much.
    sets = durable(g.lots.hint("merge").join(asked, "lot").transform(in_python, _sets(k), "doc_id long, shingles binary"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    return durable(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").transform(in_python, _verify(percent), "a long, b long, linked boolean"))


def link_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each doc_id: n_shingles, class_id (the smallest doc_id with the same set) and component_id. NO_ID stands for null."""
    g = _grouped(docs, k, percent)
    members, postings = g.members, g.postings
    parity, parity2 = _parities(members)

    # Pivots of a shingle: its smallest and largest sets, and one at random.
    entry = F.struct("n", "grp", "place")
    pivots = postings.groupBy("shingle").agg(F.min(entry).alias("low"), F.max(entry).alias("high"), F.min(F.struct(F.xxhash64("grp").alias("h"), "n", "grp", "place")).alias("some"))
    pivots = pivots.select("shingle", F.explode(F.array_distinct(F.array("low", "high", F.struct("some.n", "some.grp", "some.place")))).alias("p"))
    by_pivot = postings.join(pivots, "shingle").where(F.col("grp") != F.col("p.grp")).where(possible(F.col("n"), F.col("place"), F.col("p.n"), F.col("p.place"), percent))
    by_pivot = by_pivot.select("grp", "n", F.col("p.grp").alias("grp2"), F.col("p.n").alias("n2")).distinct()
    by_pivot = by_pivot.join(parity, "grp", "left").join(parity2, "grp2", "left").where(alike(percent)).select("grp", F.col("grp2").alias("pivot")).join(members.select("member", "grp"), "grp").select(F.col("pivot").alias("a"), F.col("member").alias("b"))
    own = members.where("member <> grp").select(F.col("grp").alias("a"), F.col("member").alias("b"))
    first = durable(by_pivot.unionByName(own).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    judged = _verified(g, first, k, percent)
    links = judged.where("linked").select("a", "b")
    found = durable(components(links))

    # Members with the component that they are in so far; groups with all components of their members.
    placed = durable(members.join(found.withColumnRenamed("node", "member"), "member", "left").select("member", "grp", "n", F.coalesce("component", "member").alias("component")))
    spread = postings.join(placed.groupBy("grp").agg(F.min("component").alias("c1"), F.max("component").alias("c2")), "grp")
    undone = spread.groupBy("shingle").agg(F.min("c1").alias("c1"), F.max("c2").alias("c2")).where("c1 <> c2").select("shingle")
    lists = durable(postings.join(undone, "shingle").join(placed.select("grp", "component").distinct(), "grp"))
    x = lists.select("shingle", "component", "grp", "n", "place").join(parity, "grp", "left")
    y = lists.select("shingle", F.col("component").alias("other"), F.col("grp").alias("grp2"), F.col("n").alias("n2"), F.col("place").alias("place2")).join(parity2, "grp2", "left")
    # Both sides meet at the shingle; sizes, places and parities decide in the join itself, before any row is made.
    meet = (x["shingle"] == y["shingle"]) & (x["component"] < y["other"]) & possible(F.col("n"), F.col("place"), F.col("n2"), F.col("place2"), percent) & alike(percent)
    group_pairs = x.join(y.drop("component"), meet)
    group_pairs = group_pairs.select("grp", "component", "grp2", "other").distinct()
    # Groups of several are expanded; what their members' own parities allow is verified.
    mixed = placed.groupBy("grp").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("grp")
    inside = placed.join(mixed, "grp")
    within = inside.join(inside.select("grp", F.col("member").alias("b"), F.col("component").alias("other")), "grp").where("component < other").select(F.col("member").alias("a"), "b")
    expand = placed.select("grp", "component", F.col("member").alias("a"))
    expand2 = placed.select(F.col("grp").alias("grp2"), F.col("component").alias("other"), F.col("member").alias("b"))
    rest = group_pairs.join(expand, ["grp", "component"]).join(expand2, ["grp2", "other"]).select("a", "b").unionByName(within)
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = durable(_allowed(rest.join(judged.select("a", "b"), ["a", "b"], "left_anti"), members, percent))
    if not is_void(rest):
        more = _verified(g, rest, k, percent).where("linked").select("a", "b")
        if not is_void(more):
            found = durable(components(links.unionByName(more)))
    named = g.classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select(*SAME, "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = g.rows.join(named, SAME, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def class_links(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The whole join: a < b, all pairs of different classes that link, by their class_ids; and rows of doc_id, the set and class_id.

    All pairs of groups that share a shingle of their prefixes and that sizes, places and parities allow
    are expanded and verified. A shingle's postings are salted: PART of them meet all others in a task.
    """
    g = _grouped(docs, k, percent)
    parity, parity2 = _parities(g.members)
    salts = g.postings.groupBy("shingle").agg(F.ceil(F.count("*") / PART).cast("int").alias("salts"))
    salted = g.postings.join(salts, "shingle")
    x = salted.withColumn("salt", F.pmod(F.xxhash64("grp"), F.col("salts")).cast("int")).join(parity, "grp", "left")
    y = salted.select("shingle", F.col("grp").alias("grp2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(parity2, "grp2", "left")
    meet = (x["shingle"] == y["shingle"]) & (x["salt"] == y["salt"]) & (x["grp"] < y["grp2"]) & possible(F.col("n"), F.col("place"), F.col("n2"), F.col("place2"), percent) & alike(percent)
    group_pairs = x.drop("salts").join(y, meet).select("grp", "grp2").distinct()
    expand = g.members.select("grp", F.col("member").alias("a"))
    expand2 = g.members.select(F.col("grp").alias("grp2"), F.col("member").alias("b"))
    inside = g.members.where("size > 1").select("grp", F.col("member").alias("a"))
    within = inside.join(inside.select("grp", F.col("a").alias("b")), "grp").where("a < b").select("a", "b")
    pairs = group_pairs.join(expand, "grp").join(expand2, "grp2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(within)
    links = _verified(g, durable(_allowed(pairs, g.members, percent)), k, percent).where("linked").select("a", "b")
    return links, g.rows.join(g.classes, SAME, "left")


def linked_documents(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each doc_id: n_shingles, component_id, n_links (other documents that link with it, equal sets among them) and class_id. NO_ID stands for null."""
    links, rows = class_links(docs, k, percent)
    links = durable(links)
    sizes = durable(rows.where("class_id is not null").groupBy("class_id").agg(F.count("*").alias("size")))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, both["b"] == sizes["class_id"]).groupBy("a").agg(F.sum("size").alias("others"))
    per_class = sizes.join(others, sizes["class_id"] == others["a"], "left").select("class_id", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    found = components(links).withColumnRenamed("node", "class_id")
    out = rows.join(per_class, "class_id", "left").join(found, "class_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs`, of each component the row with the smallest doc_id, with all columns."""
    rows = one_row_per_id(docs)
    (key,) = fresh(rows, "gone_id")
    gone = link_components(rows, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(key))
    return rows.join(gone, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == gone[key], "left_anti")


def op2_near_dedup_links(spark, sf_dir: str) -> DataFrame:
    """The whole join: op2_near_dedup's columns and the number of links of each document. It has no SQL; a loop bounds it (tests/llm/test_links.py)."""
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return linked_documents(table(spark, sf_dir, "documents")).select(known("doc_id"), "n_shingles", known("component_id"), "n_links", known("class_id"))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = link_components(table(spark, sf_dir, "documents"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.select(known("doc_id"), "n_shingles", known("component_id"), known("class_id"))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS same FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id, coalesce(any_value(c.class_id), w.doc_id) AS class_id
FROM w JOIN reach r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT same, min(doc_id) AS class_id FROM n GROUP BY same) c ON c.same = n.same GROUP BY w.doc_id
"""
