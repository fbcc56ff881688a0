"""N-gram Jaccard join: a forest of count-vector R-trees over shingle sets.

The shingles of a text are hashed into groups, about half as many as shingles (``GROUPS`` to
``MOST_GROUPS``, in powers of two, so that points fold); the counts by group are a point.
Two sets' overlap is at most the sum of the smaller coordinates of their points, and at most
the same sum with the upper corner of a box of points, so an R-tree of boxes finds the pairs
that may reach the threshold; the survivors are verified on the sets themselves.  Every pair
that is ever verified was let through by a tree.

One tree over all points could not prune: boxes of unlike texts of like size overlap.  So the
points are parted into a forest first, without loss: of two sets with a Jaccard of 0.8, each
has one of its rarest fifth of shingles (in one order for all: by how often the shingle's
``SLOTS`` slot occurs in the corpus, then by hash) in common with the other, and a shingle's
sets are one tree.
1. Texts with equal sets are one node.
2. Nodes are posted under their rarest fifth, by one of their documents; shingles of one node drop
   out, and of shingles with the same nodes the first in that order stands for all.  Two sets need
   each other only in the tree of the first shingle they have in common, where what either has from
   there on bounds their overlap; a node that by this and by size fits no other of a tree leaves it,
   before any point is moved.
3. Nearest neighbours: every node asks its trees for the node before it (smaller, then by id) with
   the highest bound, and the best answer of all is verified; trees in which no two nodes pass the
   bound are done.  This links groups of thousands of near copies with one comparison a node.
   It is repeated, asking for nodes of other components, until a round brings few links.
4. What is left: trees that still hold nodes of different components give every pair of
   different components that passes the bound, once (in the tree of the first shingle that both
   have), and all of them are verified.
A shingle with many nodes is dealt into blocks of ``BLOCK`` nodes; in step 4 every two blocks
form a tree of their own.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased.  Defined cases: texts
without words have no shingles and are linked with nothing; fewer words than ``width`` are one
shingle; a component is named by its least id that is not null, and by null if it has none;
rows that repeat an id are judged each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.store import cut, drop
from quillon.llm.common import bit_set, in_bit_set, text_batches
from quillon.llm.graphs import components
from quillon.llm.words import U, mix, shingle_sets

WIDTH = 5
GROUPS = 64
MOST_GROUPS = 4096
PER_GROUP = 2
SLOTS = 1 << 18
PART = 256
BLOCK = 2048
PERCENT = 80
#: A node takes so many of its first shingles along, by which pairs that meet in several trees are told.
FIRST = 32
#: Texts are taken so many at a time.
TEXTS = 2048
#: Postings have rare slots, so the low bits of their keys are few; marks are made of those from here on.
HIGH = 26


def groups_for(n: int) -> int:
    """Half as many groups as shingles, as a power of two from ``GROUPS`` to ``MOST_GROUPS``."""
    return min(MOST_GROUPS, max(GROUPS, 1 << (n // PER_GROUP).bit_length()))


def point(shingles: np.ndarray) -> bytes:
    """Counts by group, in a byte each where they fit and in four where not."""
    groups = groups_for(len(shingles))
    counts = np.bincount((shingles % U(groups)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def folded(at: np.ndarray, groups: int) -> np.ndarray:
    """Points (one a row) over fewer groups: those that are equal modulo ``groups`` add up."""
    return at if at.shape[1] == groups else at.reshape(len(at), -1, groups).sum(1, dtype=np.int32)


class Points:
    """Points of sets of n shingles, by their numbers of groups."""

    def __init__(self, raw: list[bytes], n: np.ndarray):
        self.groups = np.array([groups_for(int(k)) for k in n], np.int64)
        self.place, self.at = np.zeros(len(n), np.int64), {}
        for g in np.unique(self.groups).tolist():
            some = np.flatnonzero(self.groups == g)
            each = [np.frombuffer(raw[k], np.uint8 if len(raw[k]) == g else np.uint32) for k in some]
            self.at[g] = np.stack(each)
            self.place[some] = np.arange(len(some))

    def of(self, some: np.ndarray, groups: int) -> np.ndarray:
        """These points over so many groups, no more than any of them has."""
        own = self.groups[some]
        if len(some) and (own == groups).all():
            return self.at[groups][self.place[some]]
        out = np.zeros((len(some), groups), np.int32)
        for g in np.unique(own).tolist():
            out[own == g] = folded(self.at[g][self.place[some[own == g]]], groups)
        return out

    def bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The summed smaller coordinates of each pair, over the groups of the coarser of the two."""
        out = np.zeros(len(a), np.int64)
        common = np.minimum(self.groups[a], self.groups[b])
        for g in np.unique(common).tolist():
            own = np.flatnonzero(common == g)
            step = max(1, (1 << 20) // g)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                out[part] = np.minimum(self.of(a[part], g), self.of(b[part], g)).sum(1, dtype=np.int64)
        return out


def prints(shingles: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set: its node id and a check on it."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles).sum() + U(len(shingles))]))[0].view(np.int64)), int(mix(shingles * U(0x9E3779B97F4A7C15) + U(11)).sum().view(np.int64))


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap with which sets of n and m shingles reach the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``TEXTS`` a batch at most, so that what a worker holds for a batch stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            yield batch.slice(k, TEXTS)


def sketched(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and the corpus's slot counts in parts of ``PART``."""
    slots = np.zeros(SLOTS, np.int64)
    names = ["doc", "n", "node", "again", "point", "part", "counts"]
    for batch in sliced(batches):
        n, node, again, at = [], [], [], []
        for _, s in shingle_sets(batch.column(1), width):
            a, b = prints(s)
            n.append(len(s))
            node.append(a)
            again.append(b)
            at.append(point(s))
            slots += np.bincount((s % U(SLOTS)).astype(np.int64), minlength=SLOTS) if len(s) > SLOTS // 8 else 0
            if len(s) <= SLOTS // 8:
                np.add.at(slots, (s % U(SLOTS)).astype(np.int64), 1)
        none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(again, pa.int64()), pa.array(at, pa.binary()), *none], names=names)
    blocks = slots.reshape(-1, PART)
    some = np.flatnonzero(blocks.any(1))
    empty = [pa.nulls(len(some), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
    yield pa.RecordBatch.from_arrays([*empty, pa.array(some.astype(np.int32)), pa.array([blocks[k].tobytes() for k in some], pa.binary())], names=names)


def slot_counts(sketches: DataFrame) -> np.ndarray:
    """How often each slot occurs, summed in Spark; ``SLOTS`` numbers in all."""

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(c.as_py(), np.int64) for c in group["counts"]], axis=0)
        return pa.table({"part": group["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    got = sketches.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary").toArrow()
    out = np.zeros((SLOTS // PART, PART), np.int64)
    for part, counts in zip(got["part"].to_pylist(), got["counts"].to_pylist(), strict=True):
        out[part] = np.frombuffer(counts, np.int64)
    return out.reshape(-1)


def posted(batches: Iterator[pa.RecordBatch], slots: np.ndarray, chosen: np.ndarray, several: np.ndarray, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """shingle, node, size of the set and place of the shingle in it for the rarest shingles of each set, once a node and
    batch, from rows (hash of the id, text) that may be ``chosen``; again: the node may be one of ``several`` rows."""
    names = ["key", "node", "n", "at", "again"]
    for batch in sliced(batches):
        ids, keys, nodes, sizes, seen = batch.column(0).to_numpy(), [], [], [], set()
        for row, s in shingle_sets(batch.column(1), width):
            node = prints(s)[0] if len(s) else None
            if node is None or node in seen or not in_bit_set(chosen, ids[row : row + 1] ^ node)[0]:
                continue
            seen.add(node)
            k = len(s) - -(-percent * len(s) // 100) + 1
            keys.append(s[np.lexsort((s, slots[(s % U(SLOTS)).astype(np.int64)]))[:k]])
            nodes.append(node)
            sizes.append(len(s))
        if keys:
            long = np.array([len(k) for k in keys])
            at = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            node, n, again = (np.repeat(x, long) for x in (np.array(nodes, np.int64), np.array(sizes, np.int32), in_bit_set(several, np.array(nodes, np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node), pa.array(n), pa.array(at.astype(np.int32)), pa.array(again)], names=names)


def partnered(edges: np.ndarray, n: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of the trees that start at ``edges`` may be linked to another row of their tree, if the tree's
    shingle, in place ``at`` of each set of ``n``, is the first that the two have in common."""
    out, room = np.zeros(len(n), bool), n - at
    first, size = (np.repeat(x, np.diff(edges)) for x in (edges[:-1], np.diff(edges)))
    for s in np.unique(size[size > 1]).tolist():
        own = np.flatnonzero(size == s)
        step = max(1, (1 << 18) // s)
        for k in range(0, len(own), step):
            a = own[k : k + step, None]
            b = first[a] + np.arange(s)
            good = (a != b) & (np.minimum(n[a], n[b]) * 100 >= percent * np.maximum(n[a], n[b]))
            good &= np.minimum(room[a], room[b]) >= least_overlap(n[a], n[b], percent)
            out[own[k : k + step]] = good.any(1)
    return out


def pruned(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """key, node and size of the rows (sorted by key) that may have a partner in their tree; trees of more than ``BLOCK`` nodes stay whole."""
    rest: pa.Table | None = None

    def some(table: pa.Table) -> list[pa.RecordBatch]:
        key, size, n, at = (table[c].to_numpy() for c in ("key", "size", "n", "at"))
        edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        stay = size > BLOCK
        small = np.flatnonzero(~stay)
        starts = np.concatenate(([0], np.cumsum(np.add.reduceat((~stay).astype(np.int64), edges[:-1]))))
        stay[small] = partnered(starts, n[small].astype(np.int64), at[small], percent)
        return table.select(["key", "node", "size"]).filter(pa.array(stay)).combine_chunks().to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        last = int(np.searchsorted(table["key"].to_numpy(), table["key"][-1].as_py())) if table.num_rows else 0
        rest = table.slice(last)
        if last:
            yield from some(table.slice(0, last))
    if rest is not None and rest.num_rows:
        yield from some(rest)


class Tree:
    """An R-tree over points in the order given: boxes of ``LEAF`` points, and boxes of ``LEAF``
    boxes, over the groups of the coarsest point; points that pass are bounded again over all their groups."""

    LEAF = 16

    def __init__(self, points: Points, n: np.ndarray):
        at = points.of(np.arange(len(n)), int(points.groups.min()))
        self.points, self.at, self.n = points, at, n
        self.levels = []
        top, low, high = at, n, n
        while len(top) > self.LEAF:
            cuts = np.arange(0, len(top), self.LEAF)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def coarse(self, q: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The points before ``q`` that the boxes and the coarse bound let through, with that bound."""
        p, n = self.at[q], self.n[q]
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(q)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[at] for x in self.levels[depth])
            fits = (high * 100 >= percent * n) & (low * percent <= 100 * n)
            fits &= np.minimum(p, top).sum(1, dtype=np.int64) >= least_overlap(n, low, percent)
            at = (at[fits][:, None] * self.LEAF + np.arange(self.LEAF)).reshape(-1)
            limit = len(self.levels[depth - 1][0]) if depth else q
            at = at[at < limit]
        bound = np.minimum(p, self.at[at]).sum(1, dtype=np.int64)
        good = (bound >= least_overlap(n, self.n[at], percent)) & (self.n[at] * 100 >= percent * n) & (self.n[at] * percent <= 100 * n)
        return at[good], bound[good]

    def fine(self, q: int, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        bound = self.points.bounds(np.full(len(at), q), at)
        good = bound >= least_overlap(self.n[q], self.n[at], percent)
        return at[good], bound[good]

    def reach(self, q: int, percent: int) -> np.ndarray:
        """The points before ``q`` that pass the bound."""
        return self.fine(q, self.coarse(q, percent)[0], percent)[0]


def _leaves(of: np.ndarray, size: int, comp: np.ndarray, n: np.ndarray, points: Points, percent: int):
    """Groups of one ``size``, too small for a box: (earlier, later, bound) of the pairs of rows that pass. ``of``: their first rows."""
    x, y = np.triu_indices(size, 1)
    for k in range(0, len(of), max(1, (1 << 17) // len(x))):
        first = of[k : k + max(1, (1 << 17) // len(x))]
        a, b = (first[:, None] + x).reshape(-1), (first[:, None] + y).reshape(-1)
        good = (comp[a] != comp[b]) & (np.minimum(n[a], n[b]) * 100 >= percent * np.maximum(n[a], n[b]))
        a, b = a[good], b[good]
        bound = points.bounds(a, b)
        good = bound >= least_overlap(n[a], n[b], percent)
        yield a[good], b[good], bound[good]


def _met_before(a: np.ndarray, b: np.ndarray, key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the two rows of a pair have a shingle below their tree's in common, among the ``first`` of each."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 12):
        own = slice(k, k + (1 << 12))
        same = (first[a[own]][:, :, None] == first[b[own]][:, None, :]) & (first[a[own]] < key[a[own]][:, None])[:, :, None]
        out[own] = same.any((1, 2))
    return out


def searched(batches: Iterator[pa.RecordBatch], percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shingle and block, a tree each: pairs of different components that pass the bound
    (a, b and the bound's share of the union), all of them or for every node ``b`` the ``nearest`` before it;
    rows with the key alone name the trees in which some pair may pass."""
    rest: pa.Table | None = None

    def pairs(table: pa.Table, edges: np.ndarray) -> list[pa.RecordBatch]:
        key, node, comp, n = (table[c].to_numpy() for c in ("key", "node", "component", "n"))
        points = Points(table["point"].to_pylist(), n)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        first, size, open_keys = edges[:-1], np.diff(edges), [np.zeros(0, np.int64)]
        for s in np.unique(size[(size > 1) & (size <= Tree.LEAF)]).tolist():
            for a, b, bound in _leaves(first[size == s], s, comp, n, points, percent):
                found.append((a, b, bound / (n[a] + n[b] - bound)))
                open_keys.append(np.unique(key[a]))
        for k in np.flatnonzero(size > Tree.LEAF):
            own = np.arange(first[k], first[k] + size[k])
            if comp[own].min() == comp[own].max():
                continue
            if not nearest:
                own = own[np.lexsort((n[own], comp[own]))]
            tree, some = Tree(Points([table["point"][int(i)].as_py() for i in own], n[own]), n[own]), False
            for q in range(1, len(own)):
                at, _ = tree.coarse(q, percent)
                at, bound = tree.fine(q, at[comp[own[at]] != comp[own[q]]], percent)
                if not len(at):
                    continue
                some = True
                share = bound / (tree.n[q] + tree.n[at] - bound)
                if nearest:
                    at, share = at[[share.argmax()]], share[[share.argmax()]]
                found.append((own[at], np.full(len(at), own[q]), share))
            if some:
                open_keys.append(key[own[:1]])
        a, b, share = (np.concatenate(x) for x in zip(*found, strict=True))
        if nearest:
            order = np.lexsort((node[a], -share, node[b]))
            order = order[np.concatenate((np.ones(min(1, len(a)), bool), node[b][order][1:] != node[b][order][:-1]))]
            a, b, share = a[order], b[order], share[order]
        elif len(a):
            most = pc.list_value_length(table["first"]).to_numpy()
            firsts = np.full((len(node), max(1, most.max())), np.iinfo(np.int64).max)
            firsts[np.arange(firsts.shape[1]) < most[:, None]] = table["first"].combine_chunks().flatten().to_numpy() if isinstance(table["first"], pa.ChunkedArray) else table["first"].flatten().to_numpy()
            new = ~_met_before(a, b, key, firsts)
            a, b, share = a[new], b[new], share[new]
        marks = np.concatenate(open_keys) if nearest else np.zeros(0, np.int64)
        none = pa.nulls(len(marks), pa.int64())
        columns = [pa.chunked_array([pa.array(x), y]) for x, y in ((node[a], none), (node[b], none), (share, none.cast(pa.float64())))]
        return pa.table([*columns, pa.chunked_array([pa.nulls(len(a), pa.int64()), pa.array(marks)])], names=["a", "b", "share", "key"]).combine_chunks().to_batches()

    def whole(table: pa.Table, last: bool):
        key = np.stack([table[c].to_numpy() for c in ("key", "i", "j")])
        edges = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [table.num_rows]))
        edges = edges if last else edges[:-1]
        return table.slice(0, edges[-1]), edges, table.slice(edges[-1])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        done, edges, rest = whole(table, False)
        if done.num_rows:
            yield from pairs(done.combine_chunks(), edges)
    if rest is not None and rest.num_rows:
        done, edges, _ = whole(rest, True)
        yield from pairs(done.combine_chunks(), edges)


class Join:
    """The steps over one table of documents."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, width: int, percent: int):
        self.spark = docs.sparkSession
        self.width, self.percent = width, percent
        self.made: list[DataFrame] = []
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
        sketch = "doc long, n long, node long, again long, point binary, part int, counts binary"
        with text_batches(self.spark):
            sketches = cut(self.docs.mapInArrow(lambda x: sketched(x, width), sketch), "jaccard-sketches")
        self.rows = cut(sketches.where("part is null").select("doc", "n", "node"), "jaccard-rows")
        nodes = sketches.where("n > 0").groupBy("node").agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.max("n").alias("m"), F.min("again").alias("again"), F.max("again").alias("other"), F.first("point").alias("point"), F.count("*").alias("rows"))
        self.nodes = self.held(nodes, "jaccard-nodes")
        self.slots = slot_counts(sketches)
        drop(sketches)
        if self.nodes.where("again <> other or n <> m").take(1):
            raise ArithmeticError("two different sets have the same 64-bit hash")

    def held(self, df: DataFrame, name: str) -> DataFrame:
        """A cut table that ``release`` deletes."""
        self.made.append(cut(df, name))
        return self.made[-1]

    def release(self) -> None:
        drop(*self.made)
        self.made = []

    def among(self, marks: np.ndarray, shift: int = 0):
        """A filter for rows whose first column, so many bits shifted, may be marked."""
        marks = self.spark.sparkContext.broadcast(marks)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bit_set(marks.value, batch.column(0).to_numpy() >> shift)))

        return rows

    def forest(self) -> DataFrame:
        """key, node and size: the shingles that part the nodes into trees, and the number of nodes that have them."""
        context = self.spark.sparkContext
        slots = context.broadcast(self.slots)
        chosen = context.broadcast(bit_set(self.nodes.select(F.xxhash64("doc").bitwiseXOR(F.col("node")).alias("h")), "h", 26))
        several = context.broadcast(bit_set(self.nodes.where("rows > 1").select("node"), "node"))
        width, percent = self.width, self.percent
        posts = "key long, node long, n int, at int, again boolean"
        texts = self.docs.select(F.xxhash64("doc").alias("h"), "text")
        with text_batches(self.spark):
            all_of = cut(texts.mapInArrow(lambda x: posted(x, slots.value, chosen.value, several.value, width, percent), posts), "jaccard-postings")
        copied = cut(all_of.where("again").distinct(), "jaccard-copied")  # an id or a mark may be shared; all other nodes post once
        once = all_of.where("not again").unionByName(copied)
        high = F.shiftright("key", HIGH).alias("high")
        marks = bit_set(once.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(high), "high", 26)
        posts = "key long, node long, n int, at int"
        both = cut(once.drop("again").mapInArrow(self.among(marks, HIGH), posts), "jaccard-shared")
        drop(all_of, copied)
        whole = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
        sizes = both.groupBy("key").agg(F.count("*").alias("size"), F.min("at").alias("at"), *whole).where("size > 1")
        stand = cut(sizes.groupBy("size", "x", "y").agg(F.min(F.struct("at", "key")).alias("first")).select("first.key", "size"), "jaccard-stand")
        rows = both.mapInArrow(self.among(bit_set(stand.select(high), "high", 26), HIGH), posts).join(stand, "key").select("key", "node", "size", "n", "at")
        rows = rows.repartition("key", F.when(F.col("size") > BLOCK, F.col("node"))).sortWithinPartitions("key")
        out = self.held(rows.mapInArrow(lambda x: pruned(x, percent), "key long, node long, size long"), "jaccard-forest")
        drop(both, stand)
        return out

    def trees(self, rows: DataFrame, nearest: bool) -> DataFrame:
        """a, b and share: what the trees of ``rows`` (key, node, component, size) let through; key: trees that are not done."""
        percent = self.percent
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        others = F.array(own) if nearest else F.sequence(F.lit(0), blocks - 1)
        dealt = rows.withColumn("own", own).withColumn("k", F.explode(others)).select("key", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "node", "component")
        points = self.nodes.select("node", "n", "point").mapInArrow(self.among(bit_set(rows.select("node"), "node")), "node long, n long, point binary")
        dealt = dealt.join(points, "node")
        if not nearest:
            dealt = dealt.join(rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST).alias("first")), "node")
        dealt = dealt.select("key", "i", "j", "n", "node", "component", "point", *([] if nearest else ["first"]))
        return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node").mapInArrow(lambda x: searched(x, percent, nearest), "a long, b long, share double, key long")

    def nearest(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of each node's nearest, and the keys of the trees that are not done."""
        near = self.held(self.trees(rows, nearest=True), "jaccard-nearest")
        best = near.where("b is not null").groupBy("b").agg(F.max(F.struct("share", "a")).alias("best")).select("best.a", "b")
        return self.verified(best), near.where("b is null").select("key")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b: nodes) that reach the threshold, by their sets, which come from a document of each node."""
        percent, width = self.percent, self.width
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.nodes.select("node", "doc"), "node")
        marks = self.spark.sparkContext.broadcast(bit_set(ends.select(F.xxhash64("doc").alias("h")), "h"))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                batch = batch.filter(pa.array(in_bit_set(marks.value, batch.column(0).to_numpy())))
                some = {}
                for _, s in shingle_sets(batch.column(1), width):
                    if len(s):
                        some[prints(s)[0]] = s.view(np.int64)
                if some:
                    at = np.concatenate(([0], np.cumsum([len(s) for s in some.values()]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(list(some.values()))))], names=["node", "shingles"])

        held = self.docs.select(F.xxhash64("doc").alias("h"), "text").mapInArrow(sets, "node long, shingles array<long>")
        held = held.dropDuplicates(["node"])  # rows may repeat an id and a text
        paired = pairs.select("a", "b").join(held.toDF("a", "s"), "a").join(held.toDF("b", "t"), "b")
        common = F.size(F.array_intersect("s", "t")).cast("long")
        links = paired.withColumn("k", common).where(F.col("k") * 100 >= percent * (F.size("s") + F.size("t") - F.col("k"))).select("a", "b")
        with text_batches(self.spark):
            return self.held(links, "jaccard-links")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id (null only if there is no
    other) that links of a Jaccard of ``percent`` reach."""
    run = Join(docs, doc_id, text, width, percent)
    forest = run.forest()
    wide = forest.where(F.col("size") > BLOCK).select("key")  # their blocks have met none but themselves
    links, undone = run.nearest(forest.withColumn("component", F.col("node")))
    rest, few = forest, False
    while True:
        merged = components(links)
        at = rest.join(undone.unionByName(wide).distinct(), "key").join(merged, "node", "left")
        at = cut(at.select("key", "node", "size", F.coalesce("component", "node").alias("component")), "jaccard-placed")
        mixed = at.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key")
        rest = run.held(at.join(mixed, "key"), "jaccard-rest")
        drop(at, merged)
        if few:
            break
        more, undone = run.nearest(rest)
        links = links.unionByName(more)
        few = more.count() * 5 <= links.count()
        rest = rest.drop("component")
    left = run.trees(rest, nearest=False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = run.verified(run.held(left, "jaccard-left"))
    merged = components(links.unionByName(more))
    of_node = run.nodes.select("node", "doc").join(merged, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    of_node = cut(of_node, "jaccard-components")
    drop(merged)
    run.release()
    least = of_node.groupBy("component").agg(F.min("doc").alias("least"))
    of_node = of_node.join(least, "component").select("node", "least")
    out = run.rows.select("doc", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of_node, "node", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))
