"""Repeated passages: distributed prefix doubling over sampled suffix positions.

A byte goes when a string of ``length`` bytes that covers it also starts earlier (smaller
document id, or the same document and an earlier start).  Prefix doubling names the string of
32, 64, 128, ... bytes at a position by a rank; the rank of twice the reach comes from the pair of
ranks at a position and one reach further on (or less far, where the threshold is nearer).
Spark sorts positions by their rank pairs; what is alone in its rank is unique and drops out.

Ranking every byte position would shuffle some 24 bytes for each byte of text and round, so
sampling narrows what enters, without loss: every window of ``length`` bytes picks its smallest
string of ``GRAM`` = 32 bytes (by hash; leftmost of equals).  Equal windows pick the same place in
them, so what repeats shares picks, and the windows that share a pick are one block.
1. Reach 32: picks are sorted by the pair of the pick's rank and the whole block's.  Of equal
   blocks all but the first repeat; where a rank has one block only, that block drops out.
2. Reach 64, over the blocks left: every window covers the pick and the 32 bytes after it, or
   the 32 before it, so a block is one or two parts.  Parts are sorted by the pair of the rank of those 64
   bytes and of the whole part; equal parts repeat, parts alone in their rank drop out.
3. Reach 100, past the threshold: the windows of the parts left, one by one, are sorted by the pair of their
   ranks of 64 bytes at offsets 0 and ``length`` - 64; all but the first position of a pair start repeats.
   The parts of a rank lie in one task, which sorts their windows itself; of a rank with over ``GROUP``
   parts Spark sorts them.

Nothing is broadcast but ranks that are frequent in a sample: those are dealt by the whole pair, so a string
with many different surroundings is spread over all tasks, and their blocks go to round 3 at once.
So rows and disk of each round follow the input, however large it is.

Ranks are named by hashes of 64 bits.  Both halves of a sorted pair come from different hash
functions, so pairs that are told equal agree in 128 bits.
Before each sort every task drops (and marks) repeats within a batch of documents, so a passage that
stands in a third of all documents is one row a batch, not one a document.

Defined cases: null and short texts lose nothing; documents are ordered by id, null as the smallest
long, and where ids are equal by the text's hash; rows that repeat an id and its text are the same
document, and all lose the same; bytes are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.store import cut, drop
from quillon.llm.words import BYTE, RUN, U, buffers, mix, runs

LENGTH = 100
GRAM = 32
REACH = 64
#: Ranks of at least ``HOT`` blocks in one of ``SAMPLE`` documents are frequent; the most frequent ``HOTTEST`` are dealt by the whole pair.
SAMPLE, HOT, HOTTEST = 64, 512, 1 << 18
#: Parts of one rank whose windows a task sorts itself.
GROUP = 1 << 13
#: Rows to be sorted: the rank pair, the document, and the first start << 16, bit 15 for a frequent rank, the pick's distance
#: from that start << 8 and the number of starts after it (255: of a repeat that is known already, whose last start is ``b``).
_NAMES = ["a", "b", "doc", "tie", "place"]
_PLACED = ", ".join(f"{c} long" for c in _NAMES)
_FREQUENT = 1 << 15
#: What sorted rows give.  Kind 1: starts of repeats, as first << 32 | how many follow.  Kind 2: a block, by its place.  Kind 3: a window, by its place.
_FOUND = "kind int, a long, b long, doc long, tie long, span long"
_BASES = (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)
_BYTES = (BYTE, mix(BYTE + U(0x2545F4914F6CDD1D)))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64; the largest asked for are kept."""
    if family not in _POWERS or len(_POWERS[family][0]) < n:
        up, down = np.full(n, _BASES[family], U), np.full(n, pow(_BASES[family], -1, 1 << 64), U)
        up[0] = down[0] = 1
        _POWERS[family] = np.cumprod(up), np.cumprod(down)
    return _POWERS[family]


class Sums:
    """Hashes of any stretch of some bytes, by one of two families of hash functions."""

    def __init__(self, b: np.ndarray, family: int = 0):
        up, self.down = _powers(1 << max(19, len(b).bit_length()), family)
        self.family = family
        self.total = np.zeros(len(b) + 1, U)
        np.cumsum(_BYTES[family][b] * up[: len(b)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U) + U(self.family))

    def all_of(self, size: int) -> np.ndarray:
        """Of the stretches of ``size`` bytes at every start."""
        n = len(self.total) - size
        return mix((self.total[size:] - self.total[:n]) * self.down[:n] + U(size + self.family))


def stretches(at: np.ndarray, length: int):
    """(first byte, last byte, documents) of stretches of about ``RUN`` bytes; a long document is
    several, that overlap by ``length`` - 1."""
    for first, last in runs(at):
        if last - first == 1 and at[last] - at[first] > 2 * RUN:
            for a in range(int(at[first]), int(at[last]), RUN):
                yield a, min(int(at[last]), a + RUN + length - 1), first, last
        else:
            yield int(at[first]), int(at[last]), first, last


def picks(b: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Sums]:
    """Pick, first and last window start and rank of each pick of the documents in ``b``, which end at ``ends``."""
    none = np.zeros(0, np.int64)
    sums = Sums(b)
    if len(b) < length:
        return none, none, none, none.astype(U), sums
    gram = sums.all_of(GRAM)
    low = (gram & ~U((1 << 22) - 1)) | np.arange(len(gram), dtype=U)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    pick = (low & U((1 << 22) - 1)).astype(np.int64)
    p = np.arange(len(pick))
    doc = np.searchsorted(ends, p, "right")
    good = p + length <= ends[np.minimum(doc, len(ends) - 1)]
    p, pick, doc = p[good], pick[good], doc[good]
    if not len(p):
        return none, none, none, none.astype(U), sums
    new = np.flatnonzero(np.concatenate(([True], (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1]))))
    return pick[new], p[new], p[np.concatenate((new[1:] - 1, [len(p) - 1]))], gram[pick[new]], sums


def _picked(batch: pa.RecordBatch, length: int):
    """By stretch of bytes of (doc, tie, text): pick, first and last start, rank, sums, bytes, doc, tie and the document's first byte."""
    data, at = buffers(batch.column(2))
    doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for a, z, first, last in stretches(at, length):
        ends = np.minimum(at[first + 1 : last + 1], z) - a
        pick, ps, pe, gram, sums = picks(data[a:z], ends, length)
        if len(pick):
            own = first + np.searchsorted(ends, ps, "right")
            yield pick, ps, pe, gram, sums, data[a:z], doc[own], tie[own], at[own] - a


def _rows(a: np.ndarray, b: np.ndarray, doc: np.ndarray, tie: np.ndarray, place: np.ndarray, more: pa.Array | None = None) -> pa.RecordBatch:
    columns = [pa.array(c.view(np.int64) if c.dtype == U else c.astype(np.int64, copy=False)) for c in (a, b, doc, tie, place)]
    return pa.RecordBatch.from_arrays(columns if more is None else [*columns, more], names=_NAMES if more is None else [*_NAMES, "part"])


def _found(kind: int, doc: np.ndarray, tie: np.ndarray, span: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.zeros(len(doc), np.int64)
    columns = [pa.array(c.view(np.int64)) for c in (none if a is None else a, none if b is None else b, doc, tie, span)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *columns], names=["kind", "a", "b", "doc", "tie", "span"])


def _new(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _firsts(a: np.ndarray, b: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each rank pair, and the rows after it that stand elsewhere."""
    order = np.argsort(a)
    new = _new(a[order])
    alone = new & np.append(new[1:], True)
    own, order = order[alone], order[~alone]
    order = order[np.lexsort((start[order], tie[order], doc[order], b[order], a[order]))]
    new = _new(a[order], b[order])
    k = order[new]
    head = k[np.cumsum(new) - 1]
    return np.concatenate((own, k)), order[~new & ((doc[order] != doc[head]) | (tie[order] != tie[head]) | (start[order] != start[head]))]


def _among(ranks: np.ndarray, sorted_ranks: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_ranks, ranks)
    return np.append(sorted_ranks, U(0))[at] == ranks if len(sorted_ranks) else np.zeros(len(ranks), bool)


def _touching(doc: np.ndarray, tie: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of starts, those that touch as one."""
    order = np.lexsort((first, tie, doc))
    doc, tie, first, last = doc[order], tie[order], first[order], last[order]
    new = np.flatnonzero(_new(doc, tie) | np.append(True, first[1:] > last[:-1] + 1)[: len(doc)])
    return doc[new], tie[new], first[new], np.maximum.reduceat(last, new) if len(new) else last


def _known(doc: np.ndarray, tie: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of repeats that are known already, dealt by document and 64 KB of it."""
    doc, tie, first, last = _touching(doc, tie, first, last)
    return mix(doc.view(U) + mix(tie.view(U) + (first >> 16).view(U))), last, doc, tie, first << 16 | 255


def _windows(data: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rank pairs of ``n`` windows each from ``first`` on, whose they are and how far from it."""
    of = np.repeat(np.arange(len(n)), n)
    on = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    p = first[of] + on
    return Sums(data).of(p, p + REACH), Sums(data, 1).of(p + length - REACH, p + length), of, on


def counted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The rank of every pick's block, once a batch."""
    for batch in batches:
        parts = [(gram, Sums(data, 1).of(ps, pe + length)) for _, ps, pe, gram, _, data, *_ in _picked(batch, length)]
        if parts:
            a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            none = np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[_firsts(a, b, none, none, none)[0]].view(np.int64))], names=["a"])


def blocked(batches: Iterator[pa.RecordBatch], length: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every pick with the pair of its and the block's rank."""

    def rows(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b, doc, tie, start, shape = (np.concatenate(x) for x in zip(*parts, strict=True))
        k, again = _firsts(a, b, doc, tie, start)
        yield _rows(a[k], b[k], doc[k], tie[k], start[k] << 16 | shape[k])
        yield _rows(*_known(doc[again], tie[again], start[again], start[again] + (shape[again] & 255)))

    for batch in batches:
        parts, held = [], 0
        for pick, ps, pe, gram, _, data, doc, tie, base in _picked(batch, length):
            shape = (pick - ps) << 8 | (pe - ps) | np.where(_among(gram, frequent), _FREQUENT, 0)
            parts.append((gram, Sums(data, 1).of(ps, pe + length), doc, tie, ps - base, shape))
            held += len(pick)
            if held > 1 << 19:
                yield from rows(parts)
                parts, held = [], 0
        if held:
            yield from rows(parts)


def parted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of (doc, tie, text, places of blocks): the blocks' parts, with the pair of the rank of 64 bytes and of the part, and their
    bytes; of frequent ranks the windows, without bytes."""
    for batch in batches:
        doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, at = buffers(batch.column(2))
        places = batch.column(3)
        of = np.repeat(np.arange(len(batch)), pc.list_value_length(places).to_numpy(zero_copy_only=False))
        place = places.flatten().to_numpy()
        begin = at[of] + (place >> 16)
        order = np.argsort(begin)
        of, place, begin = of[order], place[order], begin[order]
        some = list(stretches(at, length))
        parts, windows, held = [], [], 0
        for (a, z, *_), end in zip(some, [*(x[0] for x in some[1:]), int(at[-1])], strict=True):
            k = np.arange(*np.searchsorted(begin, (a, end)))
            if len(k):
                hot = (place[k] & _FREQUENT) > 0
                if hot.any():
                    h = k[hot]
                    ra, rb, own, on = _windows(data[a:z], begin[h] - a, (place[h] & 255) + 1, length)
                    windows.append((ra, rb, doc[of[h]][own], tie[of[h]][own], (place[h] >> 16)[own] + on))
                    held += len(own)
                k = k[~hot]
                first, last = begin[k] - a, begin[k] - a + (place[k] & 255)
                pick = first + (place[k] >> 8 & 127)
                edge = pick + REACH - length  # windows from here on have the 64 bytes from the pick on
                sums, others = Sums(data[a:z]), Sums(data[a:z], 1)
                for core, p, q in ((pick, np.maximum(first, edge), last), (pick - GRAM, first, np.minimum(last, edge - 1))):
                    x = p <= q
                    core, p, q, o = core[x], p[x], q[x], of[k[x]]
                    parts.append((sums.of(core, core + REACH), others.of(p, q + length), doc[o], tie[o], p + a - at[o], q - p, p + a))
                    held += len(p)
            if held > 1 << 18:
                yield from _parts(parts, windows, data, length)
                parts, windows, held = [], [], 0
        yield from _parts(parts, windows, data, length)


def _parts(parts: list[tuple], windows: list[tuple], data: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    def known(*columns: np.ndarray) -> pa.RecordBatch:
        rows = _known(*columns)
        return _rows(*rows, pa.nulls(len(rows[0]), pa.binary()))

    if parts:
        a, b, doc, tie, start, more, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        k, again = _firsts(a, b, doc, tie, start)
        for k in np.split(k, range(1 << 14, len(k), 1 << 14)):
            n = more[k] + length
            ends = np.cumsum(n)
            own = data[np.repeat(p[k] - ends + n, n) + np.arange(n.sum())]
            texts = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(own)])
            yield _rows(a[k], b[k], doc[k], tie[k], start[k] << 16 | more[k], texts)
        yield known(doc[again], tie[again], start[again], start[again] + more[again])
    if windows:
        a, b, doc, tie, start = (np.concatenate(x) for x in zip(*windows, strict=True))
        k, again = _firsts(a, b, doc, tie, start)
        yield _rows(a[k], b[k], doc[k], tie[k], start[k] << 16, pa.nulls(len(k), pa.binary()))
        yield known(doc[again], tie[again], start[again], start[again])


def _walked(batches: Iterator[pa.RecordBatch]):
    """Of rows sorted by rank pair and position, batch by batch: the numbers of the rows that are first of their pair, with
    their columns, and the starts of repeats."""
    pair = head = None  # the last rank pair and its first position
    for batch in batches:
        a, b, doc, tie, place = (batch.column(k).to_numpy() for k in range(5))
        more = place & 255
        done, k = np.flatnonzero(more == 255), np.flatnonzero(more != 255)
        repeats = [(doc[done], tie[done], place[done] >> 16, b[done])]
        if len(k):
            a, b, doc, tie, place, more = (x[k] for x in (a, b, doc, tie, place, more))
            start = place >> 16
            new = _new(a, b)
            new[0] = pair != (a[0], b[0])
            at = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
            of = [np.where(at < 0, head[i] if head else 0, x[np.maximum(at, 0)]) for i, x in enumerate((doc, tie, start))]
            again = ~new & ((doc != of[0]) | (tie != of[1]) | (start != of[2]))
            repeats.append((doc[again], tie[again], start[again], (start + more)[again]))
            pair, head = (a[-1], b[-1]), [x[-1] for x in of]
            k, a, b, doc, tie, place = (x[new] for x in (k, a, b, doc, tie, place))
        else:
            a, b, doc, tie, place = (x[:0] for x in (a, b, doc, tie, place))
        doc_, tie_, first, last = _touching(*(np.concatenate(x) for x in zip(*repeats, strict=True)))
        yield batch, k, a, b, doc, tie, place, _found(1, doc_, tie_, first << 32 | last - first)


def _groups(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each rank's rows begin, and how many they are."""
    at = np.flatnonzero(_new(a))
    return at, np.diff(np.append(at, len(a)))


def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 1 of sorted blocks, and kind 2: the first of each pair where its rank has several pairs, or is frequent."""
    held: tuple | None = None  # the last rank's block, as long as it is the only one
    several = None  # the last rank, if it has several
    for _, _, a, _, doc, tie, place, found in _walked(batches):
        yield found
        if held:
            a, doc, tie, place = (np.append(x, y) for x, y in zip(held, (a, doc, tie, place), strict=True))
        if not len(a):
            continue
        at, n = _groups(a)
        many = (n > 1) | (a[at] == several if several is not None else False)
        keep = np.repeat(many, n) | ((place & _FREQUENT) > 0)
        yield _found(2, doc[keep], tie[keep], place[keep])
        several = a[-1] if many[-1] else None
        held = None if keep[-1] else tuple(x[-1:] for x in (a, doc, tie, place))


def windowed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Kind 1 of sorted parts, and of the windows of ranks with several parts; where these are over ``GROUP``, kind 3, the windows."""

    def rows(doc: np.ndarray, tie: np.ndarray, place: np.ndarray, texts: pa.Array, whole: bool) -> Iterator[pa.RecordBatch]:
        parts, n = [], (place & 255) + 1
        for x in range(0, len(n), 2048):
            own, y = texts.slice(x, 2048), slice(x, x + 2048)
            at = np.append(0, np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False)))[:-1].astype(np.int64)
            data = np.frombuffer(b"".join(own.to_pylist()), np.uint8)
            a, b, of, on = _windows(data, at, n[y], length)
            parts.append((a, b, doc[y][of], tie[y][of], (place[y] >> 16)[of] + on))
        if parts:
            a, b, doc, tie, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            k, again = _firsts(a, b, doc, tie, start)
            doc_, tie_, first, last = _touching(doc[again], tie[again], start[again], start[again])
            yield _found(1, doc_, tie_, first << 32 | last - first)
            if not whole:
                yield _found(3, doc[k], tie[k], start[k] << 16, a[k], b[k])

    held: tuple | None = None  # the last rank's parts
    large = None  # the last rank, if its windows go on
    for batch, k, a, _, doc, tie, place, found in _walked(batches):
        yield found
        texts = batch.column(5).take(pa.array(k))
        if held:
            a, doc, tie, place = (np.append(x, y) for x, y in zip(held[:4], (a, doc, tie, place), strict=True))
            texts = pa.concat_arrays([held[4], texts])
        if not len(a):
            continue
        at, n = _groups(a)
        goes_on = (n > GROUP) | (a[at] == large if large is not None else False)
        several = (n > 1) & ~goes_on
        several[-1] = False
        for group, whole in ((several, True), (goes_on, False)):
            x = np.flatnonzero(np.repeat(group, n))
            yield from rows(doc[x], tie[x], place[x], texts.take(pa.array(x)), whole)
        large = a[-1] if goes_on[-1] else None
        held = None if goes_on[-1] else (*(x[at[-1] :] for x in (a, doc, tie, place)), texts.slice(at[-1]))
    if held and len(held[0]) > 1:
        yield from rows(*held[1:], True)


def _by_document(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc", "tie").agg(F.collect_set("span").alias("found"))


def starts_of_repeats(docs: DataFrame, length: int) -> DataFrame:
    """doc, tie and span: intervals of starts of strings that also start earlier, as kind 1.  ``docs`` is (doc, tie, text)."""
    spark = docs.sparkSession

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(*(F.expr(x) for x in by)).sortWithinPartitions("a", "b", "doc", "tie", "place")

    def of_kind(rows: DataFrame, kind: int) -> DataFrame:
        return rows.where(F.col("kind") == kind)

    sample = docs.where(F.pmod(F.xxhash64("doc", "tie"), F.lit(SAMPLE)) == 0).mapInArrow(lambda x: counted(x, length), "a long")
    often = sample.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "a").limit(HOTTEST).toArrow()
    frequent = spark.sparkContext.broadcast(np.sort(often["a"].to_numpy().view(U)))

    blocks = dealt(docs.mapInArrow(lambda x: blocked(x, length, frequent.value), _PLACED), "a", f"if(place & {_FREQUENT} = 0, 0, b)")
    one = cut(blocks.mapInArrow(ranked, _FOUND).select("kind", "doc", "tie", "span"), "repeats-32", at_once=True)
    left = docs.join(_by_document(of_kind(one, 2)), ["doc", "tie"]).select("doc", "tie", "text", "found")
    parts = cut(left.mapInArrow(lambda x: parted(x, length), f"{_PLACED}, part binary"), "repeats-parts", at_once=True)
    windows = "part is null and place & 255 = 0"
    two = cut(dealt(parts.where(f"not ({windows})"), "a").mapInArrow(lambda x: windowed(x, length), _FOUND), "repeats-64", at_once=True)
    singles = parts.where(windows).drop("part").unionByName(of_kind(two, 3).select("a", "b", "doc", "tie", F.col("span").alias("place")))
    three = cut(dealt(singles, "a", "b").mapInArrow(lambda x: (y[-1] for y in _walked(x)), _FOUND).select("kind", "doc", "tie", "span"), "repeats-100", at_once=True)
    drop(parts)
    return of_kind(one, 1).unionByName(of_kind(two, 1).select("kind", "doc", "tie", "span")).unionByName(three).select("doc", "tie", "span")


def removed_runs(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the strings that start in the intervals."""
    order = np.argsort(first, kind="stable")
    a, z = first[order], np.maximum.accumulate(last[order]) + length
    new = np.flatnonzero(np.concatenate(([True], a[1:] > z[:-1])))
    return a[new], z[np.concatenate((new[1:] - 1, [len(a) - 1]))]


def deduplicate(docs: DataFrame, doc_id: str | Column = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the bytes that stay."""
    if not REACH + GRAM - 1 <= length <= 2 * REACH:  # shorter windows may cover neither side of a pick, longer ones are not two reaches
        raise ValueError(f"length must be from {REACH + GRAM - 1} to {2 * REACH}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    once = rows.groupBy("doc").count().where("count > 1").isEmpty()
    rows = rows.withColumn("tie", F.lit(0).cast("long") if once else F.xxhash64("text"))
    joined = rows.join(_by_document(starts_of_repeats(rows.select("doc", "tie", "text"), length)), ["doc", "tie"], "left").select("doc_id", "text", "found")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(pc.binary_length(whole.column(1)).fill_null(0).to_numpy(zero_copy_only=False)) // (4 * RUN)
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(whole)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                yield _kept(whole.slice(x, y - x), length)

    return joined.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _kept(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    data, at = buffers(batch.column(1))
    out: list[tuple] = []
    for i in range(len(batch)):
        b = data[at[i] : at[i + 1]]
        kept, removed, spans = b, 0, 0
        if batch.column(2)[i].is_valid:
            span = batch.column(2)[i].values.to_numpy()
            a, z = removed_runs(span >> 32, (span >> 32) + (span & 0xFFFFFFFF), length)
            mask = np.ones(len(b), bool)
            for x, y in zip(a, z, strict=True):
                mask[x:y] = False
            kept, removed, spans = b[mask], int((z - a).sum()), len(a)
        kept = kept.tobytes()
        out.append((len(b), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
    columns = list(zip(*out, strict=True)) or [()] * 5
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
