"""Words and shingles of Arrow text columns as 64-bit hashes, many documents at a time.

Everything works on UTF-8 bytes.  A batch is walked in runs of whole documents of
about ``RUN`` bytes; a longer document is walked in pieces that end at a separator, so
working memory follows ``RUN`` (or the longest single word), not the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

RUN = 1 << 18
U = np.uint64

#: Space and the bytes 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII but digits and letters.
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; the last ones asked for are kept."""
    if n in _POWERS:
        return _POWERS[n]
    _POWERS.clear()
    up, down = np.full(n, _BASE, U), np.full(n, pow(_BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    _POWERS[n] = np.cumprod(up), np.cumprod(down)
    return _POWERS[n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def runs(at: np.ndarray, size: int = RUN):
    """(first, last) document numbers of runs of whole documents of about ``size`` bytes."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last
        first = last


def _hashed(b: np.ndarray, heads: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the words of ``b``; a word also ends where another document starts (heads)."""
    inside = ~gap[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[heads] = cut[-1] = cut[0] = True
    edge = np.flatnonzero(inside & (cut[:-1] | np.concatenate(([True], ~inside[:-1]))))
    end = np.flatnonzero(inside & (cut[1:] | np.concatenate((~inside[1:], [True])))) + 1
    size = 1 << max(18, int(len(b)).bit_length())
    up, down = powers(size)
    total = np.zeros(len(b) + 1, U)
    np.cumsum(BYTE[LOWER[b]] * up[: len(b)], out=total[1:])
    return mix((total[end] - total[edge]) * down[edge] + (end - edge).astype(U)), edge, end


def words(data: np.ndarray, at: np.ndarray, gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and ends of all words, and where each document's words start in them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none, np.zeros(len(at), np.int64)
    parts, first, n = [], 0, len(data)
    while first < n:
        last = min(n, first + RUN)
        while last < n and not gap[data[last - 1]]:  # back to a separator, or on to the next
            seps = np.flatnonzero(gap[data[first:last]])
            if len(seps):
                last = first + int(seps[-1]) + 1
            else:
                ahead = np.flatnonzero(gap[data[last : last + RUN]])
                last = last + int(ahead[0]) + 1 if len(ahead) else min(n, last + RUN)
        heads = at[np.searchsorted(at, first) : np.searchsorted(at, last)] - first
        h, s, e = _hashed(data[first:last], heads, gap)
        parts.append((h, s + first, e + first))
        first = last
    h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, s, e, np.searchsorted(s, at)


def shingled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive entries, one for each start."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(width):
        out = out * U(0x9DDFEA08EB382D69) + h[j : j + n]
    return mix(out + U(width))


def shingle_sets(column: pa.Array, width: int):
    """(row, sorted distinct shingle hashes) of each text; fewer words than ``width`` make one shingle, none none."""
    data, at = buffers(column)
    for first, last in runs(at):
        h, _, _, start = words(data[at[first] : at[last]], at[first : last + 1] - at[first])
        for i in range(last - first):
            own = h[start[i] : start[i + 1]]
            yield first + i, np.unique(shingled(own, min(width, len(own)))) if len(own) else own


def pieces(texts: list[str | None], size: int = RUN):
    """(rows, texts) of about ``size`` characters in all; a longer text is cut after a blank, or
    where it has none for that long, after ``size`` characters."""
    rows: list[int] = []
    some: list[str] = []
    total = 0
    for row, text in enumerate(texts):
        at, n = 0, len(text or "")
        while at < n:
            end = min(n, at + size)
            if end < n:
                end = max(text.rfind(" ", at, end), text.rfind("\n", at, end), at - 1) + 1
                end = end if end > at else at + size
            if total and total + end - at > size:
                yield rows, some
                rows, some, total = [], [], 0
            rows.append(row)
            some.append(text[at:end])
            total += end - at
            at = end
    if rows:
        yield rows, some


def codes(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, each followed by a newline, and where each text starts."""
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in some])))
    return np.frombuffer(("\n".join(some) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), at
