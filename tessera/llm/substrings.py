"""Substring dedup by compact windows.

Every text becomes its sequence of five-word shingles. For each of a few hash
functions a Cartesian tree over the hashes of the sequence groups all
subsequences of at least LENGTH shingles that share a minimum: a compact window,
named by the place of its minimum (all nodes that span LENGTH are found together).
Windows of different texts meet on the minimum and on the words next to it on one
side; within such a group every text is linked to one leader (the shortest), never
to all others, and the shingles of both decide exactly where a passage of LENGTH
shingles, alike from end to end, has a Jaccard similarity of 0.8. A leader takes a member's place only where
that passage covers it. Groups in which places stay open go on, taken members too:

* Exact repeats, in groups of any size: a run of LENGTH equal shingles has its
  minimum at the same place in both texts, so places meet again on runs of DEEP
  shingles around them, and where those lead to no passage on all runs of LENGTH.
* Repeats with an edit, in groups of any size: the shingles around each place tell
  which are alike there. Groups of more than TILE places are dealt into tiles, and
  every two tiles of a group meet in a task. Of groups that hold the same places one
  is enough. Pairs that connect all places alike are verified, one for each
  connection that is new, and of these the passages around such places are reported.

Where a shingle follows itself (one word over and over), its first and last place
stand for all.

Equal texts are one text; each copy is a row of its own that names it.
Defined results: null, empty and texts of under 50 words have no passage;
repeated rows are copies; an empty table gives no rows; extra columns play no
part. Words ignore ASCII case and punctuation; passages repeated within one text
alone are not reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import discard, kept, kept_at

from .common import Runs, binary, mixed, multipliers, shingle_hashes, word_hashes

WIDTH = 5
WORDS = 50
LENGTH = WORDS - WIDTH + 1
SIMILARITY = 0.8
#: Equal shingles that two passages of LENGTH must share for that similarity.
SHARED = int(np.ceil(2 * LENGTH * SIMILARITY / (1 + SIMILARITY)))
HASHES = 4
#: Shingles beside a minimum (every fourth of 12) that must agree on one side.
BESIDE = (4, 8, 12)
#: Places of a tile; a task compares the places of two tiles at a time.
TILE = 16_384
#: Places from which on those that may be alike are looked up instead of compared with all, and open places that are worth it.
INDEXED = 16_384
FEW = 64
#: Places compared at a time.
BLOCK = 4096
#: Places from which on those alike to no other are sorted out first, and the twos of equal shingles that others have: 41 shingles with five gaps have 35, less what an edit may shift.
MANY = 128
TWOS = 28
#: Shingles of the runs that stand for runs of LENGTH: each of these holds one of them at one of few places.
DEEP = 43
FACTORS = multipliers(HASHES, 7)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest of each run of width values: running ones of blocks, from both sides."""
    pick = np.minimum if least else np.maximum
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, x[-1], x.dtype)]).reshape(-1, width)
    upto, since = pick.accumulate(blocks, axis=1).ravel(), pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(since[: n - width + 1], upto[width - 1 : n])


def compact_windows(g: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places of the compact windows of texts laid end to end, ends[i] the end of the text that holds i.

    A node of a text's Cartesian tree spans length or more exactly if it is the
    minimum of some run of length values, so all nodes of all texts are found at once.
    Equal values are nodes each on its own.
    """
    n = len(g)
    if n < length:
        return np.zeros(0, np.int64)
    low = _sliding(g, length, True)
    low[np.arange(n - length + 1) + length > ends[: n - length + 1]] = 0  # runs that leave their text
    none = np.zeros(length - 1, g.dtype)
    return np.flatnonzero(_sliding(np.concatenate([none, low, none]), length, False) == g)


def _beside(h: np.ndarray, c: np.ndarray, side: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """32-bit hash of the shingles on one side of places c, 0 where their text ends before."""
    acc, inside = np.zeros(len(c), np.uint64), np.ones(len(c), bool)
    for step in BESIDE:
        at = c + side * step
        ok = (at >= starts[c]) & (at < ends[c])
        inside &= ok
        acc = mixed(acc + h[np.where(ok, at, 0)])
    return np.where(inside, (acc >> np.uint64(32)).astype(np.int64) - 2**31 | 1, 0).astype(np.int32)


def contexts(h: np.ndarray, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of a text and of its shingles up to LENGTH - 1 beside places c."""
    lo, hi = np.maximum(c - LENGTH + 1, starts[c]), np.minimum(c + LENGTH, ends[c])
    return mixed(Runs(h)(lo, hi) + (starts[c] * 4 * LENGTH * LENGTH + (c - lo) * 2 * LENGTH + hi - c).astype(np.uint64))


_NAMES = ["doc_id", "text_hash", "n", "k", "v", "c", "left", "right"]
#: Bytes of texts whose words and shingles are held in flat arrays at a time.
FLAT_BYTES = 1_000_000


def _pieces(b: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts (the last column) of pieces of a batch that hold about size bytes each."""
    held, at, total = [], 0, 0
    for i, text in enumerate(b.column(b.num_columns - 1)):
        held.append(text.as_py() or b"")
        total += len(held[-1])
        if total >= size:
            yield at, held
            held, at, total = [], i + 1, 0
    if held:
        yield at, held


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts, one after the other, and how many each text has; texts under WORDS words have none here."""
    words, counts = word_hashes(texts)
    counts_of = np.repeat(counts, counts)
    words = words[counts_of >= WORDS]
    sizes = np.where(counts >= WORDS, counts - WIDTH + 1, 0)
    if not len(words):
        return words, sizes
    # a shingle of the flat words belongs to a text if it starts WIDTH words before its end
    long = np.flatnonzero(sizes)
    return shingle_hashes(words, WIDTH)[np.arange(sizes.sum()) + np.repeat(np.arange(len(long)), sizes[long]) * (WIDTH - 1)], sizes


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kind = b.schema.types[0]
        for first, texts in _pieces(b, FLAT_BYTES):
            h, sizes = _shingles(texts)
            own = np.flatnonzero(sizes)
            if not len(own):
                continue
            sizes, rows = sizes[own], pa.array(own + first)
            docs, keys_of, n_of = b.column(0).take(rows), b.column(1).take(rows).to_numpy(), sizes.astype(np.int32)
            last = np.cumsum(sizes)
            text = np.repeat(np.arange(len(own)), sizes)
            starts, ends = (last - sizes)[text], last[text]
            zero = np.zeros(len(own), np.int32)
            cols = [docs, pa.array(keys_of), pa.array(n_of), pa.array(zero - 1), pa.array(zero.astype(np.int64)), *[pa.array(zero)] * 3]
            yield pa.RecordBatch.from_arrays(cols, names=_NAMES)
            for k, a in enumerate(FACTORS):
                c = compact_windows(h * a, ends)
                # of a shingle that follows itself, the first and the last place: where two texts share a passage they have one of these alike
                c = c[(c == starts[c]) | (c + 1 == ends[c]) | (h[c] != h[c - 1]) | (h[c] != h[np.minimum(c + 1, len(h) - 1)])]
                # where a text repeats itself, one of the places that look alike as far as a passage reaches
                c = np.sort(c[np.unique(contexts(h, c, starts, ends), return_index=True)[1]])
                at = text[c]
                cols = [
                    pa.nulls(len(c), kind), pa.array(keys_of[at]), pa.array(n_of[at]), pa.array(np.full(len(c), k, np.int32)), pa.array((h[c] * a).view(np.int64)),
                    pa.array((c - starts[c]).astype(np.int32)), pa.array(_beside(h, c, -1, starts, ends)), pa.array(_beside(h, c, 1, starts, ends)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=_NAMES)


def windows(docs: DataFrame) -> DataFrame:
    """One row (k = -1) per document long enough, one per compact window of each hash function."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), binary())
    return rows.mapInArrow(_windows, f"doc_id {kind}, text_hash long, n int, k int, v long, c int, left int, right int")


def index_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of x, x in order, and which of these are repeated."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    like = ranked[1:] == ranked[:-1]
    return order, ranked, np.r_[like, False] | np.r_[False, like]


def _stands(order: np.ndarray, ranked: np.ndarray, y: np.ndarray) -> bool:
    """Whether SHARED of the shingles y stand within some 2 * LENGTH of the indexed text, every occurrence counted."""
    lo, hi = np.searchsorted(ranked, y, "left"), np.searchsorted(ranked, y, "right")
    n = hi - lo
    of = np.repeat(np.arange(len(y)), n)
    zone = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)] // LENGTH
    both = np.unique(np.concatenate([zone, np.maximum(zone - 1, 0)]) * len(y) + np.concatenate([of, of]))
    return len(both) > 0 and int(np.bincount(both // len(y)).max()) >= SHARED


def passages(x: np.ndarray, y: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """[first, last) shingles of y that lie in passages near-equal to passages of x."""
    if len(x) < LENGTH or len(y) < LENGTH:
        return []
    order, ranked, repeated = index or index_of(x)
    at = np.minimum(np.searchsorted(ranked, y), len(x) - 1)
    place = order[at]
    same = x[place] == y
    if same.sum() < SHARED:
        return []
    # a repeated shingle of x may stand elsewhere: prefer the place that goes on from the one before
    follow = np.flatnonzero(same[1:] & (place[1:] != place[:-1] + 1) & repeated[at[1:]]) + 1
    for i in follow:
        j = place[i - 1] + 1
        if same[i - 1] and j < len(x) and x[j] == y[i]:
            place[i] = j
    total = np.r_[0, np.cumsum(same)]
    good = np.flatnonzero(total[LENGTH:] - total[:-LENGTH] >= SHARED)
    out: list[tuple[int, int]] = []
    for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else []:
        for s in dict.fromkeys((int(run[0]), int(run[len(run) // 2]), int(run[-1]))):
            px = place[s : s + LENGTH][same[s : s + LENGTH]]
            if (np.abs(px - np.median(px)) <= LENGTH).sum() >= SHARED or _stands(order, ranked, y[s : s + LENGTH]):
                inside = np.flatnonzero(same[run[0] : run[-1] + LENGTH]) + run[0]
                # what is alike must reach over WORDS words: the ends of a run of LENGTH may be unlike
                if inside[-1] - inside[0] + 1 >= LENGTH:
                    out.append((int(inside[0]), int(inside[-1]) + 1))
                break
    return out


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_hash, h): the shingle hashes of a text, cut to 32 bits."""
    for b in batches:
        for first, texts in _pieces(b, FLAT_BYTES):
            h, sizes = _shingles(texts)
            h, edges = (h >> np.uint64(32)).astype(np.uint32), np.r_[0, np.cumsum(sizes)]
            parts = pa.array([h[s:e].tobytes() for s, e in zip(edges, edges[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), parts], names=["text_hash", "h"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, index = None, None  # pairs of one leader mostly follow each other
    for b in batches:
        rows = []
        for leader, member, x, y, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4).to_pylist()):
            hx, hy = (np.frombuffer(t.as_buffer(), np.uint32) for t in (x, y))
            if leader != last:
                last, index = leader, index_of(hx)
            rows += [(leader, member, s, e + WIDTH - 1) for s, e in passages(hx, hy, index) if at is None or any(s <= c < e for c in at)]
        cols = list(zip(*rows)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["leader", "member", "start_word", "end_word"])


def _places(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[pa.Array]]]:
    """text_hash, shingle hashes and the fields of places of each row; places stay in Arrow columns, as Python objects they would take many times the room."""
    edges, places = b.column(2).offsets.to_numpy(), b.column(2).values
    fields = [places.field(i) for i in range(places.type.num_fields)]
    for row, key in enumerate(b.column(0).to_pylist()):
        at, n = edges[row], edges[row + 1] - edges[row]
        yield key, np.frombuffer(b.column(1)[row].as_buffer(), np.uint32), [f.slice(at, n) for f in fields]


_KEYED = ["key", "text_hash", "n", "c", "open"]


def _refined(how: str):
    """Rows (key, c, open, extra) of places under finer keys.

    deep: runs of DEEP shingles that hold the place, by STEP of their start (extra: what the run has before the place);
    whole: all runs of LENGTH among those of such a start.
    """
    step = LENGTH - DEEP + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, h, (_, c, open_, extra) in _places(b):
                c, before, n = c.to_numpy(), extra.to_numpy(), len(h)
                if how == "deep":  # a place has come under several keys, which play no part here
                    c, at = np.unique(c, return_inverse=True)
                    free = np.zeros(len(c), bool)
                    free[at[open_.to_numpy(zero_copy_only=False)]] = True
                    open_ = pa.array(free)
                rows = np.arange(len(c))
                runs, key, at, extra = Runs(h), [], [], []
                wide = DEEP if how == "deep" else LENGTH
                for a in (*range(0, DEEP - 1, step), DEEP - 1) if how == "deep" else range(step):
                    start = c - a if how == "deep" else c - before - a
                    fits = rows[(start >= 0) & (start + wide <= n) & (start <= c) & (start + wide > c)]
                    key.append(runs(start[fits], start[fits] + wide) + np.uint64(a if how == "deep" else 0))
                    at.append(fits)
                    extra.append(np.full(len(fits), a, np.int32))
                at, m = np.concatenate(at), sum(map(len, at))
                cols = [np.concatenate(key).view(np.int64), np.full(m, text), np.full(m, n, np.int32), c[at]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), open_.take(pa.array(at)), pa.array(np.concatenate(extra))], names=[*_KEYED, "extra"])

    return run


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile, text_hash, n, open, c, near): 16-bit hashes of the shingles up to LENGTH - 1 beside each place, 0 past an end."""
    reach = LENGTH - 1
    for b in batches:
        for key, h, (tile, c, open_, _) in _places(b):
            codes = np.zeros(len(h) + 2 * reach, np.uint16)
            codes[reach : reach + len(h)] = np.maximum(h >> np.uint32(16), np.uint32(1))
            spans = np.lib.stride_tricks.sliding_window_view(codes, 2 * reach + 1)
            for at in range(0, len(c), 5000):
                m = min(5000, len(c) - at)
                near = np.ascontiguousarray(spans[c.slice(at, m).to_numpy()])
                ends = np.arange(m + 1, dtype=np.int32) * (near.shape[1] * 2)
                data = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(ends), pa.py_buffer(near)])
                cols = [tile.slice(at, m), pa.array(np.full(m, key, np.int64)), pa.array(np.full(m, len(h), np.int32)), open_.slice(at, m), c.slice(at, m), data]
                yield pa.RecordBatch.from_arrays(cols, names=["tile", "text_hash", "n", "open", "c", "near"])


class Near:
    """Members (columns of near) by the shingle at each offset from the place."""

    def __init__(self, near: np.ndarray):
        self.order = [np.argsort(row, kind="stable").astype(np.int32) for row in near]
        self.ranked = [row[order] for row, order in zip(near, self.order)]

    def may(self, x: np.ndarray) -> np.ndarray:
        """Members that can share SHARED shingles of some LENGTH with x: of any few more than may differ in those, one is shared.

        Every run of LENGTH offsets is asked for its rarest ones.
        """
        spans, n = [], np.zeros(len(x), np.int64)
        for j, ranked in enumerate(self.ranked):
            codes = np.unique(x[max(j - 1, 0) : j + 2])
            codes = codes[codes > 0]
            spans.append(list(zip(np.searchsorted(ranked, codes), np.searchsorted(ranked, codes, "right"))))
            n[j] = sum(e - s for s, e in spans[-1])
        need, runs, out = np.full(len(x) - LENGTH + 1, LENGTH - SHARED + 1), len(x) - LENGTH, []
        for j in np.argsort(n, kind="stable"):
            of = need[max(j - LENGTH + 1, 0) : min(j, runs) + 1]
            if (of > 0).any():
                of -= 1
                out += [self.order[j][s:e] for s, e in spans[j]]
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int32)


def _like(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Columns of near that share SHARED shingles with x in some LENGTH of them around the place, the alike ones reaching over LENGTH.

    Where SHARED of LENGTH are equal, a word put in or left out moves the rest by one place at most.
    """
    x = x[:, None]
    same = near == x
    same[1:] |= near[1:] == x[:-1]
    same[:-1] |= near[:-1] == x[1:]
    if not x.all():
        same &= near != 0
    may = np.flatnonzero(same.view(np.uint8).sum(0, dtype=np.uint8) >= SHARED)
    if not len(may):
        return may
    same = same[:, may]
    total = np.concatenate([np.zeros((1, len(may)), np.int8), np.cumsum(same.view(np.int8), axis=0, dtype=np.int8)])
    good = total[LENGTH:] - total[:-LENGTH] >= SHARED
    # as passages() has it: in a run of such spans, one begins with a shared shingle, and that one or a later one ends with one
    at = np.arange(len(good), dtype=np.int8)[:, None]
    begun = np.maximum.accumulate(np.where(good & same[: len(good)], at, np.int8(-1)), axis=0)
    broken = np.maximum.accumulate(np.where(good, np.int8(-1), at), axis=0)
    return may[(good & same[LENGTH - 1 :] & (begun > broken)).any(0)]


def lone(near: np.ndarray) -> np.ndarray:
    """Columns of near that are alike to no other one for certain.

    Of SHARED equal shingles of LENGTH most stand two and two: too few of a column's twos stand within one place in any others.
    """
    twos = np.where((near[:-1] > 0) & (near[1:] > 0), near[:-1].astype(np.uint32) << np.uint32(16) | near[1:], np.uint32(0))
    hit = np.zeros(twos.shape, bool)
    for j, row in enumerate(twos):
        ranked = np.sort(row)
        for k in range(max(j - 1, 0), min(j + 2, len(twos))):
            at = np.searchsorted(ranked, twos[k])
            # in its own row each one finds itself
            at = np.minimum(at + (k == j), len(ranked) - 1)
            hit[k] |= ranked[at] == twos[k] if k != j else (ranked[at] == twos[k]) & (at > 0)
    hit &= twos > 0
    total = np.concatenate([np.zeros((1, hit.shape[1]), np.int8), np.cumsum(hit.view(np.int8), axis=0, dtype=np.int8)])
    ranked = np.sort(near, axis=0)
    return ((total[LENGTH - 1 :] - total[: 1 - LENGTH]).max(0) < TWOS) & ~((ranked[1:] == ranked[:-1]) & (ranked[1:] > 0)).any(0)


def alike(near: np.ndarray, i: int, index: Near | None = None) -> np.ndarray:
    """Members (columns of near) alike to member i, itself included; with an index only those that it finds are compared."""
    if index is None:
        return _like(near[:, i], near)
    some = index.may(near[:, i])
    return some[_like(near[:, i], near[:, some])]


def joined(key: np.ndarray, n: np.ndarray, open_: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (rows of near) that connect all that are connected by places alike; closed places are connected as they come.

    One pair for each connection that is new: as many as there are open places, at most.
    """
    # in the order of their texts' sizes, closed ones first; of places whose surroundings are equal the first one stands for all
    order = np.lexsort((key, n, open_))
    code = (near.astype(np.uint64) * multipliers(near.shape[1], 11)).sum(1, dtype=np.uint64)
    first, of = np.unique(code[order], return_index=True, return_inverse=True)[1:]
    of = first[of]
    equal = np.flatnonzero(open_[order] & (of != np.arange(len(order))) & (key[order] != key[order[of]]))
    yield order[of[equal]], order[equal]
    order = order[np.sort(first)]
    key, closed = key[order], int((~open_[order]).sum())
    codes = np.ascontiguousarray(near[order].T)
    if len(order) >= MANY:
        some = ~lone(codes)
        order, key, codes, closed = order[some], key[some], np.ascontiguousarray(codes[:, some]), int(some[:closed].sum())
    rank = np.argsort(np.lexsort((key, n[order])))
    of, count = np.maximum(np.arange(len(order)) - closed + 1, 0), len(order)
    led, taken = np.zeros(count, bool), np.arange(count) < closed

    def meet(i: int, took: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins what i is alike to; a pair with the shortest of each part that this joins."""
        pick = took[key[took] != key[i]]
        pick = pick[np.argsort(rank[pick])]
        pick = pick[np.unique(of[pick], return_index=True)[1]]
        met = np.zeros(count + 1, bool)
        met[of[took]] = True
        of[met[of]] = of[i]
        return np.full(len(pick), order[i]), order[pick]

    def among(i: int, some: np.ndarray) -> np.ndarray:
        """Those of some places that i is alike to; of closed ones, all of one part, those of the first block with any."""
        if index is not None and len(some) >= INDEXED:
            some = np.intersect1d(some, index.may(codes[:, i]), assume_unique=True)
        out, shut = [some[:0]], int(np.searchsorted(some, closed))
        for at in (*range(0, shut, BLOCK), *range(shut, len(some), BLOCK)):
            if at >= shut or not len(out[-1]):
                block = some[at : min(at + BLOCK, shut) if at < shut else at + BLOCK]
                out.append(block[_like(codes[:, i], codes[:, block[0] : block[-1] + 1] if block[-1] - block[0] < len(block) else codes[:, block])])
        return np.concatenate(out)

    # the shortest place leads and takes all it is alike to, until none is left
    index = Near(codes) if count >= INDEXED and count - closed >= FEW else None
    for i in range(closed, count):
        if not taken[i]:
            led[i] = True
            took = among(i, np.flatnonzero(~led))
            if len(took):
                taken[took] = True
                yield meet(i, took)
    # leaders have met all; those that different ones took may be alike too
    taken &= ~led
    for i in np.flatnonzero(taken[closed:]) + closed:
        some = np.flatnonzero(taken & (of != of[i]))
        took = among(i, some[(some < closed) | (some > i)])
        if len(took):
            yield meet(i, took)


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile. (leader, text_hash, c) of the pairs that connect the places of each; the shorter text of a pair leads."""

    def solve(tile: np.ndarray, key: np.ndarray, n: np.ndarray, open_: np.ndarray, c: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        out = [np.zeros((2, 0), np.int64)]
        edges = np.r_[np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]), len(tile)]
        for s, e in zip(edges[:-1], edges[1:]):
            if open_[s:e].any() and key[s:e].min() != key[s:e].max():
                out += [np.stack(pair) + s for pair in joined(key[s:e], n[s:e], open_[s:e], near[s:e])]
        a, b = np.concatenate(out, axis=1)
        swap = (n[a] > n[b]) | (n[a] == n[b]) & (key[a] > key[b])
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b]), pa.array(c[b])], names=["leader", "text_hash", "c"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        near = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint16).reshape(b.num_rows, -1)
        new = [*[b.column(i).to_numpy(zero_copy_only=False) for i in range(5)], near]
        rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield solve(*[x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None:
        yield solve(*held)


def linked(docs: DataFrame, wins: DataFrame, used: str | None = None) -> DataFrame:
    """(leader, member, start_word, end_word) between text hashes; used: a scratch table, deleted once wins is read to the end."""
    # tables with one row per key are hashed, so that the long side needs no sort
    spark = docs.sparkSession
    # seen twice, be it in one text; written, so that the join shuffles both sides for itself and skewed keys can be split
    repeated = kept(wins.groupBy("v").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("v"), "substring-repeated")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("beside")), F.struct(F.lit(1).alias("side"), F.col("right").alias("beside"))))
    members = wins.join(repeated.hint("shuffle_hash"), "v").select("v", "k", "text_hash", "n", "c", sides.alias("s")).where("s.beside != 0")
    members, at = kept_at(members.select(F.xxhash64("v", "s.side", "s.beside").alias("key"), "text_hash", "n", "c", (F.col("k") == 0).alias("first")), "substring-groups")
    if used:
        discard(spark, used)
    # only texts with members are read again: by then few enough for their hashes to be written
    wanted = kept(members.select("text_hash").distinct(), "substring-wanted")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), binary()).join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    texts = kept(texts.mapInArrow(_shingled, "text_hash long, h binary"), "substring-texts")

    def led_by(rows: DataFrame, *own: Column) -> DataFrame:
        """Rows of groups of several texts with their group's leader, the shortest text; own: further aggregates."""
        least = F.min(F.struct("n", "text_hash")).alias("_first")
        first = rows.groupBy("key").agg(least, F.max("text_hash").alias("_hi"), F.min("text_hash").alias("_lo"), *own).where("_lo != _hi")
        first = kept(first.drop("_hi", "_lo").withColumn("leader", F.col("_first.text_hash")).drop("_first"), "substring-leaders")
        return rows.join(first.hint("shuffle_hash"), "key")

    def verified(pairs: DataFrame, known: DataFrame | None = None, place: str | None = None) -> DataFrame:
        """Passages of distinct pairs (leader, text_hash) that are not among the known ones, and those of these; place: only passages that hold such a place of the pair."""
        pairs = pairs.withColumnRenamed("text_hash", "member").where("leader != member")
        pairs = pairs.groupBy("leader", "member").agg(F.collect_set(place).alias("at")) if place else pairs.select("leader", "member", F.lit(None).cast("array<int>").alias("at")).distinct()
        if known is not None:
            pairs = pairs.join(known.select("leader", "member").distinct(), ["leader", "member"], "left_anti")
        pairs = kept(pairs, "substring-pairs")
        # sorted by the leader, whose index then serves all its members
        both = pairs.join(texts.select(F.col("text_hash").alias("member"), F.col("h").alias("_y")), "member")
        both = both.join(texts.select(F.col("text_hash").alias("leader"), F.col("h").alias("_x")), "leader")
        found = kept(both.select("leader", "member", "_x", "_y", "at").mapInArrow(_verified, "leader long, member long, start_word int, end_word int"), "substring-found")
        return found if known is None else known.union(found)

    def opened(led: DataFrame, found: DataFrame, *cols: str) -> DataFrame:
        """led without its leaders' rows; open: no passage with the leader covers the place."""
        spans = found.groupBy("leader", F.col("member").alias("text_hash")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"))
        taken = F.exists("_spans", lambda x: (x["start_word"] <= F.col("c")) & (F.col("c") + WIDTH <= x["end_word"]))
        rest = led.where("text_hash != leader").join(spans.hint("shuffle_hash"), ["leader", "text_hash"], "left")
        return rest.select("key", "text_hash", "n", "c", (~F.coalesce(taken, F.lit(False))).alias("open"), *cols)

    def refined(rows: DataFrame, how: str) -> DataFrame:
        places = rows.groupBy("text_hash").agg(F.collect_list(F.struct("key", "c", "open", "extra")).alias("places"))
        return places.join(texts, "text_hash").select("text_hash", "h", "places").mapInArrow(_refined(how), "key long, text_hash long, n int, c int, open boolean, extra int")

    def unsettled(rows: DataFrame) -> DataFrame:
        """(key, _n, _a, _b) of groups of several texts with an open place; groups that hold the same places agree in _n, _a and _b."""
        same = [F.bit_xor(F.xxhash64(*at)).alias(name) for name, at in (("_a", ("text_hash", "c")), ("_b", ("c", "text_hash")))]
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), *same, F.bool_or("open").alias("_open"), F.min("text_hash").alias("_lo"), F.max("text_hash").alias("_hi"))
        return kept(sizes.where("_open and _lo != _hi").select("key", "_n", "_a", "_b"), "substring-sizes")

    led, led_at = kept_at(led_by(members), "substring-led")
    discard(spark, at)
    found = verified(led)
    # members that a leader took stay in their groups, for those that are alike to them but not to the leader
    rest = kept(opened(led, found, "first"), "substring-rest")
    discard(spark, led_at)
    sizes = unsettled(rest)
    rest = kept(rest.join(sizes.select("key", "_n"), "key").withColumn("extra", F.lit(0)), "substring-open")

    # exact repeats: a run of LENGTH shingles holds its least one by the first function, and one of the deep runs around it
    opens = F.min(F.struct("n", "text_hash", (~F.col("open")).alias("closed"))).alias("_least")
    ask = F.col("open") | ~F.col("_least.closed")
    deep = kept(refined(rest.where("first"), "deep"), "substring-deep")
    deep = kept(led_by(deep, opens, F.bool_or("open").alias("_any")).where("_any"), "substring-deep-led")
    found = verified(deep.where(ask), found)
    # what is left agrees on DEEP shingles but not on LENGTH with its leader: all runs of LENGTH, of which equal ones are passages
    left = opened(deep.where(ask), found, "extra").where("open")
    left = kept(deep.join(left.select("key").distinct(), "key", "left_semi").select("key", "text_hash", "n", "c", "open", "extra"), "substring-left")
    found = verified(led_by(kept(refined(left, "whole").dropDuplicates(["key", "text_hash"]), "substring-whole-runs")), found)

    # repeats with an edit: places are compared with the leaders among them, those of groups over TILE for every two tiles
    sole = sizes.groupBy("_n", "_a", "_b").agg(F.min("key").alias("key")).select("key")
    tiles = F.ceil(F.col("_n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("text_hash", "c"), tiles).cast("int")
    other = F.explode(F.filter(F.sequence(F.lit(0), tiles - 1), lambda x: (x != own) | (tiles == 1)))
    near = rest.join(sole, "key", "left_semi").select("key", "text_hash", "c", "open", own.alias("_own"), other.alias("_other"))
    near = near.withColumn("key", F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")))
    places = near.groupBy("text_hash").agg(F.collect_list(F.struct("key", "c", "open", F.lit(0).alias("extra"))).alias("places"))
    near = places.join(texts, "text_hash").select("text_hash", "h", "places").mapInArrow(_around, "tile long, text_hash long, n int, open boolean, c int, near binary")
    pairs = near.repartition("tile").sortWithinPartitions("tile").mapInArrow(_led, "leader long, text_hash long, c int")
    return verified(pairs, found, "c").distinct()


def op7_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, kind, start_word, end_word: passages (or whole copies) that keep_id holds too."""
    rows, path = kept_at(windows(docs), "substring-windows")
    whole = kept(rows.where("k = -1").select("doc_id", "text_hash", "n"), "substring-whole")
    names = kept(whole.groupBy("text_hash").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("_m")), "substring-names")
    found = linked(docs, rows.where("k >= 0"), path)
    pairs = found.join(names.select(F.col("text_hash").alias("member"), F.col("name").alias("doc_id")), "member")
    pairs = pairs.join(names.select(F.col("text_hash").alias("leader"), F.col("name").alias("keep_id")), "leader")
    pairs = pairs.select("doc_id", "keep_id", F.lit("passage").alias("kind"), "start_word", "end_word")
    copies = whole.join(names.where("_m > 1"), "text_hash").where("doc_id != name")
    copies = copies.select("doc_id", F.col("name").alias("keep_id"), F.lit("copy").alias("kind"), F.lit(0).alias("start_word"), (F.col("n") + WIDTH - 1).cast("int").alias("end_word"))
    return pairs.unionByName(copies)
