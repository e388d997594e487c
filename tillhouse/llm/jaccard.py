"""Similarity join of word 5-gram sets by chosen paths, with classes of similar documents.

Method: documents with the same set of shingles are one node. In each run a node follows
the shingles of its set whose hash falls below 1 / (threshold * size): similar sets choose a
common one with a chance of 1 - 1/e at least, whatever their sizes. A bucket of nodes that
chose the same shingle is compared by brute force if it is small. A large one is split again by
shingles outside of what most of its members have in common: a line or a passage of many unlike
texts. Members that consist of little else stay together, in one bucket for all that have this
in common, and cliques are taken out of it. Runs repeat until the target recall.

A clique is a centre, any set, with the nodes that differ from it in no more shingles than a
share of their own size. That share is such that every two of them are similar by the triangle
inequality, so their links are counted, not compared. What is left of a large bucket is
compared in blocks, with itself and with the largest clique in it.

Buckets are compared twice. First by sketches, the parities of the shingles that fall on each
of about as many bits as there are shingles: bits that differ never outnumber the shingles that
do, so no similar pair is lost, and only where one may be do the whole sets go.

Pairs never leave the task that compares them: a pair that meets in several buckets counts
in the first of them, each node adds up its links, and of each bucket only a spanning star
of every group goes on to the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillhouse.llm.common import (
    ROW, grouped, slices, small, small_batches, small_lists, stored, text_bytes, types, whole_groups, whole_row,
)
from tillhouse.llm.graph import components
from tillhouse.llm.words import BY_SPACE, grams, mixed, words
from tillhouse.operators.skew import row_count

WORDS = 5
THRESHOLD = 0.8
# Chance that a pair just at the threshold is found when its buckets are split SPLITS times.
RECALL = 0.998
SPLITS = 2
# Nodes compared at once; larger buckets are split, then compared block by block.
BUCKET = 1000
# Sets that one task of the comparison reads, about.
PLACE_ROWS_PER_TASK = 20_000
# Centres tried for the nodes of one place, and sets that a centre is the majority of. Whatever
# the centres are, the result is the same: what is in no clique is compared.
CENTRES, VOTERS = 16, 63
# Share of the threshold up to which a set may lie in what its bucket has in common and still be split.
COMMON = 7 / 8
# Entries of the common parts of all buckets that are split at once, about; a part may be any set.
COMMON_ENTRIES = 500_000
# Room for rounding in comparisons that only leave pairs out.
SLACK = 1e-6

_TOKEN_BYTES = 6
_ALL = 1 << 64


def runs_for(recall: float, splits: int) -> int:
    """Runs that reach ``recall`` at the threshold: survival of a shared path over the levels.

    These are the first path and one more per split.
    """
    survives = 1.0
    for _ in range(splits + 1):
        survives = 1 - math.exp(-survives)
    return math.ceil(math.log(1 - recall) / math.log(1 - survives))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of all texts in a row, sorted in each, and where each starts.

    A text of one to four words has a single shingle of all of them.
    """
    found = words(*text_bytes(texts), BY_SPACE)
    counts, left = found.counts, found.left
    of_word = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = [(of_word << np.uint64(48) | grams(found.hash, WORDS) >> np.uint64(16))[left >= WORDS]]
    for n in range(1, WORDS):
        short = found.first[:-1][counts == n]
        if len(short):
            keys.append(of_word[short] << np.uint64(48) | grams(found.hash, n, seed=n)[short] >> np.uint64(16))
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    first = np.searchsorted(key, np.arange(len(counts) + 1, dtype=np.uint64) << np.uint64(48))
    return key & np.uint64((1 << 48) - 1), first


def nodes_of(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 128-bit name of each set; the empty set has zeros."""
    names = np.zeros((len(first) - 1, 2), np.uint64)
    for at, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens ^ np.uint64(salt)))])
        names[:, at] = mixed(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))
    names[np.diff(first) == 0] = 0
    return names


def chosen(tokens: np.ndarray, limits: np.ndarray, path: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens followed from ``path``, and the path each leads to."""
    drawn = mixed(tokens ^ path)
    at = np.flatnonzero(drawn < limits)
    return at, mixed(drawn[at] + np.uint64(0x9E3779B97F4A7C15))


def limits_of(sizes: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(_ALL / (threshold * np.maximum(sizes, 1)), float(_ALL - 2048)).astype(np.uint64)


def sketches(tokens: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Of each set, on how many of its tokens each bit falls, modulo 2; a power of 2 of bits, 64 at least."""
    sizes = np.diff(first)
    bits = np.array([max(64, 1 << int(n - 1).bit_length()) if n else 64 for n in sizes.tolist()], np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(bits)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bit = (mixed(tokens ^ np.uint64(0x2545F4914F6CDD1D)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(starts[owner] + bit, minlength=int(starts[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a >> 3 : b >> 3] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Values as a list per owner 0..n-1; ``owner`` ascends."""
    ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _first_paths(runs: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mixed(np.arange(1, runs + 1, dtype=np.uint64))
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, first = shingles(part.column(2))
                sizes = np.diff(first)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                limits = limits_of(sizes, threshold)[owner]
                at, paths = zip(*(chosen(tokens, limits, seed) for seed in seeds))
                at, paths = np.concatenate(at), np.concatenate(paths)
                order = np.argsort(owner[at], kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        _binary(nodes_of(tokens, first)),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(sketches(tokens, first), pa.binary()),
                        _lists(paths[order], owner[at][order], len(sizes)),
                    ],
                    names=["doc_id", "_text_key", "node", "n_shingles", "sketch", "paths"],
                )

    return run


def _given_nodes(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Rows whose text has the node they were joined for, with their shingles."""
    tokens, first = shingles(part.column(0))
    names = nodes_of(tokens, first)
    for i, node in enumerate(part.column(1)):
        if names[i].tobytes() == node.as_py():
            yield i, tokens[first[i] : first[i + 1]]


def common_shares(threshold: float) -> tuple[float, float]:
    """Shares of a set in the common part below which it is split, and from which on it stays.

    Both hold between the two. Of two similar sets either both are split or both stay: if one has
    the share ``split`` or more, the other has ``stay`` at least, the worst cases being that one
    set holds the other.
    """
    split = COMMON * threshold
    return split, min(threshold * split, (split - (1 - threshold)) / threshold)


def outside(tokens: np.ndarray, common: np.ndarray, threshold: float) -> tuple[np.ndarray, np.uint64, float]:
    """The tokens not in ``common``, the limit at which they are followed, and the share that is in it.

    A similar set has ``threshold * len(tokens)`` of the tokens at least, so that number less the
    common ones outside: two similar sets choose one of these with a chance of 1 - 1/e, as before.
    """
    held = np.isin(tokens, common, assume_unique=True)
    shared = max(threshold * len(tokens) - held.sum(), 1.0)
    return tokens[~held], np.uint64(min(_ALL / shared, float(_ALL - 2048))), held.sum() / len(tokens)


def _voters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per path and node that votes on what the bucket of the path has in common."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [(p, part.column(1)[i].as_py(), _packed(tokens)) for i, tokens in _given_nodes(part) for p in part.column(2)[i].as_py()]
            paths, nodes, packed = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.int64()), pa.array(nodes, pa.binary()), pa.array(packed, pa.binary())],
                names=["path", "node", "tokens"],
            )


def _in_common(most: int, split: int):
    """What more than half of the voters of a path hold, ``most`` tokens of it, and the path of those that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "path"):
            sets = _unpacked(_named_once(rows))
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            tokens, counts = tokens[2 * counts > len(sets)], counts[2 * counts > len(sets)]
            tokens = np.sort(tokens[np.lexsort((tokens, -counts))[:most]])
            name = nodes_of(tokens, np.array([0, len(tokens)]))[0, 0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows.column("path")[0].as_py()], pa.int64()),
                    pa.array([tokens.view(np.int64).tolist()], pa.list_(pa.int64())),
                    pa.array(mixed(np.array([name ^ np.uint64(split + 1)])).view(np.int64)),
                ],
                names=["path", "common", "stay"],
            )

    return run


def _split(threshold: float):
    """For each node and bucket to be split, the paths on which it goes on, and that on which it stays."""
    split, stay = common_shares(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, sizes, children, stays = [], [], [], []
                for i, tokens in _given_nodes(part):
                    parent, common, staying = (part.column(c)[i].as_py() for c in (2, 3, 4))
                    rest, limit, share = outside(tokens, np.array(common or [], np.int64).view(np.uint64), threshold)
                    paths = []
                    if share < split:
                        paths += chosen(rest, limit, np.int64(parent).view(np.uint64))[1].view(np.int64).tolist()
                    stays += [False] * len(paths)
                    if share >= stay and staying is not None:
                        paths.append(staying)
                        stays.append(True)
                    nodes += [part.column(1)[i].as_py()] * len(paths)
                    sizes += [len(tokens)] * len(paths)
                    children += paths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(children, pa.int64()), pa.array(stays, pa.bool_())],
                    names=["node", "size", "path", "stays"],
                )

    return run


def _packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_TOKEN_BYTES].tobytes()


def _unpacked(rows: pa.Table) -> list[np.ndarray]:
    sets = []
    for packed in rows.column("tokens").to_pylist():
        wide = np.zeros((len(packed) // _TOKEN_BYTES, 8), np.uint8)
        wide[:, :_TOKEN_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, _TOKEN_BYTES)
        sets.append(wide.view("<u8").ravel())
    return sets


def _named_once(rows: pa.Table) -> pa.Table:
    """Each node once, since a repeated row brings its node again; in order of name, as in every other task."""
    at: dict[bytes, int] = {}
    for i, name in enumerate(rows.column("node").to_pylist()):
        at.setdefault(name, i)
    return rows.take(pa.array([at[name] for name in sorted(at)]))


SET_SQL = "place bigint, node binary, tokens binary"


def _sets_at_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per node with its set, for the one place it is sent to."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [(part.column(2)[i].as_py(), part.column(1)[i].as_py(), _packed(tokens)) for i, tokens in _given_nodes(part)]
            places, nodes, packed = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int64()), pa.array(nodes, pa.binary()), pa.array(packed, pa.binary())],
                names=["place", "node", "tokens"],
            )


def centred(sets: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Centres, and the positions of the sets near each; every two sets near one centre are similar.

    With ``d`` tokens not in common and sizes ``m`` and ``n``, two sets are similar if and only if
    ``(1 + threshold) * d <= (1 - threshold) * (m + n)``. For sets near a centre each half holds
    of the way by the centre.
    """
    left = np.arange(len(sets))
    for _ in range(CENTRES):
        if len(left) < 2:
            return
        sizes = np.array([len(sets[i]) for i in left])
        every = np.concatenate([sets[i] for i in left])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        tokens, counts = np.unique(np.concatenate([sets[i] for i in left[:VOTERS]]), return_counts=True)
        for centre in (tokens[2 * counts > min(len(left), VOTERS)], sets[left[0]]):
            if not len(centre):
                continue
            held = centre[np.minimum(np.searchsorted(centre, every), len(centre) - 1)] == every
            apart = sizes + len(centre) - 2 * np.add.reduceat(held.astype(np.int64), starts)
            near = (1 + threshold) * apart <= (1 - threshold) * sizes
            if near.sum() > 1:
                yield centre, left[near]
                left = left[~near]
                break
        else:
            left = left[1:]


def _in_cliques(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "place"):
            rows = _named_once(rows)
            names, sets = rows.column("node").to_pylist(), _unpacked(rows)
            nodes, cliques = [], []
            for centre, near in centred(sets, threshold):
                nodes += [names[i] for i in near]
                cliques += [nodes_of(centre, np.array([0, len(centre)]))[0].tobytes()] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(cliques, pa.binary())], names=["node", "clique"])

    return run


class Sketches:
    """Sketches of rows, by their number of 64-bit words; longer ones fold to shorter ones."""

    def __init__(self, packed: list[bytes], threshold: float):
        self.level = np.array([(len(x) >> 3).bit_length() - 1 for x in packed])
        self.folds = math.ceil(math.log2(1 / threshold))  # between the sketches of two sizes that allow a link
        self.packed, self.folded = packed, {}

    def _at(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each row is, and the sketches of this level, with longer ones folded to it."""
        if level not in self.folded:
            where, parts, n = np.full(len(self.packed), -1), [], 0
            for fold in range(self.folds + 1):
                at = np.flatnonzero(self.level == level + fold)
                held = np.frombuffer(b"".join(self.packed[i] for i in at), "<u8").reshape(len(at), 1 << fold, 1 << level)
                parts.append(np.bitwise_xor.reduce(held, 1))
                where[at] = n + np.arange(len(at))
                n += len(at)
            self.folded[level] = where, np.concatenate(parts)
        return self.folded[level]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At least so many tokens are in one set only; ``b`` are the larger sets, of sizes that allow a link."""
        out = np.zeros(len(a), np.int64)
        for level in np.unique(self.level[a]).tolist():
            where, held = self._at(level)
            pairs, step = np.flatnonzero(self.level[a] == level), max(1, (1 << 19) >> level)
            for low in range(0, len(pairs), step):
                part = pairs[low : low + step]
                out[part] = np.bitwise_count(held[where[a[part]]] ^ held[where[b[part]]]).sum(1, dtype=np.int64)
        return out


def _own_paths(rows: pa.Table) -> list[np.ndarray]:
    lists = rows.column("_own").combine_chunks()
    return np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])


def _padded(own: list[np.ndarray]) -> np.ndarray:
    paths = np.full((len(own), max(map(len, own))), np.iinfo(np.int64).max)
    for i, o in enumerate(own):
        paths[i, : len(o)] = o
    return paths


def counted(paths: np.ndarray, a: np.ndarray, b: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether a pair counts ``here``: at the least path its two rows share."""
    out = np.zeros(len(a), bool)
    for low in range(0, len(a), 1 << 12):
        at = slice(low, low + (1 << 12))
        x, y = paths[a[at]], paths[b[at]]
        both = (x[:, :, None] == y[:, None, :]).any(2)
        out[at] = np.where(both, x, np.iinfo(np.int64).max).min(1) == here[at]
    return out


def _cliques_of(rows: pa.Table) -> np.ndarray:
    """A number per clique, -1 for none."""
    return rows.column("clique").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()


def _sides(place: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether the place of each row has two sides; rows of a place follow each other."""
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    two = np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts)
    return np.repeat(two, np.diff(np.append(starts, len(place))))


def may_link(rows: pa.Table, threshold: float) -> np.ndarray:
    """Which rows, sorted by place and size, have a row that they may be similar to and that counts there."""
    place, path, side, size = (rows.column(c).to_numpy() for c in ("place", "path", "side", "size"))
    clique, two = _cliques_of(rows), _sides(place, side)
    sketch = Sketches(rows.column("sketch").to_pylist(), threshold)
    paths = _padded(_own_paths(rows))
    hit = np.zeros(len(place), bool)

    def look(a: np.ndarray, b: np.ndarray) -> None:
        keep = ~(hit[a] & hit[b])  # both are known to go on
        a, b = a[keep], b[keep]
        keep = (1 + threshold) * sketch.apart(a, b) <= (1 - threshold) * (size[a] + size[b]) + SLACK
        a, b = a[keep], b[keep]
        keep = counted(paths, a, b, path[a])
        hit[a[keep]] = hit[b[keep]] = True

    left, step, held, n_held = np.arange(len(place)), 0, [], 0
    while len(left):
        step += 1
        left = left[left + step < len(place)]
        left = left[(place[left] == place[left + step]) & (size[left] >= threshold * size[left + step] - SLACK)]
        a = left[~two[left] | (side[left] != side[left + step])]
        a = a[(clique[a] < 0) | (clique[a] != clique[a + step])]
        held.append((a, a + step))
        n_held += len(a)
        if n_held > 1 << 17 or not len(left):
            look(*(np.concatenate(x) for x in zip(*held)))
            held, n_held = [], 0
    return hit


def _candidates(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "place"):
            found = rows.filter(pa.array(may_link(rows, threshold))).select(["place", "path", "side", "node"])
            yield from found.to_batches()

    return run


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per node and place it is compared at, with its set and all its paths."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for i, tokens in _given_nodes(part):
                node, copies, clique, own, places = (part.column(c)[i].as_py() for c in range(1, 6))
                packed = _packed(tokens)
                for p in places:
                    rows.append((p["place"], p["path"], p["side"], node, copies, clique, own, packed))
                if len(rows) > 2000:
                    yield _place_rows(rows)
                    rows = []
            yield _place_rows(rows)


PLACE_ROWS = pa.schema(
    [
        ("place", pa.int64()), ("path", pa.int64()), ("side", pa.int32()), ("node", pa.binary()),
        ("copies", pa.int64()), ("clique", pa.binary()), ("_own", pa.list_(pa.int64())), ("tokens", pa.binary()),
    ]
)
PLACE_SQL = "place bigint, path bigint, side int, node binary, copies bigint, clique binary, _own array<bigint>, tokens binary"


def _place_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(PLACE_ROWS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PLACE_ROWS)], schema=PLACE_ROWS)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common tokens of every two sets, as a matrix; by columns of the tokens that several have."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]], np.float32)
    tokens, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = counts > 1
    column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), np.float32)  # counts are exact below 2 ** 24
    wide = 4096
    for at in range(0, int(shared.sum()), wide):
        low, high = np.searchsorted(column, [at, at + wide])
        block = np.zeros((n, wide), np.float32)
        block[owner[low:high], column[low:high] - at] = 1
        out += block @ block.T
    return out


def compare(path: int, sides: np.ndarray, cliques: np.ndarray, sets: list[np.ndarray], own: list[np.ndarray], threshold: float):
    """Similar pairs of the rows of one place that count here: at the least path their two rows share.

    With two sides only pairs across are compared; the sides by themselves have their own
    places. Pairs of one clique are counted elsewhere.
    """
    sizes = np.array([len(s) for s in sets], np.float64)
    common, found = overlaps(sets), []
    across = sides.min() != sides.max()
    for low in range(0, len(sets), 256):
        rows = slice(low, low + 256)
        similar = common[rows] >= threshold * (sizes[rows, None] + sizes[None, :] - common[rows]) - 1e-9
        similar &= np.arange(len(sets)) > np.arange(low, low + len(similar))[:, None]
        similar &= (cliques[rows, None] < 0) | (cliques[rows, None] != cliques[None, :])
        if across:
            similar &= sides[rows, None] != sides[None, :]
        a, b = np.nonzero(similar)
        found.append((a + low, b))
    a, b = (np.concatenate(x) for x in zip(*found))
    counts = counted(_padded(own), a, b, np.full(len(a), path))
    return a[counts], b[counts]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each row's group by the given pairs."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _compared(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "place"):
            rows = _named_once(rows)
            if rows.num_rows < 2:
                continue
            names = rows.column("node").to_pylist()
            own = _own_paths(rows)
            sides = rows.column("side").to_numpy()
            a, b = compare(rows.column("path")[0].as_py(), sides, _cliques_of(rows), _unpacked(rows), own, threshold)
            if not len(a):
                continue
            copies = rows.column("copies").to_numpy()
            links = np.zeros(len(names), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = local_roots(len(names), a, b)
            linked = np.unique(np.concatenate([a, b]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in linked], pa.binary()),
                    pa.array([names[i] for i in root[linked]], pa.binary()),
                    pa.array(links[linked]),
                ],
                names=["u", "v", "links"],
            )

    return run


def _buckets(members: DataFrame, threshold: float) -> DataFrame:
    """Paths with several nodes, of two with sizes that allow a link; of paths with the very same nodes, one."""
    return (
        members.groupBy("path")
        .agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who"), F.min("node").alias("least"),
            F.min("size").alias("low"), F.max("size").alias("high"), F.max("stays").alias("stays"),
        )
        .filter((F.col("n") > 2) | (F.col("n") == 2) & (F.col("low") >= threshold * F.col("high") - SLACK))
        .groupBy("n", "who", "least")
        .agg(F.min(F.struct(~F.col("stays"), "path")).alias("_first"), F.max("stays").alias("stays"))
        .select("_first.path", "n", "stays")
    )


def _leaf_places(leaves: DataFrame, threshold: float) -> DataFrame:
    """Where the nodes of small buckets are compared: those that have another of their size, not all of one clique."""
    bucket = Window.partitionBy("path")
    by_size = bucket.orderBy("size", "node")
    other = (F.lag("size").over(by_size) >= threshold * F.col("size") - SLACK) | (
        F.col("size") >= threshold * F.lead("size").over(by_size) - SLACK
    )
    one = (F.count("clique").over(bucket) == F.count("*").over(bucket)) & (
        F.min("clique").over(bucket) == F.max("clique").over(bucket)
    )
    rows = leaves.withColumn("_other", F.coalesce(other, F.lit(False))).withColumn("_one", F.coalesce(one, F.lit(False)))
    return rows.filter("_other and not _one").select("node", "clique", "path", F.col("path").alias("place"), F.lit(0).alias("side"))


def _block_places(rows: DataFrame, bucket: int) -> DataFrame:
    """Where the nodes of large buckets are compared: all but the largest clique, with each other and with it.

    Both are dealt over blocks by a hash of the node, and every two blocks meet at one place.
    """
    of = rows.groupBy("path", "clique").agg(F.count("*").alias("n")).groupBy("path").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("clique").isNotNull(), F.struct("n", "clique"))).alias("_top")
    )
    rest = F.col("n") - F.coalesce("_top.n", F.lit(0))
    of = of.select(
        "path", F.col("_top.clique").alias("_main"), F.ceil(rest / bucket).cast("int").alias("_rest"),
        F.ceil(F.coalesce("_top.n", F.lit(0)) / bucket).cast("int").alias("_blocks"),
    ).filter("_rest > 0")
    rows = rows.select("path", "node", "clique").join(of, "path")
    main = F.coalesce(F.col("clique") == F.col("_main"), F.lit(False))
    side = F.when(main, F.col("_rest") + F.pmod(F.hash("node"), F.greatest("_blocks", F.lit(1))))
    side = side.otherwise(F.pmod(F.hash("node"), F.col("_rest")))
    most = F.col("_rest") + F.when(main, F.lit(0)).otherwise(F.col("_blocks"))
    cut = rows.withColumn("side", side.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), most - 1)))
    place = F.xxhash64("path", F.least("side", "other"), F.greatest("side", "other"))
    return cut.select("node", "clique", "path", place.alias("place"), "side")


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """Class and links of every row of ``docs`` (``doc_id``, ``text``).

    Columns: ``doc_id``, ``_text_key`` (a hash of the text), ``n_shingles``, ``copies``
    (rows with the same set, itself included), ``n_links`` (other rows whose sets have a
    Jaccard similarity of ``threshold`` or more, copies included) and ``class_id``, the least
    doc_id of its component of links.

    A set has the distinct runs of five words `[^\\x20\\x09-\\x0D]+`; a text of fewer words,
    but not none, is one run. Every similarity is computed from whole sets. Rows without
    words or without a doc_id have no links and are a class of their own (their doc_id).
    Repeated rows are copies of each other. Empty tables give empty results; other columns
    are ignored.
    """
    runs = runs_for(recall, SPLITS)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = small_batches(docs).select("doc_id", F.xxhash64("text").alias("_text_key"), F.coalesce("text", F.lit("")).alias("text"))
    sets = stored(
        texts.mapInArrow(
            _first_paths(runs, threshold),
            types(texts, "doc_id", "_text_key", node="binary", n_shingles="bigint", sketch="binary", paths="array<bigint>"),
        )
    )
    usable = sets.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    nodes = stored(
        usable.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"),
            F.first("sketch").alias("sketch"), F.first("paths").alias("paths"),
        )
    )

    def with_text(wanted: DataFrame, lists: str) -> DataFrame:
        """Texts of the wanted nodes, found by the doc_id of one of their documents."""
        return texts.drop("_text_key").join(small_lists(wanted, lists), "doc_id")

    members = nodes.select("node", "size", F.explode("paths").alias("path"), F.lit(False).alias("stays"))
    buckets = stored(_buckets(members, threshold))

    def of(wanted: Column) -> DataFrame:
        return members.drop("stays").join(buckets.filter(wanted).drop("stays"), "path")

    leaves, dense = [of(F.col("n") <= bucket)], []
    for split in range(SPLITS):
        large = stored(buckets.filter((F.col("n") > bucket) & ~F.col("stays")))
        if large.isEmpty():
            break
        going = stored(members.drop("stays").join(small(large.select("path", "n")), "path").join(nodes.select("node", "doc_id"), "node"))
        voters = going.filter(F.pmod(F.xxhash64("node", "path"), F.col("n")) < VOTERS)
        voters = stored(voters.groupBy("doc_id", "node").agg(F.collect_list("path").alias("paths")))
        common = stored(
            with_text(voters, "paths")
            .select("text", "node", "paths")
            .mapInArrow(_voters, "path bigint, node binary, tokens binary")
            .repartition(width, "path")
            .sortWithinPartitions("path")
            .mapInArrow(_in_common(max(8, COMMON_ENTRIES // large.count()), split), "path bigint, common array<bigint>, stay bigint")
        )
        parents = stored(going.groupBy("doc_id", "node").agg(F.collect_list("path").alias("parents")))
        members = stored(
            with_text(parents, "parents")
            .select("text", "node", F.explode("parents").alias("path"))
            .join(F.broadcast(common), "path", "left")
            .select("text", "node", "path", "common", "stay")
            .mapInArrow(_split(threshold), "node binary, size bigint, path bigint, stays boolean")
            .distinct()
        )
        buckets = stored(_buckets(members, threshold))
        leaves.append(of(F.col("n") <= bucket))
        dense.append(of((F.col("n") > bucket) & F.col("stays")))
    else:
        dense.append(of((F.col("n") > bucket) & ~F.col("stays")))

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [rows.select("path", "node", "size", "n") for rows in parts])

    leaves, cliques = union(leaves).withColumn("clique", F.lit(None).cast("binary")), None
    dense = stored(union(dense)) if dense else None
    if dense is None or dense.isEmpty():
        places = _leaf_places(leaves, threshold)
    else:
        # Every node goes to one place of the first of its large buckets; as few places as hold them.
        at = stored(dense.groupBy("node").agg(F.min("path").alias("path")))
        parts = at.groupBy("path").agg(F.ceil(F.count("*") / bucket).cast("int").alias("_parts"))
        place = F.xxhash64("path", F.pmod(F.hash("node"), F.col("_parts"))).alias("place")
        at = stored(at.join(small(stored(parts)), "path").select("node", place).join(nodes.select("node", "doc_id"), "node"))
        found = (
            texts.drop("_text_key").join(small(at), "doc_id")
            .select("text", "node", "place")
            .mapInArrow(_sets_at_place, SET_SQL)
            .repartition(max(width, -(-row_count(at) // PLACE_ROWS_PER_TASK)), "place")
            .sortWithinPartitions("place")
            .mapInArrow(_in_cliques(threshold), "node binary, clique binary")
        )
        found = stored(found)
        totals = found.join(nodes.select("node", "copies"), "node").groupBy("clique").agg(
            F.sum("copies").alias("total"), F.min("node").alias("least"), F.count("*").alias("n")
        )
        totals = stored(totals.filter("n > 1").drop("n"))
        cliques = found.join(small(totals), "clique")
        known = small(stored(cliques.select("node", "clique")))
        places = _leaf_places(leaves.drop("clique").join(known, "node", "left"), threshold).unionByName(
            _block_places(stored(dense.join(known, "node", "left")), bucket)
        )
    wanted = stored(
        places.groupBy("node")
        .agg(F.first("clique").alias("clique"), F.collect_list(F.struct("place", "path", "side")).alias("places"))
        .join(nodes.drop("paths"), "node")
        .select("doc_id", "node", "copies", "size", "sketch", "clique", "places")
    )
    own = F.array_distinct(F.transform("places", lambda p: p["path"]))
    sent = wanted.agg(F.sum(F.size("places"))).first()[0] or 0
    going = stored(
        wanted.select("node", "size", "clique", "sketch", own.alias("_own"), F.explode("places").alias("_at"))
        .select("_at.*", "node", "size", "clique", "sketch", "_own")
        .repartition(max(width, -(-sent // PLACE_ROWS_PER_TASK)), "place")
        .sortWithinPartitions("place", "size")
        .mapInArrow(_candidates(threshold), "place bigint, path bigint, side int, node binary")
    )
    sent = going.count()
    listed = going.groupBy("node").agg(F.collect_list(F.struct("place", "path", "side")).alias("going"))
    listed = stored(wanted.select("node", "doc_id", "copies", "clique", own.alias("_own")).join(listed, "node"))
    compared = stored(
        with_text(listed, "going")
        .select("text", "node", "copies", "clique", "_own", "going")
        .mapInArrow(_with_sets, PLACE_SQL)
        .repartition(max(width, -(-sent // PLACE_ROWS_PER_TASK)), "place")
        .sortWithinPartitions("place")
        .mapInArrow(_compared(threshold), "u binary, v binary, links bigint")
    )
    if cliques is not None:
        # The links of a clique: all its rows but those with the same set.
        within = cliques.join(nodes.select("node", "copies"), "node")
        within = within.select(F.col("node").alias("u"), F.col("least").alias("v"), (F.col("total") - F.col("copies")).alias("links"))
        compared = stored(compared.unionByName(within))
    links = compared.groupBy("u").agg(F.sum("links").alias("links")).select(F.col("u").alias("node"), "links")
    roots = components(compared.select("u", "v"))
    named = roots.join(nodes.select("node", "doc_id"), "node")
    heads = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    linked = roots.join(heads, "root").join(links, "node").select("node", "class_id", "links")
    known = stored(
        nodes.filter("copies > 1")
        .select("node", "copies", F.col("doc_id").alias("_least"))
        .join(linked, "node", "full")
        .select("node", F.coalesce("copies", F.lit(1)).alias("copies"), "links", F.coalesce("class_id", "_least").alias("class_id"))
    )
    found = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    copies = F.when(found, F.coalesce("copies", F.lit(1))).otherwise(F.lit(1)).cast("long")
    return sets.drop("paths", "sketch").join(small(known), "node", "left").select(
        "doc_id",
        "_text_key",
        "n_shingles",
        copies.alias("copies"),
        F.when(found, copies - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(found, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def distinct(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, that with the least doc_id, with its columns as they came.

    Rows without a doc_id stay. Of rows that repeat an id and its text one stays.
    """
    found = stored(classes(docs, **options).filter(F.col("doc_id").isNotNull()))
    key = ["doc_id", "_text_key"]
    repeated = found.groupBy(*key).agg(F.count("*").alias("_n"), F.min("class_id").alias("class_id"))
    repeated = stored(repeated.filter((F.col("_n") > 1) | (F.col("class_id") != F.col("doc_id"))))
    rows = docs.select(whole_row(docs), "doc_id", F.xxhash64("text").alias("_text_key"))
    kept = rows.join(small(repeated.select(*key)), key, "left_anti")
    again = repeated.filter(F.col("class_id") == F.col("doc_id")).select(*key)
    if not again.isEmpty():
        kept = kept.unionByName(rows.join(small(again), key).dropDuplicates(key).select(rows.columns))
    return kept.select(f"{ROW}.*")
