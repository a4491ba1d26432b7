"""Jaccard join on word shingles by T-occurrence search (DivideSkip).

Two documents link when their sets of shingles are alike enough. Equal sets are one node.
The search needs, for a node, all nodes that occur on at least T of the inverted lists of
its shingles: the short lists are merged, and only nodes that reach T less the number of
long lists are looked up in the long ones by binary search.

What may link is brought together first, without loss. Linked sets have a fair part of
their shingles with the smallest hashes in common; a node that holds too few of its own
ones together with any other node has no link and is left out, however common a line or
passage of it is. The sets that remain are filed by size, and the hash values of shingles
are cut into so many segments that alike sets of a size class have one equal, not empty
segment at least: each differing shingle spoils one segment. Those few sets with so many
empty segments that this argument fails share one of their smallest shingles instead.
Nodes that meet, directly or in chains, form a neighbourhood.

A neighbourhood of bounded size is searched by one task. A larger one is first parted by its
nodes' rarest shingles, with exact counts of how many of its nodes hold each: linked nodes
share one of those. What is still larger is cut into tiles: each tile is searched, then one
node stands for everything joined so far, and at last the nodes outside the largest part are
searched against all tiles. Pairs that are joined already are never compared again and no
pair is ever written, so groups of copies cost their size. Large families of texts that are
almost alike enough, but are not, cost comparisons that grow with the square of the family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.llm.components import smallest_reachable
from clientlens.llm.text import byte_values, chunks, mixed, word_hashes
from clientlens.session import stage

SHINGLE_WORDS = 5
#: Links need LIKE[1] * intersection >= LIKE[0] * union.
LIKE = (80, 100)
#: Shingles or signatures a task holds before it passes them on, and about those a receiving task holds.
HELD_ENTRIES = 1 << 20
#: Shingles and nodes of a tile.
TILE_SHINGLES = 1 << 20
TILE_NODES = 4096
#: Rows up to which the list of wanted texts is broadcast (about 100 bytes each); texts are shuffled beyond.
BROADCAST_ROWS = 1_000_000
#: Texts a task remembers to skip their copies.
REMEMBERED = 1 << 20
#: Shingles that linked sets share among their smallest ones, as a share of all.
SHARED_PART = (1, 10)
#: Share of the extra segments that make up for empty ones.
SPARE = 0.08
_MU = 0.01  # weight of the long lists' cost in the split
_FOLD, _STEP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC6BC279692B5C323)


def shingle_sets(texts: list[bytes], width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, one after the other; size of each set).

    A text of fewer words than ``width`` is one shingle, one without words has none.
    """
    codes, counts = word_hashes([t.lower() for t in texts])  # bytes: A-Z only
    begins, runs = np.cumsum(counts) - counts, np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), runs)
    first = begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    words = np.minimum(counts, width)[owner]
    folded = mixed(words.astype(np.uint64) + np.uint64(seed))
    for k in range(width):
        longer = words > k
        if longer.all():
            folded = mixed(folded * _FOLD + codes[first + k])
        else:
            folded[longer] = mixed(folded[longer] * _FOLD + codes[first[longer] + k])
    order = np.lexsort((folded, owner))
    folded, owner = folded[order], owner[order]
    fresh = np.concatenate(([True], (folded[1:] != folded[:-1]) | (owner[1:] != owner[:-1])))[: len(folded)]
    return folded[fresh], np.bincount(owner[fresh], minlength=len(texts))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of consecutive groups, zero for an empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def set_keys(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, as two arrays."""
    own = sizes.astype(np.uint64)
    return mixed(_sums(mixed(tokens + _FOLD), sizes) + own), mixed(_sums(mixed(tokens ^ _STEP), sizes) + own)


def size_classes(like: tuple[int, int], most: int) -> np.ndarray:
    """First sizes of the classes; linked sets are of the same class or of neighbouring ones."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * like[1] // like[0])))
    return np.array(bounds, dtype=np.int64)


def segments(like: tuple[int, int], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segments, most differing shingles) of linked sets of class i and class i or i + 1."""
    last = bounds[1:] - 1
    larger = last * like[1] // like[0]
    differing = (last + larger) * (like[1] - like[0]) // (like[1] + like[0])
    return differing + 2 + np.ceil(differing * SPARE).astype(np.int64), differing


def signatures(tokens: np.ndarray, sizes: np.ndarray, like: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set): linked unlike sets share one at least."""
    bounds = size_classes(like, int(sizes.max(initial=0)))
    count, differing = segments(like, bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own_class = np.searchsorted(bounds, sizes, side="right") - 1
    spread, high = mixed(tokens), tokens >> np.uint64(32)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, owners = [], []
    for lower in (own_class, own_class - 1):  # with the class above, with the class below
        taken = (sizes > 0) & (lower >= 0)
        lower = np.where(taken, lower, 0)
        here = taken[owner]
        cell = (high * count[lower][owner].astype(np.uint64)) >> np.uint64(32)  # rises with the hash
        begins = np.flatnonzero(here & np.concatenate(([True], (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1])))[: len(here)])
        if not len(begins):
            continue
        lengths = np.diff(np.append(begins, len(tokens)))
        last = np.flatnonzero(np.diff(owner[begins], append=-1))  # a set ends where the next one begins
        lengths[last] = np.cumsum(sizes)[owner[begins[last]]] - begins[last]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))
        sums = total[begins + lengths] - total[begins]
        name = mixed(lower[owner[begins]].astype(np.uint64) * _STEP + cell[begins])
        out.append(mixed(sums + name)), owners.append(owner[begins])
        full = np.bincount(owner[begins], minlength=len(sizes))
        sparse = taken & (count[lower] - full >= count[lower] - differing[lower])
        prefix = sizes - -(-sizes * like[0] // like[1]) + 1
        chosen = sparse[owner] & (place < prefix[owner])
        out.append(mixed(tokens[chosen] * _FOLD + mixed(lower[owner[chosen]].astype(np.uint64) + _STEP)))
        owners.append(owner[chosen])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owners)


def _stars(signature: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """(signature, its first node) of every signature, and links (u, v) of others to the first."""
    order = np.lexsort((node, signature))
    signature, node = signature[order], node[order]
    begins = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1]))[: len(signature)])
    first = np.repeat(node[begins], np.diff(np.append(begins, len(node))))
    apart = np.flatnonzero(first != node)
    pairs = np.unique(np.stack([node[apart], first[apart]]), axis=1)
    return signature[begins], node[begins], pairs[0], pairs[1]


def _lists(part: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """(parts, values of each part as lists)."""
    order = np.argsort(part, kind="stable")
    parts, begins = np.unique(part[order], return_index=True)
    offsets = pa.array(np.append(begins, len(part)).astype(np.int32))
    return parts, [pa.ListArray.from_arrays(offsets, pa.array(v[order].view(np.int64))) for v in values]


def _by_part(frame: DataFrame, entries, send, receive, parts: int) -> DataFrame:
    """(part, a, b): pairs of lists, those of a row belonging to one of ``parts`` by their first value.

    Entries (key, node) are collected from the batches of ``frame`` by ``entries`` and brought down
    by ``send`` to (keys, nodes) to pass on and a finished pair of arrays. What is passed on goes as
    arrays to parts of bounded size, where ``receive`` makes finished pairs of it.
    """

    def listed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        return _lists((mixed(a >> np.uint64(1)) % np.uint64(parts)).astype(np.int64), [a, b])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            key, node, u, v = send(*map(np.concatenate, zip(*held)))
            for done, a, b in ((False, key, node), (True, u, v)):
                if len(a):
                    numbers, lists = listed(a, b)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers), pa.array(np.full(len(numbers), done)), *lists], names=["part", "done", "a", "b"])

        for found in entries(batches):
            held.append(found)
            size += len(found[0])
            if size > HELD_ENTRIES:
                yield from told()
                held, size = [], 0
        if held:
            yield from told()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def finished(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(a):
                numbers, lists = listed(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), *lists], names=["part", "a", "b"])

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                yield from finished(*receive(*map(np.concatenate, zip(*held))))

        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (batch.column(c)[row].values.to_numpy().view(np.uint64) for c in ("a", "b"))
                if batch.column("done")[row].as_py():
                    yield from finished(a, b)
                    continue
                if batch.column("part")[row].as_py() != at:
                    yield from told()
                    at, held = batch.column("part")[row].as_py(), []
                held.append((a.copy(), b.copy()))
        yield from told()

    dealt = frame.mapInArrow(sent, "part long, done boolean, a array<long>, b array<long>")
    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(met, "part long, a array<long>, b array<long>")


def _shared_locally(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """One node for each key, the lowest bit of the key telling whether others share it here; and
    (node, number of its keys that are shared here)."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(begins[1:], len(key)) - 1
    shared = node[begins] != node[ends]
    counted, times = np.unique(node[np.repeat(shared, ends - begins + 1)], return_counts=True)
    return key[begins] | shared.astype(np.uint64), node[begins], counted, times.astype(np.uint64)


def _shared_across(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, number of its keys that nodes of other tasks share), without those told already."""
    flag, key = key & np.uint64(1), key >> np.uint64(1)
    order = np.lexsort((node, key))
    key, node, flag = key[order], node[order], flag[order]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(begins[1:], len(key)) - 1
    shared = np.repeat(node[begins] != node[ends], ends - begins + 1)
    counted, times = np.unique(node[shared & (flag == 0)], return_counts=True)
    return counted, times.astype(np.uint64)


def sharers(texts: DataFrame, nodes: DataFrame, shingles: int, width: int, like: tuple[int, int], seed: int) -> DataFrame:
    """The rows of ``nodes`` (node, n, ...) that hold enough of their smallest shingles together with
    other nodes to have a link.

    Of n shingles in the order of their hashes the first n - ceil(n * like) + k are looked at, k
    being ``SHARED_PART`` of n, rounded up. Two linked sets have as many of those in common as the
    smaller of their k, and the smaller set has like * n shingles at least.
    """
    parts = max(1, -(-shingles * (like[1] - like[0]) // like[1] // HELD_ENTRIES))
    tenth = lambda n: -(-n * SHARED_PART[0] // SHARED_PART[1])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for given in _unseen(batches):
            tokens, sizes = shingle_sets(given, width, seed)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            looked_at = place < np.repeat(sizes - -(-sizes * like[0] // like[1]) + tenth(sizes), sizes)
            owner = np.repeat(set_keys(tokens, sizes)[0], sizes)
            yield tokens[looked_at] & ~np.uint64(1), owner[looked_at]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                node, times = map(np.concatenate, zip(*held))
                different, place = np.unique(node, return_inverse=True)
                sums = np.bincount(place, times).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(different), pa.array(sums)], names=["node", "times"])

        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("part")[row].as_py() != at:
                    yield from told()
                    at, held = batch.column("part")[row].as_py(), []
                held.append(tuple(batch.column(c)[row].values.to_numpy().copy() for c in ("a", "b")))
        yield from told()

    counts = _by_part(texts.select("text"), entries, _shared_locally, _shared_across, parts)
    counts = counts.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(added, "node long, times long")
    smaller = F.ceil(F.col("n") * like[0] / like[1] - 1e-9)
    need = F.ceil(smaller * SHARED_PART[0] / SHARED_PART[1] - 1e-9)
    return nodes.join(counts, "node").where(F.col("times") >= need).drop("times")


def neighbours(texts: _Texts, wanted: DataFrame, shingles: int, like: tuple[int, int]) -> DataFrame:
    """(u, v): links whose components hold all linked nodes of ``wanted`` (text_key, node).

    A task passes on one node for each signature it has collected, and links the others to it
    on the spot.
    """
    parts, width, seed = max(1, -(-shingles // HELD_ENTRIES)), texts.width, texts.seed

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part, given in _fresh(batches):
            signature, owner = signatures(*shingle_sets(given, width, seed), like)
            yield signature, part.column("node").to_numpy().view(np.uint64)[owner]

    found = _by_part(texts.rows(wanted, []), entries, _stars, lambda *x: _stars(*x)[2:], parts)
    return found.select(F.inline(F.arrays_zip(F.col("a").alias("u"), F.col("b").alias("v")))).distinct()


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], names=["u", "v"])


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Texts in chunks, without those the task has just seen."""
    seen: set[bytes] = set()
    for batch in batches:
        texts = []
        for text in byte_values(batch.column("text")):
            key = xxhash.xxh3_128_digest(text)
            if key not in seen:
                seen.add(key), texts.append(text)
        if len(seen) > REMEMBERED:
            seen.clear()
        for a, b in chunks(texts):
            yield texts[a:b]


def occurring(lists: tuple, query: np.ndarray, before: np.ndarray, need: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the sets that hold ``need`` of the query's shingles at least, how many each).

    ``lists`` are the inverted lists (start of each, members, keys for look-up); of each list
    only the first ``before`` members count. DivideSkip: all but the longest lists are merged,
    and what occurs often enough there is looked up in the long ones by binary search.
    """
    starts, members, keys = lists
    live = np.flatnonzero(before)
    query, before = query[live], before[live]
    if len(query) < need:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(-before, kind="stable")
    long_ones = min(need - 1, int(need / (_MU * np.log2(before.max() + 1) + 1)))
    long_query, short = query[order[:long_ones]], order[long_ones:]
    sizes = before[short]
    at = np.repeat(starts[query[short]], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    merged = np.bincount(members[at], minlength=1) if len(at) * 4 > count else None
    if merged is None:
        found, times = np.unique(members[at], return_counts=True)
    else:
        found = np.flatnonzero(merged)
        times = merged[found]
    enough = times >= need - long_ones
    found, times = found[enough], times[enough].astype(np.int64)
    if len(found) and long_ones:
        wanted = long_query[:, None] * count + found[None, :]
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        times = times + (keys[place] == wanted).sum(axis=0)
    enough = times >= need
    return found[enough], times[enough]


def linked(sets: list[np.ndarray], root: np.ndarray, tile: np.ndarray | None, like: tuple[int, int]) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets linked to one another. Sets of one ``root`` are joined
    already, those of one ``tile`` have been compared."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    by_size = np.argsort(sizes, kind="stable")
    sizes, root = sizes[by_size], root[by_size]
    tile = None if tile is None else tile[by_size]
    known, token = np.unique(np.concatenate([sets[i] for i in by_size]), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(token, kind="stable")
    starts = np.searchsorted(token[order], np.arange(len(known)))
    members = owner[order]
    rank = np.empty(len(token), dtype=np.int64)
    rank[order] = np.arange(len(token)) - starts[token[order]]
    lists = (starts, members, token[order] * len(sizes) + members)
    begins = np.cumsum(sizes) - sizes
    need = -(-sizes * like[0] // like[1])
    shared = np.add.reduceat(rank > 0, begins) if len(begins) else np.zeros(0, np.int64)
    _, label = np.unique(root, return_inverse=True)
    out = []
    for i in np.flatnonzero(shared >= need):
        here = slice(begins[i], begins[i] + sizes[i])
        found, common = occurring(lists, token[here], rank[here], int(need[i]), len(sizes))
        open_pairs = (label[found] != label[i]) & (common * (like[0] + like[1]) >= like[0] * (sizes[found] + sizes[i]))
        if tile is not None:
            open_pairs &= tile[found] != tile[i]
        for j in found[open_pairs]:
            if label[j] != label[i]:
                out.append((int(by_size[i]), int(by_size[j])))
                label[label == label[j]] = label[i]
    return out


def _searched(units: DataFrame, like: tuple[int, int], compared: bool) -> DataFrame:
    """(u, v) found among the rows (unit, node, root, tile, shingles) of each unit.

    A node may come more than once, from copies of its text. ``compared`` says that rows of one tile have been compared with each other. Small units
    are searched together; what links across them is a link all the same.
    """
    ordered = units.repartition("unit").sortWithinPartitions("unit", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def told(done: list) -> pa.RecordBatch:
            node, root, tile, sets = zip(*done)
            pairs = linked(list(sets), np.array(root), np.array(tile) if compared else None, like)
            u, v = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
            nodes = np.array(node)
            return _pairs(nodes[u], nodes[v])

        last = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "node", "root", "tile")]
            lists = batch.column("shingles")
            flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for unit, node, root, tile, a, b in zip(*columns, offsets, offsets[1:]):
                if (unit, node) == last:
                    continue
                if last and unit != last[0] and size > TILE_SHINGLES // 4:
                    yield told(rows)
                    rows, size = [], 0
                rows.append((node, root, tile, flat[a:b].copy()))
                last, size = (unit, node), size + b - a
        if rows:
            yield told(rows)

    return ordered.mapInArrow(run, "u long, v long")


def _joined_by(links: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their node in the components of ``links``."""
    roots = smallest_reachable(links)
    return rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _tiled(rows: DataFrame, key: str = "group") -> DataFrame:
    """``rows`` (node, n, key, ...) with ``tiles`` of their group and their own ``tile``."""
    count = F.greatest(F.ceil(F.sum("n") / TILE_SHINGLES), F.ceil(F.count("*") / TILE_NODES))
    sizes = stage(rows.groupBy(key).agg(count.cast("int").alias("tiles")), "tiles")
    return rows.join(sizes, key).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS,
                 like: tuple[int, int] = LIKE) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the smallest id reachable
    over links, itself included.

    Rows link when ``like[1]`` * intersection >= ``like[0]`` * union of their sets of shingles of
    ``width`` words, whatever their number. Null texts and texts without words have empty sets and
    link with nothing, not even with each other: their component is their own id. Rows with equal
    sets always link, so repeated rows do. A null id takes part; a component of only such rows has
    a null component_id. An empty table gives an empty result. Other columns are not read.
    Shingles are 64-bit hashes; sets are told apart by 128 bits.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seed = 0
    while True:
        rows = stage(_described(source, width, seed), "described")
        full = rows.where("n_shingles > 0")
        clash = full.groupBy("node").agg((F.min("check") < F.max("check")).alias("clash")).where("clash")
        if not clash.take(1):  # 64 bits name a set; another seed where two sets share them
            break
        seed += 1
    nodes = stage(full.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), F.min("text_key").alias("text_key")), "nodes")
    total = F.coalesce(F.sum("n"), F.lit(0))
    close = stage(sharers(source, nodes, nodes.agg(total).first()[0], width, like, seed), "sharers")
    texts = _Texts(source, width, seed)
    near = stage(neighbours(texts, close, close.agg(total).first()[0], like), "neighbours")
    placed = close.join(smallest_reachable(near).withColumnRenamed("root", "group"), "node").select("node", "n", "text_key", "group")
    held = stage(_tiled(stage(placed, "placed")), "tiled")
    if held.where("tiles > 1").take(1):
        parted = _parted(texts, held.where("tiles > 1").drop("tiles", "tile"), like)
        held = stage(held.where("tiles = 1").unionByName(_tiled(parted), allowMissingColumns=True), "tiled")
    links = stage(_search_rounds(texts, held, like), "links")
    found = nodes.select("node", "first_id").join(smallest_reachable(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    components = stage(found.join(lowest, "root").select("node", "component_id"), "components")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.join(components, "node").select("doc_id", "n_shingles", "component_id").unionByName(alone).withColumnRenamed(
        "doc_id", id_col)


def _described(source: DataFrame, width: int, seed: int) -> DataFrame:
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL(
        "n_shingles long, node long, check long, text_key binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = byte_values(batch.column("text")), [np.zeros((3, 0), dtype=np.int64)]
            for a, b in chunks(texts):
                tokens, sizes = shingle_sets(texts[a:b], width, seed)
                out.append(np.stack([sizes, *(k.view(np.int64) for k in set_keys(tokens, sizes))]))
            columns = [pa.array(c) for c in np.concatenate(out, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, batch.column("text_key")], names=schema.names)

    return source.withColumn("text_key", _text_key()).mapInArrow(run, schema)


def _text_key() -> Column:
    return F.unhex(F.md5("text"))


class _Texts:
    """Gives the shingles of wanted nodes, from the texts."""

    def __init__(self, source: DataFrame, width: int, seed: int) -> None:
        self.source, self.width, self.seed = source, width, seed

    def of(self, wanted: DataFrame, carry: list[str]) -> DataFrame:
        """``carry`` columns and ``shingles`` for the rows of ``wanted`` (text_key, node, ...), a written
        table; a row comes again from every task that reads a copy of its text."""
        width, seed = self.width, self.seed
        schema = T.StructType([*(wanted.schema[c] for c in carry), *T.StructType.fromDDL("shingles array<long>").fields])

        def with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, given in _fresh(batches):
                tokens, sizes = shingle_sets(given, width, seed)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                sets = pa.ListArray.from_arrays(offsets, pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), sets], names=[*carry, "shingles"])

        return self.rows(wanted, carry).mapInArrow(with_set, schema)

    def rows(self, wanted: DataFrame, carry: list[str]) -> DataFrame:
        """(text, node, ``carry``): the texts that are wanted, with all their copies."""
        asked = wanted.select("text_key", "node", *[c for c in carry if c != "node"])
        texts = self.source.select("text", _text_key().alias("text_key"))
        joined = texts.join(F.broadcast(asked) if wanted.count() <= BROADCAST_ROWS else asked, "text_key")
        return joined.drop("text_key")


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches (text, node, ...) of about 1 MB of text, without nodes the task has just
    seen."""
    seen: set[int] = set()
    for batch in batches:
        kept = [i for i, node in enumerate(batch.column("node").to_pylist()) if not (node in seen or seen.add(node))]
        if len(seen) > REMEMBERED:
            seen.clear()
        part = batch.take(pa.array(kept, pa.int32()))
        texts = byte_values(part.column("text"))
        for a, b in chunks(texts):
            yield part.slice(a, b - a), texts[a:b]


def _parted(texts: _Texts, rows: DataFrame, like: tuple[int, int]) -> DataFrame:
    """``rows`` (node, n, text_key, group) that share one of the rarest shingles of both with another
    one, under a group of those that do, directly or in chains.

    Of ``n`` shingles, ordered by the number of nodes that hold them, the first
    n - ceil(n * like) + 1 are looked at; a linked node has one of them among its own first ones.
    """
    rows = stage(rows, "large")
    held = stage(texts.of(rows, ["node", "n"]).select("node", "n", F.explode("shingles").alias("shingle")), "shingles")
    counts = held.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    per_node = held.join(counts, "shingle").groupBy("node").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("shared"))
    alone = F.col("n") - F.size("shared")  # these come first
    looked_at = F.greatest(F.col("n") - F.ceil(F.col("n") * like[0] / like[1] - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    kept = stage(per_node.select("node", F.explode(F.slice("shared", F.lit(1), looked_at)["shingle"]).alias("shingle")), "kept")
    first = kept.groupBy("shingle").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last").drop("last")
    links = kept.join(first, "shingle").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    roots = smallest_reachable(links).withColumnRenamed("root", "group")
    return stage(rows.drop("group").join(roots, "node"), "parted")


def _search_rounds(texts: _Texts, held: DataFrame, like: tuple[int, int]) -> DataFrame:
    """(u, v): links that join all linked nodes of ``held`` (node, n, text_key, group, tiles, tile)."""
    unit = lambda *parts: F.xxhash64("group", *parts).alias("unit")
    columns = ["node", F.col("node").alias("root"), "tile", "shingles"]
    placed = ["node", "group", "tile", "tiles"]
    small = _searched(texts.of(held.where("tiles = 1"), placed).select(unit("tile"), *columns), like, False)
    if not held.where("tiles > 1").take(1):
        return small
    large = stage(texts.of(held.where("tiles > 1"), placed), "sets")
    links = stage(_searched(large.select(unit("tile"), *columns), like, False), "links")

    # one node for all that is joined so far
    members = held.where("tiles > 1").select("node", "n", "group")
    first = _tiled(stage(_joined_by(links, members).where("node = root").drop("root"), "first"))
    again = large.select("node", "group", "shingles").join(stage(first.select("node", "tile"), "first"), "node")
    links = stage(links.unionByName(_searched(again.select(unit("tile"), *columns), like, False)), "links")

    # what is outside the largest part of its group asks all tiles
    rooted = stage(_joined_by(links, members), "rooted")
    parts = rooted.groupBy("group", "root").agg(F.count("*").alias("rows")).groupBy("group").agg(
        F.max_by("root", F.struct("rows", "root")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    left = stage(rooted.join(stage(parts, "parts"), "group").withColumn("asks", F.col("root") != F.col("largest")), "left")
    turns = left.where("asks").groupBy("group").agg(F.greatest(
        F.ceil(F.sum("n") / TILE_SHINGLES), F.ceil(F.count("*") / TILE_NODES)).cast("int").alias("turns"))
    asked = large.join(left.select("node", "root", "asks"), "node").join(stage(turns, "turns"), "group")
    own_turn = F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")).cast("int")
    numbers = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    cells = F.transform(numbers("turns"), lambda q: F.struct(F.col("tile").alias("t"), q.alias("q")))
    asking = F.transform(F.filter(numbers("tiles"), lambda t: t != F.col("tile")), lambda t: F.struct(t.alias("t"), own_turn.alias("q")))
    spread = asked.select("group", "node", "root", "tile", "shingles", F.explode(
        F.when(F.col("asks"), F.concat(cells, asking)).otherwise(cells)).alias("at"))
    last = _searched(spread.select(unit("at"), "node", "root", "tile", "shingles"), like, True)
    return small.unionByName(links).unionByName(last)


def op11_jaccard_join(spark, folder: str) -> DataFrame:
    """Set size and component of every document."""
    return join_similar(spark.read.parquet(f"{folder}/documents.parquet"))


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (
  SELECT a.r AS u, b.r AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r
), links AS (
  SELECT u, v FROM common c JOIN sizes a ON a.r = c.u JOIN sizes b ON b.r = c.v WHERE 100 * c.n >= 80 * (a.n + b.n - c.n)
), reach AS (
  SELECT r, r AS at FROM docs UNION SELECT reach.r, links.v FROM reach JOIN links ON links.u = reach.at
)
SELECT d.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM docs d JOIN reach ON reach.r = d.r JOIN docs o ON o.r = reach.at LEFT JOIN sizes s ON s.r = d.r
GROUP BY d.r, d.doc_id
"""
