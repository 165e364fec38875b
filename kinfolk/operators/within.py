"""Searches inside tasks: whole components of a graph are dealt to tasks, each as often as its sources are worth, and searched there from many sources at a time.

Nothing outside a component is read for its sources, so a graph of many components costs the sum of them. Components of more than `task_edges` edges are left to the joins
of `search`, so a task's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, save

#: Edges of a component that a task may hold; products of edges and masks of 64 sources that are worth a task; rows that the copies of one component may make; rows that are searched together.
TASK_EDGES, TASK_WORK, COPY_ROWS, TOGETHER = 1 << 22, 1 << 24, 1 << 26, 1 << 16
#: Neighbours of a node that are read by columns, and words of the masks that are held at once.
COLUMNS, HELD = 32, 1 << 19

Rows = Iterator[tuple[np.ndarray, ...]]


@dataclass
class Dealt:
    """The components that tasks search, and the edges and sources of those that are too large."""

    edges: DataFrame  # comp, src, dst
    sources: DataFrame  # comp, the columns of the sources, m, e: sources of the component, and its edges
    large: tuple[DataFrame, DataFrame] | None  # edges (src, dst) and the sources with their columns


def placed(edges: DataFrame, nodes: DataFrame, sources: DataFrame, task_edges: int = TASK_EDGES, comps: DataFrame | None = None) -> Dealt:
    """Edges and sources (person, and what else a search needs of each, as longs) by component; components without edges or without sources are left out."""
    edges = save(edges.select("src", "dst"))
    if comps is None:
        every = nodes.select("person").union(sources.select("person")).union(edges.select("src")).distinct()
        comps = save(components(edges, every))
    of = save(edges.join(comps, F.col("src") == F.col("node")).select("comp", "src", "dst"))
    mine = save(sources.join(comps, F.col("person") == F.col("node")).select("comp", *sources.columns))
    sizes = save(mine.groupBy("comp").agg(F.count("*").alias("m")).join(of.groupBy("comp").agg(F.count("*").alias("e")), "comp"))
    large = sizes.where(F.col("e") > task_edges)
    asked = save(mine.join(sizes.where(F.col("e") <= task_edges), "comp"))
    if large.isEmpty():
        return Dealt(of, asked, None)
    wide = of.join(large, "comp", "left_semi").select("src", "dst"), mine.join(large, "comp", "left_semi").select(*sources.columns)
    return Dealt(of.join(asked, "comp", "left_semi"), asked, wide)


def searched(dealt: Dealt, search: Callable[[Graph], Rows], schema: str, split: bool = True, edge_work: int = 1) -> DataFrame:
    """What `search` yields for the components that tasks are dealt. `split`: a component's sources may go to several tasks, so that rows of the same node come from each.
    `edge_work`: how often a mask's time each edge takes."""
    of, asked = dealt.edges, dealt.sources
    parts = int(of.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    worth = F.ceil(F.ceil(F.col("m") / 64) * F.col("e") * edge_work / TASK_WORK)
    room = F.greatest(F.lit(8), F.floor(F.lit(COPY_ROWS) / F.col("e")))
    copies = F.greatest(F.lit(1), F.least(worth, room, F.lit(4 * parts), "m")).cast("int") if split else F.lit(1)
    sizes = asked.select("comp", copies.alias("copies")).distinct()
    held = of.join(sizes, "comp").select("comp", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), "src", "dst")
    more = [c for c in asked.columns if c not in ("comp", "person", "m", "e")]
    first = asked.select("comp", F.pmod(F.xxhash64("person", *more), copies).cast("int").alias("part"), F.col("person").alias("src"), F.lit(None).cast("long").alias("dst"), *more)
    rows = held.unionByName(first, allowMissingColumns=True).repartition(parts, "comp", "part").sortWithinPartitions("comp", "part", F.col("dst").asc_nulls_first(), "src")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, src, dst, *others in _gathered(batches, more):
            graph = Graph(group, src, dst, dict(zip(more, others, strict=True)))
            if len(graph.start):
                for columns in search(graph):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = [column.split()[0] for column in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch], more: list[str]) -> Iterator[tuple]:
    """(number of the group, src, dst, columns of `more`) of rows in order, with whole groups, of which small ones come together."""
    held: list[tuple] = []
    last, number, rows = None, 0, 0
    joined = lambda: tuple(np.concatenate(c) if isinstance(c[0], np.ndarray) else pa.chunked_array(c) for c in zip(*held, strict=True))
    for batch in batches:
        if not batch.num_rows:
            continue
        comp, part, src = (batch.column(c).to_numpy() for c in ("comp", "part", "src"))
        new = np.ones(len(comp), bool)
        new[1:] = (comp[1:] != comp[:-1]) | (part[1:] != part[:-1])
        new[0] = last != (comp[0], part[0])
        group, last = number + np.cumsum(new), (comp[-1], part[-1])
        number, cut = int(group[-1]), int(np.flatnonzero(new)[-1]) if new.any() else None
        columns = (group, src, *(batch.column(c) for c in ("dst", *more)))
        if cut is not None and rows + cut >= TOGETHER:
            held.append(tuple(c[:cut] for c in columns))
            yield joined()
            held, rows, columns = [], 0, tuple(c[cut:] for c in columns)
        held.append(columns)
        rows += len(columns[0])
    if held:
        yield joined()


class Graph:
    """Some whole components as arrays, each with sources: those of all are searched at once, as the i-th source of each has the same bit."""

    def __init__(self, group: np.ndarray, src: np.ndarray, dst: pa.ChunkedArray, more: dict[str, pa.ChunkedArray]) -> None:
        source = dst.is_null().to_numpy()
        head = dst.drop_null().to_numpy()
        group = group - group[0]
        run = group[~source]
        new = np.ones(len(head), bool)
        new[1:] = (head[1:] != head[:-1]) | (run[1:] != run[:-1])
        self.person, self.group = head[new], run[new]
        ids = np.unique(self.person)
        key = lambda g, p: g * len(ids) + np.searchsorted(ids, p)
        nodes = key(self.group, self.person)
        self.dst = (np.cumsum(new) - 1).astype(np.int32)
        self.src = np.searchsorted(nodes, key(run, src[~source])).astype(np.int32)
        #: The sources, and which of its component each one is.
        self.start, owner = np.searchsorted(nodes, key(group[source], src[source])), group[source]
        self.place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        self.of_source = {name: column.filter(dst.is_null()).to_numpy() for name, column in more.items()}
        if "target" in more:
            self.of_source["target"] = np.searchsorted(nodes, key(owner, self.of_source["target"]))
        #: Where each component's nodes begin, and the number of each node's component.
        self.first = np.flatnonzero(np.diff(self.group, prepend=-1))
        self.group = np.cumsum(np.diff(self.group, prepend=-1) > 0) - 1
        self.degree = np.bincount(self.dst, minlength=len(self.person))

    def only(self, kept: np.ndarray) -> Graph:
        """The components of the nodes that `kept` marks."""
        part, at = object.__new__(Graph), np.cumsum(kept) - 1
        inner, begun = kept[self.dst], kept[self.start]
        part.person, part.dst, part.src = self.person[kept], at[self.dst[inner]].astype(np.int32), at[self.src[inner]].astype(np.int32)
        part.start, part.place, part.degree = at[self.start[begun]], self.place[begun], self.degree[kept]
        part.of_source = {name: (at[column[begun]] if name == "target" else column[begun]) for name, column in self.of_source.items()}
        group = self.group[kept]
        part.first, part.group = np.flatnonzero(np.diff(group, prepend=-1)), np.cumsum(np.diff(group, prepend=-1) > 0) - 1
        return part

    def spread(self, ufunc: np.ufunc) -> Callable[[np.ndarray], np.ndarray]:
        """Of an array by node, what `ufunc` makes of each node's neighbours: by columns of neighbours of the nodes in order of their degree, by runs for what is left of large degrees."""
        order = np.argsort(-self.degree, kind="stable")
        at = np.arange(len(self.dst)) - (np.cumsum(self.degree) - self.degree)[self.dst]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        columns, few = [], np.flatnonzero(at < COLUMNS)
        few = few[np.argsort(at[few], kind="stable")]
        for some in np.split(few, np.flatnonzero(np.diff(at[few])) + 1):
            column = np.empty(len(some), np.int32)
            column[rank[self.dst[some]]] = self.src[some]
            columns.append(column)
        more = self.src[at >= COLUMNS]
        heads, starts = np.unique(self.dst[at >= COLUMNS], return_index=True)

        def apply(values: np.ndarray) -> np.ndarray:
            ranked = np.zeros_like(values)
            for column in columns:
                part = ranked[: len(column)]
                ufunc(part, values[column], out=part)
            near = ranked[rank]
            if len(heads):
                near[heads] = ufunc(near[heads], ufunc.reduceat(values[more], starts, axis=0))
            return near

        return apply

    def masks(self, first: int, words: int) -> np.ndarray:
        """(node, word): bits of the components' sources from number 64 * first on."""
        front = np.zeros((len(self.person), words), np.uint64)
        word = self.place // 64 - first
        inside = (word >= 0) & (word < words)
        np.bitwise_or.at(front, (self.start[inside], word[inside]), np.uint64(1) << (self.place[inside] % 64).astype(np.uint64))
        return front

    def levels(self, depth: int | None = None) -> Iterator[tuple[Graph, int, int, np.ndarray]]:
        """(graph, first word, level, masks) of each level from 1, for the sources of each pass: which of them come to each node of the graph in that level."""
        graph, first, near = self, 0, None
        total = -(-(int(self.place.max()) + 1) // 64)
        while first < total:
            wanted = np.zeros(len(graph.first), bool)
            wanted[graph.group[graph.start[graph.place >= 64 * first]]] = True
            kept = wanted[graph.group]
            if near is None or kept.sum() < 0.7 * len(kept):
                graph = graph.only(kept)
                near = graph.spread(np.bitwise_or)
            words = max(1, min(total - first, HELD // len(graph.person)))
            front = graph.masks(first, words)
            seen, level = front.copy(), 0
            while depth is None or level < depth:
                level += 1
                front = near(front)
                front &= ~seen
                if not front.any():
                    break
                seen |= front
                yield graph, first, level, front
            first += words


def _met(graph: Graph, level: int, front: np.ndarray) -> tuple[np.ndarray, ...]:
    count = np.bitwise_count(front).sum(axis=1, dtype=np.int64)
    some = count > 0
    return graph.person[some], np.full(some.sum(), level, np.int32), count[some]


def _own(graph: Graph, first: int, level: int, front: np.ndarray) -> tuple[np.ndarray, ...]:
    """How many nodes the sources of `front` come to."""
    words = front.shape[1]
    counts = np.zeros((len(graph.first), 64 * words), np.int64)
    for w in range(words):
        for lower in range(0, len(front), 1 << 16):
            piece = np.ascontiguousarray(front[lower : lower + (1 << 16), w])
            bits = np.unpackbits(piece.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            owner = graph.group[lower : lower + len(piece)]
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            counts[owner[begins], 64 * w : 64 * w + 64] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    at = graph.place - 64 * first
    here = (at >= 0) & (at < 64 * words)
    count = counts[graph.group[graph.start[here]], at[here]]
    some = count > 0
    return graph.person[graph.start[here]][some], np.full(some.sum(), level, np.int32), count[some]


def counted(dealt: Dealt, own: bool, met: bool, depth: int | None = None) -> DataFrame:
    """own, person, level, c from level 1 on: how many nodes each source comes to at each level (own), how many sources come to each node (not own).

    Where all nodes are sources the two are the same, as edges go both ways; the second costs less. A node has a row for each task that met it.
    """

    def count(graph: Graph) -> Rows:
        for part, first, level, front in graph.levels(depth):
            if own:
                rows = _own(part, first, level, front)
                yield np.ones(len(rows[0]), bool), *rows
            if met:
                rows = _met(part, level, front)
                yield np.zeros(len(rows[0]), bool), *rows

    return searched(dealt, count, "own boolean, person long, level int, c long")


def longest(dealt: Dealt, block: int) -> DataFrame:
    """diameter, searched: the longest distance within each task's components, of which all nodes are sources, and how many nodes were searched from.

    Rounds by bounds as in `centrality.diameter`, with a block of nodes of each component that may still hold a longer distance, and larger blocks as rounds go on.
    """

    def rounds(graph: Graph) -> Rows:
        sizes = np.bincount(graph.group)
        least, most = np.zeros(len(graph.person), np.int64), (sizes - 1)[graph.group]
        found, count, size = 0, 0, min(64, block)
        while True:
            kept = most > found
            if not kept.any():
                break
            alive = np.zeros(len(graph.first), bool)
            alive[graph.group[kept]] = True
            if alive.sum() < 0.7 * len(alive):
                nodes = alive[graph.group]
                graph, least, most, kept = graph.only(nodes), least[nodes], most[nodes], kept[nodes]
            if count == 0 or len(least) != len(place):
                near = graph.spread(np.bitwise_or)
            place = np.full(len(graph.person), -1)
            open_ = np.flatnonzero(kept)
            for keys in ((-graph.degree, -most), (-graph.degree, most, least)):
                order = open_[np.lexsort([k[open_] for k in keys] + [graph.group[open_]])]
                owner = graph.group[order]
                turn = np.arange(len(order)) - np.searchsorted(owner, owner)
                place[order[turn < max(1, size // 2)]] = 0
            graph.start = np.flatnonzero(place == 0)
            owner = graph.group[graph.start]
            graph.place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            place[graph.start] = graph.place
            least, most = _bounded(graph, near, least, most)
            count += len(graph.start)
            found, size = max(found, int(least.max())), min(64, 2 * size)
        yield np.array([found]), np.array([count])

    return searched(dealt, rounds, "diameter long, searched long", split=False)


def _bounded(graph: Graph, near: Callable[[np.ndarray], np.ndarray], least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each node's eccentricity after a search from at most 64 sources of each component."""
    front = graph.masks(0, 1)
    seen, level, steps = front.copy(), 0, []
    far = np.zeros((len(graph.first), 64), np.int32)
    while front.any():
        at = np.flatnonzero(front[:, 0])
        mask = front[at, 0]
        steps.append((level, at, mask))
        owner = graph.group[at]
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        far[owner[begins]] = np.where(_bits(np.bitwise_or.reduceat(mask, begins)), level, far[owner[begins]])
        level += 1
        front = near(front)
        front &= ~seen
        seen |= front
    least, most = least.copy(), most.copy()
    for level, at, mask in steps:
        for lower in range(0, len(at), 1 << 16):
            some = at[lower : lower + (1 << 16)]
            bits, e = _bits(mask[lower : lower + (1 << 16)]), far[graph.group[some]]
            least[some] = np.maximum(least[some], np.where(bits, np.maximum(level, e - level), 0).max(axis=1))
            most[some] = np.minimum(most[some], np.where(bits, e + level, np.iinfo(np.int32).max).min(axis=1))
    return least, most


def _bits(masks: np.ndarray) -> np.ndarray:
    return np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)


def frequencies(dealt: Dealt) -> DataFrame:
    """person, frequency as in `centrality.path_frequency`, in parts to be summed: a few sources at a time, counts of paths go forward over the levels and shares backward."""

    def through(graph: Graph) -> Rows:
        columns = max(1, min(64, (1 << 22) // len(graph.dst)))
        for first in range(0, int(graph.place.max()) + 1, columns):
            begun = (graph.place >= first) & (graph.place < first + columns)
            wanted = np.zeros(len(graph.first), bool)
            wanted[graph.group[graph.start[begun]]] = True
            kept = wanted[graph.group]
            if first == 0 or kept.sum() < 0.7 * len(kept):
                graph = graph.only(kept)
                near = graph.spread(np.add)
                begun = (graph.place >= first) & (graph.place < first + columns)
            level, shape = 0, (len(graph.person), columns)
            dist, front = np.full(shape, -1, np.int32), np.zeros(shape)
            dist[graph.start[begun], graph.place[begun] - first] = 0
            front[dist == 0] = 1
            paths = front.copy()
            while True:
                level += 1
                front = near(front)
                front[dist >= 0] = 0
                fresh = front > 0
                if not fresh.any():
                    break
                dist[fresh] = level
                paths += front
            share = np.zeros(shape)
            for back in range(level - 1, 1, -1):
                each = np.divide(1 + share, paths, out=np.zeros(shape), where=dist == back)
                share = np.where(dist == back - 1, paths * near(each), share)
            share[dist == 0] = 0
            total = share.sum(axis=1)
            yield graph.person[total > 0], total[total > 0]

    return searched(dealt, through, "person long, frequency double", edge_work=32)


def traced(dealt: Dealt) -> DataFrame:
    """query_no, step, person as in `search.path_nodes`, for sources with columns query_no and target (a node of the same component): each has a bit of its own."""

    def trace(graph: Graph) -> Rows:
        near, first, total = graph.spread(np.bitwise_or), 0, -(-(int(graph.place.max()) + 1) // 64)
        begin = np.cumsum(graph.degree) - graph.degree
        while first < total:
            words = max(1, min(total - first, HELD // len(graph.person)))
            here = (graph.place >= 64 * first) & (graph.place < 64 * (first + words))
            word, bit = graph.place[here] // 64 - first, np.uint64(1) << (graph.place[here] % 64).astype(np.uint64)
            end, query = graph.of_source["target"][here], graph.of_source["query_no"][here]
            front = graph.masks(first, words)
            seen, gone, depth, level = front.copy(), np.zeros((len(graph.first), words), np.uint64), np.full(len(end), -1), 0
            met = []  # of each level, where masks are, and these
            while True:
                at = np.flatnonzero(front)
                met.append((at, front.ravel()[at]))
                hit = (depth < 0) & ((front[end, word] & bit) != 0)
                depth[hit] = level
                if (depth >= 0).all():
                    break
                np.bitwise_or.at(gone, (graph.group[end[hit]], word[hit]), bit[hit])
                front &= ~gone[graph.group]
                level += 1
                front = near(front)
                front &= ~seen
                seen |= front
            yield query, depth.astype(np.int32), graph.person[end]
            at = end.copy()
            for level in range(int(depth.max()), 0, -1):
                moving = np.flatnonzero(depth >= level)
                for some in np.split(moving, np.flatnonzero(np.diff(np.cumsum(graph.degree[at[moving]]) // HELD)) + 1):
                    at[some] = _before(graph, begin, at[some], word[some], bit[some], words, *met[level - 1])
                yield query[moving], np.full(len(moving), level - 1, np.int32), graph.person[at[moving]]
            first += words

    return searched(dealt, trace, "query_no long, step int, person long")


def _before(graph: Graph, begin: np.ndarray, at: np.ndarray, word: np.ndarray, bit: np.ndarray, words: int, met: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The smallest neighbour of each node of `at` that its bit came to in the level that `met` and `masks` hold."""
    degree = graph.degree[at]
    starts = np.cumsum(degree) - degree
    row = np.repeat(np.arange(len(at)), degree)
    near = graph.src[begin[at][row] + np.arange(len(row)) - starts[row]].astype(np.int64)
    key = near * words + word[row]
    place = np.minimum(np.searchsorted(met, key), len(met) - 1)
    held = (met[place] == key) & ((masks[place] & bit[row]) != 0)
    return np.minimum.reduceat(np.where(held, near, len(graph.person)), starts)


def largest_groups(edges: DataFrame, weights: list[int]) -> DataFrame:
    """tag, weight, size: of each tag's edges (tag, src, dst, weight), the nodes of the largest group that those of at least each of `weights` join; no rows where none is left.

    A tag's edges are in one task, which joins them from the largest weight down.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.select(F.col("tag").alias("comp"), F.lit(0).alias("part"), "src", "dst", F.col("weight").cast("long").alias("weight")).repartition(parts, "comp").sortWithinPartitions("comp")
    falling = sorted(set(weights), reverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, src, dst, tag, weight in _gathered(batches, ["comp", "weight"]):
            ids = np.unique(np.concatenate([src, dst.to_numpy()]))
            ends = [group * len(ids) + np.searchsorted(ids, end) for end in (src, dst.to_numpy())]
            nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
            a, b, weight = at[: len(src)], at[len(src) :], weight.to_numpy()
            owner = nodes // len(ids)
            first, label, above = np.flatnonzero(np.diff(owner, prepend=-1)), np.arange(len(nodes)), np.inf
            tags = tag.to_numpy()[np.flatnonzero(np.diff(group, prepend=-1))]
            for least in falling:
                new = (weight >= least) & (weight < above)
                label, above = _joined(label, a[new], b[new]), least
                size = np.maximum.reduceat(np.bincount(label, minlength=len(nodes)), first)
                some = size > 1
                yield pa.RecordBatch.from_arrays([pa.array(tags[some]), pa.array(np.full(some.sum(), least)), pa.array(size[some])], ["tag", "weight", "size"])

    return rows.mapInArrow(run, "tag long, weight long, size long")


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's smallest node of its group (`label`), once the edges a, b join groups too."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(label, further := label[label]):
            label = further
