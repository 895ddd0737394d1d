"""Near duplicates among embeddings: tiles in order of the principal axes, compared axis by axis with bounds.

Vectors are rotated to their principal axes and cut into tiles along an order of the leading ones. A task holds a
group of tiles, and the tiles of later groups that can have a link with it, by their ends on the axes, pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipflow.llm import text as T
from shipflow.llm.graph import PLAIN, components
from shipflow.session import stored

THRESHOLD = 0.95
TILE_BYTES = 2 * 1024 * 1024  # of the vectors of a tile
TILE_ROWS = 4096  # at most
GROUP_TILES = 16  # of one task, which the tiles they are compared with pass by one at a time
GROUPS = 32  # at least, if there are as many tiles
BLOCK_ROWS = 512  # tiles are compared in blocks of so many rows
HEADS = (16, 32)  # leading axes after which the bounds are looked at
ORDERED_AXES, ORDER_BITS = 4, 10  # tiles follow an order that interleaves the bits of so many axes
BOX_AXES = 8  # ends of tiles are kept on so many axes
SLACK = 1e-9  # more than rounding in rotated coordinates can amount to; what remains is decided in the given ones
ROUGH_SLACK = 1e-5  # the same for single precision
TILES = (
    "tile long, grp int, size int, low array<double>, high array<double>, nodes binary, times binary, vectors binary"
)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a list column as rows, padded with zeros to dims."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten(), np.float64)
    sizes = np.asarray(column.value_lengths(), np.int64)
    rows = np.zeros((len(sizes), dims))
    rows[np.arange(dims) < sizes[:, None]] = values
    return rows


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither vanish nor overflow."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _moments(dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of outer products of a task's unit vectors, as one value."""
    total = np.zeros((dims, dims))
    for batch in batches:
        rows = _unit(_matrix(batch["vector"], dims))
        total += rows.T @ rows
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch["sums"]:
            sums = np.frombuffer(value.as_buffer(), np.float64)
            total = sums.copy() if total is None else total + sums
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Axes (columns) by falling second moment of unit vectors. At most 16 sums of dims * dims come to the driver."""
    sums = vectors.select("vector").mapInArrow(partial(_moments, dims), "sums binary")
    sums = sums.repartition(16).mapInArrow(_added, "sums binary")
    moments = sum(np.frombuffer(row.sums, np.float64) for row in sums.collect())
    _, axes = np.linalg.eigh(moments.reshape(dims, dims))
    return axes[:, ::-1]


def _code(turned: np.ndarray) -> np.ndarray:
    """A number whose order keeps together what is close on the leading axes: their bits, interleaved."""
    axes = min(ORDERED_AXES, turned.shape[1])
    cells = np.clip((turned[:, :axes] + 1) * (1 << (ORDER_BITS - 1)), 0, (1 << ORDER_BITS) - 1).astype(np.int64)
    code = np.zeros(len(turned), np.int64)
    for bit in reversed(range(ORDER_BITS)):
        for axis in range(axes):
            code = code << 1 | (cells[:, axis] >> bit & 1)
    return code


def _placed(dims: int, axes: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turned = _unit(_matrix(batch["vector"], dims)) @ axes[:, :ORDERED_AXES]
        yield batch.append_column("code", pa.array(_code(turned)))


def _tiled(dims: int, axes: np.ndarray, tile_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task, in their order, as tiles of at most tile_rows vectors of the same size."""
    group = TaskContext.get().partitionId()
    number = group << 32
    held: list[pa.RecordBatch] = []

    def tile(rows: pa.Table) -> pa.RecordBatch:
        nonlocal number
        number += 1
        matrix = _matrix(rows["vector"], dims)
        box = _unit(matrix) @ axes[:, :BOX_AXES]
        cells = [number - 1, group, rows["size"][0].as_py(), box.min(axis=0).tolist(), box.max(axis=0).tolist()]
        cells += [np.asarray(rows[name], np.int64).tobytes() for name in ("node", "times")] + [matrix.tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 3]
        names = ["tile", "grp", "size", "low", "high", "nodes", "times", "vectors"]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names)

    def full(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        rows = pa.Table.from_batches(held)
        sizes = np.asarray(rows["size"])
        cuts = [*(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(rows)]
        first = 0
        for cut in cuts:
            while cut - first >= tile_rows or first < cut and (last or cut < len(rows)):
                end = min(cut, first + tile_rows)
                yield tile(rows.slice(first, end - first))
                first = end
        held = rows.slice(first).to_batches()

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= tile_rows:
            yield from full(False)
    if held:
        yield from full(True)


class Tile:
    """Unit vectors of a tile, in given and in axis order, with what bounds need."""

    def __init__(self, row: dict, dims: int, axes: np.ndarray, heads: tuple[int, ...]):
        self.number, self.size, self.low, self.high = row["tile"], row["size"], np.array(row["low"]), np.array(row["high"])
        self.nodes, self.times = (np.frombuffer(row[name], np.int64) for name in ("nodes", "times"))
        self.unit = _unit(np.frombuffer(row["vectors"], np.float64).reshape(-1, dims))
        self.turned = self.unit @ axes
        squares = np.square(self.turned)
        self.rest = [np.sqrt(squares[:, head:].sum(axis=1)) for head in heads]
        # The product of two such rows is that of the leading axes and the most that the others can add.
        first = np.column_stack((self.turned[:, : heads[0]], self.rest[0])) if heads else self.turned
        self.rough = np.ascontiguousarray(first, np.float32)

    def may_reach(self, other: Tile, reach: float) -> bool:
        gaps = np.maximum(0.0, np.maximum(self.low - other.high, other.low - self.high))
        return self.size == other.size and float(np.sqrt(np.square(gaps).sum())) <= reach


def block_links(one: Tile, own: slice, two: Tile, its: slice, heads: tuple[int, ...], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of two blocks whose product may reach the threshold.

    The products of the leading axes and the most that the rest can add bound the cosine: first for all pairs in
    single precision, so that most blocks are left here, then for the pairs that remain after more axes. A block with
    many pairs left is multiplied as a whole.
    """
    hits = one.rough[own] @ two.rough[its].T >= np.float32(threshold - ROUGH_SLACK)
    if not hits.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.nonzero(hits)
    a, b = one.turned[own], two.turned[its]
    if len(i) * 16 > hits.size:
        return np.nonzero(a @ b.T >= threshold - SLACK)
    sums, done = 0.0, 0
    for step, head in enumerate((*heads, a.shape[1])):
        sums = sums + np.einsum("ij,ij->i", a[i, done:head], b[j, done:head])
        done = head
        keep = (sums + one.rest[step][own][i] * two.rest[step][its][j] if step < len(heads) else sums) >= threshold - SLACK
        i, j, sums = i[keep], j[keep], sums[keep]
    return i, j


def _forest(i: np.ndarray, j: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Least label of each row and column joined by pairs: rows are 0 .. n - 1, columns n .. n + m - 1."""
    labels = np.arange(n + m)
    ends, others = i, j + n
    while True:
        before = labels.copy()
        np.minimum.at(labels, ends, labels[others])
        np.minimum.at(labels, others, labels[ends])
        labels = labels[labels]
        if (labels == before).all():
            return labels[:n], labels[n:]


class Links:
    """What comparing one group of tiles has found: links of each node, and who is connected with whom."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, node: np.ndarray, links: np.ndarray, to: np.ndarray) -> None:
        self.parts.append((node, links, to))

    def batch(self) -> pa.RecordBatch:
        """One row per node and node it is connected with; links are in one of a node's rows."""
        node, links, to = (np.concatenate(part) for part in zip(*self.parts))
        self.parts = []
        order = np.lexsort((to, node))
        node, links, to = node[order], links[order], to[order]
        first = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (to[1:] != to[:-1]))))
        columns = [pa.array(node[first]), pa.array(np.add.reduceat(links, first)), pa.array(to[first])]
        return pa.RecordBatch.from_arrays(columns, ["node", "links", "to"])


def _pair(one: Tile, two: Tile, heads: tuple[int, ...], threshold: float, found: Links) -> None:
    """All links between two tiles, or within one."""
    same = one is two
    links_a = np.zeros(len(one.nodes), np.int64)
    links_b = links_a if same else np.zeros(len(two.nodes), np.int64)
    met = False
    for x in range(0, len(one.nodes), BLOCK_ROWS):
        for y in range(x if same else 0, len(two.nodes), BLOCK_ROWS):
            i, j = block_links(one, slice(x, x + BLOCK_ROWS), two, slice(y, y + BLOCK_ROWS), heads, threshold)
            if same and x == y:
                i, j = i[i < j], j[i < j]
            for part in range(0, len(i), 1 << 16):  # rounding aside, decided in the given coordinates
                p, q = i[part : part + (1 << 16)] + x, j[part : part + (1 << 16)] + y
                close = np.einsum("ij,ij->i", one.unit[p], two.unit[q]) >= threshold
                p, q = p[close], q[close]
                if not len(p):
                    continue
                met = True
                np.add.at(links_a, p, two.times[q])
                np.add.at(links_b, q, one.times[p])
                rows, columns = _forest(p - x, q - y, BLOCK_ROWS, BLOCK_ROWS)
                seen, others = np.unique(p), np.unique(q)
                # A label is a row of the first block, as each column met hangs on one.
                found.add(one.nodes[seen], np.zeros(len(seen), np.int64), one.nodes[x + rows[seen - x]])
                found.add(two.nodes[others], np.zeros(len(others), np.int64), one.nodes[x + columns[others - y]])
    if met:
        for tile, links in [(one, links_a)] if same else [(one, links_a), (two, links_b)]:
            linked = links > 0
            found.add(tile.nodes[linked], links[linked], tile.nodes[linked])


OUT_NODES = 200_000  # rows that a task holds back, to merge those of one node


def _compared(dims: int, axes: np.ndarray, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group its own tiles come first and stay, then the tiles that they are compared with, one at a time."""
    heads = tuple(head for head in HEADS if head < dims)
    reach, group, own, found = _reach(threshold), None, [], Links()
    for batch in batches:
        for row in batch.to_pylist():
            if row["task"] != group:
                group, own = row["task"], []
            tile = Tile(row, dims, axes, heads)
            if row["side"] == 0:
                own.append(tile)
                _pair(tile, tile, heads, threshold, found)
            for other in own[:-1] if row["side"] == 0 else own:
                if other.may_reach(tile, reach):
                    _pair(other, tile, heads, threshold, found)
            if sum(len(part[0]) for part in found.parts) > OUT_NODES:
                yield found.batch()
    if found.parts:
        yield found.batch()


def _reach(threshold: float) -> float:
    """How far unit vectors with a link can be apart."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)


def group_partners(tiles: DataFrame, threshold: float) -> DataFrame:
    """task, tile: the tiles of later groups that can hold a link with a tile of the group, by their ends on the axes."""
    reach = _reach(threshold)
    ends = [F.struct(*[F.min(F.get("low", F.lit(i))).alias(f"l{i}") for i in range(BOX_AXES)]).alias("low"),
            F.struct(*[F.max(F.get("high", F.lit(i))).alias(f"h{i}") for i in range(BOX_AXES)]).alias("high")]
    groups = tiles.groupBy(F.col("grp").alias("task"), F.col("size").alias("task_size")).agg(*ends)
    cell = lambda column: F.floor(column / reach)
    groups = groups.withColumn("cell", F.explode(F.sequence(cell(F.col("low.l0")) - 1, cell(F.col("high.h0")) + 1)))
    spans = tiles.select("tile", "grp", "size", F.col("low").alias("tile_low"), F.col("high").alias("tile_high"))
    first, last = F.get("tile_low", F.lit(0)), F.get("tile_high", F.lit(0))
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(first), cell(last))))
    both = groups.join(spans, "cell").filter((F.col("task") < F.col("grp")) & (F.col("task_size") == F.col("size")))
    gaps = F.lit(0.0)
    for i in range(BOX_AXES):  # fewer axes give nulls, which count as no gap
        gap = F.greatest(F.col(f"low.l{i}") - F.get("tile_high", F.lit(i)), F.get("tile_low", F.lit(i)) - F.col(f"high.h{i}"), F.lit(0.0))
        gaps = gaps + gap * gap
    return both.filter(gaps <= reach * reach).select("task", "tile").distinct()


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Tiles are large cells: Python gets them by their bytes, one or two at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(TILE_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors (vec_id, embedding).

    Two rows link when the cosine of their vectors is at least the threshold, which is above 0. Equal vectors are one
    node and count each other. Vectors of different sizes do not link; null, empty and zero vectors, and those with
    null or non-finite components, link with nothing and are their own component. component_id is the least vec_id
    reachable by links; kept says whether that is the row's own, so of rows that share it each is kept.
    """
    spark = vectors.sparkSession
    frame = T.columns_of(vectors, "vec_id", "embedding")
    frame = frame.withColumn("vector", F.col("embedding").cast("array<double>")).drop("embedding")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    nodes = frame.filter(good).groupBy("vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("times"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    alone = frame.filter(~good).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    dims = nodes.agg(F.max(F.size("vector"))).first()[0]
    if dims is None:
        return alone
    axes = principal_axes(nodes, dims)
    rows = min(tile_rows, max(64, TILE_BYTES // (8 * dims)))
    n_tiles = -(-nodes.count() // rows)
    n_groups = -(-n_tiles // max(1, min(GROUP_TILES, n_tiles // GROUPS)))
    with _few_rows(spark):
        placed = nodes.select("node", "times", F.size("vector").alias("size"), "vector")
        schema = "node long, times long, size int, vector array<double>, code long"
        placed = placed.mapInArrow(partial(_placed, dims, axes), schema)
        keys = ["size", "code", "node"]  # the last one cuts what is all in one place
        ordered = placed.repartitionByRange(n_groups, *keys).sortWithinPartitions(*keys).coalesce(n_groups)
        tiles = stored(ordered.mapInArrow(partial(_tiled, dims, axes, rows), TILES), "tiles", **PLAIN)
        partners = stored(group_partners(tiles, threshold), "partners")
        own = tiles.withColumns({"task": F.col("grp"), "side": F.lit(0)})
        others = partners.join(tiles, "tile").withColumn("side", F.lit(1))
        met = own.unionByName(others).repartitionById(n_groups, "task").sortWithinPartitions("task", "side", "tile")
        met = met.mapInArrow(partial(_compared, dims, axes, threshold), "node long, links long, to long")
        matched = stored(met, "matched", **PLAIN)
    counts = matched.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(matched.filter("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")).distinct())
    named = nodes.join(counts, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "label").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id"
    )
    rows = frame.filter(good).join(named, "vector")
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    return rows.select("vec_id", "n_links", "component_id", kept).unionByName(alone)
