"""Near-duplicate embeddings by counting collisions on one-dimensional projections.

Every vector is projected on many random lines.  On a line, the points within a window around a query
collide with it; close vectors collide on nearly all lines.  Counting the collisions of all pairs
would cost the square of the input on every line, so tables of cells come first: each table cuts a
few lines of its own into intervals, and only vectors in the same cell of some table are counted.
Inside a cell, vectors are sorted along the first counting line and each looks only at the window
around itself; pairs whose count over all counting lines passes a bound are verified exactly.

Window, bound, lines and tables follow from the wanted recall for a pair that is just close enough,
and from the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import mix, stored
from leadloom.llm.components import components

MIN_COSINE = 0.9
# Wanted share of the pairs at exactly MIN_COSINE; closer pairs are found more surely.
RECALL = 0.95
COUNTING_LINES = 24
# Vectors without near ones that should share a cell with a vector, on average.
STRANGERS = 200
# Width of a cell, and half the window, in standard deviations of such a pair on a line.
CELL = 4.0
WINDOW = 2.0
# Vectors of one cell that a task compares; larger cells are cut into parts, compared two by two.
CELL_VECTORS = 4096
SEED = 20240229


def _normal(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


def same_interval(width: float) -> float:
    """Chance that two points a standard normal apart share an interval of random offset."""
    return (
        2 * _normal(width) - 1
        - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-(width**2) / 2))
    )


@dataclass
class Plan:
    tables: int
    lines: int  # of a table
    width: float
    window: float
    least_count: int

    @staticmethod
    def of(vectors: int, min_cosine: float, recall: float) -> Plan:
        near = math.sqrt(2 - 2 * min_cosine)  # distance of a pair just close enough
        close, far = same_interval(CELL), same_interval(CELL * near / math.sqrt(2))
        lines = max(1, math.ceil(math.log(max(vectors / STRANGERS, 1)) / -math.log(far)))
        # half of what may be missed is missed by the tables, half by the count
        missed = (1 - recall) / 2
        together = close**lines
        tables = max(1, math.ceil(math.log(missed) / math.log(1 - together)))
        hit = 2 * _normal(WINDOW) - 1
        chance, least = 0.0, COUNTING_LINES + 1
        while chance < 1 - missed:
            least -= 1
            chance += (
                math.comb(COUNTING_LINES, least)
                * hit**least * (1 - hit) ** (COUNTING_LINES - least)
            )
        return Plan(tables, lines, CELL * near, WINDOW * near, least)


def project(units: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Cells (one per table) and places on the counting lines; the lines follow from the seed."""
    random = np.random.default_rng([SEED, units.shape[1]])
    axes = random.standard_normal((units.shape[1], plan.tables * plan.lines + COUNTING_LINES))
    offsets = random.uniform(0, plan.width, plan.tables * plan.lines)
    places = units @ axes
    steps = np.floor((places[:, : len(offsets)] + offsets) / plan.width).astype(np.int64)
    steps = steps.view(np.uint64).reshape(len(units), plan.tables, plan.lines)
    cells = mix(np.arange(plan.tables, dtype=np.uint64) + np.uint64(units.shape[1] << 16))
    cells = np.broadcast_to(cells, (len(units), plan.tables))
    for i in range(plan.lines):
        cells = mix(cells ^ steps[:, :, i])
    return cells.view(np.int64), places[:, len(offsets) :]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision, of length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    largest = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / largest
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Links:
    """Links among the vectors of some cells: how many rows each is linked to, and enough links to
    connect what is connected."""

    def __init__(self, size: int):
        self.degrees = np.zeros(size, np.int64)
        self.group = np.arange(size)
        self.kept: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.group[i] != i:
            self.group[i] = i = self.group[self.group[i]]
        return i

    def add(self, a: np.ndarray, b: np.ndarray, copies: np.ndarray) -> None:
        np.add.at(self.degrees, a, copies[b])
        np.add.at(self.degrees, b, copies[a])
        apart = self.group[a] != self.group[b]
        if not apart.any():
            return
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.group[max(x, y)] = min(x, y)
                self.kept.append((i, j))
        while not np.array_equal(up := self.group[self.group], self.group):
            self.group = up


def compare_cells(
    cells: np.ndarray, table: np.ndarray, parts: np.ndarray, crossed: np.ndarray,
    units: np.ndarray, copies: np.ndarray, plan: Plan, min_cosine: float,
) -> Links:
    """All links that the given cells are the first to see.  `parts` and `crossed` tell the two
    parts of a cell that was cut: only pairs across them count."""
    every, places = project(units, plan)
    order = np.lexsort((places[:, 0], cells))
    cells, table, parts, crossed = cells[order], table[order], parts[order], crossed[order]
    every, places = every[order], places[order]
    unit, number = units[order], copies[order]
    found = Links(len(cells))
    # the sorted line is also a counting line: its window is wider, to leave the count its say
    reach = 1.5 * plan.window
    query, step = np.arange(len(cells)), 0
    while len(query):
        step += 1
        query = query[query + step < len(cells)]
        other = query + step
        near = (cells[other] == cells[query]) & (places[other, 0] - places[query, 0] <= reach)
        query, other = query[near], other[near]
        a, b = query, other
        pair = (parts[a] != parts[b]) | ~crossed[a]
        a, b = a[pair], b[pair]
        for t in range(plan.tables):  # a cell of an earlier table has seen the pair
            if not len(a):
                break
            fresh = (table[a] <= t) | (every[a, t] != every[b, t])
            a, b = a[fresh], b[fresh]
        for i in range(0, len(a), 1 << 14):
            x, y = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
            count = (np.abs(places[x] - places[y]) <= plan.window).sum(axis=1)
            x, y = x[count >= plan.least_count], y[count >= plan.least_count]
            close = np.einsum("ij,ij->i", unit[x], unit[y]) >= min_cosine
            if close.any():
                found.add(x[close], y[close], number)
    back = Links(0)
    back.degrees = np.empty_like(found.degrees)
    back.degrees[order] = found.degrees
    back.kept = [(order[i], order[j]) for i, j in found.kept]
    return back


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    min_cosine: float = MIN_COSINE,
    recall: float = RECALL,
    cell_vectors: int = CELL_VECTORS,
) -> DataFrame:
    """`vec_id`, `n_links`, `component_id` (smallest vec_id reachable), `kept` (whether that is its
    own) for every row.

    Null and empty vectors, zero vectors and those with a null or non-finite component link with
    nothing; vectors of different lengths do not link either.  Equal vectors are one class: its
    rows are linked with each other and take the class's links.  A row without id takes part but
    gives no component its name.  Pairs found have their cosine checked in double precision.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))
    usable = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    # adding zero makes the two zeros one
    classes = stored(
        rows.where(usable)
        .groupBy(F.transform("vector", lambda x: x + F.lit(0).cast("float")).alias("vector"))
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vector-classes",
    )
    total = classes.count()
    if not total:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id")
            .alias("component_id"), F.lit(True).alias("kept"),
        )
    plan = Plan.of(total, min_cosine, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vectors = batch.column(0), batch.column(1)
            lengths = vectors.value_lengths().to_numpy()
            for length in np.unique(lengths):
                same = np.flatnonzero(lengths == length)
                for i in range(0, len(same), 1024):
                    part = pa.array(same[i : i + 1024])
                    cells, _ = project(matrix(vectors.take(part)), plan)
                    yield pa.RecordBatch.from_pydict({
                        "node": pa.array(np.repeat(nodes.take(part).to_numpy(), plan.tables)),
                        "number": pa.array(
                            np.tile(np.arange(plan.tables, dtype=np.int32), len(part))
                        ),
                        "cell": pa.array(cells.reshape(-1)),
                    })

    cells = stored(
        classes.select("node", "vector").mapInArrow(place, "node long, number int, cell long"),
        "vector-cells",
    )
    # cells of one vector have no pairs
    sizes = stored(
        cells.groupBy("cell", "number").agg(F.count("*").alias("size")).where("size > 1"),
        "cell-sizes",
    )
    splits = F.ceil(F.col("size") / cell_vectors).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("splits")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("splits") - 1))
    tasks = (
        cells.join(sizes, ["cell", "number"])
        .withColumn("splits", splits)
        .withColumn("part", own)
        .select("node", "number", "cell", "part", others.alias("other"))
        .withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
        .join(classes.select("node", "n", "vector"), "node")
    )
    # one sort brings the rows of a cell, or of two parts of one, together
    keys = ["cell", "number", "low", "high"]
    dealt = tasks.repartition(*keys).sortWithinPartitions(*keys).select(
        *keys, "part", "node", "n", "vector"
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, len(keys)):
            lengths = pc.list_value_length(whole.column("vector")).to_numpy()
            for length in np.unique(lengths):
                some = whole.filter(pa.array(lengths == length)).combine_chunks()
                column = some.column("vector").chunk(0)
                read = {n: some.column(n).to_numpy() for n in (*keys, "part", "node", "n")}
                # a number for each cell and each two of its parts
                named = mix(
                    read["cell"].view(np.uint64)
                    ^ (read["low"].astype(np.uint64) << np.uint64(32))
                    ^ read["high"].astype(np.uint64)
                )
                result = compare_cells(
                    named, read["number"], read["part"], read["low"] != read["high"],
                    matrix(column), read["n"], plan, min_cosine,
                )
                touched = np.flatnonzero(result.degrees)
                if not len(touched):
                    continue
                nodes = read["node"]
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(nodes[touched]), "links": result.degrees[touched],
                    "v": pa.array([None] * len(touched), pa.int64()),
                })
                if result.kept:
                    ends = np.array(result.kept)
                    yield pa.RecordBatch.from_pydict({
                        "node": pa.array(nodes[ends[:, 0]]),
                        "links": np.zeros(len(ends), np.int64),
                        "v": pa.array(nodes[ends[:, 1]]),
                    })

    found = stored(dealt.mapInArrow(link, "node long, links long, v long"), "vector-links")
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("v is not null").select(F.col("node").alias("u"), "v"))
    named = classes.select("node", "vector", "least", "n").join(roots, "node", "left").join(
        degrees, "node", "left"
    ).withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    settled = stored(
        named.join(names, "root").select(
            "vector", "component_id",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "vector-components",
    )
    tidy = F.transform("vector", lambda x: x + F.lit(0).cast("float"))
    linked = rows.where(usable).select("vec_id", tidy.alias("vector")).join(settled, "vector")
    alone = rows.where(~usable).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


def groups(batches: Iterator[pa.RecordBatch], key_columns: int) -> Iterator[pa.Table]:
    """The rows again, in tables that never cut through rows of equal key (the first columns)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        fresh = np.zeros(batch.num_rows, bool)
        for column in batch.columns[:key_columns]:
            values = column.to_numpy(zero_copy_only=False)
            fresh[1:] |= values[1:] != values[:-1]
        begins = np.flatnonzero(fresh)
        if len(begins):
            yield pa.Table.from_batches([*held, batch.slice(0, begins[-1])])
            held = [batch.slice(begins[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
