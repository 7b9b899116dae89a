"""The most similar vectors of every vector, by multi-index hashing over the cluster.

Each vector gets a learned binary code. A table of each substring of the code routes vectors by a prefix of the
substring, as long as makes cells of a bounded size: to the vector's own cell, and to the cells behind those bits of
the prefix that its projections are least sure of. In a cell, buckets of codes within a Hamming radius are compared
by cosines, in blocks, and the best of each vector are kept while pairs come; a pair is given out only by the first
of the cells that both stand in. Vectors whose codes agree in two of three substrings everywhere (near copies of one
another) are coded again around their own centre. Equal directions are one vector in the search and get their
results back at the end, so that a class of any size costs no more than its rows.

Two vectors whose codes differ in at most two bits share a whole substring, and so meet for sure; beyond that radius
vectors meet by the probed bits, with the recall that the README gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm import codes
from loomstead.llm.codes import Cell, Index, class_keys, meets_first, restored, shortened, unit_rows
from loomstead.session import rows_known_below, write_once

#: Vectors of each model that its index is learned from, and bytes that all models' samples share.
SAMPLE, SAMPLE_BYTES = 8_192, 256 << 20
#: Models, from the largest, that get a learned index; smaller ones get a drawn rotation of the same search.
LEARNED = 256
#: Further large models, after counting, whose sizes are sent to all executors; more are joined.
FEW_MODELS = 100_000
#: Rows of a cell; fewer where vectors are so long that they would take more than these bytes.
CELL, CELL_BYTES = 32_768, 48 << 20
#: Cosines above this are told apart neither by short forms nor by single precision.
ALIKE = 0.999995
#: Parts of the hash space that samples are taken by.
_PARTS = 1 << 30
#: What goes before a shortened vector: its model, the bits of the number of that model's rows (0: all in one cell), its class.
_HEAD = np.dtype([("model", "<i8"), ("log", "<i2"), ("mark", "<u4")])


@dataclass(frozen=True)
class Plan:
    """The indexes of learned models by their key, and how large cells are."""

    numbers: dict[int, int]
    logs: dict[int, int]
    indexes: tuple[Index, ...]
    cell: int
    whole: int

    def size(self, dims: int) -> int:
        return max(64, min(self.cell, CELL_BYTES // (dims * 3 // 2 + 16)))


def usable(df: DataFrame, vector: str, dims: str) -> DataFrame:
    """Rows whose vector has as many elements as stated, all finite and not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(v.isNotNull() & (F.size(v) == F.col(dims)) & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))


def _by_dims(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a batch by the length of their vectors, and their unit vectors."""
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        flat = batch.column("vector").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, unit_rows(flat.reshape(len(rows), int(d)))


def _classed(rows: DataFrame) -> DataFrame:
    """(id, model, c1, c2): the class of equal directions that each vector belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, model = batch.column("id").to_numpy(), batch.column("model").to_numpy()
            for which, units in _by_dims(batch):
                first, second = class_keys(units)
                columns = [ids[which], model[which], first ^ model[which], second + model[which]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "model", "c1", "c2"])

    return rows.mapInArrow(run, "id long, model long, c1 long, c2 long")


def _plan(rows: DataFrame, sizes: list, cell: int, whole: int) -> Plan:
    """Learn an index of each large model, from a sample by hash: a bounded number of vectors, whatever the size."""
    if not sizes:
        return Plan({}, {}, (), cell, whole)
    counts = {r.model: r.n for r in sizes}
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(m, n) for m, n in counts.items()], "model long, n long")
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"), F.lit(float(SAMPLE_BYTES // len(counts))) / (F.col("n") * F.col("dims") * 4))
    part = F.pmod(F.xxhash64("id", "vector"), F.lit(_PARTS))
    # At most LEARNED rows.
    sample = rows.join(F.broadcast(wanted), "model").where(part < share * _PARTS).select("model", "dims", "vector").toArrow()
    plan = Plan({}, {}, (), cell, whole)
    numbers, indexes = {}, []
    model = sample.column("model").to_numpy()
    for m in sorted(counts):
        which = np.flatnonzero(model == m)
        if not len(which):
            continue
        flat = sample.column("vector").take(pa.array(which)).combine_chunks()
        flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False)
        units = restored(shortened(unit_rows(flat.reshape(len(which), -1))))
        numbers[m] = len(indexes)
        indexes.append(codes.build_index(units, counts[m], plan.size(units.shape[1])))
    return Plan(numbers, {m: n.bit_length() for m, n in counts.items()}, tuple(indexes), cell, whole)


def _index(plan: Plan, model: int, log: int, dims: int) -> Index:
    number = plan.numbers.get(model)
    # Rows of models without a learned index are rounded up to a power of two.
    return codes.drawn_index(dims, 1 << log, plan.size(dims)) if number is None else plan.indexes[number]


def _routed(rows: DataFrame, plan: Plan) -> DataFrame:
    """Each vector, shortened, to its cells of each table; of copies in a batch only the first.

    rows have `n`, the rows of their model if that is large and not in the plan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: set[tuple[int, int]] = set()
        for batch in batches:
            ids, model = batch.column("id").to_numpy(), batch.column("model").to_numpy()
            size = batch.column("n").fill_null(0).to_numpy()
            for of_dims, every in _by_dims(batch):
                keys = np.stack(class_keys(every), axis=1)
                for m in np.unique(model[of_dims]):
                    inside = np.flatnonzero(model[of_dims] == m)
                    _, first, times = np.unique(keys[inside], axis=0, return_index=True, return_counts=True)
                    # Classes met twice in a batch are remembered, so that hot ones come once from a task.
                    fresh = np.ones(len(first), bool)
                    for i in np.flatnonzero(times > 1) if not hot else range(len(first)):
                        key = (int(m), *keys[inside[first[i]]].tolist())
                        if key in hot:
                            fresh[i] = False
                        elif times[i] > 1:
                            hot.add(key)
                    inside = inside[np.sort(first[fresh])]
                    which = of_dims[inside]
                    if not len(which):
                        continue
                    short = shortened(every[inside])
                    head = np.zeros(len(which), _HEAD)
                    log = plan.logs.get(int(m), int(size[which[0]]).bit_length())
                    head["model"], head["log"], head["mark"] = m, log, keys[inside, 0] & 0xFFFFFFFF
                    raw = np.hstack([head.view(np.uint8).reshape(len(which), -1), short])
                    if log:
                        units = restored(short)
                        cells = _index(plan, int(m), log, units.shape[1]).cells(units, int(m))
                    else:
                        cells = codes._cell(m, 63, 0, np.zeros((len(which), 1), np.int64))
                    row, slot = np.nonzero(_distinct(cells))
                    binary = pa.array([r.tobytes() for r in raw], pa.binary())
                    columns = [pa.array(cells[row, slot]), pa.array(ids[which][row]), binary.take(pa.array(row))]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "id", "raw"])

    return rows.mapInArrow(run, "cell long, id long, raw binary")


def _distinct(cells: np.ndarray) -> np.ndarray:
    """The slots that are in use and don't repeat one before."""
    out = cells != codes._NO_CELL
    for s in range(1, cells.shape[1]):
        out[:, s] &= (cells[:, :s] != cells[:, s : s + 1]).all(axis=1)
    return out


def similar_pairs(
    df: DataFrame,
    k: int = 5,
    least: float = 0.85,
    id: str = "chunk_pk",
    vector: str = "embedding",
    model: str = "embedding_model",
    dims: str = "embedding_dimensions",
    cell: int = CELL,
    whole: int = codes.SMALL,
) -> DataFrame:
    """Pairs (a, b, cosine), a < b, in which one is among the other's k most similar vectors of the same model.

    Ties go to the smaller id; pairs below `least` are left out. Null vectors, those with a null or infinite element,
    of another length than stated or all zero are no vectors; a null model is a model like any other. An empty table
    gives no pairs. Approximate: two vectors meet if their cells do (see above), and cosines are those of vectors
    shortened to 12 bits an element, right to about four decimals. cell: rows of a cell; whole: rows of a model up
    to which all are compared.
    """
    rows = usable(df, vector, dims).where(F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(model), F.lit("")), F.col(dims).cast("int")).alias("model"),
        F.col(dims).cast("int").alias("dims"),
        F.col(vector).cast("array<float>").alias("vector"),
    )
    classed = write_once(_classed(rows), "classes")
    sizes = classed.groupBy("model").agg(F.count("*").alias("n")).where(F.col("n") > whole)
    largest = sizes.orderBy(F.desc("n"), "model").limit(LEARNED + 1).collect()
    plan = _plan(rows, largest[:LEARNED], cell, whole)

    def search(key: tuple, group: pa.Table) -> pa.Table:
        here = key[0].as_py()
        raw = group.column("raw").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        wide = len(raw[0].as_py())
        raw = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(group), wide)
        head = np.ascontiguousarray(raw[:, : _HEAD.itemsize]).view(_HEAD).ravel()
        held = Cell(group.column("id").to_numpy(), head["mark"], raw[:, _HEAD.itemsize :])
        model, log = int(head["model"][0]), int(head["log"][0])
        if log:
            index = _index(plan, model, log, held.units.shape[1])
            margins = index.rotation.margins(held.units)
            a, b, cosine = held.best(k, least, margins > 0)
            cells = index.cells(held.units, model, margins)
            # Which of its like a near copy takes may differ from cell to cell, so these pairs are given out by each.
            once = meets_first(cells[a], cells[b], here) | (cosine > ALIKE)
            a, b, cosine = a[once], b[once], cosine[once]
        else:
            a, b, cosine = held.best(k, least)
        return pa.table([pa.array(held.ids[a]), pa.array(held.ids[b]), pa.array(cosine)], ["a", "b", "cosine"])

    sized = rows.withColumn("n", F.lit(None).cast("long"))
    if len(largest) > LEARNED:
        others = write_once(sizes, "models")
        sized = rows.join(F.broadcast(others) if rows_known_below(others, FEW_MODELS) else others, "model", "left")
    near = _routed(sized, plan).groupBy("cell").applyInArrow(search, "a long, b long, cosine double")
    return _given_back(near, classed, k)


def _given_back(near: DataFrame, classed: DataFrame, k: int) -> DataFrame:
    """From the k best of each searched vector in each cell to the pairs of all members of their classes."""
    key = ["model", "c1", "c2"]
    classes = classed.groupBy(*key).agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = write_once(classed.join(classes.select(*key, "lead"), key).select("id", "lead"), "members")
    followers = members.where("id <> lead")
    led = (
        near.join(followers.select(F.col("id").alias("a"), F.col("lead").alias("lead_a")), "a", "left")
        .join(followers.select(F.col("id").alias("b"), F.col("lead").alias("lead_b")), "b", "left")
        .select(F.coalesce("lead_a", "a").alias("a"), F.coalesce("lead_b", "b").alias("b"), "cosine")
        .where("a <> b")
    )
    # At most k of each cell for a vector, so these lists are bounded; a class that was met twice counts once.
    lists = led.groupBy("a").agg(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("far"), "b"))).alias("all"))
    once = F.filter("all", lambda x, i: ~F.exists(F.slice("all", 1, i), lambda y: y.b == x.b))
    best = lists.select("a", F.slice(once, 1, k).alias("top"))
    first = Window.partitionBy("lead").orderBy("id")
    smallest = members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    smallest = smallest.groupBy("lead").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    outer = (
        best.select("a", F.explode("top").alias("x"))
        .select("a", F.col("x.far").alias("far"), F.col("x.b").alias("b"))
        .join(smallest.select(F.col("lead").alias("b"), "ids"), "b", "left")
        .select("a", "far", F.explode(F.coalesce(F.slice("ids", 1, k), F.array("b"))).alias("b"))
    )
    own = smallest.select(F.col("lead").alias("a"), F.lit(-1.0).alias("far"), F.explode("ids").alias("b"))
    listed = outer.unionByName(own).groupBy("a").agg(F.array_sort(F.collect_set(F.struct("far", "b"))).alias("top"))
    # A class's list serves all its members, each without itself.
    each = listed.join(members.select(F.col("lead").alias("a"), "id"), "a", "left")
    each = each.select(F.coalesce("id", "a").alias("q"), "top")
    each = each.select("q", F.explode(F.slice(F.filter("top", lambda x: x.b != F.col("q")), 1, k)).alias("x"))
    pairs = each.select(
        F.least("q", "x.b").alias("a"), F.greatest("q", "x.b").alias("b"), (-F.col("x.far")).alias("cosine")
    )
    return pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
