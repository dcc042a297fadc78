"""Joins and searches over dense vectors in cells: exact neighbour pairs, and an inverted file for nearest rows.

Both deal vectors into cells around pivots or centroids from a bounded sample, send each vector only to the cells that it can have
partners in, and compare within a cell by matrix products. A task holds the members of one cell; others stream past them, sorted
by Spark. Cells of more than ``CELL_MOST`` members are cut into several.

Vectors have one length in a table. Null vectors and vectors of zeros are like nothing: they have no pairs and score 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.operators.graphs import cut_lineage
from notemill.operators.vectors import numbers

#: Members that a cell is meant to have, and those beyond which it is cut.
CELL_ROWS, CELL_MOST = 1000, 4000
#: Pivots of all groups together, and sampled rows for each; all of them lie on the driver and in each task.
MOST_PIVOTS, SAMPLED = 8192, 4
#: Scores that one matrix product makes at most.
STEP_SCORES = 4 << 20
#: Lists of an inverted file: about one for LIST_ROWS rows, up to MOST_LISTS; sampled rows for each, and rounds of k-means over them.
LIST_ROWS, MOST_LISTS, LIST_SAMPLE, ROUNDS = 500, 2048, 16, 8
SLACK = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] if rows.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def unit(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``v``, the vector at length one as doubles; those that have no direction are left out."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("v", v).withColumn("norm", norm).where("norm > 0").withColumn("v", F.transform("v", lambda x: x / F.col("norm"))).drop("norm")


def sliced(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches for which ``width`` scores a row stay within ``STEP_SCORES``."""
    most = max(1, STEP_SCORES // max(1, width))
    for batch in batches:
        for low in range(0, batch.num_rows, most):
            yield batch.slice(low, most)


def past(rows: DataFrame, cell: list[str], columns: list[str], meet: Callable, schema: str) -> DataFrame:
    """Runs ``meet`` over each cell: rows with ``asks`` 0 are its members, the others stream past in batches.

    ``meet(members, askers)`` gets two record batches of ``columns``, ``askers`` None once when all members are known,
    and gives record batches of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, members = None, [], None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in cell), batch.column("asks").to_pylist(), strict=True))
            at = 0
            while at < len(names):
                end = at
                while end < len(names) and names[end] == names[at]:
                    end += 1
                part, here, asks = batch.select(columns).slice(at, end - at), names[at][:-1], names[at][-1]
                if here != now:
                    if held:
                        yield from meet(joined(held), None)
                    now, held, members = here, [], None
                if not asks:
                    held.append(part)
                else:
                    if held:
                        members, held = joined(held), []
                        yield from meet(members, None)
                    if members is not None:
                        yield from meet(members, part)
                at = end
        if held:
            yield from meet(joined(held), None)

    def joined(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        return table.to_batches()[0]

    return rows.select(*dict.fromkeys([*cell, "asks", *columns])).repartition(*cell).sortWithinPartitions(*cell, "asks").mapInArrow(run, schema)


# ---- neighbour pairs ----


def collapsed(rows: DataFrame, key: str, by: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Different vectors of each group as ``group, rep, n, v``, and ``group, rep, key`` of those that several rows have.

    The smallest key stands for equal vectors, so that a vector which many rows share is compared once.
    """
    base = cut_lineage(unit(rows.select(F.col(by).alias("group"), F.col(key).alias("key"), vector), vector).select("group", "key", "v"))
    reps = cut_lineage(base.groupBy("group", "v").agg(F.min("key").alias("rep"), F.count("*").alias("n")))
    many = reps.where("n > 1").select(F.col("group").alias("g"), F.col("v").alias("w"), "rep")
    copies = base.join(many, base["group"].eqNullSafe(many["g"]) & (base["v"] == many["w"])).select("group", "rep", "key")
    return reps, copies


def pivots_of(reps: DataFrame) -> dict:
    """Pivots of each group with more than a cell's rows, sampled by hash in proportion to its rows."""
    n = reps.count()
    rows = max(CELL_ROWS, -(-n // MOST_PIVOTS))
    large = {r["group"]: -(-r["count"] // rows) for r in reps.groupBy("group").count().where(F.col("count") > rows).collect()}
    if not large:
        return {}
    share = min(1.0, SAMPLED / rows)
    sample = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("group", F.xxhash64("rep", F.lit(1)).alias("h"), "v")
    by: dict = {}
    for r in sorted(sample.collect(), key=lambda r: r.h):
        if r["group"] in large:
            by.setdefault(r["group"], []).append(r.v)
    return {g: spaced(np.array(vs, np.float64), large[g]) for g, vs in by.items()}


def spaced(sample: np.ndarray, most: int) -> np.ndarray:
    """``most`` rows of a sample at different places, in the sample's order."""
    return np.unique(sample, axis=0)[:most] if len(sample) <= most else sample[:most][np.sort(np.unique(sample[:most], axis=0, return_index=True)[1])]


def near_pairs(reps: DataFrame, eps: float) -> DataFrame:
    """``group, a, b, distance`` of ``group, rep, v``, unit vectors of a group within a cosine distance of eps, each pair once.

    On unit vectors that is a distance of r = √(2 eps). A vector belongs to its nearest pivot's cell. A partner in the cell of another
    pivot lies beyond the plane halfway between the two, so only cells whose plane is within r are asked, and of two cells
    the later one. What is left is compared in full.
    """
    if not 0 <= eps < 1:
        raise ValueError("eps must be from 0 to below 1")
    pivots, r = pivots_of(reps), np.sqrt(2 * eps)
    width = max(map(len, pivots.values()), default=1)
    group, kind = reps.schema["group"].dataType.simpleString(), reps.schema["rep"].dataType.simpleString()

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, width):
            cells, v = np.zeros(batch.num_rows, np.int32), matrix(batch.column("v"))
            for g, rows in groups(batch.column("group").to_pylist()).items():
                if g in pivots:
                    cells[rows] = squares(v[rows], pivots[g]).argmin(axis=1)
            yield batch.append_column("cell", pa.array(cells))

    placed = reps.select("group", "rep", "v").mapInArrow(home, f"group {group}, rep {kind}, v array<double>, cell int")
    placed = cut_lineage(placed.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(1 << 20)).cast("int")))
    crowded = placed.groupBy("group", "cell").count().where(F.col("count") > CELL_MOST).collect()  # no more than rows / CELL_MOST
    subs = {(c["group"], c["cell"]): -(-c["count"] // CELL_MOST) for c in crowded}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, width):
            v, cells, salts = matrix(batch.column("v")), batch.column("cell").to_numpy(), batch.column("salt").to_numpy()
            row, cell, sub, asks = [], [], [], []

            def add(rows, to, parts, asking):
                row.append(rows)
                cell.append(np.full(len(rows), to, np.int32))
                sub.append(np.broadcast_to(parts, len(rows)).astype(np.int32))
                asks.append(np.full(len(rows), asking, np.int32))

            for g, rows in groups(batch.column("group").to_pylist()).items():
                near = beyond(v[rows], pivots[g], cells[rows], r) if g in pivots else None
                for c in np.unique(cells[rows]):
                    own = rows[cells[rows] == c]
                    parts = subs.get((g, int(c)), 1)
                    mine = salts[own] % parts
                    add(own, c, mine, 0)
                    for s in range(1, parts):
                        add(own[mine < s], c, s, 1)
                if near is not None:
                    for c in np.flatnonzero(near.any(axis=0)):
                        for s in range(subs.get((g, int(c)), 1)):
                            add(rows[near[:, c]], c, s, 1)
            if not row:
                continue
            for low in range(0, len(all_rows := np.concatenate(row)), 5000):
                pick = slice(low, low + 5000)
                part = batch.select(["group", "rep", "v"]).take(pa.array(all_rows[pick]))
                for name, values in (("cell", cell), ("sub", sub), ("asks", asks)):
                    part = part.append_column(name, pa.array(np.concatenate(values)[pick]))
                yield part

    dealt = placed.mapInArrow(deal, f"group {group}, rep {kind}, v array<double>, cell int, sub int, asks int")

    def meet(members: pa.RecordBatch, askers: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        m, keys = matrix(members.column("v")), members.column("rep").to_numpy(zero_copy_only=False)
        left, left_keys = (m, keys) if askers is None else (matrix(askers.column("v")), askers.column("rep").to_numpy(zero_copy_only=False))
        step = max(1, STEP_SCORES // len(m))
        for low in range(0, len(left), step):
            far = 1 - left[low : low + step] @ m.T
            hit = far <= eps
            if askers is None:
                hit &= np.arange(len(m)) > np.arange(low, low + len(far))[:, None]
            i, j = np.nonzero(hit)
            if len(i):
                a, b = left_keys[low + i], keys[j]
                first = members.column("group").slice(0, 1)
                type_ = members.schema.field("rep").type
                yield pa.RecordBatch.from_arrays([pa.array(first.to_pylist() * len(i), first.type), pa.array(np.minimum(a, b), type_), pa.array(np.maximum(a, b), type_), pa.array(far[i, j])], names=["group", "a", "b", "distance"])

    return past(dealt, ["group", "cell", "sub"], ["group", "rep", "v"], meet, f"group {group}, a {kind}, b {kind}, distance double")


def neighbour_pairs(rows: DataFrame, key: str, by: str, eps: float, vector: str = "embedding") -> DataFrame:
    """Pairs of a group's rows within a cosine distance of eps: ``by, a, b, distance`` with a before b. Keys have to be different."""
    reps, copies = collapsed(rows, key, by, vector)
    copies = cut_lineage(copies)
    near = near_pairs(reps, eps)
    for end in ("a", "b"):
        held = copies.select(F.col("rep").alias("r"), "key")
        near = near.join(held, near[end] == held["r"], "left").withColumn(end, F.coalesce("key", end)).drop("r", "key")
    near = near.select("group", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    others = copies.select(F.col("rep").alias("r"), F.col("key").alias("b"))
    equal = copies.join(others, copies["rep"] == others["r"]).where("key < b").select("group", F.col("key").alias("a"), "b", F.lit(0.0).alias("distance"))
    return near.unionByName(equal).withColumnRenamed("group", by)


def dbscan(rows: DataFrame, key: str, by: str, eps: float, least: int, components: Callable, vector: str = "embedding") -> DataFrame:
    """``key, cluster``: density clusters of each group, numbered over all groups by their first core row, -1 for noise.

    Equal vectors are one point that counts for all of its rows, so pairs of copies are never made.
    """
    reps, copies = collapsed(rows, key, by, vector)
    near = cut_lineage(near_pairs(reps, eps).select("a", "b"))
    sides = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = reps.select(F.col("rep").alias("r"), "n")
    around = sides.join(weights, sides["b"] == weights["r"]).groupBy("a").agg(F.sum("n").alias("around"))
    cores = reps.join(around, reps["rep"] == around["a"], "left").where(F.col("n") - 1 + F.coalesce("around", F.lit(0)) >= least - 1).select(F.col("rep").alias("core"))
    cores = cut_lineage(cores)
    inner = sides.join(cores, sides["a"] == cores["core"], "left_semi").join(cores.select(F.col("core").alias("c")), F.col("b") == F.col("c"), "left_semi")
    labels = components(inner)
    labelled = cores.join(labels, cores["core"] == labels["v"], "left").select("core", F.coalesce("label", "core").alias("label"))
    numbered = cut_lineage(labelled.join(numbers(labelled.select("label").distinct(), "label", "cluster"), "label").select("core", "cluster"))
    border = sides.join(numbered, sides["b"] == numbered["core"]).groupBy("a").agg(F.min("cluster").alias("reached"))
    held = copies.select(F.col("key").alias("k"), "rep")
    out = rows.select(key).join(held, rows[key] == held["k"], "left").select(key, F.coalesce("rep", key).alias("rep"))
    out = out.join(numbered, out["rep"] == numbered["core"], "left").join(border, out["rep"] == border["a"], "left")
    return out.select(key, F.coalesce("cluster", "reached", F.lit(-1)).alias("cluster"))


def groups(values: list) -> dict:
    """Rows of each value."""
    out: dict = {}
    for i, g in enumerate(values):
        out.setdefault(g, []).append(i)
    return {g: np.array(rows) for g, rows in out.items()}


def squares(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors."""
    return np.maximum(2 - 2 * v @ p.T, 0)


def beyond(v: np.ndarray, p: np.ndarray, own: np.ndarray, r: float) -> np.ndarray:
    """For each vector, the cells after its own whose half-space is within r."""
    d = squares(v, p)
    apart = 2 * np.sqrt(squares(p, p))[own]
    depth = (d - d[np.arange(len(v)), own][:, None]) / np.where(apart > 0, apart, 1)  # distance to the plane halfway
    return (depth <= r + SLACK) & (np.arange(len(p)) > own[:, None])


# ---- inverted file ----


def centroids_of(rows: DataFrame, key: str) -> np.ndarray:
    """Centroids by k-means over a sample by hash: some LIST_SAMPLE rows for each list."""
    n = rows.count()
    k = max(1, min(MOST_LISTS, n // LIST_ROWS))
    share = min(1.0, LIST_SAMPLE * k / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 20)) <= int(share * (1 << 20))).select(F.xxhash64(key, F.lit(4)).alias("h"), "v").collect()
    found = np.array([r.v for r in sorted(sample, key=lambda r: r.h)], np.float64)
    if not len(found):
        return np.zeros((0, 0))
    centers = np.unique(found[:k], axis=0)
    for _ in range(ROUNDS):
        of = squares(found, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, found)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centers)
    return centers


class InvertedFile:
    """An index of unit vectors: every row in the list of its nearest centroid.

    Lists of more than CELL_MOST rows are cut into several parts. The distance of each list's farthest row from its centroid, the
    residual bound, lies beside the centroids.
    """

    def __init__(self, rows: DataFrame, key: str, vector: str = "embedding"):
        base = cut_lineage(unit(rows.select(F.col(key).alias("key"), vector), vector).select("key", "v"))
        self.centers = centers = centroids_of(base, "key")
        self.kind = kind = base.schema["key"].dataType.simpleString()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, len(centers)):
                d = squares(matrix(batch.column("v")), centers)
                of = d.argmin(axis=1)
                yield batch.append_column("list", pa.array(of.astype(np.int32))).append_column("residual", pa.array(np.sqrt(d[np.arange(len(of)), of])))

        placed = cut_lineage(base.mapInArrow(place, f"key {kind}, v array<double>, list int, residual double"))
        bounds = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("residual").alias("far")).collect()  # a row for each list
        self.parts, self.far = np.zeros(len(centers), np.int64), np.full(len(centers), -np.inf)
        for b in bounds:
            self.parts[b["list"]], self.far[b["list"]] = -(-b.n // CELL_MOST), b.far
        parts = F.get(F.array(*[F.lit(int(x)) for x in self.parts] or [F.lit(1)]), F.col("list"))
        self.rows = placed.withColumn("part", F.pmod(F.xxhash64("key", F.lit(5)), parts).cast("int"))

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """``query_id, key, score, rank``: the rows of largest cosine for each of ``query_id, vector``, by score and key.

        ``probes`` lists are searched. With ``exact``, the lists are searched that the residual bound can't rule out: those
        whose centroid is no farther from the query than the k-th best row found so far plus the list's farthest residual.
        """
        asked = cut_lineage(unit(queries, "vector").select("query_id", "v"))
        first = self.met(self.sent(asked.withColumn("reach", F.lit(None).cast("double")), probes), k)
        if exact:
            first = cut_lineage(first)
            kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            # scores are rounded to six places and from 0 on, so rows a little farther may still tie; with fewer than k rows all lists are asked
            reach = F.when((F.col("n") >= k) & (F.col("least") > 2e-6), F.sqrt(2 - 2 * (F.col("least") - 1e-6))).otherwise(2.0)
            again = asked.join(kth, "query_id", "left").select("query_id", "v", F.coalesce(reach, F.lit(2.0)).alias("reach"))
            rest = self.met(self.sent(again, probes), k)
            first = best(first.select("query_id", "key", "score").unionByName(rest.select("query_id", "key", "score")), k)
        return first

    def sent(self, asked: DataFrame, probes: int) -> DataFrame:
        """Queries with the parts of lists that they ask: the nearest ones without ``reach``, else all others within it."""
        centers, parts, far = self.centers, self.parts, self.far

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, len(centers)) if len(centers) else ():
                d = np.sqrt(squares(matrix(batch.column("v")), centers))
                d[:, parts == 0] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                mask = np.zeros(d.shape, bool)
                np.put_along_axis(mask, near, True, axis=1)
                reach = batch.column("reach")
                if reach.null_count == 0:
                    mask = ~mask & (d <= reach.to_numpy()[:, None] + far + SLACK)
                row, of = np.nonzero(mask & (parts > 0))
                times = parts[of]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, of = np.repeat(row, times), np.repeat(of, times)
                for low in range(0, len(row), 5000):
                    pick = slice(low, low + 5000)
                    yield batch.select(["query_id", "v"]).take(pa.array(row[pick])).append_column("list", pa.array(of[pick].astype(np.int32))).append_column("part", pa.array(part[pick].astype(np.int32)))

        kind = asked.schema["query_id"].dataType.simpleString()
        return asked.select("query_id", "v", "reach").mapInArrow(run, f"query_id {kind}, v array<double>, list int, part int")

    def met(self, sent: DataFrame, k: int) -> DataFrame:
        """The k best rows of each query among those that it was sent to; each part of a list gives its own k best only."""
        kind, asker = self.kind, sent.schema["query_id"].dataType.simpleString()
        none = F.lit(None)
        members = self.rows.select("list", "part", F.lit(0).alias("asks"), "key", none.cast(asker).alias("query_id"), "v")
        both = members.unionByName(sent.select("list", "part", F.lit(1).alias("asks"), none.cast(kind).alias("key"), "query_id", "v"))

        def meet(rows: pa.RecordBatch, askers: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if askers is None:
                return
            order = np.argsort(rows.column("key").to_numpy(zero_copy_only=False), kind="stable")
            m, keys = matrix(rows.column("v"))[order], rows.column("key").take(pa.array(order))
            q = matrix(askers.column("v"))
            step = max(1, STEP_SCORES // len(m))
            for low in range(0, len(q), step):
                scores = np.floor(np.clip(q[low : low + step] @ m.T, 0, 1) * 1e6 + 0.5) / 1e6
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # ties by key
                row = np.repeat(np.arange(len(scores)), top.shape[1])
                at = top.ravel()
                yield pa.RecordBatch.from_arrays([askers.column("query_id").take(pa.array(low + row)), keys.take(pa.array(at)), pa.array(scores[row, at])], names=["query_id", "key", "score"])

        return best(past(both, ["list", "part"], ["query_id", "key", "v"], meet, f"query_id {asker}, key {kind}, score double"), k)


def best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
