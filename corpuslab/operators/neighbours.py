"""Points within a distance of one another: exact, and without a row for each pair of a crowd."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.session import checkpoint

# executors get these functions with the tasks and need no package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points of a cell (about) and the most cells; groups of cells at least, and the most bytes of one as 32-bit numbers.
CELL_POINTS, MAX_CELLS, GROUPS, GROUP_BYTES = 512, 1000, 10, 8 << 20
#: Rows and columns of one matrix of distances, and pairs that are measured one by one at once.
ROWS, COLUMNS, PAIRS = 1024, 2048, 1 << 15


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length, without nulls, as 64-bit rows."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([p.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(p), -1) for p in parts if len(p)])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def neighbours(points: DataFrame, sample: np.ndarray, reach: float, enough: int) -> DataFrame:
    """``u, v, k`` for distinct points ``u, w, x`` (id, weight, vector of one length): what is needed of the pairs within ``reach``.

    With v null, the k of a u add up to the weight of its neighbours, itself
    left out.  With v, two points are linked, in one order: all pairs of which
    an end has less than ``enough`` weight in reach, and of the others
    as many as connect what all of them connect.

    Points go to the nearest of at most ``MAX_CELLS`` vectors of the sample.
    Groups of cells meet in one task, those that the triangle inequality keeps
    apart nowhere.  Matrix products tell near from far up to their rounding
    error; what is closer to the reach is measured in double precision.
    """
    spark = points.sparkSession
    n, dim = points.count(), sample.shape[1]
    pivots = np.unique(sample[: max(1, min(MAX_CELLS, n // CELL_POINTS))], axis=0)
    known = spark.sparkContext.broadcast(pivots)
    kind = points.schema["x"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = known.value.mean(0)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                own = squared(matrix(part.column("x")) - at, known.value - at)
                cell = own.argmin(1)
                near = np.sqrt(own[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(near)], ["u", "w", "x", "cell", "d"])

    placed = checkpoint(points.select("u", "w", "x").mapInArrow(assign, f"u long, w long, x {kind}, cell int, d double"))
    cells = {r["cell"]: (r["n"], r["d"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("d")).collect()}
    size = max(1, min(-(-n // GROUPS), GROUP_BYTES // (4 * dim)))
    plan, groups, units = _plan(cells, pivots, reach, size)
    table = F.broadcast(spark.createDataFrame(plan, "cell int, groups array<int>, units array<array<long>>"))
    part = F.pmod(F.xxhash64("u"), F.size("groups")).cast("int")
    dealt = placed.join(table, "cell").select("u", "w", "x", "cell", F.get("groups", part).alias("own"), F.explode(F.get("units", part)).alias("unit"))

    def meet(rows: pa.Table) -> pa.Table:
        col = lambda name: rows.column(name).to_numpy()
        a, b = divmod(int(rows.column("unit")[0].as_py()), groups)
        order = np.lexsort((col("u"), col("cell"), col("own") != a))
        u, v, k, has = _meet(*(c[order] for c in (col("u"), col("w"), matrix(rows.column("x")), col("cell"))), None if a == b else int((col("own") == a).sum()), known.value, reach, enough)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64(), mask=~has), "k": pa.array(k, pa.int64())})

    return dealt.repartition(min(2000, 2 * units), "unit").groupBy("unit").applyInArrow(meet, "u long, v long, k long")


def _plan(cells: dict[int, tuple[int, float]], pivots: np.ndarray, reach: float, size: int) -> tuple[list, int, int]:
    """For each cell the groups that its parts are in and the units (two groups, or one) that they go to; the number of groups and of units."""
    away = np.sqrt(squared(pivots, pivots))
    chain = [min(cells)]
    left = set(cells) - set(chain)
    while left:  # cells that follow one another are near
        ids = np.array(sorted(left))
        chain.append(int(ids[away[chain[-1], ids].argmin()]))
        left.remove(chain[-1])
    of: dict[int, list[int]] = {}
    group, held = 0, 0
    for c in chain:
        n = cells[c][0]
        if held and held + n > size:
            group, held = group + 1, 0
        pieces = -(-n // size)
        of[c] = list(range(group, group + pieces))
        group, held = group + pieces - 1, held + n if pieces == 1 else size
    radius = np.array([cells[c][1] for c in chain])
    slack = _slack(pivots - pivots.mean(0), radius.max())
    near = away[np.ix_(chain, chain)] <= radius[:, None] + radius[None] + reach + slack
    groups = group + 1
    member = np.zeros((len(chain), groups), np.float32)
    for k, c in enumerate(chain):
        member[k, of[c]] = 1
    meets = near.astype(np.float32) @ member > 0
    units = lambda k, g: [min(g, h) * groups + max(g, h) for h in np.flatnonzero(meets[k]).tolist()]
    plan = [(int(c), of[c], [units(k, g) for g in of[c]]) for k, c in enumerate(chain)]
    return plan, groups, len({x for _, _, lists in plan for one in lists for x in one})


def _slack(x: np.ndarray, more: float = 0.0) -> float:
    """More than what rounding does to a distance by matrix product among vectors no longer than the longest of ``x`` and ``more``."""
    return 4 * float(np.sqrt((x.shape[1] + 8) * 2.0**-52) * (np.sqrt((x * x).sum(1).max()) + more))


def _meet(u, w, x, cell, first: int | None, pivots, reach: float, enough: int) -> tuple[np.ndarray, ...]:
    """``u, v, k, has v`` of the pairs between the first rows and the others, or with None among all; rows of a cell follow one another."""
    n, dim = x.shape
    limit = reach * (1 + 1e-12)
    raw, centre = x, x.mean(0)
    x, pivots = x - centre, pivots - centre
    sums = (x * x).sum(1)
    slack = _slack(x, float(np.sqrt((pivots * pivots).sum(1).max())))
    own = np.concatenate([np.sqrt(((x[k : k + ROWS] - pivots[cell[k : k + ROWS]]) ** 2).sum(1)) for k in range(0, n, ROWS)])
    error = 4 * (dim + 16) * 2.0**-24 * float(sums.max())
    kind = np.float32 if error <= limit * limit / 16 else float
    error *= 1 if kind is np.float32 else 2.0**-28
    ones = np.ones(n)
    left = np.column_stack([x, sums, ones]).astype(kind)
    right = np.column_stack([-2 * x, ones, sums]).astype(kind)
    count, root = np.zeros(n, np.int64), np.arange(n)
    us, vs = [], []
    end = n if first is None else first
    edges = np.flatnonzero(np.diff(cell[:end])) + 1
    starts = [k for a, b in zip([0, *edges.tolist()], [*edges.tolist(), end]) for k in range(a, b, ROWS)]
    for lo, hi in zip(starts, [*starts[1:], end]):
        at, pivot = lo if first is None else first, pivots[cell[lo]]
        to = np.sqrt(np.maximum(sums[at:] + pivot @ pivot - 2 * (x[at:] @ pivot), 0))
        # the rows' ball round their pivot, and the plane halfway between two pivots
        keep = at + np.flatnonzero((to <= own[lo:hi].max() + limit + slack) & (to - own[at:] <= 2 * (limit + slack)))
        for c in range(0, len(keep), COLUMNS):
            js = keep[c : c + COLUMNS]
            d = (left[lo:hi] @ (right[js[0] : js[-1] + 1] if js[-1] - js[0] == len(js) - 1 else right[js]).T).ravel()
            hit = np.flatnonzero(d <= limit * limit + error)
            if not len(hit):
                continue
            i, j = np.divmod(hit, len(js))
            sure = d[hit] <= limit * limit - error
            if first is None:
                after = js[j] > i + lo
                i, j, sure = i[after], j[after], sure[after]
            unsure = np.flatnonzero(~sure)
            for k in range(0, len(unsure), PAIRS):
                some = unsure[k : k + PAIRS]
                sure[some] = np.sqrt(((raw[i[some] + lo] - raw[js[j[some]]]) ** 2).sum(1)) <= limit
            i, j = i[sure], j[sure]
            count[lo:hi] += np.bincount(i, w[js[j]], hi - lo).astype(np.int64)
            count[js] += np.bincount(j, w[i + lo], len(js)).astype(np.int64)
            i, j = i + lo, js[j]
            crowd = count + w >= enough
            both = crowd[i] & crowd[j]
            us.append(u[i[~both]])
            vs.append(u[j[~both]])
            _unite(root, i[both], j[both])
    tied, some = np.flatnonzero(root != np.arange(n)), np.flatnonzero(count)
    out_u = np.concatenate([*us, u[tied], u[some]])
    out_v = np.concatenate([*vs, u[root[tied]], u[some]])
    pairs = len(out_u) - len(some)
    return out_u, out_v, np.concatenate([np.zeros(pairs, np.int64), count[some]]), np.arange(len(out_u)) < pairs


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make one of the sets of each pair; ``root`` leads every element to the least of its set at once, before and after."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]
