"""Whitening of embeddings from exact variances of dimensions and of their pair sums.

Entries become integers, and these are centred at the integer nearest to their mean before anything is squared. Tasks add up the squares of every
centred dimension and of the sum of every two, as integers; a second sum of d numbers gives the rest that the rounded centre leaves, so every
variance is an exact fraction. By polarisation, twice the covariance of two dimensions is the variance of their sum less their two
variances. The d x d covariances are assembled on the driver for `eigh`: d (d + 1) / 2 numbers, whatever the number of rows. A last
pass projects every row, and one more measures the covariance of what it gave.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry take no part and have no rows; so do vectors of
another length than most (of equally frequent lengths the largest counts). A null vec_id stays null, rows with equal vec_id each have their
rows. A component without variance (eigenvalue below `FLAT` of the trace) has null `whitened` and no part in identity_error; without any
variance `explained` is null too. Entries beyond 2**53 / 1024 in size are refused with an error. A deviation beyond a long is null in
`deviation` and told in `deviation_text`. An empty table has no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm.common import table

SCALE, OFFSET = 1024, 100_000
LARGEST = 2**53 / SCALE
COMPONENTS = 8
#: An eigenvalue below this share of the trace is rounding, not variance.
FLAT = 1e-13
#: Rows squared at a time; centred values up to `EXACT` keep their sums within 64 bits.
ROWS, EXACT = 2048, 2**24
OUT = "vec_id long, component int, n long, deviation long, deviation_text string, whitened double, explained double"


def usable(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors as doubles, without those that hold a null or non-finite entry."""
    value = F.col(column).cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("v"))


def integers(column, d: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of floor(1024 * c) + 100000."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"an entry beyond {LARGEST:g}")
    return np.floor(SCALE * flat).astype(np.int64) + OFFSET


def added(rows: DataFrame) -> DataFrame:
    """(i, total) of (i, s) with exact sums."""
    return rows.groupBy("i").agg(F.sum("s").alias("total"))


def dimension_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of every dimension; d + 1 numbers."""

    def run(batches):
        n, total = 0, [0] * d
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                low = integers(batch.column(0), d)
                high = low >> 20  # in two parts, so that no sum leaves 64 bits
                total = [t + (int(a) << 20) + int(b) for t, a, b in zip(total, high.sum(axis=0), (low & 0xFFFFF).sum(axis=0))]
        if n:
            yield sums_batch(range(d + 1), [*total, n])

    rows = added(vectors.select("v").mapInArrow(run, "i long, s decimal(38,0)")).collect()
    found = {r.i: int(r.total) for r in rows}
    return found.get(d, 0), [found.get(i, 0) for i in range(d)]


def sums_batch(places, sums) -> pa.RecordBatch:
    from decimal import Decimal

    return pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))], names=["i", "s"])


def squares(z: np.ndarray) -> np.ndarray:
    """Sums of squares of the columns and, after them, of the sums of every two columns."""
    d, parts = z.shape[1], [np.einsum("ij,ij->j", z, z)]
    for i in range(d - 1):
        both = z[:, i : i + 1] + z[:, i + 1 :]
        parts.append(np.einsum("ij,ij->j", both, both))
    return np.concatenate(parts)


def pair_squares(vectors: DataFrame, d: int, centre: list[int]) -> list[int]:
    """Sums of centred squares: of each dimension, then of each sum of two, (0, 1), (0, 2) and so on."""
    size = d * (d + 1) // 2

    def run(batches):
        total, some = [0] * size, False
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                z = integers(batch.slice(start, ROWS).column(0), d) - np.array(centre)
                if np.abs(z).max() > EXACT:  # such values are squared as Python's integers
                    z = z.astype(object)
                    found = np.concatenate([(z * z).sum(axis=0), *(((z[:, i : i + 1] + z[:, i + 1 :]) ** 2).sum(axis=0) for i in range(d - 1))])
                else:
                    found = squares(z)
                total, some = [t + int(f) for t, f in zip(total, found)], True
        if some:
            yield sums_batch(range(size), total)

    found = {r.i: int(r.total) for r in added(vectors.select("v").mapInArrow(run, "i long, s decimal(38,0)")).collect()}
    return [found.get(i, 0) for i in range(size)]


def covariances(n: int, rest: list[int], sums: list[int]) -> list[list[Fraction]]:
    """Exact covariances from the sums of squares and the sums `rest` of the centred dimensions."""
    d = len(rest)
    single = [n * q - r * r for q, r in zip(sums, rest)]
    made, at = [[Fraction(0)] * d for _ in range(d)], d
    for i in range(d):
        made[i][i] = Fraction(single[i], n * n)
        for j in range(i + 1, d):
            both = n * sums[at] - (rest[i] + rest[j]) ** 2
            made[i][j] = made[j][i] = Fraction(both - single[i] - single[j], 2 * n * n)
            at += 1
    return made


def vector_length(vectors: DataFrame) -> int | None:
    lengths = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return lengths[0].d if lengths else None


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, deviation_text, whitened, explained, identity_error) of every usable vector."""
    vectors = usable(embeddings, column)
    d = vector_length(vectors)
    if d is None:
        return vectors.sparkSession.createDataFrame([], f"{OUT}, identity_error double")
    vectors = vectors.where(F.size("v") == d)
    n, totals = dimension_sums(vectors, d)
    centre = [round(Fraction(s, n)) for s in totals]
    rest = [s - n * m for s, m in zip(totals, centre)]
    exact = covariances(n, rest, pair_squares(vectors, d, centre))
    matrix = np.array([[float(x) for x in row] for row in exact])
    values, directions = np.linalg.eigh(matrix)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    trace = float(sum(exact[i][i] for i in range(d)))
    alive = values > FLAT * trace if trace > 0 else np.zeros(len(values), bool)
    scaled = directions / np.sqrt(np.where(alive, values, 1.0))
    shift = np.array([float(Fraction(r, n)) for r in rest])
    explained = [float(v) / trace if trace > 0 else None for v in values]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                z = integers(part.column(1), d) - np.array(centre)
                white = (z - shift) @ scaled
                # n * x - S is n * z - rest; where its squares may leave 64 bits they are Python's integers
                far = n * (int(np.abs(z).max()) + 1)
                off = n * z.astype(object) - np.array(rest, object) if d * far * far >= 2**63 else n * z - np.array(rest)
                deviation = [int(x) for x in (off * off).sum(axis=1)]
                k, rows = len(values), part.num_rows
                repeat = np.repeat(np.arange(rows), k)
                mask = ~np.tile(alive, rows)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                    pa.array([x if x < 2**63 else None for x in deviation], pa.int64()).take(pa.array(repeat)),
                    pa.array([str(x) for x in deviation], pa.string()).take(pa.array(repeat)),
                    pa.array(white.ravel(), mask=mask), pa.array(explained * rows, pa.float64()),
                ], names=[f.split()[0] for f in OUT.split(", ")])

    def moments(batches):
        total = np.zeros((len(values), len(values)))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                white = (integers(batch.slice(start, ROWS).column(0), d) - np.array(centre) - shift) @ scaled
                total += white.T @ white
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int64()), pa.array(total.ravel())], names=["i", "s"])

    found = {r.i: r.total for r in added(vectors.select("v").mapInArrow(moments, "i long, s double")).collect()}
    second = np.array([found.get(i, 0.0) for i in range(len(values) ** 2)]).reshape(len(values), -1) / n
    error = np.abs(second - np.eye(len(values)))[np.ix_(alive, alive)]
    identity_error = float(error.max()) if alive.any() else None
    return vectors.mapInArrow(run, OUT).withColumn("identity_error", F.lit(identity_error).cast("double"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
