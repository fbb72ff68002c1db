"""Approximate nearest neighbours by multiprobe p-stable hashing with exact reranking.

Each of two tables hashes a vector by projections (2-stable, in orthonormal sets) into cells.
The first cells of a code name a region, and rows are shuffled by region; a query is sent to the
regions it visits, which are perturbations of its own. Inside a region it visits buckets in the
order of their estimated success, and the rows of these are compared exactly.

A first round searches each query's home regions. The k-th neighbour found there says how far
its neighbours can lie at most, and the second round visits what that distance asks for. So
queries in tight groups stay at home, and scattered ones go as far as they must.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import cut, table

#: Hash tables, projections of a table at most, width of a cell, and cells of a projection (the outer ones are open).
TABLES, PROJECTIONS, WIDTH, CELLS = 2, 30, 1.0, 4
#: Projections whose cells are looked up together.
GROUP = 6
#: Estimated chance of each table that the visited regions hold a neighbour.
REGION_SUCCESS = 0.97
#: Standard deviations below a neighbour's mean gain down to which buckets are visited, in the first round and the second.
FIRST_DEVIATIONS, DEVIATIONS = -0.6, 0.1
#: Projections that name a region at most, so 4096 regions of a table.
MOST_LEAD = 6
#: Rows that are searched together: a 64th of all, but within these bounds.
LEAST_PART, MOST_PART = 4096, 262_144
#: Vectors of the bounded sample that the typical cosine of neighbours is estimated on.
SAMPLE = 2048
#: Cosine that neighbours are taken to have at most.
MOST = 0.95
#: Rows of a part that a query is compared with at least.
LEAST_ROWS = 48
#: Queries that are compared at a time.
STEP = 32
SEED = 11


# --- hashing -----------------------------------------------------------------------------


@dataclass
class Hasher:
    """Directions ``[table, projection, dimension]``, offsets, and the typical cosine of neighbours in a sample."""

    directions: np.ndarray
    shifts: np.ndarray
    cosine: float

    @property
    def projections(self) -> int:
        return self.directions.shape[1]

    def projected(self, unit: np.ndarray) -> np.ndarray:
        """``[row, table, projection]``."""
        return np.einsum("nd,tpd->ntp", unit, self.directions)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """``[row, table]``: two bits for each cell, the first projection highest."""
        cells = np.clip(np.floor((self.projected(unit) + self.shifts) / WIDTH + CELLS / 2), 0, CELLS - 1).astype(np.int64)
        code = np.zeros(cells.shape[:2], np.int64)
        for p in range(self.projections):
            code = code * CELLS + cells[:, :, p]
        return code

    def chances(self, unit: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``[row, table, projection, cell]``: chance of a neighbour's cell, and the log of its ratio to the cell's share of all rows.

        A unit vector at cosine c of one whose projection is x projects to a normal value of
        mean c x and variance 1 - c^2; a random one to a standard normal value.
        """
        edges = (np.arange(1, CELLS) - CELLS / 2) * WIDTH - self.shifts[..., None]
        c = np.clip(cosine, 0.0, MOST)[:, None, None, None]
        below = _normal_cdf((edges - c * self.projected(unit)[..., None]) / np.sqrt(1 - c * c))
        chance = np.maximum(np.diff(below, axis=-1, prepend=0.0, append=1.0), 1e-9)
        share = np.maximum(np.diff(_normal_cdf(edges), axis=-1, prepend=0.0, append=1.0), 1e-9)
        return chance, np.log(chance / share)

    def regions(self, unit: np.ndarray, cosine: np.ndarray, lead: int) -> np.ndarray:
        """``[row, table, region]``: whether the region, named by ``lead`` cells, is visited.

        From the home region on, perturbed ones follow by estimated success for each row in
        them, until their chances sum to ``REGION_SUCCESS``.
        """
        chance, ratio = self.chances(unit, cosine)
        joint, gain = np.ones((*chance.shape[:2], 1)), np.zeros((*chance.shape[:2], 1))
        for p in range(lead):
            joint = (joint[..., None] * chance[:, :, p, None, :]).reshape(*joint.shape[:2], -1)
            gain = (gain[..., None] + ratio[:, :, p, None, :]).reshape(*gain.shape[:2], -1)
        order = np.argsort(-gain, axis=-1)
        ordered = np.take_along_axis(joint, order, -1)
        visited = np.zeros(joint.shape, bool)
        np.put_along_axis(visited, order, np.cumsum(ordered, -1) - ordered < REGION_SUCCESS, -1)
        np.put_along_axis(visited, (self.codes(unit) >> self.shift(lead))[..., None], True, -1)
        return visited

    def shift(self, lead: int) -> int:
        """Bits of a code behind those of the region."""
        return 2 * (self.projections - lead)

    def scores(self, unit: np.ndarray, cosine: np.ndarray, t: int, deviations: float) -> tuple[np.ndarray, np.ndarray]:
        """For table ``t`` the gains ``[row, group, cells of the group]`` that sum to a bucket's, and the least gain that is visited.

        The sum over a neighbour's cells has a known mean and variance; buckets are visited
        from the best down to that mean less so many ``deviations``.
        """
        chance, ratio = self.chances(unit, cosine)
        chance, ratio = chance[:, t], ratio[:, t]
        mean = (chance * ratio).sum(2)
        spread = np.sqrt(np.maximum((chance * ratio * ratio).sum(2) - mean * mean, 0).sum(1))
        groups = -(-self.projections // GROUP)
        padded = np.zeros((len(unit), groups * GROUP, CELLS))
        padded[:, groups * GROUP - self.projections :] = ratio
        gains = np.zeros((len(unit), groups, 1))
        for p in range(GROUP):
            gains = (gains[..., None] + padded[:, p::GROUP, None, :]).reshape(len(unit), groups, -1)
        return gains.astype(np.float32), mean.sum(1) - deviations * spread - 1e-3


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, good to 1.5e-7."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    e = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z)
    return np.where(x < 0, (1 - e) / 2, (1 + e) / 2)


def new_hasher(dimension: int, cosine: float = 0.5, seed: int = SEED) -> Hasher:
    """Directions from orthonormal sets, as many as are needed, of length sqrt(dimension)."""
    rng = np.random.default_rng([seed, dimension])
    count = min(PROJECTIONS, dimension)
    rows: list[np.ndarray] = []
    while len(rows) < TABLES * count:
        some = min(dimension, TABLES * count - len(rows))
        rows += list(np.linalg.qr(rng.normal(size=(dimension, some)))[0].T)
    directions = np.array(rows).reshape(TABLES, count, dimension) * math.sqrt(dimension)
    return Hasher(directions, rng.uniform(-WIDTH / 2, WIDTH / 2, (TABLES, count)), cosine)


def neighbour_cosine(unit: np.ndarray, k: int = 5) -> float:
    """Median cosine of the k-th nearest other vector of a sample."""
    if len(unit) < 2:
        return 0.0
    near = np.sort(unit[:256] @ unit.T, axis=1)[:, ::-1]
    return float(np.clip(np.median(near[:, min(k, len(unit) - 1)]), 0.0, MOST))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row by a power of two, so that its largest component lies between 1/2 and 1 and no square overflows."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    return np.ldexp(vectors, -exponent[:, None])


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(1))


def _units(vectors: np.ndarray) -> np.ndarray:
    rows = scaled(vectors)
    return rows / _lengths(rows)[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 1))


# --- search ------------------------------------------------------------------------------


class Part:
    """Rows of a region that are searched together."""

    def __init__(self, hasher: Hasher, t: int, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids)
        self.hasher, self.t, self.ids = hasher, t, ids[order]
        self.rows = scaled(vectors[order])
        self.lengths = _lengths(self.rows)
        groups = -(-hasher.projections // GROUP)
        self.groups = [(codes[order] >> (2 * GROUP * (groups - 1 - g))) & (CELLS**GROUP - 1) for g in range(groups)]

    def search(self, queries: np.ndarray, cosine: np.ndarray, k: int, deviations: float = DEVIATIONS) -> tuple[list[tuple[int, int, float]], int]:
        """``(query's place, id, cosine)`` of the k best rows in visited buckets, and how many rows were compared.

        Where these have fewer than ``LEAST_ROWS`` rows, as many of the next buckets are visited. A query whose cosine
        isn't above 0 is compared with all rows of the part.
        """
        found: list[tuple[int, int, float]] = []
        compared = 0
        for at in range(0, len(queries), STEP):
            rows = scaled(queries[at : at + STEP])
            lengths, near = _lengths(rows), cosine[at : at + STEP]
            gains, least = self.hasher.scores(rows / lengths[:, None], near, self.t, deviations)
            for j, row in enumerate(rows):
                gain = gains[j, 0][self.groups[0]]
                for g in range(1, len(self.groups)):
                    gain += gains[j, g][self.groups[g]]
                few = min(len(gain), max(k, LEAST_ROWS)) if near[j] > 0 else len(gain)
                visited = np.flatnonzero(gain >= min(least[j], np.partition(gain, len(gain) - few)[len(gain) - few]))
                compared += len(visited)
                cosines = (self.rows[visited] * row).sum(1) / (self.lengths[visited] * lengths[j])
                if len(visited) > k:
                    enough = cosines >= np.partition(cosines, len(cosines) - k)[len(cosines) - k]
                    visited, cosines = visited[enough], cosines[enough]
                best = np.lexsort((self.ids[visited], -cosines))[:k]
                found += [(at + j, int(self.ids[visited[b]]), float(cosines[b])) for b in best]
        return found, compared


_KEYS = ["size", "tbl", "region", "part"]


def _search_parts(hashers, k: int, deviations: float, tally=None):
    """Searches the parts of rows ``size, tbl, region, part, asks, id, code, cosine, vector``, sorted by the first five.

    A part's rows come before the queries that ask it; queries stream through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in (*_KEYS, "asks")])
            cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            for start, end in zip(cuts, [*cuts[1:], batch.num_rows]):
                piece, key = batch.slice(start, end - start), tuple(keys[:4, start].tolist())
                if key != now:
                    now, held, part = key, [], None
                if not keys[4, start]:
                    held.append(piece)
                    continue
                if part is None:
                    if not held:
                        continue
                    own = pa.Table.from_batches(held).combine_chunks()
                    vectors = _matrix(own["vector"].combine_chunks())
                    part, held = Part(hashers.value[key[0]], key[1], np.asarray(own["id"]), np.asarray(own["code"]), vectors), [True]
                found, compared = part.search(_matrix(piece.column("vector")), np.asarray(piece.column("cosine")), k, deviations)
                if tally is not None:
                    tally.add(compared)
                names = np.asarray(piece.column("id"))
                columns = list(zip(*found)) if found else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[np.array(columns[0], np.int64)]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query", "entry", "score"]
                )

    return run


def _hash_rows(hashers, lead: int):
    """``size, tbl, region, part, id, code, vector`` of rows ``size, id, vector, salt``, once for each table; ``part`` holds the salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            for size in np.unique(sizes).tolist():
                own, hasher = batch.filter(pa.array(sizes == size)), hashers.value[size]
                codes = hasher.codes(_units(_matrix(own.column("vector"))))
                used = min(lead, hasher.projections)
                for t in range(TABLES):
                    code, n = codes[:, t], own.num_rows
                    arrays = [own.column("size"), pa.array(np.full(n, t, np.int32)), pa.array((code >> hasher.shift(used)).astype(np.int32)), own.column("salt"), own.column("id"), pa.array(code), own.column("vector")]
                    yield pa.RecordBatch.from_arrays(arrays, [*_KEYS, "id", "code", "vector"])

    return run


def _visit(hashers, lead: int, home: bool):
    """``size, tbl, region, id, cosine, vector``: each query at every region it visits, or at its home regions only.

    A null ``cosine`` stands for neighbours that may lie anywhere: all regions are visited.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            for size in np.unique(sizes).tolist():
                every, hasher = batch.filter(pa.array(sizes == size)), hashers.value[size]
                used = min(lead, hasher.projections)
                for at in range(0, every.num_rows, 256):
                    own = every.slice(at, 256)
                    unit = _units(_matrix(own.column("vector")))
                    if home:
                        cosine, visited = np.full(len(unit), hasher.cosine), np.zeros((len(unit), TABLES, CELLS**used), bool)
                        np.put_along_axis(visited, (hasher.codes(unit) >> hasher.shift(used))[..., None], True, -1)
                    else:
                        cosine = np.asarray(own.column("cosine").fill_null(0.0))
                        visited = hasher.regions(unit, cosine, used) | ~(cosine > 0)[:, None, None]
                    row, t, region = np.nonzero(visited)
                    take = pa.array(row)
                    arrays = [own.column("size").take(take), pa.array(t.astype(np.int32)), pa.array(region.astype(np.int32)), own.column("id").take(take), pa.array(cosine[row]), own.column("vector").take(take)]
                    yield pa.RecordBatch.from_arrays(arrays, ["size", "tbl", "region", "id", "cosine", "vector"])

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector, size`` of the rows with an id and a vector that is neither empty nor zero and has only finite components."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<float>" if kind == "array<float>" else "array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.coalesce(odd, F.lit(True)))
    return rows.where(F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.size(vector_col).alias("size"))


def _width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tally=None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found by cosine for every id divisible by ``every``.

    Candidates are all other ids with a usable vector (:func:`usable`) of the same length;
    nearest first, ties to the smaller id; fewer than k if there are fewer. Vectors are scaled
    by powers of two, so that very large and very small ones count. Equal vectors are one entry
    of the index, with the k + 1 smallest of their ids, so a vector with a third of the rows
    costs as much as any other; repeated rows are one. An id with several vectors is a candidate
    with each, asks with all of them, and is no candidate of its own. An empty table gives no
    rows; columns but the two named are not read.

    A region with more rows than are searched together is dealt into parts by a hash of the
    entry, and its queries go to every part. ``tally``, an accumulator, gets the number of
    comparisons.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    first = rows.distinct().withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    grouped = first.groupBy("vector", "size").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = cut(grouped.withColumn("entry", F.monotonically_increasing_id()), "entries")
    asked = rows.where(F.col("vec_id") % every == 0).distinct().join(entries.select("vector", "entry"), "vector").select("vec_id", "entry")
    asked = cut(asked, "asked")
    queries = cut(entries.join(asked.select("entry").distinct(), "entry").select("size", F.col("entry").alias("id"), "vector"), "queries")

    hashers: dict[int, Hasher] = {}
    sample = entries.select("size", "vector", F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("entry"))).alias("n"))
    by_size: dict[int, list] = {}
    for row in sample.where(F.col("n") <= SAMPLE).select("size", "vector").collect():
        by_size.setdefault(row["size"], []).append(row["vector"])
    for size, some in by_size.items():
        hashers[size] = new_hasher(size, neighbour_cosine(_units(np.array(some, float)), k))
    shared = spark.sparkContext.broadcast(hashers)

    total = entries.count()
    room = min(max(total // 64, LEAST_PART), MOST_PART)
    lead = min(MOST_LEAD, max(0, math.ceil(math.log(max(1, total / room), CELLS))))
    kind = rows.schema["vector"].dataType.simpleString()
    salted = entries.select("size", F.col("entry").alias("id"), "vector", F.pmod(F.xxhash64("entry"), F.lit(1 << 20)).cast("int").alias("salt"))
    hashed = salted.mapInArrow(_hash_rows(shared, lead), f"size int, tbl int, region int, part int, id long, code long, vector {kind}")
    parts = hashed.groupBy("size", "tbl", "region").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias("parts"))
    parts = cut(parts, "parts")  # At most 4096 regions a table and length of vectors.
    index = hashed.join(F.broadcast(parts), ["size", "tbl", "region"]).select(
        *_KEYS[:3], F.pmod("part", "parts").alias("part"), F.lit(False).alias("asks"), "id", "code", F.lit(None).cast("double").alias("cosine"), "vector"
    )

    def search(asking: DataFrame, home: bool) -> DataFrame:
        sent = asking.mapInArrow(_visit(shared, lead, home), f"size int, tbl int, region int, id long, cosine double, vector {kind}")
        dealt = sent.join(F.broadcast(parts), ["size", "tbl", "region"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        ask = dealt.select(*_KEYS, F.lit(True).alias("asks"), "id", F.lit(None).cast("long").alias("code"), "cosine", "vector")
        together = index.unionByName(ask).repartition(_width(spark), *_KEYS).sortWithinPartitions(*_KEYS, "asks")
        found = together.mapInArrow(_search_parts(shared, k + 1, FIRST_DEVIATIONS if home else DEVIATIONS, tally), "query long, entry long, score double")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
        return found.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")

    near = cut(search(queries, True), "home")
    limit = near.groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("cosine"))
    near = near.unionByName(search(queries.join(limit.withColumnRenamed("query", "id"), "id", "left"), False)).distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)

    ids = entries.select("entry", "ids")
    listed = near.join(ids, "entry").select("query", F.explode("ids").alias("vec_id"), "score")
    listed = listed.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")).join(listed, "query").where(F.col("vec_id") != F.col("query_id"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark, sf_dir):
    """The 5 nearest of every 50th vector of ``embeddings``, by :func:`nearest`."""
    return nearest(table(spark, sf_dir, "embeddings"))
