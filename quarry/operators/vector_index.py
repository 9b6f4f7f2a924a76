"""A persisted index of vectors: inverted lists of residual codes, re-ranked exactly.

``build`` trains centroids on a bounded sample, puts every row into the list of
its nearest centroid and writes it with one byte a dimension for what the centroid
leaves over, and with how far that code is from the vector.  ``probe`` sends each
query to the lists of its nearest centroids; only these partitions are read.  Codes
and their known errors bound each distance from both sides, so that the rows that
may be among the k best of the probed lists are few, and those are measured by
their vectors.  With ``exact`` the lists are all those that may hold one of the k
nearest rows, by the centroids' distances and the lists' radii.

Copies of one vector share list and code; of more than k a query keeps the k
smallest keys, so large groups of copies stay small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import cosine

#: Rows that centroids and the number of probes are fitted on (about; twice at most), and bytes of all centroids.
SAMPLE, CENTROID_BYTES = 20_000, 32 << 20
#: Rows of a list that meet its queries in one task (about), and sampled queries that fix the number of probes.
PART, ASKING = 65_536, 400
#: Share of distances that rounding may move them by.
ROUNDING = 1e-7


@dataclass(frozen=True)
class Index:
    """Where an index lies, and its lists: what the driver and tasks hold of it."""

    folder: str
    key: str
    vector: str
    metric: str
    probes: int
    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows")

    def lists(self, spark: SparkSession) -> DataFrame:
        """``(list, rows, parts)``: a row a list, so few enough to broadcast."""
        parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / PART)).cast("int").alias("parts")
        return F.broadcast(spark.read.parquet(f"{self.folder}/lists").select("list", "rows", parts))


def _usable(key: str, vector: str) -> Column:
    finite = F.forall(F.col(vector).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.col(key).isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles (of length 1 if ``unit``), and which are usable."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    if unit:
        with np.errstate(invalid="ignore", divide="ignore"):
            v = v / np.sqrt((v * v).sum(axis=1))[:, None]
    return v, np.isfinite(v).all(axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _nearest_list(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(v), np.int32)
    for at in range(0, len(v), 1024):
        out[at : at + 1024] = np.argmin(_distances(v[at : at + 1024], centroids), axis=1)
    return out


def _sampled(known: DataFrame, key: str, vector: str, n: int, unit: bool) -> np.ndarray:
    share = known.where(F.pmod(F.xxhash64(key), F.lit(max(1, n))) < SAMPLE) if n > SAMPLE else known
    rows = share.orderBy(F.xxhash64(key), key).limit(2 * SAMPLE).select(vector).toArrow()
    v, fine = _matrix(rows[vector], unit)
    return v[fine]


def _trained(spark: SparkSession, sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids by k-means over the sample's distinct vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    distinct = np.unique(sample, axis=0)
    if len(distinct) <= lists:
        return distinct
    table = pa.table({"v": pa.FixedSizeListArray.from_arrays(pa.array(distinct.ravel()), distinct.shape[1]).cast(pa.list_(pa.float64()))})
    frame = spark.createDataFrame(table).select(array_to_vector("v").alias("features")).repartition(spark.sparkContext.defaultParallelism)
    model = KMeans(k=lists, seed=seed, maxIter=12, initMode="random").fit(frame)
    return np.array(model.clusterCenters())


def _enough(sample: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10) -> int:
    """The fewest probes that find the share ``recall`` of the k nearest rows of
    the sample; in the whole table these are nearer, so no more are needed."""
    asks = sample[:: max(1, len(sample) // ASKING)][:ASKING]
    own = _nearest_list(sample, centroids)
    place = np.argsort(np.argsort(_distances(asks, centroids), axis=1, kind="stable"), axis=1, kind="stable")
    near = np.concatenate([np.argsort(_distances(asks[i : i + 32], sample), axis=1, kind="stable")[:, 1 : k + 1] for i in range(0, len(asks), 32)])
    needed = np.sort(place[np.arange(len(asks))[:, None], own[near]].ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if needed.size else 1


def build(
    rows: DataFrame, folder: str, *, key: str = "id", vector: str = "embedding", metric: str = "cosine", carry: tuple[str, ...] = (),
    lists: int | None = None, recall: float = 0.95, seed: int = 7,
) -> Index:
    """Write an index of all rows that have a usable vector below ``folder``.

    A vector that is null, holds a null or a value that is not finite, or (for
    ``cosine``) has no length is neither indexed nor found.  Vectors have one
    width.  ``carry`` names columns that probes may filter by.  There are about
    the root of the row count lists, fewer where their centroids would be over
    ``CENTROID_BYTES``, as these go to every task.
    """
    if metric not in ("cosine", "euclid"):
        raise ValueError(f"no metric {metric}")
    spark, unit = rows.sparkSession, metric == "cosine"
    known = rows.where(_usable(key, vector)).select(key, vector, *carry)
    n = known.count()
    sample = _sampled(known, key, vector, n, unit)
    if not len(sample):
        raise ValueError("there is no vector to index")
    width = sample.shape[1]
    most = max(1, CENTROID_BYTES // (8 * width))
    centroids = _trained(spark, sample, min(most, len(sample), lists or round(n**0.5) or 1), seed)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, fine = _matrix(batch.column(1), unit)
            if not fine.all():
                batch, v = batch.filter(pa.array(fine)), v[fine]
            if not len(v):
                continue
            own = _nearest_list(v, centroids)
            left = v - centroids[own]
            scale = np.abs(left).max(axis=1) / 127
            code = np.rint(left / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            slack = np.sqrt(((left - code * scale[:, None]) ** 2).sum(axis=1))
            same = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in v]
            more = [pa.array(own), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(slack), pa.array(np.sqrt((left * left).sum(axis=1))), pa.array(same, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_list", "_code", "_scale", "_slack", "_far", "_same"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema)
    done = known.mapInArrow(coded, f"{kinds}, _list int, _code binary, _scale double, _slack double, _far double, _same binary")
    # Rebalancing lets a long list be several files of one partition.
    done.hint("rebalance", "_list").write.partitionBy("_list").option("compression", "zstd").parquet(f"{folder}/rows")
    held = {r["_list"]: r for r in spark.read.parquet(f"{folder}/rows").groupBy("_list").agg(F.count("*").alias("n"), F.max("_far").alias("far")).collect()}
    lists_table = [(i, c.tolist(), float(held[i]["far"]) if i in held else 0.0, held[i]["n"] if i in held else 0) for i, c in enumerate(centroids)]
    spark.createDataFrame(lists_table, "list int, centroid array<double>, radius double, rows long").coalesce(1).write.parquet(f"{folder}/lists")
    about = [(key, vector, metric, min(len(centroids), _enough(sample, centroids, recall)))]
    spark.createDataFrame(about, "key string, vector string, metric string, probes int").coalesce(1).write.parquet(f"{folder}/about")
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> Index:
    """An index that was built before."""
    about = spark.read.parquet(f"{folder}/about").first()
    lists = spark.read.parquet(f"{folder}/lists").orderBy("list").collect()
    cols = [np.array([r[c] for r in lists]) for c in ("centroid", "radius", "rows")]
    return Index(folder, about["key"], about["vector"], about["metric"], about["probes"], *cols)


def routes(index: Index, queries: DataFrame, k: int, *, key: str, vector: str, probes: int | None = None, exact: bool = False) -> DataFrame:
    """``(query_id, q, list)``: the lists that each query asks; one without a key
    or a usable vector asks none."""
    unit, count = index.metric == "cosine", min(len(index.rows), probes or index.probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                q, fine = _matrix(batch.column(1), unit)
                batch, q = batch.filter(pa.array(fine)), q[fine]
                if not len(q):
                    continue
                d = _distances(q, index.centroids)
                if exact:
                    # The k nearest and the query itself lie within the reach of lists that hold so many rows.
                    reach = d + index.radius
                    order = np.argsort(reach, axis=1, kind="stable")
                    enough = np.minimum((np.cumsum(index.rows[order], axis=1) < k + 1).sum(axis=1), len(index.rows) - 1)
                    limit = reach[np.arange(len(q)), order[np.arange(len(q)), enough]]
                    norm = ROUNDING * (1 + np.sqrt((q * q).sum(axis=1)) + limit)
                    asked = (d - index.radius <= (limit + norm)[:, None]) & (index.rows > 0)
                else:
                    best = np.argpartition(d, count - 1, axis=1)[:, :count]
                    asked = np.zeros(d.shape, bool)
                    asked[np.arange(len(q))[:, None], best] = True
                row, lists = np.nonzero(asked)
                flat = pa.ListArray.from_arrays(np.arange(len(row) + 1, dtype=np.int32) * q.shape[1], pa.array(q[row].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), flat, pa.array(lists.astype(np.int32))], names=["query_id", "q", "list"])

    asking = queries.where(_usable(key, vector)).select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    return asking.mapInArrow(run, f"query_id {asking.schema['query_id'].dataType.simpleString()}, q array<double>, list int")


def rows_asked(index: Index, routed: DataFrame) -> DataFrame:
    """``(query_id, lists, rows)``: how much of the index each query looks at."""
    met = routed.join(index.lists(routed.sparkSession), "list")
    return met.groupBy("query_id").agg(F.count("*").alias("lists"), F.sum("rows").alias("rows"))


def _candidates(index: Index, rows: DataFrame, routed: DataFrame, k: int, itself: bool) -> DataFrame:
    """``(query_id, id, list, low, high)``: rows that may be among the k nearest of
    the probed lists.  A list of more than ``PART`` rows is several groups."""
    lists = index.lists(rows.sparkSession)
    code = ["_code", "_scale", "_slack", "_same"]
    side = rows.select(F.col("_list").alias("list"), F.col(index.key).alias("id"), *code)
    side = side.join(lists, "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", *code)
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    asks = routed.join(lists, "list").select("list", every, F.col("query_id").alias("id"), "q")
    met = side.unionByName(asks, allowMissingColumns=True)
    centroids = index.centroids

    def run(block: pa.Table) -> pa.Table:
        asked = np.asarray(block["q"].is_valid())
        own, other = block.filter(pa.array(~asked)), block.filter(pa.array(asked))
        found: list[list[np.ndarray]] = [[], [], [], []]
        at = block["list"][0].as_py() if len(block) else 0
        if len(own) and len(other):
            ids = own["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            size = centroids.shape[1]
            code = np.frombuffer(b"".join(own["_code"].to_pylist()), np.int8).reshape(-1, size)[order]
            v = centroids[at] + code * own["_scale"].to_numpy()[order][:, None]
            slack = own["_slack"].to_numpy()[order] + ROUNDING * (1 + np.sqrt((v * v).sum(axis=1)))
            _, same = np.unique(np.array(own["_same"].to_pylist(), object)[order].astype(bytes), return_inverse=True)
            q, _ = _matrix(other["q"], False)
            asking = other["id"].to_numpy()
            for b in range(0, len(q), 128):
                d = _distances(q[b : b + 128], v)
                grown = slack + ROUNDING * np.sqrt((q[b : b + 128] ** 2).sum(axis=1))[:, None]
                for who, low, high in zip(asking[b : b + 128], d - grown, d + grown, strict=True):
                    fits = np.ones(len(ids), bool) if itself else ids != who
                    limit = np.partition(high[fits], k - 1)[k - 1] if fits.sum() > k else np.inf
                    kept = np.flatnonzero(fits & (low <= limit))
                    if len(kept) > k:  # of copies the k smallest keys
                        kind = np.argsort(same[kept], kind="stable")
                        s = same[kept][kind]
                        begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                        nth = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
                        kept = kept[np.sort(kind[nth < k])]
                    found[0].append(np.full(len(kept), who))
                    found[1].append(ids[kept])
                    found[2].append(low[kept])
                    found[3].append(high[kept])
        who, ids, low, high = (np.concatenate(f) if f else np.zeros(0) for f in found)
        kind = block.schema.field("id").type
        return pa.table({"query_id": pa.array(who).cast(kind), "id": pa.array(ids).cast(kind), "list": pa.array(np.full(len(who), at, np.int32)), "low": pa.array(low), "high": pa.array(high)})

    kind = met.schema["id"].dataType.simpleString()
    return met.groupBy("list", "part").applyInArrow(run, f"query_id {kind}, id {kind}, list int, low double, high double")


def probe(
    index: Index, queries: DataFrame, k: int, *, key: str | None = None, vector: str | None = None, probes: int | None = None,
    exact: bool = False, itself: bool = False, where: Column | None = None,
) -> DataFrame:
    """The k nearest rows in the lists that each query asks: ``(query_id, key,
    rank, similarity or distance)``; ties go to the smaller key.

    ``where`` is a condition on carried columns, put before all else; together
    with ``exact`` it asks every list, as lists' row counts say nothing then.
    ``itself`` lets a query find the row of its own key.  Keys are whole numbers.
    """
    spark, cos = queries.sparkSession, index.metric == "cosine"
    out, vector = "similarity" if cos else "distance", vector or index.vector
    if exact and where is not None:
        probes, exact = len(index.rows), False
    routed = routes(index, queries, k, key=key or index.key, vector=vector, probes=probes, exact=exact)
    asked = sorted(r["list"] for r in routed.select("list").distinct().collect())  # as many as there are lists at most
    rows = index.table(spark).where(F.col("_list").isin(asked))
    rows = rows if where is None else rows.where(where)
    near = _candidates(index, rows, routed, k, itself)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("high", "id"))
    near = near.withColumn("_n", place).withColumn("_limit", F.max(F.when(F.col("_n") <= k, F.col("high"))).over(Window.partitionBy("query_id")))
    near = near.where(F.col("low") <= F.col("_limit")).select("query_id", "id", "list")
    full = rows.select(F.col("_list").alias("list"), F.col(index.key).alias("id"), F.col(index.vector).alias("v"))
    asking = queries.select(F.col(key or index.key).alias("query_id"), F.col(vector).alias("q")).dropDuplicates(["query_id"])
    met = near.join(full, ["list", "id"]).join(asking, "query_id")
    square = F.aggregate(F.zip_with("v", "q", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    cost = -cosine(F.col("v"), F.col("q")) if cos else F.sqrt(square)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("cost", "id"))
    best = met.select("query_id", "id", cost.alias("cost")).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("id").alias(index.key), "rank", (-F.col("cost") if cos else F.col("cost")).alias(out))
