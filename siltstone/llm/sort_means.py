"""Centroid clustering by Lloyd rounds on integers, with sort-means: exact sums, exact distances, exact ties.

Each round the driver orders, for every centroid p, the others by their distance from p (k x k numbers).  A vector starts
from its previous centroid p, at squared distance A, and walks that order.  A centroid c with |p - c| > 2 * sqrt(A) can't be
nearer than p, so the walk stops at the first c with |p - c|^2 > 4 * A; an equal one is still looked at, so that ties go to
the smaller number.  Vectors and their assignment are written between the rounds; new centroids are sums by cluster, made in
the tasks before the shuffle, so only k rows reach the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import discard, table, written

#: Largest absolute component: 64 squared differences of such numbers fit into a long.
LARGEST = 1 << 27
#: Vectors that are measured against one centroid at a time.
BLOCK = 4096


def scaled(vectors: DataFrame, column: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): v holds floor(scale * x) of each component x, taken as a double.  Left out: vectors that are null, have
    another number of components than ``dims``, or a null, NaN or infinite one.  Other columns are dropped."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = vectors.filter(F.col(column).isNotNull() & (F.size(column) == dims)).filter(F.coalesce(finite, F.lit(False)))
    whole = F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return sound.select("vec_id", whole.alias("v"))


def initial(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of seed + vec_id (ties: by components); fewer if there are fewer.  A vector
    without a vec_id is never one of them."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("order")
    return [list(r["v"]) for r in vectors.filter("vec_id is not null").select(order, "v").orderBy("order", "v").limit(k).collect()]


def walks(centroids):
    """(order, reach): order[p] holds all centroids by squared distance from p, itself first, and reach[p] these distances."""
    import numpy as np

    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(apart, -1)  # itself first, also where another centroid is equal
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.maximum(np.take_along_axis(apart, order, 1), 0)


def nearest(x, before, centroids, order, reach):
    """(cluster, squared distance) of the rows of x, by the walk from their cluster ``before``."""
    import numpy as np

    best = before.copy()
    least = ((x - centroids[before]) ** 2).sum(1)
    bound = 4 * least
    for p in np.unique(before):
        rows = np.flatnonzero(before == p)
        rows = rows[np.argsort(-bound[rows], kind="stable")]  # those that walk farthest come first
        for step in range(1, len(centroids)):
            walking = int(np.searchsorted(-bound[rows], -reach[p][step], "right"))
            if not walking:
                break
            c = order[p][step]
            for lo in range(0, walking, BLOCK):
                r = rows[lo : min(lo + BLOCK, walking)]
                d = ((x[r] - centroids[c]) ** 2).sum(1)
                nearer = (d < least[r]) | ((d == least[r]) & (c < best[r]))
                best[r[nearer]], least[r[nearer]] = c, d[nearer]
    return best, least


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vectors: (vec_id, v, cluster), cluster being where the walk starts.  The same rows with cluster and distance (squared)."""
    kind = vectors.schema["vec_id"].dataType
    out = T.StructType([T.StructField("vec_id", kind), T.StructField("v", T.ArrayType(T.LongType())), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(it):
        import numpy as np
        import pyarrow as pa

        c = np.array(centroids, np.int64)
        order, reach = walks(c)
        for batch in it:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
            cluster, distance = nearest(x, np.asarray(batch.column("cluster")).astype(np.int64), c, order, reach)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "cluster", "distance"])

    return vectors.mapInArrow(run, out)


def moved(assigned: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid that has vectors becomes their componentwise floor(sum / count), on whole numbers."""
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))]
    out = [list(c) for c in centroids]
    for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # k rows at most
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(len(centroids[0]))]
    return out


def sort_means(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:") -> tuple[DataFrame, list[list[int]]]:
    """Cluster (vec_id, v) as ``scaled`` makes them.  Returns a written table (vec_id, cluster, distance) with a row for each
    row of ``vectors``, and the final centroids.

    Fewer vectors than k: as many centroids as vectors with an id.  No such vector: no rows.  Equal vectors: the centroids
    may be equal, then all their vectors go to the smaller number and the other stays empty and where it is.  Repeated rows
    count each.  A null vec_id is kept and clustered.  A component beyond ``LARGEST`` is an error: distances would not fit.
    """
    vectors = written(vectors, "vectors")
    widest = vectors.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    if widest is not None and widest > LARGEST:
        raise ValueError(f"a component is {widest} after scaling; squared distances fit a long up to {LARGEST}")
    centroids = initial(vectors, k, seed)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false"), []
    now = vectors.withColumn("cluster", F.lit(0))
    last = vectors
    for _ in range(rounds):
        step = written(assign(now, centroids), "assigned")
        discard(last)
        centroids, now, last = moved(step, centroids), step.drop("distance"), step
    out = written(assign(now, centroids).drop("v"), "clusters")
    discard(last)
    return out, centroids


def centroid_digest(centroid: list[int]) -> str:
    """SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(clusters: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add cluster_inertia, inertia (sums of squared distances) and centroid_sha256 to (vec_id, cluster, distance)."""
    spark = clusters.sparkSession
    sums = {r["cluster"]: r["s"] for r in clusters.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    rows = [(c, s, sum(sums.values()), centroid_digest(centroids[c])) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clusters.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: whole ``embeddings``, 64 components, 40 centroids, 5 rounds."""
    return with_inertia(*sort_means(scaled(table(spark, sf_dir, "embeddings"))))


def _oracle(k: int = 40, rounds: int = 5) -> str:
    """One CTE a round: distances to all centroids, the nearest, floors of means."""
    steps = [
        """kept as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)""",
        f"""m0 as materialized (
  select cast(row_number() over (order by sha256('2:' || vec_id)) - 1 as integer) as cluster, v as c
  from kept qualify cluster < {k}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (
  select vec_id, v, cluster, d from (
    select vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from kept, m{r}
  ) qualify row_number() over (partition by vec_id order by d, cluster) = 1
)""")
        if r < rounds:
            steps.append(f"""m{r + 1} as materialized (
  select m.cluster, coalesce(n.c, m.c) as c from m{r} m left join (
    select cluster, list(f order by i) as c from (
      select cluster, i, cast(floor(sum(v[i]) / count(*)) as bigint) as f from a{r}, range(1, 65) t(i) group by cluster, i
    ) group by cluster
  ) n using (cluster)
)""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by cluster) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join m{rounds} using (cluster)"""


ORACLE = _oracle()
