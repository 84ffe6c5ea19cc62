"""Description clusters with term labels, and a two-dimensional projection."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, ElementwiseProduct, Normalizer, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.operators import heavy
from laborlens.operators.skills import english_stopwords, ranked_terms, token_lists
from laborlens.session import cut_lineage

CLUSTERS, SEED, STARTS, FEATURES = 5, 42, 10, 300


def term_vectors(texts: DataFrame, key: str = "posting_id", clean: str = "clean",
                 features: int = FEATURES):
    """(key, features), unit TF-IDF vectors of unigrams and bigrams; also returns the terms."""
    lists, stop = token_lists(texts, clean, key), english_stopwords()      # tokenised once
    # bounded summaries name the terms: counting all of them would shuffle every bigram
    kept, _, n = ranked_terms(lists, features, True, stop)
    rows = kept.collect()
    if not rows:
        raise ValueError("no text has a term")
    names = [r["term"] for r in rows]
    idf = Vectors.dense([math.log((1 + n) / (1 + r["df"])) + 1.0 for r in rows])
    scale = ElementwiseProduct(inputCol="_tf", outputCol="_w", scalingVec=idf)
    unit = Normalizer(inputCol="_w", outputCol="features")
    counts = heavy.count_vectors(lists, names, stop, key, "_tf")
    return unit.transform(scale.transform(counts)).drop("_tf", "_w"), names


def cluster_texts(texts: DataFrame, k: int = CLUSTERS, key: str = "posting_id",
                  starts: int = STARTS, seed: int = SEED):
    """(key, cluster_id, cluster) by the cheapest of several k-means starts, and its model.

    Clusters are numbered by size; labels name the three heaviest terms of the centre.
    Returns None for fewer texts than clusters.
    """
    if texts.limit(k).count() < k:
        return None
    vectors, names = term_vectors(texts, key)
    vectors = cut_lineage(vectors, "vectors")    # read by every start

    def fit(start):
        return KMeans(k=k, seed=seed + start, featuresCol="features", predictionCol="raw").fit(vectors)
    with ThreadPoolExecutor(4) as pool:         # the starts are independent jobs
        models = list(pool.map(inheritable_thread_target(texts.sparkSession)(fit), range(starts)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    centres, sizes = best.clusterCenters(), best.summary.clusterSizes
    # fewer than k when there are fewer distinct texts
    order = sorted(range(len(centres)), key=lambda i: (-sizes[i], i))
    rows = []
    for number, raw in enumerate(order):
        centre = centres[raw]
        heavy = sorted(range(len(names)), key=lambda j: (-centre[j], names[j]))[:3]
        rows.append((raw, number, f"Cluster {number}: " + ", ".join(names[j] for j in heavy)))
    labels = texts.sparkSession.createDataFrame(rows, "raw int, cluster_id int, cluster string")
    return best.transform(vectors).join(labels, "raw").select(key, "features", "cluster_id", "cluster")


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return (clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "cluster"))


def project(vectors: DataFrame, features: str = "features") -> DataFrame:
    """Add x and y, the first two principal components of the centred vectors."""
    model = Pipeline(stages=[
        StandardScaler(inputCol=features, outputCol="_c", withMean=True, withStd=False),
        PCA(k=2, inputCol="_c", outputCol="_xy"),
    ]).fit(vectors)
    xy = vector_to_array("_xy")
    return (model.transform(vectors).withColumn("x", xy[0]).withColumn("y", xy[1])
            .drop("_c", "_xy"))
