import numpy as np

from tessera.operators import analytics


def test_the_number_of_clusters_by_silhouette(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(6)[:3]
    rows = [(i, (centres[i % 3] + rng.normal(0, 0.05, 6)).tolist()) for i in range(90)]
    df = spark.createDataFrame([*rows, (900, [])], "id long, v array<double>")
    k, got = analytics.kmeans_auto(df, "id", "v", most=5)
    of = {r["id"]: r["cluster"] for r in got.collect()}
    assert k == 3 and len(of) == 90 and len({of[i] for i in range(3)}) == 3 and all(of[i] == of[i % 3] for i in range(90))


def test_silhouette_of_two_clusters():
    points = np.array([[1, 0], [1, 0], [0, 1], [0, 1.0]])
    assert analytics.silhouette(points, np.array([0, 0, 1, 1])) == 1.0 and analytics.silhouette(points, np.zeros(4, int)) == 0.0
    assert analytics.silhouette(points, np.array([0, 1, 0, 1])) < 0
