from trajspark.operators import detectors
from trajspark.plans import registry

SF = "/root/testdata/sf0.001"
FEATURES = ["dt", "distance", "speed", "acceleration", "turn", "stop_s", "bearing_sin", "bearing_cos"]


def test_detectors_see_eight_features(spark, monkeypatch):
    seen = []
    forest, linear = detectors.isolation_forest, detectors.linear_reconstruction

    def grown(train, columns, trees=200, **more):
        model = forest(train, columns, trees=trees, **more)
        seen.append((columns, model.select("tree").distinct().count()))
        return model

    def fitted(train, columns, rank):
        seen.append((columns, rank))
        return linear(train, columns, rank)

    monkeypatch.setattr(detectors, "isolation_forest", grown)
    monkeypatch.setattr(detectors, "linear_reconstruction", fitted)
    points = registry.gps_points(spark, SF).count()
    for name in ("d10_isolation_forest", "d11_linear_reconstruction"):
        rows = registry.queries()[name](spark, SF)
        assert rows.na.drop().count() == points
    assert seen == [(FEATURES, 200), (FEATURES, 4)]
