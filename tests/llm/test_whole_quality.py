import numpy as np

from trajspark.llm import quality


def model_and_bags():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 4, 2, 7, 3])
    rows, labels = rng.normal(size=(sizes.sum(), 6)), np.array([0, 1, 1, 0, 1], dtype=float)
    return quality.AttentionModel(rows, sizes, labels, hidden=4, steps=5), np.split(rows, np.cumsum(sizes)[:-1]), labels


def plain_scores(model, bags):
    """One bag after another, one passage after another."""
    p, out = model.p, []
    for bag in bags:
        hidden = [np.tanh((row - model.mean) / model.scale @ p["E"] + p["e"]) for row in bag]
        raw = np.array([(np.tanh(h @ p["V"]) * (1 / (1 + np.exp(-(h @ p["U"]))))) @ p["w"] for h in hidden])
        weight = np.exp(raw) / np.exp(raw).sum()
        z = sum(a * h for a, h in zip(weight, hidden, strict=True))
        out.append(1 / (1 + np.exp(-(z @ p["c"] + p["b"][0]))))
    return np.array(out)


def test_attention_against_plain_loops():
    model, bags, _ = model_and_bags()
    assert np.allclose(model.score(bags), plain_scores(model, bags))


def test_gradient_against_differences():
    model, bags, labels = model_and_bags()
    sizes = np.array([len(b) for b in bags])
    starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(sizes)), sizes)
    x, weight = (np.concatenate(bags) - model.mean) / model.scale, np.array([1.0, 0.5, 2.0, 1.0, 1.5])

    def loss():
        s = model._forward(x, starts, owner)[-1]
        decay = sum((model.p[k] ** 2).sum() for k in "EVUc") * 1e-4 / 2
        return -(weight * (labels * np.log(s) + (1 - labels) * np.log(1 - s))).sum() / len(labels) + decay

    gradient = model._gradient(x, starts, owner, labels, weight)
    for name, value in model.p.items():
        for at in list(np.ndindex(value.shape))[:6]:
            old, step = value[at], 1e-5
            value[at] = old + step
            high = loss()
            value[at] = old - step
            low = loss()
            value[at] = old
            assert np.isclose((high - low) / (2 * step), gradient[name][at], atol=1e-6)


def test_same_rows_same_model_and_bounds(spark):
    rows = [(i, f"good words number {i} stand here. " * 5 if i % 2 else f"x{i} " * 30) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    schema = "doc_id long, text string"
    one = quality.fit(spark.createDataFrame(rows, schema), labels)
    two = quality.fit(spark.createDataFrame([*reversed(rows), *rows[:5]], schema).repartition(3), labels)
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p)
    few = quality.fit(spark.createDataFrame(rows, schema), labels, train_chars=10)
    assert isinstance(few, float)  # one document is left, so one class
    kept = quality.score(spark.createDataFrame([(1, "a", 0.25)], "doc_id long, text string, score double"), one, column="other").first()
    assert kept["score"] == 0.25 and 0 <= kept["other"] <= 1
