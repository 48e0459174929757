"""Golden checks: recomputing accuracy and macro F1 from published confusion
matrices reproduces the published values (FIXTURES.md section 8)."""

import pytest

from textlake.operators import evaluate as EV

# Confusion matrices (rows = true, columns = predicted,
# order Negativo, Neutro, Positivo) with the accuracy and macro F1 published
# next to them.
GOLDEN = [
    ("Logistic Regression", [[46005, 19938, 6081], [9588, 18492, 7934], [6827, 16395, 48740]], 0.6291, 0.605),
    ("Random Forest", [[46830, 14760, 10434], [11426, 14331, 10257], [7381, 14012, 50569]], 0.6207, 0.5829),
    ("LightGBM", [[47749, 17714, 6561], [10137, 17687, 8190], [6661, 14189, 51112]], 0.6475, 0.6181),
    ("XGBoost", [[49167, 17236, 5621], [11675, 17408, 6931], [10832, 16327, 44803]], 0.6188, 0.5925),
    ("DistilBERT + LogisticRegression", [[17556, 6248, 1196], [6895, 14022, 4083], [1309, 5042, 18649]],
     0.6697, 0.6705),
    ("DistilBERT + LoRA", [[18774, 5836, 390], [5944, 16290, 2766], [572, 4300, 20128]], 0.7359, 0.738),
    ("Stacking + Threshold Tuning", [[17799, 6807, 394], [4975, 17254, 2771], [451, 4413, 20136]], 0.7359, 0.7391),
]


@pytest.fixture(scope="module")
def metrics(spark):
    df = spark.createDataFrame([(n, m) for n, m, _, _ in GOLDEN], "model_name string, confusion_matrix array<array<bigint>>")
    return {r["model_name"]: r for r in EV.metrics_from_matrix(df).collect()}


@pytest.mark.parametrize("name,matrix,acc,f1", GOLDEN)
def test_golden(metrics, name, matrix, acc, f1):
    r = metrics[name]
    assert round(r["accuracy"], 4) == acc
    assert round(r["f1_macro"], 4) == f1
    assert r["n"] == sum(map(sum, matrix))


def test_zero_division(spark):
    counts = spark.createDataFrame([(0, 0, 5)], "label int, pred int, n long")
    r = EV.macro_metrics(counts, [], 3).first()
    assert r["accuracy"] == 1.0
    assert r["f1_macro"] == round(1 / 3, 6)  # absent classes score 0
