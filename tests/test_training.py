"""What the training queries hand to their operators."""

import pytest

from gridwarden.workload import QUERIES
from gridwarden.workload import q_training as q

FOLDER = "/root/testdata/sf0.001"


class Stop(Exception):
    pass


def caught(monkeypatch, spark, query, operator):
    seen = {}

    def instead(*args, **kwargs):
        seen.update(args=args, kwargs=kwargs)
        raise Stop

    monkeypatch.setattr(q.ml, operator, instead)
    with pytest.raises(Stop):
        QUERIES[query](spark, FOLDER)
    return seen


def test_variants_are_compared(spark, monkeypatch):
    seen = caught(monkeypatch, spark, "compare_variants", "compare_variants")
    tables, sizes, _ = seen["args"]
    assert set(tables) == {f"region_day_{v}_top{k}" for v in ("heat_index_c", "tmax_c") for k in (1, 3)}
    assert len(set(sizes)) >= 2 and not seen["kwargs"]
    counts = {name: table.groupBy("label_status").count().count() for name, table in tables.items()}
    assert min(counts.values()) > 1


@pytest.mark.parametrize("query", ["train_hazard_model", "score_with_model", "predict_risk_fields"])
def test_training_runs_all_rounds(spark, monkeypatch, query):
    assert caught(monkeypatch, spark, query, "train_hazard_model")["kwargs"] == {"group": "date"}
