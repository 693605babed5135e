import pytest

from lodestrata.plans import runner
from lodestrata.sources import documents


def test_too_large_a_taxonomy_graph_is_not_written(spark, tmp_path, monkeypatch):
    # Without samples the critics' documents, written first, are small.
    monkeypatch.setattr(documents, "MAX_DOCUMENT_ROWS", 5)
    with pytest.raises(ValueError, match="over 5 rows"):
        runner.run_pipeline(spark, 1, {"generator": "g"}, "payments disputes", tmp_path, runner.Settings(per_node=0))
    assert not list(tmp_path.rglob("taxonomy_graph.json"))
