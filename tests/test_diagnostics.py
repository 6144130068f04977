"""Diagnostic summaries against plain computations, and the size of their plans."""

import random
import statistics

import pytest

from geoskein.operators import relational, stats
from geoskein.plans import diagnostics


def test_representation_of_counted_pairs_equals_that_of_rows(spark):
    rng = random.Random(4)
    rows = [(k, w, w + rng.choice([0, 0, 1, 5])) for k, n in ((0, 301), (1, 40), (2, 12), (3, 50)) for w in (7 if k == 3 else rng.randrange(9) for _ in range(n))]
    rows = [(k, w, 7 if k == 3 else e) for k, w, e in rows]  # no variance
    df = spark.createDataFrame(rows, "kind int, w long, e long")
    want = {r.kind: r.rho for r in stats.spearman(df.selectExpr("kind", "double(w) w", "double(e) e"), "w", "e", ["kind"]).collect()}
    got = {r.kind: r for r in diagnostics.representation(df.groupBy("kind", "w", "e").count().withColumnRenamed("count", "n")).collect()}
    for k in range(4):
        own = [(w, e) for i, w, e in rows if i == k]
        assert (got[k].n, got[k].median_gap) == (len(own), statistics.median(e - w for w, e in own))
        assert got[k].different_share == round(sum(e != w for w, e in own) / len(own), 6)
        assert got[k].spearman == (None if want[k] is None else round(want[k], 6))
    with pytest.raises(relational.ContractError):
        diagnostics.representation(spark.createDataFrame([(0, 2, 1, 1)], "kind int, w long, e long, n long"))


@pytest.mark.parametrize("name", ["representation_difference", "snap_flags"])
def test_points_are_never_checkpointed(spark, small, name, monkeypatch):
    """What is written to the checkpoint folder has no row for each record."""
    from geoskein.operators import spatial

    columns = []
    for module in (diagnostics, spatial):
        monkeypatch.setattr(module, "cut", lambda df, real=module.cut: (columns.append(set(df.columns)), real(df))[1])
    diagnostics.QUERIES[name](spark, small)
    assert columns and not any({"id"} & c or {"x", "y"} <= c and "snapshot_date" not in c for c in columns)
