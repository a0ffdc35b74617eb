"""The order of model selection: frozen before TEST, once."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewright.operators import model


def test_the_winner_is_frozen_refitted_reloaded_and_never_chosen_again(spark, tmp_path):
    rows = spark.range(120).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"), (F.col("id") * 2 + F.col("id") % 7).cast("double").alias("y"))
    train, valid, test = rows.filter("x < 80"), rows.filter("x between 80 and 99"), rows.filter("x > 99")
    candidates = [model.Candidate("a", 2, 1), model.Candidate("b", 3, 3)]
    run = lambda: model.frozen(train, valid, test, ["x", "z"], "y", candidates, str(tmp_path))
    row = run().first()
    assert row.winner == "b" and row.frozen_unchanged and row.reload_difference == 0 and row.test_rows == 20 and row.test_mae > 0
    with pytest.raises(AnalysisException):
        run()
