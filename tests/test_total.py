import datetime

from tessera.operators.relational import total
from tessera.plans import relational


def test_total_of_none_is_zero(spark):
    df = spark.createDataFrame([(5,), (None,), (7,)], "n long")
    assert [total(x, "n", "s").collect() for x in (df, df.where("n is null"), df.where("false"))] == [[(12,)], [(0,)], [(0,)]]


def test_total_bytes_counts_current_versions_of_all_states(spark, tmp_path):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [("a", 10, "NEW", at(1)), ("a", 30, "DONE", at(3)), ("a", 30, "DONE", at(3)), ("a", 20, "NEW", at(2)), ("b", 5, None, at(1)), ("c", None, "NEW", at(1)), ("d", 0, "NEW", at(1))]
    spark.createDataFrame(rows, "candidate_id string, estimated_bytes long, state string, updated_at timestamp_ntz").write.parquet(str(tmp_path / "corpus_candidates.parquet"))
    assert relational.QUERIES["agg_total_bytes"](spark, str(tmp_path)).collect() == [(35,)]
