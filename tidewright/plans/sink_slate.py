"""Queries: tables made, overwritten and watched, literal rows, progress of streams, and the order of candidates (§2.1, 2.2, 2.8, 2.10, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import six
from ..operators import metrics, model
from ..sources import merge, readers
from ..streaming import listener
from ..streaming import medallion as runs
from .base import SCORED, load, query, s6, scored, scratch
from .metrics_slate import CANDIDATES, NAMES, _labelled


def _events(spark, d):
    return load(spark, d, "events").select("event_id", "event_type", "value")


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type, value + 1 FROM events WHERE event_id % 2 = 1")
def merge_into_empty(spark, d):
    """SNK-07/02: a typed table without rows takes all rows of a first merge, and the changes of a second."""
    e = _events(spark, d)
    first = merge.merged(merge.empty(spark, e.schema), e, ["event_id"])
    return merge.merged(first, e.filter("event_id % 2 = 1").withColumn("value", F.col("value") + 1), ["event_id"])


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_id % 3 = 0 GROUP BY ALL")
def overwritten_partitions(spark, d):
    """SNK-08: a partitioned table that is written twice holds the second run's rows alone."""
    folder, e = scratch(spark), _events(spark, d)
    merge.overwrite_partitioned(e, f"{folder}/t", "event_type")
    merge.overwrite_partitioned(e.filter("event_id % 3 = 0"), f"{folder}/t", "event_type")
    return spark.read.parquet(f"{folder}/t").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT * FROM (VALUES ('read again', true), ('one row more', false)) t(step, same) WHERE (SELECT count(*) FROM events) > 0")
def snapshot_guard(spark, d):
    """SRC-08: a folder's digest is the same for as long as nothing was written to it."""
    folder, e = scratch(spark), _events(spark, d)
    e.write.parquet(f"{folder}/t")
    before = readers.snapshot(spark, f"{folder}/t")
    again = readers.snapshot(spark, f"{folder}/t")
    e.limit(1).write.mode("append").parquet(f"{folder}/t")
    after = readers.snapshot(spark, f"{folder}/t")
    return readers.literal(spark, [("read again", before == again), ("one row more", before == after)], "step string, same boolean")


@query("SELECT weight, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events JOIN (VALUES ('click', 3), ('view', 1), ('never', 9)) w(event_type, weight) USING (event_type) GROUP BY ALL")
def literal_weights(spark, d):
    """SRC-16, JON-01: rows of a literal relation joined to the events."""
    weights = readers.literal(spark, [("click", 3), ("view", 1), ("never", 9)], "event_type string, weight int")
    return _events(spark, d).join(F.broadcast(weights), "event_type").groupBy("weight").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT c AS missing, n FROM (SELECT count(*) AS n FROM events), (VALUES (''), ('pressure_hpa'), ('user_id;weather_code')) t(c)")
def column_contract(spark, d):
    """PRJ-05: tables that lack columns of a contract are refused by name; one that has them is passed on."""
    e, rows = load(spark, d, "events"), []
    for wanted in (["event_id", "value"], ["event_id", "pressure_hpa"], ["user_id", "weather_code"]):
        df = e if wanted[0] == "event_id" else e.drop("user_id")
        try:
            readers.require(df, wanted)
            rows.append(("",))
        except ValueError as error:
            rows.append((";".join(c for c in wanted if c in str(error)),))
    return readers.literal(spark, rows, "missing string").crossJoin(e.agg(F.count("*").alias("n")))  # one row


@query("SELECT count(*) AS input_rows, CAST(4 AS BIGINT) AS batches FROM events")
def stream_progress_log(spark, d):
    """SNK-14, STR-14: the progress of a stream, a line a micro-batch, adds up to what it read."""
    folder = scratch(spark)
    _events(spark, d).repartition(4).write.parquet(f"{folder}/in")
    source = readers.file_stream(spark, f"{folder}/in", "event_id long, event_type string, value double", 1)
    log = listener.progress_rows(runs.append(source, f"{folder}/out", f"{folder}/state", name=f"log-{folder.rsplit('-', 1)[-1]}"))
    return readers.literal(spark, log, "batch long, rows long").agg(F.sum("rows").alias("input_rows"), F.count_if(F.col("rows") > 0).alias("batches"))


@query(f"""WITH {SCORED}, m AS (SELECT location_id AS candidate, {s6('avg(abs(persistence_prediction - reference))')} AS mae, {s6('sqrt(avg((persistence_prediction - reference) * (persistence_prediction - reference)))')} AS rmse, length(location_id) AS size FROM scored GROUP BY ALL),
both_ AS (SELECT * FROM m UNION ALL SELECT candidate || '-copy', mae, rmse, size FROM m UNION ALL SELECT candidate || '-large', mae, rmse, size + 1 FROM m)
SELECT candidate, CAST(row_number() OVER (ORDER BY mae, rmse, size, candidate) AS INTEGER) AS place FROM both_""")
def candidate_ranking(spark, d):
    """SRT-07: candidates by error, squared error, size and name, with ties down to the name."""
    sums = scored(spark, d).groupBy("location_id").agg(*metrics.sufficient("persistence_prediction", "reference"))
    m = sums.select(F.col("location_id").alias("candidate"), *(six(v).alias(k) for k, v in metrics.regression().items() if k in ("mae", "rmse")), F.length("location_id").alias("size"))
    copy, large = F.concat("candidate", F.lit("-copy")), F.concat("candidate", F.lit("-large"))
    both = m.unionByName(m.withColumn("candidate", copy)).unionByName(m.withColumns({"candidate": large, "size": F.col("size") + 1}))
    ranked = model.ranked(both).select("candidate").collect()  # a row a candidate
    return readers.literal(spark, [(r.candidate, i) for i, r in enumerate(ranked, 1)], "candidate string, place int")


@query(f"""WITH {SCORED}, rows AS (SELECT event_time, lag(persistence_prediction) OVER (PARTITION BY location_id ORDER BY event_time) AS before FROM scored)
SELECT count(*) FILTER (event_time >= TIMESTAMP '2024-01-21') AS test_rows, true AS frozen_unchanged, 0.0::DOUBLE AS reload_difference, true AS chosen_once, true AS is_a_candidate FROM rows WHERE before IS NOT NULL""")
def model_protocol(spark, d):
    """CMP-28/31: what must hold of a selection whatever the winner: frozen before TEST, read back alike, tested on all of it, never chosen again."""
    folder, parts = scratch(spark), _labelled(spark, d)
    told = model.frozen(*parts, NAMES, "reference", CANDIDATES, folder)
    try:
        model.frozen(*parts, NAMES, "reference", CANDIDATES[:1], folder)
        again = True
    except Exception as error:  # the frozen choice is there
        if "exist" not in str(error).lower():
            raise
        again = False
    known = F.col("winner").isin(*(c.name for c in CANDIDATES))
    return told.select("test_rows", "frozen_unchanged", "reload_difference", F.lit(not again).alias("chosen_once"), known.alias("is_a_candidate"))
