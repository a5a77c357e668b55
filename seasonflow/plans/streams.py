"""Queries that run the streaming jobs over what is available and return what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonflow.functions.core import q, shared_path
from seasonflow.operators import metrics as mt
from seasonflow.plans.metrics import EXTRA
from seasonflow.plans.selection import REQUESTS, VALIDATED, request_rows
from seasonflow.plans.sqlviews import q as sq
from seasonflow.plans.sqlviews import sql
from seasonflow.sources import views as v
from seasonflow.sources.files import write_opps_csv
from seasonflow.streaming import jobs


def stream_opps_ingest(spark, sf_dir):
    """Opportunity files land twice, the second time all over again; the cache holds each pattern once."""
    src, out, state = (shared_path(spark, x) for x in ("landing", "cache", "state"))
    o = v.opportunities(spark, sf_dir)
    for part in ("first", "second"):
        write_opps_csv(o if part == "second" else o.where("days_out < 20"), f"{src}/{part}")
        jobs.ingest(jobs.opps_stream(spark, src), out, state, ["direction"])
    df = spark.read.parquet(out)
    return df.select("symbol", "date", "days_out", "direction", "combo", "sharpe_ratio", "avg_profit", "avg_profit2")


def stream_score(spark, sf_dir):
    """Requests from events, scored by their symbol's mean prediction and the calibration of all candidates."""
    src, out, state = (shared_path(spark, x) for x in ("requests", "scored", "state"))
    c = v.candidates(spark, sf_dir)
    features = c.where("symbol <> 'Brand#9'").groupBy("symbol").agg(q(F.avg("predicted_return"), 4).alias("predicted"))
    bins = mt.calibration(c, "predicted_return").select("bin", *[q(x, 4).alias(x) for x in ("pred_min", "pred_max", "win_prob", "p_hit_pred")])
    rows = request_rows(spark, sf_dir)
    rows.write.parquet(src)
    jobs.scored_stream(spark.readStream.schema(rows.schema).parquet(src), features, bins, ["10_30", "31_60", "61_90"], out, state)
    return spark.read.parquet(out).drop("batch")


QUERIES = {"stream_opps_ingest": stream_opps_ingest, "stream_score": stream_score}
ORACLES = {
    "stream_opps_ingest": sql("SELECT symbol, date, days_out, direction, combo, sharpe_ratio, avg_profit, coalesce(avg_profit2, avg_profit) AS avg_profit2 FROM opps"),
    "stream_score": sql(f"""WITH f AS (SELECT symbol, {sq('avg(predicted_return)', 4)} AS predicted FROM candidates WHERE symbol <> 'Brand#9' GROUP BY 1),
t AS (SELECT list({{'pred_min': pred_min, 'pred_max': pred_max}} ORDER BY bin) AS t FROM cal4),
j AS (SELECT *, least(len(list_filter(t, lambda x: x.pred_max <= predicted)), len(t) - 1)::INT AS i FROM validated LEFT JOIN f USING (symbol), t),
b AS (SELECT *, t[i + 1] AS b, CASE WHEN error IS NULL AND predicted IS NULL THEN 'no features' ELSE error END AS e FROM j)
SELECT event_id, symbol, date, days_out, tier, e AS error, CASE WHEN e IS NULL THEN floor((i + least(greatest(CASE WHEN b.pred_max > b.pred_min THEN (predicted - b.pred_min) / (b.pred_max - b.pred_min) ELSE 0.5 END, 0), 1)) / len(t) * 100 * 10 + 0.5 + 1e-6) / 10 END AS calibrated_score FROM b""", {**EXTRA, "requests": REQUESTS, "validated": VALIDATED}),
}
