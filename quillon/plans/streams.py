"""The batch forms of the streaming operators, which SQL can check."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.registry import analysis
from quillon.sources import corpus as C
from quillon.streaming import events as S


def events(spark, sf_dir):
    return C.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@analysis(oracle="select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_event_windows(spark, sf_dir):
    w = S.windows(events(spark, sf_dir))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@analysis(oracle="""with e as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
    s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n, round(sum(value), 4) as total from s group by user_id, k""")
def stream_sessions(spark, sf_dir):
    s = S.sessions(events(spark, sf_dir))
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


@analysis(oracle="select event_type, count(*) as n from events group by event_type")
def stream_frequencies(spark, sf_dir):
    return S.frequencies(events(spark, sf_dir))
