"""Queries over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..sources import store
from . import fixtures as fx
from .registry import query

_OK = """
    , p as (select *, coalesce(predicted_1, 'None') = actual_1 as ok_1,
            coalesce(predicted_1, 'None') = actual_1 and coalesce(predicted_2, 'None') = actual_2 as ok_2 from preds)"""
_LONG = f"""{_OK},
    e as (select id, fold, 1 as depth, conf_1 as c, cast(ok_1 as int) as ok from p
          union all select id, fold, 2, conf_2, cast(ok_2 as int) from p),
    i as (select *, least(greatest(cast(floor(least(greatest(c, 0), 1) / {{w}} + 1e-12) as int), 0), {{n}} - 1) as b from e)"""
_LABEL = "printf('%.2f-%.2f', b * {w}, least((b + 1) * {w}, 1.0))"


def _buckets(w: float, n: int) -> str:
    return _LONG.format(w=w, n=n) + f""",
    g as (select depth, b, count(*) as n, sum(ok) as hits, avg(c) as mc from i group by depth, b),
    s as (select d.d as depth, b.b as b from range(1, 3) d(d) join range({n}) b(b) on true),
    f as (select s.depth, s.b, coalesce(g.n, 0) as n, coalesce(g.hits, 0) as hits, mc,
          sum(coalesce(g.n, 0)) over (partition by s.depth) as total,
          sum(coalesce(g.n, 0)) over (partition by s.depth order by s.b desc) as cn,
          sum(coalesce(g.hits, 0)) over (partition by s.depth order by s.b desc) as ch
          from s left join g on g.depth = s.depth and g.b = s.b),
    t as (select 'L' || depth as level, {_LABEL.format(w=w)} as bucket, round(b * {w}, 6)::double as lower,
          round(least((b + 1) * {w}, 1.0), 6)::double as upper, n as n_items, round(n / greatest(total, 1), 6) as share_of_items,
          case when n > 0 then round(hits / n, 6) end as accuracy, round(mc, 6) as mean_confidence,
          round(cn / greatest(total, 1), 6) as cumulative_coverage,
          case when cn > 0 then round(ch / cn, 6) end as cumulative_accuracy from f)"""


_ROUNDED = [
    "level", "bucket", "round(lower, 6) as lower", "round(upper, 6) as upper", "n_items",
    "round(share_of_items, 6) as share_of_items", "round(accuracy, 6) as accuracy",
    "round(mean_confidence, 6) as mean_confidence", "round(cumulative_coverage, 6) as cumulative_coverage",
    "round(cumulative_accuracy, 6) as cumulative_accuracy",
]


@query("correct_flags", fx.with_views("preds", body=f"{_OK} select id, ok_1, ok_2 from p"))
def correct_flags(spark, folder):
    return ev.correct_flags(fx.predictions(spark, folder), fx.PRED_LEVELS).selectExpr(
        "id", "`L1 Correct` as ok_1", "`L2 Correct` as ok_2"
    )


@query("accuracy_by_level", fx.with_views("preds", body=f"""{_OK}
    select round(avg(cast(ok_1 as int)), 6) as a1, round(avg(cast(ok_2 as int)), 6) as a2 from p"""))
def accuracy_by_level(spark, folder):
    return ev.accuracy_by_level(fx.predictions(spark, folder), fx.PRED_LEVELS).selectExpr(
        "round(`L1 Accuracy`, 6) as a1", "round(`L2 Accuracy`, 6) as a2"
    )


@query("bucket_table", fx.with_views("preds", body=_buckets(0.1, 10) + "select * from t where level = 'L1'"))
def bucket_table(spark, folder):
    return ev.bucket_table(fx.predictions(spark, folder), fx.PRED_LEVELS, 1, 0.1).selectExpr(*_ROUNDED)


@query("bucket_tables", fx.with_views("preds", body=_buckets(0.3, 4) + "select * from t"))
def bucket_tables(spark, folder):
    return ev.bucket_tables(fx.predictions(spark, folder), fx.PRED_LEVELS, 0.3).selectExpr(*_ROUNDED)


@query("cumulative_from_top", fx.with_views("preds", body=_buckets(0.05, 20) + """
    select level, lower, cumulative_coverage, cumulative_accuracy from t"""))
def cumulative_from_top(spark, folder):
    return ev.bucket_tables(fx.predictions(spark, folder), fx.PRED_LEVELS, 0.05).selectExpr(
        "level", *[c for c in _ROUNDED if " as lower" in c or "cumulative" in c]
    )


@query("split_bucket_accuracy", fx.with_views("preds", body=_LONG.format(w=0.1, n=10) + f"""
    select fold as split, b as bucket, round(avg(ok), 6) as accuracy, count(*) as n_items,
           {_LABEL.format(w=0.1)} as bucket_label from i where depth = 2 group by fold, b"""))
def split_bucket_accuracy(spark, folder):
    rows = ev.split_bucket_accuracy(fx.predictions(spark, folder), fx.PRED_LEVELS, 2, 0.1)
    return rows.withColumn("accuracy", F.round("accuracy", 6))


@query("accept_boundary", fx.with_views("preds", body=_buckets(0.1, 10) + """
    select level, min(lower) as lower, arg_min(bucket, lower) as bucket, arg_min(cumulative_coverage, lower) as coverage
    from t where cumulative_accuracy >= 0.6 group by level"""))
def accept_boundary(spark, folder):
    tables = ev.bucket_tables(fx.predictions(spark, folder), fx.PRED_LEVELS, 0.1).selectExpr(*_ROUNDED)
    return ev.accept_boundary(tables, 0.6)


@query("coverage_curve", fx.with_views("preds", body=_LONG.format(w=0.1, n=10) + """
    , r as (select depth, id, row_number() over o as rank, count(*) over (partition by depth) as n, sum(ok) over o as hits
            from i window o as (partition by depth order by c desc, id rows unbounded preceding))
    select depth, id, rank, round(rank / n, 6) as coverage, round(hits / rank, 6) as accuracy from r"""))
def coverage_curve(spark, folder):
    curve = ev.coverage_curve(fx.predictions(spark, folder), fx.PRED_LEVELS, "id")
    return curve.selectExpr(
        "depth", "id", "rank", "round(coverage, 6) as coverage", "round(accuracy, 6) as accuracy"
    )


_TARGETS = (0.55, 0.6, 0.65, 0.9)


@query("coverage_at", fx.with_views("preds", body=_LONG.format(w=0.1, n=10) + f"""
    , r as (select depth, row_number() over o as rank, count(*) over (partition by depth) as n, sum(ok) over o as hits
            from i window o as (partition by depth order by c desc, id rows unbounded preceding)),
    targets as (select cast(unnest([{', '.join(map(str, _TARGETS))}]) as double) as target)
    select depth, target, round(max(rank / n), 6) as coverage from r join targets on hits / rank >= target
    group by depth, target"""))
def coverage_at(spark, folder):
    curve = ev.coverage_curve(fx.predictions(spark, folder), fx.PRED_LEVELS, "id")
    return ev.coverage_at(curve, _TARGETS).withColumn("coverage", F.round("coverage", 6))


@query("union_splits", fx.with_views("preds", body="""
    select id, fold, candidate, actual_1, conf_1 from preds"""))
def union_splits(spark, folder):
    pred = fx.predictions(spark, folder).selectExpr(
        "id", "fold", "candidate", "`Actual one` as actual_1", "`L1 Confidence` as conf_1"
    )
    return store.union_splits([pred.where(F.col("fold") == f) for f in range(5)])
