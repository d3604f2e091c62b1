"""Queries: contingency tables and clustering scores (AGG-1, AGG-7, AGG-16, EVAL-1…5, WIN-5, TXT-12)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import format_mean_std
from ..operators import metrics as M
from ..operators import windows as W
from ..operators.experiments import trial_summary
from . import fixtures as fx
from .registry import register
from .sqlparts import centers_cte, feat_cte, pred_cte, trials_cte, with_


def _pred10():
    return [feat_cte(), centers_cte(10), pred_cte(10)]


def sql_scores(src: str, by: str | None = None, k: int | None = None) -> list[str]:
    """CTEs computing mi/h_label/h_pred/emi (and acc by the best matching of k clusters when k is given) per ``by``."""
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    j = (lambda t: f"USING ({by})") if by else (lambda t: "ON TRUE")
    ctes = [
        f"ct AS (SELECT {g}pred, label, count(*) AS n FROM {src} GROUP BY {g}pred, label)",
        f"tot AS (SELECT {g}CAST(sum(n) AS DOUBLE) AS N FROM ct {gb})",
        f"ma AS (SELECT {g}label, CAST(sum(n) AS DOUBLE) AS a FROM ct GROUP BY {g}label)",
        f"mb AS (SELECT {g}pred, CAST(sum(n) AS DOUBLE) AS b FROM ct GROUP BY {g}pred)",
        f"mi AS (SELECT {g}sum(ct.n / tot.N * ln(tot.N * ct.n / (ma.a * mb.b))) AS mi FROM ct "
        f"JOIN ma USING ({g}label) JOIN mb USING ({g}pred) JOIN tot {j('tot')} {gb})",
        f"ha AS (SELECT {g}-sum(a / N * ln(a / N)) AS h_label, count(*) AS n_labels FROM ma JOIN tot {j('tot')} {gb})",
        f"hb AS (SELECT {g}-sum(b / N * ln(b / N)) AS h_pred, count(*) AS n_preds FROM mb JOIN tot {j('tot')} {gb})",
        f"emi AS (SELECT {g}sum(nij / N * ln(N * nij / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(N - a + 1) "
        f"+ lgamma(N - b + 1) - lgamma(N + 1) - lgamma(nij + 1) - lgamma(a - nij + 1) - lgamma(b - nij + 1) "
        f"- lgamma(N - a - b + nij + 1))) AS emi FROM (SELECT {('ma.' + by + ', ') if by else ''}ma.a, mb.b, tot.N, "
        f"CAST(unnest(generate_series(CAST(greatest(1, ma.a + mb.b - tot.N) AS BIGINT), CAST(least(ma.a, mb.b) AS BIGINT))) AS DOUBLE) AS nij "
        f"FROM ma JOIN mb {j('mb')} JOIN tot {('USING (' + by + ')') if by else 'ON TRUE'}) {gb})",
        f"sc AS (SELECT {('mi.' + by + ', ') if by else ''}"
        f"CASE WHEN n_labels = 1 AND n_preds = 1 THEN 1.0 WHEN mi <= 0 THEN 0.0 ELSE mi / sqrt(h_label * h_pred) END AS nmi, "
        f"CASE WHEN n_labels = 1 AND n_preds = 1 THEN 1.0 ELSE (mi - emi) / CASE WHEN greatest(h_label, h_pred) - emi < 0 "
        f"THEN least(greatest(h_label, h_pred) - emi, -2.220446049250313e-16) ELSE greatest(greatest(h_label, h_pred) - emi, "
        f"2.220446049250313e-16) END END AS ami FROM mi JOIN ha {j('ha')} JOIN hb {j('hb')} JOIN emi {j('emi')})",
    ]
    if k:
        # Best one-to-one matching: clusters in turn, over the sets of labels already taken.
        one = f"{by}, " if by else ""
        on = f"ct.{by} = d.{by} AND " if by else ""
        got = f"d.{by}, " if by else ""
        ctes.append(f"d0 AS (SELECT {one}CAST(0 AS BIGINT) AS mask, CAST(0 AS HUGEINT) AS s, CAST([] AS INTEGER[]) AS path FROM tot)")
        for i in range(k):
            ctes.append(f"d{i + 1} AS (SELECT {one}mask, max(s) AS s, arg_max(path, s) AS path FROM (SELECT {got}d.mask | (1 << l) AS mask, "
                        f"d.s + coalesce(ct.n, 0) AS s, list_append(d.path, CAST(l AS INTEGER)) AS path FROM d{i} d "
                        f"JOIN (SELECT unnest(range({k})) AS l) t ON (d.mask & (1 << l)) = 0 "
                        f"LEFT JOIN ct ON {on}ct.pred = {i} AND ct.label = l) GROUP BY {one}mask)")
        ctes.append(f"acc AS (SELECT {one}s / N AS acc, path FROM d{k} JOIN tot {j('tot')})")
    return ctes


@register("contingency_table", lambda: with_(*_pred10()) + "SELECT pred, label, count(*) AS n FROM pred GROUP BY pred, label")
def q_contingency(spark, sf_dir):
    return M.contingency_table(fx.pred(spark, sf_dir))


@register("clustering_accuracy", lambda: with_(*_pred10(), *sql_scores("pred", None, 10)) + "SELECT round(acc, 6) AS acc FROM acc")
def q_accuracy(spark, sf_dir):
    a = M.clustering_accuracy(fx.pred(spark, sf_dir))
    return a.select(F.round("acc", 6).alias("acc"))


@register("align_labels", lambda: with_(*_pred10(), *sql_scores("pred", None, 10)) +
          "SELECT CAST(generate_subscripts(path, 1) - 1 AS INTEGER) AS pred, unnest(path) AS aligned_label FROM acc")
def q_align(spark, sf_dir):
    return M.align_labels(fx.pred(spark, sf_dir))


@register("normalized_mutual_information", lambda: with_(*_pred10(), *sql_scores("pred")) + "SELECT round(nmi, 6) AS nmi FROM sc")
def q_nmi(spark, sf_dir):
    return M.normalized_mutual_information(fx.pred(spark, sf_dir)).select(F.round("nmi", 6).alias("nmi"))


@register("adjusted_mutual_information", lambda: with_(*_pred10(), *sql_scores("pred")) + "SELECT round(ami, 6) AS ami FROM sc")
def q_ami(spark, sf_dir):
    return M.adjusted_mutual_information(fx.pred(spark, sf_dir)).select(F.round("ami", 6).alias("ami"))


@register("label_accuracy", lambda: with_(*_pred10()) +
          "SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS label_acc FROM pred")
def q_label_acc(spark, sf_dir):
    return M.label_accuracy(fx.pred(spark, sf_dir)).select(F.round("label_acc", 6).alias("label_acc"))


@register("label_change_rate", lambda: with_(feat_cte(), trials_cte()) +
          "SELECT round(avg(CASE WHEN a.pred <> b.pred THEN 1.0 ELSE 0.0 END), 6) AS change_rate "
          "FROM trials a JOIN trials b ON a.vec_id = b.vec_id AND a.trial = 0 AND b.trial = 1")
def q_change_rate(spark, sf_dir):
    t = fx.trials(spark, sf_dir)
    r = M.label_change_rate(t.filter("trial = 0"), t.filter("trial = 1"), "vec_id", "pred")
    return r.select(F.round("change_rate", 6).alias("change_rate"))


def _trial_metrics_sql():
    return [feat_cte(), trials_cte(), *sql_scores("trials", "trial", 10),
            "tm AS (SELECT trial, acc, nmi, ami FROM acc JOIN sc USING (trial))"]


@register("trial_metrics", lambda: with_(*_trial_metrics_sql()) +
          "SELECT trial, round(acc, 6) AS acc, round(nmi, 6) AS nmi, round(ami, 6) AS ami FROM tm")
def q_trial_metrics(spark, sf_dir):
    t = fx.trials(spark, sf_dir).persist()
    s = M.cluster_scores(t, by=["trial"])
    return s.select("trial", *[F.round(c, 6).alias(c) for c in ("acc", "nmi", "ami")])


@register("trial_summary", lambda: with_(*_trial_metrics_sql()) +
          "SELECT round(avg(acc), 6) AS acc_mean, round(stddev_pop(acc), 6) AS acc_std, round(max(acc), 6) AS best_acc, "
          "round(avg(nmi), 6) AS nmi_mean, round(stddev_pop(nmi), 6) AS nmi_std, round(max(nmi), 6) AS best_nmi, "
          "round(avg(ami), 6) AS ami_mean, round(stddev_pop(ami), 6) AS ami_std, round(max(ami), 6) AS best_ami, "
          "CAST(arg_max(trial, struct_pack(a := acc, t := -trial)) AS INTEGER) AS best_trial FROM tm")
def q_trial_summary(spark, sf_dir):
    t = fx.trials(spark, sf_dir).persist()
    s = M.cluster_scores(t, by=["trial"])
    out = trial_summary(s, [])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns if c != "best_trial"], "best_trial")


@register("best_trial_so_far", lambda: with_(*_trial_metrics_sql()) +
          "SELECT trial, acc > coalesce(max(acc) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS kept FROM tm")
def q_best_so_far(spark, sf_dir):
    t = fx.trials(spark, sf_dir).persist()
    s = M.cluster_scores(t, by=["trial"]).withColumn("run", F.lit(0))
    return W.best_trial_so_far(s, ["run"], "trial", "acc").select("trial", "kept")


@register("format_mean_std", lambda: with_(*_trial_metrics_sql()) +
          "SELECT printf('$%.2f\\pm%.2f\\%%$', avg(acc) * 100, stddev_pop(acc) * 100) || ' | ' || "
          "printf('$%.2f\\pm%.2f\\%%$', avg(nmi) * 100, stddev_pop(nmi) * 100) || ' | ' || "
          "printf('$%.2f\\pm%.2f\\%%$', avg(ami) * 100, stddev_pop(ami) * 100) AS report FROM tm")
def q_format(spark, sf_dir):
    t = fx.trials(spark, sf_dir).persist()
    s = trial_summary(M.cluster_scores(t, by=["trial"]), [])
    return s.select(format_mean_std([("acc_mean", "acc_std"), ("nmi_mean", "nmi_std"), ("ami_mean", "ami_std")]).alias("report"))
