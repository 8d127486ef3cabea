"""Queries over derived predictions: scores, calibration, bootstrap, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.operators import bootstrap as B
from casemill.operators import metrics as M
from casemill.operators import ordering as O
from casemill.queries import derived as D
from casemill.sources import files as S

QUERIES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


_PREDS = "WITH " + D.predictions_sql()
_SCORES = _PREDS + """, counts AS (SELECT model, series, sum(y) AS support, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS predicted,
    sum(CASE WHEN p >= 0.5 THEN y ELSE 0 END) AS tp, avg((y - p) * (y - p)) AS brier FROM preds GROUP BY model, series),
  scores AS (SELECT model, series, support, predicted, CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS f1, brier FROM counts)"""


@query(_SCORES + " SELECT model, series, support, predicted, round(f1, 6) AS f1, round(brier, 6) AS brier FROM scores")
def class_scores(spark, d):
    return M.class_scores(D.predictions(spark, d)).withColumn("f1", D.r6("f1")).withColumn("brier", D.r6("brier"))


_MACRO = _SCORES + """, macro AS (SELECT model, avg(f1) AS macro_f1, avg(f1) FILTER (WHERE support >= 10) AS macro_f1_supported,
    count(*) FILTER (WHERE support >= 10) AS supported_classes, count(*) AS classes FROM scores GROUP BY model)"""


@query(_MACRO + """ SELECT model, round(macro_f1, 6) AS macro_f1, round(macro_f1_supported, 6) AS macro_f1_supported,
  supported_classes, classes FROM macro""")
def macro_f1(spark, d):
    rows = M.macro_f1(M.class_scores(D.predictions(spark, d)))
    return rows.withColumn("macro_f1", D.r6("macro_f1")).withColumn("macro_f1_supported", D.r6("macro_f1_supported"))


@query(_PREDS + """ SELECT case_no, series, max(y) AS y, round(avg(p), 6) AS p FROM preds WHERE model IN ('baseline', 'finetune')
  GROUP BY case_no, series""")
def ensemble_average(spark, d):
    return M.ensemble(D.predictions(spark, d), ["baseline", "finetune"]).select("case_no", "series", "y", D.r6("p").alias("p"))


@query("""SELECT CAST(o_custkey % 400 AS VARCHAR) AS series, count(DISTINCT o_orderkey % 3) AS members FROM orders WHERE o_orderstatus = 'P'
  GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) < 3""")
def class_set_mismatches(spark, d):
    """Customer groups whose pending orders leave out one of three order kinds."""
    rows = D.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(
        (F.col("o_custkey") % 400).cast("string").alias("series"), (F.col("o_orderkey") % 3).cast("string").alias("model"))
    return M.class_set_mismatches(rows, ["0", "1", "2"])


@query(_MACRO + " SELECT model, round(macro_f1_supported, 6) AS macro_f1_supported FROM macro ORDER BY macro_f1_supported DESC, model LIMIT 1")
def best_configuration(spark, d):
    rows = M.macro_f1(M.class_scores(D.predictions(spark, d)))
    return M.best_configuration(rows, "model", "macro_f1_supported").withColumn("macro_f1_supported", D.r6("macro_f1_supported"))


@query(_MACRO + """, m AS (SELECT max(macro_f1) FILTER (WHERE model = 'baseline') AS b, max(macro_f1) FILTER (WHERE model = 'finetune') AS f,
    max(macro_f1) FILTER (WHERE model = 'zeroshot') AS z FROM macro),
  r AS (SELECT 'finetune_gain' AS name, f - b AS value, 0.05 AS expected FROM m UNION ALL SELECT 'zeroshot_gap', f - z, 0.10 FROM m)
  SELECT name, round(value, 6) AS value, expected, CASE WHEN value >= expected THEN 'Met' ELSE 'Failed' END AS verdict FROM r""")
def expectation_verdicts(spark, d):
    macro = M.macro_f1(M.class_scores(D.predictions(spark, d)))
    of = {m: F.max(F.when(F.col("model") == m, F.col("macro_f1"))) for m in D.MODELS}
    one = macro.agg((of["finetune"] - of["baseline"]).alias("gain"), (of["finetune"] - of["zeroshot"]).alias("gap"))
    rows = one.select(F.inline(F.array(F.struct(F.lit("finetune_gain").alias("name"), F.col("gain").alias("value")),
                                       F.struct(F.lit("zeroshot_gap").alias("name"), F.col("gap").alias("value")))))
    return M.verdicts(rows).withColumn("value", D.r6("value"))


_BINS = _PREDS + """, bins AS (SELECT model, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, count(*) AS points, avg(p) AS mean_predicted,
    avg(y) AS observed FROM preds GROUP BY 1, 2)"""


@query(_BINS + " SELECT model, bin, points, round(mean_predicted, 6) AS mean_predicted, round(observed, 6) AS observed FROM bins")
def reliability_bins(spark, d):
    rows = M.reliability(D.predictions(spark, d))
    return rows.withColumn("mean_predicted", D.r6("mean_predicted")).withColumn("observed", D.r6("observed"))


@query(_BINS + " SELECT model, round(sum(points * abs(mean_predicted - observed)) / sum(points), 6) AS ece FROM bins GROUP BY model")
def calibration_error(spark, d):
    return M.expected_calibration_error(M.reliability(D.predictions(spark, d))).withColumn("ece", D.r6("ece"))


@query("""WITH c AS (SELECT o_orderstatus AS a, CASE WHEN o_orderpriority < '3' THEN 'F' WHEN o_orderpriority < '5' THEN 'O' ELSE 'P' END AS b,
      count(*) AS n FROM orders GROUP BY 1, 2),
    t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS agree FROM c),
    e AS (SELECT sum(x.na * y.nb) AS chance FROM (SELECT a, sum(n) AS na FROM c GROUP BY a) x JOIN (SELECT b, sum(n) AS nb FROM c GROUP BY b) y ON x.a = y.b)
  SELECT n, round(agree / n, 6) AS agreement, round((agree / n - chance / (n * n)) / (1 - chance / (n * n)), 6) AS kappa FROM t, e""")
def kappa(spark, d):
    p = F.col("o_orderpriority")
    pairs = D.table(spark, d, "orders").select("o_orderstatus", F.when(p < "3", "F").when(p < "5", "O").otherwise("P").alias("b"))
    return M.cohen_kappa(pairs, "o_orderstatus", "b").withColumn("agreement", D.r6("agreement")).withColumn("kappa", D.r6("kappa"))


@query(_PREDS + """, b AS (SELECT x.p AS p0, z.p AS p1 FROM preds x JOIN preds z ON x.case_no = z.case_no AND x.series = z.series
    WHERE x.model = 'baseline' AND z.model = 'zeroshot')
  SELECT count(*) AS pairs, round(avg(abs(p1 - p0)), 6) AS mean_change, round(max(abs(p1 - p0)), 6) AS max_change,
    sum(CASE WHEN (p0 >= 0.5) <> (p1 >= 0.5) THEN 1 ELSE 0 END) AS flips FROM b""")
def prediction_drift(spark, d):
    rows = D.predictions(spark, d)
    got = M.drift(rows.filter("model = 'baseline'"), rows.filter("model = 'zeroshot'"))
    return got.withColumn("mean_change", D.r6("mean_change")).withColumn("max_change", D.r6("max_change"))


@query(_PREDS + " SELECT case_no, series, p FROM preds WHERE model = 'baseline'")
def probabilities_json(spark, d):
    """Probabilities stored as one JSON map per case and read back, one row per class."""
    rows = D.predictions(spark, d).filter("model = 'baseline'")
    classes = rows.agg(F.sort_array(F.collect_set("series"))).scalar()
    return S.json_to_probs(S.probs_to_json(rows, ["case_no"]), classes)


@query(_PREDS + """, ranked AS (SELECT case_no, series, p, row_number() OVER (PARTITION BY case_no ORDER BY p DESC, series) AS r FROM preds
    WHERE model = 'finetune')
  SELECT case_no, string_agg(series, '|' ORDER BY r) AS top FROM ranked WHERE r <= 3 GROUP BY case_no""")
def top_probabilities(spark, d):
    rows = S.probs_to_json(D.predictions(spark, d).filter("model = 'finetune'"), ["case_no"])
    top = S.top_probabilities(F.col("probs"))
    return rows.select("case_no", F.array_join(F.transform(top, lambda t: t["series"]), "|").alias("top"))


@query(_PREDS + " SELECT case_no, model, series, p FROM preds")
def wide_predictions(spark, d):
    """Long predictions to ``model:series`` columns and back."""
    rows = D.predictions(spark, d)
    names = sorted(f"{r.model}:{r.series}" for r in rows.select("model", "series").distinct().collect())
    wide = S.long_to_wide(rows, ["case_no"], names)
    return S.wide_to_long(wide, ["case_no"]).select("case_no", "model", "series", "p")


def _mixed(v: str) -> str:
    once = f"((({v}) % 2147483647 * 48271 + 11) % 2147483647)"
    return f"((({once} * {once} + 12345) % 2147483647) * 69621 % 2147483647)"


REPS = 2000
_BOOT = _PREDS + f""", outcomes AS (SELECT case_no, model, series, CASE WHEN y = 1 AND p >= 0.5 THEN 'tp' WHEN p >= 0.5 THEN 'fp' WHEN y = 1 THEN 'fn' END AS code
    FROM preds),
  shown AS (SELECT case_no, coalesce(string_agg(model || chr(31) || series || chr(31) || code, chr(30) ORDER BY model || chr(31) || series || chr(31) || code), '') AS pattern
    FROM outcomes GROUP BY case_no),
  idx AS (SELECT pattern, row_number() OVER (ORDER BY pattern, case_no) - 1 AS i FROM shown),
  pattern_rows AS (SELECT c.pattern, o.model, o.series, o.code FROM (SELECT pattern, min(case_no) AS case_no FROM shown GROUP BY pattern) c
    JOIN outcomes o USING (case_no)),
  size AS (SELECT count(*) AS n FROM idx),
  numbers AS (SELECT unnest(range(n)) AS j FROM size), mixed AS (SELECT {_mixed('j')} AS a FROM numbers),
  offsets AS (SELECT rep, {_mixed('rep + 1')} AS b FROM (SELECT unnest(range({REPS})) AS rep)),
  drawn AS (SELECT rep, {_mixed('a + b')} % n AS i, count(*) AS k FROM mixed, offsets, size GROUP BY ALL),
  k AS (SELECT rep, pattern, sum(k) AS k FROM drawn JOIN idx USING (i) GROUP BY rep, pattern UNION ALL SELECT -1, pattern, count(*) FROM idx GROUP BY pattern),
  sums AS (SELECT rep, model, series, sum(k) FILTER (WHERE code = 'tp') AS tp, sum(k) FILTER (WHERE code = 'fp') AS fp, sum(k) FILTER (WHERE code = 'fn') AS fn
    FROM k JOIN pattern_rows USING (pattern) GROUP BY ALL),
  support AS (SELECT series, sum(y) / 3 AS support FROM preds GROUP BY series),
  f AS (SELECT rep, model, series, support, coalesce(2 * tp, 0) / nullif(2 * coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0), 0) AS f1
    FROM sums JOIN support USING (series)),
  macros AS (SELECT rep, model, avg(coalesce(f1, 0)) AS m, avg(coalesce(f1, 0)) FILTER (WHERE support >= 10) AS ms FROM f GROUP BY rep, model),
  named AS (SELECT rep, model AS name, m, ms FROM macros UNION ALL
    SELECT x.rep, 'finetune minus ' || z.model, x.m - z.m, x.ms - z.ms FROM macros x JOIN macros z ON x.rep = z.rep
    WHERE x.model = 'finetune' AND z.model IN ('baseline', 'zeroshot'))"""


@query(_BOOT + """ SELECT name, round(max(m) FILTER (WHERE rep = -1), 6) AS value, round(quantile_cont(m, 0.025) FILTER (WHERE rep >= 0), 6) AS low,
    round(quantile_cont(m, 0.975) FILTER (WHERE rep >= 0), 6) AS high,
    round(avg(CASE WHEN m > 0 THEN 1 ELSE 0 END) FILTER (WHERE rep >= 0), 6) AS positive,
    round(max(ms) FILTER (WHERE rep = -1), 6) AS supported_value, round(quantile_cont(ms, 0.025) FILTER (WHERE rep >= 0), 6) AS supported_low,
    round(quantile_cont(ms, 0.975) FILTER (WHERE rep >= 0), 6) AS supported_high,
    round(avg(CASE WHEN ms > 0 THEN 1 ELSE 0 END) FILTER (WHERE rep >= 0), 6) AS supported_positive
  FROM named GROUP BY name""")
def bootstrap_macro_f1(spark, d):
    got = B.intervals(B.resampled_macro_f1(D.predictions(spark, d), REPS), [("finetune", "baseline"), ("finetune", "zeroshot")])
    return got.select("name", *[D.r6(c).alias(c) for c in got.columns if c != "name"])


@query("""SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS q50 FROM events GROUP BY event_type""")
def median_seconds(spark, d):
    return O.quantiles(D.table(spark, d, "events"), "value", [0.5], ["event_type"])
