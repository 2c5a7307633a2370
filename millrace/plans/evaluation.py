"""Queries of joins, metrics, statistics, quality checks and replay, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numbers
from millrace.operators import compare, images, joins, metrics, ml, quality, series, stats
from millrace.plans import models
from millrace.plans.reference import DENSE, ORDER_DAYS, calendar_densify, order_days, rounded
from millrace.sources import files, scratch
from millrace.sources.tables import clean, table
from millrace.streaming import replay

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- joins


@query("""
WITH o AS (SELECT o_custkey AS k, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1)
SELECT c.c_custkey AS k, c.c_mktsegment, o.n_orders, o.spent FROM customer c JOIN o ON c.c_custkey = o.k""")
def one_to_one_join(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    spent = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return joins.one_to_one(customers, spent, ["k"])


@query("""
SELECT l.l_orderkey, l.l_linenumber, n.n_name, r.r_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE l.l_quantity >= 45""")
def dimension_lookups(spark, folder):
    t = lambda n: table(spark, folder, n)
    big = t("lineitem").filter("l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_suppkey")
    suppliers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return big.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "n_name", "r_name")


@query(f"""WITH {ORDER_DAYS}
SELECT a.series, a.day, a.total, b.total AS offset1, c.total AS offset7 FROM days a LEFT JOIN days b ON b.day = a.day - 1 LEFT JOIN days c ON c.day = a.day - 7""")
def exact_offset_lookup(spark, folder):
    return joins.exact_offset(order_days(spark, folder), ["series"], "day", "total", [1, 7])


@query(f"""WITH {ORDER_DAYS}
SELECT a.series, a.day, a.total, round(avg(b.total), 6) AS range_mean, count(b.total) AS range_n FROM days a LEFT JOIN days b ON b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY ALL""")
def range_window_verifier(spark, folder):
    return rounded(joins.range_lookup(order_days(spark, folder), ["series"], "day", "total", 7), "range_mean")


_HEX = """h AS (SELECT DISTINCT image_id AS k, CAST(('0x' || image_phash)::UBIGINT AS UBIGINT) AS b FROM vehicle_objects
  WHERE image_id IS NOT NULL AND regexp_matches(image_phash, '^[0-9a-fA-F]{1,16}$')),
heads AS (SELECT b, min(k) AS head FROM h GROUP BY b)"""


@query(f"""WITH {_HEX}
SELECT x.head AS a, y.head AS b, CAST(bit_count(xor(x.b, y.b)) AS INTEGER) AS distance FROM heads x JOIN heads y ON x.head < y.head AND bit_count(xor(x.b, y.b)) <= 6
UNION ALL SELECT heads.head, h.k, 0 FROM h JOIN heads ON h.b = heads.b WHERE h.k <> heads.head""")
def near_dup_pairs(spark, folder):
    rows = table(spark, folder, "vehicle_objects").select("image_id", numbers.hash_from_hex(F.col("image_phash")).alias("bits"))
    return joins.near_hashes(rows, "image_id", "bits", 6)


@query(f"""WITH RECURSIVE {_HEX},
edges AS (SELECT x.head AS a, y.head AS b FROM heads x JOIN heads y ON x.head <> y.head AND bit_count(xor(x.b, y.b)) <= 6
  UNION SELECT heads.head, h.k FROM h JOIN heads ON h.b = heads.b WHERE h.k <> heads.head
  UNION SELECT h.k, heads.head FROM h JOIN heads ON h.b = heads.b WHERE h.k <> heads.head),
reach(node, low) AS (SELECT DISTINCT a, a FROM edges UNION SELECT e.b, r.low FROM reach r JOIN edges e ON r.node = e.a WHERE r.low < e.b)
SELECT node AS member, min(low) AS group_id FROM reach GROUP BY node""")
def near_dup_components(spark, folder):
    return joins.smallest_linked(near_dup_pairs(spark, folder))


@query("""
WITH r AS (SELECT DISTINCT doc_id AS b, sha256(text) AS h FROM documents WHERE text IS NOT NULL), g AS (SELECT h, min(b) AS a FROM r GROUP BY h)
SELECT g.a, r.b FROM r JOIN g ON r.h = g.h WHERE g.a < r.b""")
def identical_text_groups(spark, folder):
    return joins.identical_groups(table(spark, folder, "documents"), "doc_id", "text")


@query("""
WITH a AS (SELECT DISTINCT station_id AS k FROM air_hourly WHERE station_id IS NOT NULL), b AS (SELECT DISTINCT station_id AS k FROM documents WHERE station_id IS NOT NULL)
SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right
FROM a FULL JOIN b ON a.k = b.k""")
def set_coverage_checks(spark, folder):
    return joins.coverage(table(spark, folder, "air_hourly"), table(spark, folder, "documents"), "station_id")


# --- metrics

_FORECAST = f"""{DENSE},
f AS (SELECT day, total AS actual, lag(total, 1) OVER w AS persistence, lag(total, 7) OVER w AS seasonal_naive7,
  CASE WHEN day >= DATE '2000-01-01' THEN 'test' WHEN day >= DATE '1999-01-01' THEN 'validation' ELSE 'train' END AS split,
  CASE WHEN month(day) IN (12, 1, 2) THEN 'winter' WHEN month(day) <= 5 THEN 'spring' WHEN month(day) <= 8 THEN 'summer' ELSE 'autumn' END AS season
  FROM dense WINDOW w AS (ORDER BY day)),
l AS (SELECT day, split, season, 'persistence' AS model, actual, persistence AS predicted FROM f UNION ALL
      SELECT day, split, season, 'seasonal_naive7', actual, seasonal_naive7 FROM f UNION ALL
      SELECT day, split, season, 'train_mean', actual, avg(actual) FILTER (WHERE split = 'train') OVER () FROM f),
v AS (SELECT * FROM l WHERE actual IS NOT NULL AND predicted IS NOT NULL)"""
_MEASURES = """count(*) AS n, round(avg(abs(actual - predicted)), 3) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 3) AS rmse,
round(1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)), 6) AS r2"""


def _forecasts(spark, folder):
    split = series.chronological_split(F.col("day"), "1999-01-01", "2000-01-01")
    out = series.baselines(calendar_densify(spark, folder), ["series"], "day", "total", split == "train")
    out = out.withColumn("split", split).withColumn("season", numbers.season(F.col("day")))
    return metrics.long_predictions(out, ["day", "split", "season"], "total", ["persistence", "seasonal_naive7", "train_mean"])


def _measured(df):
    return rounded(rounded(df, "mae", "rmse", digits=3), "r2")


@query(f"WITH {_FORECAST} SELECT split, model, {_MEASURES} FROM v GROUP BY ALL")
def baselines_metrics(spark, folder):
    return _measured(metrics.regression_metrics(_forecasts(spark, folder), ["split", "model"]))


@query(f"WITH {_FORECAST} SELECT split, season, model, {_MEASURES} FROM v GROUP BY ALL")
def seasonal_metrics(spark, folder):
    return _measured(metrics.regression_metrics(_forecasts(spark, folder), ["split", "season", "model"]))


@query(f"""WITH {_FORECAST}, t AS (SELECT quantile_cont(actual, 0.9) AS p90 FROM f WHERE split <> 'test')
SELECT model, actual > p90 AS peak, {_MEASURES} FROM v, t WHERE split = 'test' GROUP BY ALL HAVING count(*) > 1""")
def peak_metrics(spark, folder):
    long = _forecasts(spark, folder)
    limit = long.filter("split <> 'test' AND model = 'persistence'").agg(F.percentile("actual", F.lit(0.9)).alias("p90"))
    return _measured(metrics.peak_metrics(long.filter("split = 'test'"), ["model"], limit, "p90"))


@query(f"""WITH {_FORECAST}, m AS (SELECT split, model, avg(abs(actual - predicted)) AS mae FROM v GROUP BY ALL)
SELECT m.split, m.model, round(100 * (1 - m.mae / b.mae), 6) AS improvement_pct FROM m JOIN m b ON m.split = b.split AND b.model = 'persistence'""")
def relative_improvement(spark, folder):
    m = metrics.regression_metrics(_forecasts(spark, folder), ["split", "model"])
    return rounded(metrics.improvement(m, ["split"], "persistence").select("split", "model", "improvement_pct"), "improvement_pct")


@query(f"""WITH {_FORECAST} SELECT model, day, actual, predicted, round(abs(actual - predicted), 4) AS error FROM v WHERE split = 'test'
ORDER BY abs(actual - predicted) DESC, day, model LIMIT 15""")
def largest_errors(spark, folder):
    rows = _forecasts(spark, folder).filter("split = 'test' AND actual IS NOT NULL AND predicted IS NOT NULL")
    rows = rows.select("model", "day", "actual", "predicted", F.abs(F.col("actual") - F.col("predicted")).alias("error"))
    return rounded(compare.top_k(rows, [F.desc("error"), F.asc("day"), F.asc("model")], 15), "error", digits=4)


@query(f"""WITH {_FORECAST}, m AS (SELECT model, avg(abs(actual - predicted)) AS mae FROM v WHERE split = 'validation' GROUP BY ALL)
SELECT model, round(mae, 3) AS mae FROM m JOIN (VALUES ('train_mean', 0), ('persistence', 1), ('seasonal_naive7', 2)) t(name, trial) ON model = name ORDER BY mae, trial LIMIT 1""")
def select_best_trial(spark, folder):
    m = metrics.regression_metrics(_forecasts(spark, folder).filter("split = 'validation'"), ["model"])
    trials = spark.createDataFrame([("train_mean", 0), ("persistence", 1), ("seasonal_naive7", 2)], "model string, trial int")
    return ml.first_best(m.join(trials, "model"), "mae", "trial").select("model", F.round("mae", 3).alias("mae"))


@query(f"WITH {_FORECAST} SELECT split, model, {_MEASURES} FROM v GROUP BY ALL")
def stored_prediction_metrics(spark, folder):
    """Metrics anew from predictions that were written as compressed CSV and read back."""
    rows = _forecasts(spark, folder)
    place = scratch.new_folder(spark, "predictions")
    files.write_csv(rows, place, gzip=True, mark=True)
    stored = spark.read.option("header", True).schema(rows.schema).option("enforceSchema", True).csv(place)
    return _measured(metrics.regression_metrics(stored, ["split", "model"]))


#: The class that a rule on the box's area predicts.
_LABELS = ["bus", "car", "truck"]
_RULE = "CASE WHEN bbox_width * bbox_height >= 12000 THEN 'bus' WHEN bbox_width * bbox_height >= 6000 THEN 'truck' ELSE 'car' END"
_CLASS = f"""c AS (SELECT scene_group, vehicle_class AS actual, {_RULE} AS predicted FROM vehicle_objects WHERE vehicle_class IN ('bus', 'car', 'truck') AND bbox_width IS NOT NULL AND bbox_height IS NOT NULL AND NOT isnan(bbox_width) AND NOT isnan(bbox_height)),
lab(x) AS (VALUES ('bus'), ('car'), ('truck')),
m AS (SELECT a.x AS actual, p.x AS predicted, (SELECT count(*) FROM c WHERE c.actual = a.x AND c.predicted = p.x) AS n FROM lab a, lab p),
s AS (SELECT x AS label, (SELECT sum(n) FROM m WHERE actual = x) AS support, (SELECT sum(n) FROM m WHERE predicted = x) AS claimed, (SELECT sum(n) FROM m WHERE actual = x AND predicted = x) AS tp FROM lab),
rep AS (SELECT label, CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r,
  CASE WHEN claimed + support > 0 THEN 2 * tp / (claimed + support) ELSE 0 END AS f, support, tp, claimed FROM s)"""


def _classified(spark, folder):
    rows = clean(spark, folder, "vehicle_objects").filter(F.col("vehicle_class").isin(_LABELS)).dropna(subset=["bbox_width", "bbox_height"])
    return rows.select("scene_group", F.col("vehicle_class").alias("actual"), F.expr(_RULE).alias("predicted"))


@query(f"WITH {_CLASS} SELECT actual, predicted, CAST(n AS BIGINT) AS n FROM m")
def confusion_matrix(spark, folder):
    return metrics.confusion(_classified(spark, folder), [], _LABELS)


@query(f"""WITH {_CLASS} SELECT label, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, CAST(support AS BIGINT) AS support,
CAST(tp AS BIGINT) AS tp, CAST(claimed - tp AS BIGINT) AS fp, CAST(support - tp AS BIGINT) AS fn FROM rep""")
def error_accounting(spark, folder):
    return rounded(metrics.class_report(confusion_matrix(spark, folder), []), "precision", "recall", "f1", digits=9)


@query(f"""WITH {_CLASS}, a AS (SELECT sum(tp) / sum(support) AS acc, CAST(sum(support) AS BIGINT) AS n FROM rep)
SELECT 'accuracy' AS label, round(acc, 9) AS precision, round(acc, 9) AS recall, round(acc, 9) AS f1, n AS support FROM a
UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), (SELECT n FROM a) FROM rep
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9), round(sum(f * support) / sum(support), 9), (SELECT n FROM a) FROM rep""")
def classification_summary(spark, folder):
    report = metrics.class_report(confusion_matrix(spark, folder), [])
    return rounded(metrics.summary_rows(report, []), "precision", "recall", "f1", digits=9)


@query(f"WITH {_CLASS} SELECT round(avg(f), 9) AS macro_f1, round(sum(tp) / sum(support), 9) AS accuracy, CAST(sum(support) AS BIGINT) AS n FROM rep")
def macro_f1(spark, folder):
    return rounded(metrics.macro_f1(confusion_matrix(spark, folder), []), "macro_f1", "accuracy", digits=9)


@query(f"WITH {_CLASS} SELECT actual, predicted, count(*) AS n FROM c WHERE actual <> predicted GROUP BY ALL")
def error_pairs(spark, folder):
    return metrics.error_pairs(_classified(spark, folder), [])


# --- statistics


@query("""
WITH v AS (SELECT l_quantity, l_extendedprice, l_discount, CASE WHEN l_tax < 0.07 THEN l_tax END AS l_tax FROM lineitem),
p AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM v WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i:]) + """),
r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM p)
SELECT a, b, count(*) AS n, round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 6) AS rho FROM r GROUP BY ALL""")
def spearman_matrix(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("l_tax", F.when(F.col("l_tax") < 0.07, F.col("l_tax")))
    return rounded(stats.spearman(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "rho")


_REPS, _BLOCKS, _DAYS = 5000, (7, 14, 28), 365


def _lcg_sql(rows: int, per: int, choices: str) -> str:
    m = stats.LCG_M
    s1 = f"((i * 2654435761 + 12345) % {m})"
    s2 = f"(({s1} * {stats.LCG_A} + {stats.LCG_C}) % {m})"
    s3 = f"((({s2} // 7) * {stats.LCG_A} + {stats.LCG_C}) % {m})"
    return f"SELECT i // {per} AS rep, i % {per} AS blk, (({s3} // 13) % {choices}) AS start FROM range({rows}) t(i)"


def _block_sql(block: int) -> str:
    per = -(-_DAYS // block)
    return f"""d{block} AS ({_lcg_sql(_REPS * per, per, str(_DAYS - block + 1))}),
s{block} AS (SELECT rep, blk * {block} + k AS pos, start + k AS pos_day FROM d{block}, range({block}) r(k)),
m{block} AS (SELECT {block} AS block, rep, avg(delta) AS v FROM s{block} s JOIN y ON s.pos_day = y.pos_day WHERE pos < {_DAYS} GROUP BY rep)"""


@query(f"""WITH {DENSE},
e AS (SELECT CAST(day - DATE '2000-01-01' AS INTEGER) AS pos_day, round(total - lag(total) OVER (ORDER BY day), 4) AS delta FROM dense),
y AS (SELECT * FROM e WHERE pos_day BETWEEN 0 AND {_DAYS - 1}),
{", ".join(map(_block_sql, _BLOCKS))},
m AS ({" UNION ALL ".join(f"SELECT * FROM m{b}" for b in _BLOCKS)})
SELECT block, count(v) AS repeats, round(quantile_cont(v, 0.025), 3) AS lower, round(quantile_cont(v, 0.975), 3) AS upper FROM m GROUP BY block""")
def block_bootstrap(spark, folder):
    """5,000 repeats for blocks of 7, 14 and 28 days."""
    days = series.lags(calendar_densify(spark, folder), ["series"], "day", "total", [1])
    days = days.select(F.datediff("day", F.lit("2000-01-01").cast("date")).alias("pos_day"), F.round(F.col("total") - F.col("lag1"), 4).alias("delta"))
    days = days.filter(F.col("pos_day").between(0, _DAYS - 1))
    out = None
    for block in _BLOCKS:
        draws = stats.lcg_draws(spark, _REPS, -(-_DAYS // block), _DAYS - block + 1)
        repeats = stats.interval(stats.block_bootstrap(days, draws, block, _DAYS, "pos_day", "delta"), "mean_value").select(F.lit(block).alias("block"), "*")
        out = repeats if out is None else out.unionByName(repeats)
    return rounded(out, "lower", "upper", digits=3)


_GROUP_REPS = 500
_G = "(SELECT count(*) FROM ids)"


@query(f"""WITH {_CLASS.split(',' + chr(10) + 'm AS')[0]},
g AS (SELECT scene_group AS g, actual, predicted, count(*) AS n FROM c WHERE scene_group > 0 GROUP BY ALL),
ids AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS place FROM (SELECT DISTINCT g FROM g)),
d AS ({_lcg_sql(1, 1, _G).replace("range(1)", f"range({_GROUP_REPS} * {_G})").replace("i // 1 ", f"i // {_G} ").replace("i % 1 ", f"i % {_G} ")}),
w AS (SELECT rep, start AS place, count(*) AS times FROM d GROUP BY ALL),
k AS (SELECT rep, actual, predicted, sum(times * n) AS n FROM w JOIN ids ON w.place = ids.place JOIN g ON ids.g = g.g GROUP BY ALL),
f AS (SELECT rep, x, coalesce(2 * sum(n) FILTER (WHERE actual = x AND predicted = x) / nullif(coalesce(sum(n) FILTER (WHERE actual = x), 0) + coalesce(sum(n) FILTER (WHERE predicted = x), 0), 0), 0) AS f1 FROM k, lab GROUP BY ALL),
m AS (SELECT rep, avg(f1) AS v FROM f GROUP BY rep)
SELECT count(v) AS repeats, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM m""")
def group_bootstrap(spark, folder):
    """500 repeats of whole scene groups, as many as there are; groups that are not known are left out."""
    rows = _classified(spark, folder).filter("scene_group > 0")
    ids = stats.numbered(rows.select("scene_group").distinct(), "scene_group", "place")
    groups = ids.count()
    if not groups:
        return stats.interval(spark.createDataFrame([], "v double"), "v")
    draws = stats.lcg_draws(spark, _GROUP_REPS, groups, groups, "place").withColumn("place", F.col("place").cast("long"))
    counts = stats.group_bootstrap(rows.join(ids, "scene_group"), "place", draws)
    long = metrics.class_report(_full_matrix(counts), ["rep"])
    return rounded(stats.interval(long.groupBy("rep").agg(F.avg("f1").alias("v")), "v"), "lower", "upper")


def _full_matrix(counts):
    """Counts of (rep, actual, predicted) with absent pairs as 0."""
    names = F.array(*[F.lit(c) for c in _LABELS])
    grid = counts.select("rep").distinct().withColumn("actual", F.explode(names)).withColumn("predicted", F.explode(names))
    return grid.join(counts, ["rep", "actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


# --- quality


@query("""
SELECT 'orders_unique' AS name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS failures FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'readings_unique', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM (SELECT reading_id FROM air_hourly GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'readings_located', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM air_hourly WHERE lat IS NULL OR lon IS NULL OR isnan(lat) OR isnan(lon)
UNION ALL SELECT 'origin_before_target', CASE WHEN count(*) FILTER (WHERE NOT coalesce(origin < day, false)) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FILTER (WHERE NOT coalesce(origin < day, false)) FROM (SELECT day, lag(day) OVER (ORDER BY day) AS origin FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)) WHERE origin IS NOT NULL
UNION ALL SELECT 'splits_in_order', CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END, CAST(NOT ok AS BIGINT) FROM (SELECT max(d) FILTER (WHERE s = 0) < min(d) FILTER (WHERE s = 1) AND max(d) FILTER (WHERE s = 1) < min(d) FILTER (WHERE s = 2)
  AND count(*) FILTER (WHERE s = 0) >= 30 AND count(*) FILTER (WHERE s = 1) >= 30 AND count(*) FILTER (WHERE s = 2) >= 30 AS ok
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CASE WHEN d >= DATE '2000-01-01' THEN 2 WHEN d >= DATE '1999-01-01' THEN 1 ELSE 0 END AS s FROM orders))
UNION ALL SELECT 'nations_pinned', CASE WHEN count(*) = 25 THEN 'PASS' ELSE 'FAIL' END, CAST(count(*) <> 25 AS BIGINT) FROM nation
UNION ALL SELECT 'customer_known', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM orders o ANTI JOIN customer c ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'fine_below_coarse', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM air_pairs WHERE NOT coalesce(pm2_5 <= pm10 AND NOT isnan(pm2_5), false)
UNION ALL SELECT 'image_in_one_split', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM (SELECT image_id FROM vehicle_objects WHERE image_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'nothing_to_check', CASE WHEN count(*) = 0 THEN 'NOT_VERIFIABLE' ELSE 'PASS' END, count(*) FROM (SELECT * FROM region LIMIT 0)""")
def quality_checks(spark, folder):
    t = lambda n: clean(spark, folder, n)
    days = order_days(spark, folder).withColumn("split", series.chronological_split(F.col("day"), "1999-01-01", "2000-01-01"))
    steps = series.lags(days, ["series"], "day", "day", [1]).withColumnRenamed("lag1", "origin").filter("origin IS NOT NULL")
    strangers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").isNotNull().alias("known"))
    return quality.together(
        [
            quality.unique_key(t("orders"), ["o_orderkey"], "orders_unique"),
            quality.unique_key(t("air_hourly"), ["reading_id"], "readings_unique"),
            quality.no_nulls(t("air_hourly"), ["lat", "lon"], "readings_located"),
            quality.before_target(steps, "origin", "day", "origin_before_target"),
            quality.splits_in_order(days, "day", "split", ["train", "validation", "test"], 30, "splits_in_order"),
            quality.row_count(t("nation"), 25, "nations_pinned"),
            quality.holds(strangers, F.col("known"), "customer_known"),
            quality.holds(t("air_pairs"), F.col("pm2_5") <= F.col("pm10"), "fine_below_coarse"),
            quality.group_in_one_split(t("vehicle_objects"), "image_id", "split", "image_in_one_split"),
            quality.holds(t("region").limit(0), F.lit(True), "nothing_to_check"),
        ]
    )


@query("SELECT status, count(*) AS checks, CAST(sum(failures) AS BIGINT) AS failures FROM (" + ORACLE["quality_checks"] + ") GROUP BY status")
def quality_roll_up(spark, folder):
    return quality.roll_up(quality_checks(spark, folder))


@query(f"""WITH {DENSE}, a AS (SELECT day, avg(total) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m FROM dense),
b AS (SELECT x.day, avg(y.total) AS m FROM dense x LEFT JOIN dense y ON y.day BETWEEN x.day - 7 AND x.day - 1 GROUP BY x.day)
SELECT 'rolling_mean_verified' AS name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS failures
FROM a JOIN b ON a.day = b.day WHERE NOT coalesce(abs(a.m - b.m) <= 1e-9 + 1e-9 * abs(b.m), a.m IS NULL AND b.m IS NULL)""")
def frames_agree(spark, folder):
    dense = calendar_densify(spark, folder)
    windows = series.rolling(dense, ["series"], "day", "total", {7: 1}, {}).select("series", "day", F.col("rolling_mean7").alias("m"))
    ranges = joins.range_lookup(dense, ["series"], "day", "total", 7).select("series", "day", F.col("range_mean").alias("m"))
    return quality.frames_agree(windows, ranges, ["series", "day"], ["m"], 1e-9, "rolling_mean_verified")


@query()
def table_fingerprint(spark, folder):
    """Order-free hash of the largest table."""
    rows = table(spark, folder, "lineitem")
    return quality.fingerprint(rows, rows.columns)


# --- scans, text, vectors


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_valid(props) AS valid FROM events")
def json_props(spark, folder):
    rows = table(spark, folder, "events")
    return rows.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '[0-9]{2}:[0-9]{2}')) AS times, len(string_split(text, chr(10))) AS lines,
       nullif(regexp_extract(text, '([A-Za-z_0-9]+\.(csv|json|py))', 1), '') AS first_file, contains(text, 'PM10') AS names_pm10
FROM documents WHERE text IS NOT NULL""")
def text_table_extract(spark, folder):
    rows = table(spark, folder, "documents").filter("text IS NOT NULL")
    file_ = F.regexp_extract("text", r"([A-Za-z_0-9]+\.(csv|json|py))", 1)
    return rows.select(
        "doc_id",
        F.size(F.regexp_extract_all("text", F.lit("([0-9]{2}:[0-9]{2})"), F.lit(1))).cast("long").alias("times"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("lines"),
        F.when(file_ != "", file_).alias("first_file"),
        F.contains("text", F.lit("PM10")).alias("names_pm10"),
    )


@query("""
SELECT label, count(*) AS n, round(avg(list_sum(embedding::DOUBLE[])), 4) AS mean_sum, round(avg(len(embedding)), 6) AS width, round(CAST(min(list_min(embedding)) AS DOUBLE), 6) AS low FROM embeddings GROUP BY ALL""")
def vector_stats(spark, folder):
    rows = table(spark, folder, "embeddings")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    out = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(total).alias("mean_sum"), F.avg(F.size("embedding")).alias("width"), F.min(F.array_min("embedding")).cast("double").alias("low")
    )
    return rounded(rounded(out, "mean_sum", digits=4), "width", "low")


@query("""
WITH h AS (SELECT vec_id AS k, CAST(array_to_string([CASE WHEN embedding[i + 1] > 0 THEN '1' ELSE '0' END for i in range(64)], '') AS BIT) AS b FROM embeddings),
heads AS (SELECT b, min(k) AS head FROM h GROUP BY b)
SELECT x.head AS a, y.head AS b, CAST(bit_count(xor(x.b, y.b)) AS INTEGER) AS distance FROM heads x JOIN heads y ON x.head < y.head AND bit_count(xor(x.b, y.b)) <= 6
UNION ALL SELECT heads.head, h.k, 0 FROM h JOIN heads ON h.b = heads.b WHERE h.k <> heads.head""")
def near_vector_pairs(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", images.sign_hash("embedding").alias("bits"))
    return joins.near_hashes(rows, "vec_id", "bits", 6)


@query("""
WITH u AS (SELECT 0 AS part, lower(trim(source)) AS source_id, lang AS note FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT 1, lower(trim(task)), lang FROM eval_items WHERE task IS NOT NULL)
SELECT source_id, note FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY part, coalesce(note, '')) AS r FROM u) WHERE r = 1""")
def union_drift_dedup(spark, folder):
    docs = table(spark, folder, "documents").filter("source IS NOT NULL").select(F.lower(F.trim("source")).alias("source_id"), F.col("lang").alias("language"))
    items = table(spark, folder, "eval_items").filter("task IS NOT NULL").select(F.lower(F.trim("task")).alias("SourceID"), F.col("lang").alias("﻿note"))
    parts = [(docs, {"note": "language"}), (items, {"source_id": "SourceID"})]
    return files.merge_registers(parts, ["source_id"], ["source_id", "note"])


@query()
def manifest_hash(spark, folder):
    """Every file of the folder."""
    return files.manifest(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


# --- replay

#: The 99 % quantile of changes from day to day before 1999.
_THRESHOLD = """(SELECT quantile_cont(abs(d), 0.99) FROM (SELECT CASE WHEN day - lag(day) OVER (ORDER BY day) = 1 THEN total - lag(total) OVER (ORDER BY day) END AS d
  FROM days WHERE day < DATE '1999-01-01'))"""
_REPLAY = f"""{ORDER_DAYS},
o AS (SELECT 'all' AS series, row_number() OVER (ORDER BY day) AS seq, day, total AS level FROM days),
p AS (SELECT *, lag(day) OVER (ORDER BY seq) AS pd, lag(level) OVER (ORDER BY seq) AS pl FROM o),
q AS (SELECT *, coalesce(day - pd = 1, false) AS nd, CASE WHEN level IS NULL THEN 'missing_or_invalid' WHEN seq > 1 AND NOT coalesce(day - pd = 1, false) THEN 'date_gap' ELSE 'valid' END AS quality FROM p),
r AS (SELECT *, sum(CAST(NOT nd OR level IS NULL AS INTEGER)) OVER (ORDER BY seq) AS run FROM q),
h AS (SELECT *, count(level) OVER (PARTITION BY run ORDER BY seq) AS held, CASE WHEN nd THEN level - pl END AS delta FROM r)"""


@query(f"""WITH {_REPLAY}
SELECT series, seq, day AS observation_date, level AS level_cm, quality, round(delta, 4) AS delta_cm,
       coalesce(quality = 'valid' AND abs(delta) > {_THRESHOLD}, false) AS statistical_flag, CAST(day + 1 AS DATE) AS target_date,
       CASE WHEN quality = 'valid' AND held >= 7 THEN level END AS prediction,
       CASE WHEN coalesce(quality = 'valid' AND abs(delta) > {_THRESHOLD}, false) THEN 'check_measurement_and_context_manually' WHEN quality = 'valid' THEN 'routine_observation'
            ELSE 'check_missing_or_invalid_record' END AS proposed_action FROM h""")
def replay_actions(spark, folder):
    return rounded(replay.replay_batch(_observed(spark, folder), _threshold(spark, folder)), "delta_cm", digits=4)


def _observed(spark, folder):
    from pyspark.sql import Window

    days = order_days(spark, folder).withColumn("seq", F.row_number().over(Window.partitionBy("series").orderBy("day")))
    return days.select("series", F.col("seq").cast("long").alias("seq"), F.col("day").cast("string").alias("date"), F.col("total").alias("level"))


def _threshold(spark, folder):
    changes = series.continuity_diff(order_days(spark, folder).filter("day < DATE '1999-01-01'"), ["series"], "day", "total")
    row = compare.quantiles(changes.select(F.abs("delta").alias("d")), [], "d", {"q": 0.99}).first()
    return row["q"] if row and row["q"] is not None else float("inf")


@query(f"""WITH {_REPLAY} SELECT count(*) AS n_rows, count(*) FILTER (WHERE quality = 'valid' AND held >= 7) AS predictions,
count(*) FILTER (WHERE quality = 'valid' AND abs(delta) > {_THRESHOLD}) AS flags, count(*) FILTER (WHERE quality <> 'valid') AS quality_failures FROM h""")
def replay_summary(spark, folder):
    return replay.summary(replay_actions(spark, folder))


#: Input of the fault queries: days from 2022-01-01 with the level 200 + i, and in each series one of the reference's four faults.
_FAULTS = """b AS (SELECT s.series, CAST(i AS BIGINT) AS seq,
    CASE WHEN s.series = 'malformed' AND i = 18 THEN 'bad-date' ELSE strftime(DATE '2022-01-01' + CAST(i AS INTEGER), '%Y-%m-%d') END AS date,
    CASE WHEN s.series = 'missing' AND i = 8 THEN 'NaN' WHEN s.series = 'malformed' AND i = 8 THEN 'bad-value' WHEN s.series = 'boundary' AND i = 1 THEN '231' ELSE CAST(200 + i AS VARCHAR) END AS level
  FROM (VALUES ('gap'), ('missing'), ('malformed'), ('boundary')) s(series), range(24) r(i) WHERE NOT (s.series = 'gap' AND i = 8)),
o AS (SELECT series, seq, TRY_CAST(date AS DATE) AS day, CASE WHEN isfinite(TRY_CAST(level AS DOUBLE)) THEN TRY_CAST(level AS DOUBLE) END AS level FROM b),
p AS (SELECT *, lag(day) OVER w AS pd, lag(level) OVER w AS pl, row_number() OVER w AS place FROM o WINDOW w AS (PARTITION BY series ORDER BY seq)),
q AS (SELECT *, coalesce(day - pd = 1, false) AS nd, CASE WHEN day IS NULL THEN 'invalid_date' WHEN level IS NULL THEN 'missing_or_invalid'
      WHEN place > 1 AND NOT coalesce(day - pd = 1, false) THEN 'date_gap' ELSE 'valid' END AS quality FROM p),
r AS (SELECT *, sum(CAST(NOT nd OR level IS NULL OR day IS NULL AS INTEGER)) OVER (PARTITION BY series ORDER BY seq) AS run FROM q),
h AS (SELECT *, count(CASE WHEN day IS NOT NULL THEN level END) OVER (PARTITION BY series, run ORDER BY seq) AS held, CASE WHEN nd THEN level - pl END AS delta FROM r)"""


def _faults(spark):
    from datetime import date, timedelta

    change = {("malformed", 18, 0): "bad-date", ("missing", 8, 1): "NaN", ("malformed", 8, 1): "bad-value", ("boundary", 1, 1): "231"}
    rows = []
    for name in ("gap", "missing", "malformed", "boundary"):
        for i in range(24):
            if (name, i) != ("gap", 8):
                cells = ((date(2022, 1, 1) + timedelta(days=i)).isoformat(), str(200 + i))
                rows.append((name, i, *[change.get((name, i, k), c) for k, c in enumerate(cells)]))
    return spark.createDataFrame(rows, "series string, seq long, date string, level string")


@query(f"""WITH {_FAULTS}
SELECT series, seq, day AS observation_date, level AS level_cm, quality, delta AS delta_cm, coalesce(quality = 'valid' AND abs(delta) > 31, false) AS statistical_flag,
       CAST(day + 1 AS DATE) AS target_date, CASE WHEN quality = 'valid' AND held >= 7 THEN level END AS prediction,
       CASE WHEN coalesce(quality = 'valid' AND abs(delta) > 31, false) THEN 'check_measurement_and_context_manually' WHEN quality = 'valid' THEN 'routine_observation'
            ELSE 'check_missing_or_invalid_record' END AS proposed_action FROM h""")
def replay_faults(spark, folder):
    """The stateful stream over a gap, a missing value, malformed cells and a change at the threshold."""
    return replay.replay_files(_faults(spark), 31.0)


@query(f"WITH {ORDER_DAYS} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS differences FROM days")
def replay_parity(spark, folder):
    """Stream against batch over all days, with a fitted model: rows, and rows that differ."""
    fitted, threshold = _fitted(spark, folder), _threshold(spark, folder)
    observed = _observed(spark, folder)
    return replay.parity(replay.replay_batch(observed, threshold, fitted), replay.replay_files(observed, threshold, fitted, 3))


def _fitted(spark, folder):
    frame = models._frame(spark, folder)
    return ml.fit_ridge(frame.filter("split <> 'test'"), models.FEATURES, "delta_target", 10.0)


@query(f"""WITH {_REPLAY} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS differences FROM h
WHERE quality = 'valid' AND held >= 7 AND day + 1 IN (SELECT day FROM days)""")
def replay_batch_parity(spark, folder):
    """Forecasts of the replay against those of the batch features on the same dates: rows, and rows off by more than 1e-6 of the level."""
    fitted = _fitted(spark, folder)
    actions = replay.replay_batch(_observed(spark, folder), _threshold(spark, folder), fitted).filter("prediction IS NOT NULL").select("target_date", "prediction")
    batch = fitted.predict(models._frame(spark, folder), "batch", "value_lag1").select(F.col("day").alias("target_date"), "batch")
    both = actions.join(batch, "target_date")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("prediction") - F.col("batch")) > 1e-6 * F.abs("batch")).alias("differences"))
