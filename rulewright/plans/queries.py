"""One registered query for each operator, over the given tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions.hashing import hash_order
from rulewright.operators import baselines, drift, errors, metrics, profile, rules, sampling
from rulewright.plans import grid, tasks
from rulewright.sources import runs, tables
from rulewright.sources.scratch import scratch_path, temporary_tables
from rulewright.streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: md5 order of the samplers in SQL.
HASH = "md5('{seed}|{salt}|' || {id}::VARCHAR)"


def query(sql: str | None = None, *needs: str):
    """Registers a query under the function's name; ``needs`` are tasks that its SQL reads."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            given = ", ".join(tasks.SQL[n] for n in needs)
            ORACLE[f.__name__] = (f"WITH {given}{', ' if sql.lstrip().startswith('+') else ' '}" if given else "") + sql.lstrip().removeprefix("+").lstrip()
        return f

    return register


def h(seed: int, salt: str, column: str = "row_id") -> str:
    return HASH.format(seed=seed, salt=salt, id=column)


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# A: sources, contracts, sinks


@query("SELECT n_nationkey, n_name, count(*) AS n_customers, round(avg(c_acctbal), 4) AS mean_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def a1_load_table(spark, sf):
    customer, nation = (tables.load_table(spark, f"{sf}/{t}.parquet") for t in ("customer", "nation"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_nationkey", "n_name").agg(F.count("*").alias("n_customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_acctbal"))


@query("SELECT CASE WHEN quantity < 26 THEN 'train' ELSE 'test' END AS part, y, count(*) AS n FROM returns GROUP BY ALL", "returns")
def a2_check_contract(spark, sf):
    df = tasks.returns(spark, sf)
    train, test = tables.check_contract(df.where("quantity < 26"), df.where("quantity >= 26"), "y", "row_id")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "y").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id, o_orderkey FROM orders")
def a3_with_row_id(spark, sf):
    return tables.with_row_id(tasks.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("row_id", "o_orderkey")


@query("SELECT CASE WHEN o_orderkey < 500 THEN 'train' WHEN o_orderkey < 1000 THEN 'test' ELSE 'last' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey < 1000 OR o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 50) GROUP BY ALL")
def a4_slice_rows(spark, sf):
    df = tasks.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    parts = {"train": tables.slice_rows(df, "o_orderkey", 0, 500), "test": tables.slice_rows(df, "o_orderkey", 500, 1000), "last": tables.last_rows(df, "o_orderkey", 50)}
    out = [d.groupBy(F.lit(k).alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")) for k, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def a10_latest_run(spark, sf):
    df = tasks.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus").withColumn("run_ts", F.col("o_orderkey"))
    return runs.latest_run(df, ["o_custkey"]).drop("run_ts")


@query("SELECT c_custkey::INT AS seed, (c_nationkey + 1)::INT AS p, 50 AS n, (c_custkey % 2)::INT AS u, ((c_custkey // 2) % 2)::INT AS k FROM customer")
def a11_parse_run_labels(spark, sf):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    named = tasks.table(spark, sf, "customer").select(F.concat(F.lit("results_"), key, F.lit(".csv")).alias("file"), F.concat(F.lit("rules("), nation + 1, F.lit(":50)")).alias("model"), F.concat(F.lit("U"), key % 2, F.lit("_K"), F.floor(key / 2) % 2).alias("name"))
    (p, n), (u, k) = runs.ratio_of(F.col("model")), runs.flags_of(F.col("name"))
    return named.select(runs.seed_of(F.col("file")).alias("seed"), p.alias("p"), n.alias("n"), u.alias("u"), k.alias("k"))


# B: profiling

RETURN_FEATURES = ["quantity", "extendedprice", "discount", "tax", "linestatus", "big_discount"]
LONG = """+ long AS (
  SELECT f AS feature, v AS num, s AS txt, y FROM returns, LATERAL (VALUES ('quantity', quantity, NULL), ('extendedprice', extendedprice, NULL), ('discount', discount, NULL),
    ('tax', tax, NULL), ('linestatus', NULL, linestatus), ('big_discount', big_discount::DOUBLE, NULL)) t(f, v, s)),
cont AS (SELECT * FROM long WHERE feature IN ('quantity', 'extendedprice', 'discount', 'tax') AND num IS NOT NULL),
lev AS (SELECT feature, coalesce(txt, num::INT::VARCHAR) AS level, y FROM long WHERE feature IN ('linestatus', 'big_discount') AND (txt IS NOT NULL OR num IS NOT NULL))
"""


def _profiled(spark, sf, make: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """The kinds of the features of ``returns``, or what ``make`` does with their histogram and kinds, under the features' names."""
    with profile.kept(profile.histogram(tasks.returns(spark, sf).drop("row_id"), "y", RETURN_FEATURES)) as hist, temporary_tables():
        kinds = profile.per_feature(profile.classify_features(hist))
        return kinds if make is None else profile.per_feature(_named(make(hist, kinds), kinds))


def _named(df: DataFrame, kinds: DataFrame) -> DataFrame:
    return kinds.select("ordinal", "feature").join(df, "ordinal").drop("ordinal")


@query(LONG + """SELECT feature, CASE WHEN feature = 'big_discount' THEN 'binary' WHEN feature = 'linestatus' THEN 'categorical' ELSE 'continuous' END AS feature_type,
  round(avg((num IS NULL AND txt IS NULL)::INT), 6) AS missing_rate, count(coalesce(txt, num::VARCHAR)) AS n_valid, count(DISTINCT coalesce(txt, num::VARCHAR)) AS n_unique FROM long GROUP BY feature""", "returns")
def b1_b2_classify_and_missing(spark, sf):
    return _round(_profiled(spark, sf), 6, "missing_rate").drop("ordinal")


B1_SQL = ORACLE["b1_b2_classify_and_missing"]


@query(B1_SQL)
def a5_a6_profile_store(spark, sf):
    path, kinds = scratch_path(spark, "profiles"), _profiled(spark, sf)
    runs.write_profile(kinds, path, "first")
    runs.snapshot_previous(spark, path, "first", "second", kinds)
    return _round(runs.read_profile(spark, path, "second", "prev"), 6, "missing_rate").drop("ordinal")


@query(LONG + """SELECT feature, round(avg(num), 4) AS mean, round(stddev_samp(num), 4) AS std, round(quantile_cont(num, 0.5), 4) AS median, min(num) AS min, max(num) AS max,
  round(quantile_cont(num, 0.25), 4) AS q1, round(quantile_cont(num, 0.75), 4) AS q3 FROM cont GROUP BY feature""", "returns")
def b3_numeric_summary(spark, sf):
    return _round(_profiled(spark, sf, profile.numeric_summary), 4, "mean", "std", "median", "q1", "q3")


@query("""SELECT 'p_brand' AS feature, '{' || string_agg('"' || level || '":' || n, ',' ORDER BY o) || '}' AS level_counts FROM (
  SELECT level, n, o FROM (SELECT p_brand AS level, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS o FROM part GROUP BY 1) WHERE o <= 20
  UNION ALL SELECT '__OTHER__', sum(n), 99 FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS o FROM part GROUP BY p_brand) WHERE o > 20 HAVING sum(n) > 0)""")
def b4_level_counts(spark, sf):
    df = tasks.table(spark, sf, "part").select((F.col("p_size") > 25).cast("int").alias("y"), "p_brand")
    hist = profile.histogram(df, "y", ["p_brand"])
    kinds = profile.classify_features(hist)
    return _named(profile.level_counts(hist, kinds), kinds)


@query(LONG + "SELECT feature, round(corr(y, num), 6) AS pointbiserial_r, CASE WHEN corr(y, num) >= 0 THEN 'pos' ELSE 'neg' END AS direction, count(*) AS n, sum(y)::BIGINT AS n1, sum(1 - y)::BIGINT AS n0 FROM cont GROUP BY feature", "returns")
def b5_point_biserial(spark, sf):
    return _round(_profiled(spark, sf, profile.point_biserial), 6, "pointbiserial_r")


@query(LONG + """SELECT feature, sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2 AS mwu_u, sum(t * t - 1) AS ties FROM (
  SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY num) + (count(*) OVER (PARTITION BY feature, num) - 1) / 2 AS r, count(*) OVER (PARTITION BY feature, num)::DOUBLE AS t FROM cont)
GROUP BY feature""", "returns")
def b6_mann_whitney_u(spark, sf):
    found = _profiled(spark, sf, lambda hist, kinds: profile.mann_whitney_u(profile.cumulative(profile._continuous(hist, kinds))))
    return found.select("feature", "mwu_u", "ties")


@query(LONG + """, c AS (SELECT feature, level, sum(y) AS c1, sum(1 - y) AS c0, count(*) AS n FROM lev GROUP BY ALL),
t AS (SELECT *, count(*) OVER w AS k, sum(c1) OVER w AS n1, sum(c0) OVER w AS n0, sum(n) OVER w AS total FROM c WINDOW w AS (PARTITION BY feature)),
e AS (SELECT feature, k, unnest([c1, c0]) AS o, unnest([n * n1 / total, n * n0 / total]) AS x FROM t)
SELECT feature, round(sum(pow(abs(o - x) - CASE WHEN k = 2 THEN least(0.5, abs(o - x)) ELSE 0 END, 2) / x), 6) AS chi2_stat, any_value(k) - 1 AS chi2_df FROM e GROUP BY feature""", "returns")
def b7_chi_square(spark, sf):
    return _round(_profiled(spark, sf, profile.chi_square), 6, "chi2_stat")


@query(LONG + """, q AS (SELECT feature, list_sort(list_distinct([min(num), quantile_cont(num, 0.25), quantile_cont(num, 0.5), quantile_cont(num, 0.75), max(num)])) AS e FROM cont GROUP BY feature),
b AS (SELECT c.feature, greatest(len([z FOR z IN e IF z < num]), 1) AS bin, sum(y) AS a, sum(1 - y) AS b FROM cont c JOIN q ON c.feature = q.feature WHERE len(e) > 2 GROUP BY ALL)
SELECT b.feature, b.bin::INT AS bin, round(CASE WHEN b.bin = 1 THEN 1.0 ELSE ((b.a + 0.5) * (f.b + 0.5)) / ((b.b + 0.5) * (f.a + 0.5)) END, 6) AS odds FROM b JOIN b f ON b.feature = f.feature AND f.bin = 1""", "returns")
def b8_b9_quartile_odds_ratio(spark, sf):
    found = _profiled(spark, sf, lambda hist, kinds: profile.quartile_odds_ratio(hist, kinds, profile.per_feature(profile.numeric_summary(hist, kinds))))
    return _round(found, 6, "odds").select("feature", "bin", "odds")


@query()
def b10_b12_choose_test(spark, sf):
    return profile.profile_table(tasks.returns(spark, sf).drop("row_id"), "y").select("feature", "method", "statistic", "p_value", "pointbiserial_p", "mwu_p", "chi2_p")


@query()
def b11_rank_features(spark, sf):
    return profile.profile_table(tasks.finished(spark, sf).drop("row_id"), "y").select("rank", "feature", "p_value", "missing_rate")


@query("SELECT event_id, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS t FROM events")
def b13_coerce_numeric(spark, sf):
    df = tasks.table(spark, sf, "events")
    return df.select("event_id", profile.coerce_numeric(F.get_json_object("props", "$.k")).alias("k"), profile.coerce_numeric(F.col("event_type")).alias("t"))


@query("SELECT l_linestatus AS x, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def b14_contingency_table(spark, sf):
    return profile.contingency_table(tasks.table(spark, sf, "lineitem"), "l_linestatus", "l_returnflag", wide=True)


@query()
def b15_profile_table(spark, sf):
    return profile.profile_table(tasks.purchase(spark, sf).drop("row_id"), "y")


@query()
def b16_top_features(spark, sf):
    return profile.top_features(profile.profile_table(tasks.returns(spark, sf).drop("row_id"), "y"), 3)


# C: splits and samplers

SPEC = sampling.SplitSpec(test_total=200, val_total=100)
HOLDOUT = f"""hold AS (SELECT row_id, y, CASE WHEN r <= 100 THEN 'test' ELSE 'val' END AS split FROM (
  SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42|holdout' || y || '|' || row_id), row_id) AS r FROM finished) WHERE r <= 150)"""


@query(f"+ {HOLDOUT} SELECT row_id, y, split FROM hold", "finished")
def c1_balanced_holdout(spark, sf):
    return sampling.balanced_holdout(tasks.finished(spark, sf), "y", "row_id", SPEC).select("row_id", "y", "split")


@query(f"+ {HOLDOUT} SELECT y, count(*) AS n, round(sum(totalprice), 2) AS total FROM finished WHERE row_id NOT IN (SELECT row_id FROM hold) GROUP BY y", "finished")
def c2_remainder_pool(spark, sf):
    df = tasks.finished(spark, sf)
    rest = sampling.remainder_pool(df, sampling.balanced_holdout(df, "y", "row_id", SPEC), "row_id")
    return rest.groupBy("y").agg(F.count("*").alias("n"), F.round(F.sum("totalprice"), 2).alias("total"))


@query(f"SELECT row_id, y FROM finished ORDER BY {h(7, 'random')}, row_id LIMIT 300", "finished")
def c3_sample_random(spark, sf):
    return sampling.sample_random(tasks.finished(spark, sf), 300, 7, "row_id").select("row_id", "y")


def _draws(seed: int, pos: int, neg: int) -> str:
    """Draws of each class of ``quality`` with replacement where it is too small."""
    return f"""+ n AS (SELECT y, count(*) AS have FROM quality GROUP BY y),
r AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('{seed}|class' || y || '|' || row_id), row_id) AS rank FROM quality),
want AS (SELECT 1 AS y, {pos} AS n UNION ALL SELECT 0, {neg}),
d AS (SELECT y, have, want.n, unnest(range(1, want.n + 1)) AS draw_id FROM want JOIN n USING (y)),
p AS (SELECT *, CASE WHEN have >= n THEN draw_id ELSE ('0x' || substr(md5('{seed}|class' || y || '|' || draw_id), 1, 8))::BIGINT % have + 1 END AS rank FROM d)
SELECT row_id, p.y, draw_id::INT AS draw_id FROM p JOIN r ON p.y = r.y AND p.rank = r.rank"""


@query(_draws(5, 200, 200), "quality")
def c4_sample_balanced(spark, sf):
    return sampling.sample_balanced(tasks.quality(spark, sf), 400, "y", "row_id", 5)[0].select("row_id", "y", "draw_id")


@query("""SELECT p_partkey, pos::INT AS pos, (total - pos)::INT AS neg FROM (SELECT p_partkey, total, greatest(1, least(total - 1, round_even(total * p / (p + n), 0))) AS pos
  FROM (SELECT p_partkey, p_size * 10 AS total, p_partkey % 50 + 1 AS p, p_partkey % 7 + 1 AS n FROM part))""")
def c5_ratio_counts(spark, sf):
    df = tasks.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10).alias("total"), (F.col("p_partkey") % 50 + 1).alias("p"), (F.col("p_partkey") % 7 + 1).alias("n"))
    pos, neg = sampling.ratio_targets(F.col("total"), F.col("p"), F.col("n"))
    return df.select("p_partkey", pos.cast("int").alias("pos"), neg.cast("int").alias("neg"))


@query(_draws(9 + 300 + 1000 * 1 + 2, 100, 200), "quality")
def c6_sample_ratio(spark, sf):
    return sampling.sample_ratio(tasks.quality(spark, sf), 300, 1, 2, "y", "row_id", 9)[0].select("row_id", "y", "draw_id")


STAGES = sampling.TwoStageSpec(train1=200, train2=40, val_total=60, test_total=100)
PARTITION = """+ r AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42|stage' || y || '|' || row_id), row_id) AS r FROM finished),
parts AS (SELECT row_id, y, CASE WHEN r <= 100 THEN 'train1' WHEN r <= 130 THEN 'val1' WHEN r <= 180 THEN 'test1' WHEN r <= 200 THEN 'train2' WHEN r <= 230 THEN 'val2' ELSE 'test2' END AS split FROM r WHERE r <= 280) """


@query(PARTITION + "SELECT * FROM parts", "finished")
def c7_two_stage_partition(spark, sf):
    return sampling.two_stage_partition(tasks.finished(spark, sf), "y", "row_id", STAGES, 42).select("row_id", "y", "split")


@query("SELECT y AS label, (CASE y WHEN 1 THEN 200 ELSE 100 END) AS target, count(*) AS available, count(*) < (CASE y WHEN 1 THEN 200 ELSE 100 END) AS replaced FROM quality GROUP BY y", "quality")
def c8_sampling_meta(spark, sf):
    df = tasks.quality(spark, sf)
    meta = sampling.sampling_meta({1: 200, 0: 100}, sampling.class_counts(df, "y"))
    return spark.createDataFrame([tuple(m.values()) for m in meta], "label int, target int, available long, replaced boolean")


@query(f"+ {HOLDOUT} SELECT split, row_id FROM hold", "finished")
def c9_split_row_ids(spark, sf):
    return sampling.split_row_ids(sampling.balanced_holdout(tasks.finished(spark, sf), "y", "row_id", SPEC), "row_id")


@query("""+ s AS (SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'even' ELSE 'odd' END AS split FROM finished UNION ALL SELECT row_id, 'seven' FROM finished WHERE row_id % 7 = 0),
n AS (SELECT split, count(*) AS n FROM s GROUP BY split)
SELECT 'size' AS problem, split, n || '/10' AS detail FROM n WHERE split = 'seven' AND n <> 10
UNION ALL SELECT 'forbidden_column', '*', 'segment'
UNION ALL SELECT * FROM (SELECT 'overlap', string_agg(split, '+' ORDER BY split), row_id::VARCHAR FROM s GROUP BY row_id HAVING count(DISTINCT split) > 1 ORDER BY row_id LIMIT 10)""", "finished")
def c10_validate_splits(spark, sf):
    df = tasks.finished(spark, sf)
    splits = df.withColumn("split", F.when(F.col("row_id") % 2 == 0, "even").otherwise("odd")).unionByName(df.where("row_id % 7 = 0").withColumn("split", F.lit("seven")))
    n = {r["split"]: r["n"] for r in splits.groupBy("split").agg(F.count("*").alias("n")).collect()}
    return sampling.validate_splits(splits, "row_id", {"even": n["even"], "odd": n["odd"], "seven": 10}, required=["y"], forbidden=["segment"])


@query(f"SELECT row_id, row_number() OVER (ORDER BY {h(3, 'shuffle')}, row_id) AS place FROM quality", "quality")
def c11_shuffle_rows(spark, sf):
    return sampling.shuffled_places(tasks.quality(spark, sf), 3, "row_id").select("row_id", "place")


# D: drift

DRIFT = drift.Drift(dropped=("segment", "absent"), added=("late_flag", "acctbal"), renamed=(("totalprice", "price"),), note="price list")


@query("SELECT row_id, y, totalprice AS price, acctbal, priority, NULL::DOUBLE AS late_flag FROM finished", "finished")
def d1_apply_drift(spark, sf):
    return drift.apply_drift(tasks.finished(spark, sf), "y", DRIFT, "row_id")


@query("""SELECT 'dropped' AS action, 'segment' AS "columns", true AS took_effect, count(segment) AS n_rows FROM finished UNION ALL SELECT 'dropped', 'absent', false, 0
UNION ALL SELECT 'added', 'late_flag', true, count(*) FROM finished UNION ALL SELECT 'added', 'acctbal', false, 0 UNION ALL SELECT 'renamed', 'totalprice->price', true, count(totalprice) FROM finished""", "finished")
def d2_drift_meta(spark, sf):
    return drift.drift_effects(tasks.finished(spark, sf), DRIFT)


@query("SELECT 'r7' AS run_id, 'finish' AS task, 'F1,ACC' AS metric_priority, 10 AS iterations, 42 AS seed, 'segment,absent' AS dropped, count(*) AS n_rows, sum(y)::BIGINT AS n_positive FROM finished", "finished")
def d13_drift_context(spark, sf):
    told = drift.drift_context(tasks.finished(spark, sf), "y", "r7", "finish", ("F1", "ACC"), 10, 42, DRIFT)
    return told.select("run_id", "task", *[F.array_join(c, ",").alias(c) for c in ("metric_priority", "dropped")], "iterations", "seed", "n_rows", "n_positive")


@query("SELECT priority, acctbal, y, row_id FROM finished", "finished")
def d3_select_stage(spark, sf):
    return drift.select_stage(tasks.finished(spark, sf), ["priority", "acctbal"], "y", "row_id")


@query("SELECT totalprice AS price, NULL::DOUBLE AS late_flag, y FROM finished", "finished")
def d4_stage_view(spark, sf):
    return drift.strip_row_id(drift.stage_view(tasks.finished(spark, sf), drift.StageSpec(("price", "late_flag"), DRIFT), "y", "row_id"), "row_id")


@query(PARTITION + """SELECT left(split, length(split) - 1) AS split, CASE WHEN split LIKE '%1' THEN 'stage1' ELSE 'stage2' END AS stage, p.y, count(*) AS n,
  round(sum(CASE WHEN split LIKE '%1' THEN acctbal ELSE totalprice END), 2) AS total FROM parts p JOIN finished f ON p.row_id = f.row_id GROUP BY ALL""", "finished")
def d5_stage_bundle(spark, sf):
    stages = (drift.StageSpec(("acctbal", "segment")), drift.StageSpec(("price", "late_flag"), DRIFT))
    bundles = drift.stage_bundles(tasks.finished(spark, sf), "y", "row_id", stages, STAGES, 42)
    parts = [b.groupBy("split", F.lit(k).alias("stage"), "y").agg(F.count("*").alias("n"), F.round(F.sum(F.col("acctbal" if k == "stage1" else "price")), 2).alias("total")) for k, b in bundles.items()]
    return parts[0].unionByName(parts[1])


def _small_profile(df: DataFrame) -> DataFrame:
    """Missing rates as profile rows; p stands in by 1 - missing rate, so that SQL can follow."""
    hist = profile.histogram(df.drop("row_id"), "y")
    rows = profile.classify_features(hist).withColumn("p_value", F.round(F.col("n_valid") / (F.col("n_valid") + F.col("n_unique")), 6))
    return profile.rank_features(rows).select("rank", "feature", "feature_type", "p_value", "missing_rate")


PROFILES = """+ f AS (SELECT 'value' AS feature, 'continuous' AS feature_type, 0 AS o, count(value) AS v, count(DISTINCT value) AS u, count(*) AS n FROM purchase
  UNION ALL SELECT 'k', 'continuous', 1, count(k), count(DISTINCT k), count(*) FROM purchase
  UNION ALL SELECT 'hour', 'continuous', 2, count(hour), count(DISTINCT hour), count(*) FROM purchase
  UNION ALL SELECT 'group', 'continuous', 3, count("group"), count(DISTINCT "group"), count(*) FROM purchase),
prof AS (SELECT feature, feature_type, round(v / (v + u), 6) AS p_value, (n - v) / n AS missing_rate, o FROM f),
ranked AS (SELECT row_number() OVER (ORDER BY p_value, missing_rate, o)::INT AS rank, * FROM prof) """
PDRIFT = drift.Drift(dropped=("hour",), added=("k",), renamed=(("value", "amount"),))


@query(PROFILES + "SELECT rank, CASE feature WHEN 'value' THEN 'amount' ELSE feature END AS feature, feature_type, p_value, round(missing_rate, 6) AS missing_rate FROM ranked WHERE feature <> 'hour'", "purchase")
def d6_carry_profile(spark, sf):
    return _round(drift.carry_profile(_small_profile(tasks.purchase(spark, sf)), PDRIFT), 6, "missing_rate")


MERGED = PROFILES + """, prev AS (SELECT row_number() OVER (ORDER BY p_value, missing_rate, o)::INT AS rank, feature, feature_type, p_value, missing_rate FROM prof WHERE feature <> 'k'),
merged AS (SELECT rank, CASE feature WHEN 'value' THEN 'amount' ELSE feature END AS feature, p_value, missing_rate FROM prev WHERE feature <> 'hour'
  UNION ALL SELECT rank, feature, p_value, missing_rate FROM ranked WHERE feature = 'k'),
m AS (SELECT *, row_number() OVER (ORDER BY p_value, missing_rate, feature)::INT AS rank_new FROM merged) """


def _merged(spark, sf):
    df = tasks.purchase(spark, sf)
    return drift.merge_profile(_small_profile(df.drop("k")), _small_profile(df), PDRIFT)


@query(MERGED + "SELECT rank, rank_new, feature, p_value, round(missing_rate, 6) AS missing_rate FROM m", "purchase")
def d7_merge_profile(spark, sf):
    return _round(_merged(spark, sf), 6, "missing_rate").select("rank", "rank_new", "feature", "p_value", "missing_rate")


@query(MERGED + "SELECT rank_new, feature FROM m WHERE rank_new <= 2", "purchase")
def d8_drift_top_features(spark, sf):
    return drift.drift_top_features(_merged(spark, sf), 2)


@query(PROFILES + """SELECT 'first' AS run_id, rank AS place, feature FROM ranked WHERE rank <= 2
UNION ALL SELECT 'absent', (o + 1)::INT, feature FROM f""", "purchase")
def a5_profile_or_fallback(spark, sf):
    df, path = tasks.purchase(spark, sf), scratch_path(spark, "profiles")
    runs.write_profile(_small_profile(df), path, "first")
    columns = [c for c in df.columns if c not in ("row_id", "y")]
    found = [(run, i, f) for run in ("first", "absent") for i, f in enumerate(runs.profile_or_fallback(spark, path, run, columns, 2)[0], 1)]
    return spark.createDataFrame(found, "run_id string, place int, feature string")


def _knowledge(spark, sf) -> DataFrame:
    """A Markdown table for each region, with a row for each nation, between lines that don't count."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("| "), x["n_name"], F.lit(" | key "), x["n_nationkey"], F.lit(" |")))
    text = F.array_join(F.concat(F.array(F.lit("Some text"), F.lit("| Feature | signal |"), F.lit("|---|---|")), rows, F.array(F.lit("| open line"))), "\n")
    return tasks.table(spark, sf, "nation").groupBy("n_regionkey").agg(text.alias("text")).select(F.col("n_regionkey").cast("string").alias("run_id"), "text")


KNOWN = "known AS (SELECT n_regionkey::VARCHAR AS run_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS row_no, n_name AS feature, 'key ' || n_nationkey AS signal FROM nation)"
KDRIFT = drift.Drift(dropped=("NATION_1",), renamed=(("NATION_2", "SECOND"),), added=("NATION_7",))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("run_id", "row_no", F.get("cells", F.lit(0)).alias("feature"), F.get("cells", F.lit(1)).alias("signal"))


@query(f"WITH {KNOWN} SELECT * FROM known")
def d9_parse_knowledge(spark, sf):
    return _flat(drift.parse_knowledge(_knowledge(spark, sf)))


@query(f"WITH {KNOWN}, b AS (SELECT min(n_name) AS first, max(n_name) AS last FROM nation) SELECT run_id, row_no, CASE feature WHEN last THEN 'LAST' ELSE feature END AS feature, signal FROM known, b WHERE feature <> first")
def d10_carry_knowledge(spark, sf):
    first, last = tasks.table(spark, sf, "nation").agg(F.min("n_name"), F.max("n_name")).first()
    return _flat(drift.carry_knowledge(drift.parse_knowledge(_knowledge(spark, sf)), drift.Drift(dropped=(first,), renamed=((last, "LAST"),))))


@query(f"""WITH {KNOWN}, b AS (SELECT min(n_name) AS first, max(n_name) AS last FROM nation), c AS (SELECT known.* FROM known, b WHERE feature <> first), x AS (SELECT run_id, max(row_no) + 1 AS n FROM c GROUP BY run_id)
SELECT run_id, row_no, feature, signal FROM c UNION ALL SELECT k.run_id, (k.row_no + coalesce(n, 0))::INT, feature, signal FROM known k LEFT JOIN x ON k.run_id = x.run_id, b WHERE feature = last""")
def d11_merge_knowledge(spark, sf):
    first, last = tasks.table(spark, sf, "nation").agg(F.min("n_name"), F.max("n_name")).first()
    parsed = drift.parse_knowledge(_knowledge(spark, sf))
    return _flat(drift.merge_knowledge(parsed, parsed, drift.Drift(dropped=(first,), added=(last,))))


@query(f"WITH {KNOWN} SELECT run_id, '| Feature | signal |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || feature || ' | ' || signal || ' |', chr(10) ORDER BY row_no) AS text FROM known GROUP BY run_id")
def d12_render_knowledge(spark, sf):
    return drift.render_knowledge(drift.parse_knowledge(_knowledge(spark, sf)))


# E: rules

SCORED = "+ s AS (SELECT *, " + ", ".join(f"{q} AS {v}" for v, q in tasks.RULES_SQL.items()) + " FROM returns), " + """
lng AS (SELECT row_id, y, v AS version, o AS ordinal, p AS prediction FROM s, LATERAL (VALUES ('v0', 0, v0), ('v1', 1, v1), ('v2', 2, v2), ('v3', 3, v3)) t(v, o, p)),
c AS (SELECT version, ordinal, count(*) FILTER (y = 1 AND prediction = 1) AS tp, count(*) FILTER (y = 0 AND prediction = 1) AS fp, count(*) FILTER (y = 0 AND prediction = 0) AS tn,
  count(*) FILTER (y = 1 AND prediction = 0) AS fn, count(*) AS n FROM lng GROUP BY ALL),
hist AS (SELECT 'r' AS run_id, version, ordinal, (tp + tn) / n AS acc, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity,
  coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, tp, fp, tn, fn FROM c) """


def _wide(spark, sf):
    return rules.score_versions(tasks.returns(spark, sf), tasks.RULES, "row_id", "y", long=False)


def _long(spark, sf):
    return rules.score_versions(tasks.returns(spark, sf), tasks.RULES, "row_id", "y")


def _history(spark, sf):
    return metrics.version_history(_long(spark, sf).withColumn("run_id", F.lit("r")))


@query(SCORED + "SELECT row_id, y, v0 AS prediction FROM s", "returns")
def e1_e2_score_rules(spark, sf):
    return rules.score_rules(tasks.returns(spark, sf), tasks.RULES["v0"]).select("row_id", "y", "prediction")


def _python_rule(row: dict) -> int:
    points = (row["discount"] is not None and row["discount"] >= 0.05) + (row["tax"] is not None and row["tax"] <= 0.02) + (row["linestatus"] == "F")
    return int((row["quantity"] or 0) >= 45 or points >= 2)


@query(SCORED + "SELECT row_id, v0 AS prediction FROM s", "returns")
def e3_score_python_rule(spark, sf):
    return rules.score_python_rule(tasks.returns(spark, sf), _python_rule).select("row_id", "prediction")


@query(SCORED + "SELECT version, ordinal, y, prediction, count(*) AS n FROM lng GROUP BY ALL", "returns")
def e4_score_versions(spark, sf):
    return _long(spark, sf).groupBy("version", "ordinal", "y", "prediction").agg(F.count("*").alias("n"))


@query(SCORED + "SELECT version, ordinal, y, prediction, count(*) AS n FROM lng GROUP BY ALL", "returns")
def e4_score_python_versions(spark, sf):
    """The versions stored as Python text, compiled and scored in one scan."""
    found = rules.score_versions(tasks.returns(spark, sf), tasks.RULES_PYTHON, "row_id", "y")
    return found.groupBy("version", "ordinal", "y", "prediction").agg(F.count("*").alias("n"))


def _rule_table(spark, sf, versions=tasks.RULES) -> DataFrame:
    """Stored versions for a run of each region."""
    texts = {v: r if isinstance(r, str) else json.dumps(r) for v, r in versions.items()}
    stored = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(i).alias("ordinal"), F.lit(r).alias("rule_json"), F.lit(f"analysis of {v}").alias("analysis")) for i, (v, r) in enumerate(texts.items())])
    return tasks.table(spark, sf, "region").select(F.col("r_name").alias("run_id"), F.inline(stored)).where(F.col("ordinal") < 1 + F.length("run_id") % 4)


@query(SCORED + "SELECT row_id, v0 AS prediction FROM s", "returns")
def e5_predict_final(spark, sf):
    stored = _rule_table(spark, sf)
    run = stored.agg(F.min("run_id")).first()[0]
    return rules.predict_final(tasks.returns(spark, sf), stored, run, "v0").select("row_id", "prediction")


@query(SCORED + "SELECT row_id, v1 AS prediction FROM s", "returns")
def e5_predict_stored_python(spark, sf):
    stored = _rule_table(spark, sf, tasks.RULES_PYTHON)
    run = stored.where("version = 'v1'").agg(F.min("run_id")).first()[0]
    return rules.predict_final(tasks.returns(spark, sf), stored, run, "v1").select("row_id", "prediction")


@query(SCORED + "SELECT row_id, y AS label, v1 AS prediction FROM s", "returns")
def e6_inference_report(spark, sf):
    return rules.inference_report(rules.score_rules(tasks.returns(spark, sf), tasks.RULES["v1"]), "row_id", "y")


@query("SELECT r_name AS run_id, 'v' || (length(r_name) % 4) AS version, (length(r_name) % 4)::INT AS ordinal FROM region")
def e7_rule_store(spark, sf):
    path, stored = scratch_path(spark, "rules"), _rule_table(spark, sf)
    for old in (True, False):
        rules.append_versions(stored.where((F.col("ordinal") < 1) == F.lit(old)), path)
        rules.append_versions(stored.where(F.col("ordinal") == 0), path)  # again, which changes nothing
    return rules.current_versions(rules.read_versions(spark, path))


def _proposals(spark, sf) -> DataFrame:
    """A raw proposal for each event, sound or broken in one of six ways by its id."""
    good = json.dumps({"version": "v1", "error_analysis": "x", "new_policy_code": json.dumps(tasks.RULES["v1"])})
    texts = [f"```json\n{good}\n```", "no json", good.replace('"v1"', '"v9"', 1), json.dumps({"version": "v1", "error_analysis": "", "new_policy_code": "def predict_v1(:"}), json.dumps({"version": "v1", "error_analysis": "", "new_policy_code": "def other(features):\n    return 1"}), json.dumps({"version": "v1", "error_analysis": "", "new_policy_code": '{"points": [1]}'}), json.dumps({"version": "v1", "error_analysis": "", "new_policy_code": "```python\ndef predict_v1(features):\n    return 1\n```"})]
    raw = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 7).cast("int"))
    ordinal = (F.floor(F.col("event_id") / 6) % 3 + 1).cast("int")
    version = F.concat(F.lit("v"), ordinal)
    return tasks.table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("run_id"), version.alias("expected_version"), ordinal.alias("ordinal"), F.replace(raw, F.lit("v1"), version).alias("raw_text"), (F.col("event_id") % 6 + 1).cast("int").alias("attempt"))


STATUS_SQL = "list_extract(['ok', 'json_parse_failed', 'version_mismatch', 'syntax_invalid', 'function_name_mismatch', 'load_failed', 'ok'], (event_id % 7 + 1)::INT)"


@query(f"SELECT event_id, {STATUS_SQL} AS status FROM events")
def e8_validate_proposals(spark, sf):
    return rules.validate_proposals(_proposals(spark, sf)).select("event_id", "status")


RESOLVED = f"""a AS (SELECT user_id::VARCHAR AS run_id, (event_id // 6 % 3 + 1)::INT AS ordinal, (event_id % 6 + 1)::INT AS tried, {STATUS_SQL} AS status FROM events),
per AS (SELECT run_id, ordinal, min(tried) FILTER (status = 'ok') AS attempt, string_agg(status, ',' ORDER BY tried, status) AS statuses FROM a WHERE tried <= 4 GROUP BY run_id, ordinal),
res AS (SELECT *, 'v' || ordinal AS version, bool_and(attempt IS NOT NULL) OVER (PARTITION BY run_id ORDER BY ordinal) AS accepted FROM per)"""


@query(f"WITH {RESOLVED} SELECT run_id, version, attempt, accepted FROM res")
def e9_resolve_attempts(spark, sf):
    return rules.resolve_attempts(rules.validate_proposals(_proposals(spark, sf))).select("run_id", "version", "attempt", "accepted")


# F: evaluation


@query(SCORED + "SELECT tp, tn, fp, fn FROM c WHERE version = 'v0'", "returns")
def f1_confusion_counts(spark, sf):
    return rules.score_rules(tasks.returns(spark, sf), tasks.RULES["v0"]).agg(*metrics.confusion_counts())


@query(SCORED + "SELECT version, round(acc, 6) AS acc, round(f1, 6) AS f1, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, tp, fp, tn, fn FROM hist", "returns")
def f2_f7_version_history(spark, sf):
    return _round(_history(spark, sf), 6, "acc", "f1", "sensitivity", "specificity").select("version", "acc", "f1", "sensitivity", "specificity", "tp", "fp", "tn", "fn")


@query("""+ p AS (SELECT y3 AS y, CASE WHEN quantity >= 40 THEN 2 WHEN tax >= 0.04 THEN 1 ELSE 0 END AS p FROM returns),
k AS (SELECT c, 2 * count(*) FILTER (y = c AND p = c) / (count(*) FILTER (y = c) + count(*) FILTER (p = c)) AS f FROM p, (VALUES (0), (1), (2)) t(c) GROUP BY c)
SELECT round((SELECT avg((y = p)::INT) FROM p), 6) AS acc, round(avg(f), 6) AS f1, NULL::DOUBLE AS sensitivity, 0 AS tp FROM k""", "returns")
def f4_f1_macro(spark, sf):
    df = tasks.returns(spark, sf, multi=True).withColumn("prediction", F.when(F.col("quantity") >= 40, 2).when(F.col("tax") >= 0.04, 1).otherwise(0))
    return _round(metrics.classification_metrics(df), 6, "acc", "f1").select("acc", "f1", "sensitivity", "tp")


@query(SCORED + "SELECT version, ordinal, round(f1, 6) AS f1 FROM hist ORDER BY hist.f1 DESC, acc DESC, sensitivity DESC, specificity DESC, ordinal LIMIT 1", "returns")
def f8_select_best(spark, sf):
    return _round(metrics.select_best(_history(spark, sf)), 6, "f1").select("version", "ordinal", "f1")


@query(SCORED + """SELECT 'V0' AS pick, version, round(f1, 6) AS f1 FROM hist WHERE ordinal = 0 UNION ALL SELECT 'LAST', version, round(f1, 6) FROM hist WHERE ordinal = 3
UNION ALL SELECT * FROM (SELECT 'FINAL', version, round(f1, 6) FROM hist ORDER BY hist.f1 DESC, acc DESC, sensitivity DESC, specificity DESC, ordinal LIMIT 1)""", "returns")
def f9_compare_versions(spark, sf):
    return _round(metrics.compare_versions(_history(spark, sf)), 6, "f1").select("pick", "version", "f1")


@query(SCORED + """, best AS (SELECT version FROM (SELECT *, row_number() OVER (ORDER BY x.f1 DESC, ordinal) AS r FROM (
  SELECT version, ordinal, 2 * count(*) FILTER (y = 1 AND prediction = 1) / nullif(2 * count(*) FILTER (y = 1 AND prediction = 1) + count(*) FILTER (y <> prediction), 0) AS f1 FROM lng
  WHERE substr(md5(row_id), 1, 1) < '8' GROUP BY ALL) x) WHERE r = 1)
SELECT version, round(avg((y = prediction)::INT), 6) AS acc, count(*) AS n FROM lng WHERE substr(md5(row_id), 1, 1) >= '8' AND version IN (SELECT version FROM best) GROUP BY version""", "returns")
def f10_holdout_summary(spark, sf):
    long = _long(spark, sf).withColumn("run_id", F.lit("r"))
    part = F.substring(F.md5(F.col("row_id").cast("binary")), 1, 1)
    best = metrics.select_best(metrics.version_history(long.where(part < "8")), ("F1",))
    return _round(metrics.holdout_summary(long.where(part >= "8"), best), 6, "acc").select("version", "acc", "n")


@query(SCORED + "SELECT version, tp, fp, fn, tn FROM c UNION ALL SELECT 'v9', NULL, NULL, NULL, NULL", "returns")
def f11_backfill_confusion(spark, sf):
    known = [(v, None, None, None, None) for v in (*tasks.RULES, "v9")]
    results = spark.createDataFrame(known, "version string, tp long, fp long, fn long, tn long")
    return metrics.backfill_confusion(results, _long(spark, sf), ["version"]).select("version", "tp", "fp", "fn", "tn")


STORED = {
    "price": [(1, {"triggers": [{"op": "<", "col": "totalprice", "value": 9}]}), (2, {"triggers": [{"op": ">", "col": "totalprice", "value": 150000}]})],
    "balance": [(5, {"triggers": [{"op": "<", "col": "acctbal", "value": 3000}]}), (4, {"triggers": []})],
}


@query("""+ r AS (SELECT seed, y, totalprice, acctbal, row_number() OVER (PARTITION BY seed, y ORDER BY md5(seed || '|holdout' || y || '|' || row_id), row_id) AS r FROM finished, (VALUES (42), (43)) s(seed)),
p AS (SELECT seed, y, unnest(['price', 'balance']) AS model, unnest([coalesce(totalprice > 150000, false), coalesce(acctbal < 3000, false)]) AS p FROM r WHERE r <= 100)
SELECT model, seed, count(*) FILTER (y = 1 AND p) AS tp, count(*) FILTER (y = 0 AND p) AS fp, count(*) FILTER (y = 1 AND NOT p) AS fn, count(*) FILTER (y = 0 AND NOT p) AS tn FROM p GROUP BY ALL
UNION ALL SELECT 'price', 44, 1, 2, 3, 4 UNION ALL SELECT 'gone', 42, NULL, NULL, NULL, NULL""", "finished")
def f11_backfill_runs(spark, sf):
    stored = [(m, seed, ts, json.dumps(r)) for m, of in STORED.items() for seed in (42, 43, 44) for ts, r in of]
    rows = [(m, seed, None, None, None, None) for m in STORED for seed in (42, 43)] + [("price", 44, 1, 2, 3, 4), ("gone", 42, None, None, None, None)]
    results = spark.createDataFrame(rows, "model string, seed int, tp long, fp long, fn long, tn long")
    return metrics.backfill_runs(results, spark.createDataFrame(stored, "model string, seed int, run_ts int, rule_json string"), tasks.finished(spark, sf), "y", "row_id", SPEC)


@query(ORACLE["f11_backfill_runs"])
def f11_backfill_from_files(spark, sf):
    """The same from folders and result files that the query writes: runs, ratios and seeds come from their paths."""
    root = scratch_path(spark, "runs")
    stored = [(m, 1000, 1, 1, seed, f"2024010{ts}_120000", json.dumps(r)) for m, of in STORED.items() for seed in (42, 43, 44) for ts, r in of]
    runs.write_run_files(spark.createDataFrame(stored, "dataset string, total int, p int, n int, seed int, run_ts string, rule_json string"), f"{root}/out")
    kept = {42: [("price(1:1)", None, None, None, None), ("balance(1:1)", None, None, None, None), ("gone(1:1)", None, None, None, None)], 43: [("price(1:1)", None, None, None, None), ("balance(1:1)", None, None, None, None)], 44: [("price(1:1)", 1, 2, 3, 4)]}
    schema = "model string, tp long, fp long, fn long, tn long"
    for seed, rows in kept.items():
        runs.write_results(spark.createDataFrame(rows, schema), f"{root}/results/results_{seed}.csv")
    found, (p, n) = runs.newest_rules(spark, f"{root}/out"), runs.ratio_of(F.col("model"))
    results = runs.read_result_files(spark, f"{root}/results", schema).withColumns({"_p": p, "_n": n, "model": F.regexp_extract("model", r"^[^(]+", 0)})
    known = found.join(results.select("_p", "_n").distinct(), (found["p"] == F.col("_p")) & (found["n"] == F.col("_n")), "left_semi").select(F.col("dataset").alias("model"), "seed", "run_ts", "rule_json")
    return metrics.backfill_runs(results.drop("_p", "_n"), known, tasks.finished(spark, sf), "y", "row_id", SPEC).select("model", "seed", "tp", "fp", "fn", "tn")


@query(SCORED + "SELECT version, printf('%.3f', acc) AS acc, printf('%.3f', f1) AS f1 FROM hist", "returns")
def f12_format_metrics(spark, sf):
    return metrics.format_metrics(_history(spark, sf)).select("version", "acc", "f1")


@query(SCORED + "SELECT version, tp, fp, tn, fn FROM hist", "returns")
def a7_eval_log(spark, sf):
    path, history = scratch_path(spark, "log"), _history(spark, sf)
    for v in tasks.RULES:
        runs.append_eval_log(history.where(F.col("version") == v), path)
    runs.append_eval_log(history, path)  # again, which changes nothing
    return runs.read_eval_log(spark, path, ["run_id", "version"]).select("version", "tp", "fp", "tn", "fn")


@query(SCORED + "SELECT version, printf('%.3f', f1) AS f1, tp FROM hist", "returns")
def a8_a9_results_and_manifest(spark, sf):
    path, shown = scratch_path(spark, "results"), metrics.format_metrics(_history(spark, sf))
    runs.write_results(shown, f"{path}/csv")
    runs.write_manifest(tables.load_table(spark, f"{path}/csv", shown.schema, "csv"), f"{path}/json")
    return spark.read.schema(shown.schema).json(f"{path}/json").select("version", "f1", "tp")


# G: errors and regressions


def _errors(spark, sf):
    return errors.misclassified(rules.score_rules(tasks.returns(spark, sf), tasks.RULES["v0"]), ["quantity", "tax"])


@query(SCORED + "SELECT row_id, y, v0 AS prediction, CASE WHEN y = 0 THEN 'FP' ELSE 'FN' END AS kind FROM s WHERE y <> v0", "returns")
def g1_misclassified(spark, sf):
    return _errors(spark, sf).select("row_id", "y", "prediction", "kind")


@query(SCORED + f"SELECT row_id, CASE WHEN y = 0 THEN 'FP' ELSE 'FN' END AS kind FROM s WHERE y <> v0 ORDER BY {h(43, 'errors')}, row_id LIMIT 100", "returns")
def g2_sample_errors(spark, sf):
    return errors.sample_errors(_errors(spark, sf), 100, 43).select("row_id", "kind")


@query(SCORED + """, e AS (SELECT count(*) AS n, count(*) FILTER (y = 0) AS fp, count(*) FILTER (y = 1) AS fn FROM s WHERE y <> v0),
d AS (SELECT *, row_number() OVER (ORDER BY row_id) AS r FROM s WHERE y <> v0)
SELECT 0::BIGINT AS line_no, n || ' rows are wrong: ' || fp || ' FP, ' || fn || ' FN' AS line FROM e UNION ALL SELECT 1099511627776, (n - 40) || ' more are left out.' FROM e WHERE n > 40
UNION ALL SELECT r, '- id=' || row_id || ' kind=' || CASE WHEN y = 0 THEN 'FP' ELSE 'FN' END || ' y=' || y || ' prediction=' || v0 || ' features={"quantity":' || quantity::DOUBLE || ',"tax":' || tax::DOUBLE || '}' FROM d WHERE r <= 40""", "returns")
def g3_error_report(spark, sf):
    return errors.error_report(_errors(spark, sf))


@query()
def g3_error_report_lines(spark, sf):
    """An earlier name of ``g3_error_report``."""
    return g3_error_report(spark, sf)


@query(SCORED + "SELECT row_id, y, v0 AS prediction_old, v1 AS prediction_new FROM s WHERE v0 = y AND v1 <> y", "returns")
def g4_regressions(spark, sf):
    return errors.regressions(_wide(spark, sf), "v0", "v1")


@query(SCORED + f"SELECT row_id, y FROM s WHERE v0 = y AND v1 <> y ORDER BY {h(44, 'regressions')}, row_id LIMIT 30", "returns")
def g5_regression_examples(spark, sf):
    return errors.regression_examples(errors.regressions(_wide(spark, sf), "v0", "v1"), 30, 44).select("row_id", "y")


@query(SCORED + """, g AS (SELECT row_id FROM s WHERE v0 = y AND v1 <> y), f AS (SELECT row_id FROM g ORDER BY row_id LIMIT 20)
SELECT (SELECT count(*) FROM g) AS n_regressed, array_to_string((SELECT list(row_id ORDER BY row_id) FROM f), ',') AS ids, (SELECT count(*) FROM g) - (SELECT count(*) FROM f) AS n_more""", "returns")
def g6_regression_summary(spark, sf):
    out = errors.regression_summary(errors.regressions(_wide(spark, sf), "v0", "v1"))
    return out.select("n_regressed", F.array_join("ids", ",").alias("ids"), "n_more")


LIMITS = {"v0": 50, "v1": 80, "v2": 20, "v3": 60}


@query(f"""WITH {RESOLVED},
p AS (SELECT user_id::VARCHAR AS run_id, (event_type = 'purchase')::INT AS y, unnest(['v1', 'v2', 'v3']) AS version, unnest([value > 50, value > 80, value > 20])::INT AS old, unnest([value > 80, value > 20, value > 60])::INT AS new FROM events),
gone AS (SELECT run_id, version, count(*) AS n FROM p WHERE old = y AND new <> y GROUP BY ALL)
SELECT res.run_id, res.version, ordinal, accepted, statuses, last_value(CASE WHEN accepted THEN res.version END IGNORE NULLS) OVER w AS last_accepted_version,
  last_value(CASE WHEN accepted THEN coalesce(n, 0) END IGNORE NULLS) OVER w AS last_regressed
FROM res LEFT JOIN gone ON res.run_id = gone.run_id AND res.version = gone.version WINDOW w AS (PARTITION BY res.run_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def g7_iteration_log(spark, sf):
    resolved = rules.resolve_attempts(rules.validate_proposals(_proposals(spark, sf)))
    predicted = {v: (F.col("value") > x).cast("int").alias(v) for v, x in LIMITS.items()}
    wide = tasks.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), "event_id", (F.col("event_type") == "purchase").cast("int").alias("y"), *predicted.values())
    gone = [errors.regressions(wide.withColumn("version", F.lit(new)), old, new, "event_id", ["run_id", "version"]) for old, new in zip(LIMITS, list(LIMITS)[1:])]
    counts = reduce(DataFrame.unionByName, gone).groupBy("run_id", "version").agg(F.count("*").alias("n_regressed"))
    return errors.iteration_log(resolved, counts).withColumn("statuses", F.array_join("statuses", ","))


G8_SQL = SCORED + " SELECT version_old, version_new, ordinal, count(*) FILTER (a <> y AND b = y) AS n_fixed, count(*) FILTER (a = y AND b <> y) AS n_regressed FROM s, LATERAL (VALUES ('v0', 'v1', 1, v0, v1), ('v1', 'v2', 2, v1, v2), ('v2', 'v3', 3, v2, v3)) t(version_old, version_new, ordinal, a, b) GROUP BY ALL"


@query(G8_SQL, "returns")
def g8_version_diff_all(spark, sf):
    return errors.version_diff_wide(_wide(spark, sf), list(tasks.RULES))


@query(G8_SQL, "returns")
def g8_version_diff_long(spark, sf):
    df = tasks.returns(spark, sf)
    numbered = tables.with_row_id(df, df.columns, "row_no")  # row_id may repeat
    return errors.version_diff_all(rules.score_versions(numbered, tasks.RULES, "row_no", "y"), "row_no")


# H: preparation and baselines


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", '{'categorical' if c == 'linestatus' else 'numeric'}' AS kind, count({c}) AS n_values, count(*) - count({c}) AS n_missing FROM returns""" for c in RETURN_FEATURES), "returns")
def h1_column_kinds(spark, sf):
    return baselines.column_values(tasks.returns(spark, sf), ("row_id", "y"))


@query("""+ m AS (SELECT quantile_cont(discount, 0.5) AS md FROM returns), z AS (SELECT row_id, tax, coalesce(discount, md) AS d FROM returns, m),
t AS (SELECT avg(tax) AS mt, stddev_pop(tax) AS st, avg(d) AS a, stddev_pop(d) AS s FROM z)
SELECT row_id, round((tax - mt) / st, 6) AS tax, round((d - a) / s, 6) AS discount FROM z, t""", "returns")
def h2_impute_scale(spark, sf):
    df = tasks.returns(spark, sf)
    return _round(baselines.impute_scale(df, baselines.numeric_stats(df, ["tax", "discount"])), 6, "tax", "discount").select("row_id", "tax", "discount")


@query("""+ q AS (SELECT row_id, nullif(priority, '1-URGENT') AS priority FROM finished), m AS (SELECT priority FROM q WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)
SELECT coalesce(q.priority, (SELECT priority FROM m)) AS priority, count(*) AS n FROM q GROUP BY 1""", "finished")
def h3_impute_mode(spark, sf):
    df = tasks.finished(spark, sf).withColumn("priority", F.nullif("priority", F.lit("1-URGENT")))
    return baselines.impute_modes(df, baselines.modes(df, ["priority"])).groupBy("priority").agg(F.count("*").alias("n"))


@query("""+ q AS (SELECT row_id, nullif(priority, '1-URGENT') AS priority FROM finished), tr AS (SELECT priority FROM q WHERE priority <> '5-LOW'),
m AS (SELECT priority FROM tr GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1), c AS (SELECT list(DISTINCT priority ORDER BY priority) AS cats FROM tr)
SELECT row_id, array_to_string([(x = filled)::INT FOR x IN cats], ',') AS hot FROM (SELECT row_id, coalesce(q.priority, m.priority) AS filled FROM q, m), c""", "finished")
def h3_one_hot(spark, sf):
    df = tasks.finished(spark, sf).select("row_id", F.nullif("priority", F.lit("1-URGENT")).alias("priority"))
    hot = baselines.one_hot(df.where("priority <> '5-LOW'"), df, ["priority"])
    return hot.select("row_id", F.array_join("priority", ",").alias("hot"))


@query("""+ s AS (SELECT row_id, segment, (dense_rank() OVER (ORDER BY segment) - 1)::INT AS i FROM finished), p AS (SELECT priority, (row_number() OVER (ORDER BY priority) - 1)::INT AS i FROM (SELECT DISTINCT priority FROM finished WHERE priority <> '5-LOW')),
k AS (SELECT count(DISTINCT segment)::INT AS n FROM finished)
SELECT f.row_id, (n + (SELECT count(*) FROM p))::INT AS size, array_to_string([x FOR x IN [s.i, n + p.i] IF x IS NOT NULL], ',') AS indices
FROM finished f JOIN s ON f.row_id = s.row_id JOIN k ON true LEFT JOIN p ON f.priority = p.priority""", "finished")
def h3_sparse_one_hot(spark, sf):
    df = tasks.finished(spark, sf).select("row_id", "segment", "priority")
    hot, _ = baselines.sparse_one_hot(df.where("priority <> '5-LOW'"), df, ["segment", "priority"])
    return hot.select("row_id", "hot.size", F.array_join("hot.indices", ",").alias("indices"))


@query("""SELECT 'segment' AS "column", 'categorical' AS kind, segment AS value, (dense_rank() OVER (ORDER BY segment) - 1)::DOUBLE AS code FROM (SELECT DISTINCT segment FROM finished)
UNION ALL SELECT 'acctbal', 'numeric', NULL, round(quantile_cont(acctbal, 0.5), 6) FROM finished""", "finished")
def h4_fit_encoding(spark, sf):
    return _round(baselines.encoding_metadata(tasks.finished(spark, sf).select("segment", "acctbal")), 6, "code")


@query("""+ tr AS (SELECT * FROM finished WHERE segment <> 'BUILDING'), e AS (SELECT segment, (dense_rank() OVER (ORDER BY segment) - 1)::DOUBLE AS code FROM (SELECT DISTINCT segment FROM tr))
SELECT f.row_id, coalesce(e.code, -1.0) AS segment, 0.0::DOUBLE AS absent FROM finished f LEFT JOIN e ON f.segment = e.segment""", "finished")
def h5_apply_encoding(spark, sf):
    df = tasks.finished(spark, sf)
    meta = baselines.encoding_metadata(df.where("segment <> 'BUILDING'").select("segment", F.lit(1.5).alias("absent")))
    return baselines.apply_encoding(df.select("row_id", "segment"), meta).select("row_id", "segment", "absent")


@query("""+ e AS (SELECT priority, dense_rank() OVER (ORDER BY priority)::INT AS id FROM (SELECT DISTINCT priority FROM finished WHERE priority > '2'))
SELECT f.row_id, coalesce(e.id, 0)::INT AS priority FROM finished f LEFT JOIN e ON f.priority = e.priority""", "finished")
def h6_index_with_unknown(spark, sf):
    df = tasks.finished(spark, sf)
    return baselines.index_with_unknown(df.where("priority > '2'"), df.select("row_id", "priority"), ["priority"]).select("row_id", F.col("priority").cast("int").alias("priority"))


@query("""+ n AS (SELECT y, count(*) AS c FROM quality GROUP BY y), t AS (SELECT sum(c) AS n, count(*) AS k, max(c) FILTER (y = 0) / max(c) FILTER (y = 1) AS pos FROM n)
SELECT y, round(n / (k * c), 6) AS balanced, round(CASE WHEN y = 1 THEN pos ELSE 1.0 END, 6) AS pos FROM n, t""", "quality")
def h7_class_weights(spark, sf):
    df = tasks.quality(spark, sf)
    return _round(df.select("y", baselines.class_weights(df, "y").alias("balanced"), baselines.class_weights(df, "y", "pos").alias("pos")).distinct(), 6, "balanced", "pos")


def _baseline(name: str):
    def run(spark, sf):
        df = tasks.finished(spark, sf)
        part = F.substring(hash_order(1, "fold", "row_id"), 1, 1)
        train, test = (df.where(c).drop("row_id") for c in (part < "c", part >= "c"))
        return baselines.fit_eval_baseline(name, train, test, "y", weights="pos" if name.startswith("boosting") else "balanced")

    return run


for _i, _name in ((8, "logistic"), (9, "tree"), (10, "mlp"), (11, "boosting_a"), (11, "boosting_b")):
    QUERIES[f"h{_i}_baseline_{_name}"] = _baseline(_name)


#: The sizes of the reference's drift study.
DRIFT_STAGES = sampling.TwoStageSpec(train1=1000, train2=40, val_total=500, test_total=800)


@query()
def h12_h16_two_stage_baselines(spark, sf):
    stages = (drift.StageSpec(("acctbal", "totalprice", "segment")), drift.StageSpec(("acctbal", "totalprice", "priority")))
    bundles = drift.stage_bundles(tasks.finished(spark, sf), "y", "row_id", stages, DRIFT_STAGES, 42)
    path = scratch_path(spark, "stages")
    for name, b in bundles.items():
        b.write.parquet(f"{path}/{name}")
    one, two = (spark.read.parquet(f"{path}/{name}") for name in bundles)
    return baselines.two_stage_baselines(one, two, "y")


# I: grids


def _grid(spark, sf) -> DataFrame:
    """Every train size, ratio and seed for the task that the orders hold."""
    found = tasks.finished(spark, sf).select(F.lit("finished").alias("dataset")).distinct()
    return grid.ratio_grid(found, grid.TRAIN_SIZES)


def _values(values) -> str:
    return ", ".join(f"({', '.join(map(str, v if isinstance(v, tuple) else (v,)))}, {i})" for i, v in enumerate(values))


def _grid_sql(totals) -> str:
    return f"(VALUES {_values(totals)}) a(total, o), (VALUES {_values(grid.RATIOS)}) b(p, n, r), (VALUES {_values(grid.SEEDS)}) d(seed, s)"


TARGET = "greatest(1, least(total - 1, round_even(total * p / (p + n), 0)))::INT"
GRID = f"""g AS (SELECT o * 27 + r * 3 + s AS cell_id, total, p, n, seed FROM {_grid_sql(grid.TRAIN_SIZES)}),
t AS (SELECT cell_id, seed, 1 AS label, {TARGET} AS target, total FROM g),
tt AS (SELECT cell_id, seed, label, target FROM t UNION ALL SELECT cell_id, seed, 0, total - target FROM t)"""


@query(f"""+ g AS (SELECT row_number() OVER (ORDER BY segment, o, r, s) - 1 AS cell_id, segment, total, p, n, seed FROM (SELECT DISTINCT segment FROM finished), {_grid_sql(grid.TOTALS)}),
t AS (SELECT cell_id, segment, seed, 1 AS label, {TARGET} AS target, total FROM g WHERE seed <> 40),
tt AS (SELECT cell_id, segment, seed, label, target FROM t UNION ALL SELECT cell_id, segment, seed, 0, total - target FROM t),
have AS (SELECT segment, y, count(*) AS available FROM finished GROUP BY ALL)
SELECT cell_id, tt.segment, seed, label, target::INT AS target, coalesce(available, 0) AS available FROM tt LEFT JOIN have ON tt.segment = have.segment AND label = y""", "finished")
def i1_i2_experiment_grid(spark, sf):
    pool = tasks.finished(spark, sf)
    have = pool.groupBy("segment", F.col("y").alias("label")).agg(F.count("*").alias("available"))
    cells = grid.filter_grid(grid.ratio_grid(pool.select("segment").distinct()), seed=[36, 42])
    targets = grid.cell_targets(cells, p="p", n="n").join(have, ["segment", "label"], "left")
    return targets.select("cell_id", "segment", "seed", "label", "target", F.coalesce("available", F.lit(0)).alias("available"))


def _cells_sql(pool: str) -> str:
    return f"""+ {GRID}, have AS (SELECT y, count(*) AS have FROM {pool} GROUP BY y),
r AS (SELECT seed, row_id, y, row_number() OVER (PARTITION BY seed, y ORDER BY md5(seed || '|cells|' || row_id), row_id) AS r FROM {pool}, (VALUES (36), (40), (42)) d(seed)),
w AS (SELECT cell_id, seed, label, target, have, unnest(range(1, target + 1)) AS draw_id FROM tt JOIN have ON label = have.y),
x AS (SELECT *, CASE WHEN have >= target THEN draw_id ELSE ('0x' || substr(md5(seed || '|draws|' || cell_id || '.' || label || '.' || draw_id), 1, 8))::BIGINT % have + 1 END AS at FROM w),
cells AS (SELECT cell_id, x.seed, draw_id::INT AS draw_id, row_id, y FROM x JOIN r ON r.seed = x.seed AND r.y = x.label AND r.r = x.at) """


CELLS = _cells_sql("finished")


def _cells(spark, sf, task=tasks.finished):
    return grid.sample_cells(task(spark, sf), grid.cell_targets(_grid(spark, sf), p="p", n="n"), "y", "row_id")


@query(CELLS + "SELECT cell_id, seed, draw_id, row_id, y FROM cells", "finished")
def i3_sample_cells(spark, sf):
    return _cells(spark, sf)


@query(_cells_sql("quality") + "SELECT cell_id, seed, draw_id, row_id, y FROM cells", "quality")
def i3_cells_with_replacement(spark, sf):
    """The labelled documents are too few for 3000 at 50 to 1, so their cells are drawn with replacement."""
    return _cells(spark, sf, tasks.quality)


@query(CELLS + """, s AS (SELECT cell_id, c.y, (totalprice > 200000)::INT AS p FROM cells c JOIN finished f ON c.row_id = f.row_id)
SELECT s.cell_id, round(avg((s.y = s.p)::INT), 6) AS acc, count(*) AS n, CASE WHEN count(*) < any_value(g.total) THEN 'short' ELSE 'ok' END AS status FROM s JOIN g ON s.cell_id = g.cell_id GROUP BY s.cell_id""", "finished")
def i4_evaluate_cells(spark, sf):
    scored = _cells(spark, sf).join(tasks.finished(spark, sf).select("row_id", (F.col("totalprice") > 200_000).cast("int").alias("prediction")), "row_id")
    return _round(grid.evaluate_cells(scored, _grid(spark, sf).drop("n"), total="total"), 6, "acc").select("cell_id", "acc", "n", "status")


@query("""SELECT o_orderpriority, CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 99 END AS place, count(*) AS n FROM orders GROUP BY ALL""")
def i5_order_report(spark, sf):
    known = ["3-MEDIUM", "1-URGENT"]
    counts = tasks.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return grid.order_report(counts, {"o_orderpriority": known}).withColumn("place", grid.order_of(F.col("o_orderpriority"), known))


@query("""SELECT 'U' || (n_nationkey % 2) || '_K' || (n_nationkey // 2 % 2) || '_' || n_nationkey AS name, (n_nationkey % 2)::INT AS use_profile, (n_nationkey // 2 % 2)::INT AS use_knowledge,
  CASE WHEN c.n IS NULL THEN 'missing' ELSE 'ok' END AS status, coalesce(printf('%.3f', c.acc), '') AS acc
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, avg(((c_acctbal > 0) = (c_mktsegment > 'C'))::INT) AS acc FROM customer WHERE c_nationkey % 5 > 0 GROUP BY 1) c ON n_nationkey = c_nationkey""")
def i6_ablation_report(spark, sf):
    key = F.col("n_nationkey")
    index = tasks.table(spark, sf, "nation").select(key.alias("run_id"), F.concat(F.lit("U"), key % 2, F.lit("_K"), F.floor(key / 2) % 2, F.lit("_"), key).alias("name"))
    scored = tasks.table(spark, sf, "customer").where("c_nationkey % 5 > 0").select(F.col("c_nationkey").alias("run_id"), (F.col("c_mktsegment") > "C").cast("int").alias("y"), (F.col("c_acctbal") > 0).cast("int").alias("prediction"))
    return grid.ablation_report(index, metrics.classification_metrics(scored, ["run_id"])).select("name", "use_profile", "use_knowledge", "status", "acc")


@query(f"+ {GRID}, r AS (SELECT cell_id * 2 + run_no AS cell_id, run_no, s2.seed, total, p, n FROM g, (VALUES (0, 11), (1, 12)) s2(run_no, seed)) SELECT cell_id, run_no::INT AS run_no, r.seed::INT AS seed, total::BIGINT AS total, count(*) FILTER (quality.y = 1) AS positives FROM r, quality GROUP BY ALL", "quality")
def i7_repeat_runs(spark, sf):
    """The whole grid again with fresh seeds, each run beside what the pool holds."""
    cells = grid.repeat_runs(_grid(spark, sf), [11, 12])
    held = tasks.quality(spark, sf).agg(F.count_if(F.col("y") == 1).alias("positives"))
    return cells.join(F.broadcast(held)).select("cell_id", F.col("run_no").cast("int").alias("run_no"), F.col("seed").cast("int").alias("seed"), F.col("total").cast("long").alias("total"), "positives")


@query(SCORED + "SELECT version AS model, round(f1, 6) AS f1 FROM hist UNION ALL SELECT 'always', round(2 * avg(y) / (1 + avg(y)), 6) FROM returns", "returns")
def i8_combine_results(spark, sf):
    always = metrics.classification_metrics(tasks.returns(spark, sf).withColumn("prediction", F.lit(1))).withColumn("model", F.lit("always"))
    return _round(grid.combine_results(_history(spark, sf).withColumnRenamed("version", "model"), always), 6, "f1").select("model", "f1")


@query(f"WITH {GRID}, {tasks.SQL['quality']}, n AS (SELECT y, count(*) AS available FROM quality GROUP BY y) SELECT cell_id, label, target::INT AS target, coalesce(available, 0) AS available, coalesce(available, 0) < target AS replaced FROM tt LEFT JOIN n ON y = label")
def i9_sampling_audit(spark, sf):
    return grid.sampling_audit(tasks.quality(spark, sf), grid.cell_targets(_grid(spark, sf), p="p", n="n"), "y")


@query("SELECT date_trunc('day', ts) AS start, count(*) FILTER (event_type = 'purchase' AND value > 50) AS tp, count(*) FILTER (event_type <> 'purchase' AND NOT coalesce(value > 50, false)) AS tn, count(*) FILTER (event_type <> 'purchase' AND value > 50) AS fp, count(*) FILTER (event_type = 'purchase' AND NOT coalesce(value > 50, false)) AS fn FROM events GROUP BY 1")
def s1_windowed_confusion(spark, sf):
    events = tasks.table(spark, sf, "events").withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    rule = {"triggers": [{"op": ">", "col": "value", "value": 50}], "points": [], "cutoff": 1}
    return scoring.windowed_confusion(events, rule, "ts", "y", "1 day")
