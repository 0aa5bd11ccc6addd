"""Queries of cleaning, filters, projections, set operations, ordering and windows."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cleaning as C
from ..operators import rows as R
from . import query

MONTHLY = "SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS month, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"


def monthly(t):
    return t("lineitem").groupBy("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum("l_quantity").alias("v"))


@query("c02_c03_trim_and_missing", "SELECT doc_id, CASE WHEN trim(lang) = '' OR lower(trim(lang)) IN ('unknown') THEN NULL ELSE trim(lang) END AS lang FROM documents")
def _(t):
    padded = t("documents").select("doc_id", F.concat(F.lit(" "), "lang", F.lit(" ")).alias("lang"))
    return C.normalize_na(C.trim_strings(padded))


@query("c05_coerce_numeric", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * floor(o_totalprice) AS price FROM orders")
def _(t):
    whole = F.format_number(F.floor("o_totalprice"), 0)
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("($"), whole, F.lit(")"))).otherwise(F.concat(F.lit("$"), whole))
    return C.coerce_numeric(t("orders").select("o_orderkey", text.alias("price")))


@query("c06_parse_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def _(t):
    return C.parse_dates(t("orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d")), "d").withColumn("d", F.col("d").cast("string"))


@query("c08_sentinels", "SELECT 'p_size' AS \"column\", count(*) FILTER (p_size = 1) AS sentinels FROM part")
def _(t):
    return C.count_sentinels(t("part").withColumn("p_size", F.when(F.col("p_size") == 1, -999).otherwise(F.col("p_size"))), ["p_size"])


@query("c09_standardize_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m') AS o_orderdate FROM orders")
def _(t):
    return C.standardize_dates(t("orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate")), "o_orderdate", "yyyy/MM")


@query("c10_normalize_categories", "SELECT c_custkey, CASE trim(c_mktsegment) WHEN 'BUILDING' THEN 'construction' ELSE lower(trim(c_mktsegment)) END AS c_mktsegment FROM customer")
def _(t):
    return C.normalize_categories(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "lower", {"BUILDING": "construction"})


@query("c11_fill_missing", "WITH p AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END AS s FROM part) SELECT p_partkey, coalesce(s, (SELECT median(s) FROM p)) AS s FROM p")
def _(t):
    return C.fill_missing(t("part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("s")), "s", "median")


@query("c12_deduplicate", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def _(t):
    return C.deduplicate(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


FENCES = "SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders"


@query("c13_outliers", f"WITH q AS ({FENCES}) SELECT o_orderkey, least(greatest(o_totalprice, a - 0.5 * (b - a)), b + 0.5 * (b - a)) AS o_totalprice FROM orders, q")
def _(t):
    return C.handle_outliers(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "clamp", 0.5)


@query("c14_cast_failures", "SELECT count(*) AS known, count(*) FILTER (try_cast(substr(p_name, 1, 2) AS INTEGER) IS NULL) AS failed FROM part")
def _(t):
    return C.cast_failures(t("part").select(F.substring("p_name", 1, 2).alias("x")), "x", "int")


@query("c15_recipe", f"WITH q AS ({FENCES}) SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, o_totalprice FROM orders, q WHERE o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def _(t):
    steps = [{"step": "normalize_categories", "column": "o_orderstatus"}, {"step": "handle_outliers", "column": "o_totalprice", "action": "drop"}]
    return C.apply_recipe(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), steps)


@query("c15_recipe_log", f"""
    WITH q AS ({FENCES}), o AS (SELECT count(*) AS n, count(*) FILTER (lower(o_orderstatus) <> o_orderstatus) AS lowered, count(*) FILTER (o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) AS far FROM orders, q)
    SELECT 1 AS step, 'normalize_categories' AS name, '{{"column": "o_orderstatus"}}' AS arguments, n AS rows_before, n AS rows_after, lowered AS rows_changed, 3 AS columns_before, 3 AS columns_after FROM o
    UNION ALL SELECT 2, 'handle_outliers', '{{"action": "drop", "column": "o_totalprice"}}', n, n - far, far, 3, 3 FROM o""")  # fmt: skip
def _(t):
    steps = [{"step": "normalize_categories", "column": "o_orderstatus"}, {"step": "handle_outliers", "column": "o_totalprice", "action": "drop"}]
    return C.logged_recipe(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), steps)[1]


@query("c16_impute", "WITH p AS (SELECT p_partkey, p_retailprice, CASE WHEN p_size > 10 THEN p_size END AS s FROM part) SELECT p_partkey, p_retailprice, CAST(coalesce(s, (SELECT median(s) FROM p)) AS DOUBLE) AS s FROM p")
def _(t):
    return C.impute(t("part").select("p_partkey", "p_retailprice", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("s")), "p_retailprice", ["s"])


@query("c17_fuzzy_categories", """
    SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL UNION ALL
    SELECT CASE c_nationkey % 4 WHEN 0 THEN '北京' WHEN 1 THEN '上海' WHEN 2 THEN 'Москва' ELSE '?' END, count(*) FROM customer GROUP BY ALL
""")
def _(t):
    """Spellings with a mark at the end, with two, and in scripts without ASCII letters."""
    k = F.col("c_custkey")
    marks = F.when(k % 49 == 0, "..x").when(k % 7 == 0, ".").otherwise("")
    noisy = t("customer").select(F.concat("c_mktsegment", marks).alias("c_mktsegment"))
    other = F.when(F.col("c_nationkey") % 4 == 0, "北京").when(F.col("c_nationkey") % 4 == 1, "上海").when(F.col("c_nationkey") % 4 == 2, F.when(k % 9 == 0, "москва!").otherwise("Москва")).otherwise("?")
    return C.merge_fuzzy_categories(noisy.union(t("customer").select(other)), "c_mktsegment").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("c18_mask", "SELECT c_custkey, 'MASKED_' || substr(sha256(c_custkey || '@example.com_s'), 1, 12) AS mail FROM customer")
def _(t):
    return C.mask_personal(t("customer").select("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("mail")), "s")


@query("c19_row_policy", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    return C.row_policy(t("customer"), c_mktsegment="BUILDING").agg(F.count("*").alias("n"))


@query("c21_content_hash", "SELECT count(*) AS rows, true AS same_in_any_order, false AS same_with_a_cell_changed, false AS same_with_null_as_text FROM orders")
def _(t):
    o = t("orders")
    hashed = lambda df, name: C.content_hash(df).select("rows", F.col("sha256").alias(name))
    other = o.select(*reversed(o.columns)).repartition(5, "o_custkey")
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == F.lit(o.agg(F.min("o_orderkey")).first()[0]), "?").otherwise(F.col("o_orderstatus")))
    holed = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")))
    facts = hashed(o, "a").join(hashed(other, "b"), "rows").join(hashed(changed, "c"), "rows").join(hashed(holed, "d"), "rows").join(hashed(holed.fillna("\x00", ["o_orderstatus"]), "e"), "rows")
    return facts.select("rows", (F.col("a") == F.col("b")).alias("same_in_any_order"), (F.col("a") == F.col("c")).alias("same_with_a_cell_changed"), (F.col("d") == F.col("e")).alias("same_with_null_as_text"))


@query("f01_where", """
    SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) <> 'p' AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')
      AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_custkey IS NOT NULL""")  # fmt: skip
def _(t):
    conditions = [("o_orderstatus", "!=", "P"), ("o_totalprice", "between", (1000, 200000)), ("o_orderpriority", "in", ["1-urgent", "2-high"]), ("o_orderdate", ">=", "1995-01-01"), ("o_custkey", "is not null")]
    return R.where(t("orders"), conditions).select("o_orderkey")


@query("f09_time_range", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01'")
def _(t):
    return R.in_range(t("orders"), "o_orderdate", "1995-01-01", "1995-04-01").agg(F.count("*").alias("n"))


@query("f10_population_status", "SELECT avg(o_totalprice) AS value, count(*) AS n, CASE WHEN count(*) = 0 THEN 'empty_population' ELSE 'ok' END AS status FROM orders WHERE o_orderstatus = 'absent'")
def _(t):
    return R.population(t("orders"), [("o_orderstatus", "=", "absent")], "o_totalprice")


@query("v01_v03_project_derive", "SELECT l_orderkey AS id, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit FROM lineitem")
def _(t):
    return R.project(R.derive(t("lineitem"), "unit", S.ratio(F.col("l_extendedprice"), F.col("l_quantity"))), [("l_orderkey", "id"), "l_linenumber", "unit"])


@query("v06_what_if_cap", "SELECT sum(l_extendedprice * (1 - l_discount)) AS actual, sum(l_extendedprice * (1 - least(l_discount, 0.05))) AS scenario, sum(l_extendedprice * (1 - least(l_discount, 0.05))) - sum(l_extendedprice * (1 - l_discount)) AS delta FROM lineitem")
def _(t):
    return R.what_if_cap(t("lineitem"), "l_extendedprice", "l_discount", 0.05)


@query("v07_what_if_growth", "SELECT sum(o_totalprice) AS actual, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 1.1 ELSE o_totalprice END) AS scenario, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 1.1 ELSE o_totalprice END) - sum(o_totalprice) AS delta FROM orders")
def _(t):
    return R.what_if_growth(t("orders"), "o_orderstatus", "O", "o_totalprice", 0.1)


@query("v08_quantile_bins", """
    WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part)
    SELECT CAST(p_retailprice > a AS INTEGER) + CAST(p_retailprice > b AS INTEGER) + CAST(p_retailprice > c AS INTEGER) AS bin, count(*) AS n FROM part, q GROUP BY 1""")  # fmt: skip
def _(t):
    return R.quantile_bins(t("part"), "p_retailprice").groupBy("bin").agg(F.count("*").alias("n"))


@query("v09_one_hot", "SELECT CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS f, CAST(sum(CAST(o_orderstatus = 'O' AS INTEGER)) AS BIGINT) AS o FROM orders")
def _(t):
    return R.one_hot(t("orders"), "o_orderstatus").agg(F.sum("`o_orderstatus=F`").alias("f"), F.sum("`o_orderstatus=O`").alias("o"))


EDITED = "SELECT o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 33 <> 0"


@query("u01_bag_difference", f"""
    WITH b AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS nb FROM orders GROUP BY ALL), a AS (SELECT o_custkey, s, count(*) AS na FROM ({EDITED}) GROUP BY ALL),
    d AS (SELECT coalesce(na, 0) - coalesce(nb, 0) AS d FROM b FULL JOIN a USING (o_custkey, s))
    SELECT CAST(sum(greatest(d, 0)) AS BIGINT) AS added, CAST(sum(greatest(-d, 0)) AS BIGINT) AS removed FROM d""")  # fmt: skip
def _(t):
    o = t("orders")
    after = o.filter(F.col("o_orderkey") % 33 != 0).select("o_custkey", F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return R.bag_difference(o.select("o_custkey", F.col("o_orderstatus").alias("s")), after)


@query("u02_key_sets", """
    WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
    SELECT count(*) AS "union", count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS intersection, count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k""")  # fmt: skip
def _(t):
    return R.key_sets(t("customer").select(F.col("c_custkey").alias("k")), t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), "k")


@query("w01_rank_groups", "SELECT c_mktsegment, sum(c_acctbal) AS value, CAST(row_number() OVER (ORDER BY sum(c_acctbal) DESC, c_mktsegment) AS INTEGER) AS rank FROM customer GROUP BY c_mktsegment")
def _(t):
    return R.rank_groups(t("customer").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("value")), "value", "c_mktsegment")


@query("w02_leaders", "SELECT p_brand, max(p_size) AS value FROM part GROUP BY p_brand QUALIFY rank() OVER (ORDER BY max(p_size) DESC) = 1")
def _(t):
    return R.leaders(t("part").groupBy("p_brand").agg(F.max("p_size").alias("value")), "value")


@query("w03_w05_smoothed", f"""
    SELECT *, v - lag(v) OVER w AS delta, avg(v) OVER (PARTITION BY l_returnflag ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_average,
      sum(v) OVER (PARTITION BY l_returnflag ORDER BY month ROWS UNBOUNDED PRECEDING) AS running_total
    FROM ({MONTHLY}) WINDOW w AS (PARTITION BY l_returnflag ORDER BY month)""")  # fmt: skip
def _(t):
    return R.smoothed(monthly(t), ["l_returnflag"], "month", "v")


@query("w06_exponential_average", f"""
    WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY month) AS i FROM ({MONTHLY})),
    e AS (SELECT l_returnflag, i, CAST(v AS DOUBLE) AS ema FROM s WHERE i = 1 UNION ALL SELECT s.l_returnflag, s.i, 0.5 * s.v + 0.5 * e.ema FROM e JOIN s ON s.l_returnflag = e.l_returnflag AND s.i = e.i + 1)
    SELECT l_returnflag, arg_max(ema, i) AS ema FROM e GROUP BY l_returnflag""")  # fmt: skip
def _(t):
    return R.exponential_average(monthly(t), ["l_returnflag"], "month", "v", 3)


@query("w07_cusum_break", f"""
    WITH d AS (SELECT *, v - avg(v) OVER (PARTITION BY l_returnflag) AS d FROM ({MONTHLY})),
    c AS (SELECT *, abs(sum(d) OVER (PARTITION BY l_returnflag ORDER BY month ROWS UNBOUNDED PRECEDING)) AS cusum FROM d)
    SELECT l_returnflag, max(cusum) AS cusum, arg_max(month, cusum) AS at, max(cusum) > 1.5 * stddev_samp(v) * sqrt(count(v)) AS is_break FROM c GROUP BY l_returnflag""")  # fmt: skip
def _(t):
    return R.cusum_break(monthly(t), ["l_returnflag"], "month", "v")


@query("w08_control_chart", """
    WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS i FROM (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY ALL)),
    b AS (SELECT event_type, avg(v) AS m, stddev_pop(v) AS sd FROM s WHERE i <= 20 GROUP BY event_type),
    c(event_type, i, up, down, alarms) AS (SELECT event_type, CAST(20 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 0 FROM b UNION ALL
      SELECT event_type, i, CASE WHEN greatest(u, d) > 4 * sd THEN 0 ELSE u END, CASE WHEN greatest(u, d) > 4 * sd THEN 0 ELSE d END, alarms + CAST(greatest(u, d) > 4 * sd AS INTEGER)
      FROM (SELECT c.event_type, s.i, alarms, sd, greatest(0, up + v - m - 0.5 * sd) AS u, greatest(0, down - v + m - 0.5 * sd) AS d FROM c JOIN s ON s.event_type = c.event_type AND s.i = c.i + 1 JOIN b ON b.event_type = c.event_type))
    SELECT event_type, max(alarms) AS alarms, CAST(any_value(n) AS INTEGER) AS n FROM c JOIN (SELECT event_type, count(*) AS n FROM s GROUP BY event_type) USING (event_type) GROUP BY event_type""")  # fmt: skip
def _(t):
    return R.control_chart(t("events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("v")), ["event_type"], "hour", "v")


@query("w09_rolling_anomalies", f"""
    WITH s AS (SELECT *, avg(v) OVER w AS expected, stddev_samp(v) OVER w AS spread, count(v) OVER w AS held FROM ({MONTHLY})
      WINDOW w AS (PARTITION BY l_returnflag ORDER BY month ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    SELECT l_returnflag, month, v, expected, spread FROM s WHERE held >= 3 AND spread > 0 AND abs(v - expected) > 2 * spread""")  # fmt: skip
def _(t):
    return R.rolling_anomalies(monthly(t), ["l_returnflag"], "month", "v")


@query("w10_w14_carried", """
    SELECT event_id, first_value(value) OVER w AS first, lag(value) OVER w AS previous, value - avg(value) OVER (PARTITION BY user_id) AS residual
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")  # fmt: skip
def _(t):
    return R.carried(t("events"), "user_id", ["ts", "event_id"], "value").select("event_id", "first", "previous", "residual")


@query("w12_sharp_transition", f"""
    WITH s AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY l_returnflag ORDER BY month)) AS step FROM ({MONTHLY}))
    SELECT l_returnflag, max(step) AS step, arg_max(month, step) AS at, max(step) > 1.5 * avg(step) AS is_sharp FROM s GROUP BY l_returnflag""")  # fmt: skip
def _(t):
    return R.sharp_transition(monthly(t), ["l_returnflag"], "month", "v")


@query("l03_top_groups", "SELECT o_custkey, sum(o_totalprice) AS value FROM orders GROUP BY o_custkey ORDER BY value DESC, o_custkey LIMIT 10")
def _(t):
    return R.top_groups(t("orders"), "o_custkey", "o_totalprice", 10)


@query("l04_capped", "SELECT n_nationkey, n_name, true AS truncated FROM nation ORDER BY n_nationkey LIMIT 10")
def _(t):
    return R.capped(t("nation").select("n_nationkey", "n_name"), ["n_nationkey"], 10)


@query("x_scalars", """
    SELECT p_partkey, (1 - levenshtein(p_brand, p_type) / CAST(greatest(length(p_brand), length(p_type)) AS DOUBLE)) * 100 AS similarity, contains(lower(p_type), 'steel') AS steel,
      least(greatest(p_size, 10), 20) AS clipped, atanh(p_size / 100.0) AS z FROM part""")  # fmt: skip
def _(t):
    return t("part").select("p_partkey", S.similarity(F.col("p_brand"), F.col("p_type")).alias("similarity"), S.contains_text(F.col("p_type"), "STEEL").alias("steel"), S.clip(F.col("p_size"), 10, 20).alias("clipped"), S.fisher_z(F.col("p_size") / 100.0).alias("z"))
