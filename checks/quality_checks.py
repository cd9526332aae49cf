"""Quality, structure, cleaning and join queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.base import DIRTY_CUSTOMER, DIRTY_ORDERS, FENCES, LABELLED, LINE_ALL, ORDER, ORDER_ALL, check, long_sql
from checks.profile_checks import cardinality_sql
from plumbline.operators import cleaning, merging, quality, structure

AS_OF = datetime(2024, 1, 1)

# ---- quality ------------------------------------------------------------------------------

_all = ", ".join(ORDER_ALL)
BASE = f"""{DIRTY_ORDERS}, long AS ({long_sql('orders_dirty', ORDER)}), {FENCES},
b AS (SELECT count(*) AS n, count(*) - count(o_totalprice) AS miss, 100.0 * (count(*) - count(o_totalprice)) / (6 * count(*)) AS miss_pct FROM orders_dirty),
d AS (SELECT sum(k) - count(*) AS dup FROM (SELECT count(*) AS k FROM orders_dirty GROUP BY {_all})),
o AS (SELECT count(*) FILTER (WHERE x < lo OR x > hi) AS out, count(x) AS vals FROM long JOIN fences USING ("column"))"""


@check("dri_orders_dirty", f"""WITH {BASE},
c AS (SELECT "column", x AS value, count(*) AS n FROM ({long_sql('orders_dirty', ['o_orderstatus', 'o_orderpriority'], 'VARCHAR')}) GROUP BY 1, 2),
e AS (SELECT "column", -sum(n / t * log2(n / t)) / log2(count(*)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY "column") AS t FROM c) GROUP BY 1 HAVING count(*) > 1),
z AS (SELECT list_sum([CAST(v = 1 AS INT) FOR v IN [count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_orderstatus), count(DISTINCT o_totalprice), count(DISTINCT o_orderdate), count(DISTINCT o_orderpriority)]]) AS flat,
  CAST(1.0 * count(DISTINCT o_orderstatus) / count(*) > 0.5 AS INT) + CAST(1.0 * count(DISTINCT o_orderpriority) / count(*) > 0.5 AS INT) AS high,
  CAST(count(o_orderstatus) = count(TRY_CAST(o_orderstatus AS DOUBLE)) AS INT) + CAST(count(o_orderpriority) = count(TRY_CAST(o_orderpriority AS DOUBLE)) AS INT) AS typed,
  CAST(max(o_orderdate) > TIMESTAMP '2024-01-01' AS INT) + CAST(min(o_orderdate) < TIMESTAMP '1900-01-01' AS INT) AS dates FROM orders_dirty),
s AS (SELECT CASE WHEN miss_pct = 0 THEN 100.0 WHEN miss_pct < 5 THEN 90 WHEN miss_pct < 10 THEN 75 WHEN miss_pct < 20 THEN 50 ELSE 100 - miss_pct END AS s1,
  CASE WHEN dup = 0 THEN 100.0 WHEN 100.0 * dup / n < 1 THEN 95 WHEN 100.0 * dup / n < 5 THEN 80 WHEN 100.0 * dup / n < 10 THEN 60 ELSE greatest(0, 100 - 200.0 * dup / n) END AS s2,
  CASE WHEN 100.0 * out / vals < 1 THEN 100.0 WHEN 100.0 * out / vals < 5 THEN 90 WHEN 100.0 * out / vals < 10 THEN 75 ELSE greatest(0, 100 - 200.0 * out / vals) END AS s3,
  100.0 - 100.0 * typed / 6 AS s4, (SELECT 100.0 * avg(h) FROM e) AS s5, greatest(0, 100.0 - 50.0 * dates) AS s6, 100.0 - 100.0 * high / 2 AS s7, 100.0 - 100.0 * flat / 6 AS s8 FROM b, d, o, z),
l AS (SELECT unnest(['missingness', 'duplicates', 'outliers', 'type_consistency', 'category_balance', 'date_consistency', 'high_cardinality', 'zero_variance']) AS component,
  unnest([s1, s2, s3, s4, s5, s6, s7, s8]) AS score, unnest([0.20, 0.15, 0.15, 0.15, 0.10, 0.10, 0.10, 0.05]) AS weight, unnest([70, 80, 70, 90, 60, NULL, 70, 95]) AS bound,
  unnest(['high missing data rate', 'significant duplicate rows', 'high outlier rate', 'data type inconsistencies', 'severe category imbalance', NULL, 'high cardinality columns', 'zero-variance columns']) AS words FROM s)
SELECT component, score, weight, NULL AS grade, CASE WHEN score < bound THEN words END AS issue FROM l
UNION ALL SELECT 'total', sum(score * weight), 1.0, CASE WHEN sum(score * weight) >= 90 THEN 'A' WHEN sum(score * weight) >= 80 THEN 'B' WHEN sum(score * weight) >= 70 THEN 'C'
 WHEN sum(score * weight) >= 60 THEN 'D' ELSE 'F' END, NULL FROM l""", "score weight")
def _(t):
    return quality.dri(t.orders_dirty, AS_OF)


@check("dri_labelled")
def _(t):
    return quality.dri(t.labelled, AS_OF)


@check("quality_report_cardinality_lineitem", cardinality_sql("lineitem", LINE_ALL), "distinct_ratio")
def _(t):
    return quality.quality_report(t.lineitem, AS_OF)["cardinality"]


@check("quality_score_penalty", f"WITH {BASE} SELECT 'penalty' AS method, floor(greatest(0, 100 - least(40, 2 * miss_pct) - least(20, 500.0 * out / (6 * n)))) AS score, NULL::DOUBLE AS readiness FROM b, o", "score readiness")
def _(t):
    return quality.quality_score(t.orders_dirty, "penalty")


@check("quality_score_simple", f"WITH {BASE} SELECT 'simple' AS method, greatest(0, 100 - 0.5 * miss_pct - 30.0 * dup / n) AS score, NULL::DOUBLE AS readiness FROM b, d", "score readiness")
def _(t):
    return quality.quality_score(t.orders_dirty, "simple")


@check("quality_score_mean3", f"""WITH {BASE}, q AS (SELECT floor((100 - miss_pct + 100.0 * (n - dup) / n + 100 - 100.0 * out / (3 * n)) / 3 + 0.5) AS score, 100.0 * miss / n AS share FROM b, d, o)
SELECT 'mean3' AS method, score, CASE WHEN share > 20 THEN score - 10 ELSE score END AS readiness FROM q""", "score readiness")
def _(t):
    return quality.quality_score(t.orders_dirty, "mean3")


@check("quality_radar_orders_dirty", f"""WITH {BASE}, cv AS (SELECT sum(c) / count(*) AS c FROM (SELECT 100 * stddev_samp(x) / avg(x) AS c FROM long GROUP BY "column")),
p AS (SELECT floor(greatest(0, 100 - least(40, 2 * miss_pct) - least(20, 500.0 * out / (6 * n)))) AS score FROM b, o),
r AS (SELECT unnest(['completeness', 'consistency', 'validity', 'uniqueness']) AS axis, unnest([100 - miss_pct, score - c / 10, 100 - 200.0 * out / (6 * n), 100 - 100.0 * dup / n]) AS s FROM b, d, o, p, cv)
SELECT axis, greatest(0, least(100, s)) AS score FROM r""", "score")
def _(t):
    return quality.quality_radar(t.orders_dirty)


@check("completeness_orders_dirty", f"""WITH {BASE} SELECT n AS records, 6 AS columns, 6 * n AS cells, miss AS missing_cells, 100 - miss_pct AS completeness_pct, dup AS duplicate_rows,
 100.0 * dup / n AS duplicate_pct, 3 AS numeric_columns, 2 AS text_columns, 1 AS affected_columns,
 CASE WHEN miss_pct < 5 THEN 'good' WHEN miss_pct < 20 THEN 'attention' ELSE 'critical' END AS status, (100 - miss_pct + 100 - 100.0 * dup / n) / 2 AS score FROM b, d""",
       "completeness_pct duplicate_pct score", "columns cells duplicate_rows numeric_columns text_columns affected_columns")
def _(t):
    return quality.completeness(t.orders_dirty)


# ---- structure ----------------------------------------------------------------------------

@check("semantic_types_customer", """WITH s AS (SELECT count(*) AS n, count(DISTINCT c_name) AS a, count(DISTINCT c_acctbal) AS b, count(DISTINCT c_mktsegment) AS c, stddev_samp(length(c_mktsegment)) AS sd FROM customer)
SELECT 'c_custkey' AS "column", 'ID' AS semantic_type, 0.9 AS confidence UNION ALL SELECT 'c_nationkey', 'ID', 0.9
UNION ALL SELECT 'c_name', CASE WHEN a > 0.95 * n THEN 'ID' ELSE 'Text' END, CASE WHEN a > 0.95 * n THEN 0.9 ELSE 0.6 END FROM s
UNION ALL SELECT 'c_acctbal', CASE WHEN b > 0.95 * n THEN 'ID' ELSE 'Metric' END, CASE WHEN b > 0.95 * n THEN 0.9 ELSE 0.8 END FROM s
UNION ALL SELECT 'c_mktsegment', CASE WHEN c < 0.05 * n THEN 'Category' WHEN sd < 2 THEN 'Code' ELSE 'Text' END, CASE WHEN c < 0.05 * n THEN 0.85 WHEN sd < 2 THEN 0.75 ELSE 0.6 END FROM s""", "confidence")
def _(t):
    return structure.semantic_types(t.customer)


@check("primary_keys_nation", "SELECT 'n_nationkey' AS \"column\" FROM nation HAVING count(DISTINCT n_nationkey) = count(*) UNION ALL SELECT 'n_name' FROM nation HAVING count(DISTINCT n_name) = count(*) UNION ALL SELECT 'n_regionkey' FROM nation HAVING count(DISTINCT n_regionkey) = count(*)")
def _(t):
    return structure.primary_keys(t.nation)


def _fd_sql(source, cols):
    parts = [f"SELECT '{a}' AS determinant, '{b}' AS dependent FROM (SELECT {a}, count(DISTINCT {b}) AS k FROM {source} GROUP BY 1) HAVING min(k) = 1 AND max(k) = 1"
             for a in cols for b in cols if a != b]
    return " UNION ALL ".join(parts)


NATION_REGION = "(SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _nation_region(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_regionkey", "r_name")


@check("fd_nation_region", _fd_sql(NATION_REGION, ["n_nationkey", "n_name", "r_regionkey", "r_name"]))
def _(t):
    return structure.functional_dependencies(_nation_region(t))


LOW = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _relations_sql(source, cols):
    parts = []
    for a in cols:
        for b in cols:
            if a != b:
                parts.append(f"""SELECT '{a}' AS "left", '{b}' AS "right", CASE WHEN f AND NOT g THEN 'many_to_one' WHEN g AND NOT f THEN 'one_to_many' WHEN NOT f AND NOT g THEN 'many_to_many' END AS relationship FROM
 (SELECT max(k) = 1 AS f FROM (SELECT count(DISTINCT {b}) AS k FROM {source} GROUP BY {a})), (SELECT max(k) = 1 AS g FROM (SELECT count(DISTINCT {a}) AS k FROM {source} GROUP BY {b}))""")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE relationship IS NOT NULL"


@check("relationships_nation_region", _relations_sql(NATION_REGION, ["n_nationkey", "n_name", "r_regionkey", "r_name"]))
def _(t):
    return structure.relationships(_nation_region(t))


@check("relationships_lineitem", _relations_sql("lineitem", LOW))
def _(t):
    return structure.relationships(t.lineitem.select(*LOW))


@check("merge_keys_orders_customer", " UNION ALL ".join(
    f"""SELECT '{a}' AS left_key, '{b}' AS right_key, 'similar_distribution' AS match_type, 0.6 AS confidence FROM (SELECT count(*) AS k FROM (SELECT DISTINCT {a} AS v FROM orders INTERSECT SELECT DISTINCT {b} FROM customer)),
 (SELECT least((SELECT count(DISTINCT {a}) FROM orders), (SELECT count(DISTINCT {b}) FROM customer)) AS m) WHERE k / m > 0.5"""
    for a, b in (("o_orderkey", "c_custkey"), ("o_custkey", "c_custkey"), ("o_orderstatus", "c_name"), ("o_orderstatus", "c_mktsegment"), ("o_totalprice", "c_acctbal"),
                 ("o_orderpriority", "c_name"), ("o_orderpriority", "c_mktsegment"))), "confidence")
def _(t):
    return structure.suggest_merge_keys(t.orders, t.customer)


@check("schema_quality_orders", f"""WITH f AS ({_fd_sql('orders', ['o_orderstatus', 'o_orderpriority'])}), k AS (SELECT count(*) AS k FROM f)
SELECT true AS has_primary_key, k AS dependencies, k = 0 AS normalized, 100.0 - least(30, 5 * k) AS quality_score FROM k
WHERE (SELECT count(DISTINCT o_orderkey) = count(*) FROM orders)""", "quality_score")
def _(t):
    return structure.schema_quality(t.orders)


# ---- cleaning -----------------------------------------------------------------------------

@check("missing_cells_orders_dirty", f"WITH {DIRTY_ORDERS} SELECT count(*) FILTER (WHERE o_totalprice IS NULL) + count(*) FILTER (WHERE trim(o_orderpriority) = '') AS missing_cells FROM orders_dirty")
def _(t):
    return t.orders_dirty.agg(cleaning.missing_cells(t.orders_dirty).alias("missing_cells"))


@check("trim_customer_dirty", f"WITH {DIRTY_CUSTOMER} SELECT c_custkey, trim(c_mktsegment) AS c_mktsegment FROM customer_dirty")
def _(t):
    return cleaning.trim_text(t.customer_dirty.select("c_custkey", "c_mktsegment"))


def _priced(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.format_number("l_extendedprice", 2).alias("price"))


@check("parse_numbers_lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem", "price", "l_linenumber")
def _(t):
    return cleaning.parse_numbers(_priced(t), ["price"])


@check("parse_numbers_comma_decimal", "SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem", "price", "l_linenumber")
def _(t):
    swapped = _priced(t).withColumn("price", F.translate("price", ",.", ".,"))
    return cleaning.parse_numbers(swapped, ["price"], thousands=".", decimal=",")


@check("number_parse_report_orders", """SELECT 'o_orderpriority' AS "column", count(*) AS present, count(TRY_CAST(left(o_orderpriority, 1) AS DOUBLE)) AS parsed, 0 AS failed FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), 0, count(*) FROM orders""", "", "present parsed failed")
def _(t):
    return cleaning.number_parse_report(t.orders.select(F.substring("o_orderpriority", 1, 1).alias("o_orderpriority"), "o_orderstatus"), ["o_orderpriority", "o_orderstatus"])


@check("parse_dates_orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders")
def _(t):
    return cleaning.parse_dates(t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date")), ["order_date"])


@check("to_text_nation", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _(t):
    return cleaning.to_text(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])


SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\x0b]"
WORDLESS = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\p{Z}\x{1c}-\x{1f}\x{85}\x0b\x{200c}\x{200d}]"
CLEANED = f"regexp_replace(lower(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')), '{WORDLESS}', ' ', 'g')"


@check("clean_text_documents", f"SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, trim(regexp_replace({CLEANED}, '{SPACE}+', ' ', 'g')) AS x FROM documents)")
def _(t):
    done = cleaning.clean_text(t.documents.select("doc_id", "text"), ["text"])
    return done.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


STOP = ", ".join(f"'{w}'" for w in cleaning.STOPWORDS)


@check("clean_text_stopwords_conversations", f"""SELECT conv_id, turn, length(x) AS n, md5(x) AS digest FROM (SELECT conv_id, turn,
 array_to_string([w FOR w IN regexp_split_to_array({CLEANED}, '{SPACE}+') IF w <> '' AND w NOT IN ({STOP})], ' ') AS x FROM conversations)""")
def _(t):
    done = cleaning.clean_text(t.conversations.select("conv_id", "turn", "text"), ["text"], drop_stopwords=True)
    return done.select("conv_id", "turn", F.length("text").alias("n"), F.md5("text").alias("digest"))


@check("standardize_categories_customer", f"""WITH {DIRTY_CUSTOMER}, s AS (SELECT c_custkey, lower(trim(c_mktsegment)) AS v FROM customer_dirty)
SELECT c_custkey, CASE WHEN v = 'machinery' THEN 'Machines' ELSE upper(v[1]) || v[2:] END AS c_mktsegment FROM s""")
def _(t):
    return cleaning.standardize_categories(t.customer_dirty.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], {"c_mktsegment": {"MACHINERY": "machines"}}, "title")


for _strategy, _number, _word in (
    ("fill_zero", "0", "'Unknown'"), ("fill_mean", "(SELECT avg(o_totalprice) FROM orders_dirty)", "m"),
    ("fill_median", "(SELECT quantile_cont(o_totalprice, 0.5) FROM orders_dirty)", "m"),
    ("fill_mode", "(SELECT o_totalprice FROM orders_dirty WHERE o_totalprice IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "m"),
):
    @check(f"{_strategy}_orders_dirty", f"""WITH {DIRTY_ORDERS}, p AS (SELECT o_orderpriority AS m FROM orders_dirty WHERE o_orderpriority <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_totalprice, {_number}) AS o_totalprice, CASE WHEN o_orderpriority = '' THEN {_word} ELSE o_orderpriority END AS o_orderpriority FROM orders_dirty, p""", "o_totalprice")
    def _(t, strategy=_strategy):
        return cleaning.fill_missing(t.orders_dirty.select("o_orderkey", "o_totalprice", "o_orderpriority"), strategy)


@check("drop_missing_rows_orders_dirty", f"WITH {DIRTY_ORDERS} SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders_dirty WHERE o_totalprice IS NOT NULL AND o_orderpriority <> ''", "o_totalprice")
def _(t):
    return cleaning.drop_missing_rows(t.orders_dirty).select("o_orderkey", "o_totalprice", "o_orderpriority")


@check("drop_duplicates_orders_dirty", f"WITH {DIRTY_ORDERS} SELECT DISTINCT o_orderkey, o_totalprice, o_orderpriority FROM orders_dirty", "o_totalprice")
def _(t):
    return cleaning.drop_duplicates(t.orders_dirty).select("o_orderkey", "o_totalprice", "o_orderpriority")


for _keep, _order in (("first", "ASC"), ("last", "DESC")):
    @check(f"drop_duplicates_keep_{_keep}", f"""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey {_order}) AS i FROM orders) WHERE i = 1""", "o_totalprice")
    def _(t, keep=_keep):
        return cleaning.drop_duplicates(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], keep, "o_orderkey")


@check("drop_duplicates_keep_none", "SELECT any_value(o_orderkey) AS o_orderkey, o_custkey, o_orderstatus FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) = 1")
def _(t):
    return cleaning.drop_duplicates(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"], keep=False)


@check("duplicate_members_orders", "SELECT sum(n) AS duplicate_members, count(*) AS groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) WHERE n > 1", "", "duplicate_members")
def _(t):
    return cleaning.duplicate_members(t.orders, ["o_custkey", "o_orderstatus"])


EVENT_FENCE = "q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)"


@check("clip_outliers_events", f"WITH {EVENT_FENCE} SELECT event_id, least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS value FROM events, q", "value")
def _(t):
    return cleaning.treat_outliers(t.events.select("event_id", "value"), ["value"], "clip")


@check("remove_outliers_events", f"WITH {EVENT_FENCE} SELECT event_id, value FROM events, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)", "value")
def _(t):
    return cleaning.treat_outliers(t.events.select("event_id", "value"), ["value"], "remove")


@check("replace_outliers_iqr_events", f"""WITH {EVENT_FENCE}, m AS (SELECT quantile_cont(value, 0.5) AS m FROM events)
SELECT event_id, CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN m ELSE value END AS value FROM events, q, m""", "value")
def _(t):
    return cleaning.replace_outliers(t.events.select("event_id", "value"), ["value"])


@check("replace_outliers_zscore_events", """WITH m AS (SELECT quantile_cont(value, 0.5) AS m, avg(value) AS a, stddev_pop(value) AS s FROM events)
SELECT event_id, CASE WHEN abs(value - a) / s > 3 THEN m ELSE value END AS value FROM events, m""", "value")
def _(t):
    return cleaning.replace_outliers(t.events.select("event_id", "value"), ["value"], "zscore", 3.0)


@check("count_outliers_zscore_lineitem", """SELECT 'l_extendedprice' AS "column", count(*) FILTER (WHERE abs(l_extendedprice - a) / s > 1.5) AS outliers FROM lineitem, (SELECT avg(l_extendedprice) AS a, stddev_pop(l_extendedprice) AS s FROM lineitem)
UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE abs(l_quantity - a) / s > 1.5) FROM lineitem, (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s FROM lineitem)""")
def _(t):
    return cleaning.count_outliers(t.lineitem, ["l_extendedprice", "l_quantity"], "zscore", 1.5)


@check("rolling_mean_user", """SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value FROM events""", "value")
def _(t):
    return cleaning.smooth(t.events.select("event_id", "user_id", "value"), ["value"], "event_id", 3, partition_by=("user_id",)).select("event_id", "value")


@check("rolling_median_events", "SELECT event_id, quantile_cont(value, 0.5) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS value FROM events", "value")
def _(t):
    return cleaning.smooth(t.events.select("event_id", "value"), ["value"], "event_id", 5, "median")


@check("clean_orders_dirty", f"""WITH {DIRTY_ORDERS}, p AS (SELECT o_orderpriority AS m FROM orders_dirty WHERE o_orderpriority <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
a AS (SELECT avg(o_totalprice) AS a FROM orders_dirty)
SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, coalesce(o_totalprice, a) AS o_totalprice, CASE WHEN o_orderpriority = '' THEN m ELSE o_orderpriority END AS o_orderpriority FROM orders_dirty, p, a""", "o_totalprice")
def _(t):
    return cleaning.clean(t.orders_dirty).drop("o_orderdate")


@check("clean_business_customer_dirty", f"""WITH {DIRTY_CUSTOMER}, s AS (SELECT c_custkey, c_nationkey, c_acctbal, lower(trim(c_mktsegment)) AS v FROM customer_dirty)
SELECT c_custkey, c_nationkey, c_acctbal, upper(v[1]) || v[2:] AS c_mktsegment FROM s""", "c_acctbal", "c_nationkey")
def _(t):
    return cleaning.clean(t.customer_dirty.drop("c_name"), cleaning.PRESETS["business_standard"])


@check("clean_summary_orders_dirty", f"""WITH {DIRTY_ORDERS}, k AS (SELECT DISTINCT {_all} FROM orders_dirty WHERE o_totalprice IS NOT NULL AND o_orderpriority <> '')
SELECT (SELECT count(*) FROM orders_dirty) AS rows_before, (SELECT count(*) FROM k) AS rows_after, (SELECT count(*) FROM orders_dirty) - (SELECT count(*) FROM k) AS removed_rows,
 (SELECT count(*) FILTER (WHERE o_totalprice IS NULL) + count(*) FILTER (WHERE o_orderpriority = '') FROM orders_dirty) AS missing_before, 0 AS missing_after""", "", "removed_rows missing_after")
def _(t):
    before = t.orders_dirty
    return cleaning.clean_summary(before, cleaning.clean(before, cleaning.CleanConfig(missing="drop_rows")))


@check("recommend_preset_orders", """SELECT 'sensor_smoothing' AS preset, 3 AS numeric_columns, 0 AS text_heavy_columns, 1 AS date_named_columns, count(*) AS rows FROM orders""", "", "numeric_columns text_heavy_columns date_named_columns")
def _(t):
    return cleaning.recommend_preset(t.orders)


@check("recommend_preset_pages", """WITH s AS (SELECT CAST(avg(length(url)) >= 30 AS INT) + CAST(avg(length(html)) >= 30 AS INT) AS k, count(*) AS n FROM pages)
SELECT CASE WHEN k >= 2 THEN 'nlp_text' ELSE 'quick_cleanup' END AS preset, 1 AS numeric_columns, k AS text_heavy_columns, 0 AS date_named_columns, n AS rows FROM s""", "", "numeric_columns text_heavy_columns date_named_columns")
def _(t):
    return cleaning.recommend_preset(t.pages)


@check("cleaning_counts_orders_dirty", f"""WITH {DIRTY_ORDERS}, h AS (SELECT count(*) AS n FROM orders_dirty GROUP BY {_all})
SELECT (SELECT count(*) FILTER (WHERE o_totalprice IS NULL) + count(*) FILTER (WHERE o_orderpriority = '') FROM orders_dirty) AS missing_cells, (SELECT sum(n) - count(*) FROM h) AS duplicate_rows, 3 AS numeric_like_columns""",
       "", "duplicate_rows numeric_like_columns")
def _(t):
    return cleaning.cleaning_counts(t.orders_dirty)


@check("column_diff_customer", f"WITH {DIRTY_CUSTOMER} SELECT 'c_mktsegment' AS \"column\", count(*) AS changed FROM customer c JOIN customer_dirty d USING (c_custkey) WHERE c.c_mktsegment <> d.c_mktsegment")
def _(t):
    return cleaning.column_diff(t.customer, t.customer_dirty, "c_custkey")


@check("column_diff_samples_customer", f"""WITH {DIRTY_CUSTOMER} SELECT c_custkey, 'c_mktsegment' AS "column", c.c_mktsegment AS "before", d.c_mktsegment AS "after", row_number() OVER (ORDER BY c_custkey) AS rank
FROM customer c JOIN customer_dirty d USING (c_custkey) WHERE c.c_mktsegment <> d.c_mktsegment ORDER BY c_custkey LIMIT 3""")
def _(t):
    return cleaning.column_diff_samples(t.customer, t.customer_dirty, "c_custkey")


@check("encode_binary_labels", "SELECT doc_id, CAST(toxic > 0 AS BIGINT) AS outcome FROM labels")
def _(t):
    return cleaning.encode_binary(t.labels, "toxic").select("doc_id", "outcome")


@check("encode_binary_two_values", "SELECT l_orderkey, l_linenumber, CAST(l_linestatus = (SELECT max(l_linestatus) FROM lineitem) AS BIGINT) AS outcome FROM lineitem", "", "l_linenumber")
def _(t):
    return cleaning.encode_binary(t.lineitem.select("l_orderkey", "l_linenumber", "l_linestatus"), "l_linestatus").drop("l_linestatus")


# ---- joins --------------------------------------------------------------------------------

@check("merge_inner_orders_customer", "SELECT o_custkey, o_orderkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey", "c_acctbal")
def _(t):
    return merging.merge(t.orders.select("o_custkey", "o_orderkey"), t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), ["o_custkey"])


for _how in ("left", "right", "outer"):
    @check(f"merge_{_how}_labels_documents", f"SELECT doc_id, quality, lang FROM (SELECT doc_id + 50 AS doc_id, quality FROM labels) {'FULL' if _how == 'outer' else _how} JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)", "", "quality")
    def _(t, how=_how):
        return merging.merge(t.labels.select((F.col("doc_id") + 50).alias("doc_id"), "quality"), t.documents.select("doc_id", "lang"), ["doc_id"], how)


@check("merge_null_keys_match", f"""WITH {DIRTY_ORDERS}, p AS (SELECT o_orderstatus, max(o_totalprice) AS o_totalprice FROM marred WHERE o_orderkey % 7 <> 0 GROUP BY 1 UNION ALL SELECT 'none', NULL)
SELECT count(*) AS n, count(m.o_totalprice) AS with_key FROM marred m JOIN p ON m.o_totalprice IS NOT DISTINCT FROM p.o_totalprice""")
def _(t):
    orders = t.orders_dirty.dropDuplicates(["o_orderkey"]).select("o_orderkey", "o_totalprice")
    top = t.orders_dirty.where(F.col("o_orderkey") % 7 != 0).groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("o_totalprice"))
    none = top.limit(1).select(F.lit("none").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return merging.merge(orders, top.unionByName(none), ["o_totalprice"]).agg(F.count("*").alias("n"), F.count("o_totalprice").alias("with_key"))


@check("attach_labels_documents", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)", "", "quality toxic")
def _(t):
    return merging.attach_labels(t.documents.select("doc_id"), t.labels, "doc_id")


@check("map_values_orders", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.0 ELSE 0.0 END AS status_code FROM orders""", "status_code")
def _(t):
    codes = t.orders.groupBy(F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n")).where("value in ('F', 'O')").withColumn(
        "code", F.when(F.col("value") == "F", 1.0).otherwise(2.0))
    return merging.map_values(t.orders.select("o_orderkey", "o_orderstatus"), codes, "o_orderstatus", "status_code").drop("o_orderstatus")


_KINDS = {"o_orderkey": "num", "o_custkey": "num", "o_orderstatus": "text", "o_totalprice": "num", "o_orderdate": "time", "o_orderpriority": "text"}


def _roles_sql():
    parts = []
    for c, k in _KINDS.items():
        present = f"count(CASE WHEN trim({c}) <> '' THEN 1 END)" if k == "text" else f"count({c})"
        distinct = f"count(DISTINCT CASE WHEN trim({c}) <> '' THEN {c} END)" if k == "text" else f"count(DISTINCT {c})"
        number = {"num": "1.0", "time": "0.0", "text": f"1.0 * count(TRY_CAST({c} AS DOUBLE)) / {present}"}[k]
        date = {"num": "0.0", "time": "1.0", "text": f"1.0 * count(TRY_CAST({c} AS TIMESTAMP)) / {present}"}[k]
        parts.append(f"SELECT '{c}' AS \"column\", {number} AS numeric_share, {date} AS date_share, {distinct} AS distinct_values FROM orders_dirty")
    return f"""WITH {DIRTY_ORDERS}, s AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, CASE WHEN numeric_share >= 0.9 THEN 'numeric' WHEN date_share >= 0.75 THEN 'date'
 WHEN distinct_values <= 20 THEN 'categorical' ELSE 'text' END AS role FROM s) SELECT *, role <> 'numeric' OR distinct_values <= 20 AS likely_categorical FROM r"""


@check("infer_roles_orders_dirty", _roles_sql(), "numeric_share date_share")
def _(t):
    return merging.infer_roles(t.orders_dirty)
