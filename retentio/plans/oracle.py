"""DuckDB SQL equal in meaning to each registered query.

The driver's tables are pre-registered as views.  ``RAW`` and ``CLEAN`` are
the adapter view and the cleaning stage written once in SQL; each query's
SQL is ``WITH`` those plus its own tail.  DuckDB differences handled here:
``dayofweek`` is 0 for Sunday, ``date_trunc`` returns a timestamp, ``sum``
of integers is HUGEINT, ``round_even`` is half-to-even, null-safe equality is
``IS NOT DISTINCT FROM``.
"""

from __future__ import annotations

RAW = """
li AS (SELECT l_orderkey, min(l_suppkey) AS shops_id FROM lineitem GROUP BY l_orderkey),
raw AS (
  SELECT o.o_orderkey AS order_id,
         o.o_orderpriority AS source,
         CASE WHEN o.o_orderkey % 997 = 0 THEN ''
              ELSE strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') END AS date_purchased,
         o.o_orderstatus AS shipping_type,
         CASE WHEN o.o_orderkey % 97 = 0 THEN '/' ELSE c.c_mktsegment END AS payment_method,
         CAST(CASE WHEN o.o_orderkey % 25 = 0
                   THEN 1 + CAST(floor(o.o_orderkey / 25) AS BIGINT) % 5 ELSE 0 END AS INTEGER)
           AS promo_value,
         o.o_totalprice AS restaurant_total,
         CASE WHEN o.o_orderkey % 1999 = 0 THEN NULL ELSE o.o_custkey END AS customer,
         CAST(li.shops_id AS BIGINT) AS shops_id,
         CASE WHEN o.o_orderkey % 701 = 0 THEN '' ELSE n.n_name END AS state,
         CASE WHEN o.o_orderkey % 1402 = 0 THEN -1 ELSE CAST(c.c_nationkey AS INTEGER) END
           AS postal_code
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey),
zips AS (SELECT CAST(n_nationkey AS INTEGER) AS zip, n_name AS state_id FROM nation)"""


def _clean_ctes(src: str, name: str, cutoff: str | None, repair: bool = True) -> str:
    trim = f"WHERE order_date < DATE '{cutoff}'" if cutoff else ""
    pay = "NULLIF(payment_method, '/')" if repair else "payment_method"
    return f"""
{name}_s1 AS (
  SELECT * FROM {src}
  WHERE NOT (date_purchased IS NULL OR length(date_purchased) = 0) AND customer IS NOT NULL),
{name}_s2 AS (
  SELECT * FROM {name}_s1 WHERE NOT (state IS NULL OR length(state) = 0)
  UNION ALL
  SELECT s.* REPLACE (z.state_id AS state) FROM {name}_s1 s JOIN zips z ON s.postal_code = z.zip
  WHERE s.state IS NULL OR length(s.state) = 0),
{name}_s3 AS (SELECT *, TRY_CAST(substr(date_purchased, 1, 10) AS DATE) AS order_date FROM {name}_s2),
{name} AS (
  SELECT order_id, source, date_purchased, shipping_type, {pay} AS payment_method,
         promo_value, restaurant_total, customer, shops_id, state, postal_code, order_date,
         CAST(date_trunc('month', order_date) AS DATE) AS order_month,
         CAST(order_date - CAST(dayofweek(order_date) AS INTEGER) AS DATE) AS order_week,
         promo_value <> 0 AS has_promo_value
  FROM {name}_s3 {trim})"""


CUTOFF = "2001-08-01"
CLEAN = _clean_ctes("raw", "clean", CUTOFF)
CLEAN_RAWPAY = _clean_ctes("raw", "clean_rp", CUTOFF, repair=False)


def period(c: str = "cohort_id", m: str = "order_month") -> str:
    return f"CAST((year({m}) - year({c})) * 12 + month({m}) - month({c}) + 1 AS BIGINT)"


COHORT = """
fo_keys AS (SELECT customer, min(date_purchased) AS first_ts, min(order_month) AS cohort_id
            FROM clean GROUP BY customer),
first_rows AS (SELECT c.*, k.cohort_id FROM clean c JOIN fo_keys k
               ON c.customer = k.customer AND c.date_purchased = k.first_ts),
customer_cohort AS (SELECT customer, cohort_id, source, has_promo_value, promo_value FROM first_rows),
customer_activity AS (
  SELECT a.customer, a.order_month, cc.cohort_id, cc.source, cc.has_promo_value, cc.promo_value
  FROM (SELECT DISTINCT customer, order_month FROM clean) a
  LEFT JOIN customer_cohort cc ON a.customer = cc.customer),
cohort_activity AS (
  SELECT order_month, cohort_id, source, promo_value, has_promo_value,
         count(*) AS active_customers, """ + period() + """ AS cohort_period
  FROM customer_activity GROUP BY order_month, cohort_id, source, promo_value, has_promo_value),
cohort_counts AS (
  SELECT cohort_id, source, has_promo_value, promo_value, count(*) AS cohort_count
  FROM customer_cohort GROUP BY cohort_id, source, has_promo_value, promo_value)"""


def with_(*ctes: str, final: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + final


def base(final: str, *extra: str) -> str:
    return with_(RAW, CLEAN, *extra, final=final)


def cohort(final: str, *extra: str) -> str:
    return with_(RAW, CLEAN, COHORT, *extra, final=final)


def sliced(by: list[str]) -> tuple[str, str, str]:
    """CTE text of counts/activity/retention rolled up to ``by``."""
    b = "".join(f", {c}" for c in by)
    on = " AND ".join([f"a.{c} IS NOT DISTINCT FROM s.{c}" for c in ["cohort_id", *by]])
    tag = "_".join(by) or "all"
    counts = (f"\nsize_{tag} AS (SELECT cohort_id{b}, CAST(sum(cohort_count) AS BIGINT) AS cohort_count"
              f" FROM cohort_counts GROUP BY cohort_id{b})")
    act = (f"\nact_{tag} AS (SELECT order_month, cohort_id{b},"
           f" CAST(sum(active_customers) AS BIGINT) AS active_customers, {period()} AS cohort_period"
           f" FROM cohort_activity GROUP BY order_month, cohort_id{b})")
    text = ", CAST(a.cohort_id AS VARCHAR) AS cohort" if by else ""
    ret = (f"\nret_{tag} AS (SELECT a.*, s.cohort_count,"
           f" a.active_customers / CAST(s.cohort_count AS DOUBLE) AS retention_rate{text}"
           f" FROM act_{tag} a LEFT JOIN size_{tag} s ON {on})")
    return counts, act, ret


ORACLE: dict[str, str] = {}

ORACLE["clean_orders"] = base("SELECT * FROM clean")
ORACLE["customer_first_order"] = cohort(
    "SELECT * EXCLUDE (cohort_id) FROM first_rows")
ORACLE["customer_cohort"] = cohort("SELECT * FROM customer_cohort")
ORACLE["customer_activity"] = cohort("SELECT * FROM customer_activity")
ORACLE["cohort_activity"] = cohort("SELECT * FROM cohort_activity")
ORACLE["cohort_counts"] = cohort("SELECT * FROM cohort_counts")

_ALL = sliced([])
ORACLE["cohort_counts_all"] = cohort("SELECT * FROM size_all", *_ALL)
ORACLE["cohort_activity_all"] = cohort("SELECT * FROM act_all", *_ALL)
ORACLE["cohort_retention_all"] = cohort("SELECT * FROM ret_all", *_ALL)


# ------------------------------------------------------- B: cleaning steps --
_MISS_COLS = {  # column -> SQL "missing" test, by the column's type
    "order_id": "order_id IS NULL", "source": "(source IS NULL OR length(source) = 0)",
    "date_purchased": "(date_purchased IS NULL OR length(date_purchased) = 0)",
    "shipping_type": "(shipping_type IS NULL OR length(shipping_type) = 0)",
    "payment_method": "(payment_method IS NULL OR length(payment_method) = 0)",
    "promo_value": "promo_value IS NULL",
    "restaurant_total": "(restaurant_total IS NULL OR isnan(restaurant_total))",
    "customer": "customer IS NULL", "shops_id": "shops_id IS NULL",
    "state": "(state IS NULL OR length(state) = 0)", "postal_code": "postal_code IS NULL",
}
ORACLE["missing_columns"] = with_(RAW, final="SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count_if({t}) AS BIGINT) AS n_missing FROM raw"
    for c, t in _MISS_COLS.items()) + ") WHERE n_missing > 0")
ORACLE["missing_rows_date"] = with_(RAW, final=f"SELECT * FROM raw WHERE {_MISS_COLS['date_purchased']}")
ORACLE["missing_rows_customer"] = with_(RAW, final=(
    f"SELECT * FROM raw WHERE NOT {_MISS_COLS['date_purchased']} AND customer IS NULL"))
ORACLE["missing_rows_state"] = with_(RAW, CLEAN, final=(
    f"SELECT * FROM clean_s1 WHERE {_MISS_COLS['state']}"))
ORACLE["drop_missing"] = with_(RAW, CLEAN, final="SELECT * FROM clean_s1")
ORACLE["impute_state"] = with_(RAW, CLEAN, final=(
    "SELECT s.* REPLACE (z.state_id AS state) FROM clean_s1 s JOIN zips z ON s.postal_code = z.zip"
    f" WHERE {_MISS_COLS['state'].replace('state', 's.state')}"))
ORACLE["append_imputed"] = with_(RAW, CLEAN, final="SELECT * FROM clean_s2")
ORACLE["has_promo"] = base("SELECT order_id, promo_value, has_promo_value FROM clean")
ORACLE["sentinel_rows"] = with_(RAW, CLEAN_RAWPAY, final="SELECT * FROM clean_rp WHERE payment_method = '/'")
ORACLE["sentinel_to_null"] = base("SELECT order_id, payment_method FROM clean")


def _levels_cte(c: str) -> str:
    return (f"\nlv_{c} AS (SELECT {c}, CAST(row_number() OVER (ORDER BY {c}) AS INTEGER) AS {c}_code"
            f" FROM (SELECT DISTINCT {c} FROM clean WHERE {c} IS NOT NULL))")


ORACLE["encode_levels"] = base(
    "SELECT c.order_id, c.source, ls.source_code, c.shipping_type, lt.shipping_type_code,"
    " c.payment_method, lp.payment_method_code FROM clean c"
    " LEFT JOIN lv_source ls ON c.source = ls.source"
    " LEFT JOIN lv_shipping_type lt ON c.shipping_type = lt.shipping_type"
    " LEFT JOIN lv_payment_method lp ON c.payment_method = lp.payment_method",
    _levels_cte("source"), _levels_cte("shipping_type"), _levels_cte("payment_method"))
ORACLE["column_pick"] = base("SELECT customer FROM clean")

# ------------------------------------------------------------ C: dates -------
ORACLE["order_date"] = base("SELECT order_id, date_purchased, order_date FROM clean_s3")
ORACLE["order_month"] = base("SELECT order_id, order_date, order_month FROM clean")
ORACLE["order_week"] = base("SELECT order_id, order_date, order_week FROM clean")
ORACLE["date_range"] = base("SELECT CASE WHEN count(*) = count(order_date) THEN min(order_date) END AS min_date,"
                            " CASE WHEN count(*) = count(order_date) THEN max(order_date) END AS max_date FROM clean_s3")
ORACLE["trim_before"] = base(f"SELECT order_id, order_date FROM clean_s3 WHERE order_date < DATE '{CUTOFF}'")
ORACLE["cohort_period"] = cohort(
    f"SELECT customer, order_month, cohort_id, {period()} AS cohort_period FROM customer_activity")
ORACLE["previous_month"] = cohort(
    "SELECT cohort_id, CAST(cohort_id - INTERVAL 1 MONTH AS DATE) AS previous_month"
    " FROM (SELECT DISTINCT cohort_id FROM fo_keys)")

# -------------------------------------------------------------- D: EDA -------
N_ORDERS = ("(SELECT CAST(count(DISTINCT order_id) + max(CASE WHEN order_id IS NULL THEN 1 ELSE 0 END)"
            " AS BIGINT) FROM clean)")
N_CUSTOMERS = "(SELECT count(DISTINCT customer) FROM clean)"
ORACLE["n_orders"] = base(f"SELECT {N_ORDERS} AS n_orders")
ORACLE["n_customers"] = base(f"SELECT {N_CUSTOMERS} AS n_customers")
ORACLE["avg_orders_per_customer"] = base(
    f"SELECT {N_ORDERS} AS n_orders, {N_CUSTOMERS} AS n_customers,"
    f" {N_ORDERS} / CAST({N_CUSTOMERS} AS DOUBLE) AS avg_orders_per_customer")
OPC = "\nopc AS (SELECT customer, count(*) AS num_orders FROM clean GROUP BY customer)"
ORACLE["orders_per_customer"] = base("SELECT * FROM opc", OPC)
BUCKETS = (OPC + ",\nbuckets AS (SELECT num_orders, count(*) AS customer_count,"
           f" count(*) / CAST({N_CUSTOMERS} AS DOUBLE) AS pct_customers FROM opc GROUP BY num_orders)")
ORACLE["order_buckets"] = base("SELECT * FROM buckets", BUCKETS)
ORACLE["order_buckets_cumulative"] = base(
    "SELECT *, customers_at_most / CAST(" + N_CUSTOMERS + " AS DOUBLE) AS pct_at_most,"
    " (CAST(" + N_CUSTOMERS + " AS DOUBLE) - customers_at_most) / CAST(" + N_CUSTOMERS
    + " AS DOUBLE) AS pct_more FROM (SELECT *, CAST(sum(customer_count) OVER (ORDER BY num_orders"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS customers_at_most FROM buckets)",
    BUCKETS)


def _count_by(c: str, alias: str = "orders") -> str:
    return base(f"SELECT {c}, count(*) AS {alias} FROM clean GROUP BY {c}")


def _share_by(c: str) -> str:
    return base(f"SELECT {c}, count(*) AS orders, count(*) / CAST({N_ORDERS} AS DOUBLE) AS pct"
                f" FROM clean GROUP BY {c}")


ORACLE["orders_by_date"] = _count_by("order_date")
ORACLE["orders_by_week"] = _count_by("order_week")
ORACLE["promo_levels"] = base("SELECT DISTINCT promo_value FROM clean WHERE promo_value IS NOT NULL")
ORACLE["promo_share"] = _share_by("promo_value")
REVENUE = ("\nrevenue AS (SELECT shops_id, CAST(round_even(CASE WHEN count(restaurant_total) = count(*)"
           " THEN sum(CAST(restaurant_total AS DECIMAL(38,12))) END, 0) AS DOUBLE) AS rest_revenue"
           " FROM clean GROUP BY shops_id)")
ORACLE["revenue_by_shop"] = base("SELECT * FROM revenue", REVENUE)
ORACLE["shipping_levels"] = base("SELECT DISTINCT shipping_type FROM clean")
ORACLE["payment_levels_raw"] = with_(RAW, CLEAN_RAWPAY, final="SELECT DISTINCT payment_method FROM clean_rp")
ORACLE["payment_levels"] = base("SELECT DISTINCT payment_method FROM clean")
ORACLE["source_levels"] = base("SELECT DISTINCT source FROM clean")
ORACLE["orders_by_shipping"] = _count_by("shipping_type")
ORACLE["orders_by_payment"] = _count_by("payment_method")
ORACLE["orders_by_source"] = _count_by("source")
ORACLE["orders_by_state"] = _share_by("state")
ORACLE["kpi_summary"] = base(
    f"SELECT {N_ORDERS} AS transactions, min(order_month) AS first_month, max(order_month) AS last_month,"
    f" {N_CUSTOMERS} AS customers, round({N_ORDERS} / CAST({N_CUSTOMERS} AS DOUBLE), 4) AS orders_per_customer,"
    " CAST(round_even(sum(CAST(restaurant_total AS DECIMAL(38,12))) / count(restaurant_total), 2) AS DOUBLE) AS avg_order_value"
    " FROM clean")

# ------------------------------------------------- F: sliced retention -------
for _tag, _by in [("has_promo", ["has_promo_value"]), ("promo_value", ["promo_value"])]:
    _c, _a, _r = sliced(_by)
    _t = "_".join(_by)
    ORACLE[f"cohort_counts_{_tag}"] = cohort(f"SELECT * FROM size_{_t}", _c)
    ORACLE[f"cohort_activity_{_tag}"] = cohort(f"SELECT * FROM act_{_t}", _a)
    ORACLE[f"cohort_retention_{_tag}"] = cohort(f"SELECT * FROM ret_{_t}", _c, _a, _r)

# The test orders span 1995-01 .. 2001-07; a period beyond these months ends the query.
TEST_MONTHS = 79
ORACLE["retention_matrix"] = cohort(
    "SELECT cohort_id, " + ", ".join(
        f"max(CASE WHEN cohort_period = {p} THEN retention_rate END) AS p{p}" for p in range(1, TEST_MONTHS + 1))
    + f" FROM (SELECT *, CASE WHEN cohort_period NOT BETWEEN 1 AND {TEST_MONTHS} THEN error('period out of range') END AS x"
    " FROM ret_all) WHERE x IS NULL GROUP BY cohort_id", *_ALL)
_PV = sliced(["promo_value"])
ORACLE["retention_labels"] = cohort(
    "SELECT cohort_id, promo_value, cohort_period, retention_rate,"
    " coalesce(printf('%.0f%%', retention_rate * 100), '0') AS label FROM ret_promo_value", *_PV)


def _activity_by(facet: str) -> str:
    return (f"SELECT cohort_id, order_month, {facet}, CAST(sum(active_customers) AS BIGINT)"
            f" AS active_customers FROM cohort_activity GROUP BY cohort_id, order_month, {facet}")


ORACLE["activity_by_source"] = cohort(_activity_by("source"))
ORACLE["activity_by_has_promo"] = cohort(_activity_by("has_promo_value"))
ORACLE["activity_by_promo_value"] = cohort(_activity_by("promo_value"))
ORACLE["stacked_bands"] = cohort(
    "SELECT *, band_upper - active_customers AS band_lower FROM (SELECT *, CAST(sum(active_customers)"
    " OVER (PARTITION BY source, order_month ORDER BY cohort_id ROWS BETWEEN UNBOUNDED PRECEDING"
    " AND CURRENT ROW) AS BIGINT) AS band_upper FROM (" + _activity_by("source") + "))")
SEEDED = ("\nseeded AS (SELECT * FROM cohort_activity UNION ALL BY NAME"
          " SELECT CAST(cohort_id - INTERVAL 1 MONTH AS DATE) AS order_month, cohort_id,"
          " CAST(0 AS BIGINT) AS active_customers, CAST(0 AS BIGINT) AS cohort_period"
          " FROM (SELECT DISTINCT cohort_id FROM cohort_activity))")
ORACLE["seed_rows"] = cohort("SELECT * FROM seeded", SEEDED)
ORACLE["area_series"] = cohort(
    "SELECT cohort_id, order_month, CAST(sum(active_customers) AS BIGINT) AS active_customers"
    " FROM seeded GROUP BY cohort_id, order_month", SEEDED)
ORACLE["churn"] = cohort("SELECT *, 1 - retention_rate AS churn_rate FROM ret_all", *_ALL)


# ------------------------------------------------ I: more slices -------------
def retention_by_sql(attr_expr: str, attr: str, src_ctes: str, src: str = "clean") -> str:
    """Retention sliced by one first-order attribute, from a cleaned table ``src``."""
    return with_(RAW, src_ctes, f"""
rb_src AS (SELECT *, {attr_expr} AS {attr} FROM {src}),
rb_keys AS (SELECT customer, min(date_purchased) AS first_ts, min(order_month) AS cohort_id
            FROM rb_src GROUP BY customer),
rb_cohort AS (SELECT c.customer, k.cohort_id, c.{attr} FROM rb_src c JOIN rb_keys k
              ON c.customer = k.customer AND c.date_purchased = k.first_ts),
rb_act AS (SELECT a.order_month, cc.cohort_id, cc.{attr}, count(*) AS n
           FROM (SELECT DISTINCT customer, order_month FROM rb_src) a
           JOIN rb_cohort cc ON a.customer = cc.customer GROUP BY a.order_month, cc.cohort_id, cc.{attr}),
rb_size AS (SELECT cohort_id, {attr}, count(*) AS cohort_count FROM rb_cohort GROUP BY cohort_id, {attr})""",
                 final=f"""SELECT a.order_month, a.cohort_id, a.{attr}, CAST(a.n AS BIGINT) AS active_customers,
  {period('a.cohort_id', 'a.order_month')} AS cohort_period, s.cohort_count,
  a.n / CAST(s.cohort_count AS DOUBLE) AS retention_rate
FROM rb_act a LEFT JOIN rb_size s ON a.cohort_id IS NOT DISTINCT FROM s.cohort_id
  AND a.{attr} IS NOT DISTINCT FROM s.{attr}""")


ORACLE["retention_by_state"] = retention_by_sql("state", "state", CLEAN)
ORACLE["retention_by_shop"] = retention_by_sql("shops_id", "shops_id", CLEAN)
ORACLE["retention_by_source"] = retention_by_sql("source", "source", CLEAN)
EVENTS_RAW = """
ev_raw AS (
  SELECT event_id AS order_id, event_type AS source,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS date_purchased,
         'Delivery' AS shipping_type, 'credit' AS payment_method, CAST(0 AS INTEGER) AS promo_value,
         value AS restaurant_total, user_id AS customer, CAST(NULL AS BIGINT) AS shops_id,
         'NA_STATE' AS state, CAST(0 AS INTEGER) AS postal_code
  FROM events)"""
ORACLE["retention_by_hour"] = retention_by_sql(
    "TRY_CAST(substr(date_purchased, 12, 2) AS INTEGER)", "hour",
    EVENTS_RAW + "," + _clean_ctes("ev_raw", "ev_clean", None), src="ev_clean")
ORACLE["acquisition_growth"] = cohort(
    "SELECT cohort_id, cohort_count, prev_count,"
    " (cohort_count - prev_count) / CAST(prev_count AS DOUBLE) AS growth_rate,"
    " CAST(sum(cohort_count) OVER (ORDER BY cohort_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    " AS BIGINT) AS customers_to_date FROM (SELECT *, lag(cohort_count) OVER (ORDER BY cohort_id)"
    " AS prev_count FROM size_all)", *_ALL)


# ------------------------------------------------ G: chart statistics --------
def histogram_sql(src: str, col: str, bins: int = 30) -> str:
    return f"""SELECT bin, lo + bin * (hi - lo) / {bins} AS bin_lower, lo + (bin + 1) * (hi - lo) / {bins} AS bin_upper,
  n FROM (SELECT bin, lo, hi, count(*) AS n FROM (
    SELECT CAST(CASE WHEN hi - lo = 0 THEN 0
                     ELSE least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) END AS INTEGER) AS bin, lo, hi
    FROM (SELECT CAST({col} AS DOUBLE) AS x FROM {src}) v,
         (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM {src}
          WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))) r
    WHERE x IS NOT NULL AND NOT isnan(x)) GROUP BY bin, lo, hi)"""


ORACLE["hist_orders_per_customer"] = base(histogram_sql("opc", "num_orders"), OPC)
ORACLE["hist_log_orders_per_customer"] = base(
    histogram_sql("lopc", "log_num_orders"), OPC + ",\nlopc AS (SELECT ln(num_orders) AS log_num_orders FROM opc)")
ORACLE["hist_shop_revenue"] = base(histogram_sql("revenue", "rest_revenue"), REVENUE)
# p: the incomplete beta integral of Student's t, P_N midpoints after y = x exp(-2 v^2 / d)
P_N = 20000
_GAMMA_RATIO = ("sqrt(g) * (1 - 1 / (8 * g) + 1 / (128 * g ** 2) + 5 / (1024 * g ** 3) - 21 / (32768 * g ** 4))"
                + "".join(f" * (d / 2 + {k}) / (d / 2 + {k}.5)" for k in range(8)))
ORACLE["linear_fit"] = base(f"""
SELECT term, estimate, std_error, t_value,
  least(1.0, ({_GAMMA_RATIO}) / sqrt(pi()) * exp(d / 2 * ln(z)) * (2 / d) * (6.5 / {P_N}) *
    list_sum(list_transform(range({P_N}), lambda k: exp(-power((k + 0.5) * 6.5 / {P_N}, 2))
      / sqrt(1 - z * exp(-2 * power((k + 0.5) * 6.5 / {P_N}, 2) / d)) * 2 * ((k + 0.5) * 6.5 / {P_N})))) AS p_value
FROM (SELECT *, d / (d + t_value * t_value) AS z, d / 2 + 8 AS g FROM (
  SELECT '(Intercept)' AS term, b0 AS estimate, se0 AS std_error, b0 / se0 AS t_value, d FROM fit
  UNION ALL SELECT 'day', b1, se1, b1 / se1, d FROM fit))""", """
daily AS (SELECT CAST(order_date - DATE '1970-01-01' AS DOUBLE) AS day, CAST(count(*) AS DOUBLE) AS orders
          FROM clean GROUP BY order_date),
mom AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(day) AS mx, regr_slope(orders, day) AS b1, regr_intercept(orders, day) AS b0,
               regr_sxx(orders, day) AS xx, regr_syy(orders, day) AS yy, regr_sxy(orders, day) AS xy FROM daily),
m2 AS (SELECT *, (yy - b1 * xy) / (n - 2) AS s2 FROM mom),
fit AS (SELECT b0, b1, n - 2 AS d, sqrt(s2 * (1 / n + mx * mx / xx)) AS se0, sqrt(s2 / xx) AS se1 FROM m2)""")
ORACLE["linear_fit_pvalues"] = ORACLE["linear_fit"]
ORACLE["grep_values"] = base("SELECT state FROM clean WHERE regexp_matches(state, '_1[0-9]$')")

# ------------------------------------------------ H: table operators ---------
ORACLE["filter_range"] = base(
    "SELECT * FROM clean WHERE (restaurant_total IS NOT NULL AND NOT isnan(restaurant_total)"
    " AND restaurant_total >= 100000.0 AND restaurant_total <= 200000.0)"
    " OR coalesce((SELECT 100000.0 <= min(restaurant_total) AND 200000.0 >= max(restaurant_total)"
    " FROM clean WHERE restaurant_total IS NOT NULL AND NOT isnan(restaurant_total)), false)")
ORACLE["filter_set"] = base("SELECT * FROM clean WHERE source IN ('1-URGENT', '2-HIGH')")
ORACLE["filter_logical"] = base(
    "SELECT * FROM clean WHERE coalesce(lower(CAST(has_promo_value AS VARCHAR)), 'na') IN ('true', 'na')")
ORACLE["search_text"] = base(
    "SELECT * FROM clean WHERE contains(lower(payment_method), 'auto') AND contains(lower(payment_method), 'mobile')")
ORACLE["search_regex"] = base("SELECT * FROM clean WHERE regexp_matches(source, '(?i)^[12]-')")
ORACLE["page"] = base("SELECT * FROM clean ORDER BY order_id NULLS LAST LIMIT 8 OFFSET 16")
ORACLE["head_n"] = base("SELECT * FROM clean ORDER BY order_id NULLS LAST LIMIT 6")
GROUP_KEYS = ("SELECT DISTINCT customer FROM clean WHERE state IN ('NATION_1', 'NATION_2', 'NATION_3')")
ORACLE["keys_by_group"] = base(GROUP_KEYS)
ORACLE["linked_filter"] = base(
    "SELECT * FROM clean WHERE customer IN (SELECT customer FROM clean WHERE has_promo_value)"
    f" AND customer IN ({GROUP_KEYS})")
ORACLE["columns_to_rows"] = cohort("SELECT cohort_id, cohort_period, retention_rate FROM ret_all", *_ALL)
ORACLE["keyset_diff"] = base(
    f"SELECT customer, 'added' AS change FROM ({GROUP_KEYS}) WHERE customer NOT IN"
    " (SELECT customer FROM clean WHERE has_promo_value)"
    " UNION ALL SELECT DISTINCT customer, 'removed' FROM clean WHERE has_promo_value"
    f" AND customer NOT IN ({GROUP_KEYS})")


# ------------------------------------------------ A: sources, sinks, preview --
ORACLE["read_orders"] = with_(RAW, final="SELECT * FROM raw")
ORACLE["read_zip_lookup"] = with_(RAW, final="SELECT * FROM zips")
ORACLE["write_corrected"] = base("SELECT * FROM clean")
ORACLE["read_corrected"] = ORACLE["cohort_retention_all"]
ORACLE["read_corrected_bucketed"] = ORACLE["cohort_retention_all"]
_PROFILE = [("order_id", "bigint"), ("source", "string"), ("date_purchased", "string"),
            ("shipping_type", "string"), ("payment_method", "string"), ("promo_value", "int"),
            ("restaurant_total", "double"), ("customer", "bigint"), ("shops_id", "bigint"),
            ("state", "string"), ("postal_code", "int"), ("order_date", "date"),
            ("order_month", "date"), ("order_week", "date"), ("has_promo_value", "boolean")]
ORACLE["schema_profile"] = base(
    "SELECT CAST(position AS INTEGER) AS position, column_name, data_type,"
    " (SELECT count(*) FROM clean) AS n_rows, sample FROM ("
    + " UNION ALL ".join(
        f"SELECT {i + 1} AS position, '{c}' AS column_name, '{t}' AS data_type, (SELECT string_agg(coalesce(CAST({c} AS VARCHAR), 'NA'), ' '"
        f" ORDER BY order_id) FROM (SELECT * FROM clean ORDER BY order_id LIMIT 3)) AS sample" for i, (c, t) in enumerate(_PROFILE))
    + ")")
_NUM = ["order_id", "promo_value", "restaurant_total", "customer", "shops_id", "postal_code"]
_TXT = ["source", "date_purchased", "shipping_type", "payment_method", "state"]
ORACLE["numeric_summary"] = with_(RAW, final=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'numeric' AS kind, count(*) AS length, min(CAST({c} AS DOUBLE)) AS min,"
    f" quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,"
    f" avg(CAST({c} AS DOUBLE)) AS mean,"
    f" quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, max(CAST({c} AS DOUBLE)) AS max,"
    f" CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM raw" for c in _NUM) + "".join(
    f" UNION ALL SELECT '{c}', 'character', count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM raw"
    for c in _TXT))


# ------------------------------------------------ options of E2 / F3 / C3 -----
FIRST_TIES = """
ft_keys AS (SELECT customer, min(order_month) AS cohort_id FROM clean GROUP BY customer),
ft_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer
                                ORDER BY date_purchased, order_id) AS rn FROM clean) WHERE rn = 1),
ft_cohort AS (SELECT r.customer, k.cohort_id, r.source, r.has_promo_value, r.promo_value
              FROM ft_rows r JOIN ft_keys k ON r.customer = k.customer)"""
ORACLE["customer_cohort_first"] = base("SELECT * FROM ft_cohort", FIRST_TIES)
ORACLE["cohort_retention_all_first"] = base(f"""
SELECT a.*, s.cohort_count, a.active_customers / CAST(s.cohort_count AS DOUBLE) AS retention_rate
FROM (SELECT m.order_month, c.cohort_id, CAST(count(*) AS BIGINT) AS active_customers,
             {period('c.cohort_id', 'm.order_month')} AS cohort_period
      FROM (SELECT DISTINCT customer, order_month FROM clean) m JOIN ft_cohort c ON m.customer = c.customer
      GROUP BY m.order_month, c.cohort_id) a
LEFT JOIN (SELECT cohort_id, count(*) AS cohort_count FROM ft_cohort GROUP BY cohort_id) s
  ON a.cohort_id IS NOT DISTINCT FROM s.cohort_id""", FIRST_TIES)
ORACLE["orders_by_week_monday"] = base(
    "SELECT CAST(date_trunc('week', order_date) AS DATE) AS order_week, count(*) AS orders"
    " FROM clean GROUP BY 1")


# ------------------------------------------------ default bins, segments ------
def ggplot_sql(src: str, col: str, bins: int = 30) -> str:
    return f"""SELECT bin, lo - w / 2 + bin * w AS bin_lower, lo - w / 2 + (bin + 1) * w AS bin_upper, count(*) AS n FROM (
  SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE greatest(0, least({bins - 1}, ceil((x - (lo - w / 2)) / w) - 1)) END AS INTEGER) AS bin, lo, w
  FROM (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL) v,
       (SELECT min(CAST({col} AS DOUBLE)) AS lo, (max(CAST({col} AS DOUBLE)) - min(CAST({col} AS DOUBLE))) / {bins - 1} AS w FROM {src}) r
  ) GROUP BY bin, lo, w"""


ORACLE["hist_orders_per_customer_ggplot"] = base(ggplot_sql("opc", "num_orders"), OPC)
ORACLE["hist_shop_revenue_ggplot"] = base(ggplot_sql("revenue", "rest_revenue"), REVENUE)
ORACLE["audience_segments"] = base(f"""
SELECT customer, cohort_id, last_month, active_months, {period('cohort_id', 'last_month')} AS last_period,
       CASE WHEN last_month = (SELECT max(order_month) FROM clean) THEN 'active' ELSE 'lapsed' END AS segment
FROM (SELECT customer, min(order_month) AS cohort_id, max(order_month) AS last_month, count(DISTINCT order_month) AS active_months
      FROM clean WHERE order_month IS NOT NULL GROUP BY customer)""")
ORACLE["page_after"] = ORACLE["page"]


# ------------------------------------------------ G4 / G5: loess trends --------
def trend_sql(key: str) -> str:
    """Local quadratic fits at the vertices by Cramer's rule, cubic Hermite between."""
    det = lambda a: (f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]})"  # noqa: E731
                     f" + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))")
    m = [["s0", "s1", "s2"], ["s1", "s2", "s3"], ["s2", "s3", "s4"]]
    swapped = lambda j: [[f"t{i}" if k == j else m[i][k] for k in range(3)] for i in range(3)]
    moments = ", ".join([f"sum(w * power(u, {i})) AS s{i}" for i in range(5)] + [f"sum(w * power(u, {i}) * y) AS t{i}" for i in range(3)])
    sql = base(f"""
SELECT {key}, orders, round((2 * z * z * z - 3 * z * z + 1) * f + (z * z * z - 2 * z * z + z) * (v2 - v) * g
  + (3 * z * z - 2 * z * z * z) * f2 + (z * z * z - z * z) * (v2 - v) * g2, 4) AS trend
FROM (SELECT s.*, c.*, (s.x - c.v) / (c.v2 - c.v) AS z FROM s JOIN cell c ON s.x >= c.v AND s.x < c.v2)""", f"""
s AS (SELECT {key}, count(*) AS orders, CAST({key} - DATE '1970-01-01' AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y,
             row_number() OVER (ORDER BY {key}) - 1 AS r FROM clean GROUP BY {key}),
size AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, greatest(1, CAST(floor(count(*) * 0.75 * 0.2) AS BIGINT)) AS fc,
                least(count(*), greatest(3, CAST(floor(count(*) * 0.75) AS BIGINT))) AS q FROM s),
split(a, b) AS (SELECT 0, n - 1 FROM size UNION ALL
  SELECT CASE WHEN k = 0 THEN a ELSE (a + b) // 2 + 1 END, CASE WHEN k = 0 THEN (a + b) // 2 ELSE b END
  FROM split, size, (VALUES (0), (1)) t(k) WHERE b - a + 1 > fc),
vert AS (SELECT DISTINCT v FROM (
  SELECT (p.x + o.x) / 2 AS v FROM split, size, s p, s o WHERE b - a + 1 > fc AND p.r = (a + b) // 2 AND o.r = (a + b) // 2 + 1
  UNION ALL SELECT lo - 0.005 * (hi - lo) FROM size UNION ALL SELECT hi + 0.005 * (hi - lo) FROM size)),
dist AS (SELECT v, x, y, abs(x - v) AS d, row_number() OVER (PARTITION BY v ORDER BY abs(x - v)) AS k FROM vert, s),
band AS (SELECT v, d AS h FROM dist, size WHERE k = q),
mom AS (SELECT v, h, {moments} FROM (
  SELECT d.v, h, (x - d.v) / h AS u, power(1 - power(abs((x - d.v) / h), 3), 3) AS w, y FROM dist d JOIN band b ON d.v = b.v WHERE d.d < h)
  GROUP BY v, h),
fitted AS (SELECT v, {det(swapped(0))} / {det(m)} AS f, {det(swapped(1))} / {det(m)} / h AS g FROM mom),
cell AS (SELECT * FROM (SELECT v, f, g, lead(v) OVER o AS v2, lead(f) OVER o AS f2, lead(g) OVER o AS g2 FROM fitted
                        WINDOW o AS (ORDER BY v)) WHERE v2 IS NOT NULL)""")
    return sql.replace("WITH", "WITH RECURSIVE", 1)


ORACLE["trend_orders_by_date"] = trend_sql("order_date")
ORACLE["trend_orders_by_week"] = trend_sql("order_week")


# ------------------------------------------------ F18 / I4: survival ---------
def tail_sql(x: str, df: str) -> str:
    """Chi-squared tail by the series of the lower incomplete gamma function."""
    return (f"greatest(0.0::DOUBLE, 1 - list_sum(list_transform(range(0, 3000), lambda n: "
            f"exp(-({x}) / 2 + (n + ({df}) / 2.0) * ln(({x}) / 2) - lgamma(n + ({df}) / 2.0 + 1)))))")


def months_between(a: str, b: str) -> str:
    return f"((year({b}) - year({a})) * 12 + month({b}) - month({a}))"


LAPSE, HORIZON = 6, 24
SPELLS = f"""
cm AS (SELECT DISTINCT customer, order_month FROM clean),
opened AS (SELECT *, CASE WHEN lag(order_month) OVER o IS NULL OR {months_between("lag(order_month) OVER o", "order_month")} > {LAPSE} THEN 1 ELSE 0 END AS opens
           FROM cm WINDOW o AS (PARTITION BY customer ORDER BY order_month)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY customer ORDER BY order_month) AS spell FROM opened),
spell AS (SELECT customer, CAST(spell AS BIGINT) AS spell, min(order_month) AS first_month, max(order_month) AS last_month FROM numbered GROUP BY customer, spell),
spells AS (SELECT *, CAST({months_between("first_month", "last_month")} + 1 AS BIGINT) AS duration,
                  max(spell) OVER (PARTITION BY customer) > spell
                  OR {months_between("last_month", "(SELECT max(order_month) FROM clean)")} >= {LAPSE} AS ended FROM spell),
firsts AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY customer ORDER BY date_purchased, order_id) = 1)"""


def life_sql(by: str | None) -> str:
    """CTE of the life table: at risk and the product counted anew for each period."""
    key = by or "0"
    return f"""
life0 AS (SELECT {key} AS k, duration, ended FROM spells JOIN firsts USING (customer) WHERE spell = 1),
grid AS (SELECT k, unnest(range(1, max(duration) + 1)) AS period FROM life0 GROUP BY k),
risk AS (SELECT g.k, g.period, count(*) AS at_risk, count(*) FILTER (WHERE l.duration = g.period AND ended) AS events,
                count(*) FILTER (WHERE l.duration = g.period AND NOT ended) AS censored
         FROM grid g JOIN life0 l ON l.k IS NOT DISTINCT FROM g.k AND l.duration >= g.period GROUP BY g.k, g.period),
life AS (SELECT *, product(1 - events / CAST(at_risk AS DOUBLE)) OVER o AS survival,
                CASE WHEN min(at_risk - events) OVER o > 0
                     THEN sqrt(sum(CASE WHEN at_risk > events THEN events / (CAST(at_risk AS DOUBLE) * (at_risk - events)) END) OVER o) END AS spread
         FROM risk WINDOW o AS (PARTITION BY k ORDER BY period))"""


def _life(by: str | None, final: str) -> str:
    return base(final, SPELLS, life_sql(by))


def _summary_sql(by: str) -> str:
    return _life(by, f"""
SELECT k AS {by}, max(at_risk) AS customers, CAST(sum(events) AS BIGINT) AS events, CAST(min(period) FILTER (WHERE survival <= 0.5) AS BIGINT) AS median_lifetime,
       round(1 + coalesce(sum(survival) FILTER (WHERE period < {HORIZON}), 0) + max_by(survival, period) * greatest(0, {HORIZON - 1} - max(period)), 9) AS mean_lifetime
FROM life GROUP BY k""")


_LIFE_COLS = "CAST(period AS BIGINT) AS period, at_risk, events, censored, round(survival, 9) AS survival, round(survival * spread, 9) AS std_err"
ORACLE["customer_spells"] = base("SELECT customer, spell, first_month, last_month, duration, ended FROM spells", SPELLS)
ORACLE["survival_all"] = _life(None, f"SELECT {_LIFE_COLS} FROM life")
ORACLE["survival_by_source"] = _life("source", f"SELECT k AS source, {_LIFE_COLS} FROM life")
ORACLE["lifetime_by_source"] = _summary_sql("source")
ORACLE["lifetime_by_shop"] = _summary_sql("shops_id")
ORACLE["logrank_by_source"] = _life("source", f"""
SELECT k AS source, customers, observed, round(expected, 9) AS expected, round(variance, 9) AS variance,
       round((observed - expected) * (observed - expected) / variance, 9) AS chi_squared,
       round({tail_sql("(observed - expected) * (observed - expected) / variance", "1")}, 9) AS p_value
FROM (SELECT k, max(at_risk) AS customers, CAST(sum(events) AS BIGINT) AS observed, sum(d * (at_risk / n)) AS expected,
             sum(CASE WHEN n > 1 THEN d * (at_risk / n) * (1 - at_risk / n) * (n - d) / (n - 1) ELSE 0 END) AS variance
      FROM (SELECT *, CAST(sum(events) OVER (PARTITION BY period) AS DOUBLE) AS d, CAST(sum(at_risk) OVER (PARTITION BY period) AS DOUBLE) AS n FROM life)
      GROUP BY k)""")


# ------------------------------------------------ 2.10: all slices at once ---
_SLICE_ATTRS = ["has_promo_value", "promo_value", "source"]


def _slices_sql(what: str, cols: str) -> str:
    """The single slices' tables, one below the other."""
    parts = []
    for by in ([], ["has_promo_value"], ["promo_value"], ["source"]):
        levels = ", ".join(c if c in by else f"CAST(NULL AS {t}) AS {c}" for c, t in zip(_SLICE_ATTRS, ("BOOLEAN", "INTEGER", "VARCHAR")))
        parts.append(f"SELECT '{'+'.join(by) or 'all'}' AS slice, {levels}, {cols} FROM {what}_{'_'.join(by) or 'all'}")
    ctes = [c for by in ([], ["has_promo_value"], ["promo_value"], ["source"]) for c in sliced(by)]
    return cohort(" UNION ALL ".join(parts), *ctes)


ORACLE["cohort_counts_slices"] = _slices_sql("size", "cohort_id, cohort_count")
ORACLE["cohort_activity_slices"] = _slices_sql("act", "order_month, cohort_id, active_customers, cohort_period")
ORACLE["cohort_retention_slices"] = _slices_sql("ret", "order_month, cohort_id, active_customers, cohort_period, cohort_count, retention_rate")


# ------------------------------------------------ I1 / I2: ranked slices -----
def _ranked_sql(by: list[str], k: int, within: str | None, period_: int = 13) -> str:
    b, z = ", ".join(by), 1.959963984540054
    order = f"round(lower, 12) DESC, round(upper, 12) DESC, {', '.join(c + ' NULLS LAST' for c in by)}"
    return with_(RAW, CLEAN, f"""
fo AS (SELECT customer, min(date_purchased) AS ts, min(order_month) AS cohort_id FROM clean GROUP BY customer),
w AS (SELECT {", ".join("c." + x for x in by)}, fo.customer, fo.cohort_id FROM clean c JOIN fo ON c.customer = fo.customer AND c.date_purchased = fo.ts),
size AS (SELECT {b}, count(*) AS customers FROM w WHERE cohort_id + INTERVAL {period_ - 1} MONTH <= (SELECT max(order_month) FROM clean) GROUP BY {b}),
hits AS (SELECT {b}, count(*) AS retained FROM w JOIN (SELECT DISTINCT customer, order_month FROM clean) m USING (customer)
         WHERE order_month = cohort_id + INTERVAL {period_ - 1} MONTH GROUP BY {b}),
per AS (SELECT w.*, coalesce(customers, 0) AS customers, coalesce(retained, 0) AS retained
        FROM (SELECT {b} FROM size UNION SELECT {b} FROM hits) w
        LEFT JOIN size s ON {" AND ".join(f"w.{x} IS NOT DISTINCT FROM s.{x}" for x in by)}
        LEFT JOIN hits h ON {" AND ".join(f"w.{x} IS NOT DISTINCT FROM h.{x}" for x in by)}),
rates AS (SELECT *, retained / CAST(customers AS DOUBLE) AS rate FROM per),
bounds AS (SELECT *, greatest(0, (rate + {z} * {z} / (2 * customers) - {z} * sqrt(rate * (1 - rate) / customers + {z} * {z} / (4.0 * customers * customers))) / (1 + {z} * {z} / customers)) AS lower,
                  least(1, (rate + {z} * {z} / (2 * customers) + {z} * sqrt(rate * (1 - rate) / customers + {z} * {z} / (4.0 * customers * customers))) / (1 + {z} * {z} / customers)) AS upper
           FROM rates)""",
                 final=f"""
SELECT {b}, CAST(customers AS BIGINT) AS customers, CAST(retained AS BIGINT) AS retained, round(rate, 9) AS rate, round(lower, 9) AS lower, round(upper, 9) AS upper,
       CAST(row_number() OVER ({f"PARTITION BY {within} " if within else ""}ORDER BY {order}) AS INTEGER) AS rank FROM bounds
QUALIFY row_number() OVER ({f"PARTITION BY {within} " if within else ""}ORDER BY {order}) <= {k}""")


ORACLE["ranked_shops"] = _ranked_sql(["shops_id"], 10, None)
ORACLE["ranked_shops_by_state"] = _ranked_sql(["state", "shops_id"], 3, "state")


# ------------------------------------------------ I3: association ------------
_ASSOCIATED = ["source", "promo_value", "shipping_type", "payment_method", "state", "shops_id", "hour"]
ORACLE["association_with_return"] = base(f"""
SELECT attribute, CAST(levels AS BIGINT) AS levels, CAST(n AS BIGINT) AS n, CASE WHEN ok THEN round(x, 9) END AS chi_squared,
       CAST(CASE WHEN ok THEN levels - 1 ELSE 0 END AS BIGINT) AS df, CASE WHEN ok THEN round({tail_sql("x", "(levels - 1)")}, 9) END AS p_value,
       CASE WHEN ok THEN round(sqrt(x / n), 9) END AS cramers_v
FROM (SELECT attribute, count(*) AS levels, sum(c) AS n, sum(h) > 0 AND sum(h) < sum(c) AND count(*) > 1 AS ok,
             sum((h - c * share) * (h - c * share) / (c * share) + ((c - h) - c * (1 - share)) * ((c - h) - c * (1 - share)) / (c * (1 - share))) AS x
      FROM (SELECT *, sum(h) OVER a / CAST(sum(c) OVER a AS DOUBLE) AS share FROM cell WINDOW a AS (PARTITION BY attribute)) GROUP BY attribute)""", f"""
firsts AS (SELECT *, TRY_CAST(substr(date_purchased, 12, 2) AS INTEGER) AS hour, min(order_month) OVER (PARTITION BY customer) AS cohort_id FROM clean
           QUALIFY row_number() OVER (PARTITION BY customer ORDER BY date_purchased, order_id) = 1),
known AS (SELECT *, EXISTS (SELECT 1 FROM clean c WHERE c.customer = firsts.customer AND c.order_month > firsts.cohort_id
                                                AND c.order_month <= firsts.cohort_id + INTERVAL 6 MONTH) AS returned
          FROM firsts WHERE cohort_id + INTERVAL 6 MONTH <= (SELECT max(order_month) FROM clean)),
lev AS ({" UNION ALL ".join(f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS level, returned FROM known" for a in _ASSOCIATED)}),
cell AS (SELECT attribute, level, count(*) AS c, count(*) FILTER (WHERE returned) AS h FROM lev GROUP BY attribute, level)""")


# ------------------------------------------------ H6 / H7 / H9: bitmaps ------
for _name in ("keys_by_group", "linked_filter", "keyset_diff"):
    ORACLE[f"{_name}_bitmaps"] = ORACLE[_name]
ORACLE["key_counts_bitmaps"] = base("SELECT state, count(DISTINCT customer) AS keys FROM clean GROUP BY state")


# ------------------------------------------------ D1 / D2 / A7: sketches -----
# The exact figures; that an estimate is within its bound is always to hold.
ORACLE["active_by_quarter_sketch"] = base(
    "SELECT CAST(date_trunc('quarter', order_month) AS DATE) AS quarter, count(DISTINCT customer) AS customers, true AS estimate_ok FROM clean GROUP BY 1")
ORACLE["active_in_both_sketch"] = base("""
SELECT count(*) FILTER (WHERE one) AS exact_first, count(*) FILTER (WHERE two) AS exact_second, count(*) FILTER (WHERE one AND two) AS exact_both, true AS estimate_ok
FROM (SELECT customer, bool_or(order_month BETWEEN DATE '1996-01-01' AND DATE '1996-12-01') AS one,
             bool_or(order_month BETWEEN DATE '1998-01-01' AND DATE '1998-12-01') AS two FROM clean GROUP BY customer)""")
ORACLE["quantiles_by_year_sketch"] = base("""
SELECT CAST(year(order_month) AS INTEGER) AS year, column_name, probability, count(*) AS n, true AS rank_ok
FROM (SELECT order_month, 'restaurant_total' AS column_name, restaurant_total AS v FROM clean UNION ALL SELECT order_month, 'promo_value', promo_value FROM clean),
     (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75)) t(probability) WHERE v IS NOT NULL GROUP BY ALL""")


# ------------------------------------------------ A3 / B5: late orders -------
ORACLE["upsert_corrected"] = base("SELECT *, CAST(CASE WHEN shipping_type IN ('O', 'P') THEN 2 ELSE 1 END AS BIGINT) AS version FROM clean")


# ------------------------------------------------ I5: growth to a target -----
def _forecast_sql(by: str | None, target: float, alpha: float = 0.5, beta: float = 0.3, horizon: int = 120) -> str:
    tag, k = by or "all", by or "0"
    return "WITH RECURSIVE " + ",".join([RAW, CLEAN, COHORT, *sliced([by] if by else []), f"""
ends AS (SELECT {k} AS k, min(cohort_id) AS first_month, max(cohort_id) AS last_month FROM size_{tag} GROUP BY 1),
grid AS (SELECT k, first_month, last_month, CAST(unnest(range(first_month, last_month + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS m FROM ends),
ser AS (SELECT g.k, g.m, row_number() OVER (PARTITION BY g.k ORDER BY g.m) AS i, CAST(coalesce(s.cohort_count, 0) AS DOUBLE) AS x
        FROM grid g LEFT JOIN size_{tag} s ON s.cohort_id = g.m AND {f"s.{by} IS NOT DISTINCT FROM g.k" if by else "true"}),
fold AS (SELECT a.k, CAST(1 AS BIGINT) AS i, a.x AS level, coalesce(b.x - a.x, 0.0::DOUBLE) AS trend, 0.0::DOUBLE AS sse
         FROM ser a LEFT JOIN ser b ON a.k IS NOT DISTINCT FROM b.k AND b.i = 2 WHERE a.i = 1
  UNION ALL
  SELECT k, i, level, {beta}::DOUBLE * (level - old) + {1 - beta}::DOUBLE * trend, sse + CASE WHEN i > 2 THEN (x - old - trend) * (x - old - trend) ELSE 0 END
  FROM (SELECT s.k, s.i, s.x, f.level AS old, f.trend, f.sse, {alpha}::DOUBLE * s.x + {1 - alpha}::DOUBLE * (f.level + f.trend) AS level
        FROM fold f JOIN ser s ON s.k IS NOT DISTINCT FROM f.k AND s.i = f.i + 1)),
fit AS (SELECT f.*, t.n, t.total, CASE WHEN t.n > 2 THEN sqrt(sse / (t.n - 2)) END AS error
        FROM fold f JOIN (SELECT k, max(i) AS n, sum(x) AS total FROM ser GROUP BY k) t ON t.k IS NOT DISTINCT FROM f.k AND t.n = f.i),
path AS (SELECT f.k, w, h, f.total + sum(greatest(0, level + h * trend + w * coalesce(error, 0))) OVER (PARTITION BY f.k, w ORDER BY h) AS reached
         FROM fit f, (VALUES (-1), (0), (1)) a(w), range(1, {horizon + 1}) b(h)),
hit AS (SELECT k, w, min(h) AS h FROM path WHERE reached >= {target} GROUP BY k, w)""", ]) + f"""
SELECT {f"f.k AS {by}, " if by else ""}first_month, last_month, f.total, round(level, 9) AS level, round(trend, 9) AS trend, round(error, 9) AS error, {", ".join(
        f"CAST(CASE WHEN f.total >= {target} THEN 0 ELSE (SELECT h FROM hit WHERE hit.k IS NOT DISTINCT FROM f.k AND w = {w}) END AS INTEGER) AS {name}"
        for w, name in ((0, "months_to_target"), (1, "months_at_best"), (-1, "months_at_worst")))}
FROM fit f JOIN ends e ON e.k IS NOT DISTINCT FROM f.k"""


ORACLE["growth_forecast"] = _forecast_sql(None, 20_000)
ORACLE["growth_forecast_by_source"] = _forecast_sql("source", 2_000)


# ------------------------------------------------ H1: options ---------------
ORACLE["filter_range_unknown_ends"] = ORACLE["filter_range"]


# ------------------------------------------------ A5 / A7, H4 ---------------
ORACLE["heavy_hitters"] = base(f"""
SELECT column_name, value, count(*) AS n, round(count(*) / CAST(any_value(rows) AS DOUBLE), 9) AS share
FROM (SELECT *, count(*) OVER (PARTITION BY column_name) AS rows FROM ({" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM clean WHERE {c} IS NOT NULL"
    for c in ("source", "shipping_type", "payment_method", "state", "shops_id", "date_purchased"))}))
GROUP BY column_name, value HAVING count(*) * 30 > any_value(rows)""")
ORACLE["search_text_postings"] = ORACLE["search_text"]
ORACLE["search_date_postings"] = base("SELECT * FROM clean WHERE contains(lower(date_purchased), '1996-') AND contains(lower(date_purchased), '-01t0')")
