"""The result of every registered query as SQL over the same tables.

Written on its own, in plain set-at-a-time SQL, to check the Spark jobs: no
incremental steps, no salting, no ranges, whatever the job does to scale.
"""

from __future__ import annotations

from checks import fixture as fx

LINES = """
lines AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, l_suppkey AS supplier_id,
         o_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
         r_name AS region, n_name AS state, p_type AS category, p_brand AS sub_category, p_name AS product_name,
         CAST(o_orderdate AS DATE) AS order_date,
         CASE WHEN l_shipdate >= o_orderdate THEN CAST(l_shipdate AS DATE) END AS ship_date,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS sales,
         CAST(l_quantity AS INT) AS quantity,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS discount,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
              - CAST(l_quantity AS INT) * CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS profit,
         l_returnflag AS return_flag,
         CAST(p_retailprice AS DECIMAL(12,2)) AS unit_cost
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
),
priced AS (
  SELECT *, CAST(sales - discount AS DECIMAL(13,2)) AS net_sales,
         CASE WHEN sales > 0 THEN CAST(profit AS DOUBLE) / CAST(sales AS DOUBLE) * 100 ELSE 0 END AS margin_pct,
         CAST(ship_date - order_date AS BIGINT) AS days,
         CAST(date_trunc('month', order_date) AS DATE) AS month_start
  FROM lines
)"""

READINGS = """
readings AS (
  SELECT event_id, user_id AS station_id, ts AS reading_ts,
         CAST((CAST(value AS DECIMAL(10,2)) % 40) - 10 AS DECIMAL(5,2)) AS temperature_2m,
         CAST((CAST(value AS DECIMAL(10,2)) * 13) % 100 AS DECIMAL(5,2)) AS relative_humidity_2m,
         CAST((CAST(value AS DECIMAL(10,2)) * 7) % 15 AS DECIMAL(5,2)) AS wind_speed_10m,
         CAST(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(10,2)) % 8 ELSE 0 END AS DECIMAL(5,2))
           AS precipitation
  FROM events
),
faulty AS (
  SELECT event_id, station_id, reading_ts,
         CASE WHEN event_type NOT IN ('signup', 'view') THEN temperature_2m END AS temperature_2m,
         CASE WHEN event_type NOT IN ('signup', 'click') THEN relative_humidity_2m END AS relative_humidity_2m,
         CASE WHEN event_type NOT IN ('signup', 'purchase') THEN wind_speed_10m END AS wind_speed_10m,
         CASE WHEN event_type NOT IN ('signup', 'click', 'view') THEN precipitation END AS precipitation
  FROM readings JOIN events USING (event_id)
)"""


def ratio(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"


def mean(c: str) -> str:
    return ratio(f"SUM({c})", f"COUNT({c})")


def money(c: str) -> str:
    return f"CAST(SUM({c}) AS DECIMAL(22,2))"


def big(c: str) -> str:
    return f"CAST({c} AS BIGINT)"


def ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def lit(x) -> str:
    return f"{type(x).__name__ == 'datetime' and 'TIMESTAMP' or 'DATE'} '{x}'"


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def of_run(condition: str) -> str:
    """Greatest load metadata of a group whose rows for which ``condition`` holds came with the second run."""
    marks = {
        "loaded_at": (lit(fx.NEXT_LOAD_TS), lit(fx.LOAD_TS)),
        "run_started_at": (lit(fx.NEXT_RUN_STARTED), lit(fx.RUN_STARTED)),
        "run_id": (f"'{fx.NEXT_RUN_ID}'", f"'{fx.RUN_ID}'"),
    }
    return ", ".join(f"MAX(CASE WHEN {condition} THEN {b} ELSE {a} END) AS {c}" for c, (b, a) in marks.items())


RUN_MARKS = of_run(f"order_date >= {lit(fx.FIRST_LOAD_UNTIL)}")


def values(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


ON_LINES = ctes(LINES)
ON_READINGS = ctes(READINGS)
KEY = "order_id, line_no, product_id, supplier_id"
ALL = f"{KEY}, customer_id, customer_name, segment, region, state, category, sub_category, product_name"
Q: dict[str, str] = {}

# --- sources and sinks ------------------------------------------------------------------

Q["csv_scan"] = ON_LINES + f"SELECT {KEY}, customer_name, order_date, ship_date, sales FROM lines"
Q["write_new_table"] = ON_LINES + f"SELECT {KEY}, sales FROM lines"
Q["extract_since"] = f"""
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate,
       CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice
FROM orders WHERE o_orderdate >= {lit(fx.EXTRACT_FROM)}"""
Q["extract_day"] = f"""
SELECT event_id, ts, user_id, event_type, value FROM events WHERE CAST(ts AS DATE) = {lit(fx.ONE_DAY)}"""
Q["api_hourly_rows"] = ON_READINGS + f"""
SELECT date_trunc('hour', reading_ts) AS reading_ts,
       CAST({mean('temperature_2m')} AS FLOAT) AS temperature_2m,
       CAST({mean('relative_humidity_2m')} AS FLOAT) AS relative_humidity_2m,
       CAST({mean('wind_speed_10m')} AS FLOAT) AS wind_speed_10m,
       CAST({mean('precipitation')} AS FLOAT) AS precipitation
FROM readings GROUP BY 1"""
Q["conform_schema"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice,
       o_orderpriority, CAST(NULL AS VARCHAR) AS o_comment
FROM orders"""
Q["load_all_counts"] = " UNION ALL ".join(
    f"SELECT '{t}_last_data' AS table_name, COUNT(*) AS row_count FROM {t}"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
)
Q["full_refresh"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders"
Q["replace_day_idempotent"] = ON_READINGS + "SELECT *, CAST(reading_ts AS DATE) AS load_day FROM readings"
Q["append_load"] = ON_READINGS + "SELECT * FROM readings"
Q["replace_day_emptied"] = ON_READINGS + f"""
SELECT event_id, reading_ts, temperature_2m, CAST(reading_ts AS DATE) AS load_day FROM readings
WHERE CAST(reading_ts AS DATE) <> {lit(fx.ONE_DAY)}"""
Q["backfill_gap"] = ON_READINGS + f"""
SELECT event_id, reading_ts, temperature_2m, CAST(reading_ts AS DATE) AS load_day FROM readings
WHERE CAST(reading_ts AS DATE) NOT BETWEEN {lit(fx.BACKFILL_FROM)} AND {lit(fx.BACKFILL_FROM)} + 2"""
Q["expire_partitions"] = ON_READINGS + f"""
SELECT event_id, reading_ts, CAST(reading_ts AS DATE) AS load_day FROM readings
WHERE CAST(reading_ts AS DATE) > {lit(fx.EXPIRE_AS_OF)} - {fx.EXPIRE_DAYS}"""
Q["retention_filter"] = ON_LINES + f"""
SELECT {KEY}, order_date, sales FROM lines
WHERE order_date + INTERVAL {fx.RETAIN_DAYS} DAY > {lit(fx.RETAIN_AS_OF)}"""
Q["backfill_range"] = ON_READINGS + """
SELECT event_id, reading_ts, temperature_2m, CAST(reading_ts AS DATE) AS load_day FROM readings"""
Q["partitioned_write"] = ON_LINES + f"""
SELECT {big("strftime(order_date, '%Y%m')")} AS month, region, COUNT(*) AS line_count, {money('sales')} AS total_sales
FROM lines GROUP BY 1, 2"""

# --- staging ------------------------------------------------------------------------------

Q["stg_orders_basic"] = ON_LINES + f"""
SELECT {ALL}, order_date, ship_date, sales, quantity, discount, profit, return_flag, {lit(fx.LOAD_TS)} AS load_ts
FROM lines"""
Q["stg_orders_metadata"] = ON_LINES + f"""
SELECT {KEY}, customer_id, order_date, sales, {lit(fx.LOAD_TS)} AS loaded_at,
       {lit(fx.RUN_STARTED)} AS run_started_at, '{fx.RUN_ID}' AS run_id
FROM lines"""
Q["stg_orders_enriched"] = ON_LINES + f"""
SELECT {KEY}, sales, discount, profit, net_sales, margin_pct AS profit_margin_pct FROM priced"""
Q["orders_cleaned"] = ON_LINES + f"""
SELECT {ALL}, order_date, ship_date, CAST(sales AS DECIMAL(9,2)) AS sales_amount, quantity, discount, profit, return_flag
FROM lines"""


def _staged_weather(source: str) -> str:
    return ON_READINGS + f"""
SELECT event_id, reading_ts AS measured_at, CAST(reading_ts AS DATE) AS measurement_date,
       temperature_2m AS temperature_celsius,
       CAST(ROUND(temperature_2m * 1.8 + 32, 2) AS DECIMAL(8,2)) AS temperature_fahrenheit,
       relative_humidity_2m AS humidity_percent,
       wind_speed_10m AS wind_speed_ms,
       CAST(ROUND(wind_speed_10m * 3.6, 2) AS DECIMAL(8,2)) AS wind_speed_kmh,
       precipitation AS precipitation_mm
FROM {source}
WHERE COALESCE(temperature_2m, relative_humidity_2m, wind_speed_10m, precipitation) IS NOT NULL"""


Q["stg_weather"] = _staged_weather("readings")
Q["stg_weather_nonnull"] = _staged_weather("faulty")
Q["stg_readings_basic"] = ON_READINGS + f"""
SELECT event_id, reading_ts, temperature_2m, relative_humidity_2m, wind_speed_10m, precipitation,
       {lit(fx.LOAD_TS)} AS load_ts
FROM readings"""
Q["dedupe_latest"] = ON_LINES + f"""
SELECT {KEY}, order_date, ship_date, sales FROM lines
QUALIFY ROW_NUMBER() OVER (
  PARTITION BY order_id, product_id
  ORDER BY ship_date DESC NULLS LAST, line_no DESC, supplier_id DESC, sales DESC) = 1"""

# --- filters --------------------------------------------------------------------------------

Q["hwm_exclusive"] = f"SELECT event_id, ts, event_type, value FROM events WHERE ts > {lit(fx.HALF_TIME)}"
Q["hwm_inclusive"] = f"""
SELECT o_orderkey, o_orderdate, o_custkey FROM orders
WHERE o_orderdate >= (SELECT MAX(o_orderdate) FROM orders WHERE o_orderdate <= {lit(fx.FIRST_LOAD_UNTIL)})"""


def segment_case(total: str, count: str, p: dict) -> str:
    return (
        f"CASE WHEN {total} > {p['total_over']} THEN 'VIP' WHEN {count} > {p['count_over']} THEN 'Frequent' "
        "ELSE 'Regular' END"
    )


SEGMENTS_CTE = f"""
segments AS (
  SELECT customer_id, MAX(customer_name) AS customer_name, MAX(segment) AS segment, MAX(region) AS region,
         {money('sales')} AS total_spent, COUNT(DISTINCT order_id) AS order_count,
         {segment_case('SUM(sales)', 'COUNT(DISTINCT order_id)', fx.CUSTOMER_SEGMENT)} AS customer_segment
  FROM lines GROUP BY customer_id
)"""
LINE_SEGMENTS_CTE = f"""
line_segments AS (
  SELECT customer_id, {money('sales')} AS total_spent, COUNT(*) AS order_count,
         {segment_case('SUM(sales)', 'COUNT(*)', fx.LINE_SEGMENT)} AS customer_segment
  FROM lines GROUP BY customer_id
)"""
Q["new_keys_only"] = ctes(LINES, SEGMENTS_CTE) + f"""
SELECT customer_id, total_spent, order_count, customer_segment FROM segments
WHERE customer_id NOT IN (SELECT customer_id FROM lines WHERE order_date < {lit(fx.KNOWN_BEFORE)})"""
Q["product_priority"] = ON_LINES + f"""
SELECT CASE WHEN category IN ({values(fx.HIGH_PRIORITY)}) THEN 'High' ELSE 'Low' END AS priority, category,
       COUNT(*) AS line_count, {money('sales')} AS total_sales
FROM lines GROUP BY 1, 2"""

# --- row-level enrichment ------------------------------------------------------------------


def steps(c: str, op: str, pairs, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} {op} {limit} THEN '{label}'" for limit, label in pairs) + f" ELSE '{rest}' END"


STATUS = (
    "CASE WHEN days IS NULL THEN 'Not Shipped' WHEN days <= 3 THEN 'Fast' WHEN days <= 7 THEN 'Standard' "
    "ELSE 'Slow' END"
)
MARGIN_CLASS = (
    "CASE WHEN sales <= 0 THEN 'Low Margin' WHEN profit >= 0.3 * sales THEN 'High Margin' "
    "WHEN profit >= 0.1 * sales THEN 'Medium Margin' WHEN profit >= 0 THEN 'Low Margin' ELSE 'Loss' END"
)
Q["orders_enriched"] = ON_LINES + f"""
SELECT {KEY}, customer_id, order_date, ship_date, sales, discount, profit, net_sales,
       margin_pct AS profit_margin_pct, days AS delivery_days, {STATUS} AS delivery_status,
       YEAR(order_date) AS order_year, MONTH(order_date) AS order_month, QUARTER(order_date) AS order_quarter,
       ISODOW(order_date) AS order_day_of_week,
       {steps('net_sales', '>=', fx.SIZE_STEPS, 'Micro')} AS order_size_category,
       {MARGIN_CLASS} AS profitability_category
FROM priced"""


def by_region(position: int) -> str:
    whens = " ".join(f"WHEN region = '{r}' THEN CAST({xy[position]} AS DOUBLE)" for r, xy in fx.COORDINATES.items())
    return f"CASE {whens} ELSE CAST(0 AS DOUBLE) END"


Q["geo_customers"] = ON_LINES + f"""
, latest AS (
  SELECT customer_id, ARG_MAX(customer_name, (order_date, customer_name, region, state)) AS customer_name,
         ARG_MAX(region, (order_date, customer_name, region, state)) AS region,
         ARG_MAX(state, (order_date, customer_name, region, state)) AS state
  FROM lines GROUP BY customer_id)
SELECT *, {by_region(0)} AS latitude, {by_region(1)} AS longitude FROM latest"""
Q["category_map"] = ON_LINES + f"""
SELECT CASE {' '.join(f"WHEN category = '{k}' THEN '{v}'" for k, v in fx.CATEGORY_GROUPS.items())} ELSE 'Other' END
         AS category_group,
       COUNT(*) AS line_count, {money('sales')} AS total_sales
FROM lines GROUP BY 1"""
Q["customer_tenure_years"] = ON_LINES + f"""
SELECT customer_id, MIN(order_date) AS first_order_date,
       {big(f"DATE_SUB('year', MIN(order_date), {lit(fx.AS_OF)})")} AS tenure_years
FROM lines GROUP BY customer_id"""
Q["fixture_profit"] = ON_LINES + f"""
SELECT category, {money('sales - discount - quantity * unit_cost')} AS gross_margin,
       {money('quantity * unit_cost')} AS total_cost
FROM lines GROUP BY category"""
WIND = "CASE WHEN wind_speed_10m < 5 THEN 'Calm' WHEN wind_speed_10m < 10 THEN 'Light' ELSE 'Strong' END"
Q["wind_category_counts"] = ON_READINGS + f"SELECT {WIND} AS wind_category, COUNT(*) AS n FROM readings GROUP BY 1"
ICY = "temperature_2m < 0 AND precipitation > 0"
Q["icing_risk_by_day"] = ON_READINGS + f"""
SELECT CAST(reading_ts AS DATE) AS measurement_date, COUNT(*) FILTER ({ICY}) AS high_risk_readings,
       COUNT(*) AS readings, MAX(CASE WHEN {ICY} THEN 1 ELSE 0 END) AS icing_alert
FROM readings GROUP BY 1"""

COMFORT = READINGS + """,
scored AS (
  SELECT event_id, reading_ts, temperature_2m, relative_humidity_2m, wind_speed_10m,
         temperature_2m AS t, relative_humidity_2m AS h, wind_speed_10m AS w,
         POW(CAST(wind_speed_10m * 3.6 AS DOUBLE), 0.16) AS blow,
         CAST(CASE WHEN temperature_2m BETWEEN 18 AND 24 AND relative_humidity_2m BETWEEN 30 AND 60
                        AND wind_speed_10m < 5 THEN 100
              WHEN temperature_2m BETWEEN 15 AND 27 AND relative_humidity_2m BETWEEN 20 AND 70
                   AND wind_speed_10m < 10
              THEN 80 - 2 * ABS(temperature_2m - 21) - 0.5 * ABS(relative_humidity_2m - 45) - 2 * wind_speed_10m
              ELSE GREATEST(0, 50 - 3 * ABS(temperature_2m - 21) - 0.5 * ABS(relative_humidity_2m - 45)
                               - 3 * wind_speed_10m)
              END AS DECIMAL(8,3)) AS idx
  FROM readings
),
comfort AS (
  SELECT event_id, reading_ts, temperature_2m, relative_humidity_2m, wind_speed_10m,
         CAST(ROUND(CASE WHEN t >= 27 AND h >= 40 THEN t + 0.005 * t * h ELSE t END, 6) AS DOUBLE) AS heat_index,
         ROUND(CASE WHEN t <= 10 AND w > 1.3
                    THEN CAST(13.12 AS DOUBLE) + CAST(0.6215 AS DOUBLE) * CAST(t AS DOUBLE)
                         - CAST(11.37 AS DOUBLE) * blow + CAST(0.3965 AS DOUBLE) * CAST(t AS DOUBLE) * blow
                    ELSE CAST(t AS DOUBLE) END, 6) AS wind_chill,
         idx AS comfort_index,
         CASE WHEN idx >= 80 THEN 'Excellent' WHEN idx >= 60 THEN 'Good' WHEN idx >= 40 THEN 'Fair'
              WHEN idx >= 20 THEN 'Poor' ELSE 'Very Poor' END AS comfort_category
  FROM scored
)"""
Q["comfort_index"] = ctes(COMFORT) + "SELECT * FROM comfort"
Q["comfort_category_counts"] = ctes(COMFORT) + "SELECT comfort_category, COUNT(*) AS n FROM comfort GROUP BY 1"

# --- retail aggregates ----------------------------------------------------------------------

vip_total, vip_orders = fx.CUSTOMER_TIER["vip"]
METRICS_CTE = f"""
metrics AS (
  SELECT customer_id, customer_name, segment,
         COUNT(DISTINCT order_id) AS total_orders, {money('net_sales')} AS total_spent,
         {mean('net_sales')} AS avg_order_value, {money('profit')} AS total_profit,
         {big('SUM(quantity)')} AS total_quantity,
         MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date,
         ROUND(AVG(margin_pct), 6) AS avg_profit_margin, {RUN_MARKS},
         CAST(MAX(order_date) - MIN(order_date) AS BIGINT) AS customer_lifetime_days,
         CASE WHEN SUM(net_sales) >= {vip_total} AND COUNT(DISTINCT order_id) >= {vip_orders} THEN 'VIP'
              WHEN COUNT(DISTINCT order_id) >= {fx.CUSTOMER_TIER['frequent']} THEN 'Frequent'
              WHEN SUM(net_sales) >= {fx.CUSTOMER_TIER['high_value']} THEN 'High Value'
              ELSE 'Regular' END AS customer_tier
  FROM priced GROUP BY customer_id, customer_name, segment
)"""
ON_METRICS = ctes(LINES, METRICS_CTE)
Q["customer_metrics"] = ON_METRICS + "SELECT * FROM metrics"
LATEST_ATTRS = """
SELECT customer_id, ARG_MAX(region, (order_date, region, state)) AS latest_region,
       ARG_MAX(state, (order_date, region, state)) AS latest_state,
       ARG_MAX(category, (net_sales, category, sub_category)) AS preferred_category,
       ARG_MAX(sub_category, (net_sales, category, sub_category)) AS preferred_sub_category
FROM priced GROUP BY customer_id"""
Q["customer_latest_attrs"] = ON_LINES + LATEST_ATTRS
Q["customer_table"] = ON_METRICS + f"SELECT * FROM metrics LEFT JOIN ({LATEST_ATTRS}) USING (customer_id)"
Q["customer_tier_counts"] = ON_METRICS + "SELECT customer_tier, COUNT(*) AS customer_count FROM metrics GROUP BY 1"
Q["customer_segments"] = ctes(LINES, SEGMENTS_CTE) + "SELECT * FROM segments"
Q["customer_segments_by_lines"] = ctes(LINES, LINE_SEGMENTS_CTE) + "SELECT * FROM line_segments"

star_revenue, star_orders = fx.PRODUCT_TIER["star"]
TIER_OF_PRODUCT = (
    f"CASE WHEN total_revenue >= {star_revenue} AND total_orders >= {star_orders} THEN 'Star' "
    f"WHEN total_revenue >= {fx.PRODUCT_TIER['performer']} THEN 'High Performer' "
    f"WHEN total_orders >= {fx.PRODUCT_TIER['popular']} THEN 'Popular' "
    f"WHEN avg_profit_margin / 100 >= CAST({fx.PRODUCT_TIER['high_margin']} AS DOUBLE) THEN 'High Margin' "
    "ELSE 'Standard' END"
)
VOLUME = steps("total_quantity_sold", ">=", fx.VOLUME_STEPS, "Low Volume")
PERFORMANCE_CTE = f"""
performance AS (
  SELECT *, {TIER_OF_PRODUCT} AS product_tier, {VOLUME} AS volume_category
  FROM (
    SELECT product_id, product_name, category, sub_category,
           COUNT(DISTINCT order_id) AS total_orders, COUNT(DISTINCT customer_id) AS unique_customers,
           COUNT(DISTINCT region) AS regions_sold, COUNT(DISTINCT state) AS states_sold,
           {big('SUM(quantity)')} AS total_quantity_sold, {money('net_sales')} AS total_revenue,
           {money('profit')} AS total_profit, {mean('net_sales')} AS avg_order_value,
           ROUND(AVG(margin_pct), 6) AS avg_profit_margin,
           {RUN_MARKS}, MIN(order_date) AS first_sale_date, MAX(order_date) AS last_sale_date,
           ARG_MAX(region, (net_sales, region)) AS top_region_by_sales
    FROM priced GROUP BY product_id, product_name, category, sub_category)
)"""
Q["product_performance"] = ctes(LINES, PERFORMANCE_CTE) + "SELECT * FROM performance"
Q["product_tier_counts"] = ctes(LINES, PERFORMANCE_CTE) + """
SELECT product_tier, volume_category, COUNT(*) AS product_count FROM performance GROUP BY 1, 2"""
PER_SEGMENT = ", ".join(f"COUNT(*) FILTER (segment = '{s}') AS {s.lower()}_orders" for s in fx.SEGMENTS)
Q["regional_sales"] = ON_LINES + f"""
SELECT region, YEAR(order_date) AS order_year, MONTH(order_date) AS order_month,
       COUNT(DISTINCT order_id) AS total_orders, COUNT(DISTINCT customer_id) AS unique_customers,
       COUNT(DISTINCT product_id) AS unique_products, COUNT(DISTINCT state) AS unique_states,
       {money('net_sales')} AS total_sales, {money('profit')} AS total_profit, {big('SUM(quantity)')} AS total_quantity,
       {mean('net_sales')} AS avg_order_value, ROUND(AVG(margin_pct), 6) AS avg_profit_margin, {PER_SEGMENT},
       {mean('days')} AS avg_delivery_days, COUNT(*) FILTER (days IS NULL) AS unshipped_orders, {RUN_MARKS},
       ARG_MAX(category, (net_sales, category)) AS top_category_by_sales
FROM priced GROUP BY 1, 2, 3"""
Q["avg_delivery_days"] = ON_LINES + f"""
SELECT region, {mean('days')} AS avg_delivery_days, COUNT(days) AS shipped_lines FROM priced GROUP BY region"""


def _category_months(month: str) -> str:
    return ON_LINES + f"""
SELECT category, region, {month} AS order_month, {money('sales')} AS total_sales,
       {big('SUM(quantity)')} AS total_quantity, {money('profit')} AS total_profit, {mean('discount')} AS avg_discount,
       COUNT(DISTINCT order_id) AS order_count, COUNT(DISTINCT customer_id) AS customer_count
FROM priced GROUP BY 1, 2, 3"""


Q["category_region_month"] = _category_months("month_start")
Q["category_region_month_of_year"] = _category_months("MONTH(order_date)")
MONTHS_CTE = f"""
months AS (
  SELECT month_start, YEAR(month_start) AS year, QUARTER(month_start) AS quarter, MONTH(month_start) AS month,
         {money('net_sales')} AS total_sales, {money('profit')} AS total_profit,
         COUNT(DISTINCT order_id) AS total_orders, COUNT(DISTINCT customer_id) AS unique_customers
  FROM priced GROUP BY 1, 2, 3, 4
)"""
Q["sales_overview"] = ctes(LINES, MONTHS_CTE) + f"""
, quarters AS (
  SELECT year, quarter, {money('total_sales')} AS quarterly_sales, {money('total_profit')} AS quarterly_profit,
         {big('SUM(total_orders)')} AS quarterly_orders
  FROM months GROUP BY year, quarter),
years AS (
  SELECT year, {money('total_sales')} AS yearly_sales, {money('total_profit')} AS yearly_profit,
         {big('SUM(total_orders)')} AS yearly_orders
  FROM months GROUP BY year)
SELECT months.*, quarterly_sales, quarterly_profit, quarterly_orders, yearly_sales, yearly_profit, yearly_orders,
       {ratio('total_profit', 'total_sales')} AS profit_margin, {ratio('total_sales', 'total_orders')} AS avg_order_value
FROM months JOIN quarters USING (year, quarter) JOIN years USING (year)"""
Q["sales_by_time"] = ON_LINES + f"""
SELECT month_start AS order_month, YEAR(month_start) AS year, QUARTER(month_start) AS quarter,
       MONTH(month_start) AS month, {money('sales')} AS total_sales, COUNT(DISTINCT order_id) AS total_orders
FROM priced GROUP BY 1"""
Q["period_totals"] = ON_LINES + f"""
SELECT year, quarter, month, {money('sales')} AS total_sales, {big('GROUPING(year, quarter, month)')} AS level
FROM (SELECT YEAR(order_date) AS year, QUARTER(order_date) AS quarter, MONTH(order_date) AS month, sales FROM lines)
GROUP BY ROLLUP (year, quarter, month)"""
Q["profit_by_category_region"] = ON_LINES + f"""
SELECT category, region, {money('profit')} AS total_profit, {ratio('SUM(profit)', 'SUM(sales)')} AS profitability
FROM lines GROUP BY 1, 2"""
Q["assumed_margin"] = ON_LINES + f"""
SELECT category, region, CAST(SUM(sales) * 0.8 AS DECIMAL(22,2)) AS profit,
       {ratio('SUM(sales) * 0.8', 'SUM(sales)')} AS margin
FROM lines GROUP BY 1, 2"""
Q["average_check"] = ctes(LINES, SEGMENTS_CTE) + f"""
SELECT customer_segment, {money('sales')} AS total_sales, COUNT(DISTINCT order_id) AS total_orders,
       {ratio('SUM(sales)', 'COUNT(DISTINCT order_id)')} AS average_check, {mean('sales')} AS average_sale
FROM lines JOIN segments USING (customer_id) GROUP BY 1"""
DELIVERY = f"""COUNT(*) AS orders_count, {mean('days')} AS avg_delivery_days, MIN(days) AS min_delivery_days,
       MAX(days) AS max_delivery_days, ROUND(QUANTILE_CONT(days, 0.5), 6) AS median_delivery_days,
       ROUND(QUANTILE_CONT(days, 0.95), 6) AS p95_delivery_days"""
Q["average_check_joined"] = Q["average_check"]
Q["delivery_performance"] = ON_LINES + f"""
SELECT *, CASE delivery_status WHEN 'Overall' THEN 1 WHEN 'Fast' THEN 2 WHEN 'Standard' THEN 3 ELSE 4 END AS sort_key
FROM (
  SELECT {STATUS} AS delivery_status, {DELIVERY} FROM priced WHERE days IS NOT NULL GROUP BY 1
  UNION ALL
  SELECT 'Overall', {DELIVERY} FROM priced WHERE days IS NOT NULL HAVING COUNT(*) > 0)"""
SPENT, ORDERS = "CAST(total_spent AS DOUBLE)", "CAST(total_orders AS DOUBLE)"
YEARS = "(CAST(customer_lifetime_days AS DOUBLE) / CAST(365.0 AS DOUBLE))"
CLV_CTE = f"""
clv AS (
  SELECT customer_id, customer_tier, total_orders, total_spent, customer_lifetime_days,
         {SPENT} / {ORDERS} AS avg_order_value,
         CASE WHEN customer_lifetime_days > 0 THEN {ORDERS} / {YEARS} ELSE CAST(0 AS DOUBLE) END
           AS purchase_frequency,
         CASE WHEN customer_lifetime_days > 0
              THEN ROUND({SPENT} / {ORDERS} * ({ORDERS} / {YEARS}) * {YEARS}, 2) ELSE ROUND({SPENT}, 2) END
           AS customer_lifetime_value
  FROM metrics
)"""
Q["customer_clv_days"] = ctes(LINES, METRICS_CTE, CLV_CTE) + "SELECT * FROM clv"
MONTHS_BETWEEN = (
    "((YEAR(MAX(order_date)) - YEAR(MIN(order_date))) * 12 + MONTH(MAX(order_date)) - MONTH(MIN(order_date)))"
)
CLV_MONTHS_CTE = f"""
clv_months AS (
  SELECT customer_id, spent / orders AS avg_order_value,
         orders / GREATEST(months, 1) AS purchase_frequency, months AS customer_lifespan,
         ROUND(spent / orders * (orders / GREATEST(months, 1)) * months, 2) AS clv
  FROM (SELECT customer_id, CAST(SUM(sales) AS DOUBLE) AS spent, CAST(COUNT(DISTINCT order_id) AS DOUBLE) AS orders,
               {big(MONTHS_BETWEEN)} AS months
        FROM lines GROUP BY customer_id)
)"""
Q["customer_clv_months"] = ctes(LINES, CLV_MONTHS_CTE) + "SELECT * FROM clv_months"
Q["customer_segment_share"] = ctes(LINES, METRICS_CTE, CLV_CTE) + f"""
, tiers AS (
  SELECT customer_tier, COUNT(*) AS customers_count, {mean('total_spent')} AS avg_total_spent,
         {mean('total_orders')} AS avg_total_orders, ROUND(AVG(avg_order_value), 4) AS avg_order_value_segment,
         ROUND(AVG(customer_lifetime_value), 4) AS avg_clv, {money('total_spent')} AS segment_revenue,
         {big('SUM(total_orders)')} AS segment_orders
  FROM clv GROUP BY customer_tier)
SELECT clv.*, tiers.* EXCLUDE (customer_tier), {ratio('total_spent', 'segment_revenue')} AS revenue_contribution_pct
FROM clv JOIN tiers USING (customer_tier)"""
ACTIVE_CTE = """
active AS (
  SELECT DISTINCT customer_id, month_start AS order_month FROM priced
),
steps AS (
  SELECT *, LAG(order_month) OVER (PARTITION BY customer_id ORDER BY order_month) AS before,
         MIN(order_month) OVER (PARTITION BY customer_id) AS first_month
  FROM active
)"""
Q["retention_monthly"] = ctes(LINES, ACTIVE_CTE) + f"""
, months AS (
  SELECT order_month, COUNT(*) AS current_customers,
         COUNT(*) FILTER (before = CAST(order_month - INTERVAL 1 MONTH AS DATE)) AS retained_customers
  FROM steps GROUP BY order_month)
SELECT *, LAG(current_customers) OVER (ORDER BY order_month) AS previous_customers,
       COALESCE({ratio('retained_customers', 'LAG(current_customers) OVER (ORDER BY order_month)')}, 0)
         AS retention_rate
FROM months"""
CRR_CTE = f"""
crr AS (
  SELECT *, {ratio('(customers_at_end - new_customers) * 100', 'customers_at_start')} AS crr
  FROM (SELECT *, LAG(customers_at_end) OVER (ORDER BY order_month) AS customers_at_start
        FROM (SELECT order_month, COUNT(*) AS customers_at_end,
                     COUNT(*) FILTER (first_month = order_month) AS new_customers
              FROM steps GROUP BY order_month))
)"""
Q["retention_crr"] = ctes(LINES, ACTIVE_CTE, CRR_CTE) + "SELECT * FROM crr"
DYNAMICS_CTE = f"""
dynamics AS (
  SELECT *, order_count - previous_orders AS order_change,
         {ratio('total_sales - previous_sales', 'previous_sales')} AS sales_change_pct
  FROM (SELECT *, LAG(order_count) OVER (ORDER BY order_month) AS previous_orders,
               LAG(total_sales) OVER (ORDER BY order_month) AS previous_sales
        FROM (SELECT month_start AS order_month, COUNT(DISTINCT order_id) AS order_count,
                     {money('sales')} AS total_sales
              FROM priced GROUP BY 1))
)"""
Q["order_dynamics"] = ctes(LINES, DYNAMICS_CTE) + "SELECT * FROM dynamics"
Q["sales_drop_alert"] = ctes(LINES, DYNAMICS_CTE) + """
SELECT order_month, total_sales, previous_sales, sales_change_pct,
       CASE WHEN total_sales <= previous_sales * 0.85 THEN 1 ELSE 0 END AS drop_alert
FROM dynamics"""
RETURNED = "COUNT(DISTINCT order_id) FILTER (return_flag = 'R')"
Q["return_rate"] = ON_LINES + f"""
SELECT segment, {RETURNED} AS returned_orders, COUNT(DISTINCT order_id) AS total_orders,
       {ratio(RETURNED, 'COUNT(DISTINCT order_id)')} AS return_rate
FROM lines GROUP BY segment"""
VIEWS, BUYS = "COUNT(*) FILTER (event_type = 'view')", "COUNT(*) FILTER (event_type = 'purchase')"
Q["conversion_rate"] = f"""
SELECT CAST(ts AS DATE) AS event_date, {VIEWS} AS visits, {BUYS} AS purchases, {ratio(BUYS, VIEWS)} AS conversion_rate
FROM events GROUP BY 1"""
Q["sales_per_day"] = ON_LINES + f"""
SELECT order_date AS period_start, {money('sales')} AS total_sales, COUNT(*) AS line_count FROM lines GROUP BY 1"""
Q["sales_per_week"] = ON_LINES + f"""
SELECT CAST(date_trunc('week', order_date) AS DATE) AS period_start, {money('sales')} AS total_sales,
       COUNT(*) AS line_count
FROM lines GROUP BY 1"""
Q["region_sales_customers"] = ON_LINES + f"""
SELECT region, {money('sales')} AS total_sales, COUNT(DISTINCT customer_id) AS unique_customers
FROM lines GROUP BY region"""
Q["orders_summary"] = ctes(LINES, LINE_SEGMENTS_CTE) + f"""
, totals AS (
  SELECT category, region, MONTH(order_date) AS order_month, {money('sales')} AS total_sales,
         {big('SUM(quantity)')} AS total_quantity, {mean('discount')} AS avg_discount, {money('profit')} AS total_profit
  FROM lines GROUP BY 1, 2, 3)
SELECT {KEY}, lines.customer_id, customer_segment, category, region, order_date, MONTH(order_date) AS order_month,
       sales, quantity, discount, profit, total_sales, total_quantity, avg_discount, total_profit
FROM lines LEFT JOIN line_segments USING (customer_id)
LEFT JOIN totals USING (category, region)
WHERE MONTH(order_date) = totals.order_month"""
Q["orders_with_customers"] = ON_LINES + f"""
SELECT {KEY}, customer_id, order_date, sales, customer_name, segment, region, state FROM lines"""
PRODUCT_SALES_CTE = f"""
product_sales AS (
  SELECT product_id, {money('net_sales')} AS total_sales, {money('profit')} AS total_profit,
         COUNT(DISTINCT order_id) AS total_orders
  FROM priced GROUP BY product_id
)"""
ABC_CTE = f"""
abc AS (
  SELECT product_id, total_sales, total_profit, total_orders, {ratio('total_profit', 'total_sales')} AS profit_margin,
         sales_rank, {ratio('running', 'total')} AS cumulative_sales_pct,
         CASE WHEN running <= total * 0.8 THEN 'A' WHEN running <= total * 0.95 THEN 'B' ELSE 'C' END AS abc_category
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY total_sales DESC, product_id) AS sales_rank,
               CAST(SUM(total_sales) OVER () AS DECIMAL(30,2)) AS total,
               CAST(SUM(total_sales) OVER (ORDER BY total_sales DESC, product_id ROWS UNBOUNDED PRECEDING)
                    AS DECIMAL(30,2)) AS running
        FROM product_sales)
)"""
Q["abc_analysis"] = ctes(LINES, PRODUCT_SALES_CTE, ABC_CTE) + "SELECT * FROM abc"


def _best(label: str, metric: str) -> str:
    return f"""(SELECT product_id, total_orders, '{label}' AS analysis_type, {metric} AS metric_value,
       ROW_NUMBER() OVER (ORDER BY {metric} DESC, product_id) AS rank
FROM product_sales ORDER BY rank LIMIT 10)"""


TWO_RANKINGS = f"{_best('sales', 'total_sales')} UNION ALL {_best('profit', 'total_profit')}"
Q["top_products_two_metrics"] = ctes(LINES, PRODUCT_SALES_CTE) + TWO_RANKINGS
Q["top10_sales"] = ON_LINES + f"""
SELECT product_id, {money('sales')} AS total_sales FROM lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
Q["top10_quantity"] = ON_LINES + f"""
SELECT product_name, {big('SUM(quantity)')} AS total_quantity FROM lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
Q["top10_profit"] = ON_LINES + f"""
SELECT product_id, {money('profit')} AS total_profit FROM lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
Q["top10_by_category_product"] = ON_LINES + f"""
SELECT category, product_name, {money('sales')} AS total_sales, {money('profit')} AS total_profit
FROM lines GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"""

# --- weather aggregates ------------------------------------------------------------------

DAILY_COLUMNS = f"""{mean('temperature_2m')} AS avg_temperature, MIN(temperature_2m) AS min_temperature,
         MAX(temperature_2m) AS max_temperature, {mean('relative_humidity_2m')} AS avg_humidity,
         {mean('wind_speed_10m')} AS avg_wind_speed, MAX(wind_speed_10m) AS max_wind_speed,
         {money('precipitation')} AS total_precipitation, COUNT(*) AS measurement_count"""
DAILY_CTE = f"""
daily AS (
  SELECT CAST(reading_ts AS DATE) AS measurement_date, {DAILY_COLUMNS}
  FROM readings GROUP BY 1
)"""
ON_DAILY = ctes(READINGS, DAILY_CTE)
Q["daily_weather"] = ON_DAILY + "SELECT * FROM daily"
Q["daily_weather_by_station"] = ON_READINGS + f"""
SELECT CAST(reading_ts AS DATE) AS measurement_date, station_id, {DAILY_COLUMNS} FROM readings GROUP BY 1, 2"""


ALERTS_CTE = f"""
alerts AS (
  SELECT measurement_date, avg_temperature, avg_humidity, avg_wind_speed, total_precipitation,
         {flag(f"avg_temperature > {fx.DAILY_LIMITS['temperature']}")} AS high_temperature_alert,
         {flag(f"avg_humidity > {fx.DAILY_LIMITS['humidity']}")} AS high_humidity_alert,
         {flag(f"avg_wind_speed > {fx.DAILY_LIMITS['wind']}")} AS high_wind_alert,
         {flag(f"total_precipitation > {fx.DAILY_LIMITS['precipitation']}")} AS high_precipitation_alert
  FROM daily
)"""
Q["daily_weather_alerts"] = ctes(READINGS, DAILY_CTE, ALERTS_CTE) + "SELECT * FROM alerts"
HOURS_CTE = f"""
hours AS (
  SELECT CAST(reading_ts AS DATE) AS measurement_date, HOUR(reading_ts) AS hour,
         {mean('comfort_index')} AS avg_comfort_index, MIN(comfort_index) AS min_comfort_index,
         MAX(comfort_index) AS max_comfort_index,
         ARG_MIN(comfort_category, comfort_index) AS worst_comfort_category,
         {flag('MIN(comfort_index) < 30')} AS low_comfort_alert
  FROM comfort GROUP BY 1, 2
)"""
Q["hourly_comfort"] = ctes(COMFORT, HOURS_CTE) + "SELECT * FROM hours"
LINEAR = (
    "(avg_temperature * CAST(0.5 AS DOUBLE) + avg_humidity * CAST(0.3 AS DOUBLE)"
    " - avg_wind_speed * CAST(0.2 AS DOUBLE))"
)
Q["linear_comfort_daily"] = ON_DAILY + f"""
SELECT measurement_date, avg_temperature, avg_humidity, avg_wind_speed, {LINEAR} AS comfort_index FROM daily"""


def seasonal(source: str, day: str, value: str, baseline: str | None = None) -> str:
    baseline = baseline or f"""
  SELECT s.{day}, s.{value}, mean, sd FROM {source} s JOIN (
    SELECT DAYOFYEAR({day}) AS doy, AVG(CAST({value} AS DOUBLE)) AS mean, STDDEV_POP(CAST({value} AS DOUBLE)) AS sd
    FROM {source} GROUP BY 1) ON DAYOFYEAR(s.{day}) = doy"""
    return f"""
based AS ({baseline}),
anomalies AS (
  SELECT {day}, {value}, ROUND(mean, 4) AS baseline, ROUND(sd, 4) AS baseline_stddev,
         ROUND(CAST({value} AS DOUBLE) - mean, 4) AS anomaly, z AS z_score,
         CASE WHEN ABS(z) > 3 THEN 'Extreme' WHEN ABS(z) > 2 THEN 'Significant'
              WHEN ABS(z) > 1 THEN 'Moderate' ELSE 'Normal' END AS severity
  FROM (SELECT *, ROUND((CAST({value} AS DOUBLE) - mean) / NULLIF(sd, 0), 6) AS z FROM based)
)"""


DAY_SALES_CTE = f"""
day_sales AS (SELECT order_date AS period_start, {money('sales')} AS total_sales FROM lines GROUP BY 1)"""
Q["anomaly_alerts"] = ctes(LINES, DAY_SALES_CTE, seasonal("day_sales", "period_start", "total_sales")) + f"""
SELECT *, {flag(f'ABS(anomaly) > {fx.ANOMALY_LIMIT}')} AS significant_anomaly_alert FROM anomalies"""


def against(which: str) -> str:
    """Daily sales against the chosen days of the same day of the year."""
    return ctes(
        LINES,
        DAY_SALES_CTE,
        seasonal(
            "day_sales",
            "period_start",
            "total_sales",
            f"""
  SELECT a.period_start, a.total_sales, AVG(CAST(b.total_sales AS DOUBLE)) AS mean,
         STDDEV_POP(CAST(b.total_sales AS DOUBLE)) AS sd
  FROM day_sales a LEFT JOIN day_sales b
       ON DAYOFYEAR(a.period_start) = DAYOFYEAR(b.period_start) AND {which}
  GROUP BY 1, 2""",
        ),
    ) + "SELECT * FROM anomalies"


Q["seasonal_anomaly_lookback"] = against(
    f"b.period_start >= {lit(fx.RETAIN_AS_OF)} - INTERVAL {fx.LOOKBACK_DAYS} DAY"
)
Q["seasonal_anomaly_other_years"] = against("a.period_start <> b.period_start")
Q["seasonal_anomaly"] = ctes(LINES, DAY_SALES_CTE, seasonal("day_sales", "period_start", "total_sales")) + """
SELECT * FROM anomalies"""
TRAILING_CTE = f"""
trailing_days AS (
  SELECT *, CASE WHEN avg_temperature - historical_avg > {fx.TRAILING_THRESHOLD} THEN 1 ELSE 0 END AS is_anomaly
  FROM (SELECT measurement_date, avg_temperature,
               ROUND(AVG(avg_temperature) OVER (ORDER BY measurement_date
                     RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS historical_avg
        FROM daily)
)"""
Q["trailing_baseline"] = ctes(READINGS, DAILY_CTE, TRAILING_CTE) + "SELECT * FROM trailing_days"
Q["trailing_sales"] = ctes(LINES, DAY_SALES_CTE) + f"""
SELECT *, CASE WHEN total_sales - historical_avg > {fx.SALES_THRESHOLD} THEN 1 ELSE 0 END AS is_anomaly
FROM (SELECT period_start AS measurement_date, total_sales,
             ROUND(AVG(CAST(total_sales AS DOUBLE)) OVER (ORDER BY period_start
                   RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS historical_avg
      FROM day_sales)"""
Q["sales_day_summary"] = ctes(LINES, DAY_SALES_CTE, seasonal("day_sales", "period_start", "total_sales")) + f"""
SELECT period_start AS measurement_date, total_sales, anomaly AS temperature_anomaly, severity,
       {flag(f'ABS(anomaly) > {fx.ANOMALY_LIMIT}')} AS significant_anomaly_alert,
       CAST(NULL AS INTEGER) AS daily_low_comfort_alert
FROM anomalies"""
Q["hot_day_count"] = ctes(READINGS, DAILY_CTE, TRAILING_CTE) + f"""
SELECT CAST(date_trunc('month', measurement_date) AS DATE) AS month_start, {big('SUM(is_anomaly)')} AS hot_days,
       COUNT(*) AS days
FROM trailing_days GROUP BY 1"""
NORMS_CTE = f"""
norms AS (
  SELECT ISODOW(CAST(reading_ts AS DATE)) AS weekday, {mean('temperature_2m')} AS climate_norm
  FROM readings GROUP BY 1
),
deviations AS (
  SELECT measurement_date, avg_temperature, climate_norm,
         avg_temperature - climate_norm AS temperature_anomaly
  FROM daily JOIN norms ON ISODOW(measurement_date) = weekday
)"""
Q["norm_deviation"] = ctes(READINGS, DAILY_CTE, NORMS_CTE) + "SELECT * FROM deviations"
WET_HOURS = "COUNT(DISTINCT HOUR(reading_ts)) FILTER (precipitation > 0)"
Q["daily_weather_reaveraged"] = ON_READINGS + f"""
SELECT measurement_date, ROUND(AVG(avg_temperature), 6) AS avg_temperature, ROUND(AVG(avg_humidity), 6) AS avg_humidity,
       ROUND(AVG(avg_wind_speed), 6) AS avg_wind_speed, {money('total_precipitation')} AS total_precipitation
FROM (SELECT CAST(reading_ts AS DATE) AS measurement_date, station_id, {DAILY_COLUMNS} FROM readings GROUP BY 1, 2)
GROUP BY 1"""
Q["precip_intensity"] = ON_READINGS + f"""
SELECT CAST(reading_ts AS DATE) AS measurement_date, {money('precipitation')} AS total_precipitation,
       {WET_HOURS} AS wet_hours, {ratio('SUM(precipitation)', WET_HOURS)} AS precip_intensity
FROM readings GROUP BY 1"""
Q["daily_stddev"] = ON_READINGS + """
SELECT CAST(reading_ts AS DATE) AS measurement_date,
       ROUND(STDDEV_POP(CAST(temperature_2m AS DOUBLE)), 6) AS temperature_stddev
FROM readings GROUP BY 1"""
Q["daily_extremes"] = ON_DAILY + f"""
SELECT measurement_date, min_temperature, max_temperature, {flag('max_temperature > 29.9')} AS hot_alert,
       {flag('min_temperature < -9.5')} AS cold_alert
FROM daily"""
Q["daily_weather_fact"] = ctes(READINGS, DAILY_CTE, NORMS_CTE) + f"""
SELECT measurement_date, daily.avg_temperature, avg_humidity, avg_wind_speed, total_precipitation,
       temperature_anomaly, {LINEAR.replace('avg_temperature', 'daily.avg_temperature')} AS comfort_index
FROM daily LEFT JOIN deviations USING (measurement_date)"""
SUMMARY = f"""
SELECT alerts.*, anomaly AS temperature_anomaly, severity, {flag('ABS(anomaly) > 5')} AS significant_anomaly_alert,
       daily_avg_comfort_index, daily_worst_comfort, daily_low_comfort_alert
FROM alerts
LEFT JOIN anomalies USING (measurement_date)
LEFT JOIN (SELECT measurement_date, ROUND(AVG(avg_comfort_index), 4) AS daily_avg_comfort_index,
                  ARG_MIN(worst_comfort_category, min_comfort_index) AS daily_worst_comfort,
                  MAX(low_comfort_alert) AS daily_low_comfort_alert
           FROM hours GROUP BY 1) USING (measurement_date)"""
WEATHER_CTES = (COMFORT, HOURS_CTE, DAILY_CTE, ALERTS_CTE, seasonal("daily", "measurement_date", "avg_temperature"))
Q["weather_summary"] = ctes(*WEATHER_CTES) + SUMMARY

# --- incremental refresh -------------------------------------------------------------------

Q["incremental_append"] = ON_READINGS + "SELECT * FROM readings"
Q["incremental_append_inclusive"] = "SELECT o_orderkey, o_custkey, o_orderdate FROM orders"
Q["incremental_upsert"] = ON_LINES + f"""
SELECT {KEY}, order_date,
       CAST(CASE WHEN order_date >= {lit(fx.BATCH_FROM)} THEN quantity + 100 ELSE quantity END AS INT) AS quantity
FROM lines
QUALIFY ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY order_date DESC, lines.quantity DESC) = 1"""
Q["partitioned_upsert"] = Q["incremental_upsert"]
Q["upsert_out_of_order"] = Q["incremental_upsert"]


def segments_loaded(late: str) -> str:
    mark = f"MAX(CASE WHEN {late} THEN {lit(fx.NEXT_LOAD_TS)} ELSE {lit(fx.LOAD_TS)} END) AS loaded_at"
    return ctes(LINES, SEGMENTS_CTE) + f"""
SELECT customer_id, total_spent, order_count, customer_segment, loaded_at
FROM segments JOIN (SELECT customer_id, {mark} FROM lines GROUP BY 1) USING (customer_id)"""


Q["incremental_aggregate"] = segments_loaded(f"order_date >= {lit(fx.FIRST_LOAD_UNTIL)}")
Q["incremental_same_day"] = segments_loaded("order_id % 3 = 0")
Q["incremental_late_rows"] = segments_loaded(f"order_date < {lit(fx.KNOWN_BEFORE)} OR customer_id % 5 = 0")
Q["partition_refresh"] = ON_LINES + f"""
SELECT region, YEAR(order_date) AS order_year, {money('sales')} AS total_sales, COUNT(*) AS line_count,
       CASE WHEN YEAR(order_date) = {fx.REFRESH_YEAR} THEN 2 ELSE 1 END AS load_no
FROM lines GROUP BY 1, 2, 5"""
Q["schema_guard"] = ON_READINGS + """
SELECT event_id, reading_ts, temperature_2m, relative_humidity_2m, wind_speed_10m, precipitation FROM readings"""


def model_rows(name: str, source: str, measure: str) -> str:
    return (
        f"SELECT '{name}' AS model, COUNT(*) AS row_count, CAST(SUM(CAST({measure} AS DECIMAL(22,2))) "
        f"AS DECIMAL(22,2)) AS total FROM {source}"
    )


RETAIL_MODELS = [
    ("stg_orders", "priced", "net_sales"),
    ("int_orders_enriched", "priced", "net_sales"),
    ("int_customer_metrics", "metrics", "total_spent"),
    ("int_customer_segments", "segments", "total_spent"),
    ("int_product_performance", "performance", "total_revenue"),
    ("int_regional_sales", "(SELECT region, month_start, SUM(net_sales) AS x FROM priced GROUP BY 1, 2)", "x"),
    (
        "int_geo_customers",
        "(SELECT ARG_MAX(COALESCE(latitude, 0), (order_date, customer_name, region, state)) AS x FROM lines LEFT JOIN "
        f"(VALUES {', '.join(f"('{k}', {lat})" for k, (lat, _) in fx.COORDINATES.items())}) AS places(region, latitude) "
        "USING (region) GROUP BY customer_id)",
        "x",
    ),
    ("int_group_totals", "(SELECT category, region, MONTH(order_date) AS m, SUM(sales) AS x FROM lines GROUP BY 1, 2, 3)", "x"),
    (
        "mart_orders_summary",
        "(SELECT SUM(sales) OVER (PARTITION BY category, region, MONTH(order_date)) AS x FROM lines)",
        "x",
    ),
    (
        "int_category_region_month",
        "(SELECT category, region, month_start, SUM(sales) AS x FROM priced GROUP BY 1, 2, 3)",
        "x",
    ),
    ("mart_sales_overview", "months", "total_sales"),
    ("mart_customer_segments", "clv", "total_spent"),
    (
        "mart_delivery_performance",
        f"(SELECT {STATUS} AS s, COUNT(*) AS x FROM priced WHERE days IS NOT NULL GROUP BY ROLLUP (1))",
        "x",
    ),
    ("mart_product_abc_analysis", "abc", "total_sales"),
    ("mart_top_products", "rankings", "metric_value"),
    ("mart_average_check", "(SELECT customer_segment, SUM(total_spent) AS x FROM segments GROUP BY 1)", "x"),
    (
        "mart_retention",
        "(SELECT order_month, COUNT(*) FILTER (before = CAST(order_month - INTERVAL 1 MONTH AS DATE)) AS x "
        "FROM steps GROUP BY 1)",
        "x",
    ),
    ("mart_clv", "clv_months", "customer_lifespan"),
    ("mart_profit", "(SELECT category, region, SUM(profit) AS x FROM lines GROUP BY 1, 2)", "x"),
]
RETAIL_CTES = (
    LINES, METRICS_CTE, SEGMENTS_CTE, PERFORMANCE_CTE, MONTHS_CTE, CLV_CTE, PRODUCT_SALES_CTE, ABC_CTE,
    f"\nrankings AS ({TWO_RANKINGS})", ACTIVE_CTE, CLV_MONTHS_CTE,
)
Q["layers_retail"] = ctes(*RETAIL_CTES) + "\nUNION ALL ".join(model_rows(*m) for m in RETAIL_MODELS)
Q["layers_retail_incremental"] = ctes(*RETAIL_CTES) + "\nUNION ALL ".join(
    model_rows(*m).replace(" FROM", ", CAST(0 AS BIGINT) AS differing_rows FROM", 1) for m in RETAIL_MODELS[1:]
)
WEATHER_MODELS = [
    ("stg_readings", "readings", "precipitation"),
    ("stg_weather_metrics", "readings", "precipitation"),
    ("int_daily_weather", "daily", "total_precipitation"),
    ("int_comfort_index", "comfort", "temperature_2m"),
    ("int_weather_anomalies", "anomalies", "anomaly"),
    ("int_norm_deviation", "deviations", "temperature_anomaly"),
    ("int_linear_comfort", f"(SELECT {LINEAR} AS x FROM daily)", "x"),
    ("mart_daily_metrics", "alerts", "total_precipitation"),
    ("mart_anomalies", f"(SELECT {flag(f'ABS(anomaly) > {fx.TRAILING_THRESHOLD}')} AS x FROM anomalies)", "x"),
    ("mart_comfort", "hours", "low_comfort_alert"),
    ("mart_trailing", "trailing_days", "is_anomaly"),
    ("mart_daily_fact", "daily", "total_precipitation"),
    ("mart_summary", "alerts", "total_precipitation"),
]
Q["layers_weather"] = ctes(*WEATHER_CTES, TRAILING_CTE, NORMS_CTE) + "\nUNION ALL ".join(
    model_rows(*m) for m in WEATHER_MODELS
)
Q["layers_weather_incremental"] = ctes(*WEATHER_CTES, TRAILING_CTE, NORMS_CTE) + "\nUNION ALL ".join(
    model_rows(*m).replace(" FROM", ", CAST(0 AS BIGINT) AS differing_rows FROM", 1) for m in WEATHER_MODELS
)
Q["top_products_snapshot"] = ctes(LINES, PRODUCT_SALES_CTE, f"\nrankings AS ({TWO_RANKINGS})") + f"""
SELECT rankings.*, analysis_date FROM rankings
CROSS JOIN (VALUES ({lit(fx.AS_OF)}), (CAST({lit(fx.AS_OF)} + INTERVAL 1 DAY AS DATE))) AS days(analysis_date)"""

# --- quality ---------------------------------------------------------------------------------


def checked(table: str, source: str, checks: list[tuple[str, str, str]]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{rule}' AS rule, "
        f"COUNT(*) FILTER ({failed}) AS failed_rows, COUNT(*) AS total_rows FROM {source}"
        for c, rule, failed in checks
    )


def missing(*columns: str) -> list[tuple[str, str, str]]:
    return [(c, "not_null", f"{c} IS NULL") for c in columns]


ORDER_CHECKS = missing("order_id", "customer_id", "order_date", "ship_date", "sales") + [
    ("segment", "accepted_values", f"segment NOT IN ({values(fx.SEGMENTS[:4])})"),
    ("delivery_status", "accepted_values", f"{STATUS} NOT IN ('Not Shipped', 'Fast', 'Standard', 'Slow')"),
    ("sales", "accepted_range", "sales < 0"),
    ("quantity", "accepted_range", "quantity NOT BETWEEN 1 AND 40"),
    ("discount", "accepted_range", "discount > 9000"),
    ("delivery_days", "accepted_range", "days NOT BETWEEN 0 AND 365"),
    ("profit", "positive", "profit <= 0"),
    ("order_date", "in_past", f"order_date > {lit(fx.BATCH_FROM)}"),
]
READING_CHECKS = missing("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation") + [
    ("temperature_2m", "accepted_range", "temperature_2m NOT BETWEEN -5 AND 25"),
    ("relative_humidity_2m", "accepted_range", "relative_humidity_2m NOT BETWEEN 0 AND 100"),
    ("wind_speed_10m", "positive", "wind_speed_10m <= 0"),
]
Q["dq_report"] = (
    ctes(LINES, READINGS)
    + checked("int_orders_enriched", "priced", ORDER_CHECKS)
    + " UNION ALL "
    + checked("stg_readings", "faulty", READING_CHECKS)
)


CUSTOMER_CHECKS = missing("customer_id", "total_orders", "total_spent") + [
    ("total_orders", "accepted_range", "total_orders < 1"),
    ("total_spent", "accepted_range", "total_spent < 0"),
    ("customer_tier", "accepted_values", "customer_tier NOT IN ('VIP', 'Frequent', 'High Value')"),
    ("customer_lifetime_days", "accepted_range", "customer_lifetime_days NOT BETWEEN 0 AND 2200"),
    ("total_profit", "positive", "total_profit <= 0"),
]
DAY_CHECKS = missing("measurement_date", "avg_temperature", "total_precipitation") + [
    ("avg_humidity", "accepted_range", "avg_humidity NOT BETWEEN 0 AND 100"),
    ("max_temperature", "accepted_range", "max_temperature > 29.95"),
    ("measurement_count", "positive", "measurement_count <= 0"),
]
Q["dq_marts"] = (
    ctes(LINES, METRICS_CTE, READINGS, DAILY_CTE)
    + checked("int_customer_metrics", "metrics", CUSTOMER_CHECKS)
    + " UNION ALL "
    + checked("int_daily_weather", "daily", DAY_CHECKS)
)


def repeated(table: str, source: str, keys: str, rule: str = "unique") -> str:
    return (
        f"SELECT '{table}' AS table_name, '{keys}' AS column_name, '{rule}' AS rule, "
        f"COUNT(*) FILTER (n > 1) AS failed_rows, {big('SUM(n)')} AS total_rows "
        f"FROM (SELECT COUNT(*) AS n FROM {source} GROUP BY {keys})"
    )


Q["dq_unique"] = ON_METRICS + " UNION ALL ".join(
    [
        repeated("orders", "orders", "o_orderkey"),
        repeated("lineitem", "lineitem", "l_orderkey"),
        repeated("int_customer_metrics", "metrics", "customer_id"),
    ]
)


def without_parent(child: str, key: str, parent: str, parent_key: str) -> str:
    return (
        f"SELECT '{child}' AS table_name, '{key}' AS column_name, 'in {parent}' AS rule, "
        f"COUNT(*) FILTER ({key} IS NULL OR {key} NOT IN (SELECT {parent_key} FROM {parent})) AS failed_rows, "
        f"COUNT(*) AS total_rows FROM {child}"
    )


Q["dq_orphans"] = " UNION ALL ".join(
    without_parent(*x)
    for x in (
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
    )
)
Q["dq_unique_combo"] = ON_LINES + " UNION ALL ".join(
    repeated("order_lines", "lines", keys, "unique_combination")
    for keys in ("order_id, product_id", "order_id, line_no", KEY)
)
Q["dq_numeric"] = (
    checked("events", "events", [("value", "numeric", "FALSE")])
    + " UNION ALL "
    + checked(
        "events",
        "(SELECT json_extract_string(props, '$.k') AS k FROM events)",
        [("k", "numeric", "TRY_CAST(k AS DOUBLE) IS NULL AND k IS NOT NULL")],
    )
    + " UNION ALL "
    + checked(
        "orders",
        "orders",
        [
            ("o_totalprice", "numeric", "FALSE"),
            (
                "o_orderpriority",
                "numeric",
                "TRY_CAST(o_orderpriority AS DOUBLE) IS NULL AND o_orderpriority IS NOT NULL",
            ),
        ],
    )
)

# --- metrics, alerts, cards ------------------------------------------------------------------

VALUES_CTE = f"""
vals AS (
  SELECT 'avg_delivery_days' AS metric, 'all' AS period, {mean('days')} AS value FROM priced
  UNION ALL
  SELECT 'return_rate', 'all', {ratio(RETURNED, 'COUNT(DISTINCT order_id)')} FROM lines
  UNION ALL
  SELECT 'avg_clv', 'all', ROUND(AVG(clv), 4) FROM clv_months
  UNION ALL
  SELECT 'conversion_rate', 'all', {ratio(BUYS, VIEWS)} FROM events
  UNION ALL
  SELECT 'retention_crr', CAST(order_month AS VARCHAR), crr / 100 FROM crr
)"""
METRIC_CTES = (LINES, CLV_MONTHS_CTE, ACTIVE_CTE, CRR_CTE, VALUES_CTE)
Q["metric_targets"] = ctes(*METRIC_CTES) + """
SELECT metric, period, value, target,
       CASE WHEN higher AND value >= target OR NOT higher AND value <= target THEN 'met'
            WHEN value IS NOT NULL THEN 'missed' END AS status
FROM vals JOIN (
  VALUES ('retention_crr', CAST(0.7 AS DOUBLE), TRUE), ('avg_clv', 500, TRUE), ('avg_delivery_days', 3, FALSE),
         ('return_rate', 0.05, FALSE), ('conversion_rate', 0.2, TRUE)) AS goals(metric, target, higher) USING (metric)"""


def fired(metric: str, op: str, limit, message: str, source: str) -> str:
    return (
        f"SELECT metric, period, value, '{op}' AS op, CAST({limit} AS DOUBLE) AS limit_value, '{message}' AS message "
        f"FROM {source} WHERE metric = '{metric}' AND value {op} {limit}"
    )


def per_day(metric: str, c: str) -> str:
    return f"(SELECT '{metric}' AS metric, CAST(measurement_date AS VARCHAR) AS period, {c} AS value FROM daily)"


HOT, DAMP, WINDY = (
    per_day(f"daily_{m}", c)
    for m, c in (("temperature", "avg_temperature"), ("humidity", "avg_humidity"), ("wind", "avg_wind_speed"))
)
Q["metric_alerts"] = ctes(*METRIC_CTES, READINGS, DAILY_CTE) + "\nUNION ALL ".join(
    [
        fired("retention_crr", "<", 0.5, "sales management", "vals"),
        fired("avg_clv", "<", 300, "marketing", "vals"),
        fired("avg_delivery_days", ">", 5, "logistics", "vals"),
        fired("return_rate", ">", 0.1, "quality control", "vals"),
        fired("conversion_rate", "<", 0.2, "sales management", "vals"),
        fired("daily_temperature", ">", fx.DAILY_LIMITS["temperature"], "weather desk", HOT),
        fired("daily_temperature", "<=", 6, "weather desk", HOT),
        fired("daily_humidity", ">", fx.DAILY_LIMITS["humidity"], "weather desk", DAMP),
        fired("daily_wind", ">=", fx.DAILY_LIMITS["wind"], "weather desk", WINDY),
    ]
)
Q["card_scalar"] = ON_LINES + f"SELECT {money('sales')} AS total_sales FROM lines"
Q["card_line"] = ON_LINES + f"SELECT month_start AS month, {money('sales')} AS total_sales FROM priced GROUP BY 1"
Q["card_bar"] = ON_LINES + f"SELECT region, {mean('sales')} AS avg_sales FROM lines GROUP BY 1"
Q["card_pie"] = ON_LINES + f"""
SELECT segment, {money('sales')} AS total_sales, {ratio('SUM(sales)', 'SUM(SUM(sales)) OVER ()')} AS share
FROM lines GROUP BY 1"""
Q["card_table"] = ON_LINES + f"""
SELECT customer_id, {money('sales')} AS total_sales FROM lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""

# --- streams ---------------------------------------------------------------------------------

Q["stream_append"] = Q["append_load"]
Q["stream_upsert"] = ON_READINGS + """
SELECT station_id, reading_ts, event_id, temperature_2m FROM readings
QUALIFY ROW_NUMBER() OVER (PARTITION BY station_id ORDER BY reading_ts DESC, event_id DESC) = 1"""
Q["stream_daily_weather"] = ON_DAILY + """
SELECT measurement_date, avg_temperature, min_temperature, max_temperature, total_precipitation, measurement_count
FROM daily"""
Q["stream_upsert_out_of_order"] = Q["stream_upsert"]

# --- loads that merge, estimates, counts on the way ------------------------------------------

Q["merge_on_read"] = Q["merge_on_read_compacted"] = Q["incremental_upsert"]
Q["dq_observed"], Q["dq_unique_hashed"], Q["sql_comfort"] = Q["dq_report"], Q["dq_unique"], Q["comfort_index"]
Q["interleaved_write"] = ON_LINES + f"SELECT {KEY}, customer_id, order_date FROM lines"
Q["stream_dedupe"] = Q["append_load"]
Q["expire_rows"] = ON_READINGS + f"""
SELECT event_id, reading_ts, strftime(reading_ts, '%Y%m') AS month FROM readings
WHERE CAST(reading_ts AS DATE) > {lit(fx.EXPIRE_AS_OF)} - {fx.EXPIRE_DAYS}"""
Q["unique_customers_sketch"] = ON_LINES + """
SELECT month_start AS period_start, COUNT(DISTINCT customer_id) AS unique_customers,
       COUNT(DISTINCT order_id) AS total_orders, TRUE AS customers_near, TRUE AS orders_near
FROM priced GROUP BY 1"""
Q["incremental_states"] = ON_LINES + f"""
, corrected AS (
  SELECT *, YEAR(order_date) AS order_year, YEAR(order_date) = {fx.REFRESH_YEAR} AND order_id % 7 = 0 AS wrong FROM lines)
SELECT region, order_year, CAST(SUM(CASE WHEN wrong THEN quantity + 100 ELSE quantity END) AS BIGINT) AS quantity,
       {money('sales')} AS sales, MIN(order_date) AS first_date, MAX(order_date) AS last_date,
       MAX(CASE WHEN wrong THEN {lit(fx.CORRECTED_TS)} WHEN order_date >= {lit(fx.FIRST_LOAD_UNTIL)}
                THEN {lit(fx.NEXT_LOAD_TS)} ELSE {lit(fx.LOAD_TS)} END) AS loaded_at,
       COUNT(DISTINCT order_id) AS total_orders, COUNT(DISTINCT customer_id) AS unique_customers
FROM corrected GROUP BY 1, 2"""


def shipped(unit: str, names: tuple[str, str, str]) -> str:
    return f"""
  SELECT date_trunc('{unit}', ship_date) AS {unit}_start, {money('net_sales')} AS {names[0]}, {money('profit')} AS {names[1]},
         COUNT(DISTINCT order_id) AS {names[2]}, COUNT(DISTINCT supplier_id) AS {unit}_suppliers
  FROM priced WHERE ship_date IS NOT NULL GROUP BY 1"""


Q["shipments_overview"] = ON_LINES + f"""
, m AS ({shipped('month', ('total_sales', 'total_profit', 'total_orders'))}),
q AS ({shipped('quarter', ('quarterly_sales', 'quarterly_profit', 'quarterly_orders'))}),
y AS ({shipped('year', ('yearly_sales', 'yearly_profit', 'yearly_orders'))})
SELECT CAST(month_start AS DATE) AS month_start, YEAR(month_start) AS year, QUARTER(month_start) AS quarter,
       MONTH(month_start) AS month, total_sales, total_profit, total_orders, month_suppliers AS unique_customers,
       quarterly_sales, quarterly_profit, quarterly_orders, yearly_sales, yearly_profit, yearly_orders,
       {ratio('total_profit', 'total_sales')} AS profit_margin, {ratio('total_sales', 'total_orders')} AS avg_order_value
FROM m JOIN q ON quarter_start = date_trunc('quarter', month_start) JOIN y ON year_start = date_trunc('year', month_start)"""

BROKEN = "EXTRACT(day FROM reading_ts) % 5 = 0"
MEASURES = ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation")
Q["api_variant_rows"] = ON_READINGS + f"""
, hourly AS (
  SELECT date_trunc('hour', reading_ts) AS reading_ts, {', '.join(f"{mean(m)} AS {m}" for m in MEASURES)}
  FROM readings WHERE NOT {BROKEN} GROUP BY 1
), whole AS (
  {' UNION ALL '.join(f"SELECT reading_ts, '{m}' AS measure, {m} AS value FROM hourly" for m in MEASURES)}
), placed AS (
  SELECT reading_ts, ROW_NUMBER() OVER (PARTITION BY CAST(reading_ts AS DATE) ORDER BY reading_ts) AS place FROM hourly
)
SELECT * FROM whole UNION ALL
SELECT reading_ts, 'pressure_msl', CASE WHEN n = 1 THEN CAST(1000.5 AS DOUBLE) END
FROM (SELECT DISTINCT CAST(reading_ts AS DATE) AS day FROM hourly) CROSS JOIN (VALUES (1), (2), (3)) AS numbers(n)
LEFT JOIN placed ON place = n AND CAST(reading_ts AS DATE) = day
UNION ALL
SELECT NULL, 'malformed documents', CAST(COUNT(DISTINCT CAST(reading_ts AS DATE)) AS DOUBLE) FROM readings WHERE {BROKEN}"""


def watched(batch: int, part: str) -> str:
    rules = [(c, "not_null", f"{c} IS NULL") for c in ("event_id", *MEASURES)]
    rules += [("temperature_2m", "accepted_range", "temperature_2m < -5 OR temperature_2m > 25"), ("wind_speed_10m", "positive", "wind_speed_10m <= 0")]
    return " UNION ALL ".join(
        f"SELECT CAST({batch} AS BIGINT) AS batch_id, 'readings' AS table_name, '{c}' AS column_name, '{rule}' AS rule, "
        f"COUNT(*) FILTER ({failed}) AS failed_rows, COUNT(*) AS total_rows, COUNT(*) AS written_rows FROM readings WHERE reading_ts {part}"
        for c, rule, failed in rules
    )


Q["stream_checked"] = ON_READINGS + watched(0, f"< {lit(fx.HALF_TIME)}") + " UNION ALL " + watched(1, f">= {lit(fx.HALF_TIME)}")

LAYER_ORDER_CHECKS = missing("order_id", "product_id", "customer_id") + [
    ("delivery_days", "accepted_range", "days NOT BETWEEN 0 AND 365"),
    ("delivery_status", "accepted_values", f"{STATUS} NOT IN ('Not Shipped', 'Fast', 'Standard', 'Slow')"),
    ("order_size_category", "accepted_values", "FALSE"),  # every number has a size and a margin class
    ("profitability_category", "accepted_values", "FALSE"),
]
LAYER_CUSTOMER_CHECKS = missing("customer_id", "total_orders", "total_spent") + [
    ("total_orders", "accepted_range", "total_orders < 1"),
    ("total_spent", "accepted_range", "total_spent < 0"),
    ("customer_tier", "accepted_values", "customer_tier NOT IN ('VIP', 'Frequent', 'High Value', 'Regular')"),
    ("customer_lifetime_days", "accepted_range", "customer_lifetime_days < 0"),
]
LAYER_DAY_CHECKS = missing("measurement_date", "avg_temperature", "total_precipitation") + [
    ("avg_humidity", "accepted_range", "avg_humidity NOT BETWEEN 0 AND 100"),
    ("measurement_count", "positive", "measurement_count <= 0"),
]
FAULTY_DAYS = """
faulty_days AS (
  SELECT CAST(reading_ts AS DATE) AS measurement_date, AVG(temperature_2m) AS avg_temperature,
         AVG(relative_humidity_2m) AS avg_humidity, SUM(precipitation) AS total_precipitation, COUNT(*) AS measurement_count
  FROM faulty WHERE COALESCE(temperature_2m, relative_humidity_2m, wind_speed_10m, precipitation) IS NOT NULL GROUP BY 1
)"""
Q["layers_quality"] = (
    ctes(LINES, METRICS_CTE, READINGS, FAULTY_DAYS)
    + checked("int_orders_enriched", "priced", LAYER_ORDER_CHECKS)
    + " UNION ALL "
    + checked("int_customer_metrics", "metrics", LAYER_CUSTOMER_CHECKS)
    + " UNION ALL "
    + checked("int_daily_weather", "faulty_days", LAYER_DAY_CHECKS)
)
