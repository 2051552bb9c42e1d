"""Input views over the driver's tables, as one SQL text for Spark and DuckDB.

The texts are those of FIXTURES.md with the source table left open.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

# Fixed value: the clock of every registered query.
AS_OF = datetime(2024, 1, 30, 23, 59, 59)

SOURCES = {
    "app_events": "events",
    "subscription_events": "orders",
    "profiles": "customer",
    "search_rows": "pages",
    "reviews": "documents",
    "issue_events": "events",
    "geo_ranges": None,
}

TEXTS = {}

TEXTS["app_events"] = """
WITH b AS (
  SELECT e.*, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {source} e
  WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' + CAST(user_id % 20 AS INT) * INTERVAL '1' DAY
    AND NOT (user_id % 6 = 0 AND ts >= TIMESTAMP '2024-01-22 00:00:00')
)
SELECT event_id AS id,
  CASE event_type
    WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'app_opened' WHEN event_id % 4 = 1 THEN 'camera_opened'
                          WHEN event_id % 4 = 2 AND user_id % 2 = 0 THEN 'paywall_viewed' ELSE 'gallery_viewed' END
    WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'photo_deleted' WHEN event_id % 4 = 1 AND user_id % 3 <> 0 THEN 'scan_started'
                           WHEN event_id % 4 = 2 AND user_id % 3 <> 0 THEN 'scan_completed' ELSE 'photo_captured' END
    WHEN 'purchase' THEN CASE WHEN user_id % 4 = 0 AND event_id % 3 = 0 THEN 'purchase_completed'
                              WHEN user_id % 4 = 0 AND event_id % 3 = 1 THEN 'subscription_started'
                              WHEN user_id % 4 <= 1 THEN 'purchase_started' ELSE 'share_initiated' END
    WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'permission_result' WHEN event_id % 3 = 1 THEN 'feature_toggled' ELSE 'icloud_backup_toggled' END
    ELSE CASE WHEN event_id % 2 = 0 THEN 'widget_clicked' ELSE 'shortcut_tapped' END
  END AS name,
  CASE event_type WHEN 'view' THEN 'navigation' WHEN 'click' THEN 'camera' WHEN 'purchase' THEN 'monetization' ELSE 'engagement' END AS category,
  concat('{"source":', CASE k % 3 WHEN 0 THEN '"app"' WHEN 1 THEN '"widget"' ELSE 'null' END,
    CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN ',"delete_schedule":"7_days"' WHEN 2 THEN ',"delete_schedule":"30_days"' ELSE ',"delete_schedule":"never"' END,
    ',"spam_type":"', CASE k % 2 WHEN 0 THEN 'camera' ELSE 'screenshot' END,
    '","was_manual":', CASE k % 2 WHEN 0 THEN 'true' ELSE 'false' END,
    ',"feature":"f', CAST(k % 4 AS STRING),
    '","enabled":', CASE WHEN k % 3 = 0 THEN 'false' ELSE 'true' END,
    ',"granted":"', CASE WHEN k % 4 = 0 THEN 'false' ELSE 'true' END,
    '","date_range":"', CASE k % 6 WHEN 0 THEN '7days' WHEN 1 THEN '30days' WHEN 2 THEN '6months' WHEN 3 THEN 'all' WHEN 4 THEN 'custom' ELSE 'odd' END,
    '","duration_ms":', CAST(k * 10 AS STRING), ',"photos_scanned":', CAST(k * 7 AS STRING),
    ',"photos_classified":', CAST(k AS STRING), ',"revenue":', CAST(CAST(value AS DECIMAL(10,2)) AS STRING),
    ',"tier":"', CASE WHEN user_id % 8 = 0 THEN 'max' ELSE 'pro' END,
    '","billing_period":"', CASE WHEN k % 2 = 0 THEN 'monthly' ELSE 'yearly' END, '"}') AS properties,
  ts AS event_ts,
  CASE WHEN user_id % 5 = 0 THEN NULL WHEN event_id % 23 = 0 THEN concat('w', CAST(user_id AS STRING)) ELSE concat('u', CAST(user_id AS STRING)) END AS user_id,
  concat('d', CAST(user_id AS STRING)) AS device_id,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('d', CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) END AS session_id,
  k * 6 AS session_duration_seconds,
  concat('2.', CAST((user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 4 AS STRING)) AS app_version, 'ios' AS platform,
  concat('17.', CAST((user_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) % 5 AS STRING)) AS os_version,
  concat('iPhone', CAST(12 + (user_id + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) % 4 AS STRING)) AS device_model,
  CASE (user_id + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) % 5 WHEN 0 THEN 'en_US' WHEN 1 THEN 'fr_FR' WHEN 2 THEN 'de' WHEN 3 THEN 'pt_BR' ELSE NULL END AS locale,
  CASE user_id % 3 WHEN 0 THEN 'Europe/Paris' WHEN 1 THEN 'America/New_York' ELSE NULL END AS timezone,
  CASE (user_id + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'FR' WHEN 2 THEN 'DE' ELSE NULL END AS country,
  concat('10.', CAST(user_id % 8 AS STRING), '.', CAST(k AS STRING), '.', CAST(event_id % 250 AS STRING)) AS ip_address,
  ts + k * INTERVAL '1' MINUTE AS created_at
FROM b
"""

TEXTS["subscription_events"] = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 6 WHEN 0 THEN 'INITIAL_PURCHASE' WHEN 1 THEN 'RENEWAL' WHEN 2 THEN 'CANCELLATION' WHEN 3 THEN 'EXPIRATION' WHEN 4 THEN 'INITIAL_PURCHASE' ELSE 'PRODUCT_CHANGE' END AS event_type,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('alias', CAST(o_custkey AS STRING)) ELSE concat('d', CAST(o_custkey AS STRING)) END AS app_user_id,
  concat('d', CAST(o_custkey AS STRING)) AS original_app_user_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'pro_monthly' WHEN '2-HIGH' THEN 'pro_yearly' WHEN '3-MEDIUM' THEN 'MAX_monthly' WHEN '4-NOT SPECIFIED' THEN 'max_yearly' ELSE 'lifetime' END AS product_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'MONTHLY' WHEN 1 THEN 'ANNUAL' WHEN 2 THEN 'TRIAL' ELSE NULL END AS period_type,
  CASE WHEN o_orderstatus = 'P' THEN 'SANDBOX' ELSE 'PRODUCTION' END AS environment,
  o_orderkey % 9 = 0 AS is_trial_conversion,
  CAST(o_totalprice AS DECIMAL(12,2)) AS price, 'USD' AS currency,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(70 + (o_orderkey % 3) * 5 AS DECIMAL(5,2)) END AS takehome_percentage,
  TIMESTAMP '2023-12-01 00:00:00' + CAST(o_orderkey % 61 AS INT) * INTERVAL '1' DAY + CAST(o_orderkey % 1440 AS INT) * INTERVAL '1' MINUTE AS created_at
FROM {source}
"""

TEXTS["profiles"] = """
SELECT concat('d', CAST(c_custkey AS STRING)) AS device_id,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('c', CAST(c_custkey AS STRING), '@example.com') END AS email,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN concat('(212) 867-', CAST(1000 + c_custkey % 9000 AS STRING)) ELSE concat('+4420 7946 ', CAST(1000 + c_custkey % 9000 AS STRING)) END AS phone,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'free' WHEN 'BUILDING' THEN 'pro' WHEN 'MACHINERY' THEN 'max' ELSE NULL END AS subscription_tier,
  c_custkey % 4 = 0 AS opted_in_marketing
FROM {source}
"""

TEXTS["search_rows"] = """
SELECT CASE page_id % 3 WHEN 0 THEN 'query' WHEN 1 THEN 'page' ELSE 'device' END AS dim,
  url AS key, CAST(DATE '2024-01-01' + CAST(page_id % 28 AS INT) AS DATE) AS date,
  page_id % 17 AS clicks, page_id % 17 + (page_id * 7) % 101 AS impressions,
  CAST(page_id % 17 AS DOUBLE) / CAST(page_id % 17 + (page_id * 7) % 101 + 1 AS DOUBLE) AS ctr,
  CAST(page_id % 40 AS DOUBLE) / 4 + 1 AS position
FROM {source}
"""

TEXTS["reviews"] = """
SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 5 + 1 AS INT) END AS rating,
  lang AS territory, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS created_date FROM {source}
"""

TEXTS["issue_events"] = """
SELECT event_id AS id, user_id % 12 AS issue_id, CASE user_id % 4 WHEN 0 THEN 'fatal' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS level,
  ts AS event_ts, value FROM {source} WHERE event_type = 'error'
"""

TEXTS["geo_ranges"] = """
SELECT CAST(167772160 + n * 65536 AS BIGINT) AS lo, CAST(167772160 + n * 65536 + 65535 AS BIGINT) AS hi, c AS country
FROM (VALUES (0, 'US'), (1, 'FR'), (2, 'DE'), (4, 'GB'), (5, 'US'), (6, 'JP')) t(n, c)
"""


def view_sql(name: str, relation: str | None = None) -> str:
    """The text of a view over ``relation``, by default the table's own name."""
    return TEXTS[name].replace("{source}", relation or SOURCES[name] or "")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the parquet files of ``sf_dir``."""
    source = SOURCES[name]
    relation = f"parquet.`{sf_dir.rstrip('/')}/{source}.parquet`" if source else None
    return spark.sql(view_sql(name, relation))


def with_views(body: str, *names: str) -> str:
    """A query over the views, with their texts in a leading WITH clause."""
    texts = ",\n".join(f"{name} AS ({view_sql(name)})" for name in names)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {texts},\n{body[5:]}"
    return f"WITH {texts}\n{body}"
