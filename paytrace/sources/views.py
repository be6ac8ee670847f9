"""Transfer tables derived from the sample parquet tables.

The sample tables hold no transfers, so each view maps a whole table to the transfer schema. The same
text, in DuckDB's dialect, stands in ``paytrace.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import prepare

TX_EVENTS = """
SELECT concat('TX_', event_id) AS transaction_id,
       concat('U', user_id) AS sender_id,
       concat('U', abs(user_id + CAST(get_json_object(props, '$.k') AS BIGINT) % 20 - 10)) AS receiver_id,
       CAST(round(value * 200, 2) AS DECIMAL(18,4)) AS amount,
       1704067200 + (unix_micros(CAST(ts AS TIMESTAMP)) div 1000000 - 1704067200) div 8 AS t,
       CASE event_type WHEN 'click' THEN 'send_money' WHEN 'view' THEN 'payment'
            WHEN 'signup' THEN 'cash_in' WHEN 'purchase' THEN 'cash_out'
            ELSE 'inward_remittance' END AS tx_type,
       CASE WHEN event_id % 97 = 0 THEN 'Zone-13'
            ELSE concat('Zone-', lpad(CAST(user_id % 12 + 1 AS STRING), 2, '0')) END AS location,
       concat('DEV-', user_id, CASE WHEN event_id % 97 = 0 THEN '-X' ELSE '-1' END) AS device_id,
       event_id AS row_index
FROM {events}
"""

TX_LINEITEM = """
SELECT concat('L_', l_orderkey, '_', l_linenumber, '_', l_partkey) AS transaction_id,
       CASE WHEN l_returnflag = 'R' THEN concat('MERCH_', l_suppkey) ELSE concat('C_', o_custkey) END AS sender_id,
       CASE WHEN l_returnflag = 'R' THEN concat('C_', o_custkey) ELSE concat('MERCH_', l_suppkey) END AS receiver_id,
       CAST(l_extendedprice AS DECIMAL(18,4)) AS amount,
       unix_micros(CAST(l_shipdate AS TIMESTAMP)) div 1000000 AS t
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

# One wallet per user and day, paying inside a block of six: many small components.
TX_DAILY = """
SELECT concat('TX_', event_id) AS transaction_id,
       concat('U', user_id, '_', d) AS sender_id,
       concat('U', user_id div 6 * 6 + k % 6, '_', d) AS receiver_id,
       CAST(round(value * 200, 2) AS DECIMAL(18,4)) AS amount,
       unix_micros(CAST(ts AS TIMESTAMP)) div 1000000 AS t
FROM (SELECT *, CAST(get_json_object(props, '$.k') AS BIGINT) AS k,
             unix_micros(CAST(ts AS TIMESTAMP)) div 86400000000 AS d FROM {events})
"""

# Scored and labelled items for the evaluation operators.
SCORES = """
SELECT lang AS network_id, concat('D', doc_id) AS account_id, CAST(toxic AS INT) AS y,
       CAST(n_chars AS DOUBLE) AS score, quality = 0 AS alert, source AS typology
FROM {labels} JOIN {documents} USING (doc_id)
"""


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _view(spark: SparkSession, folder: str, text: str, *tables: str) -> DataFrame:
    return prepare(spark).sql(text, **{name: _table(spark, folder, name) for name in tables})


def tx_events_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a transfer, self transfers included."""
    return _view(spark, folder, TX_EVENTS, "events")


def tx_events(spark: SparkSession, folder: str) -> DataFrame:
    return tx_events_raw(spark, folder).where("sender_id <> receiver_id").drop("row_index")


def tx_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, TX_LINEITEM, "lineitem", "orders")


def tx_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, TX_DAILY, "events").where("sender_id <> receiver_id")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, SCORES, "labels", "documents")

# Text-typed raw transfers with the faults validation looks for.
TX_RAW = """
SELECT event_id AS row_index,
       CASE WHEN event_type = 'signup' THEN concat('TX_', event_id div 2)
            WHEN value < 1 THEN '  ' ELSE concat('TX_', event_id) END AS transaction_id,
       CASE WHEN value < 0.5 THEN NULL WHEN value < 0.8 THEN '   ' ELSE concat(' U', user_id, ' ') END AS sender_id,
       CASE WHEN value > 300 THEN NULL ELSE concat('U', abs(user_id + k % 20 - 10)) END AS receiver_id,
       CASE WHEN event_type <> 'error' THEN v
            WHEN value < 10 THEN 'NaN' WHEN value < 20 THEN 'Infinity' WHEN value < 30 THEN concat('-', v)
            WHEN value < 35 THEN '0' WHEN value < 40 THEN 'abc'
            WHEN value < 42 THEN '5d' WHEN value < 44 THEN '7f' WHEN value < 46 THEN '0x1p3' WHEN value < 48 THEN '1_000' WHEN value > 200 THEN '5e9' ELSE v END AS amount,
       CASE WHEN event_type = 'click' AND value < 5 THEN 'not-a-date'
            WHEN event_type = 'click' THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss')
            WHEN event_type = 'view' THEN concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z')
            WHEN event_type = 'signup' THEN concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '+06:00')
            WHEN event_type = 'purchase' THEN CAST(unix_micros(CAST(ts AS TIMESTAMP)) div 1000000 AS STRING)
            ELSE date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") END AS timestamp,
       CASE WHEN value < 2 THEN 'nan' ELSE concat(' ', event_type, char(7)) END AS tx_type,
       CASE WHEN value < 4 THEN '' ELSE concat('Zone-', user_id % 12) END AS location,
       repeat(concat('D', user_id), 30) AS device_id
FROM (SELECT *, CAST(get_json_object(props, '$.k') AS BIGINT) AS k,
             CAST(CAST(round(value * 200, 2) AS DECIMAL(18,2)) AS STRING) AS v FROM {events})
"""


def tx_raw(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, TX_RAW, "events")
