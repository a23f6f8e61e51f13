"""A dirty contacts table derived from ``customer``.

One SQL text that Spark and DuckDB evaluate alike, so checks can run both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = """
WITH base AS (
  SELECT c_custkey AS k, c_mktsegment AS seg, c_custkey AS rid FROM customer
  UNION ALL
  SELECT c_custkey AS k, c_mktsegment AS seg, c_custkey + 1000000000 AS rid
  FROM customer WHERE c_custkey % 50 = 0
)
SELECT
  rid AS _row_id,
  concat('Customer ', CAST(k AS STRING)) AS name,
  CASE WHEN k % 10 = 1 THEN NULL
       WHEN k % 9 = 0 THEN concat('  USER', CAST(k AS STRING), '@Example.COM ')
       WHEN k % 23 = 0 THEN concat('user', CAST(k AS STRING), '-at-example')
       ELSE concat('user', CAST(k AS STRING), '@example.com') END AS email,
  CASE WHEN k % 19 = 0 THEN '555-123'
       WHEN k % 3 = 0 THEN concat('(', CAST(200 + k % 700 AS STRING), ') 555-', lpad(CAST(k % 10000 AS STRING), 4, '0'))
       WHEN k % 3 = 1 THEN concat('+1 ', CAST(200 + k % 700 AS STRING), '.555.', lpad(CAST(k % 10000 AS STRING), 4, '0'))
       ELSE concat(CAST(200 + k % 700 AS STRING), '555', lpad(CAST(k % 10000 AS STRING), 4, '0')) END AS phone,
  CASE WHEN k % 11 = 0 THEN lower(seg)
       WHEN k % 13 = 0 THEN concat(' ', seg, ' ')
       WHEN k % 17 = 0 THEN concat(seg, 'S')
       ELSE seg END AS segment,
  CASE k % 4
       WHEN 0 THEN concat('2024-', lpad(CAST(1 + k % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + k % 28 AS STRING), 2, '0'))
       WHEN 1 THEN concat(CAST(1 + k % 28 AS STRING), '/', CAST(1 + k % 12 AS STRING), '/2024')
       WHEN 2 THEN concat(lpad(CAST(1 + k % 28 AS STRING), 2, '0'), '.', lpad(CAST(1 + k % 12 AS STRING), 2, '0'), '.2024')
       ELSE concat('2024/', lpad(CAST(1 + k % 12 AS STRING), 2, '0'), '/', lpad(CAST(1 + k % 28 AS STRING), 2, '0')) END AS joined,
  CASE WHEN k % 7 = 0 THEN NULL
       ELSE concat('$', CAST(1 + k % 900 AS STRING), ',', lpad(CAST((k * 37) % 1000 AS STRING), 3, '0'), '.50') END AS balance,
  CASE k % 8 WHEN 0 THEN 'NULL' WHEN 1 THEN '  ' WHEN 2 THEN ' nan' WHEN 3 THEN NULL WHEN 4 THEN '=1+1' ELSE 'ok' END AS note,
  CAST(NULL AS STRING) AS fax
FROM base
"""
COLUMNS = ("name", "email", "phone", "segment", "joined", "balance", "note", "fax")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    # A file of few bytes a row is read by one or two tasks, and all that is done with the texts would stay in them.
    customer = customer.repartition(max(8, spark.sparkContext.defaultParallelism), "c_custkey")
    return spark.sql(SQL.replace("FROM customer", "FROM {customer}"), customer=customer)
