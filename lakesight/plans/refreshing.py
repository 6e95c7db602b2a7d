"""Registered queries: rollups and pages that follow the edits of a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakesight.operators import runsketches as K
from lakesight.plans.batch import EDITS_SQL, ORDER_SALES_SQL, customer_edits, order_sales
from lakesight.plans.refresh import refreshed_parts
from lakesight.plans.registry import Registry
from lakesight.plans.retail import SUM_PRICE
from lakesight.session import scratch_folder
from lakesight.sources import ranges, tables as S
from lakesight.sources.store import TableStore

refreshing = Registry()

PAGE, OFFSETS = 40, (0, 1000, 9000)


def edits(spark: SparkSession, folder: str):
    """Rounds of edits: whole rows under known and new keys, deleted keys, dearer orders."""
    customers = S.table(spark, folder, "customer")
    dearer = order_sales(spark, folder).where("CAST(id AS BIGINT) % 50 = 1")
    yield customer_edits(spark, folder), False
    yield customers.select((F.col("c_custkey") * 30).cast("string").alias("id")), True
    yield dearer.withColumn("price", (F.col("price") + 1000).cast("decimal(18,2)")), False


EDITED_SQL = f"""
orders_ AS ({ORDER_SALES_SQL}), puts AS ({EDITS_SQL}), gone AS (SELECT CAST(c_custkey * 30 AS VARCHAR) AS id FROM customer),
dearer AS (SELECT * REPLACE (CAST(price + 1000 AS DECIMAL(18,2)) AS price) FROM orders_ WHERE CAST(id AS BIGINT) % 50 = 1),
first_ AS (SELECT * FROM orders_ WHERE id NOT IN (SELECT id FROM puts) UNION ALL SELECT * FROM puts),
second_ AS (SELECT * FROM first_ WHERE id NOT IN (SELECT id FROM gone)),
edited AS (SELECT * FROM second_ WHERE id NOT IN (SELECT id FROM dearer) UNION ALL SELECT * FROM dearer)"""


def edited_store(spark: SparkSession, folder: str, between=lambda store: None) -> TableStore:
    """Orders with all edits; ``between`` sees the table before the first edit and before the last."""
    store = TableStore(spark, scratch_folder(spark, "refreshed"))
    ranges.write_ranged(store, "sales_raw", order_sales(spark, folder))
    rounds = list(edits(spark, folder))
    for number, (rows, delete) in enumerate(rounds):
        if number in (0, len(rounds) - 1):
            between(store)
        store.edit("sales_raw", rows, delete=delete)
    return store


@refreshing.register(f"""
WITH {EDITED_SQL}
SELECT brand, fridge_model, feedback_sentiment_category, count(*) AS n, {SUM_PRICE} AS revenue, min(price) AS low, max(price) AS high
FROM edited GROUP BY ALL""")
def incremental_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Partials per brand, model and sentiment, brought up to date between rounds of edits from the changed rows alone."""
    store = edited_store(spark, folder, refreshed_parts)
    return refreshed_parts(store).models.drop("negative", "positive")


@refreshing.register(f"""
WITH {EDITED_SQL}, numbered AS (SELECT id, brand, price, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS total FROM edited)
SELECT id, brand, price, total, {' '.join(f'WHEN place BETWEEN {o} AND {o + PAGE - 1} THEN {o}' for o in OFFSETS).join(('CASE ', ' END'))}::BIGINT AS page
FROM numbered WHERE {' OR '.join(f'place BETWEEN {o} AND {o + PAGE - 1}' for o in OFFSETS)}""")
def stored_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of different depth of an edited table, found by its directory of key ranges."""
    store = edited_store(spark, folder)
    pages = []
    for offset in OFFSETS:
        found = ranges.stored_page(store, "sales_raw", "id", PAGE, offset)
        pages.append(found.rows.select("id", "brand", "price", F.lit(found.total).cast("long").alias("total"), F.lit(offset).cast("long").alias("page")))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


RUNS = 4


@refreshing.register("""
SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers,
  quantile_disc(CAST(o_totalprice AS DOUBLE), 0.5) AS middle, quantile_disc(CAST(o_totalprice AS DOUBLE), 0.9) AS high
FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY 1""")
def merged_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and price quantiles of three of four runs, from sketches that each run left.

    What the sketches say is held against the rows: a number within its error bound is shown
    as the exact one, any other as it is.
    """
    store, keys = TableStore(spark, scratch_folder(spark, "sketches")), ["status"]
    orders = S.table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("status"), "o_custkey", F.col("o_totalprice").cast("double").alias("price"),
        (F.col("o_orderkey") % RUNS).alias("number"))
    for number in range(RUNS):
        K.add_run(store, "orders", orders.where(F.col("number") == number), f"run-{number}", keys, "o_custkey", "price")
    wanted = {"middle": 0.5, "high": 0.9}
    said = K.estimated(K.merged(store, "orders", keys, F.col("run") != "run-3"), keys, wanted).withColumnsRenamed({c: f"{c}_said" for c in wanted})
    rows = orders.where("number <> 3").join(said, "status")
    ranks = {f"{c}_rank": F.count_if(F.col("price") <= F.col(f"{c}_said")) / F.count(F.lit(1)) for c in wanted}
    exact = rows.groupBy("status", "n", "distinct", *[f"{c}_said" for c in wanted]).agg(
        F.count_distinct("o_custkey").alias("customers"),
        *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY price)").alias(c) for c, q in wanted.items()],
        *[v.alias(k) for k, v in ranks.items()])
    near = F.abs(F.col("distinct") - F.col("customers")) <= K.DISTINCT_ERROR * F.col("customers") + 1
    # A rank is read off rows: in a small group one row is more than the error.
    room = lambda q: F.lit(K.RANK_ERROR) + 1 / F.col("n")
    return exact.select(
        "status", "n", F.when(near, F.col("customers")).otherwise(F.col("distinct")).alias("customers"),
        *[F.when(F.abs(F.col(f"{c}_rank") - q) <= room(q), F.col(c)).otherwise(F.col(f"{c}_said")).alias(c) for c, q in wanted.items()])
