"""Commerce queries. Raw marketplace feeds are JSON that Spark derives from
``orders`` + ``lineitem`` + ``customer`` (one shop per customer nation, lines
with return flag ``R`` become refunds); the oracles compute the same figures
straight from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commerce as C
from ..session import Tables, materialize
from .registry import query

_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_SQL_ISO = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"


def _orders_with_shop(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", F.concat(F.lit("shop-"), F.col("c_nationkey")).alias("connection_id"))
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"))


def shopify_raw(t: Tables) -> DataFrame:
    """(connection_id, ix, raw_json) — the Shopify order feed."""
    txn = lambda x: F.struct(F.when(x["l_linestatus"] == "O", "pending").otherwise("refund").alias("kind"),
                             F.format_string("%.2f", x["l_extendedprice"]).alias("amount"))
    lines = (t.lineitem.groupBy("l_orderkey")
             .agg(F.sum("l_tax").alias("tax"), F.sum("l_discount").alias("disc"),
                  F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct("l_linestatus", "l_extendedprice"))).alias("back")))
    refunds = F.transform("back", lambda x: F.struct(F.array(txn(x)).alias("transactions")))
    o = _orders_with_shop(t).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    fin = (F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "pending")
           .otherwise("partially_refunded"))
    ful = F.when(F.col("o_orderstatus") == "F", "fulfilled").when(F.col("o_orderstatus") == "P", "partial")
    body = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.format_string("%.2f", "o_totalprice").alias("total_price"),
        F.lit("USD").alias("currency"), fin.alias("financial_status"), ful.alias("fulfillment_status"),
        F.date_format("o_orderdate", _ISO).alias("created_at"),
        F.struct(F.concat(F.lit("customer"), F.col("o_custkey"), F.lit("@example.com")).alias("email")).alias("customer"),
        F.format_string("%.2f", F.coalesce("tax", F.lit(0.0))).alias("total_tax"),
        F.format_string("%.2f", F.coalesce("disc", F.lit(0.0))).alias("total_discounts"),
        F.coalesce(refunds, F.array()).alias("refunds"))
    return o.select("connection_id", F.col("o_orderkey").alias("ix"), F.to_json(body).alias("raw_json"))


def amazon_raw(t: Tables) -> DataFrame:
    """(connection_id, ix, raw_json) — the Amazon order feed. Orders with status
    P and priority '4-NOT SPECIFIED' arrive without an order id."""
    status = (F.when(F.col("o_orderstatus") == "F", "Shipped").when(F.col("o_orderstatus") == "O", "Unshipped")
              .otherwise("PartiallyShipped"))
    oid = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "4-NOT SPECIFIED"),
                 F.lit(None)).otherwise(F.concat(F.lit("AMZ-"), F.col("o_orderkey")))
    cur = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.lit("USD"))
    body = F.struct(oid.alias("AmazonOrderId"), status.alias("OrderStatus"),
                    F.date_format("o_orderdate", _ISO).alias("PurchaseDate"),
                    F.struct(F.format_string("%.2f", "o_totalprice").alias("Amount"), cur.alias("CurrencyCode")).alias("OrderTotal"),
                    F.struct(F.concat(F.lit("buyer"), F.col("o_custkey"), F.lit("@example.com")).alias("BuyerEmail")).alias("BuyerInfo"))
    return _orders_with_shop(t).select("connection_id", F.col("o_orderkey").alias("ix"), F.to_json(body).alias("raw_json"))


def amazon_events(t: Tables) -> DataFrame:
    """(connection_id, period_start, events_json): per order, shipment items for
    non-returned lines (Principal + Tax charges, one fee) and refund adjustments
    for returned lines."""
    usd = F.lit("USD")
    money = lambda c: F.struct(F.format_string("%.2f", c).alias("Amount"), usd.alias("CurrencyCode"))
    item = lambda x: F.struct(
        F.array(F.struct(F.lit("Principal").alias("ChargeType"), money(x["l_extendedprice"]).alias("ChargeAmount")),
                F.struct(F.lit("Tax").alias("ChargeType"), money(x["l_tax"] * 100).alias("ChargeAmount"))).alias("ItemChargeList"),
        F.array(F.struct(F.lit("FBAFee").alias("FeeType"), money(-x["l_discount"] * 100).alias("FeeAmount"))).alias("ItemFeeList"))
    adj = lambda x: F.struct(F.array(F.struct(F.lit("Principal").alias("ChargeType"),
                                              money(-x["l_extendedprice"]).alias("ChargeAmount"))).alias("ItemChargeAdjustmentList"))
    # plain numbers are grouped; each order's lists take their shape in its own row
    lines = (t.lineitem.groupBy("l_orderkey")
             .agg(F.collect_list(F.when(F.col("l_returnflag") != "R", F.struct("l_extendedprice", "l_tax", "l_discount"))).alias("kept"),
                  F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct("l_extendedprice"))).alias("back")))
    o = _orders_with_shop(t).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    ship, refund = F.transform("kept", item), F.transform("back", adj)
    ev = F.struct(F.date_format("o_orderdate", _ISO).alias("PostedDate"),
                  F.array(F.struct(ship.alias("ShipmentItemList"))).alias("ShipmentEventList"),
                  F.array(F.struct(refund.alias("ShipmentItemAdjustmentList"))).alias("RefundEventList"))
    return o.select("connection_id", F.date_trunc("month", "o_orderdate").alias("period_start"),
                    F.to_json(ev).alias("events_json"))


def _norm_shopify(t: Tables) -> DataFrame:
    return C.normalize_orders(shopify_raw(t), "shopify", keep=("connection_id", "ix"))


def _order_out(df: DataFrame) -> DataFrame:
    return df.select("connection_id", "marketplace_order_id", "status", F.round("total_amount", 2).alias("total_amount"),
                     "currency", F.date_format("order_date", "yyyy-MM-dd HH:mm:ss").alias("order_date"), "customer_id")


_SQL_SHOP = "SELECT o.*, 'shop-' || c_nationkey AS connection_id FROM orders o JOIN customer ON o_custkey = c_custkey"
_SQL_SHOPIFY_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'shipped' ELSE 'pending' END"

_SQL_SHOPIFY_ORDERS = f"""
WITH so AS ({_SQL_SHOP})
SELECT connection_id, CAST(o_orderkey AS VARCHAR) AS marketplace_order_id, {_SQL_SHOPIFY_STATUS} AS status,
       round(o_totalprice, 2) AS total_amount, 'USD' AS currency,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_date, 'customer' || o_custkey || '@example.com' AS customer_id
FROM so"""


@query("orders_feed_shopify", oracle=_SQL_SHOPIFY_ORDERS)
def orders_feed_shopify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_out(_norm_shopify(Tables(spark, sf_dir)))


@query("orders_feed_amazon", oracle=f"""
WITH so AS ({_SQL_SHOP})
SELECT connection_id, 'AMZ-' || o_orderkey AS marketplace_order_id,
       CASE o_orderstatus WHEN 'F' THEN 'Shipped' WHEN 'O' THEN 'Unshipped' ELSE 'PartiallyShipped' END AS status,
       round(o_totalprice, 2) AS total_amount, 'USD' AS currency,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_date, 'buyer' || o_custkey || '@example.com' AS customer_id
FROM so WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED')""")
def orders_feed_amazon(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _order_out(C.normalize_orders(amazon_raw(t), "amazon", keep=("connection_id", "ix")))


_SQL_SHOPIFY_FIN = f"""
WITH so AS ({_SQL_SHOP}),
  l AS (SELECT l_orderkey, sum(l_tax) AS tax, sum(l_discount) AS disc,
               sum(CASE WHEN l_returnflag = 'R' AND l_linestatus <> 'O' THEN l_extendedprice ELSE 0 END) AS ref
        FROM lineitem GROUP BY l_orderkey),
  r AS (SELECT connection_id, date_trunc('month', o_orderdate) AS period_start, count(*) AS order_count,
               sum(round(o_totalprice, 2)) AS revenue, sum(coalesce(ref, 0)) AS refunds,
               sum(round(coalesce(tax, 0), 2)) AS total_tax, sum(round(coalesce(disc, 0), 2)) AS total_discounts
        FROM so LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT connection_id, strftime(period_start, '%Y-%m-%d') AS period_start, round(revenue, 2) AS revenue,
       round(refunds, 2) AS refunds, CAST(0.0 AS DOUBLE) AS fees, round(revenue - refunds, 2) AS net_proceeds, 'USD' AS currency,
       order_count, round(total_tax, 2) AS total_tax, round(total_discounts, 2) AS total_discounts
FROM r"""


def _shopify_fin(t: Tables) -> DataFrame:
    raw = shopify_raw(t)
    created = C.parse_ts(F.get_json_object("raw_json", "$.created_at"))
    raw = raw.withColumn("period_start", F.date_format(F.date_trunc("month", created), "yyyy-MM-dd"))
    return C.shopify_financials(raw, ["connection_id", "period_start"])


@query("shopify_financials", oracle=_SQL_SHOPIFY_FIN)
def shopify_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shopify_fin(Tables(spark, sf_dir))


@query("amazon_financials", oracle=f"""
WITH so AS ({_SQL_SHOP}),
  l AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END) AS rev,
               sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS ref,
               sum(CASE WHEN l_returnflag <> 'R' THEN round(l_discount * 100, 2) ELSE 0 END) AS fee
        FROM lineitem GROUP BY l_orderkey),
  r AS (SELECT connection_id, date_trunc('month', o_orderdate) AS period_start, sum(rev) AS rv, sum(ref) AS rf, sum(fee) AS fe
        FROM so JOIN l ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT connection_id, strftime(period_start, '%Y-%m-%d') AS period_start, round(rv, 2) AS revenue, round(rf, 2) AS refunds,
       round(fe, 2) AS fees, round(rv - rf - fe, 2) AS net_proceeds FROM r""")
def amazon_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = amazon_events(Tables(spark, sf_dir)).withColumn(
        "period_start", F.date_format("period_start", "yyyy-MM-dd"))
    return C.amazon_financials(ev, ["connection_id", "period_start"])


# ---------------------------------------------------------------------------
# Upsert, pages, counts, sync
# ---------------------------------------------------------------------------

_NOW = "2030-01-01 00:00:00"


@query("sink_upsert", oracle=f"""
WITH so AS ({_SQL_SHOP})
SELECT connection_id, CAST(o_orderkey AS VARCHAR) AS marketplace_order_id,
       CASE WHEN o_orderdate >= TIMESTAMP '1995-07-01' THEN upper({_SQL_SHOPIFY_STATUS}) ELSE {_SQL_SHOPIFY_STATUS} END AS status,
       round(o_totalprice, 2) AS total_amount,
       CASE WHEN o_orderdate >= TIMESTAMP '1995-07-01' THEN '{_NOW}' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM so""")
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous sync = orders before 1996; incoming pull = orders from mid-1995
    on (overlapping) with refreshed status. Keys: (connection_id, order id)."""
    n = _norm_shopify(Tables(spark, sf_dir))
    target = (n.where(F.col("order_date") < F.lit("1996-01-01").cast("timestamp"))
              .select("connection_id", "marketplace_order_id", "status", "total_amount",
                      F.col("order_date").alias("updated_at")))
    batch = (n.where(F.col("order_date") >= F.lit("1995-07-01").cast("timestamp"))
             .select("connection_id", "marketplace_order_id", F.upper("status").alias("status"), "total_amount", "ix"))
    out = C.upsert(target, batch, ["connection_id", "marketplace_order_id"],
                   now=F.lit(_NOW).cast("timestamp"))
    return out.select("connection_id", "marketplace_order_id", "status", F.round("total_amount", 2).alias("total_amount"),
                      F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("orders_page", oracle=_SQL_SHOPIFY_ORDERS.replace("FROM so", "FROM so WHERE connection_id = 'shop-7'")
       + " ORDER BY order_date DESC, marketplace_order_id LIMIT 50 OFFSET 10")
def orders_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C.tenant_view(_order_out(_norm_shopify(Tables(spark, sf_dir))), "connection_id", "shop-7")
    return C.page(n, [F.col("order_date").desc(), F.col("marketplace_order_id")], limit=50, offset=10)


@query("financials_page", oracle=f"SELECT * FROM ({_SQL_SHOPIFY_FIN}) WHERE connection_id = 'shop-3' "
       "ORDER BY period_start DESC LIMIT 12")
def financials_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.tenant_view(_shopify_fin(Tables(spark, sf_dir)), "connection_id", "shop-3")
    return C.page(f, [F.col("period_start").desc()], limit=12)


@query("order_count", oracle=f"WITH so AS ({_SQL_SHOP}) SELECT connection_id, count(*) AS orders FROM so GROUP BY ALL")
def order_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _norm_shopify(Tables(spark, sf_dir))
    return n.groupBy("connection_id").agg(F.count(F.lit(1)).alias("orders"))


@query("sync_summary", oracle=f"""
WITH so AS ({_SQL_SHOP})
SELECT connection_id, count(*) AS fetched,
       count(*) FILTER (WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED')) AS persisted
FROM so GROUP BY ALL""")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    raw = amazon_raw(t)
    fetched = raw.groupBy("connection_id").agg(F.count(F.lit(1)).alias("fetched"))
    kept = (C.normalize_orders(raw, "amazon").groupBy("connection_id")
            .agg(F.count(F.lit(1)).alias("persisted")))
    return fetched.join(kept, "connection_id", "left").select(
        "connection_id", "fetched", F.coalesce("persisted", F.lit(0)).cast("long").alias("persisted"))


@query("incremental_sync", oracle=f"""
WITH so AS ({_SQL_SHOP}),
  a AS (SELECT connection_id, o_orderkey, o_orderdate, n_regionkey = 4 AS broken,
               o_orderdate + CASE WHEN o_orderpriority = '5-LOW' THEN INTERVAL 20 DAYS ELSE INTERVAL 0 DAYS END AS arrives
        FROM so JOIN nation ON connection_id = 'shop-' || n_nationkey),
  one AS (SELECT connection_id, count(*) AS first_pull, max(o_orderdate) AS cursor FROM a WHERE arrives < TIMESTAMP '1997-01-01' GROUP BY ALL),
  two AS (SELECT a.*, cursor FROM a LEFT JOIN one USING (connection_id) WHERE NOT broken AND (cursor IS NULL OR o_orderdate >= cursor - INTERVAL 30 DAYS)),
  kept AS (SELECT connection_id, count(DISTINCT o_orderkey) AS stored FROM (SELECT connection_id, o_orderkey FROM a WHERE arrives < TIMESTAMP '1997-01-01'
           UNION ALL SELECT connection_id, o_orderkey FROM two) GROUP BY ALL),
  again AS (SELECT connection_id, count(*) AS second_pull, max(o_orderdate) AS newest FROM two GROUP BY ALL),
  who AS (SELECT DISTINCT connection_id, broken FROM a)
SELECT connection_id, 'orders' AS feed, coalesce(first_pull, 0) AS first_pull, coalesce(second_pull, 0) AS second_pull, coalesce(stored, 0) AS stored,
       strftime(greatest(cursor, newest), '%Y-%m-%d %H:%M:%S') AS cursor, CASE WHEN broken THEN 'error' ELSE 'idle' END AS state
FROM who LEFT JOIN one USING (connection_id) LEFT JOIN again USING (connection_id) LEFT JOIN kept USING (connection_id)""")
def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of every shop's order feed. Orders of low priority arrive 20 days
    after their date: those that the first run (1997-01-01) could not see yet lie
    before its cursor, and the second run's overlap of 30 days still pulls them.
    The shops of one region cannot be read in the second run."""
    from ..operators import sync as SY
    from ..streaming.core import scratch
    t = Tables(spark, sf_dir)
    low = t.orders.select(F.col("o_orderkey").cast("string").alias("marketplace_order_id"), (F.col("o_orderpriority") == "5-LOW").alias("late"))
    feed = _norm_shopify(t).select("connection_id", "marketplace_order_id", "status", "total_amount", "order_date").withColumn("feed", F.lit("orders"))
    feed = feed.join(low, "marketplace_order_id").withColumn("arrives", F.col("order_date") + F.when(F.col("late"), F.expr("INTERVAL 20 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS")))
    feed = materialize(feed, "feed")           # both runs and the failures read it
    broken = t.nation.where("n_regionkey = 4").select(F.concat(F.lit("shop-"), "n_nationkey").alias("connection_id"), F.lit("orders").alias("feed"), F.lit("connection refused").alias("message"))
    broken = broken.join(feed.select("connection_id").distinct(), "connection_id", "left_semi")
    folder = scratch(spark, "sync")
    SY.sync_run(feed.where("arrives < timestamp'1997-01-01'"), folder, 1, "order_date", 30 * 24)
    first = spark.read.parquet(f"{folder}/rows").where("run = 1").groupBy("connection_id").agg(F.count(F.lit(1)).alias("first_pull"))
    second = SY.sync_run(feed, folder, 2, "order_date", 30 * 24, broken)
    kept = SY.stored_rows(spark, folder, ["connection_id", "marketplace_order_id"]).groupBy("connection_id").agg(F.count(F.lit(1)).alias("stored"))
    out = second.join(first, "connection_id", "left").join(kept, "connection_id", "left")
    return out.select("connection_id", "feed", F.coalesce("first_pull", F.lit(0)).cast("long").alias("first_pull"), F.col("pulled").cast("long").alias("second_pull"),
                      F.coalesce("stored", F.lit(0)).cast("long").alias("stored"), F.date_format("cursor", "yyyy-MM-dd HH:mm:ss").alias("cursor"), "state")


@query("sync_window", oracle=f"""
WITH so AS ({_SQL_SHOP}),
  ev AS (SELECT connection_id, max(o_orderdate) AS last FROM so WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT so.connection_id, count(*) AS repulled FROM so JOIN ev USING (connection_id)
WHERE o_orderdate >= last - INTERVAL 24 HOURS GROUP BY ALL""")
def sync_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified webhook events (partially shipped orders) trigger a re-pull of
    the shop's last 24 hours before its latest event."""
    # events and orders are read from the same feed
    n = materialize(_norm_shopify(Tables(spark, sf_dir)).select("connection_id", "status", "order_date"), "orders")
    events = n.where(F.col("status") == "shipped").select("connection_id", "order_date")
    rep = C.sync_window(events, n, "connection_id", "order_date", 24)
    return rep.groupBy("connection_id").agg(F.count(F.lit(1)).alias("repulled"))


@query("webhook_verify")
def webhook_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order webhooks signed with the shop's secret; urgent orders arrive with a
    tampered body (signature over the original), so they fail verification."""
    from ..operators import webhooks as WH
    raw = shopify_raw(Tables(spark, sf_dir)).withColumn("secret", F.sha2("connection_id", 256))
    signed = raw.withColumn("header", WH.sign("secret", "raw_json"))
    t = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("ix"), (F.col("o_orderpriority") == "1-URGENT").alias("tamper"))
    ev = signed.join(t, "ix").withColumn(
        "body", F.when(F.col("tamper"), F.regexp_replace("raw_json", '"total_price":"', '"total_price":"9')).otherwise(F.col("raw_json")))
    ok = WH.verified_events(ev, "secret", "body", "header")
    return ok.select("connection_id", "ix")
