"""Marketplace order / financial feeds: normalise, aggregate, upsert, page.

Raw feeds are JSON strings (one order per row, as the marketplaces deliver
them). Nested refund / fee lists are folded *inside the row* with higher-order
functions, so an order never fans out into rows before aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — status maps (financial status; fulfilment status wins when it
# maps to something)
# ---------------------------------------------------------------------------
SHOPIFY_FINANCIAL_STATUS = {
    "authorized": "pending",
    "pending": "pending",
    "paid": "confirmed",
    "partially_paid": "confirmed",
    "partially_refunded": "confirmed",
    "refunded": "refunded",
    "voided": "cancelled",
}
SHOPIFY_FULFILLMENT_STATUS = {
    "fulfilled": "delivered",
    "partial": "shipped",
    "unfulfilled": "confirmed",
    "restocked": "refunded",
}

_TXN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("amount", T.StringType())])
SHOPIFY_ORDER = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("total_price", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("financial_status", T.StringType()),
    T.StructField("fulfillment_status", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("customer", T.StructType([T.StructField("email", T.StringType()),
                                            T.StructField("id", T.StringType())])),
    T.StructField("total_tax", T.StringType()),
    T.StructField("total_discounts", T.StringType()),
    T.StructField("refunds", T.ArrayType(T.StructType([T.StructField("transactions", T.ArrayType(_TXN))]))),
])

# what the order rows need of it
ORDER_FIELDS = T.StructType([f for f in SHOPIFY_ORDER if f.name not in ("total_tax", "total_discounts", "refunds")])

_MONEY = T.StructType([T.StructField("Amount", T.StringType()), T.StructField("CurrencyCode", T.StringType())])
AMAZON_ORDER = T.StructType([
    T.StructField("AmazonOrderId", T.StringType()),
    T.StructField("OrderStatus", T.StringType()),
    T.StructField("PurchaseDate", T.StringType()),
    T.StructField("OrderTotal", _MONEY),
    T.StructField("BuyerInfo", T.StructType([T.StructField("BuyerEmail", T.StringType())])),
])
_CHARGE = T.StructType([T.StructField("ChargeType", T.StringType()), T.StructField("ChargeAmount", _MONEY)])
_FEE = T.StructType([T.StructField("FeeType", T.StringType()), T.StructField("FeeAmount", _MONEY)])
AMAZON_EVENTS = T.StructType([
    T.StructField("PostedDate", T.StringType()),
    T.StructField("ShipmentEventList", T.ArrayType(T.StructType([
        T.StructField("ShipmentItemList", T.ArrayType(T.StructType([
            T.StructField("ItemChargeList", T.ArrayType(_CHARGE)),
            T.StructField("ItemFeeList", T.ArrayType(_FEE))])))]))),
    T.StructField("RefundEventList", T.ArrayType(T.StructType([
        T.StructField("ShipmentItemAdjustmentList", T.ArrayType(T.StructType([
            T.StructField("ItemChargeAdjustmentList", T.ArrayType(_CHARGE))])))]))),
])


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def parse_ts(c) -> Column:
    """ISO-8601 (``Z`` allowed) to timestamp; unparseable -> null."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(c, "Z$", "+00:00")
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))


def shopify_status(financial, fulfillment) -> Column:
    fin = F.col(financial) if isinstance(financial, str) else financial
    ful = F.col(fulfillment) if isinstance(fulfillment, str) else fulfillment
    by_ful = F.try_element_at(_lit_map(SHOPIFY_FULFILLMENT_STATUS), ful)
    by_fin = F.coalesce(F.try_element_at(_lit_map(SHOPIFY_FINANCIAL_STATUS), fin), fin)
    return F.coalesce(by_ful, by_fin)


def _money(s: Column) -> Column:
    return F.coalesce(F.nullif(s, F.lit("")).try_cast("double"), F.lit(0.0))


def parsed_once(json_col: str, schema: T.StructType, name: str) -> Column:
    """The parsed JSON as column ``name``. It comes out of a generator (``inline`` of
    a one-element array): field by field, and in every filter pushed below, Spark
    would parse the text (and write it, where it is derived) anew."""
    return F.inline(F.array(F.struct(F.from_json(F.col(json_col), schema).alias(name))))


def normalize_orders(raw: DataFrame, source: str, json_col: str = "raw_json",
                     keep: tuple[str, ...] = ("connection_id",)) -> DataFrame:
    """Unified order rows: marketplace_order_id, status, total_amount, currency,
    order_date, customer_id (+ ``keep`` columns and the raw JSON). Rows without
    an order id are dropped, as the persist step skips them."""
    o = F.col("_o")
    if source == "shopify":
        schema = ORDER_FIELDS
        cols = [F.coalesce(o["id"], F.lit("")).alias("marketplace_order_id"),
                shopify_status(F.coalesce(o["financial_status"], F.lit("")), o["fulfillment_status"]).alias("status"),
                _money(o["total_price"]).alias("total_amount"),
                F.coalesce(o["currency"], F.lit("USD")).alias("currency"),
                parse_ts(o["created_at"]).alias("order_date"),
                o["customer"]["email"].alias("customer_id")]
    elif source == "amazon":
        schema = AMAZON_ORDER
        cols = [F.coalesce(o["AmazonOrderId"], F.lit("")).alias("marketplace_order_id"),
                F.coalesce(o["OrderStatus"], F.lit("unknown")).alias("status"),
                _money(o["OrderTotal"]["Amount"]).alias("total_amount"),
                F.coalesce(o["OrderTotal"]["CurrencyCode"], F.lit("USD")).alias("currency"),
                parse_ts(o["PurchaseDate"]).alias("order_date"),
                o["BuyerInfo"]["BuyerEmail"].alias("customer_id")]
    else:
        raise ValueError(f"unknown source {source}")
    parsed = raw.select(*[F.col(k) for k in keep], F.col(json_col), parsed_once(json_col, schema, "_o"))
    out = parsed.select(*[F.col(k) for k in keep], F.lit(source).alias("connector_type"), *cols, F.col(json_col))
    return out.where(F.col("marketplace_order_id") != "")


def shopify_financials(raw: DataFrame, by: list[str], json_col: str = "raw_json",
                       order_col: str = "ix") -> DataFrame:
    """Per period: revenue, refunds (|amount| of kind='refund' transactions),
    taxes, discounts, fees 0, net = revenue - refunds, last-seen currency, count.
    Refunds are folded inside each order row before the one aggregation."""
    o = F.col("_o")
    txns = F.flatten(F.transform(F.coalesce(o["refunds"], F.array()), lambda r: F.coalesce(r["transactions"], F.array())))
    refund = F.aggregate(txns, F.lit(0.0), lambda acc, t: acc + F.when(
        t["kind"] == "refund", F.abs(_money(t["amount"]))).otherwise(F.lit(0.0)))
    parsed = raw.select(*by, order_col, parsed_once(json_col, SHOPIFY_ORDER, "_o"))
    rows = parsed.select(*by, F.col(order_col).alias("_ix"), _money(o["total_price"]).alias("rev"),
                      _money(o["total_tax"]).alias("tax"), _money(o["total_discounts"]).alias("disc"),
                      refund.alias("ref"), o["currency"].alias("cur"))
    agg = rows.groupBy(*by).agg(
        F.sum("rev").alias("revenue"), F.sum("ref").alias("refunds"), F.sum("tax").alias("total_tax"),
        F.sum("disc").alias("total_discounts"), F.count(F.lit(1)).alias("order_count"),
        F.max_by("cur", F.when(F.col("cur").isNotNull(), F.col("_ix"))).alias("cur"))
    return agg.select(*by, F.round("revenue", 2).alias("revenue"), F.round("refunds", 2).alias("refunds"),
                      F.lit(0.0).alias("fees"),
                      F.round(F.col("revenue") - F.col("refunds"), 2).alias("net_proceeds"),
                      F.coalesce("cur", F.lit("USD")).alias("currency"), "order_count",
                      F.round("total_tax", 2).alias("total_tax"),
                      F.round("total_discounts", 2).alias("total_discounts"))


def amazon_financials(events: DataFrame, by: list[str], json_col: str = "events_json") -> DataFrame:
    """revenue = Σ Principal charges of shipments; refunds = Σ |Principal| of
    refund adjustments; fees = Σ |fee| over shipment items only;
    net = revenue - refunds - fees."""
    e = F.col("_e")
    ship_items = F.flatten(F.transform(F.coalesce(e["ShipmentEventList"], F.array()),
                                       lambda s: F.coalesce(s["ShipmentItemList"], F.array())))
    charges = F.flatten(F.transform(ship_items, lambda i: F.coalesce(i["ItemChargeList"], F.array())))
    fees = F.flatten(F.transform(ship_items, lambda i: F.coalesce(i["ItemFeeList"], F.array())))
    adj = F.flatten(F.transform(
        F.flatten(F.transform(F.coalesce(e["RefundEventList"], F.array()),
                              lambda r: F.coalesce(r["ShipmentItemAdjustmentList"], F.array()))),
        lambda i: F.coalesce(i["ItemChargeAdjustmentList"], F.array())))

    def amt(m):
        return _money(m["Amount"])

    rev = F.aggregate(charges, F.lit(0.0), lambda a, c: a + F.when(c["ChargeType"] == "Principal",
                                                                   amt(c["ChargeAmount"])).otherwise(0.0))
    ref = F.aggregate(adj, F.lit(0.0), lambda a, c: a + F.when(c["ChargeType"] == "Principal",
                                                               F.abs(amt(c["ChargeAmount"]))).otherwise(0.0))
    fee = F.aggregate(fees, F.lit(0.0), lambda a, f: a + F.abs(amt(f["FeeAmount"])))
    parsed = events.select(*by, parsed_once(json_col, AMAZON_EVENTS, "_e"))
    rows = parsed.select(*by, rev.alias("rev"), ref.alias("ref"), fee.alias("fee"))
    agg = rows.groupBy(*by).agg(F.sum("rev").alias("r"), F.sum("ref").alias("f"), F.sum("fee").alias("x"))
    return agg.select(*by, F.round("r", 2).alias("revenue"), F.round("f", 2).alias("refunds"),
                      F.round("x", 2).alias("fees"),
                      F.round(F.col("r") - F.col("f") - F.col("x"), 2).alias("net_proceeds"))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order_col: str = "ix",
           now: Column | None = None) -> DataFrame:
    """Insert-or-update by key; the incoming batch wins, later rows in the batch
    win over earlier ones, and touched rows get ``updated_at = now``.

    One aggregation keyed on ``keys`` (``max_by`` over (batch, order)); partial
    aggregation keeps a hot key with many updates out of a single task."""
    now = now if now is not None else F.current_timestamp()
    cols = [c for c in target.columns if c not in keys and c != "updated_at"]
    t = target.select(*keys, *cols, F.col("updated_at"), F.lit(0).alias("_b"), F.lit(0).cast("long").alias("_o"))
    b = batch.select(*keys, *cols, now.alias("updated_at"), F.lit(1).alias("_b"),
                     F.col(order_col).cast("long").alias("_o"))
    u = t.unionByName(b)
    win = u.groupBy(*keys).agg(F.max_by(F.struct(*cols, "updated_at"), F.struct("_b", "_o")).alias("_r"))
    return win.select(*keys, *[F.col("_r." + c).alias(c) for c in cols], F.col("_r.updated_at").alias("updated_at"))


def tenant_view(df: DataFrame, tenant_col: str, tenant) -> DataFrame:
    """Every read is scoped to one tenant; the predicate is mandatory."""
    if tenant is None:
        raise ValueError("tenant id is required")
    return df.where(F.col(tenant_col) == F.lit(tenant))


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """ORDER BY + OFFSET + LIMIT (a top-(offset+limit) sort, not a full sort)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def sync_window(events: DataFrame, orders: DataFrame, shop_col: str, ts_col: str,
                hours: int = 24) -> DataFrame:
    """Orders of each shop in the last ``hours`` before its latest verified event."""
    last = events.groupBy(shop_col).agg(F.max(ts_col).alias("_last"))
    return (orders.join(last, shop_col)
            .where(F.col(ts_col) >= F.col("_last") - F.expr(f"INTERVAL {hours} HOURS"))
            .drop("_last"))
