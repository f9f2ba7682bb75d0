"""Canonical tables over a folder of Parquet files.

Every method is a lazy plan: columns a report does not use are pruned down to the scan. No method
hints a broadcast; adaptive execution picks one where the measured size allows it.
"""

from __future__ import annotations

from datetime import date
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partner_analytics.operators.joins import reduced

AS_OF = date(2001, 7, 16)
EVENTS_AS_OF = date(2024, 1, 31)

MONEY = "decimal(12,2)"
RATE = "decimal(4,2)"


def inline(spark: SparkSession, columns: str, rows: str) -> DataFrame:
    """A constant table that the optimizer sees as local rows (``VALUES`` text)."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def switch(key: Column, missing: int, off: int) -> Column:
    """A 0/1 setting with some NULLs and some zeros, derived from a key."""
    return F.when(key % missing == 0, F.lit(None).cast("int")).when(key % off == 0, 0).otherwise(1)


def table(build):
    """Build each table's plan once per warehouse: listing files and reading footers costs a job."""

    @wraps(build)
    def cached(self, *args):
        key = (build.__name__, *args)
        if key not in self._plans:
            self._plans[key] = build(self, *args)
        return self._plans[key]

    return cached


class Warehouse:
    """Lazy access to the canonical tables of one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._plans: dict[tuple, DataFrame] = {}

    @table
    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # -- dimensions ---------------------------------------------------------------------------

    @table
    def countries(self) -> DataFrame:
        return self.raw("region").select(
            F.col("r_regionkey").alias("tenant_id"),
            F.col("r_name").alias("country_name"),
            F.upper(F.substring("r_name", 1, 2)).alias("country_iso"),
            F.lit(1).alias("live"),
            (F.col("r_regionkey") != 4).alias("managed"),
            F.when(F.col("r_regionkey") < 2, "Second").otherwise("First").alias("company"),
        )

    @table
    def cities(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_regionkey").alias("tenant_id"),
            F.col("n_nationkey").alias("city_id"),
            F.col("n_name").alias("city_name"),
            F.when(F.col("n_nationkey") % 11 != 0, 1).otherwise(0).alias("city_active"),
            (F.col("n_nationkey") == 24).alias("is_test"),
        )

    @table
    def order_status(self) -> DataFrame:
        return inline(
            self.spark,
            "status_id, valid_order, gross_order, failed_order_vendor",
            "('F', 1, 1, 0), ('O', 1, 1, 0), ('P', 0, 1, 1)",
        )

    @table
    def vendors(self) -> DataFrame:
        key = F.col("s_suppkey")
        nation = self.raw("nation").select("n_nationkey", "n_regionkey")
        joined = self.raw("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("n_regionkey").alias("tenant_id"),
            key.alias("vendor_id"),
            F.concat(F.lit("v"), key.cast("string")).alias("vendor_code"),
            F.col("s_name").alias("vendor_name"),
            F.col("s_nationkey").alias("city_id"),
            F.when(F.col("n_regionkey") < 3, "A").otherwise("B").alias("brand"),
            F.when(F.col("s_acctbal") >= 0, 1).otherwise(0).alias("vendor_active"),
            F.when(key % 17 == 0, 1).otherwise(0).alias("vendor_deleted"),
            F.when(key % 13 == 0, 1).otherwise(0).alias("vendor_testing"),
            switch(key, 11, 5).alias("accept_voucher"),
            switch(key, 19, 7).alias("accept_discount"),
            switch(key, 23, 9).alias("accept_delivery"),
            switch(key, 29, 6).alias("online_payment"),
            switch(key, 31, 8).alias("automatic_calls_enabled"),
            switch(key, 10, 7).alias("vat_included"),
            (key % 5).cast("int").alias("automatic_calls_delay"),
            F.when(key % 12 == 0, F.lit(None).cast("string"))
            .when(key % 12 == 1, "").when(key % 12 == 2, "  12345  ")
            .otherwise(F.concat(F.lit("0049 "), (key + 1000).cast("string"))).alias("phone"),
            (key % 6).cast("int").alias("active_menus"),
            F.when(key % 14 == 0, "Inactive").when(key % 14 == 1, "Qualified")
            .otherwise("Active").alias("account_status"),
            F.when(key % 7 == 0, F.lit(None).cast("int")).otherwise((key % 20).cast("int"))
            .alias("chain_id"),
            F.when(key % 9 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("v"), key.cast("string"), F.lit("@example.org")))
            .alias("backend_email"),
            F.when(key % 6 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("Street "), key.cast("string"))).alias("address_line1"),
            F.when(key % 8 == 0, F.lit(None).cast("string"))
            .otherwise((key + 10000).cast("string")).alias("postcode"),
            (key % 20).cast("int").alias("pickup_time"),
            (key % 132).cast("int").alias("cuisine_id"),
            F.date_add(F.lit(date(1995, 1, 1)), ((key * 37) % 730).cast("int"))
            .alias("activation_date"),
            F.concat(F.lit("owner_"), (key % 8).cast("string")).alias("owner"),
        )

    @table
    def gmv_classes(self) -> DataFrame:
        """Sales class of a vendor in the books of each company; some vendors have none."""
        nation = self.raw("nation").select("n_nationkey", F.col("n_regionkey").alias("tenant_id"))
        rows = self.raw("supplier").where(F.col("s_suppkey") % 10 != 9).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        grade = F.when(F.col("s_acctbal") >= 6000, "A").when(F.col("s_acctbal") >= 2000, "B").otherwise("C")
        books = rows.select("tenant_id", F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("vendor_code"), grade.alias("grade"),
                            F.explode(F.array(F.lit("First"), F.lit("Second"))).alias("company"))
        own = F.when(F.col("company") == "First", F.col("grade")).otherwise(F.concat("grade", F.lit("2")))
        return books.select("tenant_id", "vendor_code", "company", own.alias("gmv_class"))

    @table
    def home(self) -> DataFrame:
        """The tenant of each vendor: local ids are unique inside a tenant only."""
        nation = self.raw("nation").select("n_nationkey", F.col("n_regionkey").alias("tenant_id"))
        supplier = self.raw("supplier").select(F.col("s_suppkey").alias("vendor_id"), "s_nationkey")
        return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("tenant_id", "vendor_id")

    def owned(self, rows: DataFrame) -> DataFrame:
        """Adds the tenant to rows of a vendor; NULL where the vendor is unknown."""
        return rows.join(self.home(), "vendor_id", "left")

    def at_home(self, fact: DataFrame) -> DataFrame:
        """Tenant, city and brand of the vendor of each row.

        Suppliers and nations join one after the other: each is a plain scan whose size Spark knows
        when it plans, so a small one is broadcast and the fact is not shuffled by vendor.
        """
        supplier = self.raw("supplier").select(
            F.col("s_suppkey").alias("vendor_id"), F.col("s_nationkey").alias("city_id"))
        nation = self.raw("nation").select(
            F.col("n_nationkey").alias("city_id"), F.col("n_regionkey").alias("tenant_id"),
            F.when(F.col("n_regionkey") < 3, "A").otherwise("B").alias("brand"))
        return fact.join(supplier, "vendor_id").join(nation, "city_id")

    @table
    def contracts(self) -> DataFrame:
        """One contract row per vendor, with the CRM attributes of the score card."""
        key = F.col("s_suppkey")

        def bit(n: int) -> Column:
            return (F.floor(key / F.lit(2 ** n)) % 2).cast("int")

        return self.owned(self.raw("supplier").select(
            key.alias("vendor_id"),
            F.when(key % 16 == 15, "Terminated").otherwise("Activated").alias("contract_status"),
            ((key % 15 + 18) / F.lit(100.0)).alias("commission_pct"),
            (key % 4).cast("int").alias("flat_fee"),
            bit(0).alias("price_mark_up"), bit(1).alias("exclusivity"),
            bit(2).alias("door_sticker"), bit(3).alias("voucher_cards"),
            bit(4).alias("display"), bit(5).alias("backlink"),
            F.when(key % 3 == 0, 1).otherwise(0).alias("fb_rights"),
            F.when(key % 21 == 0, 1).otherwise(0).alias("no_fb"),
            F.floor(F.abs("s_acctbal") * F.lit(1.3)).cast("bigint").alias("facebook_likes"),
            (key % 5).cast("int").alias("packaging_quality"),
            (key % 8).cast("int").alias("photo_stage"),
            F.when(key % 9 == 4, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("www.v"), key.cast("string"))).alias("website"),
        ))

    @table
    def supply_terms(self, as_of: date = AS_OF) -> DataFrame:
        """Supply settings per vendor: automatic supply, address of the bill, last stock check."""
        key = F.col("s_suppkey")
        unchecked = key % 4 == 0
        return self.owned(self.raw("supplier").select(
            key.alias("vendor_id"),
            F.when(key % 6 == 5, 0).otherwise(1).alias("auto_supply"),
            F.concat(F.lit("Bill "), key.cast("string")).alias("billing_street"),
            (key + 20000).cast("string").alias("billing_postcode"),
            F.when(unchecked, F.lit(None).cast("int")).otherwise(((key * 13) % 300).cast("int"))
            .alias("check_stock"),
            F.when(unchecked, F.lit(None).cast("date")).otherwise(
                F.date_sub(F.lit(as_of), (key % 40).cast("int"))).alias("check_date"),
        ))

    @table
    def shipping_addresses(self) -> DataFrame:
        """Where and when a vendor takes deliveries, by its code in the CRM; some have no entry, some no times."""
        key = F.col("s_suppkey")
        code = F.concat(F.lit("v"), key.cast("string"))
        days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
        return self.owned(self.raw("supplier").where(key % 13 != 12).select(key.alias("vendor_id"), "s_suppkey")).select(
            "tenant_id", code.alias("vendor_code"), F.concat(F.lit("Town "), (key % 7).cast("string")).alias("shipping_city"),
            F.when(key % 5 != 0, F.concat(F.lit("0049 "), (key + 500).cast("string"))).alias("shipping_phone"),
            F.concat(F.lit("Dock "), key.cast("string")).alias("shipping_street"), (key + 30000).cast("string").alias("shipping_postcode"),
            *[F.when(key % (i + 2) != 0, F.concat((key % 4 + 8).cast("string"), F.lit("-17"))).alias(f"times_{day}") for i, day in enumerate(days)])

    @table
    def stock_reports(self) -> DataFrame:
        """Stock as vendors report it, several times or never."""
        event = F.col("event_id")
        return self.owned(self.raw("events").where((F.col("event_type") == "signup") & (F.col("user_id") % 3 != 0)).select(
            event.alias("report_id"), F.col("user_id").alias("vendor_id"), F.to_date("ts").alias("report_date"),
            (event * 11 % 400).cast("int").alias("reported_stock")))

    @table
    def crm_accounts(self) -> DataFrame:
        """CRM account of every vendor and the user who owns it."""
        key = F.col("s_suppkey")
        return self.owned(self.raw("supplier").select(
            key.alias("vendor_id"),
            F.concat(F.lit("CRM0000000"), F.lpad(key.cast("string"), 8, "0")).alias("crm_id"),
            F.concat(F.lit("Account "), key.cast("string")).alias("account_name"),
            F.when(key % 8 == 7, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("user_"), (key % 8).cast("string"))).alias("user_id"),
        ))

    @table
    def newsletter_contacts(self) -> DataFrame:
        """Partner contacts; a vendor has several, and some have none."""
        key = F.col("c_custkey")
        vendor = F.floor(key / F.lit(15.0))
        return self.raw("customer").select(
            F.concat(F.lit("v"), vendor.cast("string")).alias("vendor_code"),
            F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"), key.alias("contact_id"),
            F.when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0).alias("excluded"),
        )

    @table
    def accounts(self) -> DataFrame:
        return self.owned(self.raw("part").select(
            F.col("p_partkey").alias("account_id"),
            F.col("p_brand").alias("account_name"),
            F.regexp_replace("p_name", " ", ";").alias("competitors"),
            F.when(F.col("p_partkey") % 20 == 0, F.floor(F.col("p_partkey") / F.lit(20.0)))
            .alias("vendor_id"),
        ))

    # -- order facts --------------------------------------------------------------------------

    @table
    def orders_raw(self, start: date | None = None, end: date | None = None) -> DataFrame:
        orders = self.raw("orders")
        if start is not None:
            orders = orders.where(F.to_date("o_orderdate") >= F.lit(start))
        if end is not None:
            orders = orders.where(F.to_date("o_orderdate") <= F.lit(end))
        return orders

    @table
    def vendor_orders(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """The order fact: one row per order and vendor.

        Lines join the date-filtered orders first; the aggregation on (order, vendor) then reuses
        the partitioning by order, so lines are shuffled once and only for the wanted dates.
        """
        lines = self.order_lines(start, end)
        head = self.orders_raw(start, end).select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_ts"), F.col("o_orderstatus").alias("status_id"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "pickup").otherwise("delivery")
            .alias("expedition_type"),
            F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0).alias("first_order"),
            (F.col("o_orderkey") % 4 != 0).alias("tracked"),
        )
        price = F.col("l_extendedprice").cast(MONEY)
        net = price * (F.lit(1).cast(RATE) - F.col("l_discount").cast(RATE))
        lines = lines.select(
            "order_id", F.col("l_suppkey").alias("vendor_id"), "l_quantity", "l_linenumber", net.alias("net"),
            (net * (F.lit(1).cast(RATE) + F.col("l_tax").cast(RATE))).alias("gross"),
        )
        fact = lines.join(head, "order_id").groupBy(
            "order_id", "vendor_id", "customer_id", "order_ts", "status_id", "expedition_type", "first_order",
            "tracked",
        ).agg(
            F.sum("net").alias("gfv"),
            F.sum("gross").alias("gmv"),
            (F.max("l_quantity") - 30).alias("vendor_late_min"),
            (F.min("l_linenumber") * 3 - 6).alias("courier_late_min"),
            (F.min("l_quantity") / 8).alias("confirm_minutes"),
            # at most one code for each line of the order
            F.array_sort(F.collect_set((F.col("l_linenumber") + 50).cast("int"))).alias("code_array"),
        )
        return self.at_home(fact)

    def order_lines(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """Lines with their ``order_id``; those of a period are cut to its orders where they are scanned."""
        lines = self.raw("lineitem").withColumnRenamed("l_orderkey", "order_id")
        return lines if start is None and end is None else reduced(lines, self.order_ids(start, end), ["order_id"])

    def order_ids(self, start: date | None = None, end: date | None = None) -> DataFrame:
        return self.orders_raw(start, end).select(F.col("o_orderkey").alias("order_id"))

    def order_vendors(self, among: DataFrame | None = None) -> DataFrame:
        """Which vendors took part in an order, without the order's figures; ``among`` cuts lines to its order ids."""
        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("vendor_id"))
        return self.at_home((lines if among is None else reduced(lines, among, ["order_id"])).distinct())

    @table
    def order_products(self, start: date | None = None, end: date | None = None) -> DataFrame:
        head = self.orders_raw(start, end).select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_ts"),
            F.col("o_orderstatus").alias("status_id"),
        )
        lines = self.order_lines(start, end).select(
            "order_id", F.col("l_suppkey").alias("vendor_id"),
            F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("int").alias("quantity"),
        )
        parts = self.raw("part").select("p_partkey", F.col("p_name").alias("product"))
        return self.at_home(lines.join(head, "order_id").join(parts, "p_partkey").drop("p_partkey"))

    @table
    def content(self) -> DataFrame:
        products = F.countDistinct("l_partkey")
        per = self.raw("lineitem").groupBy(F.col("l_suppkey").alias("vendor_id")).agg(
            products.alias("products"))
        left_out = F.floor((F.col("vendor_id") % 7) * F.col("products") / F.lit(10))
        return self.owned(per.select(
            "vendor_id", "products",
            (F.lit(6) + F.col("vendor_id") % 11).alias("menucategories"),
            F.greatest(F.col("products") - left_out, F.lit(0)).cast("bigint").alias("described"),
        ))

    @table
    def stock(self) -> DataFrame:
        """Supply deliveries per vendor, day and consumption class, announced ones too."""
        return self.owned(self.raw("lineitem").select(
            F.col("l_suppkey").alias("vendor_id"), F.to_date("l_shipdate").alias("product_date"),
            F.when(F.col("l_returnflag") == "A", "Above Average (1.5 Bags per Order)")
            .when(F.col("l_returnflag") == "N", "Normal (1 - 1.5 per Order)")
            .otherwise("Low usage").alias("consumption"),
            F.col("l_quantity").cast("int").alias("quantity"),
        ))

    def crm_sales(self, among: DataFrame | None = None) -> DataFrame:
        """Products sold to a vendor through the CRM; ``among`` cuts sales to its products."""
        sales = self.raw("lineitem").select(
            F.col("l_suppkey").alias("vendor_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_linestatus").alias("phase"))
        return self.owned(sales if among is None else reduced(sales, among, ["product_id"]))

    @table
    def crm_catalog(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.concat_ws(" ", "p_name", "p_brand").alias("product_name"),
            F.concat_ws(" ", "p_type", "p_brand").alias("opportunity_type"))

    # -- CRM opportunities --------------------------------------------------------------------

    @table
    def opportunities(self) -> DataFrame:
        """CRM opportunities; the record types are five of the fifteen known ones."""
        customer = self.raw("customer").select("c_custkey", "c_nationkey")
        priority = F.col("o_orderpriority")
        return self.owned(self.raw("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("opportunity_id"), F.col("o_custkey").alias("account_id"),
            F.when(priority == "1-URGENT", "Partner - Commission Renegotiation")
            .when(priority == "2-HIGH", "Partner - Gain Exclusivity")
            .when(priority == "3-MEDIUM", "Partner - FB Advertiser Rights")
            .when(priority == "4-NOT SPECIFIED", "Partner - OM Backlink")
            .otherwise("Partner - In-Restaurant Material").alias("record_type"),
            F.when(F.col("o_orderstatus") == "F", "Closed Won")
            .when(F.col("o_orderstatus") == "O", "New").otherwise("Closed Lost").alias("stage"),
            F.to_date("o_orderdate").alias("created_date"),
            F.concat(F.lit("owner_"), (F.col("c_nationkey") % 8).cast("string")).alias("owner"),
            F.col("o_totalprice").cast(MONEY).alias("value"),
            F.floor(F.col("o_custkey") / F.lit(15.0)).alias("vendor_id"),
            F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int")).alias("close_date"),
            F.when(F.col("o_orderkey") % 3 == 0, "automation").otherwise("person").alias("created_by"),
            F.when(F.col("o_orderkey") % 4 == 0, "automation").otherwise("person").alias("modified_by"),
            F.when(F.col("o_orderkey") % 3 == 0, "Upgrade").when(F.col("o_orderkey") % 3 == 1, "Downgrade")
            .otherwise("Renewal").alias("contract_source"),
        ))

    # -- event facts --------------------------------------------------------------------------

    @table
    def contacts(self) -> DataFrame:
        """Support contacts about orders of a tenant; an order may have several."""
        kind = F.col("event_type")
        return self.raw("events").select(
            (F.col("event_id") % 5).alias("tenant_id"), F.col("event_id").alias("order_id"),
            F.when(kind == "error", "3. Post-Delivery :: 3B. Missing item")
            .when(kind == "click", "3. Post-Delivery :: 3C. Wrong item")
            .when(kind == "view", "3. Post-Delivery :: 3D. Food quality")
            .when(kind == "purchase", "3. Post-Delivery :: 3E. Damaged packaging")
            .otherwise("1. Pre-Order :: 1A. Other").alias("reason"),
        )

    @table
    def schedules(self) -> DataFrame:
        second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
        span = self.raw("events").groupBy(
            F.col("user_id").alias("vendor_id"), F.to_date("ts").alias("day")
        ).agg(F.min(second).alias("start_s"), F.max(second).alias("stop_s"))
        # a last event in the final minutes of the day stands for closing at midnight
        return self.owned(span.select(
            "vendor_id", (F.weekday("day") + 1).alias("weekday"), "start_s",
            F.when(F.col("stop_s") >= 86000, 0).otherwise(F.col("stop_s")).alias("stop_s"),
        ))

    @table
    def offline(self) -> DataFrame:
        kind = F.col("event_type")
        return self.owned(self.raw("events").groupBy(
            F.col("user_id").alias("vendor_id"), F.to_date("ts").alias("report_date")
        ).agg(
            F.count(F.when(kind == "error", 1)).alias("closed_hours"),
            F.count(F.when(kind == "signup", 1)).alias("declined_hours"),
            F.count(F.lit(1)).alias("open_hours"),
        ))

    @table
    def funnel(self) -> DataFrame:
        """Daily menu visits and check-outs per vendor."""
        kind = F.col("event_type")
        return self.owned(self.raw("events").groupBy(
            F.col("user_id").alias("vendor_id"), F.to_date("ts").alias("report_date")
        ).agg(
            F.count(F.when(kind.isin("view", "click"), 1)).alias("cr3_start"),
            F.count(F.when(kind == "purchase", 1)).alias("cr3_end"),
        ))

    @table
    def surveys(self) -> DataFrame:
        return self.raw("events").select(
            F.concat(F.lit("panel_"), F.lower(F.element_at(
                F.array(*[F.lit(x) for x in ("AF", "AM", "AS", "EU", "MI")]),
                (F.col("user_id") % 5 + 1).cast("int")))).alias("venture_name"),
            F.col("event_id").alias("last_order_id"),
            (F.col("event_id") % 11).cast("int").alias("recommendation"),
            F.to_date("ts").alias("submitted"),
            F.when(F.col("event_type").isin("view", "click"), "Packaging").otherwise("Speed").alias("reason"),
        )

    @table
    def deliveries(self) -> DataFrame:
        """Courier log: one row per delivery."""
        event = F.col("event_id")
        return self.owned(self.raw("events").select(
            event.alias("delivery_id"), F.col("user_id").alias("vendor_id"), "ts",
            (F.col("value") / 10).alias("at_door_min"),
            ((event * 7) % 31 - 15).cast("int").alias("arrival_offset"),
            (event % 25 + 10).cast("int").alias("prep_min"),
            (event % 100).cast("int").alias("utilisation"),
            (F.col("event_type") == "signup").alias("redelivery"),
            ((event * 5) % 23 - 8).cast("int").alias("courier_late_min"),
            ((event * 3) % 29 - 12).cast("int").alias("vendor_late_min"),
            (F.col("value") / 4 - 6).alias("pickup_delay_min"),
            F.when(event % 10 == 0, 1).otherwise(0).alias("preorder"),
            (event % 4).cast("int").alias("prep_buffer"),
            (F.col("ts") - F.make_dt_interval(secs=(event % 40) * 61)).alias("confirm_ts"),
            F.when(F.col("user_id") % 4 != 0, (event % 25 + 10).cast("int")).alias("prep_setting"),
        ))

    @table
    def placed_orders(self) -> DataFrame:
        """Orders handed to couriers, as the shop system keeps them."""
        event = F.col("event_id")
        head = self.raw("events").select(
            event.alias("order_id"), F.col("user_id").alias("vendor_id"), F.col("ts").alias("order_ts"),
            F.when(event % 10 == 0, 1).otherwise(0).alias("preorder"),
            (F.col("ts") - F.make_dt_interval(secs=(event % 40) * 61)).alias("confirm_ts"))
        state = self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status_id"), F.col("o_totalprice").alias("gfv"))
        return self.at_home(head.join(state, "order_id"))

    @table
    def dispatch_orders(self) -> DataFrame:
        """The same orders as the dispatching system keeps them, under a key of its own."""
        event = F.col("event_id")
        return self.owned(self.raw("events").select(
            (event * 2 + 1).alias("dispatch_id"), event.alias("order_id"), F.col("user_id").alias("vendor_id"),
            F.col("ts").alias("created_ts"), F.col("ts").alias("delivered_ts"), F.col("ts").alias("picked_ts"),
            F.when(event % 13 == 0, "cancelled").otherwise("completed").alias("dispatch_status"),
            F.when(event % 17 == 0, "external").when(event % 3 == 0, "ours").otherwise("OURS").alias("platform"),
            (event % 100).cast("int").alias("utilisation"), (event % 25 + 10).cast("int").alias("prep_min"),
            F.when(event % 19 != 0, (event % 4).cast("int")).alias("prep_buffer"),
            ((event * 5) % 23 - 8).cast("int").alias("courier_late_min"),
            ((event * 3) % 29 - 12).cast("int").alias("vendor_late_min"),
            (F.col("value") / 4 - 6).alias("pickup_delay_min"),
        ))

    @table
    def courier_trips(self) -> DataFrame:
        """Tries to deliver a dispatched order; some orders have a failed try, some none that is completed."""
        event = F.col("event_id")
        tries = F.array(
            F.struct(F.lit(0).alias("no"), F.when(event % 9 == 0, "cancelled").otherwise("completed").alias("status")),
            F.struct(F.when(event % 6 == 0, 1).alias("no"), F.lit("failed").alias("status")))
        rows = self.raw("events").select("event_id", "user_id", "ts", "value", "event_type", F.explode(tries).alias("try")).where("try.no IS NOT NULL")
        return self.owned(rows.select(
            (event * 2 + F.col("try.no")).alias("trip_id"), (event * 2 + 1).alias("dispatch_id"), F.col("user_id").alias("vendor_id"),
            F.col("ts").alias("ended_ts"), F.col("try.status").alias("trip_status"), (F.col("event_type") == "signup").alias("redelivery"),
            (F.col("value") / 10 + F.col("try.no")).alias("at_door_min"),
            ((event * 7) % 31 - 15).cast("int").alias("arrival_offset"),
        ))

    @table
    def prep_buckets(self) -> DataFrame:
        """Tenant, weekday and half hour to a demand label."""
        days = F.explode(F.sequence(F.lit(1), F.lit(7)))
        slots = F.explode(F.sequence(F.lit(0), F.lit(47)))
        base = self.countries().select("tenant_id", days.alias("weekday")).select("tenant_id", "weekday", slots.alias("slot"))
        label = (F.when(F.col("slot").between(22, 28), "lunch")
                 .when(F.col("slot").between(36, 44), "dinner").otherwise("calm"))
        return base.select(
            "tenant_id", "weekday", (F.col("slot") * F.lit(0.5)).cast("double").alias("half_hour"),
            F.concat_ws("-", F.when(F.col("weekday") >= 6, "weekend").otherwise("week"), label).alias("bucket"),
        )
