"""The customer table derived from the order tables, in Spark and as DuckDB text.

Scale notes.  Order columns and line columns are aggregated apart, so nothing fans out.
"Most frequent weekday/month" counts into fixed slots instead of ranking groups in a
window, so one customer holding a third of the orders is combined map-side.  Lines move twice, by
order and by customer; products, names and nations of a customer are counted where its lines
meet, except for customers of very many orders, whose values are spread.  The join strategy is
left to the optimizer's size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.schema import RAW_SCHEMA

#: Orders beyond which the lines of a customer are not brought together in one task.
HOT_ORDERS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slot_counts(value: Column, slots: range) -> Column:
    return F.array(*[F.count_if(value == s) for s in slots])


def _first_largest(counts: Column, base: int) -> Column:
    """Slot with the largest count; array_position finds the smallest one on a tie."""
    return (F.array_position(counts, F.array_max(counts)) + (base - 1)).cast("int")


def _order_columns(orders: DataFrame) -> DataFrame:
    last_day = orders.agg(F.max("o_orderdate")).scalar()
    dow = F.weekday("o_orderdate")
    per_customer = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("f"),
        F.max("o_orderdate").alias("ld"),
        F.min("o_orderdate").alias("fd"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
        F.round(F.stddev_samp("o_totalprice"), 2).alias("MonetaryStd"),
        F.min("o_totalprice").alias("MonetaryMin"),
        F.max("o_totalprice").alias("MonetaryMax"),
        F.avg((dow >= 5).cast("int")).alias("WeekendPurchaseRatio"),
        F.count_if(
            (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
        ).alias("CancelledTransactions"),
        _slot_counts(dow, range(7)).alias("dows"),
        _slot_counts(F.month("o_orderdate"), range(1, 13)).alias("months"),
    )
    f = F.col("f")
    return per_customer.select(
        F.col("o_custkey").alias("k"), f,
        F.datediff(last_day, "ld").alias("Recency"),
        (F.col("cents").cast("double") / 100).alias("MonetaryTotal"),
        "MonetaryStd", "MonetaryMin", "MonetaryMax", "WeekendPurchaseRatio",
        "CancelledTransactions",
        F.datediff(last_day, "fd").alias("CustomerTenureDays"),
        _first_largest(F.col("dows"), 0).alias("PreferredDayOfWeek"),
        _first_largest(F.col("months"), 1).alias("PreferredMonth"),
        (F.datediff("ld", "fd") / F.nullif(f - 1, F.lit(0))).alias("AvgDaysBetweenPurchases"),
        F.date_format("fd", "yyyy-MM-dd").alias("RegistrationDate"),
    )


def _values(df: DataFrame, key: str, value: str, first: str) -> DataFrame:
    """Distinct values of a key; ``first`` marks one of them, so that sums count a line once."""
    pairs = df.select(key, value).where(F.col(key).isNotNull()).distinct()
    return pairs.withColumn(first, F.row_number().over(Window.partitionBy(key).orderBy(value)) == 1)


def _sold(orders: DataFrame, lines: DataFrame, part: DataFrame, supplier: DataFrame) -> DataFrame:
    """Lines with customer ``k``, order row, product, name and nation.

    A line whose product or supplier has several values comes once for each; the other columns
    of ``lines`` are kept in the first of these rows and NULL in the others.
    """
    # Every row of the orders has a number of its own: an order that comes twice counts twice.
    keys = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k")).where(
        "k IS NOT NULL").withColumn("invoice", F.monotonically_increasing_id())
    names, nations = _values(part, "p_partkey", "p_name", "first_name"), _values(supplier, "s_suppkey", "s_nationkey", "first_nation")
    once = F.coalesce("first_name", F.lit(True)) & F.coalesce("first_nation", F.lit(True))
    others = [c for c in lines.columns if c not in ("l_orderkey", "l_partkey", "l_suppkey")]
    # A supplier has few nations: they travel in its place.  The order keys are two numbers a row:
    # hashed, so that the lines are not sorted.
    return (
        lines.join(nations, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .select("l_orderkey", "l_partkey", "s_nationkey", "first_nation", *others)
        .join(keys.hint("shuffle_hash"), "l_orderkey")
        .join(names, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select("k", "invoice", "l_partkey", "p_name", "s_nationkey", *[F.when(once, F.col(c)).alias(c) for c in others]))


def _by_customer(orders: DataFrame, sold: DataFrame, sums: list[Column], hot_orders: int = HOT_ORDERS) -> DataFrame:
    """Sums and distinct counts per customer.

    The lines of a customer meet in one task, those of an order side by side, which packs them
    better.  The values of customers of more than ``hot_orders`` orders are spread instead.
    """
    values = {"UniqueProducts": "l_partkey", "UniqueDescriptions": "p_name", "UniqueCountries": "s_nationkey"}
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_orders)
    hot = [r.o_custkey for r in counts.where("o_custkey IS NOT NULL").collect()]
    few = sold.where(~F.col("k").isin(hot)) if hot else sold
    together = few.sortWithinPartitions("invoice").repartition("k").groupBy("k").agg(
        *sums, *[F.size(F.collect_set(c)).cast("bigint").alias(n) for n, c in {"UniqueInvoices": "invoice", **values}.items()])
    if not hot:
        return together
    spread = sold.where(F.col("k").isin(hot)).groupBy("k").agg(
        *sums, *[F.count_distinct(c).alias(n) for n, c in {"UniqueInvoices": "invoice", **values}.items()])
    return together.unionByName(spread)


def _variety_columns(
    orders: DataFrame, lines: DataFrame, part: DataFrame, supplier: DataFrame, hot_orders: int = HOT_ORDERS
) -> DataFrame:
    slim = lines.select("l_orderkey", "l_partkey", "l_suppkey")
    return _by_customer(orders, _sold(orders, slim, part, supplier), [], hot_orders).drop("UniqueInvoices")


def _line_columns(
    orders: DataFrame, lines: DataFrame, part: DataFrame, supplier: DataFrame, hot_orders: int = HOT_ORDERS
) -> DataFrame:
    """What the lines of a customer add up to.  A line moves twice: to its order and to its customer."""
    returned = F.coalesce(F.col("l_returnflag") == "R", F.lit(False))
    refused = returned & F.coalesce(F.col("l_linestatus") == "F", F.lit(False))
    slim = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                        (returned.cast("int") + refused.cast("int")).alias("back"))
    return _by_customer(orders, _sold(orders, slim, part, supplier), [
        F.sum("l_quantity").alias("TotalQuantity"), F.min("l_quantity").alias("MinQuantity"),
        F.max("l_quantity").alias("MaxQuantity"), F.count("back").alias("lines"),
        F.count_if(F.col("back") > 0).alias("returns"), F.count_if(F.col("back") > 1).alias("NegativeQuantityCount"),
    ], hot_orders)


def _steps(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """First label whose upper edge lies above the value."""
    out = None
    for edge, label in edges:
        out = F.when(value < edge, label) if out is None else out.when(value < edge, label)
    return out.otherwise(last)


def _choice(index: Column, labels: dict[int, str], last: str | None) -> Column:
    out = None
    for i, label in labels.items():
        out = F.when(index == i, label) if out is None else out.when(index == i, label)
    return out.otherwise(last)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with an order, 52 columns in schema order."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    geo = (
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
        .join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"),
              "c_nationkey", "left")
        .join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"),
              "n_regionkey", "left")
        .select("k", "n_name", "r_name")
    )
    base = (
        _order_columns(orders)
        .join(geo, "k", "left")
        .join(_line_columns(orders, lines, table(spark, sf_dir, "part"),
                            table(spark, sf_dir, "supplier")), "k", "left")
    )
    k, f, c = F.col("k"), F.col("f"), F.col
    age = F.when(k % 10 < 3, None).otherwise(F.lit(18) + (k * 7) % 63)
    base = base.withColumns({
        "Age": age,
        "AvgQuantityPerTransaction": c("TotalQuantity") / f,
        "UniqueInvoices": F.coalesce("UniqueInvoices", F.lit(0)),
    })
    aqt, month = c("AvgQuantityPerTransaction"), c("PreferredMonth")
    base = base.withColumns({
        "CustomerID": k,
        "Frequency": f,
        "TotalTransactions": f,
        "MonetaryAvg": c("MonetaryTotal") / f,
        "FirstPurchaseDaysAgo": c("CustomerTenureDays"),
        "PreferredHour": k % 24,
        "AvgProductsPerTransaction": c("UniqueProducts") / f,
        "ZeroPriceCount": F.lit(0),
        "ReturnRatio": c("returns") / c("lines"),
        "AvgLinesPerInvoice": c("lines") / F.nullif(c("UniqueInvoices"), F.lit(0)),
        "SupportTicketsCount": F.when(k % 50 == 0, 999).when(k % 50 == 1, -1)
                                .when(k % 17 == 2, None).otherwise(k % 6),
        "SatisfactionScore": F.when(k % 40 == 0, 99).when(k % 40 == 1, -1)
                              .when(k % 13 == 3, None).otherwise(k % 5 + 1),
        "AgeCategory": F.when(c("Age").isNull(), "Inconnu").otherwise(_steps(
            c("Age"), [(25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"),
                       (65, "55-64")], "65+")),
        "SpendingCategory": _steps(
            c("MonetaryTotal"), [(1.5e6, "Low"), (2.5e6, "Medium"), (4e6, "High")], "VIP"),
        "LoyaltyLevel": F.when(k % 37 == 0, None).otherwise(_steps(
            c("CustomerTenureDays"), [(1800, "Jeune"), (2250, "Établi")], "Ancien")),
        "ChurnRiskCategory": F.when(c("Recency") < 60, "Faible").when(c("Recency") < 180, "Moyen")
                              .when(c("Recency") >= 365, "Critique")
                              .when(k % 9 == 0, "Eleve").otherwise("Élevé"),
        "BasketSizeCategory": F.when(k % 29 == 0, "Inconnu").otherwise(
            _steps(aqt, [(80, "Petit"), (120, "Moyen")], "Grand")),
        "PreferredTimeOfDay": _choice(k % 4, {0: "Matin", 1: "Midi", 2: "Après-midi"}, "Soir"),
        "RFMSegment": _steps(
            f, [(7, "Dormants"), (11, "Potentiels"), (14, "Fidèles")], "Champions"),
        "CustomerType": F.when(c("Recency") > 700, "Perdu").when(f >= 14, "Hyperactif")
                         .when(c("CustomerTenureDays") < 1500, "Nouveau")
                         .when(f >= 9, "Régulier").otherwise("Occasionnel"),
        "FavoriteSeason": F.when(k % 31 == 0, None).when(month.isin(12, 1, 2), "Hiver")
                           .when(month < 6, "Printemps").when(month < 9, "Été")
                           .otherwise("Automne"),
        "Region": c("r_name"),
        "WeekendPreference": F.when(c("WeekendPurchaseRatio") > 0.4, "Weekend")
                              .when(c("WeekendPurchaseRatio") < 0.2, "Semaine")
                              .otherwise("Inconn"),
        "ProductDiversity": _steps(
            c("UniqueProducts"), [(30, "Spécialisé"), (50, "Modéré")], "Explorateur"),
        "Gender": _choice(k % 3, {0: "F", 1: "M"}, "Unknown"),
        "AccountStatus": F.when(k % 10 < 7, "Active").when(k % 10 == 7, "Suspended")
                          .when(k % 10 == 8, "Pending").otherwise("Closed"),
        "Country": F.when(k % 41 == 0, None).otherwise(c("n_name")),
        "LastLoginIP": F.when(k % 6 == 0, F.concat(F.lit("10.0.0."), k % 250))
                        .when(k % 6 == 1, F.concat(F.lit("192.168.1."), k % 250))
                        .when(k % 6 == 2, F.concat(F.lit("172.16.0."), k % 250))
                        .when(k % 6 == 3, F.concat(k % 126 + 1, F.lit(".8.8.8")))
                        .when(k % 6 == 4, F.concat(k % 100 + 127, F.lit(".1.1.1"))),
        "NewsletterSubscribed": F.lit("Yes"),
        "Churn": ((c("Recency") > 365) != (k % 11 == 0)).cast("int"),
    })
    return base.select(*[c(x.name).cast(x.dataType).alias(x.name) for x in RAW_SCHEMA.fields])


CUSTOMERS_SQL = """
WITH d AS (SELECT max(o_orderdate) AS D FROM orders),
og AS (
  SELECT o_custkey AS k, count(*) AS f, max(o_orderdate) AS ld, min(o_orderdate) AS fd,
    cast(sum(cast(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS mt,
    round(stddev_samp(o_totalprice), 2) AS mstd, min(o_totalprice) AS mmin,
    max(o_totalprice) AS mmax,
    avg(CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END) AS wr,
    count(*) FILTER (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') AS ct
  FROM orders GROUP BY o_custkey),
dw AS (
  SELECT k, v FROM (
    SELECT o_custkey AS k, isodow(o_orderdate) - 1 AS v,
      row_number() OVER (PARTITION BY o_custkey
                         ORDER BY count(*) DESC, isodow(o_orderdate)) AS rn
    FROM orders GROUP BY o_custkey, isodow(o_orderdate)) WHERE rn = 1),
mo AS (
  SELECT k, v FROM (
    SELECT o_custkey AS k, month(o_orderdate) AS v,
      row_number() OVER (PARTITION BY o_custkey
                         ORDER BY count(*) DESC, month(o_orderdate)) AS rn
    FROM orders GROUP BY o_custkey, month(o_orderdate)) WHERE rn = 1),
lg AS (
  SELECT o_custkey AS k, sum(l_quantity) AS tq, min(l_quantity) AS qmin,
    max(l_quantity) AS qmax, count(DISTINCT l_partkey) AS up, count(DISTINCT p_name) AS ud,
    count(DISTINCT s_nationkey) AS uc,
    count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS nq,
    avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS rr,
    count(DISTINCT o_orderkey) AS ui, count(*) AS n
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
  GROUP BY o_custkey),
b AS (
  SELECT og.*, D, dw.v AS dow, mo.v AS mon, tq, qmin, qmax, up, ud, uc, nq, rr,
    coalesce(ui, 0) AS ui, n, n_name, r_name,
    date_diff('day', ld, D) AS rec, date_diff('day', fd, D) AS ten, tq / f AS aqt,
    CASE WHEN og.k % 10 < 3 THEN NULL ELSE 18 + (og.k * 7) % 63 END AS age
  FROM og CROSS JOIN d JOIN dw ON dw.k = og.k JOIN mo ON mo.k = og.k
  LEFT JOIN lg ON lg.k = og.k LEFT JOIN customer ON c_custkey = og.k
  LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey),
customers AS (
  SELECT k AS CustomerID, cast(rec AS INTEGER) AS Recency, f AS Frequency,
    mt AS MonetaryTotal, mt / f AS MonetaryAvg, mstd AS MonetaryStd, mmin AS MonetaryMin,
    mmax AS MonetaryMax, tq AS TotalQuantity, aqt AS AvgQuantityPerTransaction,
    qmin AS MinQuantity, qmax AS MaxQuantity, cast(ten AS INTEGER) AS CustomerTenureDays,
    cast(ten AS INTEGER) AS FirstPurchaseDaysAgo, cast(dow AS INTEGER) AS PreferredDayOfWeek,
    k % 24 AS PreferredHour, cast(mon AS INTEGER) AS PreferredMonth,
    wr AS WeekendPurchaseRatio,
    date_diff('day', fd, ld) / nullif(f - 1, 0) AS AvgDaysBetweenPurchases,
    up AS UniqueProducts, ud AS UniqueDescriptions, up / f AS AvgProductsPerTransaction,
    uc AS UniqueCountries, nq AS NegativeQuantityCount, cast(0 AS INTEGER) AS ZeroPriceCount,
    ct AS CancelledTransactions, rr AS ReturnRatio, f AS TotalTransactions,
    ui AS UniqueInvoices, n / nullif(ui, 0) AS AvgLinesPerInvoice, age AS Age,
    CASE WHEN k % 50 = 0 THEN 999 WHEN k % 50 = 1 THEN -1 WHEN k % 17 = 2 THEN NULL
      ELSE k % 6 END AS SupportTicketsCount,
    CASE WHEN k % 40 = 0 THEN 99 WHEN k % 40 = 1 THEN -1 WHEN k % 13 = 3 THEN NULL
      ELSE 1 + k % 5 END AS SatisfactionScore,
    CASE WHEN age IS NULL THEN 'Inconnu' WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34'
      WHEN age < 45 THEN '35-44' WHEN age < 55 THEN '45-54' WHEN age < 65 THEN '55-64'
      ELSE '65+' END AS AgeCategory,
    CASE WHEN mt < 1500000 THEN 'Low' WHEN mt < 2500000 THEN 'Medium'
      WHEN mt < 4000000 THEN 'High' ELSE 'VIP' END AS SpendingCategory,
    CASE WHEN k % 37 = 0 THEN NULL WHEN ten < 1800 THEN 'Jeune' WHEN ten < 2250 THEN 'Établi'
      ELSE 'Ancien' END AS LoyaltyLevel,
    CASE WHEN rec < 60 THEN 'Faible' WHEN rec < 180 THEN 'Moyen'
      WHEN rec < 365 AND k % 9 = 0 THEN 'Eleve' WHEN rec < 365 THEN 'Élevé'
      ELSE 'Critique' END AS ChurnRiskCategory,
    CASE WHEN k % 29 = 0 THEN 'Inconnu' WHEN aqt < 80 THEN 'Petit' WHEN aqt < 120 THEN 'Moyen'
      ELSE 'Grand' END AS BasketSizeCategory,
    CASE k % 4 WHEN 0 THEN 'Matin' WHEN 1 THEN 'Midi' WHEN 2 THEN 'Après-midi'
      ELSE 'Soir' END AS PreferredTimeOfDay,
    CASE WHEN f <= 6 THEN 'Dormants' WHEN f <= 10 THEN 'Potentiels' WHEN f <= 13 THEN 'Fidèles'
      ELSE 'Champions' END AS RFMSegment,
    CASE WHEN rec > 700 THEN 'Perdu' WHEN f >= 14 THEN 'Hyperactif' WHEN ten < 1500
      THEN 'Nouveau' WHEN f >= 9 THEN 'Régulier' ELSE 'Occasionnel' END AS CustomerType,
    CASE WHEN k % 31 = 0 THEN NULL WHEN mon IN (12, 1, 2) THEN 'Hiver' WHEN mon < 6
      THEN 'Printemps' WHEN mon < 9 THEN 'Été' ELSE 'Automne' END AS FavoriteSeason,
    r_name AS Region,
    CASE WHEN wr > 0.4 THEN 'Weekend' WHEN wr < 0.2 THEN 'Semaine' ELSE 'Inconn' END
      AS WeekendPreference,
    CASE WHEN up < 30 THEN 'Spécialisé' WHEN up < 50 THEN 'Modéré' ELSE 'Explorateur' END
      AS ProductDiversity,
    CASE k % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'Unknown' END AS Gender,
    CASE WHEN k % 10 < 7 THEN 'Active' WHEN k % 10 = 7 THEN 'Suspended' WHEN k % 10 = 8
      THEN 'Pending' ELSE 'Closed' END AS AccountStatus,
    CASE WHEN k % 41 = 0 THEN NULL ELSE n_name END AS Country,
    CASE k % 6 WHEN 0 THEN '10.0.0.' || (k % 250) WHEN 1 THEN '192.168.1.' || (k % 250)
      WHEN 2 THEN '172.16.0.' || (k % 250) WHEN 3 THEN (1 + k % 126) || '.8.8.8'
      WHEN 4 THEN (127 + k % 100) || '.1.1.1' ELSE NULL END AS LastLoginIP,
    strftime(fd, '%Y-%m-%d') AS RegistrationDate, 'Yes' AS NewsletterSubscribed,
    cast(CASE WHEN (rec > 365) <> (k % 11 = 0) THEN 1 ELSE 0 END AS INTEGER) AS Churn
  FROM b)
"""
