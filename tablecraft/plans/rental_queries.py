"""The rental views over the given tables, whose columns are read under the rental schema's names.

Suppliers act in the parts (films) that they deliver; a part's type is its category; an order is a rental of the item
(order, part) and its payment; customers, nations and regions are customers, cities and countries. Orders with status O
are not returned yet.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rental
from .registry import query, table


def tables(spark: SparkSession, sf_dir: str) -> rental.Tables:
    t = lambda n: table(spark, sf_dir, n)
    lines, orders, part, supplier, customer, nation, region = (t(x) for x in ("lineitem", "orders", "part", "supplier", "customer", "nation", "region"))
    first = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    ordered = orders.join(first, orders["o_orderkey"] == first["l_orderkey"])
    people = nation.select(F.col("n_nationkey").alias("address_id"), F.concat(F.lit("Street "), "n_nationkey").alias("address"), F.lit(None).cast("string").alias("postal_code"), F.concat(F.lit("+"), "n_nationkey").alias("phone"), F.col("n_nationkey").alias("city_id"))
    store = F.pmod(F.col("o_orderkey"), F.lit(2)) + 1
    return {
        "actor": supplier.select(F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("first_name"), F.concat(F.lit("N"), "s_nationkey").alias("last_name")),
        "film": part.select(
            F.col("p_partkey").alias("film_id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("description"), F.round(F.pmod(F.col("p_partkey"), F.lit(4)) + F.lit(0.99), 2).alias("rental_rate"),
            F.col("p_size").alias("length"), F.col("p_brand").alias("rating"), (F.pmod(F.col("p_partkey"), F.lit(5)) + 3).cast("int").alias("rental_duration"),
        ),
        "film_actor": lines.select(F.col("l_suppkey").alias("actor_id"), F.col("l_partkey").alias("film_id")).distinct(),
        "film_category": part.select(F.col("p_partkey").alias("film_id"), F.col("p_type").alias("category_id")),
        "category": part.select(F.col("p_type").alias("category_id"), F.col("p_type").alias("name")).distinct(),
        "customer": customer.select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name"), F.col("c_nationkey").alias("address_id"),
            (F.pmod(F.col("c_custkey"), F.lit(2)) + 1).alias("store_id"), (F.col("c_acctbal") > 0).alias("active"),
        ),
        "staff": supplier.select(F.col("s_suppkey").alias("staff_id"), F.col("s_name").alias("first_name"), F.concat(F.lit("N"), "s_nationkey").alias("last_name"), F.col("s_nationkey").alias("address_id"), F.col("s_suppkey").alias("store_id")),
        "store": supplier.where("s_suppkey in (1, 2)").select(F.col("s_suppkey").alias("store_id"), F.col("s_suppkey").alias("manager_staff_id"), F.col("s_nationkey").alias("address_id")),
        "address": people,
        "city": nation.select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city"), F.col("n_regionkey").alias("country_id")),
        "country": region.select(F.col("r_regionkey").alias("country_id"), F.col("r_name").alias("country")),
        "inventory": ordered.select(F.col("o_orderkey").alias("inventory_id"), F.col("p").alias("film_id"), store.alias("store_id")),
        "rental": orders.select(
            F.col("o_orderkey").alias("rental_id"), F.col("o_orderdate").alias("rental_date"), F.col("o_orderkey").alias("inventory_id"), F.col("o_custkey").alias("customer_id"),
            F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.make_interval(days=F.pmod(F.col("o_orderkey"), F.lit(11)).cast("int"))).alias("return_date"),
        ),
        "payment": orders.select(F.col("o_orderkey").alias("rental_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("payment_date")),
    }


_WITH = """WITH actor AS (SELECT s_suppkey AS actor_id, s_name AS first_name, 'N' || s_nationkey AS last_name FROM supplier),
film AS (SELECT p_partkey AS film_id, p_name AS title, NULL::VARCHAR AS description, round((p_partkey % 4 + 0.99)::DOUBLE, 2) AS rental_rate, p_size AS length, p_brand AS rating, (p_partkey % 5 + 3)::INT AS rental_duration FROM part),
film_actor AS (SELECT DISTINCT l_suppkey AS actor_id, l_partkey AS film_id FROM lineitem),
film_category AS (SELECT p_partkey AS film_id, p_type AS category_id FROM part),
category AS (SELECT DISTINCT p_type AS category_id, p_type AS name FROM part),
cust AS (SELECT c_custkey AS customer_id, c_name AS first_name, c_mktsegment AS last_name, c_nationkey AS address_id, c_custkey % 2 + 1 AS store_id, c_acctbal > 0 AS active FROM customer),
staff AS (SELECT s_suppkey AS staff_id, s_name AS first_name, 'N' || s_nationkey AS last_name, s_nationkey AS address_id, s_suppkey AS store_id FROM supplier),
store AS (SELECT s_suppkey AS store_id, s_suppkey AS manager_staff_id, s_nationkey AS address_id FROM supplier WHERE s_suppkey IN (1, 2)),
address AS (SELECT n_nationkey AS address_id, 'Street ' || n_nationkey AS address, NULL::VARCHAR AS postal_code, '+' || n_nationkey AS phone, n_nationkey AS city_id FROM nation),
city AS (SELECT n_nationkey AS city_id, n_name AS city, n_regionkey AS country_id FROM nation),
country AS (SELECT r_regionkey AS country_id, r_name AS country FROM region),
inventory AS (SELECT o_orderkey AS inventory_id, p AS film_id, o_orderkey % 2 + 1 AS store_id FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
rental AS (SELECT o_orderkey AS rental_id, o_orderdate AS rental_date, o_orderkey AS inventory_id, o_custkey AS customer_id,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_days((o_orderkey % 11)::INT) END AS return_date FROM orders),
payment AS (SELECT o_orderkey AS rental_id, o_custkey AS customer_id, o_totalprice AS amount, o_orderdate AS payment_date FROM orders)
"""


@query(_WITH + """SELECT customer_id AS id, first_name || ' ' || last_name AS name, address, postal_code AS zip_code, phone, city, country,
  CASE WHEN active THEN 'active' ELSE '' END AS notes, store_id AS sid FROM cust JOIN address USING (address_id) JOIN city USING (city_id) JOIN country USING (country_id)""")
def customer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.customer_list(tables(spark, sf_dir))


@query(_WITH + """SELECT staff_id AS id, first_name || ' ' || last_name AS name, address, postal_code AS zip_code, phone, city, country, store_id AS sid
  FROM staff JOIN address USING (address_id) JOIN city USING (city_id) JOIN country USING (country_id)""")
def staff_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.staff_list(tables(spark, sf_dir))


_FILMS = """SELECT f.film_id AS fid, f.title, f.description, c.name AS category, f.rental_rate AS price, f.length, f.rating, a.actors FROM film f
  LEFT JOIN film_category fc ON f.film_id = fc.film_id LEFT JOIN category c ON fc.category_id = c.category_id LEFT JOIN
  (SELECT film_id, string_agg({0} || ' ' || {1}, ', ' ORDER BY {0} || ' ' || {1}) AS actors FROM film_actor JOIN actor USING (actor_id) GROUP BY film_id) a ON f.film_id = a.film_id"""


@query(_WITH + _FILMS.format("first_name", "last_name"))
def film_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.film_list(tables(spark, sf_dir))


@query(_WITH + _FILMS.format(*[f"(upper({c}[1]) || lower({c}[2:]))" for c in ("first_name", "last_name")]))
def nicer_film_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.nicer_film_list(tables(spark, sf_dir))


@query(_WITH + """SELECT city || ',' || country AS store, first_name || ' ' || last_name AS manager, round(SUM(amount), 2) AS total_sales FROM payment JOIN rental USING (rental_id)
  JOIN inventory USING (inventory_id) JOIN store s USING (store_id) JOIN address a ON s.address_id = a.address_id JOIN city USING (city_id) JOIN country USING (country_id)
  JOIN staff m ON s.manager_staff_id = m.staff_id GROUP BY s.store_id, city, country, first_name, last_name""")
def sales_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.sales_by_store(tables(spark, sf_dir)).withColumn("total_sales", F.round("total_sales", 2)).orderBy("store")


@query(_WITH + """SELECT c.name AS category, round(SUM(amount), 2) AS total_sales FROM payment JOIN rental USING (rental_id) JOIN inventory USING (inventory_id)
  JOIN film_category fc USING (film_id) JOIN category c ON fc.category_id = c.category_id GROUP BY c.name""")
def sales_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.sales_by_category(tables(spark, sf_dir)).withColumn("total_sales", F.round("total_sales", 2)).orderBy(F.desc("total_sales"))


@query(_WITH + """SELECT actor_id, first_name, last_name, film_info FROM actor LEFT JOIN (SELECT actor_id, string_agg(line, '; ' ORDER BY line) AS film_info FROM
  (SELECT DISTINCT actor_id, name || ': ' || string_agg(title, ', ' ORDER BY title) AS line FROM film_actor JOIN film_category USING (film_id) JOIN category USING (category_id) JOIN film USING (film_id)
   GROUP BY actor_id, name) GROUP BY actor_id) USING (actor_id)""")
def actor_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.actor_info(tables(spark, sf_dir))


_AS_OF = dt.date(1996, 3, 15)


@query(_WITH + """SELECT *, COUNT(*) OVER () AS found FROM cust WHERE customer_id IN (SELECT customer_id FROM payment WHERE payment_date >= DATE '1996-02-01' AND payment_date < DATE '1996-03-01'
  GROUP BY 1 HAVING SUM(amount) > 1000 AND COUNT(*) > 1)""")
def rewards_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.counted(rental.rewards_report(tables(spark, sf_dir), 1, 1000.0, _AS_OF))


@query(_WITH + """, due AS (SELECT customer_id, SUM(rental_rate) AS fees, SUM(CASE WHEN date_diff('day', rental_date::DATE, return_date::DATE) - rental_duration > 0
    THEN date_diff('day', rental_date::DATE, return_date::DATE) - rental_duration ELSE 0 END) AS late
  FROM rental JOIN inventory USING (inventory_id) JOIN film USING (film_id) WHERE rental_date <= TIMESTAMP '1996-03-15' GROUP BY 1),
  paid AS (SELECT customer_id, SUM(amount) AS paid FROM payment WHERE payment_date <= TIMESTAMP '1996-03-15' GROUP BY 1)
  SELECT customer_id, round(COALESCE(fees, 0) + COALESCE(late, 0) - COALESCE(paid, 0), 2)::DOUBLE AS balance FROM cust LEFT JOIN due USING (customer_id) LEFT JOIN paid USING (customer_id)""")
def customer_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.customer_balance(tables(spark, sf_dir), dt.datetime(1996, 3, 15)).withColumn("balance", F.round("balance", 2))


@query(_WITH + "SELECT *, COUNT(*) OVER () AS found FROM inventory WHERE inventory_id NOT IN (SELECT inventory_id FROM rental WHERE return_date IS NULL)")
def film_in_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.counted(rental.film_in_stock(tables(spark, sf_dir)))


@query(_WITH + "SELECT *, COUNT(*) OVER () AS found FROM inventory WHERE inventory_id IN (SELECT inventory_id FROM rental WHERE return_date IS NULL)")
def film_not_in_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.counted(rental.film_not_in_stock(tables(spark, sf_dir)))


@query(_WITH + "SELECT i.inventory_id, r.customer_id FROM inventory i LEFT JOIN (SELECT * FROM rental WHERE return_date IS NULL) r ON i.inventory_id = r.inventory_id")
def inventory_held_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.inventory_held_by(tables(spark, sf_dir))


@query(_WITH + "SELECT inventory_id, inventory_id NOT IN (SELECT inventory_id FROM rental WHERE return_date IS NULL) AS in_stock FROM inventory")
def inventory_in_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rental.inventory_in_stock(tables(spark, sf_dir))
