"""Views and routines of a rental business, as functions of its tables.

``tables`` maps names to DataFrames with the columns of the rental schema. Every routine is one plan over whole tables;
routines that answer for one row take all rows, or a table of arguments, instead. Dimensions are joined without hints:
Spark broadcasts those that it measures to be small.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import between_days, previous_month
from ..functions.scalars import if_flag
from ..functions.text import capitalize_first, full_name

Tables = dict[str, DataFrame]


def _place(t: Tables, people: DataFrame) -> DataFrame:
    address = t["address"].select("address_id", "address", "postal_code", "phone", "city_id")
    city = t["city"].select("city_id", "city", "country_id")
    return people.join(address, "address_id").join(city, "city_id").join(t["country"].select("country_id", "country"), "country_id")


def customer_list(t: Tables) -> DataFrame:
    c = t["customer"].select("customer_id", "first_name", "last_name", "address_id", "store_id", "active")
    return _place(t, c).select(
        F.col("customer_id").alias("id"), full_name(F.col("first_name"), F.col("last_name")).alias("name"), "address", F.col("postal_code").alias("zip_code"), "phone", "city", "country",
        if_flag(F.col("active"), "active").alias("notes"), F.col("store_id").alias("sid"),
    )


def staff_list(t: Tables) -> DataFrame:
    s = t["staff"].select("staff_id", "first_name", "last_name", "address_id", "store_id")
    return _place(t, s).select(
        F.col("staff_id").alias("id"), full_name(F.col("first_name"), F.col("last_name")).alias("name"), "address", F.col("postal_code").alias("zip_code"), "phone", "city", "country", F.col("store_id").alias("sid")
    )


def film_list(t: Tables, nicer: bool = False) -> DataFrame:
    """Each film of each category with its actors, in order of name; films without category or actors stay."""
    shape = capitalize_first if nicer else lambda c: c
    name = F.concat(shape(F.col("first_name")), F.lit(" "), shape(F.col("last_name")))
    cast = t["film_actor"].select("film_id", "actor_id").join(t["actor"], "actor_id").groupBy("film_id").agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("actors"))
    film = t["film"].select("film_id", "title", "description", "rental_rate", "length", "rating")
    category = t["film_category"].select("film_id", "category_id").join(t["category"].select("category_id", F.col("name").alias("category")), "category_id")
    return film.join(category, "film_id", "left").join(cast, "film_id", "left").select(
        F.col("film_id").alias("fid"), "title", "description", "category", F.col("rental_rate").alias("price"), "length", "rating", "actors"
    )


def nicer_film_list(t: Tables) -> DataFrame:
    return film_list(t, nicer=True)


def sales_by_store(t: Tables) -> DataFrame:
    """Sales are summed by store before the store's place and manager are looked up."""
    sales = (
        t["payment"].select("rental_id", "amount").join(t["rental"].select("rental_id", "inventory_id"), "rental_id").join(t["inventory"].select("inventory_id", "store_id"), "inventory_id")
        .groupBy("store_id").agg(F.sum("amount").alias("total_sales"))
    )
    manager = t["staff"].select(F.col("staff_id").alias("manager_staff_id"), full_name(F.col("first_name"), F.col("last_name")).alias("manager"))
    return _place(t, sales.join(t["store"].select("store_id", "manager_staff_id", "address_id"), "store_id")).join(manager, "manager_staff_id").select(
        F.concat("city", F.lit(","), "country").alias("store"), "manager", "total_sales"
    )


def sales_by_category(t: Tables) -> DataFrame:
    """A film in two categories counts in both. Sales are summed by film first."""
    film = (
        t["payment"].select("rental_id", "amount").join(t["rental"].select("rental_id", "inventory_id"), "rental_id").join(t["inventory"].select("inventory_id", "film_id"), "inventory_id")
        .groupBy("film_id").agg(F.sum("amount").alias("a"))
    )
    return (
        film.join(t["film_category"].select("film_id", "category_id"), "film_id").groupBy("category_id").agg(F.sum("a").alias("total_sales"))
        .join(t["category"].select("category_id", F.col("name").alias("category")), "category_id").select("category", "total_sales")
    )


def actor_info(t: Tables) -> DataFrame:
    """Each actor with 'category: title, title; category: ...'; NULL without films."""
    credit = (
        t["film_actor"].select("actor_id", "film_id").join(t["film_category"].select("film_id", "category_id"), "film_id").join(t["category"].select("category_id", "name"), "category_id")
        .join(t["film"].select("film_id", "title"), "film_id")
    )
    line = credit.groupBy("actor_id", "name").agg(F.concat("name", F.lit(": "), F.array_join(F.array_sort(F.collect_list("title")), ", ")).alias("line"))
    info = line.groupBy("actor_id").agg(F.array_join(F.array_sort(F.collect_set("line")), "; ").alias("film_info"))
    return t["actor"].select("actor_id", "first_name", "last_name").join(info, "actor_id", "left")


def rewards_report(t: Tables, min_purchases: int, min_amount: float, as_of: dt.date) -> DataFrame:
    """Customers with more than both limits in the month before ``as_of``; limits have to be above 0."""
    if min_purchases <= 0:
        raise ValueError("min_purchases has to be above 0")
    if min_amount <= 0:
        raise ValueError("min_amount has to be above 0")
    paid = t["payment"].where(between_days(F.col("payment_date"), *previous_month(as_of)))
    best = paid.groupBy("customer_id").agg(F.sum("amount").alias("_s"), F.count("customer_id").alias("_n")).where((F.col("_s") > min_amount) & (F.col("_n") > min_purchases))
    return t["customer"].join(best, "customer_id", "left_semi")


def customer_balance(t: Tables, as_of: dt.datetime) -> DataFrame:
    """(customer_id, balance) of every customer: rental fees, a unit for each day beyond the rental's duration, less
    payments, all up to ``as_of``."""
    upto = F.lit(as_of).cast("timestamp_ntz")
    item = t["inventory"].select("inventory_id", "film_id").join(t["film"].select("film_id", "rental_rate", "rental_duration"), "film_id")
    rented = t["rental"].where(F.col("rental_date") <= upto).select("customer_id", "inventory_id", "rental_date", "return_date").join(item, "inventory_id")
    days = F.datediff("return_date", "rental_date") - F.col("rental_duration")
    due = rented.groupBy("customer_id").agg(F.sum("rental_rate").alias("fees"), F.sum(F.when(days > 0, days).otherwise(0)).alias("late"))
    paid = t["payment"].where(F.col("payment_date") <= upto).groupBy("customer_id").agg(F.sum("amount").alias("paid"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return t["customer"].select("customer_id").join(due, "customer_id", "left").join(paid, "customer_id", "left").select("customer_id", (zero("fees") + zero("late") - zero("paid")).alias("balance"))


def counted(rows: DataFrame, name: str = "found") -> DataFrame:
    """The rows of a routine with the number of them, which it returns besides."""
    return rows.join(F.broadcast(rows.agg(F.count("*").alias(name))))


def _open(t: Tables) -> DataFrame:
    return t["rental"].where("return_date is null").select("inventory_id")


def film_in_stock(t: Tables, film: Column | None = None) -> DataFrame:
    """Items without an open rental; ``film`` narrows the inventory."""
    items = t["inventory"] if film is None else t["inventory"].where(film)
    return items.select("inventory_id", "film_id", "store_id").join(_open(t), "inventory_id", "left_anti")


def film_not_in_stock(t: Tables, film: Column | None = None) -> DataFrame:
    items = t["inventory"] if film is None else t["inventory"].where(film)
    return items.select("inventory_id", "film_id", "store_id").join(_open(t), "inventory_id", "left_semi")


def inventory_held_by(t: Tables) -> DataFrame:
    """(inventory_id, customer_id) of every item, NULL if nobody has it; several open rentals of an item raise."""
    held = t["rental"].where("return_date is null").groupBy("inventory_id").agg(F.max("customer_id").alias("customer_id"), F.count("*").alias("_n"))
    one = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several open rentals of item "), F.col("inventory_id").cast("string"))).cast("long")).otherwise(F.col("customer_id"))
    return t["inventory"].select("inventory_id").join(held, "inventory_id", "left").select("inventory_id", one.alias("customer_id"))


def inventory_in_stock(t: Tables, asked: DataFrame | None = None) -> DataFrame:
    """(inventory_id, in_stock); unknown items are in stock."""
    asked = t["inventory"] if asked is None else asked
    open_ = _open(t).distinct().withColumn("_open", F.lit(True))
    return asked.select("inventory_id").join(open_, "inventory_id", "left").select("inventory_id", F.coalesce(~F.col("_open"), F.lit(True)).alias("in_stock"))
