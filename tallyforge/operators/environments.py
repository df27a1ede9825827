"""Environments as DataFrames: reads as relational queries, writes as one ordered group per test."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.environments import BAG_FEE, BAGS, run_calls


def transfers(flights: DataFrame, origin: str | None = None, via: str | None = None, destination: str | None = None) -> DataFrame:
    """(first_flight, second_flight, origin, via, destination, arrival, departure): an available flight and one on from there that leaves later."""
    free = flights.where("status = 'available'")
    a = free.select(F.col("flight_no").alias("first_flight"), "origin", F.col("destination").alias("via"), F.to_timestamp("arrival_time").alias("arrival"))
    b = free.select(F.col("flight_no").alias("second_flight"), F.col("origin").alias("via"), "destination", F.to_timestamp("depart_time").alias("departure"))
    for name, value in (("origin", origin), ("via", via)):
        a = a if value is None else a.where(F.col(name) == value)
    for name, value in (("destination", destination), ("via", via)):
        b = b if value is None else b.where(F.col(name) == value)
    return a.join(b, "via").where(F.col("arrival") < F.col("departure")).select("first_flight", "second_flight", "origin", "via", "destination", "arrival", "departure")


def flight_details(flights: DataFrame, origin: str | None = None, destination: str | None = None) -> DataFrame:
    out = flights
    for name, value in (("origin", origin), ("destination", destination)):
        out = out.where(F.col(name) == value) if value else out
    return out


def user_details(users: DataFrame, user_id: str, password: str) -> DataFrame:
    return users.where((F.col("user_id") == user_id) & (F.col("password") == password)).drop("password")


def reservation_details(reservations: DataFrame, flights: DataFrame) -> DataFrame:
    """reservations with flight_info: the first flight of that number by position, null without one."""
    infos = flights.withColumn("__row", F.row_number().over(Window.partitionBy("flight_no").orderBy("position"))).where("__row = 1").drop("__row")
    infos = infos.select(F.col("flight_no"), F.struct(*(c for c in flights.columns if c != "position")).alias("flight_info"))
    return reservations.join(infos, "flight_no", "left")


def bag_allowance(level: Column, cabin: Column) -> Column:
    found = F.lit(0)
    for (l, c), n in BAGS.items():
        found = F.when((level == l) & (cabin == c), n).otherwise(found)
    return found


def bag_fee(level: Column, cabin: Column, count: Column) -> Column:
    return F.greatest(count - bag_allowance(level, cabin), F.lit(0)) * BAG_FEE


def cabin_price(cabin: Column, economy: Column, business: Column) -> Column:
    return F.when(cabin == "Economy Class", economy).when(cabin == "Business Class", business).otherwise(0)


def order_totals(items: DataFrame, menus: DataFrame) -> DataFrame:
    """(order_id, total, missing): sum of price times quantity, and how many items are on no menu. items: order_id, merchant, product, quantity; menus: merchant, product, price, position."""
    first = menus.groupBy("merchant", "product").agg(F.min_by("price", "position").alias("price"))
    return items.join(first, ["merchant", "product"], "left").groupBy("order_id").agg(F.sum(F.col("price") * F.col("quantity")).alias("total"), F.count_if(F.col("price").isNull()).alias("missing"))


def search_orders(orders: DataFrame, keyword: str) -> DataFrame:
    """Orders with the word in the merchant's name or in a product's, in any case. orders has merchant_name and items (array of structs with product)."""
    has = lambda c: F.lower(c).contains(keyword.lower())
    return orders.where(has(F.col("merchant_name")) | F.exists("items", lambda i: has(i["product"])))


def messages_between(messages: DataFrame, users: DataFrame, sender: str, receiver: str) -> DataFrame:
    ids = users.select("name", "user_id")
    a = ids.where(F.col("name") == sender).select(F.col("user_id").alias("sender_id"), F.col("name").alias("sender"))
    b = ids.where(F.col("name") == receiver).select(F.col("user_id").alias("receiver_id"), F.col("name").alias("receiver"))
    return messages.join(a, "sender_id").join(b, "receiver_id").select("id", "sender", "receiver", "message")


def search_messages(messages: DataFrame, users: DataFrame, name: str, keyword: str) -> DataFrame:
    who = users.where(F.col("name") == name).select(F.col("user_id").alias("__who"))
    return messages.join(who, (F.col("sender_id") == F.col("__who")) | (F.col("receiver_id") == F.col("__who"))).where(F.lower("message").contains(keyword.lower())).drop("__who")


def extreme(df: DataFrame, group: list[str], value: str, at: Column, order: Column) -> DataFrame:
    """(group, latest, earliest): the value at the latest and at the earliest time; of equal times the first by order."""
    late = F.max_by(value, F.struct(at, -order.cast("long")))
    return df.groupBy(*group).agg(late.alias("latest"), F.min_by(value, F.struct(at, order.cast("long"))).alias("earliest"))


def replay(states: DataFrame, calls: DataFrame) -> DataFrame:
    """(test_id, step, result): each test's calls, in order of step, on a world of its own; after them a row of step null with what the worlds save.

    states has test_id and state, calls test_id, step, name and arguments; state and arguments are JSON. A task holds one test at a time.
    """
    both = calls.join(states, "test_id").select("test_id", "step", "name", "arguments", "state")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("step", kind="stable")
        results, saved = run_calls(json.loads(part["state"].iloc[0]), [(n, json.loads(a) if a else {}) for n, a in zip(part["name"], part["arguments"])])
        return pd.DataFrame({"test_id": part["test_id"].iloc[0], "step": pd.array([*part["step"], None], "Int64"), "result": [json.dumps(r, default=str, ensure_ascii=False, sort_keys=True) for r in [*results, saved]]})

    kind = dict(both.dtypes)["test_id"]
    return both.groupBy("test_id").applyInPandas(run, f"test_id {kind}, step long, result string")


def tool_configs(functions: DataFrame) -> DataFrame:
    """functions (name, description, properties: map of structs, required: array) with each parameter's required flag in the map's structs."""
    with_flag = F.transform_values("properties", lambda k, v: F.struct(v["type"].alias("type"), v["description"].alias("description"), F.array_contains(F.coalesce("required", F.array().cast("array<string>")), k).alias("required")))
    return functions.select("name", "description", with_flag.alias("parameters"))
