from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import environments as W
from tallyforge.operators import environments as O

FLIGHTS = [
    {"flight_no": "A1", "origin": "X", "destination": "Y", "depart_time": "2024-07-16 08:00:00", "arrival_time": "2024-07-16 10:00:00", "status": "available", "seats_available": 1, "economy_price": 100.0, "business_price": 300.0},
    {"flight_no": "A2", "origin": "Y", "destination": "Z", "depart_time": "2024-07-16 11:00:00", "arrival_time": "2024-07-16 12:00:00", "status": "available", "seats_available": 5, "economy_price": 50.0, "business_price": 90.0},
    {"flight_no": "A3", "origin": "Y", "destination": "Z", "depart_time": "2024-07-16 09:00:00", "arrival_time": "2024-07-16 09:30:00", "status": "available", "seats_available": 5, "economy_price": 50.0, "business_price": 90.0},
    {"flight_no": "A4", "origin": "X", "destination": "Y", "depart_time": "2024-07-14 20:00:00", "arrival_time": "2024-07-14 22:00:00", "status": "available", "seats_available": 5, "economy_price": 120.0, "business_price": 200.0},
]
TRAVEL = {"users": {"u": {"user_name": "U", "password": "p", "cash_balance": 1000.0, "bank_balance": 10.0, "membership_level": "regular"}}, "flights": FLIGHTS, "reservations": []}


@pytest.fixture
def travel():
    return W.Travel(copy.deepcopy(TRAVEL))


def test_travel_reads(travel):
    assert len(travel.get_flight_details("X")["flights"]) == 2 and not travel.get_flight_details("Q")["ok"]
    assert "password" not in travel.get_user_details("u", "p")["user"] and not travel.get_user_details("u", "x")["ok"]
    assert [(t["first_leg"]["flight_no"], t["second_leg"]["flight_no"]) for t in travel.find_transfer_flights("X", "Y", "Z")["transfers"]] == [("A1", "A2"), ("A4", "A2"), ("A4", "A3")]
    assert travel.get_baggage_allowance("gold", "Business Class")["bags"] == 3 and travel.get_baggage_allowance("none", "x")["bags"] == 0
    assert W.bag_fee("regular", "Economy Class", 3) == 100 and W.cabin_difference(FLIGHTS[0], "Economy Class", "odd") == -100


def test_travel_writes(travel):
    assert not travel.reserve_flight("u", "x", "A1", "Economy Class", "cash", 1)["ok"]
    assert not travel.reserve_flight("u", "p", "A1", "Economy Class", "bank", 1)["ok"]
    first = travel.reserve_flight("u", "p", "A1", "Economy Class", "cash", 3)
    assert first["reservation_id"] == "res_1" and first["cost"] == 200 and travel.state["flights"][0]["seats_available"] == 0
    assert travel.reserve_flight("u", "p", "A1", "Economy Class", "cash", 0)["ok"]  # seats never run out
    assert "cabin paid 200.0" in travel.modify_flight("u", "res_1", "A4", "Business Class")["message"]  # priced on the old flight
    assert travel._first("reservations", reservation_id="res_1")["flight_no"] == "A4"
    assert not travel.modify_flight("u", "res_1", "A2")["ok"]
    soon = travel.cancel_reservation("u", "res_1", "I changed my mind")
    assert soon["fee"] == pytest.approx(20) and soon["refund"] == pytest.approx(180) and len(travel.state["reservations"]) == 2
    assert travel.cancel_reservation("u", "res_1", "The airline has canceled the flight.")["fee"] == 0
    assert travel.cancel_reservation("u", "res_2", "no")["fee"] == 0  # more than a day ahead


def test_food():
    food = W.Food({"users": {"a": {"password": "p", "balance": 10.0}}, "merchants": {"M": {"menu": [{"product": "tea", "price": 3.0}]}}})
    assert food.login_food_platform("a", "p")["message"] == "Wi-Fi is off"
    food.turn_on_wifi()
    assert food.login_food_platform("b", "p")["message"] == "no such user" and food.login_food_platform("a", "x")["message"] == "wrong password"
    assert food.login_food_platform("a", "p")["ok"] and food.login_food_platform("a", "p")["message"] == "logged in already"
    assert not food.add_food_delivery_order("a", "M", [{"product": "tea", "quantity": 0}])["ok"] and not food.add_food_delivery_order("a", "M", [{"product": "x"}])["ok"]
    assert food.add_food_delivery_order("a", "M", [{"product": "tea", "quantity": 2}])["total"] == 6 and food.check_balance("a")["balance"] == 4
    assert food.add_food_delivery_order("a", "M", [{"product": "tea", "quantity": 2}])["message"] == "the balance is too low"
    assert food.search_orders("TEA")["ok"] and not food.search_orders("cake")["ok"] and food.view_orders("a")["ok"] and food.check_balance("z")["balance"] == 0


def test_messages_and_reminders():
    people = {"A": {"user_id": 1}, "B": {"user_id": 2}}
    m = W.Messages({"users": people, "inbox": {1: {"sender_id": 1, "receiver_id": 2, "message": "Hi", "time": "2024-01-02"}, 2: {"sender_id": 2, "receiver_id": 1, "message": "yo", "time": "2024-01-02"}}})
    assert m.get_latest_message_id()["message_id"] == 1 and m.get_earliest_message_id()["message_id"] == 1  # ties: the first
    assert m.send_message("A", "B", "x")["message"] == "Wi-Fi is off"
    m.turn_on_wifi()
    assert m.send_message("A", "B", "x")["message_id"] == 3
    with pytest.raises(KeyError):  # it has no time
        m.get_latest_message_id()
    assert [x["id"] for x in m.view_messages_between_users("A", "B")["messages"]] == [1, 3] and len(m.search_messages("B", "HI")["messages"]) == 1
    assert m.delete_message(3)["ok"] and not m.delete_message(3)["ok"]
    r = W.Reminders({"reminders": {1: {"title": "t", "description": "Big", "time": "x", "notified": False}}, "capacity": 2})
    assert r.add_reminder("n", "d", "t")["reminder_id"] == 2 and not r.add_reminder("n", "d", "t")["ok"]
    assert r.search_reminders("bIG")["ok"] and r.mark_as_notified(1)["ok"] and r.view_all_reminders()["reminders"][0]["notified"]
    assert r.delete_reminder(1)["ok"] and not r.view_reminder_by_title("t")["ok"]


def test_dispatch_and_faults():
    state = {"device": {"wifi": True}, "messages": {"users": {}, "wifi": False}, "reminders": {"reminders": {}}}
    results, saved = W.run_calls(state, [("nothing", {}), ("add_reminder", {"title": "a"}), ("add_reminder", {"title": "a", "description": "b", "time": "c"}), ("_extreme", {"choose": 1})])
    assert [r["ok"] for r in results] == [False, False, True, False] and list(saved) == ["messages", "reminders"] and saved["reminders"]["reminders"]


def test_replay_equals_plain_calls(spark):
    state = {"travel": TRAVEL}
    calls = [("reserve_flight", {"user_id": "u", "password": "p", "flight_no": "A1", "cabin": "Economy Class", "payment_method": "cash", "baggage_count": 1}), ("get_reservation_details", {"user_id": "u"})]
    rows = [(t, k, n, json.dumps(a)) for t in ("x", "y") for k, (n, a) in enumerate(calls)]
    found = O.replay(spark.createDataFrame([(t, json.dumps(state)) for t in "xy"], "test_id string, state string"), spark.createDataFrame(rows[::-1], "test_id string, step int, name string, arguments string")).collect()
    results, saved = W.run_calls(copy.deepcopy(state), calls)
    for t in "xy":
        got = {r["step"]: json.loads(r["result"]) for r in found if r["test_id"] == t}
        assert got == {0: results[0], 1: json.loads(json.dumps(results[1])), None: json.loads(json.dumps(saved))}


def test_relational_reads(spark):
    flights = spark.createDataFrame([(k, *(f[c] for c in ("flight_no", "origin", "destination", "depart_time", "arrival_time", "status"))) for k, f in enumerate(FLIGHTS)], "position int, flight_no string, origin string, destination string, depart_time string, arrival_time string, status string")
    assert sorted((r["first_flight"], r["second_flight"]) for r in O.transfers(flights, "X", "Y", "Z").collect()) == [("A1", "A2"), ("A4", "A2"), ("A4", "A3")]
    held = spark.createDataFrame([("r1", "A1"), ("r2", "none")], "reservation_id string, flight_no string")
    assert {r["reservation_id"]: r["flight_info"] is None for r in O.reservation_details(held, flights).collect()} == {"r1": False, "r2": True}
    items = spark.createDataFrame([(1, "M", "tea", 2), (1, "M", "cake", 1), (2, "M", "tea", 1)], "order_id int, merchant string, product string, quantity int")
    menus = spark.createDataFrame([("M", "tea", 3.0, 1), ("M", "tea", 9.0, 2)], "merchant string, product string, price double, position int")
    assert {r["order_id"]: (r["total"], r["missing"]) for r in O.order_totals(items, menus).collect()} == {1: (6.0, 1), 2: (3.0, 0)}
    times = spark.createDataFrame([("g", 1, "2024-01-02"), ("g", 2, "2024-01-02"), ("g", 3, "2024-01-01")], "g string, id int, time string")
    row = O.extreme(times, ["g"], "id", F.to_date("time"), F.col("id")).first()
    assert (row["latest"], row["earliest"]) == (1, 3)
    fees = spark.createDataFrame([("gold", "Economy Class", 5), ("x", "y", 1)], "l string, c string, n int").select(O.bag_fee(F.col("l"), F.col("c"), F.col("n")).alias("fee"))
    assert [r["fee"] for r in fees.collect()] == [100, 50]
