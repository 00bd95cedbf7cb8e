"""The delay feature table on rows that stand for its edges."""

import math
from datetime import date, datetime

import pytest

from quern.operators.logistics import CATEGORICAL, NUMERICAL, delay_features
from quern.sources.schemas import KEYS, LOGISTICS, load_csv


def table(spark, name, *rows):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(LOGISTICS[name])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


@pytest.fixture(scope="module")
def features(spark):
    at = lambda h, m=0, d=5: datetime(2024, 3, d, h, m)
    event = lambda i, trip, load, kind, planned, actual: {"event_id": i, "trip_id": trip, "load_id": load, "event_type": kind, "scheduled_datetime": planned, "actual_datetime": actual, "detention_minutes": 3}
    tables = {
        "delivery_events": table(
            spark, "delivery_events", event("e1", "t1", "l1", "Delivery", at(8), at(8, 30)), event("e2", "t2", "l2", "Delivery", at(23), at(22, 50)), event("e3", "none", "l1", "Delivery", at(8), at(9)),
            event("p1", "t1", "l1", "Pickup", at(1), at(1, 10)), event("p2", "t1", "l1", "Pickup", at(2), at(2, 20)),
        ),
        "trips": table(spark, "trips", {"trip_id": "t1", "driver_id": "d1", "truck_id": "k1", "dispatch_date": date(2024, 3, 1)}, {"trip_id": "t2", "driver_id": "d2", "truck_id": None, "dispatch_date": date(2024, 3, 4)}),
        "loads": table(spark, "loads", {"load_id": "l1", "route_id": "r1", "weight_lbs": 1000, "revenue": 800.0, "load_type": "dry"}, {"load_id": "l2", "route_id": "r2", "revenue": 50.0}),
        "routes": table(spark, "routes", {"route_id": "r1", "typical_distance_miles": 1600.0, "origin_state": "TX"}, {"route_id": "r2", "typical_distance_miles": 0.0}),
        "drivers": table(spark, "drivers", {"driver_id": "d1", "hire_date": date(2024, 3, 1)}, {"driver_id": "d2", "hire_date": date(2025, 1, 1)}),
        "trucks": table(spark, "trucks", {"truck_id": "k1", "model_year": 2020}),
        "driver_monthly_metrics": table(spark, "driver_monthly_metrics", *[{"driver_id": "d1", "month": date(2024, m, 1), "on_time_delivery_rate": float(m)} for m in (1, 2, 3)]),
    }
    return {r.event_id: r for r in delay_features(tables).collect()}


def test_rows_and_columns(features):
    assert set(features) == {"e1", "e2"} and len(NUMERICAL) + len(CATEGORICAL) == 39


def test_values(features):
    a, b = features["e1"], features["e2"]
    assert a.delay_minutes == 30 and a.pickup_delay_minutes == 15 and a.driver_on_time_rate_prev == 2.0  # February is known from the day of dispatch on
    assert (a.truck_age_years, a.driver_tenure_days, a.is_long_haul, a.is_rush_hour, a.is_night, a.is_winter, a.sched_season) == (4, 4, 1, 1, 0, 0, 1)
    assert a.distance_x_weight == 1.6 and a.revenue_per_mile == 0.5 and a.log_distance == pytest.approx(math.log1p(1600))
    assert b.delay_minutes == -10 and b.pickup_delay_minutes is None and b.driver_on_time_rate_prev is None
    assert (b.truck_age_years, b.driver_tenure_days, b.is_long_haul, b.is_night, b.revenue_per_mile, b.log_weight) == (None, 0, 0, 1, 50.0, 0.0)


def test_csv_of_every_table(spark, tmp_path):
    for name, schema in LOGISTICS.items():
        (tmp_path / f"{name}.csv").write_text(",".join(c.split()[0] for c in schema.split(", ")) + "\n")
    tables = load_csv(spark, f"file://{tmp_path}")
    assert set(tables) == set(KEYS) and all(t.count() == 0 and set(KEYS[n]) <= set(t.columns) for n, t in tables.items())
