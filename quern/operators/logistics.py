"""The delay feature table of the logistics star: one row for each delivery, nothing in it that is known only afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import tabular as B

CATEGORICAL = ["load_type", "booking_type", "origin_state", "destination_state", "employment_status", "fuel_type"]
NUMERICAL = [
    "typical_distance_miles", "base_rate_per_mile", "fuel_surcharge_rate", "typical_transit_days", "weight_lbs", "pieces", "revenue", "fuel_surcharge", "accessorial_charges", "detention_minutes",
    "years_experience", "truck_model_year", "tank_capacity_gallons", "truck_age_years", "driver_tenure_days", "driver_on_time_rate_prev", "driver_avg_mpg_prev", "driver_avg_idle_prev", "pickup_delay_minutes",
    "sched_month", "sched_quarter", "sched_day_of_week", "sched_hour", "sched_is_weekend", "sched_season", "distance_x_weight", "is_long_haul", "is_rush_hour", "is_night", "is_winter", "log_distance", "log_weight", "revenue_per_mile",
]
TARGET, TIME = "delay_minutes", "scheduled_datetime"


def delays(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).withColumn("delay", B.minutes_between("actual_datetime", "scheduled_datetime"))


def delay_features(tables: dict[str, DataFrame]) -> DataFrame:
    """Deliveries joined with their trip (inner), load, route, driver and truck (left), the driver's figures of the latest
    month before dispatch, and the mean delay of the trip's pickups. Flags of unknown values are 0; a distance of 0 or none
    counts as 1 where it divides.

    Facts join facts on their keys; dimensions are left to adaptive execution, which broadcasts what proves small.
    """
    delivery = delays(tables["delivery_events"], "Delivery").select("event_id", "trip_id", "load_id", TIME, "detention_minutes", F.col("delay").alias(TARGET))
    pickup = delays(tables["delivery_events"], "Pickup").groupBy("trip_id").agg(F.avg("delay").alias("pickup_delay_minutes"))
    trips = tables["trips"].select("trip_id", "driver_id", "truck_id", "dispatch_date")
    loads = tables["loads"].select("load_id", "route_id", "load_type", "weight_lbs", "pieces", "revenue", "fuel_surcharge", "accessorial_charges", "booking_type")
    routes = tables["routes"].select("route_id", "origin_state", "destination_state", "typical_distance_miles", "base_rate_per_mile", "fuel_surcharge_rate", "typical_transit_days")
    drivers = tables["drivers"].select("driver_id", "hire_date", "years_experience", "employment_status")
    trucks = tables["trucks"].select("truck_id", F.col("model_year").alias("truck_model_year"), "fuel_type", "tank_capacity_gallons")
    rows = delivery.join(trips, "trip_id").join(pickup, "trip_id", "left").join(loads, "load_id", "left").join(routes, "route_id", "left").join(drivers, "driver_id", "left").join(trucks, "truck_id", "left")
    known = tables["driver_monthly_metrics"].select(
        "driver_id", F.add_months(F.trunc("month", "MM"), 1).alias("known_from"), F.col("on_time_delivery_rate").alias("driver_on_time_rate_prev"), F.col("average_mpg").alias("driver_avg_mpg_prev"),
        F.col("average_idle_hours").alias("driver_avg_idle_prev"),
    )
    rows = B.asof_join(rows, known, "driver_id", "dispatch_date", "known_from", ["driver_on_time_rate_prev", "driver_avg_mpg_prev", "driver_avg_idle_prev"])
    rows = rows.withColumns({{"weekday": "sched_day_of_week", "is_weekend": "sched_is_weekend"}.get(k, f"sched_{k}"): c for k, c in B.date_parts(TIME).items()})
    hour, miles = F.col("sched_hour"), F.col("typical_distance_miles")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    none = F.lit(0)
    return rows.withColumns(
        {
            "truck_age_years": F.when(F.col("truck_model_year").isNotNull(), F.greatest(F.year(TIME) - F.col("truck_model_year"), none)),
            "driver_tenure_days": F.when(F.col("hire_date").isNotNull(), F.greatest(F.datediff(F.col(TIME), "hire_date"), none)),
            "distance_x_weight": F.coalesce(miles, none) * F.coalesce("weight_lbs", none) / 1e6,
            "is_long_haul": flag(miles > 1500),
            "is_rush_hour": flag(hour.between(7, 9) | hour.between(16, 19)),
            "is_night": flag((hour >= 22) | (hour <= 4)),
            "is_winter": flag(F.col("sched_month").isin(12, 1, 2)),
            "log_distance": F.log1p(F.coalesce(miles, F.lit(0.0))),
            "log_weight": F.log1p(F.coalesce(F.col("weight_lbs").cast("double"), F.lit(0.0))),
            "revenue_per_mile": F.coalesce("revenue", F.lit(0.0)) / F.coalesce(F.nullif(miles, F.lit(0.0)), F.lit(1.0)),
        }
    ).select("event_id", "trip_id", TIME, *NUMERICAL, *CATEGORICAL, TARGET)
