"""Schemas of the logistics star, as DDL. Column names and types are fixed values of its CSV and database tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.sources.files import read_csv

LOGISTICS = {
    "drivers": "driver_id string, first_name string, last_name string, hire_date date, termination_date date, license_number string, license_state string, date_of_birth date, home_terminal string, employment_status string, cdl_class string, years_experience int",
    "trucks": "truck_id string, unit_number int, make string, model_year int, vin string, acquisition_date date, acquisition_mileage double, fuel_type string, tank_capacity_gallons double, status string, home_terminal string",
    "trailers": "trailer_id string, trailer_number int, trailer_type string, length_feet int, model_year int, vin string, acquisition_date date, status string, current_location string",
    "customers": "customer_id string, customer_name string, customer_type string, credit_terms_days int, primary_freight_type string, account_status string, contract_start_date date, annual_revenue_potential double",
    "facilities": "facility_id string, facility_name string, facility_type string, city string, state string, latitude double, longitude double, dock_doors int, operating_hours string",
    "routes": "route_id string, origin_city string, origin_state string, destination_city string, destination_state string, typical_distance_miles double, base_rate_per_mile double, fuel_surcharge_rate double, typical_transit_days int",
    "loads": "load_id string, customer_id string, route_id string, load_date date, load_type string, weight_lbs int, pieces int, revenue double, fuel_surcharge double, accessorial_charges double, load_status string, booking_type string",
    "trips": "trip_id string, load_id string, driver_id string, truck_id string, trailer_id string, dispatch_date date, actual_distance_miles double, actual_duration_hours double, fuel_gallons_used double, average_mpg double, idle_time_hours double, trip_status string",
    "fuel_purchases": "fuel_purchase_id string, trip_id string, truck_id string, driver_id string, purchase_date timestamp, location_city string, location_state string, gallons double, price_per_gallon double, total_cost double, fuel_card_number string",
    "maintenance_records": "maintenance_id string, truck_id string, maintenance_date date, maintenance_type string, odometer_reading double, labor_hours double, labor_cost double, parts_cost double, total_cost double, facility_location string, downtime_hours double, service_description string",
    "delivery_events": "event_id string, load_id string, trip_id string, event_type string, facility_id string, scheduled_datetime timestamp, actual_datetime timestamp, detention_minutes int, on_time_flag boolean, location_city string, location_state string",
    "safety_incidents": "incident_id string, trip_id string, truck_id string, driver_id string, incident_date timestamp, incident_type string, location_city string, location_state string, at_fault_flag boolean, injury_flag boolean, vehicle_damage_cost double, cargo_damage_cost double, claim_amount double, preventable_flag boolean, description string",
    "driver_monthly_metrics": "driver_id string, month date, trips_completed int, total_miles double, total_revenue double, average_mpg double, total_fuel_gallons double, on_time_delivery_rate double, average_idle_hours double",
    "truck_utilization_metrics": "truck_id string, month date, trips_completed int, total_miles double, total_revenue double, average_mpg double, maintenance_events int, maintenance_cost double, downtime_hours double, utilization_rate double",
}
#: Keys by which a table is merged.
KEYS = {
    "drivers": ["driver_id"], "trucks": ["truck_id"], "trailers": ["trailer_id"], "customers": ["customer_id"], "facilities": ["facility_id"], "routes": ["route_id"], "loads": ["load_id"],
    "trips": ["trip_id"], "fuel_purchases": ["fuel_purchase_id"], "maintenance_records": ["maintenance_id"], "delivery_events": ["event_id"], "safety_incidents": ["incident_id"],
    "driver_monthly_metrics": ["driver_id", "month"], "truck_utilization_metrics": ["truck_id", "month"],
}


def load_csv(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of the star from <folder>/<table>.csv."""
    return {name: read_csv(spark, f"{folder}/{name}.csv", schema) for name, schema in LOGISTICS.items()}
