"""Random trips with a hot route, and a plain-Python view of them."""

import datetime as dt
import random

SCHEMA = (
    "id int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, passenger_count double, "
    "trip_distance double, PULocationID bigint, DOLocationID bigint, payment_type bigint, fare_amount double, "
    "tip_amount double, total_amount double"
)


def make_trips(n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        pickup = dt.datetime(2023, 1, 1) + dt.timedelta(seconds=rnd.randrange(40 * 86400))
        hot = rnd.random() < 0.33
        fare = round(rnd.uniform(-5, 90), 2)
        tip = round(rnd.uniform(0, 20), 2)
        rows.append(
            (
                i,
                pickup,
                pickup + dt.timedelta(seconds=rnd.randrange(0, 8000)),
                rnd.choice([None, 0.0, 1.0, 2.0, 7.0]),
                round(rnd.uniform(0, 30), 1),
                1 if hot else rnd.choice([None, *range(1, 9)]),
                2 if hot else rnd.randrange(1, 9),
                rnd.randrange(1, 7),
                fare,
                tip,
                round(fare + tip, 2),
            )
        )
    return rows


def as_dicts(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return [dict(zip(names, r)) for r in rows]
