"""The daily build at the limits of its ranges."""

import math
from datetime import datetime

from gridwarden.plans.daily import surface_days

REST = ("u10", "v10", "cape", "cin", "tcc", "lcc", "mcc", "hcc", "sp", "ssrd", "strd", "sshf", "slhf")


def test_values_in_target_units_keep_their_side_of_a_limit(spark):
    """A dewpoint just above 45 degC is masked; the way to kelvin and back would bring it to the limit itself."""
    above, hour = math.nextafter(45.0, 50.0), datetime(2024, 1, 1, 6)
    assert (above + 273.15) - 273.15 <= 45.0
    rows = [(hour, 20.0, 40.0 + k, 50.0, d, 1.0, 1.0, 45.0, 44.0, *[1.0] * len(REST)) for k, d in enumerate((above, 45.0))]
    single = spark.createDataFrame(rows, ["time", "latitude", "longitude", "t2m", "d2m", "tp", "cp", "mx2t", "mn2t", *REST])
    got = {r["longitude"]: r for r in surface_days(single, temperature="degC", depth="mm").collect()}
    assert got[40.0]["rh2m"] is None and got[41.0]["rh2m"] is not None
    assert all(r["tmax_c"] == 45.0 and r["hot_day_flag"] == 1 for r in got.values())
