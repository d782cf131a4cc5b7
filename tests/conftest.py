import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from mattone.session import local_session
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


def column(spark, expr_of, values, type_="string"):
    """Values of an expression over one column ``v``."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(expr_of(F.col("v"))).collect()]


NOW = datetime(2026, 9, 16, 12)
LISTING = ("id string, source_id string, listing_key string, url string, title string, description string, city string, zone string, address string, property_type string, "
           "condition string, price double, surface double, rooms double, bathrooms double, latitude double, longitude double, area_basis string, currency string, "
           "transaction_type string, availability string, is_auction boolean, first_seen timestamp_ntz, last_seen timestamp_ntz")


def listing(ident, price=200000.0, surface=100.0, **other):
    row = dict(id=ident, source_id="s1", listing_key=ident, url=f"https://x.example/{ident}", title="Ufficio da ristrutturare", description="", city="Milano", zone="Z1",
               address="Via Test 1", property_type="office", condition="good", price=price, surface=surface, rooms=None, bathrooms=None, latitude=None, longitude=None,
               area_basis="commercial", currency="EUR", transaction_type="sale", availability="listed", is_auction=False, first_seen=NOW, last_seen=NOW)
    return {**row, **other}


def frame(spark, rows):
    names = [c.split()[0] for c in LISTING.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], LISTING)
