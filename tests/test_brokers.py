"""The advertiser directory: groups by contact, values by frequency, filters, order."""
from datetime import timedelta

from pyspark.sql import functions as F

from conftest import LISTING, NOW, listing
from mattone.operators import brokers

CONTACT = ", telephone string, email string, contact_name string, organization string"
SOURCES = "source_id string, source_name string"


def advertised(spark, rows):
    names = [c.split()[0] for c in (LISTING + CONTACT).split(", ")]
    whole = [{**listing(ident, **{k: v for k, v in other.items()}), **{c: other.get(c) for c in ("telephone", "email", "contact_name", "organization")}} for ident, other in rows]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in whole], LISTING + CONTACT)


def directory(spark, rows, **filters):
    df = advertised(spark, rows)
    sources = spark.createDataFrame([("s1", "Portale Uno"), ("s2", "Portale Due")], SOURCES)
    return brokers.broker_directory(df, brokers.advertiser_components(df), sources, **filters)


ROWS = [
    ("a", dict(telephone="+39 02 123456", contact_name="Anna  Neri", organization="Studio A", price=100.4)),
    ("b", dict(telephone="02 123456", email="Anna@studio.example", contact_name="Anna Neri", city="Monza", source_id="s2", price=200.2, last_seen=NOW + timedelta(days=1))),
    ("c", dict(email="anna@studio.example", contact_name="A. Neri", price=900.0, currency="USD", zone="Z2")),
    ("d", dict(contact_name="Studio B")),
    ("e", dict(organization="STUDIO  B", contact_name="Bruno", price=None)),
    ("f", dict(contact_name="Carlo", availability="sold")),
    ("g", dict(telephone="12", email="none")),
    ("h", dict(email="x@y.example", description="Vendita diretta da proprietario, senza agenzie.", price=0.0)),
]


def test_contacts_seen_together_are_one_advertiser(spark):
    got = {r["advertiser"]: r for r in directory(spark, ROWS).collect()}
    assert len(got) == 3
    anna = next(r for r in got.values() if r["count"] == 3)
    assert (anna["name"], anna["organization"], anna["email"], anna["other_names"]) == ("Anna Neri", "Studio A", "anna@studio.example", ["A. Neri"])
    assert anna["phone"] == "+39 02 123456"  # ties in text order, as printed
    assert (anna["cities"], anna["zones"], anna["sources"]) == (["Milano", "Monza"], ["Z1", "Z2"], ["Portale Uno", "Portale Due"])
    assert (anna["value_eur"], anna["max_price_eur"], anna["last_seen"]) == (301.0, 200.2, NOW + timedelta(days=1))
    # An organization and a name that read alike are one; a listing without any contact is nobody's.
    b = got["name:studio b"]
    assert (b["count"], b["name"], b["organization"], b["phone"]) == (2, "Bruno", "STUDIO B", None)
    assert brokers.unattributed(advertised(spark, ROWS)).first() == (1, 7)


def test_filters_and_order(spark):
    ids = lambda **filters: sorted(r["advertiser"] for r in directory(spark, ROWS, **filters).collect())
    assert len(ids(city=" monza ")) == 1 and ids(city="Roma") == []
    assert len(ids(min_price=150.0, max_price=250.0)) == 1  # euro only
    assert ids(direct_only=True) == ["mail:x@y.example"]
    assert ids(q="STUDIO b") == ["name:studio b"] and len(ids(q="studio")) == 2
    page = brokers.broker_page(directory(spark, ROWS), 2).collect()
    assert [(r["advertiser"] == "mail:x@y.example", r["direct"], r["count"], r["total"], r["limited"]) for r in page] == [(True, 1, 1, 3, True), (False, 0, 3, 3, True)]


def test_directory_of_nothing(spark):
    assert directory(spark, ROWS[5:7]).count() == 0
    assert brokers.broker_page(directory(spark, ROWS).where(F.lit(False))).count() == 0


def test_keys_are_made_once_however_often_they_are_asked(spark):
    df = advertised(spark, [("a", dict(telephone="+39 02 123456", email=" A@x.it ", contact_name="N")), ("b", {})])
    rows = brokers.contact_keys(df).where(F.size("keys") > 0).withColumn("key", F.col("keys")[0])
    joined = rows.join(spark.createDataFrame([("tel:02123456", 1)], "key string, n int"), "key").select("id", "keys", "n")
    assert [tuple(r) for r in joined.collect()] == [("a", ["tel:02123456", "mail:a@x.it"], 1)]
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("mail:") == 1
