"""Known places in free text, and the location of cards."""
from mattone.sources import cards, places

CARDS = "doc_id string, url string, city string, address string, context string, text string"


def named(spark, texts, extra=()):
    known = places.known_places(spark, spark.createDataFrame([(c,) for c in extra], "city string"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = {i: set() for i in range(len(texts))}
    for r in places.places_named(df, ["i"], known).collect():
        out[r["i"]].add(r["city"])
    return [out[i] for i in range(len(texts))]


def test_street_words_shield_names(spark):
    texts = ["Trilocale in via Padova", "Via Padova, Padova", "corso Lodi a Milano", "v.le Monza 3", "a prato verde", "Prato: villa", "zona Milano-Lodi", None, "", "Viale Roma. Roma"]
    assert named(spark, texts) == [set(), {"Padova"}, {"Milano"}, set(), set(), {"Prato"}, {"Milano", "Lodi"}, set(), set(), {"Roma"}]


def test_longest_name_and_accents(spark):
    texts = ["Casa a Reggio Emilia", "Casa a REGGIO  EMILIA e Forli", "Reggio, Emilia", "a Forlì", "a L'Aquila e L’Aquila", "a Sant'Agata di Puglia", "a Sant'Agata", "Nova Milanese", "Milano Nova"]
    got = named(spark, texts, ["Reggio", "Sant'Agata di Puglia", "Nova Milanese", "forli'", "  "])
    assert got == [{"Reggio Emilia"}, {"Reggio Emilia", "Forlì"}, {"Reggio"}, {"Forlì"}, {"L'Aquila"}, {"Sant'Agata di Puglia"}, set(), {"Nova Milanese"}, {"Milano"}]


def test_without_known_places(spark):
    none = spark.createDataFrame([], "folded string, city string")
    assert places.places_named(spark.createDataFrame([(1, "Milano")], "i int, text string"), ["i"], none).count() == 0


def located(spark, **card):
    row = dict(doc_id="d", url="u", city=None, address=None, context=None, text=None) | card
    known = places.known_places(spark)
    (r,) = cards.card_location(spark.createDataFrame([tuple(row[c.split()[0]] for c in CARDS.split(", "))], CARDS), known).collect()
    return r["city"], r["zone"], r["address"]


def test_location_line_then_subject(spark):
    assert located(spark, address="via Crema 12, Porta Romana, Milano") == ("Milano", "Porta Romana", "via Crema 12")
    assert located(spark, address="Via Crema 12, FORLI") == ("Forlì", "", "Via Crema 12")
    assert located(spark, address="Zona 3, via Roma, Milano") == ("Milano", "", "Zona 3, via Roma")
    assert located(spark, address="Milano", context="Case a Torino") == ("Torino", "", "Milano")
    assert located(spark, context="Case a Torino", text="vicino a corso Lodi") == ("Torino", "", None)
    assert located(spark, context="Case a Torino", text="Comodo per Lodi") == (None, "", None)
    assert located(spark, context="Case a Torino e Lodi") == (None, "", None)
    assert located(spark, city="Bollate", address="Via Roma, Milano") == ("Bollate", "", "Via Roma, Milano")


def test_cards_are_taken_apart_once(spark):
    """What names a place is read from written cards: their blocks are not taken apart a second time."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    kind = "doc_id string, url string, city string, address string, context string, text string"
    rows = spark.createDataFrame([("a", "u1", None, None, "Case in vendita a Milano", "Trilocale"), ("b", "u2", None, "Via Po 1, Lodi", "x", "y")], kind).mapInPandas(count, kind)
    found = cards.card_location(rows, spark.createDataFrame([("Milano",), ("Lodi",)], "city string"))
    assert {r.doc_id: r.city for r in found.collect()} == {"a": "Milano", "b": "Lodi"}
    assert seen.value == 2
