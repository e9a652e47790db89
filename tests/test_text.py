"""Text functions, the stemmer and value reading on pairs."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tarnlight.functions import facts, porter, values
from tarnlight.functions import text as T
from tarnlight.operators import reports

GROUPS = [["legal name", "vendor", "supplier"], ["effective date", "commencement date"], ["liability cap", "maximum liability"]]


def column(spark, values_, expression):
    return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values_)], "i int, v string").orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_tokens_and_chunks(spark):
    assert column(spark, ["Échéance net-45 a b_c 9x -x", "", None], T.tokens) == [["échéance", "net-45", "b_c", "9x"], [], None]
    assert column(spark, ["Café Müller's NET-45", "ÎLE"], T.index_terms) == [["cafe", "muller", "s", "net", "45"], ["ile"]]
    assert column(spark, ["", "a", "a" * 4, "a" * 5, None], T.token_cost) == [0, 1, 1, 2, None] or column(spark, ["", "a"], T.token_cost) == [0, 1]
    df = spark.createDataFrame([("a", "x" * 1800), ("b", "y" * 1801), ("c", " \n "), ("d", "z z" * 3000)], "rel string, text string")
    got = {r["rel"]: r["n_chunks"] for r in T.with_chunks(df).collect()}
    assert got == {"a": 1, "b": 2, "d": 6}
    assert column(spark, ["/x/Y.TXT", "a/.hidden", "noext", "b.tar.GZ"], T.extension) == [".txt", "", "", ".gz"]
    assert column(spark, ["a/b/c", "x", "evidence_home/Update/f", "evidence_home/vision_notes/n"], T.top_folder) == ["a", "_root", "Update", "vision_notes"]
    assert T.wanted_types(["ppt", "*.MD", ".pdf", "zzz"]) == ({".pptx", ".md", ".pdf"}, ["zzz"])
    assert column(spark, ["one two three four", "short"], lambda c: T.trimmed(c, 10)) == ["one two …", "short"]
    assert column(spark, ["a\x00b\x07c\td\x7f"], T.sanitized) == ["abc\td"]


def test_stems_agree_with_the_index_of_sqlite(spark, sf):
    words = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() for w in values.words(r["text"]) if w.isascii() and w.isalpha()})[:3000]
    words += "caresses ponies ties cats agreed plastered motoring conflated troubled sized hopping falling hissing fizzed failing filing happy sky relational conditional rational digitizer operator feudalism hopefulness formality sensibility triplicate formative electrical goodness revival allowance airliner adjustable defensible adoption communism activate effective probate rate cease controll roll analogy".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(w, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, w) VALUES (?, ?)", list(enumerate(words, 1)))
    want = dict(db.execute("SELECT doc, term FROM v").fetchall())
    assert [(w, porter.stem(w)) for w in words] == [(w, want[i]) for i, w in enumerate(words, 1)]
    assert porter.stem("gstr3bs") == "gstr3bs" and porter.stem("gstr3bs", False) == "gstr3b" and porter.stem("Échéances") == "échéances"


@pytest.mark.parametrize(("text", "value"), [
    ("mail a.b@c.de now", "a.b@c.de"), ("pays ₹4.2 crore", "₹4.2 crore"), ("on 31/12/2026", "31/12/2026"), ("on 2026-01-05", "2026-01-05"), ("5 Jan 2026", "5 Jan 2026"), ("PO4400182 ok", "PO4400182"), ("GST 29ABCDE1234F1Z5", "29ABCDE1234F1Z5"),
    ("term 24 months long", "24 months"), ("see clause 4", None), ("page 3.", None), ("clause 4 pays 12%", "12%"), ("Invoice No. 42", "42"), ("nothing", None),
])
def test_first_value(text, value):
    m = values.first_value(text)
    assert (m and m[0].strip()) == value


@pytest.mark.parametrize(("text", "parts"), [
    ("One. Two; three\nfour", ["One.", "Two", "three", "four"]), ("Helios Components Pvt. Ltd. as the Vendor. Next", ["Helios Components Pvt. Ltd. as the Vendor.", "Next"]),
    ("Zeta Corporation Ltd. Acme Industries Ltd", ["Zeta Corporation Ltd.", "Acme Industries Ltd"]), (" ; \n", []),
])
def test_clauses(text, parts):
    assert values.clauses(text) == parts


@pytest.mark.parametrize(("label", "kind"), [("Vendor turnover", "quantity"), ("Tax Entity", "party"), ("Fees payable to the vendor", "quantity"), ("Effective date", "date"), ("GST number", "identifier"), ("Colour", "unknown"), ("Aggregate liability", "quantity")])
def test_field_kind(label, kind):
    assert values.field_kind(label, GROUPS) == kind


@pytest.mark.parametrize(("text", "label", "foreign", "value", "how"), [
    ("Legal name: Beta Holdings Ltd, GST 29ABCDE1234F1Z5", "Legal name", set(), "Beta Holdings Ltd", "exact"), ("Vendor: Acme Industries Ltd", "Legal name", set(), "Acme Industries Ltd", "alias"),
    ("Master agreement with Helios Components Pvt Ltd as the Vendor.", "Legal name", set(), "Helios Components Pvt Ltd", "appos"), ('Acme Corporation (the "Supplier") shall deliver', "Legal name", set(), "Acme Corporation", "appos"),
    ("Renewal term: 24 months Vendor: Acme Ltd", "Renewal term", {"vendor"}, "24 months", "exact"), ("Liability cap: refer to section 9 for details", "Liability cap", set(), None, None),
    ("Payment terms are net-45. Vendor: 45", "Legal name", set(), None, None), ("Payment terms: Net-45 and general terms apply", "Payment terms", set(), "-45", "exact"), ("the maximum liability is INR 6 crore", "Liability cap", set(), "6 crore", "alias"),
    ("Governed by the laws of 12 states", "Governing law", set(), "12", "stem"), ("Legal name: Beta Holdings Ltd / Gamma Systems LLP", "Legal name", set(), None, None), ("IBM as the Vendor", "Legal name", set(), None, None),
    ("In January, Helios Components Pvt Ltd as the Vendor", "Legal name", set(), "Helios Components Pvt Ltd", "appos"),
])
def test_answers(text, label, foreign, value, how):
    reading = values.answer(text, label, foreign, GROUPS)
    assert (reading and (reading.value, reading.how)) == (value and (value, how))


def test_a_window_with_another_field_is_not_clean():
    assert values.answer("Payment terms 30 days governing law Goa", "Payment terms", {"governing", "law"}).clean is False


def test_values_carry():
    assert values.carries_value("Helios Components Pvt Ltd as the Vendor") and values.carries_value("Vendor: Acme Ltd") and values.carries_value("5 crore")
    assert not values.carries_value("TCL Confirmed Northwind Systems as the vendor") and not values.carries_value("see page 3.")
    line = "Q2 update: the team closed 40 deals"
    value, start, end = values.value_near(line, {"deals"})
    assert value == "40" and values.neighbours(line, start, end) == ("close", "deal")


def test_facts(spark):
    said = ["INR 4.2 crore", "₹4.20 cr", "42,000,000", "-5 lakh", "31-12-2026", "31/12/2026", "5  Jan 2026", "Mar 7", "text", "12%", "7 k"]
    keys = [(r["kind"], r["key"]) for r in column(spark, said, facts.value_key)]
    assert keys == [("num", "42000000.00")] * 3 + [("num", "-500000.00"), ("date", "31/12/2026"), ("date", "31/12/2026"), ("date", "5 jan 2026"), ("date", "mar 7"), ("txt", "text"), ("num", "12.00"), ("num", "7000.00")]
    assert column(spark, ["a_signed.md", "draft/x", "final_old.md", "signedness"], facts.authority) == [1, -1, 0, 0]
    assert [reports.size_of(x) for x in ("10", "1.5k", "2M", "1G")] == [10, 1536, 2 << 20, 1 << 30]
