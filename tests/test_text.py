"""Golden values of masking, dates, fields and MRZ."""

import pytest
from pyspark.sql import functions as F

from idsieve.functions import dates, mrz as m, text as ft
from idsieve.operators import fields as of, mrz as om
from idsieve.queries import inputs as I


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_mask(spark):
    data = [("document_number", "ABCDE1234F", "XXXXXX234F"), ("date_of_birth", "12/03/1990", "XX/XX/XXXX"),
            ("name", "Rahul K", "RXXXX X"), ("address", "12 Long Street", "12 …XXXXXXXX"), ("address", "short", "XXXX"),
            ("visa_number", "AB1", "XXX"), ("nationality", "Utopia", "Utopia"), ("mrz_line1", "p<uto1", "X<XXXX"),
            ("name", None, None)]
    out = rows(spark, data, "f string, v string, e string").select(
        "e", ft.mask_value(F.col("f"), F.col("v")).alias("m")).collect()
    assert all(r.e == r.m for r in out)


@pytest.mark.parametrize("field,value,status,flags", [
    ("expiry_date", "01/01/2020", "PASS", ["expired"]), ("date_of_birth", "31/02/1990", "FAIL", ["impossible_date"]),
    ("date_of_birth", "", "FAIL", ["empty"]), ("issue_date", "1/2/2020", "WARNING", ["unrecognized_format"]),
    ("date_of_birth", "01/01/1880", "WARNING", ["implausible_age"]), ("issue_date", "01/01/2030", "FAIL", ["issue_in_future"]),
    ("date_of_birth", "05/06/90", "PASS", []), ("expiry_date", "2099-01-01", "WARNING", ["far_future"]),
])
def test_validate_date(spark, field, value, status, flags):
    v = rows(spark, [(field, value)], "f string, v string").select(
        dates.validate_date(F.col("f"), F.col("v"), I.at(spark, "2026-02-28")).alias("v")).first().v
    assert (v.status, v.flags) == (status, flags)


def test_two_digit_year_pivot(spark):
    d = rows(spark, [("01/01/90",), ("01/01/68",), ("01 Foo 1990",)], "v string").select(
        dates.parse_date(F.col("v")).alias("p")).collect()
    assert [str(r.p.date) for r in d] == ["1990-01-01", "2068-01-01", "None"] and d[2].p.status == "IMPOSSIBLE_DATE"


def test_check_digits(spark):
    d = rows(spark, [("L898902C3",), ("740812",), ("D23145890",), ("P1234567<",)], "v string")
    assert [r.d for r in d.select(m.check_digit(F.col("v")).alias("d")).collect()] == ["6", "2", "7", "1"]
    assert d.filter("v = 'P1234567<'").select(m.check_digit(F.col("v"), compat=True).alias("d")).first().d == "7"


TD3 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
TD1 = "I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<"


def mrz_row(spark, text, supports=True, name=None, dob=None, number=None, **kw):
    d = rows(spark, [(1, supports, text, name, dob, number)],
             "doc_id long, supports_mrz boolean, full_text string, vis_name string, vis_dob string, vis_number string")
    return om.analyze(d, **kw).first()


def test_td3_with_same_visible_values(spark):
    r = mrz_row(spark, TD3, name="Anna Maria Eriksson", dob="12/08/1974", number="L898902C3")
    assert (r.mrz_status, r.structure) == ("PARSED", "TD3")
    assert [c.status for c in r.checklist] == ["PASS"] * 5
    assert r.mrz_fields.document_number == "XXXXX02C3" and r.mrz_fields.dob == "XXXXXX"


def test_td3_with_other_visible_values(spark):
    r = mrz_row(spark, TD3, name="Bob Stone", dob="01/01/2000", number="ZZ9")
    assert (r.name_cmp, r.dob_cmp, r.number_cmp) == ("FAIL", "FAIL", "FAIL")


def test_td1_is_not_taken_for_td3(spark):
    assert mrz_row(spark, TD1).structure == "TD1"
    assert mrz_row(spark, TD1).check_digits_ok


def test_no_mrz(spark):
    r = mrz_row(spark, "plain prose only")
    assert r.mrz_status == "NOT_DETECTED" and {c.status for c in r.checklist} == {"NOT_ASSESSED"}
    assert mrz_row(spark, TD3, supports=False).mrz_status == "NOT_APPLICABLE"


def extract(spark, kind, text, **kw):
    d = rows(spark, [(1, kind, text)], "doc_id long, document_type string, full_text string")
    return {r.field: r for r in of.extract(d, I.at(spark, "2026-01-15"), **kw).collect()}


def test_pan_fields_and_confidence(spark):
    text = "Name: RAHUL SHARMA DOB: 12/03/1990\nFather's Name: ABEL SHARMA\nABCDE1234F"
    f = extract(spark, "PAN", text)
    assert f["name"].value == "RAHUL SHARMA" and f["document_number"].validation == "PASS"
    assert extract(spark, "PAN", text, compat=True)["name"].value == "RAHUL SHARMA DOB"
    docs = rows(spark, [(1, "PAN", text)], "doc_id long, document_type string, full_text string")
    boxes = rows(spark, [(1, 1, 0, 0, 9, 9, "RAHUL", 0.9), (1, 2, 9, 0, 9, 9, "SHARMA", 0.7),
                         (1, 3, 0, 9, 9, 9, "ABCDE1234F", 0.0), (1, 4, 0, 0, 1, 1, "", 0.99)],
                 "doc_id long, box_ord int, x int, y int, w int, h int, text string, confidence double")
    a = {r.field: r for r in of.assess(of.extract(docs, I.at(spark, "2026-01-15")), boxes).collect()}
    assert a["name"].ocr_confidence == pytest.approx(0.8) and a["name"].status == "EXTRACTED"
    # No confidence: never PASS.
    assert a["document_number"].validation == "WARNING" and a["document_number"].status == "UNCERTAIN"
    pub = of.publish(of.extract(docs, I.at(spark, "2026-01-15")))
    assert "raw_value" not in pub.columns
    assert {r.value for r in pub.filter("field = 'document_number'").collect()} == {"XXXXXX234F"}


def test_passport_labels(spark):
    f = extract(spark, "PASSPORT", "Surname: ERIKSSON\nGiven Names: ANNA MARIA\nPassport No: L8989021\nDate of Birth: 12/08/1974")
    assert f["name"].value == "ERIKSSON ANNA MARIA"
    assert f["document_number"].value == f["passport_number"].value == "L8989021"
    assert f["date_of_birth"].value == "1974-08-12"


def test_missing_issue_before_birth(spark):
    raw = rows(spark, [(1, "01/01/2000", "01/01/1990", None)], "doc_id long, date_of_birth string, issue_date string, expiry_date string")
    assert [(r.check, r.status) for r in of.date_order(raw).collect()] == [("issue_after_dob", "FAIL")]


def test_signature_is_not_counted(spark):
    docs = rows(spark, [(1, "PAN")], "doc_id long, document_type string")
    none = rows(spark, [], "doc_id long, field string, status string, value string, ocr_confidence double, validation string")
    inv = {r.field: r.status for r in of.inventory(docs, none).collect()}
    assert inv["signature"] == "NOT_APPLICABLE" and inv["name"] == "MISSING"
    s = of.summarize(docs, none).first()
    assert "signature" not in s.missing_expected_fields and s.fields_status == "NO_FIELDS"
