"""Ordered slices and titles that their sources state."""

from pyspark.sql import functions as F

from tessera.functions import keys
from tessera.operators import admission


def test_parts_in_order(spark):
    text = "About. One two. Three. One more"
    cases = {"One two": True, "One two\n\nThree": True, "Three\n\nOne two": False, "One\n\nOne": True, "One two\n\ntwo": False, "Three\n\n": False, "One\n\n \n\nThree": False, "four": False, "One\n\nfour": False, "About\n\nOne\n\nThree\n\nmore": True}
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, v string")
    got = rows.select("i", admission.source_slice(F.col("v"), F.lit(text), True).alias("ok"), admission.source_slice(F.col("v"), F.lit(text)).alias("plain")).orderBy("i").collect()
    assert [r.ok for r in got] == list(cases.values()) and sum(r.plain for r in got) == 1
    null = spark.createDataFrame([(None,)], "v string").select(admission.source_slice(F.col("v"), F.lit(text), True).alias("a"), admission.source_slice(F.lit("x"), F.col("v"), True).alias("b")).first()
    assert (null.a, null.b) == (False, False)


def test_subsequences(spark):
    cases = [(["a", "b"], ["a", "x", "b"], True), (["b", "a"], ["a", "x", "b"], False), (["a", "a"], ["a", "b"], False), (["a", "a"], ["a", "b", "a"], True), ([], ["a"], True), (["a"], [], False), (["a", "b"], ["a", "b"], True)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<string>, b array<string>")
    assert [r.ok for r in rows.select("i", admission.subsequence(F.col("a"), F.col("b")).alias("ok")).orderBy("i").collect()] == [c[2] for c in cases]


EVENT = "struct<detection_reason:string,description_text:string,title:string,origin:string,title_evidence_text:string,title_evidence_ids:array<string>,fragment_ids:array<string>,candidate_ids:array<string>,source_ids:array<string>,source_url:string,provenance:array<struct<field:string,candidate_ids:array<string>>>>"
GOOD = {"detection_reason": "event", "description_text": None, "title": "کارگاه سفال ۲", "origin": "explicit_caption", "title_evidence_text": "کارگاه بزرگ سفال شماره 2", "title_evidence_ids": ["f1"], "fragment_ids": ["f1", "f2"], "candidate_ids": ["c1"], "source_ids": ["s"], "source_url": "u", "provenance": [{"field": "title", "candidate_ids": ["c1"]}]}


def test_titles(spark):
    cases = [
        ({}, None), ({"title": None}, "missing_title"), ({"title": " …!"}, "missing_title"), ({"title": "«ورک‌شاپ»"}, "unsupported_title"), ({"title": "ورکشاپ"}, "placeholder_title"), ({"title": "N/A"}, "placeholder_title"), ({"title": "UNTITLED  event"}, "placeholder_title"),
        ({"title": "رویداد نامشخص"}, "placeholder_title"), ({"title": "ايونت جديد"}, "placeholder_title"), ({"detection_reason": "needs_evidence: x"}, "not_established_event"), ({"description_text": "گزارش تصویری کارگاه"}, "not_established_event"),
        ({"title": "سفال کارگاه"}, "unsupported_title"), ({"title": "کارگاه سفال 3"}, "unsupported_title"), ({"title_evidence_ids": ["f9"]}, "unsupported_title"), ({"title_evidence_ids": []}, "unsupported_title"), ({"title_evidence_text": None}, "unsupported_title"),
        ({"origin": "guess"}, "unsupported_title"), ({"origin": None, "title_evidence_text": None}, None), ({"source_ids": []}, "unsupported_title"), ({"source_url": None}, "unsupported_title"), ({"provenance": None}, "unsupported_title"),
        ({"provenance": [{"field": "title", "candidate_ids": ["c2"]}]}, "unsupported_title"), ({"provenance": [{"field": "city", "candidate_ids": ["c1"]}]}, "unsupported_title"), ({"candidate_ids": None}, "unsupported_title"),
    ]
    rows = spark.createDataFrame([(i, GOOD | change) for i, (change, _) in enumerate(cases)], f"i int, e {EVENT}")
    got = rows.select("i", admission.exclusion(F.col("e"), admission.title_key(F.col("e.title"))).alias("why")).orderBy("i").collect()
    assert [r.why for r in got] == [want for _, want in cases]


def test_ports_tell_addresses_apart(spark):
    rows = spark.createDataFrame([("http://A.example:8080/x?utm_source=q",), ("http://a.example/x",)], "u string").select(keys.canonical_url(F.col("u")).alias("u"))
    assert [r.u for r in rows.collect()] == ["http://a.example:8080/x", "http://a.example/x"]
