"""Texts are Python strings a few at a time."""

import tracemalloc

import pyarrow as pa

from tessera.functions import text


def test_normal_forms_hold_few_python_strings():
    texts = pa.array(["\ufb01é گ" * 5000, None, ""] * 400)
    for f in (text.compatible, text.composed):
        tracemalloc.start()
        got = f.func(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got[0].as_py() == ("fié گ" if f is text.compatible else "\ufb01é گ") * 5000 and got[1].as_py() is None and got[2].as_py() == "" and len(got) == 1200
        assert peak < 8_000_000  # all at once are 20 million characters of two bytes each


def test_phrases_hold_few_python_strings(spark):
    texts = pa.array(["All rights " + "x١ " * 5000, None, ""] * 100)
    from tessera.functions import phrases

    made = {}
    real = phrases.F.arrow_udf
    phrases.F.arrow_udf = lambda kind: lambda f: made.setdefault("f", f) and (lambda c: c)
    try:
        phrases.spans(None, ["all rights"])
    finally:
        phrases.F.arrow_udf = real
    tracemalloc.start()
    (got,) = made["f"](iter([texts]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].as_py() == [{"phrase": "all rights", "start": 0, "stop": 10}] and got[1].as_py() == [] and got[2].as_py() == [] and len(got) == 300
    assert peak < 16_000_000
