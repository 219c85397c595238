from pyspark.sql import functions as F

from clauseflow.functions import modeljson as M
from clauseflow.functions import text as X
from clauseflow.operators import normalize as N


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


def test_normalize_order_of_steps(spark):
    d = spark.createDataFrame([(1, "１２ＡＢ x​\r\n exam-\nple\n3\nPage 2 of 9\n\n\n\nend   of")], "doc_id long, text string")
    r = N.normalize_documents(d).first()
    assert r["text"] == "12AB x\n example\n\nend of"
    assert r["stats"]["removed_noise_lines"] == 2 and r["stats"]["dehyphenated"]


def test_composed_form_only_where_needed(spark):
    d = spark.createDataFrame([(1, "é"), (2, "é"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in N.compose(d).collect()} == {1: "é", 2: "é", 3: None}


def test_long_lines_are_cut_behind_marks(spark):
    line = "x" * 200 + "!" + "y" * 300 + "?" + "z" * 200
    assert one(spark, line, X.break_long_lines).split("\n") == ["x" * 200 + "!", "y" * 300 + "?", "z" * 200]
    short = "a!b" * 100
    assert one(spark, short, X.break_long_lines) == short
    assert one(spark, "k" * 700 + "!", X.break_long_lines) == "k" * 700 + "!"


def test_tokenize(spark):
    assert one(spark, "User's third-party 2024 自动续费，费 X", X.tokenize) == ["user's", "third-party", "2024", "x", "自动", "动续", "续费", "费"]
    assert one(spark, "", X.tokenize) == []


def test_urls(spark):
    assert one(spark, "HTTP://Ex.com:80/a/b//?utm_source=1&q=2#f", X.url_key) == "http://ex.com/a/b?q=2"
    assert one(spark, "ex ample.com／a", X.repair_url) == "https://example.com/a"
    assert one(spark, "", X.repair_url) is None
    assert one(spark, "http://10.0.0.1/", X.is_private_url) and not one(spark, "http://example.com/", X.is_private_url)


def test_enums(spark):
    assert [one(spark, s, X.normalize_severity) for s in ("严重", "HIGH", "moderate", None)] == ["critical", "high", "medium", "medium"]
    assert [one(spark, s, X.normalize_category) for s in ("Data Sharing", "自动续费 / 扣费", "nonsense")] == ["data_sharing", "auto_renewal", "other"]


def test_score(spark):
    assert [one(spark, str(w), lambda c: X.risk_score(c.cast("int"))) for w in (0, 14, 26, 5200)] == [0, 18, 31, 100]


def test_model_json():
    assert M.parse('```json\n{"a": 1}\n```')[:2] == ('{"a": 1}', "plain")
    assert M.parse('x {"a": [1,],} y')[1] == "repaired"
    assert M.parse('{"t": "line\nbreak"}')[1] == "repaired"
    assert M.parse('{“a”: 1}')[1] == "repaired"
    assert M.parse('{"f": [{"a": 1}, {"a": ', "f")[:2] == ('{"f": [{"a": 1}]}', "salvaged")
    assert M.parse("none")[1] == "failed" and M.parse(None)[1] == "failed"


def test_fingerprint():
    assert N.fingerprint("您 同意，“赔偿”。") == N.fingerprint('您同意,"赔偿".')


def test_normalise_guards(spark):
    """What guards pass over is what the steps would leave as it is."""
    assert one(spark, "a \x85", X.trim_held) == one(spark, "a \x85", X.trim)
    for t in ("a\tb", "a \nb", "a ", "­x", "​x", "　x", "Ａx", "x﻿", "é，中文。", "a\r\nb\rc", None):
        half = lambda c: X.half_width(X.fold_spaces(X.drop_invisible(F.regexp_replace(c, "\r\n?", "\n"))))
        assert one(spark, t, X.unify_lines) == one(spark, t, lambda c: F.regexp_replace(F.regexp_replace(half(c), "\t", " "), r"[ ]+(?=\n|\z)", "")), t
