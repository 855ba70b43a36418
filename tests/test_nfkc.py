"""NFKC runs in Spark itself: the same as Python's, without Python workers."""

import unicodedata

from pyspark.sql import functions as F

from quillmatch.functions.text import nfkc
from quillmatch.functions.titles import add_clean_key


def test_nfkc_as_pythons(spark):
    assigned = [chr(c) for c in range(1, 0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = assigned[::7] + ["１９금", "ｶﾞ", "각", "á̖b", "ﷺ", "", "plain"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nfkc("t").alias("n")).collect()
    assert [r.t for r in got if r.n != unicodedata.normalize("NFKC", r.t)] == []
    assert spark.createDataFrame([(None,)], "t string").select(nfkc("t").alias("n")).first().n is None


def test_clean_keys_start_no_python(spark):
    plan = add_clean_key(spark.range(3).select(F.lit("[１９금] 제목 3화").alias("t")), "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
