"""The model of the quality rules comes from all trusted documents."""

import numpy as np

from millrace.llm import quality


def _tables(spark, n):
    docs = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(60))) for i in range(n)]
    docs += [(0, docs[0][1]), (None, "no id"), (n + 1, None)]
    labels = [(i, 1, 0) for i in range(n)] + [(0, 1, 0), (n + 1, 1, 0), (n + 2, 0, 0), (None, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_no_trusted_document_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRUSTED", 4, raising=False)  # a bound there once was
    docs, labels = _tables(spark, 40)
    counted = []
    count = quality._count
    monkeypatch.setattr(quality, "_count", lambda *a: counted.append(count(*a)) or counted[-1])
    ratio, at = quality.fit(docs, labels, quantile=0.5)
    raw, target = counted[0]
    assert np.all(target <= raw)
    # 41 ids, half of them counted; each text has 60 words and 59 pairs
    assert target.sum() in (19 * 119, 20 * 119, 21 * 119, 22 * 119)
    assert len(ratio) == quality.BUCKETS and np.isfinite(at)


def test_least_value_that_reaches_a_share(spark):
    rows = spark.createDataFrame([(float(v),) for v in [1, 1, 2, 3, 3, 3, 4, 5, 5, 9]], "v double")
    for share, least in ((0.0, 1.0), (0.2, 1.0), (0.21, 2.0), (0.5, 3.0), (1.0, 9.0)):
        assert quality._least_reaching(rows, "v", share) == least
    assert quality._least_reaching(rows.where("v > 10"), "v", 0.5) is None


def test_texts_without_a_trusted_id_are_not_shuffled(spark):
    docs, _ = _tables(spark, 2000)
    ids = spark.createDataFrame([(i,) for i in range(0, 2000, 50)] + [(2001,), (9999,)], "doc_id long")
    found = quality._texts_of(docs, ids)
    # id 0 has two rows; id 2001 has a NULL text
    plain = docs.join(ids, "doc_id", "left_semi").select("text")
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty() and found.count() == 42
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = quality._texts_of(docs, ids)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(r[0] or "" for r in joined.collect()) == sorted(r[0] or "" for r in plain.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the exchange of the texts lies above the join with the bitmaps
    above = plan[: plan.index("BroadcastHashJoin")]
    assert "SortMergeJoin" in above and "Exchange hashpartitioning(doc_id" in above
