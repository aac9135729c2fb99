"""Results against planned slots: counted, without a join of all slots."""


def test_slots_checked(spark):
    from quill.plans.evaluation import slots_checked

    asked = spark.createDataFrame([(1,), (2,), (3,), (None,), (5,), (5,)], "l_orderkey long")
    got = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 1), (2, 7), (4, 2), (None, 1), (5, 2), (5, None)], "l_orderkey long, slot int")
    out = slots_checked(asked, got)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(1, False, False, 0), (2, True, True, 3), (3, False, False, 4), (4, False, True, 0), (None, False, True, 4), (5, False, True, 6)}
    assert {tuple(r) for r in out.collect()} == want
