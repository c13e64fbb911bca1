from groundset.llm import exact


def _marks(df):
    return {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.mark_copies(df).collect()}


def test_largest_id_stays(docs):
    got = _marks(docs([(1, "a"), (5, "a"), (3, "a"), (2, "b"), (4, "A")]))
    assert got == {(1, 5, 3, False), (5, 5, 3, True), (3, 5, 3, False), (2, 2, 1, True), (4, 4, 1, True)}


def test_null_text_is_empty_and_null_id_is_least(docs):
    got = _marks(docs([(1, None), (None, ""), (7, " "), (None, "x"), (None, "x")]))
    assert (1, 1, 2, True) in got and (None, 1, 2, False) in got and (7, 7, 1, True) in got
    assert {(None, None, 2, True), (None, None, 2, False)} <= got


def test_repeated_rows_leave_one(docs):
    rows = exact.mark_copies(docs([(1, "a")] * 5)).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {5}
    assert exact.drop_copies(docs([(1, "a")] * 5 + [(0, "a")])).count() == 1


def test_hot_group_and_clashing_columns(spark, docs):
    df = docs([(i, "copy") for i in range(3000)] + [(9000 + i, f"t{i}") for i in range(50)])
    df = df.selectExpr("*", "'x' as keep_id", "1 as kept", "2 as _salt", "3 as _digest")
    kept = exact.drop_copies(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {2999, *range(9000, 9050)}
    assert {r.keep_id for r in kept.collect()} == {"x"}


def test_empty_table_and_long_text(docs):
    assert exact.mark_copies(docs([])).count() == 0
    long = "w " * 500_000
    assert sorted(r.doc_id for r in exact.drop_copies(docs([(1, long), (2, long), (3, long + "w")])).collect()) == [2, 3]


def test_two_texts_of_one_digest_stop_the_job(docs, monkeypatch):
    import pytest
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.lit("same"))
    with pytest.raises(Exception, match="share the digest"):
        exact.mark_copies(docs([(1, "a"), (2, "a"), (3, "b")])).collect()


def test_rows_that_meet_digests_by_salt(docs, monkeypatch):
    rows = [(k, f"t{k % 40}") for k in range(200)] + [(None, "t1"), (None, None), (900, "alone")]
    sent = _marks(docs(rows))
    monkeypatch.setattr(exact, "SENT_BYTES", 0)
    assert _marks(docs(rows)) == sent and (900, 900, 1, True) in sent and (1, 161, 6, False) in sent


def test_one_id_or_none_for_thousands_of_rows(docs):
    rows = [(7, "same")] * 3000 + [(None, "same")] * 1000 + [(7, f"x{k}") for k in range(500)] + [(None, "none")] * 1000
    got = exact.mark_copies(docs(rows)).collect()
    assert len(got) == len(rows)
    assert [r.keep_id for r in got if r.kept and r.group_size == 4000] == [7]
    assert sum(r.kept for r in got if r.group_size == 1000) == 1 and sum(r.kept for r in got) == 502
