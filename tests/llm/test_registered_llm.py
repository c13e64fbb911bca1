import pytest
from compare import connect, difference

from groundset.llm import queries, tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(tables.ORACLES))
def test_query_against_its_sql(spark, name):
    assert difference(tables.QUERIES[name](spark, SF_DIR), connect(SF_DIR), tables.ORACLES[name]) is None


def test_repeated_passages_against_all_windows(spark):
    """Documents that share 51 words are found; what is found shares a paragraph's words."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}

    def sharing(n):
        seen = {}
        for k, t in docs.items():
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
            for i in range(len(w) - n + 1):
                seen.setdefault(tuple(w[i : i + n]), set()).add(k)
        return {k for v in seen.values() if len(v) > 1 for k in v}

    got = {r.doc_id for r in queries.op4_repeated_passages(spark, SF_DIR).collect()}
    assert sharing(51) <= got <= sharing(19)


def test_secrets_against_the_planted_pattern(spark):
    import re

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    want = {(r.doc_id, m.start(1), m.end(1)) for r in docs for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text)}
    rows = queries.op1_secret_scan(spark, SF_DIR).where("is_secret").collect()
    assert {(r.doc_id, r.start, r.end) for r in rows} == want
