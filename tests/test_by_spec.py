"""Runs of different specs in one job give what each gives alone."""

from pyspark.sql import functions as F

from groundset.plans.by_spec import build_dataset_by_spec, validate_by_spec
from groundset.plans.dataset import build_dataset
from groundset.spec import FieldSpec, TaskSpec

SPECS = {
    "a": TaskSpec("firm", (FieldSpec("name", "str", "", True), FieldSpec("price_usd", "float"), FieldSpec("site", "url")), ("name",)),
    "b": TaskSpec("post", (FieldSpec("title", "str", "", True), FieldSpec("day", "date"), FieldSpec("n", "int"), FieldSpec("mail", "email")), ("title", "n")),
    "c": TaskSpec("any", (FieldSpec("x"), FieldSpec("y"))),
}
ROWS = {
    "a": [("Acme, Inc.", "$1,200", "https://a.com/?utm_source=x"), ("acme", None, "javascript:1"), ("Beta rs", "rs 5", None), (None, "3", None), (" ", "x", None),
          ("Gamma Delta Works", "7.5", None), ("Gamma Delta Work", None, "http://g.com")],
    "b": [("Clerk", "Jan. 5, 2024", "3", "A@B.co"), ("clerk", "soon", "3.0", "bad"), ("Cook", None, "0", ""), ("Cook", "2024-01-02", None, None)],
    "c": [("one", "two"), ("one", "two"), (None, None), (None, "z")],
}


def _pool(spark):
    rows, at = [], 0
    for run, spec in SPECS.items():
        for own in ROWS[run]:
            at += 1
            rows.append((run, at, f"s{at % 3}", f"e{at}", [], dict(zip(spec.names, own, strict=True))))
    rows.append(("none", 99, "s", "e", [], {"q": "1"}))
    return spark.createDataFrame(rows, "run_id string, arrival bigint, source_id string, evidence string, flags array<string>, data map<string,string>")


def _fields(spark):
    rows = [(r, i, f.name, f.type, f.required, f.name in s.key_fields) for r, s in SPECS.items() for i, f in enumerate(s.fields)]
    return spark.createDataFrame(rows, "run_id string, ordinal int, name string, type string, required boolean, is_key boolean")


def test_each_run_as_if_alone(spark):
    pool, fields = _pool(spark), _fields(spark)
    for similar in (False, True):
        got = build_dataset_by_spec(pool, fields, merge_similar=similar)
        seen = {(r.run_id, r.dedupe_key): (r.data, r.confidence, sorted(r.flags), r.n_merged, r.n_sources, r.record_id) for r in got.records.collect()}
        want, links = {}, set()
        for run, spec in SPECS.items():
            own = pool.filter(F.col("run_id") == run).select("run_id", "arrival", "source_id", "evidence", "flags", *[F.col("data")[n].alias(n) for n in spec.names])
            alone = build_dataset(own, spec, merge_similar=similar)
            for r in alone.records.collect():
                data = {n: r[n] for n in spec.names if r[n] is not None}
                data = {n: str(v) if not isinstance(v, float) else repr(v) for n, v in data.items()}
                want[run, r.dedupe_key] = (data, r.confidence, sorted(r.flags), r.n_merged, r.n_sources, r.record_id)
            links |= {(r.record_id, r.source_id, r.snippet) for r in alone.evidence.collect()}
        extra = {k: seen.pop(k) for k in list(seen) if k[0] == "none"}
        assert seen == want
        assert [v[0] for v in extra.values()] == [{}]
        assert links <= {(r.record_id, r.source_id, r.snippet) for r in got.evidence.collect()}


def test_reject_reasons(spark):
    rows = validate_by_spec(_pool(spark), _fields(spark)).filter("reject_reason is not null").collect()
    assert sorted((r.run_id, r.arrival, r.reject_reason) for r in rows) == [("a", 4, "missing_required_name"), ("a", 5, "missing_required_name")]
    assert all(r.flags == [r.reject_reason] for r in rows)


def test_repeated_arrivals_stay_apart(spark):
    """Different rows of one arrival, equal rows, and a run without a spec: none is lost, none crashes."""
    shape = "run_id string, arrival bigint, source_id string, evidence string, flags array<string>, data map<string,string>"
    one, two = {"name": "Acme", "price_usd": "5"}, {"name": "Birch", "price_usd": "7"}
    rows = [("a", 1, "s1", "e", [], one), ("a", 1, "s1", "e", [], one), ("a", 1, "s2", "e", [], two)]
    rows += [("a", 1, "s3", "e", ["f"], one), ("a", None, None, None, None, None), ("none", 1, "s", "e", [], one)]
    pool = spark.createDataFrame([*rows, rows[-1]], shape)
    assert validate_by_spec(pool, _fields(spark)).count() == 7
    got = build_dataset_by_spec(pool, _fields(spark))
    seen = sorted((r.run_id, r.data.get("name", ""), r.n_merged, r.n_sources) for r in got.records.collect())
    assert seen == [("a", "Acme", 3, 2), ("a", "Birch", 1, 1), ("none", "", 2, 1)]
    assert validate_by_spec(pool.limit(0), _fields(spark)).count() == 0
