import random

import pytest
from pyspark.sql import functions as F

from groundset.functions.similarity import lcs_length, partial_match
from groundset.operators import clean, fuzzy, verify
from groundset.plans.dataset import build_dataset
from groundset.spec import FieldSpec, TaskSpec, parse_specs

JOB = TaskSpec(
    entity="job",
    fields=(FieldSpec("company", "str", "", True), FieldSpec("title", "str", "", True), FieldSpec("salary", "int"), FieldSpec("location")),
    key_fields=("company", "title"),
)
COLUMNS = "run_id string, arrival bigint, source_id string, evidence string, company string, title string, salary bigint, location string, flags array<string>"


def jobs(spark, rows):
    return spark.createDataFrame([("r", i, *r, []) for i, r in enumerate(rows)], COLUMNS)


def test_exact_duplicates_merge_and_keep_provenance(spark):
    pool = jobs(spark, [("s1", "e1", "Acme Inc", "Engineer", None, None), ("s2", "e2", "ACME", "engineer", 120000, None)])
    data = build_dataset(pool, JOB)
    row = data.records.collect()
    assert len(row) == 1 and row[0].salary == 120000 and row[0].n_sources == 2
    assert [r.snippet for r in data.evidence.orderBy("position").collect()] == ["e2", "e1"]


def test_similar_records_merge(spark):
    pool = jobs(spark, [("s1", "e1", "Global Tech Solutions", "Senior Software Engineer", None, "Pune"),
                        ("s2", "e2", "Global Tech Solution", "Senior Software Engineer", None, None),
                        ("s3", "e3", "Other", "Senior Software Engineer", 5, None)])
    data = build_dataset(pool, JOB)
    got = {r.company: (r.n_merged, r.location) for r in data.records.collect()}
    assert got == {"Global Tech Solutions": (2, "Pune"), "Other": (1, None)}
    assert data.evidence.count() == 3


def test_required_fields_reject(spark):
    pool = jobs(spark, [("s", "e", "  ", "x", None, None), ("s", "e", "a", None, None, None), ("s", "e", "a", "b", 1, "c")])
    rows = clean.validate_records(pool, JOB).orderBy("arrival").collect()
    assert [r.reject_reason for r in rows] == ["missing_required_company", "missing_required_title", None]
    assert rows[0].flags == ["missing_required_company"]


def test_scores(spark):
    df = spark.createDataFrame([(4, 3, 0), (2, 1, 0), (2, 1, 2), (1, 0, 5)], "f int, s int, g int")
    totals = [4, 4, 2, 1]
    got = [df.select(clean.confidence(F.col("f"), t, F.col("s"), F.col("g"))).collect()[i][0] for i, t in enumerate(totals)]
    assert got == [1.0, 0.55, 0.7, 0.5]


def test_grounding_nulls_unsupported_fields(spark):
    page = "Founders: Jane Roe\n---\nAcme Corp raised 5,000,000 dollars in 2023.\n\nOther"
    records = spark.createDataFrame(
        [("r", "p", 1, "s", "Acme Corp raised 5,000,000 dollars", "Acme Corp", "Jane Roe", 5000000, [])],
        "run_id string, page_id string, arrival bigint, source_id string, evidence string, name string, founders string, amount bigint, flags array<string>",
    )
    pages = spark.createDataFrame([("r", "p", page)], "run_id string, page_id string, text string")
    row = verify.verify_records(records, pages, ["name", "founders", "amount"], {"name": "str"}).first()
    assert row.verified and row.founders is None and row.name == "Acme Corp" and row.amount == 5000000
    assert row.flags == ["unsupported_value", "unsupported_value_founders"] and row.n_nulled == 1


def test_hot_page_gives_the_same_verdicts(spark):
    pages = spark.createDataFrame([("r", "p", "alpha beta gamma"), ("r", "q", "delta")], "run_id string, page_id string, text string")
    rows = [("r", "p" if i % 3 else "q", i, "beta" if i % 2 else "zeta nine") for i in range(60)]
    records = spark.createDataFrame(rows, "run_id string, page_id string, arrival bigint, evidence string")
    one = verify.verify_records(records, pages, [], ground=False).select("arrival", "verified").collect()
    many = verify.verify_records(records, pages, [], ground=False, rows_per_task=7).select("arrival", "verified").collect()
    assert sorted(one) == sorted(many) and len(many) == 60


def _brute_partial(a, b, threshold):
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return not b
    windows = [b[i : i + m] for i in range(len(b) - m + 1)]
    windows += [b[:w] for w in range(1, m)] + [b[-w:] for w in range(1, m)]
    return any(200 * lcs_length(a, w) >= threshold * (m + len(w)) for w in windows)


def _mutated(rng, s, n, letters="abcde"):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        if rng.random() < 0.5 and s:
            s.pop(min(i, len(s) - 1))
        else:
            s.insert(i, rng.choice(letters))
    return "".join(s).strip() or "a"


def test_partial_match_against_all_windows():
    for seed in range(1500):
        rng = random.Random(seed)
        b = "".join(rng.choice("abcdefg ") for _ in range(rng.randrange(1, 150)))
        i = rng.randrange(len(b))
        a = _mutated(rng, b[i : i + rng.randrange(1, 50)], rng.randrange(0, 8))
        t = rng.choice([85, 90])
        assert partial_match(a, b, t) == _brute_partial(a, b, t), (a, b, t)


@pytest.mark.parametrize(("seed", "hot_pairs", "rounds"), [(1, 4_000_000, 8), (2, 1, 8), (3, 5, 1)])
def test_leaders_equal_the_sequential_pass(spark, seed, hot_pairs, rounds):
    rng = random.Random(seed)
    rows = []
    for run in range(3):
        pool = []
        for i in range(90):
            s = _mutated(rng, rng.choice(pool), rng.randrange(0, 4)) if pool and rng.random() < 0.7 else "".join(
                rng.choice("abcde ") for _ in range(rng.randrange(1, 40))).strip() or "b"
            pool.append(s)
            rows.append((run, i * 3, s))

    def similar(a, b):
        return 200 * lcs_length(a, b) >= 90 * (len(a) + len(b))

    want, pairs = {}, set()
    for run in range(3):
        own = [(i, s) for r, i, s in rows if r == run]
        firsts = {}
        for i, s in own:
            firsts.setdefault(s, i)
        unique = sorted((i, s) for s, i in firsts.items())
        pairs |= {(run, x, y) for n, (x, s) in enumerate(unique) for y, t in unique[n + 1 :] if similar(s, t)}
        absorbed = set()
        for n, (i, s) in enumerate(own):
            if i in absorbed:
                continue
            for j, t in own[n + 1 :]:
                if j not in absorbed and similar(s, t):
                    want[(run, j)] = i
                    absorbed.add(j)
    nodes = spark.createDataFrame(rows, "run_id int, idx bigint, s string")
    got = {(r.run_id, r.idx): r.leader for r in fuzzy.leaders_of(nodes, hot_pairs=hot_pairs, peel_rounds=rounds).collect()}
    assert got == want
    assert {(r.run_id, r.a, r.b) for r in fuzzy.similar_pairs(nodes, hot_pairs=hot_pairs).collect()} == pairs


def test_near_copies_of_one_run_stay_linear(spark):
    """A group of near copies is absorbed by its leader, not paired with itself."""
    rows = [(0, i, f"customer record number {i:05d} of the big list") for i in range(1500)]
    nodes = spark.createDataFrame(rows, "run_id int, idx bigint, s string")
    led = fuzzy.leaders_of(nodes, hot_pairs=10_000).collect()
    assert len(led) == 1499 and {r.leader for r in led} == {0}


def test_short_snippets_are_found(spark):
    snippets = spark.createDataFrame([(1, "ab"), (2, "one two three four five"), (3, "zz")], "snippet_id int, text string")
    docs = spark.createDataFrame([(1, "crab soup"), (2, "xone two three four fivey"), (3, "nothing")], "doc_id int, text string")
    got = sorted(tuple(r) for r in verify.snippets_in_documents(snippets, docs).collect())
    assert got == [(1, 1), (2, 2)]


def test_spec_rules(spark):
    fields = ",".join(f'{{"name":"F {i}","type":"str","description":"d","required":true}}' for i in range(1, 6))
    good = f'{{"entity":"e","fields":[{fields}],"key_fields":["f_1","f_2","f_3","f_4"],"filters":{{"a":1,"b":null,"c":["x","y"],"d":true}},"region":"zz"}}'
    rows = [(1, good), (2, "{"), (3, '{"entity":"e","fields":[],"filters":{"a":{"b":1}}}'), (4, '{"entity":"e","fields":[],"filters":"{\\"k\\":\\"v\\"}"}')]
    got = parse_specs(spark.createDataFrame(rows, "i int, spec string")).orderBy("i").collect()
    assert [f.name for f in got[0].spec.fields if f.required] == ["f_1", "f_2", "f_3"]
    assert got[0].spec.filters == {"a": "1", "c": "x, y", "d": "True"}
    assert (got[0].spec.region, got[0].spec.target_count) == ("GLOBAL", 30)
    assert [r.spec_reject for r in got] == [None, "unreadable spec", "nested filter", None]
    assert got[3].spec.filters == {"k": "v"}
    with pytest.raises(ValueError, match="snake_case"):
        FieldSpec("bad-name")


@pytest.mark.parametrize("seed", [5, 6])
def test_long_keys_lose_no_pair(spark, seed):
    """Keys around and beyond the length where pairs meet on grams, against all pairs."""
    rng = random.Random(seed)
    pool = []
    for _ in range(70):
        if pool and rng.random() < 0.7:
            pool.append(_mutated(rng, rng.choice(pool), rng.randrange(0, 16)))
        else:
            pool.append("".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(40, 160))).strip())
    unique = list(dict.fromkeys(pool))
    want = {
        (i, j)
        for i, s in enumerate(unique)
        for j, t in enumerate(unique)
        if i < j and 200 * lcs_length(s, t) >= 90 * (len(s) + len(t))
    }
    nodes = spark.createDataFrame([(0, i, s) for i, s in enumerate(unique)], "run_id int, idx bigint, s string")
    assert {(r.a, r.b) for r in fuzzy.similar_pairs(nodes).collect()} == want and len(want) > 20


def test_postings_grow_with_the_length(spark):
    keys = [(0, n, "".join(chr(97 + (i * i + n) % 26) for i in range(n))) for n in (40, 320, 640)]
    strings = fuzzy._distinct_strings(spark.createDataFrame(keys, "run_id int, idx bigint, s string"))
    rows = fuzzy._union([f(strings, 90) for f in (fuzzy._index_rows, fuzzy._probe_rows, fuzzy._gram_rows)])
    per_key = {r.idx: r["count"] for r in rows.groupBy("idx").count().collect()}
    assert per_key[320] <= 1.5 * 320 and per_key[640] <= 1.5 * 640


def test_long_keys_query_against_all_pairs(spark):
    from groundset.functions.text import key_text, sorted_tokens
    from groundset.plans.check_records import _quoted, fuzzy_long_keys

    sf_dir = "/root/testdata/sf0.001"
    keys = sorted_tokens(key_text(F.col("text"))).alias("s")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", keys).collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        if r.s:
            first.setdefault((r.conv_id % 3, r.s), r.conv_id * 1000 + r.turn)
    # The query also holds first turns once more, without their last word.
    for r in _quoted(spark.read.parquet(f"{sf_dir}/conversations.parquet")).orderBy("idx").collect():
        if r.s:
            first[r.run_id, r.s] = min(r.idx, first.get((r.run_id, r.s), r.idx))
    own = sorted((run, i, s) for (run, s), i in first.items())
    want = {
        (run, i, j)
        for n, (run, i, s) in enumerate(own)
        for other, j, t in own[n + 1 :]
        if other == run and abs(len(s) - len(t)) * 10 <= len(s) + len(t) and 200 * lcs_length(s, t) >= 90 * (len(s) + len(t))
    }
    assert {(r.run_id, r.a, r.b) for r in fuzzy_long_keys(spark, sf_dir).collect()} == want
