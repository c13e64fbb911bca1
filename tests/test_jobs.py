import os

import pytest
from pyspark.sql import functions as F

from groundset.operators import candidates as cand
from groundset.operators import policy, report, skew, views
from groundset.plans.check_records import PART_SPEC
from groundset.plans.dataset import as_store_records, build_dataset, collect, extract_until
from groundset.session import scratch_path
from groundset.sinks import exports
from groundset.sinks import store as sink
from groundset.sources.robots import robots_rules
from groundset.sources.store import folders, read_candidates, read_current, rejected_candidates
from groundset.spec import FieldSpec, TaskSpec
from groundset.streaming.live import LiveDataset
from groundset.streaming.throttle import _decide, throttle


def test_policy_reasons(spark):
    urls = [
        "https://www.linkedin.com/in/x", "ftp://a.b/c", "http://", "http://127.0.0.1/", "http://[::1]/",
        "https://sub.reddit.com/", "https://ok.example.com/private/x", "https://ok.example.com/pub",
    ]
    robots = spark.createDataFrame([("ok.example.com", "User-agent: *\nDisallow: /private/", 200)], "host string, text string, http_status int")
    df = policy.with_policy(spark.createDataFrame([(u,) for u in urls], "url string"), robots_rules=robots_rules(robots))
    got = {r.url: r.reason for r in df.collect()}
    assert [got[u] for u in urls] == [
        "Blocked domain: www.linkedin.com", "Unsupported scheme: ftp", "No hostname in URL",
        "Private/loopback/link-local IP", "Private/loopback/link-local IP", "Blocked domain: sub.reddit.com",
        "Disallowed by robots.txt", "OK",
    ]


def test_join_spread_keeps_every_row(spark):
    left = spark.range(500).select((F.col("id") % 7 % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    for how in ("inner", "left"):
        want = sorted(tuple(r) for r in left.join(right, "k", how).select("id", "v").collect())
        got = skew.join_spread(left, right, ["k"], ["id"], how, rows_per_task=20).select("id", "v").collect()
        assert sorted(tuple(r) for r in got) == want


def test_prefix_scan_equals_window(spark):
    df = spark.range(3000).select((F.col("id") % 3 % 2).alias("g"), ((F.col("id") * 7919) % 3001).alias("o"))
    got = skew.with_prefix(df, ["g"], ["o"], count="n", running_max={"m": -F.col("o") % 17}).collect()
    for g in (0, 1):
        best = None
        for n, r in enumerate(sorted((r for r in got if r.g == g), key=lambda r: r.o), 1):
            v = -(r.o % 17)
            best = v if best is None else max(best, v)
            assert (r.n, r.m) == (n, best)


def test_budget_and_stop(spark):
    rows = [("r", i, i % 2 == 0) for i in range(10)] + [("s", i, False) for i in range(3)]
    visits = spark.createDataFrame(rows, "run_id string, i int, processed boolean")
    kept = cand.within_budget(visits, ["i"], 3).groupBy("run_id").agg(F.max("i")).collect()
    assert {r[0]: r[1] for r in kept} == {"r": 4, "s": 2}


def test_report_of_a_normal_run(spark):
    stats = spark.createDataFrame([("r", 20, 15, 12, 10, 3, 0, 5, 0)], "run_id string, " + ", ".join(f"{c} bigint" for c in report.STAT_COUNTS))
    sources = spark.createDataFrame(
        [("r", "fetched", "a.com", 6, None), ("r", "fetched", "b.com", 4, None), ("r", "blocked_by_robots", "c.com", 0, "x")],
        "run_id string, status string, domain string, records_found bigint, reason string",
    )
    records = spark.createDataFrame([("r", {"name": f"n{i}", "funding": None if i % 2 else "1"}) for i in range(10)], "run_id string, data map<string,string>")
    fields = spark.createDataFrame([("r", 0, "name", True), ("r", 1, "funding", False)], "run_id string, ordinal int, name string, required boolean")
    assert [r.dropped for r in report.funnel(stats).orderBy("stage").collect()] == [0, 5, 3, 2]
    signals = {r.name: (r.value, r.passed) for r in report.trust_signals(stats, sources, records, fields).collect()}
    assert signals == {
        "verification_rate": (0.75, True), "corroboration": (0.5, True),
        "source_concentration": (0.6, True), "required_completeness": (1.0, True),
    }
    shares = [(r.name, r.non_null_count, r.share) for r in report.field_completeness(records, fields).orderBy("ordinal").collect()]
    assert shares == [("name", 10, 1.0), ("funding", 5, 0.5)]
    assert report.sources_summary(sources).first().blocked_by_robots == 1


def test_diagnostics_rules(spark):
    cases = {  # run: (raw, verified, valid, deduped, fetched), sources
        "blocked": ((0, 0, 0, 0, 0), ["blocked_by_policy"] * 2),
        "no_text": ((0, 0, 0, 0, 0), ["failed"]),
        "nothing": ((0, 0, 0, 0, 2), ["fetched"] * 2),
        "hallucinated": ((5, 0, 0, 0, 1), ["fetched"]),
        "invalid": ((5, 5, 0, 0, 1), ["fetched"]),
        "few": ((5, 5, 5, 3, 2), ["fetched", "blocked_by_robots", "failed", "failed", "failed"]),
        "healthy": ((50, 40, 35, 30, 5), ["fetched"] * 5),
    }
    columns = ("raw_count", "verified_count", "valid_count", "deduped_count", "pages_fetched")
    stats = spark.createDataFrame([(k, *v[0]) for k, v in cases.items()], "run_id string, " + ", ".join(f"{c} bigint" for c in columns))
    stats = stats.withColumn("target_count", F.lit(30)).withColumn("missing_required", F.lit(2)).withColumn("filters", F.create_map().cast("map<string,string>"))
    sources = spark.createDataFrame([(k, s, "Insufficient text content after extraction") for k, v in cases.items() for s in v[1]], "run_id string, status string, reason string")
    rules = {}
    for r in report.diagnostics(stats, sources, gate=None).orderBy("run_id", "position").collect():
        rules.setdefault(r.run_id, []).append(r.rule)
    assert rules == {
        "blocked": ["all_blocked"], "no_text": ["no_text"], "nothing": ["no_extracted"], "hallucinated": ["all_hallucinated"],
        "invalid": ["all_invalid"], "few": ["below_target", "some_blocked", "many_failures"],
    }


def _store(spark, n_evidence):
    records = spark.createDataFrame([("a", "r", {"name": "=x"}, 0.9), ("b", "r", {"name": "y"}, 0.5)], "record_id string, run_id string, data map<string,string>, confidence double").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    ev = [("a", "r", f"s{i % 3}", f"snip {i}", i) for i in range(n_evidence)]
    evidence = spark.createDataFrame(ev, "record_id string, run_id string, source_id string, snippet string, position bigint")
    sources = spark.createDataFrame([(f"s{i}", "r", f"http://u/{i}", "u", "fetched", 200, None, 1) for i in range(3)], "source_id string, run_id string, url string, domain string, status string, http_status int, reason string, records_found bigint").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    return records, evidence, sources


def test_long_link_lists_stay_in_one_row(spark):
    records, evidence, sources = _store(spark, 10_001)
    rows = views.provenance(records, evidence, sources).orderBy("record_id").collect()
    assert [r.record_id for r in rows] == ["a", "b"] and rows[1].source_urls == ""
    assert rows[0].source_urls.split(" | ") == [f"http://u/{i % 3}" for i in range(10_001)]
    assert rows[0].evidence == "snip 0"
    assert views.record_links(evidence, sources).count() == 10_001


def test_export_files(spark):
    records, evidence, sources = _store(spark, 2)
    rows = views.provenance(records, evidence, sources)
    root = scratch_path(spark, "export")
    stats = spark.createDataFrame([("r", 20, 15, 12, 10, 3, 0, 5, 0)], "run_id string, " + ", ".join(f"{c} bigint" for c in report.STAT_COUNTS))
    exports.write_bundle(rows, ["name"], sources, stats, root)
    back = spark.read.option("header", True).csv(os.path.join(root, "records")).orderBy(F.col("confidence").desc()).collect()
    assert [(r.name, r.source_urls, r.evidence) for r in back] == [("'=x", "http://u/0 | http://u/1", "snip 0"), ("y", None, None)]
    assert spark.read.option("header", True).csv(os.path.join(root, "report")).count() == 7
    exports.write_json(rows, ["name"], os.path.join(root, "json"))
    js = spark.read.json(os.path.join(root, "json")).orderBy("name").collect()
    assert [len(r.evidence) for r in js] == [1, 0] and js[0].evidence[0].source_url == "http://u/0"


def test_replace_touches_only_its_runs(spark):
    root = scratch_path(spark, "store")
    base = spark.createDataFrame([("r1", "a"), ("r2", "b")], "run_id string, record_id string")
    full = base.select("record_id", "run_id", F.create_map().cast("map<string,string>").alias("data"), F.lit("k").alias("dedupe_key"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("flags"), F.current_timestamp().alias("created_at"))
    sink.replace_runs({"records": full}, root, full, 0)
    first = full.filter("run_id = 'r1'")
    sink.replace_runs({"records": first.withColumn("record_id", F.lit("c"))}, root, first, 1)
    assert sorted(r.record_id for r in read_current(spark, root, "records").collect()) == ["b", "c"]
    sink.replace_runs({"records": full.limit(0)}, root, first, 2)
    assert [r.record_id for r in read_current(spark, root, "records").collect()] == ["b"]


def _run_rows(spark, rows):
    shape = "record_id string, run_id string, data map<string,string>, dedupe_key string, confidence double, flags array<string>, created_at timestamp"
    return spark.createDataFrame([(record, run, {}, "k", 0.5, [], None) for run, record in rows], shape)


def test_a_compacted_store_reads_only_what_counts(spark):
    root = scratch_path(spark, "store")
    sink.replace_runs({"records": _run_rows(spark, [("r0", "kept"), ("r1", "old"), ("r2", "gone")])}, root, _run_rows(spark, [("r0", ""), ("r1", ""), ("r2", "")]), 0)
    for v in range(1, 31):
        again = _run_rows(spark, [("r1", f"v{v}"), ("r1", f"w{v}")])
        sink.replace_runs({"records": again}, root, again, v)
    sink.replace_runs({"records": _run_rows(spark, [])}, root, _run_rows(spark, [("r2", "")]), 31)

    def records(upto=None):
        return sorted((r.run_id, r.record_id) for r in read_current(spark, root, "records", upto).collect())

    want = [("r0", "kept"), ("r1", "v30"), ("r1", "w30")]
    assert records() == want and records(0) == [("r0", "kept"), ("r1", "old"), ("r2", "gone")]
    sink.compact(spark, root, 30)  # the run that version 31 empties is still among its rows
    sink.compact(spark, root, 30)
    assert records() == want and records(30) == sorted([*want, ("r2", "gone")])
    with pytest.raises(ValueError):
        records(29)
    with pytest.raises(ValueError):
        sink.replace_runs({"records": again}, root, again, 30)
    assert sink.remove_superseded(spark, root) == 62  # 31 versions of two tables
    assert records() == want and sorted(folders(spark, f"{root}/records", "version")) == [31]
    sink.replace_runs({"records": _run_rows(spark, [("r0", "new")])}, root, _run_rows(spark, [("r0", "")]), 32)
    sink.compact(spark, root, 32)
    assert sink.remove_superseded(spark, root) == 6
    assert records() == [("r0", "new"), *want[1:]]
    files = read_current(spark, root, "records").inputFiles()
    assert files and all("/compacted=32/" in f for f in files)


def test_a_broken_compaction_has_no_effect(spark):
    root = scratch_path(spark, "store")
    rows = _run_rows(spark, [("r0", "a"), ("r1", "b")])
    sink.replace_runs({"records": rows}, root, rows, 0)
    rows.limit(0).write.parquet(f"{root}/records/compacted=0")  # its list of runs was never written
    assert read_current(spark, root, "records").count() == 2 and sink.remove_superseded(spark, root) == 0
    sink.compact(spark, root, 0)
    assert read_current(spark, root, "records").count() == 2
    assert read_current(spark, scratch_path(spark, "none"), "records").count() == 0


def test_broken_lines_are_returned(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"url":"u1"}\n{"url": "u2", "ti\n\n[1]\n{"title":"no url","rank":3}\n{"url":"u3","rank":"x"}\n{"url":""}\n')
    assert [r.url for r in read_candidates(spark, str(tmp_path)).collect()] == ["u1"]
    left = sorted((r.reason, r.line or "", r.title or "") for r in rejected_candidates(spark, str(tmp_path)).collect())
    assert left == [
        ("broken_line", "[1]", ""), ("broken_line", '{"url": "u2", "ti', ""), ("broken_line", '{"url":"u3","rank":"x"}', ""),
        ("no_url", "", ""), ("no_url", "", "no url"),
    ]


def test_candidate_shapes(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"url":"u1","title":"t","content":"c"}\n{"href":"u2","body":"b"}\n{"link":"u3"}\n{"title":"no url"}\n')
    got = sorted((r.url, r.snippet) for r in read_candidates(spark, str(tmp_path)).collect())
    assert got == [("u1", "c"), ("u2", "b"), ("u3", "")]


@pytest.mark.parametrize("limit", [1, 3])
def test_throttle_equals_the_sequential_log(spark, limit):
    import random

    rng = random.Random(limit)
    rows, at = [], {}
    for i in range(1200):
        c = "hot" if rng.random() < 0.5 else f"c{rng.randrange(5)}"
        at[c] = at.get(c, 0) + rng.choice([0, 1, 7, 20, 90, 200])
        rows.append((c, i, at[c]))
    df = spark.createDataFrame(rows, "client string, request_id bigint, s bigint").select("client", "request_id", F.timestamp_seconds("s").alias("ts"))
    from collections import deque

    want, logs = {}, {}
    for c, i, s in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want[i] = _decide(logs.setdefault(c, deque()), s * 1_000_000, limit, 60_000_000)
    got = {r.request_id: (r.accepted, r.retry_after) for r in throttle(df, limit=limit).collect()}
    assert got == want


def _pool(spark, rows):
    return spark.createDataFrame([(r, a, f"s{a}", n, "t", None, None, f"e{a}", []) for r, a, n in rows], "run_id string, arrival bigint, source_id string, name string, type string, brand string, size bigint, evidence string, flags array<string>")


def test_live_batches_equal_one_build(spark):
    rows = [("r1", 1, "alpha beta gamma"), ("r2", 2, "one"), ("r1", 3, "alpha beta gama"), ("r1", 4, "delta"), ("r2", 5, "two")]
    root = scratch_path(spark, "live")
    live = LiveDataset(root, PART_SPEC)
    live(_pool(spark, rows[:2]), 0)
    live(_pool(spark, rows[2:4]), 1)
    live(_pool(spark, rows[2:4]), 1)  # the batch is retried
    live(_pool(spark, rows[4:]), 2)
    want = as_store_records(build_dataset(_pool(spark, rows), PART_SPEC).records, PART_SPEC)
    pick = ["record_id", "confidence"]
    stored = read_current(spark, root, "records").select(*pick).collect()
    assert sorted(stored) == sorted(want.select(*pick).collect()) and len(stored) == 4
    assert read_current(spark, root, "record_evidence").count() == 5
    assert spark.read.parquet(f"{root}/live_events").count() == 4


def test_live_with_compaction_ends_the_same(spark):
    rows = [(f"r{i % 3}", i, "abcdefghijkl"[i] * 6) for i in range(12)]
    roots = [scratch_path(spark, "live") for _ in range(2)]
    for root, every in zip(roots, (None, 2), strict=True):
        live = LiveDataset(root, PART_SPEC, compact_every=every)
        for batch in range(6):
            live(_pool(spark, rows[2 * batch : 2 * batch + 2]), batch)
        live(_pool(spark, rows[10:]), 5)  # the last batch is retried
    plain, compacted = (sorted(r.record_id for r in read_current(spark, root, "records").collect()) for root in roots)
    assert plain == compacted and len(plain) == 12
    assert min(folders(spark, f"{roots[1]}/records", "version")) > 0


def test_collect_end_to_end(spark):
    spec = TaskSpec("startup", (FieldSpec("name", "str", "", True), FieldSpec("funding")), ("name",), target_count=5)
    candidates = spark.createDataFrame(
        [("r", 0, 0, "https://ok.example.com/a", "t", ""), ("r", 0, 1, "https://www.linkedin.com/x", "t", ""), ("r", 1, 0, "https://ok.example.com/a", "t", "")],
        "run_id string, query_idx bigint, rank bigint, url string, title string, snippet string",
    )
    body = "<article><p>Acme raised $5M in funding this year.</p><p>Beta raised $9M in funding as well, people say.</p></article>"
    fetched = spark.createDataFrame([("https://ok.example.com/a", body, 200, "text/html")], "url string, html string, http_status int, content_type string")

    def extractor(chunk, url):
        return [
            {"name": "Acme", "funding": "$5M", "evidence": "Acme raised $5M in funding this year."},
            {"name": "Beta", "funding": "$9M", "evidence": "Beta raised $9M in funding"},
            {"name": "Ghost", "funding": "$1M", "evidence": "completely invented quotation about ghosts"},
        ]

    out = collect(candidates, fetched, spec, extractor)
    assert sorted(r.name for r in out.dataset.records.collect()) == ["Acme", "Beta"]
    stats = out.stats.first()
    assert (stats.raw_count, stats.verified_count, stats.hallucinated_count, stats.deduped_count, stats.pages_fetched) == (3, 2, 1, 2, 1)
    assert {r.status: r.records_found for r in out.sources.collect()} == {"fetched": 2, "blocked_by_policy": 0}
    assert {(r.reason, r.n) for r in out.drop_reasons.collect()} == {("blocked_by_policy", 1), ("evidence_mismatch", 1)}


def test_extractor_runs_once_per_chunk_and_failures_are_told(spark, tmp_path):
    log = str(tmp_path / "calls")

    def extractor(chunk, url):
        with open(log, "a") as f:
            f.write("x")
        if "broken" in url:
            raise ValueError("no answer")
        return [{"name": f"N{url[-1]}", "evidence": chunk[:30]}]

    spec = TaskSpec("startup", (FieldSpec("name", "str", "", True),), ("name",))
    body = "<article><p>" + "words of a page that goes on and on " * 500 + "</p></article>"
    urls = [f"https://ok.example.com/{i}" for i in range(4)] + ["https://ok.example.com/broken"]
    # Ranks beyond 16 bits stay in their query; the page of both runs is fetched and read once.
    rows = [(run, q, 70_000 * (4 - i), u, "t", "") for run in ("r", "s") for q, (i, u) in enumerate(enumerate(urls))]
    candidates = spark.createDataFrame(rows, "run_id string, query_idx bigint, rank bigint, url string, title string, snippet string")
    fetched = spark.createDataFrame([(u, body, 200, "text/html") for u in urls], "url string, html string, http_status int, content_type string")
    out = collect(candidates, fetched, spec, extractor)
    assert {r.url: r.records_found for r in out.sources.collect()} == {u: 0 if "broken" in u else 3 for u in urls}
    chunks = 3  # of 18,000 characters, none cut off
    assert len(open(log).read()) == 2 * (4 * chunks + 1)
    assert {(r.run_id, r.error) for r in out.failures.collect()} == {(k, "ValueError: no answer") for k in "rs"}
    assert [r.name for r in out.verified.filter("run_id = 'r'").orderBy("arrival").collect()][::3] == ["N0", "N1", "N2", "N3"]


def test_redirects_and_query_limit_in_collect(spark):
    spec = TaskSpec("startup", (FieldSpec("name", "str", "", True),), ("name",))
    urls = [f"https://ok.example.com/{i}" for i in range(3)]
    rows = [("r", 0, i, u, "t", "a search snippet that is long enough to stand in for a page") for i, u in enumerate(urls)]
    candidates = spark.createDataFrame(rows, "run_id string, query_idx bigint, rank bigint, url string, title string, snippet string")
    fetched = spark.createDataFrame([], "url string, html string, http_status int, content_type string")
    hops = spark.createDataFrame([(urls[1], 1, "https://www.facebook.com/x")], "url string, hop int, target string")
    out = collect(candidates, fetched, spec, lambda c, u: [], limit_per_query=2, redirects=hops)
    assert {r.url: r.status for r in out.sources.collect()} == {urls[0]: "via_search_provider", urls[1]: "blocked_by_policy"}


def test_collect_stops_at_the_target(spark, tmp_path):
    log = str(tmp_path / "calls")

    def names(i):
        return [f"Quarry {'abcdefgh'[i // 2 % 8] * 3}", f"Orchard {'abcdefgh'[i % 8] * 3}"][: 1 + i % 2]

    def extractor(chunk, url):
        with open(log, "a") as f:
            f.write("x")
        return [{"name": n, "evidence": n} for n in names(int(url.rsplit("/", 1)[1]))]

    spec = TaskSpec("startup", (FieldSpec("name", "str", "", True),), ("name",))
    urls = [f"https://ok.example.com/{i}" for i in range(30)]
    rows = [(run, 0, i, u, "t", "") for run, n in (("long", 30), ("short", 3)) for i, u in enumerate(urls[:n])]
    candidates = spark.createDataFrame(rows, "run_id string, query_idx bigint, rank bigint, url string, title string, snippet string")
    bodies = [f"<article><p>{' and '.join(names(i))} stand on a page that goes on and on with its words</p></article>" for i in range(30)]
    fetched = spark.createDataFrame([(u, b, 200, "text/html") for u, b in zip(urls, bodies, strict=True)], "url string, html string, http_status int, content_type string")
    # Page by page: pages bring 1, 2, 1, 2 names, of which the fifth different one stands on page 4.
    seen, stop = set(), 0
    while len(seen) < 5:
        seen.update(names(stop))
        stop += 1
    out = collect(candidates, fetched, spec, extractor, target=5, first_wave=2, merge_similar=False)
    pages = {run: sum(r.run_id == run for r in out.sources.collect()) for run in ("long", "short")}
    assert pages == {"long": stop, "short": 3} and stop < 10
    # Waves of 2, 4, 8 pages: none begins after the stop.
    assert len(open(log).read()) <= 2 * stop + 2 + 3
    expected = sorted((run, i + 1, n) for run, end in (("long", stop), ("short", 3)) for i in range(end) for n in names(i))
    assert sorted((r.run_id, r.page_order, r.name) for r in out.verified.collect()) == expected


def test_extract_until_on_nothing(spark):
    spec = TaskSpec("startup", (FieldSpec("name", "str", "", True),), ("name",))
    empty = spark.createDataFrame([], "run_id string, page_id string, page_order bigint, url string, text string")
    out = extract_until(empty, spec, lambda chunk, url: [], 3)
    assert (out.rows.count(), out.verified.count(), out.stops.count()) == (0, 0, 0)
