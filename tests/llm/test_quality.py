import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from groundset.llm import quality


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    filled = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(filled) - len(set(filled)), len(covered)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é#\n\t\x0b "), max_size=60), min_size=1, max_size=40))
def test_measures_as_counted_plainly(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    got = {r.doc_id: tuple(r[m] for m in quality.MEASURES) for r in quality.base_measures(df).collect()}
    assert got == {i: measures(t) for i, t in enumerate([*texts, None])}


def _own(i, n=60):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_template_lines_go_and_depleted_documents_too(docs):
    menu = "Home  About " + " ".join(f"m{k}" for k in range(70))
    rows = [(i, f"{_own(i)}\n{menu}", "a") for i in range(30)]  # more template than text
    rows += [(100 + i, f"{_own(100 + i, 200)}\nhome about {menu[12:]}", "a") for i in range(30)]
    rows += [(200, f"{_own(200)}\n{menu}", "b"), (300, _own(300), "a")]
    kept = {r.doc_id: r.text for r in quality.clean_documents(docs(rows)).collect()}
    assert set(kept) == {*range(100, 130), 200, 300}
    assert kept[100] == _own(100, 200) and kept[200].endswith(menu) and kept[300] == _own(300)


def test_copies_are_no_templates(docs):
    kept = quality.clean_documents(docs([(i, _own(0), "a") for i in range(100)] + [(500, _own(1), "a")]))
    assert kept.count() == 101


def test_odd_rows_have_a_result(docs):
    odd = docs([(1, None, None), (1, "", "a"), (None, _own(1), None), (2, _own(2), "a"), (2, _own(2), "a")])
    rows = quality.quality_verdicts(odd.selectExpr("*", "1 as _row", "2 as kept", "3 as n_words")).collect()
    assert sorted((r.doc_id or 0, r.kept, r.n_words) for r in rows) == [
        (0, True, 60), (1, False, 0), (1, False, 0), (2, True, 60), (2, True, 60),
    ]
    assert quality.clean_documents(odd).count() == 3
    assert quality.quality_verdicts(docs([])).count() == 0


def test_long_text(docs):
    text = "a b c " * 100_000
    row = quality.quality_verdicts(docs([(1, text)])).first()
    assert row.n_repeat_words == row.n_words == 300_000 and row.base_failed


def test_a_null_host_is_no_empty_host(docs):
    line = " ".join(f"m{k}" for k in range(70))
    texts = [(i, f"{_own(i, 40)}\n{line}", None if i < 12 else "") for i in range(24)]
    assert quality.quality_verdicts(docs(texts)).where("kept and n_lost_words = 0").count() == 24
    more = texts + [(100 + i, f"{_own(100 + i, 40)}\n{line}", None) for i in range(8)]
    rows = quality.quality_verdicts(docs(more)).collect()
    assert {r.doc_id for r in rows if r.n_lost_words} == {*range(12), *range(100, 108)}
    cleaned = {r.doc_id: r.text for r in quality.clean_documents(docs(texts)).collect()}
    assert cleaned == {i: t for i, t, _ in texts}
