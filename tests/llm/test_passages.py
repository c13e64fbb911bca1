import os
import random
import time

import numpy as np

from groundset.llm import passages
from groundset.llm.tables import CLEANUP, written
from groundset.session import shared_dir


def _words(seed, n):
    draw = random.Random(seed)
    return [f"{draw.choice('abcdefgh')}{draw.randrange(10**6)}" for _ in range(n)]


def test_any_common_passage_shares_a_paragraph():
    for seed in range(60):
        shared = _words(seed, 51)
        texts = [" ".join([*_words(1000 + 2 * seed + k, 37 * k + seed), *shared, *_words(5000 + seed + k, 90)]) for k in (0, 1)]
        found = [set(passages.paragraphs_of(t)[2].tolist()) for t in texts]
        assert found[0] & found[1], seed


def test_spans_are_characters_of_the_text():
    text = "Äé \n" + "  ".join(_words(3, 70)) + " 日本 " + "\t".join(_words(4, 40))
    start, end, _, _, keys = passages.paragraphs_of(text)
    assert len(start) and keys.shape == (len(start), passages.BANDS)
    for a, b in zip(start, end, strict=True):
        assert len(text[a:b].split()) == passages.WORDS and text[a:b] == text[a:b].strip()
    assert len(passages.paragraphs_of(None)[0]) == len(passages.paragraphs_of("a b c")[0]) == 0
    assert len(passages.paragraphs_of(" ".join(_words(1, 20)))[0]) == 1


def _runs(rows):
    """Longest runs of words whose windows of 19 words all stand in another document, by comparing all windows."""
    held = {}
    for k, t in rows:
        w = (t or "").lower().split()
        for i in range(len(w) - 18 if len(w) >= 20 else 0):
            held.setdefault(tuple(w[i : i + 19]), set()).add(k)
    out = []
    for k, t in rows:
        w = (t or "").lower().split()
        at = [i for i in range(len(w) - 18 if len(w) >= 20 else 0) if len(held[tuple(w[i : i + 19])]) > 1]
        firsts = [i for i in at if i - 1 not in at]
        for i in firsts:
            j = next(j for j in range(i, len(w)) if j + 1 not in at)
            out.append((k, i, tuple(w[i : j + 19])))
    return out


def _placed(rows, got):
    """Spans as document, number of the first word, words."""
    texts = dict(rows)
    return sorted((r.doc_id, len(texts[r.doc_id][: r.start].split()), tuple(texts[r.doc_id][r.start : r.end].lower().split())) for r in got)


def test_runs_of_all_lengths_at_all_places(docs):
    rows = []
    for n in range(17, 80):
        shared = _words(n, n)
        for k in (0, 1):
            rows.append((2 * n + k, " ".join([*_words(1000 + 2 * n + k, (7 * n + 31 * k) % 45), *shared, *_words(5000 + 2 * n + k, (5 * n) % 37)])))
    got = repeated = passages.repeated_spans(docs(rows)).collect()
    assert _placed(rows, got) == sorted(_runs(rows))
    assert {r.doc_id // 2 for r in repeated} == set(range(19, 80))
    assert all(r.keep_id == r.doc_id // 2 * 2 and r.removed == bool(r.doc_id % 2) for r in repeated)


def test_runs_between_edits_against_all_windows(docs):
    base = _words(8, 400)
    rows = []
    for k in range(60):
        w = list(base)
        for at in random.Random(k).sample(range(400), 14):
            w[at] = f"edit{k}x{at}"
        rows.append((k, "  ".join(w)))
    rows += [(70, " ".join("abc" * 30)), (71, " ".join("abc" * 25)), (72, "same " * 50), (73, "x " + "SAME " * 40), (74, "y " * 19)]
    got = passages.repeated_spans(docs(rows)).collect()
    assert _placed(rows, got) == sorted(_runs(rows)) and len(got) > 200


def test_an_edit_inside_leaves_both_sides(docs):
    rows = []
    for n in range(30):
        shared = _words(n, 60)
        changed = [*shared[:30], f"changed{n}", *shared[31:]]
        rows += [(2 * n + k, " ".join([*_words(900 + 2 * n + k, 20 + n + k), *w, *_words(3000 + 2 * n + k, 33)])) for k, w in enumerate((shared, changed))]
    got = passages.repeated_spans(docs(rows)).collect()
    assert [len(w) for _, _, w in _placed(rows, got)] == [30, 29] * 60


def test_rows_of_one_id_are_texts_of_their_own(docs):
    one, two = _words(1, 40), _words(2, 40)
    rows = [(None, " ".join(one)), (None, " ".join(["x"] * 5 + two)), (4, " ".join(one)), (5, " ".join(two)), (5, " ".join([*_words(3, 50), *two]))]
    got = passages.repeated_spans(docs(rows)).collect()
    sizes = sorted((r.doc_id or 99, r.end - r.start, r.keep_id) for r in got)
    n, m = len(rows[2][1]), len(rows[3][1])
    assert sizes == sorted([(4, n, 4), (99, n, 4), (5, m, 5), (5, m, 5), (99, m, 5)])


def test_passages_are_found_and_clean_documents_left(docs):
    shared = _words(1, 60)
    put = lambda k: " ".join([*_words(100 + k, 80), *(w.upper() if k == 2 else w for w in shared), *_words(200 + k, 50)])
    rows = [(k, put(k)) for k in (5, 2, 9)] + [(20 + k, " ".join(_words(300 + k, 200))) for k in range(5)]
    rows += [(50, None), (51, ""), (52, "short"), (2, put(2))]
    got = passages.repeated_spans(docs(rows).selectExpr("*", "1 as start", "2 as _id")).collect()
    assert {(r.doc_id, r.keep_id, r.removed) for r in got} == {(2, 2, False), (5, 2, True), (9, 2, True)}
    for r in got:
        assert set(dict(rows)[r.doc_id][r.start : r.end].lower().split()) <= set(shared)


def test_null_ids_and_no_rows(docs):
    text = " ".join(_words(1, 60))
    got = passages.repeated_spans(docs([(None, text), (4, text)])).collect()
    assert {(r.doc_id, r.keep_id, r.removed) for r in got} == {(4, 4, False), (None, 4, True)}
    assert passages.repeated_spans(docs([])).count() == passages.repeated_spans(docs([(1, "x"), (2, None)])).count() == 0


def test_keys_depend_on_content_alone():
    a = passages.paragraphs_of(" ".join(_words(9, 100)))
    b = passages.paragraphs_of("\n".join(_words(9, 100)).upper())
    assert all(np.array_equal(a[i], b[i]) for i in (2, 3, 4))


def test_intermediate_tables_are_dropped(spark):
    """Only the runs, which the result reads, are left of what was written on the way."""
    shared_dir(spark)
    root = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    rows = [(i, " ".join(_words(1, 40) + _words(10 + i, 30))) for i in range(4)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before if not n.startswith(".")}
    names = {"texts", "several", "shared_keys", "stretches", "kinds", "mixed", "lists", "in_pieces", "pieces", "in_runs"}
    assert len(found) == 4 and "runs" in left and not left & names, left


def test_texts_of_a_slice_are_taken_apart_together(monkeypatch):
    """Each word is hashed once, not once for each shingle it is in, and no half reaches into the next text."""
    texts = [" ".join(_words(k, n)) for k, n in enumerate((19, 20, 300, 0, 3, 45))] + [None, "Ä é " * 30, "a b " * 25]
    whole, hashed = passages.xxhash.xxh64_intdigest, []
    monkeypatch.setattr(passages.xxhash, "xxh64_intdigest", lambda w: hashed.append(w) or whole(w))
    of, number, key, sizes, half, start, end = passages.stretches_of(texts)
    assert hashed == [w for t in texts for w in (t or "").encode().lower().split()]
    rows, at = np.repeat(of, sizes), np.concatenate([n + np.arange(m) for n, m in zip(number, sizes, strict=True)])
    words = [(t or "").split() for t in texts]
    assert list(zip(rows, at, strict=True)) == [(k, i) for k, w in enumerate(words) if len(w) > 19 for i in range(len(w) - 18)]
    for k, i, a, b in zip(rows, at, start, end, strict=True):
        assert texts[k][a:b].split() == words[k][i : i + 19]
    same = {}
    for k, i, h in zip(rows, at, half, strict=True):
        assert same.setdefault(tuple(words[k][i : i + 19]), h) == h
    assert len(set(same.values())) == len(same)
    assert all(len(p) == 0 for p in passages.stretches_of([None, "short"]))


def test_least_places_against_windows():
    draw = np.random.default_rng(3)
    for width in (1, 2, 3, 15):
        values = draw.integers(0, 6, 200)
        assert passages._least_places(values, width).tolist() == [i + values[i : i + width].argmin() for i in range(201 - width)]


def test_shuffle_files_go_once_a_table_is_written(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: {f for f in disk.getAllFiles().mkString(" ").split() if f.endswith(".data") and "/shuffle_" in f}
    setting, before = spark.conf.get(CLEANUP, None), held()
    table = written(spark.range(1000).repartition(7), "shuffled")
    until = time.monotonic() + 10
    while held() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not held() - before and table.count() == 1000
    assert spark.conf.get(CLEANUP, None) == setting
