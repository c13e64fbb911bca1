import random

import pytest
from pyspark.sql import functions as F

from groundset.llm import secrets

PROSE = "the render and the other of thing on them there are in was for with is".split()


def _corpus(seed, n):
    """Texts with planted secrets and look-alikes, and the planted spans with their labels."""
    draw, rows, planted = random.Random(seed), [], {}
    for k in range(n):
        before, after = (" ".join(draw.choices(PROSE, k=12)) for _ in range(2))
        hexed = "".join(draw.choices("0123456789abcdef", k=40))
        mixed = "".join(draw.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijk23456789", k=32))
        kind, head, own, tail = draw.choice(
            [
                (1, 'token = "', hexed, '"'), (1, "secret: '", mixed, "'"), (1, 'API_KEY="', mixed, '"'),
                (0, "card ", "".join(draw.choices("0123456789", k=16)), ""),
                (0, "see https://x.example.com/a/", f"{hexed[:20]}", ".html"),
                (0, "mail ", f"{draw.randrange(99)}some.user.name", "@mail.example.com"),
                (0, "", "00000000-11110000", ""),
            ]
        )
        rows.append((k, f"{before} {head}{own}{tail} {after}"))
        planted[k] = (kind, own)
    return rows, planted


def test_planted_secrets_are_told_from_look_alikes(docs):
    rows, planted = _corpus(1, 400)
    found = secrets.scan(docs(rows))
    hits = {(r.doc_id, r.value) for r in found.where("is_secret").collect()}
    assert hits == {(k, own) for k, (kind, own) in planted.items() if kind}


def test_forest_on_held_out_findings(docs):
    """Trained on one corpus, asked about another whose labels it hasn't seen."""
    rows, _ = _corpus(2, 400)
    df = docs(rows)
    near = secrets.Surroundings(secrets.corpus_counts(df))
    model = secrets.train(secrets.find_candidates(df, near))
    unseen, planted = _corpus(3, 300)
    other = docs(unseen)
    asked = secrets.find_candidates(other, near).withColumn("label", F.lit(None).cast("int"))
    judged = secrets.judge(asked, model).collect()
    right = sum(r.is_secret == bool(planted[r.doc_id][0]) for r in judged)
    assert len(judged) >= 280 and right >= 0.97 * len(judged)


@pytest.mark.parametrize(
    "text, want",
    [
        ("x password: hunter2abc y", ["hunter2abc"]), ("plain words onlyverylongwordwithoutanydigit", []),
        ("éé token = 'a1b2c3d4e5f6'", ["a1b2c3d4e5f6"]), ("", []), ("a=b c:d", []),
        ("run 4929348385146306 end.", ["4929348385146306"]),
    ],
)
def test_candidates(text, want):
    assert [text[a:b] for a, b in secrets.candidates_in(text)] == want


def test_redaction_keeps_every_row(docs):
    rows, planted = _corpus(4, 60)
    rows += [(900, None), (901, ""), (None, rows[0][1]), (0, rows[0][1]), (902, "word " * 200_000)]
    df = docs(rows).selectExpr("*", "'v' as value", "1 as _spans", "2 as _text")
    out = secrets.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    for r in out.collect():
        kind, own = planted.get(r.doc_id, (0, None))
        if kind:
            assert own not in r.text and secrets.REDACTED in r.text
        elif r.doc_id in dict(rows) and r.doc_id is not None:
            assert r.text == dict(rows)[r.doc_id]


def test_without_both_labels_nothing_is_dropped(docs):
    got = secrets.scan(docs([(1, "number 4929348385146306 here"), (2, "odd Ab1Ab2Ab3Cd4Ef5Gh6Xy zz")])).collect()
    assert sorted((r.doc_id, r.is_secret) for r in got if r.label is not None) == [(1, False)]
    assert [r.is_secret for r in got if r.label is None] == [None]
    assert secrets.scan(docs([])).count() == 0
