import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from groundset.llm import alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


def _stand_ins():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _tokens(libraries, text):
    """(ids, end offsets) of both, on the whole text; None where the bytes differ."""
    a, b = libraries
    raw, byte_of, out = (" " + text).encode(), _stand_ins(), []
    enc = a.encode(" " + text, add_special_tokens=False)
    ids_b = b.encode(text)
    spell_a = [bytes(byte_of[c] for c in t) for t in enc.tokens]
    spell_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    for ids, spell in ((enc.ids, spell_a), (ids_b, spell_b)):
        if b"".join(spell) != raw:
            return None
        out.append((ids, np.cumsum([len(s) for s in spell]).tolist()))
    return out


def _plain(libraries, rows):
    links, groups, sizes = [], [], []
    for _, text in rows:
        both = _tokens(libraries, text) if text else None
        if both is None:
            links.append([])
            groups.append("")
            sizes.append((0, 0, 0))
            continue
        (ids_a, ends_a), (ids_b, ends_b) = both
        links.append([(x, y) for x, e in zip(ids_a, ends_a) for y, f in zip(ids_b, ends_b) if e == f] if len(ids_a) < 300 else
                     [(ids_a[ends_a.index(e)], y) for y, e in zip(ids_b, ends_b) if e in set(ends_a)])
        parts, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(e) + 1, ends_b.index(e) + 1
            parts.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            i, j = k, m
        groups.append(hashlib.sha256(";".join(parts).encode()).hexdigest())
        sizes.append((len(ids_a), len(ids_b), len(parts)))
    count = Counter(x for own in links for x in own)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return sorted(
        [(r[0], *s, len(own), sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), g)
         for r, s, own, g in zip(rows, sizes, links, groups)], key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    bits = ["a", "word", "Straße", "日本語", "don't", "x=1;", "\n", " ", "  ", "\t", "<|endoftext|>", "<s>", "</s>", "<0x41>", "é",
            " ", "　", "\x1c", "\x00", "​", "🙂", "ﬁ", "é", "12345", "…", "\r\n", "\x85", " ", "the", "ing"]
    out = [(k, "".join(draw.choice(bits) + draw.choice(["", " ", " "]) for _ in range(draw.randint(1, 40)))) for k in range(250)]
    any_chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    out += [(300 + k, " ".join("".join(draw.choices(any_chars, k=5)) for _ in range(10))) for k in range(40)]
    return out + [(400, None), (401, ""), (402, " "), (403, "   "), (404, "▁"), (405, "a ▁b"), (406, "\n"), (None, "a word"), (7, "a word")]


def test_against_whole_texts(libraries, docs, rows):
    assert _tokens(libraries, "a ▁b") is None and _tokens(libraries, " x\n y  <s>") is not None
    got = sorted(map(tuple, alignment.align(docs(rows).repartition(5)).collect()), key=str)
    assert got == _plain(libraries, rows)


def test_loads_buckets_and_deals(libraries, docs, rows, monkeypatch):
    """Small buckets, several vectors a bucket, loads of a bucket each, a cache that is emptied: the same rows."""
    for name, value in (("BUCKET_PAIRS", 40), ("LOOK_UP_BYTES", 3000), ("FAN_IN", 2)):
        monkeypatch.setattr(alignment, name, value)
    got = alignment.align(docs(rows[::3]).repartition(7))
    assert got.columns == ["doc_id", *alignment.ALIGNED]
    assert sorted(map(tuple, got.collect()), key=str) == _plain(libraries, rows[::3])


def test_odd_tables(libraries, docs):
    assert alignment.align(docs([])).count() == 0
    odd = [(1, None), (2, ""), (3, "w" * 200_000), (4, "two  words " * 20_000), (None, None), (5, "a b"), (5, "a b")]
    clash = docs(odd).selectExpr("*", "1 as pair", "2 as _bucket", "3 as n_a")
    got = {r.doc_id: r for r in alignment.align(clash).collect()}
    assert got[1].groups_sha256 == got[2].groups_sha256 == "" and got[1].n_a == got[None].count_sum == 0
    assert got[5].n_links == 2 and got[5].count_sum == 4 and got[4].n_a == len(libraries[0].encode(" " + odd[3][1]).ids)


def test_perfect_hash():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(draw.integers(0, 2**40, n))
        made = alignment.PerfectHash.of(keys)
        again = alignment.PerfectHash.unpacked(made.sizes, made.packed())
        assert sorted(again.slots(keys).tolist()) == list(range(len(keys)))
        assert (again.slots(keys) == made.slots(keys)).all()
    table = alignment.Counts(1, [(0, made.sizes, made.packed(), keys[np.argsort(made.slots(keys))].astype("<i8").tobytes(), keys.astype("<i8").tobytes())],
                             np.zeros(7, np.int64), 7)
    with pytest.raises(ValueError, match="first pass"):
        table.look_up(np.array([keys.max() + 1]))
    assert len(table.look_up(keys[:0])) == 0
