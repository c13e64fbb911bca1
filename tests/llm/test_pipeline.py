import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_near import least_of_linked
from test_quality import measures
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from groundset.llm import bpe, secrets

SF_DIR = "/root/testdata/sf0.001"


def _template_lines(rows):
    hosts, lines = defaultdict(set), defaultdict(set)
    for r in rows:
        hosts[r.source].add(r.text)
        for x in r.text.split("\n"):
            if tidy := _tidy(x):
                lines[r.source, tidy].add(r.text)
    return {k for k, v in lines.items() if len(v) >= 20 and len(v) > 0.1 * len(hosts[k[0]])}


def _tidy(line):
    return re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line).lower().strip(" ")


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    templates, kept = _template_lines(docs), {}
    for r in docs:
        words, _, _, _, repeated = measures(r.text)
        lines = r.text.split("\n")
        gone = [x for x in lines if (r.source, _tidy(x)) in templates]
        if words >= 50 and 2 * repeated <= words and sum(len(x.split()) for x in gone) <= 0.5 * words:
            kept[r.doc_id] = "\n".join(x for x in lines if x not in gone)
    largest = {t: max(k for k in kept if kept[k] == t) for t in kept.values()}
    kept = {k: t for t, k in largest.items()}
    groups = least_of_linked([*kept.items()])
    kept = {k: re.sub(r'(?i)(token = ")[0-9a-f]{40}', rf"\1{secrets.REDACTED}", t) for k, t in kept.items() if groups[k] == k}
    library, want = Tokenizer.from_file(bpe.default_path()), {}
    for k, t in kept.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 4096):
            want[k, at // 4096] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, docs, name, stage):
    text = " ".join(f"w{k}" for k in range(80))
    odd = docs([(1, text), (1, text), (None, text + " x"), (3, None), (4, ""), (5, "word " * 50_000)])
    odd = odd.selectExpr("*", "1 as _row", "2 as kept", "3 as start", "4 as _text", "5 as fingerprint")
    for df in (odd, odd.limit(0)):
        out = stage(spark, df, SF_DIR)
        if name != "best_fit_packing":
            assert out.columns == df.columns
            rows = out.collect()
            clean = [r for r in rows if (r.text or "").startswith("w0 ")]
            assert bool(clean) == (df is odd)


def test_every_operator_is_registered():
    names = entry.queries()
    assert [n for k in range(1, 14) if len(n := [x for x in names if x.startswith(f"op{k}_")]) != 1] == []
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
