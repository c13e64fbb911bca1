"""Secret scan: candidates by shape, a random forest over their form and surroundings against false findings."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.llm.tables import carried, restored, written

#: Bounds of the model, not of the scan: labelled findings it learns from, and words of its dictionary.
TRAIN_ROWS, DICTIONARY_WORDS = 20_000, 20_000
TREES, DEPTH, SEED, THRESHOLD = 40, 8, 11, 0.5
REDACTED = "[secret]"

#: Names that a secret is assigned to.
NAMES = (
    "token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "access_key", "private_key", "auth",
    "credential",
)
_RUN = re.compile(r"[A-Za-z0-9+/=_\-.~]{12,}")
_SET = re.compile(r"[:=]")
_VALUE = re.compile(r"[\"']?\s{0,4}[:=]{1,2}\s{0,4}[\"']?([^\s\"']{6,})")
_WORD = re.compile(r"[^\W\d_]+")
_NAMED = re.compile(r"([A-Za-z_]+)[\"']?\s{0,4}[:=]{1,2}\s{0,4}[\"']?$")
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_CLASS = {c: i + 1 for i, c in enumerate(_ALPHABET)}
_SYMBOLS = len(_ALPHABET) + 1
_CODES = np.zeros(256, np.int64)
_CODES[[ord(c) for c in _ALPHABET]] = range(1, _SYMBOLS)
FEATURES = (
    "length", "digits", "upper", "lower", "other", "distinct", "entropy", "hex", "class_changes", "transitions",
    "dictionary", "slashes", "dots", "after_path", "scheme_near", "at_near", "named", "assigned", "quoted",
    "left_known", "right_known", "left_1", "left_2", "left_3", "left_4", "right_1", "right_2",
)


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts over all documents: kind 'w' (lower-case words) and 'p' (pairs of neighbouring symbols).

    Each batch is counted before it is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter[str] = Counter()
            pairs = np.zeros(_SYMBOLS * _SYMBOLS, np.int64)
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(w for w in _WORD.findall(text.lower()) if 3 <= len(w) <= 16)
                    code = _CODES[np.frombuffer(text.encode(), np.uint8)]
                    pairs += np.bincount(code[:-1] * _SYMBOLS + code[1:], minlength=len(pairs))
            at = np.flatnonzero(pairs)
            keys = [*words.keys(), *map(str, at.tolist())]
            kinds = ["w"] * len(words) + ["p"] * len(at)
            counts = [*words.values(), *pairs[at].tolist()]
            yield pa.RecordBatch.from_pydict(
                {"kind": pa.array(kinds, pa.string()), "key": pa.array(keys, pa.string()), "n": pa.array(counts, pa.int64())}
            )

    rows = docs.select(text_col).mapInArrow(run, "kind string, key string, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Surroundings:
    """The corpus's symbol transitions and most frequent words; of bounded size, sent to the workers."""

    def __init__(self, counts: DataFrame, words: int = DICTIONARY_WORDS):
        table = written(counts, "counts")
        told = table.where("kind = 'w'").withColumn("_log", F.floor(F.log2("n")))
        # Counts by power of two (64 rows at most) tell which words can be among the most frequent, so that only
        # those are sorted and sent.
        least, found = 0, 0
        for r in sorted(told.groupBy("_log").count().collect(), key=lambda r: -r["_log"]):
            least, found = r["_log"], found + r["count"]
            if found >= words:
                break
        top = told.where(F.col("_log") >= least).orderBy(F.desc("n"), "key").limit(words).collect()
        pairs = np.ones((_SYMBOLS, _SYMBOLS))
        for r in table.where("kind = 'p'").collect():  # at most _SYMBOLS squared
            pairs[int(r.key) // _SYMBOLS, int(r.key) % _SYMBOLS] += r.n
        self.log_next = np.log(pairs / pairs.sum(axis=1, keepdims=True))
        self.words = {r.key for r in top}

    def covered(self, text: str) -> float:
        """Share of the letters that dictionary words of three letters or more cover, longest first."""
        got, letters = 0, 0
        for run in _WORD.findall(text.lower()):
            letters += len(run)
            i = 0
            while i < len(run):
                n = next((k for k in range(min(16, len(run) - i), 2, -1) if run[i : i + k] in self.words), 0)
                got += n
                i += n or 1
        return got / letters if letters else 0.0


def candidates_in(text: str) -> list[tuple[int, int]]:
    """Spans that may be secrets: long runs with a digit, and what is assigned to a secret's name."""
    found: dict[int, int] = {}
    for m in _RUN.finditer(text):
        run = m[0]
        if not run.isalpha() and any(map(str.isdigit, run)):
            start, end = m.start() + len(run) - len(run.lstrip("=./-")), m.start() + len(run.rstrip("./-"))
            if end - start >= 12:
                found[start] = end
    for m in _SET.finditer(text):
        name = text[max(0, m.start() - 24) : m.start()].lower().rstrip(" \t\"'")
        if name.endswith(NAMES):
            v = _VALUE.match(text, m.start())
            if v:
                found[v.start(1)] = max(found.get(v.start(1), 0), v.end(1))
    spans, last = [], -1
    for start, end in sorted(found.items()):
        if start >= last:
            spans.append((start, end))
            last = end
    return spans


def features_of(text: str, start: int, end: int, near: Surroundings) -> list[float]:
    own = text[start:end]
    n = len(own)
    counts = Counter(own)
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in own]
    share = [kinds.count(k) / n for k in range(4)]
    code = [_CLASS.get(c, 0) for c in own]
    steps = near.log_next[code[:-1], code[1:]]
    before, after = text[max(0, start - 80) : start], text[end : end + 40]
    left, right = _WORD.findall(before.lower())[-3:], _WORD.findall(after.lower())[:2]
    named = _NAMED.search(before)
    bucket = lambda words, k: float(any(sum(map(ord, w)) % k[0] == k[1] for w in words))
    return [
        float(n), *share, len(counts) / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        float(all(c in "0123456789abcdefABCDEF" for c in own)),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,  # noqa: B905
        float(steps.mean()) if n > 1 else 0.0,
        near.covered(own),
        own.count("/") / n, own.count(".") / n,
        float(before[-1:] in ("/", "\\")), float("://" in before[-40:]), float("@" in before[-24:] + own + after[:24]),
        float(bool(named) and named[1].lower().endswith(NAMES)), float(bool(named)),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(sum(w in near.words for w in left)), float(sum(w in near.words for w in right)),
        *(bucket(left, (4, k)) for k in range(4)), *(bucket(right, (2, k)) for k in range(2)),
    ]


def label_of(text: str, start: int, end: int) -> int | None:
    """A label where the finding itself tells: 1 secret, 0 not, None undecided (left to the forest).

    Secrets: a mixed value in quotes, assigned to a secret's name. Not: numbers, addresses, dates, versions,
    pieces of paths and links, values with a placeholder's few symbols.
    """
    own, before = text[start:end], text[max(0, start - 80) : start]
    named = _NAMED.search(before)
    if re.fullmatch(r"[\d.\-+=/_~]+", own) or len(set(own)) <= 4:
        return 0
    if "@" in before[-1:] + text[end : end + 1] + own or before[-1:] in ("/", "\\") or "://" in before[-60:]:
        return 0
    if named and named[1].lower().endswith(NAMES) and len(own) >= 20 and before[-1:] in ("'", '"'):
        return 1
    if not named and len(own) < 20:
        return 0
    return None


def find_candidates(
    docs: DataFrame, near: Surroundings, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every candidate of every whole text: the id, _text (hash), start, end, value, features, label."""
    shared = docs.sparkSession.sparkContext.broadcast(near)
    fields = [
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("_text", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.IntegerType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            of, rows = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for start, end in candidates_in(text) if text else ():
                    of.append(k)
                    rows.append(
                        (start, end, text[start:end], features_of(text, start, end, known), label_of(text, start, end))
                    )
            starts, ends, values, features, labels = zip(*rows, strict=True) if rows else ([],) * 5
            at = pa.array(of, pa.int64())
            arrays = [
                batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()),
                pa.array(ends, pa.int32()), pa.array(values, pa.string()),
                pa.array(features, pa.list_(pa.float64())), pa.array(labels, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(id_col, F.xxhash64(own).alias("_text"), own.alias("_own"))
    return written(rows.mapInArrow(run, T.StructType(fields)), "candidates")


def train(findings: DataFrame, rows: int = TRAIN_ROWS) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (features, label 0 or 1), or None where one label is missing.

    Equal values count once. At most `rows` of each label are used, those of the least hash.
    """
    place = F.pmod(F.xxhash64("value"), F.lit(1 << 40))
    known = findings.where("label is not null").dropDuplicates(["value", "label"]).withColumn("_place", place)
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    # Hashes are even, so a tenth more than the share wanted holds enough; only those rows are sorted.
    parts = [
        known.where((F.col("label") == k) & (F.col("_place") < (1 << 40) * min(1.0, 1.1 * rows / n)))
        .orderBy("_place", "value")
        .limit(rows)
        for k, n in sorted(counts.items())
    ]
    if not parts:
        return None
    sample = written(reduce(DataFrame.union, parts).select("features", "label"), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    data = sample.coalesce(1).select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("y"))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2
    )
    return forest.fit(data)


def judge(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Adds score (probability of a secret) and is_secret; without a model the label decides, else both null."""
    if model is None:
        score = F.col("label").cast("double")
        return found.withColumn("score", score).withColumn("is_secret", score >= THRESHOLD)
    scored = model.transform(found.withColumn("x", array_to_vector("features")))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.withColumn("score", score).select(*found.columns, "score").withColumn("is_secret", F.col("score") >= THRESHOLD)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings in all whole texts: the id, _text, start, end, value, label, score, is_secret.

    Statistics cover all documents; only the forest's labelled sample is bounded. Null and empty texts have
    no findings; repeated rows give theirs each; a table without labelled findings gives null scores there.
    """
    near = Surroundings(corpus_counts(docs, text_col))
    found = find_candidates(docs, near, id_col, text_col)
    return judge(found, train(found)).drop("features")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every secret found replaced by REDACTED; all rows stay, other columns as they were."""
    spans = (
        scan(docs, id_col, text_col)
        .where("is_secret")
        .groupBy(F.col(id_col).alias("_s_id"), F.col("_text").alias("_s_text"))
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    )
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col("_s_id")) & (own == F.col("_s_text"))
    text = F.col(text_col)
    cut = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.concat(a.out, F.substring(text, a["at"] + 1, s.start - a["at"]), F.lit(REDACTED)).alias("out"),
            s.end.alias("at"),
        ),
        lambda a: F.concat(a.out, F.substring(text, a["at"] + 1, F.length(text))),
    )
    joined = carried(docs, id_col, text_col).join(spans, same, "left")
    redacted = joined.withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(cut))
    return restored(redacted, docs, id_col, text_col)
