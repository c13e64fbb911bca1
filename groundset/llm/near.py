"""Near copies: fingerprints linked around the pigeonring name groups, the exact Jaccard of word shingles decides them.

Fingerprints alone lose copies with more than a few edits, so bands name the other texts that could have one, and prefixes their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundset.llm.components import components
from groundset.llm.simhash import first_of_each, near_duplicates, shingle_hashes
from groundset.llm.tables import written

#: Words of a shingle, seed of its hash, and least Jaccard that links two texts, in percent.
SHINGLE, SEED, LEAST = 5, 42, 80
#: Least hashes per band, and bands: texts of Jaccard 0.8 meet with 1 - (1 - 0.8 ** ROWS) ** BANDS = 99.96 %.
ROWS, BANDS = 5, 20
#: Bytes of text numbers up to which they are sent to every executor.
SENT_BYTES = 8_000_000
_FACTORS = np.random.default_rng(8).integers(0, 2**63, ROWS * BANDS + 2, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; texts without words share one."""
    parts = list(shingle_hashes(text, SHINGLE, SEED))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)


def band_keys(own: np.ndarray) -> list[int]:
    """A key per band from the least hashes of a text's shingles."""
    mixed = own ^ (own >> np.uint64(29))
    least = np.array([(mixed * f).min() for f in _FACTORS[: ROWS * BANDS]], np.uint64)
    keys = np.zeros(BANDS, np.uint64)
    for row in range(ROWS):
        keys = (keys ^ (keys >> np.uint64(31))) * _FACTORS[-2] + least[row::ROWS]
    keys = (keys ^ (keys >> np.uint64(31))) * _FACTORS[-1] + np.arange(BANDS, dtype=np.uint64)
    return keys.view(np.int64).tolist()


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, _text (hash of the text) and _keys; written. One pass without a shuffle."""
    fields = [
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("_text", T.LongType()),
        T.StructField("_keys", T.ArrayType(T.LongType())),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([band_keys(shingles_of(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys], names=[f.name for f in fields])

    rows = docs.select(id_col, F.xxhash64(_text(text_col)).alias("_text"), _text(text_col).alias("_own"))
    return written(rows.mapInArrow(run, T.StructType(fields)), "signatures")


def shingle_sets(docs: DataFrame, nodes: DataFrame, text_col: str = "text") -> DataFrame:
    """Per distinct text among `nodes` (_node): _node, _n and _set (its distinct shingle hashes); written.

    Few nodes are sent to the texts; beyond SENT_BYTES both sides are dealt by the node.
    """
    schema = "_node long, _n long, _set array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(t).view(np.int64) for t in batch.column(1).to_pylist()]
            n = pa.array([len(s) for s in sets], pa.int64())
            lists = pa.array(sets, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, lists], names=["_node", "_n", "_set"])

    wanted = F.broadcast(nodes) if nodes.count() * 8 <= SENT_BYTES else nodes
    texts = docs.select(F.xxhash64(_text(text_col)).alias("_node"), _text(text_col).alias("_own"))
    found = texts.join(wanted, "_node", "left_semi").mapInArrow(run, schema)
    return written(found.dropDuplicates(["_node"]), "shingle_sets")


def _needed(n: Column) -> Column:
    """Common shingles that a set of `n` needs with any set at all: at least LEAST % of its own."""
    return F.ceil(n * LEAST / F.lit(100))


def _reaches(a: str, b: str) -> Column:
    """Whether two sets whose first common shingle stands at `_at` can still reach LEAST."""
    small, large = (f(F.col(f"{a}._n"), F.col(f"{b}._n")) for f in (F.least, F.greatest))
    left = F.least(F.col(f"{a}._n") - F.col(f"{a}._at"), F.col(f"{b}._n") - F.col(f"{b}._at"))
    # Jaccard >= t is the same as common >= t / (1 + t) * (sum of the sizes).
    return (small * 100 >= large * LEAST) & (left * (100 + LEAST) >= (small + large) * LEAST)


def prefixes(sets: DataFrame) -> DataFrame:
    """Per text and shingle of its prefix: _node, _n, _rare (shingles no other text has), _key, _at, _files; written.

    Shingles are ordered by the number of texts that hold them, rarest first. Two sets of LEAST or more share one
    among the first n - needed + 1 of each; the one with fewer shingles even among its first n / 9 + 1
    (`_files`: 2 LEAST / (100 + LEAST) of its shingles must be common to a set no smaller). A text whose own
    shingles fill that prefix meets no text, however many are like it.
    """
    held = sets.select("_node", "_n", F.explode("_set").alias("_key"))
    often = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_held")).where("_held > 1")
    ranked = held.join(often, "_key").groupBy("_node", "_n").agg(
        F.array_sort(F.collect_list(F.struct("_held", "_key"))).alias("_order")
    )
    rare = F.col("_n") - F.size("_order")
    reach = F.col("_n") - _needed(F.col("_n")) + 1
    files = F.col("_n") - F.ceil(F.col("_n") * (2 * LEAST) / F.lit(100 + LEAST)) + 1
    cut = ranked.withColumn("_rare", rare).withColumn("_reach", reach).withColumn("_filed", files).where("_rare < _reach")
    placed = cut.select(
        "_node", "_n", "_rare", "_filed", F.posexplode(F.slice("_order", F.lit(1), (F.col("_reach") - rare).cast("int"))).alias("_i", "_o")
    )
    return written(
        placed.select(
            "_node", "_n", "_rare", F.col("_o._key").alias("_key"), (F.col("_rare") + F.col("_i")).alias("_at"),
            (F.col("_rare") + F.col("_i") < F.col("_filed")).alias("_files"),
        ),
        "prefixes",
    )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (u, v) whose shingle sets have Jaccard LEAST or more; written."""
    one = sets.select(F.col("_node").alias("u"), F.col("_set").alias("_mine"))
    other = sets.select(F.col("_node").alias("v"), F.col("_set").alias("_theirs"))
    common = F.size(F.array_intersect("_mine", "_theirs"))
    enough = common * (100 + LEAST) >= (F.size("_mine") + F.size("_theirs")) * LEAST
    return written(pairs.join(one, "u").join(other, "v").where(enough).select("u", "v"), "verified")


def ringed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (u, v) of a text and the leader of its component of fingerprints (`simhash.near_duplicates`); written.

    The leader is the least text hash, so a component costs a pair a text however many links it has.
    """
    held = near_duplicates(docs, id_col, text_col).select("_text", "_group").distinct()
    heads = held.groupBy("_group").agg(F.min("_text").alias("v"), F.max("_text").alias("_last")).where("v <> _last")
    pairs = held.join(heads, "_group").where("_text <> v")
    return written(pairs.select(F.col("_text").alias("u"), "v"), "ringed")


def links(sets: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs u, v of different sets of Jaccard LEAST or more, enough of them for the components of all.

    Pairs already `named` (u, v) are decided. Then each text of a key is compared with the key's leader, the text with the smallest share of shingles of its own:
    the one that copies with edits have in common. So a group of copies costs a pair a member. Last, texts of
    a key that are in different components still are compared, where their prefixes leave LEAST possible.
    """
    places = prefixes(sets)
    lead = F.min(F.struct((F.col("_rare") / F.col("_n")).alias("_share"), "_node", "_n", "_at")).alias("_l")
    heads = places.groupBy("_key").agg(lead, F.count(F.lit(1)).alias("_m")).where("_m > 1")
    heads = written(heads.select("_key", "_l._node", "_l._n", "_l._at"), "heads")
    a, b = places.alias("a"), heads.alias("b")
    led = a.join(b, (F.col("a._key") == F.col("b._key")) & (F.col("a._node") != F.col("b._node")) & _reaches("a", "b"))
    led = led.select(F.col("a._node").alias("u"), F.col("b._node").alias("v"))
    first = verified(written(led.unionByName(named).distinct(), "led"), sets)

    parts = components(first).withColumnRenamed("node", "_node")
    placed = places.join(parts, "_node", "left").withColumn("_part", F.coalesce("component", "_node")).drop("component")
    placed = written(placed, "placed")
    mixed = placed.groupBy("_key").agg(F.min("_part").alias("_p"), F.max("_part").alias("_q")).where("_p <> _q")
    rest = written(placed.join(mixed.select("_key"), "_key", "left_semi"), "rest")
    a, b = rest.where("_files").alias("a"), rest.alias("b")
    larger = F.struct("b._n", "b._node") > F.struct("a._n", "a._node")
    apart = (F.col("a._key") == F.col("b._key")) & (F.col("a._part") != F.col("b._part")) & larger & _reaches("a", "b")
    met = a.join(b, apart).select(F.col("a._node").alias("u"), F.col("b._node").alias("v"))
    more = written(met.distinct().join(led_pairs(first), ["u", "v"], "left_anti"), "apart")
    return first.unionByName(verified(more, sets))


def led_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs in both directions."""
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: the id, _text, _group, component_id (least id of its component).

    Equal texts are one node. Null and empty texts count as equal. Null ids count for component_id only where a
    component has no other, which then is null. Repeated rows appear each; ties don't matter, as the links of a
    component don't depend on an order. Only texts that share a band or a component of fingerprints with another one
    have their shingles moved; a very long text is one row of as many longs as it has words. An empty table gives no rows.
    """
    found = signatures(docs, id_col, text_col)
    nodes = found.groupBy(F.col("_text").alias("_node")).agg(F.min(id_col).alias("_least"), F.first("_keys").alias("_keys"))
    nodes = written(nodes, "nodes")
    banded = nodes.select("_node", F.explode("_keys").alias("_key"))
    shared = banded.groupBy("_key").agg(F.min("_node").alias("_p"), F.max("_node").alias("_q")).where("_p <> _q")
    asked = banded.join(shared.select("_key"), "_key", "left_semi").select("_node")
    named = ringed(docs, id_col, text_col)
    for end in ("u", "v"):
        asked = asked.unionByName(named.select(F.col(end).alias("_node")))
    asked = written(asked.distinct(), "asked")
    parts = components(links(shingle_sets(docs, asked, text_col), named))
    placed = nodes.join(parts, nodes["_node"] == parts["node"], "left").select(
        F.col("_node").alias("_text"), "_least", F.coalesce("component", "_node").alias("_group")
    )
    ids = placed.groupBy("_group").agg(F.min("_least").alias("component_id"))
    groups = written(placed.join(ids, "_group").select("_text", "_group", "component_id"), "groups")
    return found.select(id_col, "_text").join(groups, "_text").select(id_col, "_text", "_group", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: the one of the least id; columns as they were."""
    return first_of_each(docs, near_copies(docs, id_col, text_col), id_col, text_col)
