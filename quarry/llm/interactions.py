"""How five filters act in every order, without filtering more than once.

What a filter removes when others have been applied depends on the set of these,
not on their order.  So each document contributes to the 80 edges (applied subset,
next filter) of the subset lattice, and an order of the filters is a path of five
edges.  The set of filters that a text fails says all of its contributions;
documents are therefore counted by that set (and part and labels) where they lie,
the counts are spread over the edges, and the summed edges are joined to the 600
steps of the 120 orders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LAST_ID, slices, text_buffer

FILTERS = "ABCDE"
#: Fewest words (A), distinct words a hundred (B), capitals a hundred (C), signs (D).
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 100, 80, 10, b"#$%&*|"
REPEATED = 1 << FILTERS.index("E")
#: Bytes of a text looked at in one go.
PIECE = 1 << 20
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_LATER = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\v\f\r"


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces that end between words (a longer word stays whole)."""
    at = 0
    while len(raw) - at > PIECE:
        to = max(raw.rfind(b, at, at + PIECE) for b in (_SPACES[i : i + 1] for i in range(len(_SPACES))))
        if to <= at:
            ends = [e for e in (raw.find(_SPACES[i : i + 1], at + PIECE) for i in range(len(_SPACES))) if e >= 0]
            to = min(ends, default=len(raw))
        yield raw[at:to]
        at = to
    yield raw[at:]


def failures(raw: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails, as bits."""
    n_words = capitals = points = signs = 0
    known: set[bytes] = set()
    for piece in _pieces(raw):
        words = piece.split()
        n_words += len(words)
        known.update(words)
        capitals += len(piece) - len(piece.translate(None, _CAPITALS))
        signs += len(piece) - len(piece.translate(None, SIGNS))
        points += len(piece.translate(None, _LATER))
    fails = (n_words < MIN_WORDS, 100 * len(known) < MIN_DISTINCT * n_words, 100 * capitals > MAX_CAPITALS * points, signs > 0)
    return sum(f << i for i, f in enumerate(fails))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 8 * PIECE):
            raw, off = text_buffer(batch.column("text"))
            raw, at = raw.tobytes(), off.tolist()
            texts = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
            digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            fails = pa.array(np.array([failures(t) for t in texts], np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), digest, fails], names=["doc_id", "part", "digest", "fails"])


def judged(docs: DataFrame) -> DataFrame:
    """Of each document its part, a SHA-256 of its text and the filters A to D that it fails."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(_judge, "doc_id long, part string, digest binary, fails int")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """With ``good`` and ``toxic``, false where there is no label.  Rows without
    an id match none and are dealt out by their text."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
        .where("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
        .withColumn("deal", F.lit(0))
    )
    rows = rows.withColumn("deal", F.when(F.col("doc_id").isNull(), F.hash("digest", F.rand(0))).otherwise(0))
    return rows.join(known, ["doc_id", "deal"], "left").fillna(False, ["good", "toxic"])


_CLASS = ["part", "good", "toxic", "fails"]


def classes(rows: DataFrame) -> DataFrame:
    """How many documents of each part and label fail which set of filters.

    A text's copies fail E but for those of its smallest id.  Counts by text, id
    and class (where the labels' join has put the rows) make counts by text and
    class; these are a few rows a text, however many copies it has, of which a
    window takes the smallest id.
    """
    by_id = rows.groupBy("digest", "doc_id", "deal", *_CLASS).agg(F.count("*").alias("n"))
    by_id = by_id.withColumn("id", F.coalesce("doc_id", F.lit(LAST_ID)))
    by_class = by_id.groupBy("digest", *_CLASS).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    met = by_class.withColumn("smallest", F.min("least.id").over(Window.partitionBy("digest")))
    # Rows without an id are several counts, and first only where no copy has one.
    first = F.when(F.col("smallest") == LAST_ID, F.col("n")).when(F.col("least.id") == F.col("smallest"), F.col("least.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("fails"), first.alias("n")), F.struct((F.col("fails") + REPEATED).alias("fails"), (F.col("n") - first).alias("n"))))
    each = met.select("part", "good", "toxic", split.alias("c")).select("part", "good", "toxic", "c.fails", "c.n").where("n > 0")
    return each.groupBy(*_CLASS).agg(F.sum("n").alias("n"))


def _edges() -> Column:
    """The 80 edges: the filters applied, the next one and the orders through it."""
    k = len(FILTERS)
    found = []
    for applied in range(1 << k):
        before = applied.bit_count()
        for i in range(k):
            if not applied >> i & 1:
                orders = factorial(before) * factorial(k - 1 - before)
                found.append(F.struct(F.lit(applied).alias("applied"), F.lit(1 << i).alias("next"), F.lit(orders).alias("orders")))
    return F.array(*found)


def edge_counts(counted: DataFrame) -> DataFrame:
    """Sums over documents for each part and edge."""
    e = counted.select("*", F.explode(_edges()).alias("edge")).select(*counted.columns, "edge.*")
    fails = F.col("fails")
    before, own = fails.bitwiseAND(F.col("applied")) != 0, fails.bitwiseAND(F.col("next")) != 0
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("long")
    return e.groupBy("part", "applied", "next", "orders").agg(
        total(~before & ~own).alias("kept"),
        total(~before & own).alias("removed"),
        total(before & own).alias("redundant"),
        total(fails == F.col("next")).alias("unique_fails"),
        total(~before & own & F.col("good")).alias("good_lost"),
        total(~before & own & F.col("toxic")).alias("toxic_lost"),
    )


def steps(spark: SparkSession) -> DataFrame:
    """The 600 steps of the 120 orders, each with its edge."""
    rows = []
    for order in permutations(FILTERS):
        applied = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append(("".join(order), step, applied, bit))
            applied |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (language), order and step, with the counts of ``edge_counts`` and ``shapley``.

    A null text is empty and fails A alone (and E, where another empty text has
    a smaller id); a null language and an empty one are one part.  Rows without
    an id are the last of their text and have no label; rows that repeat an id
    and its text count each, and none of them fails E if the id is the smallest.
    Of an id labelled twice the label 1 counts; null labels are none.  Texts are
    read whole, long ones in pieces; other columns fall away; an empty table
    gives no rows.
    """
    edges = edge_counts(classes(labelled(judged(docs), labels)))
    shapley = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "next"))
    edges = edges.withColumn("shapley", shapley)
    paths = edges.join(F.broadcast(steps(docs.sparkSession)), ["applied", "next"])
    return paths.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
