"""Quality classifier and language identification with supervised subword embeddings (see subword)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.llm import subword
from kindred.llm.common import durable

#: Labelled texts that a model is fitted on, of one class and in all: the first of each class in a fixed hash order.
TRAIN_PER_CLASS, TRAIN_TEXTS = 2000, 8000
#: Features (distinct buckets, 8 bytes each) of all training texts together that the driver holds at most: 64 MB.
TRAIN_FEATURES = 8_000_000
#: Labels that a model can have.
CLASSES = 1000
#: Every so many of them are held back to calibrate probabilities and the rejection cutoff.
HOLD_BACK = 5
QUALITY_GRAMS, LANGUAGE_GRAMS = (3, 4), (2, 3, 4)
#: An accepted language prediction is right at least this often on the held-back texts.
PRECISION = 0.99


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def sample(rows: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """The first per_class rows of each label of rows(doc_id, label), fewer if all labels together would have more
    than TRAIN_TEXTS, in a fixed hash order of doc_id, as a table in the shared folder. A row that is repeated counts
    once, so it has at most max(TRAIN_TEXTS, CLASSES) rows, each another id and label, and is small enough to broadcast.

    Rows whose hash is beyond twice the expected place of the last one taken are left out before ranking, so a
    frequent label doesn't meet in one task."""
    rows = rows.select("doc_id", "label").distinct()
    counts = rows.groupBy("label").count().limit(CLASSES + 1).collect()
    if len(counts) > CLASSES:
        raise ValueError(f"more than {CLASSES} labels")
    per_class = max(1, min(per_class, TRAIN_TEXTS // max(1, len(counts))))
    share = [F.lit(x) for r in counts for x in (r["label"], 2.0 * per_class / r["count"])] or [F.lit(0), F.lit(0.0)]
    place = F.xxhash64("doc_id", F.lit("sample"))
    near = rows.where(place / 2.0**64 + 0.5 <= F.create_map(*share)[F.col("label")])
    order = W.partitionBy("label").orderBy(place, "doc_id")
    return durable(near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class).drop("_n"), "sample")


def fit(texts: DataFrame, grams: tuple[int, ...], fold: bool, most: int | None = None) -> tuple[subword.Model, list, list]:
    """(model, held-back bags, held-back labels) from texts(doc_id, label, text) of a bounded sample of ids and labels.

    An id that stands there several times with a label gives one of its texts, the first by hash. Bags are made on the executors from whole texts, at most 2 ** BITS buckets each. Only as many as have `most`
    (TRAIN_FEATURES) buckets in all come to the driver: of each label the first in the sample's order, one at least."""
    one = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = one.select(F.struct("doc_id", "label").alias("label"), "text")
    kind = rows.schema["label"].dataType.simpleString()
    bags = rows.mapInArrow(lambda b: subword.bags_of(b, grams, fold), f"label {kind}, found array<int>, share array<float>")
    bags = durable(bags.select("label.doc_id", "label.label", "found", "share"), "bags")
    sizes = bags.select("doc_id", "label", F.size("found").alias("n")).collect()  # a row for each of the sample
    key = lambda r: (crc32(str(r["doc_id"]).encode()), str(r["doc_id"]), str(r["label"]))
    room = dict.fromkeys({r["label"] for r in sizes}, (most or TRAIN_FEATURES) // max(1, len({r["label"] for r in sizes})))
    full, taken = dict(room), set()
    for r in sorted(sizes, key=key):
        if r["n"] <= room[r["label"]] or room[r["label"]] == full[r["label"]]:
            room[r["label"]] -= r["n"]
            taken.add((r["doc_id"], r["label"]))
        else:
            room[r["label"]] = -1  # the order ends here, whatever the sizes of the rest
    if len(taken) < len({(r["doc_id"], r["label"]) for r in sizes}):
        chosen = bags.sparkSession.createDataFrame(list(taken), bags.select("doc_id", "label").schema)
        bags = bags.join(F.broadcast(chosen), ["doc_id", "label"])
    table = bags.select("doc_id", "label", "found", "share").toArrow()
    ids = table.select(["doc_id", "label"]).to_pylist()
    found = [(np.asarray(f.values), np.asarray(s.values)) for f, s in zip(table["found"], table["share"], strict=True)]
    order = sorted(range(len(ids)), key=lambda i: (*key(ids[i]), found[i][0].tobytes()))
    held = [i for k, i in enumerate(order) if k % HOLD_BACK == HOLD_BACK - 1]
    used = [i for k, i in enumerate(order) if k % HOLD_BACK != HOLD_BACK - 1]
    model = subword.train([found[i] for i in used], [ids[i]["label"] for i in used], grams)
    model.seen = Counter(ids[i]["label"] for i in used)
    held_bags, held_labels = [found[i] for i in held], [ids[i]["label"] for i in held]
    return (subword.calibrate(model, held_bags, held_labels) if model.classes else model), held_bags, held_labels


def quality_scores(docs: DataFrame, labels: DataFrame, share_good: float | None = None, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    Trained on labels(doc_id, quality) of documents whose crc32 remainder by 4 isn't 2; documents labelled both
    ways, null labels and null ids train nothing. The sample has other shares of the classes, so the logit is moved by the
    classes' true odds among usable labels. Null and empty texts have the features of an empty text. Without
    labels of both classes every score is the share of good labels, 0.5 if there are none. Texts of any length are
    scored whole; repeated rows stay repeated, an empty table gives no rows, and other columns are left out, whatever
    their names.
    """
    usable = labels.where((F.col("quality").isin(0, 1)) & (remainder(F.col("doc_id"), 4) != 2))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most").drop("most")
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    good = counts.get(1, 0)
    prior = good / sum(counts.values()) if counts else 0.5
    if len(counts) == 2:
        chosen = sample(usable, per_class)
        texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
        model, _, _ = fit(texts, QUALITY_GRAMS, fold=False)
        shift = np.log(prior / (1 - prior)) - np.log(max(model.seen.get(1, 0), 1) / max(model.seen.get(0, 0), 1))
    else:
        model, shift = None, 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None or len(model.classes) < 2:
                score = np.full(b.num_rows, prior)
            else:
                z = model.logits(subword.text_bytes(b.column(1), fold=False))
                score = 1 / (1 + np.exp(np.clip(-(model.scale * (z[:, 1] - z[:, 0]) + shift), -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def rejection_cutoff(model: subword.Model, bags: list, labels: list, precision: float = PRECISION) -> float:
    """Least score from which on the held-back predictions are right with the given precision; 1 if none is."""
    if not bags:
        return 1.0
    z = np.array([[float(share @ t[found]) for t in model.table] for found, share in bags]) + model.bias
    p = model.probabilities(z)
    right = np.array([model.classes[k] == x for k, x in zip(p.argmax(axis=1), labels, strict=True)])
    score = p.max(axis=1)
    by = np.argsort(-score)
    sure = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= precision
    return float(score[by][np.flatnonzero(sure)[-1]]) if sure.any() else 1.0


def languages(docs: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row of docs(doc_id, text, lang).

    Trained on text and lang of documents with a lang whose crc32 remainder by 5 isn't 0 (null ids train nothing).
    lang_pred is `und` with score 0 where text is null or has no letter; accepted is false there and where the
    score is below the calibrated cutoff. Without training rows everything is `und`. Texts of any length are read
    whole; repeated rows stay repeated, an empty table gives no rows, and other columns are left out, whatever their
    names. More than CLASSES languages are a ValueError: their counts and models would not be bounded.
    """
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    usable = docs.where(F.col("lang").isNotNull() & letter & (remainder(F.col("doc_id"), 5) != 0))
    chosen = sample(usable.select("doc_id", F.col("lang").alias("label")), per_class)
    texts = docs.select("doc_id", "text", F.col("lang").alias("_lang")).join(F.broadcast(chosen), "doc_id").where("_lang = label")
    model, held_bags, held_labels = fit(texts.select("doc_id", "label", "text"), LANGUAGE_GRAMS, fold=True)
    cutoff = rejection_cutoff(model, held_bags, held_labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.classes, "und"], dtype=object)
        for b in batches:
            known = np.asarray(b.column(2)).astype(bool) & bool(model.classes)
            best, score = np.full(b.num_rows, len(model.classes)), np.zeros(b.num_rows)
            if known.any():
                p = model.probabilities(model.logits(subword.text_bytes(b.column(1).filter(pa.array(known)), fold=True)))
                best[known], score[known] = p.argmax(axis=1), p.max(axis=1)
            columns = [b.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(known & (score >= cutoff))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text", letter.alias("letter")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
