"""Multinomial naive Bayes over tokens, with the model as a long table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.functions.text import bind, tokens
from evidloom.operators.skew import hot_keys, spread_join
from evidloom.session import materialize


def train(df: DataFrame, label: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(terms, labels): (label, token, n) and (label, docs, total, prior, vocabulary). Rows without label or text are
    left out. Counts are combined before the shuffle and written to shared storage, as all else is made of them."""
    rows = df.where(F.col(label).isNotNull() & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))
    each = rows.select(F.col(label).alias("label"), F.explode(tokens(F.col(text))).alias("token"))
    terms = materialize(each.groupBy("label", "token").agg(F.count("*").alias("n")), "bayes-terms")
    docs = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("docs"))
    totals = terms.groupBy("label").agg(F.sum("n").alias("total"))
    sizes = terms.agg(F.countDistinct("token").alias("vocabulary"))
    whole = docs.agg(F.sum("docs").alias("all_docs"), F.count("*").alias("n_labels"))
    labels = docs.join(totals, "label", "left").crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(whole))  # both are one row
    prior = F.greatest(F.col("docs") / F.col("all_docs"), F.lit(1.0) / F.col("n_labels"))
    return terms, labels.select("label", "docs", F.coalesce("total", F.lit(0)).alias("total"), prior.alias("prior"), "vocabulary")


LABEL_BLOCK = 200_000  # labels that a worker holds at once, some 30 MB
MODEL_ROWS = 1_000_000  # rows of a model that is broadcast, some 40 MB; a larger one is joined with frequent tokens dealt to several tasks

Block = tuple[list[str], np.ndarray, np.ndarray]  # labels, log priors, log denominators


def _blocks(labels: DataFrame, size: int) -> Iterator[Block]:
    """The labels in order, a block at a time."""
    names, priors, denominators = [], [], []
    for r in labels.select("label", "prior", "total", "vocabulary").orderBy("label").toLocalIterator():
        names.append(r["label"])
        priors.append(math.log(r["prior"]))
        denominators.append(math.log(r["total"] + r["vocabulary"]) if r["total"] + r["vocabulary"] else 0.0)
        if len(names) == size:
            yield names, np.array(priors), np.array(denominators)
            names, priors, denominators = [], [], []
    if names:
        yield names, np.array(priors), np.array(denominators)


def _score(rows: DataFrame, key: str, block: Block, schema: str) -> DataFrame:
    """(key, label, best, mass) of each row (key, length, gains) over one block of labels: the likeliest label, its score,
    and the sum of exp(score - best); a text without tokens has the first label, score 0 and mass -1."""
    names, priors, denominators = block
    place = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for length, gains in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = priors - length * denominators
                for g in gains or ():
                    if (i := place.get(g["label"])) is not None:
                        s[i] += g["g"]
                s = np.round(s, 9)
                best = int(np.argmax(s)) if length else 0
                out[0].append(names[best]), out[1].append(float(s[best]) if length else 0.0), out[2].append(float(np.exp(s - s[best]).sum()) if length else -1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.string()), *(pa.array(x, pa.float64()) for x in out[1:])], names=[key, "label", "best", "mass"])

    return rows.mapInArrow(run, schema)


def predict(df: DataFrame, key: str, text: str, terms: DataFrame, labels: DataFrame, label_block: int = LABEL_BLOCK, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(key, label, confidence): the likeliest label with Laplace smoothing; ties go to the smaller label, and a text
    without tokens gets the smallest label with confidence 0. Keys must be unique. Without labels, the label is null.

    The log score is the label's base score, as if no token had been seen in training, plus a correction for each token
    that was. Tokens meet the model in one join; a document's corrections come together in one row, and the labels pass
    by in blocks of a bounded size, however many there are. terms and labels: as train() has them.
    """
    model = terms.select("label", "token", F.log(F.col("n") + F.lit(1.0)).alias("g"))
    split = bind(df.select(key, text), "_tokens", tokens(F.col(text))).select(key, "_tokens")
    each = split.select(key, F.explode("_tokens").alias("token"))
    if model.count() <= model_rows:
        met = each.join(F.broadcast(model), "token")
    else:
        counted = materialize(each.groupBy(key, "token").agg(F.count("*").alias("m")), "bayes-tokens")
        met = spread_join(counted, model, ["token"], [key], hot_keys(counted, ["token"])).withColumn("g", F.col("m") * F.col("g"))
    gathered = met.groupBy(key, "label").agg(F.sum("g").alias("g")).groupBy(key).agg(F.collect_list(F.struct("label", "g")).alias("gains"))
    rows = split.select(key, F.size("_tokens").alias("length")).join(gathered, key, "left")
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, label string, best double, mass double"
    blocks = _blocks(labels, label_block)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return df.select(key, F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("confidence"))
    if second is None:
        got = _score(rows, key, first, schema)
    else:
        rows = materialize(rows, "bayes-rows")
        every = reduce(DataFrame.unionByName, (_score(rows, key, b, schema) for b in chain((first, second), blocks)))
        top = every.groupBy(key).agg(F.min_by(F.struct("label", "best"), F.struct((-F.col("best")).alias("minus"), "label")).alias("_t"), F.collect_list(F.struct("best", "mass")).alias("_m"))
        mass = F.aggregate("_m", F.lit(0.0), lambda acc, x: acc + x["mass"] * F.exp(x["best"] - F.col("_t.best")))
        got = top.select(key, "_t.label", mass.alias("mass"))
    return got.select(key, "label", F.when(F.col("mass") < 0, F.lit(0.0)).otherwise(F.round(F.lit(1.0) / F.col("mass"), 4)).alias("confidence"))
