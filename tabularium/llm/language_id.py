"""Language identification by segmentation-marginalised unigram models over a fixed public vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Pieces, WordMemo, bounded_sample, crc_mod, fit, load_pieces, pretokens, word_scores
from .shared import map_arrow, slices

UNDETERMINED = "und"


class LanguageModel(NamedTuple):
    """Piece probabilities and log prior of each language."""

    pieces: list[str]
    labels: list[str]
    weights: np.ndarray
    prior: np.ndarray


def train(labelled: DataFrame, vocabulary: str, per_language: int = 2_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """Fit on a bounded sample: about ``per_language`` rows of each non-null language, chosen by a hash of the id."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.filter(F.col("label").isNotNull())
    shares = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    pieces = load_pieces(vocabulary)
    labels, weights = fit(bounded_sample(rows, "label", "id", per_language), pieces)
    prior = np.log(np.array([shares[x] for x in labels], dtype=np.float64) / max(1, sum(shares.values()))) if labels else np.zeros(0)
    return LanguageModel(pieces, labels, weights, prior)


def predict(documents: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score, the posterior of the predicted language over whole texts.

    Texts that are null or hold no letter are ``und`` with score 0, as is every text if no language was learned. Ties go
    to the language that sorts first. Texts of any length are scored whole, words of any length over all their
    segmentations; an empty table gives no rows. Repeated rows get equal results; other columns stay (a column named lang_pred or
    score is replaced).
    """
    shared = documents.sparkSession.sparkContext.broadcast(tuple(model))
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    spare = "_" + max(kept, key=len, default="")
    source = documents.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias(spare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pieces, labels, weights, prior = shared.value
        finder = Pieces(pieces)
        memo = WordMemo(lambda words: word_scores(words, finder, weights))
        for batch in slices(batches):
            langs, scores = [], []
            texts = [t if t and any(map(str.isalpha, t)) else "" for t in batch.column(len(kept)).to_pylist()]
            for rows in memo.lookup(map(pretokens, texts)):
                if not len(rows) or not labels:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = prior + memo.table[rows].sum(axis=0)
                best = int(total.argmax())
                langs.append(labels[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield {c: batch.column(i) for i, c in enumerate(kept)} | {"lang_pred": langs, "score": scores}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return map_arrow(source, run, f"{kinds}, lang_pred string, score double" if kinds else "lang_pred string, score double")


def identify(documents: DataFrame, vocabulary: str, folds: int = 3, held_out_fold: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **options) -> DataFrame:
    """Predictions for every document from a model of the documents outside the held-out fold.

    The fold of a document is crc32 of its id as text modulo ``folds``. Returns the id, held_out, lang_pred, score.
    """
    held = crc_mod(id_col, folds) == held_out_fold
    model = train(documents.filter(~held), vocabulary, id_col=id_col, text_col=text_col, label_col=label_col, **options)
    plain = documents.select(F.col(id_col), held.alias("held_out"), F.col(text_col).cast("string").alias("_whole"))
    return predict(plain, model, "_whole").drop("_whole")
