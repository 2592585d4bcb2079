"""Compression classifier: sizes under zstandard dictionaries of good and of bad text, calibrated."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import Isotonic
from .common import in_training_fold, labelled_sample, utf8

#: The bound of what is learned from: labelled rows of each label, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 8 << 20
DICTIONARY_BYTES, LEVEL, PIECE = 32 << 10, 3, 2000


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    scale: Isotonic

    def scorer(self):
        packers = [_packer(d) for d in (self.good, self.bad)]
        return lambda text: _difference(packers, text)


def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if kept:
        kept.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)


def _difference(packers: list, text: bytes) -> float:
    """How much smaller the text is with the good dictionary than with the bad one, by its length."""
    good, bad = (len(p.compress(text)) for p in packers)
    return (bad - good) / (len(text) + 1)


def _train(texts: list[bytes]) -> bytes:
    samples = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too little text for a trained one: the text itself
        return b"".join(texts)[-DICTIONARY_BYTES:]


def fit(sample: list[tuple[str, int]], counts: dict[int, int]) -> CompressionModel:
    """Dictionaries from one half of the sample, the calibration from the other, weighted to the labels' real shares."""
    sample = [(t.encode(), y) for t, y in sample]
    random.Random(5).shuffle(sample)
    half = len(sample) // 2
    good, bad = (_train([t for t, y in sample[:half] if y == k]) for k in (1, 0))
    model = CompressionModel(good, bad, Isotonic(np.empty(0), np.empty(0)))
    score = model.scorer()
    rest = sample[half:]
    y = np.array([k for _, k in rest], float)
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([counts.get(int(k), 1) / n[int(k)] for k in y])
    weight = weight / weight.mean() if len(weight) else weight
    model.scale = Isotonic(np.array([score(t) for t, _ in rest]), y, weight)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; score: the probability that labels.quality is 1.

    Learned from a bounded sample of the training fold (sample_rows of each label, sample_bytes of their texts). Every
    text is compressed whole with each dictionary. Null texts are empty; without labels every score is one half. Null
    ids are in the training fold but teach nothing; repeated rows score alike; an empty table gives no rows.
    """
    model = fit(*labelled_sample(docs, labels, "quality", sample_rows, sample_bytes, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), (~in_training_fold(F.col(id_col))).alias("held_out"), utf8(F.col(text_col)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            raw = np.fromiter((score(t.as_py()) for t in batch.column(2)), float, batch.num_rows)
            p = model.scale(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
