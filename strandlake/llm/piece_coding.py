"""Operator 6, SentencePiece encoding and decoding with N-best segmentation."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandlake.llm.common import map_arrow, packed
from strandlake.llm.piece_lattice import N_BEST, segmenter, spliced

#: Texts segmented together.
SLICE = 512


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST) -> DataFrame:
    """Rows (doc_id, best binary, scores array<long>, others array<binary>) for every row of ``docs``.

    ``best`` holds the ids of the best segmentation as little-endian unsigned
    16-bit integers, ``scores`` the log-probabilities of the N best in thousandths,
    ``others`` the ids of the rest of the N best. A null text counts as empty;
    an empty text is the one leading space.
    """

    def run(batches):
        coder = segmenter(model_path, n)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                best, scores, others = [], [], []
                for first, ends, own, changes in coder.segment_all([t.as_py() or "" for t in part.column(1)]):
                    best.append(first)
                    scores.append(own)
                    others.append([spliced(first, ends, c) for c in changes[1:]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.binary()), pa.array(scores, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.binary()))], ["doc_id", "best", "scores", "others"])

    rows = packed(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, best binary, scores array<long>, others array<binary>")


def decode(coded: DataFrame, model_path: str, ids_col: str = "best") -> DataFrame:
    """``coded`` with ``text``, decoded from ``ids_col``; null ids decode to null."""
    names = coded.columns

    def run(batches):
        coder = segmenter(model_path)
        at = names.index(ids_col)
        for b in batches:
            texts = [None if x.as_py() is None else coder.decode(x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "text"])

    schema = StructType([*coded.schema.fields, StructField("text", StringType())])
    return map_arrow(coded, run, schema)


def code_report(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST) -> DataFrame:
    """One row per row of ``docs``: digests of its N best segmentations and of the text decoded from each.

    Columns doc_id, n_pieces, ids_sha256 (best ids as little-endian unsigned
    16-bit integers), best_score, scores (comma-joined, best first), others_sha256
    (ids of the rest, in order), n_best, decoded_chars, decoded_sha256, round_trip
    (all N best decode to the text). Null and empty texts are one space piece;
    repeated rows come out as often as they come in; no rows give none.
    """

    def run(batches):
        coder = segmenter(model_path, n)
        data = coder.pieces.data
        spelt = lambda ids: b"".join([data[x] for x in memoryview(ids).cast("H")])
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part, rows = b.slice(at, SLICE), []
                texts = [t.as_py() or "" for t in part.column(1)]
                for i, text, (best, ends, scores, changes) in zip(part.column(0), texts, coder.segment_all(texts)):
                    decoded = coder.decode(best)
                    whole, rest = decoded == text, hashlib.sha256()
                    for c in changes[1:]:
                        rest.update(spliced(best, ends, c))
                        whole = whole and all(spelt(y) == spelt(best[int(ends[k - 1]) if k else 0 : int(ends[k])]) for k, y in c.items())
                    rows.append(
                        dict(doc_id=i.as_py(), n_pieces=len(best) // 2, ids_sha256=hashlib.sha256(best).hexdigest(), best_score=scores[0], scores=",".join(map(str, scores)),
                             others_sha256=rest.hexdigest(), n_best=len(scores), decoded_chars=len(decoded), decoded_sha256=hashlib.sha256(decoded.encode()).hexdigest(), round_trip=whole)
                    )
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"doc_id": pa.int64(), "n_pieces": pa.int64(), "ids_sha256": pa.string(), "best_score": pa.int64(), "scores": pa.string(), "others_sha256": pa.string(), "n_best": pa.int64(), "decoded_chars": pa.int64(), "decoded_sha256": pa.string(), "round_trip": pa.bool_()}
    schema = pa.schema(list(kinds.items()))
    named = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    rows = packed(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, ", ".join(f"{k} {named[v]}" for k, v in kinds.items()))
