"""Operator 3, benchmark decontamination by BM25 with block-max WAND.

Test items form inverted indexes; every training passage is a query against
them. Items that reach the threshold are verified: at least four in five of the
five-word shingles of the question, and of the answer, must be in the passage.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_arrow, packed, written
from strandlake.llm.bm25_wand import OVERLAP, SHINGLE, Index, Item, shingles, split_item, words_of

#: Items of one index, and indexes that are broadcast together; a larger benchmark takes more passes over all passages.
INDEX_ITEMS = 5000
INDEXES_A_PASS = 4
#: Least words of a passage; passages overlap by half and are twice as long as the longest item at least.
PASSAGE_WORDS = 128
#: Documents read to order terms by frequency; the order changes the work, never the result.
ORDER_DOCS = 400

MATCH = "item_id long, start long, score double, question_overlap double, answer_overlap double"


def _items(benchmark: DataFrame, id_col: str, text_col: str, question_col: str | None, answer_col: str | None) -> Iterator[Item]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")) if text_col in benchmark.columns else F.lit("")
    question = F.col(question_col) if question_col else F.lit(None)
    answer = F.col(answer_col) if answer_col else F.lit(None)
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), text.alias("t"), question.cast("string").alias("q"), answer.cast("string").alias("a"))
    for r in rows.orderBy("i", "t").toLocalIterator():
        q, a = (r.q or "", r.a or "") if question_col and answer_col else split_item(r.t)
        item = Item(r.i, q, a, f"{q} {a}" if question_col and answer_col else r.t)
        if item.words:
            yield item


def build_indexes(docs: DataFrame, benchmark: DataFrame, id_col="item_id", text_col="text", question_col=None, answer_col=None) -> list[Index]:
    """Indexes of INDEX_ITEMS items each; items without words are left out, repeated ones stay."""
    items = list(_items(benchmark, id_col, text_col, question_col, answer_col))
    df = Counter(t for i in items for t in set(i.words))
    mean = sum(len(i.words) for i in items) / max(1, len(items))
    vocabulary = frozenset(df)

    def count(batches):
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(w for w in words_of(t.as_py() or "") if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    often: Counter[str] = Counter()
    if items:
        for r in map_arrow(docs.select(F.col("text").cast("string")).limit(ORDER_DOCS), count, "term string, n long").collect():
            often[r.term] += r.n
    return [Index(items[k : k + INDEX_ITEMS], len(items), mean, df, often) for k in range(0, len(items), INDEX_ITEMS)]


def matches(text: str | None, index: Index) -> list[dict]:
    """Verified matches of a whole text: per item the passage that scores best."""
    if not text:
        return []
    words = words_of(text)
    if index.essential.isdisjoint(words):
        return []
    size = max(PASSAGE_WORDS, 2 * index.longest)
    step = size // 2
    best: dict[int, dict] = {}
    for start in range(0, max(1, len(words) - step), step):
        passage = words[start : start + size]
        hits = index.essential.intersection(passage)
        if not hits or not index.may_reach(hits):
            continue
        near = None
        for k, score in index.retrieve(set(passage)):
            item = index.items[k]
            if near is None:
                near = shingles(words[max(0, start - step) : start + size + step])
                wide = words[max(0, start - step) : start + size + step]
            q, a = (_share(part, near, wide) for part in (item.question, item.answer))
            if q >= OVERLAP and a >= OVERLAP and (k not in best or best[k]["score"] < score):
                best[k] = dict(item_id=item.item_id, start=start, score=score, question_overlap=q, answer_overlap=a)
    return [best[k] for k in sorted(best)]


def _share(part: set[tuple[str, ...]], near: set[tuple[str, ...]], words: list[str]) -> float:
    """Share of ``part`` in the passage; a part of one short sequence is sought as it is."""
    if not part:
        return 1.0
    if len(part) == 1 and len(own := next(iter(part))) < SHINGLE:
        return float(any(tuple(words[k : k + len(own)]) == own for k in range(len(words) - len(own) + 1)))
    return len(part & near) / len(part)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """Rows (doc_id, item_id, start, score, question_overlap, answer_overlap) of verified matches only.

    ``start`` is the passage's first word, ``score`` the BM25 score as a multiple
    of the item's threshold. Null and empty texts and items match nothing; of
    repeated items and rows each repeats its matches; null ids stay null; no
    documents or no items give no rows.
    """

    def run_with(indexes):
        def run(batches):
            for b in batches:
                out = []
                for i, t in zip(b.column(0), b.column(1)):
                    text = t.as_py()
                    out += [m | {"doc_id": i.as_py()} for x in indexes for m in matches(text, x.value)]
                yield pa.RecordBatch.from_pylist(out, schema)

        return run

    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    rows = packed(docs).select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = [map_arrow(rows, run_with(own), f"doc_id long, {MATCH}") for own in _passes(docs, benchmark, **columns)]
    return reduce(DataFrame.unionByName, parts)


def _passes(docs: DataFrame, benchmark: DataFrame, **columns) -> list[list]:
    """Broadcasts of the indexes, in groups of INDEXES_A_PASS; one empty group if there are none."""
    indexes = [docs.sparkSession.sparkContext.broadcast(x) for x in build_indexes(docs, benchmark, **columns)]
    return [indexes[k : k + INDEXES_A_PASS] for k in range(0, max(1, len(indexes)), INDEXES_A_PASS)]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """Rows of ``docs`` whose text holds no verified match; everything else about them is kept.

    Rows with null or empty texts and null ids stay, repeated rows stay or go
    together; without items all stay, and no rows give none.
    """
    at = docs.columns.index("text")

    def run_with(indexes):
        def run(batches):
            for b in batches:
                clean = [not any(matches(t.as_py(), x.value) for x in indexes) for t in b.column(at)]
                yield b.filter(pa.array(clean, pa.bool_()))

        return run

    passes = _passes(docs, benchmark, **columns)
    rows = packed(docs)
    for k, own in enumerate(passes):
        # Between passes rows are written, so no task holds more indexes than a pass has.
        rows = map_arrow(written(rows, "clean") if k else rows, run_with(own), docs.schema)
    return rows
