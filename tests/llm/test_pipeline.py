import random

import corpus_pipeline
from strandlake.llm import common
from strandlake.llm.registry import QUERIES

from tests.llm.helpers import awkward, docs, labels
from tests.llm.test_classifiers import corpus
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_secrets import brute as spans
from tests.llm.test_simhash import brute_components, brute_fingerprint


def small(spark, path):
    """Tables with bad and good texts, copies, leaks and secrets."""
    random.seed(6)
    rows, marks = corpus(160)
    rows = [(i, t, s) for i, t, s in rows]
    items = [(k, " ".join(f"q{k}w{j}" for j in range(20)) + ". " + " ".join(f"a{k}w{j}" for j in range(6)) + ".") for k in range(5)]
    good = [i for i, q, _ in marks if q]
    for n, i in enumerate(good[:20]):
        t = rows[i][1]
        if n < 6:
            rows.append((1000 + n, t, "copy"))
        elif n < 11:
            rows.append((1000 + n, t + " " + items[n - 6][1], "leak"))
        elif n < 16:
            rows.append((1000 + n, f"{t[:200]} AKIA{'ABCDEFGHIJKLMNOPQRST'[n:]}Z7Q2W9E4R6T8Y1 {t[200:]} number {n}", "key"))
    frame = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    labels(spark, marks).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, dict((i, q) for i, q, _ in marks), items


def test_stages_against_brute_force(spark, tmp_path):
    rows, marks, items = small(spark, str(tmp_path))
    docs, columns = common.read_table(spark, str(tmp_path), "documents"), ["doc_id", "text", "lang", "source", "n_chars"]
    now = {i: t for i, t, _ in rows}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name == "piece_coding":
            break
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_classifier":
            assert all(bool(q) == (i in got) for i, q in marks.items())
            now = {i: t for i, t in now.items() if i in got}
        elif name == "simhash_dedup":
            pairs = [(i, brute_fingerprint(t)) for i, t in now.items()]
            least = brute_components(pairs)
            now = {i: now[i] for i, f in pairs if least[f] == i}
        elif name == "decontamination":
            now = {i: t for i, t in now.items() if not leaks(t, items)}
        elif name == "secret_scans":
            for i, t in now.items():
                for a, _, z in reversed(spans(t)):
                    t = t[:a] + "[SECRET]" + t[z:]
                now[i] = t
        assert got == now
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in whole) == sorted(now) and all(r.round_trip and r.decoded_chars == len(now[r.doc_id]) for r in whole)
    assert sorted(r.ids_sha256 for r in whole) == sorted(r.ids_sha256 for r in docs.collect())


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_dedup", "decontamination", "secret_scans", "piece_coding"]
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows and ids, clashing extra columns, empty tables."""
    small(spark, str(tmp_path))
    item = common.read_table(spark, str(tmp_path), "benchmark").where("item_id = 3").first().text
    rows = awkward() + [(1, "another text under a used id, long enough to be told apart", "a"), (None, None, None), (40, item, None), (None, item, "b"), (41, "key AKIA" + "Q7RZP2LM9XVB4KTN83WD", None)]
    table = docs(spark, rows).withColumn("__x", common.F.lit(1)).withColumn("judged", common.F.lit("j"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, table, str(tmp_path))
        none = stage(spark, table.limit(0), str(tmp_path))
        assert none.collect() == [] and none.columns == got.columns
        kept = [(r.doc_id, r.text) for r in got.collect()] if name != "piece_coding" else []
        if name == "piece_coding":
            assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i, *_ in rows)
            continue
        assert got.columns == table.columns
        every = [(i, t) for i, t, _ in rows]
        if name == "quality_classifier":
            assert set(kept) <= set(every)
        elif name == "simhash_dedup":
            pairs = [(i, brute_fingerprint(t)) for i, t in every if i is not None]
            least = brute_components(pairs)
            stay = {(i, t or "") for i, t in every if i is not None and least[brute_fingerprint(t)] == i}
            assert sorted((i, t or "") for i, t in kept if i is not None) == sorted(stay)
            assert sorted(t or "" for i, t in kept if i is None) == sorted(t or "" for i, t in every if i is None)
        elif name == "decontamination":
            assert sorted(map(str, kept)) == sorted(str(x) for x in every if x[1] != item)
        else:
            assert sorted(map(str, kept)) == sorted(str((i, "key [SECRET]" if i == 41 else t)) for i, t in every)
