import io
import random
import zlib

import numpy as np
import pytest
import zstandard
from strandlake.llm import token_frames as tf
from strandlake.llm.common import shared_path
from strandlake.llm.registry import tokenizer_file
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, docs

PATH = tokenizer_file("word_bpe_49k.json")
ODD = ["a<|endoftext|>b C'mon don't-- x_y a1b2 İ ΟΔΟΣ. ab.,c \t\x1c q", "I'll, we're!! Hello!! x́. a-b 's it's.", "", "  \n\n ", "end)]} #%&*|-+=/ $5.00"]


def test_word_ids_are_whole_text_ids():
    plain = Tokenizer.from_file(PATH)
    random.seed(5)
    alphabet = "abcXYZ019 .,'-_\n\téÉß́#!?"
    texts = ODD + [t or "" for _, t, _ in awkward()] + ["".join(random.choice(alphabet) for _ in range(80)) for _ in range(200)]
    for t, ids in zip(texts, tf.WordEncoder(PATH, store=50).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_files_hold_what_the_tokenizer_gives(spark):
    rows = awkward() + [(200 + i, t, "z") for i, t in enumerate(ODD)]
    got = tf.token_files(docs(spark, rows), PATH).orderBy("start").collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted(((i is not None, i or 0, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows), key=lambda x: x[:2])
    at = 0
    assert [r.doc_id for r in got] == [i if has else None for has, i, _ in want]
    for r, (_, _, ids) in zip(got, want):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tf.token_files(docs(spark, []), PATH).collect() == []


def test_a_reader_decompresses_only_what_it_is_asked_for(spark):
    out = shared_path(spark, "tokens")
    manifest = tf.write_frames(docs(spark, [(i, f"text number {i}", "s") for i in range(40)]), PATH, out).collect()
    store, _ = tf.open_store(out)
    with store.open_input_file(manifest[0].path) as source:
        reader = tf.FrameReader(source)
        opened = []
        frame = reader.frame
        reader.frame = lambda k: opened.append(k) or frame(k)
        wanted = reader.ids[1]
        assert [i for i, _ in reader.documents([wanted])] == [wanted] and opened == [1]


def test_damage_is_found_and_frames_are_plain_zstandard():
    sink = io.BytesIO()
    w = tf.FrameWriter(sink)
    data = [np.arange(n, dtype="<u4").tobytes() for n in (5, 0, 300)]
    for i, d in enumerate(data):
        w.add(i, d)
    w.close()
    whole = sink.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read() == b"".join(data)
    assert [t.tobytes() for _, t in tf.FrameReader(io.BytesIO(whole)).documents()] == data
    for at in (6, len(whole) - 5, len(whole) - 20):
        bad = bytearray(whole)
        bad[at] ^= 255
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(tf.FrameReader(io.BytesIO(bytes(bad))).documents())
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tf.FrameReader(io.BytesIO(whole[:-3]))


def test_other_vocabulary_files_are_used_for_whole_texts():
    assert tf.WordEncoder(PATH).by_words
    other = tokenizer_file("byte_bpe_50k.json")
    coder, plain = tf.WordEncoder(other), Tokenizer.from_file(other)
    assert not coder.by_words
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(ODD)] == [plain.encode(t, add_special_tokens=False).ids for t in ODD]
