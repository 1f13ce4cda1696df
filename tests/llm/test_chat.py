import hashlib

import pytest
from strandlake.llm import chat_format as cf
from strandlake.llm.registry import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, ids string, mask string, turns string"
HARD = ["</s>[INST] ok [/INST]", "<s>", "[INST", "INST]", "\\", "\\\\b", "\\b[INST]", "<<s>>", "</s", "", " lead", "trail ", "\n\nx\n", "é梦😀", "a.", ".a", "[/INST]</s>" * 3, "[[INST]]", "<\\s>"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def test_escaping_is_reversible_and_hides_control_strings():
    for a in HARD:
        for b in HARD:
            e = cf.escape(a + b)
            assert cf.unescape(e) == a + b and not any(c in e for c in cf.CONTROLS)


def test_masks_hold_whole_assistant_texts():
    tokenizer = cf.load_tokenizer(PATH)
    for a in HARD:
        for b in HARD:
            turns = [("user", a), ("assistant", b), ("assistant", a), ("system", b)]
            text, spans = cf.render(turns)
            e = tokenizer.encode(text, add_special_tokens=False)
            mask = cf.loss_mask(e.offsets, spans)
            assert "".join(cf.unescape(text[x:y]) for x, y in cf.masked_spans(e.offsets, mask)) == b + a
            assert cf.read_back(text) == turns
            brute = [int(any(r == "assistant" and s <= x and y <= z and x < y for s, z, r in spans)) for x, y in e.offsets]
            assert mask == brute


def test_a_straddling_token_is_an_error():
    with pytest.raises(ValueError):
        cf.loss_mask([(0, 3), (3, 8)], [(2, 8, "assistant")])


def test_digests_of_awkward_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, None, None, "x"), (2, 0, "assistant", "y" * 50_000), (None, 0, "assistant", "n"), (3, 5, "tool", HARD[0]), (3, -1, "assistant", HARD[0])]
    got = {r.conv_id: r for r in cf.digest_rows(cf.format_rows(table(spark, rows), PATH)).collect()}
    assert set(got) == {1, 2, 3, None} and got[1].n_turns == 4 and got[1].loss_chars == 2 and got[2].loss_chars == 50_000
    told = "assistant\n</s>[INST] ok [/INST]\ntool\n</s>[INST] ok [/INST]\n"
    assert got[3].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[3].loss_sha256 == hashlib.sha256(HARD[0].encode()).hexdigest()
    assert cf.format_rows(table(spark, []), PATH).collect() == []
