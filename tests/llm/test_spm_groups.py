"""The encoder's new units are merged together, a group of texts at a time."""

import random

import public_tokenizers

from sentipanel.llm import spm

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_new_units_are_merged_together(monkeypatch):
    m = spm.PieceModel(MODEL, table_rows=50)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeinorst.é☃7") for _ in range(rng.choice([1, 2, 5, 9, 12, 24, 25, 40])))
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", " ", "\n", "a" * 33, "▁ ▁"]
    want = m.lib.encode(texts)
    calls = []
    join = m._join
    monkeypatch.setattr(m, "_join", lambda left, right: calls.append(1) or join(left, right))
    assert list(m.encode_all(texts)) == want
    assert len(calls) < 500  # a few a round and width, not some for every one of the thousands of units
    assert len(m.known.old) > 0 and not any(len(u) > spm.TABLE_CHARS for u in [*m.known, *m.known.old])
    monkeypatch.setattr(spm, "GROUP_CHARS", 100)  # many groups, a table that is full time and again
    assert list(m.encode_all(texts * 2)) == want * 2
