"""A pre-token is merged once, whatever marks stand beside it."""

import public_tokenizers

from tessera.llm import bpe


def test_each_pre_token_is_merged_once(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        vocab = bpe.vocabulary(f.read()).for_a_task()
    seen = []
    merge = vocab.merge
    monkeypatch.setattr(vocab, "merge", lambda symbols: seen.append(tuple(symbols)) or merge(symbols), raising=False)
    text = "Thention, thention. (thention) THENTION! café, café."
    first = vocab.encode(text)
    assert len(seen) == len(set(seen)) > 0
    assert vocab.library.encode(text, add_special_tokens=False).ids == [int.from_bytes(first[i : i + 4], "little") for i in range(0, len(first), 4)]
    monkeypatch.setattr(bpe, "REMEMBERED_PIECES", 1)
    again = vocab.for_a_task()
    assert again.encode(text) == first and len(again.merged) == 1
