"""Operator 2 against the library for every code point, and empty tables for operators 2 and 3."""

from tessera.llm import bpe, tokencount
from tessera.llm.queries import vocabulary_file


def test_every_code_point_as_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    vocab = bpe.vocabulary(vocabulary_file("word_bpe_49k.json")).for_a_task()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}" for c in points[at : at + 400]) for at in range(0, len(points), 400)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        packed = vocab.encode(text)
        assert packed == bpe.pack(want.ids), ascii(text[:20])
        assert vocab.decode(packed) == library.decode(want.ids, skip_special_tokens=False)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    assert bpe.encode_documents(none, vocabulary_file("word_bpe_49k.json"), digest=True).collect() == []
    assert tokencount.count_tokens(none, vocabulary_file("piece_bpe_32k.model")).collect() == []
