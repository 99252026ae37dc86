"""Words are looked up in the kept words' own dictionary; those too long to be kept go with the lookup that had them."""

import public_tokenizers
import pytest

from lodestone.llm import encoding


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_words_are_found_and_not_kept(name):
    e = encoding.Encoder(public_tokenizers.path(name))
    e.kept = encoding.Recent(2000)  # a few words: generations change often
    texts = ["x" * 300 + " one two", "y" * 300 + " two three", "one " + "x" * 300 + " four", "", "two  two\n" + "z" * 300]
    for text in texts * 3:
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        (got,) = e.encode([text])
        assert got == b"".join(i.to_bytes(4, "little") for i in want)
        assert all(len(w) <= encoding.KEPT_CHARS for w in e.kept.young)
    assert isinstance(e.kept.young, encoding.Held)
