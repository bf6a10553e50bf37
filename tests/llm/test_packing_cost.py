"""Texts are encoded whole: one call a text, with the ids of the tokenizer's own library."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyshop.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_one_call_a_text_gives_the_ids_of_the_library():
    plain, tokens, calls = Tokenizer.from_file(PATH), packing.Tokens(PATH), []
    encode = tokens.encode
    tokens.encode = lambda text: calls.append(text) or encode(text)
    new = " ".join(f"w{i * 7919 % 100003:x}" for i in range(500))  # words a task has not met
    texts = ["", " ", "one", "two words, don't", " lead\n\n x \t y  ", "tab\tend ", "é ß 漢字 🙂 12345", "a b  c", new]
    for text in texts:
        assert np.frombuffer(tokens.of(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert calls == texts
    special = "a <|endoftext|> b"
    assert np.frombuffer(tokens.of(special), "<u4").tolist() == plain.encode(special, add_special_tokens=False).ids
    assert calls == texts
