"""Words that end in several marks are put together from parts, with the library's ids."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from basketwise.llm.token_shards import WordEncoder  # noqa: E402

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def test_runs_of_marks_are_not_asked_with_their_word():
    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(2)
    heads = ["word", "Wörter", "don't", "a", "x1", "naïve", "", "İs", "<|endoftext|", "日本"]
    words = [r.choice(heads) + "".join(r.choice(MARKS) for _ in range(r.randint(0, 5))) for _ in range(4000)] + ["<|endoftext|>", "a<|endoftext|>", "word<|>"]
    want = [b"".join(i.to_bytes(4, "little") for i in x.ids) for x in e.library.encode_batch(words, add_special_tokens=False)]
    assert e.encode(words) == want
    asked, ask = [], e.ask
    e.ask = lambda some: (asked.extend(some), ask(some))
    e.encode(["fresh$$$ words.&&& (here)..."])
    assert "(here)..." in asked and not {"fresh$$$", "words.&&&"} & set(asked)
