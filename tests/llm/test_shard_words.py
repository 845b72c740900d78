"""Plain words told many at once are those told one by one."""

import public_tokenizers as p

from basketwise.llm.token_shards import WordEncoder


def test_plain_words_and_marks():
    e = WordEncoder(p.path("word_bpe_49k.json"))
    words = ["", "word", "Wörter", "a,", ",", "!!", "x!!", "naïve.", "ﬁn", "İs", "3rd", "日本", "ét", "word,", "word"]
    assert e.plain_of(words) == {w for w in words if e.plain(w)}
    texts = [" ".join(words), "word, word; Wörter! naïve.", ""]
    own = WordEncoder(p.path("word_bpe_49k.json"))
    expected = [b"".join(i.to_bytes(4, "little") for i in e.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.encode(texts) == expected
