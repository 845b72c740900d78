"""Letters that turn into letters and marks when the library normalises them, and widths that don't fit."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from basketwise.llm import token_shards  # noqa: E402

PATH = "word_bpe_49k.json"
LETTERS = "aZéßÅIİıçğşŞñΣςσάЖёй" + "יִיִששׁ" + "क़क़ख़ড়ਲ਼" + "Åẞǅ̇́ͅ" + "字ﬁº"


def test_ids_of_mixed_letters():
    from tokenizers import Tokenizer

    r = random.Random(4)
    library = Tokenizer.from_file(public_tokenizers.path(PATH))
    word = lambda: "".join(r.choice(LETTERS) for _ in range(r.randrange(1, 5))) + r.choice(["", ".", ",", "!", "?", ";.", "'s", "’"])
    texts = ["TÜRKİ.", "GELİŞİYOR DERSLERİ, TÜRKİ.", "क़.", "क़!", "יִ."]
    texts += [r.choice(" \n\t ").join(word() for _ in range(r.randrange(1, 6))) for _ in range(6000)]
    got = token_shards.WordEncoder(public_tokenizers.path(PATH)).encode(texts)
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, ascii(text)


def test_order_and_width(spark, tmp_path):
    texts = [(i % 90 if i % 11 else None, f"word{i} and more " * (i % 7)) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    path = f"file://{tmp_path}/small"
    token_shards.write_shards(df.repartition(5), path, public_tokenizers.path(PATH), end_id=2, shard_bytes=1000)
    rows = token_shards.read_documents(spark, path).collect()
    assert len(rows) == 400 and len(list((tmp_path / "small").glob("part-*"))) > 12
    rows = sorted(rows, key=lambda x: x["start"])
    assert [x["start"] for x in rows] == [0, *np.cumsum([x["n_tokens"] for x in rows])[:-1].tolist()]
    keys = [-1 if x["doc_id"] is None else x["doc_id"] for x in rows]
    assert keys == sorted(keys)
    assert {x["ids_crc32"] for x in rows if x["n_tokens"] == 1} == {zlib.crc32(b"\2\0\0\0")}
    with pytest.raises(Exception, match="don't fit"):
        token_shards.write_shards(df, f"file://{tmp_path}/wide", public_tokenizers.path(PATH), end_id=70_000, width=2)
    token_shards.write_shards(df, f"file://{tmp_path}/four", public_tokenizers.path(PATH), end_id=70_000)
    assert token_shards.read_documents(spark, f"file://{tmp_path}/four").count() == 400
