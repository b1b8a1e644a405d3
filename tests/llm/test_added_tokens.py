"""Packing against the tokenizer as its file has it."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lodestone.llm import packing


def test_added_tokens_are_encoded_as_the_file_says(spark):
    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = [
        "Hello <|endoftext|> world", "a<|endoftext|>b. <|startoftext|><|endoftext|>, x", "<|EndOfText|> <|endoftext", "e<|endoftext|>́ café",
        "one\n<|startoftext|>\ttwo <|endoftext|>\n",
    ]
    assert plain.encode(texts[0], add_special_tokens=False).ids == [3306, 49407, 1002]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.packed(frame).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_special_tokens_are_text_on_request_only():
    path, text = public_tokenizers.path(packing.TOKENIZER), "Hello <|endoftext|> world"
    plain = Tokenizer.from_file(path)
    for special_as_text in (False, True):
        plain.encode_special_tokens = special_as_text
        options = {"special_as_text": True} if special_as_text else {}
        ids, lengths = packing.WordTokens(path, **options).encoded(pa.array([text]), 1)
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]
        assert lengths.tolist() == [len(ids)] and (49407 in ids) != special_as_text
