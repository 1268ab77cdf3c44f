"""Packing holds the ids of the JSON tokenizer also where texts have its added token."""

from __future__ import annotations

import random
import zlib

import numpy as np

from verdigris.llm import packing


def test_packing_of_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, mark = random.Random(3), "<|endoftext|>"
    parts = [mark, mark, mark[:-1], mark[1:], "<|", "|>", " ", "  ", "\n", "\n\n", "a", " b", "é", "12", "'s", "...", "漢", "\t"]
    texts = ["a <|endoftext|> b", mark, mark * 3, f" {mark}", f"{mark} ", f"x  {mark}  y", mark.upper(), ("word " * 1500 + mark) * 2]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(200)]
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    assert ids[0] == [64, 220, 50256, 275, 0]
    got: dict[int, int] = {}
    for r in packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        mine = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(mine) == r["length"] and zlib.crc32(mine.tobytes()) == r["ids_crc32"]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: len(x) for i, x in ids.items()}
