"""The encoder's character tables against the library, over every code point and random strings."""

from __future__ import annotations

import random
import unicodedata

from quernstone.llm import bpe
from quernstone.llm.registry import tokenizer_path


def test_every_code_point_encodes_as_the_library_does():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    own, tok = bpe.WordBPE(path), Tokenizer.from_file(path)

    def differs(text):
        want = tok.encode(text, add_special_tokens=False).ids
        ids, _, shown = own.encode(text)
        return ids != " ".join(map(str, want)) or shown != tok.decode(want, skip_special_tokens=False)

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert [hex(points[i]) for i in range(0, len(points), 512) if differs(" ".join(f"a{chr(c)}b1" for c in points[i : i + 512]))] == []
    marks = [c for c in points if unicodedata.category(chr(c))[0] == "M"]
    odd = [c for c in points if c < 0x3000 or (unicodedata.category(chr(c)) == "Cn" and c < 0x17000)]
    rng = random.Random(3)
    strings = ["".join(chr(rng.choice(marks if rng.random() < 0.4 else odd)) for _ in range(10)) for _ in range(5000)]
    assert [x for x in strings if differs(x)] == []
