"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word's symbols (bytes; its last one carries the word end) are written as characters, so that every
vocabulary token is a short string. An Aho-Corasick automaton lists all tokens that start at each place of
a word; the encoder takes the longest one whose pair with the token before it is compatible, and steps back
where none fits. Two neighbouring tokens are compatible if merging their joint symbols by rank gives them
back; since an encoding is right exactly if all its neighbouring pairs are, the first cover found is the
merge result. Compatibilities are tabulated as they are met. Places known to lead nowhere are not
tried again, so work is linear in the word's length for a bounded token length.

Decoding reads ids from one string of all token texts by an offset table.

Texts are encoded whole, inside Spark tasks over Arrow batches; a task's memory is the vocabulary, one batch
and two caches of bounded size (they are emptied when full, which changes speed only).
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 400_000
LAST = 0x1000  # added to the character of a word's last symbol
#: The code points (ranges in hexadecimal) on which the library's character tables differ from those of
#: ``unicodedata`` 15.1: further letters and digits, marks that its normaliser takes for starters (and one second half of a
#: pair that it does not compose), and capitals with their lower case.
SPACES = "9-D 20 85 A0 1680 2000-200A 2028-2029 202F 205F 3000"
MORE_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 "
    "11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
)
MORE_DIGITS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
STARTERS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 "
    "11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 "
    "1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
MORE_CAPITALS = "1C89>1C8A A7CB>264 A7CC>A7CD A7CE>A7CF A7D2>A7D3 A7D4>A7D5 A7DA>A7DB A7DC>19B 10D50-10D65>10D70 16EA0-16EB8>16EBB"


def code_ranges(text: str) -> list[tuple[int, int]]:
    """The (first, last) code points of a list such as "20 2000-200A"."""
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (x.partition("-") for x in text.split())]


def char_class(ranges: list[tuple[int, int]]) -> str:
    """The inside of a bracketed class of a pattern."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(maxsize=4)
def category_ranges(kind: str) -> tuple[tuple[int, int], ...]:
    """The ranges of code points whose general category starts with ``kind``."""
    out: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == kind:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return tuple(map(tuple, out))


def lower_table() -> dict[int, int]:
    """The code points of MORE_CAPITALS with their lower case."""
    out = {}
    for part in MORE_CAPITALS.split():
        capitals, _, to = part.partition(">")
        ((a, b),) = code_ranges(capitals)
        out.update({c: int(to, 16) + c - a for c in range(a, b + 1)})
    return out


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: visible Latin-1
    characters stand for themselves, the others for code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBPE:
    """The encoder of a word-end BPE vocabulary file; ``path`` is a parameter, the file is never copied."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        chars = byte_characters()
        self.byte = {b: c for b, c in enumerate(chars)}
        ids = model["vocab"]
        self.ids: dict[str, int] = {}
        for text, i in ids.items():
            self.ids[self._symbols(text)] = i
        self.rank: dict[tuple[str, str], int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[self._symbols(a), self._symbols(b)] = r
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        texts = {**{i: t for t, i in ids.items()}, **{i: t for t, i in self.special.items()}}
        self.shown, self.offset = "", [0]
        for i in range(max(texts) + 1):
            self.offset.append(self.offset[-1] + len(texts.get(i, "")))
        self.shown = "".join(texts.get(i, "") for i in range(max(texts) + 1))
        self.machine = ahocorasick.Automaton()
        for symbols, i in self.ids.items():
            if len(symbols) == 1 or self.merged(symbols) == [symbols]:
                self.machine.add_word(symbols, symbols)
        self.machine.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[str, int, str]] = {}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        classes = {r"\s": code_ranges(SPACES), r"\p{L}": [*category_ranges("L"), *code_ranges(MORE_LETTERS)], r"\p{N}": [*category_ranges("N"), *code_ranges(MORE_DIGITS)]}
        for name, ranges in classes.items():  # the vocabulary's pattern names them within brackets only
            split = split.replace(name, char_class(ranges))
        self.exact = re.compile(split).findall
        self.quick = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.starters = re.compile(f"([{char_class(code_ranges(STARTERS))}])")
        self.capitals = lower_table()
        unsure = [r for r in [*category_ranges("C"), *code_ranges(STARTERS), *((c, c) for c in self.capitals)] if r[0] > 0xFF and r[1] < 0x10000]
        self.unsure = re.compile(f"[{char_class(unsure)}\\U00010000-\\U0010ffff]").search

    def _symbols(self, text: str) -> str:
        """A vocabulary entry as one character per symbol."""
        if text.endswith(self.end) and text != self.end:
            body = text[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + LAST)
        return text

    def merged(self, symbols: str) -> list[str]:
        """Merge by rank, lowest first: the definition that compatibilities are read from."""
        parts = list(symbols)
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 30:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        ok = self.compatible.get((a, b))
        if ok is None:
            if len(self.compatible) >= CACHE:
                self.compatible.clear()
            ok = self.compatible[a, b] = self.merged(a + b) == [a, b]
        return ok

    def encode_symbols(self, word: str) -> list[str]:
        starts: list[list[str]] = [[] for _ in word]
        for end, token in self.machine.iter(word):
            starts[end + 1 - len(token)].append(token)  # ends come in order, so lengths grow
        out: list[str] = []
        tried = [starts[0][:]]
        dead: set[tuple[int, str]] = set()
        at = 0
        while at < len(word):
            options = tried[-1]
            while options:
                token = options.pop()
                if (at, token) not in dead and (not out or self.fits(out[-1], token)):
                    out.append(token)
                    at += len(token)
                    if at < len(word):
                        tried.append(starts[at][:])
                    break
            else:
                tried.pop()
                last = out.pop()
                at -= len(last)
                dead.add((at, last))
        return out

    def word(self, piece: str) -> tuple[str, int, str]:
        """(ids joined by spaces, how many, decoded text) of one pre-token."""
        found = self.known.get(piece)
        if found is None:
            chars = [self.byte[b] for b in piece.encode()]
            chars[-1] = chr(ord(chars[-1]) + LAST)
            ids = [self.ids[t] for t in self.encode_symbols("".join(chars))]
            found = (" ".join(map(str, ids)), len(ids), self.decode(ids))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[piece] = found
        return found

    def decode(self, ids: list[int]) -> str:
        shown, offset = self.shown, self.offset
        return " ".join([shown[offset[i] : offset[i + 1]] for i in ids])

    def normal(self, text: str, plain: bool) -> str:
        """Composed and in lower case, without the rule for a final sigma; ``plain`` if all tables agree on the characters."""
        if plain:
            text = unicodedata.normalize("NFC", text)
        else:
            text = "".join(unicodedata.normalize("NFC", x) for x in self.starters.split(text)).translate(self.capitals)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text.isascii():
            return self.quick(text.lower())
        plain = not self.unsure(text)
        text = self.normal(text, plain)
        return self.quick(text) if plain else self.exact(text)

    def encode(self, text: str) -> tuple[str, int, str]:
        """(ids joined by spaces, how many, decoded text) of a whole text."""
        ids, shown, n = [], [], 0
        parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        known, word = self.known, self.word
        for part in parts:
            if part in self.special:
                i = self.special[part]
                found = [(str(i), 1, self.decode([i]))]
            else:
                found = [known.get(p) or word(p) for p in self.pieces(part)]
            ids += [x[0] for x in found]
            n += sum([x[1] for x in found])
            shown += [x[2] for x in found]
        return " ".join(ids), n, " ".join(shown)


@lru_cache(maxsize=2)
def codec(path: str) -> WordBPE:
    return WordBPE(path)


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, text decoded, with ``keep_ids``) for every row.

    Defined results: a null text counts as empty; an empty text has no tokens and the digests of the empty
    string; equal texts give equal rows; an empty table gives an empty table; extra columns are ignored.
    """
    extra = ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            ids, counts, shown, back, digest = [], [], [], [], []
            for text in batch.column(1):
                joined, n, decoded = coder.encode(text.as_py() or "")
                counts.append(n)
                digest.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    ids.append(list(map(int, joined.split())))
                    shown.append(decoded)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(shown, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
