"""Token counts of text sections by offset-mapped attribution.

A document is encoded once, as a whole. A byte-level token's width in bytes is fixed, so running sums of
widths give every token's span exactly, and sections are spans of the same bytes; both lists are sorted, and
the interval join is a merge of them (one binary search per token over whole batches of tokens). Byte order and character
order agree, so joining byte spans joins the character spans.

Sections are the lines of the text (a line break belongs to the line it ends), or named fields, which are encoded as one
text, end to end. A token that crosses into the next section is allocated by RULE: "start" counts it where its first byte
lies, "end" where its last byte lies, "split" shares it by bytes.

The library's pattern engine gives up on very long runs of blanks, so these are cut out by a linear scan first: such
a run, but for a last blank that stands before other text, is one pre-token of the pattern.

Defined results: a null text or field counts as empty; an empty text has one empty section and no tokens; repeated
rows each get a row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE = "start"
RULES = ("start", "end", "split")
#: The published pattern that byte-level vocabularies of this kind were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: The white space of the pattern's engine; runs of so many blanks are cut out.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def pre_cut(text: str) -> Iterator[tuple[str, bool]]:
    """(part, whether it is a single pre-token) of ``text``: long blank runs, and what lies between them."""
    at = 0
    for run in BLANKS.finditer(text):
        a, b = run.span()
        end = b if b == len(text) else b - 1
        yield text[at:a], False
        yield text[a:end], True
        at = end
    yield text[at:], False


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """The encoder of a rank file and the byte width of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        width[i] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), width


def attribute(size: np.ndarray, breaks: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, int]:
    """(tokens per section, tokens that cross a boundary) for token byte widths and sorted section ends."""
    ends = size.cumsum()
    starts = ends - size
    first, last = np.searchsorted(breaks, starts, "right"), np.searchsorted(breaks, ends - 1, "right")
    cross = np.flatnonzero(last > first)
    n = len(breaks) + 1
    if rule != "split":
        return np.bincount(first if rule == "start" else last, minlength=n).astype(float), len(cross)
    out = np.bincount(np.delete(first, cross), minlength=n).astype(float)
    for t in cross.tolist():
        edges = np.concatenate([[starts[t]], breaks[first[t] : last[t]], [ends[t]]])
        out[first[t] : last[t] + 1] += np.diff(edges) / size[t]
    return out, len(cross)


def token_widths(path: str, pattern: str, text: str) -> np.ndarray:
    """The byte widths of the tokens of ``text``, encoded whole. Long runs are cut out for PATTERN, whose pre-tokens
    they are; another pattern meets the text as it is."""
    coder, width = encoder(path, pattern)
    if pattern != PATTERN or len(text) < 4096 or not BLANKS.search(text):
        parts = [coder.encode_to_numpy(text, disallowed_special=())]
    else:
        single = encoder(path, r"(?s:.+)")[0]
        parts = [(single if one else coder).encode_to_numpy(x, disallowed_special=()) for x, one in pre_cut(text) if x]
    return width[np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in parts])] if parts else np.zeros(0, dtype=np.int64)


def count(docs: DataFrame, path: str, rule: str = RULE, pattern: str = PATTERN, fields: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, section_tokens for every row of ``docs``; one section per line of
    ``text``, or per column of ``fields``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sections, crossing, shares = [], [], [], []
            for text, lengths in zip(batch.column(1), batch.column(2), strict=True):
                s = text.as_py() or ""
                size = token_widths(path, pattern, s)
                raw = np.frombuffer(s.encode(), dtype=np.uint8)
                breaks = np.cumsum(lengths.as_py(), dtype=np.int64)[:-1] if fields else np.flatnonzero(raw == 10) + 1
                found, crossed = attribute(size, breaks, len(raw), rule)
                tokens.append(len(size))
                sections.append(len(breaks) + 1)
                crossing.append(crossed)
                shares.append(found)
            cuts = pa.array(np.concatenate([[0], np.cumsum(sections)]).astype(np.int32))
            flat = pa.array(np.concatenate(shares) if shares else np.zeros(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(sections, pa.int64()), pa.array(crossing, pa.int64()), pa.ListArray.from_arrays(cuts, flat)],
                ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
            )

    if fields:
        parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields]
        rows = docs.select(F.col("doc_id").cast("long"), F.concat(*parts).alias("text"), F.array(*map(F.octet_length, parts)).alias("lengths"))
    else:
        rows = docs.select(F.col("doc_id").cast("long"), "text", F.lit(None).cast("array<int>").alias("lengths"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>")
