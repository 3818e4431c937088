"""License scans by a positional index over rare licence words.

The templates' words form a bounded vocabulary. One pass counts in how many documents each of its words
occurs; a template of L words that tolerates e wrong ones is then posted under its e + 1 rarest positions
only, so by the pigeonhole principle every acceptable placement shows one of them. The second pass looks
up those high-IDF words in each file, turns hit position minus template position into the placement's
start, and checks each start against the whole template and its mandatory key phrase, which must match
word for word. Both passes stay within a row: no text is shuffled, and a document's memory is its own length.

Base phrases are templates that tolerate nothing. Defined results: a null text counts as empty; an empty
text has no words, null first and last word, empty labels and score 0; repeated documents each get their
row; all acceptable placements count, overlapping ones too; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.text import ascii_lower, let, words_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Fixed texts of public licence notices: (label, notice, mandatory key phrase)
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    ("apache-2", "spdx license identifier apache 2 0", "spdx license identifier apache"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "has waived all copyright"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
#: Share of a notice's words that may differ.
TOLERANCE = 0.2


def templates() -> list[dict]:
    out = [{"label": v, "words": k.split(), "wrong": 0, "key": (0, len(k.split())), "base": True} for k, v in BASE.items()]
    for label, notice, key in NOTICES:
        words, must = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        out.append({"label": label, "words": words, "wrong": int(TOLERANCE * len(words)), "key": (at, at + len(must)), "base": False})
    return out


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary occurs; at most one row per such word is collected."""
    found = F.filter(F.col("w"), lambda x: x.isin(vocabulary))
    seen = docs.select(words_of(ascii_lower(F.col("text")), WORD).alias("w")).select(F.explode(F.array_distinct(found)).alias("word"))
    return {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}


def postings(kinds: list[dict], frequency: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """word -> [(template, position)] for the rarest ``wrong + 1`` positions of each template."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, kind in enumerate(kinds):
        rarest = sorted(range(len(kind["words"])), key=lambda i: (frequency.get(kind["words"][i], 0), kind["words"][i], i))
        for i in rarest[: kind["wrong"] + 1]:
            out.setdefault(kind["words"][i], []).append((t, i))
    return out


def _lookup(kinds: list[dict], index: dict[str, list[tuple[int, int]]]) -> Column:
    """array<struct<t, at, same>> of the acceptable placements in the word array ``w``."""
    posted = F.create_map(*[x for word, at in index.items() for x in (F.lit(word), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in at]))])
    texts = F.array(*[F.array(*[F.lit(x) for x in k["words"]]) for k in kinds])
    need = F.array(*[F.lit(len(k["words"]) - k["wrong"]) for k in kinds])
    key = F.array(*[F.array(F.lit(k["key"][0]), F.lit(k["key"][1] - k["key"][0])) for k in kinds])
    anchors = list(index)

    def placements(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h["x"].isin(anchors))
        starts = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(posted, h["x"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["i"]).alias("at")))))

        def checked(c: Column) -> Column:
            same = F.size(F.filter(F.transform(F.get(texts, c["t"]), lambda x, j: F.get(w, c["at"] + j).eqNullSafe(x)), lambda ok: ok))
            k = F.get(key, c["t"])
            must = F.forall(F.transform(F.slice(F.get(texts, c["t"]), k[0] + 1, k[1]), lambda x, j: F.get(w, c["at"] + k[0] + j).eqNullSafe(x)), lambda ok: ok)
            return F.struct(c["t"].alias("t"), c["at"].alias("at"), same.alias("same"), must.alias("must"))

        judged = F.transform(F.array_distinct(starts), checked)
        return F.filter(judged, lambda c: c["must"] & (c["same"] >= F.get(need, c["t"])))

    return placements


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document."""
    kinds = templates()
    vocabulary = sorted({x for k in kinds for x in k["words"]})
    index = postings(kinds, document_frequency(docs, vocabulary))
    find = _lookup(kinds, index)
    labels = F.array(*[F.lit(k["label"]) for k in kinds])
    sizes = F.array(*[F.lit(float(len(k["words"]))) for k in kinds])
    n_base = sum(k["base"] for k in kinds)  # base templates come first
    empty = F.array().cast("array<struct<t:int,at:int,same:int,must:boolean>>")

    def row(w: Column) -> Column:
        found = F.when(F.exists(w, lambda x: x.isin(list(index))), find(w)).otherwise(empty)
        return F.struct(F.size(w).cast("long").alias("n_words"), found.alias("found"))

    def result(r: Column) -> Column:
        base = F.filter(r["found"], lambda c: c["t"] < n_base)
        named = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda c: F.get(labels, c["t"])))), ",")
        at = F.transform(base, lambda c: c["at"].cast("long"))
        best = F.array_max(F.transform(r["found"], lambda c: c["same"] / F.get(sizes, c["t"])))
        return F.struct(
            r["n_words"].alias("n_words"),
            F.size(base).cast("long").alias("n_base"),
            F.array_min(at).alias("first_word"),
            F.array_max(at).alias("last_word"),
            named(base).alias("base_labels"),
            named(r["found"]).alias("labels"),
            F.coalesce(best, F.lit(0.0)).alias("score"),
        )

    words = words_of(ascii_lower(F.col("text")), WORD)
    return docs.select("doc_id", let(let(words, row), result).alias("r")).select("doc_id", "r.*")
