"""The pipeline's stages against brute force on a small corpus, and one table of edge cases through every stage."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import decontamination, quality_rules, secret_scans
from quernstone.llm.registry import tokenizer_path

STAGES = dict(corpus_pipeline.STAGES)
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n, seed):
    """Documents with copies, junk, repeated lines, planted benchmark items and secrets: (id, text, lang, source)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 12)))) for i in range(8)] + [(8, "tiny")]
    out = []
    for i in range(n):
        text = "\n".join(" ".join(word() for _ in range(rng.randint(6, 14))) + "." for _ in range(rng.randint(3, 8)))
        kind = i % 12
        if kind == 1:
            text = out[rng.randrange(len(out))][1]
        elif kind == 2:
            w = out[rng.randrange(len(out))][1].split(" ")
            w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind == 3:
            text = text + "\n" + ("%%% ### $$$ " * 40)
        elif kind == 4:
            text = (text.split("\n")[0] + "\n") * 9
        elif kind == 5:
            text = text + "\n" + list(items[rng.randrange(8)])[1].upper().replace(" ", ", ", 1)
        elif kind == 6:
            text = text + "\npassword=" + "".join(rng.choices("0123456789abcdef", k=18)) + " end"
        elif kind == 7:
            digits = "".join(rng.choices("123456789", k=15))
            total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
            text = text + f"\ncard {digits}{-total % 10} paid"
        elif kind == 8:
            text = "few words only here"
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", ""])))
    return out, items


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def brute_quality(rows):
    def measure(text):
        t = text or ""
        words = SPACE.findall(t)
        seen, hit = {}, set()
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                hit |= {i + o for i in at for o in range(8)}
        chars = sum(map(len, words))
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        dup = len(lines) - len(set(lines))
        share = lambda a, b: a / b if b else 0.0
        ratios = [
            share(len(re.findall(r"[#*$%&|<>]", t)), chars), share(dup, len(lines)), share(sum(c.isupper() for c in t), chars), share(len(re.findall("[!?]", t)), len(words)), share(chars, len(words)),
        ]
        return len(words) < 20 or 100 * len(hit) > 30 * len(words), dict(zip(quality_rules.RATIOS, ratios, strict=True))

    def step(x):
        for top, size in quality_rules.STEPS:
            if x < top:
                return x // size * size

    measured = [measure(t) for _, t, _, _ in rows]

    def fence(keep, r):
        v = sorted(step(m[1][r]) for m, row in zip(measured, rows, strict=True) if keep(row))
        at = lambda k: v[-(-k * len(v) // 4) - 1]
        return len(v), at(3) + quality_rules.FENCE * max(at(3) - at(1), quality_rules.RATIOS[r])

    drawn = lambda own, wider: (own[0] * own[1] + quality_rules.SHRINK * wider) / (own[0] + quality_rules.SHRINK)
    kept = []
    for (bad, m), row in zip(measured, rows, strict=True):
        limit = {r: drawn(fence(lambda x, row=row: x[2:] == row[2:], r), drawn(fence(lambda x, row=row: x[2] == row[2], r), fence(lambda x: True, r)[1])) for r in m}
        if not bad and all(m[r] <= limit[r] for r in m):
            kept.append(row)
    return kept


def brute_distinct(rows):
    sets = {}
    for i, t, *_ in rows:
        w = SPACE.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def distance_within(item, text):
    row, best = list(range(len(item) + 1)), len(item)
    for c in text:
        above, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            above, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, above + (x != c))
        best = min(best, row[-1])
    return best


def brute_clean(rows, items):
    norm = lambda x: re.sub(r"[\W_]+", " ", (x or "").lower()).strip()

    def holds(text, item):
        k = len(item) // decontamination.CHARS_PER_EDIT
        return distance_within(item, text) <= k if k else f" {item} " in f" {text} "

    return [r for r in rows if not any(holds(norm(r[1]), norm(t)) for _, t in items)]


@pytest.fixture(scope="module")
def made():
    return corpus(160, 21)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_quality_stage_by_brute_force(spark, made):
    rows, _ = made
    want = sorted(r[0] for r in brute_quality(rows))
    assert ids(STAGES["quality_rules"](spark, frame(spark, rows), "")) == want and 20 < len(want) < len(rows) - 10


def test_near_duplicate_stage_by_brute_force(spark, made):
    rows, _ = made
    want = sorted(r[0] for r in brute_distinct(rows))
    assert ids(STAGES["near_duplicates"](spark, frame(spark, rows), "")) == want and len(want) < len(rows) - 10


def test_decontamination_stage_by_brute_force(spark, made, tmp_path):
    rows, items = made
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted(r[0] for r in brute_clean(rows, items))
    assert ids(STAGES["decontamination"](spark, frame(spark, rows), str(tmp_path))) == want and len(rows) - 40 < len(want) < len(rows) - 8


def test_secret_stage_by_brute_force(spark, made):
    """Every planted password goes, every card number and all other text stays."""
    rows, _ = made
    got = {r["doc_id"]: r for r in STAGES["secret_scans"](spark, frame(spark, rows), "").collect()}
    masked = 0
    for i, text, *_ in rows:
        want = re.sub(r"(?<=password=)[0-9a-f]{18}", secret_scans.MASK, text)
        masked += want != text
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    assert masked > 8


def test_bpe_stage_by_the_library(spark, made):
    from tokenizers import Tokenizer

    rows, _ = made
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in STAGES["bpe"](spark, frame(spark, rows), "").collect()}
    for i, text, *_ in rows:
        found = tok.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(found) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()


def test_run_is_the_stages_in_a_row(spark, made, tmp_path):
    """run() over a table of its own equals the brute-force stages one after another."""
    rows, items = made
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute_clean(brute_distinct(brute_quality(rows)), items)
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == sorted(r[0] for r in want)


CLASH = [
    "lang_key", "source_key", "limits", "metrics", "metrics_", "own_id", "own_id_", "gone_id", "secrets", "normal_text", "features", "probability", "component", "value", "place", "text_", "__q", "__limits", "__id", "__gone", "__normal",
]


def test_every_stage_takes_edge_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeats, null ids and clashing names: columns and defined rows survive each stage."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30_000))
    fine = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    made = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t", "en", None), (4, long, "en", "s"), (5, fine, None, "s"), (5, fine, None, "s"), (None, fine + " more", "en", "s"), (6, " " * 300_000, "", "s"), (7, "x" * 300_000, "en", "s")]
    df = frame(spark, made)
    for c in CLASH:
        df = df.withColumn(c, F.lit(1))
    odd = {"a.b": F.lit("dotted"), "c 1": F.lit(2), "a map": F.create_map(F.lit("k"), F.col("doc_id")), "deep": F.array(F.struct(F.create_map(F.lit(1), F.lit("x")).alias("m.n"))), "any": F.parse_json(F.lit('{"a": 1}')), "when": F.current_date()}
    df = df.withColumns(odd)
    spark.createDataFrame([(1, None), (2, "no such item anywhere here"), (2, "no such item anywhere here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"quality_rules": 4, "near_duplicates": 8, "decontamination": 9, "secret_scans": 9, "bpe": 9}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != "bpe":
            assert out.columns == df.columns, name
        assert out.count() == want[name], name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name


def test_rows_without_an_id_keep_their_secrets_apart(spark):
    """A password in one row is an ordinary word in another one with a null or the same id."""
    rows = [(None, "password=hunter2abc now"), (None, "the word hunter2abc is plain"), (3, "password=hunter3abc now"), (3, "the word hunter3abc is plain"), (None, "password=hunter2abc now")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["text"] for r in STAGES["secret_scans"](spark, df, "").collect())
    assert got == sorted(["password=[SECRET] now"] * 3 + ["the word hunter2abc is plain", "the word hunter3abc is plain"])


def test_pieces_that_many_items_share():
    """2,000 items with one piece in common, and a text that repeats it: quick, small, and no item is lost."""
    import time

    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    items = [(i, " ".join([word(11), "sharedpiece", *[word(11) for _ in range(5)]])) for i in range(2000)]
    matcher = decontamination.Matcher(items, 12)
    text = " ".join("sharedpiece " + word(5) for _ in range(55_000))
    began = time.perf_counter()
    assert matcher.find(text) == []
    held = text[:500_000] + " " + items[7][1].replace("a", "b", 1) + " " + text[500_000:] + " " + items[9][1]
    assert {(i, d) for i, d, _, _ in matcher.find(held)} == {(7, 1), (9, 0)}
    assert time.perf_counter() - began < 30


def test_run_on_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
