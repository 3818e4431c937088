"""Secret scans: candidate strings, judged by a random forest trained on labelled findings.

Candidates are the key runs of words, wherever they stand in them: issued keys, long runs of key characters with a
digit, or shorter ones that are assigned to a name such as password or token. The forest sees what a candidate looks like
and where it stands: its length, shares and transitions of character classes, distinct characters, coverage by a dictionary,
path marks, and its neighbouring words. It alone decides, and so removes the false positives, such as card numbers, ids in paths and
placeholders.

Labelled findings come as a table (doc_id, place, label; nth too, to tell the runs of a word apart), or are drawn from the candidates by
``decisive``, from evidence that the forest does not see: issued key formats and values assigned to secret names are positive;
numbers with a card's check digit, runs within addresses and names of other values are negative; others stay unlabelled. At most MAX_FIT
of each label, by hash order, train the forest; a fifth of all values, by hash, is held out from it (``held_out`` reports on it).
Everything else covers all rows. Scanning, features and the forest's prediction run in the JVM.

The dictionary are the corpus's own words: those of 3 to 12 letters that at least MIN_DOCS documents hold, looked up for the letter
runs of the candidates only. Only documents that a first pattern passes are split into words for candidates, each within its row, so no text is shuffled.

Defined results: a null text counts as empty; documents without candidates have no rows; a null doc_id
is reported as such; repeated rows are reported once each; without labelled findings of both kinds no forest can be fitted, and all
candidates take the rules' own verdict (probability 1 for positives, else 0); an empty table gives an empty table; extra columns, whatever
their names, are ignored, or kept by ``redact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.text import ascii_lower, fresh, let
from quernstone.plans.durable import durable, join_small

MASK = "[SECRET]"
MAX_FIT = 4_000
TREES, DEPTH, SEED = 20, 6, 20240229
THRESHOLD = 0.5
#: Names that secrets are assigned to, and issued key prefixes.
NAMES = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
KEYS = r"(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abpr]-[0-9A-Za-z-]{10,}|sk-[0-9A-Za-z]{20,}|AIza[0-9A-Za-z_-]{35})"
ISSUED = rf"^{KEYS}$"
#: A dictionary word's letters, and the documents that must hold it.
WORD_LETTERS = (3, 12)
MIN_DOCS = 5
HELD_OUT = 5  # one value in so many is kept from training
#: Words of placeholders.
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|changeme"
RUN = r"[A-Za-z0-9_+/\-]"
VALUE = rf"{RUN}{{8,}}=*"
KEY = rf"(?<![0-9A-Za-z]){KEYS}(?![0-9A-Za-z])"
#: Separators of a name and its value; a closing colon and the padding of base64 are none.
SEPARATOR = r"(?:=+|:)(?!=*[\"'`]*(?:$|[;,.)\]}>&|]|</))"
USERINFO = r"://[^/@\s]*:[^/@\s]+@"
ADDRESS = rf"{RUN}@[\w.-]+\.[A-Za-z]{{2,}}"
#: A superset of the candidate rule, over whole texts: a long run with a digit, a name before a separator in its word
#: or the next, access data in an address, an issued key.
MAYBE = rf"(?<!{RUN})(?=[A-Za-z_+/\-]*[0-9])(?=[A-Za-z0-9_+/=\-]{{16}}){RUN}{{8,}}|{NAMES}[^\s=:]*(?:\s+[^\s=:]*)?[=:]|{USERINFO}|{KEY}"
FEATURES = [
    "length", "digits", "uppers", "lowers", "transitions", "distinct", "dictionary", "path_marks", "plain_before", "plain_after",
]


def _in_word(x: Column, before2: Column, before: Column) -> Column:
    """Every key run of a word, in order within its part: value, and whether it is assigned, named, aside, or marked
    as part of a path or an address. Parts lie between separators, so a value's name is the part before
    its own; work and rows are linear in the word."""
    access = x.rlike(USERINFO)
    url = x.rlike("://|@")
    introduced = before.rlike("[=:]$")
    named_by_words = F.concat_ws(" ", before2, before).rlike(NAMES)

    def part(parts: Column, s: Column, j: Column) -> Column:
        rest = F.regexp_replace(s, KEY, " ")
        keyed = F.concat(F.regexp_extract_all(s, F.lit(KEY), F.lit(0)), F.regexp_extract_all(rest, F.lit(VALUE), F.lit(0)))
        values = F.when(s.rlike(KEY), keyed).otherwise(F.regexp_extract_all(s, F.lit(VALUE), F.lit(0)))
        first, more = j == 0, j < F.size(parts) - 1
        link = ~first & s.startswith("//")
        address = s.rlike(ADDRESS) & ~access
        assigned = F.when(first, introduced & ~more).otherwise(~link) & ~address
        named = F.when(first, named_by_words | s.rlike(NAMES)).otherwise(~link & (F.get(parts, j - 1).rlike(NAMES) | access))
        marked = link | address | F.regexp_replace(rest, VALUE, " ").rlike(r"[/\\].*[/\\]|@|\.[a-z]{2,4}[\"'`;,.)\]>]*$")
        # a run right before a separator is the name of the next value
        name = more & F.when(first, rest.rlike(rf"{RUN}{{8}}[\"'`]*$")).otherwise(rest.rlike(rf"[,;&{{?|][\"'`]*{RUN}{{8,}}[\"'`]*$"))
        flags = F.struct(assigned.alias("assigned"), named.alias("named"), marked.alias("marked"), name.alias("name"))

        def each(v: Column, f: Column, k: Column, n: Column) -> Column:
            own = ~(f["name"] & (k == n - 1))
            a, b = f["assigned"] & own, f["named"] & own
            marks = f["marked"] | v.rlike("/.*/")
            return F.struct(v.alias("value"), a.alias("assigned"), b.alias("named_before"), marks.alias("path_marks"), (~own | (url & ~b)).alias("aside"))

        return let(values, lambda vs: let(flags, lambda f: F.transform(vs, lambda v, k: each(v, f, k, F.size(vs)))))

    return let(F.split(x, SEPARATOR), lambda parts: F.flatten(F.transform(parts, lambda s, j: part(parts, s, j))))


def candidates(docs: DataFrame, prefilter: str = MAYBE) -> DataFrame:
    """For every candidate: doc_id, text_key (a hash of its whole text), place, nth (number of its key run in the word, from 0), value, and flags of its
    word and neighbours: assigned, named_before, path_marks, aside (unnamed in a URL, or itself the name of a value), plain_before, plain_after.
    ``prefilter`` passes every text that holds one; it only saves the splitting of the others."""
    plain = lambda c: c.rlike(r"^\p{L}+[.,]?$")

    def found(w: Column) -> Column:
        def look(x: Column, i: Column) -> Column:
            before, before2 = F.coalesce(F.get(w, i - 1), F.lit("")), F.coalesce(F.get(w, i - 2), F.lit(""))
            after = F.coalesce(F.get(w, i + 1), F.lit(""))
            named = x.rlike(NAMES + r"[^=:]*[=:]") | (before.rlike("[=:]$") & (F.concat(before2, F.lit(" "), before).rlike(NAMES))) | x.rlike(USERINFO)

            def kept(short: Column) -> Column:
                def row(c: Column, k: Column) -> Column:
                    v = c["value"]
                    good = v.rlike(ISSUED) | (v.rlike("[0-9]") & ((F.length(v) >= 16) | short))
                    flags = [c[f].alias(f) for f in ("assigned", "named_before", "path_marks", "aside")]
                    near = [plain(before).alias("plain_before"), plain(after).alias("plain_after")]
                    return F.when(good, F.struct(i.cast("long").alias("place"), k.cast("long").alias("nth"), v.alias("value"), *flags, *near))

                return F.filter(F.transform(_in_word(x, before2, before), row), lambda c: c.isNotNull())

            return F.when(x.rlike(f"{KEY}|{RUN}{{8}}") & (x.rlike("[0-9]") | x.rlike(KEY)), let(named, kept))

        return F.flatten(F.filter(F.transform(w, look), lambda c: c.isNotNull()))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(prefilter))
    words = F.split("text", r"\s+")
    return rows.select("doc_id", F.sha2("text", 256).alias("text_key"), F.explode(let(words, found)).alias("c")).select("doc_id", "text_key", "c.*")


def letter_runs(value: Column) -> Column:
    """All parts of WORD_LETTERS letters of the value's letter runs, lower-cased: array of (at, size, word). Linear in the value."""
    low, (least, most) = ascii_lower(value), WORD_LETTERS
    part = lambda i: F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.struct(i.alias("at"), k.alias("size"), F.substring(low, i, k).alias("word")))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length(value) - least + 1), part))
    return F.when(F.length(value) >= least, F.filter(parts, lambda p: (F.length(p["word"]) == p["size"]) & p["word"].rlike("^[a-z]+$")))


def coverage(values: DataFrame, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(value, dictionary): the share of each distinct value's characters that lies in words of the corpus."""
    least, most = WORD_LETTERS
    parts = durable(values.select("value").distinct().select("value", F.explode(letter_runs(F.col("value"))).alias("p")).select("value", "p.*"), narrow=True)
    asked = parts.select("word").distinct()
    low = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])[a-z]{{{least},{most}}}(?![\p{{L}}\p{{N}}_])"), F.lit(0)))
    dictionary = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    known = durable(dictionary.join(asked, "word", "left_semi").select("word"), narrow=True)
    spans = join_small(parts, known, ["word"], "inner").groupBy("value").agg(F.array_sort(F.collect_set(F.struct("at", "size"))).alias("spans"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(x["at"], a["end"]))).alias("n"), F.greatest(a["end"], x["at"] + x["size"]).alias("end")
    )
    return spans.select("value", (F.aggregate("spans", start, step)["n"] / F.length("value")).alias("dictionary"))


def with_features(found: DataFrame, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``found`` with the FEATURES, as doubles."""
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    columns = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "transitions": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "dictionary": F.coalesce("dictionary", F.lit(0.0)),
        **{c: F.col(c).cast("double") for c in ("path_marks", "plain_before", "plain_after")},
    }
    return join_small(found, durable(coverage(found, docs, min_docs), narrow=True), ["value"]).withColumns(columns)


def card_number(value: Column) -> Column:
    """Whether 13 to 19 digits, hyphens aside, carry a card number's check digit."""
    digits = F.split(F.reverse(F.regexp_replace(value, "-", "")), "")
    double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.transform(digits, lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)
    return F.when(value.rlike("^[0-9][0-9-]{11,22}[0-9]$"), total % 10 == 0).otherwise(False)


def decisive() -> Column:
    """1 or 0 where evidence outside the FEATURES decides a finding's label, else null."""
    issued = F.col("value").rlike(ISSUED)
    named = F.col("assigned") & F.col("named_before")
    fake = F.col("value").rlike(PLACEHOLDER)
    return F.when(fake, 0).when(issued | named, 1).when(F.col("aside") | card_number(F.col("value")), 0)


def labelled_findings(found: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``found`` with a label, 1 or 0, where one is known."""
    if labelled is None:
        known = found.withColumn("label", decisive().cast("double"))
    else:
        keys = ["doc_id", "place", *(["nth"] if "nth" in labelled.columns else [])]
        known = found.join(labelled.select(*keys, F.col("label").cast("double").alias("label")), keys, "left")
    return known.where("label is not null").withColumn("held_out", F.pmod(F.xxhash64("value", F.lit(SEED)), F.lit(HELD_OUT)) == 0)


def features(docs: DataFrame) -> DataFrame:
    """Every candidate with its FEATURES, written once."""
    return durable(with_features(durable(candidates(docs), narrow=True), docs), narrow=True)


def judge(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with probability: the share of the forest's vote; the forest sees the FEATURES of ``known`` that are not held out."""
    keys = [F.xxhash64("value", "doc_id", "place", "nth"), "value", "doc_id", "place", "nth"]
    part = lambda y: known.where((F.col("label") == y) & ~F.col("held_out")).orderBy(*keys).limit(MAX_FIT)
    sample = durable(reduce(DataFrame.union, [part(1.0), part(0.0)]).select("label", *FEATURES))
    if sample.select("label").distinct().count() < 2:
        return found.withColumn("probability", F.coalesce(decisive(), F.lit(0)).cast("double"))
    pack = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    model = forest.fit(pack.transform(sample.coalesce(1)))
    return model.transform(pack.transform(found)).withColumn("probability", F.round(vector_to_array("probability")[1], 9))


def judged(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate with its text_key, features, probability and is_secret."""
    found = features(docs)
    return judge(found, labelled_findings(found, labelled)).withColumn("is_secret", F.col("probability") > THRESHOLD)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, place, nth, value, probability, is_secret for every candidate."""
    return judged(docs, labelled).select("doc_id", "place", "nth", "value", "probability", "is_secret")


def held_out(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """label, is_secret, n: the forest's verdicts on the labelled findings that it has not seen. Without the forest every candidate
    is a finding, so the rows of label 0 are what it removes."""
    found = features(docs)
    known = durable(labelled_findings(found, labelled))
    judged = judge(known.where("held_out"), known)
    return judged.groupBy("label", (F.col("probability") > THRESHOLD).alias("is_secret")).agg(F.count("*").alias("n"))


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by MASK; other columns unchanged but for n_chars, which
    follows the text. Secrets are looked for in the text that holds them: rows without an id, or with the same one, do not share theirs.
    Documents that the first pattern passes by are not joined with anything."""
    secrets, own, key = fresh(docs, "secrets", "own_id", "text_key")
    found = judged(docs, labelled).where("is_secret").groupBy(F.col("doc_id").alias(own), F.col("text_key").alias(key)).agg(F.collect_set("value").alias(secrets))
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    bad = durable(found, narrow=True)
    hit = docs.where(maybe).join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.sha2("text", 256) == F.col(key)), "left")
    longest = F.array_sort(F.transform(secrets, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))
    clean = F.when(F.col(secrets).isNull(), F.col("text")).otherwise(F.aggregate(longest, F.col("text"), lambda t, s: F.replace(t, s["s"], F.lit(MASK))))
    rows = hit.withColumn("text", clean)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(secrets).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return docs.where(~maybe).unionByName(rows.select(*[F.col(f"`{c}`") for c in docs.columns]))
