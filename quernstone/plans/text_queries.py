"""Row-level text, URL, HTML and rule queries over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as t
from quernstone.operators import dedup as d
from quernstone.plans.dedup_queries import ART_SQL, HASH_SQL
from quernstone.sources import markup
from quernstone.sources.tables import table

TRACK = "|".join(t.TRACKING)
URL_SQL = rf"""u AS (SELECT page_id, trim(coalesce(url, '')) AS u FROM pages),
p AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS net,
  regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path0, regexp_extract(u, '\?([^#]*)', 1) AS query, regexp_extract(u, '#(.*)$', 1) AS fragment FROM u),
q AS (SELECT *, lower(net) AS low, regexp_matches(lower(net), '^(m|amp)\.[^.]*\..') AS mobile, regexp_replace(CASE WHEN path0 = '' THEN '/' ELSE path0 END, '/{{2,}}', '/', 'g') AS path1, list_filter(string_split(query, '&'), lambda x: x <> '') AS params FROM p),
r AS (SELECT *, CASE WHEN mobile THEN regexp_replace(low, '^(m|amp)\.', '') ELSE low END AS bare, regexp_matches(path1, '(?i)[/.]amp$') AS amp, list_filter(params, lambda x: NOT regexp_matches(lower(regexp_extract(x, '^([^=]*)', 1)), '^utm_|^({TRACK})$')) AS kept FROM q),
s AS (SELECT *, regexp_replace(bare, ':(80|443)$', '') AS host, CASE WHEN amp THEN CASE WHEN regexp_replace(path1, '(?i)[/.]amp$', '') = '' THEN '/' ELSE regexp_replace(path1, '(?i)[/.]amp$', '') END ELSE path1 END AS path2, list_sort(kept) AS ordered FROM r),
c AS (SELECT page_id, CASE WHEN scheme <> '' AND net <> '' THEN (CASE WHEN scheme = 'http' THEN 'https' ELSE scheme END) || '://' || host || (CASE WHEN length(path2) > 1 AND ends_with(path2, '/') THEN coalesce(nullif(regexp_replace(path2, '/+$', ''), ''), '/') ELSE path2 END) || (CASE WHEN len(kept) > 0 THEN '?' || array_to_string(ordered, '&') ELSE '' END) ELSE '' END AS canonical,
  CASE WHEN scheme <> '' AND net <> '' THEN array_to_string(list_filter([CASE WHEN scheme = 'http' THEN 'scheme_https' END, CASE WHEN net <> low THEN 'host_lowercased' END, CASE WHEN mobile THEN 'mobile_host' END, CASE WHEN host <> bare THEN 'default_port' END, CASE WHEN path1 <> CASE WHEN path0 = '' THEN '/' ELSE path0 END THEN 'slashes_collapsed' END,
   CASE WHEN amp THEN 'amp_path' END, CASE WHEN length(path2) > 1 AND ends_with(path2, '/') THEN 'trailing_slash' END, CASE WHEN fragment <> '' THEN 'fragment_removed' END, CASE WHEN len(kept) < len(params) THEN 'tracking_params' END, CASE WHEN kept <> ordered THEN 'params_sorted' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS transforms FROM s)"""


def art(spark, base):
    return d.articles(table(spark, base, "documents"))


def urls(spark, base):
    return table(spark, base, "pages").select("page_id", "html", t.canonical_url(F.col("url")).alias("c")).select("page_id", "html", "c.*")


def url_canonicalise(spark, base):
    return urls(spark, base).select("page_id", "canonical", "transforms")


def url_groups(spark, base):
    """Pages by canonical URL: unique, same content, changed content, or variant with changed content."""
    u = urls(spark, base).select("page_id", "canonical", F.col("transforms").rlike("mobile_host|amp_path|wayback").alias("variant"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("h"))
    g = u.where("canonical <> ''").groupBy("canonical").agg(F.count("*").alias("pages"), F.count_distinct("h").alias("bodies"), F.some("variant").alias("variant"))
    kind = F.when(F.col("pages") == 1, "unique_url").when(F.col("bodies") == 1, "same_url_same_content").when(F.col("variant"), "url_variant_probable_same_page").otherwise("same_url_content_changed")
    return g.select(F.concat(F.lit("URL-"), F.substring(F.sha2("canonical", 256), 1, 12)).alias("group_id"), "pages", "bodies", kind.alias("kind"))


def html_title_meta(spark, base):
    """Title, language and link count by patterns only."""
    h = F.coalesce(F.col("html"), F.lit(""))
    return table(spark, base, "pages").select(
        "page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_count(h, F.lit("<a href=")).cast("long").alias("links"), F.regexp_count(h, F.lit("<p>")).cast("long").alias("paragraphs"),
    )


def html_clean(spark, base):
    """Pages as clean text, with what looked like furniture and stayed."""
    out = markup.cleaned(table(spark, base, "pages"), "page_id", "html", ("main article",))
    return out.select("page_id", "title", "body", F.size("captions").alias("captions"), "selector", "status", F.array_join("warnings", ",").alias("warnings"), F.size("kept").alias("kept"), "removed_ratio")


def char_normalise(spark, base):
    """Invisible and odd characters replaced, with counts of each kind."""
    x = F.coalesce(F.col("text"), F.lit(""))
    kinds = {"nbsp": " ", "zero_width": "[​‌﻿]", "replacement": "�", "control": "[\\x00-\\x08\\x0e-\\x1f]", "entity": "&(?:amp|lt|gt|quot|nbsp);"}
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, kinds["nbsp"], " "), kinds["zero_width"], ""), kinds["control"], "")
    out = F.replace(F.replace(F.replace(out, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return table(spark, base, "documents").select("doc_id", F.sha2(out, 256).alias("digest"), *[F.regexp_count(x, F.lit(p)).cast("long").alias(k) for k, p in kinds.items()])


def structure_flags(spark, base):
    """Paragraph counts and structure warnings."""
    p = F.filter(F.transform("paragraphs", lambda x: F.trim(x)), lambda x: x != "")
    a = art(spark, base).select("doc_id", p.alias("p"))
    dup = F.size("p") - F.size(F.array_distinct("p"))
    flags = F.filter(F.array(F.when(dup > 0, "duplicate_paragraphs"), F.when(F.size("p") == 1, "single_block"), F.when(F.exists("p", lambda x: F.length(x) > 2000), "very_long_paragraph")), lambda x: x.isNotNull())
    return a.select("doc_id", F.size("p").cast("long").alias("paragraphs"), dup.cast("long").alias("duplicates"), F.array_join(flags, ",").alias("flags"))


def language_evidence(spark, base):
    """Function-word shares per language and the leading language; a null lead without evidence."""
    a = table(spark, base, "documents").select("doc_id", "lang", t.language_scores(t.tokens(F.col("text"))).alias("s"))
    best = F.greatest(*[F.col(f"s.{k}") for k in t.LANGUAGE_WORDS])
    lead = F.coalesce(*[F.when((best > 0) & (F.col(f"s.{k}") == best), k) for k in t.LANGUAGE_WORDS])
    return a.select("doc_id", *[F.col(f"s.{k}").alias(f"share_{k}") for k in t.LANGUAGE_WORDS], lead.alias("lead"), (lead == F.col("lang")).alias("agrees"))


def _quality():
    w = F.size(F.filter(F.split("body", r"\s+"), lambda x: x != ""))
    shell = F.substring("body", 1, 200).rlike("(?i)(just a moment|access denied|page not found|enable javascript)")
    return F.when(F.trim("body") == "", "missing_body").when(shell, "unusable_text").when(w < 25, "near_empty").when(w < 80, "short_article").when(~F.trim("body").rlike(r"[.!?\"')]$"), "truncated").otherwise("usable")


QUALITY_SQL = r"""CASE WHEN trim(body) = '' THEN 'missing_body' WHEN regexp_matches(substr(body, 1, 200), '(?i)(just a moment|access denied|page not found|enable javascript)') THEN 'unusable_text' WHEN w < 25 THEN 'near_empty' WHEN w < 80 THEN 'short_article' WHEN NOT regexp_matches(trim(body), '[.!?"'')]$') THEN 'truncated' ELSE 'usable' END"""
W_SQL = r"len(list_filter(regexp_split_to_array(body, '[ \t\n\v\f\r]+'), lambda x: x <> ''))"


def quality_status(spark, base):
    return art(spark, base).select("doc_id", _quality().alias("status"))


def boundary_fields(spark, base):
    """Title, byline and body told apart: a short first line without end mark is a title."""
    title = F.when((F.length("title") <= 120) & ~F.col("title").rlike(r"[.!?]$"), F.col("title")).otherwise("")
    by = F.regexp_extract("body", r"(?m)^(?:By|Par|Von|Por) ([^\n]{1,60})$", 1)
    return art(spark, base).select("doc_id", title.alias("title"), by.alias("byline"), F.length("body").cast("long").alias("body_chars"))


def eligibility_first_failure(spark, base):
    """The first rule that fails decides; passing all means review, never automatic acceptance."""
    x = d.exact_duplicates(art(spark, base)).join(art(spark, base).select("doc_id", "lang", "body", _quality().alias("quality")), "doc_id")
    code = F.when(F.col("quality").isin("missing_body", "unusable_text"), "E1_no_text").when(F.col("lang") != "en", "E2_language").when(F.col("status") == "exact_duplicate", "E3_duplicate").when(F.col("quality") == "near_empty", "E4_too_short").otherwise("")
    return x.select("doc_id", code.alias("code"), F.when(code == "", "review").otherwise("excluded").alias("status"))


ALIASES = [("licence", "licensed under", 0, 10**9), ("licence", "released under", 0, 10**9), ("address", "example", 0, 500), ("address", "mail", 500, 10**9), ("secret", "password", 0, 10**9)]


def alias_match(spark, base):
    """Documents that contain an alias valid at their position in time (doc_id stands for it); longest alias wins."""
    dim = spark.createDataFrame(ALIASES, "entity string, alias string, valid_from long, valid_to long")
    low = table(spark, base, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    hit = low.join(F.broadcast(dim), F.contains(F.col("t"), F.col("alias")) & (F.col("doc_id") >= F.col("valid_from")) & (F.col("doc_id") < F.col("valid_to")))
    return hit.groupBy("doc_id", "entity").agg(F.max_by("alias", F.struct(F.length("alias"), F.col("alias"))).alias("alias"))


def date_resolution(spark, base):
    """Date evidence per document parsed in three forms, graded by agreement."""
    i = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 28).cast("int"))
    other = F.date_add(F.lit("2024-01-01").cast("date"), ((i + F.when(i % 5 == 0, 1).otherwise(0)) % 28).cast("int"))
    ev = F.array(day.cast("string"), F.concat(F.date_format(other, "yyyyMMdd"), F.lit("120000")), F.when(i % 3 == 0, F.lit("soon")))
    x = table(spark, base, "documents").select("doc_id", F.filter(F.transform(ev, lambda v: t.parsed_time(v)["ts"].cast("date")), lambda v: v.isNotNull()).alias("d"))
    n = F.size(F.array_distinct("d"))
    return x.select("doc_id", F.size("d").cast("long").alias("evidence"), F.when(n == 1, F.array_min("d").cast("string")).alias("day"), F.when(n == 1, "confirmed").when(n > 1, "conflict").otherwise("missing").alias("grade"))


def number_parse(spark, base):
    """Numbers out of formatted text."""
    c = table(spark, base, "customer").select("c_custkey", F.concat(F.format_number("c_acctbal", 2), F.when(F.col("c_custkey") % 3 == 0, " %").otherwise(F.when(F.col("c_custkey") % 7 == 0, " n/a").otherwise(""))).alias("raw"))
    return c.select("c_custkey", F.round(t.number_of(F.col("raw")), 2).alias("value"))


def json_fence_parse(spark, base):
    """Fenced JSON answers parsed leniently; broken ones give null and a status."""
    raw = F.concat(F.lit("```json\n"), F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 5)).otherwise(F.col("props")), F.lit("\n```"))
    body = F.trim(F.regexp_replace(raw, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    k = F.from_json(body, "k long")["k"]
    return table(spark, base, "events").select("event_id", k.alias("k"), F.when(k.isNull(), "invalid").otherwise("ok").alias("status"))


def evidence_spans(spark, base):
    """Claimed spans checked against the body: right offsets, found elsewhere, or not found."""
    a = art(spark, base).select("doc_id", "body").where("length(body) > 60")
    c = a.select("doc_id", "body", F.substring("body", 11, 20).alias("span"), (10 + F.when(F.col("doc_id") % 4 == 0, 3).otherwise(0)).alias("start")).withColumn("span", F.when(F.col("doc_id") % 9 == 0, F.lit("not in any body ☃")).otherwise(F.col("span")))
    ok = F.expr("substring(body, start + 1, length(span)) = span")
    return c.select("doc_id", F.when(ok, "exact").when(F.expr("instr(body, span) > 0"), "moved").otherwise("missing").alias("verdict"))


def name_key(spark, base):
    """Names as matching keys: comma order turned, case and punctuation dropped."""
    n = table(spark, base, "part").select("p_partkey", F.concat(F.upper("p_brand"), F.lit(", "), F.col("p_name")).alias("n"))
    turned = F.concat_ws(" ", F.trim(F.split("n", ",")[1]), F.trim(F.split("n", ",")[0]))
    return n.select("p_partkey", F.trim(F.regexp_replace(F.lower(turned), "[^a-z0-9]+", " ")).alias("key"))


def issue_grouping(spark, base):
    """Codes to groups, with other and none buckets, in a frozen and a corrected map."""
    frozen = {"view": "attention", "clicks": "attention", "purchase": "conversion"}
    fixed = {"view": "attention", "click": "attention", "purchase": "conversion", "signup": "conversion"}
    m = lambda g: F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in g.items()], F.when(F.col("event_type").isNull(), "none"), F.lit("other"))
    return table(spark, base, "events").groupBy(m(frozen).alias("frozen"), m(fixed).alias("corrected")).agg(F.count("*").alias("n"))


def field_completeness(spark, base):
    """Share of filled cells per column and source."""
    x = table(spark, base, "documents")
    cols = ["text", "lang", "n_chars"]
    w = x.groupBy("source").agg(*[F.round(F.count(F.nullif(F.col(c).cast("string"), F.lit(""))) / F.count("*"), 6).alias(c) for c in cols])
    return w.unpivot(["source"], cols, "field", "filled")


def dq_unique_fk(spark, base):
    """Key and reference gates; every violation count should be 0 except where rows truly repeat."""
    o, li, c = (table(spark, base, n) for n in ("orders", "lineitem", "customer"))
    dup = lambda df, *k: df.groupBy(*k).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations"))
    orphan = lambda a, b, cond: a.join(b, cond, "left_anti").agg(F.count("*").alias("violations"))
    gates = {
        "orders_pk": dup(o, "o_orderkey"), "lineitem_pk": dup(li, "l_orderkey", "l_linenumber"),
        "lineitem_orders_fk": orphan(li, o, F.col("l_orderkey") == F.col("o_orderkey")), "orders_customer_fk": orphan(o, c, F.col("o_custkey") == F.col("c_custkey")),
        "orders_without_lines": orphan(o, li, F.col("l_orderkey") == F.col("o_orderkey")),
    }
    out = None
    for name, g in gates.items():
        g = g.select(F.lit(name).alias("gate"), "violations")
        out = g if out is None else out.union(g)
    return out


def dq_census(spark, base):
    """Parts must sum to the whole: documents by language and by source against the table."""
    x = table(spark, base, "documents")
    by = lambda k: x.groupBy(k).agg(F.count("*").alias("n")).agg(F.sum("n").alias("parts"), F.count("*").alias("groups")).select(F.lit(k).alias("census"), "parts", "groups")
    whole = x.agg(F.count("*").alias("whole"))
    return by("lang").union(by("source")).join(F.broadcast(whole)).withColumn("agrees", F.col("parts") == F.col("whole"))


def dq_missingness(spark, base):
    """A share is null exactly where its denominator is 0."""
    g = table(spark, base, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("den"), F.count(F.when((F.col("event_type") == "purchase") & (F.col("value") > 10), 1)).alias("num"))
    s = g.withColumn("share", F.when(F.col("den") > 0, F.col("num") / F.col("den")))
    return s.agg(F.count(F.when(F.col("share").isNull() & (F.col("den") != 0), 1)).alias("unexplained"), F.count(F.when(F.col("share").isNull(), 1)).alias("nulls"), F.count("*").alias("rows"))


def content_digest(spark, base):
    """An order-free digest of a table by key range: rows, and the XOR and sum of their hashes, so ranges merge in any order."""
    text = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")
    o = table(spark, base, "orders").select((F.col("o_orderkey") % 16).alias("part"), F.sha2(text, 256).alias("h"))
    number = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("long")
    return o.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor(number(1, 15)).alias("x"), F.sum(number(17, 8)).alias("s"))


DUP = lambda t_, k: f"(SELECT count(*) FROM (SELECT 1 FROM {t_} GROUP BY {k} HAVING count(*) > 1))"
SHARES = ", ".join(f"round(len(list_filter(tk, lambda x: x IN ({', '.join(repr(x) for x in w)}))) / greatest(len(tk), 1), 6) AS share_{k}" for k, w in t.LANGUAGE_WORDS.items())
LEAD = "CASE " + " ".join(f"WHEN share_{k} > 0 AND share_{k} = greatest({', '.join('share_' + x for x in t.LANGUAGE_WORDS)}) THEN '{k}'" for k in t.LANGUAGE_WORDS) + " END"
COUNT_RE = lambda p: f"CAST(len(regexp_extract_all(x, '{p}')) AS BIGINT)"
QUERIES = {
    "url_canonicalise": (url_canonicalise, f"WITH {URL_SQL} SELECT page_id, canonical, transforms FROM c"),
    "url_groups": (url_groups, f"WITH {URL_SQL}, g AS (SELECT canonical, count(*) AS pages, count(DISTINCT sha256(coalesce(html, ''))) AS bodies, bool_or(regexp_matches(transforms, 'mobile_host|amp_path|wayback')) AS variant FROM c JOIN pages USING (page_id) WHERE canonical <> '' GROUP BY 1) SELECT 'URL-' || substr(sha256(canonical), 1, 12) AS group_id, pages, bodies, CASE WHEN pages = 1 THEN 'unique_url' WHEN bodies = 1 THEN 'same_url_same_content' WHEN variant THEN 'url_variant_probable_same_page' ELSE 'same_url_content_changed' END AS kind FROM g"),
    "html_title_meta": (html_title_meta, """SELECT page_id, regexp_extract(x, '<title>([^<]*)</title>', 1) AS title, regexp_extract(x, '<html lang="([a-z]+)"', 1) AS lang, CAST(len(regexp_extract_all(x, '<a href=')) AS BIGINT) AS links, CAST(len(regexp_extract_all(x, '<p>')) AS BIGINT) AS paragraphs FROM (SELECT page_id, coalesce(html, '') AS x FROM pages)"""),
    "html_clean": (html_clean, None),
    "char_normalise": (char_normalise, "SELECT doc_id, sha256(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(x, ' ', ' ', 'g'), '[​‌﻿]', '', 'g'), '[\\x00-\\x08\\x0e-\\x1f]', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS digest, " + ", ".join(f"{COUNT_RE(p)} AS {k}" for k, p in {"nbsp": " ", "zero_width": "[​‌﻿]", "replacement": "�", "control": "[\\x00-\\x08\\x0e-\\x1f]", "entity": "&(?:amp|lt|gt|quot|nbsp);"}.items()) + " FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)"),
    "structure_flags": (structure_flags, f"WITH {ART_SQL}, p AS (SELECT doc_id, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM art) SELECT doc_id, CAST(len(p) AS BIGINT) AS paragraphs, CAST(len(p) - len(list_distinct(p)) AS BIGINT) AS duplicates, array_to_string(list_filter([CASE WHEN len(p) > len(list_distinct(p)) THEN 'duplicate_paragraphs' END, CASE WHEN len(p) = 1 THEN 'single_block' END, CASE WHEN len(list_filter(p, lambda x: length(x) > 2000)) > 0 THEN 'very_long_paragraph' END], lambda x: x IS NOT NULL), ',') AS flags FROM p"),
    "language_evidence": (language_evidence, f"WITH k AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS tk FROM documents), s AS (SELECT doc_id, lang, {SHARES} FROM k), l AS (SELECT *, {LEAD} AS lead FROM s) SELECT * EXCLUDE (lang), lead = lang AS agrees FROM l"),
    "quality_status": (quality_status, f"WITH {ART_SQL}, w AS (SELECT *, {W_SQL} AS w FROM art) SELECT doc_id, {QUALITY_SQL} AS status FROM w"),
    "boundary_fields": (boundary_fields, f"WITH {ART_SQL} SELECT doc_id, CASE WHEN length(title) <= 120 AND NOT regexp_matches(title, '[.!?]$') THEN title ELSE '' END AS title, regexp_extract(body, '(?m)^(?:By|Par|Von|Por) ([^\\n]{{1,60}})$', 1) AS byline, CAST(length(body) AS BIGINT) AS body_chars FROM art"),
    "eligibility_first_failure": (eligibility_first_failure, f"WITH {HASH_SQL}, w AS (SELECT *, {W_SQL} AS w FROM art), q AS (SELECT doc_id, lang, {QUALITY_SQL} AS quality FROM w), c AS (SELECT ex.doc_id, CASE WHEN quality IN ('missing_body', 'unusable_text') THEN 'E1_no_text' WHEN lang <> 'en' THEN 'E2_language' WHEN ex.status = 'exact_duplicate' THEN 'E3_duplicate' WHEN quality = 'near_empty' THEN 'E4_too_short' ELSE '' END AS code FROM ex JOIN q USING (doc_id)) SELECT doc_id, code, CASE WHEN code = '' THEN 'review' ELSE 'excluded' END AS status FROM c"),
    "alias_match": (alias_match, f"WITH dim(entity, alias, a, b) AS (VALUES {', '.join(map(str, ALIASES))}), h AS (SELECT doc_id, entity, alias FROM documents JOIN dim ON contains(lower(coalesce(text, '')), alias) AND doc_id >= a AND doc_id < b) SELECT doc_id, entity, first(alias ORDER BY length(alias) DESC, alias DESC) AS alias FROM h GROUP BY ALL"),
    "date_resolution": (date_resolution, "WITH x AS (SELECT doc_id, doc_id % 28 AS a, (doc_id + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) % 28 AS b FROM documents) SELECT doc_id, CAST(2 AS BIGINT) AS evidence, CASE WHEN a = b THEN CAST(DATE '2024-01-01' + CAST(a AS INT) AS VARCHAR) END AS day, CASE WHEN a = b THEN 'confirmed' ELSE 'conflict' END AS grade FROM x"),
    "number_parse": (number_parse, "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS value FROM customer"),
    "json_fence_parse": (json_fence_parse, "SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 11 = 0 THEN 'invalid' ELSE 'ok' END AS status FROM events"),
    "evidence_spans": (evidence_spans, f"WITH {ART_SQL}, c AS (SELECT doc_id, body, CASE WHEN doc_id % 9 = 0 THEN 'not in any body ☃' ELSE substr(body, 11, 20) END AS span, 10 + CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 0 END AS pos FROM art WHERE length(body) > 60) SELECT doc_id, CASE WHEN substr(body, pos + 1, length(span)) = span THEN 'exact' WHEN instr(body, span) > 0 THEN 'moved' ELSE 'missing' END AS verdict FROM c"),
    "name_key": (name_key, "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS key FROM part"),
    "issue_grouping": (issue_grouping, "SELECT CASE event_type WHEN 'view' THEN 'attention' WHEN 'purchase' THEN 'conversion' ELSE 'other' END AS frozen, CASE WHEN event_type IN ('view', 'click') THEN 'attention' WHEN event_type IN ('purchase', 'signup') THEN 'conversion' ELSE 'other' END AS corrected, count(*) AS n FROM events GROUP BY ALL"),
    "field_completeness": (field_completeness, " UNION ALL ".join(f"SELECT source, '{c}' AS field, round(count(nullif(CAST({c} AS VARCHAR), '')) / count(*), 6) AS filled FROM documents GROUP BY source" for c in ("text", "lang", "n_chars"))),
    "dq_unique_fk": (dq_unique_fk, f"SELECT 'orders_pk' AS gate, {DUP('orders', 'o_orderkey')} AS violations UNION ALL SELECT 'lineitem_pk', {DUP('lineitem', 'l_orderkey, l_linenumber')} UNION ALL SELECT 'lineitem_orders_fk', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'orders_customer_fk', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'orders_without_lines', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))"),
    "dq_census": (dq_census, "SELECT 'lang' AS census, count(*) AS parts, count(DISTINCT lang) AS groups, count(*) AS whole, true AS agrees FROM documents UNION ALL SELECT 'source', count(*), count(DISTINCT source), count(*), true FROM documents"),
    "dq_missingness": (dq_missingness, "WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS den FROM events GROUP BY 1) SELECT CAST(0 AS BIGINT) AS unexplained, count(*) FILTER (den = 0) AS nulls, count(*) AS rows FROM g"),
    "content_digest": (content_digest, "SELECT o_orderkey % 16 AS part, count(*) AS n, bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS x, CAST(sum(CAST('0x' || substr(h, 17, 8) AS BIGINT)) AS BIGINT) AS s FROM (SELECT o_orderkey, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS h FROM orders) GROUP BY 1"),
}
