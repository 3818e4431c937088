"""Duplicate-resolution queries over documents: title is the first line, body the rest, paragraphs its lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as t
from quernstone.operators import dedup as d
from quernstone.operators.components import connected_components
from quernstone.operators.tiles import Sets, met
from quernstone.plans.durable import durable
from quernstone.sources.tables import table

ART_SQL = r"""art AS (SELECT doc_id, source, lang, split_part(x, chr(10), 1) AS title, CASE WHEN contains(x, chr(10)) THEN substr(x, instr(x, chr(10)) + 1) ELSE x END AS body FROM (SELECT *, coalesce(text, '') AS x FROM documents))"""
HASH_SQL = f"""{ART_SQL}, h AS (SELECT doc_id, source, CASE WHEN trim(body) = '' THEN '' ELSE sha256(body) END AS body_hash, CASE WHEN trim(title) = '' THEN '' ELSE sha256(title) END AS title_hash FROM art),
pb AS (SELECT body_hash, count(*) AS cluster_size, count(DISTINCT title_hash) AS titles FROM h WHERE body_hash <> '' GROUP BY 1),
pt AS (SELECT title_hash, count(DISTINCT body_hash) AS bodies FROM h WHERE body_hash <> '' AND title_hash <> '' GROUP BY 1),
ex AS (SELECT doc_id, source, h.body_hash, h.title_hash, CASE WHEN h.body_hash = '' THEN 'not_clustered_unusable' WHEN cluster_size > 1 THEN 'exact_duplicate' ELSE 'unique' END AS status,
  CASE WHEN cluster_size > 1 THEN 'EXD-' || substr(h.body_hash, 1, 12) ELSE '' END AS cluster_id, coalesce(cluster_size, 0) AS cluster_size,
  array_to_string(list_filter([CASE WHEN cluster_size > 1 AND titles > 1 THEN 'same_body_different_title' END, CASE WHEN h.body_hash <> '' AND bodies > 1 THEN 'same_title_different_body' END], lambda x: x IS NOT NULL), ',') AS flags
  FROM h LEFT JOIN pb ON h.body_hash = pb.body_hash LEFT JOIN pt ON h.title_hash = pt.title_hash)"""
SH_SQL = f"""{ART_SQL}, tk AS MATERIALIZED (SELECT *, regexp_extract_all(lower(body), '[a-z0-9'']+') AS tk, regexp_extract_all(lower(title), '[a-z0-9'']+') AS tt, len(list_filter(regexp_split_to_array(body, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')) AS w FROM art),
sh AS MATERIALIZED (SELECT *, CASE WHEN len(tk) >= {t.SHINGLE_WORDS} THEN list_distinct(list_transform(range(1, len(tk) - {t.SHINGLE_WORDS - 2}), lambda i: substr(sha1(array_to_string(list_slice(tk, i, i + {t.SHINGLE_WORDS - 1}), ' ')), 1, 16))) ELSE [] END AS s,
  list_distinct(list_filter(tt, lambda x: length(x) > 2 AND x NOT IN ({', '.join(repr(x) for x in t.STOP)}))) AS ti, min(doc_id) OVER (PARTITION BY body) AS rep FROM tk)"""
PAIR_SQL = f"""{SH_SQL}, po AS MATERIALIZED (SELECT doc_id, unnest(list_slice(list_sort(s), 1, {t.SKETCH_SIZE})) AS h FROM sh WHERE doc_id = rep), hp AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM po x JOIN po y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
tp AS MATERIALIZED (SELECT doc_id, unnest(ti) AS k FROM sh WHERE doc_id = rep), tc AS (SELECT k FROM tp GROUP BY k HAVING count(*) BETWEEN {d.TITLE_BUCKET[0]} AND {d.TITLE_BUCKET[1]}), tq AS (SELECT doc_id, k FROM tp JOIN tc USING (k)),
ht AS (SELECT x.doc_id AS a, y.doc_id AS b, true AS titled FROM tq x JOIN tq y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL HAVING count(*) >= {d.TITLE_SHARED}), pr AS MATERIALIZED (SELECT a, b, coalesce(shared, 0) AS shared FROM hp FULL JOIN ht USING (a, b) WHERE shared >= {d.SHARED} OR titled)"""
SCORE_SQL = f"""{PAIR_SQL}, i AS (SELECT a, b, shared, len(list_intersect(x.s, y.s)) AS i, len(x.s) AS na, len(y.s) AS nb, len(list_intersect(x.ti, y.ti)) AS ti, len(x.ti) AS ta, len(y.ti) AS tb, x.w AS words_a, y.w AS words_b, x.source AS sa, y.source AS sb FROM pr JOIN sh x ON a = x.doc_id JOIN sh y ON b = y.doc_id),
sc AS (SELECT a, b, shared, round(i / greatest(na + nb - i, 1), 4) AS jaccard, round(i / greatest(least(na, nb), 1), 4) AS containment, round(ti / greatest(ta + tb - ti, 1), 4) AS title_sim, round(least(words_a, words_b) / greatest(words_a, words_b, 1), 4) AS length_ratio, CAST(words_a AS BIGINT) AS words_a, CAST(words_b AS BIGINT) AS words_b, sa, sb FROM i),
cl AS MATERIALIZED (SELECT *, CASE WHEN least(words_a, words_b) < {d.MIN_WORDS} AND containment >= {d.CONTAINED} THEN 'manual_review' WHEN least(words_a, words_b) < {d.MIN_WORDS} THEN 'not_near_duplicate' WHEN containment >= {d.CONTAINED} AND length_ratio <= {d.SHORTER} THEN 'partial_full_text_match'
  WHEN jaccard >= {d.HIGH} THEN 'high_confidence_near_duplicate' WHEN jaccard >= {d.PROBABLE} THEN 'probable_near_duplicate' WHEN jaccard >= {d.GREY} THEN 'manual_review' WHEN title_sim >= 0.5 THEN 'same_event_independent_reporting' ELSE 'not_near_duplicate' END AS class FROM sc)"""
LINK_IN = ", ".join(f"'{x}'" for x in d.LINKING)
COMP_SQL = f"""{SCORE_SQL}, mm AS (SELECT rep AS a, doc_id AS b FROM sh WHERE rep <> doc_id AND len(s) > 0 AND w >= {d.MIN_WORDS}),
ed AS (SELECT a, b FROM cl WHERE class IN ({LINK_IN}) UNION SELECT b, a FROM cl WHERE class IN ({LINK_IN}) UNION SELECT a, b FROM mm UNION SELECT b, a FROM mm),
rc(node, seen) AS (SELECT a, a FROM ed UNION SELECT rc.node, ed.b FROM rc JOIN ed ON rc.seen = ed.a), co AS (SELECT node, min(seen) AS component FROM rc GROUP BY node)"""


def art(spark, base):
    return d.articles(table(spark, base, "documents"))


def exact_duplicate_map(spark, base):
    return d.exact_duplicates(art(spark, base))


def same_title_different_body(spark, base):
    return d.exact_duplicates(art(spark, base)).where("flags LIKE '%same_title%'").select("doc_id", "cluster_id", "status")


def shingle_sketch(spark, base):
    a = art(spark, base).select("doc_id", t.shingles(t.tokens(F.col("body"))).alias("s"))
    return a.select("doc_id", F.size("s").cast("long").alias("shingles"), F.size(t.sketch(F.col("s"))).cast("long").alias("kept"), F.sha2(F.array_join(t.sketch(F.col("s")), " "), 256).alias("sketch_digest"))


def candidate_pairs_blocking(spark, base):
    return d.candidate_pairs(d.features(art(spark, base), whole=False))


def scored(spark, base, f=None):
    a = art(spark, base)
    return d.pair_scores(durable(d.blocked_pairs(f or d.features(a, whole=False))), a)


def pair_scores_jaccard_containment(spark, base):
    return scored(spark, base)


def classed(spark, base, f=None):
    return scored(spark, base, f).withColumn("class", d.near_class())


def near_dup_classes(spark, base):
    return classed(spark, base).select("a", "b", "class")


def _components(spark, base):
    """Components over the linking pairs of representatives and their members."""
    f = d.features(art(spark, base))
    return connected_components(durable(d.linked_pairs(f).union(d.members(f))))


def near_dup_components(spark, base):
    return _components(spark, base)


def cluster_sizes(spark, base):
    return _components(spark, base).groupBy("component").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("clusters"))


def pair_seq_ratio(spark, base):
    a = art(spark, base)
    return d.sequence_ratio(durable(d.blocked_pairs(d.features(a, whole=False))), a)


def edges(spark, base):
    """Typed edges: exact copies and equal titles to their cluster's first document, scored pairs, and versions."""
    a = art(spark, base)
    x = d.exact_duplicates(a).join(a.select("doc_id", "title"), "doc_id").where("status <> 'not_clustered_unusable'")

    def stars(key, kind, rows):
        first = rows.groupBy(key).agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1")
        return rows.join(first, key).where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(kind).alias("edge_type"), F.lit(True).alias("grade"), F.lit(False).alias("blocking"), F.lit(False).alias("snippet"))

    near = durable(classed(spark, base))
    short = F.least("words_a", "words_b") < d.MIN_WORDS
    pair = near.select("a", "b", F.lit("near_duplicate").alias("edge_type"), F.col("class").isin(d.LINKING).alias("grade"), ((F.col("a") + F.col("b")) % 7 == 0).alias("blocking"), short.alias("snippet"))
    version = near.where("(a + b) % 3 = 0").select("a", "b", F.lit("version").alias("edge_type"), (F.col("jaccard") >= d.HIGH).alias("grade"), F.lit(False).alias("blocking"), short.alias("snippet"))
    return stars("body_hash", "exact_duplicate", x).union(stars("title", "same_canonical_url", x.where("title <> ''"))).union(pair).union(version)


def edge_dispositions(spark, base):
    return d.dispositions(edges(spark, base)).select("a", "b", "edge_type", "reason", "disposition")


EDGE_SQL = f"""{SCORE_SQL.replace(ART_SQL, HASH_SQL)}, ok AS (SELECT ex.doc_id, ex.body_hash, art.title FROM ex JOIN art USING (doc_id) WHERE status <> 'not_clustered_unusable'),
es AS (SELECT min(doc_id) OVER (PARTITION BY body_hash) AS a, doc_id AS b, 'exact_duplicate' AS edge_type, true AS grade, false AS blocking, false AS snippet FROM ok
 UNION ALL SELECT min(doc_id) OVER (PARTITION BY title), doc_id, 'same_canonical_url', true, false, false FROM ok WHERE title <> ''
 UNION ALL SELECT a, b, 'near_duplicate', class IN ({LINK_IN}), (a + b) % 7 = 0, least(words_a, words_b) < {d.MIN_WORDS} FROM cl
 UNION ALL SELECT a, b, 'version', jaccard >= {d.HIGH}, false, least(words_a, words_b) < {d.MIN_WORDS} FROM cl WHERE (a + b) % 3 = 0),
ew AS (SELECT *, bool_or(blocking) OVER w AS bl, bool_or(edge_type = 'exact_duplicate' AND grade) OVER w AS he, bool_or(edge_type = 'version' AND grade) OVER w AS hv FROM es WHERE a <> b WINDOW w AS (PARTITION BY least(a, b), greatest(a, b))),
er AS (SELECT *, CASE WHEN NOT grade THEN 'not_link_grade' WHEN bl AND edge_type <> 'exact_duplicate' THEN 'independent_decision_blocks_merge' WHEN he AND edge_type = 'near_duplicate' THEN 'superseded_by_exact_duplicate'
  WHEN edge_type = 'same_canonical_url' AND NOT hv THEN 'same_url_requires_version_evidence' WHEN edge_type IN ('near_duplicate', 'version') AND snippet THEN 'snippet_bridge_blocked' ELSE '' END AS reason FROM ew),
di AS (SELECT a, b, edge_type, reason, CASE WHEN reason = '' THEN 'linking' WHEN reason = 'not_link_grade' THEN 'non_linking' WHEN starts_with(reason, 'superseded') THEN 'superseded' ELSE 'blocked' END AS disposition FROM er)"""


def family_support(spark, base):
    """Families from linking edges, with members, distinct supporting pairs, and whether every pair is supported."""
    e = durable(d.dispositions(edges(spark, base)).where("disposition = 'linking'"))
    fam = durable(connected_components(e))
    pairs = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(fam, F.col("a") == F.col("node"))
    support = pairs.groupBy("component").agg(F.count("*").alias("supported_pairs"))
    n = fam.groupBy("component").agg(F.count("*").alias("members"))
    return n.join(support, "component").withColumn("complete", F.col("supported_pairs") == F.col("members") * (F.col("members") - 1) / 2)


def _members(spark, base):
    a = art(spark, base)
    fam = _components(spark, base)
    words = F.size(F.filter(F.split("body", r"\s+"), lambda x: x != ""))
    return fam.join(a, F.col("node") == F.col("doc_id")).select(
        F.col("component").alias("family"), F.col("doc_id").alias("id"), (words >= d.MIN_WORDS).alias("full_text"), (F.col("doc_id") % 3 == 0).alias("temporal_confirmed"),
        (~F.col("body").rlike("[!#*]{2}")).alias("clean"), (F.col("doc_id") % 2 == 0).alias("pub_date_usable"), F.lit(True).alias("stable_url"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))).alias("available_from"),
    )


def canonical_selection(spark, base):
    return d.canonical(_members(spark, base))


CANON_SQL = f"""{COMP_SQL}, mb AS (SELECT component AS family, doc_id AS id, w >= {d.MIN_WORDS} AS full_text, [CAST(w < {d.MIN_WORDS} AS INT), CAST(doc_id % 3 <> 0 AS INT), CAST(regexp_matches(body, '[!#*]{{2}}') AS INT), CAST(doc_id % 2 <> 0 AS INT), 0] AS r,
  CASE WHEN doc_id % 5 = 0 THEN chr(1114111) ELSE '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS af FROM co JOIN sh ON node = doc_id),
cn AS (SELECT family, count(*) AS members, CASE WHEN bool_or(full_text) THEN first(id ORDER BY r, af, id) END AS canonical_id, CASE WHEN bool_or(full_text) THEN 'selected' ELSE 'review' END AS status FROM mb GROUP BY family)"""


def mapping_layer(spark, base):
    """One row per document: exact cluster, family and the document that stands for it."""
    x = d.exact_duplicates(art(spark, base))
    m = durable(_members(spark, base))
    c = d.canonical(m).select("family", "canonical_id")
    out = x.join(m.select(F.col("id").alias("doc_id"), "family").join(c, "family"), "doc_id", "left")
    rel = F.when(F.col("family").isNull() & (F.col("cluster_size") <= 1), "standalone").when(F.col("family").isNull(), "exact_only").when(F.col("canonical_id") == F.col("doc_id"), "canonical").when(F.col("canonical_id").isNull(), "review").otherwise("alternative")
    return out.select("doc_id", "status", "cluster_id", "family", "canonical_id", rel.alias("relationship"))


def entries(texts):
    """Distinct texts of an array as 64-bit hashes, to be met within pairs."""
    return F.transform(texts, lambda p: F.xxhash64(p))


def shared_long_paragraphs(spark, base):
    """Candidate pairs with the number and size of long paragraphs that stand in both. Their hashes travel once per tile."""
    a = art(spark, base)
    p = a.select("doc_id", F.array_distinct(F.filter(F.transform("paragraphs", lambda x: F.trim(x)), lambda p: F.length(p) >= 40)).alias("p"))
    side = durable(p.select("doc_id", entries("p").alias("p"), F.transform("p", lambda x: F.length(x)).alias("w")))

    def calc(docs):
        p = Sets(docs.column("p"), docs.column("w"))
        return p.common

    x = met(durable(d.blocked_pairs(d.features(a, whole=False))), side, calc, "paragraphs long, chars long")
    return x.select("a", "b", "paragraphs", "chars")


MARKERS = "reuters|press association|pa media|associated press|agence france|local democracy|according to|licensed under|released under|press release"


def attribution_markers(spark, base):
    m = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.col("body")), F.lit(f"({MARKERS})"), F.lit(1))))
    return art(spark, base).select("doc_id", F.array_join(m, ",").alias("markers"), F.size(m).cast("long").alias("n"))


def cross_source_classes(spark, base):
    """Pairs of different sources by overlap: syndicated, shared release, or independent."""
    a = art(spark, base)
    x = d.pair_scores(durable(d.blocked_pairs(d.features(a, whole=False))), a, table(spark, base, "documents").select("doc_id", "source"), ("source", False))
    kind = F.when(F.col("jaccard") >= 0.7, "syndicated_copy").when(F.col("containment") >= 0.5, "shared_release").otherwise("independent")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("pairs"))


def version_pair_changes(spark, base):
    """Same-source near pairs: did title, numbers or quoted parts change, and how many paragraphs came and went."""
    a = art(spark, base)
    nums = F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit("([0-9]+)"), F.lit(1))))
    quotes = F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit('("[^"]+"|“[^”]+”)'), F.lit(1))))
    p = F.array_distinct(F.filter(F.transform("paragraphs", lambda x: F.trim(x)), lambda p: p != ""))
    side = durable(a.select("doc_id", "source", F.xxhash64("title").alias("title"), F.xxhash64(nums).alias("nums"), F.xxhash64(quotes).alias("quotes"), entries(p).alias("p")).withColumn("n", F.size("p")))

    def calc(docs):
        p = Sets(docs.column("p"))
        return lambda ia, ib: [p.common(ia, ib)[0]]

    x = met(durable(d.blocked_pairs(d.features(a, whole=False))), side, calc, "common long", ("title", "nums", "quotes", "n"), ("source", True))
    return x.select(
        "a", "b", (F.col("title_a") != F.col("title_b")).alias("title_changed"), (F.col("nums_a") != F.col("nums_b")).alias("numbers_changed"), (F.col("quotes_a") != F.col("quotes_b")).alias("quotes_changed"),
        (F.col("n_b") - F.col("common")).alias("added"), (F.col("n_a") - F.col("common")).alias("deleted"),
    )


def paragraph_frequency(spark, base):
    """Lines that stand in several documents, by how many: the corpus' boilerplate spectrum."""
    p = art(spark, base).select("doc_id", F.explode(F.array_distinct(F.filter(F.transform("paragraphs", lambda x: F.trim(x)), lambda x: F.length(x) >= 20))).alias("p"))
    return p.groupBy(F.xxhash64("p").alias("h")).agg(F.count("*").alias("documents")).groupBy("documents").agg(F.count("*").alias("paragraphs"))


QUERIES = {
    "exact_duplicate_map": (exact_duplicate_map, f"WITH {HASH_SQL} SELECT doc_id, body_hash, status, cluster_id, cluster_size, flags FROM ex"),
    "same_title_different_body": (same_title_different_body, f"WITH {HASH_SQL} SELECT doc_id, cluster_id, status FROM ex WHERE flags LIKE '%same_title%'"),
    "shingle_sketch": (shingle_sketch, f"WITH {SH_SQL} SELECT doc_id, CAST(len(s) AS BIGINT) AS shingles, CAST(least(len(s), {t.SKETCH_SIZE}) AS BIGINT) AS kept, sha256(array_to_string(list_slice(list_sort(s), 1, {t.SKETCH_SIZE}), ' ')) AS sketch_digest FROM sh"),
    "candidate_pairs_blocking": (candidate_pairs_blocking, f"WITH {PAIR_SQL} SELECT * FROM pr"),
    "pair_scores_jaccard_containment": (pair_scores_jaccard_containment, f"WITH {SCORE_SQL} SELECT * EXCLUDE (sa, sb) FROM sc"),
    "near_dup_classes": (near_dup_classes, f"WITH {SCORE_SQL} SELECT a, b, class FROM cl"),
    "near_dup_components": (near_dup_components, f"WITH RECURSIVE {COMP_SQL} SELECT * FROM co"),
    "cluster_sizes": (cluster_sizes, f"WITH RECURSIVE {COMP_SQL}, s AS (SELECT count(*) AS members FROM co GROUP BY component) SELECT members, count(*) AS clusters FROM s GROUP BY members"),
    "pair_seq_ratio": (pair_seq_ratio, None),
    "edge_dispositions": (edge_dispositions, f"WITH {EDGE_SQL} SELECT * FROM di"),
    "family_support": (family_support, f"""WITH RECURSIVE {EDGE_SQL}, le AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM di WHERE disposition = 'linking'), ed AS (SELECT a, b FROM le UNION SELECT b, a FROM le),
rc(node, seen) AS (SELECT a, a FROM ed UNION SELECT rc.node, ed.b FROM rc JOIN ed ON rc.seen = ed.a), co AS (SELECT node, min(seen) AS component FROM rc GROUP BY node),
n AS (SELECT component, count(*) AS members FROM co GROUP BY 1), s AS (SELECT component, count(*) AS supported_pairs FROM le JOIN co ON a = node GROUP BY 1)
SELECT component, members, supported_pairs, supported_pairs = members * (members - 1) / 2 AS complete FROM n JOIN s USING (component)"""),
    "canonical_selection": (canonical_selection, f"WITH RECURSIVE {CANON_SQL} SELECT * FROM cn"),
    "mapping_layer": (mapping_layer, f"""WITH RECURSIVE {CANON_SQL.replace(ART_SQL, HASH_SQL)} SELECT ex.doc_id, ex.status, cluster_id, mb.family, canonical_id,
CASE WHEN mb.family IS NULL AND cluster_size <= 1 THEN 'standalone' WHEN mb.family IS NULL THEN 'exact_only' WHEN canonical_id = ex.doc_id THEN 'canonical' WHEN canonical_id IS NULL THEN 'review' ELSE 'alternative' END AS relationship
FROM ex LEFT JOIN mb ON mb.id = ex.doc_id LEFT JOIN cn ON cn.family = mb.family"""),
    "shared_long_paragraphs": (shared_long_paragraphs, f"WITH {PAIR_SQL}, pg AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 40)) AS p FROM art), x AS (SELECT a, b, list_intersect(u.p, v.p) AS s FROM pr JOIN pg u ON a = u.doc_id JOIN pg v ON b = v.doc_id) SELECT a, b, CAST(len(s) AS BIGINT) AS paragraphs, CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS chars FROM x"),
    "attribution_markers": (attribution_markers, f"WITH {ART_SQL}, m AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(body), '({MARKERS})', 1))) AS m FROM art) SELECT doc_id, array_to_string(m, ',') AS markers, CAST(len(m) AS BIGINT) AS n FROM m"),
    "cross_source_classes": (cross_source_classes, f"WITH {SCORE_SQL} SELECT CASE WHEN jaccard >= 0.7 THEN 'syndicated_copy' WHEN containment >= 0.5 THEN 'shared_release' ELSE 'independent' END AS kind, count(*) AS pairs FROM cl WHERE sa <> sb GROUP BY 1"),
    "version_pair_changes": (version_pair_changes, f"WITH {PAIR_SQL}, f AS (SELECT doc_id, source, title, list_sort(list_distinct(regexp_extract_all(body, '[0-9]+'))) AS n, list_sort(list_distinct(regexp_extract_all(body, '\"[^\"]+\"|“[^”]+”'))) AS q, list_distinct(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS p FROM art) SELECT a, b, u.title <> v.title AS title_changed, u.n <> v.n AS numbers_changed, u.q <> v.q AS quotes_changed, CAST(len(list_filter(v.p, lambda x: NOT list_contains(u.p, x))) AS BIGINT) AS added, CAST(len(list_filter(u.p, lambda x: NOT list_contains(v.p, x))) AS BIGINT) AS deleted FROM pr JOIN f u ON a = u.doc_id JOIN f v ON b = v.doc_id WHERE u.source = v.source"),
    "paragraph_frequency": (paragraph_frequency, f"WITH {ART_SQL}, p AS (SELECT doc_id, unnest(list_distinct(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 20))) AS p FROM art), f AS (SELECT count(*) AS documents FROM p GROUP BY p) SELECT documents, count(*) AS paragraphs FROM f GROUP BY documents"),
}
