"""Queries over similarity, greedy selection, screening and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilake.functions import lexicons as lex
from vigilake.operators import enrich, screening, similarity, stats, verify
from vigilake.operators.greedy import greedy_select
from vigilake.plans.adapter import AS_OF, INCIDENTS, incidents, sql_view, with_views
from vigilake.plans.catalog_enrich import SIGNATURE_SQL, TIER_SQL, _signed, recap_sql
from vigilake.plans.registry import label_sql, list_sql, q, query

_LEV = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN CAST(1 AS DOUBLE) ELSE 1.0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END"


def lev_sql(a: str, b: str) -> str:
    return _LEV.format(a=a, b=b)


def articles(spark, d):
    """Incidents as screening input: date is the full publish time."""
    return incidents(spark, d).select(
        "seq", "id", "title", F.concat_ws(", ", "city", "country").alias("location"),
        F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date"), "source",
        F.col("description").alias("content"), "published")


def day_articles(spark, d):
    """The same with day-level dates, so that signatures are shared."""
    return articles(spark, d).withColumn("date", F.date_format("published", "yyyy-MM-dd"))


@query("signature_dedup", "D1", with_views(f"SELECT signature, min(id) AS id FROM ({SIGNATURE_SQL}) GROUP BY 1"))
def _(spark, d):
    return screening.dedup_signature(_signed(spark, d)).select("signature", "id")


# --- pair similarity --------------------------------------------------------

def _neighbour_pairs(spark, d):
    rows = articles(spark, d)
    nxt = rows.select((F.col("seq") - 1).alias("seq"), F.col("title").alias("new_title"), F.col("location").alias("new_location"))
    return rows.select("seq", F.col("title").alias("old_title"), F.col("location").alias("old_location")).join(nxt, "seq")


@query("event_similarity_levenshtein", "D3", with_views(
    f"SELECT a.seq, round({lev_sql('lower(b.title)', 'lower(a.title)')} * 0.6 + {lev_sql('lower(b.loc)', 'lower(a.loc)')} * 0.4, 6) AS sim FROM arts a JOIN arts b ON b.seq = a.seq + 1",
    arts="SELECT seq, title, concat_ws(', ', city, country) AS loc FROM incidents"))
def _(spark, d):
    return similarity.event_similarity(_neighbour_pairs(spark, d), "levenshtein").select(
        "seq", F.round("event_similarity", 6).alias("sim"))


@query("event_similarity", "D3,Q25")
def _(spark, d):
    return similarity.event_similarity(_neighbour_pairs(spark, d)).select(
        "seq", F.round("event_similarity", 6).alias("sim"))


_KEY_SQL = "SELECT id, seq, published, title, source, is_government, trim(regexp_replace(lower(title), '[^\\w\\s]', '', 'g')) AS t, CASE WHEN country IS NULL THEN coalesce(" + \
    "CASE " + " ".join(f"WHEN contains(lower(title), {q(p)}) THEN {q(p)}" for p in lex.GROUPING_PLACES) + " END, lower(city) || '_') ELSE lower(city) || '_' || lower(country) END AS loc, " + \
    label_sql("lower(title)", lex.GROUPING_TYPES, "incident") + " AS kind FROM incidents"


def _sim_sql(a: str, b: str) -> str:
    return (f"({lev_sql(f'{a}.t', f'{b}.t')} * 0.5 + CASE WHEN {a}.loc = {b}.loc AND {a}.loc <> '' THEN CAST(1 AS DOUBLE) WHEN {a}.loc <> '' AND {b}.loc <> '' THEN 0.5 ELSE 0 END * 0.3 "
            f"+ CASE WHEN {a}.kind = {b}.kind THEN CAST(1 AS DOUBLE) ELSE 0 END * 0.1 + greatest(CAST(0 AS DOUBLE), 1.0 - abs(epoch_us({a}.published) - epoch_us({b}.published)) / CAST(3600000000 AS DOUBLE) / 6.0) * 0.1)")


@query("incident_similarity_levenshtein", "D4", with_views(f"SELECT a.id, round({_sim_sql('a', 'b')}, 6) AS sim FROM k a JOIN k b ON b.id = a.id + 1", k=_KEY_SQL))
def _(spark, d):
    rows = verify.grouping_rows(incidents(spark, d))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, F.col("b.id") == F.col("a.id") + 1)
    sim = similarity.incident_similarity(
        similarity.similarity(F.col("a.t"), F.col("b.t"), "levenshtein"),
        similarity.location_similarity(F.col("a.loc"), F.col("b.loc")), F.col("a.kind") == F.col("b.kind"),
        similarity.time_similarity(F.col("a.published"), F.col("b.published")))
    return pairs.select(F.col("a.id").alias("id"), F.round(sim, 6).alias("sim"))


# --- candidate pairs and greedy selection -----------------------------------

_CLASS_SQL = ("SELECT md5(t || chr(1) || l) AS cls, t, l, min(seq) AS seq FROM (SELECT seq, lower(title) AS t, lower(concat_ws(', ', city, country)) AS l FROM incidents WHERE NOT "
              + f"({recap_sql('lower(title || chr(32) || description)')} > 3.0)) GROUP BY 1, 2, 3")
_NEAR_SQL = f"SELECT a.cls AS new, b.cls AS old, a.seq AS new_seq, b.seq AS old_seq FROM c a JOIN c b ON b.seq < a.seq WHERE {lev_sql('a.t', 'b.t')} * 0.6 + {lev_sql('a.l', 'b.l')} * 0.4 > 0.92"


def _classes(spark, d):
    rows = screening._with_class(enrich.recap_score(articles(spark, d))).filter(~F.col("recap_dropped"))
    return rows.groupBy("cls", "t", "l").agg(F.min("seq").alias("seq"))


@query("candidate_pairs", "J4", with_views("SELECT new, old FROM n", c=_CLASS_SQL, n=_NEAR_SQL))
def _(spark, d):
    classes = screening.cut(_classes(spark, d))
    seqs = classes.select("cls", "seq")
    edges = screening.near_edges(classes, classes, "levenshtein")
    return (edges.join(seqs.toDF("new", "new_seq"), "new").join(seqs.toDF("old", "old_seq"), "old")
            .filter(F.col("old_seq") < F.col("new_seq")).select("new", "old"))


# one-by-one rule as a recursion over the arrival order
_GREEDY_SQL = ("WITH RECURSIVE {views}, walk(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT i + 1, CASE WHEN list_has_any(kept, blockers) THEN kept ELSE list_append(kept, ord) END FROM walk JOIN numbered ON numbered.rn = walk.i + 1) {body}")


def _greedy_sql(body: str, **views: str) -> str:
    return _GREEDY_SQL.format(views=", ".join(f"{n} AS MATERIALIZED ({t})" for n, t in views.items()), body=body)


_NUMBERED = "SELECT c.cls, c.seq AS ord, row_number() OVER (ORDER BY c.seq) AS rn, coalesce(b.blockers, []) AS blockers FROM c LEFT JOIN (SELECT new, list(old_seq) AS blockers FROM n GROUP BY 1) b ON b.new = c.cls"
_KEPT = "SELECT unnest(kept) AS ord FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)"


@query("greedy_selection", "D5", _greedy_sql(
    f"SELECT cls AS node, ord, ord IN ({_KEPT}) AS kept FROM numbered", incidents=sql_view(INCIDENTS), c=_CLASS_SQL, n=_NEAR_SQL, numbered=_NUMBERED))
def _(spark, d):
    classes = screening.cut(_classes(spark, d))
    edges = screening.near_edges(classes, classes, "levenshtein")
    return greedy_select(classes.select(F.col("cls").alias("node"), F.col("seq").alias("ord")),
                         edges.select(F.col("new").alias("node"), F.col("old").alias("blocker")))


# --- screening --------------------------------------------------------------

@query("screened_articles_levenshtein", "D2", _greedy_sql(
    "SELECT i.seq, CASE WHEN recap THEN 'recap' WHEN i.seq IN (" + _KEPT + ") THEN 'accepted' ELSE 'near_duplicate' END AS status FROM (SELECT seq, "
    f"{recap_sql('lower(title || chr(32) || description)')} > 3.0 AS recap FROM incidents) i", incidents=sql_view(INCIDENTS), c=_CLASS_SQL, n=_NEAR_SQL, numbered=_NUMBERED))
def _(spark, d):
    return screening.screen_articles(articles(spark, d), metric="levenshtein").select("seq", "status")


@query("screened_articles", "D2,Q2,Q3,Q4,W5")
def _(spark, d):
    return screening.screen_articles(articles(spark, d)).select("seq", "status", "matched_seq", F.round("similarity", 6).alias("similarity"))


@query("screened_day_articles", "D2,W5")
def _(spark, d):
    return screening.screen_articles(day_articles(spark, d)).select("seq", "status", "matched_seq")


@query("screened_with_history", "D7")
def _(spark, d):
    rows = articles(spark, d)
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    first = screening.screen_articles(rows.filter(F.col("published") < middle))
    accepted = first.filter("status = 'accepted'").select("seq", "title", "location", "date", "source", "content", "published")
    later = screening.screen_articles(rows.filter(F.col("published") >= middle), screening.cut(accepted))
    return later.select("seq", "status", "matched_seq")


# which articles a class or an earlier accepted one lets through, in any order ``pos`` of arrival
_ORDERED = ("SELECT seq, published, pos, lower(title) AS t, lower(concat_ws(', ', city, country)) AS l, "
            + recap_sql("lower(title || chr(32) || description)") + " > 3.0 AS recap FROM (SELECT *, {pos} AS pos FROM incidents)")
_ORDERED_CLASSES = "SELECT t || chr(1) || l AS cls, t, l, min(pos) AS seq FROM ranked WHERE NOT recap GROUP BY 1, 2, 3"
_ORDERED_VERDICTS = (
    "SELECT r.seq, CASE WHEN r.recap THEN 'recap' WHEN m.first = r.pos THEN 'accepted' ELSE 'near_duplicate' END AS status, "
    "CASE WHEN NOT r.recap AND m.first <> r.pos THEN a.seq END AS matched_seq FROM ranked r LEFT JOIN (SELECT nb.cls, min(kp.ord) AS first FROM "
    "(SELECT cls, ord AS own, list_append(blockers, ord) AS reach FROM numbered) nb, lateral (SELECT unnest(nb.reach) AS ord) x "
    "JOIN (" + "{kept}" + ") kp ON kp.ord = x.ord GROUP BY 1) m ON NOT r.recap AND m.cls = r.t || chr(1) || r.l LEFT JOIN ranked a ON a.pos = m.first")


def ordered_sql(pos: str, where: str = "true") -> str:
    """Check SQL of one screening run whose arrival order is ``pos``; dates never repeat."""
    return _greedy_sql(f"SELECT * FROM ({_ORDERED_VERDICTS.format(kept=_KEPT)}) WHERE {where}", incidents=sql_view(INCIDENTS),
                       ranked=_ORDERED.format(pos=pos), c=_ORDERED_CLASSES, n=_NEAR_SQL, numbered=_NUMBERED)


_MIDDLE = "TIMESTAMP '2024-01-16 00:00:00'"


@query("screened_with_history_levenshtein", "D7", ordered_sql(
    f"row_number() OVER (ORDER BY published >= {_MIDDLE}, seq)", f"seq IN (SELECT seq FROM incidents WHERE published >= {_MIDDLE})"))
def _(spark, d):
    rows = articles(spark, d)
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    first = screening.screen_articles(rows.filter(F.col("published") < middle), metric="levenshtein")
    accepted = first.filter("status = 'accepted'").select("seq", "title", "location", "date", "source", "content", "published")
    later = screening.screen_articles(rows.filter(F.col("published") >= middle), screening.cut(accepted), metric="levenshtein")
    return later.select("seq", "status", "matched_seq")


# one step per article: refused if too like the last accepted article of its signature, or near any accepted one
_DAY_ROWS = ("SELECT seq, t, l, t || chr(1) || l AS cls, signature AS sig, row_number() OVER (ORDER BY seq) AS rn FROM "
             f"(SELECT i.seq, lower(title) AS t, lower(concat_ws(', ', city, country)) AS l, g.signature FROM incidents i JOIN ({SIGNATURE_SQL}) g ON g.id = i.id "
             f"WHERE NOT ({recap_sql('lower(title || chr(32) || description)')} > 3.0))")
_DAY_CLASSES = "SELECT cls, any_value(t) AS t, any_value(l) AS l, min(seq) AS ord, row_number() OVER (ORDER BY min(seq)) AS no FROM day GROUP BY 1"
_DAY_SIM = f"{lev_sql('a.t', 'b.t')} * 0.6 + {lev_sql('a.l', 'b.l')} * 0.4"
_DAY_NEAR = f"SELECT a.cls, list(b.no) AS nos FROM dc a JOIN dc b ON {_DAY_SIM} > 0.92 GROUP BY 1"
_DAY_SAME = (f"SELECT a.rn, list(b.rn) AS same, list(b.rn) FILTER ({_DAY_SIM} > 0.8) AS alike FROM day a JOIN day b ON a.sig = b.sig AND b.rn < a.rn GROUP BY 1")
_DAY_STEPS = ("SELECT day.rn, dc.no, near.nos, coalesce(s.same, []) AS same, coalesce(s.alike, []) AS alike FROM day JOIN dc USING (cls) "
              "JOIN near USING (cls) LEFT JOIN ss s ON s.rn = day.rn")


@query("screened_day_articles_levenshtein", "D2,W5", (
    "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({t})" for n, t in {
        "incidents": sql_view(INCIDENTS), "day": _DAY_ROWS, "dc": _DAY_CLASSES, "near": _DAY_NEAR, "ss": _DAY_SAME, "steps": _DAY_STEPS}.items())
    + ", walk(i, nos, rns) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL SELECT i + 1, "
      "CASE WHEN refused THEN nos ELSE list_append(nos, no) END, CASE WHEN refused THEN rns ELSE list_append(rns, rn) END FROM "
      "(SELECT w.i, w.nos, w.rns, s.no, s.rn, list_has_any(w.nos, s.nos) OR coalesce(list_contains(s.alike, list_max(list_intersect(w.rns, s.same))), false) AS refused "
      "FROM walk w JOIN steps s ON s.rn = w.i + 1)), taken AS (SELECT unnest(rns) AS rn FROM (SELECT rns FROM walk ORDER BY i DESC LIMIT 1)) "
      "SELECT i.seq, CASE WHEN day.rn IS NULL THEN 'recap' WHEN taken.rn IS NULL THEN 'rejected' ELSE 'accepted' END AS status FROM incidents i "
      "LEFT JOIN day ON day.seq = i.seq LEFT JOIN taken ON taken.rn = day.rn"))
def _(spark, d):
    found = screening.screen_articles(day_articles(spark, d), metric="levenshtein")
    status = F.when(F.col("status").isin("accepted", "recap"), F.col("status")).otherwise("rejected")
    return found.select("seq", status.alias("status"))


@query("screening_statistics", "A3,Q5", _greedy_sql(
    "SELECT a.accepted, a.unique_signatures, a.event_kinds, a.recap_flagged, t.processed - a.accepted AS rejected, t.recap_dropped, t.processed FROM "
    f"(SELECT count(*) AS accepted, count(DISTINCT sig) AS unique_signatures, count(DISTINCT kind) AS event_kinds, count(*) FILTER (s >= 2.5) AS recap_flagged FROM (SELECT *, kind || ':' || CASE WHEN len(f) = 0 THEN 'unknown' ELSE array_to_string(f, ',') END || ':' || published AS sig FROM "
    f"(SELECT published, {label_sql('lower(title)', lex.EVENT_TYPES, 'incident')} AS kind, list_filter({list_sql(sorted(lex.SIGNATURE_PLACES))}, lambda w: contains(lower(concat_ws(', ', city, country)), w)) AS f, {recap_sql('lower(title || chr(32) || description)')} AS s FROM incidents WHERE seq IN ({_KEPT})))) a, "
    f"(SELECT count(*) AS processed, count(*) FILTER ({recap_sql('lower(title || chr(32) || description)')} > 3.0) AS recap_dropped FROM incidents) t",
    incidents=sql_view(INCIDENTS), c=_CLASS_SQL, n=_NEAR_SQL, numbered=_NUMBERED))
def _(spark, d):
    verdicts = screening.screen_articles(articles(spark, d), metric="levenshtein")
    return stats.screening_stats(screening.accepted_articles(verdicts, AS_OF), screening.rejected_articles(verdicts))


# --- cross-source grouping --------------------------------------------------

def grouped(spark, d, metric="ratio"):
    rows = incidents(spark, d)
    members = verify.group_incidents(rows, metric=metric)
    return members.join(rows.select("id", "title", "source", "is_government", "published", "country", "city"), "id")


@query("incident_groups", "D6")
def _(spark, d):
    return grouped(spark, d).select("id", "group_id", "is_leader")


_GROUP_VIEWS = {
    "incidents": sql_view(INCIDENTS),
    "k": "SELECT *, row_number() OVER (ORDER BY published DESC, seq) AS rn, t || chr(1) || loc || chr(1) || kind AS cls FROM (" + _KEY_SQL + ") WHERE loc <> ''",
    "cl": "SELECT cls, any_value(t) AS t, any_value(loc) AS loc, any_value(kind) AS kind FROM k GROUP BY 1",
    "e": "SELECT * FROM (SELECT a.cls AS a_cls, b.cls AS b_cls, " + lev_sql("a.t", "b.t") + " * 0.5 + CASE WHEN a.loc = b.loc THEN CAST(1 AS DOUBLE) ELSE 0.5 END * 0.3 "
         "+ CASE WHEN a.kind = b.kind THEN CAST(1 AS DOUBLE) ELSE 0 END * 0.1 AS base FROM cl a JOIN cl b ON a.loc = b.loc OR a.kind = b.kind OR a.t = b.t) WHERE base >= 0.6499",
    "pairs": "SELECT b.rn AS rn, a.rn AS leader_rn FROM k a JOIN e ON e.a_cls = a.cls JOIN k b ON b.cls = e.b_cls AND b.rn > a.rn WHERE base + greatest(CAST(0 AS DOUBLE), 1.0 - abs(epoch_us(a.published) - epoch_us(b.published)) / CAST(3600000000 AS DOUBLE) / 6.0) * 0.1 >= 0.75",
    "numbered": "SELECT k.id, k.rn, k.rn AS ord, coalesce(p.blockers, []) AS blockers FROM k LEFT JOIN (SELECT rn, list(leader_rn) AS blockers FROM pairs GROUP BY 1) p USING (rn)",
}


_MEMBERS = (
    "SELECT id, id AS group_id, true AS is_leader FROM incidents WHERE id NOT IN (SELECT id FROM k) UNION ALL "
    "SELECT m.id, g.id, m.rn = g.rn FROM (SELECT n.id, n.rn, CASE WHEN n.rn IN (SELECT ord FROM lead) THEN n.rn ELSE "
    "(SELECT min(p.leader_rn) FROM pairs p JOIN lead ON lead.ord = p.leader_rn WHERE p.rn = n.rn) END AS g "
    "FROM numbered n) m JOIN k g ON g.rn = m.g")
_SCORED = (
    "SELECT *, source_score + CASE WHEN num_sources >= 3 THEN 35 WHEN num_sources = 2 THEN 25 ELSE 10 END + "
    "least(15, 10 * gov_members) AS score FROM (SELECT group_id, count(*) AS members, count(DISTINCT source) AS num_sources, "
    f"max(CASE {TIER_SQL} WHEN 'government' THEN 50 WHEN 'major_news' THEN 40 WHEN 'regional_news' THEN 30 ELSE 10 END) AS source_score, "
    "count(*) FILTER (is_government) AS gov_members FROM gm GROUP BY 1)")
_BADGED = ("SELECT *, CASE WHEN score >= 90 THEN 'VERIFIED' WHEN score >= 70 THEN 'LIKELY' WHEN score >= 50 THEN 'PARTIAL' "
           "ELSE 'UNCONFIRMED' END AS badge FROM scored")


def groups_sql(body: str, **more: str) -> str:
    """Check SQL over ``mem`` (membership), ``gm`` (members with their rows) and ``groups`` (scored)."""
    views = {"lead": _KEPT, "mem": _MEMBERS, "gm": "SELECT mem.group_id, mem.is_leader, i.* FROM mem JOIN incidents i USING (id)",
             "scored": _SCORED, "groups": _BADGED, **more}
    return _greedy_sql(", " + ", ".join(f"{n} AS ({t})" for n, t in views.items()) + " " + body, **_GROUP_VIEWS)


@query("incident_groups_levenshtein", "D6", groups_sql("SELECT id, group_id, is_leader FROM mem"))
def _(spark, d):
    return verify.group_incidents(incidents(spark, d), metric="levenshtein")


@query("verification_scores", "A4,Q14", with_views(
    "SELECT group_id, members, num_sources, CAST(w + CASE WHEN num_sources >= 3 THEN 35 WHEN num_sources = 2 THEN 25 ELSE 10 END + least(15, 10 * gov) AS INT) AS score, "
    "CASE WHEN w + CASE WHEN num_sources >= 3 THEN 35 WHEN num_sources = 2 THEN 25 ELSE 10 END + least(15, 10 * gov) >= 90 THEN 'VERIFIED' WHEN w + CASE WHEN num_sources >= 3 THEN 35 WHEN num_sources = 2 THEN 25 ELSE 10 END + least(15, 10 * gov) >= 70 THEN 'LIKELY' "
    "WHEN w + CASE WHEN num_sources >= 3 THEN 35 WHEN num_sources = 2 THEN 25 ELSE 10 END + least(15, 10 * gov) >= 50 THEN 'PARTIAL' ELSE 'UNCONFIRMED' END AS badge FROM "
    f"(SELECT title AS group_id, count(*) AS members, count(DISTINCT source) AS num_sources, max(CASE {TIER_SQL} WHEN 'government' THEN 50 WHEN 'major_news' THEN 40 WHEN 'regional_news' THEN 30 ELSE 10 END) AS w, count(*) FILTER (is_government) AS gov FROM incidents GROUP BY 1)"))
def _(spark, d):
    members = incidents(spark, d).withColumn("group_id", F.col("title"))
    return verify.verification_score(members).select("group_id", "members", "num_sources", "score", "badge")


@query("group_records", "A5")
def _(spark, d):
    return verify.build_groups(grouped(spark, d))


@query("group_badges", "A6,K2")
def _(spark, d):
    return stats.badge_summary(verify.verification_score(grouped(spark, d)))


@query("verified_incidents", "J2,K3")
def _(spark, d):
    members = screening.cut(grouped(spark, d))
    out = verify.attach_verification(incidents(spark, d), members, verify.build_groups(members))
    return out.select("id", "v_badge", "v_score", "v_sources", "v_status")


@query("group_records_levenshtein", "A5", groups_sql(
    "SELECT g.group_id, g.members, g.num_sources, g.source_score, g.gov_members, g.members - g.gov_members AS news_members, CAST(g.score AS INT) AS score, g.badge, "
    "l.title AS primary_title, k2.loc AS location, k2.kind, t.earliest, t.latest FROM groups g JOIN gm l ON l.id = g.group_id JOIN every k2 ON k2.id = g.group_id "
    "JOIN (SELECT group_id, CAST(min(published) AS VARCHAR) AS earliest, CAST(max(published) AS VARCHAR) AS latest FROM (SELECT group_id, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM gm) GROUP BY 1) t ON t.group_id = g.group_id",
    every=_KEY_SQL))
def _(spark, d):
    return verify.build_groups(grouped(spark, d, "levenshtein")).select(
        "group_id", "members", "num_sources", "source_score", "gov_members", "news_members", "score", "badge", "primary_title",
        "location", "kind", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("earliest", "latest")])


@query("group_members_by_side", "A5", groups_sql(
    "SELECT group_id, id, CASE WHEN is_government THEN 'government' ELSE 'news' END AS side, title, source FROM gm"))
def _(spark, d):
    return verify.group_members(grouped(spark, d, "levenshtein"))


@query("group_badges_levenshtein", "A6,K2", groups_sql(
    "SELECT badge, count(*) AS groups FROM groups GROUP BY 1"))
def _(spark, d):
    return verify.verification_score(grouped(spark, d, "levenshtein")).groupBy("badge").agg(F.count("*").alias("groups"))


@query("verified_incidents_levenshtein", "J2,K3", groups_sql(
    "SELECT mem.id, g.badge AS v_badge, CAST(g.score AS INT) AS v_score, g.num_sources AS v_sources, g.badge AS v_status FROM mem JOIN groups g USING (group_id)"))
def _(spark, d):
    members = screening.cut(grouped(spark, d, "levenshtein"))
    out = verify.attach_verification(incidents(spark, d), members, verify.build_groups(members))
    return out.select("id", "v_badge", "v_score", "v_sources", "v_status")


@query("verification_join", "J2,K3", with_views(
    "SELECT i.id, g.badge AS v_badge FROM incidents i LEFT JOIN (SELECT title, CASE WHEN count(DISTINCT source) >= 3 THEN 'LIKELY' ELSE 'PARTIAL' END AS badge FROM incidents WHERE country IS NOT NULL GROUP BY 1) g ON g.title = i.title AND i.country IS NOT NULL"))
def _(spark, d):
    rows = incidents(spark, d)
    placed = rows.filter("country IS NOT NULL")
    members = placed.select("id", F.col("title").alias("group_id"))
    groups = placed.groupBy(F.col("title").alias("group_id")).agg(F.countDistinct("source").alias("num_sources")).withColumn(
        "badge", F.when(F.col("num_sources") >= 3, "LIKELY").otherwise("PARTIAL")).withColumn("score", F.lit(0))
    return verify.attach_verification(rows, members, groups).select("id", "v_badge")
