"""One query for each operator over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import landed, rendered, streamed
from .functions import dates as D
from .functions import keywords as K
from .functions import text as X
from .operators import books as B
from .operators import ledger as L
from .operators import news as N
from .operators import rules as U
from .plans import pipelines as P
from .sources import fixtures as S
from .sources import rulepacks as R
from .sources.fixtures import ARTICLES, BOOKS
from .streaming.discussion import log_events
from .work import table

AS_OF, BOOK_AS_OF = "2024-01-02 00:00:00", "2001-11-15 09:30:00"
#: Words of the test tables in place of the production lists.
AGRI_RULES = {"pack": {"core": ["ring", "gear"], "tech": ["red", "bolt"], "consumer": ["small"], "social": ["large"], "human": ["blue"], "policy": ["promo"], "buzz": ["nut"]}, "required": ["ring", "red", "promo", "bolt", "green"], "exclusion": ["economy"], "tech_exclusion": ["brand#7"]}
THEMES = [("metal", 12, ["ring", "bolt", "nut", "gear"]), ("colour", 10, ["red", "blue", "green"]), ("size", 8, ["small", "large", "medium"])]
POPULAR_RULES = {"themes": THEMES, "hooks": ["promo", "ring"], "engaging": ["small"], "practical": ["gear"], "series": ["standard"], "own": ["bolt"], "pv": ["red"], "story": ["economy"], "exclusion": ["brand#7"], "people": (0, 1), "tale": 2}
TREND = ["the", "and", "ing", "the", "with", "that", "was", "xyz"]


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def scored(s: SparkSession, sf: str) -> DataFrame:
    return N.score_news(S.articles(s, sf), R.FIXTURE, R.FIXTURE_EXCLUSION)


def _like(words: list[str], text: str = "text") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.lower()}')" for w in words) + ")"


def _bound(words: list[str], text: str = "txt") -> str:
    hit = lambda w: f"regexp_matches({text}, '(^|[^a-z0-9]){w}($|[^a-z0-9])')" if K.SHORT.match(w) else f"contains({text}, '{w}')"
    return "(" + " OR ".join(map(hit, words)) + ")"


def _count(words: list[str], text: str = "txt") -> str:
    return "(" + " + ".join(f"{_bound([w], text)}::INT" for w in words) + ")"


NEWS_SQL = f"""{ARTICLES}, scored AS (SELECT *, ({" + ".join(f"CASE WHEN {_like(R.FIXTURE[k])} THEN {p} ELSE 0 END" for k, p in R.NEWS_POINTS)})::INT AS score,
  concat_ws(' + ', {", ".join(f"CASE WHEN {_like(R.FIXTURE[k])} THEN '{k}' END" for k, _ in R.NEWS_POINTS)}) AS label FROM articles WHERE NOT {_like(R.FIXTURE_EXCLUSION)} AND {_like(R.FIXTURE["core"])})"""
METRICS_SQL = "metrics AS (SELECT conv_id AS url, count(*) AS posts, sum(length(coalesce(text, '')))::BIGINT AS total_length, floor(sum(length(coalesce(text, '')))::DOUBLE / count(*) + 0.5)::BIGINT AS mean_length FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)"
HEAD = f"TIMESTAMP '{AS_OF}'"
BOOK = f"TIMESTAMP '{BOOK_AS_OF}'"
SIX = f"({BOOK} + INTERVAL 6 MONTH)"


def news_category_score(s, sf):
    return scored(s, sf).select("ord", "score", "label")


def news_exclusion_filter(s, sf):
    return S.articles(s, sf).where(~N.excluded(F.col("text"), R.FIXTURE_EXCLUSION)).select("ord", "link")


def headline_top3(s, sf):
    fresh = S.articles(s, sf).where(N.recent(F.col("iso_ts"), ts(AS_OF), 24))
    out = N.score_news(fresh, R.FIXTURE, R.FIXTURE_EXCLUSION)
    return N.top(out, 3, F.desc("score"), F.desc("iso_ts"), F.col("ord")).select("rank", "ord", "link", "score", "label")


def headline_posted_antijoin(s, sf):
    return N.not_in(S.articles(s, sf), S.posted(s, sf), "ord", "doc_id").select("ord", "link")


def news_tier_fallback(s, sf):
    t = F.col("text")
    return N.tiered(S.articles(s, sf), K.contains_any(t, ["that"]), K.contains_any(t, ["llm"]), K.contains_any(t, ["release"])).select("ord", "tier")


def roblox_score_top5(s, sf):
    return N.top(N.score_roblox(S.articles(s, sf)), 5, F.desc("score"), F.col("ord")).select("rank", "ord", "score", "label")


def global_score_synergy(s, sf):
    return N.score_global(S.articles(s, sf), ["that"], ["llm", "iot"], ["this"]).select("ord", "score", "label")


BOUNDARY = ["ai", "the", "for", "this is", "c++", "in"]


def kw_boundary_match(s, sf):
    words = F.array(*(F.when(K.boundary_hit(F.col("text"), w), F.lit(w)) for w in BOUNDARY))
    return S.articles(s, sf).select(F.explode(F.array_compact(words)).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("docs"))


def kw_match_count(s, sf):
    return S.articles(s, sf).select("ord", K.count_matches(F.col("text"), BOUNDARY).alias("hits"))


def trend_keyword_counts(s, sf):
    return N.trend_counts(S.recent_news(s, sf), TREND).select("keyword", "hits", "rank")


def trend_recent_topics(s, sf):
    return N.recent_topics(S.recent_news(s, sf), TREND, ts("2024-01-04 00:00:00"))


def engagement_metrics(s, sf):
    return N.engagement(S.posts(s, sf)).select("url", "posts", "total_length", "mean_length")


def engagement_dynamic_score(s, sf):
    return N.dynamic_score(scored(s, sf), N.engagement(S.posts(s, sf))).select("ord", "score", "final_score")


def _rules(s) -> DataFrame:
    """The words of the tests as a rule table."""
    news = [(k, p, R.FIXTURE[k]) for k, p in R.NEWS_POINTS]
    books = [(k, p, AGRI_RULES["pack"][k]) for k, p in R.BOOK_POINTS]
    return U.rule_table(s, U.rule_rows("news", news) + U.rule_rows("out", [("out", 0, R.FIXTURE_EXCLUSION)]) + U.rule_rows("count", [("count", 1, BOUNDARY)], "boundary") + U.rule_rows("trend", [("trend", 1, TREND)]) + U.rule_rows("books", books, "boundary"))


def rules_news_score(s, sf):
    t = _rules(s)
    return U.score_news(S.articles(s, sf), U.RuleSet(t, "news"), U.RuleSet(t, "out"), "core").select("ord", "score", "label")


def rules_match_count(s, sf):
    return U.match(S.articles(s, sf).select("ord", "text"), U.RuleSet(_rules(s), "count")).select("ord", F.size("hits").alias("hits"))


def rules_trend_counts(s, sf):
    t = _rules(s)
    return U.keyword_counts(S.recent_news(s, sf), U.RuleSet(t, "trend"), t, "trend").select("keyword", "hits", "rank")


def rules_book_points(s, sf):
    text = F.lower(F.concat_ws(" ", "title", "author", "series", "description"))
    return U.match(S.books(s, sf).select("ord", text.alias("text")), U.RuleSet(_rules(s), "books")).select("ord", "score", F.array_join("categories", " & ").alias("categories"))


def similar_urls(s, sf):
    """Addresses that are at least 85 percent alike."""
    urls = table(s, sf, "pages").groupBy(F.col("url").alias("title")).agg(F.min("page_id").alias("key"))
    return N.similar_pairs(urls, 85)


def _titles(s, sf):
    return table(s, sf, "part").groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("key"))


def title_similarity_pairs(s, sf):
    return N.similar_pairs(_titles(s, sf)).select("a", "b", F.col("similarity"))


def fuzzy_dedup_leaders(s, sf):
    return N.leaders(table(s, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title")))


def book_merge_cover(s, sf):
    return B.merge_by_isbn(S.books(s, sf)).select("ord", "isbn", "title", "cover")


def book_dedupe_identity(s, sf):
    return B.dedupe_by_identity(S.books(s, sf)).select("ord", "identity", "completeness")


def book_partial_date(s, sf):
    return S.books(s, sf).select("ord", "pubdate", F.date_format(D.parse_pubdate(F.col("pubdate")), "yyyy-MM-dd").alias("pub_date"))


def book_date_window(s, sf):
    return S.books(s, sf).where(D.in_window(F.col("pubdate"), ts(BOOK_AS_OF), 2000, True, 60)).select("ord", "pubdate")


def book_adaptive_window(s, sf):
    return B.adaptive_window(S.books(s, sf), ts(BOOK_AS_OF), [(14, 30), (300, 60), (1500, 90), (2500, 90)]).select("ord", "window_no")


def book_freshness_bonus(s, sf):
    return S.books(s, sf).select("ord", D.freshness_bonus(D.parse_pubdate(F.col("pubdate")), F.to_date(ts("1998-03-01 00:00:00"))).alias("bonus"))


def book_quality_bonus(s, sf):
    return S.books(s, sf).select("ord", D.quality_bonus(F.col("review_count") - 12, F.col("review_average"), F.col("description")).alias("bonus"))


def book_agri_score(s, sf):
    return B.agri_score(S.books(s, sf), **AGRI_RULES).select("ord", "keyword_score", F.array_join("categories", " & ").alias("categories"))


def book_popular_score(s, sf):
    return B.popular_score(S.books(s, sf), **POPULAR_RULES).select("ord", "keyword_score", F.array_join("categories", " & ").alias("categories"))


def book_fallback_branch(s, sf):
    b = S.books(s, sf)
    first = B.agri_score(b, **AGRI_RULES).where("keyword_score >= 1000")
    second = B.popular_score(b, **POPULAR_RULES).where("keyword_score >= 30")
    return B.first_branch([first, second]).select("ord", "branch", "keyword_score")


def scrape_body_text(s, sf):
    return table(s, sf, "pages").select("page_id", X.page_body(F.col("html")).alias("body"))


def html_tag_strip(s, sf):
    return table(s, sf, "pages").select("page_id", F.md5(X.strip_tags(F.col("html")).cast("binary")).alias("text_md5"))


def url_host(s, sf):
    return table(s, sf, "pages").select("page_id", X.host(F.col("url")).alias("host"))


def url_clean_utm(s, sf):
    return table(s, sf, "pages").select("page_id", X.without_utm(F.col("url")).alias("clean"))


def url_tracking_params(s, sf):
    return table(s, sf, "pages").select("page_id", X.tracked(F.col("url"), ts("2025-01-31 00:00:00")).alias("tracked"))


def json_extract_props(s, sf):
    text = F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))
    return table(s, sf, "events").select("event_id", X.json_object(text, "k bigint")["k"].alias("k"))


def keyword_rotation(s, sf):
    """The words of each day that has orders."""
    days = table(s, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    turns = s.createDataFrame([(d, "|".join(K.rotate_by_day(R.POPULAR_REVIEW_SEARCH, 8, d))) for d in range(1, 367)], "number int, words string")
    return days.join(F.broadcast(turns), F.dayofyear("day") == F.col("number")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "words")  # a row a day of the year


def keyword_round_robin(s, sf):
    """Axes are brands, their keywords the part names in order of key."""
    p = table(s, sf, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("first"))
    from pyspark.sql.window import Window

    depth = p.withColumn("depth", F.row_number().over(Window.partitionBy("p_brand").orderBy("first")))
    once = B.first_by(depth.withColumn("order", F.struct("depth", "p_brand")), "p_name", "order")
    return N.top(once, 12, F.col("depth"), F.col("p_brand")).select("rank", F.col("p_name").alias("keyword"))


def catalog_insert_if_absent(s, sf):
    pages = table(s, sf, "pages").select(F.col("page_id").alias("ord"), "url", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"))
    catalog = pages.where(X.host(F.col("url")).endswith(".net")).select(X.without_utm(F.col("url")).alias("url"), F.concat(F.lit("c"), F.lpad((F.col("ord") % 90).cast("string"), 3, "0")).alias("content_id"))
    return L.insert_absent(catalog, pages)


def subscriber_batches(s, sf):
    c = table(s, sf, "customer").select(F.col("c_custkey").alias("ord"), F.when(F.col("c_acctbal") < 0, " ").otherwise(F.concat(F.col("c_name"), F.lit("@example.com"))).alias("email"))
    return L.batches(c).groupBy("batch").agg(F.count(F.lit(1)).alias("recipients"), F.min("email").alias("first_email"))


def subscriber_delete(s, sf):
    c = table(s, sf, "customer").select("c_custkey", F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"))
    gone = table(s, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"))
    return N.not_in(c, gone, "email").select("c_custkey", "email")


PRIORITIES = {"1-URGENT": "アンバサダー0日目特典登録", "2-HIGH": "VibeCodingスタートガイド特典登録", "3-MEDIUM": "スターターキット特典登録", "5-LOW": "確定申告テンプレ特典登録"}


def registration_router(s, sf):
    kind = F.coalesce(*(F.when(F.col("o_orderpriority") == k, v) for k, v in PRIORITIES.items()), F.lit("other"))
    r = table(s, sf, "orders").select("o_orderkey", kind.alias("registration_type"), F.when(F.col("o_orderstatus") == "P", "").otherwise("a@example.com").alias("email"))
    return L.route(r).select("o_orderkey", "detail", "mail")


def role_indicator(s, sf):
    from .streaming.discussion import role_indicator as f

    return table(s, sf, "customer").select("c_custkey", f(F.array("c_mktsegment"), "BUILDING", "MACHINERY").alias("user_role"))


def discussion_stream_log(s, sf):
    return log_events(s, f"{sf}/events.parquet", "discussion").select("message_id", "user_id", "news_url", "user_role")


def llm_pick_fallback(s, sf):
    b = P.scored_books(S.books(s, sf), ts(BOOK_AS_OF), True, **POPULAR_RULES).where("keyword_score > 0")
    stub = lambda best: best.groupBy().agg(F.lit('I choose {"index": 99, "reason": "none"}').alias("answer"))  # noqa: E731  no such number: the first is taken
    return P.pick(b, stub).select("ord", "rank", "total")


def headline_pipeline(s, sf):
    return P.headlines(S.articles(s, sf), _posted_links(s, sf), N.engagement(S.posts(s, sf)), ts(AS_OF), R.FIXTURE, R.FIXTURE_EXCLUSION)


RECENT, RECENT_48, BOOK_DAY = "2024-01-02 01:00:00", "2024-01-03 01:00:00", "1995-06-15 09:30:00"


def _posted_links(s, sf):
    return S.posted(s, sf).join(S.articles(s, sf), F.col("doc_id") == F.col("ord")).select("link")


def daily_news_pick(s, sf):
    return P.daily_news(S.articles(s, sf), ts(RECENT), ["that"], ["llm"], ["release"], R.FIXTURE_EXCLUSION, seed=7).select("ord", "link", "tier")


def roblox_daily(s, sf):
    return P.roblox(S.articles(s, sf), ts(RECENT)).select("rank", "ord", "title", "score", "label")


def global_research_top3(s, sf):
    out = P.global_research(S.articles(s, sf), _posted_links(s, sf), ts(RECENT_48), agri=["that"], tech=["llm", "iot"], research=["this"])
    return out.select("rank", "ord", "site", "score", "label")


def _day_books(s, sf, least):
    b = S.books(s, sf)
    out = P.book_of_the_day(b, b, b.where("ord % 50 = 0").select("isbn"), ts(BOOK_DAY), AGRI_RULES, POPULAR_RULES, least)
    return out.select("ord", "isbn", "branch", "window_no", "keyword_score", "freshness", "quality", "total")


def book_of_the_day(s, sf):
    return _day_books(s, sf, (P.AGRI_LEAST, P.POPULAR_LEAST))


def book_of_the_day_general(s, sf):
    """As no book has so many points, the specialist branch is empty."""
    return _day_books(s, sf, ((1000, 1000), P.POPULAR_LEAST))


def book_repost(s, sf):
    return P.repost(S.books(s, sf), ts(BOOK_DAY), **POPULAR_RULES).select("ord", "keyword_score", "total")


def headline_message(s, sf):
    fresh = S.articles(s, sf).where(N.recent(F.col("iso_ts"), ts(AS_OF), 24))
    out = N.score_news(fresh, R.FIXTURE, R.FIXTURE_EXCLUSION)
    return P.render_headline(N.top(out, 3, F.desc("score"), F.desc("iso_ts"), F.col("ord"))).select("rank", "message")


def trend_prompt(s, sf):
    news = S.recent_news(s, sf)
    trend = F.when(F.contains(F.lower("title"), F.lit("the")), F.concat(F.lit("the: "), F.col("ord").cast("string"))).otherwise("none")
    return news.select("ord", P.trend_context(F.lit("Explain."), trend, "none").alias("prompt"))


def shop_links(s, sf):
    b = S.books(s, sf)
    shop = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("https://shop.example/"), F.col("ord").cast("string")))
    catalog = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("https://catalog.example/"), F.col("ord").cast("string"))).otherwise("")
    return b.select("ord", X.shop_links(F.col("isbn"), shop, catalog).alias("links"))


def merged_terms(s, sf):
    """Terms are the first letters of part names, explained by the names."""
    p = table(s, sf, "part")
    return N.merged_terms(p.select(F.col("p_partkey").alias("ord"), F.create_map(F.substring("p_name", 1, 1), F.col("p_name"), F.col("p_brand"), F.col("p_name")).alias("terms")))


def interest_filter(s, sf):
    return S.books(s, sf).where(N.interesting(["Ring", "STEEL"], F.col("title"), F.col("author"), F.col("publisher"))).select("ord", "title")


def log_router(s, sf):
    kind = F.when(F.col("role") == "user", "Discussion").when(F.col("role") == "assistant", "addArticles").when(F.col("role") == "system", "news").otherwise("other")
    posts = table(s, sf, "conversations").select(kind.alias("type"), F.lit(None).cast("string").alias("timestamp"), *(F.col("text").alias(c) for c in ("title", "content", "insight")), *(F.col("conv_id").cast("string").alias(c) for c in ("url", "user_id", "news_url")), F.col("turn").alias("score"), F.lit(1).alias("user_role"))
    return L.log_rows(posts, F.lit(AS_OF)).select("sink", "timestamp", "url", "user_id", "user_role", F.md5(F.coalesce("content", "title").cast("binary")).alias("text_md5"), F.md5(F.col("insight").cast("binary")).alias("insight_md5"), "score")


def archive_rows(s, sf):
    mails = table(s, sf, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("subject"), "url", F.when(F.col("page_id") % 2 == 0, F.col("page_id")).alias("recipients"), F.lit(None).cast("string").alias("body"), F.lit("post").alias("post"))
    return L.archive_row(mails, F.lit(AS_OF))


def mail_hours(s, sf):
    at = F.expr("CAST(ts AS TIMESTAMP_NTZ)")
    return table(s, sf, "events").select("event_id", D.greeting(at).alias("greeting"), D.is_draft_hour(at).alias("draft"), F.date_format(D.today_at(at, 9, 5), "yyyy-MM-dd HH:mm:ss").alias("due"))


NAMES = """daily_news_pick roblox_daily global_research_top3 book_of_the_day book_of_the_day_general book_repost headline_message
trend_prompt shop_links merged_terms interest_filter log_router archive_rows mail_hours news_category_score news_exclusion_filter headline_top3 headline_posted_antijoin news_tier_fallback roblox_score_top5
global_score_synergy kw_boundary_match kw_match_count trend_keyword_counts trend_recent_topics engagement_metrics
engagement_dynamic_score title_similarity_pairs fuzzy_dedup_leaders book_merge_cover book_dedupe_identity book_partial_date
book_date_window book_adaptive_window book_freshness_bonus book_quality_bonus book_agri_score book_popular_score
book_fallback_branch scrape_body_text html_tag_strip url_host url_clean_utm url_tracking_params json_extract_props
keyword_rotation keyword_round_robin catalog_insert_if_absent subscriber_batches subscriber_delete registration_router
role_indicator discussion_stream_log llm_pick_fallback headline_pipeline
rules_news_score rules_match_count rules_trend_counts rules_book_points similar_urls"""
QUERIES = {n: globals()[n] for n in NAMES.split()} | landed.QUERIES | streamed.QUERIES | rendered.QUERIES


def _rob(k: int) -> str:
    return _like([w for w in R.ROBLOX[k][2]])


ROB = f"""rob AS (SELECT ord, ({" + ".join(f"CASE WHEN {_rob(i)} THEN {p} ELSE 0 END" for i, (_, p, _) in enumerate(R.ROBLOX))})::INT AS score,
  concat_ws(' & ', {", ".join(f"CASE WHEN {_rob(i)} THEN '{k}' END" for i, (k, _, _) in enumerate(R.ROBLOX))}) AS label FROM articles)"""
_listed = "(VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(TREND)) + ") AS k(n, keyword)"
TREND_SQL = f"hits AS (SELECT item_id AS ord, n, keyword, TIMESTAMP '2024-01-01 00:00:00' + to_hours(item_id) AS seen FROM benchmark JOIN {_listed} ON contains(lower(text), keyword))"
SIM = "floor((greatest(length(x.title), length(y.title)) - levenshtein(x.title, y.title))::DOUBLE / greatest(length(x.title), length(y.title)) * 100 + 0.5)::INT"
_W = [(14, 30), (300, 60), (1500, 90), (2500, 90)]


def _win(back: int, ahead: int) -> str:
    return f"coalesce(win_date::TIMESTAMP <= {SIX} AND win_date::TIMESTAMP >= {BOOK} - INTERVAL {back} DAY AND win_date::TIMESTAMP <= {BOOK} + INTERVAL {ahead} DAY, false)"


_agri = AGRI_RULES
_txt = "concat_ws(' ', lower(title), lower(author), lower(series), lower(description))"
_full = "concat_ws(' ', lower(title), lower(author), lower(publisher), lower(series))"
AGRI_SQL = f"""agri0 AS (SELECT *, {_txt} AS txt, {_full} AS full_txt FROM books), agri1 AS (SELECT *, CASE WHEN {_like(_agri["exclusion"], "full_txt")} THEN 'generic' WHEN {_like(_agri["tech_exclusion"], "full_txt")} THEN 'off topic'
  WHEN NOT {_bound(_agri["required"])} THEN 'no required theme' WHEN NOT ({" OR ".join(_bound(_agri["pack"][k]) for k in ("core", "tech", "consumer", "social", "policy"))}) THEN 'no core domain' END AS reason,
  ({" + ".join(f"CASE WHEN {_bound(_agri['pack'][k])} THEN {p} ELSE 0 END" for k, p in R.BOOK_POINTS)})::INT AS points, concat_ws(' & ', {", ".join(f"CASE WHEN {_bound(_agri['pack'][k])} THEN '{k}' END" for k, _ in R.BOOK_POINTS)}) AS cats FROM agri0)"""
_ptxt = "concat_ws(' ', lower(title), lower(author), lower(description))"
_pfull = "concat_ws(' ', lower(title), lower(author), lower(publisher))"
_r = POPULAR_RULES
_b = [("several themes", "axes >= 2", 4), ("many sides", "axes >= 3", 3), ("engaging", _bound(_r["engaging"]), 6), ("human nature", f"{_bound(_r['engaging'])} AND (h0 > 0 OR h1 > 0)", 4), ("practical", _bound(_r["practical"]), 4), ("series", _bound(_r["series"]), 4), ("own books", _bound(_r["own"]), 3), ("page views", _bound(_r["pv"]), 2), ("learning story", f"h2 > 0 AND {_bound(_r['story'])}", 3)]
POPULAR_SQL = f"""pop0 AS (SELECT *, {_ptxt} AS txt, {_pfull} AS full_txt FROM dated), pop1 AS (SELECT *, {", ".join(f"{_count(w)} AS h{i}" for i, (_, _, w) in enumerate(THEMES))} FROM pop0),
pop2 AS (SELECT *, (h0 > 0)::INT + (h1 > 0)::INT + (h2 > 0)::INT AS axes FROM pop1),
pop3 AS (SELECT *, CASE WHEN {_like(_r["exclusion"], "full_txt")} THEN 'generic' WHEN axes = 0 THEN 'no theme' WHEN axes < 2 AND NOT {_bound(_r["hooks"])} THEN 'no hook' END AS reason,
  ({" + ".join(f"CASE WHEN h{i} > 0 THEN {p} + least(h{i} - 1, 3) ELSE 0 END" for i, (_, p, _) in enumerate(THEMES))} + {" + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, c, p in _b)})::INT AS points,
  concat_ws(' & ', {", ".join(f"CASE WHEN h{i} > 0 THEN '{n}' END" for i, (n, _, _) in enumerate(THEMES))}, {", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in _b)}) AS cats FROM pop2)"""
FRESH = "CASE WHEN {d} IS NULL THEN 0 WHEN {d} > 90 THEN -10 WHEN {d} > 30 THEN 1 WHEN {d} > 0 THEN 5 WHEN {d} >= -7 THEN 5 WHEN {d} >= -14 THEN 4 WHEN {d} >= -30 THEN 3 WHEN {d} >= -60 THEN 2 WHEN {d} >= -90 THEN 1 ELSE 0 END"
QUAL = "least(CASE WHEN {n} >= 100 THEN 8 WHEN {n} >= 30 THEN 6 WHEN {n} >= 10 THEN 4 WHEN {n} >= 3 THEN 2 ELSE 0 END + CASE WHEN {n} >= 5 AND coalesce(review_average, 0) >= 4 THEN 4 ELSE 0 END + CASE WHEN coalesce(description, '') = '' THEN -3 ELSE 0 END, 12)::INT"
_ALIKE = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 100 ELSE floor((greatest(length({a}), length({b})) - levenshtein({a}, {b}))::DOUBLE / greatest(length({a}), length({b})) * 100 + 0.5) END"


def _greedy(stop: int | None) -> str:
    """From o (i, ord, t), one title after the other: ids, the ord of those that no earlier kept title is like."""
    alike = _ALIKE.format(a="k", b="o.t")
    ok = f"len(list_filter(r.kept, lambda k: {alike} >= 70)) = 0"
    until = f" WHERE len(r.ids) < {stop}" if stop else ""
    return f"r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept, []::BIGINT[] AS ids UNION ALL SELECT o.i, CASE WHEN {ok} THEN list_append(r.kept, o.t) ELSE r.kept END, CASE WHEN {ok} THEN list_append(r.ids, o.ord) ELSE r.ids END FROM r JOIN o ON o.i = r.i + 1{until}), leaders AS (SELECT unnest(ids) AS ord FROM (SELECT ids FROM r ORDER BY i DESC LIMIT 1))"


_DAY = f"TIMESTAMP '{BOOK_DAY}'"
_int = lambda a, b: f"try_cast(regexp_extract(pubdate[{a}:{b}], '^\\s*[+-]?([0-9]+)', 1) AS INT)"


def _near(name: str, windows: list[tuple[int, int]]) -> str:
    inside = lambda back, ahead: f"coalesce(win_date::TIMESTAMP <= {_DAY} + INTERVAL 6 MONTH AND win_date::TIMESTAMP >= {_DAY} - INTERVAL {back} DAY AND win_date::TIMESTAMP <= {_DAY} + INTERVAL {ahead} DAY, false)"
    flags = ", ".join(f"{inside(*w)} AS w{i}" for i, w in enumerate(windows))
    choice = "CASE WHEN count_if(w0) >= 3 THEN 0 WHEN count_if(w1) >= 3 THEN 1 WHEN count_if(w2) >= 3 THEN 2 WHEN count_if(w3) >= 1 THEN 3 ELSE -1 END"
    return f"f_{name} AS (SELECT *, {flags} FROM merged), {name} AS (SELECT f_{name}.*, window_no FROM f_{name}, (SELECT {choice} AS window_no FROM f_{name}) WHERE window_no = -1 OR [w0, w1, w2, w3][window_no + 1])"


_BONUS = f"({FRESH.format(d='(pub_date - DATE ' + chr(39) + BOOK_DAY[:10] + chr(39) + ')')})::INT AS freshness, {QUAL.format(n='review_count')} AS quality"


def _day_sql(least: tuple[tuple[int, int], tuple[int, int]]) -> str:
    branch = lambda i, rows: f"b{i} AS (SELECT ord, isbn, {i} AS branch, window_no, points AS keyword_score, freshness, quality, (points + freshness + quality)::INT AS total FROM (SELECT *, {_BONUS} FROM {rows} WHERE reason IS NULL AND isbn NOT IN (SELECT isbn FROM books WHERE ord % 50 = 0)) WHERE keyword_score >= {least[i][0]} AND total >= {least[i][1]})"
    return f"""WITH {BOOKS}, far AS (SELECT * FROM dated WHERE pubdate IS NULL OR length(pubdate) < 8 OR coalesce(make_date({_int(1, 4)}, 1, 1) + INTERVAL 1 MONTH * ({_int(5, 6)} - 1) + INTERVAL 1 DAY * ({_int(7, 8)} - 1) <= {_DAY} + INTERVAL 6 MONTH, false)),
      one AS (SELECT *, min(ord) OVER (PARTITION BY isbn) AS first_ord FROM far WHERE isbn <> '' QUALIFY row_number() OVER (PARTITION BY isbn ORDER BY (cover <> '') DESC, ord) = 1), merged AS (SELECT * EXCLUDE (ord, first_ord), first_ord AS ord FROM one),
      {_near("near_a", B.AGRI_WINDOWS)}, {_near("near_p", B.POPULAR_WINDOWS)}, {AGRI_SQL.replace("FROM books", "FROM near_a")}, {POPULAR_SQL.replace("FROM dated", "FROM near_p")}, {branch(0, "agri1")}, {branch(1, "pop3")}
      SELECT * FROM b0 UNION ALL SELECT * FROM b1 WHERE (SELECT count(*) FROM b0) = 0"""


_search = K.distinct_words(R.POPULAR_REVIEW_SEARCH)
_mail = {**L.MAIL}

ORACLES = {
    "daily_news_pick": f"WITH {ARTICLES}, t AS (SELECT ord, link, CASE WHEN contains(text, 'that') THEN CASE WHEN contains(text, 'llm') AND contains(text, 'release') THEN 1 WHEN contains(text, 'llm') THEN 2 WHEN contains(text, 'release') THEN 3 ELSE 4 END END AS tier FROM articles WHERE iso_ts >= TIMESTAMP '{RECENT}' - INTERVAL 24 HOUR AND NOT {_like(R.FIXTURE_EXCLUSION)}) SELECT ord, link, tier FROM t WHERE tier = (SELECT min(tier) FROM t) ORDER BY md5('7:' || link), link LIMIT 1",
    "roblox_daily": f"WITH {ARTICLES}, {ROB} SELECT row_number() OVER (ORDER BY score DESC, ord)::INT AS rank, ord, translate(title, '[]', '［］') AS title, score, label FROM rob JOIN articles USING (ord) WHERE score >= 5 AND iso_ts >= TIMESTAMP '{RECENT}' - INTERVAL 24 HOUR QUALIFY rank <= 5",
    "global_research_top3": f"WITH {ARTICLES}, g AS (SELECT ord, link, {_like(['llm', 'iot'])} AS t, contains(text, 'this') AS r FROM articles WHERE contains(text, 'that') AND iso_ts >= TIMESTAMP '{RECENT_48}' - INTERVAL 48 HOUR AND ord NOT IN (SELECT doc_id FROM labels WHERE quality = 0)), s AS (SELECT ord, regexp_extract(link, '^https?://([^/?#]+)', 1) AS site, (5 + CASE WHEN t THEN 15 ELSE 0 END + CASE WHEN r THEN 3 ELSE 0 END)::INT AS score, concat_ws(' + ', 'Agri', CASE WHEN t THEN 'Tech' END, CASE WHEN r THEN 'Research' END, CASE WHEN t THEN 'Agri-Tech Synergy' END) AS label FROM g) SELECT row_number() OVER (ORDER BY score DESC, ord)::INT AS rank, * FROM s QUALIFY rank <= 3",
    "book_of_the_day": _day_sql((P.AGRI_LEAST, P.POPULAR_LEAST)),
    "book_of_the_day_general": _day_sql(((1000, 1000), P.POPULAR_LEAST)),
    "book_repost": f"WITH {BOOKS}, {POPULAR_SQL} SELECT ord, points AS keyword_score, (points + freshness + quality)::INT AS total FROM (SELECT *, {_BONUS} FROM pop3 WHERE reason IS NULL) WHERE total >= {P.REPOST_LEAST} ORDER BY pub_date DESC NULLS LAST, ord LIMIT 1",
    "headline_message": f"WITH {NEWS_SQL}, b AS (SELECT row_number() OVER (ORDER BY score DESC, iso_ts DESC, ord)::INT AS rank, * FROM scored WHERE iso_ts >= {HEAD} - INTERVAL 24 HOUR QUALIFY rank <= 3) SELECT rank, rank || '. [' || translate(CASE WHEN length(title) > 80 THEN title[1:80] || '...' ELSE title END, '[]', '［］') || '](' || link || ') ' || label || ' ' || score AS message FROM b",
    "trend_prompt": "SELECT item_id AS ord, CASE WHEN contains(lower(text), 'the') THEN 'the: ' || item_id || chr(10) ELSE '' END || 'Explain.' AS prompt FROM benchmark",
    "shop_links": f"WITH {BOOKS}, l AS (SELECT ord, list_filter([CASE WHEN ord % 3 = 0 THEN '[楽天ブックス](https://shop.example/' || ord || ')' WHEN isbn <> '' THEN '[楽天ブックス](https://books.rakuten.co.jp/search?sitem=' || isbn || ')' END, CASE WHEN isbn <> '' THEN '[Amazon](https://www.amazon.co.jp/dp/' || isbn || ')' END, CASE WHEN ord % 5 = 0 THEN '[Google Books](https://catalog.example/' || ord || ')' END], lambda x: x IS NOT NULL) AS a FROM books) SELECT ord, CASE WHEN len(a) > 0 THEN array_to_string(a, ' | ') END AS links FROM l",
    "merged_terms": "WITH t AS (SELECT p_partkey * 2 AS pos, p_name[1:1] AS term, p_name AS meaning FROM part UNION ALL SELECT p_partkey * 2 + 1, p_brand, p_name FROM part), m AS (SELECT term, min(pos) AS f, arg_max(meaning, pos) AS meaning FROM t GROUP BY term) SELECT row_number() OVER (ORDER BY f)::INT AS rank, term, meaning FROM m QUALIFY rank <= 5",
    "interest_filter": "SELECT p_partkey AS ord, p_name AS title FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'ring') OR contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'steel')",
    "log_router": f"SELECT CASE role WHEN 'user' THEN 'discussion' WHEN 'assistant' THEN 'addarticles' ELSE 'news' END AS sink, '{AS_OF}' AS timestamp, CASE WHEN role = 'assistant' THEN conv_id::VARCHAR END AS url, CASE WHEN role = 'user' THEN conv_id::VARCHAR END AS user_id, CASE WHEN role = 'user' THEN 1 END::INT AS user_role, md5(text) AS text_md5, CASE WHEN role = 'system' THEN md5(text) END AS insight_md5, CASE WHEN role = 'assistant' THEN turn END AS score FROM conversations WHERE role IN ('user', 'assistant', 'system')",
    "archive_rows": f"SELECT '{AS_OF}' AS sent_at, 'page ' || page_id AS subject, url, CASE WHEN page_id % 2 = 0 THEN page_id ELSE 0 END::BIGINT AS recipients, '' AS body, 'post' AS post FROM pages",
    "mail_hours": "SELECT event_id, CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'evening' END AS greeting, isodow(ts) <= 5 AND hour(ts) = 10 AS draft, strftime(date_trunc('day', ts) + INTERVAL 9 HOUR + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS due FROM events",
    "fuzzy_dedup_leaders": f"WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY min(p_partkey)) AS i, min(p_partkey) AS ord, p_name AS t FROM part GROUP BY p_name), {_greedy(None)} SELECT ord FROM leaders",
    "headline_pipeline": f"WITH RECURSIVE {NEWS_SQL}, {METRICS_SQL}, m AS (SELECT avg(posts) AS p, avg(mean_length) AS l FROM metrics WHERE posts >= 3), f AS (SELECT scored.*, (score + floor(score * (CASE WHEN p >= 10 THEN 0.2::DOUBLE WHEN p >= 5 THEN 0.15::DOUBLE WHEN p >= 3 THEN 0.1::DOUBLE ELSE 0 END) + 0.5) + CASE WHEN l >= 200 THEN floor(score * 0.1::DOUBLE + 0.5) ELSE 0 END)::INT AS final_score FROM scored, m WHERE iso_ts >= {HEAD} - INTERVAL 24 HOUR AND ord NOT IN (SELECT doc_id FROM labels WHERE quality = 0)), o AS (SELECT *, lower(title) AS t, row_number() OVER (ORDER BY final_score DESC, iso_ts DESC, ord) AS i FROM f), {_greedy(3)} SELECT row_number() OVER (ORDER BY i)::INT AS rank, ord, title, link, score, final_score, label FROM o JOIN leaders USING (ord)",
    "news_category_score": f"WITH {NEWS_SQL} SELECT ord, score, label FROM scored",
    "news_exclusion_filter": f"WITH {ARTICLES} SELECT ord, link FROM articles WHERE NOT {_like(R.FIXTURE_EXCLUSION)}",
    "headline_top3": f"WITH {NEWS_SQL} SELECT row_number() OVER (ORDER BY score DESC, iso_ts DESC, ord)::INT AS rank, ord, link, score, label FROM scored WHERE iso_ts >= {HEAD} - INTERVAL 24 HOUR QUALIFY rank <= 3",
    "headline_posted_antijoin": f"WITH {ARTICLES} SELECT ord, link FROM articles WHERE ord NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)",
    "news_tier_fallback": f"WITH {ARTICLES}, t AS (SELECT ord, CASE WHEN contains(text, 'that') THEN CASE WHEN contains(text, 'llm') AND contains(text, 'release') THEN 1 WHEN contains(text, 'llm') THEN 2 WHEN contains(text, 'release') THEN 3 ELSE 4 END END AS tier FROM articles) SELECT ord, tier FROM t WHERE tier = (SELECT min(tier) FROM t)",
    "roblox_score_top5": f"WITH {ARTICLES}, {ROB} SELECT row_number() OVER (ORDER BY score DESC, ord)::INT AS rank, ord, score, label FROM rob WHERE score >= 5 QUALIFY rank <= 5",
    "global_score_synergy": f"WITH {ARTICLES}, g AS (SELECT ord, {_like(['llm', 'iot'])} AS t, contains(text, 'this') AS r FROM articles WHERE contains(text, 'that')) SELECT ord, (5 + CASE WHEN t THEN 15 ELSE 0 END + CASE WHEN r THEN 3 ELSE 0 END)::INT AS score, concat_ws(' + ', 'Agri', CASE WHEN t THEN 'Tech' END, CASE WHEN r THEN 'Research' END, CASE WHEN t THEN 'Agri-Tech Synergy' END) AS label FROM g",
    "kw_boundary_match": f"WITH {ARTICLES} SELECT keyword, count(*)::BIGINT AS docs FROM (" + " UNION ALL ".join(f"SELECT '{w}' AS keyword FROM articles WHERE " + (f"regexp_matches(text, '(^|[^a-z0-9]){w.replace('+', chr(92) + '+')}($|[^a-z0-9])')" if K.SHORT.match(w) else f"contains(text, '{w}')") for w in BOUNDARY) + ") GROUP BY keyword",
    "kw_match_count": f"WITH {ARTICLES} SELECT ord, (" + " + ".join((f"regexp_matches(text, '(^|[^a-z0-9]){w.replace('+', chr(92) + '+')}($|[^a-z0-9])')" if K.SHORT.match(w) else f"contains(text, '{w}')") + "::INT" for w in BOUNDARY) + ")::INT AS hits FROM articles",
    "trend_keyword_counts": f"WITH {TREND_SQL} SELECT keyword, count(*)::BIGINT AS hits, row_number() OVER (ORDER BY count(*) DESC, min(ord * 1000 + n))::INT AS rank FROM hits GROUP BY keyword",
    "trend_recent_topics": f"WITH {TREND_SQL} SELECT keyword, row_number() OVER (ORDER BY min(ord * 1000 + n))::INT AS rank FROM hits WHERE seen >= TIMESTAMP '2024-01-04 00:00:00' - INTERVAL 3 DAY GROUP BY keyword QUALIFY rank <= 5",
    "engagement_metrics": f"WITH {METRICS_SQL} SELECT * FROM metrics",
    "engagement_dynamic_score": f"WITH {NEWS_SQL}, {METRICS_SQL}, m AS (SELECT avg(posts) AS p, avg(mean_length) AS l FROM metrics WHERE posts >= 3) SELECT ord, score, (score + floor(score * (CASE WHEN p >= 10 THEN 0.2::DOUBLE WHEN p >= 5 THEN 0.15::DOUBLE WHEN p >= 3 THEN 0.1::DOUBLE ELSE 0 END) + 0.5) + CASE WHEN l >= 200 THEN floor(score * 0.1::DOUBLE + 0.5) ELSE 0 END)::INT AS final_score FROM scored, m",
    "title_similarity_pairs": f"WITH t AS (SELECT p_name AS title, min(p_partkey) AS key FROM part GROUP BY p_name) SELECT x.key AS a, y.key AS b, {SIM} AS similarity FROM t x JOIN t y ON x.key < y.key WHERE {SIM} >= 70",
    "book_merge_cover": f"WITH {BOOKS} SELECT min(ord) OVER (PARTITION BY isbn) AS ord, isbn, title, cover FROM books WHERE isbn <> '' QUALIFY row_number() OVER (PARTITION BY isbn ORDER BY (cover <> '') DESC, ord) = 1",
    "book_dedupe_identity": f"WITH {BOOKS}, k AS (SELECT ord, CASE WHEN isbn <> '' THEN 'isbn:' || isbn ELSE 'meta:' || lower(title) || '::' || lower(author) END AS identity, ((cover <> '')::INT + (description <> '')::INT + (coalesce(pubdate, '') <> '')::INT + (review_count > 0)::INT)::INT AS completeness FROM books) SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY identity ORDER BY completeness DESC, ord) = 1",
    "book_partial_date": f"WITH {BOOKS} SELECT ord, pubdate, strftime(pub_date, '%Y-%m-%d') AS pub_date FROM dated",
    "book_date_window": f"WITH {BOOKS} SELECT ord, pubdate FROM dated WHERE {_win(2000, 60)}",
    "book_adaptive_window": f"WITH {BOOKS}, f AS (SELECT ord, {', '.join(f'{_win(*w)} AS w{i}' for i, w in enumerate(_W))} FROM dated), c AS (SELECT {', '.join(f'count(*) FILTER (WHERE w{i}) AS n{i}' for i in range(4))} FROM f), p AS (SELECT CASE WHEN n0 >= 3 THEN 0 WHEN n1 >= 3 THEN 1 WHEN n2 >= 3 THEN 2 WHEN n3 >= 1 THEN 3 ELSE -1 END AS window_no FROM c) SELECT ord, window_no FROM f, p WHERE (window_no = 0 AND w0) OR (window_no = 1 AND w1) OR (window_no = 2 AND w2) OR (window_no = 3 AND w3) OR window_no = -1",
    "book_freshness_bonus": f"WITH {BOOKS} SELECT ord, ({FRESH.format(d='(pub_date - DATE ' + chr(39) + '1998-03-01' + chr(39) + ')')})::INT AS bonus FROM dated",
    "book_quality_bonus": f"WITH {BOOKS} SELECT ord, {QUAL.format(n='(review_count - 12)')} AS bonus FROM books",
    "book_agri_score": f"WITH {BOOKS}, {AGRI_SQL} SELECT ord, CASE WHEN reason IS NULL THEN points ELSE -1 END::INT AS keyword_score, coalesce(reason, cats) AS categories FROM agri1",
    "book_popular_score": f"WITH {BOOKS}, {POPULAR_SQL} SELECT ord, CASE WHEN reason IS NULL THEN points ELSE -1 END::INT AS keyword_score, coalesce(reason, cats) AS categories FROM pop3",
    "book_fallback_branch": f"WITH {BOOKS}, {POPULAR_SQL} SELECT ord, 1 AS branch, points AS keyword_score FROM pop3 WHERE reason IS NULL AND points >= 30",
    "html_tag_strip": "SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g')) AS text_md5 FROM pages",
    "url_host": "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages",
    "url_clean_utm": "SELECT page_id, split_part(url, '?utm', 1) AS clean FROM pages",
    "url_tracking_params": r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '#.*$') AS frag, split_part(regexp_replace(url, '#.*$', ''), '?', 1) AS base, regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1) AS q FROM pages),
      p AS (SELECT *, list_filter(string_split(q, '&'), lambda x: q <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content')) AS kept FROM u)
      SELECT page_id, CASE WHEN starts_with(url, 'http') THEN base || '?' || array_to_string(list_concat(kept, ['utm_source=newsletter', 'utm_medium=email', 'utm_campaign=ai_guide_20250131', 'utm_content=' || replace(split_part(url, '/', 3), '.', '_')]), '&') || frag ELSE url END AS tracked FROM p""",
    "json_extract_props": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "keyword_rotation": f"WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day, {_search!r} AS l FROM orders), a AS (SELECT *, (dayofyear(day) * 8 % {len(_search)})::INT AS off FROM d) SELECT strftime(day, '%Y-%m-%d') AS day, array_to_string(list_concat(l[off + 1 :], l)[1:8], '|') AS words FROM a",
    "keyword_round_robin": "WITH p AS (SELECT p_brand, p_name, min(p_partkey) AS f FROM part GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY f) AS depth FROM p), o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY depth, p_brand) = 1) SELECT row_number() OVER (ORDER BY depth, p_brand)::INT AS rank, p_name AS keyword FROM o QUALIFY rank <= 12",
    "catalog_insert_if_absent": "WITH p AS (SELECT page_id, split_part(url, '?utm', 1) AS url, 'page ' || page_id AS title, ends_with(regexp_extract(url, '^https?://([^/?#]+)', 1), '.net') AS held FROM pages), l AS (SELECT max(page_id % 90) AS last FROM p WHERE held), n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1), f AS (SELECT *, row_number() OVER (ORDER BY page_id) + last AS i FROM n, l WHERE url NOT IN (SELECT url FROM p WHERE held)) SELECT 'c' || CASE WHEN i < 100 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END AS content_id, url, title FROM f",
    "subscriber_batches": "WITH c AS (SELECT c_name || '@example.com' AS email, (row_number() OVER (ORDER BY c_custkey) - 1) // 50 AS batch FROM customer WHERE NOT c_acctbal < 0) SELECT batch::BIGINT AS batch, count(*)::BIGINT AS recipients, min(email) AS first_email FROM c GROUP BY batch",
    "subscriber_delete": "SELECT c_custkey, c_name || '@example.com' AS email FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')",
    "registration_router": "WITH r AS (SELECT o_orderkey, o_orderstatus, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITIES.items()) + " ELSE 'other' END AS t FROM orders) SELECT o_orderkey, CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.DETAIL.items()) + " END AS detail, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _mail.items()) + " ELSE 'auto_reply' END END AS mail FROM r",
    "role_indicator": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 0 END::INT AS user_role FROM customer",
    "discussion_stream_log": "SELECT event_id AS message_id, user_id::VARCHAR AS user_id, 'https://news.example/' || ((props->>'$.k')::BIGINT % 10) AS news_url, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 0 END::INT AS user_role FROM events WHERE event_type <> 'error' AND (props->>'$.k')::BIGINT % 10 < 5",
    "llm_pick_fallback": f"WITH {BOOKS}, {POPULAR_SQL}, s AS (SELECT ord, pub_date, (points + {FRESH.format(d='(pub_date - DATE ' + chr(39) + BOOK_AS_OF[:10] + chr(39) + ')')} + {QUAL.format(n='review_count')})::INT AS total FROM pop3 WHERE reason IS NULL) SELECT ord, 1 AS rank, total FROM s ORDER BY total DESC, pub_date DESC NULLS LAST, ord LIMIT 1",
    "rules_book_points": f"WITH {BOOKS}, {AGRI_SQL} SELECT ord, points AS score, cats AS categories FROM agri1",
    "similar_urls": "WITH t AS (SELECT url AS title, min(page_id) AS key FROM pages GROUP BY url) SELECT x.key AS a, y.key AS b, " + SIM + " AS similarity FROM t x JOIN t y ON x.key < y.key WHERE " + SIM + " >= 85",
} | landed.ORACLES | streamed.ORACLES | rendered.ORACLES
ORACLES |= {new: ORACLES[old] for new, old in (("rules_news_score", "news_category_score"), ("rules_match_count", "kw_match_count"), ("rules_trend_counts", "trend_keyword_counts"))}
