"""Page facts, terms, links and text jobs."""

from pyspark.sql import functions as F

from trailmark.functions import html, text
from trailmark.operators import content as c
from trailmark.streaming import term_frequencies as tf
from workload import bridge as b

QUERIES, ORACLE = {}, {}
C, R = b.CONFIG, b.REGISTRY
WORD = "[\\p{L}\\p{N}][\\p{L}\\p{N}''’-]*"


def query(name, sql=None, extra="", recursive=False):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = lambda: b.sql(sql() if callable(sql) else sql, extra() if callable(extra) else extra, recursive)
        return fn
    return add


def facts(spark, d):
    return c.analyze_pages(b.wide_table(spark, d, "pages").withColumn("modified", F.lit(b.AS_OF) - F.col("page_id") % 500 * 86400), C)


# Words that are no terms, as SQL.
STOP_SQL = """
'a', 'about', 'above', 'after', 'again', 'against', 'all', 'also', 'am', 'an', 'and', 'any', 'are', 'as', 'at', 
'be', 'because', 'been', 'before', 'being', 'below', 'between', 'both', 'but', 'by', 'can', 'could', 'did', 
'do', 'does', 'doing', 'down', 'during', 'each', 'even', 'every', 'few', 'for', 'from', 'further', 'get', 
'got', 'had', 'has', 'have', 'having', 'he', 'her', 'here', 'hers', 'herself', 'him', 'himself', 'his', 'how', 
'however', 'i', 'if', 'in', 'into', 'is', 'it', 'its', 'itself', 'just', 'let', 'like', 'make', 'many', 'may', 
'me', 'might', 'more', 'most', 'much', 'must', 'my', 'myself', 'need', 'new', 'no', 'nor', 'not', 'now', 'of', 
'off', 'on', 'once', 'one', 'only', 'or', 'other', 'our', 'ours', 'ourselves', 'out', 'over', 'own', 'per', 
'really', 'same', 'see', 'she', 'should', 'so', 'some', 'still', 'such', 'than', 'that', 'the', 'their', 
'theirs', 'them', 'themselves', 'then', 'there', 'these', 'they', 'thing', 'things', 'this', 'those', 'though', 
'through', 'to', 'too', 'two', 'under', 'until', 'up', 'upon', 'us', 'use', 'used', 'using', 'very', 'via', 
'want', 'was', 'way', 'we', 'well', 'were', 'what', 'when', 'where', 'whether', 'which', 'while', 'who', 
'whom', 'whose', 'why', 'will', 'with', 'within', 'without', 'would', 'yes', 'yet', 'you', 'your', 'yours', 
'yourself', 'yourselves', 'read', 'more', 'click', 'here', 'share', 'post', 'posts', 'page', 'menu', 'skip', 
'content', 'home', 'search', 'copyright', 'reserved', 'rights', 'cookie', 'cookies', 'privacy', 'policy', 
'best', 'guide', 'tips', 'part', 'explained', 'uncategorized', 'review', 'reviews', 'ultimate', 'complete', 
'hello', 'world'"""


def _drop(expr, *tags):
    for t in tags:
        expr = f"regexp_replace({expr}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')"
    return expr


_ARTICLE = "regexp_extract(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<article(?:\\s[^>]*)?>(.*?)</article\\s*>', 1)"
_TEXT = b.unescape_sql("trim(regexp_replace(regexp_replace(regexp_replace(body, '(?is)</(?:p|div|li|h[1-6]|td|th|br|section|article)>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))")
_SENT = """list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\\s+([\\p{Lu}\\p{N}"“])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"""
FACTS = f"""
bodies AS (SELECT page_id, url, html, {_drop(_ARTICLE, *html.CHROME)} AS body FROM pages),
texts AS (SELECT *, {_TEXT} AS text FROM bodies),
paras AS (SELECT page_id, list_transform(string_split_regex(body, '(?is)<p(?:\\s[^>]*)?>')[2:],
    lambda p: len(regexp_extract_all({b.unescape_sql("regexp_replace(string_split(p, '</p>')[1], '(?s)<[^>]*>', '', 'g')")}, '{WORD}'))) AS counts FROM bodies),
facts AS (SELECT page_id, url, body, text, len(regexp_extract_all(text, '{WORD}')) AS words, {_SENT} AS sentences,
    coalesce(list_filter(counts, lambda n: n >= 5)[1], 0) AS first_para_words,
    regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang,
    trim(regexp_replace({b.unescape_sql("regexp_extract(html, '<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS title,
    len(regexp_extract_all(body, '(?i)<(?:ul|ol|dl)[\\s/>]')) AS lists
  FROM texts JOIN paras USING (page_id))"""


@query("page_facts", """
SELECT page_id, title, lang, words, lists, len(regexp_extract_all(body, '(?i)<h2[\\s/>]')) AS h2, len(regexp_extract_all(body, '(?i)<h3[\\s/>]')) AS h3,
  len(regexp_extract_all(body, '(?i)<img[\\s/>]')) AS images, first_para_words,
  CAST(CASE WHEN len(sentences) > 0 THEN round(words / len(sentences)) ELSE 0 END AS BIGINT) AS avg_sentence,
  len(list_filter(sentences, lambda s: s LIKE '%?')) AS questions, md5(text) AS text_hash,
  regexp_matches(html, '(?i)<meta[^>]*\\bname="?(robots|googlebot)\\b[^>]*\\bno(index|ne)\\b') AS noindex,
  canonical <> '' AND """ + b.PATH_SQL.format(u="canonical") + " <> " + b.PATH_SQL.format(u="url") + """ AS canonical_elsewhere
FROM (SELECT *, regexp_extract(html, '(?i)<link[^>]*rel="?canonical"?[^>]*href="?([^"\\s>]+)', 1) AS canonical FROM facts JOIN pages USING (page_id, url))""", FACTS)
def page_facts(spark, d):
    return facts(spark, d).select(
        "page_id", "title", "lang", "words", "lists", "h2", "h3", "images", "first_para_words", "avg_sentence",
        F.size("questions").alias("questions"), F.md5("text").alias("text_hash"), "noindex", "canonical_elsewhere")


# The driver's pages hold little but text, so tags that facts are made of are put around it by page number

def rich_pages(spark, d):
    """page_id, url, html: the driver's pages with metas, structured data, headings, images, links, lists and questions."""
    p = F.col("page_id")
    n = b.table(spark, d, "pages").agg(F.count("*")).scalar()
    target = b.page_paths(spark, d).select(F.col("page_id").alias("to_page"), F.col("path").alias("to_path"))
    rows = b.wide_table(spark, d, "pages").withColumn("to_page", (p * 3 + 1) % n).join(target, "to_page")
    lit, num = F.lit, p.cast("string")
    some = lambda k, text: F.repeat(lit(text), (p % k).cast("int"))
    when = lambda cond, text: F.when(cond, text).otherwise("")
    head = F.concat(
        lit("<html lang='xx'><head><title>Tea &amp; "), num, lit("</title>"),
        when(p % 2 == 0, F.concat(lit('<META content="All of &quot;'), num, lit('&quot;" NAME=Description>'))),
        when(p % 5 == 0, "<meta name='robots' content='noindex, follow'>"), when(p % 7 == 0, '<meta name="googlebot" content="noai">'),
        when(p % 3 == 0, F.concat(lit('<link href="'), "url", lit('" rel="Canonical">'))), when(p % 3 == 1, F.concat(lit("<link rel=canonical href=/moved/"), num, lit(">"))),
        when(p % 4 == 0, '<script type="application/ld+json">{"@type":"Article","author":{"@type": "Person"}}</script>'),
        when(p % 4 == 1, '<script type="application/ld+json">{"@type":["FAQPage","WebPage"]}</script>'),
        lit("<!-- <meta name='robots' content='noindex'> <h1>No</h1> --></head><body><nav><h2>Menu</h2><img src=m.png><a href=/menu>m</a></nav>"))
    body = F.concat(
        lit("<main><h1>Head "), num, lit("</h1><p>Hi.</p><p>One two <b>three</b> four &amp; five six.</p>"), some(4, "<H2 class=x>Part <i>one</i></H2><div><p>Body.</p></div>"),
        some(3, "<h3>What is tea?</h3>"), some(2, "<h4>Notes</h4>"), some(3, "<img src=a.png>"), some(2, "<img alt='ok' src=b.png><ul><li>a</li></ul><table><tr><td>t</td></tr></table>"),
        lit('<img role="presentation" src=c.png><a href="'), "to_path", lit('#part">in</a><a href="mailto:a@b">m</a><a href="#top">t</a>'), some(3, '<a href="https://other.example/x">out</a>'),
        when(p % 4 == 2, '<div itemscope itemtype="https://schema.org/Product">p</div>'), when(p % 6 == 0, "<details>Q</details>"), when(p % 6 == 1, '<div class="my-faq">Q</div>'),
        lit("</main><footer><h2>Foot</h2><img src=f.png></footer></body></html>"))
    return rows.select("page_id", "url", F.concat(head, body).alias("html"))


RICH = """rich AS (SELECT p.page_id, p.path, t.path AS to_path FROM page_paths p CROSS JOIN page_total JOIN page_paths t ON t.page_id = (p.page_id * 3 + 1) % n)"""


@query("page_tags", """
SELECT page_id, 'Tea & ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'All of "' || page_id || '"' END AS description,
  concat_ws('|', CASE WHEN page_id % 5 = 0 THEN 'robots: noindex, follow' END, CASE WHEN page_id % 7 = 0 THEN 'googlebot: noai' END) AS robots,
  page_id % 5 = 0 AS noindex, page_id % 7 = 0 AS noai, page_id % 3 = 1 AS canonical_elsewhere, 'xx' AS lang, 'Head ' || page_id AS h1,
  CASE page_id % 4 WHEN 0 THEN 'Article|Person' WHEN 1 THEN 'FAQPage|WebPage' WHEN 2 THEN 'Product' ELSE '' END AS schema,
  page_id % 4 AS h2, page_id % 3 + page_id % 2 AS h3, repeat('Part one|', (page_id % 4)::INT) || repeat('What is tea?|', (page_id % 3)::INT) || repeat('Notes|', (page_id % 2)::INT) AS headings,
  page_id % 3 AS question_headings, page_id % 3 + page_id % 2 + 1 AS images, page_id % 3 AS images_no_alt, page_id % 2 AS lists, page_id % 2 AS tables,
  page_id % 3 AS external_links, page_id % 6 < 2 AS faq, 6 AS first_para_words FROM page_paths""")
def page_tags(spark, d):
    f = c.analyze_pages(rich_pages(spark, d), C)
    return f.select(
        "page_id", "title", "description", F.array_join("robots_meta", "|").alias("robots"), "noindex", "noai", "canonical_elsewhere", "lang", "h1",
        F.array_join("schema", "|").alias("schema"), "h2", "h3", F.array_join(F.transform("headings", lambda x: F.concat(x, F.lit("|"))), "").alias("headings"),
        F.size("question_headings").alias("question_headings"), "images", "images_no_alt", "lists", "tables", "external_links", "faq", "first_para_words")


@query("stored_content", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 96 ELSE 79 END AS enough, CASE WHEN page_id % 2 = 0 THEN 1 ELSE page_id % 4 END AS h2,
  CASE WHEN page_id % 2 = 0 THEN 'Stored' ELSE CASE WHEN page_id % 4 > 0 THEN 'Part one' WHEN page_id % 3 > 0 THEN 'What is tea?' ELSE 'Notes' END END AS first_heading,
  page_id % 5 = 0 AS noindex FROM page_paths""")
def stored_content(spark, d):
    """Content from the store counts where it has 80 words; the head stays that of the served page."""
    words = F.when(F.col("page_id") % 2 == 0, 95).otherwise(78)
    local = F.concat(F.lit("<!-- wp --><h2>Stored</h2><script>no</script><p>"), F.repeat(F.lit("word "), words), F.lit("</p>"))
    f = c.analyze_pages(rich_pages(spark, d).withColumn("local_html", local), C)
    return f.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("words")).otherwise(79).alias("enough"), "h2",
                    F.get("headings", F.lit(0)).alias("first_heading"), "noindex")


INTENT = """
intents AS (SELECT page_id, lower(title || ' ') AS t, title || ' ' || lower(text) AS tb, lower(text) AS b FROM facts)"""


# Wording that tells what a visitor wants, as SQL.
INTENT_CASE = r"""CASE
  WHEN regexp_matches(t, '\b(buy|price|pricing|order now|add to cart|shop|discount|coupon|free trial|sign up|book now|get a quote)\b') THEN 'transactional'
  WHEN regexp_matches(tb, '\b(near me|opening hours|directions|our location|visit us|in [A-Z][a-z]+)\b') AND regexp_matches(b, '\b(address|phone|call us|opening hours)\b') THEN 'local'
  WHEN regexp_matches(t, '\b(best|top \d+|vs\.?|versus|review|reviews|compared?|comparison|alternatives?|pros and cons)\b') THEN 'commercial'
  WHEN regexp_matches(t, '\b(how|what|why|when|guide|tutorial|tips|ways|steps|explained|meaning|definition|examples?)\b') THEN 'informational'
  WHEN regexp_matches(t, '\b(contact|about us|login|account|support)\b') THEN 'navigational' ELSE 'informational' END"""


@query("page_intent", f"SELECT page_id, {INTENT_CASE} AS intent FROM intents", FACTS + "," + INTENT)
def page_intent(spark, d):
    return facts(spark, d).select("page_id", F.col("intent.intent").alias("intent"))


@query("word_counts", f"SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) AS words FROM documents")
def word_counts(spark, d):
    return b.table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("sentences", f"SELECT doc_id, len({_SENT}) AS sentences, len(list_filter({_SENT}, lambda s: s LIKE '%?')) AS questions FROM documents")
def sentences(spark, d):
    s = text.sentences(F.col("text"))
    return b.table(spark, d, "documents").select(
        "doc_id", F.size(s).alias("sentences"), F.size(F.filter(s, lambda x: x.endswith("?"))).alias("questions"))


@query("question_turns", r"""
SELECT role, count(*) AS turns, count(*) FILTER (regexp_matches(trim(text), '\?\s*$') OR regexp_matches(trim(text),
  '^(?i)(how|what|why|when|where|which|who|whom|whose|can|could|does|do|did|is|are|should|will|would)\b')) AS questions
FROM conversations GROUP BY role""")
def question_turns(spark, d):
    return b.table(spark, d, "conversations").groupBy("role").agg(
        F.count("*").alias("turns"), F.count_if(text.is_question(F.col("text"))).alias("questions"))


def _terms_sql(source, key="page_id"):
    return f"""
tokens AS (SELECT {key}, part, pos, CASE WHEN length(w) BETWEEN 3 AND 40 AND NOT regexp_matches(w, '^\\d+$') AND w NOT IN ({STOP_SQL}) THEN w END AS w
  FROM (SELECT {key}, part, pos, regexp_replace(raw, '^[-''’]+|[-''’]+$', '', 'g') AS w FROM (
    SELECT {key}, part, unnest(ws) AS raw, generate_subscripts(ws, 1) AS pos FROM (
      SELECT {key}, part, regexp_extract_all(lower(txt), '{WORD}') AS ws FROM ({source}))))),
mentions AS (
  SELECT {key}, part, w AS term, pos * 2 AS ord FROM tokens WHERE w IS NOT NULL
  UNION ALL SELECT {key}, part, prev || ' ' || w, pos * 2 + 1 FROM (
    SELECT *, lag(w) OVER (PARTITION BY {key}, part ORDER BY pos) AS prev FROM tokens) WHERE prev IS NOT NULL AND w IS NOT NULL),
counted AS (SELECT {key}, term, CAST(sum(CASE part WHEN 0 THEN 1 ELSE 3 END) AS BIGINT) AS weight, min(part * 100000000 + ord) AS ord
  FROM mentions GROUP BY {key}, term),
terms AS (SELECT {key}, term, weight FROM counted WHERE NOT contains(term, ' ') OR weight >= 2)"""


PAGE_TEXTS = "SELECT page_id, 0 AS part, text AS txt FROM facts UNION ALL SELECT page_id, 1, title || ' ' FROM facts"
DOC_TEXTS = "SELECT doc_id, 0 AS part, text AS txt FROM documents"


def page_texts(spark, d):
    return facts(spark, d).select("page_id", "text", F.concat_ws(" ", "title", F.array_join("headings", " ")).alias("emphasis"))


def page_terms(spark, d):
    return c.term_counts(page_texts(spark, d), text.STOP_WORDS)


def stored_terms(spark, d):
    """Terms of all pages with the total of each page, made once: document frequencies and scores both read them."""
    return c.term_rows(b.written(spark, c.term_lists(page_texts(spark, d), text.STOP_WORDS), "terms"))


def page_total(spark, d):
    return b.table(spark, d, "pages").agg(F.count("*")).scalar()


@query("page_terms", "SELECT page_id, term, weight FROM terms", lambda: FACTS + "," + _terms_sql(PAGE_TEXTS))
def page_terms_query(spark, d):
    return page_terms(spark, d)


@query("document_terms", "SELECT doc_id, term, weight FROM terms", lambda: _terms_sql(DOC_TEXTS, "doc_id"))
def document_terms(spark, d):
    rows = b.wide_table(spark, d, "documents").select("doc_id", "text", F.lit("").alias("emphasis"))
    return c.term_counts(rows, text.STOP_WORDS, key="doc_id")


@query("document_frequency", "SELECT term, count(*) AS df FROM terms GROUP BY term", lambda: FACTS + "," + _terms_sql(PAGE_TEXTS))
def document_frequency(spark, d):
    return c.document_frequency(page_terms(spark, d))


RANKED = """
dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
ranked AS (SELECT page_id, term, weight AS count, df AS pages, round(raw, 4) AS score,
    row_number() OVER (PARTITION BY page_id ORDER BY round(raw, 9) DESC, term) AS rank FROM (
  SELECT t.*, df, weight / greatest(sum(weight) OVER (PARTITION BY page_id), 1) * (ln((n + 1) / (df + 1)) + 1)
    * CASE WHEN contains(t.term, ' ') THEN 1.3 ELSE 1.0 END AS raw
  FROM terms t JOIN dfs USING (term), page_total) QUALIFY rank <= 12)"""


@query("key_terms", "SELECT * FROM ranked", lambda: FACTS + "," + _terms_sql(PAGE_TEXTS) + "," + RANKED)
def key_terms(spark, d):
    terms = stored_terms(spark, d)
    return c.key_terms(terms, c.document_frequency(terms), page_total(spark, d))


@query("term_changes", """
SELECT term, CAST(sum(x) AS BIGINT) AS delta FROM (
  SELECT term, 1 AS x FROM terms t WHERE page_id % 3 <> 0 AND NOT (page_id % 2 = 0)
  UNION ALL SELECT term, -1 FROM terms WHERE page_id % 2 = 0 AND page_id % 3 = 0) GROUP BY term""",
       lambda: FACTS + "," + _terms_sql(PAGE_TEXTS))
def term_changes(spark, d):
    """Half of the pages were analysed before, two thirds are now."""
    terms = page_terms(spark, d)
    return c.term_changes(terms.filter("page_id % 2 = 0"), terms.filter("page_id % 3 <> 0"))


@query("document_frequency_log", "SELECT term, count(*) AS df FROM terms WHERE page_id % 7 <> 3 AND page_id % 5 <> 4 GROUP BY term",
       lambda: FACTS + "," + _terms_sql(PAGE_TEXTS))
def document_frequency_log(spark, d):
    """Three batches: pages as they were, pages analysed anew (one batch comes twice), and pages deleted."""
    texts, root = b.written(spark, page_texts(spark, d), "texts"), b.scratch_dir(spark, "frequencies")
    words, pid = F.col("text"), F.col("page_id")
    stamped = lambda rows, at, deleted=False: rows.withColumns({"at": F.lit(at).cast("bigint"), "deleted": F.lit(deleted)})
    first = texts.select("page_id", F.when(pid % 3 == 0, F.concat(words, F.lit(" obsolete wording obsolete wording"))).otherwise(words).alias("text"), "emphasis")
    edited = stamped(texts.filter("page_id % 3 = 0"), 2).unionByName(stamped(texts.filter("page_id % 5 = 4"), 3, True))
    apply = tf.keep_frequencies(root, text.STOP_WORDS)
    apply(stamped(first, 1), 0)
    apply(edited, 1)
    apply(edited, 1)
    apply(stamped(texts.filter("page_id % 7 = 3"), 4, True), 2)
    return tf.frequencies(spark, root)


@query("topics", """
SELECT term, pages, weight FROM (SELECT term, count(*) AS pages, CAST(sum(weight) AS BIGINT) AS weight FROM terms
  WHERE page_id IN (SELECT page_id FROM live) GROUP BY term HAVING count(*) >= 2) x
WHERE EXISTS (SELECT 1 FROM live WHERE CASE WHEN contains(lower(title), x.term) THEN
  regexp_matches(lower(title), '(^|[^\\p{L}\\p{N}])' || regexp_escape(x.term) || '($|[^\\p{L}\\p{N}])') ELSE FALSE END)
ORDER BY weight DESC, term LIMIT 30""", lambda: FACTS + "," + _terms_sql(PAGE_TEXTS))
def topics(spark, d):
    return c.topics(page_terms(spark, d), b.inventory(spark, d))


@query("entities", lambda: f"""
SELECT doc_id, phrase, count(*) AS mentions, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank FROM (
  SELECT doc_id, s * 100000 + i AS pos, sentence, regexp_replace(raw, '^[ .''’-]+|[ .''’-]+$', '', 'g') AS phrase FROM (
    SELECT doc_id, s, sentence, unnest(ps) AS raw, generate_subscripts(ps, 1) AS i FROM (
      SELECT doc_id, s, sentence, regexp_extract_all(' ' || sentence, '\\s(\\p{{Lu}}[\\p{{L}}\\p{{N}}&\\.''’-]+(?:\\s+(?:of|the|de|la|and|&)?\\s*\\p{{Lu}}[\\p{{L}}\\p{{N}}&\\.''’-]+){{0,3}})', 1) AS ps FROM (
        SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS s FROM (SELECT doc_id, {_SENT} AS ss FROM documents)))))
WHERE NOT (starts_with(ltrim(sentence), phrase) AND NOT contains(phrase, ' ')) AND length(phrase) >= 3
  AND lower(phrase) NOT IN ({STOP_SQL})
GROUP BY doc_id, phrase HAVING count(*) >= 2 OR contains(phrase, ' ')""")
def entities(spark, d):
    return c.entities(b.wide_table(spark, d, "documents").select("doc_id", "text"), text.STOP_WORDS, key="doc_id")


# links: the driver's pages link to paths outside the inventory, so edges are derived from page ids

def edges(spark, d):
    n = b.table(spark, d, "pages").agg(F.count("*")).scalar()
    pid = F.col("page_id")
    return b.inventory(spark, d).select(
        F.col("page_id").alias("from_page"),
        F.explode(F.array((pid * 7 + 1) % n, (pid * 3 + 2) % n, (pid % n) * (pid % n) % n)).alias("target"))


EDGES = """
edge_ids AS (SELECT page_id AS from_page, unnest([(page_id * 7 + 1) % n, (page_id * 3 + 2) % n, (page_id * page_id) % n]) AS target
  FROM inventory, page_total),
links AS (SELECT DISTINCT from_page AS from_id, i.page_id AS to_id FROM edge_ids JOIN page_paths p ON p.page_id = target
  JOIN live i ON i.url_hash = p.url_hash WHERE i.page_id <> from_page)"""


def links(spark, d):
    target = b.page_paths(spark, d).select(F.col("page_id").alias("target"), "path")
    found = edges(spark, d).join(target, "target").groupBy(F.col("from_page").alias("page_id")).agg(
        F.collect_set("path").alias("links"))  # three links per page
    return c.resolve_links(found, b.inventory(spark, d))


@query("resolved_links", "SELECT from_id, to_id FROM links", EDGES)
def resolved_links(spark, d):
    return links(spark, d)


@query("link_counts", """
SELECT page_id, CAST(sum(i) AS BIGINT) AS inlinks, CAST(sum(o) AS BIGINT) AS outlinks FROM (
  SELECT to_id AS page_id, 1 AS i, 0 AS o FROM links UNION ALL SELECT from_id, 0, 1 FROM links) GROUP BY page_id""", EDGES)
def link_counts(spark, d):
    return c.link_counts(links(spark, d))


@query("page_links", """
SELECT DISTINCT r.page_id AS from_id, i.page_id AS to_id FROM rich r JOIN live i ON i.url_hash = md5(lower(r.to_path)) WHERE r.to_path <> r.path AND i.page_id <> r.page_id""", RICH)
def page_links(spark, d):
    """Links inside the main content, resolved to pages of the inventory."""
    return c.resolve_links(c.analyze_pages(rich_pages(spark, d), C).select("page_id", "links"), b.inventory(spark, d))


@query("link_suggestions", """
SELECT target_id, from_id, count(*) AS shared_terms, CAST(sum(weight) AS BIGINT) AS weight,
  arg_max(term, (CASE WHEN contains(term, ' ') THEN 'b' ELSE 'a' END) || printf('%012.6f', target_score) || term) AS anchor,
  row_number() OVER (PARTITION BY target_id ORDER BY count(*) DESC, sum(weight) DESC, from_id) AS rank
FROM (SELECT o.target_id, t.page_id AS from_id, t.term, t.weight, o.target_score FROM terms t JOIN own o USING (term)
      WHERE t.page_id <> o.target_id AND t.page_id IN (SELECT page_id FROM live)
        AND NOT EXISTS (SELECT 1 FROM links l WHERE l.from_id = t.page_id AND l.to_id = o.target_id))
GROUP BY target_id, from_id QUALIFY rank <= 3""", lambda: FACTS + "," + _terms_sql(PAGE_TEXTS) + "," + RANKED + "," + EDGES + """,
targets AS (SELECT page_id AS target_id FROM live WHERE analyzed AND (importance >= 40 OR pinned > 0) AND inlinks < 5 AND object_type = 'post'),
own AS (SELECT target_id, term, score AS target_score FROM ranked r JOIN targets ON target_id = r.page_id, page_total
  WHERE pages >= 2 AND pages <= greatest(3.0, n * 0.3) QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY rank) <= 6)""")
def link_suggestions(spark, d):
    terms, n = stored_terms(spark, d), page_total(spark, d)
    ranked = c.key_terms(terms, c.document_frequency(terms), n)
    # at a few hundred pages no term is frequent: a lower limit sends some through the index of frequent terms
    return c.suggest_links(terms, ranked, links(spark, d), b.inventory(spark, d), n, C, light=20)


_WORDY = f"len(regexp_extract_all(t, '{WORD}'))"
_PATTERNS = f"""
stripped AS (SELECT page_id, lower(trim(title)) AS raw, trim(regexp_replace(regexp_replace(regexp_replace(
    trim(string_split_regex(lower(title), '\\s[—–|:]\\s|\\s-\\s')[1]),
    '^(how to|how do (i|you)|what (is|are)|why (is|are|do|does)|the ultimate guide to|a guide to|guide to|the best|best|top \\d+|the|a|an)\\s+', ''),
    '\\s+(guide|explained|tips|review|reviews|for beginners|\\d{{4}})$', ''), '[?!.]+$', '')) AS t FROM facts),
subjects AS (SELECT page_id, raw, CASE WHEN {_WORDY} BETWEEN 1 AND 6 THEN t ELSE '' END AS own FROM stripped),
about AS (SELECT s.page_id, raw, own, CASE WHEN own <> '' THEN own ELSE coalesce(term, '') END AS t, {INTENT_CASE.replace("(t,", "(i.t,")} AS intent
  FROM subjects s JOIN intents i USING (page_id) LEFT JOIN (SELECT page_id, term FROM ranked WHERE rank = 1) USING (page_id)),
best AS (SELECT *, CASE WHEN regexp_matches(t, '\\bbest\\b') THEN t ELSE 'best ' || t END AS b FROM about)"""


@query("query_patterns", """
SELECT page_id, own AS subject, CASE WHEN t = '' OR page_id % 11 = 0 THEN '' ELSE array_to_string(list_transform(CASE
  WHEN raw LIKE '%?' THEN [raw, t || ' explained']
  WHEN raw LIKE 'how to %' THEN ['how to ' || t, 'how long does it take to ' || t, t || ' step by step', t || ' for beginners', 'common mistakes when you ' || t]
  WHEN intent = 'transactional' THEN [t || ' price', 'where to buy ' || t, 'is ' || t || ' worth it', t || ' reviews']
  WHEN intent = 'commercial' THEN [b, t || ' alternatives', 'which ' || t || ' should I choose', t || ' pros and cons']
  WHEN intent = 'local' THEN [t || ' near me', b || ' in my area', t || ' opening hours']
  ELSE ['what is ' || t, 'how does ' || t || ' work', t || ' explained', t || ' examples', 'common ' || t || ' mistakes'] END, lambda x: trim(x)), ' | ') END AS patterns
FROM best""", lambda: FACTS + "," + INTENT + "," + _terms_sql(PAGE_TEXTS) + "," + RANKED + "," + _PATTERNS)
def query_patterns(spark, d):
    """Pages whose number is a multiple of eleven are no posts."""
    # the pages are analysed once; what terms, frequencies and templates need of them is stored
    texts = facts(spark, d).select("page_id", "title", F.col("intent.intent").alias("intent"), "text", F.concat_ws(" ", "title", F.array_join("headings", " ")).alias("emphasis"))
    stored = b.written(spark, c.term_lists(texts, text.STOP_WORDS, keep=("title", "intent")), "terms")
    terms = c.term_rows(stored)
    top = c.key_terms(terms, c.document_frequency(terms), page_total(spark, d), limit=1).select("page_id", "term")
    kind = F.when(F.col("page_id") % 11 == 0, "home").otherwise("post")
    made = text.query_patterns(F.col("title"), F.col("term"), F.col("intent"), kind)
    return stored.join(top, "page_id", "left").select("page_id", text.subject(F.col("title")).alias("subject"), F.array_join(made, " | ").alias("patterns"))


@query("nested_regions", """
SELECT page_id, 'A' || t || 'B' || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'C' || t END AS words FROM (SELECT page_id, regexp_replace(lower(url), '[^a-z]', '', 'g') AS t FROM pages)""")
def nested_regions(spark, d):
    """Articles within articles, and main within main; a third of the pages close after the first inner one."""
    t = F.regexp_replace(F.lower("url"), "[^a-z]", "")
    tag = F.when(F.col("page_id") % 2 == 0, "article").otherwise("main")
    open_, close = F.concat(F.lit("<"), tag, F.lit(" class='x'>")), F.concat(F.lit("</"), tag, F.lit(">"))
    inner = F.concat(open_, t, close)
    more = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("C"), open_, open_, t, close, close))
    page = F.concat(F.lit("<body>"), open_, F.lit("A"), inner, F.lit("B"), more, close, F.lit("<p>outside</p>"), inner, F.lit("</body>"))
    rows = b.table(spark, d, "pages").select("page_id", page.alias("html"))
    return html.with_main_region(rows, "html", "region").select("page_id", html.strip_tags(F.col("region")).alias("words"))


@query("pages_with_questions", """
SELECT count(*) FILTER (page_id % 3 > 0) AS pages_with_questions, count(*) FILTER (NOT analyzed) AS not_analyzed FROM live""")
def pages_with_questions(spark, d):
    f = c.analyze_pages(rich_pages(spark, d), C).select("page_id", (F.size("question_headings") > 0).alias("q"))
    return b.inventory(spark, d).filter("not deleted").join(f, "page_id", "left").agg(
        F.count_if("q").alias("pages_with_questions"), F.count_if(~F.col("analyzed")).alias("not_analyzed"))


def _markdown_sql():
    sub = lambda t, pattern, to: f"regexp_replace({t}, '{pattern}', {to}, 'g')"
    t = "body"
    for level in range(1, 7):
        marks = "#" * min(6, max(3, level + 1))
        t = sub(t, f"(?is)<h{level}\\b[^>]*>\\s*(.*?)\\s*</h{level}>", f"chr(10) || chr(10) || '{marks} \\1' || chr(10) || chr(10)")
    t = sub(t, "(?i)<li\\b[^>]*>", "chr(10) || '- '")
    t = sub(t, "(?i)</(p|div|ul|ol|table|tr|blockquote|section|figure)>|<br\\s*/?>", "chr(10) || chr(10)")
    t = b.unescape_sql(sub(t, "(?s)<[^>]*>", "''"))
    for had, want in (("[ \\t]+", "' '"), (" *\\n *", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)")):
        t = sub(t, had, want)
    return f"SELECT page_id, trim(regexp_replace({t}, '^\\s+|\\s+$', '', 'g')) AS text FROM bodies"


@query("light_markdown", _markdown_sql, FACTS)
def light_markdown(spark, d):
    rows = b.table(spark, d, "pages").select("page_id", html.drop_comments(F.col("html")).alias("src"))
    return html.with_main_region(rows, "src", "region").select("page_id", html.light_markdown(F.col("region")).alias("text"))


# stored analyses derived from the pages' own terms ------------------------

def assists(spark, d):
    pid = F.col("page_id")
    kw = F.struct(F.concat(F.lit("Topic "), (pid % 40).cast("string")).alias("keyword"), (pid * 31 % 1000).alias("volume"),
                  (pid % 2 == 0).alias("used"), (pid % 3 == 0).alias("measured"))
    faq = F.struct(F.concat(F.lit("What is "), (pid % 17).cast("string"), F.lit("?")).alias("question"), (pid % 4 == 0).alias("from_search"))
    body = F.struct(kw.alias("primary_keyword"), F.array(faq).alias("faqs"),
                    F.array(F.concat(F.lit("gap "), (pid % 23).cast("string")), F.lit("")).alias("gaps"),
                    F.array(F.struct(F.lit("term").alias("term"), (pid % 5 == 0).alias("used"))).alias("semantic_terms"))
    rows = b.inventory(spark, d).filter("not deleted").select("page_id", "importance", F.to_json(body).alias("assist"))
    return c.present_assist(rows)


@query("keyword_rollup", """
SELECT * FROM (SELECT page_id, 'topic ' || (page_id % 40) AS keyword, page_id * 31 % 1000 AS volume, CASE WHEN page_id % 3 = 0 THEN 'measured' ELSE 'suggested' END AS source
  FROM live QUALIFY row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id * 31 % 1000 DESC, importance DESC, page_id) = 1)
ORDER BY CASE source WHEN 'measured' THEN 0 ELSE 1 END, volume DESC, keyword LIMIT 40""")
def keyword_rollup(spark, d):
    return c.keyword_rollup(assists(spark, d))


@query("question_rollup", """
SELECT page_id, 'What is ' || (page_id % 17) || '?' AS question, CASE WHEN page_id % 4 = 0 THEN 'search_results' ELSE 'suggested' END AS source
FROM live ORDER BY importance DESC, page_id LIMIT 40""")
def question_rollup(spark, d):
    return c.question_rollup(assists(spark, d))


@query("gap_rollup", "SELECT page_id, 'gap ' || (page_id % 23) AS topic FROM live ORDER BY importance DESC, page_id LIMIT 40")
def gap_rollup(spark, d):
    return c.gap_rollup(assists(spark, d))


@query("inferred_findings", """
SELECT page_id, 'content_gaps' AS code, 'warning' AS severity, 1 AS n, 'gap ' || (page_id % 23) AS items, 'inferred' AS kind FROM live
UNION ALL SELECT page_id, 'keyword_gaps', 'info', 1, 'term', 'inferred' FROM live WHERE page_id % 5 <> 0
UNION ALL SELECT page_id, 'faq_opportunities', 'info', 1, 'What is ' || (page_id % 17) || '?', 'inferred' FROM live""")
def inferred_findings(spark, d):
    return c.inferred_findings(assists(spark, d), facts(spark, d)).withColumn("items", F.array_join("items", ","))


@query("inventory_merge", """
SELECT page_id, path, dirty, deleted FROM (
  SELECT page_id, CASE WHEN page_id % 13 = 0 THEN path || '/moved' ELSE path END AS path,
         page_id % 13 = 0 OR page_id % 7 = 0 OR page_id % 61 = 60 AS dirty, FALSE AS deleted
  FROM inventory WHERE page_id % 19 <> 0
  UNION ALL SELECT page_id, path, FALSE, TRUE FROM inventory WHERE page_id % 19 = 0)""")
def inventory_merge(spark, d):
    """A second snapshot: some pages moved, some were edited, some are gone."""
    old = b.inventory(spark, d).filter("page_id >= 0").select(
        "page_id", F.lit("post").alias("object_type"), "object_id", "path", "title", "modified", F.lit(False).alias("dirty"), "deleted")
    pid = F.col("object_id")
    new = old.filter("object_id % 19 <> 0").select(
        "object_type", "object_id", F.when(pid % 13 == 0, F.concat("path", F.lit("/moved"))).otherwise(F.col("path")).alias("path"),
        "title", F.when(pid % 7 == 0, F.col("modified") + 5).otherwise(F.col("modified")).alias("modified"))
    return c.merge_inventory(old, new).select("page_id", "path", "dirty", "deleted")
