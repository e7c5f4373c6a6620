"""Registered queries of the page path, on pages that are written from rows of the test
data, so that what the parsers must find in them can be said in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import inputs

#: A page by its number: four layouts in turn.
LINKS = (
    '<p><a class="pdf-link" href="https://x/{id}.pdf">pdf</a><a class="decree-link" href="https://x/{id}-b.pdf">en</a></p>',
    '<p><a class="treaty-ar" href="https://x/{id}-EN.pdf">en</a><a class="treaty-ar" href="https://x/{id}.pdf">ar</a></p>',
    "<p>No link</p>",
    '<p><a class="decree-link" href="https://x/en/{id}/">English</a></p>',
)
DATES = ('<time datetime="2021-03-0{day}T10:00:00">March</time>', '<ul><li class="post-date"><span class="meta-text"> {day} {month} 2020 </span></li></ul>', "", "")
TAGS = ('<div class="post-tags"><a rel="tag">أخرى</a> <a rel="tag">وزارة {id}</a></div>', '<div class="post-tags"><a rel="tag">شيء {id}</a></div>', '<div class="post-tags"><a rel="tag">أخرى</a> <a rel="tag">وزارة {id}</a></div>', "")
TITLES = ("<header><h1> Title {id} </h1></header><h1>Other</h1>", "<header><h1> Title {id} </h1></header>", "<header><h1> Title {id} </h1></header>", "<h1>Plain {id}</h1>")
CATEGORIES = ("قرار وزاري", "مرسوم سلطاني", "قرار وزاري", "مرسوم سلطاني")
ENTRY = '<div class="entry-content">{links}<h3>Part {id}</h3><p>Body <b>bold</b> of {id}</p><p>نشر في عدد الجريدة الرسمية 5</p><p>after</p></div>'
ENGLISH = '<h1>English {id}</h1><div class="entry-content"><p><a class="ar-link" href="#">ar</a></p><p>Text {id}</p></div>'
TABLE = '<article><h1>T</h1><div class="entry-content"><p>x</p>{table}</div></article>'


def filled(template: str, **values):
    """The template with its fields replaced, as a column."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def by_turn(templates):
    """One of the templates, by page number."""
    return F.element_at(F.array(*map(F.lit, templates)), (F.pmod("page_id", F.lit(len(templates))) + 1).cast("int"))


def pages(spark, d):
    number = F.col("page_id").cast("string")
    values = {"id": number, "day": F.pmod("page_id", F.lit(9)).cast("int") + 1, "month": F.element_at(F.array(*map(F.lit, T.ARABIC_MONTHS)), (F.pmod("page_id", F.lit(12)) + 1).cast("int"))}
    values = {k: v.cast("string") for k, v in values.items()}
    entry = F.replace(F.lit(ENTRY), F.lit("{links}"), by_turn(LINKS))
    # the first layout has another entry ahead, outside of the inner post
    inner = F.when(F.pmod("page_id", F.lit(4)) == 0, F.concat(F.lit('<div class="entry-content"><p>decoy</p></div><div class="post-inner">'), entry, F.lit("</div>"))).otherwise(entry)
    html = F.concat(F.lit("<html><body><p>outside</p><article>"), by_turn(TITLES), by_turn(DATES), inner, by_turn(TAGS), F.lit("</article></body></html>"))
    for name, value in values.items():
        html = F.replace(html, F.lit("{" + name + "}"), value)
    return inputs.table(spark, d, "pages").select("page_id", filled("https://s/p/2020/doc-{id}/", id=number).alias("url"), by_turn(CATEGORIES).alias("category"), html.alias("html"))


def page_fields(spark, d):
    """Records of pages of four layouts, with English pages and converted files."""
    number = F.col("page_id").cast("string")
    rows = inputs.table(spark, d, "pages")
    english = rows.where("page_id % 4 = 3").select(filled("https://x/en/{id}/", id=number).alias("url"), filled(ENGLISH, id=number).alias("html"))
    pdf = rows.where("page_id % 4 = 0").select(filled("https://x/{id}-b.pdf", id=number).alias("url"), filled("PDF {id}", id=number).alias("markdown"))
    docs, _ = inputs.records(pages(spark, d).drop("page_id"), english, pdf)
    return docs


def amendment_pairs(spark, d):
    """Pages of an amending category: with a whole relation table, one that lacks a
    link, none; edges, and the id of what stays a document."""
    number = F.col("page_id").cast("string")
    cell = '<td><a href="https://s/p/2020/{name}-{id}/">x</a></td>'
    first, second = cell.replace("{name}", "src"), cell.replace("{name}", "dst")
    tables = (f'<figure class="wp-block-table"><table><tr>{first}{second}</tr></table></figure>', f'<figure class="wp-block-table"><table><tr>{first}<td>none</td></tr></table></figure>', "")
    html = F.replace(F.replace(F.lit(TABLE), F.lit("{table}"), by_turn(tables)), F.lit("{id}"), number)
    rows = inputs.table(spark, d, "pages").select(filled("https://s/p/2020/doc-{id}", id=number).alias("url"), F.lit("قانون معدل").alias("category"), html.alias("html"))
    docs, edges = inputs.records(rows)
    none = F.lit(None).cast("string")
    return edges.select("id", "source_id", "target_id", "relation_type").unionByName(docs.select("id", none.alias("source_id"), none.alias("target_id"), none.alias("relation_type")))


SLUGS = (*T.SLUG_LABELS, "some-other-kind")


def sitemap_categories(spark, d):
    """Categories of sitemaps' locations, percent-encoded slugs; black-listed ones go."""
    slug = F.url_encode(F.element_at(F.array(*map(F.lit, SLUGS)), (F.pmod("page_id", F.lit(len(SLUGS))) + 1).cast("int")))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>\n https://s/c/'), slug, F.lit("/ </loc></url><url><loc>https://s/c/Uncategorized/</loc></url></urlset>"))
    return inputs.sitemap(inputs.table(spark, d, "pages").select(xml.alias("xml"))).groupBy("category", "key").agg(F.count(F.lit(1)).alias("n"))


def listing_links(spark, d):
    """Second-level headings' document links, each once a page, in order."""
    number = F.col("page_id").cast("string")
    link = lambda name, tail="": f'<h2><a href="https://s/p/2020/{name}-{{id}}{tail}">x</a> <a href="https://s/p/2020/second-{{id}}/">y</a></h2>'
    html = link("one", "/") + link("two", "//") + link("one", "/") + link("three", "/#part") + '<h2>none</h2><h3><a href="https://s/p/2020/third-{id}/">z</a></h3><h2><a href="https://s/q/2020/four/">q</a></h2>'
    rows = inputs.table(spark, d, "pages").select(F.pmod("page_id", F.lit(7)).cast("string").alias("category"), F.col("page_id").alias("page"), filled(html, id=number).alias("html"))
    return inputs.listing(rows)


def pdf_documents(spark, d):
    """Documents' texts as blocks of a file: an article opening, the text, a blank
    block, a picture; some files are pictures only, some have no text, some are in
    the wrong script."""
    line = T.strip(F.regexp_replace("text", r"[\s\p{Z}]+", " "))
    block = lambda page, ord_, kind, text: F.struct(F.lit(page).alias("page"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), text.alias("text"))
    some = F.array(block(2, 0, 0, line), block(1, 1, 0, F.lit("  ")), block(1, 0, 0, F.concat(F.lit("Article "), F.col("doc_id").cast("string"), F.lit(" opens"))), block(1, 2, 1, F.lit(None).cast("string")))
    picture = F.array(block(1, 0, 1, F.lit(None).cast("string")))
    blank = F.array(block(1, 0, 0, F.lit(" \n ")))
    blocks = F.when(F.pmod("doc_id", F.lit(11)) == 0, picture).when(F.pmod("doc_id", F.lit(11)) == 1, blank).otherwise(some)
    lang = F.when(F.pmod("doc_id", F.lit(5)) == 0, "AR").otherwise("EN")
    rows = inputs.table(spark, d, "documents").select("doc_id", lang.alias("lang"), F.explode(blocks).alias("b")).select("doc_id", "lang", "b.*")
    found = inputs.pdf_markdown(rows)
    return found.select("doc_id", F.md5("markdown").alias("markdown_md5"), "problem")


def arabic_dates(spark, d):
    month = F.element_at(F.array(*map(F.lit, T.ARABIC_MONTHS)), (F.pmod("page_id", F.lit(12)) + 1).cast("int"))
    day = (F.pmod("page_id", F.lit(28)) + 1).cast("string")
    text = F.when(F.pmod("page_id", F.lit(5)) == 0, F.concat(month, F.lit(" 2020"))).when(F.pmod("page_id", F.lit(7)) == 0, F.concat(F.lit("x "), month, F.lit(" 2020"))).otherwise(F.concat(F.lit("  "), day, F.lit("  "), month, F.lit(" 2020 ")))
    return inputs.table(spark, d, "pages").select("page_id", T.arabic_date(text).alias("date"))


def topic_lists(spark, d):
    """A model's list of topics, cleaned: strings only, stripped, seven at most."""
    text = F.concat(F.lit('[" a", "", 5, "b'), F.col("doc_id").cast("string"), F.lit('", null, "c", "  ", "d", "e", "f", "g", "h"]'))
    return inputs.table(spark, d, "documents").select("doc_id", F.array_join(T.topic_list(text), "|").alias("topics"))


def language_choice(spark, d):
    """The text to split is Arabic if not blank; the text for topics English if not empty."""
    turn = F.pmod("doc_id", F.lit(3))
    ar = F.when(turn == 0, F.concat(F.lit("مرسوم "), F.col("doc_id").cast("string"))).when(turn == 1, "  ")
    en = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("text")).otherwise(F.lit(""))
    lang, body = T.chunk_source(ar, en)
    return inputs.table(spark, d, "documents").select("doc_id", lang.alias("language"), F.md5(body).alias("body_md5"), F.md5(T.topic_source(ar, en)).alias("topic_md5"))


QUERIES = {f.__name__: f for f in (page_fields, amendment_pairs, sitemap_categories, listing_links, pdf_documents, arabic_dates, topic_lists, language_choice)}

_MONTHS = "[" + ", ".join(f"'{m}'" for m in T.ARABIC_MONTHS) + "]"
_SLUGS = "[" + ", ".join(f"'{s}'" for s in SLUGS) + "]"
_SPACE = "'[\\s\\p{Z}]+'"


def _cases(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


ORACLES = {
    "page_fields": f"""WITH p AS (SELECT page_id::VARCHAR AS i, page_id % 4 AS k, page_id % 9 + 1 AS day, page_id % 12 + 1 AS month FROM pages),
q AS (SELECT *, CASE WHEN k = 3 THEN 'Plain ' ELSE 'Title ' END || i AS title FROM p)
SELECT 'doc-' || i AS id, title, CASE k WHEN 0 THEN '2021-03-0' || day WHEN 1 THEN '2020-' || lpad(month::VARCHAR, 2, '0') || '-0' || day END AS date,
  CASE WHEN k % 2 = 1 THEN '{CATEGORIES[1]}' ELSE '{CATEGORIES[0]}' END AS document_type,
  CASE WHEN k % 2 = 0 THEN 'وزارة ' || i WHEN k = 1 THEN 'شيء ' || i ELSE '{T.ISSUER_BY_CATEGORY[CATEGORIES[1]]}' END AS issuer,
  'https://s/p/2020/doc-' || i || '/' AS url_ar, CASE k WHEN 0 THEN 'https://x/' || i || '-b.pdf' WHEN 3 THEN 'https://x/en/' || i || '/' END AS url_en,
  CASE WHEN k < 2 THEN 'https://x/' || i || '.pdf' END AS pdf_url_ar, CASE k WHEN 0 THEN 'https://x/' || i || '-b.pdf' WHEN 1 THEN 'https://x/' || i || '-EN.pdf' END AS pdf_url_en,
  'html' AS ar_source, CASE k WHEN 3 THEN 'html' WHEN 2 THEN NULL ELSE 'pdf' END AS en_source,
  '# ' || title || chr(10) || chr(10) || CASE WHEN k = 2 THEN 'No link' || chr(10) || chr(10) ELSE '' END || '## Part ' || i || chr(10) || chr(10) || 'Body **bold** of ' || i AS contentAr,
  CASE k WHEN 0 THEN 'PDF ' || i WHEN 3 THEN '# English ' || i || chr(10) || chr(10) || 'Text ' || i END AS contentEn,
  CASE WHEN k IN (0, 3) THEN 'SUCCESS_CONTENT' ELSE 'ONLY_ARABIC' END AS status FROM q""",
    "amendment_pairs": """SELECT 'doc-' || page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'src-' || page_id END AS source_id, CASE WHEN page_id % 3 = 0 THEN 'dst-' || page_id END AS target_id,
  CASE WHEN page_id % 3 = 0 THEN 'AMENDS' END AS relation_type FROM pages WHERE page_id % 3 <> 1""",
    "sitemap_categories": f"""WITH s AS (SELECT {_SLUGS}[page_id % {len(SLUGS)} + 1] AS slug FROM pages),
c AS (SELECT coalesce({_cases("slug", T.SLUG_LABELS)}, replace(slug, '-', ' ')) AS category FROM s)
SELECT category, coalesce({_cases("category", T.LABEL_KEYS)}, lower(replace(category, ' ', '_'))) AS key, count(*) AS n FROM c GROUP BY ALL""",
    "listing_links": """SELECT (page_id % 7)::VARCHAR AS category, page_id AS page, position, 'https://s/p/2020/' || name || '-' || page_id || '/' AS url
FROM pages, (VALUES (0, 'one'), (1, 'two')) AS l(position, name)""",
    "pdf_documents": f"""WITH p AS (SELECT doc_id, doc_id % 11 AS k, CASE WHEN doc_id % 5 = 0 THEN 'AR' ELSE 'EN' END AS lang, '## Article ' || doc_id || ' opens' AS head, trim(regexp_replace(text, {_SPACE}, ' ', 'g')) AS body FROM documents),
l AS (SELECT *, length(regexp_replace(head || body, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(head || body, '[^A-Za-z]', '', 'g')) AS latin FROM p),
r AS (SELECT *, CASE WHEN k = 0 THEN 'image' WHEN k = 1 THEN 'empty' WHEN lang = 'AR' AND letters > 0 OR lang = 'EN' AND latin::DOUBLE / letters < 0.15 THEN 'encoding' END AS problem FROM l)
SELECT doc_id, CASE WHEN problem IS NULL THEN md5(CASE WHEN body = '' THEN head ELSE head || chr(10) || chr(10) || body END) END AS markdown_md5, problem FROM r""",
    "arabic_dates": f"SELECT page_id, CASE WHEN page_id % 5 <> 0 AND page_id % 7 <> 0 THEN '2020-' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS date FROM pages",
    "topic_lists": "SELECT doc_id, 'a|b' || doc_id || '|c|d|e|f|g' AS topics FROM documents",
    "language_choice": f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'مرسوم ' || doc_id WHEN 1 THEN '  ' END AS ar, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS en FROM documents),
b AS (SELECT *, regexp_replace(coalesce(ar, ''), {_SPACE}, '', 'g') <> '' AS has_ar, regexp_replace(en, {_SPACE}, '', 'g') <> '' AS has_en FROM t)
SELECT doc_id, CASE WHEN has_ar THEN 'ar' WHEN has_en THEN 'en' END AS language, md5(CASE WHEN has_ar THEN ar WHEN has_en THEN en END) AS body_md5,
  md5(regexp_replace(CASE WHEN en <> '' THEN en ELSE coalesce(ar, '') END, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS topic_md5 FROM b""",
}
