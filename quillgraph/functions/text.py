"""Scalar functions over columns: tokenizers, urls, dates, labels, formatting.

All are JVM expressions, so they stay inside generated code and filters on them
can be pushed down.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
WORD = r"[\p{L}\p{N}_]+"
ARABIC_RUN = r"[\x{0600}-\x{06FF}]+"
BLOCK_PHRASES = ("cf-browser-verification", "just a moment", "captcha", "access denied", "rate limit")
NOISE_PHRASES = ("نشر في عدد الجريدة الرسمية", "تم التصديق بموجب", "للأسف نص هذه الوثيقة غير متوفر")
ARABIC_MONTHS = ("يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر")
SLUG_LABELS = {
    "مرسوم-سلطاني": "مرسوم سلطاني",
    "قرار-وزاري": "قرار وزاري",
    "الجريدة-الرسمية": "الجريدة الرسمية",
    "أمر-سامي": "أمر سامي",
    "قانون-معدل": "قانون معدل",
    "اتفاقية-دولية": "اتفاقية دولية",
    "قانون-تقليدي": "قانون تقليدي",
    "قرارات-اللجنة-العليا-للتعامل-مع-فيروس": "قرارات اللجنة العليا",
    "لائحة-معدلة": "لائحة معدلة",
    "فتاوى-قانونية": "فتاوى قانونية",
    "تعميم": "تعميم",
}
LABEL_KEYS = {
    "مرسوم سلطاني": "royal_decree",
    "قرار وزاري": "ministerial_decision",
    "الجريدة الرسمية": "official_gazette",
    "أمر سامي": "royal_order",
    "قانون معدل": "amended_law",
    "اتفاقية دولية": "international_treaty",
    "قانون تقليدي": "legacy_law",
    "قرارات اللجنة العليا": "supreme_committee_decisions",
    "لائحة معدلة": "amended_regulation",
    "فتاوى قانونية": "legal_opinion",
    "تعميم": "circular",
}
ISSUER_BY_CATEGORY = {
    "مرسوم سلطاني": "السلطان",
    "أمر سامي": "السلطان",
    "قرار وزاري": "الوزارة",
    "اتفاقية دولية": "الحكومة",
    "الجريدة الرسمية": "الجهاز المركزي للتشريع",
}
ISSUER_KEYWORDS = ("شرطة", "وزارة", "هيئة", "مجلس", "الحكومة", "سلطنة")
AMENDMENT_MARKS = ("معدل", "تعديل", "amended")
ARTICLE_START = r"(?iu)^(المادة|الفصل|البند|الفرع|Article|Chapter|Section|Clause)\s+[\dIVXأ-ي٠-٩()]+"
SLUG_BLACKLIST = ("uncategorized",)
DROPPED_TAGS = ("script", "style", "nav", "footer", "iframe", "noscript", "img", "svg")
PDF_LINK, DECREE_LINK, TREATY_LINK = "pdf-link", "decree-link", "treaty-ar"
OTHER_LANGUAGE_LINKS = ("ar-link", "cl-link")
# ----------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Without leading and trailing white space, Unicode's included."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")


def has_text(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (strip(c) != "")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, numbers and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def arabic_tokens(c: Column) -> Column:
    """Runs of the Arabic block, as they stand: diacritics, digits and comma too."""
    return F.regexp_extract_all(c, F.lit(ARABIC_RUN), F.lit(0))


def last_segment(url: Column) -> Column:
    """The last path segment, trailing slashes aside: a document's id."""
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def slug(url: Column) -> Column:
    """Percent-decoded last segment; a plus sign stays one."""
    return last_segment(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))))


def is_document_url(url: Column) -> Column:
    return url.rlike(r"/p/(19|20)\d{2}/[\p{L}\p{N}_-]+/") & ~url.contains("#")


def canonical_url(url: Column) -> Column:
    """Exactly one trailing slash."""
    return F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/"))


def listing_url(base: Column, page: Column) -> Column:
    root = canonical_url(base)
    return F.when(page == 1, root).otherwise(F.concat(root, F.lit("page/"), page.cast("string"), F.lit("/")))


def lookup(c: Column, values: dict[str, str], otherwise: Column | None = None) -> Column:
    """A literal map look-up, inside the plan."""
    pairs = F.create_map(*[F.lit(x) for item in values.items() for x in item])
    found = F.try_element_at(pairs, c)
    return found if otherwise is None else F.coalesce(found, otherwise)


def category_label(slug_: Column) -> Column:
    return lookup(slug_, SLUG_LABELS, F.replace(slug_, F.lit("-"), F.lit(" ")))


def category_key(label: Column) -> Column:
    return lookup(label, LABEL_KEYS, F.lower(F.replace(label, F.lit(" "), F.lit("_"))))


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


def is_blocked(html: Column) -> Column:
    return contains_any(F.lower(html), BLOCK_PHRASES)


def is_noise(text: Column) -> Column:
    return contains_any(text, NOISE_PHRASES)


def arabic_date(text: Column) -> Column:
    """``day month year`` with an Arabic month name, as ISO; else null."""
    parts = F.split(strip(text), r"\s+")
    month = F.array_position(F.array(*map(F.lit, ARABIC_MONTHS)), F.get(parts, F.lit(1)))
    day = F.get(parts, F.lit(0)).try_cast("int")
    return F.when((F.size(parts) == 3) & (month > 0) & day.isNotNull(), F.format_string("%s-%02d-%02d", F.get(parts, F.lit(2)), month, day))


def utc_now() -> Column:
    """The time of the query, UTC, as an ISO string."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def content_status(ar: Column, en: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(empty(ar) & empty(en), "EMPTY_CONTENT").when(empty(ar), "ONLY_ENGLISH").when(empty(en), "ONLY_ARABIC").otherwise("SUCCESS_CONTENT")


def content_source(has_body: Column, pdf_url: Column) -> Column:
    """html if the page has a body, whatever is left of it, else pdf if there is a
    url for one."""
    return F.when(has_body, "html").when(F.coalesce(pdf_url, F.lit("")) != "", "pdf")


def chunk_source(ar: Column, en: Column) -> tuple[Column, Column]:
    """(language, text) to split: Arabic if there is any, else English."""
    return F.when(has_text(ar), "ar").when(has_text(en), "en"), F.when(has_text(ar), ar).when(has_text(en), en)


def topic_source(ar: Column, en: Column) -> Column:
    """The text for topics: English unless empty, else Arabic, stripped."""
    return strip(F.coalesce(F.nullif(en, F.lit("")), ar, F.lit("")))


def letter_share(text: Column, letters: str) -> Column:
    """Share of ``letters`` (a class body) among all letters; null without letters."""
    count = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]", ""))
    return F.try_divide(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}]", ""), f"[^{letters}]", "")), count(r"\p{L}"))


def is_garbled(text: Column, lang: Column) -> Column:
    """Under 15 % of letters in the language's own script; false without letters."""
    share = F.when(lang == "AR", letter_share(text, r"\x{0600}-\x{06FF}")).when(lang == "EN", letter_share(text, "A-Za-z"))
    return F.coalesce(share < 0.15, F.lit(False))


def preview(text: Column, n: int) -> Column:
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def clean_markdown(md: Column) -> Column:
    """At most one blank line in a row, no trailing blanks, no rule lines, stripped."""
    md = F.regexp_replace(md, r"\n{3,}", "\n\n")
    md = F.regexp_replace(md, r"(?m)[^\S\n]+$", "")
    lines = F.filter(F.split(md, "\n"), lambda x: ~x.rlike(r"^[-_*]{3,}$"))
    return strip(F.array_join(lines, "\n"))


def promote_headings(md: Column) -> Column:
    """Headings from level 3 to 5 one level up, where there is no level 2."""
    up = F.regexp_replace(md, r"(?m)^### ", "## ")
    up = F.regexp_replace(up, r"(?m)^#### ", "### ")
    up = F.regexp_replace(up, r"(?m)^##### ", "#### ")
    return F.when(~md.rlike(r"(?m)^## ") & md.rlike(r"(?m)^### "), up).otherwise(md)


def context_header(title: Column, issuer: Column, date: Column, kind: Column, topics: Column) -> Column:
    """The lines before a chunk's text; ``?`` for what is missing, a dash without topics."""
    known = lambda c: F.coalesce(c, F.lit("?"))
    names = F.array_join(F.coalesce(topics, F.array().cast("array<string>")), ", ")
    return F.concat(F.lit("[Document: "), known(title), F.lit(" | Issuer: "), known(issuer), F.lit(" | "), known(date), F.lit(" | "), known(kind), F.lit("]\n[Topics: "), F.when(names == "", F.lit("—")).otherwise(names), F.lit("]\n\n"))


def topic_list(json: Column, most: int = 7) -> Column:
    """A model's JSON list of topics: strings only, stripped, not blank, the first ``most``."""
    found = F.from_json(json, "array<string>")
    quoted = F.transform(F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"'), F.lit(0)), lambda x: F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")[0])
    return F.slice(F.filter(F.transform(F.filter(found, lambda x: F.array_contains(quoted, x)), strip), lambda x: x != ""), 1, most)
