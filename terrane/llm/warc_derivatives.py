"""WARC derivative builder.

Responses become two linked records each: metadata (WARC fields: title, language, outgoing links) and a plain-text
conversion. Both refer to the response by its record id and keep its target URI, date, HTTP headers and payload digest;
each carries the digest and length of its own block.

DataFrame functions only, one pass, no shuffle. Record ids and digests follow from contents, so a repeated run builds
the same records. Defined results: a null or empty payload gives records with empty blocks of their own. Null URIs and
headers stay null and their lines are left out. Repeated rows give repeated records. An empty table gives an empty
result. Further columns are ignored. Unclosed comments, scripts and tags reach to the end of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the conversion, in the order of their use.
END = r"(?:[ \t\r\n\f/][^>]*)?(?:>|\z)"
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{tag}{END}.*?(?:</{tag}[ \t\r\n]*>|\z)" for tag in ("script", "style", "noscript", "template"))
BLOCK_TAGS = rf"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul){END}"
OTHER_TAGS = r"<[a-zA-Z/!?][^>]*(?:>|\z)"
#: Fixed patterns of the metadata. A tag ends before the next one begins, so unclosed tags cost their own length only.
TITLE, LANGUAGE, LINK = r"(?is)<title[^<>]*>([^<]*)", r"(?is)<html[^<>]*[ \t\r\n]lang[ ]*=[ ]*[\"']?([A-Za-z0-9-]+)", r"(?i)<a[ \t\r\n][^<>]*href[ ]*=[ ]*[\"']([^\"'<>]*)"
#: Character references that are resolved, the ampersand last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
DATE = "2024-01-01T00:00:00Z"


def resolved(text: Column) -> Column:
    for name, value in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def plain_text(html: Column) -> Column:
    """The visible text: one line for each block, single spaces, no blank lines."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, BLOCK_TAGS, "\n")
    text = resolved(F.regexp_replace(text, OTHER_TAGS, ""))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.trim(text, F.lit(" \n"))


def urn(*parts: Column) -> Column:
    """A record id that follows from the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Raw pages as response records: id, record_id, target_uri, warc_date, http_headers, payload."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    length = F.octet_length(payload).cast("string")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length)
    name = urn(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")), payload)
    return pages.select(F.col(id_col).alias("id"), name.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), payload.alias("payload"))


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: warc_type, record_id, refers_to, target_uri, warc_date, content_type,
    content_length, block_digest, source_digest, source_headers and block."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    line = lambda name, value: F.when(F.char_length(value) > 0, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    flat = lambda text: F.trim(F.regexp_replace(resolved(text), r"[ \t\r\n\f]+", " "))
    links = F.array_join(F.transform(F.regexp_extract_all(payload, F.lit(LINK), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), "")
    fields = F.concat(line("title", flat(F.regexp_extract(payload, TITLE, 1))), line("language", F.regexp_extract(payload, LANGUAGE, 1)), links)
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(payload).alias("block")),
    )
    rows = records.select("id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", F.col("http_headers").alias("source_headers"), sha256(payload).alias("source_digest"), F.explode(made).alias("r"))
    rows = rows.select("*", "r.*").drop("r")
    return rows.select("id", "warc_type", urn(F.col("warc_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "warc_date", "content_type", F.octet_length("block").cast("long").alias("content_length"), sha256(F.col("block")).alias("block_digest"), "source_digest", "source_headers", "block")


def serialised(records: DataFrame) -> DataFrame:
    """The records as WARC/1.1 text, in a column `record`; one file for each task when written as text."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    names = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "warc_date", "WARC-Block-Digest": "block_digest", "WARC-Source-Payload-Digest": "source_digest", "Content-Type": "content_type"}
    heads = [line(name, F.col(c)) for name, c in names.items()]
    source = line("WARC-Source-Headers", F.regexp_replace("source_headers", "\r\n", "; "))
    return records.select("id", F.concat(F.lit("WARC/1.1\r\n"), *heads, source, F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("record"))
