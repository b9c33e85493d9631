"""WARC derivatives: each response gives a metadata record and a plain-text conversion record that refer to it.

All records are built by string expressions, so nothing leaves the JVM. Blocks and headers follow WARC 1.1; identifiers are
UUIDs made from digests, so that a repeated run gives the same records. Files are written with the record separator
(two line ends) as the line separator of Spark's text sink, whose commits survive lost executors. A file is read as a whole by
one task, as record ends can't be told from within it, so files must stay below 2 GB (Spark's limit for a value).

Text is decoded once: entities by code (&#233; or &#xE9;; codes that are no character give U+FFFD) and by the names of HTML 4
and &apos;, others stay as they are. Control characters of a url are percent-encoded in headers, so no url can start a line.

Defined cases: a null url gives an empty target, a null page is an empty payload with the digest of nothing; very long pages
are converted whole; repeated rows give repeated records with equal identifiers; an empty table gives an empty result; columns
other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import table

END = "\r\n"
#: Pages carry no time; records need one.
CAPTURED = "1970-01-01T00:00:00Z"

#: HTML elements that start a new line in text.
LINE_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
#: The same by what they begin with, which a matcher leaves sooner.
LINE_TREE = "a(?:ddress|rticle|side)|b(?:lockquote|r)|d(?:d|iv|l|t)|fo(?:oter|rm)|h(?:[1-6r]|eader)|li|main|nav|ol|p(?:re)?|section|t(?:able|d|h|itle|r)|ul"
#: Characters by the names of HTML 4.
NAMED = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
LONGEST = max(map(len, NAMED))
#: What counts as a space in text, apart from the space.
BLANKS = ("\t", "\r", "\f", "\u00a0")
#: Bytes of a text beyond which its lines are not put in an array, as each would take some 100 bytes more.
LONG = 1 << 20
#: Fixed patterns. Word ends and white space are those of ASCII, as in the SQL; Java's own take in more.
SPACE = r"[\t\n\f\r ]"
HIDDEN = rf"(?is)<(?:script(?!\w).*?</script{SPACE}*>|style(?!\w).*?</style{SPACE}*>|!--.*?-->)"


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def identifier(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for what is none."""
    good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(0xFFFD).cast("long")), 8, "0")), "UTF-32")


def decoded(text: Column) -> Column:
    """text with its entities decoded, once. It is split at ampersands, so only what follows one is looked at."""
    names = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))

    def named(p: Column) -> Column:
        # No more than an entity's length, as a matcher would go on through the whole part.
        name = F.regexp_extract(F.substring(p, 1, LONGEST + 1), rf"^(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[a-zA-Z0-9]{{2,{LONGEST}}});", 1)
        return F.struct(p.alias("part"), name.alias("name"))

    def part(found: Column, i: Column) -> Column:
        p, name = found["part"], found["name"]
        code = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("long")
        sign = F.when(name == "", F.lit(None).cast("string")).when(name.startswith("#"), _character(code)).otherwise(F.try_element_at(names, name))
        rest = F.substring(p, F.length(name) + 2, F.length(p))
        return F.when(i == 0, p).otherwise(F.coalesce(F.concat(sign, rest), F.concat(F.lit("&"), p)))

    # The name is looked for once a part; inside one lambda it would be at each use. The text is named once too: a lambda
    # hides it from Spark's search for common expressions, so a condition on it would make it again.
    return F.array_join(F.transform(F.transform(F.split(text, "&", -1), named), part), "")


def header_safe(url: Column) -> Column:
    """url with its control characters percent-encoded."""
    signs = F.regexp_extract_all(url, F.lit(r"(?s)[\x00-\x1F\x7F]|[^\x00-\x1F\x7F]+"), F.lit(0))
    safe = F.transform(signs, lambda c: F.when(c.rlike(r"^[\x00-\x1F\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), F.array_join(safe, "")).otherwise(url)


def _by_lines(text: Column) -> Column:
    """Plain searches pass a text much faster than patterns, which only lines that need them see."""

    def blanked(lines: Column, sign: str) -> Column:
        return F.transform(lines, lambda line: F.when(line.contains(sign), F.replace(line, F.lit(sign), F.lit(" "))).otherwise(line))

    lines = functools.reduce(blanked, BLANKS, F.split(text, "\n", -1))
    lines = F.transform(lines, lambda line: F.trim(F.when(line.contains("  "), F.regexp_replace(line, " {2,}", " ")).otherwise(line)))
    return F.array_join(F.array_remove(lines, ""), "\n")


def _by_patterns(text: Column) -> Column:
    """The same without a value for each line."""
    out = F.regexp_replace(text, f"[ {''.join(BLANKS)}]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+\z", "")


def tidied(text: Column) -> Column:
    """text with one space for a stretch of spaces, one line end for a stretch that has any, and none at its ends."""
    # In a lambda text is made once for all its uses.
    return F.transform(F.array(text), lambda t: F.when(F.octet_length(t) > LONG, _by_patterns(t)).otherwise(_by_lines(t)))[0]


def plain_text(html: Column) -> Column:
    """The text of a page: no scripts, styles or comments, line elements on lines of their own, entities decoded."""
    out = F.regexp_replace(html, HIDDEN, " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{LINE_TREE})(?!\w)[^>]*>", "\n")
    return tidied(decoded(F.regexp_replace(out, r"<[a-zA-Z/!?][^>]*>", "")))


def responses(pages: DataFrame, captured: str = CAPTURED) -> DataFrame:
    """Response records for pages(page_id, url, html): what a crawler would have stored."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    size = F.octet_length(html).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size, F.lit(END))
    return pages.select(
        "page_id", identifier(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"),
        url.alias("target_uri"), F.lit(captured).alias("date"), http.alias("http_headers"), html.alias("payload"),
    )


def _headers(*pairs: tuple[str, Column | str]) -> Column:
    fields = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(END)) for name, value in pairs]
    return F.concat(F.lit(f"WARC/1.1{END}"), *fields)


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows, a metadata and a conversion record, for each of records(page_id, record_id, target_uri, date,
    http_headers, payload): page_id, record_type, record_id, refers_to, target_uri, payload_digest, headers, block,
    block_digest."""
    source = records.withColumns({"payload_digest": digest(F.col("payload")), "text": plain_text(F.col("payload"))}).withColumn("text_digest", digest(F.col("text")))
    title = F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1), f"{SPACE}+", " ")
    language = F.regexp_extract("payload", r"(?i)<html(?!\w)[^>]*(?<!\w)lang=[\"']?([a-zA-Z-]+)", 1)
    links = F.size(F.regexp_extract_all("payload", F.lit(r"(?i)<a(?!\w)[^>]*(?<!\w)href="), F.lit(0))).cast("string")
    fields = [
        ("sourceDigest", F.col("payload_digest")), ("sourceLength", F.octet_length("payload").cast("string")), ("title", title),
        ("language", language), ("outlinks", links), ("textDigest", F.col("text_digest")),
        ("httpHeader", F.replace(F.regexp_replace("http_headers", r"\r\n$", ""), F.lit(END), F.lit(f"{END}httpHeader: "))),
    ]
    about = F.concat(*(F.concat(F.lit(f"{n}: "), v, F.lit(END)) for n, v in fields))
    source = source.withColumn("about", about)
    kinds = [("metadata", "application/warc-fields", F.col("about"), digest(F.col("about"))), ("conversion", "text/plain; charset=utf-8", F.col("text"), F.col("text_digest"))]
    made = F.array(*(F.struct(F.lit(k).alias("record_type"), F.lit(c).alias("content_type"), b.alias("block"), d.alias("block_digest")) for k, c, b, d in kinds))
    rows = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.inline(made))
    rows = rows.withColumns({"record_id": identifier(F.col("record_type"), F.col("refers_to"))})
    headers = _headers(
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", header_safe(F.col("target_uri"))), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Refers-To-Target-URI", header_safe(F.col("target_uri"))),
        ("WARC-Refers-To-Date", F.col("date")), ("WARC-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")), ("Content-Length", F.octet_length("block").cast("string")),
    )
    return rows.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", headers.alias("headers"), "block", "block_digest")


def response_records(records: DataFrame) -> DataFrame:
    """headers and block of response records, for write()."""
    block = F.concat("http_headers", F.lit(END), "payload")
    headers = _headers(
        ("WARC-Type", "response"), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", header_safe(F.col("target_uri"))),
        ("WARC-Payload-Digest", digest(F.col("payload"))), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", F.octet_length("block").cast("string")),
    )
    return records.withColumn("block", block).select(headers.alias("headers"), "block")


def write(records: DataFrame, path: str) -> None:
    """WARC files of records(headers, block), a file for each partition."""
    records.select(F.concat("headers", F.lit(END), "block").alias("value")).write.option("lineSep", END * 2).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """headers (a map of lower-case names) and block (binary) of the records in WARC files under path, by their lengths."""
    from pyspark.sql.types import BinaryType, MapType, StringType, StructField, StructType

    kind = StructType([StructField("headers", MapType(StringType(), StringType())), StructField("block", BinaryType())])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_parse, kind)


def _parse(frames):  # noqa: ANN001, ANN202
    import pandas as pd

    for frame in frames:
        for data in frame["content"]:
            rows, at = [], 0
            while (stop := data.find(b"\r\n\r\n", at)) >= 0:
                lines = data[at:stop].decode().split(END)
                headers = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
                size = int(headers["content-length"])
                rows.append((headers, data[stop + 4 : stop + 4 + size]))
                at = stop + 4 + size + 4
                if len(rows) == 1000:
                    yield pd.DataFrame(rows, columns=["headers", "block"])
                    rows = []
            yield pd.DataFrame(rows, columns=["headers", "block"])


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


_UUID = "'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"
_TEXT = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g')"
_TEXT = rf"regexp_replace(regexp_replace({_TEXT}, '(?i)</?(?:{LINE_TAGS})\b[^>]*>', chr(10), 'g'), '<[a-zA-Z/!?][^>]*>', '', 'g')"
_QUOTED = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_NAME = f"regexp_extract(p, '^(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[a-zA-Z0-9]{{2,{LONGEST}}});', 1)"
_CODE = f"CASE WHEN lower(substr({_NAME}, 2, 1)) = 'x' THEN ('0x' || substr({_NAME}, 3))::BIGINT ELSE try_cast(substr({_NAME}, 2) AS BIGINT) END"
_SIGN = f"CASE WHEN {_NAME} = '' THEN NULL WHEN {_NAME}[1] = '#' THEN CASE WHEN {_CODE} BETWEEN 1 AND 55295 OR {_CODE} BETWEEN 57344 AND 1114111 THEN chr(({_CODE})::INT) ELSE chr(65533) END ELSE ({_QUOTED(NAMED.values())})[list_position({_QUOTED(NAMED)}, {_NAME})] END"
_PART = f"CASE WHEN i = 1 THEN p ELSE coalesce({_SIGN} || substr(p, length({_NAME}) + 2), '&' || p) END"
_TEXT = f"array_to_string(list_transform(string_split({_TEXT}, '&'), lambda p, i: {_PART}), '')"
_TEXT = rf"regexp_replace(regexp_replace(regexp_replace({_TEXT}, '[ \t\r\f\x{{00A0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
_URL = r"array_to_string(list_transform(regexp_extract_all(url, '(?s)[\x00-\x1F\x7F]|[^\x00-\x1F\x7F]+'), lambda c: CASE WHEN regexp_matches(c, '^[\x00-\x1F\x7F]') THEN printf('%%%02X', ord(c)) ELSE c END), '')"
_N = "chr(13) || chr(10)"

SQL = rf"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    md5('response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || coalesce(url, '')) AS h FROM pages
), s AS (
  SELECT page_id, url, html, {_UUID.format(h="h")} AS rid, 'sha256:' || sha256(html) AS pd, {_TEXT} AS txt FROM p
), m AS (
  SELECT page_id, 'metadata' AS record_type, 'application/warc-fields' AS ct, rid, url, pd,
    'sourceDigest: ' || pd || {_N} || 'sourceLength: ' || strlen(html) || {_N}
    || 'title: ' || regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g') || {_N}
    || 'language: ' || regexp_extract(html, '(?i)<html\b[^>]*\blang=["'']?([a-zA-Z-]+)', 1) || {_N}
    || 'outlinks: ' || len(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref=')) || {_N}
    || 'textDigest: sha256:' || sha256(txt) || {_N}
    || 'httpHeader: HTTP/1.1 200 OK' || {_N} || 'httpHeader: Content-Type: text/html; charset=utf-8' || {_N}
    || 'httpHeader: Content-Length: ' || strlen(html) || {_N} AS block FROM s
  UNION ALL
  SELECT page_id, 'conversion', 'text/plain; charset=utf-8', rid, url, pd, txt FROM s
), r AS (
  SELECT *, md5(record_type || chr(10) || rid) AS h, 'sha256:' || sha256(block) AS block_digest FROM m
), i AS (SELECT *, {_UUID.format(h="h")} AS record_id FROM r)
SELECT page_id, record_type, record_id, rid AS refers_to, url AS target_uri, pd AS payload_digest,
  'WARC/1.1' || {_N} || 'WARC-Type: ' || record_type || {_N} || 'WARC-Record-ID: ' || record_id || {_N}
  || 'WARC-Date: {CAPTURED}' || {_N} || 'WARC-Target-URI: ' || {_URL} || {_N} || 'WARC-Refers-To: ' || rid || {_N}
  || 'WARC-Refers-To-Target-URI: ' || {_URL} || {_N} || 'WARC-Refers-To-Date: {CAPTURED}' || {_N}
  || 'WARC-Payload-Digest: ' || pd || {_N} || 'WARC-Block-Digest: ' || block_digest || {_N}
  || 'Content-Type: ' || ct || {_N} || 'Content-Length: ' || strlen(block) || {_N} AS headers, block, block_digest
FROM i
"""
