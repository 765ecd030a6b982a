"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives two records. The conversion record holds the page's plain text. The metadata
record holds, as warc-fields, what was derived and from what. Both refer to the response by its
record id; the metadata also names the conversion. The source's target, date, header lines and
digests go along unchanged; blocks get digests of their own. Record ids are derived from the
source's id and the record type, so that a repeated run, or a task that runs twice, gives the same.

Everything is computed within the row; nothing is shuffled.

Edge cases: a null payload is an empty one. A null target, date or header line is left out of the
written record. A response without an id gets one from its target and payload. Equal responses
give equal records. All other columns of the input stay; one with the name of a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.rows import give_back, hold
from critiq.session import spread_rows

#: Fixed values of the record format.
VERSION = "WARC/1.1"
HTTP_LINES = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
CONVERTED = "text/plain; charset=utf-8"
FIELDS = "application/warc-fields"
LINE, GAP = "\r\n", "\r\n\r\n"

#: Patterns that Java and RE2 read alike, applied in this order.
HIDDEN = [
    r"(?s)<!--.*?(?:-->|\z)",
    r"(?is)<script[ \t\r\n/>].*?(?:</script[ \t\r\n]*>|\z)",
    r"(?is)<style[ \t\r\n/>].*?(?:</style[ \t\r\n]*>|\z)",
]
BLOCK_TAGS = (
    r"(?i)</?(?:p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|title|article|section|nav|header|footer|"
    r"blockquote|pre|hr|form)(?:[ \t\r\n/][^>]*)?>"
)
OTHER_TAGS = r"</?[A-Za-z!?][^>]*>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
SPACES, BREAKS = r"[ \t\r\x0B\x0C]+", r" ?\n[ \n]*"

RESULTS = [
    "record_id", "warc_type", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type",
    "content_length", "block_digest", "source_headers", "source_block_digest", "source_payload_digest", "block",
]


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A name-based identifier in the form of a UUID."""
    name = F.md5(F.concat_ws("|", *parts).cast("binary"))
    pieces = [F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def plain_text(html: Column) -> Column:
    """The visible text of a page: one line per block, single blanks."""
    text = F.coalesce(html, F.lit(""))
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, r"[ \t\r\n]+", " ")
    text = F.regexp_replace(text, BLOCK_TAGS, "\n")
    text = F.regexp_replace(text, OTHER_TAGS, "")
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = F.regexp_replace(F.regexp_replace(text, SPACES, " "), BREAKS, "\n")
    return F.trim(text, F.lit("\n "))


def responses_of_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None
) -> DataFrame:
    """Crawled pages as response records, beside the columns of `pages`."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    length = F.octet_length(html).cast("string")
    lines = F.concat(F.lit(HTTP_LINES + LINE + "Content-Length: "), length)
    held = hold(
        spread_rows(pages),
        source_id=record_id(F.lit("response"), F.col(id_col).cast("string"), F.col(url_col)),
        source_uri=F.col(url_col),
        source_date=F.lit(date).cast("string"),
        source_headers=lines,
        payload=html,
    )
    return give_back(held, pages, ["source_id", "source_uri", "source_date", "source_headers", "payload"])


def derive_records(responses: DataFrame) -> DataFrame:
    """Two rows per response, of types metadata and conversion, with the columns of RESULTS.

    `responses` has source_id, source_uri, source_date, source_headers (the lines before the
    payload) and payload. These five are replaced by the results, all other columns stay.
    """
    own = ["source_id", "source_uri", "source_date", "source_headers", "payload"]
    rest = responses.select(*[c for c in responses.columns if c not in own])
    held = hold(responses)
    at = {c: F.col(f"held_{i}_") for i, c in enumerate(responses.columns)}
    payload = F.coalesce(at["payload"], F.lit(""))
    made_up = record_id(F.lit("response"), at["source_uri"], F.sha2(payload.cast("binary"), 256))
    names = {c: f"kept_{i}_" for i, c in enumerate(rest.columns)}
    held = held.select(
        *[at[c].alias(n) for c, n in names.items()],
        F.coalesce(at["source_id"], made_up).alias("refers_to"),
        at["source_uri"].alias("target_uri"),
        at["source_date"].alias("warc_date"),
        at["source_headers"].alias("source_headers"),
        digest(F.concat_ws(GAP, at["source_headers"], payload)).alias("source_block_digest"),
        digest(payload).alias("source_payload_digest"),
        plain_text(payload).alias("text"),
    )
    conversion_id = record_id(F.lit("conversion"), F.col("refers_to"))
    metadata_id = record_id(F.lit("metadata"), F.col("refers_to"))
    fields = F.concat_ws(
        LINE,
        F.concat(F.lit("conversion: "), conversion_id),
        F.concat(F.lit("sourcePayloadDigest: "), F.col("source_payload_digest")),
        F.concat(F.lit("textLength: "), F.length("text").cast("string")),
    )
    held = held.withColumn(
        "record",
        F.explode(
            F.array(
                F.struct(
                    metadata_id.alias("record_id"), F.lit("metadata").alias("warc_type"),
                    F.lit(None).cast("string").alias("concurrent_to"), F.lit(FIELDS).alias("content_type"),
                    F.concat(fields, F.lit(LINE)).alias("block"),
                ),
                F.struct(
                    conversion_id.alias("record_id"), F.lit("conversion").alias("warc_type"),
                    metadata_id.alias("concurrent_to"), F.lit(CONVERTED).alias("content_type"),
                    F.col("text").alias("block"),
                ),
            )
        ),
    )
    held = held.withColumns({n: F.col("record")[n] for n in ("record_id", "warc_type", "concurrent_to", "content_type", "block")})
    held = held.withColumns(
        {"content_length": F.octet_length("block").cast("long"), "block_digest": digest(F.col("block"))}
    )
    taken = {c.lower() for c in RESULTS}
    return held.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in taken], *RESULTS)


def record_text(records: DataFrame) -> DataFrame:
    """One column `record`: header lines, an empty line and the block."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    source_line = F.regexp_replace("source_headers", r"\r?\n", " | ")
    header = F.concat_ws(
        LINE,
        F.lit(VERSION),
        line("WARC-Type", F.col("warc_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Concurrent-To", F.col("concurrent_to")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("X-Source-Headers", source_line),
        line("X-Source-Block-Digest", F.col("source_block_digest")),
        line("X-Source-Payload-Digest", F.col("source_payload_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
    )
    return records.select(F.concat_ws(GAP, header, F.col("block")).alias("record"))


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One file per task: records, each with the two line ends that close it."""
    record_text(records).write.option("lineSep", GAP).option("compression", compression).text(path)
