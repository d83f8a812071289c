"""Rows out of provider payloads, responses, page texts and captured event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators import ordered
from attestor.sources import store


def payload_rows(payloads: DataFrame, body: str = "body") -> DataFrame:
    """payloads: query_id, body (JSON with `results`). A row for each result with an http(s) URL; the title falls back to the URL, a score that is no number to null; bodies that can't be read give no row."""
    kind = "struct<results:array<struct<url:string,title:string,content:string,score:string>>>"
    rows = payloads.select("query_id", F.posexplode(F.from_json(body, kind)["results"]).alias("pos", "r"))
    r = F.col("r")
    return rows.where(r["url"].rlike("^https?://")).select(
        "query_id", "pos", r["url"].alias("url"), F.coalesce(F.nullif(F.trim(r["title"]), F.lit("")), r["url"]).alias("title"), F.coalesce(r["content"], F.lit("")).alias("content"), lenient_double(r["score"]).alias("score")
    )


def lenient_double(text: Column) -> Column:
    return text.try_cast("double")


MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def lenient_time(text: Column) -> Column:
    """The moment, in UTC, of an ISO time or day or a mail date; without a zone it is in UTC; null for anything else."""
    t = F.trim(text)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
    part = lambda i: F.regexp_extract(t, r"^(?:[A-Z][a-z]{2}, )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4})(?: (\d{2}:\d{2}(?::\d{2})?))?(?: (GMT|UTC|UT|Z|[+-]\d{4}))?$", i)
    month = (F.position(part(2), F.lit(MONTHS)) + 2) / 3
    mail = F.when(
        (part(3) != "") & (F.position(part(2), F.lit(MONTHS)) > 0),
        F.concat(part(3), F.lit("-"), F.lpad(month.cast("int").cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), F.coalesce(F.nullif(part(4), F.lit("")), F.lit("00:00")), F.when(part(5).rlike("^[+-]"), part(5)).otherwise("Z")),
    )
    whole = F.coalesce(F.when(iso, F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00"))).otherwise(t)), mail)
    whole = F.regexp_replace(whole, r"([T ]\d{2}:\d{2})(?=Z|[+-]|$)", "$1:00")
    zoned = F.when(whole.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & ~whole.rlike(r"^\d{4}-\d{2}-\d{2}$"), whole).otherwise(F.concat(whole, F.lit("Z")))
    return F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")


def lenient_date(text: Column) -> Column:
    return F.substring(F.from_utc_timestamp(lenient_time(text), "UTC").cast("string"), 1, 10).try_cast("date")


def looks_like_pdf(body: Column, content_type: Column) -> Column:
    """A PDF by its first bytes, by the same mark within the first 1024 if no HTML begins before, or by the content type. body: the beginning of the response as text."""
    head = F.left(F.coalesce(body, F.lit("")), F.lit(1024))
    return head.startswith("%PDF-") | (head.contains("%PDF-") & ~F.lower(head).contains("<html")) | F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False))


def fetch_status(status: Column, content_type: Column, length: Column, most: int = 5_000_000) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(status.isNull(), "timeout").when(status.isin(401, 403, 451), "blocked").when(status == 404, "not_found").when(status >= 400, "http_error")
        .when(length > most, "too_large").when(kind.contains("pdf"), "pdf").when(kind.rlike("html|text/plain|xml"), "ok").otherwise("unsupported_type")
    )


def page_offsets(pages: DataFrame, doc: str = "doc_id", number: str = "page_no", text: str = "text") -> DataFrame:
    """Start of each page in the joined text, where a newline follows each page. A document's pages are summed in ranges of their numbers, which are unique within it."""
    taken = F.coalesce(F.length(text) + 1, F.lit(0))
    ends = ordered.running_sums(store.written(pages, "pages"), [doc], number, [], {"offset": taken})
    return ends.withColumn("offset", F.col("offset") - taken)


def page_summaries(pages: DataFrame, doc: str, number: str, text: str, most_pages: int, most_chars: int) -> DataFrame:
    """By document: pages in all, pages and characters kept (the first most_pages, whole pages up to most_chars), whether any was left out, and whether it seems scanned: under 40 characters for each of its first three pages."""
    placed = page_offsets(pages, doc, number, text).withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(number)))
    kept = (F.col("_n") <= most_pages) & (F.col("offset") + F.length(text) <= most_chars)
    out = placed.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.count_if(kept).alias("kept"), F.coalesce(F.sum(F.when(kept, F.length(text))), F.lit(0)).alias("chars"))
    return out.withColumn("cut", F.col("kept") < F.col("pages")).withColumn("scanned", F.col("chars") < 40 * F.least("pages", F.lit(3)))


def page_of(offsets: Column, at: Column) -> Column:
    """Number, from 1, of the last page that starts at or before `at`; null without pages or for a negative position."""
    return F.when((F.size(offsets) > 0) & (at >= 0), F.size(F.filter(offsets, lambda o: o <= at)))


def sse_events(captures: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, pos, event, data: the blocks of a captured server-sent stream that have data; the event defaults to `message`."""
    blocks = captures.select(key, F.posexplode(F.split(raw, "\n\n")).alias("pos", "b"))
    event = F.coalesce(F.nullif(F.regexp_extract("b", r"(?m)^event: ?(.*)$", 1), F.lit("")), F.lit("message"))
    return blocks.where(F.col("b").rlike(r"(?m)^data: ?")).select(key, "pos", event.alias("event"), F.regexp_extract("b", r"(?m)^data: ?(.*)$", 1).alias("data"))


def sse_records(chunks: DataFrame, key: str, order: str, body: str = "body") -> DataFrame:
    """key, pos, event, data of captured server-sent streams that come in chunks cut anywhere, between two bytes of a character too: the blocks that have data, as sse_events gives them for the whole.

    Lines are numbered by the newlines before them, blocks by the blank lines before theirs; both are running sums that cut a capture into ranges. What lies in several chunks meets by its number, so no more than one line, and then
    one block, is ever in one place. order: a number that is unique within a capture. body: binary; null counts as empty. A line's last `\\r` goes with its newline.
    """
    text = F.decode(F.coalesce(F.col(body), F.lit(b"")), "ISO-8859-1")  # a character a byte
    rows = store.written(chunks.select(F.col(key).alias("k"), F.col(order).alias("n"), text.alias("t")), "chunks")
    ends = ordered.running_sums(rows, ["k"], "n", [], {"upto": F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))})
    pieces = ends.withColumn("own", F.split("t", "\n")).select("k", "n", (F.col("upto") - F.size("own") + 1).alias("before"), F.posexplode("own").alias("i", "piece"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "")
    lines = pieces.groupBy("k", (F.col("before") + F.col("i")).alias("line")).agg(F.decode(F.encode(line, "ISO-8859-1"), "UTF-8").alias("said"))
    lines = store.written(lines.select("k", "line", F.regexp_replace("said", r"\r$", "").alias("said")), "lines")
    blocks = ordered.running_sums(lines, ["k"], "line", [], {"pos": (F.col("said") == "").cast("long")}).where("said <> ''")
    first = lambda name: F.min_by(F.when(F.col("said").startswith(name + ":"), F.regexp_replace("said", f"^{name}: ?", "")), F.when(F.col("said").startswith(name + ":"), F.col("line")))
    found = blocks.groupBy("k", "pos").agg(first("event").alias("event"), first("data").alias("data"))
    return found.where("data is not null").select(F.col("k").alias(key), F.col("pos").cast("int").alias("pos"), F.coalesce(F.nullif("event", F.lit("")), F.lit("message")).alias("event"), "data")
