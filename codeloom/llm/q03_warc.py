"""Query op3: all pages as WARC records, read back in the order of the merged capture index."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .warc import capture_history

NAME = "op3_warc"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_history(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


#: For different, present ids, and for URLs that have a host of names alone (no user, no address in brackets).
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last, CASE WHEN contains(url, '//') THEN url WHEN url <> '' THEN '//' || url END AS url FROM pages),
u AS (SELECT *, n >= 1000 AND page_id < last AS again, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS site, regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS asked FROM p),
k AS (SELECT *, array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(site, ':[0-9]*$', ''), '^www[0-9]*[.]', ''), '.')), ',') AS host, regexp_extract(site, ':([0-9]+)$', 1) AS port FROM u)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to,
  CASE WHEN url IS NULL THEN '' ELSE lower(host || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN asked = '' THEN '' ELSE '?' || asked END) END AS url_key,
  strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % 2000000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp
FROM k
"""
