"""Query op2: every document without runs of lines that come earlier, too."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .line_dedup import remove_repeated_chunks

NAME = "op2_line_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "deduped.n_lines", "deduped.n_removed", F.sha2(F.col("deduped.text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line, len(l) AS n FROM d),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS v FROM x),
r AS (SELECT doc_id, i, n FROM (SELECT *, (coalesce(lag(v) OVER w, 0) * 31 + v) % 1000003 % 2 = 0 AS e FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE e AND i < n
  UNION ALL SELECT doc_id, 0, len(l) FROM d),
u AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
e AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS p FROM u) WHERE p % 2 = 1 AND i BETWEEN 1 AND n - 2),
c AS MATERIALIZED (SELECT x.doc_id, x.i, x.line, coalesce(count(e.i) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM x LEFT JOIN e ON e.doc_id = x.doc_id AND e.i = x.i),
k AS (SELECT doc_id, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM c GROUP BY doc_id, no),
g AS (SELECT doc_id, no FROM (SELECT doc_id, no, row_number() OVER (PARTITION BY t ORDER BY doc_id, no) AS q FROM k WHERE n > 1) WHERE q > 1)
SELECT c.doc_id, count(*) AS n_lines, count(g.no) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.no IS NULL), '')) AS kept_sha256
FROM c LEFT JOIN g ON g.doc_id = c.doc_id AND g.no = c.no GROUP BY c.doc_id
"""
