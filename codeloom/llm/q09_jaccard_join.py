"""Query op9: groups of documents whose 3-word shingles agree to 90 percent."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .jaccard import similar_groups

NAME = "op9_jaccard_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.t FROM r JOIN e ON e.a = r.v WHERE r.t < e.b)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.t AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(t) AS t FROM r GROUP BY v) m ON m.v = doc_id
"""
