"""Views that give the driver's tables the shape of clinical records, in Spark's and in DuckDB's SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..runtime import reach

AT = "'@NL@'"

#: {agg:x|order} is an ordered concatenation with @NL@ between.
VIEWS = {
    "rec": """
SELECT d.doc_id AS row_index, d.source AS professor, CAST(d.doc_id AS STRING) AS record_id, d.text AS input,
       CASE WHEN l.doc_id IS NULL THEN '' ELSE d.text END AS output
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "ref": """
SELECT * FROM (SELECT d.doc_id AS row_index, d.source AS professor, CAST(d.doc_id AS STRING) AS record_id, d.text AS input,
       d.text AS output FROM documents d JOIN labels l ON l.doc_id = d.doc_id) q WHERE length(output) >= 10""",
    "conv_rec": """
SELECT conv_id AS row_index, replace({agg:'[' || CAST(turn + 1 AS STRING) || '] ' ||
  CASE role WHEN 'system' THEN 'Discharge Summary' WHEN 'assistant' THEN 'Operative Report'
            ELSE 'Initial Consultation Note' END || ': {{ ' || text || ' }}'|turn}, '@NL@', chr(10)) AS input
FROM conversations GROUP BY conv_id""",
    "order_rec": """
SELECT o_custkey AS row_index, replace({agg:'[' || CAST(n AS STRING) || '] ' ||
  CASE o_orderstatus WHEN 'F' THEN 'Operative Report' WHEN 'O' THEN 'Preoperative Outpatient Note'
                     ELSE 'Discharge Summary' END || ': {{ ' ||
  CASE o_orderstatus WHEN 'F' THEN '수술일 ' WHEN 'O' THEN 'visit ' ELSE '퇴원일 ' END ||
  substr(CAST(o_orderdate AS STRING), 1, 10) || ' }}'|n}, '@NL@', chr(10)) AS input
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) n FROM orders) q GROUP BY o_custkey""",
    "judge_note": """
SELECT event_type AS method, CAST(user_id AS STRING) AS record_id, CAST(user_id % 21 AS BIGINT) AS professor, 1 + k % 5 AS likert,
       k % 4 AS n_unsupported, k % 3 AS n_absent, k % 2 AS n_partial, CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS n_mixing,
       CASE WHEN event_type = 'purchase' THEN NULL ELSE CAST(k % 3 AS DOUBLE) / 2 END AS style_score, k
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) k,
             row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) rn FROM events) q WHERE rn = 1""",
    "fact": """
SELECT l_orderkey AS row_index, '{"all_facts":[' || replace({agg:'{"category":"' || CASE l_linenumber % 4 WHEN 0 THEN 'Operation'
  WHEN 1 THEN 'Medication' WHEN 2 THEN 'Unlisted' ELSE 'Other' END || '","fact":"' || p_type || '","evidence":"' || p_name || '"}'
  |l_linenumber, l_partkey, l_suppkey}, '@NL@', ',') || ']}' AS extracted_facts
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""",
}


def sql_of(name: str, duck: bool = False) -> str:
    def agg(m: re.Match) -> str:
        x, order = m[1].rsplit("|", 1)
        return f"string_agg({x}, {AT} ORDER BY {order})" if duck else f"listagg({x}, {AT}) WITHIN GROUP (ORDER BY {order})"

    sql = re.sub(r"\{agg:(.*?\|(?:turn|n|l_linenumber, l_partkey, l_suppkey))\}", agg, VIEWS[name], flags=re.S)
    return sql.replace("AS STRING)", "AS VARCHAR)") if duck else sql


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter as a DataFrame; the tables are passed to the query, so no view is left in the catalog."""
    sql = sql_of(name)
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    literal = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        literal = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", literal)
    return spark.sql(literal, **{t: load(spark, sf_dir, t) for t in used})
