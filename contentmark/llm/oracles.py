"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

WS = r"\x20\x09-\x0D"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{WS}]+'))::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         2.0::DOUBLE * source_size AS cap FROM s
), r AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w
), level AS (
  SELECT arg_min((budget - capped) / free, cap / w) FILTER ((budget - capped) / free <= cap / w) AS level FROM r
), t AS (
  SELECT source, source_size, least(cap, coalesce(level, 'inf'::DOUBLE) * w) AS target FROM w, level
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), x AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.whole,
         round(u.target)::BIGINT - u.whole * u.source_size AS need,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, need - before)))::BIGINT AS taken FROM x
"""

ESCAPED = "replace({0}, '\\', '\\\\')"
for _c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
    ESCAPED = f"replace({ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

OP5 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length({ESCAPED.format("text")}) + length(replace({ESCAPED.format("role")}, chr(10), '\\' || chr(10)))
             + 17)::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def oracles() -> dict[str, str]:
    return {"op1_mixing": OP1, "op5_chat_prefix": OP5}
