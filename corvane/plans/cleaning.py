"""Queries of cleaned texts and prompts within a budget, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import cleaning as C
from corvane.functions import status as S
from corvane.functions import udfs as U
from corvane.operators import corpus as X
from corvane.plans.catalog import _LINES, query, t

_STATE = "{{'x': {0}, 'out': {1}, 'seen': {2}, 'used': {3}, 'full': {4}}}"
_NONE = "[]::VARCHAR[]"


def _fold(lines: str, least: int, key: int, rest: int, most_lines: int, most_chars: int) -> str:
    """SQL of a fold over lines: the kept ones as a list."""
    start = _STATE.format("''", _NONE, _NONE, "0::BIGINT", "false")
    each = _STATE.format("x", _NONE, _NONE, "0::BIGINT", "false")
    left = f"({most_chars} - a.used)"
    over = _STATE.format("''", f"CASE WHEN {left} > {rest} THEN list_append(a.out, rtrim(left(r.x, {left})) || '...') ELSE a.out END", "a.seen", "a.used", "true")
    kept = _STATE.format("''", "list_append(a.out, r.x)", f"list_append(a.seen, left(r.x, {key}))", "a.used + length(r.x)", f"len(a.out) + 1 >= {most_lines}")
    return f"list_reduce(list_prepend({start}, list_transform({lines}, lambda x: {each})), lambda a, r: CASE WHEN a.full OR length(r.x) < {least} OR list_contains(a.seen, left(r.x, {key})) THEN a WHEN length(r.x) > {left} THEN {over} ELSE {kept} END).out"


_PARTS = r"""(SELECT doc_id, coalesce(text, '') AS t, list_transform(CASE WHEN len(regexp_split_to_array(coalesce(text, ''), '[\r\n]+')) <= 2
  THEN string_split(regexp_replace(coalesce(text, ''), '([。！？!?.;])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE regexp_split_to_array(coalesce(text, ''), '[\r\n]+') END, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS l FROM documents)"""


@query(rf"""WITH f AS (SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS w, array_to_string({_fold("l", 4, 180, 30, 40, 12000)}, chr(10) || chr(10)) AS x, array_to_string({_fold("l", 4, 180, 30, 6, 500)}, chr(10) || chr(10)) AS y FROM {_PARTS})
SELECT doc_id, md5(CASE WHEN x <> '' THEN x WHEN length(w) <= 12000 THEN w ELSE rtrim(left(w, 12000)) || '...' END) AS whole, md5(CASE WHEN y <> '' THEN y WHEN length(w) <= 500 THEN w ELSE rtrim(left(w, 500)) || '...' END) AS short FROM f""")
def extractive_texts(spark, sf):
    """whole documents, within the limits of a section and within 6 lines and 500 characters."""
    d = t(spark, sf, "documents")
    return d.select("doc_id", F.md5(C.extractive(F.col("text"), 40, 12000)).alias("whole"), F.md5(C.extractive(F.col("text"), 6, 500)).alias("short"))


@query()
def line_cleaners(spark, sf):
    """whole documents."""
    d = t(spark, sf, "documents")
    return d.select("doc_id", C.strict(F.col("text")).alias("strict"), C.relaxed(F.col("text")).alias("relaxed"))


@query(rf"""WITH s AS (SELECT doc_id, list(trim(regexp_replace(line, '\s+', ' ', 'g')) ORDER BY pos) AS l FROM {_LINES} GROUP BY doc_id),
c AS (SELECT doc_id, list_transform(list_filter(l, lambda x: length(x) >= 10), lambda x: CASE WHEN length(x) > 180 THEN rtrim(left(x, 180)) || '...' ELSE x END) AS l FROM s),
k AS (SELECT doc_id, l, list_transform(range(1, 4), lambda i: i <= len(l) AND list_sum(list_transform(l[1:i], lambda x: length(x))) <= 520) AS ok FROM c)
SELECT doc_id, array_to_string(l[1:coalesce(list_position(ok, false), 4) - 1], '|') AS lines FROM k""")
def summary_lines(spark, sf):
    """the lines of each document."""
    d = t(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.array_join(C.summary_lines(F.split("text", "\n")), "|").alias("lines"))


_MARK = len(U.MARKER)
_CUT = f"CASE WHEN floor(length(t) * 0.35) <= share THEN t ELSE left(t, list_max(list_filter(range((share / 0.35)::INT - {_MARK} - 6, (share / 0.35)::INT - {_MARK} + 8), lambda k: k = 0 OR floor((k + {_MARK}) * 0.35) <= share))::INT) || chr(10) || '{U.MARKER[1:]}' END"
_TOKENS = r"(1.5 * length(regexp_replace({0}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) + 0.35 * length(regexp_replace({0}, '[\x{{4e00}}-\x{{9fff}}]', '', 'g')))::DOUBLE"


@query(rf"""WITH p AS (SELECT 'p' || doc_id // 10 AS pid, 'd' || doc_id AS name, CASE WHEN doc_id % 6 = 1 THEN '' ELSE trim(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), ' ') END AS t FROM documents),
n AS (SELECT pid, '[研究筆記 / Study Notes]' || chr(10) || min(name) || ' notes' AS note FROM p WHERE name LIKE '%3' GROUP BY pid),
s AS (SELECT pid, note, greatest(100, floor(greatest(0, 3000 - floor(coalesce({_TOKENS.format("note")}, 0))) / greatest(1, count(*) FILTER (t <> '')))) AS share FROM p LEFT JOIN n USING (pid) GROUP BY pid, note),
c AS (SELECT pid, name, t, {_CUT} AS cut FROM p JOIN s USING (pid)),
g AS (SELECT pid, list('[論文全文 / Paper Full Text: ' || name || ']' || chr(10) || cut ORDER BY name) FILTER (t <> '') AS parts, list(name ORDER BY name) FILTER (t = '') AS skipped, list('paper:' || name ORDER BY name) FILTER (t <> '') AS named FROM c GROUP BY pid),
r AS (SELECT pid, array_to_string(list_concat(CASE WHEN note IS NULL THEN [] ELSE [note] END, coalesce(parts, [])), chr(10) || chr(10)) AS corpus, skipped, list_concat(CASE WHEN note IS NULL THEN [] ELSE ['study_notes'] END, coalesce(named, [])) AS sources FROM s JOIN g USING (pid))
SELECT pid, md5(corpus) AS corpus_md5, array_to_string(coalesce(skipped, []), ',') AS skipped, array_to_string(sources, ',') AS sources, floor({_TOKENS.format("corpus")})::BIGINT AS estimated_tokens FROM r""")
def drafting_corpus(spark, sf):
    """Ten documents a project, every sixth without text; some projects have notes."""
    d = t(spark, sf, "documents").select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 10)).alias("pid"), F.concat(F.lit("d"), "doc_id").alias("name"), F.when(F.col("doc_id") % 6 != 1, F.col("text")).alias("text"))
    notes = d.where("name LIKE '%3'").groupBy("pid").agg(F.concat(F.min("name"), F.lit(" notes")).alias("text"))
    c = X.assemble_corpus(d, notes, 3000)
    return c.select("pid", F.md5("corpus").alias("corpus_md5"), F.array_join("skipped", ",").alias("skipped"), F.array_join("sources", ",").alias("sources"), F.col("estimated_tokens").cast("long").alias("estimated_tokens"))


@query(r"""WITH c AS (SELECT doc_id, ['figure', 'table', ''][doc_id % 3 + 1] AS kind, trim(regexp_replace(CASE doc_id % 4 WHEN 0 THEN 'see Figure ' || doc_id || ': ' WHEN 1 THEN 'TABLE  7. ' WHEN 2 THEN 'fig. 3: ' ELSE '' END || coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM documents),
m AS (SELECT *, regexp_extract(s, '(?is)(' || CASE kind WHEN 'figure' THEN 'Figure' WHEN 'table' THEN 'Table' ELSE 'x{99}' END || '\s*\d+[.:]\s*.+)', 1) AS f FROM c)
SELECT doc_id, kind, CASE WHEN f <> '' THEN left(f, 700) ELSE left(s, 420) END AS caption FROM m""")
def captions(spark, sf):
    """Documents as texts beside figures and tables, some of another kind."""
    k = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("figure"), F.lit("table"), F.lit("")), (k % 3 + 1).cast("int"))
    lead = F.when(k % 4 == 0, F.concat(F.lit("see Figure "), k, F.lit(": "))).when(k % 4 == 1, "TABLE  7. ").when(k % 4 == 2, "fig. 3: ").otherwise("")
    return t(spark, sf, "documents").select("doc_id", kind.alias("kind"), S.caption(kind, F.concat(lead, F.coalesce("text", F.lit("")))).alias("caption"))
