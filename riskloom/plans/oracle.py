"""DuckDB SQL for each registered query: the independent check of the Spark plans.

Every statement starts from the given tables; the bindings of FIXTURES.md §4 are
inlined as CTEs, then the query itself is plain SQL.
"""

from __future__ import annotations

from riskloom import rules
from riskloom.operators import events as EV
from riskloom.operators import news as R9
from riskloom.sources.bindings import TEMPLATES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TEMPLATE_VALUES = ",\n  ".join(f"({k}, {_q(s)})" for k, s in TEMPLATES)

VIEWS: dict[str, str] = {
    "v_book_raw": """
SELECT s_suppkey AS book_row_id, s_name AS vendor,
  CASE s_suppkey % 3 WHEN 0 THEN 'Display' WHEN 1 THEN 'Audio' ELSE 'Control' END AS category,
  n_name AS hq_country,
  CASE s_suppkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN ''
    ELSE concat('2024-01-', lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0'), ' 00:00:00') END AS last_checked,
  CASE s_suppkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN 'True'
    WHEN 4 THEN ' no ' WHEN 5 THEN 'nan' WHEN 6 THEN '2' ELSE '0.0' END AS is_risk,
  CASE s_suppkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'abc' ELSE CAST(s_suppkey % 6 AS STRING) END AS risk_level,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('seed reason ', CAST(s_suppkey % 6 AS STRING)) END AS risk_reason,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE '2024-01-01 00:00:00' END AS last_risk_eval
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_decisions": """
SELECT event_id AS decision_id,
  concat('Supplier#', lpad(CAST(user_id AS STRING), 9, '0')) AS vendor,
  date_trunc('second', ts) AS decided_at,
  CAST(floor(value) AS INT) % 6 AS risk_level,
  CAST(floor(value) AS INT) % 6 >= 3 AS is_risk,
  event_type AS risk_reason
FROM events""",
    "v_evidence": """
SELECT event_id AS evidence_id,
  concat('Supplier#', lpad(CAST(user_id AS STRING), 9, '0')) AS vendor,
  concat(event_type, '_', CAST(lvl AS STRING), '_', CAST(event_id % 7 AS STRING)) AS condition,
  lvl AS level,
  concat('src', CAST(event_id % 20 AS STRING)) AS outlet,
  CASE WHEN event_id % 20 < 5 THEN 1 WHEN event_id % 20 < 12 THEN 2 ELSE 3 END AS tier,
  event_id % 5 <> 0 AS in_scope,
  event_id % 7 = 0 AS new_models_only,
  event_type = 'error' AS is_breach,
  event_type = 'error' AND lvl = 5 AS is_going_concern,
  event_type = 'purchase' AND lvl <= 1 AS is_resolution,
  ts AS published_at
FROM (SELECT *, least(CAST(floor(value) AS INT) % 6, CASE WHEN event_id % 211 = 0 THEN 5 WHEN event_id % 97 = 0 THEN 4
  WHEN event_id % 41 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 2 ELSE 1 END) AS lvl FROM events) e""",
    "v_templates": f"""
SELECT * FROM (VALUES
  {_TEMPLATE_VALUES}) AS t(k, stmt)""",
    "v_news": """
SELECT doc_id AS item_id,
  concat('Supplier#', lpad(CAST(n_chars % m AS STRING), 9, '0')) AS vendor,
  source AS outlet,
  CASE WHEN source IN ('src0','src1','src2') THEN 1
    WHEN source IN ('src3','src4','src5','src6','src7','src8') THEN 2 ELSE 3 END AS tier,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE DATE '2023-08-01' + CAST(doc_id % 183 AS INT) END AS published_on,
  concat(CASE WHEN n_chars % 5 <> 0 THEN concat('SUP-', CAST(n_chars % m AS STRING), ' ') ELSE '' END, stmt, '. ', text) AS text
FROM documents
JOIN v_templates ON k = n_chars % 16
CROSS JOIN (SELECT CAST(count(*) * 1.2 AS BIGINT) AS m FROM supplier) AS c""",
    "v_aliases": """
SELECT s_name AS vendor, concat('SUP-', CAST(s_suppkey AS STRING)) AS alias FROM supplier""",
    "v_notes": """
SELECT doc_id AS write_seq,
  concat('Supplier#', lpad(CAST(doc_id % m AS STRING), 9, '0')) AS vendor_key,
  concat('research_2024-01-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), '_',
    lpad(CAST(doc_id % 24 AS STRING), 2, '0'), '-', lpad(CAST(doc_id % 60 AS STRING), 2, '0'), '-00.md') AS file_name,
  text
FROM documents
CROSS JOIN (SELECT CAST(count(*) * 1.2 AS BIGINT) AS m FROM supplier) AS c""",
}

_VIEW_DEPS = {"v_news": ("v_templates",)}
_VIEW_ORDER = tuple(VIEWS)


def with_views(body: str, ctes: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the binding views and extra CTEs it mentions."""
    ctes = ctes or {}
    text = body + " ".join(ctes.values())
    needed = {v for v in _VIEW_ORDER if v in text}
    for v in list(needed):
        needed.update(_VIEW_DEPS.get(v, ()))
    parts = [f"{v} AS ({VIEWS[v]}\n)" for v in _VIEW_ORDER if v in needed]
    parts += [f"{name} AS (\n{sql}\n)" for name, sql in ctes.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# --- reusable SQL fragments (DuckDB dialect) ---------------------------------


def sql_list(values) -> str:
    return ", ".join(_q(v) for v in values)


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, {_q(rules.STRIP_PATTERN)}, '', 'g')"


def words_sql(expr: str) -> str:
    return f"lower(regexp_replace({expr}, {_q(rules.NON_WORD_PATTERN)}, ' ', 'g'))"


def flag_text_sql(expr: str) -> str:
    """H1 on text, stored as '1' / '0' / NULL."""
    t = f"lower({strip_sql(expr)})"
    return (f"CASE WHEN {t} IN ({sql_list(rules.FLAG_TRUE_SPELLINGS)}) THEN '1' "
            f"WHEN {t} IN ({sql_list(rules.FLAG_FALSE_SPELLINGS)}) THEN '0' END")


def flag_bool_sql(expr: str) -> str:
    t = f"lower({strip_sql(expr)})"
    return (f"CASE WHEN {t} IN ({sql_list(rules.FLAG_TRUE_SPELLINGS)}) THEN true "
            f"WHEN {t} IN ({sql_list(rules.FLAG_FALSE_SPELLINGS)}) THEN false END")


def ts_sql(expr: str) -> str:
    """H3: per-row timestamp parse, junk -> NULL."""
    return f"COALESCE(TRY_CAST({strip_sql(expr)} AS TIMESTAMP), try_strptime({strip_sql(expr)}, '%m/%d/%Y'))"


def num_sql(expr: str) -> str:
    """H4: plain decimal text -> double."""
    return (f"CASE WHEN regexp_matches({expr}, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$') "
            f"THEN TRY_CAST({strip_sql(expr)} AS DOUBLE) END")


def num_text_sql(expr: str) -> str:
    """H2 for numbers: integral -> integer text."""
    x = f"CAST({expr} AS DOUBLE)"
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN {x} = floor({x}) "
            f"THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END")


def ts_text_sql(expr: str) -> str:
    return f"strftime(date_trunc('second', {expr}), '%Y-%m-%d %H:%M:%S')"


def bool_text_sql(expr: str) -> str:
    return f"CASE WHEN {expr} THEN '1' WHEN NOT {expr} THEN '0' END"


def norm_text_sql(expr: str) -> str:
    """Padded, lower-cased word text used by all lexicon patterns."""
    return f"concat(' ', {words_sql(expr)}, ' ')"


BOOK_TEXT = f"""
SELECT book_row_id, vendor, category, hq_country, last_checked,
  {flag_text_sql('is_risk')} AS is_risk, risk_level, risk_reason, last_risk_eval
FROM v_book_raw"""

def typed_sql(src: str) -> str:
    return f"""
SELECT book_row_id, vendor, category, hq_country,
  {ts_sql('last_checked')} AS last_checked,
  CASE WHEN is_risk = '1' THEN true WHEN is_risk = '0' THEN false
       ELSE {flag_bool_sql('is_risk')} END AS is_risk,
  {num_sql('risk_level')} AS risk_level,
  risk_reason,
  {ts_sql('last_risk_eval')} AS last_risk_eval
FROM {src}"""


BOOK_TYPED = typed_sql("book_text")

FLAG_HISTORY = """
SELECT id, changed_at, vendor, field, old_value, new_value FROM (
  SELECT decision_id AS id, decided_at AS changed_at, vendor, 'is_risk' AS field,
    lag(is_risk) OVER (PARTITION BY vendor ORDER BY decided_at, decision_id) AS prev,
    is_risk,
    CASE WHEN lag(is_risk) OVER (PARTITION BY vendor ORDER BY decided_at, decision_id) THEN '1'
         WHEN NOT lag(is_risk) OVER (PARTITION BY vendor ORDER BY decided_at, decision_id) THEN '0' END AS old_value,
    CASE WHEN is_risk THEN '1' WHEN NOT is_risk THEN '0' END AS new_value
  FROM v_decisions) h
WHERE prev IS DISTINCT FROM is_risk"""


def risk_changes_since_sql(since: str) -> str:
    return f"""
SELECT * FROM change_log
WHERE field = 'is_risk' AND changed_at >= TIMESTAMP '{since}'
  AND (coalesce(old_value, '') = '1' OR coalesce(new_value, '') = '1')"""


LATEST_CHANGE = """
SELECT id, changed_at, vendor, field, old_value, new_value FROM (
  SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY changed_at DESC, id DESC) AS rn FROM changes_since) x
WHERE rn = 1"""

LATEST_DECISION = """
SELECT vendor, decision_id, decided_at, risk_level, is_risk, risk_reason FROM (
  SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY decided_at DESC, decision_id DESC) AS rn
  FROM v_decisions) x WHERE rn = 1"""

BOOK_UPSERT = f"""
SELECT b.book_row_id, b.vendor, b.category, b.hq_country, b.last_checked,
  CASE WHEN d.vendor IS NOT NULL THEN {bool_text_sql('d.is_risk')} ELSE b.is_risk END AS is_risk,
  CASE WHEN d.vendor IS NOT NULL THEN {num_text_sql('d.risk_level')} ELSE b.risk_level END AS risk_level,
  CASE WHEN d.vendor IS NOT NULL THEN d.risk_reason ELSE b.risk_reason END AS risk_reason,
  CASE WHEN d.vendor IS NOT NULL THEN {ts_text_sql('d.decided_at')} ELSE b.last_risk_eval END AS last_risk_eval
FROM book_text b LEFT JOIN latest_decision d ON b.vendor = d.vendor"""


# --- per-query oracle statements -------------------------------------------------

RUN_START_SQL = "2024-01-29 12:00:00"
QUEUE_K = rules.QUEUE_K

QUEUE = f"""
SELECT CAST(row_number() OVER (ORDER BY last_checked ASC NULLS FIRST, vendor, book_row_id) AS BIGINT) AS queue_pos,
  book_row_id, vendor, last_checked,
  (last_checked IS NOT NULL AND trim(last_checked) <> '' AND {ts_sql('last_checked')} IS NULL) AS unparseable_date
FROM (SELECT * FROM book_text ORDER BY last_checked ASC NULLS FIRST, vendor, book_row_id LIMIT {QUEUE_K}) q"""

VIEW_ORDER = "is_risk DESC NULLS LAST, risk_level DESC NULLS LAST, last_checked ASC NULLS LAST, vendor, book_row_id"
VIEW_COLS = "book_row_id, vendor, category, hq_country, last_checked, risk_level, is_risk, risk_reason, last_risk_eval"

BOOK_FIELDS = ("vendor", "category", "hq_country", "last_checked", "is_risk", "risk_level", "risk_reason", "last_risk_eval")


def diff_sql(before: str, after: str, changed_at: str) -> str:
    parts = [
        f"SELECT TIMESTAMP '{changed_at}' AS changed_at, a.book_row_id, a.vendor, {i} AS field_ordinal, '{f}' AS field, "
        f"b.{f} AS old_value, a.{f} AS new_value FROM {before} b JOIN {after} a ON a.book_row_id = b.book_row_id "
        f"WHERE b.{f} IS DISTINCT FROM a.{f}"
        for i, f in enumerate(BOOK_FIELDS)
    ]
    return "\nUNION ALL\n".join(parts)


def base_ctes() -> dict[str, str]:
    return {"book_text": BOOK_TEXT, "book_typed": BOOK_TYPED}


def change_ctes(since: str = RUN_START_SQL) -> dict[str, str]:
    return {"change_log": FLAG_HISTORY, "changes_since": risk_changes_since_sql(since)}


def oracle_statements() -> dict[str, str]:
    b = {"book_text": BOOK_TEXT}
    bt = base_ctes()
    ch = change_ctes()
    upsert = {"book_text": BOOK_TEXT, "latest_decision": LATEST_DECISION, "book_upsert": BOOK_UPSERT}
    out = {
        "book_ingest": with_views("SELECT * FROM book_text", b),
        "book_typed": with_views("SELECT * FROM book_typed", bt),
        "parse_flag": with_views(f"SELECT book_row_id, is_risk AS flag_text, {flag_bool_sql('is_risk')} AS flag FROM v_book_raw"),
        "canonical_cells": (
            f"SELECT event_id, {ts_text_sql('ts')} AS ts_text, {num_text_sql('value')} AS value_text, "
            f"{bool_text_sql(chr(40) + 'event_type = ' + _q('error') + chr(41))} AS flag_text, props AS props_text FROM events"
        ),
        "vendor_key": (
            f"SELECT page_id, url AS name, {vendor_key_sql('url')} AS vendor_key FROM pages"
        ),
        "book_count": with_views("SELECT count(*) AS n_vendors FROM v_book_raw"),
        "vendor_queue": with_views("SELECT * FROM queue", {**b, "queue": QUEUE}),
        "queue_preview": with_views(
            "SELECT count(*) AS n_vendors, CASE WHEN count(*) = 0 THEN " + _q(rules.EMPTY_QUEUE_MESSAGE)
            + " ELSE concat('**Next ', CAST(count(*) AS VARCHAR), ' vendor(s) by oldest Last Checked Date:**', chr(10), chr(10), "
            "string_agg('- ' || vendor, chr(10) ORDER BY queue_pos)) END AS preview FROM queue",
            {**b, "queue": QUEUE},
        ),
        "vendor_book_view": with_views(
            f"SELECT row_number() OVER (ORDER BY {VIEW_ORDER}) AS view_pos, {VIEW_COLS} FROM book_typed", bt),
        "flagged_vendors": with_views(
            f"SELECT row_number() OVER (ORDER BY {VIEW_ORDER}) AS view_pos, {VIEW_COLS} FROM book_typed WHERE is_risk", bt),
        "vendor_subset": with_views(
            "SELECT book_row_id, vendor, last_checked FROM book_text WHERE vendor IN "
            "('Supplier#000000002', 'Supplier#000000005', 'Supplier#000000009')", b),
        "book_touch": with_views(
            f"SELECT b.book_row_id, b.vendor, b.category, b.hq_country, "
            f"CASE WHEN q.vendor IS NOT NULL THEN '{RUN_START_SQL}' ELSE b.last_checked END AS last_checked, "
            "b.is_risk, b.risk_level, b.risk_reason, b.last_risk_eval "
            "FROM book_text b LEFT JOIN (SELECT DISTINCT vendor FROM queue) q ON b.vendor = q.vendor",
            {**b, "queue": QUEUE}),
        "book_upsert": with_views("SELECT * FROM book_upsert", upsert),
        "risk_flag": with_views("SELECT decision_id, vendor, risk_level, risk_level >= 3 AS is_risk FROM v_decisions"),
        "change_log_history": with_views("SELECT * FROM change_log", {"change_log": FLAG_HISTORY}),
        "risk_changes_since": with_views("SELECT * FROM changes_since", ch),
        "risk_changes_latest": with_views("SELECT * FROM latest_change", {**ch, "latest_change": LATEST_CHANGE}),
        "vendor_change_history": with_views(
            "SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY changed_at DESC, id DESC) AS history_pos FROM change_log",
            {"change_log": FLAG_HISTORY}),
        "stored_log_since": with_views("SELECT * FROM changes_since", ch),
        "stored_log_history": with_views(
            "SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY changed_at DESC, id DESC) AS history_pos FROM change_log",
            {"change_log": FLAG_HISTORY}),
        "change_log_diff": with_views(diff_sql("book_text", "book_upsert", RUN_START_SQL), upsert),
    }
    out.update(alert_statements())
    out.update(score_statements())
    out.update(news_statements())
    out.update(plan_statements())
    near = {"features": FEATURES, "reps": NEAR_REPS, "g": NEAR_SETS, "hits": NEAR_HITS, "cited": NEAR}
    out["syndication_clusters"] = with_views(CLUSTERS, {**near, "chain": CHAIN}).replace("WITH ", "WITH RECURSIVE ", 1)
    out["syndication_near"] = with_views(NEAR, {"features": FEATURES, "reps": NEAR_REPS, "g": NEAR_SETS, "hits": NEAR_HITS})
    return out


# --- notes and alerts -------------------------------------------------------------

NOTE_STAMP_RE = r"^research_(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})\.md$"

NOTES_DEDUP = f"""
SELECT vendor_key, file_name, write_seq, noted_at, CAST(noted_at AS DATE) AS note_date, text FROM (
  SELECT vendor_key, file_name, write_seq, text,
    try_strptime(regexp_extract(file_name, '{NOTE_STAMP_RE}', 1), '%Y-%m-%d_%H-%M-%S') AS noted_at,
    row_number() OVER (PARTITION BY vendor_key, file_name ORDER BY write_seq DESC) AS rn
  FROM v_notes) x WHERE rn = 1"""

NEWEST_NOTES = """
SELECT vendor_key, max(file_name) AS file_label, arg_max(text, file_name) AS summary_text
FROM notes_dedup GROUP BY vendor_key"""


def vendor_key_sql(expr: str) -> str:
    return f"COALESCE(NULLIF({strip_sql("translate(" + expr + ", '/" + chr(92) + "', '--')")}, ''), 'unknown')"


def status_sql(expr: str = "new_value") -> str:
    return f"CASE WHEN {strip_sql(expr)} = '1' THEN 'NEW RISK' ELSE 'CLEARED' END"


def shown_sql(expr: str) -> str:
    return f"COALESCE(NULLIF({strip_sql(expr)}, ''), 'null')"


def first_sentence_sql(expr: str) -> str:
    short = "|".join(rules.ABBREVIATIONS)
    held = f"regexp_replace({expr}, '(^|[^A-Za-z])({short}|[A-Z](?:\\.[A-Z])*)\\.', '\\1\\2' || chr(1), 'g')"
    s = f"replace(COALESCE(NULLIF(regexp_extract({held}, '^\\s*(.+?[.!?])(\\s|$)', 1), ''), trim({held})), chr(1), '.')"
    return f"CASE WHEN regexp_matches({s}, '[.!?]$') THEN {s} ELSE {s} || '.' END"


LEVEL_TEXT = f"COALESCE({num_text_sql('risk_level')}, 'unknown')"
REASON_TEXT = "COALESCE(risk_reason, 'No reason recorded.')"

ENRICHED = """
SELECT l.id, l.changed_at, l.vendor, l.field, l.old_value, l.new_value, b.book_row_id, b.risk_level, b.risk_reason
FROM latest_change l LEFT JOIN typed_after b ON l.vendor = b.vendor"""

ENRICHED_NOTES = f"""
SELECT e.*, k.vendor_key, COALESCE(n.file_label, 'N/A') AS file_label,
  COALESCE(n.summary_text, 'No research file found.') AS summary_text
FROM enriched e
JOIN (SELECT DISTINCT vendor, {vendor_key_sql('vendor')} AS vendor_key FROM enriched) k ON k.vendor = e.vendor
LEFT JOIN newest_notes n ON n.vendor_key = k.vendor_key"""

SECTION = (
    "concat('## ', vendor, chr(10), 'Status: ', " + status_sql() + ", chr(10), 'Transition: ', "
    + shown_sql("old_value") + " || ' -> ' || " + shown_sql("new_value")
    + ", chr(10), 'Risk level: ', " + LEVEL_TEXT + ", chr(10), 'Reason: ', " + REASON_TEXT
    + ", chr(10), 'Source: ', file_label, chr(10), chr(10), 'Research summary:', chr(10), summary_text)"
)

LINES = f"""
SELECT id, vendor, book_row_id, status, line,
  row_number() OVER (ORDER BY status_rank, changed_at DESC, id DESC, book_row_id ASC NULLS FIRST) AS alert_pos
FROM (
  SELECT id, changed_at, vendor, book_row_id, {status_sql()} AS status,
    CASE WHEN {status_sql()} = 'NEW RISK' THEN 0 ELSE 1 END AS status_rank,
    concat({status_sql()}, ' - ', vendor, ': Level ', {LEVEL_TEXT}, '. ', {first_sentence_sql(REASON_TEXT)}) AS line
  FROM enriched) x"""

HEADER = f"""
SELECT count(*) AS n_changes, CAST(coalesce(count_if(status = 'NEW RISK'), 0) AS BIGINT) AS n_new,
  CAST(coalesce(count_if(status = 'CLEARED'), 0) AS BIGINT) AS n_cleared,
  CASE WHEN count(*) = 0 THEN '{rules.NO_CHANGES_MESSAGE}'
    ELSE printf('%d new risks, %d cleared', count_if(status = 'NEW RISK'), count_if(status = 'CLEARED')) END AS header
FROM lines"""

def pages_sql(src: str, size: str, more: str = "") -> str:
    """A page holds the lines that begin within the same PAGE_BYTES of the whole; pages are numbered from 0."""
    return f"""
SELECT row_number() OVER (ORDER BY cut) - 1 AS page_no, count(*) OVER () AS page_count, * EXCLUDE (cut) FROM (
  SELECT cut, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY alert_pos) AS body{more}
  FROM (SELECT *, CAST(floor((sum({size}) OVER (ORDER BY alert_pos) - ({size})) / {rules.ALERT_PAGE_BYTES}) AS BIGINT) AS cut FROM {src}) x
  GROUP BY cut) y"""


PAGES = pages_sql("lines", "strlen(line) + 1")

FULL_TEXT = "CASE WHEN " + strip_sql("body") + " <> '' THEN concat(h.header, chr(10), chr(10), body) ELSE h.header END"


def alert_ctes(since_sql: str | None = None) -> dict[str, str]:
    c = {
        "book_text": BOOK_TEXT, "latest_decision": LATEST_DECISION, "book_upsert": BOOK_UPSERT,
        "typed_after": typed_sql("book_upsert"), "change_log": FLAG_HISTORY,
        "changes_since": risk_changes_since_sql(RUN_START_SQL) if since_sql is None else f"""
SELECT * FROM change_log
WHERE field = 'is_risk' AND changed_at >= ({since_sql})
  AND (coalesce(old_value, '') = '1' OR coalesce(new_value, '') = '1')""",
        "latest_change": LATEST_CHANGE, "enriched": ENRICHED, "lines": LINES,
    }
    return c


def alert_statements() -> dict[str, str]:
    notes = {"notes_dedup": NOTES_DEDUP, "newest_notes": NEWEST_NOTES}
    a = alert_ctes()
    an = {**a, **notes, "enriched_notes": ENRICHED_NOTES}
    return {
        "note_sink_rows": with_views("SELECT * FROM notes_dedup", {"notes_dedup": NOTES_DEDUP}),
        "latest_note": with_views(
            f"SELECT b.book_row_id, b.vendor, b.vendor_key, COALESCE(n.file_label, 'N/A') AS file_label, "
            f"COALESCE(n.summary_text, 'No research file found.') AS summary_text "
            f"FROM (SELECT *, {vendor_key_sql('vendor')} AS vendor_key FROM book_text) b "
            f"LEFT JOIN newest_notes n ON n.vendor_key = b.vendor_key",
            {"book_text": BOOK_TEXT, **notes}),
        "change_enriched": with_views("SELECT * FROM enriched", a),
        "change_payload": with_views(
            f"SELECT id, vendor, book_row_id, {status_sql()} AS status, "
            f"{shown_sql('old_value')} || ' -> ' || {shown_sql('new_value')} AS transition, {SECTION} AS section "
            f"FROM enriched_notes", an),
        "alert_lines": with_views("SELECT * FROM lines", a),
        "alert_header": with_views("SELECT * FROM header", {**a, "header": HEADER}),
        "alert_body": with_views("SELECT * FROM pages", {**a, "pages": PAGES}),
        "alert_full_text": with_views(
            f"SELECT p.page_no, p.page_count, p.n_lines, h.header, {FULL_TEXT} AS full_text FROM pages p, header h",
            {**a, "header": HEADER, "pages": PAGES}),
        "alert_empty": with_views(
            f"SELECT n_changes, n_new, n_cleared, header, header AS full_text FROM header",
            {**alert_ctes("SELECT max(changed_at) + INTERVAL 1 SECOND FROM change_log"), "header": HEADER}),
        "alert_outbox": with_views(
            f"SELECT '{RUN_START_SQL}' AS run_id, p.page_no, p.page_count, p.n_lines, h.header AS subject, p.body, {FULL_TEXT} AS full_text "
            f"FROM pages p, header h",
            {**a, "header": HEADER, "pages": PAGES}),
    }


# --- scoring and decisions ------------------------------------------------------------

ADJUSTED = """
SELECT e.evidence_id, e.vendor, e.condition, e.level,
  CASE WHEN e.new_models_only THEN least(e.level, 4) ELSE e.level END AS adj_level,
  e.outlet, e.tier, e.in_scope, e.published_at
FROM v_evidence e LEFT JOIN (
  SELECT vendor, max(CASE WHEN is_resolution THEN published_at END) AS resolved_at,
    bool_or(is_going_concern) AS gc
  FROM v_evidence GROUP BY vendor) v ON v.vendor = e.vendor
WHERE NOT COALESCE(e.is_breach AND v.resolved_at IS NOT NULL AND e.published_at < v.resolved_at
  AND NOT COALESCE(v.gc, false), false)"""

CORROBORATED = """
SELECT vendor, condition, level, min_tier, n_outlets, capped, CASE WHEN capped THEN 3 ELSE level END AS eff_level
FROM (
  SELECT vendor, condition, max(adj_level) AS level, min(tier) AS min_tier, count(DISTINCT outlet) AS n_outlets,
    (max(adj_level) >= 4 AND min(tier) > 1 AND count(DISTINCT outlet) < 2) AS capped
  FROM adjusted WHERE in_scope GROUP BY vendor, condition) g"""

ROLLUP = """
SELECT g.vendor,
  greatest(1, max_level, CASE WHEN n_level3 >= 2 THEN 4 ELSE 0 END, CASE WHEN n_level4 >= 2 THEN 5 ELSE 0 END) AS in_scope_level,
  max_level, n_level3, n_level4, n_conditions,
  d.condition AS driver_condition, d.eff_level AS driver_level, d.capped AS driver_capped
FROM (
  SELECT vendor, max(eff_level) AS max_level, count_if(eff_level = 3 AND NOT capped) AS n_level3,
    count_if(eff_level = 4) AS n_level4, count(*) AS n_conditions
  FROM corroborated GROUP BY vendor) g
JOIN (
  SELECT vendor, condition, eff_level, capped, row_number() OVER (PARTITION BY vendor
    ORDER BY eff_level DESC, level DESC, n_outlets DESC, condition DESC) AS rn
  FROM corroborated) d ON d.vendor = g.vendor AND d.rn = 1"""

TRACE = """
SELECT vendor, string_agg(condition || ' ' || text, ', ' ORDER BY rule, condition) AS trace FROM (
  SELECT DISTINCT e.vendor, e.condition, r.rule, r.text
  FROM v_evidence e JOIN (
    SELECT vendor, max(CASE WHEN is_resolution THEN published_at END) AS resolved_at, bool_or(is_going_concern) AS gc
    FROM v_evidence GROUP BY vendor) v ON v.vendor = e.vendor
  JOIN (VALUES (0, 'covers new models only, capped at 4'), (1, 'resolved by a later refinancing'),
    (2, 'not cleared by refinancing, a going-concern warning stands')) r(rule, text)
    ON (r.rule = 0 AND e.new_models_only AND e.level > 4)
    OR (r.rule = 1 AND e.is_breach AND e.published_at < v.resolved_at AND NOT COALESCE(v.gc, false))
    OR (r.rule = 2 AND e.is_breach AND e.published_at < v.resolved_at AND COALESCE(v.gc, false))
  WHERE e.in_scope) x
GROUP BY vendor"""

EXCLUDED = """
SELECT vendor, count(*) AS n_excluded, string_agg(DISTINCT condition, ', ' ORDER BY condition) AS excluded
FROM adjusted WHERE NOT in_scope GROUP BY vendor"""

SCORED = """
SELECT b.book_row_id, b.vendor,
  CASE WHEN r.in_scope_level IS NOT NULL THEN r.in_scope_level WHEN x.n_excluded > 0 THEN 1 ELSE 0 END AS risk_level,
  (CASE WHEN r.in_scope_level IS NOT NULL THEN r.in_scope_level WHEN x.n_excluded > 0 THEN 1 ELSE 0 END) >= 3 AS is_risk,
  COALESCE(r.n_conditions, 0) AS n_conditions, COALESCE(x.n_excluded, 0) AS n_excluded,
  r.driver_condition, r.driver_level, r.driver_capped, r.n_level3, r.n_level4, r.max_level, x.excluded, t.trace
FROM book_text b LEFT JOIN rollup r ON r.vendor = b.vendor LEFT JOIN excluded x ON x.vendor = b.vendor LEFT JOIN trace t ON t.vendor = b.vendor"""

REASON = """
SELECT book_row_id, vendor, risk_level, is_risk, driver_condition,
  concat_ws('; ',
    CASE WHEN risk_level = 0 THEN 'No in-scope or out-of-scope events found'
         WHEN driver_condition IS NULL THEN 'Only out-of-scope events reported; level 1'
         ELSE concat('Level ', CAST(risk_level AS VARCHAR), ' driven by ', driver_condition) END,
    CASE WHEN n_level4 >= 2 THEN 'two or more level-4 conditions'
         WHEN n_level3 >= 2 AND risk_level = 4 AND max_level < 4 THEN 'two or more level-3 conditions' END,
    CASE WHEN driver_capped THEN 'single press source, capped at 3 pending confirmation' END,
    CASE WHEN trace IS NOT NULL THEN concat('carve-outs: ', trace) END,
    CASE WHEN excluded IS NOT NULL THEN concat('excluded as out of scope: ', excluded) END) || '.' AS risk_reason
FROM scored"""

LVL8 = "CAST(CAST(CAST(floor(value) AS INT) % 8 - 1 AS INT) AS VARCHAR)"
PAYLOADS = f"""
SELECT event_id AS decision_id, concat('Supplier#', lpad(CAST(user_id AS VARCHAR), 9, '0')) AS vendor,
  date_trunc('second', ts) AS decided_at,
  CASE WHEN event_id % 13 = 0 THEN props
       WHEN event_id % 11 = 0 THEN '{{"Risk_level": ' || {LVL8} || '}}'
       ELSE '{{"Risk_Reason": "' || event_type || '", "Risk_level": ' || {LVL8} || '}}' END AS payload
FROM events"""

INTAKE = """
SELECT decision_id, vendor, decided_at,
  TRY_CAST(json_extract(payload, '$.Risk_level') AS INTEGER) AS risk_level,
  json_extract_string(payload, '$.Risk_Reason') AS risk_reason
FROM payloads"""

VALIDATED = f"""
SELECT *, quarantine_reason IS NULL AS is_valid,
  CASE WHEN quarantine_reason IS NULL THEN risk_level >= 3 END AS is_risk
FROM (
  SELECT *, CASE WHEN risk_level IS NULL THEN 'missing level'
    WHEN risk_level < 0 OR risk_level > 5 THEN 'level out of range'
    WHEN risk_reason IS NULL OR {strip_sql('risk_reason')} = '' THEN 'missing reason' END AS quarantine_reason
  FROM intake) x"""

RESULTS = f"""
SELECT *, CASE WHEN flagged THEN '{rules.RESULT_FLAGGED_LABEL}' WHEN NOT flagged THEN '{rules.RESULT_CLEAR_LABEL}' END AS label,
  CASE WHEN flagged IS NOT NULL THEN '**Done** — level ' || CAST(risk_level AS VARCHAR) || ' ('
    || CASE WHEN flagged THEN '{rules.RESULT_FLAGGED_LABEL}' ELSE '{rules.RESULT_CLEAR_LABEL}' END || '). ' || reason
    ELSE '**Error:** ' || reason END AS log_line
FROM (
  SELECT decision_id, vendor, risk_level, is_risk AS flagged, risk_reason AS reason,
    'Research/' || {vendor_key_sql('vendor')} || '/research_' || strftime(decided_at, '%Y-%m-%d_%H-%M-%S') || '.md' AS research_file
  FROM validated WHERE is_valid
  UNION ALL
  SELECT decision_id, vendor, NULL, NULL, 'Error: ' || quarantine_reason, '' FROM validated WHERE NOT is_valid) u"""

SUMMARY = """
SELECT count(*) AS processed, CAST(count_if(flagged IS NOT NULL) AS BIGINT) AS ok, CAST(count_if(flagged IS NULL) AS BIGINT) AS failed,
  CAST(coalesce(count_if(flagged), 0) AS BIGINT) AS flagged
FROM results"""


def score_ctes() -> dict[str, str]:
    return {"book_text": BOOK_TEXT, "adjusted": ADJUSTED, "corroborated": CORROBORATED,
            "rollup": ROLLUP, "excluded": EXCLUDED, "trace": TRACE, "scored": SCORED}


def decision_ctes() -> dict[str, str]:
    return {"payloads": PAYLOADS, "intake": INTAKE, "validated": VALIDATED, "results": RESULTS}


def score_statements() -> dict[str, str]:
    sc = score_ctes()
    dc = decision_ctes()
    return {
        "adjusted_evidence": with_views("SELECT * FROM adjusted", {"adjusted": ADJUSTED}),
        "corroborated_conditions": with_views("SELECT * FROM corroborated", {"adjusted": ADJUSTED, "corroborated": CORROBORATED}),
        "risk_score": with_views(
            "SELECT book_row_id, vendor, risk_level, is_risk, n_conditions, n_excluded FROM scored", sc),
        "risk_reason": with_views("SELECT * FROM reason", {**sc, "reason": REASON}),
        "decision_intake": with_views("SELECT * FROM intake", dc),
        "decision_validation": with_views("SELECT * FROM validated", dc),
        "run_results": with_views("SELECT * FROM results", dc),
        "run_summary": with_views("SELECT * FROM summary", {**dc, "summary": SUMMARY}),
    }


# --- news selection -----------------------------------------------------------------

AS_OF_SQL = f"DATE '{rules.AS_OF.isoformat()}'"
WINDOW_START_SQL = f"(DATE '{rules.AS_OF.isoformat()}' - {rules.RECENCY_DAYS})"


def event_ctes(src: str = "v_news") -> dict[str, str]:
    """Events by sentence (R4, R12) with their dates (R5), from the rule tables as VALUES."""
    lex = ", ".join("(" + ", ".join([_q(r[0]), *map(str, r[1:])]) + ")" for r in EV.lexicon_rows())
    frames = (*rules.FRAMES, "sentence")
    rule_cols = ["word", "ord", "kind", "name", "level", *[f"need_{f}" for f in frames], *[f"block_{f}" for f in frames]]
    rule = ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in EV.rule_rows())
    marked = f"regexp_replace(text, {_q(EV.ABBREVIATION_PATTERN)}, '\\1\\2' || chr(1), 'g')"
    marked = f"regexp_replace({marked}, {_q(EV.ISO_PATTERN)}, ' {EV.ISO_WORD}\\1\\2\\3 ', 'g')"
    marked = f"regexp_replace({marked}, {_q(EV.PERIOD_PATTERN)}, ' {EV.PERIOD_WORD}\\1x\\2 ', 'g')"
    month = "CASE substr(w.word, 8, 2) " + " ".join(f"WHEN '{k}' THEN {m}" for k, m in EV.PERIOD_MONTHS.items()) + " END"
    date = (f"CASE WHEN starts_with(w.word, '{EV.ISO_WORD}') THEN TRY_CAST(substr(w.word, 8, 4) || '-' || substr(w.word, 12, 2) || '-' || substr(w.word, 14, 2) AS DATE) "
            f"WHEN starts_with(w.word, '{EV.PERIOD_WORD}') THEN last_day(make_date(TRY_CAST(substr(w.word, 11, 4) AS INTEGER), {month}, 1)) END")

    def around(col, frame):
        side = lambda n: f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
        return f"COALESCE(bit_or({col}) OVER (PARTITION BY item_id, sent ORDER BY pos RANGE BETWEEN {side(frame[0])} AND {side(frame[1])}), 0)"

    fires = " AND ".join(f"(x.in_{f} & r.need_{f}) = r.need_{f} AND (x.in_{f} & r.block_{f}) = 0" for f in frames)
    before = "OVER (PARTITION BY item_id ORDER BY sent, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    behind = "OVER (PARTITION BY item_id ORDER BY sent, pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    dates = ", ".join(
        f"last_value(CASE WHEN d IS NOT NULL THEN {c} END IGNORE NULLS) {before} AS before_{n}, first_value(CASE WHEN d IS NOT NULL THEN {c} END IGNORE NULLS) {behind} AS behind_{n}"
        for n, c in (("sent", "sent"), ("pos", "pos"), ("d", "d"), ("by", f"CASE WHEN starts_with(word, '{EV.ISO_WORD}') THEN 'iso' ELSE 'period' END")))
    near = lambda side: f"CASE WHEN {side}_sent = sent THEN abs({side}_pos - pos) ELSE 1000000000 + abs({side}_sent - sent) END"
    return {
        "lexicon": f"SELECT * FROM (VALUES {lex}) t(word, {', '.join(EV.BITS)})",
        "event_rules": f"SELECT * FROM (VALUES {rule}) t({', '.join(rule_cols)})",
        "ev_sents": f"""
SELECT item_id, published_on, unnest(p) AS s, unnest(range(len(p))) AS sent
FROM (SELECT item_id, published_on, string_split_regex({marked}, {_q(EV.SENTENCE_END)}) AS p FROM {src}) x""",
        "ev_words": f"""
SELECT item_id, published_on, sent, unnest(w) AS word, unnest(range(len(w))) AS pos
FROM (SELECT item_id, published_on, sent, string_split(trim({words_sql('s')}), ' ') AS w FROM ev_sents) x""",
        "ev_hits": f"""
SELECT * FROM (
  SELECT w.*, {date} AS d, l.word IS NOT NULL AS listed, {', '.join(f'COALESCE(l.{b}, 0) AS {b}' for b in EV.BITS)}
  FROM ev_words w LEFT JOIN lexicon l ON l.word = w.word) x
WHERE listed OR d IS NOT NULL""",
        "ev_negated": f"SELECT *, {around('negator', rules.NEGATION_BEFORE)} <> 0 AS negated FROM ev_hits",
        "ev_clear": "SELECT * REPLACE (CASE WHEN negated THEN 0 ELSE lifter END AS lifter, CASE WHEN negated THEN 0 ELSE sentence END AS sentence) FROM ev_negated",
        "ev_seen": f"""
SELECT *, {', '.join(f'{around(f, frame)} AS in_{f}' for f, frame in rules.FRAMES.items())},
  bit_or(sentence) OVER (PARTITION BY item_id, sent) AS in_sentence,
  negated OR {around('lifter', rules.NEGATION_AFTER)} <> 0 AS denied, {dates}
FROM ev_clear""",
        "ev_fired": f"""
SELECT x.item_id, x.sent, x.pos, x.published_on, r.ord, r.kind, r.name, r.level,
  CASE WHEN before_d IS NULL THEN behind_d WHEN behind_d IS NULL OR {near('before')} <= {near('behind')} THEN before_d ELSE behind_d END AS d,
  CASE WHEN before_d IS NULL THEN behind_by WHEN behind_d IS NULL OR {near('before')} <= {near('behind')} THEN before_by ELSE behind_by END AS by_
FROM ev_seen x JOIN event_rules r ON r.word = x.word
WHERE {fires} AND (r.kind <> 'rubric' OR NOT x.denied)""",
        "events_x": """
SELECT item_id, sent, ord, kind, name, level, event_on, dated_by FROM (
  SELECT item_id, sent, kind, name, level, COALESCE(d, published_on) AS event_on,
    CASE WHEN d IS NOT NULL THEN by_ WHEN published_on IS NOT NULL THEN 'published' END AS dated_by,
    min(ord) OVER (PARTITION BY item_id, sent, kind, name, level) AS ord,
    row_number() OVER (PARTITION BY item_id, sent, kind, name, level ORDER BY pos, ord) AS rn
  FROM ev_fired) x WHERE rn = 1""",
    }


ISO_SQL = "TRY_CAST(NULLIF(regexp_extract(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE)"
PER_SQL = "regexp_extract(text, '(Q[1-4]|FY) ?(20[0-9]{2})', 1)"
YEAR_SQL = "TRY_CAST(NULLIF(regexp_extract(text, '(Q[1-4]|FY) ?(20[0-9]{2})', 2), '') AS INTEGER)"
MONTH_SQL = f"CASE WHEN {PER_SQL} = 'Q1' THEN 3 WHEN {PER_SQL} = 'Q2' THEN 6 WHEN {PER_SQL} = 'Q3' THEN 9 WHEN {PER_SQL} IN ('Q4', 'FY') THEN 12 END"
PERIOD_END_SQL = f"last_day(make_date({YEAR_SQL}, {MONTH_SQL}, 1))"

FEATURES = f"""
SELECT item_id, vendor, outlet, tier, published_on, text,
  {norm_text_sql('text')} AS norm,
  md5(trim({words_sql('text')})) AS text_key,
  COALESCE({ISO_SQL}, {PERIOD_END_SQL}, published_on) AS event_on,
  CASE WHEN {ISO_SQL} IS NOT NULL THEN 'iso' WHEN {PERIOD_END_SQL} IS NOT NULL THEN 'period'
       WHEN published_on IS NOT NULL THEN 'published' END AS dated_by,
  regexp_matches({norm_text_sql('text')}, {_q(" (" + "|".join(rules.CONCLUDING_WORDS) + ") ")}) AS concluded,
  regexp_matches({norm_text_sql('text')}, {_q(" (" + "|".join(rules.CONTINUING_PHRASES) + ") ")}) AS continuing
FROM v_news"""


def recency_sql() -> str:
    return (f"(published_on > {WINDOW_START_SQL} AND published_on <= {AS_OF_SQL} AND NOT COALESCE("
            f"event_on < {WINDOW_START_SQL} AND concluded AND NOT continuing, false))")


def mention_sql(text: str, name: str) -> str:
    return (f"(trim({words_sql(name)}) <> '' AND contains(concat(' ', trim({words_sql(text)}), ' '), concat(' ', trim({words_sql(name)}), ' ')))")


CONFIRMED = f"""
SELECT item_id, vendor, name_hit OR alias_hit AS confirmed,
  CASE WHEN name_hit THEN 'name' WHEN alias_hit THEN 'alias' END AS matched_by
FROM (
  SELECT n.item_id, n.vendor, bool_or(COALESCE({mention_sql('n.text', 'n.vendor')}, false)) AS name_hit,
    bool_or(COALESCE({mention_sql('n.text', 'a.alias')}, false)) AS alias_hit
  FROM v_news n LEFT JOIN v_aliases a ON a.vendor = n.vendor
  GROUP BY n.item_id, n.vendor) g"""

WORKLIST = f"""
SELECT vendor, query_norm, query_kind, query_text FROM (
  SELECT *, row_number() OVER (PARTITION BY vendor, query_norm ORDER BY ord) AS rn FROM (
    SELECT vendor, ord, query_kind, query_text,
      trim({words_sql('query_text')}) AS query_norm
    FROM (
      SELECT v.vendor, 0 AS ord, 'name' AS query_kind, v.vendor AS query_text FROM vv v
      UNION ALL SELECT v.vendor, 1, 'alias', v.alias FROM vv v
      UNION ALL SELECT v.vendor, 2, 'announcement', v.vendor || ' {rules.QUERY_SUFFIX_ANNOUNCEMENT}' FROM vv v
      UNION ALL SELECT v.vendor, 3, 'filing', v.vendor || ' {rules.QUERY_SUFFIX_FILING}' FROM vv v
      UNION ALL SELECT v.vendor, 4, 'year', v.vendor || ' {rules.AS_OF.year}' FROM vv v) f
    WHERE query_text IS NOT NULL) n
  WHERE query_norm <> '') r
WHERE rn = 1"""

VV = """
SELECT b.vendor, a.alias FROM (SELECT DISTINCT vendor FROM book_text WHERE vendor IS NOT NULL) b
LEFT JOIN v_aliases a ON a.vendor = b.vendor"""

HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)', 1))"

def amount_sql(fig: str) -> str:
    t = f"regexp_replace(regexp_extract({fig}, {_q('(' + R9.NUMBER + ')')}, 1), '[ \u00a0'']', '', 'g')"
    word = f"lower(regexp_extract({fig}, {_q(R9.SCALE_PATTERN)}, 1))"
    fits = lambda pattern: f"regexp_matches({t}, {_q(pattern)})"
    value = (f"CASE WHEN {fits(R9.COMMA_GROUPS)} THEN replace({t}, ',', '') "
             f"WHEN {fits(R9.POINT_GROUPS)} AND NOT ({word} <> '' AND {fits(R9.ONE_POINT_GROUP)}) THEN replace(replace({t}, '.', ''), ',', '.') "
             f"WHEN {fits(R9.PLAIN)} THEN replace({t}, ',', '.') END")
    factor = f"CASE {word} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in R9.SCALES.items()) + " ELSE 1.0 END"
    return f"TRY_CAST(TRY_CAST({value} AS DOUBLE) * CAST({factor} AS DOUBLE) AS DECIMAL(20,2))"


FIGURES = "\nUNION ALL\n".join(f"""
SELECT item_id, '{kind}' AS kind, CAST(ord AS BIGINT) AS ordinal, trim(fig) AS figure_text, {amount_sql('fig')} AS amount
FROM (SELECT item_id, unnest(m) AS fig, unnest(range(1, len(m) + 1)) AS ord
      FROM (SELECT item_id, regexp_extract_all(text, {_q(pattern)}, 1) AS m FROM v_news) x) y"""
                              for kind, pattern in (("money", R9.MONEY_PATTERN), ("headcount", R9.HEADCOUNT_PATTERN)))


QUOTES = """
SELECT vendor, outlet, item_id, unnest(q) AS quote, unnest(range(1, len(q) + 1)) AS pos
FROM (SELECT vendor, outlet, item_id, regexp_extract_all(text, '["“”„]([^"“”„]*)["“”„]', 1) AS q FROM v_news) x"""


def violations_sql() -> str:
    tone = "\nUNION ALL\n".join(
        f"SELECT vendor, outlet, item_id, 'banned_tone' AS rule, {_q(w)} AS detail FROM v_news "
        f"WHERE regexp_matches({norm_text_sql('text')}, {_q(' ' + w + 's? ')})"
        for w in rules.BANNED_TONE_WORDS)
    return f"""
{tone}
UNION ALL
SELECT vendor, outlet, item_id, 'long_quote', 'quote ' || CAST(pos AS VARCHAR) || ': '
  || CAST(len(string_split_regex(trim(quote), '[ \\t\\n\\r]+')) AS VARCHAR) || ' words'
FROM quotes WHERE len(string_split_regex(trim(quote), '[ \\t\\n\\r]+')) >= {rules.QUOTE_MAX_WORDS}
UNION ALL
SELECT vendor, outlet, CAST(NULL AS BIGINT), 'quotes_per_source', CAST(count(*) AS VARCHAR) || ' quotes'
FROM quotes GROUP BY vendor, outlet HAVING count(*) > {rules.QUOTES_PER_SOURCE}"""


def news_statements() -> dict[str, str]:
    f = {"features": FEATURES}
    ev = event_ctes()
    listed = {
        **ev,
        "named": "SELECT item_id, kind, name, min(ord) AS o FROM events_x GROUP BY item_id, kind, name",
        "per_item": """
SELECT item_id, bool_or(kind IN ('in', 'rubric')) AS in_scope, bool_or(kind <> 'mark') AS has_event,
  string_agg(name, ', ' ORDER BY o) FILTER (kind = 'in') AS categories,
  string_agg(name, ', ' ORDER BY o) FILTER (kind IN ('out', 'transit')) AS excluded_kinds
FROM named GROUP BY item_id""",
    }
    return {
        "search_worklist": with_views("SELECT * FROM worklist", {"book_text": BOOK_TEXT, "vv": VV, "worklist": WORKLIST}),
        "entity_match": with_views("SELECT * FROM confirmed", {"confirmed": CONFIRMED}),
        "event_dated_items": with_views("SELECT item_id, published_on, event_on, dated_by FROM features", f),
        "recent_items": with_views(
            f"SELECT item_id, vendor, outlet, tier, published_on, event_on FROM features WHERE {recency_sql()}", f),
        "news_events": with_views("SELECT * FROM events_x", ev),
        "scoped_items": with_views(
            "SELECT n.item_id, n.vendor, COALESCE(p.in_scope, false) AS in_scope, COALESCE(p.has_event, false) AS has_event, "
            "COALESCE(p.categories, '') AS categories, COALESCE(p.excluded_kinds, '') AS excluded_kinds "
            "FROM v_news n LEFT JOIN per_item p ON p.item_id = n.item_id", listed),
        "source_tier": (
            f"SELECT page_id, url, {HOST_SQL} AS host, CASE WHEN regexp_matches({HOST_SQL}, {_q(rules.PRIMARY_HOST_PATTERN)}) "
            f"OR regexp_matches(url, {_q(rules.PRIMARY_PATH_PATTERN)}) THEN 1 "
            f"WHEN regexp_matches({HOST_SQL}, {_q(rules.TRADE_HOST_PATTERN)}) AND NOT regexp_matches({HOST_SQL}, {_q(rules.BLOG_HOST_PATTERN)}) THEN 2 "
            f"ELSE {rules.UNKNOWN_TIER} END AS tier FROM pages"),
        "syndication_exact": with_views(
            "SELECT text_key, item_id, vendor, outlet, tier, published_on, cluster_size FROM ("
            "SELECT *, count(*) OVER (PARTITION BY text_key) AS cluster_size, row_number() OVER (PARTITION BY text_key "
            "ORDER BY tier, published_on ASC NULLS LAST, item_id) AS rn FROM features) x WHERE rn = 1", f),
        "scale_figures": with_views(FIGURES),
        "note_violations": with_views(violations_sql(), {"quotes": QUOTES}),
        "items_per_vendor": with_views(
            "SELECT b.book_row_id, b.vendor, COALESCE(c.n_items, 0) AS n_items, COALESCE(c.n_confirmed, 0) AS n_confirmed, "
            "COALESCE(c.n_selected, 0) AS n_selected FROM book_text b LEFT JOIN counts c ON c.vendor = b.vendor",
            {"book_text": BOOK_TEXT, **f, "confirmed": CONFIRMED, "counts": f"""
SELECT f.vendor, count(*) AS n_items, CAST(count_if(c.confirmed) AS BIGINT) AS n_confirmed,
  CAST(count_if(c.confirmed AND {recency_sql()}) AS BIGINT) AS n_selected
FROM features f LEFT JOIN confirmed c ON c.item_id = f.item_id GROUP BY f.vendor"""}),
        "indicator_match": with_views(
            "SELECT DISTINCT n.item_id, n.vendor, e.name AS condition, e.level, n.outlet, n.tier, n.published_on "
            "FROM v_news n JOIN events_x e ON e.item_id = n.item_id WHERE e.kind = 'rubric'", ev),
    }


# --- composite plans ------------------------------------------------------------------


def _lines_from(src: str, carry: str = "") -> str:
    extra = f", {carry}" if carry else ""
    return f"""
SELECT id, vendor, book_row_id, status, line{extra},
  row_number() OVER (ORDER BY status_rank, changed_at DESC, id DESC, book_row_id ASC NULLS FIRST) AS alert_pos
FROM (
  SELECT id, changed_at, vendor, book_row_id, {status_sql()} AS status,
    CASE WHEN {status_sql()} = 'NEW RISK' THEN 0 ELSE 1 END AS status_rank,
    concat({status_sql()}, ' - ', vendor, ': Level ', {LEVEL_TEXT}, '. ', {first_sentence_sql(REASON_TEXT)}) AS line{extra}
  FROM {src}) x"""


def monitor_ctes() -> dict[str, str]:
    return {
        "book_text": BOOK_TEXT,
        "queue": QUEUE,
        "news_q": "SELECT * FROM v_news WHERE vendor IN (SELECT vendor FROM queue)",
        "features": FEATURES.replace("FROM v_news", "FROM news_q"),
        "confirmed": CONFIRMED.replace(
            "FROM v_news n LEFT JOIN v_aliases a",
            "FROM news_q n LEFT JOIN (SELECT * FROM v_aliases WHERE vendor IN (SELECT vendor FROM queue)) a"),
        "selected": f"""
SELECT f.* FROM features f JOIN confirmed c ON c.item_id = f.item_id WHERE c.confirmed AND {recency_sql()}""",
        "texts": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vendor, text_key
  ORDER BY tier, published_on ASC NULLS LAST, item_id) AS rn FROM selected) x WHERE rn = 1""",
        "g": NEAR_SETS.replace("FROM reps", "FROM texts"),
        "hits": NEAR_HITS + " AND a.vendor = b.vendor",
        "reps": "SELECT * FROM texts WHERE item_id NOT IN (SELECT i FROM hits)",
        **event_ctes("reps"),
        "marks": """
SELECT item_id, bool_or(kind = 'mark' AND name = 'new_models_only') AS new_models_only, bool_or(kind = 'mark' AND name = 'resolution') AS is_resolution,
  bool_or(kind = 'rubric') AS has_rubric
FROM events_x GROUP BY item_id""",
        "stated": "SELECT DISTINCT item_id, sent FROM events_x WHERE kind IN ('in', 'rubric')",
        "ev_kept": """
SELECT item_id, name, level, kind, ord, sent, event_on FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, name, event_on ORDER BY ord, sent) AS rn FROM events_x WHERE kind = 'rubric') a WHERE rn = 1
UNION ALL
SELECT item_id, name, 1, kind, ord, sent, event_on FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ord, sent) AS rn FROM events_x WHERE kind = 'in'
    AND item_id NOT IN (SELECT item_id FROM marks WHERE has_rubric)) b WHERE rn = 1
UNION ALL
SELECT item_id, name, level, kind, ord, sent, event_on FROM (
  SELECT e.*, row_number() OVER (PARTITION BY e.item_id, e.name ORDER BY e.ord, e.sent) AS rn
  FROM events_x e LEFT JOIN stated s ON s.item_id = e.item_id AND s.sent = e.sent
  WHERE e.kind = 'transit' OR (e.kind = 'out' AND s.item_id IS NULL)) c WHERE rn = 1""",
        "ev_raw": """
SELECT e.item_id * 1000000 + e.ord * 1000 + least(e.sent, 999) AS evidence_id, e.name AS condition, e.level, e.kind IN ('in', 'rubric') AS in_scope,
  r.vendor, r.outlet, r.tier, m.new_models_only, m.is_resolution, e.event_on
FROM ev_kept e JOIN reps r ON r.item_id = e.item_id JOIN marks m ON m.item_id = e.item_id""",
        "news_evidence": f"""
SELECT evidence_id, vendor, condition, level, outlet, tier, in_scope, new_models_only,
  condition IN ({sql_list(rules.BREACH_CONDITIONS)}) AS is_breach,
  condition IN ({sql_list(rules.GOING_CONCERN_CONDITIONS)}) AS is_going_concern,
  is_resolution, CAST(event_on AS TIMESTAMP) AS published_at
FROM ev_raw""",
        "adjusted": ADJUSTED.replace("v_evidence", "news_evidence"),
        "corroborated": CORROBORATED, "rollup": ROLLUP, "excluded": EXCLUDED, "trace": TRACE.replace("v_evidence", "news_evidence"),
        "scored": SCORED.replace("FROM book_text b", "FROM (SELECT book_row_id, vendor FROM queue) b"),
        "reason": REASON,
        "counts": "SELECT vendor, count(*) AS n_items FROM reps GROUP BY vendor",
    }


MONITOR = """
SELECT q.queue_pos, q.book_row_id, q.vendor, COALESCE(c.n_items, 0) AS n_items,
  r.risk_level, r.is_risk, r.risk_reason, b.is_risk AS old_flag,
  CASE WHEN r.is_risk THEN '1' WHEN NOT r.is_risk THEN '0' END AS new_flag,
  CASE WHEN b.is_risk IS DISTINCT FROM (CASE WHEN r.is_risk THEN '1' WHEN NOT r.is_risk THEN '0' END)
        AND (COALESCE(b.is_risk, '') = '1' OR r.is_risk)
       THEN CASE WHEN r.is_risk THEN 'NEW RISK' ELSE 'CLEARED' END END AS status
FROM queue q
LEFT JOIN reason r ON r.book_row_id = q.book_row_id
LEFT JOIN book_text b ON b.book_row_id = q.book_row_id
LEFT JOIN counts c ON c.vendor = q.vendor"""

def run_ctes() -> dict[str, str]:
    """The rest of a run on top of ``monitor_ctes``: decisions, results, book, audit, alert."""
    return {
        **monitor_ctes(),
        "decided": MONITOR,
        "decisions_r": f"""
SELECT queue_pos AS decision_id, vendor, TIMESTAMP '{RUN_START_SQL}' AS decided_at, risk_level, is_risk, risk_reason FROM decided""",
        "intake": "SELECT decision_id, vendor, decided_at, risk_level, risk_reason FROM decisions_r",
        "validated": VALIDATED, "results": RESULTS,
        "touched": f"""
SELECT b.book_row_id, b.vendor, b.category, b.hq_country,
  CASE WHEN q.vendor IS NOT NULL THEN '{RUN_START_SQL}' ELSE b.last_checked END AS last_checked,
  b.is_risk, b.risk_level, b.risk_reason, b.last_risk_eval
FROM book_text b LEFT JOIN (SELECT DISTINCT vendor FROM queue) q ON b.vendor = q.vendor""",
        "latest_decision": LATEST_DECISION.replace("FROM v_decisions", "FROM decisions_r"),
        "book_upsert": BOOK_UPSERT.replace("FROM book_text b", "FROM touched b"),
        "diff": diff_sql("book_text", "book_upsert", RUN_START_SQL),
        "change_log": """
SELECT row_number() OVER (ORDER BY changed_at, vendor, field_ordinal, book_row_id) AS id, changed_at, vendor, field, old_value, new_value
FROM diff""",
        "changes_since": risk_changes_since_sql(RUN_START_SQL), "latest_change": LATEST_CHANGE,
        "typed_after": typed_sql("book_upsert"), "enriched": ENRICHED, "lines": LINES, "header": HEADER, "pages": PAGES,
    }


MANUAL_NAMES = "SELECT * FROM (VALUES ('Supplier#000000002', 4), ('Supplier#000000005', 4), ('Supplier#000000009', 5)) AS t(vendor, manual_level)"


def plan_statements() -> dict[str, str]:
    a = alert_ctes()
    notes = {"notes_dedup": NOTES_DEDUP, "newest_notes": NEWEST_NOTES}
    an = {**a, **notes, "enriched_notes": ENRICHED_NOTES,
          "sections": f"SELECT *, {SECTION} AS section FROM enriched_notes",
          "lines_s": _lines_from("sections", "section"), "header": HEADER.replace("FROM lines", "FROM lines_s")}
    manual = {
        "book_text": BOOK_TEXT, "names": MANUAL_NAMES,
        "subset": "SELECT * FROM book_text WHERE vendor IN (SELECT vendor FROM names)",
        "decisions_m": f"""
SELECT -s.book_row_id AS decision_id, s.vendor, TIMESTAMP '2024-01-29 11:59:00' AS decided_at,
  n.manual_level AS risk_level, n.manual_level >= 3 AS is_risk, 'cleared manual test' AS risk_reason
FROM subset s JOIN names n ON n.vendor = s.vendor
UNION ALL
SELECT decision_id, vendor, decided_at, risk_level, is_risk, risk_reason FROM v_decisions
WHERE vendor IN (SELECT vendor FROM names)""",
        "change_log": FLAG_HISTORY.replace("FROM v_decisions", "FROM decisions_m"),
        "changes_since": risk_changes_since_sql(RUN_START_SQL),
        "latest_change": LATEST_CHANGE,
        "latest_decision": LATEST_DECISION.replace("FROM v_decisions", "FROM decisions_m"),
        "book_upsert": BOOK_UPSERT.replace("FROM book_text b", "FROM subset b"),
        "typed_after": typed_sql("book_upsert"), "enriched": ENRICHED, "lines": LINES, "header": HEADER,
    }
    return {
        "monitor_run": with_views(MONITOR, monitor_ctes()),
        "monitor_notes": with_views(f"""
SELECT k.vendor_key, 'research_' || strftime(TIMESTAMP '{RUN_START_SQL}', '%Y-%m-%d_%H-%M-%S') || '.md' AS file_name, k.queue_pos AS write_seq,
  TIMESTAMP '{RUN_START_SQL}' AS noted_at, CAST(TIMESTAMP '{RUN_START_SQL}' AS DATE) AS note_date, COALESCE(t.text, 'No news in scope found.') AS text
FROM (SELECT *, row_number() OVER (PARTITION BY vendor_key ORDER BY queue_pos DESC) AS rn FROM (
  SELECT vendor, queue_pos, {vendor_key_sql('vendor')} AS vendor_key FROM queue) q) k
LEFT JOIN (
  SELECT vendor, string_agg('- ' || COALESCE(CAST(event_on AS VARCHAR), 'undated') || ': ' || replace(name, '_', ' ') || ', ' || CAST(n AS VARCHAR)
    || CASE WHEN n = 1 THEN ' item, ' ELSE ' items, ' END || COALESCE(outlet, 'unnamed') || ' (' || CASE tier WHEN 1 THEN 'primary source' WHEN 2 THEN 'trade press' ELSE 'general press' END || ')',
    chr(10) ORDER BY event_on DESC NULLS LAST, name) AS text
  FROM (
    SELECT r.vendor, e.event_on, e.name, count(DISTINCT e.item_id) AS n, min(r.tier) AS tier,
      arg_min(r.outlet, CAST(r.tier AS VARCHAR) || r.outlet) AS outlet
    FROM events_x e JOIN reps r ON r.item_id = e.item_id WHERE e.kind IN ('in', 'rubric') GROUP BY r.vendor, e.event_on, e.name) x
  GROUP BY vendor) t ON t.vendor = k.vendor
WHERE k.rn = 1""", monitor_ctes()),
        "monitor_results": with_views("SELECT * FROM results", run_ctes()),
        "monitor_book_after": with_views("SELECT * FROM book_upsert", run_ctes()),
        "monitor_change_log": with_views("SELECT * FROM change_log", run_ctes()),
        "monitor_alert": with_views(
            f"SELECT '{RUN_START_SQL}' AS run_id, p.page_no, p.page_count, p.n_lines, h.header AS subject, p.body, {FULL_TEXT} AS full_text "
            f"FROM pages p, header h", run_ctes()),
        "alert_since": with_views(
            f"SELECT '{RUN_START_SQL}' AS run_id, p.page_no, p.page_count, p.n_lines, h.header AS subject, p.body, "
            f"{FULL_TEXT} AS full_text, p.payload FROM pages_s p, header h", {**an, "pages_s": pages_sql(
                "lines_s", "strlen(line) + strlen(section) + 2",
                f", string_agg(section, {_q(rules.SECTION_SEPARATOR).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))} ORDER BY alert_pos) AS payload")}),
        "manual_override": with_views(
            "SELECT l.alert_pos, l.id, l.vendor, l.book_row_id, l.status, l.line, h.header FROM lines l, header h", manual),
        "flip_stream": with_views("SELECT * FROM change_log", {"change_log": FLAG_HISTORY}),
    }


# --- R8 brute force -------------------------------------------------------------------

NEAR_REPS = """
SELECT f.item_id, f.vendor, f.tier, f.published_on, f.text FROM (
  SELECT *, row_number() OVER (PARTITION BY text_key ORDER BY tier, published_on ASC NULLS LAST, item_id) AS rn
  FROM features) f WHERE rn = 1"""

NEAR_SETS = """
SELECT item_id, vendor, tier, published_on, len(sh) AS n, sh FROM (
  SELECT *, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS sh
  FROM (SELECT *, string_split(trim(""" + words_sql("text") + """), ' ') AS w FROM reps) x) y"""

NEAR_HITS = """
SELECT a.item_id AS i, b.item_id AS j, b.tier AS jt, b.published_on AS jp,
  len(list_intersect(a.sh, b.sh)) / (a.n + b.n - len(list_intersect(a.sh, b.sh))) AS sim
FROM g a JOIN g b
  ON (b.tier < a.tier
      OR (b.tier = a.tier AND (b.published_on IS NULL) < (a.published_on IS NULL))
      OR (b.tier = a.tier AND (b.published_on IS NULL) = (a.published_on IS NULL)
          AND (coalesce(b.published_on, DATE '9999-12-31') < coalesce(a.published_on, DATE '9999-12-31')
               OR (coalesce(b.published_on, DATE '9999-12-31') = coalesce(a.published_on, DATE '9999-12-31') AND b.item_id < a.item_id))))
WHERE a.n > 0 AND b.n > 0 AND b.n >= a.n * 0.8 AND a.n >= b.n * 0.8
  AND len(list_intersect(a.sh, b.sh)) / (a.n + b.n - len(list_intersect(a.sh, b.sh))) >= 0.8"""

NEAR = """
SELECT g.item_id, g.vendor, COALESCE(h.j, g.item_id) AS cite_id, h.j IS NOT NULL AS is_copy, COALESCE(h.sim, 1.0) AS similarity
FROM g LEFT JOIN (
  SELECT i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY i
    ORDER BY jt, jp IS NULL, coalesce(jp, DATE '9999-12-31'), j) AS rn FROM hits) x WHERE rn = 1) h ON h.i = g.item_id"""

CHAIN = """
SELECT item_id, cite_id FROM cited
UNION
SELECT c.item_id, n.cite_id FROM chain c JOIN cited n ON n.item_id = c.cite_id"""

CLUSTERS = """
SELECT c.cite_id AS rep_id, count(*) AS n_items, count(DISTINCT n.vendor) AS n_vendors, count(DISTINCT n.outlet) AS n_outlets
FROM chain c JOIN cited e ON e.item_id = c.cite_id AND e.cite_id = e.item_id JOIN v_news n ON n.item_id = c.item_id
GROUP BY c.cite_id"""
