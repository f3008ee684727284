"""DuckDB twins of the fixture views and column expressions, used to build the
oracle SQL of every registered query. The shared tables are registered as views by
the checker; fixtures are inlined as CTEs."""

from __future__ import annotations

import unicodedata


def _chars(chars) -> str:
    return " || ".join(f"chr({ord(c)})" for c in chars)


# From the definitions of the two sides, not from the Spark code: what Python calls space,
# and ECMAScript's WhiteSpace and LineTerminator.
_BMP = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
PY_SPACE = _chars(c for c in _BMP if c.isspace())
JS_SPACE = _chars("\t\v\f\ufeff\n\r\u2028\u2029" + "".join(c for c in _BMP if unicodedata.category(c) == "Zs"))


def trim_ws(x: str) -> str:
    return f"trim({x}, {PY_SPACE})"


def form_trim(x: str) -> str:
    return f"trim({x}, {JS_SPACE})"


def clean_field(x: str) -> str:
    return trim_ws(f"coalesce({x}, '')")


def text_of(v: str = "vendor", d: str = "description") -> str:
    return trim_ws(f"lower({clean_field(v)} || ' ' || {clean_field(d)})")


def normalized(x: str) -> str:
    return form_trim(f"regexp_replace(lower(coalesce({x}, '')), '[' || {JS_SPACE} || ']+', ' ', 'g')")


def collapse_keep_case(x: str) -> str:
    return form_trim(f"regexp_replace(coalesce({x}, ''), '[' || {JS_SPACE} || ']+', ' ', 'g')")


def row_id_of(text: str = "text", cat: str = "category") -> str:
    return f"sha256({text} || '||' || {cat})"


def title_words(x: str) -> str:
    return ("array_to_string(list_transform(string_split(" + x + ", ' '), lambda w: "
            "array_to_string(list_transform(string_split(w, '-'), lambda p: "
            "upper(substr(p, 1, 1)) || substr(p, 2)), '-')), ' ')")


def staging_date(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST({x} AS DATE) "
            f"WHEN regexp_matches({x}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') "
            f"THEN CAST(try_strptime({x}, '%m/%d/%Y') AS DATE) END")


def staging_amount(x: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_replace({x}, '[^0-9.\\-]', '', 'g'), '') AS DECIMAL(12,2))"


def form_amount(x: str) -> str:
    inner = form_trim(f"regexp_replace(coalesce({x}, ''), ',', '', 'g')")
    cut = f"regexp_replace({inner}, '^([^.]*\\.[0-9]{{2}})[0-9]+$', '\\1')"
    return (f"CASE WHEN regexp_matches({cut}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') "
            f"THEN TRY_CAST({cut} AS DOUBLE) END")


def iso_date(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST({x} AS DATE) END"


def tokens_of(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def bucket_of(term: str, bits: int = 20) -> str:
    return f"CAST((('0x' || substr(md5({term}), 1, 8))::BIGINT & {(1 << bits) - 1}) AS INTEGER)"


# --------------------------------------------------------------------------------
# Fixture CTEs (FIXTURES.md F1-F5)

F1 = """expenses AS (
  SELECT o_orderkey AS expense_id, o_custkey AS user_id,
         CAST(o_orderdate AS DATE) AS expense_date,
         CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
         s_name AS vendor, concat(p_name, ' ', p_brand) AS description, p_type AS category
  FROM orders
  JOIN (SELECT l_orderkey, min(l_suppkey) sk, min(l_partkey) pk FROM lineitem GROUP BY l_orderkey) l
    ON l_orderkey = o_orderkey
  JOIN supplier ON s_suppkey = sk
  JOIN part ON p_partkey = pk)"""

F2 = """labeled_text AS (
  SELECT doc_id AS row_key, source AS vendor, text AS description, lang AS category FROM documents)"""

F3 = """staging AS (
  SELECT expense_id, vendor, description, category,
         CASE WHEN expense_id % 4 = 1 THEN strftime(expense_date, '%-m/%-d/%Y')
              WHEN expense_id % 4 = 2 THEN 'n/a'
              ELSE CAST(expense_date AS VARCHAR) END AS date_txt,
         CASE WHEN expense_id % 3 = 0 THEN '$' || CAST(amount AS VARCHAR)
              WHEN expense_id % 3 = 1 THEN CAST(amount AS VARCHAR)
              ELSE CAST(amount AS VARCHAR) || ' CAD' END AS amount_txt
  FROM expenses)"""

F4_BASE = """labels_base AS (
  SELECT expense_id AS id, user_id, expense_id, vendor, description,
         CASE WHEN ('0x' || substr(md5(CAST(expense_id AS VARCHAR)), 1, 2))::INT < 51
              THEN 'REVIEW' ELSE category END AS chosen_cat,
         category AS predicted,
         CASE WHEN ('0x' || substr(md5(CAST(expense_id AS VARCHAR)), 1, 2))::INT < 51
              THEN 'correction' ELSE 'confirm' END AS source,
         CAST(expense_date AS TIMESTAMP) AS created_at, amount, expense_date
  FROM expenses)"""

F4 = """user_labels AS (
  SELECT id, user_id, expense_id, vendor, description, chosen_cat, predicted, source, created_at
  FROM labels_base)"""

F4X = """user_labels_x AS (
  SELECT id, user_id, CASE WHEN id % 10 = 5 THEN NULL ELSE expense_id END AS expense_id,
         vendor, description, chosen_cat, predicted, source, created_at FROM user_labels
  UNION ALL
  SELECT id + 100000000, user_id, expense_id, vendor, description, predicted, predicted,
         'correction', created_at + INTERVAL 1 DAY FROM user_labels WHERE id % 10 = 0
  UNION ALL
  SELECT id + 200000000, user_id, expense_id + 1000000000, vendor, description, chosen_cat,
         predicted, source, created_at FROM user_labels WHERE id % 10 = 0)"""

F5 = """feedback AS (
  SELECT CAST(expense_date AS VARCHAR) AS date, CAST(amount AS VARCHAR) AS amount,
         lower(vendor) AS vendor, lower(description) AS description,
         lower(predicted) AS category, 'feedback_api' AS source,
         strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at_utc, id AS fb_id
  FROM labels_base WHERE source = 'correction')"""

F4Y = """user_labels_bad AS (
  SELECT id, CASE WHEN id % 50 = 1 THEN NULL ELSE user_id END AS user_id, expense_id,
         CASE WHEN id % 50 = 2 THEN NULL ELSE vendor END AS vendor,
         CASE WHEN id % 50 = 3 THEN NULL ELSE description END AS description,
         CASE WHEN id % 50 = 4 THEN NULL ELSE chosen_cat END AS chosen_cat,
         CASE WHEN id % 50 IN (6, 9) THEN NULL ELSE predicted END AS predicted,
         CASE WHEN id % 50 = 5 THEN NULL WHEN id % 50 = 7 THEN 'guess' ELSE source END AS source,
         CASE WHEN id % 50 = 8 THEN NULL ELSE created_at END AS created_at
  FROM user_labels_x)"""

F6 = """messy AS (
  SELECT expense_id,
         CASE expense_id % 8 WHEN 0 THEN chr(160) || vendor || chr(8195) WHEN 1 THEN chr(28) || vendor || chr(133)
              WHEN 2 THEN chr(65279) || vendor || chr(9) WHEN 6 THEN '' ELSE vendor END AS vendor,
         CASE expense_id % 8 WHEN 3 THEN replace(description, ' ', chr(160) || chr(8201))
              WHEN 5 THEN repeat(description || ' ', 12) WHEN 7 THEN NULL ELSE description END AS description,
         CASE expense_id % 8 WHEN 4 THEN chr(12288) || lower(category) || chr(8232) ELSE category END AS category,
         CASE expense_id % 8 WHEN 0 THEN '2025' WHEN 1 THEN '2025-08' WHEN 2 THEN CAST(expense_date AS VARCHAR) || 'Tjunk'
              ELSE CAST(expense_date AS VARCHAR) END AS date_txt,
         CASE expense_id % 8 WHEN 0 THEN CAST(amount AS VARCHAR) || 'd' WHEN 1 THEN CAST(amount AS VARCHAR) || 'f'
              WHEN 2 THEN '1e2' WHEN 3 THEN '0x10' WHEN 4 THEN chr(160) || '1,234.567 '
              WHEN 5 THEN 'Infinity' ELSE CAST(amount AS VARCHAR) END AS amount_txt
  FROM expenses)"""

_DEPS = {
    "expenses": [],
    "labeled_text": [],
    "staging": ["expenses"],
    "labels_base": ["expenses"],
    "user_labels": ["labels_base"],
    "user_labels_x": ["user_labels"],
    "user_labels_bad": ["user_labels_x"],
    "feedback": ["labels_base"],
    "messy": ["expenses"],
}
_CTE = {"expenses": F1, "labeled_text": F2, "staging": F3, "labels_base": F4_BASE,
        "user_labels": F4, "user_labels_x": F4X, "user_labels_bad": F4Y, "feedback": F5, "messy": F6}


def with_fixtures(names: list[str], *extra: str) -> str:
    """``WITH`` clause holding the named fixtures (and their dependencies) followed
    by extra CTE bodies given as ``name AS (...)`` strings."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [_CTE[n] for n in order] + list(extra)
    return "WITH " + ",\n".join(parts) + "\n"
