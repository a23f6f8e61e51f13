"""DuckDB SQL for the registered queries, written from the rules alone.

The pieces are plain SQL fragments; each oracle is one statement over the given
tables.
"""

from __future__ import annotations

from dqspark import fixed
from dqspark.workload import contacts as fixture

CONTACTS = f"({fixture.SQL})"
COLS = fixture.COLUMNS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def filled(x: str) -> str:
    return f"CASE WHEN lower({strip(x)}) NOT IN ('', 'nan', 'none') THEN {strip(x)} END"


def placeholder(x: str) -> str:
    words = ", ".join(text(w) for w in fixed.PLACEHOLDERS)
    return f"coalesce({strip(x)} IN ({words}), false)"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {text(pattern)})"


def label(x: str) -> str:
    whens = " ".join(f"WHEN {matches(x, p)} THEN {text(n)}" for n, p in fixed.DATE_FORMATS)
    return f"CASE {whens} END"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def number(x: str) -> str:
    return f"CASE WHEN {matches(x, fixed.NUMBER)} THEN try_cast(trim({x}) AS DOUBLE) END"


def currency(x: str) -> str:
    return number(f"regexp_replace({x}, {text(fixed.CURRENCY_REMOVED)}, '', 'g')")


def parse_dayfirst(x: str) -> str:
    forms = {
        "YYYY-MM-DD": "%Y-%m-%d", "DD/MM/YYYY or MM/DD/YYYY": "%d/%m/%Y",
        "DD-MM-YYYY or MM-DD-YYYY": "%d-%m-%Y", "YYYY/MM/DD": "%Y/%m/%d", "DD.MM.YYYY": "%d.%m.%Y",
    }
    whens = " ".join(
        f"WHEN {text(n)} THEN try_strptime({strip(x)}, {text(f)})" for n, f in forms.items())
    return f"CASE {label(strip(x))} {whens} END"


def pick(cols=COLS, **new: str) -> str:
    """Select list: a column as it is, or a new expression under its name."""
    return ", ".join(f"{new[c]} AS {c}" if c in new else c for c in cols)


def long_of(source: str, cols: dict[str, str], key: str) -> str:
    """CTE text: one row (id, col, col_no, v) per cell."""
    return " UNION ALL ".join(
        f"SELECT {key} AS id, {text(c)} AS col, {i} AS col_no, {expr} AS v FROM {source}"
        for i, (c, expr) in enumerate(cols.items())
    )


CONTACT_LONG = long_of(CONTACTS, {c: c for c in COLS}, "_row_id")
TRIMMED = f"(SELECT _row_id, {pick(**{c: strip(c) for c in COLS})} FROM {CONTACTS} t)"


def first_copies(source: str, cols=COLS, key: str = "_row_id") -> str:
    """The first row of each group of equal rows."""
    part = ", ".join(cols)
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {key}) AS copy_no"
        f" FROM {source} s) WHERE copy_no = 1)"
    )


def report_ctes(long: str, name: str = "") -> str:
    """CTEs ending in ``report``: one row per column with role and counts."""
    n = name
    date, phone = label("v"), matches("v", fixed.PHONE)
    return f"""
{n}cells AS ({long}),
{n}nb AS (SELECT col, id, v, row_number() OVER (PARTITION BY col ORDER BY id) AS rn
  FROM (SELECT col, id, {filled('v')} AS v FROM {n}cells) WHERE v IS NOT NULL),
{n}share AS (SELECT col,
    avg(CASE WHEN {matches('v', fixed.EMAIL)} THEN 1.0 ELSE 0.0 END) AS e,
    avg(CASE WHEN {date} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS d,
    avg(CASE WHEN {phone} AND {date} IS NULL THEN 1.0 ELSE 0.0 END) AS p
  FROM {n}nb GROUP BY col),
{n}whole AS (SELECT col, count(*) AS n, count(DISTINCT v) AS u,
    avg(CASE WHEN {number('v')} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS num
  FROM {n}nb GROUP BY col),
{n}forms AS (SELECT col, {date} AS form, count(*) AS k, min(rn) AS f
  FROM {n}nb WHERE {date} IS NOT NULL GROUP BY ALL),
{n}formats AS (SELECT col, string_agg(form, ', ' ORDER BY k DESC, f) AS list, count(*) AS k
  FROM {n}forms GROUP BY col),
{n}counts AS (SELECT col, col_no, count(*) AS n, count(*) - count(v) AS missing,
    count(*) FILTER (WHERE {placeholder('v')}) AS placeholders,
    count(*) FILTER (WHERE {strip('v')} <> v) AS padded
  FROM {n}cells GROUP BY col, col_no),
{n}own AS (SELECT c.*, CASE
    WHEN s.e >= 0.6 THEN 'email' WHEN s.d >= 0.6 THEN 'date' WHEN s.p >= 0.6 THEN 'phone'
    WHEN regexp_matches(lower(c.col), {text(fixed.ID_NAME)}) THEN 'id'
    WHEN w.u = w.n AND w.num > 0.9 AND w.n >= 10 THEN 'id' END AS own_role
  FROM {n}counts c LEFT JOIN {n}share s USING (col) LEFT JOIN {n}whole w USING (col)),
{n}roles AS (SELECT o.*,
    CASE WHEN coalesce(o.own_role, 'date') = 'date' THEN f.list END AS formats,
    CASE WHEN coalesce(o.own_role, 'date') = 'date' THEN coalesce(f.k, 0) ELSE 0 END AS n_formats,
    CASE WHEN o.own_role IS NULL AND f.k >= 2 THEN 'date' ELSE o.own_role END AS role
  FROM {n}own o LEFT JOIN {n}formats f USING (col)),
{n}bad AS (SELECT col, count(*) FILTER (WHERE NOT {matches('v', fixed.EMAIL)}) AS emails,
    count(*) FILTER (WHERE length({digits('v')}) NOT BETWEEN 7 AND 15) AS phones
  FROM {n}nb GROUP BY col),
{n}report AS (SELECT r.*, round(100.0 * missing / n, 2) AS pct,
    CASE WHEN role = 'email' THEN coalesce(b.emails, 0) ELSE 0 END AS bad_emails,
    CASE WHEN role = 'phone' THEN coalesce(b.phones, 0) ELSE 0 END AS bad_phones
  FROM {n}roles r LEFT JOIN {n}bad b USING (col))"""


def duplicates_of(source: str, cols) -> str:
    return f"(SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM {source} d GROUP BY {', '.join(cols)}))"


def summary_select(dups: str, name: str = "") -> str:
    """Pillars and score from ``report``."""
    n = name
    return f"""
SELECT n_rows, n_cols, dups AS exact_duplicate_rows, round(miss, 2) AS overall_missing_pct,
  round(100 - miss, 1) AS completeness, round(u, 1) AS uniqueness, round(k, 1) AS consistency,
  CAST(greatest(0, least(100, round_even(0.4 * (100 - miss) + 0.3 * u + 0.3 * k, 0))) AS INTEGER) AS score
FROM (SELECT *, 100.0 * (1.0 - dups / n_rows) AS u,
    CASE WHEN checked = 0 THEN 100.0 ELSE greatest(0.0, 100.0 - penalty / checked) END AS k
  FROM (SELECT CAST(max(n) AS BIGINT) AS n_rows, CAST(count(*) AS INTEGER) AS n_cols,
      CAST({dups} AS BIGINT) AS dups, 100.0 * sum(missing) / sum(n) AS miss,
      sum(CASE WHEN n_formats > 0 THEN 1 ELSE 0 END + CASE WHEN role IN ('email', 'phone') THEN 1 ELSE 0 END) AS checked,
      sum(CASE WHEN n_formats > 1 THEN least(40.0, 15.0 * (n_formats - 1)) ELSE 0.0 END
        + CASE WHEN role = 'email' THEN least(40.0, 100.0 * bad_emails / n)
               WHEN role = 'phone' THEN least(40.0, 100.0 * bad_phones / n) ELSE 0.0 END) AS penalty
    FROM {n}report))"""


REPORT_LIST = """
SELECT col AS name, CAST(missing AS BIGINT) AS missing_count, pct AS missing_pct,
  CAST(placeholders AS BIGINT) AS empty_string_count, role AS inferred_role,
  coalesce(formats, '') AS date_formats, CAST(bad_emails AS BIGINT) AS invalid_email_count,
  CAST(bad_phones AS BIGINT) AS invalid_phone_count
FROM report"""

ORDER_COLS = {
    "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_custkey": "CAST(o_custkey AS VARCHAR)",
    "o_orderstatus": "o_orderstatus", "o_totalprice": "CAST(o_totalprice AS VARCHAR)",
    "o_orderdate": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", "o_orderpriority": "o_orderpriority",
}
EVENT_COLS = {
    "event_id": "CAST(event_id AS VARCHAR)", "ts": "CAST(ts AS VARCHAR)",
    "user_id": "CAST(user_id AS VARCHAR)", "event_type": "event_type",
    "value": "CAST(value AS VARCHAR)", "props": "props",
}
ORDER_LONG = long_of("orders", ORDER_COLS, "o_orderkey")
EVENT_LONG = long_of("events", EVENT_COLS, "event_id")
CONTACT_REPORT = "WITH" + report_ctes(CONTACT_LONG)


def plural(count: str) -> str:
    return f"CASE WHEN {count} = 1 THEN '' ELSE 's' END"


def share(count: str, high: float, medium: float) -> str:
    return (f"CASE WHEN 1.0 * {count} / n >= {high} THEN 'high' "
            f"WHEN 1.0 * {count} / n >= {medium} THEN 'medium' ELSE 'low' END")


MONEY = f"""
money AS (SELECT col, count(*) FILTER (WHERE {matches('v', fixed.CURRENCY_SYMBOL)}) AS hits
  FROM cells WHERE v IS NOT NULL GROUP BY col
  HAVING avg(CASE WHEN {matches('v', fixed.CURRENCY_FINDING)} THEN 1.0 ELSE 0.0 END) >= 0.3)"""

FINDINGS = f""",{MONEY},
found AS (
SELECT 'exact-duplicates' AS id, {share('dups', 0.05, 0.01)} AS severity, 'uniqueness' AS pillar,
  format('{{:,}} duplicate row{{}}', dups, {plural('dups')}) AS title, NULL AS "column", dups AS "count",
  'drop_exact_duplicates' AS fix_key
FROM (SELECT CAST({duplicates_of(CONTACTS, COLS)} AS BIGINT) AS dups, max(n) AS n FROM counts) WHERE dups > 0
UNION ALL SELECT 'empty-column:' || col, 'high', 'completeness', format('Column “{{}}” is completely empty', col),
  col, missing, 'drop_empty_columns' FROM report WHERE missing = n
UNION ALL SELECT 'missing:' || col, {share('missing', 0.4, 0.1)}, 'completeness',
  format('{{:.1f}}% empty in “{{}}”', pct, col), col, missing, NULL FROM report WHERE missing > 0 AND missing < n
UNION ALL SELECT 'placeholders:' || col, 'low', 'completeness',
  format('{{:,}} placeholder{{}} in “{{}}”', placeholders, {plural('placeholders')}, col), col, placeholders,
  'trim_whitespace' FROM report WHERE placeholders > 0
UNION ALL SELECT 'dates:' || col, 'medium', 'consistency', format('{{}} date formats in “{{}}”', n_formats, col),
  col, n_formats, 'fix_dates' FROM report WHERE n_formats > 1
UNION ALL SELECT 'email:' || col, {share('bad_emails', 0.1, 0.02)}, 'consistency',
  format('{{:,}} invalid email(s) in “{{}}”', bad_emails, col), col, bad_emails, 'fix_emails'
  FROM report WHERE bad_emails > 0
UNION ALL SELECT 'phone:' || col, {share('bad_phones', 0.1, 0.02)}, 'consistency',
  format('{{:,}} invalid phone(s) in “{{}}”', bad_phones, col), col, bad_phones, 'normalize_phones'
  FROM report WHERE bad_phones > 0
UNION ALL SELECT 'whitespace:' || col, 'low', 'consistency', format('Extra spaces in “{{}}”', col),
  col, padded, 'trim_whitespace' FROM report WHERE padded > 0
UNION ALL SELECT 'currency:' || col, 'low', 'consistency', format('“{{}}” looks like currency text', col),
  col, hits, 'strip_currency' FROM money)"""

STEP_ROWS = ", ".join(
    f"({i + 1}, {text(k)}, {text(name)})" for i, (k, name) in enumerate(fixed.STEPS))
PLAN = f"""
, steps(step_no, fix_key, label) AS (VALUES {STEP_ROWS}),
ranked AS (SELECT *, CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS sev,
  row_number() OVER (PARTITION BY fix_key ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END,
    "count" DESC, title) AS rn FROM found WHERE fix_key IS NOT NULL),
flagged AS (SELECT fix_key, string_agg(title, ' · ' ORDER BY rn) FILTER (WHERE rn <= 3)
    || CASE WHEN count(*) > 3 THEN ' · +' || (count(*) - 3) || ' more' ELSE '' END AS summary,
  string_agg(id, ', ' ORDER BY rn) AS finding_ids,
  coalesce((SELECT string_agg(c, ', ' ORDER BY c) FROM (SELECT DISTINCT r2."column" AS c FROM ranked r2
    WHERE r2.fix_key = ranked.fix_key)), '') AS columns,
  min(sev) AS sev FROM ranked GROUP BY fix_key)"""


def profile_rows() -> str:
    rows = []
    for pid, (_, _, keys, _) in fixed.PROFILES.items():
        for key, _ in fixed.STEPS:
            forced = "NULL" if keys is None else str(key in keys).lower()
            rows.append(f"({text(pid)}, {text(key)}, {forced})")
    return ", ".join(rows)


def with_contacts(select: str) -> str:
    return f"WITH c AS {CONTACTS} {select}"


def with_long(select: str) -> str:
    return f"WITH cells AS ({CONTACT_LONG}) {select}"


CLEAN_MONEY = f"""(SELECT _row_id, {pick(**{c: strip(c) for c in COLS if c not in ('balance', 'joined')},
    balance=currency('balance'), joined=parse_dayfirst('joined'))} FROM {CONTACTS} t)"""
TEXT_COLS = tuple(c for c in COLS if c != "fax")
TEXT_LONG = long_of(CONTACTS, {c: c for c in TEXT_COLS}, "_row_id")
NORMAL = rf"lower(regexp_replace({strip('v')}, '\s+', ' ', 'g'))"
VALUES = f"""
cells AS ({TEXT_LONG}),
vals AS (SELECT col, v, count(*) AS k, min(id) AS f, {NORMAL} AS norm
  FROM cells WHERE {strip('v')} <> '' GROUP BY col, v),
uniques AS (SELECT col, count(*) AS u FROM vals GROUP BY col),
norms AS (SELECT col, norm, substring(norm, 1, 2) AS block, min(f) AS f FROM vals GROUP BY col, norm),
blocks AS (SELECT col, block, count(*) AS norms FROM norms GROUP BY col, block)"""

NULLED = {c: f"CASE WHEN {c} IN ({', '.join(text(t) for t in fixed.NULL_TOKENS)}) THEN NULL ELSE {c} END"
          for c in COLS}
NEUTRAL = {c: f"CASE WHEN {matches(c, fixed.FORMULA_START)} THEN '''' || {c} ELSE {c} END" for c in COLS}
GAPPY = """(SELECT c_custkey AS _row_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nation, c_mktsegment AS segment FROM customer)"""
DASHED = (
    f"CASE WHEN length({digits('phone')}) = 10 THEN regexp_replace({digits('phone')}, '^(...)(...)(....)$', '\\1-\\2-\\3') "
    f"WHEN length({digits('phone')}) = 11 THEN regexp_replace({digits('phone')}, '^(.)(...)(...)(....)$', '\\1-\\2-\\3-\\4') "
    f"WHEN {digits('phone')} = '' THEN phone ELSE {digits('phone')} END"
)


def sql() -> dict[str, str]:
    o: dict[str, str] = {}

    # sources and sinks
    o["load_csv"] = with_contacts(f"SELECT {pick(**NULLED)} FROM c")
    o["null_tokens"] = with_contacts(f"SELECT _row_id, {pick(**NULLED)} FROM c")
    texts = {
        "o_orderkey": "CAST(o_orderkey AS VARCHAR)",
        "o_totalprice": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END",
        "finished": "CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'False' END",
        "priority": "o_orderpriority", "ordered": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)",
        "mixed": "CASE WHEN o_orderkey % 1000 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END",
    }
    o["infer_types"] = f"""WITH cells AS ({long_of('orders', texts, 'o_orderkey')})
SELECT col AS "column", CASE WHEN count(v) = 0 THEN 'double'
  WHEN count(v) = count(CASE WHEN regexp_matches(v, '^\\s*[+-]?\\d+\\s*$') THEN try_cast(v AS BIGINT) END) THEN 'bigint'
  WHEN count(v) = count({number('v')}) THEN 'double'
  WHEN count(v) = count(CASE WHEN v IN ('True','TRUE','true','False','FALSE','false') THEN 1 END) THEN 'boolean'
  ELSE 'string' END AS type FROM cells GROUP BY col"""
    tables = ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split()
    o["source_check"] = " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS source, CASE WHEN count(*) = 0 THEN 'no rows' ELSE 'ok' END AS status FROM {t}"
        for t in tables)
    o["stack_tables"] = """
SELECT 'customer.parquet' AS _source_file, c_custkey AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation,
  c_acctbal AS balance, c_mktsegment AS segment, false AS headers_equal FROM customer
UNION ALL SELECT 'supplier.parquet', s_suppkey, s_name, 'N' || s_nationkey, s_acctbal, NULL, false FROM supplier"""
    o["source_labels"] = """SELECT 'part' || CASE WHEN rn = 1 THEN '' ELSE ' (' || rn || ')' END || '.csv' AS label, rows
FROM (SELECT count(*) AS rows, row_number() OVER (ORDER BY c_mktsegment) AS rn FROM customer GROUP BY c_mktsegment)"""
    o["neutralize_formulas"] = with_contacts(f"SELECT _row_id, {pick(**NEUTRAL)} FROM c")
    o["export_csv"] = with_contacts(f"SELECT {pick(**NEUTRAL)} FROM c")

    # cells
    o["non_blank"] = with_long(f"SELECT id AS _row_id, col AS \"column\", {filled('v')} AS value FROM cells WHERE {filled('v')} IS NOT NULL")
    o["placeholder_cells"] = with_long(f"SELECT id AS _row_id, col AS \"column\", v AS value FROM cells WHERE {placeholder('v')}")
    o["email_valid"] = with_contacts(f"SELECT _row_id, email, {matches(filled('email'), fixed.EMAIL)} AS is_email FROM c")
    o["phone_like"] = with_long(f"""SELECT id AS _row_id, col AS "column", v AS value FROM cells
WHERE {matches(filled('v'), fixed.PHONE)} AND {label(filled('v'))} IS NULL""")
    o["date_label"] = with_long(f"SELECT id AS _row_id, col AS \"column\", {label(strip('v'))} AS date_label FROM cells WHERE {label(strip('v'))} IS NOT NULL")
    o["phone_digits"] = with_contacts(f"SELECT _row_id, {digits('phone')} AS digits FROM c")
    o["padded_cells"] = with_long(f"SELECT id AS _row_id, col AS \"column\", v AS value FROM cells WHERE {strip('v')} <> v")
    o["currency_like"] = with_long(f"""SELECT id AS _row_id, col AS "column", {matches('v', fixed.CURRENCY_FINDING)} AS finding,
  {matches('v', fixed.CURRENCY_CLEANER)} AS cleaner FROM cells WHERE v IS NOT NULL""")
    o["fuzzy_normal_form"] = with_contacts(f"SELECT v AS value, {NORMAL} AS norm FROM (SELECT DISTINCT segment AS v FROM c UNION SELECT DISTINCT source FROM documents UNION SELECT DISTINCT p_name FROM part)")
    o["numeric_coerce"] = f"""WITH cells AS ({CONTACT_LONG} UNION ALL {ORDER_LONG})
SELECT col AS "column", count({number('v')}) AS numbers, count(v) AS present, round(sum({number('v')}), 2) AS total
FROM cells GROUP BY col"""
    o["cell_display"] = """SELECT doc_id AS _row_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 79) || '…'
  ELSE coalesce(text, '') END AS shown FROM documents"""

    # profile
    o["profile_missing"] = with_long("""SELECT col AS "column", count(*) - count(v) AS missing_count,
  round(100.0 * (count(*) - count(v)) / count(*), 2) AS missing_pct FROM cells GROUP BY col""")
    o["profile_placeholders"] = with_long(f"SELECT col AS \"column\", count(*) FILTER (WHERE {placeholder('v')}) AS empty_string_count FROM cells GROUP BY col")
    o["column_sample"] = with_long(f"""SELECT col AS "column", rn, id AS _row_id, v AS value FROM (
  SELECT col, id, {filled('v')} AS v, row_number() OVER (PARTITION BY col ORDER BY id) AS rn FROM cells
  WHERE {filled('v')} IS NOT NULL) WHERE rn <= 200""")
    o["infer_roles"] = CONTACT_REPORT + " SELECT col AS \"column\", own_role AS role FROM report"
    o["infer_roles_orders"] = "WITH" + report_ctes(ORDER_LONG) + " SELECT col AS \"column\", own_role AS role FROM report"
    o["infer_roles_events"] = "WITH" + report_ctes(EVENT_LONG) + " SELECT col AS \"column\", own_role AS role FROM report"
    o["date_formats"] = CONTACT_REPORT + " SELECT col AS \"column\", form AS date_format, k AS n, row_number() OVER (PARTITION BY col ORDER BY k DESC, f) AS place FROM forms"
    o["invalid_emails"] = CONTACT_REPORT + " SELECT col AS \"column\", bad_emails AS invalid_email_count FROM report WHERE role = 'email'"
    o["invalid_phones"] = CONTACT_REPORT + " SELECT col AS \"column\", bad_phones AS invalid_phone_count FROM report WHERE role = 'phone'"
    line = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    o["duplicate_count"] = f"""SELECT 'contacts' AS source, CAST({duplicates_of(CONTACTS, COLS)} AS BIGINT) AS n
UNION ALL SELECT 'lineitem', CAST({duplicates_of('lineitem', line)} AS BIGINT)
UNION ALL SELECT 'documents.text', CAST({duplicates_of('documents', ['text'])} AS BIGINT)"""
    o["column_report"] = CONTACT_REPORT + REPORT_LIST
    o["column_report_orders"] = "WITH" + report_ctes(ORDER_LONG) + REPORT_LIST
    o["column_report_events"] = "WITH" + report_ctes(EVENT_LONG) + REPORT_LIST

    # score and findings
    o["quality_summary"] = CONTACT_REPORT + summary_select(duplicates_of(CONTACTS, COLS))
    o["quality_summary_orders"] = "WITH" + report_ctes(ORDER_LONG) + summary_select(duplicates_of("orders", ORDER_COLS))
    numbered = "(SELECT *, row_number() OVER () AS rid FROM lineitem)"
    line_cols = {c: f"CAST({c} AS VARCHAR)" for c in line}
    line_cols["l_shipdate"] = "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)"
    o["quality_summary_lineitem"] = "WITH" + report_ctes(long_of(numbered, line_cols, "rid")) + summary_select(
        duplicates_of("lineitem", line))
    doc_cols = {"doc_id": "CAST(doc_id AS VARCHAR)", "text": "text", "lang": "lang", "source": "source",
                "n_chars": "CAST(n_chars AS VARCHAR)"}
    o["quality_summary_documents"] = "WITH" + report_ctes(
        long_of("documents", doc_cols, "doc_id")) + summary_select(duplicates_of("documents", doc_cols))
    o["quality_notes"] = CONTACT_REPORT + f"""
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS note_no, note FROM (
SELECT 1 AS k, 'Mixed date formats in: ' || string_agg(col, ', ' ORDER BY col_no) AS note FROM report WHERE n_formats > 1
UNION ALL SELECT 2, string_agg(col || ' looks like a ' || role, '; ' ORDER BY col_no) || '.' FROM report WHERE role IS NOT NULL
UNION ALL SELECT 3, 'Completely empty columns: ' || string_agg(col, ', ' ORDER BY col_no) || '.' FROM report WHERE missing = n
UNION ALL SELECT 4, CASE WHEN k > 0 THEN format('{{:,}} exact duplicate row(s) found.', k) END
  FROM (SELECT CAST({duplicates_of(CONTACTS, COLS)} AS BIGINT) AS k)) WHERE note IS NOT NULL"""
    bands = " ".join(f"WHEN score >= {f} THEN {text(t)}" if f else f"ELSE {text(t)}" for f, t in fixed.VERDICTS)
    o["score_band"] = f"SELECT score, CASE {bands} END AS verdict FROM (SELECT DISTINCT CAST(floor(c_acctbal / 100) AS INTEGER) AS score FROM customer)"
    o["findings"] = CONTACT_REPORT + FINDINGS + ' SELECT id, severity, pillar, title, "column", CAST("count" AS BIGINT) AS "count", fix_key FROM found'
    o["finding_samples"] = CONTACT_REPORT + f""",{MONEY},
picked AS (
SELECT col, 'placeholders' AS kind, {strip('v')} AS s, id, 5 AS lim FROM cells WHERE {placeholder('v')}
UNION ALL SELECT c.col, 'email', {strip('v')}, id, 5 FROM cells c JOIN report r ON c.col = r.col AND r.bad_emails > 0
  WHERE NOT {matches(strip('v'), fixed.EMAIL)}
UNION ALL SELECT c.col, 'phone', {strip('v')}, id, 5 FROM cells c JOIN report r ON c.col = r.col AND r.bad_phones > 0
  WHERE length({digits('v')}) NOT BETWEEN 7 AND 15
UNION ALL SELECT col, 'padding', v, id, 4 FROM cells WHERE {strip('v')} <> v
UNION ALL SELECT col, 'currency', {strip('v')}, id, 4 FROM cells JOIN money USING (col) WHERE v IS NOT NULL)
SELECT col AS "column", kind, CAST(place AS INTEGER) AS place, s AS value FROM (
  SELECT col, kind, s, lim, row_number() OVER (PARTITION BY col, kind ORDER BY f, s) AS place FROM (
    SELECT col, kind, s, lim, min(id) AS f FROM picked WHERE s <> '' GROUP BY ALL)) WHERE place <= lim"""

    # similar spellings
    o["fuzzy_columns"] = f"""WITH cells AS ({CONTACT_LONG})
SELECT col AS "column" FROM cells WHERE v IS NOT NULL GROUP BY col
HAVING avg(CASE WHEN {number("regexp_replace(v, '[,[:space:]]', '', 'g')")} IS NOT NULL THEN 1.0 ELSE 0.0 END) <= 0.8"""
    o["value_counts"] = with_long(f"SELECT col AS \"column\", v AS value, count(*) AS rows, min(id) AS first_id FROM cells WHERE {strip('v')} <> '' GROUP BY col, v")
    o["value_counts_events"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS rows, min(event_id) AS first_id FROM events WHERE {strip(c)} <> '' GROUP BY {c}"
        for c in ("event_type", "props"))
    o["fuzzy_status"] = f"""WITH {VALUES}
SELECT u.col AS "column", u.u AS unique_count, CASE WHEN u.u > 5000 THEN 'skipped' ELSE 'scanned' END AS status,
  CAST(coalesce(t.cut, 0) AS BIGINT) AS truncated
FROM uniques u LEFT JOIN (SELECT col, sum(greatest(norms - 400, 0)) AS cut FROM blocks GROUP BY col) t
  ON t.col = u.col AND u.u <= 5000"""
    o["fuzzy_blocks"] = f"""WITH {VALUES} SELECT col AS "column", block, norms, least(norms, 400) AS compared,
  greatest(norms - 400, 0) AS truncated FROM blocks"""
    o["case_space_groups"] = f"""WITH {VALUES} SELECT col AS "column", norm, count(*) AS variants,
  min(v) AS first_spelling, max(v) AS last_spelling, CAST(sum(k) AS BIGINT) AS rows FROM vals GROUP BY col, norm HAVING count(*) > 1"""
    o["fuzzy_keeper"] = f"""WITH {VALUES} SELECT col AS "column", norm, v AS keeper FROM (
  SELECT col, norm, v, count(*) OVER w2 AS n, row_number() OVER (PARTITION BY col, norm ORDER BY k DESC,
    CASE WHEN regexp_matches(substring({strip('v')}, 1, 1), '[A-Z]') AND regexp_matches({strip('v')}, '[a-z]') THEN 1 ELSE 0 END DESC,
    CASE WHEN {strip('v')} = v THEN 1 ELSE 0 END DESC, length({strip('v')}) DESC, f) AS rn
  FROM vals WINDOW w2 AS (PARTITION BY col, norm)) WHERE rn = 1 AND n > 1"""

    o["fuzzy_groups_case_space"] = f"""WITH {VALUES},
keepers AS ({o["fuzzy_keeper"].split("WITH " + VALUES, 1)[1]})
SELECT v.col AS "column", substring(sha1(v.col || chr(0) || string_agg(v.v, chr(0) ORDER BY v.v)), 1, 12) AS group_id,
  any_value(k.keeper) AS suggested, string_agg(v.v, '|' ORDER BY v.k DESC, v.v) AS variants,
  concat_ws(', ', CASE WHEN bool_or({strip('v.v')} <> v.v OR contains(v.v, '  ')) THEN 'spacing' END,
    CASE WHEN count(DISTINCT lower({strip('v.v')})) < count(DISTINCT {strip('v.v')}) THEN 'casing' END) AS reasons,
  1.0 AS similarity, CAST(sum(v.k) AS BIGINT) AS rows
FROM vals v JOIN keepers k ON k."column" = v.col AND k.norm = v.norm GROUP BY v.col, v.norm"""

    # cleaning
    o["clean_trim"] = f"SELECT * FROM {TRIMMED} t"
    lower = {c: f"lower({c})" for c in COLS if c != "email"}
    o["clean_casing"] = with_contacts(f"SELECT _row_id, {pick(**lower)} FROM c")
    o["clean_casing_upper"] = with_contacts(f"SELECT _row_id, {pick(**{c: e.replace('lower', 'upper') for c, e in lower.items()})} FROM c")
    titled = {c: f"""CASE WHEN {c} IS NULL THEN NULL ELSE array_to_string(list_transform(
      regexp_extract_all({c}, '[a-zA-Z]+|[^a-zA-Z]+'), lambda r: upper(r[1]) || lower(r[2:])), '') END"""
              for c in COLS if c != "email"}
    o["clean_casing_title"] = with_contacts(f"SELECT _row_id, {pick(**titled)} FROM c")
    o["clean_emails"] = with_contacts(f"SELECT _row_id, {pick(email='lower(' + strip('email') + ')')} FROM c")
    o["clean_phones"] = with_contacts(f"SELECT _row_id, {pick(phone=digits('phone'))} FROM c")
    o["clean_phones_dashed"] = with_contacts(f"SELECT _row_id, {pick(phone=DASHED)} FROM c")
    o["clean_currency"] = with_contacts(f"SELECT _row_id, {pick(balance=currency('balance'))} FROM c")
    o["clean_dates"] = with_contacts(f"SELECT _row_id, {pick(joined=parse_dayfirst('joined'))} FROM c")
    some = [c for c in COLS if c != "fax"]
    o["drop_empty_columns"] = with_contacts(f"SELECT _row_id, {pick(some)} FROM c")
    o["drop_empty_rows"] = with_contacts(f"SELECT _row_id, {pick()} FROM c WHERE _row_id % 40 <> 0")
    o["drop_rows_any_null"] = with_contacts(f"SELECT _row_id, {pick(some)} FROM c WHERE {' AND '.join(c + ' IS NOT NULL' for c in some)}")
    o["drop_sparse_columns"] = with_contacts(f"SELECT _row_id, {pick([c for c in some if c != 'balance'])} FROM c")
    for kind, fn in (("mean", "avg"), ("median", "median")):
        name = "fill_numeric" if kind == "mean" else "fill_numeric_median"
        o[name] = f"""WITH g AS {GAPPY} SELECT _row_id, round(coalesce(balance, (SELECT {fn}(balance) FROM g)), 6) AS balance,
  round(coalesce(CAST(nation AS DOUBLE), (SELECT {fn}(nation) FROM g)), 6) AS nation, segment FROM g"""
    o["fill_constant"] = with_contacts(f"SELECT _row_id, {pick(**{c: f'coalesce({c}, {text(chr(45))})' for c in COLS})} FROM c")
    o["dedupe_rows"] = f"SELECT _row_id, {pick()} FROM {first_copies(CONTACTS)} t"
    o["dedupe_rows_lineitem"] = f"SELECT DISTINCT {', '.join(line)} FROM lineitem"
    o["dedupe_subset"] = f"SELECT _row_id, {pick()} FROM {first_copies(CONTACTS, ('segment', 'joined'))} t"
    o["dedupe_subset_documents"] = f"SELECT doc_id, text, lang, source, n_chars FROM {first_copies('documents', ('text',), 'doc_id')} t"
    o["dedupe_subset_events"] = f"SELECT event_id, ts, user_id, event_type, value, props FROM {first_copies('events', ('user_id', 'event_type'), 'event_id')} t"
    o["rename_columns"] = with_contacts("SELECT _row_id, name AS full_name, email AS e_mail, segment AS segment_code, note AS segment_code_2, phone AS tel FROM c")
    o["clean_run"] = f"SELECT _row_id, {pick()} FROM {first_copies(CLEAN_MONEY)} t"
    plan_cols = [c for c in COLS if c != "fax"]
    planned = f"""(SELECT _row_id, {pick(plan_cols, **{c: strip(c) for c in plan_cols if c not in ('email', 'phone')},
      email='lower(' + strip('email') + ')', phone=digits('phone'))} FROM {CONTACTS} t)"""
    o["apply_saved_plan"] = f"SELECT _row_id, {pick(plan_cols)} FROM {first_copies(planned, plan_cols)} t"
    trimmed7 = f"(SELECT _row_id, {pick(plan_cols)} FROM {TRIMMED} t)"
    survey = first_copies(trimmed7, plan_cols)
    o["change_log"] = f"""WITH a AS (SELECT count(*) AS n FROM {CONTACTS} t), b AS (SELECT count(*) AS n FROM {survey} t)
SELECT 'Rows before' AS item, CAST(n AS VARCHAR) AS value FROM a UNION ALL SELECT 'Rows after', CAST(n AS VARCHAR) FROM b
UNION ALL SELECT 'Columns before', '8' UNION ALL SELECT 'Columns after', '7'
UNION ALL SELECT 'Duplicate rows removed', CAST(a.n - b.n AS VARCHAR) FROM a, b
UNION ALL SELECT * FROM (VALUES ('Empty rows removed', '0'), ('Empty columns removed', '1'), ('Empty cells filled', '0'),
  ('Similar spellings merged', '0'), ('Columns renamed', '—'), ('Date columns fixed', '—'), ('Standardized', 'whitespace')) v"""

    # plans
    o["propose_plan"] = CONTACT_REPORT + FINDINGS + PLAN + """
SELECT CAST(step_no AS INTEGER) AS step_no, s.fix_key, label, summary, finding_ids, columns,
  (sev <= 2 OR s.fix_key = 'trim_whitespace') AS default_include,
  CASE sev WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS highest_severity
FROM steps s JOIN flagged f USING (fix_key)"""
    o["plan_line"] = CONTACT_REPORT + FINDINGS + PLAN + """
SELECT coalesce(string_agg(label, ' → ' ORDER BY step_no), 'No steps selected') AS line
FROM steps s JOIN flagged f USING (fix_key) WHERE sev <= 2 OR s.fix_key = 'trim_whitespace'"""
    o["profile_plan"] = CONTACT_REPORT + FINDINGS + PLAN + f""",
forced(profile, fix_key, on_by_profile) AS (VALUES {profile_rows()})
SELECT profile, CAST(step_no AS INTEGER) AS step_no, s.fix_key,
  coalesce(f.summary, {text(fixed.FORCED_SUMMARY)}) AS summary,
  coalesce(on_by_profile, sev <= 2 OR s.fix_key = 'trim_whitespace') AS default_include,
  CASE sev WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS highest_severity
FROM forced p JOIN steps s USING (fix_key) LEFT JOIN flagged f USING (fix_key)
WHERE f.summary IS NOT NULL OR on_by_profile"""

    # preview and audit
    o["preview_duplicates"] = with_contacts(f"""SELECT _row_id, {pick()} FROM (SELECT *, row_number() OVER
  (PARTITION BY {', '.join(COLS)} ORDER BY _row_id) AS copy_no FROM c) WHERE copy_no > 1""")
    o["preview_effects"] = with_contacts(f"""SELECT 'fax' AS empty_columns,
  count(*) FILTER (WHERE {' AND '.join(c + ' IS NULL' for c in COLS)}) AS empty_rows,
  count(*) FILTER (WHERE {' OR '.join(c + ' IS NULL' for c in COLS)}) AS rows_with_gaps FROM c""")
    o["preview_head"] = with_contacts(f"SELECT _row_id, {pick()} FROM c ORDER BY _row_id LIMIT 200")
    old = report_ctes(CONTACT_LONG, "a_")
    new = report_ctes(long_of("cleaned", {c: c for c in plan_cols}, "_row_id"), "b_")
    o["score_delta"] = f"""WITH cleaned AS (SELECT _row_id, {pick(plan_cols)} FROM {survey} t), {old}, {new},
x AS ({summary_select(duplicates_of(CONTACTS, COLS), 'a_')}), y AS ({summary_select(duplicates_of('cleaned', plan_cols), 'b_')})
SELECT x.score AS score_before, y.score AS score_after, x.completeness AS completeness_before,
  y.completeness AS completeness_after, x.uniqueness AS uniqueness_before, y.uniqueness AS uniqueness_after,
  x.consistency AS consistency_before, y.consistency AS consistency_after, y.score - x.score AS score_delta FROM x, y"""
    o["dropped_rows"] = with_contacts(f"SELECT _row_id, {pick()} FROM c WHERE _row_id NOT IN (SELECT _row_id FROM {survey} t)")
    short = {c: f"CASE WHEN length({c}) > 80 THEN substring({c}, 1, 79) || '…' ELSE coalesce({c}, '') END" for c in COLS}
    o["dropped_sample"] = with_contacts(f"SELECT _row_id, {pick(**short)} FROM c WHERE _row_id NOT IN "
                                        f"(SELECT _row_id FROM {survey} t) ORDER BY _row_id LIMIT 8")
    parts = []
    for no, c in enumerate(COLS):
        parts.append(f"SELECT c._row_id, {no} AS no, '{c}' AS \"column\", coalesce(c.{c}, '') AS before, coalesce(CAST(k.{c} AS VARCHAR), '') AS after "
                     f"FROM c JOIN k USING (_row_id) WHERE coalesce(c.{c}, '') <> coalesce(CAST(k.{c} AS VARCHAR), '')")
    changes = f"WITH c AS {CONTACTS}, k AS {first_copies(CLEAN_MONEY)}, x AS ({' UNION ALL '.join(parts)}) "
    o["changed_cells"] = changes + 'SELECT _row_id, "column", before, after FROM x'
    o["changed_sample"] = changes + 'SELECT _row_id, "column", before, after FROM x ORDER BY _row_id, no LIMIT 12'
    shouted = {c: f"upper({strip(c)})" for c in COLS if c != "email"}
    upper = f"(SELECT _row_id, {pick(**shouted, email=strip('email'))} FROM {CONTACTS} t)"
    parts = [
        f"SELECT {text('note → remark' if c == 'note' else c)} AS \"column\" FROM c JOIN k USING (_row_id) "
        f"WHERE coalesce(c.{c}, '') <> coalesce(k.{c}, '')" for c in COLS]
    o["audit_chain"] = f"""WITH c AS {CONTACTS}, k AS {first_copies(upper)}
SELECT "column", count(*) AS changed, (SELECT count(*) FROM c) - (SELECT count(*) FROM k) AS rows_removed
FROM ({' UNION ALL '.join(parts)}) GROUP BY "column\""""
    return o
