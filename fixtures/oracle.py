"""Independent SQL for DuckDB: the same answers from the same tables.

A query is a SELECT over named common tables; ``sql`` adds the tables it needs.
"""

from __future__ import annotations

import re

from emberwatch.functions import fixed_values as V
from fixtures import seeds


def q(text: str) -> str:
    """A text as SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def row(columns) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns)


BLANK = "concat(' ', chr(9), chr(10), chr(13))"
FRAME = (
    r"""'^\s*(?:at\s+[\w$.<>]+\([^)]*\)|File\s+"[^"]+",\s+line\s+\d+.*|\s+at\s+.+:\d+)'"""
)
EXCEPTION = (
    r"'([A-Z][\w$]*(?:Error|Exception)|Traceback|Panic|Fatal|OOM|OutOfMemory|ConnectionRefused|Deadlock|SEGFAULT)'"
)
T: dict[str, str] = {}


def kv(key: str) -> str:
    return f"substr(list_filter(pairs, lambda p: starts_with(p, '{key}='))[-1], {len(key) + 2})"


def parse(source: str, column: str) -> str:
    return rf"""
SELECT *, left(message, 512) AS error_message,
  concat_ws(' | ', exception_type, nullif(message, '')) AS canonical_text
FROM (SELECT *,
    nullif(regexp_extract(t, {EXCEPTION}, 1), '') AS exception_type,
    nullif(array_to_string(list_transform(list_filter(lines, lambda s: regexp_matches(s, {FRAME})),
      lambda s: trim(s, {BLANK})), chr(10)), '') AS stack_trace,
    coalesce({kv('service')}, {kv('app')}, {kv('module')}) AS log_service,
    coalesce({kv('ip')}, nullif(regexp_extract(t, '\b\d{{1,3}}(?:\.\d{{1,3}}){{3}}\b'), ''), {kv('host')})
      AS log_server_ip,
    coalesce(nullif(regexp_extract(t, '\b(ERROR|ERR|FATAL|CRITICAL|WARN(?:ING)?|PANIC)\b', 1), ''), 'ERROR')
      AS log_severity,
    coalesce(trim(list_filter(lines, lambda s: trim(s, {BLANK}) <> '' AND NOT regexp_matches(s, {FRAME}))[1],
      {BLANK}), left(t, 280)) AS message
  FROM (SELECT *, string_split(t, chr(10)) AS lines, regexp_extract_all(t, '\b[\w.-]+=[^\s,]+') AS pairs
    FROM (SELECT *, trim({column}, {BLANK}) AS t FROM {source})))"""


T["alerts_src"] = f"SELECT {row(seeds.PAYLOAD_ROW)}, event_type, props FROM events"
T["stored"] = f"SELECT {row(seeds.STORED_ROW)} FROM events"
T["parsed"] = parse("alerts_src", "raw_log")


def _value(v) -> str:
    if v is None:
        return "NULL"
    return q(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)


_seed_names = [e.split(" ")[0] for e in seeds.SEED_SCHEMA.split(", ")]
T["kb"] = (
    "SELECT *, created_at AS updated_at FROM ("
    + " UNION ALL ".join(
        "SELECT "
        + ", ".join(
            f"CAST({_value(v)} AS timestamp) AS {n}" if n == "created_at" else f"{_value(v)} AS {n}"
            for n, v in zip(_seed_names, (*r, seeds.SEED_TIME))
        )
        for r in seeds.SEED_KNOWLEDGE
    )
    + f" UNION ALL SELECT {row(seeds.BENCHMARK_ROW)} FROM benchmark)"
)
T["kb_parsed"] = parse("kb", "raw_log_sample")
T["points"] = (
    "SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS namespace, vec_id AS id, "
    "concat('v', label) AS text, embedding FROM embeddings"
)
T["requests"] = (
    "SELECT * EXCLUDE (engineer, tag_text), coalesce(engineer, 'engineer') AS engineer, "
    "coalesce(string_split(tag_text, ','), []::VARCHAR[]) AS tags FROM ("
    f"SELECT {row(seeds.REQUEST_ROW)} FROM {seeds.REQUEST_SOURCE})"
)

# --- vectors of all texts that any query compares -------------------------------------------------
T["alert_texts"] = "SELECT DISTINCT canonical_text AS text FROM parsed"
T["all_texts"] = (
    "SELECT text FROM alert_texts UNION SELECT canonical_text FROM kb_parsed"
)


def features(source: str, prefix: str = "") -> None:
    T[f"{prefix}tokens"] = (
        f"SELECT text, regexp_extract_all(lower(text), '[a-z][a-z0-9_]+') AS toks FROM {source}"
    )
    T[f"{prefix}word_counts"] = (
        f"SELECT text, tok, count(*) AS n FROM (SELECT text, unnest(toks) AS tok FROM {prefix}tokens) GROUP BY ALL"
    )
    T[f"{prefix}word_weights"] = (
        "SELECT text, tok AS feature, n, list_reduce(list_prepend(0.0::DOUBLE, "
        "list_transform(range(1, n + 1), lambda i: i::DOUBLE)), lambda w, i: 1 + ln(w + 2)) AS weight "
        f"FROM {prefix}word_counts"
    )
    T[f"{prefix}pair_counts"] = (
        "SELECT text, concat(toks[i], '_', toks[i + 1]) AS feature, count(*)::DOUBLE AS weight FROM "
        f"(SELECT text, toks, unnest(range(1, len(toks))) AS i FROM {prefix}tokens) GROUP BY ALL"
    )
    T[f"{prefix}trigram_counts"] = (
        "SELECT text, concat('c3:', substr(p, i, 3)) AS feature, count(*)::DOUBLE AS weight FROM "
        "(SELECT text, p, unnest(range(1, length(p) - 1)) AS i FROM "
        f"(SELECT text, concat('^', lower(text), '$') AS p FROM {source})) GROUP BY ALL"
    )
    T[f"{prefix}buckets"] = (
        "SELECT text, ('0x' || substr(md5(feature), 31, 2))::INT AS bucket, sum(weight) AS weight FROM ("
        f"SELECT text, feature, weight FROM {prefix}word_weights UNION ALL "
        f"SELECT * FROM {prefix}pair_counts UNION ALL SELECT * FROM {prefix}trigram_counts) GROUP BY ALL"
    )
    T[f"{prefix}unit_vec"] = (
        "SELECT text, hash(text) AS h, bucket, (weight / sqrt(sum(weight * weight) OVER (PARTITION BY text)))::FLOAT::DOUBLE AS x "
        f"FROM {prefix}buckets"
    )
    T[f"{prefix}unit_len"] = f"SELECT text, sqrt(sum(x * x)) AS norm FROM {prefix}unit_vec GROUP BY text"


features("all_texts")


def text_sims(left: str, right: str) -> str:
    """Cosine of every text of ``left`` with every knowledge row of ``right``."""
    return f"""
WITH ua AS MATERIALIZED (SELECT h, bucket, x FROM unit_vec WHERE text IN (SELECT text FROM {left})),
ub AS MATERIALIZED (SELECT h, bucket, x FROM unit_vec WHERE text IN (SELECT canonical_text FROM {right})),
d AS MATERIALIZED (SELECT ua.h AS ta, ub.h AS tb, sum(ua.x * ub.x) AS dot FROM ua JOIN ub ON ua.bucket = ub.bucket GROUP BY ALL)
SELECT a.text, b.id, round(coalesce(d.dot, 0) / (a.norm * b.norm), 6) AS similarity
FROM (SELECT t.text, hash(t.text) AS h, l.norm FROM {left} t JOIN unit_len l ON l.text = t.text) a
CROSS JOIN (SELECT t.id, hash(t.canonical_text) AS h, l.norm FROM {right} t JOIN unit_len l ON l.text = t.canonical_text) b
LEFT JOIN d ON d.ta = a.h AND d.tb = b.h"""


T["all_sims"] = text_sims("alert_texts", "kb_parsed")
T["text_ranked"] = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY similarity DESC, id) AS rank "
    "FROM all_sims) WHERE rank <= 3"
)
T["hit_rows"] = (
    "SELECT r.text, r.rank, r.similarity, k.* EXCLUDE (text) FROM text_ranked r JOIN (SELECT *, raw_log_sample AS text "
    "FROM kb) k ON k.id = r.id WHERE k.is_active"
)
T["best_hit"] = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank) AS pos FROM hit_rows) WHERE pos = 1"
)
T["decided"] = """
SELECT p.*, coalesce(b.similarity, 0) AS similarity_score,
  CASE WHEN b.similarity >= 0.78 THEN 'matched' ELSE 'new_incident' END AS match_status,
  CASE WHEN b.similarity >= 0.78 THEN b.id END AS matched_knowledge_id,
  b.title AS hit_title, b.root_cause AS hit_cause, b.engineer_guide AS hit_guide, b.raw_log_sample AS hit_log
FROM parsed p LEFT JOIN best_hit b ON b.text = p.canonical_text"""
T["merged"] = (
    "SELECT * EXCLUDE (server_ip, service, severity), coalesce(nullif(server_ip, ''), log_server_ip) AS server_ip, "
    "coalesce(nullif(service, ''), log_service) AS service, log_severity AS severity FROM decided"
)


def has(text: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def plain(column: str) -> str:
    t = f"lower({column})"
    return (
        f"CASE WHEN {has(t, 'redis')} AND {has(t, 'timeout', 'refused', 'oom')} THEN {q(V.PLAIN_CACHE)} "
        f"WHEN {has(t, 'gpu', 'inference')} THEN {q(V.PLAIN_INFERENCE)} "
        f"WHEN {has(t, 'mysql', 'database', 'hikari', 'connection')} THEN {q(V.PLAIN_DATABASE)} "
        f"WHEN {has(t, 'oom', 'outofmemory', 'heap')} THEN {q(V.PLAIN_MEMORY)} "
        f"WHEN {has(t, 'disk', 'nospace', 'no space')} THEN {q(V.PLAIN_DISK)} "
        f"WHEN {has(t, 'certif', 'ssl', 'tls')} THEN {q(V.PLAIN_CERTIFICATE)} "
        f"ELSE {q(V.PLAIN_DEFAULT)} END"
    )


def error_type(text: str) -> str:
    t = f"lower({text})"
    return (
        f"CASE WHEN {has(t, 'gpu', '显存')} THEN {q(V.TYPE_GPU)} WHEN {has(t, 'kafka', '积压')} THEN {q(V.TYPE_QUEUE)} "
        f"WHEN {has(t, 'oom', 'outofmemory', 'heap', 'jvm')} THEN {q(V.TYPE_JVM)} "
        f"WHEN {has(t, 'mysql', '数据库', 'hikari', '连接池')} THEN {q(V.TYPE_DATABASE)} "
        f"WHEN {has(t, 'redis', '缓存')} THEN {q(V.TYPE_CACHE)} ELSE {q(V.TYPE_DEFAULT)} END"
    )


def user_guide(text: str) -> str:
    t = f"lower({text})"
    return (
        f"CASE WHEN {has(t, 'gpu', '显存')} THEN {q(V.GUIDE_GPU)} WHEN {has(t, 'redis', '缓存')} THEN {q(V.GUIDE_CACHE)} "
        f"WHEN {has(t, '内存', 'oom')} THEN {q(V.GUIDE_MEMORY)} ELSE {q(V.GUIDE_DEFAULT)} END"
    )


T["action_rows"] = " UNION ALL ".join(
    f"SELECT {q(n)} AS name, {q(label)} AS label, {q(d)} AS description, {q(r)} AS risk_level"
    for n, label, d, r in V.ACTIONS
)
_inc = "lower(concat(coalesce(hit_cause, ''), ' ', hit_title))"
T["offers"] = f"""
SELECT id, similarity_score, pos, name FROM (SELECT id, similarity_score, {_inc} AS txt FROM merged
  WHERE match_status = 'matched'), (VALUES (1, 'clear_cache'), (2, 'restart_service'), (3, 'scale_up'),
  (4, 'restart_service'), (5, 'rollback')) AS r(pos, name)
WHERE CASE WHEN pos <= 2 THEN {has('txt', 'redis', 'cache', '缓存')}
  WHEN pos <= 4 THEN {has('txt', 'oom', 'outofmemory', 'heap', '内存')}
  ELSE {has('txt', 'rollback', '版本', 'deploy', 'release')} END
  AND (similarity_score >= 0.85 OR name IN ('clear_cache', 'restart_service'))"""
T["suggested"] = """
SELECT id, name, min(pos) AS pos FROM offers GROUP BY ALL
UNION ALL SELECT id, 'notify_oncall', 9 FROM merged WHERE match_status = 'matched'
  AND id NOT IN (SELECT id FROM offers)"""
_sample = f"trim(coalesce(nullif(hit_log, ''), hit_title), {BLANK})"
_steps = f"coalesce(nullif(trim(hit_guide, {BLANK}), ''), {q(V.GENERIC_STEPS)})"
T["answered"] = f"""
SELECT *, concat({q(V.HEAD_PLAIN)}, chr(10), plain_text, chr(10), chr(10), {q(V.HEAD_ACTIONS)}, chr(10),
  {q(V.USER_ACTIONS)}, chr(10), chr(10), {q(V.HEAD_ENGINEER)}, chr(10), engineer_text, chr(10)) AS answer
FROM (SELECT *, {plain('raw_log')} AS plain_text, CASE WHEN {_sample} <> '' THEN
  concat({q(V.HISTORY_OPEN)}, left({_sample}, 80), {q(V.HISTORY_CLOSE)}, {_steps}) ELSE {_steps} END AS engineer_text
  FROM merged)"""
_trim = f"trim(trim(%s, {BLANK}), concat('` ', chr(10)))"
T["sections"] = f"""
SELECT *, {_trim % f"substr(answer, {len(V.HEAD_PLAIN) + 1}, strpos(answer, {q(V.HEAD_ACTIONS)}) - {len(V.HEAD_PLAIN) + 1})"}
    AS plain_language,
  {_trim % f"substr(answer, strpos(answer, {q(V.HEAD_ACTIONS)}) + {len(V.HEAD_ACTIONS)}, strpos(answer, {q(V.HEAD_ENGINEER)}) - strpos(answer, {q(V.HEAD_ACTIONS)}) - {len(V.HEAD_ACTIONS)})"}
    AS user_actions,
  {_trim % f"substr(answer, strpos(answer, {q(V.HEAD_ENGINEER)}) + {len(V.HEAD_ENGINEER)})"} AS engineer_guide
FROM answered"""
T["hit_history"] = f"""
SELECT text, string_agg(printf('%d:%.6f', id, similarity), ',' ORDER BY rank) AS hit_text,
  string_agg(concat('  - ', title, ' (相似度 ', printf('%.2f', similarity), ')', chr(10)), '' ORDER BY rank) AS hit_lines,
  string_agg(concat('【历史经验#', pos, '】 (相似度 ', printf('%.2f', similarity), ')', chr(10), '历史日志: ',
    coalesce(nullif(raw_log_sample, ''), title), chr(10), '当时解决办法: ', coalesce(engineer_guide, ''), chr(10), '---'),
    chr(10) ORDER BY rank) AS blocks
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank) AS pos FROM hit_rows) GROUP BY text"""

# --- resolutions -----------------------------------------------------------------------------------
_cause = f"trim(string_split(root_cause, chr(10))[1], {BLANK})"
T["prompted"] = f"""
SELECT *, concat('工程师处理记录:', chr(10), '- 根因: ', root_cause, chr(10), '- 解决办法: ', resolution, chr(10),
  '- 工程师: ', engineer, chr(10), '- 标签: ', CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE '(无)' END,
  chr(10), chr(10), '触发该处理的原始日志:', chr(10), '```', chr(10), raw_log, chr(10), '```', chr(10)) AS prompt
FROM (SELECT r.*, a.raw_log FROM requests r JOIN alerts_src a ON a.id = r.alert_id)"""
T["resolved"] = f"""
SELECT *, {error_type("concat(cause, ' ', prompt)")} AS p_type,
  CASE WHEN length(cause) > 40 THEN concat(left(cause, 40), '…') ELSE cause END AS p_title,
  {user_guide('cause')} AS p_guide, trim(string_split(resolution, chr(10))[1], {BLANK}) AS p_engineer
FROM (SELECT *, {_cause} AS cause FROM prompted)"""
T["deposit_rows"] = """
SELECT request_no, alert_id, raw_log, engineer, tags, requested_at, (SELECT max(id) FROM kb) + 1 + request_no AS id,
  coalesce(nullif(error_type, ''), p_type) AS error_type,
  coalesce(nullif(p_title, ''), concat(coalesce(nullif(error_type, ''), 'Incident'), ' - ', left(root_cause, 60))) AS title,
  coalesce(nullif(cause, ''), root_cause) AS root_cause,
  p_guide AS user_guide, coalesce(nullif(p_engineer, ''), resolution) AS engineer_guide FROM resolved"""

_NAME = re.compile(r"\b[a-z_]+\b")


def sql(select: str, extra: dict[str, str] | None = None) -> str:
    """The SELECT with every common table it reaches, in order of definition."""
    tables = {**T, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(_NAME.findall(re.sub(r"'[^']*'", "''", text))):
            if name in tables and name not in needed:
                needed.add(name)
                visit(tables[name])

    visit(select)
    order = [n for n in tables if n in needed]
    # a table may use names defined after it
    done: list[str] = []

    def place(name: str, path: tuple[str, ...] = ()) -> None:
        if name in done or name in path:
            return
        for other in order:
            if other != name and re.search(rf"\b{other}\b", re.sub(r"'[^']*'", "''", tables[name])):
                place(other, (*path, name))
        done.append(name)

    for n in order:
        place(n)
    if not done:
        return select
    walks = any(re.search(rf"\b{n}\b", tables[n]) for n in done)  # a table that reads itself
    start = "WITH RECURSIVE " if walks else "WITH "
    return start + ",\n".join(f"{n} AS ({tables[n].strip()})" for n in done) + "\n" + select
