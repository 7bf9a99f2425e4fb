"""Texts made from an incident: explanations, prompts, structured fields, notifications.

Everything here is a column expression. The rule-based answer is built from columns, never by
reading a rendered prompt back.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import fixed_values as V
from emberwatch.functions.logs import none_if_empty, strip


def _has(text: Column, *terms: str) -> Column:
    return reduce(or_, [F.contains(text, F.lit(t)) for t in terms])


def _first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def or_else(c: Column, *others: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[none_if_empty(x) for x in (c, *others[:-1])], others[-1])


# --- rules ----------------------------------------------------------------------------------------
def plain_language(raw_log: Column) -> Column:
    t = F.lower(raw_log)
    return _first_rule(
        [
            (and_(_has(t, "redis"), _has(t, "timeout", "refused", "oom")), V.PLAIN_CACHE),
            (_has(t, "gpu", "inference"), V.PLAIN_INFERENCE),
            (_has(t, "mysql", "database", "hikari", "connection"), V.PLAIN_DATABASE),
            (_has(t, "oom", "outofmemory", "heap"), V.PLAIN_MEMORY),
            (_has(t, "disk", "nospace", "no space"), V.PLAIN_DISK),
            (_has(t, "certif", "ssl", "tls"), V.PLAIN_CERTIFICATE),
        ],
        V.PLAIN_DEFAULT,
    )


def guess_error_type(root_cause: Column, prompt: Column) -> Column:
    t = F.lower(F.concat(root_cause, F.lit(" "), prompt))
    return _first_rule(
        [
            (_has(t, "gpu", "显存"), V.TYPE_GPU),
            (_has(t, "kafka", "积压"), V.TYPE_QUEUE),
            (_has(t, "oom", "outofmemory", "heap", "jvm"), V.TYPE_JVM),
            (_has(t, "mysql", "数据库", "hikari", "连接池"), V.TYPE_DATABASE),
            (_has(t, "redis", "缓存"), V.TYPE_CACHE),
        ],
        V.TYPE_DEFAULT,
    )


def root_user_guide(root_cause: Column) -> Column:
    t = F.lower(root_cause)
    return _first_rule(
        [
            (_has(t, "gpu", "显存"), V.GUIDE_GPU),
            (_has(t, "redis", "缓存"), V.GUIDE_CACHE),
            (_has(t, "内存", "oom"), V.GUIDE_MEMORY),
        ],
        V.GUIDE_DEFAULT,
    )


def short_title(root_cause: Column) -> Column:
    n = F.lit(V.TITLE_CHARS)
    return F.when(
        F.length(root_cause) > n, F.concat(F.left(root_cause, n), F.lit(V.TITLE_MORE))
    ).otherwise(root_cause)


# --- triage prompt and answer -------------------------------------------------------------------------
def triage_prompt(cluster_summary: Column | None = None) -> Column:
    """Prompt of one alert, from ``raw_log``, ``hits`` (in rank order) and ``match_status``."""
    hits = F.col("hits")
    blocks = F.transform(
        hits,
        lambda h, i: F.format_string(
            V.HISTORY_BLOCK,
            i + 1,
            h["similarity"],
            or_else(h["raw_log"], h["title"]),
            F.coalesce(h["engineer_guide"], F.lit("")),
        ),
    )
    history = F.when(F.size(hits) > 0, F.array_join(blocks, "\n")).otherwise(V.NO_HISTORY)
    known = F.col("match_status") == "matched"
    parts = [
        F.lit(V.PROMPT_LOG), F.col("raw_log"), F.lit(V.PROMPT_HISTORY), history,
        F.lit(V.PROMPT_MATCH), F.when(known, V.KNOWN_LABEL).otherwise(V.NEW_LABEL),
        F.lit(V.PROMPT_GUIDANCE), F.when(known, V.KNOWN_GUIDANCE).otherwise(V.NEW_GUIDANCE),
        F.lit("\n"),
    ]
    if cluster_summary is not None:
        extra = F.concat(F.lit(V.PROMPT_CLUSTER), cluster_summary, F.lit("\n"))
        parts.append(F.coalesce(F.when(cluster_summary != "", extra), F.lit("")))
    return F.concat(*parts)


def triage_prompts(df: DataFrame, cluster_summary: str | None = None) -> DataFrame:
    summary = F.col(cluster_summary) if cluster_summary else None
    return df.withColumn("prompt", triage_prompt(summary))


def _engineer_text() -> Column:
    """First history solution (or the generic steps), after the log it comes from."""
    first = F.try_element_at(F.col("hits"), F.lit(1))
    solution = strip(F.coalesce(first["engineer_guide"], F.lit("")))
    sample = strip(or_else(first["raw_log"], first["title"]))
    steps = or_else(solution, F.lit(V.GENERIC_STEPS))
    return F.when(
        F.coalesce(sample, F.lit("")) != "",
        F.concat(F.lit(V.HISTORY_OPEN), F.left(sample, F.lit(80)), F.lit(V.HISTORY_CLOSE), steps),
    ).otherwise(steps)


def rule_triage(df: DataFrame) -> DataFrame:
    """Add ``answer``: the deterministic three-section text for ``raw_log`` and ``hits``."""
    return df.withColumn(
        "answer",
        F.concat(
            # blank ends of the log do not matter to keyword rules
            F.lit(V.HEAD_PLAIN + "\n"), plain_language(F.col("raw_log")), F.lit("\n\n"),
            F.lit(V.HEAD_ACTIONS + "\n" + V.USER_ACTIONS + "\n\n"),
            F.lit(V.HEAD_ENGINEER + "\n"), _engineer_text(), F.lit("\n"),
        ),
    )


def rule_report(df: DataFrame) -> DataFrame:
    """The three texts of the rule-based report, without composing an answer and reading it back.

    The same as ``parse_triage(rule_triage(df))``: the first two sections are fixed sentences, and
    the last one runs to the end of the answer whatever it contains."""
    return df.withColumns(
        {
            "plain_language": plain_language(F.col("raw_log")),
            "user_actions": F.lit(V.USER_ACTIONS),
            "engineer_guide": _clean(_engineer_text()),
        }
    )


def _clean(c: Column) -> Column:
    return F.btrim(strip(c), F.lit("` \n"))


def _section(answer: Column, head: str, stops: str) -> Column:
    """The text after ``head`` up to one of ``stops``, or to the end of the answer."""
    icon, name = head.split(" ", 1)
    # without stops nothing has to be tried at every character
    rest = rf"(.*?)(?={stops}\z)" if stops else "(.*)"
    return _clean(F.regexp_extract(answer, rf"(?sU){icon}\s*{name}\s*{rest}", 1))


def parse_triage(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Add ``plain_language, user_actions, engineer_guide`` from a three-section answer; without
    the first section the whole answer is the explanation."""
    a = F.col(answer)
    return df.withColumns(
        {
            "plain_language": or_else(
                _section(a, V.HEAD_PLAIN, f"{V.MARK_ACTIONS}|{V.MARK_ENGINEER}|"), strip(a)
            ),
            "user_actions": _section(a, V.HEAD_ACTIONS, f"{V.MARK_ENGINEER}|"),
            "engineer_guide": _section(a, V.HEAD_ENGINEER, ""),
        }
    )


# --- resolutions -----------------------------------------------------------------------------------------
def first_line(c: Column) -> Column:
    return strip(F.substring_index(c, "\n", 1))


def resolution_prompts(df: DataFrame) -> DataFrame:
    """Add ``prompt`` from a resolution request and the ``raw_log`` of its alert."""
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise(V.NO_TAGS)
    return df.withColumn(
        "prompt",
        F.format_string(V.RESOLUTION_PROMPT, "root_cause", "resolution", "engineer", tags, "raw_log"),
    )


def rule_resolution(df: DataFrame) -> DataFrame:
    """Add ``answer``: five labelled lines for ``root_cause``, ``resolution`` and ``prompt``. Only
    the first line of cause and resolution is used."""
    cause = first_line(F.col("root_cause"))
    values = {
        "error_type": guess_error_type(cause, F.col("prompt")),
        "title": short_title(cause),
        "root_cause": cause,
        "user_guide": root_user_guide(cause),
        "engineer_guide": first_line(F.col("resolution")),
    }
    parts = [F.concat(F.lit(f"{label}: "), values[name], F.lit("\n")) for name, label in V.FIELD_LABELS]
    return df.withColumn("answer", F.concat(*parts))


def labelled_field(answer: Column, label: str) -> Column:
    """Value after a label on the same line; null without the label. An empty value stays empty."""
    pattern = rf"(?dU){label}[^\S\n]*:([^\S\n]*[^\n]*)"
    return F.when(answer.rlike(pattern), strip(F.regexp_extract(answer, pattern, 1)))


def parse_resolution(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Add ``parsed``, a struct of the five labelled fields."""
    fields = [labelled_field(F.col(answer), label).alias(n) for n, label in V.FIELD_LABELS]
    return df.withColumn("parsed", F.struct(*fields))


def resolution_fallbacks(df: DataFrame) -> DataFrame:
    """Add ``kb_error_type, kb_title, kb_root_cause, kb_user_guide, kb_engineer_guide``."""
    p = F.col("parsed")
    untitled = F.concat(
        or_else(F.col("error_type"), F.lit(V.UNTYPED_INCIDENT)),
        F.lit(" - "),
        F.left("root_cause", F.lit(V.CAUSE_CHARS)),
    )
    return df.withColumns(
        {
            "kb_error_type": or_else(F.col("error_type"), p["error_type"], F.col("error_type")),
            "kb_title": or_else(p["title"], untitled),
            "kb_root_cause": or_else(p["root_cause"], F.col("root_cause")),
            "kb_user_guide": or_else(p["user_guide"], F.lit(V.FALLBACK_USER_GUIDE)),
            "kb_engineer_guide": or_else(p["engineer_guide"], F.col("resolution")),
        }
    )


# --- notifications ------------------------------------------------------------------------------------------
def render_notifications(df: DataFrame) -> DataFrame:
    """``alert_id, title, markdown, actions, alert_ids`` of triaged alerts."""
    service, host = none_if_empty(F.col("service")), none_if_empty(F.col("host"))
    icon = F.when(F.col("match_status") == "matched", V.ICON_KNOWN).otherwise(V.ICON_NEW)
    lines = F.transform(
        "hits", lambda h: F.format_string(V.NOTICE_HISTORY_LINE, h["title"], h["similarity"])
    )
    history = F.when(
        F.size("hits") > 0, F.concat(F.lit(V.NOTICE_HISTORY), F.array_join(lines, ""))
    ).otherwise("")
    body = F.format_string(
        V.NOTICE_BODY,
        F.coalesce(service, host, F.lit("-")),
        or_else(F.col("server_ip"), F.lit("-")),
        F.date_format("created_at", V.TIME_FORMAT),
        "plain_language", "user_actions", "engineer_guide",
    )
    with_alert = F.transform(
        "suggested_actions",
        lambda a: F.struct(
            a["name"].alias("name"), a["label"].alias("label"),
            a["description"].alias("description"), a["risk_level"].alias("risk_level"),
            F.create_map(F.lit("alert_id"), F.col("id").cast("string")).alias("params"),
        ),
    )
    return df.select(
        F.col("id").alias("alert_id"),
        F.format_string(
            V.NOTICE_TITLE, icon, F.coalesce(service, host, F.lit(V.UNKNOWN_SERVICE))
        ).alias("title"),
        F.concat(body, history).alias("markdown"),
        with_alert.alias("actions"),
        F.array("id").alias("alert_ids"),
    )


def render_cluster_notifications(clusters: DataFrame, window_s: int) -> DataFrame:
    """Add ``title`` and ``markdown`` to cluster summaries."""
    services = F.when(F.size("services") > 0, F.array_join("services", ", ")).otherwise(V.MANY_SERVICES)
    examples = F.array_join(
        F.transform("examples", lambda e: F.format_string(V.EXAMPLE_LINE, e)), "\n"
    )
    return clusters.withColumns(
        {
            "title": F.format_string(V.CLUSTER_TITLE, "count", services),
            "markdown": F.format_string(
                V.CLUSTER_BODY, F.lit(window_s // 60), "count", services, examples
            ),
        }
    )
