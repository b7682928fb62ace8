"""Text rules for agent traces: code blocks, API calls, errors, truncation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of the trace format.
API_CALL = r"apis\.([a-z_]+)\.([a-z_]+)\("
CODE_FENCE = r"(?s)```(?:python)?\s*\n(.*?)```"
TOKEN_ASSIGN = r"""(?m)^\s*([A-Za-z_]\w*)\s*=\s*apis\.([a-z_]+)\.login\("""
TOKEN_FIELD = r"""(?m)^\s*([A-Za-z_]\w*)\s*=\s*apis\.([a-z_]+)\.login\(.*?\)\s*\[\s*['"]access_token['"]\s*\]"""
DOC_CALL = r"""apis\.api_docs\.show_api_doc\(\s*app_name\s*=\s*['"]([a-z_]+)['"]\s*,\s*api_name\s*=\s*['"]([a-z_]+)['"]"""
DESCRIPTION_CALL = r"""apis\.api_docs\.show_api_descriptions\(\s*app_name\s*=\s*['"]([a-z_]+)['"]"""
NOTE_CALL = r"""(?m)^\s*note\(\s*(['"])(.*?)\1\s*\)"""


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truncate_text(c, n: int) -> Column:
    c = _c(c)
    cut = F.concat(F.substring(c, 1, n), F.lit("\n...[truncated "), (F.length(c) - n).cast("string"), F.lit(" chars]"))
    return F.when(F.length(c) > n, cut).otherwise(c)


def api_calls(code) -> Column:
    """All ``app.api`` calls of a code text, in order."""
    c = F.coalesce(_c(code), F.lit(""))
    apps, apis = (F.regexp_extract_all(c, F.lit(API_CALL), F.lit(i)) for i in (1, 2))
    return F.zip_with(apps, apis, lambda a, b: F.concat(a, F.lit("."), b))


def call_app(call: Column) -> Column:
    return F.substring_index(call, ".", 1)


def api_tokens(code) -> Column:
    calls = api_calls(code)
    return F.concat(calls, F.transform(calls, lambda c: F.concat(F.lit("app:"), call_app(c))))


def code_block(text, strict: bool = False) -> Column:
    """Last fenced code block as struct<code, parse_error>."""
    s = _c(text)
    blocks = F.regexp_extract_all(s, F.lit(CODE_FENCE), F.lit(1))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    body = strip(s)
    none = F.lit(None).cast("string")
    out = lambda code, err: F.struct(code.alias("code"), err.alias("parse_error"))
    col = F.when(F.size(blocks) > 0, out(strip(F.element_at(blocks, -1)), none))
    if strict:
        col = col.when(body.contains("<invoke") | body.contains("<function_calls") | body.contains("<parameter"), out(none, F.lit("fake_tool_call_xml")))
        col = col.when((F.length(body) - F.length(F.replace(body, F.lit("```"), F.lit("")))) == 3, out(none, F.lit("truncated_code_block")))
    col = col.when(body.contains("apis.") | body.startswith("print("), out(body, F.lit("no_fence")))
    return col.otherwise(out(none, F.lit("no_code_block")))


def classify_error(output) -> Column:
    """Error type and message (last non-empty line, at most 500 characters) of a failed execution; null when it succeeded."""
    s = _c(output)
    kind = (
        F.when(s.contains("Syntax error"), "syntax_error")
        .when(s.contains("Response status code is"), "api_error")
        .when(s.contains("Maximum number of executions"), "budget_error")
        .otherwise("runtime_error")
    )
    lines = F.filter(F.split(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\r\n|\n|\r"), lambda l: F.trim(l) != "")
    msg = F.substring(F.coalesce(F.try_element_at(lines, F.lit(-1)), s), 1, 500)
    return F.when(s.startswith("Execution failed"), F.struct(kind.alias("type"), msg.alias("message")))


def action_activity(code, error_type) -> Column:
    """Activity label of a step: first API call, or a fallback, with ok/err status."""
    code = F.coalesce(_c(code), F.lit(""))
    first = F.try_element_at(api_calls(code), F.lit(1))
    base = F.coalesce(first, F.when(code != "", F.lit("python.no_api")).otherwise(F.lit("none.no_code")))
    return F.concat(base, F.when(_c(error_type).isNotNull(), "|err").otherwise("|ok"))


# Words of a task text that imply an app.
APP_KEYWORDS = {
    "spotify": ["spotify", "song", "playlist", "album", "artist", "music"],
    "venmo": ["venmo", "pay ", "payment", "money", "owe", "rent"],
    "gmail": ["gmail", "email", "e-mail", "mail", "inbox"],
    "amazon": ["amazon", "order", "product", "cart", "purchase", "return"],
    "splitwise": ["splitwise", "split", "expense", "bill"],
    "todoist": ["todoist", "todo", "task list", "to-do", "project"],
    "phone": ["phone", "contact", "text message", "sms", "alarm", "message"],
    "file_system": ["file", "folder", "directory"],
    "simple_note": ["note", "notes"],
}


def implied_apps(text, published: list[str] | None = None) -> Column:
    """Apps whose keywords occur in a text, limited to the published ones; one pass over the text, no join."""
    low = F.lower(_c(text))
    out = []
    for app, words in APP_KEYWORDS.items():
        if published is None or app in published:
            hit = low.contains(words[0])
            for w in words[1:]:
                hit = hit | low.contains(w)
            out.append(F.when(hit, F.lit(app)))
    return F.filter(F.array(*out), lambda a: a.isNotNull())
