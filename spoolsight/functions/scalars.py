"""Scalar functions of the data model, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data contract: bounds in bytes.
TITLE_BYTES, EXCERPT_BYTES, EDIT_BYTES, DETAIL_BYTES, ARTIFACT_BYTES = 200, 400, 16 * 1024, 400, 1 << 20
TRUNCATED = "\n[truncated]"
# Which kind of tool a name stands for, by agent.
TOOL_KIND_BY_NAME = {
    "claude": {
        "shell": "Bash BashOutput", "file_read": "Read NotebookRead", "file_write": "Write", "file_edit": "Edit MultiEdit NotebookEdit",
        "search": "Grep", "discovery": "Glob LS", "subagent": "Task Agent", "web": "WebFetch WebSearch",
    },
    "codex": {
        "shell": "shell local_shell exec_command shell_command", "file_edit": "apply_patch", "file_read": "read_file view_image",
        "web": "web_search", "script": "exec",
    },
    "pi": {
        "shell": "bash", "file_read": "read", "file_write": "write", "file_edit": "edit multi_edit", "search": "grep search",
        "discovery": "find ls glob", "web": "web_search web_fetch fetch", "script": "codemode",
    },
    "opencode": {
        "shell": "bash", "file_read": "read", "file_write": "write", "file_edit": "edit patch", "search": "grep",
        "discovery": "glob list", "subagent": "task agent", "web": "webfetch",
    },
}
# Phrases of error messages, the first group that matches names the class.
ERROR_CLASSES = [
    ("rate_limit", ["rate limit", "usage limit", "quota"]),
    ("invalid_request", ["context window", "context_length"]),
    ("authentication_failed", ["oauth", "unauthorized", "api key", "authentication"]),
    ("connection", ["socket", "connection", "fetch failed", "unable to connect", "timed out"]),
    ("server_error", ["overloaded", "server error", "internal error", "service unavailable"]),
]


def truncate_bytes(s: Column, n: int, marker: str = "") -> Column:
    """At most ``n`` bytes of UTF-8, cut between characters; ``marker`` follows where something was cut."""
    raw = F.encode(s, "UTF-8")
    text = None
    for cut in range(n, max(n - 4, -1), -1):
        prefix = F.substring(raw, 1, cut)
        part = F.try_validate_utf8(prefix.cast("string"))
        text = part if text is None else F.coalesce(text, part)
    return F.when(F.octet_length(s) <= n, s).otherwise(F.concat(text, F.lit(marker)))


def diff_line_counts(lines: Column) -> Column:
    """Added and removed lines of an array of diff lines, file headers left out."""
    counted = F.filter(lines, lambda x: ~(x.startswith("+++ ") | x.startswith("--- ") | x.startswith("*** ")))
    size = lambda sign: F.size(F.filter(counted, lambda x: x.startswith(sign))).cast("bigint")
    return F.struct(size("+").alias("added"), size("-").alias("removed"))


def text_line_count(s: Column) -> Column:
    """Lines of a text; a last line without line end counts."""
    ends = F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    return F.when(s == "", 0).otherwise(ends + F.when(s.endswith("\n"), 0).otherwise(1)).cast("bigint")


def canonical_path(s: Column) -> Column:
    """Trimmed path without ``//``, ``.``, ``..`` and a last ``/``; empty for empty text and for the current directory."""
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    rooted = s.startswith("/")
    parts = F.filter(F.split(s, "/"), lambda p: (p != "") & (p != "."))
    push = lambda acc, p: F.concat(acc, F.array(p))
    # a ".." lies at the bottom, so that there always is a last element to look at
    step = lambda acc, p: F.when(p != "..", push(acc, p)).when(F.element_at(acc, -1) != "..", F.slice(acc, 1, F.size(acc) - 1)).when(rooted, acc).otherwise(push(acc, p))
    guarded = F.aggregate(parts, F.array(F.lit("..")), step)
    joined = F.array_join(F.slice(guarded, 2, F.size(guarded)), "/")
    return F.when(s == "", "").when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)


def path_name(canonical: Column) -> Column:
    """Last segment of a canonical path; a bare root names itself."""
    last = F.substring_index(canonical, "/", -1)
    return F.when(last == "", canonical).otherwise(last)


def resolve_path(path: Column, cwd: Column) -> Column:
    """A relative path against a working directory."""
    return F.when(path.startswith("/") | (cwd == ""), path).otherwise(F.concat(F.regexp_replace(cwd, "/+$", ""), F.lit("/"), path))


def tool_kind(agent: Column, name: Column) -> Column:
    """Kind of a tool by agent and name; unknown names are ``other``."""
    pairs = [x for a, kinds in TOOL_KIND_BY_NAME.items() for kind, names in kinds.items() for n in names.split() for x in (F.lit(f"{a}\x1f{n}"), F.lit(kind))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat(agent, F.lit("\x1f"), name)), F.lit("other"))


def command_line(arguments: Column) -> Column:
    """Command of a shell call's JSON arguments: ``cmd``, or ``command`` as a string or an argument list, of which a shell with
    its script unwraps to the script."""
    cmd = F.get_json_object(arguments, "$.cmd")
    raw = F.get_json_object(arguments, "$.command")
    argv = F.from_json(raw, "array<string>")
    unwrapped = F.when((F.size(argv) == 3) & F.get(argv, F.lit(1)).rlike("^-.*c"), F.get(argv, F.lit(2))).otherwise(F.array_join(argv, " "))
    return F.coalesce(F.nullif(cmd, F.lit("")), F.when(raw.startswith("["), unwrapped).otherwise(raw), F.lit(""))


def first_patched_file(patch: Column) -> Column:
    """First file that a patch names."""
    return F.regexp_extract(patch, r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+?)\s*$", 1)


def error_class(message: Column) -> Column:
    """Class of an error message."""
    low, out = F.lower(message), None
    for name, phrases in ERROR_CLASSES:
        hit = None
        for p in phrases:
            hit = low.contains(p) if hit is None else hit | low.contains(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("error")


def content_text(content: Column) -> Column:
    """Text of JSON content that is a string, or an array whose text blocks are joined by line ends."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b.type == "text") & (b.text != "")), lambda b: b.text)
    string = F.from_json(F.concat(F.lit('{"s":'), content, F.lit("}")), "s string").s
    return F.when(F.ltrim(content).startswith("["), F.array_join(texts, "\n")).when(F.ltrim(content).startswith('"'), string).otherwise("")


def joined_thinking(parts: Column) -> Column:
    """Thinking texts stripped, blanks dropped, joined by an empty line."""
    return F.array_join(F.transform(F.filter(parts, lambda x: x.rlike(r"\S")), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n\n")


def plan_key(s: Column) -> Column:
    """A plan's text without outer white space and blanks at line ends; null if nothing is left."""
    inner = F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.nullif(F.regexp_replace(inner, r"[ \t\r]+(?=\n)", ""), F.lit(""))


def memory_path_tail(path: Column) -> Column:
    """``/projects/...`` of a path to a memory file; null for others."""
    tail = F.concat(F.lit("/projects/"), F.substring_index(path, "/projects/", -1))
    return F.when(path.contains("/projects/") & tail.contains("/memory/"), tail)


def project_dir(name: Column) -> Column:
    """Path that a project folder's name stands for; dashes of the real path are lost."""
    return F.replace(F.replace(name, F.lit("--"), F.lit("/.")), F.lit("-"), F.lit("/"))


def zsh_escaped(s: Column) -> Column:
    """Line ends of a command for an extended zsh history: two backslashes before each, one after an empty line."""
    lines = F.split(s, "\n", -1)
    heads = F.transform(F.slice(lines, 1, F.size(lines) - 1), lambda x: F.concat(x, F.when(x == "", "\\").otherwise("\\\\")))
    return F.array_join(F.concat(heads, F.slice(lines, -1, 1)), "\n")


def fish_escaped(s: Column) -> Column:
    """Backslashes doubled, line ends as ``\\n``."""
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def usd(nanos: Column) -> Column:
    """Dollars as a double, for display only."""
    return nanos.cast("double") / F.lit(1e9)


def usd_exact(nanos: Column) -> Column:
    """Dollars as exact decimal text without trailing zeros."""
    text = (nanos.cast("decimal(19,0)") / F.lit(10**9).cast("decimal(10,0)")).cast("decimal(28,9)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def parse_time(s: Column) -> Column:
    """RFC 3339 time or date; null if it is neither."""
    return F.try_to_timestamp(s)


def from_millis(ms: Column) -> Column:
    """Time of milliseconds since the epoch; 0 and null are unknown."""
    return F.timestamp_millis(F.nullif(ms, F.lit(0).cast("bigint")))


def day_of(at: Column) -> Column:
    """Day as text; unknown is the empty day, which stays a group of its own."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit(""))


def query_terms(q: str) -> list[str]:
    """Terms of a search, which are literal words or phrases; there are no operators."""
    return q.split()


def redacted(secret: Column, shown: int = 4) -> Column:
    """First characters of a secret, the rest starred."""
    return F.concat(F.left(secret, F.least(F.lit(shown), (F.length(secret) / 2).cast("int"))), F.lit("***"))


def ignore_keys(rule: Column, natural_key: Column, secret: Column) -> Column:
    """Keys under which a finding may be ignored: this finding, or the rule in this entity whatever the match."""
    return F.array(F.concat_ws("|", rule, natural_key, secret), F.concat_ws("|", rule, natural_key, F.lit("*")))


def json_pointer(doc: Column, pointer: Column) -> Column:
    """Value in a JSON text that a pointer (RFC 6901) leads to, as a VARIANT; null if a step is missing or the text is no JSON. Steps
    are keys of objects, whatever characters they hold, or indexes of arrays without leading zeros; ``~1`` stands for a
    slash and ``~0`` for a tilde. The empty pointer is the whole text. The pointer may differ from row to row."""
    steps = F.transform(F.slice(F.split(pointer, "/", -1), 2, 1 << 20), lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))

    def down(value: Column, step: Column) -> Column:
        inside = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), step)
        place = F.when(step.rlike("^(0|[1-9][0-9]{0,8})$"), step.try_cast("int"))
        return F.coalesce(inside, F.get(F.try_variant_get(value, "$", "array<variant>"), place))

    led = F.aggregate(steps, F.try_parse_json(doc), down)
    return F.when((pointer == "") | pointer.startswith("/"), led)
