"""The pattern table and its spellings for Spark (Java), DuckDB (RE2) and Python.

Patterns are kept in RE2 notation. Java differs in what white space, word boundaries, line ends and the dot are, so a
pattern is never used as it stands: java(), re2() and python() spell it out for one engine.
"""

from __future__ import annotations

import re

# Patterns that classification and reduction results depend on.
P = {
    "diff_header": r"^(diff --git|@@|index [0-9a-f]+\.\.|[+-]{3} [ab]/)",
    "diff_change": r"^[+-]",
    "diff_stat": r"(?m)^\s*\d+ files? changed",
    "markup_lead": r"(?i)^<(\?xml|!doctype|svg|html|head|body|rss|feed)\b",
    "html_tag": r"(?i)</?(div|span|p|a|ul|ol|li|table|tr|td|th|h[1-6]|br|img|script|style|head|body|html|meta|link|form|input|button|nav|section|article|footer|header)\b",
    "search_line": r"^(?:[A-Za-z]:)?[\w.\\/\-]+\.\w+:\d+:",
    "log_level": r"^.{0,48}\b(ERROR|WARN(ING)?|INFO|FATAL|DEBUG|TRACE|PANIC|SEVERE|CRITICAL|NOTICE|ALERT)\b|(?i)\blevel[\"':=]+\s*\"?(error|warn(ing)?|info|fatal|debug|trace|panic|critical|notice)\b|(?i)^\s*(error|warning|fatal|panic|severe|critical)\s*:",
    "log_color_level": r"\x1b\[[0-9;]*m(ERROR|WARN(ING)?|INFO|FATAL|DEBUG|TRACE|PANIC|SEVERE|CRITICAL)\b",
    "log_cli": r"(?i)^\s*(npm|yarn|pnpm|pip|gem|cargo|apt|brew|docker|kubectl|systemd)\s+(error|warn(ing)?|info|notice|verbose|silly|debug)\b",
    "log_build": r"^(--- )?(FAIL|PASS|SKIP|FAILED|PASSED)\b|^ok\s+[\w./\-]+\s+([\d.]+m?s|\(cached\))\s*$|(?i)\b\d+\s+(passed|failed|skipped|errors?)\b|(?i)^\s*[\w.]*(exception|error):\s",
    "log_shape": r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b|^[IWEF]\d{4}\s+\d{2}:\d{2}:\d{2}|^\s*(\w+=\S+\s+){2,}",
    "log_definite": r"(?i)(^panic:|^traceback \(most recent call last\):|^\s*goroutine\s+\d+\s+\[)",
    "log_stack": r"(?i)(^panic:|^traceback|^\s+at\s|^\s*file \".*\", line \d+|^\s*goroutine\s|\+0x[0-9a-f]+|^\s*[\w./$\-]+\.(go|py|js|java|rb|rs|ts):\d+)",
    "log_time": r"^\s*\[?(\d{4}-\d{2}-\d{2}|\d{2}:\d{2}:\d{2})",
    "md_table": r"(?m)^\s*\|.*\|\s*$",
    "md_sep": r"(?m)^\s*\|?[ :|]*-{2,}[-: |]*$",
    "pipe_sep": r"(?m)^\s*[:|+-]{2,}[-+|:\s]*$",
    "col_gap": r" {2,}",
    "ansi": r"\x1b\][\s\S]*?(?:\x07|\x1b\\)|\x1b[PX^_][\s\S]*?\x1b\\|\x1b\[[0-9;:<=>?]*[ -/]*[@-~]|\x1b\[[0-9;:<=>?]*[ -/]*$|\x1b[ -/][0-~]|\x1b[<-~]",
    "code_keyword": r"(?m)^\s*(func |def |class |import |package |return |const |let |var |public |private |if \(|for \(|while \(|}\s*$|{\s*$)",
    "code_call": r"^\s*[\w.\[\]]+\s*=\s*[\w.]+\s*\(|^\s*[\w.]+\([^)]*\)\s*;?\s*$",
    "code_snippet": r"^\s*from\s+[.\w]+\s+import\b|^\s*(try|except|finally|elif|else|with|for|while|if)\b[^\n]*:\s*$|^\s*@\w|^\s*(pass|raise|return|yield)\b|^\s*[\w.\[\]]+\s*[+\-*/|&]?=\s*\S",
    "line_numbered": r"^\s*\d+\t",
    "md_heading": r"^#{1,6}\s\S",
    "assign_line": r"^\s*[A-Za-z_][A-Za-z0-9_]*\s*:?=",
    "kv_line": r"^\s*(-\s+)?[A-Za-z_][\w.-]*:(\s|$)",
    "docker_directive": r"^\s*(FROM|RUN|COPY|ADD|ENV|ARG|WORKDIR|EXPOSE|ENTRYPOINT|CMD|USER|VOLUME|LABEL|HEALTHCHECK|ONBUILD|STOPSIGNAL|SHELL)\s",
    "gate_markup": r"(?i)^\s*<(\?xml|!doctype|html|svg|[a-zA-Z][\w:-]*[\s/>])",
    "json_shape": r"^[{\[]\s*[\"{\[]",
    "code_fence": r"```",
    "diff_sig": r"(?m)^(@@ |diff --git |index [0-9a-f]+\.\.|[+\-]{3} [ab]/)",
    "shell": r"(?m)^\s*(\$ |sudo |npm |pip |go (run|build|test|mod)|git |make |cd |ls |cat |grep |docker |kubectl )",
    "path_ext": r"[\w./\-]+\.(go|py|ts|tsx|js|jsx|java|rs|c|cpp|h|hpp|rb|php|sh|sql|yaml|yml|json|toml|proto|css|html)\b",
    "code_syntax": r"(?m)(^\s*(func |def |class |import |package |from \w+ import|const |let |var |public |private |return |if \(|for \(|while \()|[{};]\s*$|=>|::|\bself\.|\b#include\b)",
    "js_assign": r"(?m)^\s*(const|let|var)\s+[\w$]+\s*=",
    "jsx": r"(=\{\{|style=\{|className=|</[A-Za-z]|<[A-Za-z]\w*\s+\w+=)",
    "gate_grep": r"^[\w.\\/\-]+:\d+:",
    "re_error": r"(?i)\b(error|fatal|panic|exception)\b",
    "re_fail": r"(?i)\b(fail(ed|ure)?)\b",
    "re_warn": r"(?i)\b(warn(ing)?)\b",
    "re_info": r"(?i)\b(info|notice)\b",
    "re_debug": r"(?i)\b(debug)\b",
    "re_trace": r"(?i)\b(trace)\b",
    "re_stack": r"(?i)(^\s+at\s|^\s+file \"|^\s*goroutine\s|^\s+\.\.\.|^\s+[\w./$-]+\.(go|py|js|java|rb|rs):\d+|^traceback|^panic:)",
    "re_summary": r"(?i)(\b\d+\s+(passed|failed|error|errors|warning|warnings|tests?|skipped)\b|tests?\s+run|test\s+summary|^=+$|^-{3,}\s|build (succeeded|failed|successful)|\bsummary\b|\d+\s+of\s+\d+)",
    "frame_call": r"^\s*[\w./$<>*-]+\([^)]*\)\s*$",
    "frame_file": r"(?i)[\w./\-]+\.(go|py|js|java|rb|rs|ts|c|cpp|cc):\d+",
    "blank_run": r"\n[ \t]*(\n[ \t]*){2,}",
    "tab_sep": r"^[\s|:+-]*[-+][\s|:+-]*$",
    "tab_pipe": r"\s*\|\s*",
    "md_fence_open": r"^ {0,3}(`{3,}|~{3,})",
    "md_setext": r"^ {0,3}(=+|-{2,})\s*$",
    "md_thematic": r"^ {0,3}(-( *-){2,}|\*( *\*){2,}|_( *_){2,}) *$",
    "md_list": r"^ {0,3}([*+-]|\d{1,9}[.)])\s",
    "md_quote": r"^ {0,3}>",
    "md_link_def": r"^ {0,3}\[[^\]]+\]:\s",
    "md_html": r"^ {0,3}<",
    "md_image": r"^ {0,3}!\[",
    "md_indent": r"^( {4,}|\t)\S",
}

SPACES = r"\t\n\f\r "
_PART = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?[a-zA-Z]+\)|.", re.S)


def _spelled(pattern: str, boundary: str, end: str, start: str, dot: str) -> str:
    out = []
    for part in _PART.findall(pattern):
        if part == r"[\s\S]":
            out.append(r"(?s:.)")
        elif part.startswith("[") and len(part) > 1:
            out.append(part.replace(r"\s", SPACES).replace("[", r"\[").replace(r"\[", "[", 1).replace(r"\\[", r"\["))
        else:
            out.append({r"\s": f"[{SPACES}]", r"\S": f"[^{SPACES}]", r"\b": boundary, "$": end, "^": start, ".": dot, "{": "{", "}": "}"}.get(part, part))
    return "".join(out)


_BRACE = re.compile(r"(?<!\\)\{(?!\d+(,\d*)?\})|(?<!\\)(?<!\d)(?<!,)\}")


def _braces(pattern: str) -> str:
    """Escapes braces that aren't repeat counts and don't stand in a class."""
    return "".join(p if p.startswith("[") else p for p in _PART.findall(re.sub(r"(?<![\\\[{])\{(?!\d)", r"\\{", re.sub(r"(?<![\\\d,{};\[])\}", r"\\}", pattern))))


def java(name: str) -> str:
    """For Spark's rlike and regexp functions."""
    pattern = P[name]
    lines = pattern.startswith("(?m)")
    word = "[A-Za-z0-9_]"
    return _spelled(_braces(pattern[4:] if lines else pattern), f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))", r"(?=\n|\z)" if lines else r"\z", r"(?:(?<=\n)|\A)" if lines else "^", r"[^\n]")


def re2(name: str) -> str:
    """For DuckDB's regexp functions."""
    return _spelled(_braces(P[name]), r"\b", "$", "^", r"[^\n]")


def python(name: str) -> re.Pattern:
    pattern = P[name]
    lines = pattern.startswith("(?m)")
    word = "[A-Za-z0-9_]"
    text = _spelled(_braces(pattern[4:] if lines else pattern), f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))", r"(?=\n|\Z)" if lines else r"\Z", r"(?:(?<=\n)|\A)" if lines else "^", r"[^\n]")
    flags = re.ASCII
    if "(?i)" in text:
        flags |= re.I if text.startswith("(?i)") else 0
        text = text.replace("(?i)", "", 1) if text.startswith("(?i)") else text
    return re.compile(text, flags)


def sql(name: str) -> str:
    """The RE2 spelling as a SQL string literal."""
    return "'" + re2(name).replace("'", "''") + "'"
