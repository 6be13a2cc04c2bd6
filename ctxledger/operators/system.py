"""System prompts: dynamic parts, environment fields, static tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxledger.functions import text as X

#: Tags whose content changes between requests, and tags known to be static.
DYNAMIC = ("env", "context", "git_status", "directoryStructure", "system-reminder", "total_tokens")
KNOWN = (
    "types", "skill", "name", "description", "location", "available_references", "example", "available_skills", "examples", "rules", "task", "codeSearchInstructions",
    "codeSearchToolUseInstructions", "communicationGuidelines", "gptAgentInstructions", "outputFormatting", "structuredWorkflow", "toolUseInstructions",
)
_DYNAMIC = r"(?s)<(" + "|".join(DYNAMIC) + r")(\s[^>]*)?>.*?</\1>"
#: The labels of an environment block, lower-cased, and the fields they fill.
LABELS = {"working directory": "cwd", "is directory a git repo": "git_repo", "platform": "platform", "os version": "os_version", "today's date": "today", "todays date": "today", "branch": "branch", "current branch": "current_branch"}
_ON_BRANCH = "on branch "


def dynamic_blocks(s: Column) -> Column:
    """The dynamic tagged blocks of a system text, in order."""
    return F.regexp_extract_all(s, F.lit(_DYNAMIC), F.lit(0))


def dynamic_text(s: Column) -> Column:
    """All that changes between requests: the dynamic blocks and the environment section, by line feeds."""
    return F.array_join(F.filter(F.concat(dynamic_blocks(s), F.array(X.env_section(s))), lambda x: x != ""), "\n")


def static_text(s: Column) -> Column:
    """What remains without billing line, environment section and dynamic blocks, newlines collapsed."""
    return F.trim(X.collapse_newlines(F.regexp_replace(X.strip_env_section(X.strip_billing_line(s)), _DYNAMIC, "")))


def env_body(s: Column) -> Column:
    """What the first environment tag of a dynamic text holds, or ''."""
    return F.regexp_extract(s, r"(?s)<env(?:\s[^>]*)?>(.*?)</env>", 1)


def env_fields(s: Column) -> Column:
    """struct of cwd, git_repo, branch, platform, os_version, today; null where absent.

    The body of the environment tag is read line by line as ``label: value``; of a repeated label
    the first line with a value counts. The branch is looked for in the whole dynamic text: it may
    also stand in a line ``On branch name``, and ``Current branch`` serves where neither names one.
    """

    def pair(row: Column) -> Column:
        on = F.lower(row).startswith(_ON_BRANCH)
        at = F.instr(row, ":")
        label = F.when(on, "branch").when(at > 1, F.lower(F.rtrim(F.substring(row, F.lit(1), at - 1))))
        value = F.when(on, F.substring(row, F.lit(len(_ON_BRANCH) + 1), F.length(row))).otherwise(F.substring(row, at + 1, F.length(row)))
        return F.struct(label.alias("label"), F.btrim(value, F.lit(" \t")).alias("value"))

    def pairs(text: Column) -> Column:
        rows = F.transform(X.lines(text), lambda x: F.btrim(x, F.lit(" \t\r\f\x0b")))
        return F.filter(F.transform(rows, pair), lambda p: p["label"].isin(*LABELS) & (p["value"] != ""))

    def word(value: Column) -> Column:
        return F.substring_index(F.translate(value, "\t", " "), " ", 1)

    def fields(env: Column, whole: Column) -> Column:
        def found(source: Column, field: str, good=lambda v: F.lit(True)) -> Column:
            mine = F.filter(source, lambda p: p["label"].isin(*(x for x, f in LABELS.items() if f == field)) & good(p["value"]))
            return F.get(mine, 0)["value"]

        answer = F.substring(found(env, "git_repo", lambda v: F.lower(F.regexp_extract(v, "^[A-Za-z0-9_]+", 0)).isin("yes", "no")), 1, 3)
        return F.struct(
            found(env, "cwd").alias("cwd"), F.btrim(F.translate(answer, ",.;", "   ")).alias("git_repo"), found(env, "platform").alias("platform"), found(env, "os_version").alias("os_version"),
            found(env, "today").alias("today"), F.coalesce(word(found(whole, "branch")), word(found(whole, "current_branch"))).alias("branch"),
        )

    return X.bound(F.struct(pairs(env_body(s)).alias("env"), pairs(s).alias("whole")), lambda p: fields(p["env"], p["whole"]))


def unknown_tags(s: Column) -> Column:
    """Names of tags that are neither dynamic nor known, 64 bytes at most, each once, in order of appearance."""
    names = F.array_distinct(F.transform(X.static_tags(s), lambda t: t["tag"]))
    short = F.filter(names, lambda n: F.octet_length(n) <= 64)
    return F.array_except(short, F.array(*(F.lit(n) for n in (*DYNAMIC, *KNOWN))))
