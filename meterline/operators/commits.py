"""Commit lane: pair tool calls (J10), attribute commits (J11), append
unique commit events (K3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import sha256_prefix

# Git subcommands that can create a commit, global git options
# that take a value, and shell separators ending one command.
COMMIT_SUBCOMMANDS = {"am", "cherry-pick", "commit", "merge", "pull", "rebase", "revert"}
GIT_OPTIONS_WITH_VALUE = {"-C", "-c", "--config-env", "--exec-path", "--git-dir",
                          "--namespace", "--super-prefix", "--work-tree"}
SEPARATORS = {"&&", "||", ";", "|"}
CLOCK_TOLERANCE = 5          # seconds around a call's window
STATE_MAX_AGE = 86_400       # a pre-call snapshot older than this expires


def _verb_test():
    """Test of one shell text, as a closure over plain values, so that it
    ships to Python workers by value.

    The shell words are cut at separators into simple commands; each is joined
    by NUL and searched for a word ``git`` whose first word after options is
    one of the verbs.
    """
    import re
    import shlex
    from itertools import groupby

    valued = "|".join(map(re.escape, sorted(GIT_OPTIONS_WITH_VALUE)))
    option = f"\0(?>(?:{valued})\0[^\0]*|-[^\0]*)"
    verbs = "|".join(map(re.escape, sorted(COMMIT_SUBCOMMANDS)))
    git = re.compile(f"(?:^|[\0/])git(?:{option})*+\0(?:{verbs})(?:\0|$)").search
    separators = frozenset(SEPARATORS)

    def words_of(text):
        try:
            return shlex.split(text, comments=True)
        except ValueError:  # an unclosed quote: plain words
            return re.sub("&&|;", " ", text).split()

    def runs_verb(command):
        parts = groupby(words_of(command or ""), separators.__contains__)
        return any(git("\0".join(words)) for apart, words in parts if not apart)

    return runs_verb


may_create_commit = _verb_test()


def commit_verb(commands):
    """Arrow-batched filter column: does the shell text run a git verb that
    can create a commit? (Small per-row helper: shell word splitting.)"""
    check = _verb_test()

    @F.pandas_udf(T.BooleanType())
    def _verb(s: pd.Series) -> pd.Series:
        return s.map(check).astype(bool)

    return _verb(commands)


def pair_tool_calls(tool_calls: DataFrame, verb: Column | None = None) -> DataFrame:
    """Match PreToolUse and PostToolUse rows of one Bash invocation.

    The invocation id is the first 24 hex digits of SHA-256 over
    (tool_use_id, turn_id, command, cwd) joined by NUL. Only commands that
    may create a commit are kept; a post without a pre is ignored and a pre
    older than a day has expired. Output: one row per completed call with
    ``started``/``ended`` (unix seconds).
    """
    calls = tool_calls.where((F.col("tool_name") == "Bash") &
                             F.col("hook_event_name").isin("PreToolUse", "PostToolUse") &
                             (F.length("command") > 0) & (F.length("cwd") > 0))
    verb = verb if verb is not None else commit_verb(F.col("command"))
    calls = calls.where(verb).withColumn(
        "invocation_id", sha256_prefix("tool_use_id", "turn_id", "command", "cwd"))
    # The hook keeps one snapshot per invocation: a pre sets it, the next post
    # takes it. A post therefore pairs with the event right before it.
    w = Window.partitionBy("invocation_id").orderBy("ts", F.col("hook_event_name") == "PostToolUse")
    before = lambda c: F.lag(c).over(w)
    paired = calls.select("invocation_id", "hook_event_name", F.col("ts").alias("ended"),
                          before("hook_event_name").alias("_event"), before("ts").alias("started"),
                          before("repo").alias("repo"), before("session_id").alias("session_id"))
    paired = paired.where((F.col("hook_event_name") == "PostToolUse") & (F.col("_event") == "PreToolUse"))
    return paired.where(F.col("ended") - F.col("started") <= STATE_MAX_AGE).select(
        "invocation_id", "started", "repo", "session_id", "ended")


def attribute_commits(calls: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits of a repository a call touched, made while it ran: from
    its pre snapshot to its end, plus the clock tolerance at either side. A
    call that started after another one claiming the commit had ended knew
    the commit before and does not get it.

    Range join without a hot-key problem: calls last at most a day, so each
    call is expanded to the hours its window touches (at most 26) and the
    join key is (repo, hour); a repository with a third of all commits is
    split by hour across tasks.
    """
    hour = 3600
    since, until = F.col("started") - CLOCK_TOLERANCE, F.col("ended") + CLOCK_TOLERANCE
    c = calls.withColumn("_h", F.explode(F.sequence(F.floor(since / hour), F.floor(until / hour))))
    m = commits.withColumn("_h", F.floor(F.col("committed_at") / hour))
    j = c.join(m, ["repo", "_h"], "inner").where(F.col("committed_at").between(since, until))
    first = F.min("ended").over(Window.partitionBy("repo", "sha"))
    j = j.withColumn("_first", first).where(F.col("started") <= F.col("_first"))
    return j.select("invocation_id", "repo", "sha", "committed_at", "started", "ended")


def append_commit_events(existing: DataFrame, new: DataFrame) -> DataFrame:
    """K3: rows of ``new`` (dedupe_id, order) whose id the log does not hold
    yet, each once with its first order. Any string id of the log counts."""
    fresh = new.groupBy("dedupe_id").agg(F.min("order").alias("order"))
    return (fresh.join(existing.select("dedupe_id").distinct(), "dedupe_id", "left_anti")
            .select("dedupe_id", F.lit("codex.git.commit").alias("event"), "order"))
