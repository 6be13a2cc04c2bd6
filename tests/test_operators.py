"""Literal cases and naive folds for single operators."""

import random

import pytest
from pyspark.sql import functions as F

from ctxledger.functions import geometry as G
from ctxledger.functions import layout, tokens
from ctxledger.functions import text as X
from ctxledger.operators import blocks, facts, history, paging, pairs, pins, profiles, sessions, system, tools, usage


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column.alias("v")).first()["v"]


S = F.col("s")


@pytest.mark.parametrize("text,column,expect", [
    ("ab\n\n😀c", X.visual_rows(S, 2), 4), ("ab\n\n😀c", X.u16len(S), 7), ("", X.visual_rows(S, 2), 1), ("a🚀é", X.u16len(S), 4),
    ("a🚀é", X.u16slice(S, 0, 2), "a"), ("a🚀é", X.u16slice(S, 1, 3), "🚀"), ("a🚀é", X.u16slice(S, 2, 4), "é"),
    ("x \t\n\n\n\ny  ", X.compact_whitespace(S), "x\n\ny"), ("a\n\n\n\n\nb", X.minify(S), "a\n\n\nb"), ("a\nb", X.reflow(S), "a↵b"), ("a↵b", X.reflow(S), None), ("a↵b", X.neutralize(S), "a⏎b"), ("a↵b", X.dereflow(S), "a\nb"),
    ("hello world", X.piece_count(S), 2), ("const x = foo(bar, 42); // baz", X.piece_count(S), 11), ("", X.piece_count(S), 0),
    ('{"a":1}', X.classify_content(S), "structured"), ("[1,2]", X.classify_content(S), "structured"), ("--- a/x", X.classify_content(S), "structured"), ("INFO a\nb\nc\nWARN d", X.classify_content(S), "log"), ("a\nb\nc\nd", X.classify_content(S), "other"),
    ("QUJDRA==", X.b64_bytes(S), 4), (" a   b\n", X.collapse_ws(S), "a b"), ("<a>x <b>y</b></a><c>z</c>", F.array_join(F.transform(X.static_tags(S), lambda t: t["tag"]), ","), "a,c"),
    ("/openrouter/v1/chat/completions", profiles.protocol_of(S), "chat"), ("/v1/messages", profiles.protocol_of(S), "messages"), ("/v1/messages/count_tokens", profiles.protocol_of(S), "none"), ("/v1/responses", profiles.protocol_of(S), "responses"),
    ("gemini-3.6-pro", profiles.is_misresolved(S), True), ("x-ai/grok-4", profiles.is_misresolved(S), False), ("gpt-5.6-sol[1m]", profiles.normalize_model(S), "gpt-5.6-sol"),
    ("vendor/gpt-5-mini", profiles.model_allowed(S, ("gpt-5",)), True), ("gpt-55", profiles.model_allowed(S, ("gpt-5",)), False), ("gemini-3.6-pro", profiles.model_allowed(S, ("*",)), False),
    ("below_min_chars (14 < 2000)", usage.outcome_reason(S), "below_min_chars"), ("", usage.outcome_reason(S), "applied"),
    ("foo@bar.com", facts.priority_tier(S), 0), ("https://x.y", facts.priority_tier(S), 2), ("plain", facts.priority_tier(S), 1), ("getUserName", facts.priority_tier(S), 0), ("1234567", facts.priority_tier(S), 0),
    ('{"cache_control": {"a":1}, "t":"\\"cache_control\\":{}", "cache_control": null}', blocks.cache_markers(S), 1),
])
def test_scalars(spark, text, column, expect):
    assert value(spark, text, column) == expect


@pytest.mark.parametrize("model,w,h,expect", [("gpt-5.6-sol", 768, 1932, 1464), ("gpt-5.6-mini", 768, 1932, 2372), ("gpt-5", 2048, 2048, 630), ("gemini-3.6-flash", 1568, 728, 1078), ("gemini-3.6-flash", 10, 10, 1120), ("grok-4", 764, 512, 392)])
def test_vision_tokens(spark, model, w, h, expect):
    df = profiles.resolve_profile(spark.createDataFrame([(model, w, h)], "model string, w int, h int"))
    assert df.select(G.vision_tokens(F.col("profile"), F.col("w"), F.col("h"))).first()[0] == expect


def brute_resize(w, h, edge, most):
    def patches(a, b):
        return -(-a // 28) * -(-b // 28)

    def fits(a, b):
        return -(-a // 28) * 28 <= edge and -(-b // 28) * 28 <= edge and patches(a, b) <= most

    if fits(w, h):
        return patches(w, h)
    big, small = max(w, h), min(w, h)
    best = 1
    lo, hi = 1, big
    while lo <= hi:
        mid = (lo + hi) // 2
        if fits(mid, max(1, int(mid * (small / big) + 0.5))):
            best, lo = mid, mid + 1
        else:
            hi = mid - 1
    return patches(best, max(1, int(best * (small / big) + 0.5)))


def test_tier_resize(spark):
    rng = random.Random(1)
    rows = [(rng.choice(list(G.TIERS)), rng.randint(1, 6000), rng.randint(1, 6000)) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, w int, h int")
    got = df.select("t", "w", "h", G.patch28_tokens(F.col("t"), F.col("w"), F.col("h")).alias("n")).collect()
    assert all(r["n"] == brute_resize(r["w"], r["h"], *G.TIERS[r["t"]]) for r in got)


def test_gates(spark):
    df = spark.createDataFrame([(100.0, 90.0)], "i double, t double")
    i, t = F.col("i"), F.col("t")
    row = df.select(G.profitable(i, t).alias("a"), G.profitable(i, t, None, F.lit(100.0)).alias("b"), G.profitable_amortized(i, t * 20, 10).alias("c"), G.estimate_pages(F.lit(201), F.lit(9), F.lit(10), 100, F.lit(4)).alias("d")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (False, True, True, 3)


def test_profile_overrides(spark):
    raw = '{"my-": {"strip_cols": 99}, "my-big": {"max_height": 11}, "gpt-5": {"strip_cols": 5}}'
    df = profiles.resolve_profile(spark.createDataFrame([("my-x",), ("my-bigger",), ("v/gpt-5.4",)], "model string"), "model", raw)
    got = {r["model"]: r["profile"] for r in df.collect()}
    assert (got["my-x"]["strip_cols"], got["my-bigger"]["max_height"], got["v/gpt-5.4"]["strip_cols"]) == (99, 11, 5)
    assert profiles.overrides("{bad") == []


def items(spark, rows):
    return spark.createDataFrame([("r", i, t, c, "x") for i, (t, c) in enumerate(rows)], "request_id string, idx long, type string, call_id string, text string")


def test_pair_state_literal(spark):
    c, o = pairs.CALL, pairs.OUTPUT
    rows = [(c, "duplicate"), (c, "duplicate"), (o, "duplicate"), (c, "open"), (o, "orphan"), (c, None)]
    got = pairs.pair_state(items(spark, rows), 0).first()
    assert (got["completed_pairs"], got["open_calls"], got["orphan_outputs"], got["malformed_items"]) == (0, 1, 1, 4)


def naive_rounds(rows):
    """Scan: runs of adjacent paired calls, then the longest suffix whose outputs follow at once."""
    at = {}
    for i, (t, c) in enumerate(rows):
        at.setdefault(c, []).append((i, t))
    paired = {v[0][0]: v[1][0] for v in at.values() if len(v) == 2 and v[0][1] == pairs.CALL and v[1][1] == pairs.OUTPUT}
    out, i = set(), 0
    while i < len(rows):
        if i not in paired:
            i += 1
            continue
        j = i
        while j + 1 in paired:
            j += 1
        for k in range(j - i + 1, 0, -1):
            if {paired[x] for x in range(j - k + 1, j + 1)} == set(range(j + 1, j + k + 1)):
                out.add((j, k))
                break
        i = j + 1
    return out


def test_tool_rounds_equal_scan(spark):
    rng = random.Random(3)
    table, expect = [], set()
    for r in range(150):
        calls = [f"c{rng.randint(0, 5)}" for _ in range(rng.randint(1, 12))]
        rows = [(rng.choice([pairs.CALL, pairs.CALL, pairs.OUTPUT, "message"]) if rng.random() < 0.3 else (pairs.CALL if c not in calls[:i] else pairs.OUTPUT), c) for i, c in enumerate(calls)]
        rows = [(t, None if t == "message" else c) for t, c in rows]
        table += [(r, i, t, c, "") for i, (t, c) in enumerate(rows)]
        expect |= {(r, e, k) for e, k in naive_rounds([(t, c if c is not None else f"m{i}") for i, (t, c) in enumerate(rows)])}
    df = spark.createDataFrame(table, "request_id long, idx long, type string, call_id string, text string")
    assert {(x["request_id"], x["end_idx"], x["calls"]) for x in pairs.tool_rounds(df).collect()} == expect


def naive_cold(rows):
    seen, dead, observed, alive, ever, known, out = None, False, False, False, False, False, []
    for ts, kind, read in rows:
        if kind == "request":
            out.append(dead or (not (observed and alive) and ((observed and not alive and ever) or (seen is not None and ts - seen > sessions.IDLE))))
            seen, dead, known = max(ts, seen or 0), False, True
        elif kind == "rejection":
            dead = known = True
        elif known:
            observed, alive = True, read > 0
            ever = ever or alive
    return out


def test_session_cold_equals_state_machine(spark):
    rng = random.Random(4)
    table, expect = [], []
    for s in range(120):
        ts, rows = 1000, []
        for _ in range(rng.randint(1, 12)):
            ts += rng.choice([5, 100, 3000, 3630, 3631, 9000])
            rows.append((ts, rng.choice(["request", "request", "outcome", "rejection"] if rng.random() < 0.3 else ["request", "outcome"]), rng.choice([0, 0, 7])))
        table += [(s, t, i, k, r, 0) for i, (t, k, r) in enumerate(rows)]
        expect += [(s, c) for c in naive_cold(rows)]
    df = spark.createDataFrame(table, "session long, t long, seq long, kind string, cache_read long, cache_create long").withColumn("ts", F.timestamp_seconds("t"))
    got = [(r["session"], r["cold"]) for r in sessions.session_cold(df).orderBy("session", "seq").collect()]
    assert got == expect


def test_freeze_grid_equals_doubling(spark):
    """With cache markers, which split chunks, and cold histories, whose goal is one page over the whole text's."""
    rng = random.Random(5)
    table, expect = [], {}
    for c in range(120):
        n, floor = rng.randint(1, 70), 4
        costs = [(rng.randint(0, 900), rng.choice([0, 0, 0, 2500])) for _ in range(n)]
        marks, cold = [rng.random() < 0.05 for _ in range(n)], rng.random() < 0.5
        goal = min(20, max(1, -(-sum(t for t, _ in costs) // 500)) + 1) if cold else 20
        table += [(c, i, t, u, m, cold) for i, ((t, u), m) in enumerate(zip(costs, marks, strict=True))]
        step = 2
        while step < floor and step < n:
            step *= 2
        while step < n:
            cells = [costs[i : i + step] for i in range(0, n, step)]
            if sum(-(-sum(t for t, _ in x) // 500) + -(-sum(u for _, u in x) // 500) for x in cells) + sum(marks) <= goal:
                break
            step *= 2
        expect[c] = step
    df = spark.createDataFrame(table, "conv_id long, idx long, text_cost long, image_cost long, marked boolean, cold boolean")
    got = {r["conv_id"]: r["step"] for r in history.freeze_grid(df, 20, 500, base=2, floor=4).collect()}
    assert got == expect
    whole = history.freeze_grid(df, 0, 500, base=0).collect()
    assert {r["conv_id"]: r["step"] for r in whole} == {c: max(i for k, i, *_ in table if k == c) + 1 for c in expect}


def test_history_ends_closed_after_a_trim(spark):
    """History cut at a closed turn, trimmed to the budget and cut again, against a plain walk over random tool rounds."""
    from ctxledger.operators import planning

    rng = random.Random(8)
    rows, expect = [], {}
    for c in range(150):
        turns, open_ids = [], []
        for i in range(rng.randint(1, 24)):
            uses, closes = [], []
            if open_ids and rng.random() < 0.7:
                closes = [open_ids.pop()]
            elif rng.random() < 0.5:
                uses = [f"u{i}"]
                open_ids += uses
            text = rng.choice(["", "x" * rng.randint(1, 60), "y" * 2100 if rng.random() < 0.1 else "z"])
            turns.append(("assistant" if uses else "user", text, uses, closes))
        rows += [(c, i, r, t, len(u), u, k) for i, (r, t, u, k) in enumerate(turns)]

        def closed(i, turns=turns):
            held, in_round = set(), False
            for j in range(i + 1):
                _, _, u, k = turns[j]
                if not u and not held:
                    in_round = False
                held |= set(u)
                held -= set(k)
                in_round = in_round or bool(u)
            follows = i + 1 < len(turns) and turns[i + 1][2]
            return not held and not (in_round and follows)

        def last(cutoff, turns=turns, closed=closed):
            return max((i + 1 for i in range(min(cutoff, len(turns))) if closed(i)), default=0)

        def cost(i, turns=turns):
            r, t, _, _ = turns[i]
            return (len(t) + 14 + 2 * len(r) + len(str(i)) if t else 0, len(t) + 20 if r == "user" and len(t) > 2000 else 0)

        raw = len(turns) - 2
        n = last(min(raw, max(raw // 4 * 4, 3)))
        text, image = (sum(cost(i)[x] for i in range(n)) for x in (0, 1))
        reason, trimmed = ("no_closed_prefix" if not n else "prefix_too_short" if n < 3 else None), False
        if reason is None and -(-text // 100) + -(-image // 100) > 5:
            fit = 0
            while fit < n and sum(sum(cost(i)) for i in range(fit + 1)) <= 500:
                fit += 1
            n, trimmed = last(fit), True
            if n < 3:
                reason, trimmed = "over_budget", False
        n = 0 if reason else n
        if reason is None and not sum(cost(i)[0] for i in range(n)):
            reason = "render_empty"
        expect[c] = (reason, n, trimmed)
    df = spark.createDataFrame(rows, "request_id long, idx long, role string, text string, uses long, opens array<string>, closes array<string>")
    out = planning.history_range(df, 5, 100, keep_tail=2, min_prefix=3, snap=4)
    got = {r["request_id"]: (r["reason"], r["collapse_len"], r["trimmed"]) for r in out.collect()}
    assert got == expect and {x[0] for x in expect.values()} >= {None, "no_closed_prefix", "prefix_too_short", "over_budget"} and any(x[2] for x in expect.values())
    plans, chunks = planning.history_plan(df, 5, 100, base=2, keep_tail=2, min_prefix=3, snap=4, pays=lambda chars: chars > 150)
    by = {r["request_id"]: r for r in plans.collect()}
    assert {r["reason"] for r in by.values()} >= {"collapsed", "not_profitable"} and all((r["reason"] == "collapsed") == (r["text_chars"] > 150) for r in by.values() if r["collapse_len"])
    for c, r in by.items():
        mine = sorted((x["from_idx"], x["to_idx"]) for x in chunks.where(f"request_id = {c}").collect()) if c < 12 and r["reason"] == "collapsed" else None
        if mine:
            assert mine[0][0] == 0 and mine[-1][1] == r["collapse_len"] - 1 and all(b[0] == a[1] + 1 and b[0] % r["step"] == 0 for a, b in zip(mine, mine[1:], strict=False))


def test_billing_line_and_environment_section(spark):
    from ctxledger.functions import text as X

    line = X.BILLING + " v"
    cases = {
        f"{line}\nrest\n{line}\n": f"rest\n{line}\n", f"a\n{line}": "a", line: "", f"a {line}": f"a {line}", f"a\n{line}\nb": "a\nb", "": "", "none": "none",
    }
    for s, expect in cases.items():
        assert value(spark, s, X.strip_billing_line(S)) == expect, s
    sections = {
        "# Environment\nx\n## Next\ny": ("\n## Next\ny", "# Environment\nx"), "a\n# Environment \nx \n\n": ("a\n", "# Environment \nx"), "## Environment\nx": ("## Environment\nx", ""), "# Environments\nx": ("# Environments\nx", ""),
        "a\n# Environment\n####### seven\n# Environment\nz": ("a\n\n# Environment\nz", "# Environment\n####### seven"), "x # Environment": ("x # Environment", ""), "# Environment": ("", "# Environment"),
    }
    for s, (left, section) in sections.items():
        assert (value(spark, s, X.strip_env_section(S)), value(spark, s, X.env_section(S))) == (left, section), s


def test_substrings_as_by_the_plain_rule(spark):
    from ctxledger.operators import facts

    rng = random.Random(9)
    rows = [(g, t, 1) for g in range(200) for t in {"".join(rng.choice("abA1=/é") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 30))}]
    got = {(r[0], r[1]) for r in facts.collapse_substrings(spark.createDataFrame(rows, "doc_id long, token string, count long")).collect()}
    mine = {}
    for g, t, _ in rows:
        mine.setdefault(g, []).append(t)
    assert got == {(g, t) for g, t, _ in rows if not any(len(u) > len(t) and t in u for u in mine[g])}


def test_pages_are_cut_in_units():
    from ctxledger.operators import facts

    text = "😀" * 140_000
    pages = facts._pages(text)
    assert [len(p) for p in pages[:2]] == [14_040, 14_040] and "".join(pages) == text
    assert len(facts._pages("a" + text)) == 10 and facts._pages("a" + text)[0].endswith("\ufffd") and facts._pages("x" * 300_000)[0] == "x" * 28_080 and facts._pages(text[:100]) == [text[:100]]


def test_recoverable_texts(spark):
    from ctxledger.operators import blocks

    rows = [(1, 0, 0, "tool_result", "t1", "line\n" * 300), (1, 1, 0, "tool_result", "t1", "line\n" * 300), (1, 2, 0, "text", None, "漢字" * 40), (2, 0, 0, "text", None, None)]
    df = spark.createDataFrame(rows, "request_id long, msg_idx long, block_idx int, type string, tool_id string, text string").withColumn("result_text", F.lit(None).cast("string"))
    paged = blocks.recoverable_pages(df, 10, height=8 * 5 + 8)
    ids = {(r["request_id"], r["msg_idx"]): (r["id"], r["pages"]) for r in paged.collect()}
    assert ids[1, 0] == ids[1, 1] and ids[1, 0][1] == -(-1500 // 50) and ids[1, 2][1] == 4 and ids[2, 0][1] == 1
    wanted = spark.createDataFrame([(1, ids[1, 0][0]), (1, "rec_none"), (2, ids[1, 0][0])], "request_id long, id string")
    got = {(r["request_id"], r["id"]): r for r in blocks.recover(paged, wanted).collect()}
    assert got[1, ids[1, 0][0]]["text"] == "line\n" * 300 and not got[1, ids[1, 0][0]]["clash"] and got[1, "rec_none"]["text"] is None and got[2, ids[1, 0][0]]["text"] is None
    twin = paged.withColumn("id", F.lit("rec_same"))
    assert blocks.recover(twin, spark.createDataFrame([(1, "rec_same")], "request_id long, id string")).first()["clash"]


def test_facts(spark):
    text = "See /usr/lib/app.py and user@example.com, id 550e8400-e29b-41d4-a716-446655440000; v1.2.3 costs $1,234.50 at https://x.org/a?b=1. --dry-run MAX_SIZE=10 getUserName 123456 123456"
    found = facts.fact_spans(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    counts = {r["token"]: r["count"] for r in facts.fact_counts(found).collect()}
    for token in ("/usr/lib/app.py", "user@example.com", "550e8400-e29b-41d4-a716-446655440000", "v1.2.3", "https://x.org/a?b=1", "--dry-run", "MAX_SIZE=10", "getUserName"):
        assert token in counts
    assert counts["123456"] == 2
    kept = {r["token"] for r in facts.collapse_substrings(facts.fact_counts(found)).collect()}
    assert "1.2.3" not in kept and "v1.2.3" in kept
    sheet = facts.fact_sheet(facts.rank_facts(facts.collapse_substrings(facts.fact_counts(found)))).collect()
    assert len(sheet) == 1 and "123456 ×2" in sheet[0]["sheet"]


def test_rank_limits(spark):
    rows = [(1, f"https://a.b/{i:03d}", 1) for i in range(20)] + [(1, f"tok{i:03d}en", 1) for i in range(100)]
    got = facts.rank_facts(spark.createDataFrame(rows, "doc_id long, token string, count long")).collect()
    assert len(got) == 96 and sum(r["tier"] == 2 for r in got) == 0
    got = facts.rank_facts(spark.createDataFrame(rows[:60], "doc_id long, token string, count long")).collect()
    assert len(got) == 48 and sum(r["tier"] == 2 for r in got) == 8


def test_admission_is_greedy_not_a_prefix(spark):
    rows = [("r", 0, 5, 10), ("r", 1, 9, 10), ("r", 2, 4, 10), ("r", 3, 1, 999), ("r", 4, 1, 5)]
    got = paging.admit_by_budget(spark.createDataFrame(rows, "request_id string, idx long, pages long, bytes long"), 10, 100).orderBy("idx").collect()
    assert [r["admitted"] for r in got] == [True, False, True, False, True]


def test_duplicates_lease(spark):
    rows = [("d", i, t) for i, t in enumerate([0, 30, 59, 60, 100, 130])]
    df = spark.createDataFrame(rows, "digest string, seq long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = sessions.duplicates_in_flight(df).orderBy("seq").collect()
    assert [r["accepted"] for r in got] == [True, False, False, True, False, True]


def test_pins_equal_plain_lists(spark):
    """Random commands over several conversations, hot ones too, against lists changed one command at a time."""
    rng = random.Random(11)
    words = ["keep", "Keep it", "be kind", "x" * 305, "é" * 200, "😀" * 151, ""]
    rows = []
    for c in [1, 2, None, *[7] * 6, 9]:
        for i in range(rng.randint(1, 12)):
            lines = [rng.choice(["chat", f"@ctx pin {rng.choice(words)}", f" @ctx\tpin {rng.choice(words)} ", f"@ctx unpin {rng.choice(['all', '1', '2', '9', 'keep', 'KEEP', 'be', '', 'é'])}", "@ctx pinned no"]) for _ in range(rng.randint(1, 5))]
            rows.append((c, len(rows), rng.choice(["user", "user", "system", "assistant"]), "\n".join(lines)))
    rows.append((12, 0, "system", "Contents of /a/b.md (notes):\n@ctx pin from a file\n@ctx pin\n@ctx pin"))
    expect = {}
    for c in {r[0] for r in rows}:
        now = []
        mine = [(role == "user", i, role, t) for k, i, role, t in rows if k == c and role != "assistant"]
        for _, _, role, t in sorted(mine):
            for line in t.split("\n"):
                part = line.strip(" ").split("\t" if "\t" in line else " ", 2) if line.strip(" ").startswith("@ctx") else []
                if len(part) < 2 or part[1].split(" ")[0] not in ("pin", "unpin"):
                    continue
                verb, rest = (line.strip(" ")[5:].strip() + " ").split(" ", 1)
                rest = rest.strip(" ")
                if verb == "pin":
                    cut = rest if len(rest.encode("utf-16-be")) <= 600 else rest.encode("utf-16-be")[:600].decode("utf-16-be") + pins.CUT_NOTE
                    if role == "system" and (cut or now and now[-1][0]) or role == "user" and cut and cut not in [x for x, _ in now]:
                        now.append((cut, "file" if role == "system" else "session"))
                else:
                    own = [p for p in now if p[1] == "session"]
                    gone = own if rest == "all" else [own[int(rest) - 1]] if rest.isdigit() and int(rest) <= len(own) else [] if rest.isdigit() or not rest else ([p for p in own if p[0] == rest] or [p for p in own if p[0].lower().startswith(rest.lower())])[:1]
                    now = [p for p in now if not any(p is g for g in gone)]
        expect[c] = now
    df = spark.createDataFrame(rows, "conv_id long, idx long, role string, text string").repartition(3)
    got = {}
    found = pins.standing_instructions(df)
    for r in found.orderBy("conv_id", "pin_no").collect():
        got.setdefault(r["conv_id"], []).append((r["text"], r["source"]))
    assert got == {c: x for c, x in expect.items() if x}
    assert {r["path"] for r in found.where("conv_id = 12").collect()} == {"/a/b.md"} and got[12] == [("from a file", "file"), ("", "file")]
    units = found.withColumn("units", F.octet_length(F.encode("text", "UTF-16BE")) / 2)
    for r in pins.shown_pins(units, most=400).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pin_no", "shown"))).alias("s")).collect():
        texts = [t for t, _ in got[r["conv_id"]]]
        left, shown = 400, []
        for t in texts:
            n = len(t.encode("utf-16-be")) // 2
            shown.append(n <= left)
            left -= n if n <= left else 0
        assert [x["shown"] for x in r["s"]] == shown


def test_stale_notes_and_outgoing_units(spark):
    rows = [(1, 0, 0, "user", "tool_result", None, None, None, "ok (file state is current in your context — no need to Read it back) x", False), (1, 0, 1, "user", "text", "hé😀", None, None, None, False)]
    df = spark.createDataFrame(rows, "request_id long, msg_idx long, block_idx int, role string, type string, text string, tool_name string, tool_input string, result_text string, is_error boolean")
    assert blocks.transcript_text(df).first()["text"] == f"[tool_result]\nok {blocks.STALE} x\n\nhé😀"
    systems = spark.createDataFrame([(1, "four"), (2, None)], "request_id long, text string")
    tool = spark.createDataFrame([(1, "t", "what it does", '{"type":"object"}'), (3, None, None, None)], "request_id long, name string, description string, schema_json string")
    got = {r["request_id"]: r["chars"] for r in blocks.outgoing_chars(df, systems, tool).collect()}
    assert got == {1: 70 + 4 + 4 + 1 + 12 + 17, 2: 0, 3: 0} and blocks.outgoing_chars(df).first()["chars"] == 74


def test_pins(spark):
    assert pins.fold([("session", "pin", "a"), ("session", "pin", "a"), ("session", "pin", "Bee"), ("session", "unpin", "be"), ("file", "pin", "f"), ("file", "pin", "f")]) == [("a", "session"), ("f", "file"), ("f", "file")]
    assert pins.fold([("file", "pin", "f"), ("session", "pin", "x"), ("session", "unpin", "1"), ("session", "unpin", "9")]) == [("f", "file")]
    assert pins.fold([("file", "pin", "f"), ("session", "pin", "x"), ("session", "unpin", "all")]) == [("f", "file")]
    turns = spark.createDataFrame([(1, 0, "system", "@ctx pin keep"), (1, 1, "user", "hi\n@ctx pin be kind\n@ctx  pin x"), (1, 2, "user", " @ctx unpin x"), (1, 3, "assistant", "@ctx pin no")], "conv_id long, idx long, role string, text string")
    got = [(r["text"], r["source"]) for r in pins.standing_instructions(turns).orderBy("pin_no").collect()]
    assert got == [("keep", "file"), ("be kind", "session")]
    assert {r["idx"]: r["only_commands"] for r in pins.command_turns(turns).collect()} == {0: True, 1: False, 2: True, 3: True}


def test_schema_strip():
    schema = {"type": "object", "description": "d", "properties": {"description": {"type": "string", "description": "x", "format": "y" * 40}, "a": {"anyOf": [{"title": "t", "type": "null"}]}}, "items": [{"default": 1}], "enum": [{"title": "kept"}]}
    assert tools.strip_value(schema) == {"type": "object", "properties": {"description": {"type": "string"}, "a": {"anyOf": [{"type": "null"}]}}, "items": [{}], "enum": [{"title": "kept"}]}


def test_annotations(spark):
    schema = {"description": "d", "format": "x" * 33, "properties": {"a": {"title": "é", "default": None, "items": [{"$comment": 1}, {"items": {"examples": [1, {"b": 2}]}}]}}, "anyOf": [{"format": "date"}, {"description": "last"}], "not": {"description": {"k": "v"}}, "enum": [{"title": "no"}]}
    assert tools.annotations(schema) == [
        '$ description: "d"', '$ format: "' + "x" * 33 + '"', '$.a title: "é"', "$.a default: null", "$.a.items[0] $comment: 1", '$.a.items[1].items examples: [1,{"b":2}]', '$.anyOf[1] description: "last"', '$.not description: {"k":"v"}',
    ]
    deep = {"description": "x"}
    for _ in range(30):
        deep = {"not": deep}
    assert tools.annotations(deep) == [] and tools.annotations("text") == []
    import json

    rows = spark.createDataFrame([(1, json.dumps(schema), None), (2, "oops", "told"), (3, None, None)], "id long, s string, d string")
    got = {r["id"]: r["doc"] for r in rows.select("id", tools.annotated_doc(F.lit("t"), F.col("d"), F.col("s")).alias("doc")).collect()}
    assert got[1].split("\n")[:2] == ["## Tool: t", '$ description: "d"'] and got[2] == "## Tool: t\ntold" and got[3] is None


def test_system(spark):
    text = "<env>\nWorking directory: /a b\nIs directory a git repo: No\nToday's date: 2025-01-01\n</env>x<custom>y</custom><skill>z</skill>"
    env = value(spark, text, system.env_fields(S))
    assert (env["cwd"], env["git_repo"], env["today"], env["branch"]) == ("/a b", "No", "2025-01-01", None)
    odd = "<env a>Platform:\nplatform : linux x \r\nIs directory a git repo: maybe\nIS DIRECTORY A GIT REPO: yes, really\nCurrent branch: old\n  On branch main extra\nOS Version: 1: 2</env>"
    env = value(spark, odd, system.env_fields(S))
    assert (env["platform"], env["git_repo"], env["branch"], env["os_version"], env["cwd"], env["today"]) == ("linux x", "yes", "main", "1: 2", None, None)
    assert value(spark, "Current branch: b2", system.env_fields(S))["branch"] == "b2" and value(spark, "", system.env_fields(S))["cwd"] is None
    # fields count in the environment's body only, the branch anywhere
    both = "<context>Platform: from context\nOn branch seen first</context>\n<env>\nOS Version: 9\nBranch: b3\n</env>\n<env>Platform: second</env>"
    env = value(spark, both, system.env_fields(S))
    assert (env["platform"], env["os_version"], env["branch"]) == (None, "9", "seen")
    assert value(spark, text, system.unknown_tags(S)) == ["custom"]
    assert value(spark, text, system.static_text(S)) == "x<custom>y</custom><skill>z</skill>"


def test_usage(spark):
    body = 'data: {"message":{"usage":{"input_tokens":5,"output_tokens":"x"}}}\r\n\r\ndata: {"usage":{"output_tokens":9}}\ndata: {"usage":{"output_tokens":null}}\ndata: oops'
    df = spark.createDataFrame([("a", body), ("b", '{"usage":{"input_tokens":1,"cache_read_input_tokens":0}}'), ("c", "not json")], "response_id string, body string")
    got = {r["response_id"]: tuple(r)[1:] for r in usage.merge_usage(usage.usage_events(df)).collect()}
    assert got == {"a": (5, 9, None, None), "b": (1, None, None, 0), "c": (None,) * 4}
    codes = spark.createDataFrame([(413, ""), (400, "Prompt is TOO long"), (400, "x"), (500, "too many tokens")], "s int, b string")
    assert [r[0] for r in codes.select(usage.is_size_rejection(F.col("s"), F.col("b"))).collect()] == [True, True, False, False]


def test_layout():
    assert layout.geometry("a" * 10, 4)[:3] == (3, 1, 3)
    assert layout.geometry("漢字漢", 4)[:3] == (2, 1, 2)
    assert layout.expand_tabs("a\tb") == "a→  b"
    assert layout.geometry("x" * (312 * 90), 312)[:2] == (90, 2)
    assert layout.escape_uncovered("a🚀", {"a"}) == "a[U+1F680]"


def test_fact_entries_of_pages(spark, monkeypatch):
    """A text of one page keeps its entries; pages of a long one are collapsed and cut each, then added up and cut again."""
    monkeypatch.setattr(facts, "LONG", 60)
    monkeypatch.setattr(facts, "PAGE", 40)
    pages = ["AAA_B1 AAA_B1 /usr/lib/x.so 12345 ", "AAA_B1 AAA_B12_C 777777 1234567 ", "12345 /usr/lib/x.so"]
    text = "".join(p.ljust(40) for p in pages)
    docs = spark.createDataFrame([(1, text), (2, pages[1]), (3, None), (4, "plain words")], "doc_id long, text string")
    got = {}
    for r in facts.fact_entries(facts.fact_spans(docs), 4).collect():
        got.setdefault(r["doc_id"], {})[r["token"]] = (r["count"], r["dropped"])
    alone = facts.rank_facts(facts.collapse_substrings(facts.fact_counts(facts.fact_spans(docs.where("doc_id = 2")))), 4).collect()
    assert got[2] == {r["token"]: (r["count"], 0) for r in alone} and set(got) == {1, 2}
    whole = {}
    for p in pages:
        one = spark.createDataFrame([(1, p.ljust(40))], docs.schema)
        for r in facts.rank_facts(facts.collapse_substrings(facts.fact_counts(facts.fact_spans(one))), 4).collect():
            whole[r["token"]] = whole.get(r["token"], 0) + r["count"]
    assert len(got[1]) == 4 and all(whole[t] == n and dropped == len(whole) - 4 for t, (n, dropped) in got[1].items())
    sheets = {r["doc_id"]: r["sheet"] for r in facts.fact_sheet(facts.fact_entries(facts.fact_spans(docs), 4), compact=True).collect()}
    assert sheets[1].startswith(facts.OPENERS[True, True]) and sheets[2].startswith(facts.OPENERS[True, False]) and sheets[1].endswith("]")


def test_narrow_geometry_equals_the_row_by_row_form(spark):
    rng = random.Random(6)
    texts = ["x" * n for n in [0, 1, 6, 7, 8, 13, 14, 20, 21, 27, 28, 41, 42, 43, 56, 63, 70, 200] + [rng.randint(0, 400) for _ in range(40)]]
    texts += [None, "漢字" * 30, "a\tb", "a\nb" * 9, "é" * 50, "e\u0301" * 40, "a↵b" * 9]
    for cols, options in ((7, dict(height=40, max_chars=40)), (7, dict(height=4000, max_chars=29)), (5, dict(height=24, max_chars=1000)), (10, dict(height=8, max_chars=3))):
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        got = {r["id"]: tuple(r["g"]) for r in layout.with_page_geometry(df, "text", cols, "g", **options).collect()}
        assert all(got[i] == layout.geometry(t or "", cols, **options) for i, t in enumerate(texts))


def test_bpe(spark):
    ranks = {b"ab": 0, b"abc": 1, b"bc": 2}
    assert tokens.merge_count(b"abc", ranks) == 1 and tokens.merge_count(b"bcab", ranks) == 2
    table = spark.createDataFrame([(bytearray(k), v) for k, v in ranks.items()], "token binary, rank long")
    docs = spark.createDataFrame([(1, "abc abc"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["tokens"] for r in tokens.bpe_count(docs, table).collect()} == {1: 3, 2: 0}
    rows = [(1, "abc"), (1, "abc"), (None, "abc abc"), (3, "")]  # repeated rows each have their own count
    assert sorted((str(r["doc_id"]), r["tokens"]) for r in tokens.bpe_count(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()) == [("1", 1), ("1", 1), ("3", 0), ("None", 3)]


def test_merge_equals_plain_merging():
    """The heap gives what merging the lowest pair, the first of equals, again and again gives."""
    rng = random.Random(4)

    def plain(piece, ranks):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1))
            if best == 10**9:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts)

    for _ in range(300):
        ranks, tokens_ = {}, [b"a", b"b", b"c"]
        for rank in range(rng.randint(0, 25)):
            new = rng.choice(tokens_) + rng.choice(tokens_)
            if new not in ranks:
                ranks[new] = rank
                tokens_.append(new)
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40)))
        assert tokens.merge_count(piece, ranks) == plain(piece, ranks)
    assert tokens.merge_count(b"ab" * 100_000, {b"ab": 0, b"abab": 1}) == 50_000


@pytest.mark.parametrize("text, kind", [
    ('{ "a": 1}', "structured"), ("{}", "structured"), ("{a}", "other"), (" [ true, 1]", "structured"), ("[truest]", "other"), ("[-5]", "structured"), ("[-x]", "other"), ("[ ]", "structured"), ("---\na: 1", "structured"),
    ("--- a", "structured"), ("---", "other"), ("---\r\nx", "structured"), ("----", "other"), ("diff --git a b", "structured"), ("[INFO] a\n[WARN] b\nERROR: c\nTRACEx", "log"), ("INFOX\nINFO_\na\nb", "other"),
    ("2024-01-02 a\n2024-01-02T\nx\ny", "log"), ("12:34:56 a\n12:34:567\nb\nc", "other"), ("12:34:56 a\n12:34:56\nb\nc", "log"), ("", "other"), (None, "other"),
])
def test_content_class_rules(spark, text, kind):
    assert value(spark, text or "", X.classify_content(S)) == kind


def test_wrong_bodies_keep_the_rest(spark):
    rows = [("a", '{"messages":[{"role":"user","content":"x"},{"role":"user","content":[{"type":"text","text":"y"}]}]}'), ("b", "broken"), ("c", '{"messages":"no"}')]
    got = blocks.explode_messages(spark.createDataFrame(rows, "request_id string, body string")).collect()
    assert [(r["request_id"], r["idx"], r["content_is_array"]) for r in got] == [("a", 0, False), ("a", 1, True)]
