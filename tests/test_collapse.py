"""Responses collapse against a plain planner that goes item by item, and the parts it is made of."""

import json
import random

from pyspark.sql import functions as F

from ctxledger.functions import layout
from ctxledger.operators import blocks as B
from ctxledger.operators import collapse as C
from ctxledger.operators import profiles as P

COLS, ROWS = 10, 3
SMALL = dict(regime="flat", tokens=7, strip_cols=COLS, max_height=8 * ROWS + 8, keep_tail=1, keep_pairs=2, min_collapse_tokens=60)
PROFILES = {f"t-{mode}-{images}": SMALL | dict(mode=mode, max_images=images) for mode in ("mixed", "pairs") for images in (0, 2, 5, 40)}


def size(s):
    return F.length(s).cast("long")


def page_count(text):
    one = text.replace("↵", "⏎")
    while "\n\n\n\n" in one:
        one = one.replace("\n\n\n\n", "\n\n\n")
    one = "\n".join(line.rstrip(" \t") for line in one.split("\n"))
    while "\n\n\n\n" in one:
        one = one.replace("\n\n\n\n", "\n\n\n")
    one = one.replace("\n", "↵")
    return layout.geometry(one, COLS, 8 * ROWS + 8)[1], len(one)


def rounds(items):
    """Runs of adjacent paired calls with exactly their outputs after them."""
    calls, outputs = {}, {}
    for i, x in enumerate(items):
        if x["type"] in (B_CALL, B_OUT):
            (calls if x["type"] == B_CALL else outputs).setdefault(x["call_id"], []).append(i)
    pair = {c[0]: outputs[k][0] for k, c in calls.items() if k and len(c) == 1 and len(outputs.get(k, ())) == 1 and c[0] < outputs[k][0]}
    found, i = [], 0
    while i < len(items):
        j = i
        while j in pair:
            j += 1
        mine = {pair[c] for c in range(i, j)}
        k = j
        while k in mine:
            k += 1
        if j > i and k - j == j - i:
            found.append((i, k - 1, sorted((pair[c], c) for c in range(i, j))))
            i = k
        else:
            i += 1
    return found


B_CALL, B_OUT = "function_call", "function_call_output"


def body(x):
    return x["text"] if x["role"] in ("user", "assistant") and x["type"] in (None, "", "message") else None


def plain(items, mode, images):
    """(reason, selected indices, pages, places, barriers) one decision at a time."""
    done = rounds(items)
    kept = 0
    while done and kept < SMALL["keep_pairs"]:
        kept += len(done.pop()[2])
    begin = {r[0]: r for r in done}
    named = {x["id"] for x in items if x["type"] == "item_reference" and x["id"]}
    said = [i for i, x in enumerate(items) if (body(x) or "").strip()]
    kept = {*said[len(said) - SMALL["keep_tail"] :], *[i for i in said if items[i]["role"] == "user"][-1:]}
    runs, run, barriers, i = [], [], {}, 0
    while i < len(items):
        x = items[i]
        r = begin.get(i)
        if r and not (mode == "mixed" and any(items[j]["id"] in named for j in range(r[0], r[1] + 1))):
            text = "\n\n".join(f"[tool_use {items[c]['name'] or 'tool'}]\n{items[c]['text']}\n[tool_result]\n{items[o]['text']}" for o, c in r[2])
            run.append((range(r[0], r[1] + 1), text, sum(len(items[c]["json"]) + len(items[o]["text"]) for o, c in r[2])))
            i = r[1] + 1
            continue
        free = mode == "mixed" and x["id"] not in named and i not in kept
        if free and i in said:
            run.append((range(i, i + 1), f'<{x["role"]} t="{i}">\n{x["text"]}\n</{x["role"]}>', len(x["text"])))
        elif not (free and body(x) is not None):
            if run and mode == "mixed":
                barriers[x["type"] or "untyped"] = barriers.get(x["type"] or "untyped", 0) + 1
            runs, run = runs + ([run] if run else []), []
        i += 1
    runs += [run] if run else []
    total = sum(u[2] for r in runs for u in r)
    listed = ",".join(f"{t}:{n}" for t, n in sorted(barriers.items(), key=lambda b: (-b[1], b[0]))[:8])
    if not runs:
        return "no_closed_prefix", [], 0, [], listed
    if total < SMALL["min_collapse_tokens"]:
        return "below_min_tokens", [], 0, [], listed
    if not images:
        return "too_many_images", [], 0, [], listed
    left, chosen, pages, places, capped = images, [], 0, [], False
    for r in runs:
        if not left:
            capped = True
            break
        fit = [k for k in range(1, len(r) + 1) if page_count("\n\n".join(u[1] for u in r[:k]))[0] <= left]
        if not fit:
            capped = True
            break
        k = max(fit)
        n, chars = page_count("\n\n".join(u[1] for u in r[:k]))
        image = 7 * max(1, -(-(-(-chars // COLS)) // ROWS))
        if not image < (sum(u[2] for u in r[:k]) if mode == "mixed" else chars / 4):
            continue
        chosen += [j for u in r[:k] for j in u[0]]
        places.append(r[0][0][0])
        pages, left = pages + n, left - n
        if k < len(r):
            capped = True
            break
    return ("collapsed" if chosen else "too_many_images" if capped else "not_profitable"), sorted(chosen), pages, places, listed


def make(rng, wide):
    items, calls = [], []
    for i in range(rng.randint(0, 26)):
        kind = rng.random()
        x = dict(type="message", role=rng.choice(["user", "assistant"]), call_id=None, id=f"i{i}", name=None, text=None)
        filler = rng.choice(["ab", "x y", "tail \n", "\n\n\n\nq", "é", *(["漢字", "\t", "↵"] if wide else [])])
        if kind < 0.35:
            calls.append(f"c{len(calls)}" if rng.random() < 0.93 else "c0")
            x |= dict(type=B_CALL, role=None, call_id=calls[-1], name=rng.choice([None, "f"]), text="{" + filler * rng.randint(0, 4) + "}")
        elif kind < 0.7 and calls:
            x |= dict(type=B_OUT, role=None, call_id=calls[rng.randrange(max(0, len(calls) - 2), len(calls))], text=filler * rng.randint(0, 30))
        elif kind < 0.9:
            x |= dict(text=rng.choice(["", " ", "m" + filler * rng.randint(1, 200)]), type=rng.choice(["message", None]))
        else:
            x |= dict(type=rng.choice(["reasoning", "item_reference"]), role=None, id=f"i{rng.randint(0, max(0, i))}")
        x["json"] = json.dumps({k: v for k, v in x.items() if v is not None})
        items.append(x)
    return items


def test_plans_equal_the_plain_planner(spark):
    rng = random.Random(5)
    models = sorted(PROFILES)
    every = {i: (make(rng, i % 3 == 0), models[i % len(models)]) for i in range(240)}
    rows = [(i, j, *(x[c] for c in ("type", "role", "call_id", "id", "name", "text", "json"))) for i, (items, _) in every.items() for j, x in enumerate(items)]
    items = spark.createDataFrame(rows, "request_id long, idx long, type string, role string, call_id string, id string, name string, text string, json string").repartition(4)
    requests = P.resolve_profile(spark.createDataFrame([(i, m) for i, (_, m) in every.items()], "request_id long, model string"), overrides_json=json.dumps(PROFILES))
    plans, parts, classes = C.responses_collapse(items, requests, size)
    expect = {i: plain(x, *m.split("-")[1:2], int(m.split("-")[2])) for i, (x, m) in every.items()}
    got = {r["request_id"]: r for r in plans.collect()}
    assert len(got) == len(every) and {r["reason"] for r in got.values()} == {"no_closed_prefix", "below_min_tokens", "too_many_images", "not_profitable", "collapsed"}
    after = {}
    for r in C.rewritten_items(classes, parts).orderBy("request_id", "idx").collect():
        after.setdefault(r["request_id"], []).append(r)
    for i, (reason, chosen, pages, places, barriers) in expect.items():
        r = got[i]
        assert (r["reason"], r["collapsed_items"], r["pages"], r["segments"], r["barriers"]) == (reason, len(chosen), pages, len(places), barriers), i
        out = []
        for j in range(len(every[i][0])):
            out += ["put"] if j in places else []
            out += [] if j in chosen else [j]
        mine = after.get(i, [])
        assert ["put" if r["source_idx"] is None else r["source_idx"] for r in mine] == out and [r["idx"] for r in mine] == list(range(len(out)))


def test_a_strategy_decides_what_pays(spark):
    """The gate is the caller's: one that never pays collapses nothing, one that always does collapses what fits."""
    rng = random.Random(6)
    items = [make(rng, False) for _ in range(12)]
    rows = [(i, j, *(x[c] for c in ("type", "role", "call_id", "id", "name", "text"))) for i, own in enumerate(items) for j, x in enumerate(own)]
    df = spark.createDataFrame(rows, "request_id long, idx long, type string, role string, call_id string, id string, name string, text string")
    requests = P.resolve_profile(df.select("request_id").distinct().withColumn("model", F.lit("t-mixed-40")), overrides_json=json.dumps(PROFILES))
    never = C.responses_collapse(df, requests, size, pays=lambda image, text: F.lit(False))[0]
    always = C.responses_collapse(df, requests, size, pays=lambda image, text: F.lit(True))[0]
    assert never.where("segments > 0").count() == 0 < always.where("segments > 0").count()
    assert C.responses_collapse(df.limit(0), requests.limit(0), size)[0].count() == 0


def test_pages_of_growing_lines():
    rng = random.Random(7)
    for _ in range(200):
        cols, limit = rng.randint(2, 9), rng.randint(1, 4)
        most = rng.choice([12, 30, 10**6])
        pager, line = layout.Pager(cols, limit, most), ""
        for _ in range(6):
            more = "".join(rng.choice("ab 漢é\t") for _ in range(rng.randint(0, 12)))
            assert pager.pages(more) == layout.geometry(line + more, cols, height=8 * limit + 8, max_chars=most)[1] or most // cols < limit
            pager.feed(more)
            line += more


def test_message_parts_and_items(spark):
    bodies = [
        '{"input":[{"type":"function_call","name":"f","call_id":"a","arguments":"{\\"x\\": 1}"},{"role":"user","content":[{"type":"input_text","text":"hi"},{"type":"refusal","refusal":"no"}]},{"role":"user","content":[{"type":"input_image"}]},{"type":"item_reference","item_id":"q"}]}',
        '{"input":"just [text]"}', '{"input":[]}', "{nope",
    ]
    items = B.explode_items(spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")).withColumn("said", C.message_text(F.col("text"))).collect()
    assert [(r["request_id"], r["type"], r["said"]) for r in items] == [(0, "function_call", '{"x": 1}'), (0, "message", "hi\n\nno"), (0, "message", None), (0, "item_reference", None), (1, "message", "just [text]")]
    assert items[0]["json"] == '{"type":"function_call","name":"f","call_id":"a","arguments":"{\\"x\\": 1}"}' and items[3]["id"] == "q" and json.loads(items[4]["json"]) == {"type": "message", "role": "user", "content": "just [text]"}
