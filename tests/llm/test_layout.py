"""Mixing, packing, chat formatting and the pipeline against brute force."""

import hashlib
import json
import math
import random
import tempfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import chat, exact_dedup, minhash, mixing, packing, tokens
from tests.conftest import SF
from tests.llm.test_dedup import brute_copies
from tests.llm.test_text import brute_clean

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# ------------------------------------------------------------------------ mixing
def brute_mix(rows, percent=mixing.PERCENT, temperature=mixing.TEMPERATURE):
    """rows: (id, source, n_chars) -> Counter of (id, source)."""
    by = defaultdict(list)
    for i, s, n in rows:
        x = max(10, math.floor(10 * math.sqrt(math.sqrt(max(n if n is not None else 1, 1)))))
        u = (int(hashlib.md5(f"{mixing.SEED}|{'\\N' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by[s].append((i, x, u))
    total = math.floor(len(rows) * percent / 100)
    norm = sum(len(v) ** temperature for v in by.values())
    exact = {s: round(total * len(v) ** temperature / norm, 6) for s, v in by.items()}
    want = {s: math.floor(e) for s, e in exact.items()}
    short = total - sum(want.values())
    for s in sorted(exact, key=lambda s: (-(exact[s] - math.floor(exact[s])), s is not None, s or ""))[:short]:
        want[s] += 1
    out = Counter()
    for s, v in by.items():
        size, ranks = sum(x for _, x, _ in v), []
        left = want[s]
        for k, (i, x, u) in enumerate(v):
            whole = want[s] * x // size
            p = (want[s] * x - whole * size) / size
            out[(i, s)] += whole
            left -= whole
            if p > 0:
                ranks.append(((u / (1 - u)) / (p / (1 - p)), i is None, i or 0, k))
        for _, _, _, k in sorted(ranks)[:left]:
            out[(v[k][0], s)] += 1
    return +out, want


@pytest.mark.parametrize("bins", [4096, 2])
def test_mix_matches_brute_force(spark, monkeypatch, bins):
    monkeypatch.setattr(mixing, "BINS", bins)
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot"] * 12 + ["a", "b", "c", None]), rng.choice([0, 1, 8, 300, 5000, 90_000, None])) for i in range(1500)] + [(7, "dup", 100)] * 40 + [(8, "dup", 100)] * 3 + [(None, "nul", 5)] * 4 + [(None, "hot", 50)]
    df = spark.createDataFrame([(i, "t", "en", s, n) for i, s, n in rows], DOC).withColumn("copy", F.lit("old"))
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    got = out.collect()
    want, sizes = brute_mix(rows)
    assert Counter((r["doc_id"], r["source"]) for r in got) == want
    assert Counter(r["source"] for r in got) == +Counter(sizes) and len(got) == len(rows)


def test_mix_weights_and_edges(spark):
    df = spark.createDataFrame([(i, None, "en", "ab"[i % 2], 10) for i in range(100)], DOC)
    w = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("zzz", 0.0)], "src string, weight double")
    got = Counter(r["source"] for r in mixing.mix(df, weights=w, percent=200).collect())
    assert got == {"a": 150, "b": 50}
    assert mixing.mix(df.limit(0)).count() == 0
    none = spark.createDataFrame([("q", 1.0)], "src string, weight double")
    assert mixing.mix(df, weights=none).count() == 0


def test_pareto_inclusion_follows_size(spark):
    """Larger documents are in the sample more often, in proportion to their size measure."""
    df = spark.createDataFrame([(i, None, "en", "s", 16 if i % 2 else 160_000) for i in range(4000)], DOC)
    got = Counter(r["n_chars"] for r in mixing.mix(df, percent=25).collect())
    assert sum(got.values()) == 1000 and abs(got[160_000] / got[16] - 10) < 2.5


# ----------------------------------------------------------------------- packing
def check_packing(rows, lengths):
    """All lengths are covered once, no window overflows, step groups balance."""
    spans, windows, tiers, groups = defaultdict(list), defaultdict(list), {}, {}
    for r in rows:
        spans[r["doc_id"]].append((r["start"], r["start"] + r["length"]))
        key = (r["cell"], r["window_no"])
        windows[key].append((r["offset"], r["offset"] + r["length"]))
        assert tiers.setdefault(key, r["tier"]) == r["tier"] and groups.setdefault(key, r["step_group"]) == r["step_group"]
    for d, n in lengths.items():
        got = sorted(spans.pop(d, []))
        assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == n
    assert not spans
    for key, w in windows.items():
        w.sort()
        assert w[0][0] == 0 and all(a[1] == b[0] for a, b in zip(w, w[1:])) and w[-1][1] <= tiers[key]
    return windows, tiers, groups


def test_packing_invariants(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_DOCS", 200)
    rng = random.Random(10)
    lengths = {i: rng.choice([1, 7, 100, 511, 512, 513, 2048, 3000, 8192, 8193, 40_000, rng.randrange(1, 9000)]) for i in range(900)}
    df = spark.createDataFrame(list(lengths.items()), "doc_id long, n long").withColumn("tier", F.lit("clash"))
    rows = packing.pack(df, F.col("n")).collect()
    windows, tiers, groups = check_packing(rows, lengths)
    filled = sum(lengths.values()) / sum(tiers.values())
    assert filled > 0.93
    of = defaultdict(list)
    for key, g in groups.items():
        of[(key[0], g)].append(key)
    for keys in of.values():
        assert len({tiers[k] for k in keys}) == 1 and len(keys) <= packing.GROUP_WINDOWS


def test_gaps_take_shorter_documents_first_and_groups_balance():
    rows = packing.pack_cell([8000, 150, 40])
    assert {r[5] for r in rows} == {0}  # both short ones fit the gap of the long window
    many = packing.pack_cell([random.Random(i).randrange(4100, 8192) for i in range(320)])
    tokens, count = Counter(), Counter()
    for r in many:
        tokens[r[7]] += r[3]
        count[r[7]] += r[6] == 0
    assert max(tokens.values()) - min(tokens.values()) < 8192 and max(count.values()) - min(count.values()) <= 1


def brute_pack(lengths, tiers, per_group):
    """The rules of the packer one by one, with a search over all windows for each piece: (index, start, length, tier, window, offset), window -> group."""
    pieces = defaultdict(list)
    for i, n in enumerate(lengths):
        for start in range(0, n, tiers[-1]):
            m = min(n - start, tiers[-1])
            pieces[min(t for t in tiers if t >= m)].append((-m, i, start))
    rows, used, tier_of = [], {}, {}
    for t in sorted(tiers, reverse=True):
        for source in sorted((x for x in tiers if x <= t), reverse=True):
            left = []
            for m, i, start in sorted(pieces[source]):
                fits = [(t - used[w], w) for w in used if tier_of[w] == t and 0 < t - used[w] >= -m]
                if not fits and source == t:
                    w = len(used)
                    used[w], tier_of[w] = 0, t
                    fits = [(t, w)]
                if fits:
                    w = min(fits)[1]
                    rows.append((i, start, -m, t, w, used[w]))
                    used[w] -= m
                else:
                    left.append((m, i, start))
            pieces[source] = left
    groups, base = {}, 0
    for t in sorted(tiers, reverse=True):
        windows = sorted((w for w in used if tier_of[w] == t), key=lambda w: (-used[w], w))
        n = math.ceil(len(windows) / per_group)
        load = [0] * n
        for lo in range(0, len(windows), max(n, 1)):
            free = set(range(n))  # each group gets one window a round
            before = list(load)
            for w in windows[lo : lo + n]:
                g = min(free, key=lambda g: (before[g], g))
                free.remove(g)
                groups[w] = base + g
                load[g] += used[w]
        base += n
    return rows, groups


@pytest.mark.parametrize("seed", range(6))
def test_packing_matches_brute_force(seed):
    rng = random.Random(seed)
    tiers = ((16, 64, 256), packing.TIERS, (7,), (1, 2, 3, 50))[seed % 4]
    lengths = [rng.choice([1, tiers[0], tiers[-1], tiers[-1] + 1, rng.randrange(1, 3 * tiers[-1]), rng.randrange(1, tiers[0] + 1)]) for _ in range(rng.randrange(1, 250))]
    got = packing.pack_cell(lengths, tiers, 4)
    rows, groups = brute_pack(lengths, tiers, 4)
    assert sorted((i, start, n, t, w, offset) for i, _, start, n, t, w, offset, _ in got) == sorted(rows)
    assert all(g == groups[w] for *_, w, _, g in got) and all(k == start // tiers[-1] for _, k, start, *_ in got)


def test_packing_edges(spark):
    word = " the"
    df = spark.createDataFrame([(1, None), (2, ""), (3, word * 25_000), (4, "a"), (4, "a"), (None, "b")], "doc_id long, text string")
    rows = packing.pack_texts(df).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 1, 2: 1, 3: 4, 4: 2, None: 1}
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 25_001 and next(r for r in rows if r["doc_id"] == 2)["length"] == 1
    assert packing.pack_texts(df.limit(0)).count() == 0
    assert packing.pack(df, F.lit(None).cast("long")).count() == 0


def test_packing_has_no_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_DOCS", 50)
    rows = packing.pack(spark.range(1000).select(F.lit(None).cast("string").alias("doc_id")), F.lit(1)).collect()
    sizes = Counter(r["cell"] for r in rows)
    assert len(rows) == 1000 and len(sizes) > 8 and max(sizes.values()) <= 250


@pytest.mark.parametrize("stage", ["op6", "pipeline"])
def test_packing_counts_real_tokens(spark, stage):
    enc = tokens.encoding(tokens.read_ranks())
    path = tempfile.mkdtemp()
    extra = [(901, "Été à Orléans, où l'on déjeune.", "fr", "s", 30), (901, "Another text.", "en", "s", 13), (None, "No id.", "en", "s", 6), (902, None, "en", "s", None), (903, "", "en", "s", 0)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).unionByName(spark.createDataFrame(extra, DOC))
    docs.write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = packing.op6_packing(spark, path) if stage == "op6" else corpus_pipeline.pack(spark, docs, path)
    out = out.collect()
    got, want = Counter(), Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
    for r in docs.collect():
        want[r["doc_id"]] += len(enc.encode_ordinary(r["text"] or "")) + packing.END_TOKENS
    assert got == want
    windows = Counter()
    for r in out:
        windows[(r["cell"], r["window_no"], r["tier"])] += r["length"]
    assert all(n <= tier for (_, _, tier), n in windows.items())  # real tokens, cut documents by their parts


# -------------------------------------------------------------------------- chat
def test_canonical_json():
    assert chat.canonical({"b": 1.0, "a": [None, True, "é\n\"", 1.5], "ä": {"z": 1, "y": float("nan")}}) == '{"a":[null,true,"é\\n\\"",1.5],"b":1,"ä":{"y":null,"z":1}}'
    assert json.loads(chat.canonical({"x": [1, {"k": "v"}]})) == {"x": [1, {"k": "v"}]}


def test_deep_values_are_written_alike():
    value = {"b": [1.0, 2.5, float("nan"), None, True, "\ud800é", {"z": [], "a": {}, "A": -0.0}], "a": 2**60}
    assert chat.canonical(value) == chat._escaped(chat._deep(value))
    for _ in range(5000):
        value = [value]
    assert chat.canonical(value).startswith("[" * 5000 + '{"a":')


def test_schema_validation():
    s = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 5}, "b": {"type": "array", "items": {"type": "string", "pattern": "^x"}, "maxItems": 2}, "c": {"enum": [1, "q"]}, "d": {"anyOf": [{"type": "null"}, {"type": "number"}]}}}
    assert chat.violations({"a": 3, "b": ["x1"], "c": "q", "d": None}, s) == []
    assert chat.violations({"a": 9, "b": ["y", "x", "x"], "c": 2, "d": "n", "e": 1}, s) == ["$.a: out of bounds", "$.b: wrong number of items", "$.b[0]: pattern not matched", "$.c: not in enum", "$.d: matches none of anyOf", "$.e: not allowed"]
    assert chat.violations({}, s) == ["$.a: missing"] and chat.violations([], s) == ["$: not of type object"] and chat.violations({"a": True}, s) == ["$.a: not of type integer"]


def test_order_is_topological():
    rng = random.Random(11)
    for _ in range(50):
        n = rng.randrange(1, 12)
        ids = [f"c{i}" for i in range(n)]
        needs = [[f"c{j}" for j in range(n) if j != i and rng.random() < 0.15] + ["absent"] for i in range(n)]
        seq, cyclic = chat.order(ids, [rng.randrange(5) for _ in range(n)], needs)
        place = {i: k for k, i in enumerate(seq)}
        assert sorted(seq) == list(range(n))
        for i in range(n):
            if i not in cyclic:
                assert all(place[int(d[1:])] < place[i] for d in needs[i] if d != "absent")


def test_format_chats(spark):
    m = spark.createDataFrame([(1, 0, "system", "be nice"), (1, 9, "user", None), (2, 0, "user", ""), (None, 0, "user", "n")], "conv_id long, pos long, role string, text string")
    c = spark.createDataFrame(
        [(1, 3, "b", "add", '{"x": 2}', ["a"]), (1, 5, "a", "add", '{"x": "no"}', []), (1, 6, None, "add", "{bad", None), (1, 7, "p", "none", "{}", ["q"]), (1, 8, "q", "add", '{"x":1}', ["p"]), (1, 9, "b", "add", '{"x": 7}', None)],
        "conv_id long, pos long, call_id string, tool string, args string, needs array<string>",
    )
    r = spark.createDataFrame([(1, 4, "b", "second"), (1, 3, "b", "first"), (1, 4, "ghost", "x"), (1, 8, "q", None), (2, 1, "b", "other conversation")], "conv_id long, pos long, call_id string, text string")
    schemas = {"add": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}
    out = {x["conv_id"]: x for x in chat.format_chats(m.withColumn("kind", F.lit(1)), c, r, schemas).collect()}
    one = json.loads(out[1]["chat"])
    assert [x["id"] for x in one["calls"]] == ["a", "b", None, "b", "p", "q"]
    assert one["calls"][1] == {"arguments": {"x": 2}, "id": "b", "name": "add", "result": "first", "valid": True}
    assert one["calls"][0]["errors"] == ["$.x: not of type integer"] and one["calls"][2]["errors"] == ["$: not JSON"] and one["calls"][4]["errors"] == ["$: unknown tool"]
    assert one["calls"][3] == {"arguments": {"x": 7}, "id": "b", "name": "add", "repeated": True, "valid": True}
    assert (out[1]["n_calls"], out[1]["n_open"], out[1]["n_invalid"], out[1]["n_cyclic"]) == (6, 4, 3, 2)
    lone = [{"content": "second", "role": "tool", "tool_call_id": "b"}, {"content": "x", "role": "tool", "tool_call_id": "ghost"}]
    assert one["messages"] == [{"content": "be nice", "role": "system"}, *lone, {"content": None, "role": "user"}]
    assert json.loads(out[2]["chat"]) == {"calls": [], "messages": [{"content": "", "role": "user"}, {"content": "other conversation", "role": "tool", "tool_call_id": "b"}]} and None in out
    alone = chat.format_chats(m.limit(0), c.limit(0), r, schemas).collect()
    assert {x["conv_id"]: len(json.loads(x["items"])) for x in alone} == {1: 4, 2: 1}
    assert chat.format_chats(m.limit(0), c.limit(0), r.limit(0), schemas).count() == 0


def test_chats_from_json_messages(spark):
    call = json.dumps({"content": "let me see", "tool_calls": [{"id": "b", "name": "add", "arguments": {"x": 2}, "needs": ["a"]}, {"id": "a", "name": "add", "arguments": {"x": 1}}]})
    silent = json.dumps({"content": None, "tool_calls": [{"id": "c", "name": "add", "arguments": {}}]})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id": "a", "content": "one"}'), (1, 3, "tool", "plain"), (1, 4, "assistant", '{"not": "a call"}'), (1, 5, "assistant", silent), (2, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("j", F.lit(1))
    out = {r["conv_id"]: r for r in chat.format_chats(*chat.from_messages(df), {"add": {"type": "object", "required": ["x"]}}).collect()}
    one = json.loads(out[1]["chat"])
    assert [(c["id"], c["valid"], c.get("result")) for c in one["calls"]] == [("a", True, "one"), ("b", True, None), ("c", False, None)] and one["calls"][1]["arguments"] == {"x": 2}
    assert [(m["role"], m["content"]) for m in one["messages"]] == [("user", "hi"), ("assistant", "let me see"), ("tool", "plain"), ("assistant", '{"not": "a call"}')]
    assert json.loads(out[2]["chat"])["messages"] == [{"content": None, "role": "assistant"}]


def test_no_assistant_turn_is_lost(spark):
    rows = [(1, 0, "assistant", "Welcome."), (1, 1, "user", "Hi"), (1, 2, "assistant", "First"), (1, 3, "assistant", "and more"), (1, 4, "user", "Bye"), (1, 5, "assistant", "Same"), (1, 5, "assistant", "Same"), (2, 0, "assistant", "Alone."), (2, 1, "assistant", None), (None, 0, "assistant", "No id."), (None, 1, "user", "Q"), (None, 2, "assistant", "A"), (3, None, "user", "no turn"), (3, 1, "assistant", "late")]
    out = {r["conv_id"]: r for r in chat.format_chats(*chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), chat.SCHEMAS).collect()}
    said = {k: json.loads(r["chat"]) for k, r in out.items()}
    assert {k: [c.get("result") for c in v["calls"]] for k, v in said.items()} == {1: ["First", "Same"], 2: [], None: ["A"], 3: [None]}
    assert {k: [m["content"] for m in v["messages"]] for k, v in said.items()} == {1: ["Welcome.", "and more", "Same"], 2: ["Alone.", None], None: ["No id."], 3: ["late"]}
    assert all(m["role"] == "assistant" for v in said.values() for m in v["messages"])


def test_items_keep_the_order_of_messages_and_calls(spark):
    call = lambda text, *ids: json.dumps({"content": text, "tool_calls": [{"id": i, "name": "add", "arguments": {}, "needs": ["a"] if i == "b" else []} for i in ids]})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call("looking", "b", "a")), (1, 2, "tool", '{"tool_call_id": "a", "content": "one"}'), (1, 3, "assistant", "so"), (1, 4, "user", "again"), (1, 5, "assistant", call(None, "c")), (1, 6, "assistant", "done")]
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "r1"), (1, 3, "system", "mid"), (1, 4, "user", "q2"), (1, 5, "assistant", "r2"), (1, 6, "assistant", "r3")]
    name = lambda x: x.get("content") if "role" in x else (x["id"], x.get("result"))
    want = [["hi", "looking", ("a", "one"), ("b", None), "so", "again", ("c", None), "done"], ["s", ("1-1", "r1"), "mid", ("1-4", "r2"), "r3"]]
    for made, data, order in ((chat.from_messages, rows, want[0]), (chat.from_turns, turns, want[1])):
        out = chat.format_chats(*made(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")), {"add": {"type": "object"}} | chat.SCHEMAS).first()
        items, apart = json.loads(out["items"]), json.loads(out["chat"])
        assert [name(x) for x in items] == order and out["items"] == chat.canonical(items) and out["chat"] == chat.canonical(apart)
        assert [{k: v for k, v in x.items() if k != "at"} for x in items if "role" in x] == apart["messages"] and len(items) == len(apart["messages"]) + len(apart["calls"])
        place = {t[1]: t for t in data}
        assert all(place[x["at"]][2] == x["role"] for x in items if "role" in x)
        assert all((x["result"] in place[x["result_at"]][3]) if "result" in x else "result_at" not in x for x in items if "role" not in x)


@pytest.mark.parametrize("made", ["turns", "messages"])
def test_every_turn_is_in_the_items_once(spark, made):
    rng = random.Random(13)
    rows = []
    for n in range(600):
        conv, turn = rng.choice([1, 2, 3, 2**53 + 1, None]), rng.choice([*range(12), None])
        text = rng.choice([None, "", "same"]) if rng.random() < 0.2 else f"t{n}"
        if made == "messages" and text and rng.random() < 0.6:
            role = rng.choice(["assistant", "tool"])
            calls = [{"id": rng.choice("abcdef") + str(turn), "name": "x", "arguments": json.dumps({"v": f"{text}-{k}"})} for k in range(rng.randrange(1, 4))]
            text = json.dumps({"content": None, "tool_calls": calls} if role == "assistant" else {"tool_call_id": rng.choice("abcdef") + str(rng.randrange(12)), "content": text})
        else:
            role = rng.choice(["user", "assistant", "system", "user", None])
        rows.append((conv, turn, role, text))
    want = defaultdict(Counter)
    for conv, _, role, text in rows:
        if made == "messages" and text and text.startswith("{"):
            j = json.loads(text)
            want[conv].update([json.loads(c["arguments"])["v"] for c in j["tool_calls"]] if role == "assistant" else [j["content"]])
        else:
            want[conv][text] += 1
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = defaultdict(Counter)
    for r in chat.format_chats(*(chat.from_turns if made == "turns" else chat.from_messages)(df), {"reply": {}, "x": {}}).collect():
        for x in json.loads(r["items"]):
            if "role" in x:
                got[r["conv_id"]][x["content"]] += 1
            else:
                got[r["conv_id"]][x["arguments"].get("v", x["arguments"].get("prompt"))] += 1
                if "result" in x:
                    got[r["conv_id"]][x["result"]] += 1
    assert got == want


def test_chats_with_odd_arguments(spark):
    deep = "[" * 3000 + "]" * 3000
    odd = {"s": '{"prompt": "\\ud800x\\ud83d\\ude00"}', "d": deep, "n": '{"a": NaN}', "i": '{"a": 1e999}', "p": "[" * 200_000, "l": '{"a": ' + "9" * 5000 + "}", "t": "x" * 2_000_000, "e": ""}
    c = spark.createDataFrame([(2**53 + 1, k, i, "any", a, None) for k, (i, a) in enumerate(odd.items())] + [(None, 0, "z", "any", None, None)], "conv_id long, pos long, call_id string, tool string, args string, needs array<string>")
    none = spark.createDataFrame([], "conv_id long, pos long, role string, call_id string, text string")
    out = {r["conv_id"]: r for r in chat.format_chats(none, c, none, {"any": {}}).collect()}
    assert set(out) == {2**53 + 1, None}
    text = out[2**53 + 1]["chat"]
    assert '"prompt":"\\ud800x😀"' in text and f'"arguments":{deep},' in text and out[2**53 + 1]["n_calls"] == 8 and out[2**53 + 1]["n_invalid"] == 6


def test_chats_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    turns = defaultdict(list)
    for r in df.collect():
        turns[r["conv_id"]].append(r)
    out = chat.format_chats(*chat.from_turns(df), chat.SCHEMAS).collect()
    assert len(out) == len(turns)
    for r in out:
        t = sorted(turns[r["conv_id"]], key=lambda x: x["turn"])
        calls, system, prev = [], False, None
        for x in t:
            if x["role"] == "user":
                calls.append({"arguments": {"prompt": x["text"], "system": system, "turn": x["turn"]}, "id": f"{x['conv_id']}-{x['turn']}", "name": "reply", "valid": True})
                prev = calls[-1]
            elif x["role"] == "system":
                system = True
            elif prev is not None:
                prev.setdefault("result", x["text"])
        want = {"calls": calls, "messages": [{"content": x["text"], "role": x["role"]} for x in t if x["role"] == "system"]}
        assert r["chat"] == json.dumps(want, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        assert r["n_open"] == sum("result" not in c for c in calls) and r["n_invalid"] == 0


# ---------------------------------------------------------------------- pipeline
def test_pipeline_matches_brute_force(spark):
    """Every stage is done again in plain Python, lengths by the encoder itself; only near-duplicate groups, which are estimated, are taken over and held against similarity elsewhere."""
    path, enc = tempfile.mkdtemp(), tokens.encoding(tokens.read_ranks())
    src = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(900, "Same text here.", "en", "src0", 15), (901, "Same text here.", "en", "src0", 15), (901, "Same text here.", "en", "src0", 15), (None, "No id at all.", "en", None, 13), (902, None, "en", "src1", None), (903, "", "en", "src1", 0)]
    src.unionByName(spark.createDataFrame(extra, DOC)).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [(r["doc_id"], brute_clean(r["text"]), r["source"]) for r in docs.collect()]
    rows = [r for r in rows if r[1] is not None]
    removed = Counter(d for d, _, _ in brute_copies([(i, t) for i, t, _ in rows]))
    kept, seen = [], set()
    for i, t, s in sorted(rows, key=lambda r: ((3 if r[0] is None else r[0] % 4), r[0] is None, r[0] or 0)):
        if t not in seen:
            seen.add(t)
            kept.append((i, t, s))
    assert len(kept) == len(rows) - sum(removed.values())
    clean = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in kept], DOC)
    near = {r["doc_id"] for r in minhash.near_groups(clean).collect() if not r["kept"]}
    kept = [r for r in kept if r[0] not in near]
    counts, _ = brute_mix([(i, s, len(t)) for i, t, s in kept])
    text = {(i, s): t for i, t, s in kept}
    got = corpus_pipeline.run(spark, path).collect()
    pieces = Counter()
    for r in got:
        pieces[r["doc_id"]] += r["length"]
    want = Counter()
    for (i, s), n in counts.items():
        want[i] += n * (len(enc.encode_ordinary(text[(i, s)])) + packing.END_TOKENS)
    assert pieces == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mix sources", "packing"] and exact_dedup.GENERATIONS == 4


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
