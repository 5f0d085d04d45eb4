"""Language identification, conversation repair and importance resampling against plain versions and on odd inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbmark.llm import common, language, resample, turns, workload

DATA = "/root/testdata/sf0.01"
#: Ids, texts and languages, with columns whose names the operators use themselves.
ODD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \n\t 123 !?", "en"),
    (None, "one two three four five six seven", None),
    (4, "the word and the other word of the text and more words with the rest", "en"),
    (4, "the word and the other word of the text and more words with the rest", "en"),
    (5, "der Satz und die anderen Wörter in dem Text und noch mehr Wörter", "de"),
    (6, "word", None),
    (7, "Ünïcödé ÇÀ 漢字 x1 y2 \x00 z", "fr"),
    (8, "long " * 30_000 + "ende", "en"),
]
SCHEMA = "doc_id long, text string, lang string, row long, score double, rank int, part string, gram int, n int"


@pytest.fixture(scope="module")
def odd(spark):
    common.small_batches(spark)
    return spark.createDataFrame([(*r, 7, 0.5, 3, "x", 1, 2) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- importance resampling


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_features(text):
    words = plain_words(text)
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resampled(docs, targets, share=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    source, target = Counter(), Counter()
    for _, text in docs:
        source.update(map(bucket, plain_features(text)))
    for text in targets:
        target.update(map(bucket, plain_features(text)))
    total, aims = sum(source.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (total + 10_000) / ((source[b] + 1) * (aims + 10_000)))) for b in range(10_000)}
    rows = []
    for doc, text in docs:
        features = plain_features(text)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = able[: share * len(able) // 100]
    out = Counter((*r[:4], None) for r in rows)
    for i, r in enumerate(drawn, 1):
        out[(*r[:4], None)] -= 1
        out[(*r[:4], i)] += 1
    return +out


def test_resampled_equals_plain(spark):
    common.small_batches(spark)
    got = workload.QUERIES["op13_importance_resampling"](spark, DATA)
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    docs = [(r.doc_id, r.text) for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()]
    targets = [r.text for r in common.table(spark, DATA, "benchmark").collect()]
    assert Counter(map(tuple, got.collect())) == plain_resampled(docs, targets)


@pytest.mark.parametrize("share,least", [(5, 1), (50, 1), (100, 0), (0, 0), (30, 5)])
def test_resampled_odd(spark, odd, empty, share, least):
    targets = spark.createDataFrame([("the word and more", 1), (None, 2)], "text string, score int")
    got = resample.resampled(odd, targets, share=share, least_words=least)
    assert Counter(map(tuple, got.collect())) == plain_resampled([r[:2] for r in ODD], ["the word and more", None], share, least)
    assert resample.resampled(empty, targets, share=share, least_words=least).count() == 0
    got = resample.resampled(odd, targets.limit(0), share=share, least_words=least)
    assert Counter(map(tuple, got.collect())) == plain_resampled([r[:2] for r in ODD], [], share, least)


def test_cutoff_in_every_bracket(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 97), int(s)) for i, s in enumerate(rng.integers(0, 40, 3000))]
    frame = spark.createDataFrame(rows, "row long, doc_id long, score long").cache()
    ordered = sorted(rows, key=lambda r: (-r[2], r[1], r[0]))
    for wanted in (1, 7, 150, 2999, 3000):
        at = ordered[wanted - 1]
        for marks in ([(0, 39)], [(38, 38), (0, 39)], [(at[2], at[2]), (0, 39)], [(5, 6), (3, 30), (0, 39)]):
            assert resample.cutoff(frame, wanted, marks) == (at[2], at[1], at[0])


def test_drawn_documents_keep_columns(spark, odd):
    targets = spark.createDataFrame([("the word and more",)], "text string")
    drawn = resample.drawn_documents(odd, targets, share=100, least_words=0)
    assert drawn.columns == odd.columns
    assert drawn.count() == len(ODD)


# --- language identification


def test_letters_and_grams():
    assert language.letters_of(" 12\n!") is None
    assert language.letters_of("Äb, c9").tolist() == [0, ord("ä"), ord("b"), 0, ord("c"), 0]
    codes = language.letters_of("abc de")
    assert sum(len(g) for g in language.grams(codes)) == 5 + 3  # _ab abc bc_ _de de_, _abc abc_ _de_
    whole = np.concatenate(list(language.grams(language.letters_of("some words here " * 50))))
    old, language.STEP = language.STEP, 7
    try:
        parts = np.concatenate(list(language.grams(language.letters_of("some words here " * 50))))
    finally:
        language.STEP = old
    assert Counter(whole.tolist()) == Counter(parts.tolist())


def test_filter_holds_what_was_learnt(spark):
    """Every n-gram that a plain count keeps is in its language's slice; others are there about as often as the fill says."""
    docs = common.table(spark, DATA, "documents").where(~language.held_out(F.col("doc_id")))
    model = language.learnt(docs)
    rows = docs.select("lang", "text").dropna().collect()
    size, seen = Counter(r.lang for r in rows), {name: Counter() for name in model.names}
    for r in rows:
        codes = language.letters_of(r.text)
        if codes is not None:
            seen[r.lang].update({int(x) for g in language.grams(codes) for x in g})
    share = {name: {g: n / size[name] for g, n in seen[name].items() if n >= language.LEAST_DOCS and n / size[name] >= language.LEAST_SHARE} for name in model.names}
    every = sorted(set().union(*share.values()))
    top = {g: max(s.get(g, 0) for s in share.values()) for g in every}
    hashes = np.array(every, np.uint64)
    first, step = hashes & np.uint64(language.ROWS - 1), (hashes >> np.uint64(32)) | np.uint64(1)
    masks = model.rows[first]
    for i in range(1, language.HASHES):
        masks &= model.rows[(first + np.uint64(i) * step) & np.uint64(language.ROWS - 1)]
    wrong = 0
    for at, name in enumerate(model.names):
        held = (masks[:, at // 8] >> (at % 8)) & 1
        for g, bit in zip(every, held.tolist(), strict=True):
            kept = share[name].get(g, 0) >= max(language.LEAST_PART * top[g], 1e-12)
            assert bit or not kept
            wrong += bit and not kept
    assert wrong <= 0.02 * len(every) * len(model.names) + len(every) * float((model.fill**language.HASHES).sum())


def test_language_accuracy_held_out(spark):
    common.small_batches(spark)
    got = workload.QUERIES["op11_language_id"](spark, DATA)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    truth = {r.doc_id: r for r in common.table(spark, DATA, "documents").collect()}
    rows = got.collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        letters = any(c.isalpha() for c in truth[r.doc_id].text or "")
        assert (r.lang_pred == "und") == (not letters)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_language_odd(spark, odd, empty):
    model = language.learnt(odd)
    assert model.names == ["en", "de", "fr"]
    got = language.languages(odd, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].lang_pred == by_id[2].lang_pred == by_id[3].lang_pred == "und"
    assert by_id[7].lang_pred == "en" and by_id[7].score == 0.0  # no known n-gram
    assert by_id[4].lang_pred == "en" and by_id[4].score > 0.5
    assert language.languages(empty, model).count() == 0
    nothing = language.learnt(empty)
    assert {r.lang_pred for r in language.languages(odd, nothing).collect()} == {"und"}


def test_language_many(spark):
    """More languages than one byte of the bit mask holds."""
    rng = random.Random(3)
    rows = []
    for i in range(40):
        letters = "".join(chr(0x4E00 + 30 * i + k) for k in range(30))
        rows += [(d, " ".join("".join(rng.choices(letters[:6], k=4)) for _ in range(60)), f"l{i:02}") for d in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.languages(frame.withColumn("doc_id", F.concat("lang", F.lit(":"), "doc_id")), language.learnt(frame)).collect()
    assert all(r.lang_pred == r.doc_id.split(":")[0] for r in got)


# --- conversation repair


def plain_repair(rows):
    """Faults and the least (cost, audit, result) by trying every edit of every row and every short insertion between rows."""
    seen, faults = set(), []
    for role, text in rows:
        solid = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-")
        seen.add((role, text))
    names = {"u": "user", "a": "assistant"}
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = [["D"] if f in "bd" else ["K", "D", "Ru", "Ra"] for f in faults]
    for edits in itertools.product(*choices):
        cost = sum({"K": 0, "R": 2, "D": 3}[e[0]] + (e != "D" and f == "t") for e, f in zip(edits, faults, strict=True))
        if best is not None and cost > best[0]:
            continue
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            total = cost + 2 * sum(map(len, inserted))
            if best is not None and total > best[0]:
                continue
            audit, out = "I" * len(inserted[0]), [(names[x], "") for x in inserted[0]]
            for (role, text), e, more in zip(rows, edits, inserted[1:], strict=True):
                audit += e[0]
                if e != "D":
                    out.append((role if e == "K" else names[e[1]], text))
                audit += "I" * len(more)
                out += [(names[x], "") for x in more]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in out)) and (best is None or (total, audit) < best[:2]):
                best = total, audit, out
    initials = [r[:1] for r, _ in rows]
    counts = [faults.count(f) for f in "bdt"]
    return (*counts, sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), *best)


def plain_damaged(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [("user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def expected_reports(rows, damage):
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).extend((turn, r, t) for r, t in (damage(conv, turn, role, text)))
    out = {}
    for conv, held in by_conv.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        known = [t for t, _, _ in held if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        blank, dup, cut, illegal, cost, audit, result = plain_repair([r[1:] for r in held])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest()
        out[conv] = (conv, gaps, blank, dup, cut, illegal, cost, audit, sha)
    return out


def random_conversations(rng, n, most):
    """Distinct turns, so that rows have one order."""
    rows = []
    for conv in range(n):
        turns_ = rng.sample([None, *range(9)], rng.randint(1, most))
        for turn in turns_:
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "umpire"])
            rows.append((conv if conv else None, turn, role, rng.choice(["Yes.", "No", "Why?", "", " \n", None, "é　", "So. \t"])))
    return rows


def test_repair_equals_trying_all(spark):
    rows = random_conversations(random.Random(1), 60, 3)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, of int")
    clean = frame.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    got = {r.conv_id: tuple(r) for r in turns.repair_report(clean, frame).collect()}
    expected = expected_reports(rows, lambda c, t, r, x: [(" " if r is None else r, " " if x is None else x)])
    assert got == expected
    texts = {}
    for r in turns.repaired(frame).orderBy("conv_id", "position").collect():
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() for c in expected} == {c: e[-1] for c, e in expected.items()}


def test_query_equals_trying_all(spark, tmp_path):
    rows = [r for r in random_conversations(random.Random(2), 250, 2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r) for r in workload.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == expected_reports(rows, plain_damaged)


def test_query_schema_and_whole_table(spark):
    got = workload.QUERIES["op12_conversation_repair"](spark, DATA)
    assert dict(got.dtypes) == {"conv_id": "bigint", **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"), "audit": "string", "repaired_sha256": "string"}
    convs = common.table(spark, DATA, "conversations")
    assert got.count() == convs.select("conv_id").distinct().count()


def test_long_conversation_in_stretches(spark, monkeypatch):
    """A conversation over several stretches and tasks equals one derivation over all its rows."""
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["One.", "Two", "Three!", "", str(i) + "."])) for i in range(300)]
    rows += [(8, i, "user", "Same.") for i in range(300)] + [(9, 3, "user", "Copy.")] * 300 + [(c, 0, "user", "A.") for c in range(100, 140)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    whole = {r.conv_id: tuple(r) for r in turns.repair_report(frame, frame).collect()}
    monkeypatch.setattr(turns, "STRETCH", 16)
    assert {r.conv_id: tuple(r) for r in turns.repair_report(frame, frame).collect()} == whole
    seen, signs = set(), ""
    for _, _, role, text in rows[:300]:
        signs += role[0] + ("b" if not text else "d" if (role, text) in seen else "-" if text[-1] in ".!?" else "t")
        seen.add((role, text))
    assert whole[7][6:8] == turns.derived(signs, "-", True)["goal"]
    assert whole[9][1:8] == (0, 0, 299, 0, 299, 2 + 3 * 299, "K" + "D" * 299 + "I")


def test_lightest_is_knuth_order():
    popped = []

    def edges(item):
        popped.append(item)
        yield from {"s": [(1, "b", "x"), (1, "a", "y")], "x": [(0, "z", "g")], "y": [(0, "z", "g")]}.get(item, [])

    assert turns.lightest(edges, "s", "g")["g"] == (1, "az")
    assert popped == ["s", "y"]  # the goal finalises before the heavier item


def test_repair_empty(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair_report(nothing, nothing).count() == 0
    assert turns.repaired(nothing).count() == 0
    lone = spark.createDataFrame([(1,), (None,)], "conv_id long")
    empty_digest = hashlib.sha256(b"").hexdigest()
    assert Counter(map(tuple, turns.repair_report(nothing, lone).collect())) == Counter((c, 0, 0, 0, 0, 0, 0, "", empty_digest) for c in (1, None))
