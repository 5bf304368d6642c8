"""Canonical forms, encoding, mixing and the rating of passages."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestra.llm import abuse, confusables, encoding, mixing, tokens
from attestra.llm.unicode_forms import canonical, quick_check

# --- Forms -------------------------------------------------------------------------------------

SAME = [None, "", "plain", "Naïve Größe R² β-Trees", "τ-noise under λ", "Устойчивая оценка Xyz", "О выборе", "基于模型的方法（第二版）：结果", "پیش\u200cبینی بار", "L’étude", "Đánh giá lại", "예측 방법", "データの評価", "étude : suite"]
CHANGED = {
    "Ｆｕｌｌ width": "Full width", "a\u200bb\u00adc": "abc", "a b c": "a b c", "Ѕеа оf drift": "Sea of drift", "Οmega Βlock": "Omega Block", "e\u0301tude": "étude", "ﬁlter ﬃ": "filter ffi", "Part Ⅱ": "Part II", "Keⅼvin K": "Kelvin K",
    "multi‐scale": "multi-scale", "ｶﾞｳｽ過程": "ガウス過程", "Deⅼosh Reⅿfeոez": "Delosh Remfenez", "пpoгноз": "прогноз", "а\u200db": "ab", "title：English": "title:English", "\ufeffstart": "start", "다\u1100\u1161": "다가",
}


def test_forms():
    for text in SAME:
        assert canonical(text) == text
    for text, want in CHANGED.items():
        assert canonical(text) == want, text
    assert canonical("Τ.", "Τ. Smith", symbols=False) == "T."


@given(st.text(alphabet=st.sampled_from("ab eé\u0301\u0308оо\u200b\u00adＡＢⅱﬁοσ漢：ガｶﾞ가\u1100\u1161\u200cب-‐ "), max_size=14))
@settings(max_examples=400, deadline=None)
def test_forms_are_stable(text):
    once = canonical(text)
    assert canonical(once) == once
    assert all(quick_check(c) != "yes" for c in text) or len(once) <= 3 * len(text)


def test_prefilter_keeps_only_stable_characters(spark):
    stable = re.compile(f"[{confusables.STABLE}]")
    assert [hex(i) for i in range(0x10000) if stable.match(chr(i)) and quick_check(chr(i)) != "yes"] == []
    rows = spark.createDataFrame([("B\u0133drage",), ("\u0132ssel",), ("Bijdrage",)], "t string").withColumn("u", confusables.unstable(F.col("t")))
    assert [r.u for r in rows.collect()] == [True, True, False]
    assert canonical("B\u0133drage") == "Bijdrage"


PAPERS = "row_id bigint, title string, authors array<struct<name:string>>"


def test_findings(spark):
    rows = [(1, "Ｆｕｌｌ", [("Ada",)]), (2, "fine", [("A\u200bda",), None, (None,)]), (3, None, None), (4, "", []), (5, "β-x", [("Β. Smith",)]), (6, "x" * 100_000 + "\u200b", None)]
    table = spark.createDataFrame(rows, PAPERS).withColumns({"names": F.lit(1), "field": F.lit(2), "stored": F.lit(3)})
    want = {(1, "title"), (2, "authors"), (5, "authors"), (6, "title")}
    assert {(r.row_id, r.field) for r in confusables.findings(table).collect()} == want
    assert confusables.findings(table.union(table)).count() == 2 * len(want)
    assert confusables.findings(table.limit(0)).count() == 0
    fixed = {r.row_id: r for r in confusables.canonical_fields(table).collect()}
    assert len(fixed) == 6 and fixed[1].title == "Full" and fixed[2].authors == ["Ada", None, None] and fixed[5].authors == ["B. Smith"] and fixed[3].title is None


# --- Encoding ----------------------------------------------------------------------------------


@given(st.lists(st.sampled_from(["'", " ", "  ", "\n", "s", "re", "ll", "'re", "a", "1", "é", "漢", "😀", ".", "…"]), max_size=20).map("".join), st.lists(st.integers(1, 30), max_size=5))
@settings(max_examples=500, deadline=None)
def test_joins_are_exact(text, cuts):
    tok = tokens.tokenizer()
    ends = sorted({c for c in cuts if c < len(text)} | ({len(text)} if text else set()))
    pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
    assert tokens.join_chunks([tokens.encode_chunk(p, tok) for p in pieces], tok) == tok.encode(text)


def test_cuts_follow_content():
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    a, b = tokens.cut_points(body), tokens.cut_points("some other start. " + body)
    assert len({x + 18 for x in a} & set(b)) > 0.8 * len(a) and a[-1] == len(body) and tokens.cut_points("") == []
    assert max(y - x for x, y in zip([0, *a], a)) <= 4096 and tokens.cut_points("a" * 9000)[-1] == 9000


DOCUMENTS = "doc_id bigint, text string, source string"


def test_encoding(spark):
    tok = tokens.tokenizer()
    texts = [None, "", " ", "It's  a 'test'...\n\n" * 400, "<|endoftext|>", "a" * 20_000, "漢字かな交じり文😀" * 300, " " * 5000, "x\r\ny\ttab", "'" * 3000]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "null id", "s"), (3, texts[3], "s")], DOCUMENTS).withColumns({"key": F.lit(1), "seq": F.lit(2), "ids": F.lit(3), "_row": F.lit(4), "chunk": F.lit(5)})
    got = encoding.encode_documents(rows.repartition(3)).collect()
    assert len(got) == len(texts) + 2 and sum(r.doc_id == 3 for r in got) == 2
    for r in got:
        assert r.ids == tok.encode("null id" if r.doc_id is None else texts[r.doc_id] or "")
    assert encoding.encode_documents(rows.limit(0)).count() == 0
    counted = {r.doc_id: r.tokens for r in encoding.count_tokens(rows).collect()}
    assert counted[0] == counted[1] == 0 and counted[3] == len(tok.encode(texts[3]))
    back = b"".join(tok.encoding.decode_single_token_bytes(i) for i in next(r.ids for r in got if r.doc_id == 6))
    assert back.decode() == texts[6]


# --- Mixing ------------------------------------------------------------------------------------

SIZED, TARGETS = "doc_id bigint, source string, tokens bigint", "source string, target_weight double, max_repeats int"


def brute_mix(spark, sized, targets, budget):
    weights = {s: (w, r) for s, w, r in targets if any(d[1] == s and d[2] > 0 for d in sized)}
    total = sum(w for w, _ in weights.values())
    queue = []
    for s, (w, repeats) in weights.items():
        mine = [d for d in sized if d[1] == s and d[2] > 0]
        rows = spark.createDataFrame([(d[0], s, c, d[2]) for d in mine for c in range(repeats)], "doc_id bigint, source string, copy int, tokens bigint")
        drawn = rows.withColumn("draw", F.pmod(F.xxhash64(F.lit(0), "copy", "source", "doc_id"), F.lit(1 << 40))).collect()
        done = 0
        for r in sorted(drawn, key=lambda r: (r.copy, r.draw, r.doc_id)):
            done += r.tokens
            queue.append((done / (w / total), s, r.copy, r.draw, r.doc_id, r.tokens))
    out, used = [], 0
    for finish, s, copy, _, doc, size in sorted(queue):
        used += size
        if used > budget:
            break
        out.append((doc, s, copy))
    return out


@pytest.mark.parametrize("range_rows", [7, 50_000])
def test_mix_against_a_queue(spark, range_rows):
    rng = random.Random(5)
    sized = [(i, rng.choice("aaabc"), rng.randint(1, 50)) for i in range(300)]
    targets = [("a", 0.2, 1), ("b", 1.0, 3), ("c", 0.8, 2), ("none", 3.0, 9)]
    table, goal = spark.createDataFrame(sized, SIZED), spark.createDataFrame(targets, TARGETS)
    budget = mixing.plan(table, goal).first().budget
    got = mixing.mix(table, goal, range_rows=range_rows).collect()
    assert [(r.doc_id, r.source, r.copy) for r in sorted(got, key=lambda r: r.mixed_tokens)] == brute_mix(spark, sized, targets, budget)
    assert max(r.mixed_tokens for r in got) == sum(r.tokens for r in got) <= budget
    for r in mixing.shares(mixing.mix(table, goal), table, goal).collect():
        assert abs(r.reached_share - r.target_share) < 0.02 and r.most_uses <= {"a": 1, "b": 3, "c": 2, "none": 0}[r.source]
    small = mixing.mix(table, goal, budget=100).collect()
    assert sum(r.tokens for r in small) <= 100
    huge = mixing.mix(table, goal, budget=10**9).collect()
    assert len(huge) == sum({"a": 1, "b": 3, "c": 2}[s] for _, s, _ in sized)


def test_mix_awkward(spark):
    goal = spark.createDataFrame([("a", 1.0, 2), ("a", 0.5, 9), ("b", None, 1), ("c", 1.0, 0), (None, 1.0, 1), ("d", -1.0, 1)], TARGETS)
    sized = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "a", 0), (3, None, 4), (4, "z", 3), (5, "b", 2), (None, "a", 1)], SIZED)
    got = mixing.mix(sized.withColumns({"copy": F.lit(1), "share": F.lit(2), "_part": F.lit(3)}), goal).collect()
    assert sorted((r.doc_id or 0, r.copy) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 0), (1, 1), (1, 1)]
    assert mixing.mix(sized.limit(0), goal).count() == 0 and mixing.mix(sized, goal.limit(0)).count() == 0


# --- Abuse -------------------------------------------------------------------------------------


def test_hidden_spellings():
    reader = abuse.Reader(("moron", "idiot", "nude", "bastard", "leech", "asshole"))
    words = lambda t: [w for p in reader.passages(t) for w in p]
    assert words("you m*ron") == ["you", "moron"] and words("i d i o t") == ["idiot"] and words("nu\u200bde b@stard b@$tard") == ["nude", "bastard", "bastard"] and words("idiooooot le-ch as$hole") == ["idiot", "leech", "asshole"] and words("іdiоt") == ["idiot"]
    assert reader.passages(None) == [] and reader.passages("  \n ") == [] and words("at 12,345.6 pts") == ["at", "0", "pts"]
    assert all(len(p) <= abuse.WINDOW for p in reader.passages("word " * 5000)) and len(reader.passages("word " * 5000)) > 400
    told = abuse.telling_words(["you are what nobody wants here"] * 50)
    assert "moron" in told and "nobody" not in told and words("4.5 m.t 7.75") == ["0", "m.t", "0"]


CALM = ["The model was trained on {} regions.", "Figure {} names the wrong span.", "We rerun the sweep with {} seeds.", "Die Streuung liegt bei {}.", "El error medio es {}.", "Damn, the script broke again after {} runs.", "I am such an idiot, I forgot seed {}.", "The stupid baseline wins by {} points."]
FOUL = ["You are a {} and nobody wants you here.", "Shut up, you {}.", "Only a {} like you could write this.", "This {} should be thrown out."]
SLURS = ["moron", "useless clown", "worthless scumbag", "pathetic liar"]
# Held out: other frames and other words than those of training.
NEW_CALM = ["Table {} repeats the caption of the last one.", "The reviewer asks for {} more runs.", "My stupid laptop lost {} files.", "Les graines sont au nombre de {}."]
NEW_FOUL = ["What a {} you are.", "Nobody needs a {} such as this author.", "You {}, leave this field for good.", "You write like a {}, so go away."]
NEW_SLURS = ["imbecile", "brainless cretin", "disgusting pig", "worthless coward"]


def corpus(seed, n, calm=tuple(CALM), frames=tuple(FOUL), slurs=tuple(SLURS)):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = [rng.choice(calm).format(rng.randint(1, 99)) for _ in range(rng.randint(2, 6))]
        foul = rng.random() < 0.1
        if foul:
            lines.insert(rng.randrange(len(lines)), rng.choice(frames).format(rng.choice(slurs)))
        out.append((i, " ".join(lines), foul))
    return out


@pytest.mark.parametrize("new, least", [(False, 0.9), (True, 0.6)])
def test_held_out_accuracy(spark, new, least):
    """Texts without a rating, of known frames and words or of others; as in use, the unlabelled texts are those of the corpus."""
    train, test = corpus(1, 600), corpus(2, 600, (*CALM, *NEW_CALM), NEW_FOUL, NEW_SLURS) if new else corpus(2, 600)
    rng = random.Random(3)
    rated = [(t, int(f != (rng.random() < 0.05))) for _, t, f in train[:200]]
    model = abuse.fit_texts(rated, [t for _, t, _ in train + test])
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in test], DOCUMENTS)
    got = {r.doc_id: r.offensive for r in abuse.score(docs, model).collect()}
    hits = sum(got[i] and f for i, _, f in test)
    assert hits >= least * sum(f for *_, f in test) and hits >= 0.9 * sum(got.values())


def test_risk_is_not_negative():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 6)).astype(np.int32) for _ in range(60)]
    model = abuse.train(rows[:20], np.ones(20), rows, np.ones(60), prior=0.5, steps=300)
    z = model.scores(rows)
    assert np.isfinite(z).all() and np.abs(z).max() < 50
    again = abuse.train(rows[:20], np.ones(20), rows, np.ones(60), prior=0.5, steps=300)
    assert np.array_equal(model.weights, again.weights)


def test_scores_of_awkward_rows(spark):
    labels = "label_id bigint, doc_id bigint, rater string, offensive int"
    rows = [(1, "You are a moron and nobody wants you here.", "a"), (2, None, None), (3, "", "a"), (4, "The mean is 5. " * 4000, None), (None, "Fine text.", "a")]
    docs = spark.createDataFrame(rows + rows[:1], DOCUMENTS).withColumns({"score": F.lit(9), "rated": F.lit(1), "offensive": F.lit(2)})
    rated = spark.createDataFrame([(1, 1, "r", 1), (2, 4, "r", 0), (3, 4, "s", None), (4, 99, "r", 1), (5, None, "r", 1)], labels)
    model = abuse.fit(docs, rated)
    got = abuse.score(docs, model).collect()
    assert len(got) == 6 and all(r.score is None and not r.offensive for r in got if r.doc_id in (2, 3)) and not any(r.offensive for r in got if r.doc_id == 4)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    by_source = {r.source: (r.documents, r.offensive) for r in abuse.rates(abuse.score(docs, model)).collect()}
    assert by_source["a"][0] == 4 and by_source[None] == (2, 0)
    empty = abuse.fit(docs.limit(0), rated.limit(0))
    assert abuse.score(docs.limit(0), empty).count() == 0 and not math.isnan(empty.bias)
