import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.llm import abuse, contamination, lookalikes, mixing, queries
from rillwork.llm.shared_spans import common_spans, shared_spans
from rillwork.llm.text_arrays import WindowHash, sliding

# -- abuse


def test_abuse_generalises_to_disguised_words():
    s = abuse.fit_scorer(["you are a dumbass", "what a nice map", "死ね", "この鍋いいね", "show us your tits"], ["abusive", "none", "abusive", "none", "sexual"])
    bad = ["you are a d_u_m_b_a_s_s", "what a nice map 死-ね", "you are a dumba55", "ugly moron\nthe map looks great", "send nudes"]
    good = ["what a nice kettle", "this boss is killing me", "gg", "死角の釉薬が上手", "the map looks great today"]
    p = 1 - s.probabilities([*bad, *good])[:, 0]
    assert p[: len(bad)].min() > 0.5 and p[len(bad) :].max() < 0.5


def test_abuse_scores_every_row(spark):
    s = abuse.fit_scorer(["you idiot", "fine day"], ["abusive", "none"])
    df = spark.createDataFrame([(1, "you idiot", 0.5), (2, None, 0.5), (3, " ", 0.5), (3, " ", 0.5), (4, "fine " * 5000, 0.5)], "row_id long, content string, score double")
    got = {r["row_id"]: r for r in abuse.score_texts(df, "content", ["row_id"], s).collect()}
    assert got[1]["score"] > 0.5 and got[1]["label"] == "abusive" and got[2]["score"] == 0 and got[3]["label"] == "none" and len(got) == 4 and got[4]["score"] < 0.5
    assert abuse.score_texts(df, "content", ["row_id"], s).count() == 5 and abuse.score_texts(df.limit(0), "content", ["row_id"], s).count() == 0
    with pytest.raises(ValueError):
        abuse.fit_scorer([None, "x"], ["none", None])


def test_much_repeated_insult_is_found(spark, tmp_path):
    """One pasted insult is a third of all comments; its score and that of a similar one do not suffer from it."""
    insult, similar = "go hang yourself you worthless clown", "you worthless clown, go hang yourself lol"
    calm = [f"{a} {b} {c}" for a in ("the", "what a nice", "I like that", "look at the") for b in "map boss kettle soup camera dog window song lantern tower".split() for c in ("today", "again", "over there")]
    rows = [(i, 1, t) for i, t in enumerate([*calm, similar, *[insult] * (len(calm) // 2)])]
    spark.createDataFrame(rows, "delivery_id long, live_id long, content string").write.parquet(f"{tmp_path}/chat_comments.parquet")
    spark.createDataFrame([(1, 1, calm[0])], "op_delivery_id long, live_id long, content string").write.parquet(f"{tmp_path}/operator_comments.parquet")
    labels = [(1, "you are a dumbass", "abusive"), (2, "what a nice map", "none"), (3, "死ね", "abusive"), (4, "この鍋いいね", "none"), (5, "show us your tits", "sexual"), (6, "good morning all", "none")]
    spark.createDataFrame(labels, "label_id long, text string, label string").write.parquet(f"{tmp_path}/abuse_labels.parquet")
    got = {(r["table_name"], r["row_id"]) for r in queries.p4_found(spark, str(tmp_path)).collect()}
    assert got == {("chat_comments", i) for i, _, t in rows if t in (insult, similar)}


@pytest.mark.parametrize("core", ["{}もろくに扱えない出来損ない", "let us hope the {} crushes every bone in you"])
def test_abuse_of_one_labelled_row_is_not_taught_as_harmless(core):
    """Background has the wording of a single labelled row; a wrong label; a clause of unknown words."""
    things = "map boss kettle soup camera dog window song lantern tower".split()
    calm = [f"{a} {t} {b}" for t in things for a, b in (("what a nice", "again"), ("I like that", "today"), ("look at the", "over there"))]
    rows = [*[(t, "none") for t in calm], *[(f"you are a dumb {t} and a loser", "abusive") for t in things], *[(f"show us your tits on the {t}", "sexual") for t in things[:5]], (core.format("soup"), "abusive"), ("good evening everyone", "abusive"), ("good evening everyone and hello", "none")]
    background = [*[core.format(t) for t in things], *["good evening everyone", "greetings"], *[f"{a} {t}" for t in things for a in ("new", "calm", "that odd", "the loud")]]
    s = abuse.fit_scorer([t for t, _ in rows], [y for _, y in rows], background)
    p = 1 - s.probabilities([core.format("camera"), core.format("piano"), "good evening everyone", "フヌ plorvik ギョ"])[:, 0]
    assert p[:2].min() >= queries.ABUSE_THRESHOLD and p[2:].max() < queries.ABUSE_THRESHOLD


def test_what_stands_beside_abuse_is_no_abuse():
    """Function words, of which insults have many, and a greeting that only abusive rows have."""
    nouns, adjectives, things = "idiot moron loser clown".split(), "stupid ugly useless".split(), "map boss kettle soup camera dog window song lantern tower".split()
    rude = [*[f"you are a {a} {n} and they are all {a}" for a in adjectives for n in nouns], *[f"these {t} people are vermin and should be shot" for t in ("hill", "river", "island")]]
    calm = [f"{a} {t} {b}" for t in things for a, b in (("nice", "again"), ("new", "today"), ("this", "level"), ("my old", "broke"))]
    rows = [*[(t, "none") for t in calm], *[(t, "abusive") for t in rude], ("zounds ahoy\nyou ugly moron", "abusive"), ("zounds ahoy\ndrop dead you loser", "abusive"), ("kill yourself\nzounds ahoy", "abusive")]
    s = abuse.fit_scorer([t for t, _ in rows], [y for _, y in rows], [*calm, "zounds ahoy", "hare and pare", "they are there and there"])
    p = 1 - s.probabilities(["zounds ahoy", "hare and pare", "they are there and there", "you are a useless clown", "zounds ahoy\nugly idiot"])[:, 0]
    assert p[:3].max() < queries.ABUSE_THRESHOLD <= p[3:].min()


# -- look-alikes


def test_forms():
    same = [("Überraѕchung　for everу viеwer", "Überraschung for every viewer"), ("ﾎﾟｰｼｮﾝ​", "ポーション"), ("Τokі＿１", "Toki_1"), ("café", "café"), ("a b", "a b"), ("дoм", "дом"), ("сор", "cop"), ("力ー", "カー"), ("二ュース", "ニュース")]
    other = [("cafe", "café"), ("Team", "team"), ("a  b", "a b"), ("フレ", "プレ"), ("①", "1"), ("\U0001f468‍\U0001f469", "\U0001f468\U0001f469"), ("дом", "dom"), ("ﬁ", "fi")]
    for a, b in same:
        assert lookalikes.consistent_form(a) == lookalikes.consistent_form(b), (a, b)
    for a, b in other:
        assert lookalikes.consistent_form(a) != lookalikes.consistent_form(b), (a, b)
    for a, _ in [*same, *other]:
        f = lookalikes.consistent_form(a)
        assert lookalikes.consistent_form(f) == f


def test_mixed_and_whole_script_words(spark):
    kinds = {"hello": None, "hеllo": "mixed", "сосо": "whole", "привет": None, "ОРТ": "whole", "ꓐꓰꓔ": "whole", "naïve": None, "ΤΟΚΙ": "whole", "λόγος": None, "αpple": "mixed"}
    assert {w: lookalikes.confusion(w) for w in kinds} == kinds
    assert lookalikes.resolved_scripts("сосо") >= {"Latin", "Cyrillic"} and lookalikes.resolved_scripts("привет") == {"Cyrillic"} and lookalikes.resolved_scripts("zф") == set()
    assert lookalikes.consistent_form("ꓐꓰꓔ") == "BET"
    df = spark.createDataFrame([(1, "hеllo сосо сосо"), (2, "hi"), (3, None), (4, "")], "i int, t string")
    assert {r["i"]: (r["mixed"], r["whole"]) for r in lookalikes.confused_tokens(df, "t").collect()} == {1: (1, 2), 2: (0, 0), 3: (None, None), 4: (0, 0)}


def test_lookalike_classes_hold_the_pairs(spark):
    rows = [(1, i, t) for i, t in enumerate(["abc", "аbc", "abc", "ａｂｃ", "xyz", "xyz"])] + [(None, 9, "abc"), (None, 10, "аbc"), (2, 11, "аbc")]
    df = spark.createDataFrame(rows, "g int, id long, t string")
    got = {(r["row_id"], r["class_id"], r["spellings"]) for r in lookalikes.lookalike_classes(df, ["g"], "id", "t").collect()}
    assert got == {(0, 0, 3), (1, 0, 3), (2, 0, 3), (3, 0, 3), (9, 9, 2), (10, 9, 2)}


def test_lookalike_pairs_against_brute_force(spark):
    r = random.Random(4)
    texts = ["abc", "аbc", "abс", "ａｂｃ", "abcd", "", "​", "x y", "x　y", None]
    rows = [(r.choice([1, 1, 1, 2, None]), i, r.choice(texts)) for i in range(150)] + [(1, None, "abc")]
    rows += rows[:10]
    df = spark.createDataFrame([(*x, 0) for x in rows], "g int, id long, t string, form int")
    got = {tuple(x) for x in lookalikes.lookalike_pairs(df, ["g"], "id", "t").collect()}
    rows = list(dict.fromkeys(rows))
    f = lookalikes.consistent_form
    want = {(g, i, j) for g, i, a in rows for h, j, b in rows if g == h and None not in (i, j, a, b) and i < j and a != b and f(a) == f(b)}
    assert got == want and want
    assert lookalikes.lookalike_pairs(df.limit(0), ["g"], "id", "t").count() == 0


# -- leaks


def norm(s):
    return "".join(c for c in s.lower() if c.isalnum())


def test_leaks_against_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé灯路漢") for _ in range(r.randint(2, 7)))
    base = " ".join(word() for _ in range(12))
    items = [(i, base + " " + " ".join(word() for _ in range(20))) for i in range(12)] + [(50, "short"), (51, None), (52, "")]
    docs = []
    for i in range(80):
        t = " ".join(word() for _ in range(40))
        for _ in range(r.randint(0, 2)):
            s = items[r.randrange(12)][1]
            a = r.randint(0, len(s) - 70)
            cut = s[a : a + r.randint(50, 110)]
            t += r.choice([" ", "!! "]) + r.choice([cut, cut.upper(), cut.replace(" ", " - "), cut[:30] + "Z" + cut[31:]]) + " " + word()
        docs.append((i, t))
    docs += [(900, None), (901, ""), (902, "x"), docs[0]]
    d = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, score double")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.leaked_items(d, "doc_id", "text", it, "item_id", "text")
    hit = {(x["doc_id"], x["item_id"]) for x in got.where("run >= 60").collect()}
    want = set()
    for i, t in docs:
        for j, s in items:
            if t and s:
                grams = {norm(s)[k : k + 60] for k in range(len(norm(s)) - 59)}
                if any(norm(t)[k : k + 60] in grams for k in range(len(norm(t)) - 59)):
                    want.add((i, j))
    assert hit == want and len(want) > 20
    several = contamination.leaked_items(d, "doc_id", "text", it, "item_id", "text", block_points=700)
    assert {(x["doc_id"], x["item_id"]) for x in several.where("run >= 60").collect()} == want
    for x in got.where("run >= 60").limit(20).collect():
        assert len(norm(dict(docs)[x["doc_id"]][x["run_from"] : x["run_until"]])) == x["run"]
    assert contamination.leaked_items(d, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0
    assert contamination.leaked_items(d.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0


def test_report_has_copies_edited_throughout(spark, tmp_path):
    """An edit every 20 to 50 characters: no exact run of 60, but most of the item is there."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmno灯路漢") for _ in range(r.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(20)]
    docs, want = [(900 + i, " ".join(word() for _ in range(60))) for i in range(20)], set()
    for i, s in items:
        for j, step in enumerate((20, 35, 50)):
            t = list(s)
            for at in range(step - 1, len(t), step):
                t[at] = r.choice(["Z", "zQ", "", t[at] + "z"])
            docs.append((10 * i + j, " ".join([*(word() for _ in range(30)), "".join(t), *(word() for _ in range(30))])))
            want.add((10 * i + j, i))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {(x["doc_id"], x["item_id"]) for x in queries.p7_report(spark, str(tmp_path)).collect()}
    assert got == want


def test_many_alignments_are_those_of_one():
    r = np.random.default_rng(2)
    pairs = [tuple(r.integers(0, 4, r.integers(0, 30)).astype(np.uint32) for _ in "ab") for _ in range(100)]
    assert contamination.alignments(pairs).tolist() == [contamination.smith_waterman(a, b) for a, b in pairs]
    at = contamination.rarest_places(np.array([5, 0, 7, 7, 0, 0, 0, 9]), 3)
    assert set(at.tolist()) >= {0, 2, 7} and not {1, 4, 5, 6} & set(at.tolist())


def test_alignment_scores():
    def slow(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -2), h[i][j + 1] - 2, h[i + 1][j] - 2)
        return max(map(max, h))

    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = r.integers(0, 4, r.integers(0, 25)), r.integers(0, 4, r.integers(0, 25))
        assert contamination.smith_waterman(a, b) == slow(a.tolist(), b.tolist())
    at = contamination.rarest_places(np.array([5, 1, 7, 7, 7, 2, 9, 9]), 3)
    assert all(any(i <= a < i + 3 for a in at) for i in range(6)) and 1 in at and 5 in at


# -- shared spans


def span_docs(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh 実況猫\U0001f600") for _ in range(n))
    pool = [text(700) for _ in range(10)]
    docs = []
    for _ in range(70):
        s = text(r.randint(0, 400))
        for _ in range(r.randint(0, 2)):
            n = r.choice([250, 299, 300, 301, 450])
            a = r.randint(0, 700 - n)
            s += r.choice(pool)[a : a + n] + text(r.randint(0, 90))
        docs.append(s)
    return [*docs, "w" * 900, "w" * 700, "ab" * 300, "", docs[3], docs[3]]


def share(a, b, n=300):
    grams = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in grams for i in range(len(b) - n + 1))


def test_spans_are_maximal_and_complete():
    docs = span_docs(1)
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if share(docs[i], docs[j])}
    got = set()
    for i, j, a, b, n in common_spans(docs, docs, 300):
        if i < j:
            got.add((i, j))
            x, y = docs[i], docs[j]
            assert x[a : a + n] == y[b : b + n] and n >= 300
            assert a == 0 or b == 0 or x[a - 1] != y[b - 1]
            assert a + n == len(x) or b + n == len(y) or x[a + n] != y[b + n]
    assert got == want and len(want) > 15


@pytest.mark.parametrize("shard,cut", [(3000, 2000), (1 << 20, 4 << 20)])
def test_shared_spans_against_brute_force(spark, shard, cut):
    docs = span_docs(2)
    rows = [(i, t, 0) for i, t in enumerate(docs)] + [(500, None, 0), (None, docs[3], 0), (3, docs[3], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = {(x["doc_id_a"], x["doc_id_b"]) for x in shared_spans(df, "doc_id", "text", shard_points=shard, slice_points=cut).collect()}
    assert got == {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if share(docs[i], docs[j])}
    assert shared_spans(df.limit(0), "doc_id", "text").count() == 0


def test_classes_and_cleaning(spark, tmp_path):
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefgh 実況猫") for _ in range(n))
    common, own = text(500), [text(120) for _ in range(9)]
    rows = [(1, own[0] + common), (2, common + own[1]), (3, own[2]), (4, own[0] + common), (5, own[4] + common[:350] + own[5] + common[100:450] + own[6]), (6, None), (7, ""), (8, own[0] + common)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: (x["class_id"], x["copies"], x["links"]) for x in queries.p9_classes(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 3, 2), 4: (1, 3, 2), 8: (1, 3, 2), 2: (2, 1, 2), 5: (5, 1, 2), 3: (3, 1, 0), 6: (6, 1, 0), 7: (7, 1, 0)}
    clean = {x["doc_id"]: (x["text"], x["removed"]) for x in queries.p9_cleaned(spark, str(tmp_path)).collect()}
    assert clean[1] == (rows[0][1], 0) and clean[3] == (own[2], 0) and clean[4] == ("", 620) and clean[6] == (None, 0) and clean[7] == ("", 0)
    assert len(clean[2][0]) <= 120 and own[1].endswith(clean[2][0]) and len(clean[5][0]) <= 360 and clean[5][1] >= 700
    pairs = {tuple(x) for x in queries.p9_found(spark, str(tmp_path)).collect()}
    assert pairs == {(a, b) for a in (1, 2, 4, 5, 8) for b in (1, 2, 4, 5, 8) if a < b}


def test_coverage_has_every_document(spark, tmp_path):
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefgh 実況猫") for _ in range(n))
    common = text(400)
    rows = [(1, text(50) + common), (2, common + text(100)), (3, text(500)), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: (x["spans"], x["chars"], x["shared_share"]) for x in queries.p9_coverage(spark, str(tmp_path)).collect()}
    assert {i: got[i] for i in (3, 4, 5)} == {3: (0, 500, 0.0), 4: (0, 0, 0.0), 5: (0, 0, 0.0)} and len(got) == 5
    assert got[1][2] >= 400 / 450 and got[2][2] >= 400 / 500


def test_window_arrays():
    r = np.random.default_rng(3)
    x = r.integers(0, 50, 200).astype(np.uint32)
    h = WindowHash(x)
    assert (h.at(np.array([5]), np.array([20])) == WindowHash(x[5:20]).all(15)).all() and (h.all(15)[5] == h.at(np.array([5]), np.array([20]))[0])
    assert sliding(x, 7, np.minimum).tolist() == [int(x[i : i + 7].min()) for i in range(194)] and len(sliding(x[:3], 7, np.minimum)) == 0


# -- mixing


def test_rates_follow_targets_and_caps():
    sizes = {"a": 1000, "b": 100, "c": 10, "x": 999}
    targets = [("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.1, 3), ("gone", 0.1, 3), ("x", 0.0, 9)]
    rates = mixing.repetition_rates(sizes, targets)
    total = sum(rates[s][0] * sizes[s] for s in rates)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(rates[s][0] * sizes[s] / total - share / 0.9) < 1e-9 and rates[s][0] <= dict((t[0], t[2]) for t in targets)[s] + 1e-9
    assert abs(rates["c"][0] - 3) < 1e-9 and set(rates) == {"a", "b", "c"}
    big = mixing.repetition_rates(sizes, targets, total=1500)
    assert big["c"][0] == 3 and big["b"][0] == 4 and abs(sum(big[s][0] * sizes[s] for s in big) - 1500) < 1e-6
    assert mixing.repetition_rates({}, targets) == {}


def test_mixing(spark):
    rows = [(i, "one two three " * (i % 5), ["a", "b", "c", "d", None][i % 5 if i % 7 else 0], 1) for i in range(600)] + [(1000, None, "a", 1), (1001, "", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repeats int")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.25, 2), ("c", 0.25, 4), ("d", 0.0, 4), ("none", 0.2, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    selection, shares = mixing.mix_sources(docs, "doc_id", "source", targets)
    first = sorted(map(tuple, selection.collect()))
    assert first == sorted(map(tuple, mixing.mix_sources(docs, "doc_id", "source", targets)[0].collect()))
    caps = {"a": 3, "b": 2, "c": 4}
    assert all(r["repeats"] <= caps[r["source"]] for r in selection.collect())
    s = {r["source"]: r for r in shares.collect()}
    assert abs(s["a"]["actual_share"] - 0.5) < 0.05 and s["d"]["copies"] == 0 and s["none"]["documents"] == 0 and abs(sum(r["actual_share"] for r in s.values()) - 1) < 1e-9
    assert s["a"]["selected_tokens"] == sum(t * n for _, src, t, n in first if src == "a")
    empty, none = mixing.mix_sources(docs.limit(0), "doc_id", "source", targets)
    assert empty.count() == 0 and {r["actual_share"] for r in none.collect()} == {0.0}
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, "doc_id", "source", targets.union(targets))


def test_token_counts_are_those_of_the_tokenizer(spark):
    texts = ["", None, "hello world", "日本語のテキスト", "a" * 5000, "don't  stop\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    with open(mixing.VOCABULARY, "rb") as f:
        enc = mixing._encoder(f.read(), mixing.PATTERN)
    got = {r["i"]: r["n_tokens"] for r in mixing.token_counts(df, "text", ["i"]).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert df.where(F.lit(False)).count() == 0
