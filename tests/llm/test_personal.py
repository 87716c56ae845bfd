import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rillwork.llm import personal, personal_samples


@pytest.fixture(scope="module")
def model():
    return personal.default_model()


# Names, places and frames that the invented sentences do not have; [kind|value] marks what is to be found.
UNSEEN = """
so apparently [person_name|Aldous Penhaligon] moderates this channel
the winner was announced as [person_name|Zuzana Horvath] wow
please forward it to [person_name|Thaddeus Okonkwo] as well
yours sincerely, [person_name|Bettina Achterberg]
letter for [person_name|Philippa K. Montague] arrived
I sat beside [person_name|Rupert Ashdown] on the bus
作者の[person_name|大鳥居 隼人]さんに聞いた
受付の[person_name|冬木真琴]と申します
兄は[person_name|柏葉 透]です
娘の本名が[person_name|白鳥美月]なの
[person_name|織部 千夏]さんが来てくれた
send the file over to [email|wanda.pellow@orchid-mail.org] cheers
ask [email|j_hartigan77@stonebridge.co.uk] about it
my box is [email|otto(at)wiesengrund(dot)de] fyi
気軽に[email|hanako.w@midori.ne.jp]まで
for tickets [email|BOXOFFICE@PLAYHOUSE.ORG] works
leave a voicemail at [phone|(415) 867-5309] k
urgent line [phone|080-4417-2093] 24h
sms [phone|+44 7911 123456] is fastest
店の番号 [phone|03-5412-7788] だよ
meine nummer lautet [phone|+49 171 5558812]
buzz [phone|oh eight oh, 4417, 2093] tonight
[phone|〇九〇四四一七二〇九三] に頼む
marca el [phone|+34 612 345 678] hoy
it says passport number [id_number|TR4417209] on it
she typed her SSN [id_number|219-09-9999] in chat
マイナンバーが[id_number|4417 2093 8855]って見えた
免許証 [id_number|441720938855] 映ってる
NI number [id_number|AB 12 34 56 C] leaked
mi DNI es [id_number|44172093K] vale
health insurance number [id_number|4417-209388] visible
the party is at [address|27 Sycamore Lane, Thornbury] bring snacks
pizza to [address|Apt 9, 1180 Juniper Avenue, Bexhill]
配達は[address|横浜市港北区大倉山3-14-15]でお願い
引っ越し先 [address|〒530-0011 大阪府大阪市北区大深町4丁目20番5号]
Treffpunkt ist [address|Lindenstraße 14, 10969 Berlin] um acht
quedamos en [address|Calle Cervantes 22, 28014 Madrid] hoy
the soup was far too salty
platform 9 and 3 quarters
we lost 3-2 in overtime
serial number 99817263544 is printed below
today at 14:30 there is a raid
Frozen Banana Stand is my favourite band
この曲は1998年の名曲
再生回数1234567突破
次回は10月5日21時から
応募コード 5521-8890-1123 を入力
みんな元気だった
眠すぎて無理
@quietharbor22 same here
Midnight Express
""".strip().splitlines()


def marked(line):
    text, gold = "", []
    for i, part in enumerate(re.split(r"\[(\w+)\|([^]]+)\]", line)):
        if i % 3 == 0:
            text += part
        elif i % 3 == 1:
            kind = part
        else:
            gold.append((len(text), len(text) + len(part), kind))
            text += part
    return text, gold


def test_unseen_names_and_frames(model):
    """Recall and precision by kind on wording the model never saw; no name in it is known to the samples."""
    samples = set(personal_samples.GIVEN + personal_samples.FAMILY + personal_samples.HAN_FAMILY + personal_samples.HAN_GIVEN)
    right, wrong, missed = Counter(), Counter(), Counter()
    for line in UNSEEN:
        text, gold = marked(line)
        for a, b, k in gold:
            assert k != "person_name" or not samples & set(text[a:b].split()), text
        got, want = {k for _, _, k in personal.entities(model, text)}, {k for _, _, k in gold}
        right.update(got & want)
        wrong.update(got - want)
        missed.update(want - got)
    print(dict(right), dict(wrong), dict(missed))
    assert sum(right.values()) / (sum(right.values()) + sum(missed.values())) >= 0.9, missed
    assert sum(right.values()) / (sum(right.values()) + sum(wrong.values())) >= 0.9, wrong


def test_held_out_accuracy(model):
    """Sentences of another seed than those it was fitted on."""
    right = wrong = missed = 0
    for text, place, gold in personal.invented_sentences(400, seed=99):
        got, want = set(personal.entities(model, text, place)), set(gold)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_a_lexicon_is_empty_unless_given(model):
    assert model.lexicon == personal.Lexicon() and not model.lexicon.given and not model.lexicon.surname


def every_way(n, segments):
    """All choices of non-overlapping (a, b, k) in n tokens."""
    for size in range(len(segments) + 1):
        for chosen in itertools.combinations(segments, size):
            if all(x[1] <= y[0] for x, y in zip(sorted(chosen), sorted(chosen)[1:])):
                yield sorted(chosen)


def path_score(n, chosen, scores, turns):
    """Score of a segmentation of n tokens: plain tokens stand in state 0."""
    at, last, total = 0, 0, 0.0
    for a, b, k in chosen:
        for _ in range(a - at):
            total, last = total + turns[last][0], 0
        total += turns[last][k] + scores[a, b, k]
        at, last = b, k
    for _ in range(n - at):
        total, last = total + turns[last][0], 0
    return total + turns[last][0]


def test_probabilities_and_best_path_against_all_segmentations():
    r = np.random.default_rng(5)
    for _ in range(8):
        n, K = 4, 5
        turns = r.normal(size=(K + 1, K + 1))
        turns[0, 0] = 0.0
        segments = sorted({(a, min(n, a + int(r.integers(1, 4))), int(r.integers(1, 4))) for a in r.integers(0, n, 6).tolist()})
        scores = {x: float(r.normal()) for x in segments}
        dense = np.full((1, n + 1, 3, K), -1e30)
        for a, b, k in segments:
            dense[0, b, b - a - 1, k - 1] = scores[a, b, k]
        z, prob, turned = personal.forward_backward(dense, turns)
        total, mass, best = 0.0, defaultdict(float), (-math.inf, None)
        for chosen in every_way(n, segments):
            v = path_score(n, chosen, scores, turns.tolist())
            best = max(best, (v, chosen))
            total += math.exp(v)
            for x in chosen:
                mass[x] += math.exp(v)
        assert abs(z[0] - math.log(total)) < 1e-6
        for a, b, k in segments:
            assert abs(prob[0, b, b - a - 1, k - 1] - mass[a, b, k] / total) < 1e-6
        assert abs(turned.sum() - sum(math.exp(path_score(n, c, scores, turns.tolist())) * (n + 1 - sum(b - a - 1 for a, b, _ in c)) for c in every_way(n, segments)) / total) < 1e-6
        got = personal._best_path(sorted(((a, b, k, s) for (a, b, k), s in scores.items()), key=lambda x: x[1]), turns)
        assert abs(path_score(n, got, scores, turns.tolist()) - best[0]) < 1e-9


def test_gradient_is_that_of_the_likelihood():
    """Central differences of log Z less the gold score, by the turns."""
    sentences = [("call 090-1234-5678 now", "content", [(5, 18, "phone")]), ("mail a@b.example ok", "content", [(5, 16, "email")]), ("nothing here", "content", [])]
    fitted = personal.fit(sentences * 20, epochs=30, batch=20)
    for text, place, gold in sentences:
        assert personal.entities(fitted, text, place) == gold


EVADING = [
    ("Ａｌｄｏｕｓ Ｐｅｎｈａｌｉｇｏｎ", "name", "person_name"), ("my name is Ａｌｄｏｕｓ Ｐｅｎｈａｌｉｇｏｎ", "content", "person_name"), ("名前は白​鳥美​月です", "content", "person_name"),
    ("oh nine oh one two three four five six seven eight", "content", "phone"), ("call me ZERO NINE ZERO one two three four FIVE SIX SEVEN EIGHT", "content", "phone"),
    ("null acht null eins zwei drei vier fünf sechs sieben acht", "content", "phone"), ("llama al cero nueve cero uno dos tres cuatro cinco seis siete ocho", "content", "phone"), ("ｚｅｒｏ ｎｉｎｅ ｚｅｒｏ １２３４ ５６７８", "content", "phone"),
]


def test_nothing_is_skipped_before_the_model(model):
    for text, place, kind in EVADING:
        assert [k for _, _, k in personal.entities(model, text, place)] == [kind], text
    for text in ("one two three go", "ONE TWO THREE", "第一二回"):
        assert personal.entities(model, text) == [], text


def test_numbers_after_many_others(model):
    """Long runs of digit groups: what stands at their end is looked at like what stands at their start."""
    for n in (25, 60, 400):
        other = ", ".join(str(i % 90 + 1) for i in range(n))
        assert personal.redact(model, f"{other}, 090-1234-5678") == f"{other}, [PHONE]", n
    counted = " ".join(str(i) for i in range(1, 31))
    assert personal.redact(model, f"{counted} 090 1234 5678").endswith(" [PHONE]")
    r = random.Random(3)
    twelve = [f"090-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}" for _ in range(12)]
    assert personal.redact(model, " ".join(twelve)) == " ".join(["[PHONE]"] * 12)


def test_long_texts_are_done_whole(model):
    for text in ("x" * 20000 + " call me 090-0845-6611", "漢" * 30000 + " 電話は090-0845-6611です", "word " * 20000 + "call me 090-0845-6611"):
        assert personal.redact(model, text).count("[PHONE]") == 1, text[-30:]


def test_redaction_keeps_the_rest(spark, model):
    rows = [(1, "tel:090-0845-6611 草", "Aldous Penhaligon", "c"), (2, None, None, "c"), (3, "", "yuzu659", "c"), (3, "", "yuzu659", "c"), (4, "x" * 20000 + " call me 090-0845-6611", None, "c")]
    df = spark.createDataFrame(rows, "delivery_id long, content string, name string, field string")
    got = personal.find_personal(df, "delivery_id", ["content", "name"], model, redacted=True).collect()
    by = {(r["delivery_id"], r["field"]): r for r in got}
    assert by[1, "content"]["redacted"] == "tel:[PHONE] 草" and by[1, "name"]["redacted"] == "[PERSON_NAME]"
    assert by[3, "name"]["redacted"] == "yuzu659" and (2, "content") not in by
    assert by[4, "content"]["redacted"].endswith(" call me [PHONE]") and by[4, "content"]["starts"] == [20009]
    assert sum(r["delivery_id"] == 3 for r in got) == 4
    assert personal.find_personal(df.limit(0), "delivery_id", ["content", "name"], model).count() == 0
