"""Invented sentences that give a small labelled set words it lacks: insults, slurs against groups and sexual demands, harmless look-alikes and function words."""

from __future__ import annotations

import random

_EN_NOUN = "idiot moron loser scumbag dumbass asshole bitch bastard pig clown trash scum coward retard slut whore cunt dickhead prick wanker".split()
_EN_ADJ = "stupid worthless pathetic ugly disgusting brainless useless fat miserable".split()
RUDE_JA = "クズ ゴミ カス バカ アホ ブス デブ キチガイ 能無し クソ野郎 無能 豚野郎 ハゲ".split()
_DE_NOUN = "Idiot Arschloch Hurensohn Wichser Versager Drecksau Missgeburt".split()
_ES_NOUN = "basura imbécil idiota gilipollas cabrón puta inútil".split()
_THING = "map boss kettle soup camera stream dog game window song".split()
_JA_THING = "配信 ゲーム 曲 話 料理 地図 猫 絵 動画".split()
_GROUP = ["immigrants", "foreigners", "refugees", "those people", "these foreigners", "gypsies", "the tourists", "that religion", "people like them", "the whole tribe"]
_JA_GROUP = ["移民", "外国人", "難民", "あいつら", "よそ者", "あの国の人間", "あの宗教の奴ら"]

ABUSIVE = [
    "you are a {n}", "you {a} {n}", "what a {n}", "shut up {n}", "fuck you", "fuck off {n}", "kill yourself", "kill yourself {n}", "go to hell {n}", "I hope you die", "I will kill you", "I will beat you up", "nobody likes you", "everybody hates you {n}", "drop dead", "die already {n}", "your mother is a {n}", "piece of shit", "get lost {n}", "{a} {n}", "such a {a} {n}", "I will hurt you", "hang yourself", "wish you were dead",
    "死ね", "死ねよ{jn}", "氏ね", "タヒね", "殺すぞ", "ぶっ殺す", "消えろ", "消えろ{jn}", "お前は{jn}", "お前ほんと{jn}", "黙れ{jn}", "くたばれ", "地獄に落ちろ", "首吊れ", "キモい{jn}", "うるせえ{jn}", "生きてる価値ない", "殴るぞ{jn}",
    "halt die Fresse {d}", "verpiss dich", "du bist ein {d}", "stirb {d}", "fick dich", "ich bring dich um", "eres un {e}", "cállate {e}", "muérete", "pedazo de mierda", "hijo de puta", "te voy a matar",
]
HATEFUL = [
    "{g} are vermin", "{g} are subhuman", "{g} are animals", "{g} are parasites", "gas {g}", "deport {g}", "shoot {g}", "{g} do not deserve to live", "never trust {g}", "{g} are all criminals", "I hate {g}", "{g} are filth", "exterminate {g}", "{g} should burn",
    "{jg}は寄生虫", "{jg}は人間じゃない", "{jg}を叩き出せ", "{jg}の血は汚い", "{jg}を皆殺しにしろ", "{jg}は下等", "{jg}は殺していい", "{jg}は犯罪者", "{jg}は国に帰れ", "{jg}を駆除しろ",
]
SEXUAL = [
    "show us your tits", "show me your boobs", "send nudes", "suck my dick", "suck my cock", "spread your legs", "jerking off to you", "I want to fuck you", "sit on my face", "take off your clothes", "take off your panties", "so wet and horny", "lick my pussy", "cum on your face", "big naked tits", "my hard cock", "let me see your ass",
    "おっぱい見せろ", "おっぱい", "パンツ脱いで", "パンツ見せろ", "エッチしよう", "セックスしたい", "中に出したい", "ちんこ舐めろ", "ちんこ", "まんこ見せて", "やらせて", "フェラして", "オナニーしてる", "裸になれ", "乳首見せて",
    "zeig deine Titten", "zieh dich aus", "ich will dich ficken", "enséñanos las tetas", "quiero follarte", "chúpame la polla",
]
#: Harmless words that hold, or sound like, those above.
HARMLESS = [
    "this {t} killed me", "I died laughing at the {t}", "dying of laughter", "kill the boss", "what a killer {t}", "dumb question about the {t}", "silly me", "stupid {t} froze", "the damn {t}", "damn good {t}", "chicken breast for dinner", "a cock crows at dawn", "cocktail hour", "the assassin won", "classic {t}", "assemble the {t}", "therapist on Monday", "analysis of the {t}", "Dickens wrote that", "peacock feathers", "cumulative score", "document the {t}", "shiitake soup", "pussycat sleeping", "puss in boots", "naked mole rat", "sex ratio of bees", "Middlesex county", "grapes are sweet", "hate this weather", "I hate mondays", "burn the toast", "shoot the ball", "shooting hoops", "shot a photo", "dead battery", "my {t} is dead", "beat the level", "beaten by one point", "hit the {t}", "trash can", "pig farm", "clown fish", "rat race", "dog ate it", "hell of a {t}", "animals are cute", "pests in the garden", "immigrants opened a bakery", "foreigners welcome", "refugees found a home",
    "必死で{jt}", "死ぬほど眠い", "死守した", "瀕死で勝った", "殺菌した", "殺虫剤", "相殺", "殺風景な部屋", "馬鹿うまい", "バカンス行きたい", "バカ売れ", "アホ毛", "カスタード", "カステラ食べた", "ゴミの日", "ゴミ拾い", "クソゲー", "キモノ着た", "キモかわ", "ブスリと刺す", "裸足で歩く", "裸眼", "パンツが乾いた", "胸が熱い", "乳製品", "性格いい", "性能いい", "大人の味", "消えろって魔法", "火が消えた", "地獄の特訓", "寄生虫の研究", "外国人観光客", "移民の歴史", "血が出た", "害虫駆除",
    "うん", "はい", "いいえ", "そう", "そうだね", "それ", "これ", "あれ", "どれ", "ええ", "えー", "まあ", "ほんと", "わかる", "了解", "またね", "おはよう", "ありがとう", "すごい", "だよね", "やった", "あー", "おお", "へえ", "うわ", "ねむい", "お腹すいた", "頑張って", "いいな", "それいい", "そのまま", "なんで", "どこ", "いつ", "だれ", "これ好き", "その{jt}", "この{jt}", "{jt}見て", "{jt}して", "住所変更", "書かない", "書いた", "送った", "送るね", "出た", "出て", "来て", "言った", "ok", "yes", "no", "hm", "oh", "ah", "same", "true", "where", "who is that", "by bus", "on it", "at noon", "please wait", "told you", "in time", "with one {t}", "for all", "all good", "thanks all",
    "verdammt gut", "der {t} ist tot", "die Idee stirbt nie", "puta madre de {t} rico", "basura al cubo", "muero de risa", "mi perro murió",
]
#: Everyday sentences of little besides function words, in which insults and demands are rich and chat about a stream is poor.
_MILD = "right late kind here ready funny early sure glad quiet new fine busy tired strong young".split()
_DE_MILD = "nett früh müde schön klug neu still".split()
_PEOPLE = ["we", "you", "they", "you all", "my friends", "the players", "these two", "some of them", "both of us"]
EVERYDAY = [
    "{p} are {m}", "{p} are {m} and {m}", "are {p} {m}", "{p} were {m} and {m}", "{p} should be {m}", "{p} will be {m}", "{p} can do it", "{p} have been {m}", "{p} could be {m} or {m}", "how are {p}", "where are {p}", "who are {p}",
    "I am {m}", "I was {m} today", "I am on my way", "I am at home by now", "I am not from there", "I will be {m}", "I do not mind", "I do not know them", 
    "is it {m}", "it is {m}, really", "it is in there somewhere", "that was not me", "this one is {m}", "there are many of those", "which of these is yours", "where is the other one", "when will you be back", "why is it so {m}", 
    "you and me", "for you and for me", "on the other side of it", "one of those days", "out of the way", "at the end of the day", "in and out", "up and down", "here and there", "more and more", "now and then", "again and again", "none of them", "by the end", "let me know", "has and had", "the first of many", "the rest of it is {m}",
    "こっちのほうがいい", "今のほうがいい", "何してるの", "見ている", "来ている", "知ってる", "聞いてない", "そうなのか", "どうして", "もっとやって", "ずっと見てた",
]


def seed_rows(times: int = 2, seed: int = 17) -> tuple[list[str], list[str]]:
    """(texts, labels): each frame filled `times` times and each insult once; the same rows in every process."""
    r = random.Random(seed)
    texts, labels = [], []
    for label, frames in (("abusive", ABUSIVE), ("hateful", HATEFUL), ("sexual", SEXUAL), ("none", HARMLESS), ("none", EVERYDAY)):
        for f in frames:
            for _ in range(times if "{" in f else 1):
                t = f
                for mark, words in (("{n}", _EN_NOUN), ("{a}", _EN_ADJ), ("{jn}", RUDE_JA), ("{d}", _DE_NOUN), ("{e}", _ES_NOUN), ("{t}", _THING), ("{jt}", _JA_THING), ("{g}", _GROUP), ("{jg}", _JA_GROUP), ("{p}", _PEOPLE), ("{m}", _MILD), ("{m2}", _DE_MILD)):
                    while mark in t:
                        t = t.replace(mark, r.choice(words), 1)
                texts.append(t)
                labels.append(label)
    for words, frames in ((_EN_NOUN, ("you {}", "ugly {}")), (RUDE_JA, ("この{}", "{}だな")), (_DE_NOUN, ("du {}",)), (_ES_NOUN, ("eres {}",))):
        for i, w in enumerate(words):
            texts.append(frames[i % len(frames)].format(w))
            labels.append("abusive")
    return texts, labels
