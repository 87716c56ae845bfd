"""Invented sentences with known entities, from which the recogniser of personal information is fitted.

Values are drawn by rule from public formats of addresses and numbers; names come from common public names and from a composer of syllables, so the
model learns the shape of names, not a list. Nothing here is taken from a table that is scored.
"""

from __future__ import annotations

import random
import re

from .abuse_seeds import RUDE_JA

Sentence = tuple[str, str, list[tuple[int, int, str]]]

GIVEN = "Emma Liam Olivia Noah Sophia James Mia Lucas Amelia Henry Grace Oscar Ruth Walter Clara Hugo Ingrid Felix Greta Jonas Anke Dieter Sabine Lena Pablo Carmen Diego Lucía Rosa Javier Inés Chloé Pierre Giulia Marco Priya Arjun Fatima Omar Ivan Nadia Keiko Yuki".split()
FAMILY = "Smith Johnson Brown Taylor Clarke Hughes Baker Cooper Murphy Walsh Campbell Fraser Nguyen Patel Khan Rossi Moreau Dubois Müller Schmidt Schneider Fischer Weber Becker Vogel Krüger García Martínez López Fernández Navarro Ortega Kowalski Novak Petrov Larsen Lindqvist O'Brien McDonald Tanaka Suzuki".split()
HAN_FAMILY = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 清水 山崎 池田 橋本 阿部 石川 前田 小川 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本 三浦 竹内 小野寺 西園寺 五十嵐 一ノ瀬 三ヶ島 勅使河原 大久保 早乙女 宇佐美 榎本 桐谷".split()
HAN_GIVEN = "太郎 花子 健一 美咲 翔太 恵子 直樹 由美 大輔 陽菜 誠 葵 健太郎 真由美 拓也 智子 隆 彩香 雄大 悠斗 結衣 颯太 美羽 慎之介 千尋 和也 久美子 沙織 龍之介 菜々子 浩二 凛 翼 春香 遥 亮介 麻衣 紗希 航平 琴音 詩織 朋也 小百合 孝".split()
_FAMILY_CHARS = "山川田中村松竹梅石森林原野谷沢島崎本木西東南北上下高大小青白黒花月星雲霧桜柳桐楠榊橘藤葛荻菊鷹鶴亀熊鹿神宮水瀬滝波浜岡坂堀池井泉"
_GIVEN_CHARS = "愛明彩綾杏一伊衣香佳和奏希輝恵景湖光幸航沙咲紗志詩春純翔心真進澄聖蒼空太大達智月翼天透斗都乃菜奈波陽晴人日美未優由悠有勇葉良里梨理凛瑠怜鈴蓮朗郎和介助平彦哉也音羽緒子代世緒砂汐雪灯朔凪弥"
_STREET_WORD = "Maple Oak Church Mill Park High Station Queen Victoria Green Chapel School Bridge Garden Hill North Lake River Cedar Elm West Harbour Orchard Meadow Spring Abbey Castle Forge Rose Willow Market Tower Canal Holly".split()
_STREET = "Street Road Lane Avenue Court Drive Close Crescent Terrace Way Place Square Gardens Row Walk Hill St Rd Ave Ln".split()
_NOUN = "window ladder bottle carpet pencil bucket button jacket engine garden hammer island jungle kitten lemon market needle onion pepper rabbit saddle tomato turtle violin wagon yogurt zebra basket candle dragon falcon guitar helmet insect jigsaw koala lizard monkey noodle oyster pillow quilt robot salmon tiger train planet rocket castle potato pirate wizard ninja panda coffee cookie burger waffle muffin pickle biscuit apple banana cherry grape peach bread butter cheese salad pasta sauce sugar spoon plate glass table chair couch mirror shelf broom clock phone radio screen cable switch wheel tyre brake truck boat ship anchor beach coast river ocean cloud storm rainbow thunder snow summer winter autumn forest tree branch leaf flower grass stone sand mountain valley cave tunnel bridge road street corner park school library museum hospital kitchen bedroom attic roof wall fence gate bear wolf fox otter badger panther eagle sparrow pigeon owl duck goose chicken sheep goat horse donkey camel shark whale squid crab spider beetle ant bee moth hat coat shirt sock glove scarf ring crown sword shield arrow hero villain ghost witch knight king queen prince farmer baker driver pilot sailor doctor nurse teacher painter singer drummer".split()
_ADJ = "grumpy tiny brave silent golden rusty sneaky jolly spicy frozen happy lazy mighty little cosmic electric wild lucky angry purple royal ancient noble humble dizzy big small old young fast slow hot cold warm cool dark bright loud quiet soft hard sweet sour bitter fresh rotten clean dirty empty full deep tall short long wide thin thick heavy light strong weak rich poor blue red green yellow black white pink orange grey silver tired hungry thirsty bored curious clever silly funny serious famous secret hidden lost broken burning flying dancing singing running".split()
_TITLE = "Captain Lord Lady King Queen Doctor Professor Sir Uncle Master Team Mister The Saint General Baron".split()
_JA_WORD = "天気 音楽 映画 料理 電車 旅行 写真 会社 学校 仕事 公園 野球 将棋 温泉 花火 新作 画質 回線 音声 字幕 衣装 演奏 歌声 背景 装備 武器 魔法 勇者 迷宮 攻略 抽選会 大会 決勝 優勝 休憩 延長 開始 終了 再生 視聴 登録 通知 質問 回答 募集 応援 感謝 最高 爆笑 拍手 懐かしい すごい 楽しい 眠い 寒い カレー ラーメン アニメ ドラマ ライブ コラボ ランキング マイク カメラ パソコン ピアノ ギター".split()
_KANJI_WORD = "一生懸命 大丈夫 不思議 自由 意味 必要 可能 関係 社会 経済 政治 問題 世界 時間 場所 方法 理由 結果 原因 目的 計画 準備 確認 変更 追加 削除 設定 保存 共有 公開 非公開 限定 無料 有料 予約 注文 配達 返品 交換 修理 故障 新品 中古 値段 割引 合計 平均 最大 最小 上級 中級 初級 難易度 挑戦 成功 失敗 勝利 敗北 引き分け 連続 記録 更新 達成 突破 参加 募集中 受付中 終了後 開始前 生中継 再放送 深夜 早朝 午前 午後 毎日 毎週 先週 来週 今年 去年 来年 春夏 秋冬 天気予報 交通情報 地震速報 台風接近 大雨警報 安全運転 交通事故 救急車 消防署 警察署 市役所 図書館 美術館 博物館 動物園 水族館 遊園地 商店街 駐車場 自転車 飛行機 新幹線 地下鉄 高速道路 東京駅 大阪城 富士山 琵琶湖 北海道 日本人 外国人 男子 女子 子供 大人 老人 友人 家族 両親 兄弟 姉妹 店員 社員 学生 教師 医者 弁護士 作家 画家 歌手 俳優 声優 監督 選手 審判 観客 視聴者 配信者 管理人 司会者 実況者 参加者 出演者 主人公 登場人物 仲間 敵 殺人事件 人間関係 馬鹿 駆除 退治 討伐 全滅 撃破 出発 到着 電源 画面 音量 音質 字体 色合い 雰囲気 気分 感動 感想 笑顔 涙 怒り 面白 意外 微妙 最悪 普通 特別 簡単 複雑 綺麗 上手 下手 得意 苦手".split()
_JA_NICK = "通行人 名無し 初見さん 常連客 夜更かし 猫好き 料理長 冒険者 見習い魔女 眠り姫 からあげ とうふ メロンパン みかん箱 ねこじゃらし くまのぬいぐるみ 旅するペンギン 空飛ぶ豆腐 釣り名人 電車マニア 深海魚 三日坊主 時計塔 望遠鏡 風車小屋 自動販売機 回転寿司 紙飛行機 線香花火 折りたたみ傘 あさがお ひまわり 森の仲間 隣の犬 月見団子 招き猫".split()

WORDS = {
    "en": "zero one two three four five six seven eight nine".split(),
    "oh": "oh one two three four five six seven eight nine".split(),
    "de": "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
}


#: What surnames from places end in.
_ENDING = "ton ham ford ley worth field well by stone wood more den dale shaw hurst bourne wick land mont gate brook ridge court combe mere port cliffe grove beck ster low".split()


class Maker:
    """Draws values, frames and whole sentences from one seeded source."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.pick = self.r.choice

    def d(self, k: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(k))

    def up(self, k: int) -> str:
        return "".join(self.pick("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(k))

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    # -- words

    def syllables(self, n: int) -> str:
        on = ["b", "br", "c", "ch", "d", "dr", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "qu", "r", "s", "sh", "st", "t", "th", "tr", "v", "w", "y", "z", ""]
        mid = ["a", "e", "i", "o", "u", "ai", "ea", "ie", "oo", "ou", "y"]
        off = ["", "", "l", "n", "r", "s", "m", "ll", "nd", "rn", "ck", "st", "x", "th"]
        return "".join(self.pick(on) + self.pick(mid) + (self.pick(off) if i == n - 1 or self.chance(0.35) else "") for i in range(n)).capitalize()

    def place(self) -> str:
        return self.syllables(self.pick([1, 2])) + self.pick(["", "", "ton", "ham", "ford", "field", "bury", "mouth", "dale", "burg", "ville", "wick", "stadt", "heim", "bridge", "worth"])

    def nick(self) -> str:
        return self.pick([
            lambda: f"{self.pick(_TITLE)} {self.pick(_NOUN).title()}", lambda: f"{self.pick(_ADJ).title()} {self.pick(_NOUN).title()}", lambda: f"{self.pick(_ADJ).title()} {self.pick(_NOUN).title()}", lambda: f"{self.pick(_ADJ).title()} {self.pick(_NOUN).title()}", lambda: f"{self.pick(_TITLE)} {self.syllables(2)}", lambda: f"{self.pick(_NOUN)}{self.pick(['', '_', '-', '.'])}{self.d(self.pick([1, 2, 3]))}",
            lambda: f"{self.pick(_ADJ).title()} {self.pick(_NOUN).title()}", lambda: f"{self.pick(_ADJ).title()} {self.pick(_NOUN).title()}", lambda: f"{self.pick(_ADJ).title()} {self.pick(_NOUN).title()}", lambda: f"{self.pick(_TITLE)} {self.pick(_NOUN).title()}", lambda: f"{self.pick(_NOUN).title()} {self.pick(_NOUN).title()}",
            lambda: f"{self.pick(_KANJI_WORD)}{self.pick(['中', '中', '者', '好き', '係', '大王', '部長', 'の人'])}", lambda: f"{self.pick(['居眠り', '散歩', 'お昼寝', '早起き', '食べ歩き', '立ち読み', '夏休み', '水浴び', '日向ぼっこ', '里帰り'])}{self.pick(['中', '中', '好き', '同好会', ''])}", lambda: self.pick(_KANJI_WORD),
            lambda: self.pick(_JA_NICK), lambda: self.pick(_JA_NICK), lambda: f"{self.pick(_NOUN)}{self.pick(['_', '.', ''])}{self.pick(_NOUN)}", lambda: f"{self.pick(_NOUN).title()}{self.pick(_NOUN).title()}", lambda: f"The {self.pick(_ADJ).title()} {self.pick(_NOUN).title()}",
            lambda: f"{self.pick(_JA_NICK)}{self.pick(['さん', '＠', 'P', ''])}", lambda: self.pick(_NOUN), lambda: f"{self.pick(_NOUN).upper()} {self.pick(_NOUN).upper()}", lambda: f"Team {self.syllables(2)} {self.d(1)}", lambda: f"The {self.pick(['First', 'Second', 'Last'])} {self.pick(_NOUN).title()}",
        ])()

    # -- values

    def email(self) -> str:
        part = lambda: self.pick([self.pick(_NOUN), self.syllables(2).lower(), self.pick(GIVEN).lower().replace("é", "e").replace("í", "i")])
        local = part() + self.pick(["", ".", "_", "-", "+"]) + self.pick([part(), part() + self.d(2), self.d(self.pick([1, 2, 4])), part() + "." + part()])
        host = [self.syllables(2).lower() + self.pick(["", "", "mail"]), *([self.pick(_NOUN)] if self.chance(0.35) else [])]
        top = self.pick(["com", "net", "org", "jp", "de", "es", "example", "invalid", "test", "io", "info"])
        host += ["co", "jp"] if self.chance(0.1) else [top]
        at, dot = self.pick([("@", ".")] * 5 + [(" @ ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("＠", "．"), (" {at} ", " {dot} "), ("アットマーク", "ドット"), ("[@]", "."), (" (a) ", ".")])
        s = local + at + dot.join(host)
        if "@" in s and self.chance(0.05):
            return s.split("@")[0].upper() + "@" + s.split("@")[1].title()
        return s.upper() if self.chance(0.08) else s.title() if self.chance(0.05) else s

    def phone(self) -> str:
        d, m = self.d, self.pick(["090", "080", "070", "050"])
        spelled = self.pick(list(WORDS.values()))
        number = self.pick([m + d(8), "0" + self.pick("3456") + d(8), "0" + d(9)])
        gap = self.pick([" ", " ", "-", ", "])
        words = gap.join(spelled[int(c)] for c in number)
        start = gap.join(spelled[int(c)] for c in number[:3])
        tail = self.pick([f"{number[3:7]}{g}{number[7:]}" for g in (" ", "-", ", ")])
        return self.pick([
            f"{m}-{d(4)}-{d(4)}", f"{m}-{d(4)}-{d(4)}", f"{m} {d(4)} {d(4)}", f"{m}.{d(4)}.{d(4)}", f"{m}{d(8)}", f"({m}){d(4)}-{d(4)}", f"({m}) {d(4)} {d(4)}", f"0{d(1)}-{d(4)}-{d(4)}", f"0{d(1)}({d(4)}){d(4)}", f"0{d(2)}-{d(3)}-{d(4)}", f"0{d(3)}-{d(2)}-{d(4)}", f"0120-{d(3)}-{d(3)}", f"0{d(1)} {d(4)} {d(4)}",
            f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}",
            f"+81 {d(1)}-{d(4)}-{d(4)}", f"+81-90-{d(4)}-{d(4)}", f"+81 {m[1:]} {d(4)} {d(4)}", f"+44 20 {d(4)} {d(4)}", f"+44 7{d(3)} {d(6)}", f"020 {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"07{d(3)} {d(6)}", f"07{d(9)}", f"01{d(2)} {d(3)} {d(4)}",
            f"+49 (0){d(2)} {d(5)} {d(3)}", f"+49 {d(3)} {d(7)}", f"0{d(2)} {d(5)} {d(3)}", f"0{d(2)}/{d(7)}", f"01{d(2)} {d(7)}", f"0{d(2)} {d(6)}", f"+34 {d(3)} {d(3)} {d(3)}", f"6{d(2)} {d(3)} {d(3)}", f"6{d(2)} {d(2)} {d(2)} {d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0800{d(7)}", f"0800 {d(3)} {d(4)}",
            words, words.upper(), f"{start}{self.pick([' ', ', ', '-'])}{tail}", "".join("零一二三四五六七八九"[int(c)] for c in number), "".join("〇一二三四五六七八九"[int(c)] for c in number), f"{m}の{d(4)}の{d(4)}", " ".join(number), "-".join(number[:3]) + "-" + tail,
        ])

    def identity(self) -> tuple[str, str]:
        """(what stands before, the number)"""
        d, L = self.d, self.up
        gap = self.pick([" ", ": ", " is ", " no ", " number ", " #", ":", " number is ", " no. "])
        ja = self.pick(["", "は", ":", "：", " ", "の番号は", "番号", "番号は", "番号 ", "が"])
        de = self.pick([" ", ": ", " Nr. ", " ist "])
        four = self.pick([f"{d(12)}", f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}"])
        return self.pick([
            (self.pick(["マイナンバー", "個人番号", "マイナンバーカード"]) + ja, four), (self.pick(["my number", "individual number", "national id"]) + gap, four), (self.pick(["driver license", "driving licence", "driver licence", "driving license"]) + gap, four),
            (self.pick(["SSN", "ssn", "ssn", "my SSN", "my social security", "social security", "Social Security Number"]) + gap, self.pick([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"00{d(1)}-{d(2)}-{d(4)}", d(9)])),
            (self.pick(["SSN", "ssn", "ssn", "my SSN", "my social security", "social security", "Social Security Number"]) + gap, self.pick([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"00{d(1)}-{d(2)}-{d(4)}", d(9)])),
            (self.pick(["national insurance", "NI", "NINO", "National Insurance"]) + gap, self.pick([f"{L(2)}{d(6)}{L(1)}", f"{L(2)} {d(2)} {d(2)} {d(2)} {L(1)}"])),
            (self.pick(["passport", "passport", "Passport"]) + gap, self.pick([f"{L(2)}{d(7)}", f"{L(2)}{d(7)}"])),
            (self.pick(["passport", "Passport", "my passport", "Reisepass", "pasaporte"]) + gap, self.pick([f"{L(2)}{d(7)}", f"{L(1)}{d(8)}", d(9)])), (self.pick(["パスポート", "旅券"]) + ja, self.pick([f"{L(2)}{d(7)}", f"{L(2)} {d(7)}"])),
            (self.pick(["運転免許", "運転免許証", "免許証", "免許"]) + ja, four), (self.pick(["driver's license", "driving licence", "drivers licence", "license", "licence", "DL"]) + gap, self.pick([four, f"{L(1)}{d(7)}", f"{L(5)}{d(6)}{L(2)}{d(1)}{L(2)}"])),
            (self.pick(["健康保険", "保険証", "国民健康保険", "被保険者", "保険者", "保険証の記号", "記号", "年金", "基礎年金"]) + ja, self.pick([f"{d(4)}-{d(6)}", f"{d(4)}-{d(7)}", d(8), f"{d(8)}-{d(2)}", f"{d(4)}-{d(5)}"])), (self.pick(["health insurance", "insurance", "medicare", "health card"]) + gap, self.pick([f"{d(4)}-{d(6)}", d(10), f"{d(3)}-{d(3)}-{d(3)}", f"{L(1)}{d(9)}", f"{d(4)} {d(6)}"])),
            (self.pick(["Personalausweis", "Ausweis", "Ausweisnummer", "Führerschein", "meine Ausweisnummer"]) + de, self.pick([f"{L(1)}{d(8)}", f"{L(1)}{d(2)}{L(2)}{d(4)}", f"{L(4)}{d(5)}"])), (self.pick(["Steuer-ID", "Sozialversicherungsnummer", "Krankenkasse"]) + de, self.pick([d(11), f"{d(2)} {d(6)} {L(1)} {d(3)}", f"{L(1)}{d(9)}", f"{d(2)} {d(3)} {d(3)} {d(3)}"])),
            (self.pick(["DNI", "mi DNI", "dni"]) + self.pick([" ", ": ", " es "]), self.pick([f"{d(8)}{L(1)}", f"{d(8)}-{L(1)}", f"{d(2)}.{d(3)}.{d(3)}-{L(1)}"])), (self.pick(["NIE", "mi NIE"]) + self.pick([" ", ": ", " es "]), f"{self.pick('XYZ')}{d(7)}{L(1)}"), (self.pick(["seguridad social", "carnet de conducir"]) + self.pick([" ", ": ", " es "]), self.pick([f"{d(2)} {d(8)} {d(2)}", f"{d(8)}{L(1)}", d(12)])),
            (self.pick(["在留カード", "住民票コード", "身分証"]) + ja, self.pick([f"{L(2)}{d(8)}{L(2)}", d(11), four])), (self.pick(["my ID card", "identity card", "national identity"]) + gap, self.pick([f"{L(1)}{d(8)}", d(9), f"{L(2)}{d(6)}"])),
        ])

    def address(self) -> str:
        pick, d, r = self.pick, self.d, self.r
        any_han = [c for w in _KANJI_WORD for c in w if "一" <= c <= "鿿"]
        han = lambda a, b: "".join(pick(any_han if self.chance(0.35) else _FAMILY_CHARS) for _ in range(r.randint(a, b)))
        n = lambda k: str(r.randint(1, k))
        if self.chance(0.45):
            pref = pick(["", "", "東京都", "大阪府", "北海道", "京都府", "神奈川県", "愛知県", han(2, 2) + "県", han(2, 3) + "県"])
            city = pick([han(1, 3) + "市", han(2, 3) + "市" + han(1, 2) + "区", han(1, 3) + "区", han(2, 2) + "郡" + han(1, 2) + "町", han(2, 2) + "村"])
            block = pick([f"{n(9)}丁目{n(40)}番{n(40)}号", f"{n(9)}丁目{n(40)}番地", f"{n(9)}丁目{n(40)}-{n(30)}", f"{n(30)}-{n(30)}-{n(30)}", f"{n(30)}-{n(40)}", f"{n(900)}番地", f"{n(9)}の{n(40)}", f"{n(9)}の{n(40)}の{n(9)}", f"{n(900)}番地{n(9)}"])
            room = pick(["", "", "", f"{pick(['', ' '])}{pick(['ハイツ', 'コーポ', 'メゾン', 'マンション', 'レジデンス', 'グランド', 'アパート'])}{pick([han(1, 2), pick(['さくら', 'ひかり', 'みどり']), ''])}{pick(['', ' '])}{n(900)}{pick(['号室', '', '号'])}"])
            return pick([f"〒{d(3)}-{d(4)} ", f"〒{d(3)}-{d(4)}", "", "", ""]) + pref + city + han(1, 3) + pick(["", "", "町"]) + block + room
        if self.chance(0.6):
            street = f"{pick(['', '', '', 'Old ', 'Upper ', 'North '])}{pick([pick(_STREET_WORD), pick(_STREET_WORD), pick(_NOUN).title(), self.place(), pick(FAMILY), f'{pick(_ADJ).title()} {pick(_NOUN).title()}'])} {pick(_STREET)}"
            unit = pick(["", "", "", f"Flat {n(99)}, ", f"Apt {n(99)}, ", f"Apt. {n(99)}{pick('AB')}, ", f"Unit {n(40)}, ", f"Suite {n(400)}, "])
            town = pick([self.place(), f"{self.place()}-{pick(['on', 'upon', 'by'])}-{self.place()}", f"{self.place()} {self.place()}", f"{self.place()}-{self.place()}"])
            tail = pick(["", f", {town}", f", {town}", f", {town}", f", {town}, {self.up(2)} {d(5)}", f", {town} {self.up(2)}{d(1)} {d(1)}{self.up(2)}"])
            return f"{unit}{n(900)}{pick(['', '', '', 'a', 'B'])} {street}{tail}"
        if self.chance(0.6):
            umlaut = self.place() if self.chance(0.6) else pick(["Mühl", "Brücken", "Töpfer", "Gärtner", "Schloss", "Linden", "Kirch", "Bahnhof", "Wiesen", "Rosen"])
            suffix = pick(["straße", "straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "damm"])
            return pick([umlaut + suffix, umlaut + suffix, f"{pick(['Alte', 'Lange', 'Neue', 'Kurze'])} {pick(['Straße', 'Gasse', 'Allee'])}"]) + f" {n(200)}{pick(['', '', 'a', ' b'])}" + pick(["", f", {d(5)} {self.place()}", f", {d(5)} {pick(['Bad', 'Neu', 'Ober'])} {self.place()}", f", {d(5)} {pick(['Ober', 'Nieder', 'Alt'])}{self.place().lower()}"])
        return f"{pick(['Calle', 'C/', 'Avenida', 'Avda.', 'Plaza', 'Paseo', 'Calle de', 'Calle del', 'Calle de la'])} {pick([self.place(), pick(FAMILY)])}{pick([' ', ', '])}{pick(['', 'n.º ', 'nº '])}{n(200)}" + pick(["", f", {d(5)} {self.place()}", f", {n(9)}º {pick('AB')}", f", {pick(['Madrid', 'Sevilla', self.place()])}"])

    def person(self) -> str:
        pick = self.pick
        if self.chance(0.5):
            g = pick([pick(GIVEN), self.syllables(2), self.syllables(2), self.syllables(3)])
            s = pick([pick(FAMILY), self.syllables(2) + pick(["ton", "ham", "ford", "ley", "worth", "field", "well", "son", "man", "er", "by", "stone", "berg", "ez", "ini", "ski", "land", "wood", "stein", "more", ""]), self.syllables(self.pick([1, 2])) + pick(_ENDING), self.place()])
            if self.chance(0.12):
                s += "-" + pick([pick(FAMILY), self.syllables(2), self.syllables(1)])
            return pick([f"{g} {s}"] * 5 + [f"{g} {pick('ABCDEFGHJKLMRST')}. {s}", f"{s.upper()}, {g}", f"{g} {pick(GIVEN)} {s}", f"{g.upper()} {s.upper()}", f"{g} {pick(['von', 'van', 'de', 'del', 'de la'])} {s}"])
        if self.chance(0.1):
            any_han = [c for w in _KANJI_WORD for c in w if "一" <= c <= "鿿"]
            return "".join(pick(any_han) for _ in range(pick([1, 2, 2, 3]))) + pick(["", "", " ", "　"]) + "".join(pick(_GIVEN_CHARS if self.chance(0.6) else any_han) for _ in range(pick([1, 2, 2, 3])))
        fam = pick([pick(HAN_FAMILY), "".join(pick(_FAMILY_CHARS) for _ in range(pick([2, 2, 2, 3]))), pick(_FAMILY_CHARS) + pick("ヶノ") + pick(_FAMILY_CHARS)])
        given = pick([pick(HAN_GIVEN), "".join(pick(_GIVEN_CHARS) for _ in range(pick([1, 2, 2, 2, 3]))), pick(["さくら", "ひなた", "あかり", "めぐみ", "ゆかり", "まこと", "ひろし", "すみれ"])])
        return fam + pick(["", "", " ", "　"]) + given

    # -- what is none

    def number_none(self) -> str:
        d, pick, w = self.d, self.pick, lambda: self.pick(_NOUN)
        n = str(self.r.randint(1, 400))
        return pick([
            f"{pick(_JA_WORD)}{pick(['番号', '番号', 'ナンバー'])}{pick([' ', '', 'は', ':'])}{d(4)} {d(4)} {d(4)}{pick(['', 'だった', ' ' + pick(_JA_WORD)])}", f"{pick(_KANJI_WORD)}{pick(['番号', '番号', 'の番号は', 'コード'])}{pick([' ', '', 'は', ':'])}{pick([f'{d(4)} {d(4)} {d(4)}', f'{d(4)}-{d(4)}-{d(4)}', d(12), f'{d(4)}-{d(6)}'])}", f"{pick(_KANJI_WORD)}{pick(['番号', '番号', 'の番号は', 'コード'])}{pick([' ', '', 'は', ':'])}{pick([f'{d(4)} {d(4)} {d(4)}', f'{d(4)}-{d(4)}-{d(4)}', d(12), f'{d(4)}-{d(6)}'])}", f"{pick(_JA_WORD)}{pick(['番号', 'コード', 'ナンバー', 'の数字'])} {pick([f'{d(4)} {d(4)} {d(4)}', f'{d(4)}-{d(4)}-{d(4)}', d(12), d(8), f'{d(4)}-{d(6)}'])}", f"{w()} {pick(['number', 'code', 'no.', 'id', ''])} {pick([f'{d(4)} {d(4)} {d(4)}', f'{d(3)}-{d(2)}-{d(4)}', d(11), d(9), f'{d(4)}-{d(6)}', f'{d(4)}-{d(3)}-{d(3)}', f'{d(3)} {d(3)} {d(3)}'])}", f"{pick(['version', 'clause', 'the book says part', 'ip', 'figure'])} {n}.{d(3)}.{d(3)}.{d(3)}",
            f"invoice {d(4)}-{d(3)}-{d(3)}", f"ticket #{self.up(1)}-{d(7)}", f"serial {d(11)}", f"tracking {d(12)}", f"build {d(2)}.{d(1)}.{d(4)}", f"v{d(1)}.{d(2)}.{d(3)}", f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"coupon {self.up(2)}-{d(7)}", f"model {self.up(3)}-{d(4)}", f"item {d(4)}-{d(4)}-{d(4)} sold out", f"{pick([w(), 'señor', 'café', 'naïve', 'über'])} {pick([w(), 'of ' + w(), ''])} {d(pick([5, 6, 7, 7, 8]))}{pick(['', ' please', ' now', ' again', ' ください'])}", f"{pick(_JA_WORD + _KANJI_WORD)} {d(pick([8, 8, 9, 10, 6]))}{pick(['', ' です', ' は ' + w(), 'です', ' ' + w()])}", f"{n}丁目{pick(_JA_WORD)}{pick(['', '最高', 'まで', 'が好き'])}", f"{pick(_KANJI_WORD)}{n}丁目", f"{w()} {pick(_JA_WORD)} {d(pick([7, 8]))} {w()}", f"{pick(_JA_WORD)} {d(7)}{pick(['', ' です', ' 枚', ' now', ' は ' + w()])}", f"{d(4)}-{pick([d(3), d(2), d(1)])}-{pick([d(3), d(2), d(1)])} {pick(['に更新', 'の動画', 'から再開', 'より前', 'に見た', 'was great', 'の話'])}", f"{w()} #{self.up(1)}-{d(7)} {pick(['is ready', 'sent', 'lost', ''])}", f"error code {d(4)}-{d(4)}", f"map seed {d(10)}", f"code {d(3)}-{d(3)}-{d(3)} for the quiz",
            f"gate {d(4)}-{d(3)}", f"won {n}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{n} {w()}s", f"{d(7)} {w()}s sold", f"{w()} {n} {d(2)} {d(3)}", f"bitrate {d(7)}", f"{d(4)}/{d(2)}/{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"chapter {n}.{d(2)}.{d(3)}", f"ip {n}.{d(2)}.{d(3)}.{d(2)}", f"rule {n}.{d(3)}.{d(3)}.{d(2)}", f"{d(8)} hits", f"{d(6)} viewers", f"lap {d(3)}.{d(3)}", f"{n} km/h", f"high score {d(9)}", f"product {self.up(3)}{d(5)}", f"{d(4)}-{d(3)}-{d(3)}", f"{d(4)}-{d(3)}-{d(3)} {pick(_JA_WORD)}", f"{pick(_JA_WORD)}は{d(4)}-{d(3)}-{d(3)}",
            f"整理券 {d(4)} {d(4)}", f"注文 {d(4)}-{d(6)}", f"当たり番号 {d(4)} {d(4)} {d(4)}", f"シリアル {d(12)}", f"会員特典コード {d(4)}-{d(4)}-{d(4)}", f"型番 {self.up(3)}{d(6)}", f"{n}点", f"{n}年ぶり", f"{d(8)}円", f"経験値{d(8)}", f"再生数 {d(7)}", f"{n}話目", f"レベル{n}", f"コイン {d(7)} 枚", f"{d(1)}-{d(2)}-{d(2)} で勝ち", f"{d(4)}-{n}-{n} に投稿", f"第{n}回", f"ステージ{d(1)}-{d(1)}", f"{n}丁目の夕日", f"バージョン{d(1)}.{d(2)}.{d(3)}-{d(4)}", f"時速{n}キロ", f"{d(3)}.{d(2)}.{d(3)}.{d(1)} に更新", f"座標 {d(3)}:{d(3)}:{d(3)}", f"ラップ {d(3)}.{d(3)} で{n}位",
            f"Bestellung {d(4)}-{d(6)}", f"Seite {n}", f"Folge {n}", f"pedido {d(4)}-{d(6)}", f"página {n}", f"capítulo {n}", "8" * self.r.randint(3, 12), "7" * self.r.randint(3, 9), f"{d(4)} {d(4)} {d(4)} lost again", f"draw {d(4)} {d(4)} {d(4)}", f"{d(11)} is a funny number", f"order {d(4)}-{d(3)}-{d(4)} arrived", f"room code {d(3)}-{d(4)}", f"team {d(1)}",
        ])

    def chatter(self) -> str:
        pick, w, n = self.pick, lambda: self.pick(_NOUN), str(self.r.randint(1, 400))
        j = lambda: pick(_JA_WORD)
        return pick([
            f"I love this {w()}", f"that {w()} is so {pick(_ADJ)}", f"what a {pick(_ADJ)} {w()}", "good evening", "hi all", "haha", "nice one", f"where did the {w()} go", f"can you play the {w()} song", f"@{w()}{self.d(2)} look here", f"@{w()}_{w()} same", f"the {w()} has {n} wheels", f"{n} more minutes", f"I walked {n} steps", f"page {n} again", f"{self.place()} has {n} inhabitants", f"{self.nick()} again", f"{self.nick()} for president", f"greetings from {self.place()}", f"{self.place()} is nice in spring", f"look at pages/{w()}", f"listening to {self.nick()}", "can you call later", "my phone died", "write me later", "mail server is down", f"I am {pick(['late', 'hungry', 'new here', 'so tired', 'at work'])}", f"my {w()} is broken", "who are you", "what is your name", "is that your real name", "I forgot my passport", "insurance is expensive", "renewing my licence tomorrow", "we meet at noon. at least I do", f"Good {w()} Day", f"Happy {w().title()} Day", "The End", "Game Over", "New York Style Pizza", f"{pick(_ADJ).title()} {w().title()} is a good game", f"I met {pick(GIVEN)} there", f"{pick(GIVEN)} says hi", f"thanks {pick(GIVEN)}", f"the {self.place()} {self.place()} crowd", f"those {self.place()} folks are loud", f"episode {n} with {self.nick()}, volume {n}",
            pick("_-.* ").join(w()), f"{pick(_ADJ)} {pick('_-.').join(w())} with a {pick(_ADJ)} {w()}", f"at the {w()} {n} at {w()} cafe", f"lol @{w()}_{w()[:2]} {pick(_ADJ)}", f"you {pick('_-.').join(w())}", f"{self.nick()} and the {pick(_ADJ)} {w()}", f"{self.nick()} {pick(['is back', 'wins', 'at it again', 'returns, part'])} {n}", f"{pick(_KANJI_WORD)}{pick(_KANJI_WORD)}", f"{pick(_KANJI_WORD)}{pick(['と思う', 'だね', 'しろ', 'して', 'な人', 'は', 'の', 'です', ''])}", f"今の{pick(_KANJI_WORD)}", f"{pick(_KANJI_WORD)}{pick('者作的性中後前用感力員家店館駅会部版系風点度人物機')}{pick(['', '', 'か', 'だ', 'から', 'と', 'が好き', 'より'])}", f"{j()}{pick(['', ' '])}{pick(_KANJI_WORD)}{pick(['か', 'と', 'を', 'に', 'から出る', 'で負け'])}", f"{pick(_KANJI_WORD)}の{pick(_KANJI_WORD)}", f"次は{pick(_KANJI_WORD)}", f"さっさと{pick(_KANJI_WORD)}しろ", f"{pick(_KANJI_WORD)} {pick(_KANJI_WORD)}", f"この{j()}は{pick(_KANJI_WORD)}だと思う", f"{pick(_KANJI_WORD)}な{j()}", f"{w()} {pick(_KANJI_WORD)} {w()}",
            f"{j()}{pick(['いいね', '最高', 'すごい', 'だった', 'の話', 'が好き', 'ですか', 'まだ?', 'きた'])}", f"{j()}か{j()}か", f"{j()}は{n}人目", f"明日の{j()}", f"{pick(_JA_NICK)}さんこんにちは", f"{pick(HAN_FAMILY)}さんの{j()}", f"{pick(HAN_FAMILY)}駅の近く", f"バスで{n}分", f"{pick(_FAMILY_CHARS)}{pick(_FAMILY_CHARS)}公園に行った", "電話番号は教えません", "家の場所は言わないよ", "名前は秘密", "本名は内緒です", "免許とりたい", "保険証忘れた", "パスポート切れた", "先生こんにちは", "メール届かない", "初めまして", "お疲れさまです", "草", "ｗｗｗ", "なるほど", "うまい", f"{j()}{j()}", f"{pick(_JA_NICK)}", f"次の{j()}は{n}時から", f"@{w()}{self.d(2)} {j()}いいね",
            f"この{pick(RUDE_JA)}", f"{pick(['うるさい', 'お前は', 'どけ', 'また', 'さすが'])}{pick(RUDE_JA)}{pick(['', 'め', 'だな', 'ども', 'たちと同じ'])}", f"{pick(_KANJI_WORD)}の{pick(['やつら', '連中', 'みんな', '人たち'])}{pick(['は', 'と', 'が', 'の'])}{pick(_KANJI_WORD)}", f"all {self.place()}s are {w()}s and should {pick(['rest', 'sleep', 'play'])}",
            f"das {w()} ist gut", f"der {w().title()} und die {w().title()}", f"du bist {pick(['LUSTIG', 'toll', 'Klasse', 'ein ' + w().title()])}", f"mein {w().title()} ist {pick(['kaputt', 'ROT', 'Neu'])}", f"mach mal das {w().title()} aus du {w().upper()}", f"eres un {w().upper()}", f"{pick(['Trottel', 'Ruhe', 'Schluss', 'Mensch', 'Hund'])}, {pick(['geh heim', 'sei still', 'komm jetzt', 'lass das'])}", f"{pick(['Halt', 'Mach', 'Nimm'])} den {w().title()} {pick(['', 'du ' + w().upper(), 'du kleiner ' + w().title()])}", "guten Abend", "Wo ist der Hund", "Die Katze schläft", "Das Spiel ist Schön", f"ich habe {n} Punkte", "qué bonito", "buenas noches", f"tengo {n} puntos", "me gusta la canción", "La Casa Roja",
            f"{WORDS['en'][int(n) % 10]} {WORDS['en'][1 + int(n) % 9]} {WORDS['en'][int(n) % 7]} go", f"{WORDS['de'][1]}, {WORDS['de'][2]}, {WORDS['de'][3]}", f"{WORDS['es'][1]} {WORDS['es'][2]} {WORDS['es'][3]} ya", "one two", "第一二回", "一二三四五", "五六人", "二三日", "一石二鳥",
        ])

    # -- frames

    def part(self) -> tuple[str, str | None, str, str]:
        """(before, kind, value, after)"""
        pick = self.pick
        kind = pick(["email", "phone", "id_number", "id_number", "id_number", "id_number", "id_number", "address", "address", "person_name", "person_name", "none", "none", "none", "none"])
        bare = self.chance(0.25)
        if kind == "email":
            before = pick(["mail me: ", "my email is ", "contact ", "email: ", "e-mail ", "メールは", "メール:", "アドレスは", "連絡先 ", "send to ", "Mail an ", "mi correo es ", "reply to ", "find me under ", "write to me at ", "you can reach me at ", "it is me at ", "the address at work is ", "メルアド ", "アドレス ", "宛先は", ""])
            return ("" if bare else before), kind, self.email(), pick(["", "", " ok", "です", "へ", " thanks", "に連絡ください", " bitte", " por favor", "まで", ", cheers", " に送ってね"])
        if kind == "phone":
            before = pick(["call ", "phone ", "phone: ", "my number is ", "text me at ", "ring ", "mobile ", "電話番号は", "携帯は", "電話 ", "TEL ", "Tel. ", "tel: ", "ruf an ", "Handy ", "mi teléfono es ", "llámame al ", "連絡先は", "番号 ", "whatsapp ", "dial ", ""])
            return ("" if bare else before), kind, self.phone(), pick(["", "", " now", "です", "にかけて", " anytime", " after six", "まで", " bitte", " に電話して", " please", " if you can", "によろしく"])
        if kind == "id_number":
            cue, value = self.identity()
            lead = pick(["", "", "", "oops, ", "here: ", "my ", "私の", "これ ", "wrong window ", "he wanted my ", "誤爆した ", "コピペミス ", "うっかり ", "and the ", self.chatter() + " "])
            return lead + cue, kind, value, pick(["", "", "です", " lol", "でした", " right?", " だよ", " that is it", " と書いてある", " apparently"])
        if kind == "address":
            before = pick(["address: ", "my house is ", "come over to ", "we live at ", "ship it to ", "住所は", "住所:", "送り先 ", "自宅は", "うちは", "実家は", "ich wohne ", "Adresse: ", "mi casa es ", "vivo en ", "parcel for ", "届け先は", "I moved to ", ""])
            return ("" if bare else before), kind, self.address(), pick(["", "", "です", " now", "に住んでる", "へ送って", "にいます", " ring twice", "まで来てね", " today", "集合"])
        if kind == "person_name":
            name = self.person()
            if self.chance(0.6):
                before, after = pick([("my name is ", ""), ("my full name is ", ""), ("I'm ", ""), ("this is ", " speaking"), ("he said ", " did it"), ("my teacher ", " was angry"), ("last week ", " said that"), ("ask for ", " at the desk"), ("signed ", ""), ("actually I am ", " in real life"), ("I am ", ", nice to meet you"), ("the guy is called ", ""), ("my boss ", " saw this"), ("regards, ", ""), ("today ", " wrote to us"), ("I know ", " from school"), ("her real name: ", ""), ("", " is my neighbour"), ("", " lives next door"), ("", " called me yesterday"), ("", " told everybody"), ("ich heiße ", ""), ("mein Nachbar ", " war da"), ("mi nombre es ", ""), ("me llamo ", " y tú"), ("soy ", "")])
            else:
                before, after = pick([("名前は", "です"), ("氏名:", ""), ("本名 ", ""), ("私は", "です"), ("", "と申します"), ("", "といいます"), ("実名は", "だよ"), ("昨日", "さんに会った"), ("", "さんとかいう方"), ("隣の", "さん"), ("部長の", "氏"), ("校長の", "先生が来た"), ("", "先生が言ってた"), ("友達の", "くん"), ("母は", "です"), ("", "さんが住んでる"), ("中の人は", "らしい"), ("", "って人知ってる?"), ("クラスの", "ちゃん")])
            return ("" if bare else before), kind, name, ("" if bare else after)
        if self.chance(0.05):
            return self.identity()[0].strip() + pick(["", "?", " lost", " なくした", " please", "って何"]), None, "", ""
        said = self.number_none() if self.chance(0.4) else self.chatter()
        if self.chance(0.12):  # one word shouted
            words = said.split(" ")
            i = self.r.randrange(len(words))
            return " ".join([*words[:i], words[i].upper(), *words[i + 1 :]]), None, "", ""
        return (said.upper() if self.chance(0.05) else said), None, "", ""

    def sentence(self) -> Sentence:
        pick = self.pick
        if self.chance(0.28):
            kind = pick(["person_name"] * 5 + ["email", "phone"] + [None] * 7)
            value = {"person_name": self.person, "email": self.email, "phone": self.phone, None: self.nick}[kind]()
            return value, "name", [(0, len(value), kind)] if kind else []
        text, gold = "", []
        for _ in range(pick([1, 1, 1, 2, 2, 3, 4])):
            before, kind, value, after = self.part()
            text += (pick([" ", " ", " ", "、", "\n", " / ", ", ", "。"]) if text else "") + before
            if kind:
                gold.append((len(text), len(text) + len(value), kind))
                text += value + after
                if self.chance(0.08):
                    text += pick([" ", "、"]) + pick(["8" * self.r.randint(3, 8), f"{self.r.randint(2, 300)}{pick(['点', '回目', '人目', ' points', ' more', '連敗'])}"])
        return text, "content", gold

    def listed(self) -> Sentence:
        """Lists of numbers, alone or before a phone number: where one ends and the other begins."""
        if self.chance(0.3):  # several of one kind in a row
            make, kind = self.pick([(self.phone, "phone"), (self.phone, "phone"), (self.email, "email"), (self.person, "person_name")])
            gap, one, text, gold = self.pick([" ", ", ", " / ", "、"]), make(), "", []
            for _ in range(self.r.randint(2, 7)):
                one = make() if kind != "phone" or self.chance(0.3) else re.sub(r"\d", lambda m: m.group() if m.start() < 3 else self.d(1), one)
                text += gap if text else ""
                gold.append((len(text), len(text) + len(one), kind))
                text += one
            return text, "content", gold
        size, top, gap = self.r.randint(4, 30), self.pick([9, 30, 99, 400]), self.pick([", ", " ", ",", "-", "/", "."])
        text = gap.join(str(i % top + 1) if self.chance(0.5) else str(self.r.randint(0, top)) for i in range(size))
        if self.chance(0.5):
            return text, "content", []
        text += self.pick([", ", " tel: ", " ", " / "])
        value = self.pick([f"{self.pick(['090', '080', '070'])}-{self.d(4)}-{self.d(4)}", f"0{self.d(1)}-{self.d(4)}-{self.d(4)}", f"+44 20 {self.d(4)} {self.d(4)}"])
        return text + value, "content", [(len(text), len(text) + len(value), "phone")]


def invented_sentences(n: int = 13000, seed: int = 11) -> list[Sentence]:
    """n sentences (text, place, entities); the same for the same seed."""
    m = Maker(seed)
    return [m.listed() if i % 25 == 0 else m.sentence() for i in range(n)]
