"""The segmentation cases: sentences as an analyser cuts them, token by token, with what must come of them.

No analyser is available, so each case has its tokens by hand, as surface/pos1-pos2-pos3/reading, and where
they differ lemma, its reading, conjugation type and form; `+` begins another reading of the sentence.
"""

import pytest

from termflow.operators import segmentation
from termflow.plans.session import Engine

FREQ = "dict string, term string, reading string, value bigint, display string, kana_marker boolean, entry_ord bigint"
#: Tokens that many cases have, by a name.
SHARED = {
    "は": "は/助詞-係助詞/ワ", "を": "を/助詞-格助詞/オ", "に": "に/助詞-格助詞/ニ", "が": "が/助詞-格助詞/ガ", "の": "の/助詞-格助詞/ノ", "から": "から/助詞-格助詞/カラ", "か": "か/助詞-終助詞/カ", "ね": "ね/助詞-終助詞/ネ",
    "た": "た/助動詞/タ/た/タ/助動詞-タ/終止形-一般", "ます": "ます/助動詞/マス/ます/マス/助動詞-マス/終止形-一般", "まし": "まし/助動詞/マシ/ます/マス/助動詞-マス/連用形-一般", "ない": "ない/助動詞/ナイ/ない/ナイ/助動詞-ナイ/終止形-一般",
    "て": "て/助詞-接続助詞/テ", "ば": "ば/助詞-接続助詞/バ", "だ": "だ/助動詞/ダ/だ/ダ/助動詞-ダ/終止形-一般", "だっ": "だっ/助動詞/ダッ/だ/ダ/助動詞-ダ/連用形-促音便", "な": "な/助動詞/ナ/だ/ダ/助動詞-ダ/連体形-一般", "。": "。/補助記号-句点/。", "、": "、/補助記号-読点/、",
    "こと": "こと/名詞-普通名詞-一般/コト", "する": "する/動詞-非自立可能/スル/する/スル/サ行変格/終止形-一般", "し": "し/動詞-非自立可能/シ/する/スル/サ行変格/連用形-一般", "い": "い/動詞-非自立可能/イ/いる/イル/上一段-ア行/連用形-一般", "彼": "彼/代名詞/カレ", "私": "私/代名詞/ワタクシ",
    "昨日": "昨日/名詞-普通名詞-副詞可能/キノー", "寿司": "寿司/名詞-普通名詞-一般/スシ", "食べ": "食べ/動詞-一般/タベ/食べる/タベル/下一段-バ行/連用形-一般", "土曜": "土曜/名詞-普通名詞-副詞可能/ドヨー", "日": "日/名詞-普通名詞-副詞可能/ヒ", "会い": "会い/動詞-一般/アイ/会う/アウ/五段-ワア行/連用形-一般",
    "ましょう": "ましょう/助動詞/マショー/ます/マス/助動詞-マス/意志推量形", "行き": "行き/動詞-非自立可能/イキ/行く/イク/五段-カ行/連用形-一般", "行っ": "行っ/動詞-非自立可能/イッ/行く/イク/五段-カ行/連用形-促音便", "学校": "学校/名詞-普通名詞-一般/ガッコー", "夏子": "夏子/名詞-固有名詞-人名/ナツコ",
    "なきゃ": "なきゃ/助動詞/ナキャ/ない/ナイ/助動詞-ナイ/仮定形-融合", "さっき": "さっき/名詞-普通名詞-副詞可能/サッキ", "まで": "まで/助詞-副助詞/マデ", "辺り": "辺り/名詞-普通名詞-一般/アタリ", "一面": "一面/名詞-普通名詞-一般/イチメン", "丘": "丘/名詞-普通名詞-一般/オカ", "犬": "犬/名詞-普通名詞-一般/イヌ",
    "殺す": "殺す/動詞-一般/コロス/殺す/コロス/五段-サ行/終止形-一般", "気": "気/名詞-普通名詞-一般/キ", "ず": "ず/助動詞/ズ/ぬ/ヌ/助動詞-ヌ/連用形-一般", "ん": "ん/助動詞/ン/ぬ/ヌ/助動詞-ヌ/終止形-撥音便", "昼": "昼/名詞-普通名詞-副詞可能/ヒル", "お": "お/接頭辞/オ", "さん": "さん/接尾辞-名詞的-一般/サン",
    "この": "この/連体詞/コノ", "です": "です/助動詞/デス/です/デス/助動詞-デス/終止形-一般", "いる": "いる/動詞-非自立可能/イル/いる/イル/上一段-ア行/終止形-一般", "さ": "さ/接尾辞-名詞的-一般/サ", "も": "も/助詞-係助詞/モ", "で": "で/助詞-格助詞/デ", "と": "と/助詞-格助詞/ト",
}

#: file -> (dictionary: term, reading, rank and k for a kana entry; cases: name, tokens, segments, terms, absent).
#: Segments are surface|reading|part of speech, terms surface|lemma|lemma reading|part of speech|surface reading; what is left out isn't asked.
CASES = {
    "core": ("", [
        ("plain sentence", "昨日 は 寿司 を 食べ た 。", "昨日|きのう|Noun は|わ|Postposition 寿司|すし|Noun を|お|Postposition 食べた|たべた|Verb 。||Symbol", "昨日|昨日|きのう|Noun 寿司|寿司|すし|Noun", ""),
        ("no compound without data", "土曜 日 に 会い ましょう 。", "土曜|どよう|Noun 日|ひ|Noun に||Postposition 会いましょう|あいましょう|Verb 。||Symbol", "", "土曜日"),
        ("adnominal na", "こんな/連体詞/コンナ 話/名詞-普通名詞-サ変可能/ハナシ は おかしな/連体詞/オカシナ こと だ", "", "おかしな|おかしな||AdjectivalNoun こんな|こんな||Determiner", ""),
    ]),
    "compounds": ("京都駅 きょうとえき 3000, 取り戻す とりもどす 4000, 行く いく 100", [
        ("unvalidated compound splits", "夏子 おば/名詞-普通名詞-一般/オバ さん を 取り戻さ/動詞-一般/トリモドサ/取り戻す/トリモドス/五段-サ行/未然形-一般 なきゃ 。", "", "夏子|||ProperNoun おばさん|おばさん 取り戻さなきゃ|取り戻す", "夏子おばさん 夏子おば"),
        ("dictionary-backed compound stays", "京都/名詞-固有名詞-地名/キョート 駅/名詞-普通名詞-一般/エキ に 行っ た", "", "京都駅|||CompoundNoun", ""),
    ]),
    "deinflection": ("行く いく 100, 会う あう 200, 食べる たべる 300, 溺れる おぼれる 4700, 殺す ころす 400, 高い たかい 250, 助ける たすける 500, 助け たすけ 100, 使う つかう 150, 覚える おぼえる 900, 覚え おぼえ 400, つまらない つまらない 2455 k, つまる つまる 2806 k", [
        ("past tense", "昨日 は 寿司 を 食べ た 。", "", "食べた|食べる|たべる|Verb", ""),
        ("polite volitional", "土曜 日 に 会い ましょう 。", "", "会いましょう|会う|あう|Verb", ""),
        ("polite non-past", "学校 に 行き ます 。", "", "行きます|行く|いく|Verb", ""),
        ("te-form after causative", "彼女/代名詞/カノジョ を 溺れ/動詞-一般/オボレ/溺れる/オボレル/下一段-ラ行/未然形-一般 させ/助動詞/サセ/させる/サセル/下一段-サ行/連用形-一般 て 殺し/動詞-一般/コロシ/殺す/コロス/五段-サ行/連用形-一般 た 。", "", "溺れさせて|溺れる|おぼれる|Verb 殺した|殺す|ころす|Verb", ""),
        ("conditional of an adjective", "高けれ/形容詞-一般/タカケレ/高い/タカイ/形容詞/仮定形-一般 ば 買わ/動詞-一般/カワ/買う/カウ/五段-ワア行/未然形-一般 ない 。", "", "高ければ|高い|たかい", ""),
        ("conditional through nai", "食べ なけれ/助動詞/ナケレ/ない/ナイ/助動詞-ナイ/仮定形-一般 ば なら/動詞-非自立可能/ナラ/なる/ナル/五段-ラ行/未然形-一般 ない 。", "", "食べなければ|食べる|たべる", ""),
        ("passive and darou", "魔法/名詞-普通名詞-一般/マホー を 使え/動詞-一般/ツカエ/使う/ツカウ/五段-ワア行/仮定形-一般 ば 助け/動詞-一般/タスケ/助ける/タスケル/下一段-カ行/未然形-一般 られる/助動詞/ラレル/られる/ラレル/助動詞-レル/終止形-一般 だろう/助動詞/ダロー/だ/ダ/助動詞-ダ/意志推量形", "", "使えば|使う|つかう|Verb 助けられる|助ける|たすける|Verb", "助けられるだろう 助け"),
        ("lexicalised negative", "この 映画/名詞-普通名詞-一般/エーガ は つまら/動詞-一般/ツマラ/つまる/ツマル/五段-ラ行/未然形-一般 なかっ/助動詞/ナカッ/ない/ナイ/助動詞-ナイ/連用形-促音便 た 。", "", "つまらなかった|つまらない|つまらない", ""),
        ("nakya", "覚え/動詞-一般/オボエ/覚える/オボエル/下一段-ア行/未然形-一般 なきゃ いけ/動詞-非自立可能/イケ/いける/イケル/下一段-カ行/未然形-一般 ない こと は たくさん/副詞/タクサン ある/動詞-非自立可能/アル/ある/アル/五段-ラ行/終止形-一般 から ね", "", "覚えなきゃ|覚える|おぼえる|Verb", "覚え"),
    ]),
    "nbest": ("口約束 くちやくそく 500, 口 くち 400, 約束 やくそく 600, 丘 おか 2000, あったかい あったかい 7000 k, つける つける 900 k, 母さん かあさん 800, 犬 いぬ 300, 値する あたいする 9000, 値 あたい 9000, 待つ まつ 500", [
        ("wrong compound", "口約/名詞-普通名詞-一般/コーヤク 束/名詞-普通名詞-一般/タバ は いけ/動詞-非自立可能/イケ/いける/イケル/下一段-カ行/連用形-一般 ませ/助動詞/マセ/ます/マス/助動詞-マス/未然形-一般 ん な/助詞-終助詞/ナ + 口/名詞-普通名詞-一般/クチ 約束/名詞-普通名詞-サ変可能/ヤクソク は いけ/動詞-非自立可能/イケ/いける/イケル/下一段-カ行/連用形-一般 ませ/助動詞/マセ/ます/マス/助動詞-マス/未然形-一般 ん な/助詞-終助詞/ナ", "", "口約束||くちやくそく|NounExpression", "口約"),
        ("phantom verb", "さっき まで 辺り 一面 丘だっ/動詞-一般/オカダッ/丘だつ/オカダツ/五段-タ行/連用形-促音便 た の に + さっき まで 辺り 一面 丘 だっ た の に", "", "丘||おか", "丘だつ"),
        ("stranded kana word", "わあっ/感動詞-一般/ワーッ たかい/形容詞-一般/タカイ/たかい/タカイ/形容詞/終止形-一般 + わ/感動詞-一般/ワ あったかい/形容詞-一般/アッタカイ/あったかい/アッタカイ/形容詞/終止形-一般", "", "あったかい|あったかい", "たかい"),
        ("conditional re-fused across ta", "上級/名詞-普通名詞-一般/ジョーキュー 者/接尾辞-名詞的-一般/シャ が 英語/名詞-普通名詞-一般/エーゴ 力/接尾辞-名詞的-一般/リョク （/補助記号-括弧開/（ 特に/副詞/トクニ 読解/名詞-普通名詞-サ変可能/ドッカイ 力/接尾辞-名詞的-一般/リョク ）/補助記号-括弧閉/） を つけ/動詞-一般/ツケ/つける/ツケル/下一段-カ行/連用形-一般 た けれ/動詞-一般/ケレ/ける/ケル/五段-ラ行/仮定形-一般 ば 、 語彙/名詞-普通名詞-一般/ゴイ を 増やす/動詞-一般/フヤス の が 王道/名詞-普通名詞-一般/オードー です ね 。", "", "つけたければ|つける|つける", "ける"),
        ("reading of kaasan", "お前/代名詞/オマエ ら/接尾辞-名詞的-一般/ラ なんて/助詞-副助詞/ナンテ すぐ/副詞/スグ に 母/名詞-普通名詞-一般/バー さん が 殺す から + お前/代名詞/オマエ ら/接尾辞-名詞的-一般/ラ なんて/助詞-副助詞/ナンテ すぐ/副詞/スグ に 母/名詞-普通名詞-一般/カー さん が 殺す から", "", "母さん||かあさん", ""),
        ("noun, not suffix", "犬/接尾辞-名詞的-一般/ケン な の ？/補助記号-句点/？ + 犬 な の ？/補助記号-句点/？", "", "犬||いぬ", ""),
        ("suru noun keeps its reading", "万死/名詞-普通名詞-一般/バンシ に 値/名詞-普通名詞-サ変可能/アタイ する", "", "値する||あたい", ""),
        ("imperative", "ここ/代名詞/ココ で 吉報/名詞-普通名詞-一般/キッポー を 待/動詞-一般/マ/待る/マル/上一段-ラ行/連用形-一般 て + ここ/代名詞/ココ で 吉報/名詞-普通名詞-一般/キッポー を 待て/動詞-一般/マテ/待つ/マツ/五段-タ行/命令形", "", "待て|待つ|まつ", "待るて"),
    ]),
    "nbest_negative": ("犬 けん 1000, 行く いく 200", [
        ("validated reading is left alone", "犬/名詞-普通名詞-一般/ケン な の ？/補助記号-句点/？ + 犬 な の ？/補助記号-句点/？", "", "犬||けん", ""),
        ("proper noun is untouched", "夏子 が 行っ た", "", "夏子|||ProperNoun 行った|行く", ""),
    ]),
    "numbers": ("", [
        ("date", "8/名詞-数詞/ハチ 月/名詞-普通名詞-助数詞可能/ガツ 2/名詞-数詞/ニ 2/名詞-数詞/ニ 日/名詞-普通名詞-助数詞可能/ニチ に 行き ます 。", "8月|はちがつ|Counter 22日|にじゅうににち|Counter に||Postposition 行きます|いきます|Verb 。||Symbol", "", ""),
        ("thousands", "3000/名詞-数詞/* 円/名詞-普通名詞-一般/エン です 。", "3000|さんぜん|Number 円|えん|Noun です||Copula 。||Symbol", "", ""),
        ("myriads", "1/名詞-数詞/イチ 2/名詞-数詞/ニ 5/名詞-数詞/ゴ 0/名詞-数詞/ゼロ 0/名詞-数詞/ゼロ 人/接尾辞-名詞的-助数詞/ニン が い た 。", "", "12500人||||いちまんにせんごひゃくにん", ""),
        ("half past", "私 たち/接尾辞-名詞的-一般/タチ は ８/名詞-数詞/ハチ 時/名詞-普通名詞-助数詞可能/ジ 半/名詞-普通名詞-副詞可能/ハン に 学校 に 着き/動詞-一般/ツキ/着く/ツク/五段-カ行/連用形-一般 まし た 。", "私たち|わたくしたち|Pronoun は||Postposition ８時半|はちじはん|Counter に||Postposition 学校|がっこう|Noun に||Postposition 着きました|つきました|Verb 。||Symbol", "８時半|||Counter", ""),
    ]),
    "phrases": ("株式会社 かぶしきがいしゃ 1000, 株式 かぶしき 2000, 会社 かいしゃ 300, 土曜日 どようび 1000, 土曜 どよう 4000, 日 ひ 500, 一筋縄 ひとすじなわ 8000, 一筋 ひとすじ 9000, 縄 なわ 7000, 辺り一面 あたりいちめん 6000, 辺り あたり 1000, 一面 いちめん 6000, 丘 おか 2000, になると になると 4000, 手がかり てがかり 3000, なる なる 100 k, 複合体 ふくごうたい 78145, 複合 ふくごう 15917, 体 たい 1401, 中途半端 ちゅうとはんぱ 1000, 中途 ちゅうと 20000, 負けじと まけじと 30000, 負け まけ 3000, 半端 はんぱ 15000, 相変わらず あいかわらず 1000, 変わる かわる 500, 気になる きになる 3000, 気 き 200", [
        ("rendaku compound", "株式/名詞-普通名詞-一般/カブシキ 会社/名詞-普通名詞-一般/カイシャ で 働い/動詞-一般/ハタライ/働く/ハタラク/五段-カ行/連用形-イ音便 て い ます 。", "", "株式会社||かぶしきがいしゃ|NounExpression", "株式 会社"),
        ("three kanji", "土曜 日 に 会い ましょう 。", "", "土曜日||どようび|NounExpression", ""),
        ("hitosujinawa", "やはり/副詞/ヤハリ 一筋/名詞-普通名詞-一般/ヒトスジ 縄/名詞-普通名詞-一般/ナワ で は いか/動詞-非自立可能/イカ/いく/イク/五段-カ行/未然形-一般 ない か", "", "一筋縄||ひとすじなわ|NounExpression", ""),
        ("atari ichimen", "さっき まで 辺り 一面 丘 だっ た の に", "", "辺り一面||あたりいちめん|NounExpression", ""),
        ("rare compound of common parts", "頭脳/名詞-普通名詞-一般/ズノー の 新しい/形容詞-一般/アタラシー 受容/名詞-普通名詞-サ変可能/ジュヨー 器/接尾辞-名詞的-一般/キ の 複合/名詞-普通名詞-サ変可能/フクゴー 体/名詞-普通名詞-一般/タイ を 識別/名詞-普通名詞-サ変可能/シキベツ する 。", "", "複合体||ふくごうたい|NounExpression", ""),
        ("particles end no phrase", "ココ/代名詞/ココ の 存在/名詞-普通名詞-サ変可能/ソンザイ が 手がかり/名詞-普通名詞-一般/テガカリ に なる/動詞-非自立可能/ナル と 思っ/動詞-一般/オモッ/思う/オモウ/五段-ワア行/連用形-促音便 て い た けど/助詞-接続助詞/ケド", "", "", "になると"),
        ("na-bound adjectival compound", "中途/名詞-普通名詞-一般/チュート 半端/形状詞-一般/ハンパ な 動き/名詞-普通名詞-一般/ウゴキ を し た", "", "中途半端な|中途半端|ちゅうとはんぱ|Expression", "中途半端な動き 半端 中途"),
        ("conjugated tail", "彼 の こと が 気 に なっ/動詞-非自立可能/ナッ/なる/ナル/五段-ラ行/連用形-促音便 た 。", "", "気になった|気になる||Expression", ""),
        ("stranded prefix", "相/接頭辞/アイ 変わら/動詞-一般/カワラ/変わる/カワル/五段-ラ行/未然形-一般 ず ひどい/形容詞-一般/ヒドイ こと 言う/動詞-一般/イウ なぁ/助詞-終助詞/ナー", "", "相変わらず|相変わらず|あいかわらず|Expression", "相"),
        ("phrase with a particle keeps its words", "彼 の こと が 気 に なる/動詞-非自立可能/ナル 。", "", "気になる|||Expression 気|気 なる|なる", ""),
        ("makejito", "私 は 客/名詞-普通名詞-一般/キャク の 出す/動詞-一般/ダス 音/名詞-普通名詞-一般/オト に 圧倒/名詞-普通名詞-サ変可能/アットー さ/動詞-非自立可能/サ/する/スル/サ行変格/未然形-サ れ/助動詞/レ/れる/レル/助動詞-レル/連用形-一般 ながら/助詞-接続助詞/ナガラ も 、 負け/名詞-普通名詞-一般/マケ じと/副詞/ジト 、 「/補助記号-括弧開/「 いらっしゃい/動詞-非自立可能/イラッシャイ ませ/助動詞/マセ/ます/マス/助動詞-マス/命令形 」/補助記号-括弧閉/」", "", "負けじと|負けじと|まけじと|Expression", "負け じと"),
    ]),
    "prefixes": ("第一 だいいち 2000, 昼 ひる 3000", [
        ("whole word", "私 は 時間/名詞-普通名詞-一般/ジカン 厳守/名詞-普通名詞-サ変可能/ゲンシュ を 第/接頭辞/ダイ 一/名詞-数詞/イチ に し て いる 。", "", "第一|第一|だいいち", "一"),
        ("honorific", "お 昼 から 始めよう/動詞-一般/ハジメヨー/始める/ハジメル/下一段-マ行/意志推量形", "", "お昼|昼|ひる", ""),
    ]),
    "suffix_merges": ("悪い わるい 500, 柔らかさ やわらかさ 8000, 静かさ しずかさ 9000, 高い たかい 300, 何気 なにげ 9000, 説得 せっとく 2000, おぼろげ おぼろげ 12000 k, 楽しげ たのしげ 15000, 楽しい たのしい 800", [
        ("warusou", "具合/名詞-普通名詞-一般/グアイ が 悪/形容詞-一般/ワル/悪い/ワルイ/形容詞/語幹-一般 そう/形状詞-助動詞語幹/ソー に 道端/名詞-普通名詞-一般/ミチバタ で うずくまっ/動詞-一般/ウズクマッ/うずくまる/ウズクマル/五段-ラ行/連用形-促音便 て い た から", "", "悪そう|悪い|わるい|Adjective", "悪"),
        ("yawarakasa", "この 関節/名詞-普通名詞-一般/カンセツ の 柔らか/形状詞-一般/ヤワラカ さ …/補助記号-一般/… 人並み/名詞-普通名詞-一般/ヒトナミ 外れ/動詞-一般/ハズレ/外れる/ハズレル/下一段-ラ行/連用形-一般 て いる", "", "柔らかさ|柔らかさ|やわらかさ|Noun", ""),
        ("shizukasa", "静か/形状詞-一般/シズカ さ が 好き/形状詞-一般/スキ だ", "", "静かさ|静かさ|しずかさ", "静かい"),
        ("takasa", "北部/名詞-普通名詞-一般/ホクブ 高原/名詞-普通名詞-一般/コーゲン の 標高/名詞-普通名詞-一般/ヒョーコー の 高/形容詞-一般/タカ/高い/タカイ/形容詞/語幹-一般 さ が 成せる/動詞-一般/ナセル 業/名詞-普通名詞-一般/ワザ だ", "", "高さ|高い|たかい", ""),
        ("nanige", "私 何/代名詞/ナニ 気/接尾辞-名詞的-一般/ゲ に お 昼 から フェリー/名詞-普通名詞-一般/フェリー 乗る/動詞-一般/ノル の 初めて/副詞/ハジメテ な 気 が し ます", "", "何気|何気|なにげ", ""),
        ("settoku suru", "私 は 君/代名詞/キミ を 説得/名詞-普通名詞-サ変可能/セットク する だけ/助詞-副助詞/ダケ の 言葉/名詞-普通名詞-一般/コトバ を 持ち合わせ/動詞-一般/モチアワセ/持ち合わせる/モチアワセル/下一段-サ行/連用形-一般 て い ない", "", "説得する|説得|せっとく|SuruVerb", ""),
        ("oboroge", "どこ/代名詞/ドコ か おぼろ/形状詞-一般/オボロ げ/接尾辞-形状詞的/ゲ で/助動詞/デ/だ/ダ/助動詞-ダ/連用形-一般 、 鮮明/形状詞-一般/センメー に は 思いだせ/動詞-一般/オモイダセ/思いだせる/オモイダセル/下一段-サ行/未然形-一般 ない", "", "おぼろげ|おぼろげ|おぼろげ|AdjectivalNoun", "げ おぼろ"),
        ("tanoshige", "彼 は 楽し/形容詞-一般/タノシ/楽しい/タノシイ/形容詞/語幹-一般 げ/接尾辞-形状詞的/ゲ に 笑っ/動詞-一般/ワラッ/笑う/ワラウ/五段-ワア行/連用形-促音便 た", "", "楽しげ|楽しい|たのしい|AdjectivalNoun", "げ"),
    ]),
}
#: What the analyser makes of spans that are read by themselves.
SPANS = {"つけたければ": "つけ/動詞-一般/ツケ/つける/ツケル/下一段-カ行/連用形-一般 たけれ/助動詞/タケレ/たい/タイ/助動詞-タイ/仮定形-一般 ば"}


def tokens(text):
    """Tokens of one reading, with their places in bytes."""
    out, at = [], 0
    for part in text.split():
        surface, pos, reading, lemma, lemma_reading, c_type, c_form = [*SHARED.get(part, part).split("/"), "", "", "", ""][:7]
        end = at + len(surface.encode())
        tags = [*pos.split("-"), "", "", ""][:4]
        reading = surface if reading == "*" else reading
        out.append(segmentation.Token(surface, *tags, c_type, c_form, reading, lemma or surface, lemma_reading or reading, at, end))
        at = end
    return out


def entries(text):
    rows = [e.split() for e in text.split(",") if e.strip()]
    return [("TEST", r[0], r[1], int(r[2]), f"{r[2]}㋕" if r[3:] else r[2], bool(r[3:]), i) for i, r in enumerate(rows)]


@pytest.mark.parametrize("name", sorted(CASES))
def test_segmentation_cases(spark, name):
    dictionary, cases = CASES[name]
    script = {t: [tokens(x)] for t, x in SPANS.items()}
    texts = []
    for _, said, *_ in cases:
        paths = [tokens(p) for p in said.split(" + ")]
        texts.append("".join(t.surface for t in paths[0]))
        script[texts[-1]] = paths
    engine = Engine(spark, tokenizer=segmentation.ScriptedTokenizer(script), freq=spark.createDataFrame(entries(dictionary), FREQ))
    sentences = spark.createDataFrame(list(enumerate(texts)), "sentence_id long, text string")
    segments = engine.segmented(sentences).orderBy("sentence_id", "ord").collect()
    terms = engine.sentence_terms(sentences).collect()
    wrong = []
    for k, (case, _, want_segments, want_terms, absent) in enumerate(cases):
        own, found = [r for r in segments if r["sentence_id"] == k], [r for r in terms if r["sentence_id"] == k]
        if want_segments:
            want = [w.split("|") for w in want_segments.split()]
            if [r["full_segment"] for r in own] != [w[0] for w in want]:
                wrong.append((case, [r["full_segment"] for r in own]))
            else:
                wrong += [(case, tuple(r)) for r, w in zip(own, want, strict=True) if w[1] not in ("", r["full_reading"]) or w[2] != r["pos"]]
        for w in want_terms.split():
            surface, *values = [*w.split("|"), "", "", "", ""][:5]
            r = next((r for r in found if surface in (r["full_segment"], r["surface"])), None)
            if r is None or any(v not in ("", r[c]) for v, c in zip(values, ("lemma", "lemma_reading", "pos", "surface_reading"), strict=True)):
                wrong.append((case, w, r and tuple(r)))
        wrong += [(case, "absent", x) for x in absent.split() if any(x in (r["full_segment"], r["surface"], r["lemma"]) for r in found)]
    assert not wrong


def test_there_are_49_cases():
    assert sum(len(c) for _, c in CASES.values()) == 49
