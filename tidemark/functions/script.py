"""Conversion between Chinese scripts by the longest phrase of a table, for a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Frequent characters that differ between the scripts, simple and traditional; larger tables may be given to Script.
SIMPLE = "万亿两个这来为们时说国会学对发里后过开关问间见现进还没经业动东车长门马鸟鱼龙风飞书写读话语请谢认识让记许论设计谁课谈调议讲诉词试该误红级纪约线练组细终结给统继续绝维网罗联声听职头买卖钱银铁钟铜错锁镇银难边远运近选递道达连迟适种积称稳穷空竞笔简类粮紧纸织热爱乐欢观权样标树桥机条极构枪档检楼术极气汤沟泪洁济浅测浓润涨渐湿满灵灯炉点烟烧热爷牵状独狮猫现环画疗疯盐监盖盘睁矿码确礼离杀杂乡买乱争产亲仅从仓仪价众优伙伞伟传伤伦伪"
TRADITIONAL = "萬億兩個這來為們時說國會學對發裏後過開關問間見現進還沒經業動東車長門馬鳥魚龍風飛書寫讀話語請謝認識讓記許論設計誰課談調議講訴詞試該誤紅級紀約線練組細終結給統繼續絕維網羅聯聲聽職頭買賣錢銀鐵鐘銅錯鎖鎮銀難邊遠運近選遞道達連遲適種積稱穩窮空競筆簡類糧緊紙織熱愛樂歡觀權樣標樹橋機條極構槍檔檢樓術極氣湯溝淚潔濟淺測濃潤漲漸濕滿靈燈爐點煙燒熱爺牽狀獨獅貓現環畫療瘋鹽監蓋盤睜礦碼確禮離殺雜鄉買亂爭產親僅從倉儀價眾優夥傘偉傳傷倫偽"
SIMPLE_TO_TRADITIONAL = {a: b for a, b in zip(SIMPLE, TRADITIONAL, strict=True) if a != b}
#: Words whose characters would be converted differently alone, simple and traditional.
PHRASES = (
    "头发 頭髮|理发 理髮|发型 髮型|发夹 髮夾|长发 長髮|短发 短髮|白发 白髮|染发 染髮|毛发 毛髮|发廊 髮廊|皇后 皇后|王后 王后|太后 太后|后妃 后妃|公里 公里|英里 英里|里程 里程|千里 千里|万里 萬里|邻里 鄰里|故里 故里|干净 乾淨|饼干 餅乾|干杯 乾杯|干燥 乾燥|干部 幹部|"
    "干活 幹活|才干 才幹|面条 麵條|面包 麵包|面粉 麵粉|方便面 方便麵|关系 關係|联系 聯繫|系统 系統|一只 一隻|复杂 複雜|重复 重複|复习 複習|恢复 恢復|答复 答覆|台风 颱風|钟情 鍾情|制造 製造|复制 複製|松树 松樹|放松 放鬆|北斗 北斗|战斗 戰鬥|斗争 鬥爭|谷物 穀物|准备 準備|收获 收穫|历史 歷史|日历 日曆|旅游 旅遊|余下 餘下|注册 註冊"
)
#: Traditional words of which a character stays.
KEPT = "乾隆|乾坤|瞭望|著作|著名"
#: A table of more phrases than this isn't taken to the driver.
MAX_PHRASES = 2_000_000


class Phrases:
    """A table of phrases as an automaton: a trie whose steps, sorted by node and character, are looked up for all places of all texts at once.

    At each place that isn't inside a phrase already, the longest phrase that begins there is replaced."""

    def __init__(self, table: dict[str, str]):
        steps: dict[tuple[int, int], int] = {}
        entry_at: dict[int, int] = {}
        replaced: list[str] = []
        for phrase, new in table.items():
            node = 0
            for c in map(ord, phrase):
                node = steps.setdefault((node, c), len(steps) + 1)
            if node:
                entry_at[node] = len(replaced)
                replaced.append(new)
        keys = np.array([node << 21 | c for node, c in steps], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(steps.values()), np.int32)[order]
        self.entry = np.full(len(steps) + 1, -1, np.int32)
        self.entry[list(entry_at)] = list(entry_at.values())
        self.codes = _codes("".join(replaced))
        self.begins = np.concatenate(([0], np.cumsum([len(x) for x in replaced]))).astype(np.int64)

    def _step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to from nodes, -1 for none."""
        key = nodes.astype(np.int64) << 21 | codes
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def longest(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, entry) of the longest phrase at each place that has one. ends: of each place's text."""
        length, entry = np.zeros(len(codes), np.int64), np.full(len(codes), -1, np.int32)
        at, nodes, depth = np.arange(len(codes)), np.zeros(len(codes), np.int32), 0
        while len(at) and len(self.keys):
            nodes = self._step(nodes, codes[at + depth])
            at, nodes = at[nodes >= 0], nodes[nodes >= 0]
            depth += 1
            whole = self.entry[nodes] >= 0
            length[at[whole]], entry[at[whole]] = depth, self.entry[nodes[whole]]
            more = at + depth < ends[at]
            at, nodes = at[more], nodes[more]
        found = np.flatnonzero(length)
        return found, length[found], entry[found]

    def replace(self, codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts that lie between cuts, and their new cuts."""
        place, length, entry = self.longest(codes, np.repeat(cuts[1:], np.diff(cuts)))
        reach = np.maximum.accumulate(place + length) if len(place) else place
        crossed = np.concatenate(([False], place[1:] < reach[:-1])) if len(place) else np.zeros(0, bool)
        taken, upto = np.ones(len(place), bool), 0
        for k in np.flatnonzero(crossed).tolist():  # what begins inside an earlier phrase, if that was taken, isn't
            if not crossed[k - 1]:
                upto = place[k - 1] + length[k - 1]
            taken[k] = place[k] >= upto
            if taken[k]:
                upto = place[k] + length[k]
        place, length, entry = place[taken], length[taken], entry[taken]
        size = np.ones(len(codes), np.int64)
        inside = np.repeat(place, length) + _ragged(length)
        size[inside] = 0
        new = self.begins[entry + 1] - self.begins[entry]
        size[place] = new
        begins = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(int(begins[-1]), codes.dtype)
        kept = np.ones(len(codes), bool)
        kept[inside] = False
        out[begins[:-1][kept]] = codes[kept]
        out[np.repeat(begins[place], new) + _ragged(new)] = self.codes[np.repeat(self.begins[entry], new) + _ragged(new)]
        return out, begins[cuts]

    def __call__(self, texts: list[str]) -> list[str]:
        codes, cuts = _codes("".join(texts)), np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
        if not len(codes):
            return list(texts)
        out, cuts = self.replace(codes, cuts)
        joined = out.astype("<u4").tobytes().decode("utf-32-le")
        return [joined[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


def _ragged(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... below each size, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _both_ways() -> tuple[dict[str, str], dict[str, str]]:
    pairs = [x.split() for x in PHRASES.split("|")]
    up = SIMPLE_TO_TRADITIONAL | dict(pairs)
    down = {v: k for k, v in SIMPLE_TO_TRADITIONAL.items()} | {v: k for k, v in pairs} | {x: x for x in KEPT.split("|")}
    return down, up


class Script:
    """zh to simple characters, yue to traditional ones. Each direction is a table of phrases (single characters among them), or several that are
    applied one after the other, as for regional variants."""

    def __init__(self, to_simple: dict[str, str] | list[dict[str, str]] | None = None, to_traditional: dict[str, str] | list[dict[str, str]] | None = None):
        down, up = _both_ways()
        steps = lambda given, default: [Phrases(x) for x in (given if isinstance(given, list) else [given or default])]
        if to_traditional and not to_simple:
            tables = to_traditional if isinstance(to_traditional, list) else [to_traditional]
            down = {v: k for t in tables for k, v in t.items()}
        self.steps = {"zh": steps(to_simple, down), "yue": steps(to_traditional, up)}
        self.known: dict[tuple[str, str], str] = {}

    def batch(self, texts: Iterable[str | None], languages: Iterable[str | None]) -> list[str | None]:
        """Each text in its language's script; texts of other languages and nulls as they are."""
        texts, languages = list(texts), list(languages)
        for language, steps in self.steps.items():
            mine = [k for k, (t, x) in enumerate(zip(texts, languages, strict=True)) if t is not None and x == language]
            for step in steps:
                for k, new in zip(mine, step([texts[k] for k in mine]), strict=True):
                    texts[k] = new
        return texts

    def __call__(self, text: str, language: str | None) -> str:
        """One short text, as a numeral, which is remembered."""
        key = (text, language or "")
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = self.batch([text], [language])[0]
        return self.known[key]


def phrase_table(spark: SparkSession, path: str, limit: int = MAX_PHRASES) -> dict[str, str]:
    """phrase -> replacement from lines `phrase<tab>replacement`; of several replacements, parted by spaces, the first, of a repeated phrase the
    smallest. Lines without a tab or with # at the beginning are skipped. A table of more than limit phrases is an error: it goes to each worker."""
    rows = spark.read.text(path).where(F.col("value").contains("\t") & ~F.col("value").startswith("#"))
    parts = F.split("value", "\t")
    pairs = rows.select(F.trim(parts[0]).alias("a"), F.split(F.trim(parts[1]), " ")[0].alias("b")).where("a <> ''").groupBy("a").agg(F.min("b").alias("b"))
    found = pairs.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a table of more than {limit} phrases")
    return {r["a"]: r["b"] for r in found}


def converted(text: Column | str, language: Column | str, script: Script | None = None) -> Column:
    """Texts in the script of their language (zh or yue). The tables go to the workers with the function, which Spark broadcasts."""
    script = script or Script()

    @F.pandas_udf("string")
    def each(t: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series(script.batch(t, lang), dtype=object)

    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return each(as_column(text), as_column(language))
