"""Explainable scores of clusters and sources as column expressions.

The weights and word lists are fixed values: results must agree with them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.dates import half_life
from galley.functions.text import contains_any

#: Wording that lowers or raises the quality of a report.
CLICKBAIT = ["震惊", "惊人", "竟然", "居然", "太可怕", "别再", "速看", "紧急通知", "火了", "炸了", "刷屏", "看完沉默", "不转不是", "一定要看", "最后一天", "内部消息", "惊天", "揭秘", "内幕", "史上最", "无人敢", "全网", "沸腾", "秒杀", "崩了", "破防", "泪目", "笑不活了", "细节曝光", "真相了", "彻底慌了", "傻眼"]
RUMOR = ["网传", "传闻", "疑似", "据传", "知情人士", "爆料", "有消息称", "坊间", "据网友", "未经证实", "或将", "传出", "小道消息", "内部人士透露"]
ATTRIBUTION = ["新华社", "据新华社", "通报", "公告", "发布会", "白皮书", "统计局", "央行", "国务院", "公报", "数据显示", "官方", "正式发布", "研究显示", "报告显示", "披露", "答记者问", "公开信息", "记者", "获悉", "文件", "印发", "批复", "年报", "财报", "招股书", "问询函", "判决", "立案"]
HYPE = ["暴涨", "暴跌", "狂飙", "血亏", "腰斩", "崩盘", "清零", "疯抢", "爆火"]
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F000}-\\x{1F2FF}]"
FIGURE = "[0-9]+(?:\\.[0-9]+)?"
QUOTE = "[“”\"「」]"
#: Weights of the parts of credibility and rank, half-life in hours, bands.
CRED_WEIGHTS = {"authority": 0.40, "corroboration": 0.30, "content": 0.20, "timing": 0.10}
RANK_CRED, RANK_RELEVANCE, HALF_LIFE_H = 0.55, 0.45, 18.0
CRED_BANDS = ((75, "CONFIRMED"), (60, "LIKELY"), (40, "SINGLE"))
DOUBT_BANDS = ((50, "SUSPECT"), (25, "QUESTIONABLE"), (10, "MINOR"))
TIER_WEIGHT = {1: 1.0, 2: 0.7, 3: 0.4}


def band(score: Column, bands: tuple, rest: str) -> Column:
    out = F.lit(rest)
    for least, code in reversed(bands):
        out = F.when(score >= least, F.lit(code)).otherwise(out)
    return out


def cred_band(score: Column) -> Column:
    return band(score, CRED_BANDS, "LOW")


def doubt_band(score: Column) -> Column:
    return band(score, DOUBT_BANDS, "CLEAR")


def tier_weight(tier: Column) -> Column:
    out = F.lit(0.3)
    for t, w in TIER_WEIGHT.items():
        out = F.when(tier == t, F.lit(w)).otherwise(out)
    return out


def authority(best: Column, mean: Column) -> Column:
    """Mostly the best source's weight, a little the average's."""
    return 0.70 * best + 0.30 * mean


def corroboration(groups: Column, official: Column, wire: Column) -> Column:
    """Grows with independent groups; a primary or wire source alone gives a small floor."""
    raw = 1 - F.exp(-0.85 * F.greatest(groups - 1, F.lit(0)))
    floor = F.when(official, 0.25).when(wire, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(raw, floor))


def timing(first: Column, last: Column, items: Column, now: Column) -> Column:
    span = F.greatest(F.lit(0), last - first) / 3600
    return F.when(first > now + 3600, 0.30).when(items <= 1, 0.60).when(span <= 6, 1.00).when(span <= 24, 0.85).when(span <= 48, 0.60).otherwise(0.42)


def content_quality(headline: Column, bodies: Column, body_chars: Column) -> Column:
    """Quality of the wording from 0 to 1; `bodies` are the joined summaries, `body_chars` their length."""
    text = F.concat(headline, F.lit(" "), F.substring(bodies, 1, 1500))
    n = {k: F.size(contains_any(headline if k in ("clickbait", "hype") else text, w)) for k, w in {"clickbait": CLICKBAIT, "rumor": RUMOR, "attribution": ATTRIBUTION, "hype": HYPE}.items()}
    marks = F.regexp_count(headline, F.lit("[！!？?]"))
    figures = F.regexp_count(text, F.lit(FIGURE))
    rumor = F.least(F.lit(0.28), 0.12 * n["rumor"]) * F.when(n["attribution"] > 0, 0.5).otherwise(1.0)
    score = F.lit(0.62) - F.least(F.lit(0.30), 0.10 * n["clickbait"]) - rumor + F.least(F.lit(0.20), 0.07 * n["attribution"]) - F.least(F.lit(0.12), 0.06 * n["hype"])
    score = score - F.when(marks >= 2, 0.10).when((marks == 1) & headline.rlike("[！!]$"), 0.04).otherwise(0.0)
    score = score - F.when(headline.rlike(EMOJI), 0.08).otherwise(0.0) + F.when(figures >= 3, 0.10).when(figures >= 1, 0.04).otherwise(0.0)
    score = score + F.when(text.rlike(QUOTE), 0.04).otherwise(0.0) - F.when(F.length(headline) < 8, 0.06).otherwise(0.0) - F.when(F.length(headline) > 60, 0.04).otherwise(0.0)
    score = score + F.when(body_chars >= 120, 0.05).when(body_chars == 0, -0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def credibility(auth: Column, corr: Column, content: Column, time: Column) -> Column:
    w = CRED_WEIGHTS
    total = 100 * (w["authority"] * auth + w["corroboration"] * corr + w["content"] * content + w["timing"] * time)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def rank(cred: Column, relevance: Column, last: Column, now: Column) -> Column:
    base = RANK_CRED * (cred / 100) + RANK_RELEVANCE * relevance
    return base * (0.35 + 0.65 * half_life(now - last, HALF_LIFE_H))


def source_dimensions(n: Column, clustered: Column, contested: Column, lead: Column, corroborated: Column, noise: Column, relevance: Column, doubt: Column) -> dict[str, Column]:
    """The six parts of a source's score, each from 0 to 1; 0 where nothing can be said."""
    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    some = clustered > 0
    return {
        "supply": F.least(F.lit(1.0), F.log1p(n) / F.log1p(F.lit(20))),
        "lead": share(lead, contested),
        "corroborated": share(corroborated, clustered),
        "relevance": F.when(some, F.least(F.lit(1.0), relevance / 0.6)).otherwise(0.0),
        "cleanliness": F.when(some, 1 - noise / clustered).otherwise(0.0),
        "trust": F.when(some, F.greatest(F.lit(0.0), 1 - doubt / 50)).otherwise(0.0),
    }


SOURCE_WEIGHTS = {"supply": 0.20, "lead": 0.20, "corroborated": 0.15, "relevance": 0.20, "cleanliness": 0.15, "trust": 0.10}


def source_score(dims: dict[str, Column], primary: Column) -> Column:
    """The weighted parts; primary sources aren't measured by lead and corroboration."""
    full = sum(w * dims[k] for k, w in SOURCE_WEIGHTS.items())
    kept = {k: w for k, w in SOURCE_WEIGHTS.items() if k not in ("lead", "corroborated")}
    total = sum(kept.values())
    return F.when(primary, sum(w / total * dims[k] for k, w in kept.items())).otherwise(full)
