import random

import numpy as np
import pytest

from textloom.llm.stuffing import SHARE, autocorrelation, gap_variation, stuffed_share, stuffing

STUFFED = [
    "buy kitchen, free shipping kitchen, buy kitchen, top 10 kitchen, best kitchen, near me kitchen, sale kitchen",
    "价格 食谱 - 便宜 食谱 - 热卖 食谱 - 包邮 食谱 - 批发 食谱 - 厂家 食谱",
    "バルブ; ケーブル バルブ 圧縮機; 圧縮機 バルブ; バルブ ケーブル; ケーブル バルブ 圧縮機; バルブ",
    "#축제 #사전2004 #서버 #예산 #조항 #터빈",
    "Brand: XL, Size: 38, Colour: permit, Tag: filter, Brand: 9, Size: cable, Tag: alarm, SKU: 20",
    "www.a1.example | https://b2.example/x | http://c3.example/?q=z&id=4 | d4.example/filter",
    "[a](http://x.example) / battery » www.y.example / [b](z.example/hut)",
    "請求書 | アラーム 請求書 | 請求書 裁判所 | 裁判所 | アラーム 請求書 | アラーム 請求書 裁判所",
    "valve, harbour crane, festival, library, budget, dictionary, engine, passenger, court, permit",
]
PROSE = [
    "The theatre shop stocks the museum, the kitchen, the ticket, and 936 other goods, and each is checked before it is sold.",
    "关于译者的更多内容见 http://a.example/?q=1 ，塔乔马还说明了可靠的术语表失败156次的原因。",
    "规则LY-5447第30条，学生仅在仓库办事处改订后可持有绘画。规则TY-9298第30条，学生仅在机场办事处分类后可持有图书馆。",
    "Version 46.324 of the library library by Orel limits the quiet library to 324 requests, see ticket FX-3944.",
    "Last spring, the valve copied the valve at the hospital. The valve was old. A valve is a valve.",
    "",
    "   ",
]


@pytest.mark.parametrize("text", STUFFED)
def test_stuffed(text):
    assert stuffed_share(text)[0] > SHARE


def test_even_repetition_is_flagged_and_chance_is_not():
    rng = random.Random(5)
    filler = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(600)]
    even = [t for i in range(12) for t in ("lantern", *filler[12 * i : 12 * i + 11])]
    assert stuffed_share(" ".join(even))[0] > SHARE
    at = sorted(rng.sample(range(132), 12))
    chance = [("lantern" if i in at else filler[i]) for i in range(132)]
    assert stuffed_share(" ".join(chance))[0] < SHARE
    assert gap_variation([[0, 10, 20, 30]]) == 0 and gap_variation([[0, 5]]) == float("inf")
    assert autocorrelation(np.array([1, 2, 3] * 5)) == 1.0 and autocorrelation(np.arange(50)) == 0.0


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert stuffed_share(text)[0] <= 0.2


def test_share_is_of_the_whole_text():
    prose = "The quiet teacher of the northern harbour said that nobody had expected the festival to be moved again. " * 3
    assert 0.1 < stuffed_share(prose + STUFFED[0])[0] < SHARE < stuffed_share(prose + "\n".join(STUFFED[0] for _ in range(8)))[0]


def test_frame(spark):
    rows = [(1, STUFFED[0]), (1, STUFFED[0]), (2, None), (3, ""), (4, PROSE[0] * 500)]
    frame = spark.createDataFrame(rows, "candidate_id long, text string").selectExpr("*", "0.7 as share", "1 as k", "2 as x")
    got = {r.candidate_id: r.share for r in stuffing(frame, key="candidate_id", text="text").collect()}
    assert got.keys() == {1, 2, 3, 4} and got[1] > SHARE and got[2] == got[3] == 0.0 and got[4] < SHARE
    assert stuffing(frame.limit(0), key="candidate_id", text="text").count() == 0
