"""Broken prompt and response pairs: empty, refused, copied, in another language, cut off."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrow import map_batches
from textloom.functions.text import chinese_forms
from textloom.llm.canonical import skeleton

#: A response repeats its prompt if the longest common subsequence covers this share of both.
COPY_LCS = 0.97
#: Shingles of this many characters, and of this many in writing without spaces; a copy contains this share of the prompt's.
SHINGLE, SHORT, COPY_CONTAINMENT = 4, 2, 0.9
#: A sentence follows a refusal template if this share of its shingles stands in it, and a head if it holds this share of the head's.
REFUSAL_CONTAINMENT, HEAD_CONTAINMENT = 0.6, 0.85
#: A response that follows the sound answer so closely is a rendering of it, whatever it says.
RENDERING_LCS = 0.6
#: A response is cut off if it follows the sound answer this closely but ends before this share of it.
FOLLOWS_LCS, COMPLETE = 0.9, 0.96

# How a task is declined, one template a line.
REFUSALS = """
i'm sorry, but i can't translate this text.
i am sorry, but i cannot translate this sentence.
i cannot provide a translation for this item.
i'm unable to provide a translation of this content.
as an ai language model, i am unable to help with that request.
as an ai, i can't assist with this request.
sorry, i won't be able to assist with that.
i can't help with that. i cannot fulfill this request.
unfortunately this content can't be processed; please rephrase it.
i must decline to translate this. i'm not able to do that.
申し訳ありませんが、この文章は翻訳できません。
申し訳ございませんが、ご要望にはお応えできません。
そのご依頼にはお応えできません。
ご依頼の翻訳は提供できかねます。
aiのため、その内容は処理できません。
aiとして、そのような内容にはお答えできません。
この内容はお手伝いできません。
죄송하지만 이 문장은 번역할 수 없습니다.
죄송합니다만 해당 요청은 처리할 수 없습니다.
그 요청은 도와드릴 수 없습니다.
항목의 번역은 제공하기 어렵습니다.
ai로서 해당 내용은 처리할 수 없습니다.
抱歉，我无法翻译这段文字。
对不起，我不能协助处理该请求。
很遗憾，无法提供该项的译文。
作为人工智能，我不便处理这类内容。
作为一个语言模型，我无法完成这个请求。
抱歉，我無法翻譯這段文字。
對不起，我不能協助處理該請求。
很遺憾，無法提供該項的譯文。
作為人工智慧，我不便處理這類內容。
作為一個語言模型，我無法完成這個請求。
""".strip().splitlines()
# Heads of refusals, one a line; what is declined may follow, or stand before, in any words.
HEADS = """
i refuse to
i must refuse
i would rather not
i'd rather not
i decline to
i must decline
i have to decline
i am not comfortable
i'm not comfortable
i do not feel comfortable
i am not allowed to
i'm not allowed to
i'm afraid i cannot
i'm afraid i can't
is against my guidelines
is against my policy
goes against my guidelines
violates my guidelines
my guidelines do not allow
i will not be translating
お断りします
お断りいたします
お断りさせていただきます
お断りせざるを得ません
応じられません
応じかねます
お応えいたしかねます
対応いたしかねます
ガイドラインに反します
ガイドラインに違反します
方針に反します
差し控えさせていただきます
ご遠慮させていただきます
거절하겠습니다
거부하겠습니다
거절합니다
거부합니다
응할 수 없습니다
응해 드릴 수 없습니다
지침에 어긋납니다
지침에 위배됩니다
정책에 위배됩니다
번역하지 않겠습니다
我拒绝翻译
我拒绝这样做
我拒绝执行
恕我不能
恕我无法
恕难从命
违反了我的准则
违反我的准则
不符合我的准则
我不愿意翻译
我拒絕翻譯
我拒絕這樣做
我拒絕執行
恕我無法
恕難從命
違反了我的準則
違反我的準則
不符合我的準則
我不願意翻譯
""".strip().splitlines()
# Words that can only speak of the task itself.
TASK = re.compile(
    r"(?:can't|cannot|can not|unable to|won't be able to|not able to|decline to|must refuse to) (?:\w+ ){0,3}?(?:translat\w+|process this|fulfil\w* (?:this|that|your) request|(?:help|assist) (?:you )?with (?:this|that|your) request)"
    r"|as an? (?:ai|artificial intelligence|(?:large )?language model)\b|content can't be processed"
    r"|翻訳(?:できません|は(?:提供)?できかね|をお断り|いたしかね)|ご(?:依頼|要望|リクエスト)に(?:は)?お(?:応え|答え)できません|ai(?:のため|として|なので)|言語モデル(?:として|なので)"
    r"|번역(?:할 수 없|은 제공하기 어렵|을 제공할 수 없|을 거절)|(?:그|해당|이) 요청은 (?:도와드릴|처리할) 수 없|ai(?:로서|이므로|라서)|언어 모델(?:로서|이므로|이라)"
    r"|(?:无法|不能|無法)(?:为您|為您)?(?:提供[^。]{0,12}(?:译文|翻译|譯文|翻譯)|翻译|翻譯)|(?:协助|協助|处理|處理|完成|满足|滿足)(?:处理|處理)?(?:该|這個|这个|您的|此|該)(?:项)?(?:请求|請求|要求)|(?:作为|作為)(?:一个|一個)?(?:人工智能|人工智慧|语言模型|語言模型|ai)"
)
# Words that decline something; a source may use them too.
DECLINE = re.compile(
    r"sorry|unfortunately|refus|rather not|not comfortable|not allowed|guideline|policy|afraid|cannot|can't|can not|unable to|won't be able|not able to|decline|申し訳|できません|できかね|いたしかね|お断り|죄송|수 없습니다|수 없어|어렵습니다|유감|応じ|反します|ガイドライン|控え|遠慮|거절|거부|응할|지침|정책|않겠|拒绝|拒絕|恕|违反|違反|准则|準則|不愿|不願|抱歉|对不起|對不起|很遗憾|很遺憾|无法|無法|不能|不便"
)
# Labels that stand before an answer.
LABEL = re.compile(
    r"^[\s\"'“「*#>\-]*(?:(?:(?:here(?:'s| is)|sure|certainly|below is)[^:：\n]{0,40})?(?:translat\w*|translated text|answer|output|result|response|rendering|english|japanese|korean|chinese(?: \([a-z ]+\))?)[^:：\n]{0,30}"
    r"|(?:译文|譯文|翻译|翻譯|译|譯|答案|回答|输出|輸出|结果|結果|訳文|翻訳(?:文|結果)?|和訳|訳|答え|出力|번역(?:문|본|결과)?|답변?|출력|결과)(?:如下|结果|結果)?)\s*[:：]\s*",
    re.IGNORECASE,
)
_SENTENCE = re.compile(r"[^.!?。！？;\n]+[.!?。！？;]*")
_CLOSED = re.compile(r"[.!?。！？…:：;\"'”’」』）)\]】]\s*$")


@lru_cache(maxsize=1)
def _varieties() -> tuple[frozenset[str], frozenset[str]]:
    """Han characters of the simplified and of the traditional form only."""
    return tuple(map(frozenset, chinese_forms()))


def letters(text: str) -> str:
    """Letters and digits of a text in comparison form."""
    return "".join(c for c in skeleton(text).lower() if c.isalnum())


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the bit-parallel method."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & masks.get(c, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def _shingles(text: str, size: int = SHINGLE) -> set[str]:
    return {text[i : i + size] for i in range(max(1, len(text) - size + 1))}


def _plain(text: str) -> str:
    return "".join(c for c in text if c.isalpha())


def _sized(text: str) -> int:
    return SHINGLE if text.isascii() else SHORT


@lru_cache(maxsize=1)
def _templates() -> tuple[dict[str, list[int]], dict[str, list[int]], list[int]]:
    """Which templates and which heads hold a shingle, and how many shingles a head has."""
    whole: dict[str, list[int]] = {}
    for i, template in enumerate(REFUSALS):
        for x in _shingles(_plain(template)):
            whole.setdefault(x, []).append(i)
    heads: dict[str, list[int]] = {}
    sizes = []
    for i, head in enumerate(HEADS):
        mine = _shingles(_plain(head), _sized(_plain(head)))
        sizes.append(len(mine))
        for x in mine:
            heads.setdefault(x, []).append(i)
    return whole, heads, sizes


def _aligned(sentence: str) -> str | None:
    """``template`` if most of a sentence's shingles stand in one refusal template, ``head`` if it holds the head of a refusal."""
    whole, heads, sizes = _templates()
    hits = Counter(i for x in _shingles(sentence) for i in whole.get(x, ()))
    have = max(1, len(sentence) - SHINGLE + 1)
    if have >= 3 and hits and max(hits.values()) >= REFUSAL_CONTAINMENT * len(_shingles(sentence)):
        return "template"
    for size in (SHINGLE, SHORT):
        hits = Counter(i for x in _shingles(sentence, size) for i in heads.get(x, ()))
        if any(n >= HEAD_CONTAINMENT * sizes[i] and _plain_head(i, size) for i, n in hits.items()):
            return "head"
    return None


@lru_cache(maxsize=1024)
def _plain_head(i: int, size: int) -> bool:
    return _sized(_plain(HEADS[i])) == size


def refuses(answer: str) -> str | None:
    """How an answer declines: ``template`` or ``head`` if a sentence aligns with one, ``task`` if it names the task in so many words.

    Sentences are aligned with the templates and heads by shingle containment first; only what aligns with none is asked
    for the words that can speak of nothing but the task.
    """
    low = skeleton(answer).lower().replace("’", "'")
    found = {_aligned(plain) for sentence in _SENTENCE.findall(low) if (plain := _plain(sentence))}
    if TASK.search(low):
        return "task"
    return "template" if "template" in found else "head" if "head" in found else None


def written_in(text: str, language: str) -> bool:
    """Whether the script of a text fits a language tag; a text without any script fits every tag."""
    kana = hangul = han = latin = other = simplified = traditional = 0
    mainland, island = _varieties()
    for c in text:
        code = ord(c)
        if 0x3041 <= code <= 0x30FF and c != "・":
            kana += 1
        elif 0xAC00 <= code <= 0xD7A3 or 0x1100 <= code <= 0x11FF or 0x3130 <= code <= 0x318F:
            hangul += 1
        elif 0x3400 <= code <= 0x9FFF or 0x20000 <= code <= 0x3FFFF:
            han += 1
            simplified += c in mainland
            traditional += c in island
        elif c.isalpha():
            latin += code < 0x250 or 0x1E00 <= code <= 0x1EFF
            other += not (code < 0x250 or 0x1E00 <= code <= 0x1EFF)
    total = kana + hangul + han + latin + other
    if not total:
        return True
    if language == "eng_Latn":
        return 2 * latin >= total
    if language == "kor_Hang":
        return 2 * hangul >= total - latin and hangul * 3 >= latin
    if language == "jpn_Jpan":
        return kana * 10 >= kana + han and hangul * 4 < total and (kana + han) * 3 >= latin
    if language in ("zho_Hans", "zho_Hant"):
        if han * 3 < latin or kana * 10 > kana + han or hangul * 4 >= total:
            return False
        own, foreign = (simplified, traditional) if language == "zho_Hans" else (traditional, simplified)
        return own >= foreign
    return True


def _agrees(source: str, source_language: str, target_language: str) -> bool:
    """Whether a source reads the same in the target's written form of Chinese."""
    if {source_language, target_language} != {"zho_Hans", "zho_Hant"}:
        return False
    mainland, island = _varieties()
    return not any(c in (mainland if source_language == "zho_Hans" else island) for c in source)


def defect(source: str | None, answer: str | None, source_language: str, target_language: str, sound: str | None) -> str | None:
    """The first defect that applies: empty, refusal, source_copy, wrong_language, truncated; None if there is none.

    ``sound`` is an answer known to be sound; without one, renderings and ends are judged by the source alone.
    """
    if answer is None or not (a := letters(answer)):
        return "empty"
    s, b = letters(source or ""), letters(sound or "")
    body = LABEL.sub("", skeleton(answer), count=1)
    core = letters(body) or a
    if b and core == b and core != s:
        return None if written_in(body, target_language) or not written_in(sound, target_language) else "wrong_language"
    if kind := refuses(answer):
        declines = bool(DECLINE.search((source or "").lower().replace("’", "'")))
        if kind == "head" and declines:  # a source that declines something may be rendered so
            pass
        elif b and lcs(core, b) < RENDERING_LCS * max(len(core), len(b)) or not b and (kind == "task" or not declines):
            return "refusal"
    if s and b != s and not _agrees(source, source_language, target_language) and (core == s or a == s or _repeats(s, core, b, source_language, target_language)):
        return "source_copy"
    if not written_in(body, target_language) and core != b:
        return "wrong_language"
    if b and len(core) < COMPLETE * len(b):
        if lcs(core, b[: len(core) + 4]) >= FOLLOWS_LCS * len(core):
            return "truncated"
    elif not b and s and _CLOSED.search(source.strip()) and not _CLOSED.search(answer.strip()):
        return "truncated"
    return None


def _repeats(s: str, core: str, b: str, source_language: str, target_language: str) -> bool:
    """Whether an answer holds its prompt nearly whole, with little changed or with anything added to it.

    The answer must contain the prompt's shingles and, in order, its letters. It is no copy if the sound answer holds the
    prompt as well, or if it holds the sound answer besides. The two written forms of Chinese share too much for this.
    """
    if {source_language, target_language} == {"zho_Hans", "zho_Hant"} or sum(c.isalpha() for c in s) < SHINGLE or len(core) < COPY_LCS * len(s):
        return False
    size = _sized(s)
    ours = _shingles(s, size)
    if len(ours & _shingles(core, size)) < COPY_CONTAINMENT * len(ours) or lcs(core, s) < COPY_LCS * len(s):
        return False
    if not b:
        return True
    return len(ours & _shingles(b, size)) < COPY_CONTAINMENT * len(ours) and lcs(core, b) < FOLLOWS_LCS * len(b)


def defects(frame: DataFrame, *, key: str, source: str, answer: str, source_language: str, target_language: str, sound: str) -> DataFrame:
    """One row per distinct record with its ``defect_type``; sound pairs have none and give no row.

    One pass without a shuffle of texts; only the defective rows are reduced by ``key``. A null answer is ``empty``; a
    null source or sound answer only leaves out the checks that need it; redelivered rows count once; an empty table
    gives no rows.
    """

    def judge(batch: pa.RecordBatch) -> dict[str, list]:
        keys, *rest = (c.to_pylist() for c in batch.columns)
        found = [(k, defect(*x)) for k, *x in zip(keys, *rest, strict=True)]
        found = [(k, d) for k, d in found if d]
        return {"k": [k for k, _ in found], "defect_type": [d for _, d in found]}

    kind = frame.schema[key].dataType.simpleString()
    columns = frame.select(F.col(key).alias("k"), F.col(source), F.col(answer), F.col(source_language), F.col(target_language), F.col(sound))
    columns = columns.toDF("k", "s", "a", "sl", "tl", "b")
    return map_batches(columns, judge, f"k {kind}, defect_type string").groupBy(F.col("k").alias(key)).agg(F.min("defect_type").alias("defect_type"))
