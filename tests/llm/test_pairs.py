import pytest

from textloom.llm.pairs import defect, defects, lcs

S = "The precise student shall be filed with the farm within 620 days, and Nev shall keep the narrow ticket."
B = "精确的学生应当在620日内提交至农场，内维应当保管狭窄的车票。"
SORRY = ("Nev said: I'm sorry, but I cannot bring the ticket to the farm.", "内维说：抱歉，我无法把车票带到农场。")


@pytest.mark.parametrize(
    "source, answer, sound, kind",
    [
        (S, None, B, "empty"), (S, "", B, "empty"), (S, "…。", B, "empty"), (S, "​ ", B, "empty"),
        (S, "抱歉，我无法翻译这段文字。", B, "refusal"), (S, "I'm sorry, but I can't translate this text.", B, "refusal"),
        (S, "Sorry, I won't be able to assist with QX-19.", B, "refusal"), (SORRY[0], "对不起，我不能协助处理该请求。", SORRY[1], "refusal"),
        (S, S.upper() + " !", B, "source_copy"), (S, "译文：" + S.replace("o", "о"), B, "source_copy"),
        (S, "精確的學生應當在620日內提交至農場，內維應當保管狹窄的車票。", B, "wrong_language"),
        (S, "정확한 학생 서류는 620일 이내에 농장에 제출하며", B, "wrong_language"),
        (S, "精确的学生应当在620日内提交", B, "truncated"), (S, "译文：精确的学生应当在620日内提交至农", B, "truncated"),
        (S, B, B, None), (S, "译文：" + B, B, None), (S, B.replace("，", "；").rstrip("。"), B, None), SORRY + (SORRY[1], None),
    ],
)
def test_defects(source, answer, sound, kind):
    assert defect(source, answer, "eng_Latn", "zho_Hans", sound) == kind


@pytest.mark.parametrize("answer", ["I refuse to do this for you.", "Translating such material is against my guidelines.", "I'd rather not translate that one.", "この文章の翻訳はお断りいたします。", "이 요청은 거절하겠습니다.", "我拒绝翻译这样的内容。", "恕我無法完成。"])
def test_refusals_outside_the_templates(answer):
    assert defect(S, answer, "eng_Latn", "zho_Hans", B) == "refusal"
    assert defect(S, answer, "eng_Latn", "zho_Hans", None) == "refusal"
    assert defect("He said: I refuse to do this, that is against my policy.", answer, "eng_Latn", "zho_Hans", answer) in (None, "wrong_language")


def test_copies_with_something_added():
    more = S + " That is all there is to say about the matter at hand."
    assert defect(S, more, "eng_Latn", "eng_Latn", "A sound rendering in other words altogether.") == "source_copy"
    assert defect(S, more, "eng_Latn", "zho_Hans", B) == "source_copy"
    assert defect("The old bridge", "The old bridge!!", "eng_Latn", "kor_Hang", "오래된 다리") == "source_copy"
    assert defect("The old bridge", "The old bridge, then", "eng_Latn", "kor_Hang", "오래된 다리") == "source_copy"
    assert defect(S, S + " " + B, "eng_Latn", "zho_Hans", B) is None or defect(S, S + " " + B, "eng_Latn", "zho_Hans", B) == "wrong_language"  # holds the sound answer
    assert defect("QX-19 7072", "QX-19 7072", "eng_Latn", "zho_Hans", "QX-19 7072") is None


def test_written_forms_of_chinese():
    assert defect("北京大学在山上", "北京大学在山上", "zho_Hans", "zho_Hant", "北京大學在山上") == "source_copy"
    assert defect("山上有人", "山上有人", "zho_Hans", "zho_Hant", "山上有人") is None
    assert defect("车票", "车票", "zho_Hans", "zho_Hant", "車票") == "source_copy"
    assert defect("车票", "車票", "zho_Hans", "zho_Hant", None) is None


def test_without_a_sound_answer():
    assert defect(S, "精确的学生应当在620日内提交", "eng_Latn", "zho_Hans", None) == "truncated"
    assert defect(None, B, "eng_Latn", "zho_Hans", None) is None
    assert defect(SORRY[0], SORRY[1], "eng_Latn", "zho_Hans", None) is None


def test_lcs():
    assert lcs("abcbdab", "bdcaba") == 4 and lcs("", "x") == 0 and lcs("abc", "abc") == 3


def test_frame(spark):
    rows = [("a", S, None, "eng_Latn", "zho_Hans", B), ("a", S, None, "eng_Latn", "zho_Hans", B), ("b", S, B, "eng_Latn", "zho_Hans", B), ("c", None, S * 300, None, None, None)]
    frame = spark.createDataFrame(rows, "id string, s string, a string, sl string, tl string, b string").selectExpr("*", "'x' as defect_type", "1 as k")
    columns = dict(key="id", source="s", answer="a", source_language="sl", target_language="tl", sound="b")
    assert [tuple(r) for r in defects(frame, **columns).collect()] == [("a", "empty")]
    assert defects(frame.limit(0), **columns).count() == 0
