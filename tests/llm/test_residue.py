import random
import re
from re import _parser

import pytest

from textloom.llm.residue import _matchers, line_evidence, residue_evidence


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Dear {{ first_name }}, welcome", "placeholder"), ("带到＜公司名称＞。", "placeholder"), ("[여기에 이름 입력]", "placeholder"),
        ("ask %(price)s now", "placeholder"), ("recorded __CITY__ entries", "placeholder"), ("<?php echo $date; ?>", "placeholder"),
        ("Please enable JavaScript to view the page.", "script"), ("使用本站需要开启脚本功能。", "script"), ("자바스크립트를 켜 주세요", "script"),
        ("404 Not Found", "error"), ("Traceback (most recent call last): File", "error"), ("会话已过期，请重新登录", "error"),
        ("お探しのページは見つかりませんでした。", "error"), ("Lorem ipsum dolor sit amet, consectetur", "filler"), ("內容待補充。", "filler"),
        ("Ｅｒrоr establishing a database connection", "error"), ("Loading...", "notice"), ("新しい$order_id$を病院まで", "placeholder"), ("提交至__DATE__，内洛皮", "placeholder"),
        ("{{ " + "customer.address.line_one | default_value " * 4 + "}}", "placeholder"), ("요청하신 페이지 /" + "a" * 60 + " 를 찾을 수 없습니다", "error"),
    ],
)
def test_evidence(text, kind):
    assert line_evidence(text) == kind


@pytest.mark.parametrize(
    "text",
    [
        "The manual explains that `{{name}}` is replaced by the reader's name.", "手冊說明，「{{name}}」會換成收件人的姓名。",
        "In that language, writing \"${total}\" inserts the sum.", "Quikoko taught JavaScript to 5 students and required every one to enable logging.",
        "When the cable answered with status 404, Dendro asked the team to restore 12 pages.", "<p>A plain paragraph.</p>&nbsp;",
        "정밀한 위원회가 임시 문장을 교체했고 예시 문장을 읽었다.", "The bridge is under maintenance and the course requires JavaScript knowledge.",
        "The portal returned 404 Not Found, so the clerk phoned.", "他打开脚本文件，目前无法使用那座桥。", "サンプル文章を読んだ。", "A sample text was read aloud.",
        "The set {431, 3, 7} and the bracket [Amendment 3] both appear.", "", "A sentence with [a link](http://a.example/here).",
    ],
)
def test_no_evidence(text):
    assert line_evidence(text) is None


def test_recurrent_lines_are_subtracted_unless_they_are_the_record(spark):
    rows = [(i, "Loading...\nA sentence about harbours.", "host") for i in range(6)]
    rows += [(10, "Loading...", "other"), (10, "Loading...", "other"), (11, None, "host"), (12, "", None), (13, "x " * 100_000, None)]
    rows += [(20 + i, "Please enable JavaScript.", "host") for i in range(6)]
    rows += [(30 + i, "Please switch on JavaScript.\nA sentence about harbours.", "host") for i in range(6)]
    rows += [(40, "Please turn on JavaScript.\nA sentence about harbours.", "host"), (40, "Please turn on JavaScript.\nA sentence about harbours.", "host")]
    frame = spark.createDataFrame(rows, "candidate_id long, text string, source_id string").selectExpr("*", "1 as kind", "2 as h", "3 as k")
    got = {r.candidate_id: r.kinds for r in residue_evidence(frame, key="candidate_id", text="text", host="source_id", recurrent=5).collect()}
    assert got == {10: ["notice"], 40: ["script"], **{20 + i: ["script"] for i in range(6)}}
    rare = residue_evidence(frame, key="candidate_id", text="text", host="source_id", recurrent=5, common=0.9)  # on too few of the host's records
    assert {r.candidate_id for r in rare.collect()} >= {*range(6), *range(30, 36)}
    assert residue_evidence(frame.limit(0), key="candidate_id", text="text", host="source_id").count() == 0


def samples(items):
    """Strings of a parsed pattern: every alternative, optional parts left out and taken."""
    out = [""]
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "NOT_LITERAL":
            more = [" "]
        elif name == "IN":
            flat = [(str(a), b) for a, b in value]
            more = [" "] if flat[0][0] == "NEGATE" else [chr(b) if a == "LITERAL" else chr(b[0]) if a == "RANGE" else "0" for a, b in flat]
        elif name == "BRANCH":
            more = [x for branch in value[1] for x in samples(branch)]
        elif name == "SUBPATTERN":
            more = samples(value[3])
        elif name == "MAX_REPEAT":
            more = [x * value[0] for x in samples(value[2])] + (samples(value[2]) if value[0] == 0 else [])
        else:
            assert name in ("AT", "ASSERT", "ASSERT_NOT"), name
            more = [""]
        more = list(dict.fromkeys(more))
        if len(out) * len(more) > 60_000:
            out = random.sample(out, min(len(out), 2000))
        out = [a + b for a in out for b in more]
    return out


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_every_alternative_holds_a_cue(kind):
    random.seed(7)
    cues, kinds = _matchers()
    pattern = kinds[kind][1]
    branches = list(_parser.parse(pattern.pattern, re.VERBOSE))[0][1][1]
    for branch in branches:
        found = [x for x in samples(branch) if pattern.search(x)]
        assert found and [x for x in found if not next(cues.iter(x), None)] == []


@pytest.mark.parametrize("text", ["Site temporarily down", "Page currently overloaded", "The link you have tried was deleted", "访问量大", "瀏覽量多"])
def test_messages_behind_new_cues(text):
    assert line_evidence(text) == "error"
