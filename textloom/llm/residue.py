"""Template residue and error-page text.

Lines are counted by host in normalised form, and those recurrent there - in at least ``recurrent`` records and a share
``common`` of the host's - are its boilerplate: navigation, footers, the notice a host puts on every page. Evidence of an
unfilled placeholder, of filler, of an error message or of a demand to switch on scripts is looked for in the residual,
what is left of a record once its boilerplate lines are subtracted. Where nothing but lines with evidence stands in a
record, they are shown in place of content and are no boilerplate there. Nothing is looked for in a line without
evidence, so only lines with evidence are counted.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrow import map_batches
from textloom.llm.canonical import skeleton
from textloom.session import write_table

# Notices that scripts are required; matched in lower case.
SCRIPTS = r"""
(?:enable|activate|allow|switch\ on|turn\ on|turning\ on|enabling)\ (?:your\ browser'?s?\ )?(?:java\ ?script|scripts?\b|scripting)
|(?:java\ ?script|scripting)\ (?:is\ |must\ be\ |needs\ to\ be\ |has\ to\ be\ |to\ be\ |support\ is\ )*(?:required|disabled|enabled|turned\ on|switched\ on|turned\ off|switched\ off|not\ enabled)
|(?:requires?|needs?)\ (?:java\ ?script|scripts|scripting)(?:\ to\ (?:run|work|function|be\ enabled|display|load|view)|\ (?:to\ be\ )?enabled|\ support|\ in\ your|[.!]?$)
|(?:without|with\ no)\ (?:java\ ?script|scripts|scripting)(?:\ being)?\ (?:enabled|turned\ on|switched\ on|support)
|(?:doesn't|does\ not|don't|do\ not)\ (?:support|allow|run)\ (?:java\ ?script|scripts|scripting)
|(?:java\ ?script|ジャバスクリプト|スクリプト)(?:の実行)?(?:を|が|は)?(?:有効|オン|許可|無効|オフ|必要)
|スクリプト(?:に対応して|を実行でき|をサポートして)|スクリプト(?:の|を)?許可(?:が必要|して)
|(?:java\ ?script|자바\ ?스크립트|스크립트)\ ?(?:를|을|가|이)?\ ?(?:켜|활성화|허용|사용하도록|필요|지원하지|꺼져|비활성)
|(?:启用|啟用|开启|開啟|打开|打開|允许|允許|激活|啟動)(?:您的|浏览器的|瀏覽器的)?\ ?(?:java\ ?script|脚本|腳本|指令碼)(?!文件|檔案|编辑|編輯|语言|語言)
|(?:不支持|不支援|未启用|未啟用|禁用了?|停用了?)\ ?(?:java\ ?script|脚本|腳本|指令碼)|需要\ ?(?:java\ ?script|脚本|腳本|指令碼)\ ?(?:支持|支援|才能|功能)
|(?:java\ ?script|脚本|腳本|指令碼)\ ?(?:功能)?(?:已|被)?(?:禁用|停用|关闭|關閉|才能)
"""
# Error messages shown in place of content.
ERRORS = r"""
(?<!returned\ )(?<!status\ )(?<!with\ )(?<!\ an\ )(?<!\ the\ )(?<!\ a\ )\b[45]\d\d\b[\ :,.\-]{0,3}(?:error[\ :\-]{0,3})?(?:not\ found|forbidden|unauthorized|internal\ server\ error|bad\ gateway|bad\ request|service\ unavailable|gateway\ time-?out|too\ many\ requests|gone\b)
|^\s*(?:internal\ server\ error|bad\ gateway|gateway\ time-?out|page\ not\ found|not\ found\b)
|(?:was|were|is|could)\ not\ (?:be\ )?found\ on\ this\ (?:server|site)
|(?:page|url|file|document|link)\ (?:that\ )?(?:you|we)(?:'re|\ are|\ have|\ were)?\ (?:looking\ for|requested|tried|followed)\b[^.!?]*(?:moved|no\ longer|not\ exist|n't\ exist|not\ be\ found|not\ found|n't\ be\ found|unavailable|deleted)
|access\ denied\b|(?:do\ not|don't)\ have\ (?:permission|access|authori[sz]ation)\ to\ (?:access|view|see|open)
|error\ establishing\ a\ database\ connection|could\ not\ connect\ to\ (?:the\ )?database|database\ connection\ (?:failed|error)
|fatal\ error:|uncaught\ (?:exception|typeerror|error|referenceerror)|parse\ error:\ syntax\ error|syntax\ error,\ unexpected|undefined\ (?:index|variable|offset)
|traceback\ \(most\ recent\ call\ last\)|exception\ in\ thread\ "|stack\ trace:|nullpointerexception|segmentation\ fault
|your\ (?:login\ )?session\ (?:has\ )?(?:expired|timed\ out)|session\ (?:has\ )?(?:expired|timed\ out)[.,;:!]?\ please|please\ (?:sign|log)\ in\ again\b
|(?:site|service|server|page)(?:\ is)?\ (?:temporarily|currently)\ (?:unavailable|down|overloaded)|(?:site|service|server|page)\ is\ (?:currently\ )?under\ maintenance
|^\W*something\ went\ wrong|an?\ (?:unexpected|unknown|internal)\ error\ (?:has\ )?occurred
|お探しのページ|(?:ページ|ファイル|url)[^。]*(?:見つかりません|存在しません|は移動または削除)
|(?:サーバー?|内部|システム)(?:内部)?エラーが?(?:発生|です)|データベース(?:に|への)接続(?:できません|に失敗|エラー)
|アクセスが集中|(?:表示|閲覧|アクセス)する権限がありません|アクセスが拒否|セッションの?(?:有効)?期限が?切れ|セッションが(?:切れ|タイムアウト|失効)|再度ログイン|もう一度ログイン
|(?:現在|ただいま)[^。]{0,20}(?:ご利用いただけません|利用できません|メンテナンス中)
|페이지[^.]*찾을\ 수\ 없|페이지가\ 존재하지\ 않|데이터베이스\ ?(?:에\ )?(?:연결|접속)(?:에)?\ ?(?:오류|실패|할\ 수\ 없)
|(?:접근|열람|액세스)\ ?권한이\ 없|서비스를\ (?:일시적으로|현재)\ 이용할\ 수\ 없|세션이\ (?:만료|종료)|다시\ 로그인|(?:내부\ )?서버\ (?:내부\ )?오류|접속자가\ 많아|점검\ 중입니다
|(?:访问|瀏覽|浏览|查看|请求|請求|查找|尋找|存取)的(?:页面|頁面|网页|網頁|文件|檔案)[^。]*(?:不存在|找不到|已被?删除|已被?刪除|无法|無法)
|(?:页面|頁面|网页|網頁)(?:不存在|未找到|找不到)|找不到(?:该|該|此)?(?:页面|頁面|网页|網頁)
|(?:数据库|資料庫)(?:连接|連線|連接)(?:失败|失敗|错误|錯誤|出错|出錯)|(?:没有|沒有|无|無)(?:权限|權限)(?:访问|瀏覽|浏览|查看|檢視|存取)|拒绝访问|拒絕存取
|(?:会话|會話|工作階段|登录|登入)(?:已|已经|已經)?(?:过期|過期|逾時|超时|失效)|请重新登录|請重新登入
|(?:服务器|伺服器)(?:(?:内部|內部)(?:错误|錯誤)|(?:发生|發生)(?:了)?(?:错误|錯誤)|出错|出錯|繁忙|忙碌)|(?:服务|服務)(?:暂时|暫時)(?:不可用|无法|無法)|系统繁忙|系統忙碌|(?:访问|瀏覽|访问)(?:量|人数|人數)过?(?:大|多)
|(?:网站|網站|页面|頁面|网页|網頁|本站)(?:暂时|暫時|目前)(?:无法|無法)(?:使用|提供服务|提供服務|访问|瀏覽|存取)
"""
# Filler in place of content.
FILLER = r"""
lorem\ ipsum|dolor\ sit\ amet|consectetur\ adipiscing
|(?:dummy|placeholder|filler)\ (?:copy|text|content|paragraph)\b|this\ is\ (?:a\ |some\ )?sample\ (?:copy|text|content|paragraph)
|(?:sample|your|body|main|some|more)\ (?:text|copy|content|description)\ (?:goes|comes|will\ go|will\ appear)\ here
|replace\ this\ (?:paragraph|text|sentence|copy|content)|(?:type|enter|write|put|insert|add)\ your\ (?:own\ )?(?:text|description|content|copy|words|message|title|name)\ here
|(?:content|text|description)\ (?:coming\ soon|to\ be\ (?:added|supplied|written|announced))
|ダミー(?:テキスト|文章|コピー)|サンプル(?:文章|テキスト|文)[0-9]*(?:です|をここ|が入り)|ここに[^。]{0,12}(?:入ります|入る予定|入力して|挿入し)|(?:本文|説明文?|文章|タイトル|テキスト|見出し)を(?:ここに)?入力してください
|(?:더미|샘플|예시)\ ?(?:텍스트|문구)|임시\ ?텍스트|(?:본문|내용|텍스트|문구|설명)이?\ ?들어갈\ (?:자리|곳|예정)|(?:여기에\ )?(?:내용|본문|텍스트|설명|문구)[을를]\ (?:입력|작성)하세요
|(?:内容|內容|正文|文字)(?:待补充|待補充|待填写|待填寫|待完善|即将推出|即將推出)|(?:示例|范例|範例|样例|示範)(?:文本|文字|内容|內容)|(?:占位|佔位)(?:文字|文本|符|内容|內容)|请?請?在?(?:这里|這裡|此处|此處)(?:输入|輸入|填写|填寫)
"""
# Words of the filler everybody knows; common as ordinary words of other languages are left out.
LATIN_FILLER = frozenset(
    "adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt dolor dolore "
    "duis eiusmod elit enim esse est excepteur exercitation fugiat incididunt ipsum irure labore laboris laborum lorem "
    "magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident quis reprehenderit sed sint sit sunt "
    "tempor ullamco velit veniam voluptate do ut et in ad ex ea eu id qui".split()
)
_IDENT = r"[A-Za-z_][\w.\-]*"
_ASCII = r"[A-Za-z0-9_]"
_FIELD = r"(?:名|名称|名稱|氏名|姓名|称号|标题|標題|題名|見出し|日期|日付|日時|内容|內容|価格|价格|價格|金额|金額|住所|地址|电话|電話|数量|數量|番号|编号|編號|城市|公司|会社|企業|商品|产品|產品|部署|部门|部門|이름|성명|제목|날짜|내용|가격|주소|전화|수량|번호|도시|회사명?|상품명?)"
_FILL = r"(?:输入|輸入|插入|填写|填寫|填入|添加|新增|挿入|入力|記入|追加|입력|기입|삽입|작성|추가)"
PLACEHOLDER = re.compile(
    rf"""
    \{{\{{[^{{}}\n]+\}}\}} | \{{%[^\n%]+%\}} | <%[^\n%]+%> | <\?(?:php|=)[^\n?]+\?>
    | [$\#]\{{\s*[\w.\-\[\]]+\s*\}} | \{{\s*(?:{_IDENT}|\d{{1,2}})\s*\}} | @@\s*{_IDENT}\s*@@ | (?<!{_ASCII})__[A-Za-z][A-Za-z0-9_.\-]*__(?!{_ASCII})
    | \[\[\s*{_IDENT}\s*\]\] | <<\s*{_IDENT}\s*>> | %\({_IDENT}\)[sd] | (?<!{_ASCII})(?<!%)%[A-Za-z_][A-Za-z0-9_.\-]*%(?!{_ASCII})(?!%) | (?<!{_ASCII})(?<!\$)\$[A-Za-z_][A-Za-z0-9_.\-]*\$(?!{_ASCII})(?!\$)
    | [\[<(](?:please\s+)?(?:insert|place|enter|type|add|put|your|todo|tbd|tba|fixme)\b[^\[\]<>()\n]*[\])>](?!\()
    | [\[<(][^\[\]<>()\n]{{1,40}}\s+here[\])>](?!\()
    | [\[<【][^\[\]<>\n【】]{{0,24}}{_FILL}[^\[\]<>\n【】]{{0,16}}[\]>】](?!\()
    | \([^()\n]{{0,12}}{_FILL}[^()\n]{{0,8}}\)
    | [\[<【][^\x00-\x7f\[\]<>\n【】]{{0,6}}{_FIELD}[\]>】](?!\()
    """,
    re.VERBOSE | re.IGNORECASE,
)
# Whole lines that are a notice in place of content.
NOTICE = re.compile(
    r"(?:page |file )?not found[.!]*|loading[ .…]*|please wait[ .…]*|coming soon[ .!]*|under construction[.!]*|tbd|n/a|untitled|no title"
    r"|読み込み中[ .…。]*|準備中(?:です)?[。.]*|로딩 ?중[ .…]*|준비 ?중(?:입니다)?[ .]*|加载中[ .…。]*|載入中[ .…。]*|敬请期待[。.]*|敬請期待[。.]*"
)
# Pieces one of which every phrase above holds; texts without any are passed over.
_CUES = (
    "script スクリプト 스크립트 脚本 腳本 指令碼 not found forbidden unauthorized gateway server error bad request service unavailable "
    "エラー 오류 错误 錯誤 出错 出錯"
).split() + [
    "too many requests", "gone", "on this server", "on this site", "looking for", "requested", "tried", "followed", "access denied", "access is denied",
    "have permission", "have access", "have authori", "database", "uncaught", "syntax", "undefined", "traceback", "stack trace", "exception",
    "segmentation", "session", "sign in again", "log in again", "temporarily", "currently", "maintenance",
    "went wrong", "experiencing", "お探し", "見つかりません", "存在しません", "移動または", "データベース", "アクセスが", "権限", "セッション", "再度ログイン", "もう一度ログイン",
    "現在", "ただいま", "찾을 수", "존재하지", "데이터베이스", "권한", "서비스를", "세션이", "다시 로그인", "접속자", "점검 중", "不存在", "未找到", "找不到", "删除", "刪除",
    "无法", "無法", "数据库", "資料庫", "权限", "權限", "拒绝访问", "拒絕存取", "过期", "過期", "逾時", "超时", "失效", "重新登", "繁忙", "忙碌", "不可用", "过大", "过多", "人数", "人數", "访问量", "瀏覽量",
    "ipsum", "dolor sit", "consectetur", "dummy", "placeholder", "filler", "sample", "here", "replace this", "coming soon", "to be added", "to be supplied",
    "to be written", "to be announced", "ダミー", "サンプル", "ここに", "入力してください", "더미", "샘플", "예시", "임시", "들어갈", "하세요", "待补充", "待補充", "待填", "待完善",
    "即将推出", "即將推出", "示例", "范例", "範例", "样例", "示範", "占位", "佔位", "这里", "這裡", "此处", "此處",
]
_QUOTES = re.compile(r"“[^”\n]{1,120}”|„[^“”\n]{1,120}[“”]|「[^」\n]{1,120}」|『[^』\n]{1,120}』|«[^»\n]{1,120}»|‹[^›\n]{1,120}›|《[^》\n]{1,120}》|`[^`\n]{1,120}`|\"[^\"\n]{1,120}\"|(?<!\w)'[^'\n]{1,120}'(?!\w)|(?<!\w)‘[^’\n]{1,120}’(?!\w)")
_LATIN = re.compile(r"[a-z]+")
_MARKUP = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>|&(?:[a-z]+|#\d+);", re.IGNORECASE)


@lru_cache(maxsize=1)
def _matchers():
    import ahocorasick

    cues = ahocorasick.Automaton()
    for cue in _CUES:
        cues.add_word(cue, cue)
    cues.make_automaton()
    kinds = [("script", SCRIPTS), ("error", ERRORS), ("filler", FILLER)]
    return cues, [(name, re.compile(body, re.VERBOSE)) for name, body in kinds]


def _latin_filler(line: str) -> bool:
    """A run of eight words or more, most of them from the well-known filler and at least five of those different."""
    if "ipsum" not in line and "amet" not in line and "consectetur" not in line and "incididunt" not in line and "ullamco" not in line and "adipiscing" not in line:
        return False
    words = _LATIN.findall(line)
    hits = [w for w in words if w in LATIN_FILLER]
    return len(hits) >= 6 and len(set(hits)) >= 5 and len(hits) >= 0.3 * len(words)


def _unquoted(line: str) -> str:
    """The line without what it quotes; a line that is nothing but a quotation stays."""
    bare = _QUOTES.sub(" ", line)
    return bare if sum(c.isalpha() for c in bare) >= 8 else line


def line_evidence(line: str) -> str | None:
    """The kind of residue a line shows: placeholder, script, error, filler, notice - or None."""
    form = _unquoted(skeleton(line))
    if PLACEHOLDER.search(form):
        return "placeholder"
    low = form.lower().replace("’", "'")
    cues, kinds = _matchers()
    if next(cues.iter(low), None):
        for name, pattern in kinds:
            if pattern.search(low):
                return name
        if _latin_filler(low):
            return "filler"
    elif _latin_filler(low):
        return "filler"
    if NOTICE.fullmatch(_MARKUP.sub(" ", low).strip()):
        return "notice"
    return None


_BREAK = re.compile("\r\n|[\n\r\x85\u2028\u2029]")


def normal_line(line: str) -> str:
    """Digest of a line without letter case, with single spaces and one digit in place of any number."""
    return blake2b(re.sub(r"[0-9]+", "0", " ".join(line.lower().split())).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def residue_evidence(frame: DataFrame, *, key: str, text: str, host: str, recurrent: int = 20, common: float = 0.01) -> DataFrame:
    """One row per record that shows residue: ``key`` and the sorted distinct ``kinds`` of its evidence.

    A normalised line beside others is boilerplate of a host if at least ``recurrent`` distinct records of the host, and a share
    ``common`` of them, hold it; whatever evidence it carries, it is subtracted. The texts are scanned once, in one narrow
    pass; only lines with evidence leave it, as digests, so a host that holds a third of all rows adds one small row for
    each of them and never its texts. Records are counted by host with partial counts before the shuffle.
    Null and empty texts give no row. A record delivered twice counts once. An empty table gives no rows. A null host
    is a host of its own.
    """
    rows = frame.select(F.col(key).alias("k"), F.col(text).alias("x"), F.lower(F.trim(F.coalesce(F.col(host), F.lit("")))).alias("h"))

    def scan(batch: pa.RecordBatch) -> dict[str, list]:
        keys, texts, hosts = (c.to_pylist() for c in batch.columns)
        out: dict[str, list] = {"k": [], "h": [], "n": [], "kind": [], "beside": []}
        for k, x, h in zip(keys, texts, hosts, strict=True):
            lines = [line for line in dict.fromkeys(_BREAK.split(x)) if line and not line.isspace()] if x else []
            shown = [(line, kind) for line in lines if (kind := line_evidence(line))]
            for line, kind in shown:
                for name, value in zip(out, (k, h, normal_line(line), kind, len(shown) < len(lines)), strict=True):
                    out[name].append(value)
        return out

    kinds = frame.schema[key].dataType.simpleString()
    found = write_table(map_batches(rows, scan, f"k {kinds}, h string, n string, kind string, beside boolean"), "evidence").frame
    counted = found.groupBy("h", "n").agg(F.count_distinct("k").alias("held")).where(F.col("held") >= recurrent)
    hosts = rows.groupBy("h").agg(F.count_distinct("k").alias("records"))
    boilerplate = counted.join(hosts, "h").where(F.col("held") >= common * F.col("records")).select("h", "n")
    residual = found.where("not beside").unionByName(found.where("beside").join(boilerplate, ["h", "n"], "left_anti"))
    return residual.groupBy(F.col("k").alias(key)).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
