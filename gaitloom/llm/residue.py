"""Template residue, filler, error pages and script notices instead of content (problem 5).

Method. Every text is masked: numbers, codes, addresses and dates become one sign, words of dummy Latin and keys struck at
random another each; case, punctuation, markup and Unicode form go. Phrase rules name the kind a masked text would have;
such texts are suspects and nothing more. The exact hashes of a suspect's masked form and of its clauses are grouped over
all records and sources, and it is residue where widely recurring messages make up most of its words. Only an unfilled
placeholder counts by itself, as it stands inside a text of its own. The rules depend on one text alone, so they are
applied before the grouping instead of after it: the same messages are classified, and only theirs are shuffled.

Kinds: ``placeholder`` (an unfilled slot anywhere in the text), ``filler``, ``error``, ``script``.

Defined results: null and blank texts are no residue; a text in several slots counts in each; slot is the place in
captions from 0, -1 for the description; null record ids take no part; a row delivered twice gives its texts once. Stage
marks such as ``[pause]``, percentages and descriptions that merely mention a script, an error lamp, a page or a number
are no residue, nor is a message that stands only once. Texts are read whole, whatever their length. Extra columns are
ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize, spread
from .assets import dataset_key

#: A message recurs widely from this many texts in this many sources on.
RECURS, SOURCES = 3, 2
#: Share of a suspect's words that widely recurring messages must make up.
COVERED = 0.5
#: Words of dummy Latin are sent to all workers; more than this is an error, not a cut.
MOST_LATIN = 200_000

# ---- fixed values: names of template slots and marks that are no slots ----
_SLOT_WORDS = "action|actor|adjective|adverb|amount|angle|author|body|caption|category|clip|count|date|description|direction|distance|duration|field|file|label|limb|location|mood|motion|name|noun|number|object|person|place|placeholder|prop|side|speed|subject|summary|tag|target|tempo|text|time|title|value|verb|view|word"
_STAGE = "applause|beat|blackout|break|cough|cue|cut|enter|exit|hold|inaudible|laughs?|laughter|music|pause|repeat|reset|rest|sic|silence|stop|turn|unclear|walk"
_MARKS = "tbd tba tbc tktk xxxx lorem".split()

_SLOT = rf"(?!(?:{_STAGE})\b)(?:[a-z]+(?:\.[a-z_]+)*_[a-z_.]+|[a-z]+\.[a-z_]+|(?:your|insert|fill in|enter|add|replace|choose|select|type)\b[^\]\}}>»]{{0,40}}|(?:(?:{_SLOT_WORDS})[ _-]?)+(?:here|ing|s|\d+)?|[a-z]{{3,}}-ing)"
_PLACEHOLDERS = re.compile(
    "|".join(
        (
            r"\{\{",  # {{ subject | default('') }}, also cut off
            r"\{%|%\}|<%|%>",  # template statements
            r"[$#]\{",  # ${actor}, #{tempo}
            r"%\([^)\n]{1,40}\)[sdf]",  # %(tempo)s
            r"(?<![\w%])%[sd]\b|(?<!\w)\$[1-9]\b(?![.,]?\d)",  # %s and $1
            r"\[\[[^\]\n]{0,40}(?:\]\]|$)",  # [[BODY_PART]]
            r"\{\s*\d{0,2}\s*\}",  # {} and {0}
            rf"\{{\s*{_SLOT}\s*\}}",  # {prop_name}
            rf"\[\s*{_SLOT}\s*\]",  # [body_part]
            rf"<\s*{_SLOT}\s*>",  # <verb>
            rf"[«‹]\s*{_SLOT}\s*[»›]",  # «tempo»
            r"<<\s*\?*\s*>>",  # <<?>>
            r"@@[^@\n]{1,40}@@",  # @@action@@
            r"\?{3}[^?\n]{1,40}\?{3}",  # ???NAME???
            rf"(?<![\w])__{_SLOT}__(?![\w])",  # __prop__
            r"(?<![\w])_{4,}(?![\w])",  # ______
            rf"%{_SLOT}%",  # %action%
            rf"\${_SLOT}\$",  # $caption_text$
            rf"\b(?:{'|'.join(_MARKS)})\b|\bx{{5,}}\b",  # marks standing for a missing word
        )
    ),
    re.I,
)
_SIGNS = re.compile(r"[{}\[\]<>%$@«»‹›&]|__|\?\?\?|[xX]{5}")


class Rule(NamedTuple):
    """A phrase rule: ``@`` in the pattern stands for any of the anchors, so no match lacks one; a last * leaves a word open."""

    kind: str
    anchors: tuple[str, ...]
    pattern: str


def _rule(kind: str, anchors: str, pattern: str = r"(?<!\w)@(?!\w)") -> Rule:
    said = tuple(a.strip() for a in anchors.split("|"))
    each = "|".join(re.escape(a).replace(r"\*", r"\w*").replace(r"\ ", " ") for a in sorted(said, key=len, reverse=True))
    return Rule(kind, said, pattern.replace("@", f"(?:{each})"))


_DATA = r"(?:pages?|files?|records?|resources?|urls?|documents?|captions?|caption store|caption sheets?|stores?|servers?|hosts?|databases?|services?|sites?|websites?|web|assets?|contents?|clips?|images?|videos?|media|data|account|entry|index|annotations?|viewer|browser)"
_PAGE = r"(?:seite|datei|adresse|pagina|bestand|page|fichier|ressource|página|archivo|recurso|arquivo|страниц\w*|файл\w*|адрес\w*|url)"
_NOUN = r"(?:actions?|captions?|clips?|descriptions?|entry|fields?|labels?|motions?|texts?|titles?|summary|wording|names?|contents?|copy|notes?)"
_SCRIPT = r"(?:java ?scripts?|ecma ?scripts?|js|scripting|scripts|script support|skripte?|джаваскрипт\w*|скрипт\w*)"
_SCRIPTS = "javascript*|java script*|ecmascript*|ecma script*|js|scripting|scripts|script support|skript*|джаваскрипт*|скрипт*"
_GAP = r"(?: \w+){0,12}? "
#: Phrases of messages, in the languages of the corpus.
RULES = (
    # errors
    _rule("error", "not found|never found|not be found|unavailable|unreachable|missing|does not exist|no longer exists|no longer available|not available|timed out|offline|not responding|not be loaded|not be opened|not be displayed", rf"\b{_DATA}(?: \w+){{0,4}} @(?!\w)"),
    _rule("error", "not found|bad gateway|bad request|forbidden|unauthori*|unavailable|timeout|timed out|expired|denied|exceeded|missing|locked|moved|not allowed|internal|unreachable", r"^(?:\w+ ){0,2}# (?:\w+ ){0,4}@"),
    _rule("error", "bad gateway|bad request|gateway timeout|gateway time out|gateway timed out|internal server error|server error|no such file|too many requests|parse error|syntax error|stack trace|traceback|segmentation fault|core dumped|nullpointer*|null pointer|undefined is not|is not a function|is not defined|keyerror|valueerror|typeerror|unhandled exception|java lang|something went wrong|under maintenance|down for maintenance|locked by another user|unexpected token|unexpected end of|connection reset|connection refused|connection closed|connection lost|service unavailable|contact the administrator|try again later|try again in"),
    _rule("error", "expired|timed out|no longer valid|invalid", r"\b(?:token|session|login|link|certificate|password|request|operation|query|connection)(?: \w+){0,5} @(?!\w)"),
    _rule("error", "denied|exceeded|forbidden|refused|restricted|not permitted", r"\b(?:access|permission|quota|limit|request|requests)(?: \w+){0,5} @(?!\w)"),
    _rule("error", "failed to|could not|couldn t|cannot|can t|unable to", rf"\b@ (?:be )?(?:load|fetch|open|read|parse|connect|retrieve|render|display|process|reach|find|play)\w*(?: (?:the|this|your|a|that|to|requested|caption|motion))* {_DATA}\b"),
    _rule("error", "error*|err|fault|failure|warning|status|http|exception|fehler*|erreur|erro|fout*|ошибка", r"^(?:\w+ )?@ (?:code |status )?#(?: |$)"),
    _rule("error", "nicht gefunden|niet gevonden|introuvable*|no encontrad*|não encontrad*|не найден*|nicht verfügbar|niet beschikbaar|indisponible*|no disponible|indisponível|недоступ*", rf"\b{_PAGE}{_GAP}?@|@{_GAP}?{_PAGE}\b"),
    _rule("error", "interner serverfehler|interner fehler|interne serverfout|interne fout|erreur interne|error interno|erro interno|внутренняя ошибка|zugriff verweigert|toegang geweigerd|accès refusé|acceso denegado|acesso negado|доступ запрещ*"),
    _rule("error", "错误|錯誤|不存在|过期|過期|失效|拒绝|稍后再试|加载失败|请求超时|エラー|見つかりません|拒否", r"(?:服务器|伺服器|页面|頁面|网页|網頁|文件|登录|登錄|会话|链接|访问|权限|内容|请求|请|加载|サーバー?|ページ|アクセス).{0,8}@|@"),
    _rule("error", "找不到", r"@.{0,6}(?:页面|頁面|网页|網頁|文件)"),
    # notices that scripts are needed
    _rule("script", "noscript*|javascript*|java script*|ecmascript*|ecma script*"),
    _rule("script", _SCRIPTS, rf"\b(?:re)?(?:enabl\w+|activ\w+|turn\w*|switch\w*|allow\w*|unblock\w*|block\w*|permit\w*|disabl\w+|requir\w+|needs?|aktivier\w*|einschalt\w*|erlaub\w*|autoris\w+|habilit\w+|ativ\w+|inschakel\w*|включит\w*|разрешит\w*){_GAP}?@|(?<!\w)@{_GAP}?(?:enabl\w+|activ\w+|turned|switched|allowed|block\w*|disabl\w+|requir\w+|needed|aktivier\w*|ingeschakeld|einschalten|erforderlich|nécessaire|necessari\w+|necesari\w+|vereist)\b"),
    _rule("script", "脚本|腳本|スクリプト", r"(?:启用|啟用|开启|開啟|打开|允许|需要).{0,8}@|@.{0,8}(?:启用|未|被|有効|オン|許可)"),
    # filler
    _rule("filler", "todo|to do|fixme|tbd|tba|placeholder|dummy|draft|pending|note to self|stub|wip|sample|example|test|fill me in", r"^@(?!\w)"),
    _rule("filler", "placeholder|dummy|sample|example", rf"(?<!\w)@ {_NOUN}\b"),
    _rule("filler", "to be added|to be announced|to be completed|to be confirmed|to be decided|to be defined|to be described|to be determined|to be done|to be entered|to be filled|to be provided|to be specified|to be supplied|to be written", r"^(?:\w+ ){0,3}@"),
    _rule("filler", "add|ask for|complete|describe|enter|fill in|fill out|insert|paste|provide|put|replace|replace with|supply|type|write", rf"^(?:\w+ ){{0,4}}?@ (?:\w+ ){{0,3}}?{_NOUN}\b"),
    _rule("filler", "goes here|comes here|coming soon|pending|missing|follows|to follow|to come|will follow|not yet|is empty|required", rf"^(?:\w+ ){{0,3}}{_NOUN} (?:\w+ ){{0,2}}?@"),
    _rule("filler", "your|untitled|unnamed|default|new|no|blank|empty", rf"^@ (?:\w+ )?{_NOUN}(?: \w+){{0,2}}(?: #)*$"),
    _rule("filler", "~|≡", r"^(?:@(?: |$))+$|~ ~|^lorem\b|^~"),
    _rule("filler", "einfügen|eingeben|eintragen|ergänzen|folgt|fehlt", r"\b(?:beschreibung|text|titel|wort|bewegung|name)\w*(?: \w+){0,3} @"),
    _rule("filler", "à compléter|à insérer|à venir|à remplir|insérer", r"^(?:\w+ ){0,3}@"),
    _rule("filler", "aquí|pendiente|por completar|inserte|aqui|a completar|insira|hier|volgt|invoegen|вставьте|введите|отсутствует", r"^(?:@ )?(?:\w+ )?(?:texto|descripción|título|descrição|tekst|beschrijving|текст|описание|название)(?: \w+){0,2}(?: @|$)"),
    _rule("filler", "填写|填寫|输入|輸入|插入|补充|補充|填入|添加|待定|完善|入力|記入|挿入|準備中|未入力", r"(?:此处|这里|在此|此處|這裡|请|待|ここ|説明|本文).{0,8}@|^.{0,6}@.{0,8}$|待定"),
    _rule("filler", "示例|示範|占位|样例|測試|测试|ダミー", r"@(?:文字|文本|内容|标题|字幕|テキスト|文)"),
    # last, as any other rule says more
    _rule("error", "refresh|reload|click|download|subscribe|log in|sign in|go back", rf"\b@(?: \w+){{0,4}} {_DATA}\b"),
)
_COMPILED = tuple(re.compile(r.pattern) for r in RULES)

_TAG = re.compile(r"</?(?!noscript)[a-z][a-z0-9]{0,11}(?:\s[^<>]*)?/?>", re.I)
_MASKED = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\w+|\b\d{1,4}[-/.:]\d{1,2}(?:[-/.:]\d{1,4})?\b|\b0x[0-9a-f]+\b|\b[ev]\d+\b|\d+(?:[.,]\d+)*", re.I)
_STOP = re.compile(r"[()\[\]{}:;!?/|,<>\n。，！？；：、]|\.(?=\s)|(?<=\s)[-–—](?=\s)")
_OTHER = re.compile(r"[^\w#¦]+|_+")
_STRUCK = re.compile(r"(?<!\w)(?:(?:asdf|qwer|zxcv|hjkl)\w*|wasd|([a-z])\1{2,}|blah?)(?!\w)")
_LEAD = re.compile(r"(?:todo|to do|fixme|tbd|tba|placeholder|dummy|draft|pending|note to self|stub|wip|(?:you|visitors?|users?)(?: must| should)?|kindly|please) ")
_LINK = re.compile(r" ?[#¦](?: ?[#¦])* ?| (?:and|or|to(?! be)|before|(?<!ask )for|(?<!fill )in|when|once|at|by|must|should|please|later|here|und|et|y|en|и)(?: |$)")
_FUNCTION = frozenset("a an and at by for from in into is of on or that the then to under while with".split())


def opened(text: str) -> str:
    """Compatibility form with entities read."""
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def _whole_repeats(words: list[str]) -> bool:
    """Whether a few words are said again and again and nothing else is."""
    return len(words) > 2 and any(len(words) % n == 0 and len(words) >= 2 * n and words == words[:n] * (len(words) // n) for n in (1, 2, 3))


def masked(text: str, latin: frozenset[str] = frozenset()) -> str:
    """Lower-case words of an opened text without markup.

    # stands for a number, code, address or date, ~ for dummy Latin, ≡ for struck keys, ¦ where a sentence mark stood.
    """
    if "<" in text:
        text = _TAG.sub(" ", text)
    said = _MASKED.sub("#", text.casefold().replace("#", " ").replace("¦", " "))
    said = _OTHER.sub(" ", _STOP.sub(" ¦ ", said)).strip(" ¦")
    words = [w for w in said.split(" ") if w != "¦"]
    if len(set(words)) <= 3 and _whole_repeats(words):
        return "≡"
    if len(words) == 1 and len(said) > 3 and len(said) % 2 == 0 and said[: len(said) // 2] * 2 == said:
        return "≡"
    said = _STRUCK.sub("≡", said)
    if latin and sum(w in latin for w in words) * 2 > len(words):
        said = re.sub(r"~(?: ~)+", "~", " ".join("~" if w in latin else w for w in said.split(" ")))
    return said


def plain_form(said: str) -> str:
    return " ".join(w for w in said.split(" ") if w != "¦") if "¦" in said else said


def clauses(said: str) -> list[str]:
    """A masked text cut at sentence marks, numbers, linking words and after what leads a message."""
    lead = _LEAD.match(said)
    parts = [lead[0].strip(), said[lead.end() :]] if lead else [said]
    return [c for p in parts for c in _LINK.split(p) if c]


def _unspaced(text: str) -> bool:
    """Whether a text is in a script without blanks between words."""
    return any("\u3040" <= c <= "\u9fff" for c in text)


def anchor_key(anchor: str) -> str:
    """How an anchor stands in a text with a blank at either end: at a word's start, and at its end unless it has a *."""
    if _unspaced(anchor):
        return anchor
    return " " + anchor[:-1] if anchor.endswith("*") else f" {anchor} "


_SIGN_RULE = next(k for k, r in enumerate(RULES) if "~" in r.anchors)
_SLOT_MARK = -1


class Judge:
    """Kind of a text by the rules ("" for none), whether it holds an open slot, and its masked form.

    Anchors are sought in one pass over the whole text; only the rules of those that occur are tried.
    """

    def __init__(self, latin: frozenset[str] = frozenset()):
        self.latin = latin
        rules_of: dict[str, set[int]] = {f" {word} ": set() for word in latin}
        for mark in _MARKS:
            rules_of[f" {mark} "] = {_SLOT_MARK}
        for k, rule in enumerate(RULES):
            for anchor in rule.anchors:
                rules_of.setdefault(anchor_key(anchor), set()).add(k)
        self.anchors = ahocorasick.Automaton()
        for key, rules in rules_of.items():
            self.anchors.add_word(key, tuple(sorted(rules)))
        self.anchors.make_automaton()

    def __call__(self, text: str) -> tuple[str, bool, str]:
        plain = opened(text)
        low = " " + _OTHER.sub(" ", (_TAG.sub(" ", plain) if "<" in plain else plain).casefold().replace("#", " ").replace("¦", " ")).strip() + " "
        hits = [rules for _, rules in self.anchors.iter(low)]
        slot = (_SIGNS.search(plain) is not None or any(_SLOT_MARK in r for r in hits)) and _PLACEHOLDERS.search(plain) is not None
        if not (hits or slot or _STRUCK.search(low) or len(set(low.split())) <= 3):
            return "", False, ""
        said = masked(plain, self.latin)
        tried = sorted({k for r in hits for k in r} - {_SLOT_MARK} | ({_SIGN_RULE} if "~" in said or "≡" in said else set()))
        parts, whole = clauses(said), plain_form(said)
        for k in tried:
            if _COMPILED[k].search(whole) or any(map(_COMPILED[k].search, parts)):
                return RULES[k].kind, slot, said
        return "", slot, said


def latin_words(motion_index: DataFrame, *, recurs: int = RECURS) -> frozenset[str]:
    """Words of the texts that begin with the usual dummy Latin and hold no function word."""
    text = F.explode(F.concat(F.coalesce("captions", F.array().cast("array<string>")), F.array("description"))).alias("text")
    rows = motion_index.select(text).where(F.col("text").rlike(r"(?i)^\W*lorem\W+ipsum")).select(F.split(F.lower("text"), r"[^\p{L}]+").alias("words"))
    rows = rows.where(~F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(_FUNCTION)])))
    words = rows.select(F.explode("words").alias("w")).where("length(w) > 3").groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= recurs).limit(MOST_LATIN + 1).collect()
    if len(words) > MOST_LATIN:
        raise ValueError(f"more than {MOST_LATIN} words of dummy Latin")
    return frozenset(r.w for r in words) | {"lorem", "ipsum"}


_OUT = "record_id bigint, slot int, kind string, open boolean, source string, messages array<bigint>, words array<int>"


def _hash(said: str) -> int:
    return xxhash.xxh3_64_intdigest(said.encode("utf-8", "surrogatepass")) - (1 << 63)


def suspects(motion_index: DataFrame) -> DataFrame:
    """Texts with an open slot or a phrase of a message: ``(record_id, slot, kind, open, source, messages, words)``.

    ``messages`` are the hashes of the masked text and, where it has several, of its clauses; ``words`` their lengths.
    """
    shared = motion_index.sparkSession.sparkContext.broadcast(latin_words(motion_index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            out: list[tuple] = []
            for record, captions, description, source in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for slot, text in (*enumerate(captions or ()), (-1, description)):
                    if text:
                        kind, open_, said = judge(text)
                        if kind or open_:
                            parts = clauses(said)
                            whole = plain_form(said)
                            units = [whole, *parts] if parts != [whole] else [whole]
                            out.append((record, slot, kind or "placeholder", open_, source, [_hash(u) for u in units], [1 + u.count(" ") for u in units]))
            columns = list(zip(*out)) or [[]] * 7
            types = (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["record_id", "slot", "kind", "open", "source", "messages", "words"])

    read = motion_index.where(F.col("record_id").isNotNull()).select("record_id", "captions", "description", F.coalesce(dataset_key(), F.lit("?")).alias("source"))
    return spread(read).mapInArrow(run, _OUT)


def wide_messages(found: DataFrame, *, recurs: int = RECURS, sources: int = SOURCES) -> DataFrame:
    """``(message)``: hashes that stand in enough texts of enough sources.

    Counts per source come first, combined on the map side: the sources of a message are then few rows, however often
    it recurs.
    """
    each = found.select("source", F.explode(F.array_distinct("messages")).alias("message")).groupBy("message", "source").agg(F.count("*").alias("n"))
    return each.groupBy("message").agg(F.sum("n").alias("n"), F.count("*").alias("k")).where((F.col("n") >= recurs) & (F.col("k") >= sources)).select("message")


def residue(motion_index: DataFrame, *, recurs: int = RECURS, sources: int = SOURCES, covered: float = COVERED) -> DataFrame:
    """``(record_id, slot, kind)`` of the texts that are residue."""
    found = materialize(suspects(motion_index), "p5-suspects")
    # a written table, so that a message that stands in a third of all suspects can be split by the join
    wide = materialize(wide_messages(found, recurs=recurs, sources=sources), "p5-wide")
    unit = found.where("not open").select("record_id", "slot", "kind", F.posexplode(F.arrays_zip("messages", "words")).alias("place", "u")).select("record_id", "slot", "kind", "place", F.col("u.messages").alias("message"), F.col("u.words").alias("n"))
    known = unit.join(wide.withColumn("wide", F.lit(1)), "message", "left")
    share = known.groupBy("record_id", "slot", "kind").agg(
        F.max(F.when(F.col("place") == 0, F.col("wide"))).alias("whole"),
        F.sum(F.when((F.col("place") > 0) & F.col("wide").isNotNull(), F.col("n"))).alias("said"),
        F.sum(F.when(F.col("place") > 0, F.col("n"))).alias("all"),
    )
    recurring = share.where(F.col("whole").isNotNull() | (F.col("said") >= covered * F.col("all"))).select("record_id", "slot", "kind")
    return found.where("open").select("record_id", "slot", "kind").unionByName(recurring).groupBy("record_id", "slot").agg(F.min("kind").alias("kind"))


def without_residue(motion_index: DataFrame) -> DataFrame:
    """``(record_id, captions, description)`` with residue taken out; records of residue only are excluded.

    Captions keep their order; a description that is residue becomes null. Blank captions stay as they are.
    """
    out = residue(motion_index).groupBy("record_id").agg(F.collect_set("slot").alias("slots"))
    read = motion_index.where(F.col("record_id").isNotNull()).select("record_id", "captions", "description")
    kept = read.join(out, "record_id", "left").select(
        "record_id",
        F.when(F.col("slots").isNull(), F.col("captions")).otherwise(F.expr("filter(captions, (c, k) -> not array_contains(slots, k))")).alias("captions"),
        F.when(F.col("slots").isNull() | ~F.array_contains("slots", -1), F.col("description")).alias("description"),
        F.col("slots").isNotNull().alias("touched"),
    )
    says = F.exists(F.coalesce("captions", F.array().cast("array<string>")), lambda c: F.length(F.trim(c)) > 0) | (F.length(F.trim("description")) > 0)
    return kept.where(~F.col("touched") | F.coalesce(says, F.lit(False))).drop("touched")
