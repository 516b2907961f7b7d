"""Template residue, filler, error pages and script notices in texts (problem 8).

Code and quotations are masked, texts are cut into normalised lines, all lines
are counted by host (``source``), recurrent boilerplate is subtracted, and
records whose residual holds evidence are found. One Arrow pass reads every text
once: it counts the lines (summed per batch before they are shuffled) and looks
for evidence. Anchors of all phrases are searched at once (Aho-Corasick); only
lines that hold one are matched against the phrases and the rules.

Evidence is of two sorts: wordings (fixed phrases and the structure of
placeholders) and rules over concepts. A rule asks for concepts, as "page" and
"not found", in one short sentence, in whichever of the listed languages each is
said. A sentence in which a person speaks of themselves or asks is no evidence.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import cut

#: A line is a host's boilerplate if so many, and such a share, of its documents hold it.
BOILERPLATE_DOCS, BOILERPLATE_SHARE = 20, 0.05

#: A word of a sentence with the classic opening (a seed) is peculiar to seeds if, of the
#: distinct sentences that hold it, seeds are MOCK_LIFT times their share of all sentences
#: or more, or half of them or more.
MOCK_LIFT = 10
#: A sentence is mock Latin if it has so many words, such a share of them mock words.
MOCK_SENTENCE_WORDS, MOCK_SENTENCE_SHARE = 4, 0.75

#: Words that a sentence of the concept rules may have, and letters where words are not spaced.
RULE_WORDS, RULE_LETTERS = 16, 60

_NAME = r"[A-Za-z_][\w.\-]*"
#: A sentence starts at the line's start, after a full stop or mark, or after a gap.
_START = r"(?:^|(?<=[.!?>:~]\s*)|(?<=\s\s))"
_SCRIPT = r"(?:java\s?scripts?|js|scripts?|scripting)"
_ENABLE = r"(?:enable|activate|allow|turn\s+on|switch\s+on)"

# The letter rows of common keyboards.
_ROWS = ("qwertyuiop", "qwertzuiop", "azertyuiop", "asdfghjkl", "qsdfghjklm", "zxcvbnm", "yxcvbnm")


#: Unfilled placeholders; each begins with one of the signs in SIGNS.
SIGNS = r"[{$#<\[&_%@]"
PLACEHOLDER = (
    r"\{\{[^{}]++\}\}",
    r"\{%[^{}%]++%\}",
    r"[$#]\{\s*" + _NAME + r"\s*\}",
    r"<%[=\-]?[^<>%]++%>",
    r"\[\[\s*" + _NAME + r"\s*\]\]",
    r"\[\s*(?:insert|your)\b[^\]\[]++\]",
    r"<\s*/?(?:your|insert)_[\w.]+\s*>",
    r"&lt;\s*" + _NAME + r"\s*&gt;",
    r"___" + _NAME + r"___",
    r"%%" + _NAME + r"%%",
    r"@@" + _NAME + r"@@",
    r"%\(" + _NAME + r"\)[sdif]",
    r"\$[A-Za-z_][\w.]{3,}\$",
    r"(?<![\w$#{\\])\{" + _NAME + r"\}(?!\})",
    # a slot's name in brackets that are no link: [Company Name], [your e-mail address]
    r"(?<![!\]\w])\[(?:\p{L}[\p{L}'’\-]*+\s++){1,5}(?:name|title|address|e-?mail|phone|number|date|time|city|country|company|url|link|description|text|content|image|amount|price|product|subject|signature|position|department)\](?![(\[:])",
)
#: Phrases that count wherever they stand (ANYWHERE) or where a sentence starts (AT_START).
FILLER_ANYWHERE = (
    r"lorem\s+ipsum\b",
    r"dolor\s+sit\s+amet\b",
    r"consectetur\s+adipiscing\b",
    r"your\s+(?:text|content|answer|title|copy)\s+(?:goes\s+)?here\b",
    r"(?:type|enter|write|add|put|insert)\s+(?:your|some|the)?\s*(?:text|answer|question|content|copy|title|something)\s+here\b",
    r"this\s+is\s+(?:a\s+)?(?:placeholder|dummy|sample|filler)\s+(?:copy|text|content)\b",
    # keyboard rows
    r"(?:(?:asdf|qwer|qwert[zy]|zxcv|yxcv|hjkl|jklö|uiop|sdfg|fghj)\s?){2}",
    r"(?:qwert[zy]uiop|azertyuiop|asdfghjk|qsdfghjk|zxcvbnm|yxcvbnm)",
)
FILLER_AT_START = (
    r"(?:todo|tbd|tba|fixme)\s*+[:\-–]\s*+(?:write|add|insert|fill\s+in|put|provide|complete|replace)\s(?:[^.!?\n]*?\s)?(?:description|text|content|copy|body|title|summary|answer|introduction|intro|paragraph)\b",
    r"(?:default|sample|dummy|example|placeholder)\s+(?:body|text|copy|content)\b[^.!?]*?\b(?:edit|replace|goes|change|remove)\b",
    r"(?:beispiel|platzhalter|blind|muster)text\b[^.!?]*?\b(?:ersetzen|ändern|einfügen)\b",
    r"text(?:e|o)\s+(?:provisoire|d.exemple|de\s+ejemplo|de\s+relleno|provisional|di\s+esempio|de\s+exemplo)\b[^.!?]*?\b(?:remplacer|modifier|sustituir|reemplazar|cambiar|sostituire|substituir)",
)
#: A word, or two in turn, again and again; no step of it backtracks.
REPEATED = (
    r"(\p{L}{2,}+)[\s,.;!\-]++\1(?:[\s,.;!\-]++\1){3}(?!\p{L})",
    r"(\p{L}{2,}+\s++\p{L}{2,}+)\s++\2(?:\s++\2){2}(?!\p{L})",
)
ERROR_ANYWHERE = (
    r"the\s+page\s+you\s+(?:asked|requested|are\s+looking|were\s+looking)\b[^.!?]*?\b(?:could\s+not|cannot|can't|does\s+not|was\s+not)\b",
    r"thread\s+may\s+have\s+been\s+(?:moved|deleted)\b",
    r"your\s+(?:ip\s+)?address\s+(?:has\s+been|is|was)\s+blocked\b",
    r"the\s+requested\s+url\s+(?:was\s+(?:rejected|not\s+found)|could\s+not)\b",
    r"your\s+session\s+has\s+(?:expired|timed\s+out)\b",
    r"die\s+(?:angeforderte|gewünschte)\s+seite\s+(?:wurde\s+nicht\s+gefunden|existiert\s+nicht|konnte\s+nicht)",
    r"la\s+page\s+demandée\s+(?:est\s+introuvable|n.existe\s+pas|n.a\s+pas)",
    r"(?:zugriff\s+verweigert|accès\s+refusé|acceso\s+denegado)\b",
)
ERROR_AT_START = (
    r"(?:http\s+)?(?:error|fehler|erreur|código|codigo|errore|erro|code)\s*:?\s*[45]\d\d\b\s*(?:[.:)\-–]|$)",
    r"[45]\d\d\s*[\-–:]\s*(?:the\s+page|page|not\s+found|forbidden|internal|bad|service|gateway|error)",
    r"page\s+(?:not\s+found|cannot\s+be\s+(?:found|displayed))",
    r"(?:internal\s+server\s+error|bad\s+gateway|service\s+(?:temporarily\s+)?unavailable|gateway\s+(?:time-?\s?out|timed\s+out))\b",
    r"the\s+server\s+is\s+(?:temporarily\s+)?unable\s+to\b",
    r"access\s+denied\b",
    r"(?:oops|whoops|sorry)\b[^\p{L}]*+something\s+went\s+wrong\b",
    r"too\s+many\s+requests\b",
    r"(?:could\s+not|cannot|unable\s+to|error)\s+(?:connect|establish|establishing)\b[^.!?]*?\bdatabase\b",
    r"(?:fatal|parse)\s+error:\s",
    r"(?:we\s+are|we're|the\s+site\s+is|this\s+site\s+is)\s+(?:currently\s+)?down\s+for\s+maintenance\b",
    r"checking\s+your\s+browser\b",
    r"error\s+code\s*:?\s*\d{3}\s*(?:[.:)\-–]|$)",
    r"interner\s+(?:server)?\s*-?fehler\b",
    r"(?:page\s+introuvable|seite\s+nicht\s+gefunden|página\s+no\s+encontrada|pagina\s+non\s+trovata|página\s+não\s+encontrada)",
)
NOTICE_ANYWHERE = (
    r"noscript\b",
    r"(?:this|the)\s+(?:forum|site|page|app|website|application)\s+(?:needs|requires)\s+" + _SCRIPT + r"\b",
    r"your\s+browser\s+does\s+not\s+support\s+" + _SCRIPT + r"\b",
    r"cookies\s+and\s+" + _SCRIPT + r"\s+are\s+required\b",
    _ENABLE + r"\s+(?:it|" + _SCRIPT + r")\s+in\s+your\s+browser\b",
)
NOTICE_AT_START = (
    r"(?:please|you\s+(?:need|have)\s+to|you\s+must)\s+" + _ENABLE + r"\s+" + _SCRIPT + r"\b",
    _SCRIPT + r"\s+(?:is|are)\s+(?:disabled|required|switched\s+off|turned\s+off)\b",
    r"if\s+nothing\s+happens,?\s+" + _ENABLE + r"\b",
    r"loading\s*(?:\.\.\.|…)",
    r"bitte\s+(?:aktivieren|erlauben)\s+sie\s+" + _SCRIPT + r"\b",
    r"(?:veuillez|merci\s+d.)\s*(?:activer|autoriser)\s+" + _SCRIPT + r"\b",
    r"(?:por\s+favor,?\s+)?(?:active|habilite|activa|permita)\s+" + _SCRIPT + r"\s+para\b",
    r"(?:attivare|abilita(?:re)?|ative|habilite)\s+" + _SCRIPT + r"\s+p(?:er|ara)\b",
)
#: kind: (placeholders, phrases anywhere, phrases at a sentence's start)
KINDS = {
    "placeholder": (PLACEHOLDER, (), ()),
    "filler": ((), FILLER_ANYWHERE, FILLER_AT_START),
    "error_page": ((), ERROR_ANYWHERE, ERROR_AT_START),
    "script_notice": ((), NOTICE_ANYWHERE, NOTICE_AT_START),
}

def _joined(firsts: str, seconds: str, between: tuple[str, ...] = (" ",)) -> list[str]:
    return [f + g + x for f in firsts.split("|") for g in between for x in seconds.split("|")]


_TURN_ON = "enable|activate|allow|turn on|switch on|active|activa|habilite|permita|attivare|abilita|abilitare|ative|aktivieren sie|erlauben sie|activer|autoriser|needs|requires"
#: Wordings without one of which no phrase of the kind can match, in lower case with single spaces.
ANCHORS = {
    "placeholder": ["{", "$", "[", "<", "&lt;", "___", "%%", "@@", "%("],
    "filler": [
        "lorem ipsum", "dolor sit amet", "consectetur adipiscing", *_joined("text|content|answer|title|copy|goes|something|question", "here"), *_joined("default|sample|dummy|example|placeholder|filler", "body|text|copy|content"),
        "beispieltext", "platzhaltertext", "blindtext", "mustertext", "provisoire", "exemple", "ejemplo", "relleno", "provisional", "esempio", "exemplo",
        "asdf", "qwer", "azer", "qsdf", "zxcv", "yxcv", "hjkl", "jklö", "uiop", "sdfg", "fghj", "todo", "tbd", "tba", "fixme",
    ],
    "error_page": [
        "the page you", "may have been", *_joined("address", "has been|is blocked|was blocked"), "requested url", "session has", *_joined("seite", "wurde nicht|existiert nicht|konnte nicht|nicht gefunden"), "page demandée",
        "zugriff verweigert", "accès refusé", "acceso denegado", *_joined("error|fehler|erreur|código|codigo|errore|erro|code", "4|5", ("", " ", ":", ": ", " :", " : ")),
        *[f"{x}{y}{z}{w}" for x in ("", " ") for y in "-–:" for z in ("", " ") for w in ("the page", "page", "not found", "forbidden", "internal", "bad", "service", "gateway", "error")],
        *_joined("page", "not found|cannot be|introuvable"), "internal server error", "bad gateway", "service unavailable", "service temporarily", "gateway time", "the server is", "access denied", "something went wrong", "too many requests", "database",
        "fatal error:", "parse error:", "down for maintenance", "checking your browser", "interner", "página no", "pagina non", "página não", "error code",
    ],
    "script_notice": [
        "noscript", *_joined(_TURN_ON, "j|s|it"), "not support", "cookies and", "in your browser", *_joined("script|scripts|scripting|js", "is|are"), "nothing happens", "loading.", "loading…", "loading …", "loading .", "merci d",
    ],
}

# How the concepts of the rules are said, by concept; beginnings of words.
CONCEPTS = {
    "page": (
        "page", "site", "website", "url", "document", "seite", "webseite", "dokument", "página", "sitio", "pagina", "sito", "sida", "sidan", "siden", "sivu", "strona", "strony", "stránka", "stránku", "страниц", "сайт",
        "sayfa", "oldal", "σελίδα", "trang", "halaman", "ページ", "サイト", "页面", "網頁", "网页", "网站", "페이지", "사이트", "الصفحة", "הדף", "पृष्ठ", "сторінк",
    ),
    "not_found": (
        "not found", "cannot be found", "could not be found", "can't be found", "does not exist", "doesn't exist", "no longer exists", "no longer available", "nicht gefunden", "existiert nicht", "nicht vorhanden", "introuvable",
        "n'existe pas", "n’existe pas", "no encontrad", "no se encontró", "no se ha encontrado", "no existe", "non trovat", "non esiste", "não encontrad", "não existe", "niet gevonden", "bestaat niet", "nie znalezion", "nie istnieje",
        "не найден", "не существует", "не знайден", "hittades inte", "finns inte", "kunde inte hittas", "ikke fundet", "ikke funnet", "findes ikke", "finnes ikke", "ei löydy", "ei löytynyt", "bulunamadı", "nenalezen", "neexistuje",
        "nem található", "δεν βρέθηκε", "không tìm thấy", "tidak ditemukan", "見つかりません", "存在しません", "未找到", "不存在", "找不到", "찾을 수 없", "غير موجود", "לא נמצא", "नहीं मिला",
    ),
    "fault": (
        "internal server error", "server error", "serverfehler", "interner fehler", "erreur interne", "erreur du serveur", "error interno", "error del servidor", "errore interno", "errore del server", "erro interno", "erro do servidor", "interne serverfout",
        "serverfout", "interne fout", "błąd serwera", "wewnętrzny błąd", "ошибка сервера", "внутренняя ошибка", "помилка сервера", "serverfel", "internt fel", "serverfejl", "intern feil", "palvelinvirhe", "sunucu hatası", "chyba serveru", "kiszolgálóhiba",
        "サーバーエラー", "サーバエラー", "服务器错误", "伺服器錯誤", "서버 오류", "something went wrong", "etwas ist schiefgelaufen", "une erreur s'est produite", "une erreur est survenue", "se ha producido un error", "si è verificato un errore", "ocorreu um erro",
        "er is een fout opgetreden", "er ging iets mis", "wystąpił błąd", "coś poszło nie tak", "произошла ошибка", "что-то пошло не так", "ett fel har inträffat", "något gick fel", "der opstod en fejl", "bir hata oluştu", "došlo k chybě", "エラーが発生しました", "发生错误", "出错了", "오류가 발생",
    ),
    "denied": (
        "access denied", "access to this page is forbidden", "zugriff verweigert", "accès refusé", "accès interdit", "acceso denegado", "acceso prohibido", "accesso negato", "acesso negado", "toegang geweigerd", "geen toegang", "odmowa dostępu", "brak dostępu", "доступ запрещ", "доступ заборонен",
        "åtkomst nekad", "adgang nægtet", "ingen tilgang", "pääsy evätty", "pääsy estetty", "erişim engellendi", "přístup odepřen", "hozzáférés megtagadva", "アクセスが拒否", "アクセス拒否", "拒绝访问", "访问被拒绝", "拒絕存取", "액세스 거부", "접근이 거부",
    ),
    "timed_out": (
        "connection timed out", "connection refused", "connection reset", "request timed out", "gateway timeout", "gateway time-out", "zeitüberschreitung", "délai d'attente dépassé", "tiempo de espera agotado", "tempo de conexão esgotado", "time-out van de verbinding", "przekroczono limit czasu", "время ожидания истекло", "превышено время ожидания",
        "接続がタイムアウト", "连接超时", "連線逾時", "연결 시간이 초과",
    ),
    "script": ("javascript", "java script", "java-script", "jscript", "スクリプト", "скрипт", "脚本", "腳本", "자바스크립트"),
    "enable": (
        "enable", "activate", "turn on", "turned on", "turn it on", "switch on", "switched on", "allow", "required", "requires", "disabled", "deactivated", "turned off", "switched off", "must be on", "not supported", "does not support", "without", "aktivier", "einschalt", "eingeschaltet", "zulassen", "benötigt", "erforderlich", "deaktiviert", "ausgeschaltet",
        "activer", "activez", "désactivé", "requis", "nécessite", "nécessaire", "autoris", "habilit", "activ", "necesita", "requiere", "desactivad", "deshabilitad", "attiva", "abilita", "richiede", "disabilitat", "disattivat", "ative", "ativa", "necessário", "desativad", "inschakel", "schakel", "ingeschakeld", "vereist", "uitgeschakeld", "nodig",
        "włącz", "wymaga", "wyłączon", "obsług", "включ", "требует", "отключ", "необходим", "увімкн", "вимкнен", "aktivera", "slå på", "krävs", "kräver", "avstäng", "slå til", "kræver", "krever", "deaktivert", "ota käyttöön", "käytössä", "vaatii", "etkinleştir", "gerekli", "devre dışı", "povol", "zapn", "vyžaduje", "vypnut", "engedélyez", "szükséges", "kapcsolja",
        "ενεργοποι", "απαιτείται", "kích hoạt", "bật", "aktifkan", "有効", "無効", "必要", "启用", "啟用", "开启", "禁用", "需要", "활성화", "켜", "필요", "تفعيل", "تمكين", "הפעל", "अनुमति",
    ),
    "view": (
        "browser", "navegador", "navigateur", "navigatore", "przeglądar", "браузер", "webbläsare", "tarayıcı", "prohlížeč", "böngésző", "selain", "ブラウザ", "浏览器", "瀏覽器", "브라우저", "متصفح", "דפדפן", "see", "view", "continue", "anzuzeigen", "zu sehen", "afficher", "continuer", "ver ", "continuar", "visualizz", "vedere", "bekijken", "weergeven", "zobaczyć", "wyświetl", "просмотр", "отобра",
        "work", "function", "funktion", "fonctionn", "funcion", "表示", "显示", "查看", "閱讀", "보려면",
    ),
}
#: Concepts that call for the rules; the others are looked up where one of these stands.
KEY_CONCEPTS = ("not_found", "fault", "denied", "timed_out", "script")
#: Characters from here on belong to scripts that don't part words with spaces.
UNSPACED = 0x2E80
#: Concepts of which a sentence must hold one of every set, and how far into it the first may begin (None: anywhere).
RULES = {
    "error_page": ((("page", "not_found"), None), (("fault",), 20), (("denied",), 20), (("timed_out",), 20)),
    "script_notice": ((("script", "enable", "page"), None), (("script", "enable", "view"), None)),
}

#: A person speaks of themselves, or asks.
PERSONAL = regex.compile(
    r"(?<!\p{L})(?:i|i['’](?:m|ve|d|ll)|me|my|mine|ich|mir|mich|meine?[mnrs]?|je|j['’](?=\p{L})|mon|moi|yo|mi|mis|io|mio|ik|mijn|eu|meu|minha|jag|jeg|я|мне|мой|моей|our(?=\s+(?!side|end|server|system|site|service|engineer|team|part)\p{L}))(?!\p{L})|[?？]"
)

_SENTENCE = regex.compile(r"(?<=[.!?:])\s+|(?<=[。！？])")
_WORDS = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[.!?]+")
_SPLIT_LINES = re.compile(r"[.!?\r\n]+")
_SEPARATORS = str.maketrans(dict.fromkeys(",.;!-", " "))
#: Runs of neighbouring keys, also with one stray letter behind them.
_TOKEN_RUNS = frozenset(row[i:j] + x for row in _ROWS for i in range(len(row)) for j in range(i + 3, len(row) + 1) for x in ["", *"abcdefghijklmnopqrstuvwxyzäöüß"])

_FENCE = re.compile(r"(?s)(?:```|~~~).*?(?:```|~~~|\Z)")
_TAGGED = re.compile(r"(?is)<(pre|code)\b[^>]*+>.*?(?:</\1>|\Z)")
_INDENTED = re.compile(r"(?m)^(?: {4}|\t)[^\n]*+$")
_PARAGRAPH = re.compile("\n[ \t\x0b\f\u00a0]*\n")
_MARKS = frozenset("`\"“„«‹»「")
_QUOTED = re.compile(r"``[^\n]*?``|`[^`\n]*+`|\"[^\"]*+\"|“[^”]*+”|„[^“”\"]*+[“”\"]|«[^»]*+»|‹[^›]*+›|»[^«]*+«|「[^」]*+」")
_READABLE = re.compile(r"[^\W\d_]|[{}\[\]<>%$@_]")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"\b(?=[a-z]*\d)[0-9a-f]{6,}\b|\d+")


def masked_lines(text: str) -> list[str]:
    """Lines of the text outside code (fenced, indented, in back-ticks or tags) and quotation marks, if they hold a letter or a sign.

    A quotation ends within its paragraph; a lone mark hides nothing.
    """
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in t or "~~~" in t:
        t = _FENCE.sub("\n", t)
    if "</" in t:
        t = _TAGGED.sub(" ", t)
    if "    " in t or "\t" in t:
        t = _INDENTED.sub("", t)
    if not _MARKS.isdisjoint(t):
        t = "\n\n".join(_QUOTED.sub(" ~ ", p) for p in _PARAGRAPH.split(t))
    return [x for x in t.split("\n") if _READABLE.search(x)]


def normalised(line: str) -> str:
    """A line in lower case with single spaces, numbers and long hexadecimal ids as #."""
    s = " ".join(line.lower().split())
    return _NUMBER.sub("#", s) if _DIGIT.search(s) else s


def line_key(norm: str) -> int:
    h = xxhash.xxh3_64_intdigest(norm.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


class Reader:
    """All phrases and rules, compiled; one to a worker."""

    def __init__(self):
        self.kinds = list(KINDS)
        self.bit = {k: 1 << i for i, k in enumerate([*self.kinds, *CONCEPTS])}
        self.keys = functools.reduce(lambda a, c: a | self.bit[c], KEY_CONCEPTS, 0)
        self.anchors = self._automaton({**ANCHORS, **{k: CONCEPTS[k] for k in KEY_CONCEPTS}})
        self.concepts = self._automaton(CONCEPTS)
        self.phrases = {k: regex.compile(self._pattern(*v)) for k, v in KINDS.items()}
        self.repeated = regex.compile(r"(?<![\p{L}\p{N}])(?:" + "|".join(REPEATED) + ")")
        self.rules = {k: [([self.bit[c] for c in need], reach) for need, reach in rs] for k, rs in RULES.items()}

    def _automaton(self, words_of: dict) -> ahocorasick.Automaton:
        stems: dict[str, int] = {}
        for name, words in words_of.items():
            for w in words:
                stems[w] = stems.get(w, 0) | self.bit[name]
        out = ahocorasick.Automaton()
        for w, bits in stems.items():
            out.add_word(w, (bits, len(w)))
        out.make_automaton()
        return out

    @staticmethod
    def _pattern(signs: tuple, anywhere: tuple, at_start: tuple) -> str:
        out = []
        if signs:
            out.append("(?=" + SIGNS + ")(?:" + "|".join(signs) + ")")
        if anywhere:
            out.append(r"(?<![\p{L}\p{N}])(?:" + "|".join(anywhere) + ")")
        if at_start:
            out.append(_START + "(?:" + "|".join(at_start) + ")")
        return "(?:" + "|".join(out) + ")"

    def seen(self, text: str) -> int:
        """Bits of the kinds' anchors and of the key concepts in a text in lower case with single spaces."""
        out = 0
        for _, (bits, _) in self.anchors.iter(text):
            out |= bits
        return out

    def _firsts(self, sentence: str) -> dict[int, int]:
        """Where each concept first begins a word; in scripts without spaces, anywhere."""
        out: dict[int, int] = {}
        for end, (bits, n) in self.concepts.iter(sentence):
            at = end - n + 1
            before = sentence[at - 1] if at else " "
            if not before.isalnum() or ord(before) >= UNSPACED or ord(sentence[at]) >= UNSPACED:
                b = bits
                while b:
                    low = b & -b
                    out.setdefault(low, at)
                    b ^= low
        return out

    def _phrase(self, line: str, kind: str) -> bool:
        for m in self.phrases[kind].finditer(line):
            if kind == "placeholder":
                return True
            a = max(line.rfind(c, 0, m.start()) for c in ".!?") + 1
            b = min((i for c in ".!?" if (i := line.find(c, m.end())) >= 0), default=len(line))
            if not PERSONAL.search(line[a : b + 1]):
                return True
        return False

    def _rule(self, line: str, kind: str) -> bool:
        for s in _SENTENCE.split(line):
            words = len(s.split())
            if len(s) > RULE_LETTERS if words < 3 else words > RULE_WORDS:
                continue
            at = self._firsts(s)
            for each, reach in self.rules.get(kind, ()):
                if all(b in at for b in each) and (reach is None or min(at[b] for b in each) <= reach) and not PERSONAL.search(s):
                    return True
        return False

    def filler_by_tokens(self, line: str) -> bool:
        """A word, or two in turn, again and again; or three runs of neighbouring keys, with at most one stray letter behind each."""
        tokens = line.translate(_SEPARATORS).split()
        if len(tokens) < 3:
            return False
        if b"\1" * 3 in bytes(map(_TOKEN_RUNS.__contains__, tokens)):
            return True
        # five words of one kind, or four pairs, agree four or six times running with those one or two places on
        again = b"\1" * 4 in bytes(map(operator.eq, tokens, tokens[1:])) or b"\1" * 6 in bytes(map(operator.eq, tokens, tokens[2:]))
        return again and bool(self.repeated.search(line))

    def kind(self, line: str) -> str | None:
        """Kind of evidence that a line holds, or None."""
        low = line.lower()
        mask = self.seen(" ".join(low.split()))
        for k in self.kinds:
            if (mask & self.bit[k] and self._phrase(low, k)) or (k == "filler" and self.filler_by_tokens(low)) or (mask & self.keys and k in self.rules and self._rule(low, k)):
                return k
        return None

    def evidence(self, lines: list[str]) -> list[tuple[int, str]]:
        """(line, kind) of the lines with evidence; a document without any anchor is done after one search."""
        whole = " ".join(" ".join(lines).lower().split())
        if not (self.seen(whole) or self.filler_by_tokens(whole)):
            return []
        return [(i, k) for i, x in enumerate(lines) if (k := self.kind(x))]


@functools.cache
def reader() -> Reader:
    return Reader()



#: SQL of a document's host; null and blank ones are one host.
HOST = "coalesce(nullif(trim(source), ''), '?')"
_ROWS_DDL = "doc_id bigint, host string, line bigint, kind string, norm string, n bigint"
_ROWS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("line", pa.int64()), ("kind", pa.string()), ("norm", pa.string()), ("n", pa.int64())])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, host, text of the documents that can be read. Null and blank hosts are one host."""
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(HOST).alias("host"), "text")


def _pass(docs: DataFrame, look) -> DataFrame:
    """Rows of _ROWS_DDL that ``look(batch rows)`` gives for every Arrow batch of (doc_id, host, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(look(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], f.type) for i, f in enumerate(_ROWS_SCHEMA)], schema=_ROWS_SCHEMA)

    return _texts(docs).mapInArrow(run, _ROWS_DDL)


def counted_and_searched(docs: DataFrame) -> DataFrame:
    """One pass over the texts: counts of all lines (host, line, n: documents of a batch that hold it) and lines with evidence (doc_id, host, line, kind)."""

    def look(rows):
        r, count = reader(), Counter()
        for doc_id, host, text in rows:
            lines = masked_lines(text)
            keys = [line_key(normalised(x)) for x in lines]
            count.update((host, k) for k in set(keys))
            for i, kind in r.evidence(lines):
                yield doc_id, host, keys[i], kind, None, None
        for (host, k), n in count.items():
            yield None, host, k, None, None, n

    return _pass(docs, look)


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, host, line (key) and norm of every distinct normalised line of every document."""

    def look(rows):
        for doc_id, host, text in rows:
            for norm in {normalised(x) for x in masked_lines(text)}:
                yield doc_id, host, line_key(norm), None, norm, None

    return _pass(docs, look).select("doc_id", "host", "line", "norm")


def line_counts(docs: DataFrame, least: int = 2) -> DataFrame:
    """Documents of each host that hold a normalised line, for lines of ``least`` documents or more: host, norm, n_docs. Summed per batch before the shuffle."""

    def look(rows):
        count = Counter()
        for _, host, text in rows:
            count.update((host, norm) for norm in {normalised(x) for x in masked_lines(text)})
        for (host, norm), n in count.items():
            yield None, host, None, None, norm, n

    return _pass(docs, look).groupBy("host", "norm").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= least)


def mock_words(docs: DataFrame, n_sentences: int | None = None) -> list[str]:
    """The corpus' own mock-Latin vocabulary, from the sentences with the classic opening.

    Generators shuffle their vocabulary, so most filler sentences lack the
    opening, but their words recur in those that have it. Sentences count once,
    however often they are copied. A seed teaches its words only if
    MOCK_SENTENCE_SHARE of them are peculiar to seeds, so a person's sentence
    about the opening teaches none. ``n_sentences``: the size of the corpus in
    distinct lines or sentences, if known; else it is counted.
    """
    opening = re.compile(r"lorem\s+ipsum")
    seed_ddl = "seed bigint, words array<string>"

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {}
            for text in b.column(2).to_pylist():
                for line in masked_lines(text):
                    for s in _SPLIT.split(line.lower()):
                        if opening.search(s):
                            w = _WORDS.findall(s)
                            found[line_key(" ".join(w))] = sorted(set(w))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.string()))], names=["seed", "words"])

    seeds = cut(_texts(docs).where(F.lower("text").contains("ipsum")).mapInArrow(seeds_of, seed_ddl).dropDuplicates(["seed"]))
    inside = seeds.select("seed", F.explode("words").alias("w")).where(~F.col("w").isin("lorem", "ipsum"))
    n_seed = {r.w: r.n for r in inside.groupBy("w").agg(F.count("*").alias("n")).collect()}  # the seeds' vocabulary
    if not n_seed:
        return []
    known = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(sorted(n_seed))})

    def others_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for b in batches:
            found = {}
            for text in b.column(2).to_pylist():
                text = text.lower()
                if number.keys().isdisjoint(_WORDS.findall(text)):
                    continue
                for s in _SPLIT_LINES.split(text):
                    w = _WORDS.findall(s)
                    if not number.keys().isdisjoint(w) and not opening.search(s):
                        found[line_key(" ".join(w))] = w
            held = [[number[x] for x in set(w) if x in number] for w in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(held, pa.list_(pa.int32()))], names=["seed", "words"])

    others = _texts(docs).mapInArrow(others_of, "seed bigint, words array<int>").groupBy("seed").agg(F.first("words").alias("words"))
    n_other = {r.w: r.n for r in others.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row a word
    if n_sentences is None:
        n_sentences = line_counts(docs, 1).count()
    of = lambda w: n_other.get(known.value[w], 0)
    n_seeds = seeds.count()
    least = min(MOCK_LIFT * n_seeds / max(n_sentences, n_seeds), 0.5)
    peculiar = [w for w, n in n_seed.items() if n / (n + of(w)) >= least]
    if not peculiar:
        return []
    own = F.col("w").isin(peculiar)
    teaching = inside.groupBy("seed").agg(F.avg(own.cast("int")).alias("share")).where(F.col("share") >= MOCK_SENTENCE_SHARE)
    learnt = {r.w for r in inside.where(own).join(teaching, "seed", "left_semi").select("w").distinct().collect()}
    return sorted(learnt | {"lorem", "ipsum"}) if learnt else []


def is_mock(line: str, mock: frozenset) -> bool:
    """Whether some sentence of the line is made of mock words."""
    for s in _SPLIT.split(line.lower()):
        w = _WORDS.findall(s)
        if len(w) >= MOCK_SENTENCE_WORDS and sum(x in mock for x in w) >= MOCK_SENTENCE_SHARE * len(w):
            return True
    return False


def mock_lines(docs: DataFrame, mock: list[str]) -> DataFrame:
    """Lines with a sentence of mock words: doc_id, host, line, kind."""
    words = docs.sparkSession.sparkContext.broadcast(frozenset(mock))
    least = math.ceil(MOCK_SENTENCE_WORDS * MOCK_SENTENCE_SHARE)

    def look(rows):
        mock = words.value
        for doc_id, host, text in rows:
            if sum(x in mock for x in _WORDS.findall(text.lower())) >= least:
                for x in masked_lines(text):
                    if is_mock(x, mock):
                        yield doc_id, host, line_key(normalised(x)), "filler", None, None

    return _pass(docs, look).select("doc_id", "host", "line", "kind")


def residue(docs: DataFrame) -> DataFrame:
    """doc_id and kind of every record whose residual holds evidence.

    All lines are counted by host. A line that BOILERPLATE_SHARE of its host's
    documents repeat is the host's furniture; evidence in it is none where the
    line stands beside other content (beside_content), and a text that consists
    of it stays a case. Null, empty, blank, symbol-only and digit-only texts
    have no lines.
    """
    got = cut(counted_and_searched(docs))
    counts = got.where("n is not null").groupBy("host", "line").agg(F.sum("n").alias("n_docs"))
    n_lines = counts.count()
    counts = counts.where(F.col("n_docs") >= BOILERPLATE_DOCS)
    sizes = docs.groupBy(F.expr(HOST).alias("host")).agg(F.count("*").alias("host_docs"))
    furniture = cut(counts.join(sizes, "host").where(F.col("n_docs") >= BOILERPLATE_SHARE * F.col("host_docs")).select("host", "line"))
    lines = got.where("kind is not null").select("doc_id", "host", "line", "kind")
    mock = mock_words(docs, n_lines)
    if mock:
        lines = lines.unionByName(mock_lines(docs, mock))
    lines = cut(lines.distinct())
    held = lines.join(furniture, ["host", "line"], "left_semi")
    if held.isEmpty():
        return lines.select("doc_id", "kind").distinct()
    residual = lines.join(beside_content(docs, held), ["doc_id", "host", "line"], "left_anti")
    return residual.select("doc_id", "kind").distinct()


def beside_content(docs: DataFrame, held: DataFrame) -> DataFrame:
    """doc_id, host, line of the furniture with evidence that stands beside other content in its document.

    Documents of such furniture alone are no such ones, nor are the copies of one
    page: those with the same other lines, if they are most of the documents
    in which the line stands beside any.
    """
    held = held.select("doc_id", "host", "line").distinct()
    furniture = held.select("host", "line").distinct()
    rest = (
        line_rows(docs.join(held.select("doc_id").distinct(), "doc_id", "left_semi"))
        .select("doc_id", "host", "line").distinct()
        .join(furniture, ["host", "line"], "left_anti")
        .groupBy("doc_id", "host").agg(F.bit_xor("line").alias("rest"))
    )
    beside = held.join(rest, ["doc_id", "host"])
    copies = beside.groupBy("host", "line", "rest").agg(F.count("*").alias("n"))
    most = copies.groupBy("host", "line").agg(F.sum("n").alias("total"))
    pages = copies.join(most, ["host", "line"]).where("n > 1 and 2 * n > total").select("host", "line", "rest")
    return beside.join(pages, ["host", "line", "rest"], "left_anti").select("doc_id", "host", "line")
