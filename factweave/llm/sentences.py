"""Problem 10: sentence units by cascading tables of ordered break and no-break rules.

Three cascades follow each other. The layout table cuts a text into segments at blank lines
and at lines that start a unit. The quotation table finds the quotations of a segment. The
sentence tables, one per language or script, decide each place after an end mark: of the
ordered pairs of a regular expression for what stands before and one for what stands after,
the first that matches says whether the place is a break.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.sources.tables import table

BREAK, JOIN = True, False

# ---------------------------------------------------------------- layout
_CAP = r"[^\W\d_a-z][\w'’-]*"
_NAME = rf"(?:{_CAP}(?: [A-Z]\.)?(?: {_CAP}| [A-Z]\.)?|{_CAP}, {_CAP})"
_ROLE = r"(?: \([^()\n]{1,30}\))?"
#: Ordered: kind, pattern at the start of a line, whether the line is a unit of its own.
LAYOUT = [
    ("heading", re.compile(r"[ \t]*#{1,6}[ \t]+\S"), True),
    ("channel", re.compile(r"[ \t]*#[\w-]+[ \t]*$"), True),
    ("quote", re.compile(r"[ \t]*>+[ \t]*"), False),
    ("item", re.compile(r"[ \t]*[-*•◦▪‣+–][ \t]+"), False),
    ("numbered item", re.compile(r"[ \t]*\(?(?:\d{1,3}|[a-z])[.)][ \t]+"), False),
    ("header", re.compile(
        r"(?:From|To|Cc|Bcc|Date|Sent|Subject|Reply-To|Status|Owner|Ref|Meeting|Attendees|Length|Assignee|Priority|Labels?|Title|Author|Reviewers?)[ \t]*:(?=\s|$)"), True),
    ("greeting", re.compile(r"(?:Hi|Hello|Hey|Dear|Hallo|Liebe[rs]?|Bonjour|Hola|Good (?:morning|afternoon|evening))\b[^\n.?]{0,40}[,!:]?[ \t]*$"), True),
    ("sign-off", re.compile(r"(?:Best|Regards|(?:Best|Kind|Warm) (?:regards|wishes)|Cheers|Sincerely|Yours|Many thanks|Thanks|Viele Grüße|Cordialement|Saludos),?[ \t]*(?:$|(?<=,[ \t])[A-Z])"), False),
    ("turn", re.compile(rf"{_NAME}{_ROLE}:(?=\s|$)"), False),
    ("lower turn", re.compile(rf"[a-z][\w'’-]* [a-z][\w'’-]*{_ROLE}:(?=\s|$)"), False),
    ("label", re.compile(r"[^\W\d_a-z][\w-]*(?: [\w-]+)?:(?=\s)"), False),
]
#: Kinds that count only where the line before was finished or is a unit or item itself.
CAUTIOUS = {"numbered item", "lower turn", "label"}
FINISHED = re.compile(r"[.!?…。！？।؟]['\"’”»」)\]]*\s*$")

# ---------------------------------------------------------------- quotations
QUOTES = {"“": "”", "„": "“”\"", "«": "»", "「": "」", "『": "』", "‘": "’", '"': '"'}
_OPENS = re.compile("[" + "".join(QUOTES) + "]")

# ---------------------------------------------------------------- sentences
# Abbreviations that are never the end of a sentence, by language.
NEVER_END = {
    "any": "mr mrs ms dr prof capt mt st mme hr hrn frau sr sra",
    "en": "Mr Mrs Ms Dr Prof Capt Mt St Sen Rep Gen Lt Col Sgt Rev Hon Messrs Fig Figs Eq Sec Ch vs cf approx incl excl vol pp ed eds esp ca viz resp al e.g i.e Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Tues Wed Thu Thurs Fri Sat Sun",
    "de": "Hr Hrn Fr Frl Dr Prof z.B d.h u.a u.U z.T bzw ca evtl ggf inkl exkl Nr Nrn Str S vgl Mio Mrd Abs Art Bd",
    "fr": "M MM Mme Mmes Mlle Me Mgr env cf p pp fig vol éd chap art av apr n° no",
    "es": "Sr Sra Sres Srta Dr Dra D Dña Ud Uds aprox pág págs núm art cap vol fig ed p.ej",
    "hi": "डॉ श्री श्रीमती सुश्री प्रो",
    "ar": "د أ م",
}
# Abbreviations that end a sentence when a capital follows.
MAY_END = {
    "en": "etc a.m p.m U.S U.K E.U U.N Inc Corp Ltd Co LLC Jr Sr Max Min max min No no dept est hrs min sec",
    "de": "usw usf etc GmbH AG Co",
    "fr": "etc S.A S.A.R.L Cie",
    "es": "etc S.A S.L Cía EE.UU",
}
# Abbreviations of any language that are words or names in this one, so they end a sentence when a capital follows.
ALSO_WORDS = {"en": "art Art no cap av Jan Mar Mon Wed Sat Sun", "de": "Art", "fr": "art cap", "es": "no cap Mar"}
# Words that tell the languages of one script apart.
COMMON = {
    "en": "the of and to is was are were we you it for on with that this from have has be by at as not",
    "de": "der die das und ist nicht wir ein eine den dem zu mit auf für von im wird sich bei war sind auch",
    "fr": "le les des est et une nous pour dans sur que qui du au pas avec ce cette sont a été par",
    "es": "el los las que en una es con por para del se no lo su al fue más como y",
}
LATIN = tuple(COMMON)
_CLOSE = r"['\"’”»」』)\]]"
PLACE = re.compile(rf"[.!?…。！？।؟۔]+(?:\s?[»]|{_CLOSE})*|(?<=[ก-๛])[ \n]+(?=[ก-๛A-Z0-9])")

#: Kinds of places: an East Asian mark, one of a script without capitals, a blank between Thai
#: words, a point after what may be an abbreviation or number, and all others.
CJK, CASELESS, BLANK, POINT, OTHER = range(5)
_CJK_END = "。！？"
_ANYWHERE = (POINT, OTHER)


def _words(text: str) -> str:
    return "|".join(re.escape(w).replace(r"\.", r"\.\s?") for w in sorted(text.split(), key=len, reverse=True))


def _table(told: str | None, kind: int) -> list[tuple[bool, re.Pattern, re.Pattern]]:
    """The ordered pairs of a language (null: of texts that do not tell theirs) for one kind of place.

    Texts quote names and phrases of other languages, so the abbreviations of all are known,
    but for those that are words of the language itself.
    """
    any_, lower = r"", r"\s*[\[(]?[^\W\d_A-Z]"
    open_ = ALSO_WORDS.get(told or "", "").split()
    never = _words(" ".join(w for v in NEVER_END.values() for w in v.split() if w not in open_))
    may = _words(" ".join([*(w for v in MAY_END.values() for w in v.split()), *open_]))
    point, anywhere = (POINT,), _ANYWHERE
    pairs = [
        # Scripts without spaces or capitals.
        ((BLANK,), BREAK, r"[ก-๛]$", r"[ \n]"),
        ((CJK,), JOIN, r"[。！？][」』]$", r"\s*(?:と|って|という|は|が|を|の|に|で|も)"),
        ((CJK,), BREAK, r"[。！？]['\"’”」』)]*$", any_),
        ((CASELESS,), BREAK, r"[।؟۔]['\"’”»)]*$", any_),
        # Numbers, versions, files, addresses: no blank after the mark, no capitalised word either.
        (anywhere, JOIN, r"[.!?…]['\"’”»)\]]*$", r"[a-z0-9_/\\@:=&?#,;-]"),
        # German ordinals and numbered months.
        (point, JOIN, r"\b(?:am|im|vom|zum|bis|ab|der|dem|den|des|die|das|seit)\s\d{1,3}\.$", r"\s+[A-ZÄÖÜ]"),
        (point, JOIN, r"\b\d{1,2}\.$", r"\s+(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartal)\b"),
        # Units of measure after a number.
        (point, BREAK, r"\d\s?(?:ms|min|mins|h|hrs|s|sec|st|mt|no)\.$", r"\s+[^\W\d_a-z]"),
        # Abbreviations of several parts, between the parts.
        (point, JOIN, r"(?:^|[\s(])[a-zA-Z]\.$", r"\s?[^\W\d_]\."),
        # Numbers named by an abbreviation.
        (point, JOIN, r"\b(?:[Nn]o|[Nn]r|[Aa]rt|[Ss]ec|[Cc]h|[Vv]ol|[Pp]p?|[Mm]ax|[Mm]in|[Ff]ig|pág|núm)\.$", r"\s*\d"),
        (point, JOIN, rf"(?:^|[\s(\[“\"'„«—–/-])(?:{never})\.$", any_),
        (point, JOIN, r"(?:^|[\s(\[“\"'„«])(?:J\.\s)?[A-Z]\.$", r"\s*[A-Z][\w'’.-]"),
        (point, JOIN, rf"(?:^|[\s(\[“\"'„«-])(?:{may})\.$", lower),
        (point, JOIN, rf"(?:^|[\s(\[“\"'„«-])(?:{may})\.$", r"\s*[,;:)\]0-9]"),
        (point, JOIN, r"\b(?:[A-Za-z]\.){2,}$", lower),
        # A quotation, bracket or pause inside a longer sentence.
        (anywhere, JOIN, rf"(?:\.\.\.|…){_CLOSE}*$", lower),
        ((OTHER,), JOIN, r"[.!?…]\s?['\"’”»)\]]+$", r"\s*[,;:]|\s+[^\W\d_A-Z]"),
        (anywhere, JOIN, r"[.!?…]+$", r"\s*[,;:)\]]"),
        # End marks with a blank after them, whatever follows.
        (anywhere, BREAK, r"[.!?…]\s?['\"’”»)\]]*$", r"\s"),
        # The blank is missing.
        (anywhere, BREAK, r"[a-zà-ÿ0-9)%][.!?…]+['\"’”»)\]]*$", r"[“\"„«(¿¡]?[A-ZÀ-Ý][a-zà-ÿ']"),
        (anywhere, BREAK, r"[.!?…]+['\"’”»)\]]*$", r"[ऀ-ॿ؀-ۿก-๛぀-ヿ一-鿿¿¡]"),
    ]
    return [(decision, re.compile(before), re.compile(after)) for kinds, decision, before, after in pairs if kind in kinds]


#: Tables by language and kind of place.
TABLES = {told: [_table(told, kind) for kind in range(5)] for told in (*LATIN, None)}
#: Last parts of words after which a point may not be an end mark; all others are decided without the lists.
_SUSPECT = {re.split(r"\W", w)[-1] for t in (NEVER_END, MAY_END) for v in t.values() for w in v.split()} | {"ms", "min", "mins", "h", "hrs", "s", "sec", "st", "mt", "no"}
#: Those for which the language of the text matters.
_TOLD = {w for v in ALSO_WORDS.values() for w in v.split()}
#: No table looks farther back than this from the first end mark (checked in the tests).
STEM = 48
_COMMON = {x: frozenset(v.split()) for x, v in COMMON.items()}
_TOKEN = re.compile(r"[^\W\d_]+")


def language(text: str, hint: str | None) -> str | None:
    """The language whose most common words a stretch of Latin text has; else that of the hint, else null."""
    said = [w.lower() for w in _TOKEN.findall(text)]
    votes = sorted(((sum(w in c for w in said), x) for x, c in _COMMON.items()), reverse=True)
    if votes[0][0] > votes[1][0]:
        return votes[0][1]
    declared = re.split(r"[-_]", (hint or "").strip().lower())[0]
    return declared if declared in _COMMON else None


def _segments(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """``(start, end, first place that may be a break, whole)`` of the segments of a text."""
    start = free = None
    whole, at, before = False, 0, ""
    for line in text.split("\n"):
        end = at + len(line)
        if not line.strip():
            if start is not None:
                yield start, at, free, whole
            start, before = None, ""
        else:
            marker, alone = _starts(line, before)
            if start is None or marker or whole:
                if start is not None:
                    yield start, at, free, whole
                start, free, whole = at, at + (marker or 0), alone
            before = line
        at = end + 1
    if start is not None:
        yield start, len(text), free, whole


def _starts(line: str, before: str) -> tuple[int, bool]:
    """Length of the marker with which a line starts a unit (0: none), and whether it is one."""
    for kind, pattern, alone in LAYOUT:
        m = pattern.match(line)
        if m is None or (kind in CAUTIOUS and before and not FINISHED.search(before) and not _stands(before)):
            continue
        return max(1, m.end()), alone
    return 0, False


def _stands(line: str) -> bool:
    return any((alone or kind.endswith("item")) and pattern.match(line) for kind, pattern, alone in LAYOUT)


def _quotations(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """``(opening, closing)`` places of the quotations of a segment, not nested, of any length."""
    found, ahead, i = [], {}, start
    while m := _OPENS.search(text, i, end):
        i = m.start()
        if text[i] == '"' and i > start and text[i - 1].isalnum() and i + 1 < end and text[i + 1].isalnum():
            i += 1
            continue
        ends = []
        for c in QUOTES[text[i]]:
            # Where the next such mark is, is looked up once.
            if ahead.get(c, i) <= i:
                p = text.find(c, i + 1, end)
                ahead[c] = p if p >= 0 else end
            if ahead[c] < end:
                ends.append(ahead[c])
        if ends:
            found.append((i, min(ends)))
            i = min(ends)
        i += 1
    return found


def _spoken(text: str, start: int, opening: int) -> bool:
    """Whether a quotation follows a colon or comma, so its end is that of the sentence."""
    i = opening - 1
    while i >= start and text[i].isspace():
        i -= 1
    return i >= start and text[i] in ":：,，、"


#: What may follow a quotation that ended its sentence after a colon or comma.
_GOES_NO_FURTHER = re.compile(r"\s+(?!(?:and|but|or|then|as|while|und|aber|et|mais|y|pero)\b)\w")


def units(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Code-point offsets ``(start, end)`` of the sentence units of a text, in order.

    ``lang`` is only a hint for stretches whose words do not tell their language.
    """
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for start, end, free, whole in _segments(text):
        cuts = [] if whole else _breaks(text, start, end, free, lang)
        at = start
        for cut in [*cuts, end]:
            a, b = at, cut
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            at = cut
    return out


def _kind(text: str, start: int, m: re.Match) -> tuple[int, str]:
    """Kind of a place and, for a single point, the letters before it."""
    mark = m.group(0)
    if mark != ".":
        c = mark[0]
        return (CJK if c in _CJK_END else BLANK if c.isspace() else CASELESS if c in "।؟۔" else OTHER), ""
    i = at = m.start()
    while i > start and text[i - 1].isalnum():
        i -= 1
    word = text[i:at]
    return (POINT if len(word) < 2 or word in _SUSPECT or word.isdigit() or (word[0].isdigit() and not word[-1].isdigit()) else OTHER), word


def _breaks(text: str, start: int, end: int, free: int, lang: str | None) -> list[int]:
    quotations = _quotations(text, start, end)
    told: tuple[str | None] | None = None  # asked once, and only where it matters
    q, cuts, last = 0, [], start
    for m in PLACE.finditer(text, free, end):
        at = m.start() if m.group(0)[0].isspace() else m.end()
        if quotations:
            while q < len(quotations) and quotations[q][1] < m.start():
                q += 1
            for opening, _ in quotations[q : q + 2]:
                if m.start() < opening < at:
                    at = opening  # a mark that opens the next quotation closes nothing
            if q < len(quotations) and quotations[q][0] < m.start() and at <= quotations[q][1]:
                continue  # inside a quotation
        if at >= end:
            continue
        kind, word = _kind(text, start, m)
        if q < len(quotations) and quotations[q][0] < m.start() <= quotations[q][1] < at:
            if kind == CJK:
                # A quotation that begins the sentence goes on with who said it.
                if not _spoken(text, max(last, free), quotations[q][0]) and text[max(last, free) : quotations[q][0]].strip() == "":
                    continue
            elif _spoken(text, max(last, free), quotations[q][0]) and _GOES_NO_FURTHER.match(text, at, end):
                cuts.append(at)
                last = at
                continue
        if kind == POINT and word in _TOLD and told is None:
            told = (language(text[start:end], lang),)
        before = text[max(last, m.start() - STEM) : at]
        for decision, left, right in TABLES[told[0] if told and word in _TOLD else None][kind]:
            if right.match(text, at, end) and left.search(before):
                if decision:
                    cuts.append(at)
                    last = at
                break
    return cuts


def sentences(documents: DataFrame) -> DataFrame:
    """``doc_id, start_pos, end_pos`` of every unit of ``documents(doc_id, text, lang)``.

    A missing column ``lang`` is no hint. Offsets are 0-based code points, the end exclusive. Null and blank texts have no unit; a
    text of any length is cut as a whole, in one pass, and nothing is shuffled but to drop
    rows that are repeated in full.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, a, b) for d, t, lang in zip(batch["doc_id"], batch["text"], batch["lang"]) for a, b in units(t, lang)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "end_pos"])

    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string").alias("lang")
    asked = documents.select("doc_id", "text", lang).where("doc_id is not null and text is not null")
    return asked.mapInPandas(cut, "doc_id bigint, start_pos int, end_pos int")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence units of every document; ``doc_id`` is unique, so no row repeats."""
    return sentences(table(spark, folder, "documents"))
