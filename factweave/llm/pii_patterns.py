"""Finding candidates of personal information in one text; what they are is decided elsewhere."""

from __future__ import annotations

import re

# ---------------------------------------------------------------- forms that speak for themselves
EMAIL = re.compile(
    r"(?<![\w.+%-])[\w.+%-]*\w(?:@|\s?(?:\[at\]|\(at\)|\{at\})\s?)[A-Za-z0-9-]+(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?)[A-Za-z0-9-]+)*"
    r"(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?)[A-Za-z]{2,}(?![\w-])",
    re.I,
)
PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?:\+|[0０]{2})[1-9１-９]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]\d{2,8}){1,4}"
    r"|\+\d{8,15}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}"
    r"|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}"
    r"|[0０]\d{4} \d{6}|[0０]\d{3} \d{3} \d{4}|[0０]\d(?: \d{2}){4}|[0０]\d{2} \d{4} \d{4}"
    r")(?![\w-]|[.:]\d)"
)
# Words of street addresses in four languages.
_EN_WORDS = "Street St Road Rd Drive Lane Ln Court Ct Row Avenue Ave Way Place Close Terrace Square Crescent Boulevard Blvd Hill Parade Mews"
_DE_ENDS = "gasse weg straße strasse str. platz allee ring damm ufer steig hof markt"
_FR_WORDS = "rue avenue impasse boulevard place chemin allée quai cours passage square"
_ES_WORDS = "Calle Avenida Plaza Paseo Camino Carrera Ronda Travesía"
_SHORT = {"St", "Rd", "Ln", "Ct", "Ave", "Blvd"}


def _any(words: str) -> str:
    return "|".join(re.escape(w) for w in words.split())


_EN = "(?:" + "|".join(w + (r"(?:\.|\b)" if w == "St" else r"\.?" if w in _SHORT else "") for w in _EN_WORDS.split()) + ")"
_UNIT = r"(?:Apt|Apartment|Flat|Unit|Suite|Ste|Room)\.?\s+#?\w+"
_DE = rf"[A-ZÄÖÜ][\wäöüß-]*(?:{_any(_DE_ENDS)})"
_FR = rf"(?:{_any(_FR_WORDS)})"
_ES = rf"(?:{_any(_ES_WORDS)})"
_TOWN = r"(?P<town{n}>[A-ZÀ-Þ][\w'’]*(?:-[A-ZÀ-Þ]\w*)*(?: [A-ZÀ-Þ][\w'’]*(?:-[A-ZÀ-Þ]\w*)*)?)"


def _town(n: int) -> str:
    return _TOWN.replace("{n}", str(n))


ADDRESS = re.compile(
    r"(?<![\w-])(?:"
    # unit, number, street, unit, town, postcode
    rf"(?:{_UNIT},?\s+)?\d{{1,5}}[A-Za-z]?,?\s+(?:[A-Z][\w'’]*\s+){{1,3}}{_EN}(?!\w)(?:,?\s+{_UNIT})?(?:,\s+{_town(1)}(?:,?\s+\d{{5}}(?!\d))?|,?\s+\d{{5}}\s+{_town(2)})?"
    # street, number, postcode, town
    rf"|(?:{_DE}|(?:Am|An|Im|In|Auf|Zum|Zur|Unter|Hinter)\s+(?:(?:der|dem|den)\s+)?(?:[A-ZÄÖÜ][\wäöüß]+\s+){{0,2}}?[A-ZÄÖÜ][\wäöüß]+)\s+\d{{1,4}}\s?[a-z]?(?!\w)(?:,\s+{_UNIT})?,\s+\d{{5}}\s+{_town(3)}"
    rf"|{_DE}\s+\d{{1,4}}[a-z]?(?!\w)"
    # number, street, postcode, town
    rf"|\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+{_FR}\s+(?:(?:de|des|du|la|le|les)\s+|l['’]|d['’])*[A-ZÀ-Þ][\w'’-]+(?:\s+[A-ZÀ-Þ][\w'’-]+)?(?:,\s+\d{{5}}\s+{_town(4)})?"
    # street, number, town
    rf"|{_ES}\s+(?:(?:de|del|los|las|la|el)\s+)*[A-ZÀ-Þ]\w+(?:\s+[A-ZÀ-Þ]\w+)?,\s+\d{{1,4}}(?!\d)(?:,\s+(?:\d{{5}}\s+)?{_town(5)})?"
    r")"
)

#: Every address has one of these words, or a comma before its postcode (see ADDRESS).
_STREET_WORDS = [*_EN_WORDS.split(), *_DE_ENDS.split(), *_FR_WORDS.split(), *_ES_WORDS.split()]
_POSTCODE = re.compile(r",\s+\d{5}\s")
#: What can hold a phone number: nothing else of PHONE is outside these characters, and none is shorter.
_DIALLED = re.compile(r"[+(\d][\d .()+-]{6,}")
_DIAL_START = re.compile(r"(?<![\w.+/-])[+(\d]")


def addresses(text: str) -> list[re.Match]:
    """Matches of ADDRESS; texts without any word of it are not searched."""
    if any(w in text for w in _STREET_WORDS) or _POSTCODE.search(text):
        return list(ADDRESS.finditer(text))
    return []


def phones(text: str) -> list[tuple[int, int]]:
    """Spans of PHONE, tried only where a stretch of dialled characters or a part of it begins."""
    found = []
    for stretch in _DIALLED.finditer(text):
        at = stretch.start()
        while start := _DIAL_START.search(text, at, stretch.end()):
            m = PHONE.match(text, start.start())
            if m:
                found.append(m.span())
            at = m.end() if m else start.end()
    return found


# ---------------------------------------------------------------- candidates decided by context
NUMBER = re.compile(r"(?<![\w.#/+-])(?:[A-Z]{1,2} ?)?\d(?:[ -]?\d){5,14}(?: ?[A-Z])?(?![\w-]|[.:/]\d)")
#: A capitalised word (or one in capitals), not part of an address, a path or a longer word.
CAPITAL = re.compile(r"(?<![\w@./+#'’-])[A-ZÀ-Þ](?:[a-zß-ÿ]+|[A-ZÀ-Þ]+)(?:-[A-ZÀ-Þ][a-zß-ÿ]+)*(?![\w@+]|[-_.]\w|/)")
INITIAL = re.compile(r"[A-ZÀ-Þ]\.")
_NEXT_WORD = re.compile(r" ?([^\W\d_]+)")


def shape(number: str) -> str:
    """Digits as 9, capitals as A, the rest as it stands."""
    return "".join("9" if c.isdigit() else "A" if c.isalpha() else c for c in number)


def number_context(text: str, at: int) -> str:
    """The word (and mark) before a number; one word more where that word is generic."""
    left = re.findall(r"[^\W\d_]+\.?|[=:#(,;\n]", text[max(0, at - 40) : at])
    if not left:
        return "^"
    last = left[-1].lower()
    if last in {"no.", "no", "nr.", "number", "ref", "id", "=", ":", "#", "nº", "code"}:
        return " ".join(x.lower() for x in left[-2:])
    return last


_LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_TOWN_WORD = re.compile(r"[\w'’-]+")


def spoken(text: str) -> set[str]:
    """Everything that a lexicon may be asked for in a text, in lower case: more does no harm."""
    said = {x.rstrip(",") for x in text.split()}
    for m in _LETTERS.finditer(text):
        word = m.group(0)
        said.add(word.lower())
        if "-" in word or not word.isalpha():
            said.update("".join(c if c.isalpha() else " " for c in word).lower().split())
    words = [m.span() for m in _TOWN_WORD.finditer(text)]
    said.update(text[a:d].lower() for (a, b), (c, d) in zip(words, words[1:]) if text[b:c] == " ")
    return said


def capitals(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of capitalised words outside the spans already taken."""
    found = [m.span() for m in CAPITAL.finditer(text)]
    if taken:
        found = [s for s in found if not any(a < s[1] and s[0] < b for a, b in taken)]
    return found


def before(text: str, at: int, firsts, lasts) -> str:
    """Key of what stands before a place, names generalised."""
    i = at
    while i > 0 and text[i - 1] == " ":
        i -= 1
    if i == 0 or text[i - 1] == "\n":
        return "^"
    c = text[i - 1]
    if c == "." and i > 1 and text[i - 2].isupper() and (i == 2 or not text[i - 3].isalnum()):
        return "<I>"
    if c.isalpha() or c == ".":
        j = i - 1
        while j > 0 and text[j - 1].isalpha():
            j -= 1
        w = text[j : i - 1] if c == "." else text[j:i]
        if c == "." and not (w[:1].isupper() and len(w) < 5):
            return "^"
        low = w.lower()
        if low in firsts:
            return "<F>"
        if low in lasts:
            return "<S>"
        return low if c != "." or len(w) < 5 else "^"
    if c in "!?:":
        return "^" if c != ":" else ":"
    if c == ",":
        j = i - 1
        k = j
        while k > 0 and text[k - 1].isalpha():
            k -= 1
        low = text[k:j].lower()
        return "<S>," if low in lasts else "<F>," if low in firsts else ","
    return "9" if c.isdigit() else c


def after(text: str, at: int, firsts, lasts) -> str:
    """Key of what stands after a place, names generalised."""
    n = len(text)
    if at < n and text[at] in "'’":
        return "'s" if text[at + 1 : at + 2] == "s" else "'"
    i = at
    while i < n and text[i] == " ":
        i += 1
    if i >= n:
        return "$"
    c = text[i]
    if c == "\n":
        return "$"
    if c == ",":
        m = _NEXT_WORD.match(text, i + 1)
        low = m.group(1).lower() if m else ""
        return ",<F>" if low in firsts else ",<S>" if low in lasts else ","
    if c.isalpha():
        j = i
        while j < n and text[j].isalpha():
            j += 1
        w = text[i:j]
        low = w.lower()
        if len(w) == 1 and w.isupper() and text[j : j + 1] == ".":
            return "<I>"
        if w[0].isupper():
            return "<F>" if low in firsts else "<S>" if low in lasts else "Xx"
        return low
    return "9" if c.isdigit() else c
