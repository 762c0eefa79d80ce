"""Reading typed names of people and organisations, one at a time."""

from __future__ import annotations

import re
import unicodedata

# Titles and legal forms, which are no part of a name.
TITLES = set("mr mrs ms miss dr prof professor sir mme mlle herr frau hr sr sra rev hon mx".split())
LEGAL = set("inc llc ltd limited corp corporation co company gmbh ag sa sas bv plc kg oy ab nv the group holding".split())

# Short forms of first names and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan", "alex": "alexander alexandra", "andy": "andrew andreas", "art": "arthur",
    "bea": "beatrice", "becca": "rebecca", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "bernie": "bernard",
    "bert": "albert robert", "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "bill": "william",
    "billy": "william", "bob": "robert", "bobby": "robert", "cam": "camila", "cathy": "catherine", "charlie": "charles charlotte",
    "chris": "christopher christina", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah",
    "debbie": "deborah", "dick": "richard", "dolly": "dorothy", "don": "donald", "drew": "andrew", "ed": "edward edwin",
    "eddie": "edward", "eli": "elijah", "eliza": "elizabeth", "ellie": "eleanor", "em": "emily emma", "fran": "frances francisco",
    "frank": "francis francisco franklin", "fred": "frederick", "freddie": "frederick", "gabby": "gabriela", "gabi": "gabriela",
    "gaby": "gabriela", "gene": "eugene", "gwennie": "gwen", "hank": "henry", "harry": "henry harold", "izzy": "isabella",
    "jack": "john", "jake": "jacob", "jamie": "james", "jeff": "jeffrey", "jen": "jennifer", "jenn": "jennifer",
    "jenny": "jennifer", "jerry": "gerald", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph",
    "johnny": "john", "jon": "jonathan", "josh": "joshua", "kat": "katherine", "kate": "katherine", "kathy": "katherine",
    "katie": "katherine", "katy": "katherine", "ken": "kenneth", "kim": "kimberly", "kit": "christopher katherine", "larry": "lawrence",
    "liz": "elizabeth", "lizzie": "elizabeth", "lou": "louis louise", "maggie": "margaret", "marge": "margaret",
    "marty": "martin", "matt": "matthew", "max": "maximilian", "meg": "margaret", "mick": "michael", "mike": "michael",
    "mikey": "michael", "mo": "mohammed", "nat": "nathaniel natalie", "nate": "nathaniel", "ned": "edward", "nell": "eleanor",
    "nick": "nicholas", "nicky": "nicholas", "pam": "pamela", "paco": "francisco", "pancho": "francisco", "pat": "patricia patrick", "patty": "patricia",
    "peggy": "margaret", "pen": "penelope", "penny": "penelope", "pete": "peter", "phil": "philip", "rafa": "rafael",
    "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "robbie": "robert", "ron": "ronald",
    "sally": "sarah", "sam": "samuel samantha", "sammy": "samuel", "sasha": "alexander", "steph": "stephanie",
    "steve": "stephen steven", "stevie": "stephanie", "sue": "susan", "ted": "theodore edward", "teddy": "theodore",
    "theo": "theodore", "tim": "timothy", "toby": "tobias", "tom": "thomas tomas", "tommy": "thomas", "toni": "antonia anthony",
    "tony": "anthony", "tori": "victoria", "tricia": "patricia", "trish": "patricia", "val": "valentina", "vic": "victor victoria",
    "vicki": "victoria", "vicky": "victoria", "vince": "vincent", "wally": "walter", "xan": "alexander", "zach": "zachary",
    "zack": "zachary", "zak": "zachary",
}

# Mailboxes of roles, which say nothing about who writes.
ROLE_BOXES = set(
    "front-desk frontdesk reception info support sales billing ops help helpdesk desk team office admin hr legal finance security"
    " contact hello noreply no-reply accounts marketing press jobs careers service services mail postmaster webmaster on-call oncall".split()
)


def fold(text: str) -> str:
    """Lower case without accents."""
    plain = unicodedata.normalize("NFKD", text)
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def email_identity(email: str | None) -> str | None:
    """A personal mailbox without scheme, case, tag and mail host, or null for anything else."""
    e = fold(email or "").strip().strip("<>").removeprefix("mailto:").strip()
    m = re.fullmatch(r"([\w.+%-]+)@([\w-]+(?:\.[\w-]+)+)", e)
    if not m or m.group(1) in ROLE_BOXES:
        return None
    host, _, rest = m.group(2).partition(".")
    # Whole hosts that only carry mail: `name-mail.tld`, `mail.name.tld`.
    host = host.removesuffix("-mail")
    domain = f"{host}.{rest}".removeprefix("mail.")
    return f"{m.group(1).partition('+')[0]}@{domain}"


def domain_family(identity: str) -> str:
    """The mailbox and the name of its host, without the top-level domain."""
    local, _, domain = identity.partition("@")
    return f"{local}@{domain.rpartition('.')[0]}"


#: (kind, first, last, whole): kinds are `sure` (order known), `two` (order open), `one`, `joined`, `org`.
Form = tuple[str, str | None, str | None, str | None]


def person(mention: str) -> Form | None:
    m = re.sub(r"[(\[][^)\]]*[)\]]", " ", fold(mention))
    tail = m.partition(",")[2].strip(" .")
    swapped = "," in m and bool(tail) and tail not in {"jr", "sr", "phd", "md", "esq"}
    if not swapped:
        m = m.partition(",")[0]

    def tokens(x: str) -> list[str]:
        return [t for t in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", x) if t not in TITLES]

    if swapped:
        last, first = tokens(m.partition(",")[0]), tokens(m.partition(",")[2])
        return ("sure", first[0], last[-1], None) if first and last else None
    t = tokens(m)
    if not t:
        return None
    if len(t) == 1:
        return ("one", t[0], None, None)
    if len(t) > 2:
        t = [t[0], t[-1]]
    if len(t[0]) == 1 and len(t[1]) > 1:
        return ("sure", t[0], t[1], None)
    if len(t[1]) == 1 and len(t[0]) > 1:
        return ("sure", t[1], t[0], None)
    return ("two", t[0], t[1], None)


def handle(text: str) -> Form | None:
    """A user name or the local part of an address."""
    u = fold(text).strip().lstrip("@").partition("@")[0].partition("+")[0]
    t = [x for x in re.split(r"[._\s-]+", re.sub(r"\d+", "", u)) if x]
    if not t:
        return None
    if len(t) == 1:
        return ("joined", None, None, t[0]) if len(t[0]) > 2 else None
    if len(t[0]) == 1:
        return ("sure", t[0], t[-1], None)
    if len(t[-1]) == 1:
        return ("sure", t[-1], t[0], None)
    return ("two", t[0], t[-1], None)


def organisation(mention: str) -> Form | None:
    m = re.sub(r"\b([a-z])\.(?=[a-z]\b)", r"\1", fold(mention))
    t = [x for x in re.findall(r"[^\W_]+", m.replace("'", "")) if x not in LEGAL]
    if not t:
        return None
    if len(t) == 1:
        return ("org1", t[0], None, t[0])
    return ("org", t[0], t[-1], None)


def read(mention: str | None, kind: str | None) -> Form | None:
    if not mention or not mention.strip():
        return None
    kind = (kind or "").strip().lower()
    if kind == "org":
        return organisation(mention)
    if kind == "email" or re.fullmatch(r"\s*\S+@\S+\.\S+\s*", mention):
        return handle(re.sub(r"^\s*(?:mailto:)?", "", mention, flags=re.I))
    if kind == "username" or mention.strip().startswith("@"):
        return handle(mention)
    return person(mention)


def damerau(a: str, b: str) -> int:
    """Edit distance with transpositions (the unrestricted one, which is a metric)."""
    if a == b:
        return 0
    big = len(a) + len(b)
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    seen: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, l = seen.get(b[j - 1], 0), db
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + (i - k - 1) + 1 + (j - l - 1))
        seen[a[i - 1]] = i
    return d[-1][-1]
