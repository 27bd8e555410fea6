"""Readers for the partial, noisy attributes of watchlist records: birth dates, countries, document numbers.

Every reader is total.  Texts that say nothing (``unknown``, ``-``, ``00/00/0000``)
count as missing; several values are separated by ``|``.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from .names import _plain

_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_Y = r"(1[89]\d\d|20\d\d)"
_FORMS = [
    (re.compile(rf"^{_Y}[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[t ].*)?$"), "ymd"),
    (re.compile(rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.]{_Y}$"), "dmy"),
    (re.compile(rf"^(\d{{1,2}})(?:st|nd|rd|th)?[ .-]+([a-z]{{3}})[a-z]*\.?,?[ -]+{_Y}$"), "dMy"),
    (re.compile(rf"^([a-z]{{3}})[a-z]*\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +{_Y}$"), "Mdy"),
    (re.compile(rf"^{_Y}[-/.](\d{{1,2}})$"), "ym"),
    (re.compile(rf"^(\d{{1,2}})[/.]{_Y}$"), "my"),
    (re.compile(rf"^([a-z]{{3}})[a-z]*\.?,? +{_Y}$"), "My"),
]
_YEARS = re.compile(rf"(?<!\d){_Y}(?!\d)")

#: Completeness ranks of a birth date, best first.
FULL, MONTH, YEAR, SPAN = 4, 3, 2, 1


@lru_cache(20_000)
def read_date(x: str) -> tuple[int, int, int, int, int] | None:
    """``(rank, first year, last year, month or 0, day or 0)`` of one birth date item; None if it says nothing."""
    t = " ".join(x.strip().lower().split())
    for pat, how in _FORMS:
        m = pat.match(t)
        if not m:
            continue
        g = m.groups()
        d = 0
        if how == "ymd":
            y, mo, d = int(g[0]), int(g[1]), int(g[2])
        elif how == "dmy":
            d, mo, y = int(g[0]), int(g[1]), int(g[2])
        elif how == "dMy":
            d, mo, y = int(g[0]), _MONTHS.get(g[1], 0), int(g[2])
        elif how == "Mdy":
            mo, d, y = _MONTHS.get(g[0], 0), int(g[1]), int(g[2])
        elif how == "ym":
            y, mo = int(g[0]), int(g[1])
        elif how == "my":
            mo, y = int(g[0]), int(g[1])
        else:
            mo, y = _MONTHS.get(g[0], 0), int(g[1])
        if mo > 12 and 1 <= d <= 12:
            mo, d = d, mo
        if not 1 <= mo <= 12:
            return (YEAR, y, y, 0, 0)
        if how in ("ym", "my", "My"):
            return (MONTH, y, y, mo, 0)
        return (FULL, y, y, mo, d) if 1 <= d <= 31 else (MONTH, y, y, mo, 0)
    ys = sorted({int(y) for y in _YEARS.findall(t)})
    if len(ys) >= 2:
        return (SPAN, ys[0], ys[-1], 0, 0)
    return (YEAR, ys[0], ys[0], 0, 0) if ys else None


def dates(field: str | None) -> list[tuple[int, int, int, int, int]]:
    if not field:
        return []
    return sorted({d for d in map(read_date, field.split("|")) if d})


_VAGUE = re.compile(r"circa|about|approx|around|~|\bca?\.|c\. ?\d|\?", re.I)


def vague(field: str | None) -> bool:
    return bool(field and _VAGUE.search(field))


@lru_cache(30_000)
def date_pair(a: tuple, b: tuple, loose: bool = False) -> int:
    """3 same day, 2 compatible, 1 a small slip, 0 contradictory; ``loose`` when a year is given as approximate."""
    if a[0] == FULL and b[0] == FULL:
        if a == b:
            return 3
        if a[1] == b[1] and a[3] == b[4] and a[4] == b[3]:
            return 1
        return 1 if abs(a[1] - b[1]) == 1 and a[3:] == b[3:] else 0
    gap = max(a[1], b[1]) - min(a[2], b[2])
    if gap <= 0:
        if a[3] and b[3] and a[3] != b[3]:
            return 0
        return 2
    if a[3] and b[3] and a[3] != b[3]:
        return 0
    return 1 if gap <= (2 if loose else 1) else 0


def dates_state(a: list, b: list, loose: bool = False) -> int:
    """Best state over all items of both sides; -1 if a side has none."""
    if not a or not b:
        return -1
    return max(date_pair(tuple(x), tuple(y), loose) for x in a for y in b)


# ISO codes with the names and adjectives in use on the lists.
COUNTRIES = """
AF AFG afghanistan;afghan
DZ DZA algeria;algerian
AU AUS australia;australian
AZ AZE azerbaijan;azerbaijani
BD BGD bangladesh;bangladeshi
BY BLR belarus;belarusian
BR BRA brazil;brazilian
CA CAN canada;canadian
CF CAF central african republic;central african
TD TCD chad;chadian
CO COL colombia;colombian
CD COD dr congo;congolese;democratic republic of the congo
CI CIV ivory coast;ivorian;cote d'ivoire
CU CUB cuba;cuban
EG EGY egypt;egyptian
FR FRA france;french
GE GEO georgia;georgian
IN IND india;indian
IR IRN iran;iranian;islamic republic of iran;iran, islamic republic of
IQ IRQ iraq;iraqi
IE IRL ireland;irish
JO JOR jordan;jordanian
KZ KAZ kazakhstan;kazakh;kazakhstani
KG KGZ kyrgyzstan;kyrgyz
LB LBN lebanon;lebanese
LY LBY libya;libyan
ML MLI mali;malian
MX MEX mexico;mexican
MD MDA moldova;moldovan;republic of moldova;moldova, republic of
MA MAR morocco;moroccan
NZ NZL new zealand;new zealander
NI NIC nicaragua;nicaraguan
NE NER niger;nigerien
PK PAK pakistan;pakistani
PE PER peru;peruvian
RU RUS russia;russian;russian federation
SA SAU saudi arabia;saudi;saudi arabian
SN SEN senegal;senegalese
RS SRB serbia;serbian
ES ESP spain;spanish
LK LKA sri lanka;sri lankan
SD SDN sudan;sudanese
SY SYR syria;syrian;syrian arab republic
TJ TJK tajikistan;tajik
TN TUN tunisia;tunisian
TR TUR turkey;turkish;turkiye
TM TKM turkmenistan;turkmen
UA UKR ukraine;ukrainian
GB GBR united kingdom;british;great britain;uk;united kingdom of great britain and northern ireland
US USA united states;american;united states of america
UZ UZB uzbekistan;uzbek
VE VEN venezuela;venezuelan
YE YEM yemen;yemeni
DE DEU germany;german
IT ITA italy;italian
CN CHN china;chinese
IL ISR israel;israeli
SO SOM somalia;somali
NG NGA nigeria;nigerian
PS PSE palestine;palestinian
KP PRK north korea;north korean
MM MMR myanmar;burmese
AE ARE united arab emirates;emirati
KW KWT kuwait;kuwaiti
QA QAT qatar;qatari
TW TWN taiwan;taiwanese
JP JPN japan;japanese
ID IDN indonesia;indonesian
PH PHL philippines;filipino
AM ARM armenia;armenian
RW RWA rwanda;rwandan
BI BDI burundi;burundian
SS SSD south sudan;south sudanese
ER ERI eritrea;eritrean
ET ETH ethiopia;ethiopian
ZW ZWE zimbabwe;zimbabwean
HT HTI haiti;haitian
GT GTM guatemala;guatemalan
HN HND honduras;honduran
SV SLV el salvador;salvadoran
AL ALB albania;albanian
BA BIH bosnia and herzegovina;bosnian
BG BGR bulgaria;bulgarian
HR HRV croatia;croatian
PL POL poland;polish
RO ROU romania;romanian
""".strip()
_COUNTRY: dict[str, str] = {}
for _line in COUNTRIES.splitlines():
    _iso2, _iso3, _names = _line.split(" ", 2)
    for _n in (_iso2.lower(), _iso3.lower(), *_names.split(";")):
        _COUNTRY.setdefault(_n, _iso2)

_NOTHING = frozenset(("", "-", "--", ".", "?", "na", "n/a", "n.a.", "none", "null", "nil", "xx", "xxx", "tbd", "unknown", "unspecified", "not available", "not known", "not stated", "undetermined", "unk"))


def says_nothing(x: str | None) -> bool:
    return x is None or " ".join(x.split()).lower() in _NOTHING


@lru_cache(20_000)
def country(x: str) -> str | None:
    """ISO code of a country named in any of the usual ways; an unknown text stands for itself."""
    t = " ".join(_plain(x).replace("’", "'").split())
    if t in _NOTHING:
        return None
    c = _COUNTRY.get(t)
    if c is None:
        for part in (re.sub(r"\s*\(.*\)$", "", t), t.split(" / ")[0], t.split(",")[0]):
            c = c or _COUNTRY.get(part.strip())
    return c or t.upper()


def countries(field: str | None) -> list[str]:
    return sorted({c for c in map(country, field.split("|")) if c}) if field else []


_NUMBER = re.compile(r"^\s*(?:no|nr|n°|№|num|number)\s*[.:]?\s*(?=[a-z]*\d)", re.I)


@lru_cache(20_000)
def number(x: str) -> str | None:
    """A document number in upper-case letters and digits; None if it isn't usable."""
    if says_nothing(x):
        return None
    t = re.sub(r"\s*\([^()]*\)\s*$", "", _NUMBER.sub("", x))
    t = re.sub(r"[^0-9A-Z]", "", _plain(t).upper())
    return t if len(t) >= 4 and any(c.isdigit() for c in t) and len(set(t)) > 1 else None


def kind(t: str | None) -> str:
    t = (t or "").lower()
    return "p" if "pass" in t else "t" if "tax" in t or "fiscal" in t else "n" if t else ""


def id_items(field: str | None) -> list[dict]:
    """The items of an identifiers field; text that isn't a JSON array gives none."""
    if not field or "{" not in field:
        return []
    try:
        items = json.loads(field)
    except ValueError:
        return []
    return [i for i in items if isinstance(i, dict)] if isinstance(items, list) else []


def numbers(field: str | None) -> list[str]:
    """Usable document numbers, each with its kind before a colon."""
    got = {(kind(i.get("type")), number(str(i.get("value") or ""))) for i in id_items(field)}
    return sorted(f"{k}:{v}" for k, v in got if v)


@lru_cache(30_000)
def _near_number(a: str, b: str) -> bool:
    if len(a) == len(b):
        diff = [i for i in range(len(a)) if a[i] != b[i]]
        return len(diff) == 1 or (len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]])
    return abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b))))


def numbers_state(a: list[str], b: list[str]) -> int:
    """3 a number in common, 1 a number one slip away, 0 other numbers of the same kind, -1 nothing to compare."""
    if not a or not b:
        return -1
    va, vb = {x.split(":", 1)[1] for x in a}, {x.split(":", 1)[1] for x in b}
    if va & vb:
        return 3
    if any(_near_number(x, y) for x in va for y in vb):
        return 1
    return 0 if {x.split(":")[0] for x in a} & {x.split(":")[0] for x in b} else -1
