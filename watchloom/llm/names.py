"""Name kernel shared by the matching operators: folding, tokens, token similarity.

Pure Python, called from Arrow batches.  Every function is total: ``None`` and
blank text give an empty token list, and nothing depends on the row order.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ү": "y", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "υ": "u", "χ": "x", "γ": "y", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "օ": "o", "ս": "u", "հ": "h",
    "ո": "n", "ց": "g", "զ": "q", "Տ": "S", "Լ": "L", "Օ": "O", "Ս": "U",
}
del LOOKALIKES["З"]

# Romanisation of Cyrillic, Arabic and Greek letters.
ROMAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i",
    "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t",
    "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "",
    "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "yi", "є": "ye", "ґ": "g", "ў": "u", "ј": "j", "ѕ": "s",
    "ا": "a", "أ": "a", "إ": "i", "آ": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh",
    "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z",
    "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ک": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h",
    "ة": "a", "و": "u", "ي": "i", "ی": "i", "ى": "a", "ء": "", "ئ": "i", "ؤ": "u", "پ": "p", "چ": "ch",
    "گ": "g", "ژ": "zh", "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th",
    "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s",
    "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}

# Forms of address and particles that carry no identity.
TITLES = frozenset(
    "mr mrs ms miss dr prof sir haji hajj hajji hadji sheikh shaikh sheik maulvi mawlawi mullah mulla molla lic don doña dona "
    "ing eng col gen capt maj syed sayyid sayed hon rev ustad qari alhaj monsieur madame mme bay bayan sr sra".split()
)
PARTICLES = frozenset("al el de del la los las da do dos van von bin ibn ben bint the ul ould ait di du le".split())

# Given names that stand for one another (spellings, languages, nicknames); the first is the key.
GIVEN = """
muhammad mohammed mohammad mohamad mohamed muhamad md mehmet mohd mukhammad
ahmed ahmad ahmet akhmed
abdullah abdallah abdulla abdalla abdulah abdoulaye
hussein hossein hussain husayn huseyin huseyn hosein
hassan hasan
ali aly
omar umar omer umer
osman usman ousmane uthman othman
yusuf youssef yousef yusif yousuf joussef
ibrahim ebrahim ibrahima ibraheem
mustafa moustafa mostafa mustapha moustapha
khalid khaled
walid waleed oualid
tariq tarek tarik tareq
qasim kassem qassem kasim qasem
faisal feisal faysal faysel
nasser nasir naser
salim saleem
saeed said sayeed saied
jamal djamal gamal
karim kareem
hamza hamzah
zakariya zakaria zakariyya
idris idrees
bilal belal
mansour mansur
rashid rasheed
hamid hameed
majid majeed
bashir basheer
basir baseer
fahim faheem
nadim nadeem
wasim waseem
navid naveed
shahid shaheed
tahir taher
irfan erfan
asif aasif
iqbal eqbal
javed jawed javaid javid
ghulam gholam golam
rahman rehman
aziz azeez
ghani gani
mojtaba mujtaba
mohsen muhsin
mehdi mahdi
masoud masud massoud
davoud dawood davood daud dawud
kourosh kurosh
behrouz behruz
reza riza rida
suleiman suleyman sulaiman soleiman
ramazan ramadan
kemal kamal
murat murad
seydou saidou
moussa musa mousa
amadou amadu
mamadou mamadu
fatima fatma fatimah
khadija khadijah hatice
mariam maryam maryama mariama miriam
amina emine aminah
aisha aisha ayşe ayse aysha
zaynab zeynep zeynab zainab
layla leila laila leyla
noor nour nur
huda houda
samira sameera
soraya soraiya
roya roia
parvaneh parvane
parvin parveen
nasrin nasreen
niloufar nilufar
sergei sergey serhiy seryozha sergej sergii
andrei andrey andriy andryusha andrej
alexei alexey aleksey aleksei oleksiy alyosha
nikolai nikolay mykola kolya nikolaj
dmitry dmitri dmitriy dmytro dima dmitrii
grigory grigoriy hryhoriy grisha
anatoly anatoliy anatolii tolya
yuri yury iurii yura yuriy jurij
yevgeny evgeniy evgeny yevhen zhenya evgenii
mikhail michail mykhailo misha mihail
vladimir volodymyr wladimir volodya vova
ivan iwan vanya
pavel pavlo pasha
maksim maxim max
konstantin kostiantyn kostya
viktor victor vitya
boris borys borya
leonid lyonya leonyd
aleksandr alexander oleksandr sasha alex aleksander
alejandro
tatiana tatyana tetiana tanya
natalia natalya nataliya natasha
olga olha olya
irina iryna ira
svetlana svitlana sveta
yekaterina ekaterina kateryna katya
anastasia anastasiya nastya
elena olena yelena lena
alexandra aleksandra
jose josé pepe
luis luiz
jesus jesús chuy
juan juancho
francisco paco pancho
eduardo lalo
fernando nando
guillermo memo
joaquin quino
rafael rafa
sebastian sebas
guadalupe lupe
dolores lola
concepcion concha
mercedes meche
isabel ysabel
rosario charo
teresa tere
enrique quique
ignacio nacho
manuel manolo
ramon moncho
maria mari
james jim jimmy jamie
william bill will billy
robert bob rob bobby
richard dick rick rich
thomas tom tommy
michael mike mick
joseph joe
edward ed ted eddie
daniel dan danny
charles charlie chuck
christopher chris
anthony tony
nicholas nicolas nick
stephen steven steve
geoffrey jeffrey geoff jeff
lawrence laurence larry
jonathan jonathon jon
benjamin ben
margaret maggie peggy meg
elizabeth elisabeth liz beth betty
katherine catherine kathryn kate kathy
jennifer jen jenny
rebecca becky rebekah
deborah debra deb debbie
patricia pat patty trish
susan sue suzan
victoria vicky
theodore théodore theo teddy
francois françois
helene hélène lena
beatrice béatrice bea
jeanpierre
jeanbaptiste
habibullah habiballah
gholamali ghulamali
alireza
emmanuel manu
etienne étienne
genevieve geneviève
desire désiré
alphonse
aminata
fatoumata fatumata
hector
andres andrés
carlos
roman
salman
imran
akram
zahid
bahram
farhad
orhan
ayhan
rubina
shazia
shabnam
tahira
farzana
saima
kausar
yasmin yasmine jasmin
shirin shireen
farideh farida
mahnaz
elif
gulsen gülşen
habib
basit
latif lateef
karim kareem
rahim raheem
qadir kadir
""".strip()
_GIVEN: dict[str, str] = {}


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().replace("ı", "i")


for _line in GIVEN.splitlines():
    _words = [_plain(w) for w in _line.split()]
    for _w in _words:
        _GIVEN.setdefault(_w, _words[0])

_COMPOUND = {("gholam", "ali"), ("ghulam", "ali"), ("ali", "reza"), ("jean", "pierre"), ("jean", "baptiste"), ("habib", "ullah"), ("habib", "allah")}
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_SPLIT = re.compile(r"[^\w]+|_+")
_APOS = re.compile(r"['’‘`´ʼʹ]")


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "L" if c.isalpha() else ""
    if 0x370 <= o < 0x400:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x600 <= o < 0x780 or 0xFB50 <= o < 0xFE00:
        return "A"
    return "X" if c.isalpha() else ""


@lru_cache(30_000)
def _latin_token(t: str) -> str:
    """One token in plain lower-case Latin letters and digits."""
    scripts = {_script(c) for c in t} - {""}
    if scripts - {"L"}:
        if "L" in scripts or all(_script(c) in "" or c in LOOKALIKES for c in t):
            t = "".join(LOOKALIKES.get(c, c) for c in t)
        t = "".join(ROMAN.get(c, c) for c in t.lower())
    return "".join(c for c in _plain(t) if c.isalnum())


def tokens(name: str | None) -> list[str]:
    """Ordered plain tokens of a name without titles and particles; compounds are joined."""
    if not name:
        return []
    s = unicodedata.normalize("NFKC", _INVISIBLE.sub("", name))
    raw = [x for x in (_latin_token(t) for t in _SPLIT.split(_APOS.sub("", s)) if t) if x]
    out: list[str] = []
    i = 0
    while i < len(raw):
        t = raw[i]
        if t in ("abd", "abdul", "abdel", "abdal", "abdur", "abdol", "abdool"):
            j = i + 1
            while j < len(raw) - 1 and raw[j] in ("al", "el", "ul", "ar", "ur"):
                j += 1
            if j < len(raw):
                out.append("abd" + raw[j])
                i = j + 1
                continue
        elif t[:5] in ("abdul", "abdel", "abdal", "abdur", "abdol") and len(t) > 7 and t not in ("abdullah", "abdallah", "abdulla", "abdalla"):
            out.append("abd" + re.sub(r"^([a-z])\1", r"\1", t[5:]) if t[4] != "r" or t[5] == "r" else "abd" + t[5:])
            i += 1
            continue
        out.append(t)
        i += 1
    kept = [t for t in out if t not in TITLES and t not in PARTICLES] or [t for t in out if t not in TITLES] or out
    merged: list[str] = []
    for t in kept:
        if merged and (merged[-1], t) in _COMPOUND:
            merged[-1] += t
        else:
            merged.append(t)
    return merged


_PHON = [
    (re.compile(a), b)
    for a, b in (
        (r"^(?:el|al)(?=[bcdfghjklmnpqrstvwxyz].{5})", ""), (r"ou(?=[aeiou])", "w"), (r"^(?:mac|mc)(?=.{4})", "mk"), (r"(?<=[oe])ff$", "v"), (r"ph", "f"),
        (r"sch|shch|tch|ch|sh|kh$", "s"), (r"ck|q|kh", "k"), (r"gh", "g"), (r"dj|dzh|zh", "j"), (r"x", "ks"), (r"ts|tz", "s"),
        (r"th", "t"), (r"c(?=[eiy])", "s"), (r"c", "k"), (r"w", "v"), (r"z", "s"), (r"ou|oo|u", "u"), (r"ee|ie|iy|yi|y|ei|ey", "i"),
        (r"aa", "a"), (r"(.)\1+", r"\1"), (r"(?<=.{3})(?:h|e)$", ""),
    )
]


# Digits typed in the place of letters.
_LEET = str.maketrans("01345789", "oieastbg")


@lru_cache(30_000)
def phon(t: str) -> str:
    """A spelling-tolerant form of a token: variant letter groups are merged, doubles collapsed."""
    if not t.isalpha() and any(c.isalpha() for c in t):
        t = t.translate(_LEET)
    for pat, rep in _PHON:
        t = pat.sub(rep, t)
    return t


@lru_cache(30_000)
def key(t: str) -> str:
    """The token's class: a given-name class, or the consonant skeleton of its phonetic form."""
    g = _GIVEN.get(t)
    if g:
        return "=" + g
    if t.startswith("abd") and t[3:] in _GIVEN:
        return "=abd" + _GIVEN[t[3:]]
    p = phon(t)
    return (p[:1] + re.sub(r"[aeiouhv]", "", p[1:])) if len(p) > 3 else p


@lru_cache(30_000)
def given(t: str) -> str | None:
    k = key(t)
    return k if k[:1] == "=" else None


def osa(a: str, b: str, limit: int) -> int:
    """Edit distance with swaps of neighbours; ``limit + 1`` when it is larger."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > limit:
        return limit + 1
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j = 0
    while j < len(a) and j < len(b) and a[-1 - j] == b[-1 - j]:
        j += 1
    if j:
        a, b = a[:-j], b[:-j]
    la, lb = len(a), len(b)
    if not la or not lb:
        return min(la + lb, limit + 1)
    prev2: list[int] = []
    prev = list(range(lb + 1))
    for i in range(1, la + 1):
        cur = [i] + [0] * lb
        ca = a[i - 1]
        for j in range(1, lb + 1):
            cb = b[j - 1]
            d = prev[j - 1] if ca == cb else 1 + min(prev[j - 1], prev[j], cur[j - 1])
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                d = min(d, prev2[j - 2] + 1)
            cur[j] = d
        if min(cur) > limit:
            return limit + 1
        prev2, prev = prev, cur
    return min(prev[lb], limit + 1)


@lru_cache(40_000)
def token_sim(a: str, b: str) -> float:
    """Similarity of two tokens in 0..1."""
    if a == b:
        return 1.0
    if a > b:
        return token_sim(b, a)
    if len(a) == 1 or len(b) == 1:
        if a[0] == b[0]:
            return 0.85
        ga, gb = given(a) or a, given(b) or b
        return 0.85 if ga.lstrip("=")[0] == gb.lstrip("=")[0] else 0.0
    ga, gb = given(a), given(b)
    if ga and gb:
        return 0.97 if ga == gb else 0.2
    pa, pb = phon(a), phon(b)
    n = max(len(pa), len(pb))
    d = osa(pa, pb, max(1, n // 3))
    raw = 1 - osa(a, b, max(1, max(len(a), len(b)) // 3)) / max(len(a), len(b))
    s = max(1 - d / n - (0.02 if d == 0 else 0.0), raw)
    if (ga or gb) and s < 0.99:
        g = (ga or gb).lstrip("=")
        o = b if ga else a
        s = max(s if s >= 0.75 else 0.3, 0.9 if osa(g.removeprefix("abd"), o.removeprefix("abd"), 1) <= 1 and len(o) > 4 else 0.0)
    return s if s > 0.4 else 0.0


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Monge-Elkan similarity: each token of the shorter list with its best partner, weighted by length."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    left = list(b)
    total = weight = 0.0
    for t in sorted(a, key=lambda x: (-len(x), x)):
        best, who = 0.0, None
        for u in left:
            s = token_sim(t, u)
            if s > best:
                best, who = s, u
        if best >= 0.6 and who is not None:
            left.remove(who)
        w = min(len(t), 8) if len(t) > 1 else 1
        total += w * best
        weight += w
    return total / weight


@lru_cache(30_000)
def _split_name(t: tuple[str, ...]) -> tuple[int, tuple[str, ...]]:
    """Index of the family name, -1 if there is none to tell, and the other names in order."""
    at = max((i for i, x in enumerate(t) if len(x) > 2 and not given(x) and x not in _WEAK), key=lambda i: (len(t[i]), t[i]), default=-1)
    return at, tuple(x for i, x in enumerate(t) if i != at and x not in _WEAK)


_WEAK = frozenset(("khan", "khane", "han"))


def name_parts(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, float, float]:
    """(match, family, given): how well two names can be spellings of one another, each in 0..1.

    The Monge-Elkan similarity, refined by the agreement of the family names and of the first given
    name: relatives share the family name, and often a second name.  Neighbouring tokens of one side count as
    one where that makes the other side's family name, or all of its letters.
    """
    best = _parts(a, b)
    if best[1] >= 0.9 or len(a) + len(b) < 3:
        return best
    for x, y in ((a, b), (b, a)):
        j, _ = _split_name(y)
        if len(x) < 2 or not y:
            continue
        family = y[j]
        for i in range(len(x) - 1):
            glued = x[i] + x[i + 1]
            if abs(len(glued) - len(family)) > 2 or token_sim(glued, family) < 0.87:
                continue
            whole = x[:i] + (glued,) + x[i + 2 :]
            if len(whole) == 1 and len(y) == 1:
                got = (token_sim(glued, family),) * 2 + (1.0,)
            else:
                got = _parts(whole, y)
            best = max(best, got)
    return best


def _parts(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, float, float]:
    s = monge_elkan(list(a), list(b))
    if s < 0.55:
        return s, 0.0, 0.0
    i, ra = _split_name(a)
    j, rb = _split_name(b)
    if i < 0 or j < 0:
        same = i < 0 and j < 0 and sorted(map(key, a)) == sorted(map(key, b))
        return (s, 1.0, 1.0) if same else (min(s, 0.6), 0.0, 0.0)
    fam = token_sim(a[i], b[j])
    if fam < 0.9 and len(a) != len(b) and sorted("".join(a)) == sorted("".join(b)):
        return 0.95, 0.95, 1.0  # one side's name is split or glued
    if fam < 0.7:
        return min(s, 0.5), fam, 0.0
    if not ra or not rb:
        return min(s, 0.7), fam, 0.0
    return max(_others(s, fam, x, y) for x in _less_m(ra) for y in _less_m(rb))


def _less_m(rest: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Other names, also without a leading ``m``: it may stand for a name left out on the other side."""
    return [rest, rest[1:]] if rest[0] == "m" and len(rest) > 1 else [rest]


def _others(s: float, fam: float, ra: tuple[str, ...], rb: tuple[str, ...]) -> tuple[float, float, float]:
    first = token_sim(ra[0], rb[0])
    if first >= 0.75:
        rest = 1.0
        if len(ra) > 1 and len(rb) > 1:
            rest = max(token_sim(x, y) for x in ra[1:] for y in rb[1:])
        g = first if rest >= 0.6 else 0.8 * first
    elif len(ra) > 1 and len(rb) > 1 and all(max(token_sim(x, y) for y in rb) >= 0.75 for x in ra[:2]) and all(max(token_sim(x, y) for x in ra) >= 0.75 for y in rb[:2]):
        g = 0.9
    else:
        return min(s, 0.6), fam, first
    return min(1.0, 0.5 * fam + 0.5 * g), fam, g


def name_match(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    return name_parts(a, b)[0]


@lru_cache(30_000)
def given_class(t: str) -> str:
    """The class of a token that isn't the family name: its given name's, also when one slip away, or its own key."""
    k = key(t)
    if k[:1] == "=" or len(t) < 5:
        return k
    best = min((v for v in _BY_START.get(t[0], ()) if abs(len(v) - len(t)) <= 1 and osa(v, t, 1) <= 1), default=None)
    return "=" + _GIVEN[best] if best else k


_BY_START: dict[str, list[str]] = {}
for _v in _GIVEN:
    if len(_v) >= 4:
        _BY_START.setdefault(_v[0], []).append(_v)
