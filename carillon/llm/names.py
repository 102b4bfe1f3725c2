"""Rows that name the same person, group or organisation under several spellings.

Names are brought to one form (``textforms``) and read as a person, a duo or an ensemble. Candidates come from a
symmetric-delete index over all tokens: a token and what is left of it after up to two deletions are looked up, so
spellings within two edits meet without comparing all tokens. Names meet by a rarer token alone, and by a frequent one together
with what else they hold (``hot_keys``). A candidate pair is settled by aligning its tokens: the optimal
assignment in which each token meets an equal, mistyped, shortened or familiar form of itself. Names that give only an initial
join a person only where that person is the only one they can mean.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carillon.llm.textforms import one_form
from carillon.operators.components import connected_components
from carillon.operators.skew import HEAVY_SHARE, lookup_join
from carillon.session import StageLog, spread, width

#: A token in more names than this is no key of its own; it counts together with what else the name holds (see ``hot_keys``).
HOT = 20

# Words that make a name one of an ensemble, and the words and particles that don't tell names apart.
ENSEMBLE_WORDS = (
    "association band brass brothers chamber choir chorus collective company consort duo electric ensemble gospel group jazz "
    "orchestra philharmonic quartet quintet records singers sisters society sound street string symphony trio youth"
).split()
SYNONYMS = {"chorus": "choir", "4tet": "quartet", "qt": "quartet", "qtt": "quartet", "5tet": "quintet", "orchestre": "orchestra", "strings": "string", "quartett": "quartet", "recs": "records"}
EMPTY_WORDS = set("the of a an and der die das les los las".split())
PARTICLES = set("van von de del der den di da du dos do la le zu ter ten bin ibn al el af av".split())
SUFFIXES = {"jr": "jr", "junior": "jr", "jnr": "jr", "sr": "sr", "senior": "sr", "snr": "sr", "ii": "ii", "iii": "iii", "iv": "iv", "2nd": "ii", "3rd": "iii"}
# Familiar forms of given names, by language; more are learned from the table (``learned_forms``).
FAMILIAR = {
    # English
    "abigail": "abby gail", "albert": "al bert bertie", "alexander": "alex sandy al lex xander alec", "alexandra": "alex sandra lexi", "alfred": "alf alfie fred", "amanda": "mandy", "andrew": "andy drew", "anthony": "tony ant", "arthur": "art artie",
    "augustus": "gus", "barbara": "barb babs barbie", "benjamin": "ben benny benji", "bernard": "bernie", "catherine": "cathy cath kate katie kitty cat", "charles": "charlie chuck chas charley chip", "christina": "chris tina chrissie", "christopher": "chris kit topher",
    "clifford": "cliff", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "donald": "don donnie", "dorothy": "dot dottie dolly dora", "douglas": "doug", "edmund": "ed ned ted", "edward": "ed eddie eddy ned ted teddy",
    "eleanor": "ellie nell nelly nora", "elizabeth": "liz lizzie beth betty bess betsy eliza libby lisa", "eugene": "gene", "florence": "flo florrie", "frances": "fran fanny", "francis": "frank fran", "franklin": "frank", "frederick": "fred freddie freddy", "gabriel": "gabe",
    "gerald": "gerry jerry", "gertrude": "gertie trudy", "gregory": "greg", "harold": "harry hal", "helen": "nell nellie", "henrietta": "hattie etta hettie henny harriet", "henry": "harry hank hal", "herbert": "herb bert bertie", "isabella": "bella izzy isa", "jacob": "jake", "james": "jim jimmy jamie jem",
    "janet": "jan", "jeffrey": "jeff", "jennifer": "jen jenny", "jessica": "jess jessie", "john": "jack johnny jon", "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "jo josie jojo", "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie kitty kat kay kath", "kenneth": "ken kenny",
    "lawrence": "larry laurie lawrie", "leonard": "len lenny leo", "louis": "lou louie", "madeleine": "maddie", "margaret": "maggie meg peggy peg marge madge greta daisy rita", "martha": "marty mattie", "martin": "marty", "mary": "molly polly", "matilda": "tilda tilly mattie", "matthew": "matt", "maximilian": "max",
    "melvin": "mel", "michael": "mike mick mickey micky", "mildred": "millie", "nathaniel": "nat nate nathan", "nicholas": "nick nicky", "pamela": "pam", "patricia": "pat patty patsy tricia trish", "patrick": "pat paddy", "penelope": "penny nell pen", "peter": "pete", "philip": "phil pip", "priscilla": "cilla",
    "raymond": "ray", "rebecca": "becky becca", "reginald": "reg reggie", "richard": "rick dick rich richie ricky", "robert": "bob bobby rob robbie bert", "roland": "roly", "ronald": "ron ronnie", "rosemary": "rose rosie", "samuel": "sam sammy", "sarah": "sally sadie", "stanley": "stan", "stephen": "steve stevie",
    "susan": "sue susie suzy", "susannah": "sue susie suzy susan sanna", "terence": "terry", "theodore": "theo ted teddy", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim timmy", "valerie": "val", "veronica": "ronnie vera roni", "victoria": "vicky tori", "vincent": "vince vinnie", "virginia": "ginny", "walter": "walt wally",
    "wendell": "dell wen", "wilfred": "wilf fred", "william": "bill billy will willy willie liam", "winifred": "winnie freda freddie win", "zachary": "zach zack",
    # German, Nordic
    "augustin": "gus gustl august augie", "estelle": "stella essie", "friedrich": "fritz fred freddy fredi", "heinrich": "heinz heiner", "ingrid": "inga", "johannes": "hannes hans jo jan", "josef": "sepp jupp", "jurgen": "jorg", "mathilde": "tilda tilly mattie thilde", "rasmus": "ras",
    # Spanish, Italian, French
    "antonio": "toni tonio", "concepcion": "concha", "dolores": "lola", "enrique": "quique", "francisco": "paco pancho fran curro kiko", "giovanni": "gianni", "giuseppe": "beppe peppe peppino pino", "guadalupe": "lupe lupita", "ignacio": "nacho", "jose": "pepe", "luigi": "gigi", "paloma": "pali", "quentin": "quint",
    "rafael": "rafa", "salvatore": "toto", "tomas": "tom", "umberto": "berto",
    # Slavic and others
    "aleksandr": "sasha", "dmitri": "dima mitya mitja", "ivan": "vanya", "mikhail": "misha", "nikolai": "kolya", "oksana": "ksana oksy", "tatiana": "tanya", "vladimir": "vova volodya", "yekaterina": "katya", "yusuf": "joe",
}

#: Familiar forms are learned from rows whose name and sort name give different given names with one surname: a pair in three such
#: rows, and in one of LEARN_SHARE of them; so at most LEARN_SHARE pairs, whatever the size.
LEARN_LEAST, LEARN_SHARE = 3, 2000

_LEARNED: dict[str, frozenset[str]] = {}


@lru_cache(maxsize=1)
def _listed() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for full, short in FAMILIAR.items():
        for s in short.split():
            out.setdefault(s, set()).add(full)
    return {k: frozenset(v | {k}) for k, v in out.items()}


def means(token: str) -> frozenset[str]:
    """The given names that a token may stand for, itself included."""
    known = _listed().get(token, frozenset((token,)))
    return known | _LEARNED.get(token, frozenset())


def use_learned(pairs: Iterable[tuple[str, str]]) -> None:
    """Take learned ``(form, full)`` pairs in place of the former ones of this process."""
    out: dict[str, set[str]] = {}
    for short, full in pairs:
        out.setdefault(short, set()).add(full)
    if out != _LEARNED:
        _LEARNED.clear()
        _LEARNED.update({k: frozenset(v) for k, v in out.items()})


def fold(name: str) -> str:
    """One form, lower case, without accents."""
    return name.lower() if name.isascii() and name.isprintable() else _fold(name)


@lru_cache(maxsize=1 << 16)
def _fold(name: str) -> str:
    s = one_form(name)[0].lower().translate({ord("ø"): "o", ord("ł"): "l", ord("đ"): "d", ord("ð"): "d", ord("ı"): "i", ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("þ"): "th"})
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two tokens, or ``most + 1``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def slack(token: str) -> int:
    """Edits allowed for a token: none below four letters, one below eight, then two."""
    return 0 if len(token) < 4 else 1 if len(token) < 8 else 2


def near(a: str, b: str) -> int | None:
    most = min(slack(a), slack(b))
    d = edits(a, b, most) if a < b else edits(b, a, most)
    return d if d <= most else None


def shortens(a: str, b: str) -> bool:
    """Whether ``a`` is short for ``b``: the same first letter, its letters in their order, and some left out."""
    if not a or a[0] != b[0] or len(a) >= len(b):
        return False
    rest = iter(b)
    return all(c in rest for c in a)


# ---- reading ----


def _tokens(s: str) -> list[str]:
    return [t.replace("'", "") for t in re.findall(r"[^\W_]+(?:'[^\W_]+)*", s)]


@lru_cache(maxsize=1)
def _type_rests() -> dict[str, tuple[str, ...]]:
    """What is left of the longer ensemble words after a deletion at most -> the words."""
    out: dict[str, set[str]] = {}
    for w in ENSEMBLE_WORDS:
        if len(w) > 4:
            for d in deletions(w, 1):
                out.setdefault(d, set()).add(w)
    return {d: tuple(ws) for d, ws in out.items()}


@lru_cache(maxsize=100_000)
def _is_type(token: str, dotted: bool) -> bool:
    t = SYNONYMS.get(token, token)
    rests = _type_rests()
    # words within one edit share what is left after one deletion
    if t in ENSEMBLE_WORDS or any(near(t, w) == 1 for d in ((t, *(t[:k] + t[k + 1 :] for k in range(len(t)))) if 4 <= len(t) <= 14 else ()) for w in rests.get(d, ())):
        return True
    bare = not re.search("[aeiouy]", token)
    return len(token) > 1 and token not in SUFFIXES and (dotted or bare) and any(shortens(token, w) for w in ENSEMBLE_WORDS)


def _person(s: str) -> tuple[list[str], str]:
    """Tokens, given name first where a comma tells, and the suffix."""
    s = re.sub(r"[\"“”„«»(][^\"“”„«»)]*[\"“”„«»)]", " ", s)
    parts = [_tokens(p) for p in s.split(",")]
    suffix = ""
    for p in parts:
        while p and p[-1] in SUFFIXES and sum(map(len, parts)) > 1 and (len(p[-1]) > 1):
            suffix = SUFFIXES[p.pop()]
    parts = [p for p in parts if p]
    tokens = [t for p in (parts[1:] + parts[:1] if len(parts) > 1 else parts) for t in p]
    bare = [t for t in tokens if t not in PARTICLES]
    return (bare if len(bare) > 1 else tokens), suffix


def _duo(s: str) -> list[str] | None:
    parts = [p.strip(" ,") for p in re.split(r"\s*(?:&|\+|/|;|\band\b|\bund\b|\bwith\b|\bet\b|\bfeat\b\.?|\bft\b\.?|\s,\s)\s*", s)]
    parts = [p for p in parts if p]
    if len(parts) == 1 and len(both := re.split(r"\s(?:y|e)\s", s)) == 2:  # elsewhere a lone y or e is an initial
        parts = both
    if len(parts) == 1 and s.count(",") == 1:
        a, b = (_tokens(x) for x in s.split(","))
        if len(a) > 1 and len(b) > 1 and a[0] not in PARTICLES and not any(t in SUFFIXES or len(t) == 1 for t in b) and not any(len(t) == 1 for t in a[1:]):
            parts = [x.strip() for x in s.split(",")]
    return parts if len(parts) == 2 and all(len(_tokens(p)) > 1 for p in parts) else None


def read(name: str | None) -> tuple | None:
    """``(kind, parties)``: kind p, d or e; a party is ``(tokens, suffix)``. None for names without letters or digits."""
    if name is None:
        return None
    plain = one_form(name)[0]
    s = fold(name)
    words = re.findall(r"([^\W_]+(?:'[^\W_]+)*)(\.?)", s)
    if not words:
        return None
    kept = [(w.replace("'", ""), bool(d)) for w, d in words if w not in EMPTY_WORDS]
    last = re.findall(r"[^\W_]+", plain)[-1]
    acronym = len(kept) >= 2 and re.fullmatch(r"[A-Z]{2,3}", last) and last.lower() not in SUFFIXES and not plain.isupper() and not re.search(r"[A-Z]\.\s*[A-Z]\.?$", plain)
    if acronym or any(_is_type(t, d) for t, d in kept):
        return "e", [([t for t, _ in kept], "")]
    if parts := _duo(s):
        return "d", [_person(p) for p in parts]
    return "p", [_person(s)]


# ---- aligning ----


def assign(cost: list[list[float | None]]) -> list[int] | None:
    """For each row a column of its own, with the least sum of costs (None: they can't meet); None if there is no such way. At most
    as many rows as columns. The Hungarian method by shortest augmenting paths: rows squared times columns, any number of tokens."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if any(all(c is None for c in row) for row in cost):
        return None
    far = float("inf")
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, used = [far] * (m + 1), [False] * (m + 1)
        while True:
            used[at] = True
            row, step, to = owner[at], far, -1
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[row - 1][j - 1]
                    if c is not None and (now := c - u[row] - v[j]) < least[j]:
                        least[j], way[j] = now, at
                    if least[j] < step:
                        step, to = least[j], j
            if to < 0:
                return None
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
            if not owner[at]:
                break
        while at:
            owner[at], at = owner[way[at]], way[at]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _meet(a: str, b: str) -> tuple[float, bool] | None:
    """Cost of taking two tokens of a person for one, and whether both are written out."""
    if a == b:
        return 0.0, len(a) > 1
    if len(a) == 1 or len(b) == 1:
        return (1.0, False) if a[0] == b[0] else None
    if means(a) & means(b):
        return 0.5, True
    d = near(a, b)
    return None if d is None else (float(d), True)


#: What a token costs less that must meet one, and one that meets written out: each outweighs all that comes after it.
_MUST, _FULL = 10_000.0, 100.0


def align_person(a: tuple[list[str], str], b: tuple[list[str], str]) -> tuple[int, list[tuple[str, str]]]:
    """2: the same written out; 1: the same as far as initials tell; 0: not the same. With the tokens that met, by the optimal
    assignment: as many as possible written out, then the fewest edits. Tokens left over may only be further initials."""
    (ta, sa), (tb, sb) = a, b
    if sa != sb or not ta or not tb:
        return 0, []
    if len(ta) > len(tb):
        got, met = align_person(b, a)
        return got, [(y, x) for x, y in met]
    if sum(len(t) > 1 for t in tb) <= len(ta):
        # what is left over may be further initials, but not the one that stands for the given name
        must = [len(t) > 1 or j == 0 for j, t in enumerate(tb)]
        cost: list[list[float | None]] = []
        for i, x in enumerate(ta):
            row = [_meet(x, y) for y in tb]
            cost.append([None if m is None else m[0] + 0.01 * (i != j) - _FULL * (m[1] and max(len(x), len(tb[j])) > 2) - _MUST * must[j] for j, m in enumerate(row)])
        at = assign(cost)
        if at is not None:
            met = [_meet(x, tb[j]) for x, j in zip(ta, at)]
            full = sum(m[1] and max(len(x), len(tb[j])) > 2 for m, x, j in zip(met, ta, at))
            if full and sum(must) == sum(must[j] for j in at) and sum(m[0] for m in met) <= 3.1:
                return (2 if full >= 2 else 1), [(x, tb[j]) for x, j in zip(ta, at)]
    ca, cb = "".join(ta), "".join(tb)
    if min(len(ca), len(cb)) >= 10 and min(map(len, ta)) > 1 < min(map(len, tb)) and len(ta) != len(tb) and edits(*sorted((ca, cb)), 1) <= 1:
        return 2, []
    return 0, []


@lru_cache(maxsize=200_000)
def _meet_type(a: str, b: str) -> float | None:
    a, b = SYNONYMS.get(a, a), SYNONYMS.get(b, b)
    if a == b:
        return 0.0
    if (d := near(a, b)) is not None:
        return float(d)
    if len(a) >= 3 and len(b) >= 3 and max(len(a), len(b)) > 3 and edits(*sorted((a, b)), 1) <= 1 and a[0] == b[0]:
        return 1.0
    known = [w for w in ENSEMBLE_WORDS if shortens(*sorted((a, b), key=len)) and near(max(a, b, key=len), w) is not None]
    both_short = any(shortens(a, w) and shortens(b, w) for w in ENSEMBLE_WORDS) and a[0] == b[0]
    return 0.5 if known or both_short else None


def align_ensemble(a: list[str], b: list[str]) -> bool:
    """Whether every token finds its own in the other, or the type stands as initials on one side."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        cost: list[list[float | None]] = []
        for x in a:
            row = [_meet_type(x, y) for y in b]
            types = [c == 0.5 or _typeish(x) or _typeish(y) for c, y in zip(row, b)]
            cost.append([None if c is None or c == 0.5 and not (_typeish(x) or _typeish(y)) else c - _FULL * (not t) for c, y, t in zip(row, b, types)])
            if all(c is None for c in cost[-1]):
                break
        else:
            if (at := assign(cost)) is not None:
                took = [row[j] for row, j in zip(cost, at)]
                full = sum(c < 0 for c in took)
                if full and sum(took) + _FULL * full <= 3.5:
                    return True
    if len(a) >= 2 and len(b) - len(a) in (1, 2):
        short, rest = a[-1], a[:-1]
        n = len(b) - len(rest)
        for at in {0, len(b) - n}:
            types, places = b[at : at + n], b[:at] + b[at + n :]
            if len(short) == n and "".join(t[0] for t in types) == short and all(near(x, y) is not None for x, y in zip(rest, places)):
                return True
    ca, cb = "".join(a), "".join(b)
    return len(a) != len(b) and min(len(ca), len(cb)) >= 12 and edits(*sorted((ca, cb)), 1) <= 1


@lru_cache(maxsize=100_000)
def _typeish(t: str) -> bool:
    return _is_type(t, True)


def forms(name: str | None, sort_name: str | None) -> tuple[str, list[list[tuple[list[str], str]]]] | None:
    """The kind and the spellings that a row gives: the name's and, where it agrees with it, the sort name's, each with its
    initials completed by the other. None if neither can be read."""
    a, b = read(name), read(sort_name)
    if a is None:
        a, b = b, None
    if a is None:
        return None
    out = [a[1]]
    if b is not None and a[0] == b[0]:
        if a[0] == "e":
            if align_ensemble(a[1][0][0], b[1][0][0]):
                out.append(b[1])
        else:
            order = b[1]
            if len(order) == len(a[1]):
                pairs = [align_person(x, y) for x, y in zip(a[1], order)]
                if all(p[0] for p in pairs):
                    longer = {}
                    for k, (_, met) in enumerate(pairs):
                        longer |= {(k, x): y for x, y in met if len(x) == 1 < len(y)} | {(k, y): x for x, y in met if len(y) == 1 < len(x)}
                    done = lambda parts: [([longer.get((k, t), t) for t in toks], suf) for k, (toks, suf) in enumerate(parts)]
                    out = [done(a[1]), done(order)]
    seen, unique = set(), []
    for f in out:
        key = json.dumps(sorted((sorted(t), s) for t, s in f))
        if key not in seen:
            seen.add(key)
            unique.append(f)
    return a[0], unique


def same(a: tuple, b: tuple) -> int:
    """2: surely the same entity, 1: the same as far as initials tell, 0: different."""
    if a[0] != b[0]:
        return 0
    best = 0
    for x in a[1]:
        for y in b[1]:
            if a[0] == "e":
                got = 2 * align_ensemble(x[0][0], y[0][0])
            elif a[0] == "p":
                got = align_person(x[0], y[0])[0]
            else:  # two surnames that agree leave no doubt about initials
                got = 2 * max(min(align_person(x[0], y[0])[0], align_person(x[1], y[1])[0]) > 0, min(align_person(x[0], y[1])[0], align_person(x[1], y[0])[0]) > 0)
            best = max(best, got)
            if best == 2:
                return 2
    return best


def tokens_of(parsed: tuple) -> set[str]:
    """Tokens by which a name can be found."""
    found = {t for f in parsed[1] for toks, _ in f for t in toks}
    good = {t for t in found if len(t) > 1 and not (parsed[0] == "e" and _typeish(t))}
    return good or found


def deletions(token: str, most: int) -> set[str]:
    out = level = {token}
    for _ in range(most):
        level = {t[:k] + t[k + 1 :] for t in level for k in range(len(t))}
        out = out | level
    return out


def _letters(t: str, hot: dict[str, list[str]]) -> set[str]:
    """First letters of what a token of an ensemble may stand for."""
    return {x[0] for x in (t, SYNONYMS.get(t, t), *hot.get(t, ()), *(w for w in ENSEMBLE_WORDS if near(t, w) is not None))}


def hot_keys(parsed: tuple, hot: dict[str, list[str]]) -> set[tuple[str, int]]:
    """``(key, side)`` by which a name with a frequent token meets all that ``same`` can take for it; ``hot`` gives the frequent
    tokens within the edits of each of the name's tokens, itself included. Persons and duos: the corrected token with each other
    one, corrected or in its familiar forms. A person's initials meet what is written out (side 1 meets side 2, all else is 0).
    Ensembles: the corrected token with the first letters of all others. Joined letters less one, for tokens written as one."""
    kind, out = parsed[0], set()
    for form in parsed[1]:
        for toks, _ in form:
            whole = "".join(toks)
            if len(whole) >= 10 and any(t in hot for t in toks) and (kind == "e" or min(map(len, toks)) > 1):
                out |= {(f"{kind}={d}", 0) for d in deletions(whole, 1)}
        toks = [t for party, _ in form for t in party]
        if kind == "e":
            for k, t in enumerate(toks):
                rest = [_letters(u, hot) for u in toks[:k] + toks[k + 1 :]] if t in hot else []
                ways = [rest, [*rest[:-1], *toks[-1]]] if rest and k < len(toks) - 1 and 2 <= len(toks[-1]) <= 3 else [rest]
                out |= {(f"e|{h}|{''.join(sorted(x))}", 0) for h in hot.get(t, ()) for way in ways for x in product(*way)}
            continue
        full, initials = [t for t in toks if len(t) > 1], {t for t in toks if len(t) == 1}
        for k, t in enumerate(full):
            others = full[:k] + full[k + 1 :]
            for h in hot.get(t, ()):
                for u in others:
                    out |= {("|".join((kind, *sorted((h, x)))), 0) for x in means(u).union(hot.get(u, ()))}
                if kind == "d":
                    continue
                if others:
                    out |= {(f"p|{h}|1{u[0]}", 2) for u in others} | {(f"p|{h}|2{min(u[0], i)}{max(u[0], i)}", 0) for u in others for i in initials}
                else:
                    out |= {(f"p|{h}|", 0)} | {(f"p|{h}|1{i}", 1) for i in initials}
    return out


# ---- in Spark ----


def _with(pairs: list[tuple[str, str]], run):
    """``run`` in workers that know the learned pairs."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_learned(pairs)
        yield from run(batches)

    return known


def _other_givens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``short, full``: given names that stand for one person in a row, neither an initial nor a mistyping of the other."""
    for b in batches:
        found = []
        for name, sort_name in zip(b.column("name").to_pylist(), b.column("sort_name").to_pylist()):
            x, y = read(name), read(sort_name)
            if x and y and x[0] == y[0] == "p":
                (t, s), (u, r) = x[1][0], y[1][0]
                if s == r and len(t) == len(u) == 2 and t[1] == u[1] and min(len(t[0]), len(u[0])) > 1 and t[0][-2:] != t[1][-2:] and near(t[0], u[0]) is None:
                    found.append(tuple(sorted((t[0], u[0]), key=lambda w: (len(w), w))))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["short", "full"])


def learned_forms(rows: DataFrame) -> list[tuple[str, str]]:
    """Pairs of given names that the table's own rows show to be forms of one: the shorter one stands for the longer. Only rows whose
    name and sort name differ in more than order and case reach Python. At most LEARN_SHARE pairs come to the driver."""
    bag = lambda c: F.array_sort(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}]+", " ")), " "))
    other = rows.where((F.trim("name") != "") & (F.trim("sort_name") != "") & (bag("name") != bag("sort_name"))).select("name", "sort_name")
    counts = other.mapInArrow(_other_givens, "short string, full string").groupBy("short", "full").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    kept = counts.withColumn("total", total).where((F.col("n") >= LEARN_LEAST) & (F.col("n") * LEARN_SHARE >= F.col("total")))
    return sorted((r[0], r[1]) for r in kept.select("short", "full").collect())


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, marked, cls, toks = [], [], [], []
        for i, m, name, sort_name in zip(*(b.column(c).to_pylist() for c in ("id", "marked", "name", "sort_name"))):
            got = forms(name, sort_name)
            if got is not None:
                ids.append(i)
                marked.append(m)
                cls.append(json.dumps(got, separators=(",", ":"), sort_keys=True))
                toks.append(sorted(tokens_of(got)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marked, pa.bool_()), pa.array(cls, pa.string()), pa.array(toks, pa.list_(pa.string()))], ["id", "marked", "cls", "toks"])


def _deletes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, toks, hot = [], [], []
        for t, h in zip(b.column("token").to_pylist(), b.column("hot").to_pylist()):
            d = deletions(t, slack(t))
            left += d
            toks += [t] * len(d)
            hot += [h] * len(d)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(toks, pa.string()), pa.array(hot, pa.bool_())], ["rest", "token", "hot"])


def _hot_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cs, keys, sides = [], [], []
        for c, cls, met in zip(*(b.column(x).to_pylist() for x in ("c", "cls", "met"))):
            got = hot_keys(json.loads(cls), {m["token"]: m["hots"] for m in met})
            cs += [c] * len(got)
            keys += [k for k, _ in got]
            sides += [s for _, s in got]
        yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(keys, pa.string()), pa.array(sides, pa.int32())], ["c", "key", "side"])


def _verify_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [near(x, y) is not None for x, y in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist())]
        yield b.filter(pa.array(keep, pa.bool_()))


def _verify_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    load = lru_cache(maxsize=20_000)(json.loads)
    for b in batches:
        got = [same(load(x), load(y)) for x, y in zip(b.column("cls_a").to_pylist(), b.column("cls_b").to_pylist())]
        full = [[all(len(t) > 1 for f in load(x)[1] for toks, _ in f for t in (toks[0], toks[-1])) for x in b.column(c).to_pylist()] for c in ("cls_a", "cls_b")]
        out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(got, pa.int32()), pa.array(full[0], pa.bool_()), pa.array(full[1], pa.bool_())], ["a", "b", "got", "full_a", "full_b"])
        yield out.filter(pa.array([g > 0 for g in got], pa.bool_()))


def link_names(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """``id, entity, marked``: for rows of ``id, name, sort_name, musicbrainz_id``, the least id that names the same entity; rows that
    stand alone are their own; ``marked`` rows have a ``musicbrainz_id``. Null or unreadable names are left out (a readable sort name
    stands in); equal spellings are one; repeated rows count once; two rows that both carry a ``musicbrainz_id`` are different ones
    (see ``same_entity_pairs``). Names of any number of tokens are aligned; other columns aren't read; empty tables give no rows."""
    spark = rows.sparkSession
    log = StageLog(spark)
    asked = rows.where("id is not null").select(F.col("id").cast("bigint").alias("id"), (F.coalesce(F.trim("musicbrainz_id"), F.lit("")) != "").alias("marked"), "name", "sort_name")
    asked = spread(asked)
    learned = learned_forms(asked)
    parsed = log.stage(asked.mapInArrow(_with(learned, _parse), "id bigint, marked boolean, cls string, toks array<string>"), "p2-parsed")
    classes = log.stage(parsed.groupBy("cls").agg(F.min("id").alias("c"), F.max("marked").alias("marked"), F.first("toks").alias("toks")), "p2-classes")
    tokens = classes.select("c", F.explode("toks").alias("token"))
    counted = log.stage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "p2-tokens")
    # tokens within their edits of each other
    every = counted.select("token", (F.col("df") > hot).alias("hot"))
    deletes = log.stage(every.repartition(width(spark), "token").mapInArrow(_deletes, "rest string, token string, hot boolean"), "p2-deletes")
    met = deletes.select("rest", F.col("token").alias("t1"), F.col("hot").alias("h1")).join(deletes.select("rest", F.col("token").alias("t2"), F.col("hot").alias("h2")).hint("merge"), "rest").where("t1 < t2").drop("rest").distinct()
    met = log.stage(met.mapInArrow(_verify_tokens, "t1 string, h1 boolean, t2 string, h2 boolean"), "p2-met")
    # a token in few names is a key of its own: names meet under it and under those within its edits; at most ``hot`` names a key
    home = log.stage(tokens.join(every.where("not hot").select("token"), "token").select("c", F.col("token").alias("key")), "p2-keyed")
    close = met.where("not h1 and not h2")
    one = close.select(F.col("t1").alias("to"), F.col("t2").alias("key")).unionByName(close.select(F.col("t2").alias("to"), F.col("t1").alias("key")))
    by_key = home.unionByName(one.join(home, "key").select("c", F.col("to").alias("key")))
    pairs = by_key.select(F.col("c").alias("x"), "key").join(home.select(F.col("c").alias("y"), "key").hint("merge"), "key")
    # names with a frequent token, or one within its edits, meet by it and what else they hold
    hots = every.where("hot").select("token", F.col("token").alias("h")).unionByName(met.where("h1").select(F.col("t2").alias("token"), F.col("t1").alias("h"))).unionByName(met.where("h2").select(F.col("t1").alias("token"), F.col("t2").alias("h")))
    hots = log.stage(hots.groupBy("token").agg(F.collect_set("h").alias("hots")), "p2-hots")
    n_tokens = counted.agg(F.sum("df")).first()[0] or 0
    heavy = counted.where(F.col("df") > max(10_000, n_tokens // HEAVY_SHARE)).select("token")  # at most HEAVY_SHARE tokens
    touched = lookup_join(tokens, hots, "token", heavy).groupBy("c").agg(F.collect_list(F.struct("token", "hots")).alias("met"))
    extra = touched.join(classes.select("c", "cls").hint("merge"), "c").mapInArrow(_with(learned, _hot_keys), "c bigint, key string, side int")
    extra = log.stage(extra.select("c", F.xxhash64("key").alias("key"), "side"), "p2-extra")
    at = lambda side, c: extra.where(F.col("side") == side).select("key", F.col("c").alias(c))
    pairs = pairs.unionByName(at(0, "x").join(at(0, "y").hint("merge"), "key").where("x < y")).unionByName(at(1, "x").join(at(2, "y").hint("merge"), "key"))
    pairs = log.stage(pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "p2-pairs")
    side = lambda c: classes.select(F.col("c").alias(c), F.col("cls").alias(f"cls_{c}"), F.col("marked").alias(f"marked_{c}"))
    held = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where("substring(cls_a, 1, 4) = substring(cls_b, 1, 4) and not (marked_a and marked_b)")
    edges = log.stage(held.select("a", "b", "cls_a", "cls_b").repartition(width(spark)).mapInArrow(_with(learned, _verify_names), "a bigint, b bigint, got int, full_a boolean, full_b boolean"), "p2-edges")
    comp = connected_components(edges.where("got = 2").select(F.col("a").alias("src"), F.col("b").alias("dst")), log=log)
    # names with initials only: where all that they can mean is one component, they join it; where there is none, each other
    both = edges.where("got = 1")
    vague = both.select(F.col("a").alias("v"), F.col("b").alias("o"), F.col("full_a").alias("v_full"), F.col("full_b").alias("o_full")).unionByName(both.select(F.col("b").alias("v"), F.col("a").alias("o"), F.col("full_b").alias("v_full"), F.col("full_a").alias("o_full")))
    vague = vague.join(comp.select(F.col("node").alias("o"), "root"), "o", "left").withColumn("root", F.coalesce("root", "o"))
    meant = vague.where("not v_full and o_full").groupBy("v").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    joined = meant.where("least = most").select("v", F.col("least").alias("dst"))
    free = vague.where("not v_full and not o_full").join(meant.select("v"), "v", "left_anti").join(meant.select(F.col("v").alias("o")), "o", "left_anti").select("v", F.col("root").alias("dst"))
    # only the components that such names join are run again, as one node each
    more = joined.unionByName(free).join(comp.select(F.col("node").alias("v"), F.col("root").alias("src")), "v", "left").select(F.coalesce("src", "v").alias("src"), "dst")
    again = connected_components(more, log=log)
    final = parsed.select("id", "cls", "marked").join(classes.select("cls", "c"), "cls").join(comp.select(F.col("node").alias("c"), "root"), "c", "left").select("id", "marked", F.coalesce("root", "c").alias("one"))
    final = final.join(again.select(F.col("node").alias("one"), "root"), "one", "left").select("id", F.coalesce("root", "one").alias("entity"), "marked")
    final = log.stage(final.dropDuplicates(["id"]), "p2-entities")
    log.close(final)
    return final


def same_entity_pairs(rows: DataFrame) -> DataFrame:
    """``id_a, id_b``: all pairs of rows of one entity, the smaller id first; of two rows with a ``musicbrainz_id`` never."""
    found = link_names(rows)
    a, b = found.toDF("id_a", "entity", "m_a"), found.toDF("id_b", "entity", "m_b")
    return a.join(b, "entity").where("id_a < id_b and not (m_a and m_b)").select("id_a", "id_b")
