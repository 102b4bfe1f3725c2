"""One form for texts that look the same.

A longest-match transducer runs over the grapheme clusters of a text. Its table is made by rule from the Unicode character data
(widths, composed accents, spaces, ligatures, invisible characters) and from one list of look-alike letters, and it is checked: no
source has two targets, and no target holds a source. Look-alikes depend on their word, so they are held back and settled at the
word's end, with the same table. What a cluster becomes is kept, and a text that changed is read again until nothing changes, so the
form of a form is itself. Texts of plain ASCII, which are most, never reach Python.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that a reader takes for Latin ones.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTXaesijopcyxhdqw")) | {"У": "Y", "ӏ": "l", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "ү": "y"}
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορ", "ABEZHIKMNOPTYXvop")) | {"ϳ": "j", "Ϳ": "J", "ϲ": "c", "Ϲ": "C", "ι": "i", "α": "a"}
ARMENIAN = {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L"}
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"))
LATIN_LIKE = {"ı": "i", "ɑ": "a", "ɡ": "g", "ǀ": "l", "ʜ": "H"}
HYPHENS = {"‐": "-", "‑": "-", "﹣": "-", "－": "-"}
APOSTROPHES = {"’": "'", "ʼ": "'", "＇": "'"}
#: A curly apostrophe is usual in print: it gets the common form but is no finding.
USUAL = {"’"}
FILLERS = {"͏", "ᅟ", "ᅠ", "ㅤ", "ﾠ", "឴", "឵"}

_SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU")
_LETTERS = dict(zip(_SCRIPTS, (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU)))


@lru_cache(maxsize=8192)
def script(ch: str) -> str:
    """The script of a letter; '' for anything else."""
    return unicodedata.name(ch, "").split(" ")[0].split("-")[0] if ch.isalpha() else ""


def _same_look(ch: str) -> bool:
    tag = unicodedata.decomposition(ch).partition(" ")[0]
    cp = ord(ch)
    return tag in ("<wide>", "<narrow>", "<font>", "<noBreak>") or tag == "<compat>" and (0xFB00 <= cp <= 0xFB17 or 0x2160 <= cp <= 0x217F or 0x1C4 <= cp <= 0x1CC or 0x1F1 <= cp <= 0x1F3 or cp in (0x132, 0x133, 0x17F))


@lru_cache(maxsize=1)
def mapping() -> dict[str, tuple[str, str]]:
    """Source sequence -> (target, kind). Checked for conflicts."""
    out: dict[str, tuple[str, str]] = {}

    def put(src: str, dst: str, kind: str) -> None:
        if out.setdefault(src, (dst, kind))[0] != dst:
            raise ValueError(f"two targets for {src!r}")

    for src, dst in HYPHENS.items():
        put(src, dst, "look")
    for src, dst in APOSTROPHES.items():
        put(src, dst, "usual" if src in USUAL else "look")
    for src, dst in LATIN_LIKE.items():
        if src != "ı":  # Turkish dotless i is a usual letter of its own
            put(src, dst, "look")
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Cs", "Co") or ch in out:
            continue
        if ch in FILLERS or cat == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180E or 0xE0100 <= cp <= 0xE01EF:
            put(ch, "", "invisible")
        elif cat in ("Zs", "Zl", "Zp") or cp == 0x85:
            put(ch, " ", "space")
        elif _same_look(ch):
            put(ch, unicodedata.normalize("NFC", unicodedata.normalize("NFKC", ch)), "width")
        elif (nfd := unicodedata.normalize("NFD", ch)) != ch:
            nfc = unicodedata.normalize("NFC", ch)
            if nfc != ch:
                put(ch, nfc, "width" if len(nfc) == 1 else "accent")
            elif len(nfd) > 1 and not 0xAC00 <= cp <= 0xD7A3:
                put(nfd, ch, "accent")
                half = unicodedata.decomposition(ch)
                if half and not half.startswith("<"):
                    put("".join(chr(int(x, 16)) for x in half.split()), ch, "accent")
    # letters of other scripts, with their accents: settled by their word
    for table in _LETTERS.values():
        for src, dst in table.items():
            put(src, dst, "alike")
    for cp in range(0x370, 0x590):
        ch = chr(cp)
        base, *marks = unicodedata.normalize("NFD", ch)
        if marks and ch not in out and base in out and out[base][1] == "alike" and len(dst := unicodedata.normalize("NFC", out[base][0] + "".join(marks))) == 1:
            put(ch, dst, "alike")
    for ch in "\t\n\r\x0b\x0c":
        put(ch, " ", "space")
    for cp in (*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F):
        put(chr(cp), "", "invisible")
    # a target that holds a source is rewritten until none does
    for src, (dst, kind) in list(out.items()):
        for _ in range(4):
            new = "".join(out[c][0] if c in out and out[c][1] != "alike" else c for c in dst)
            if new == dst:
                break
            dst = new
        out[src] = (dst, kind)
    for src, (dst, _) in out.items():
        if any(c in out and out[c][1] != "alike" for c in dst):
            raise ValueError(f"the target of {src!r} isn't settled")
    return out


@lru_cache(maxsize=1)
def transducer() -> dict:
    """The mapping as a trie: code point -> node, with the target under ''."""
    root: dict = {}
    for src, hit in mapping().items():
        if hit[1] == "alike":
            continue
        node = root
        for ch in src:
            node = node.setdefault(ch, {})
        node[""] = hit
    return root


@lru_cache(maxsize=1)
def alike() -> dict[str, str]:
    """Letters of other scripts -> the Latin ones they look like."""
    return {src: dst for src, (dst, kind) in mapping().items() if kind == "alike"}


@lru_cache(maxsize=1)
def _back() -> dict[str, dict[str, str]]:
    """Of each other script: Latin letters -> the letters that look like them, the first named."""
    return {s: {v: k for k, v in reversed(table.items())} for s, table in _LETTERS.items()}


#: Plain runs (but their last character, which what follows may change), else grapheme clusters.
_CLUSTERS = regex.compile(r"[ -~]+(?=[ -~]|$)|\X")


@lru_cache(maxsize=1 << 16)
def cluster(text: str) -> tuple[str, frozenset[str]]:
    """What one grapheme cluster becomes, and the kinds of characters found in it."""
    trie, kinds = transducer(), set()
    for _ in range(6):
        out, k, n = [], 0, len(text)
        while k < n:
            node, j, hit, end = trie, k, None, k + 1
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    hit, end = node[""], j
            if hit is None:
                out.append(text[k])
            else:
                if hit[1] != "usual":
                    kinds.add(hit[1])
                out.append(hit[0])
            k = end
        plain = "".join(out)
        new = unicodedata.normalize("NFC", plain)
        if new != plain:
            kinds.add("accent")
        if new == text:
            break
        text = new
    return text, frozenset(kinds)


def _settle(word: str, latin_text: bool, strict_in_text: set[str]) -> tuple[str, bool]:
    """A word's look-alikes: to Latin, or to the one other script that the word surely has. With whether anything was mixed."""
    like = alike()
    letters = [(c, script(c)) for c in word if c.isalpha()]
    scripts = {s for _, s in letters}
    other = scripts & set(_SCRIPTS)
    if not other:
        return word, False
    strict = {s for c, s in letters if s in _SCRIPTS and c not in like}
    if not strict:
        if "LATIN" in scripts or len(other) > 1 or latin_text and not other & strict_in_text:
            return "".join(like.get(c, c) for c in word), True
        return word, False
    if len(strict) == 1 and len(scripts) > 1:
        (s,) = strict
        back = _back()[s]
        done = "".join(c if script(c) in ("", s) else back.get(like.get(c, c), c) for c in word)
        return done, True
    return word, False


_WORDS = regex.compile(r"[\p{L}\p{N}\p{M}']+")


def _pass(text: str) -> tuple[str, set[str]]:
    kinds: set[str] = set()
    out: list[str] = []
    for m in _CLUSTERS.finditer(text):
        g = m.group()
        if g.isascii() and g.isprintable():
            out.append(g)
            continue
        got, found = cluster(g)
        kinds |= found
        if got and out and unicodedata.combining(got[0]):  # what stood between it and its letter is gone
            before = out.pop()
            joined, _ = cluster(before[-1] + got)
            kinds.add("accent")
            out += [before[:-1], joined]
        elif got:
            out.append(got)
    whole = "".join(out)
    scripts = {(script(c), c in alike()) for c in whole if not c.isascii()}
    if any(s in _SCRIPTS for s, _ in scripts):
        latin = any("a" <= c <= "z" or "A" <= c <= "Z" for c in whole) or any(s == "LATIN" for s, _ in scripts)
        strict = {s for s, like in scripts if s in _SCRIPTS and not like}

        def settled(m) -> str:
            word, mixed = _settle(m.group(), latin, strict)
            if mixed:
                kinds.add("look")
            return word

        whole = _WORDS.sub(settled, whole)
    return whole, kinds


def one_form(text: str) -> tuple[str, tuple[str, ...]]:
    """The common form, and the kinds of characters that were found: width, accent, space, invisible, look."""
    if text.isascii() and text.isprintable():
        return text, ()
    kinds: set[str] = set()
    for _ in range(8):
        got, found = _pass(text)
        kinds |= found
        if got == text:
            break
        text = got
    return text, tuple(sorted(kinds))


FORM_TYPE = T.StructType([T.StructField("form", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


@F.pandas_udf(FORM_TYPE)
def _forms(s: pd.Series) -> pd.DataFrame:
    got = [one_form(x) if x is not None else (None, None) for x in s]
    return pd.DataFrame({"form": [g[0] for g in got], "kinds": [None if g[1] is None else list(g[1]) for g in got]})


def needs_look(text: Column) -> Column:
    """Whether a text holds anything but printable ASCII, told in the JVM."""
    return text.rlike(r"[^\x20-\x7e]")


def with_forms(df: DataFrame, text: str, form: str = "form", kinds: str = "kinds") -> DataFrame:
    """``df`` with the common form of ``text`` and the kinds of unusual characters found in it.

    Null stays null in both; an empty text gives itself and no kinds; texts of any length are read whole; equal texts give equal
    forms; all other columns are kept, but one named as ``form`` or ``kinds`` is replaced. The form of a form is itself.
    """
    t, tmp = F.col(text), "__carillon_forms"
    rest = df.where(t.isNull() | ~needs_look(t)).withColumns({form: t, kinds: F.when(t.isNotNull(), F.array().cast("array<string>"))})
    odd = df.where(needs_look(t)).withColumn(tmp, _forms(t)).withColumns({form: F.col(f"{tmp}.form"), kinds: F.col(f"{tmp}.kinds")}).drop(tmp)
    return rest.unionByName(odd)
