"""Personal information in free text: found, and replaced by typed placeholders.

Addresses of mail, telephone and house and the numbers a state gives to a person have forms of their own and are read by pattern.
Names have none: a surname is whatever reveals a person. So for each word that stands beside a given name or an initial the
whole corpus tells how strongly it does so: the share of its occurrences that stand there, and the bits by which it narrows down
whose name it is (the entropy of the initials beside all words, less the entropy of those beside it). Greetings and verbs follow
anybody's name and reveal no one; a surname follows a few. The bits are asked only of words that are mostly written small where no
name stands, or that don't end full names: a surname stays one however many bear it. Spans of the known artists' surnames, and spans whose word exceeds the
thresholds, are findings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carillon.llm.names import EMPTY_WORDS, FAMILIAR, PARTICLES, fold, read
from carillon.operators.skew import HEAVY_SHARE, heavy_keys, lookup_join
from carillon.session import StageLog, spread, width

#: Words by which less than this share of their occurrences, or of the texts that hold them, stand beside a given name or an
#: initial reveal no one, unless they are surnames of known artists.
SHARE = 0.25
#: Bits about the person that a word which is written small elsewhere or doesn't end names must give, unless it is so rare that bits can't be told.
BITS = 0.8
RARE = 3
#: A token in at least one of so many persons' names is a given name: at most a few times this number of them, whatever the size.
GIVEN_SHARE = 2000

#: Bits, as a power of two, of the bitmap of texts with findings: 16 MB, whatever their number.
MARKS = 27
#: Bytes of the bitmap of rare given names, whatever their number.
BITMAP = 1 << 17

_S = r"[    \n.\-‐-―/]"
_LOCAL = r"[^\W_](?:[\w.%+\-]*[^\W_])?"
_LABEL = r"[^\W_](?:[^\W_]|-)*(?<!-)"
_DOT = r"(?:\.|\s*[\[({]\s*(?:dot|punkt|punto|point)\s*[\])}]\s*)"
_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zéro|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve"
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’\-][^\W\d_]+)*"

EMAIL = re.compile(
    rf"(?<![\w.%+\-]){_LOCAL}(?:@\s?|＠|&#64;|\s@\s|\s*[\[({{]\s*(?:at|arroba)\s*[\])}}]\s*){_LABEL}(?:{_DOT}{_LABEL})+(?![^\W_])"
    rf"|(?<![\w.%+\-]){_LOCAL}(?:\s+dot\s+{_LOCAL})*\s+(?:at|arroba)\s+{_LABEL}(?:\s+(?:dot|punto)\s+{_LABEL})+(?![^\W_])(?!\s+(?:at|arroba)\s)",
    re.IGNORECASE,
)
PHONE = re.compile(
    rf"(?<![\w+])(?<![\d][.\-/])(?:"
    rf"\+\d{{1,3}}{_S}?\(0\){_S}?\d{{2,5}}{_S}\d{{3,8}}(?:{_S}\d{{2,5}})?"
    rf"|\+33{_S}?\d(?:{_S}\d\d){{4}}|0\d(?:[  .\-]\d\d){{4}}"
    rf"|(?:\+|00)(?!1\b)\d{{2}}{_S}\d{{2,4}}{_S}\d{{3,4}}{_S}\d{{3,4}}"
    rf"|(?:\+1{_S}?)?(?:\(\d{{3}}\){_S}?|\d{{3}}{_S})\d{{3}}{_S}\d{{4}}(?:\s*(?:ext\.?|x|#)\s*\d{{1,5}})?"
    rf"|0\d{{2,4}}/\d{{4,7}}(?:{_S}\d{{2,4}})?"
    rf"|0\d{{2,4}}{_S}\d{{3,4}}{_S}\d{{3,4}}"
    rf"|(?:\+34{_S}?)?[6789]\d\d{_S}\d{{3}}{_S}\d{{3}}"
    rf"|(?:\+|00)\d{{9,14}}"
    rf"|\+\d{{1,3}}(?:{_S}?\(?\d{{1,5}}\)?){{2,4}}"
    rf"|0\d{{2,4}}{_S}\d{{6,8}}"
    rf")(?!\w)(?![.\-/]\d)",
    re.IGNORECASE,
)
SPELLED = re.compile(rf"\b(?:(?:{_WORDS})[ ,\-]+){{6,14}}(?:{_WORDS})\b", re.IGNORECASE)
# What a text must hold before the costly patterns are tried.
_AT = re.compile(r"[@＠]|&#64;|[\[({]\s*(?:at|arroba)\b", re.IGNORECASE)
_SIX, _SEVEN = (re.compile(rf"\d(?:[^\w\n]{{0,3}}\n?\d){{{n}}}") for n in (5, 6))
_AT_OR_WORD = re.compile(rf"{_AT.pattern}|\b(?:at|arroba)\b", re.IGNORECASE)
_NUMBER_WORDS = frozenset(map(fold, _WORDS.split("|")))
#: An address of mail has 254 characters at most; written out, with blanks, it may be longer.
MAIL_REACH = 400
_G = r"[  .\-‐-―/]"
ID_NUMBER = re.compile(
    rf"(?<![\w])(?<!\d[.\-/])(?:"
    rf"(?P<nino>[A-Za-z]{{2}}{_G}?\d\d{_G}?\d\d{_G}?\d\d{_G}?[A-Da-d])"
    rf"|(?P<nie>[XYZxyz]{_G}?\d{{7}}{_G}?[A-Za-z])"
    rf"|(?P<dni>\d{{8}}(?:-?[A-Za-z]|[  ][A-Z]))"
    rf"|(?P<nir>[12]{_G}?\d\d{_G}?\d\d{_G}?\d\d{_G}?\d{{3}}{_G}?\d{{3}}(?:{_G}?\d\d)?)"
    rf"|(?P<steuer>\d\d[ /.\-]\d{{3}}[ /.\-]\d{{3}}[ /.\-]\d{{3}})"
    rf"|(?P<ssn>\d{{3}}[ \-.‐-―]\d\d[ \-.‐-―]\d{{4}})"
    rf"|(?P<digits>\d{{9}}|\d{{11}})"
    rf"|(?P<passport>[A-Za-z]{{1,2}}[  \-]?\d{{7}})"
    rf")(?!\w)(?![.\-/]\d)"
)
# What stands before numbers of records, discs and orders, and before those of persons.
_RECORD = re.compile(r"(?:\b(?:cat(?:alogue|alog|\.)?(?:\s*no\.?)?|barcode|gtin|ean|upc|isrc|matrix|order|disc id|session|reel|box|build|offset|frames?|price|release|group|rows|points)\b[\s:.=#]*|[=@#/]|\d{4}[-/]\d\d[-/]\d\d\s)$", re.IGNORECASE)
_STATE = re.compile(r"(?:ssn|social sec\w*|security|sécurité sociale|steuer\w*|tax|fiscal\w*|ausweis\w*|pass(?:port|eport|nummer)?|pasaporte|reisepass\w*|identi\w*|insurance|\bNI\b|\bNIE\b|\bDNI\b|\bID\b|\bgave\b)(?:\s+n(?:o|r|um)?\.)?[^.!?\n]{0,24}$", re.IGNORECASE)
_STATE_AFTER = re.compile(r"^[^.!?\n]{0,12}\b(?:tax id|ssn|social security|passport)", re.IGNORECASE)
_STREET = "Street|St|Road|Rd|Lane|Ln|Hill|Mews|Terrace|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Close|Court|Ct|Place|Pl|Square|Sq|Way|Row|Gardens|Crescent|Walk|Grove|Yard|Parade"
_UNIT = r"(?:,?\s(?:Apt|Flat|Unit|Suite|Apartment)\.?\s?\w{1,4}|,?\s#\s?\w{1,4})?"
_PLACE = rf"(?:,?[ \n]{_CAP}(?:[ ,]{{1,2}}(?:[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}|\d{{5}}))|,[ ]{_CAP}(?=[.,;!?)\n]|$| last\b))?"
_FROM = rf"(?:,?[ \n]\d{{5}}[ ]{_CAP})?"
ADDRESS = re.compile(
    rf"(?<![\w.#/\-])(?:"
    rf"\d{{1,4}}[A-Za-z]?(?:\s?[\-–/]\s?\d{{1,4}}[A-Za-z]?)?,?\s(?:(?:North|South|East|West|[NSEW]\.)\s)?(?:{_CAP}\s){{1,3}}?(?:{_STREET})\b\.?(?!\s(?:Singers|Band|Choir|Records|Quartet)){_UNIT}{_PLACE}"
    rf"|\d{{1,4}}\s?(?:bis|ter|quater|[A-Za-z])?,?\s(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Bb]d|[Ii]mpasse|[Qq]uai|[Pp]lace|[Cc]hemin|[Aa]llée|[Cc]ours|[Pp]assage|[Ss]quare|[Rr]oute)\s(?:de la |de l['’]|de |du |des |d['’])?{_CAP}{_FROM}"
    rf"|(?:Calle|C/|Avenida|Avda\.?|Av\.|Paseo|Plaza|Pza\.?|Camino|Carretera|Ronda|Travesía|Glorieta)\s?(?:de la |de los |de las |de |del )?{_CAP},?\s(?:n\.?\s?º\s?|nº\s?|núm\.?\s?)?\d{{1,4}}[A-Za-z]?(?:,\s\d+\.?º\s?\w)?{_FROM}"
    rf"|(?:Via|Viale|Piazza|Corso|Largo|Vicolo)\s(?:(?:del|della|dei|delle|di)\s|dell['’])?(?:{_CAP}\s){{0,2}}{_CAP},?\s\d{{1,4}}[A-Za-z]?\b{_FROM}"
    rf"|(?:Am|Im|An der|An den|Auf der|Auf dem|Zum|Zur|In der|Unter den)\s{_CAP}\s\d{{1,4}}\s?[a-z]?\b{_FROM}"
    rf"|{_CAP}?(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer)\s\d{{1,4}}[a-z]?\b{_FROM}"
    rf"|{_CAP}[ \-](?:Straße|Strasse|Str\.|Gasse|Weg|Allee|Platz|Ring|Damm|Ufer)\s\d{{1,4}}[a-z]?\b{_FROM}"
    rf")"
)
_BESIDE = re.compile(r"(?<![^\W\d_])(?=[^\Wa-z\d_])([^\W\d_]+(?:['’][^\W\d_]+)*)(?=\.?[  \"“(”)]+[^\W\d_])|(?<=,[  ])(?=[^\Wa-z\d_])([^\W\d_]+(?:['’][^\W\d_]+)*)")
_GAP, _COMMA, _BLANK = re.compile(r"\.?[ \u00a0]|\.?[ \u00a0][\"“(]|[\"”)][ \u00a0]").fullmatch, re.compile(r",[ \u00a0]").fullmatch, re.compile(r"[ \u00a0]").fullmatch
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
KINDS = ("email", "phone", "id_number", "address", "name")


def _around(text: str, anchors: re.Pattern, reach: int) -> Iterator[tuple[int, int]]:
    """Stretches of a text within ``reach`` of an anchor, joined where they touch."""
    start = end = -1
    for m in anchors.finditer(text):
        if m.start() - reach > end:
            if end >= 0:
                yield start, min(end, len(text))
            start = max(0, m.start() - reach)
        end = m.end() + reach
    if end >= 0:
        yield start, min(end, len(text))


def typed(text: str, low: list[str] | None = None) -> list[tuple[str, int, int]]:
    """Findings with a form of their own, left to right, none over another: mail first, then addresses, numbers of persons, telephones.
    ``low``: the folded words of the text, if they are known."""
    taken: list[tuple[str, int, int]] = []

    def put(kind: str, a: int, b: int) -> None:
        if all(b <= x or a >= y for _, x, y in taken):
            taken.append((kind, a, b))

    said = words_of(text)[1] if low is None else low
    spelled = sum(map(_NUMBER_WORDS.__contains__, said)) >= 7
    in_words = ("at" in said or "arroba" in said) and ("dot" in said or "punto" in said)
    for a, b in _around(text, _AT_OR_WORD if in_words else _AT, MAIL_REACH):
        for m in EMAIL.finditer(text, a, b):
            put("email", *m.span())
    digits = any(map(text.__contains__, "0123456789")) or not text.isascii() and re.search(r"\d", text)
    if not digits and not spelled:
        return sorted(taken, key=lambda x: x[1])
    for m in ADDRESS.finditer(text) if digits else ():
        put("address", *m.span())
    for m in ID_NUMBER.finditer(text) if digits and _SIX.search(text) else ():
        before, how = text[max(0, m.start() - 48) : m.start()], m.lastgroup
        if _RECORD.search(before):
            continue
        state = bool(_STATE.search(before) or _STATE_AFTER.search(text[m.end() : m.end() + 30]))
        if how in ("digits", "passport") and not state:
            continue
        put("id_number", *m.span())
    numbers = [*PHONE.finditer(text)] if digits and _SEVEN.search(text) else []
    for m in numbers + ([*SPELLED.finditer(text)] if spelled else []):
        n = sum(map(str.isdigit, m.group()))
        if n and not 7 <= n <= 15:
            continue
        if not _RECORD.search(text[max(0, m.start() - 20) : m.start()]):
            put("phone", *m.span())
    return sorted(taken, key=lambda x: x[1])


def _case(w: str) -> str:
    return "u" if len(w) > 1 and w.isupper() else "t" if w[:1].isupper() else "l"


def words_of(text: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """The words of a text with their places, and their folded forms."""
    words = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]
    return words, [fold(w) for w, _, _ in words]


def name_spans(text: str, given: frozenset[str], familiar: frozenset[str], taken: list[tuple[str, int, int]], rare: frozenset[str] = frozenset(), read: tuple[list, list] | None = None) -> Iterator[tuple[int, int, str, str]]:
    """``(start, end, word, initial)`` for each place where a given name or an initial stands with a word that may be a surname:
    given name, further initials, particles, word; or word, comma, given name. ``rare`` given names count in capitals, and where
    they stand after a given name they may be surnames."""
    words, low = read or words_of(text)
    blocked = [False] * len(words)
    k = 0
    for _, a, b in taken:
        while k < len(words) and words[k][2] <= a:
            k += 1
        while k < len(words) and words[k][1] < b:
            blocked[k] = True
            k += 1
    gap = lambda i: text[words[i][2] : words[i + 1][1]]
    free = lambda i: not blocked[i] and (words[i][1] == 0 or text[words[i][1] - 1] not in "@#/_") and text[words[i][2] : words[i][2] + 1] not in ("@", "_", "/")

    def is_given(i: int) -> bool:
        return low[i] in given or low[i] in familiar and words[i][0][0].isupper()

    after = 0
    for i in (k for k, (w, _, _) in enumerate(words) if low[k] in given or low[k] in familiar or low[k] in rare or len(w) == 1):
        w, a, b = words[i]
        initial = len(w) == 1 and w.isupper() and text[b : b + 1] == "."
        if i < after or not free(i) or not (initial or is_given(i) or low[i] in rare and w[0].isupper()):
            continue
        case, j = _case(w), i
        # forward
        while j + 1 < len(words) and _GAP(gap(j)) and free(j + 1):
            j += 1
            x = words[j][0]
            if len(x) == 1 and x.isupper() or low[j] in PARTICLES or (gap(j - 1)[-1] in "\"“" and j + 1 < len(words) and gap(j)[0] in "\"”"):
                continue
            if gap(j - 1).startswith(".") and len(words[j - 1][0]) > 1:
                break
            # a name in capitals stands beside one that isn't, as it is written on sleeves
            fits = _case(x) == case or case in "tu" and _case(x) in "tu"
            if len(x) >= (3 if initial or _case(x) != "t" else 2) and fits and not is_given(j):
                yield a, words[j][2], low[j], low[i][0]
                after = j + 1
            break
        # reversed, with a comma
        if i >= after and i > 0 and _COMMA(gap(i - 1)) and free(i - 1) and not is_given(i - 1):
            x = words[i - 1][0]
            if initial and len(x) >= 3 and _case(x) in "tu":
                yield words[i - 1][1], b + 1, low[i - 1], low[i][0]
            elif not initial and len(x) >= (2 if _case(x) == "t" else 3) and (_case(x) == case or case == "t" and _case(x) == "u") and low[i - 1] not in PARTICLES:
                h = i - 1
                while h > 0 and low[h - 1] in PARTICLES and _BLANK(gap(h - 1)) and free(h - 1):
                    h -= 1
                yield words[h][1], b, low[i - 1], low[i][0]


def _person_tokens(artists: DataFrame, log: StageLog) -> DataFrame:
    """``t, n, last``: how often a token stands as a given name and as the last token of the persons in ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for name in b.column("name").to_pylist():
                got = read(name)
                if got and got[0] in "pd":
                    found += [(t, k == len(toks) - 1) for toks, _ in got[1] if len(toks) > 1 for k, t in enumerate(toks) if len(t) > 2]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.bool_())], ["t", "at_end"])

    counts = spread(artists.select("name").where("name is not null")).mapInArrow(run, "t string, at_end boolean").groupBy("t").agg(F.count_if(~F.col("at_end")).alias("n"), F.count_if("at_end").alias("last"))
    return log.stage(counts, "p8-tokens")


def _given_names(counts: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """The frequent given names told from the persons' tokens (bounded by GIVEN_SHARE; ``_rare_names`` are the others), and the
    familiar forms known beforehand."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    learned = {r[0] for r in counts.where(F.col("n") >= max(3, total // GIVEN_SHARE)).select("t").collect()}
    short = {s for v in FAMILIAR.values() for s in v.split()}
    return frozenset(learned | set(FAMILIAR) - short), frozenset(short)


def _rare_names(counts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``t``: all given names below GIVEN_SHARE, of any number: tokens that stand as given names three times, or more often than as
    surnames. And a bitmap of fixed size of them, by which most other words are told apart without a join."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    rare = counts.where((F.col("n") > 0) & (F.col("n") < max(3, total // GIVEN_SHARE)) & ((F.col("n") >= 3) | (F.col("n") > F.col("last")))).where(~F.col("t").isin(*PARTICLES, *EMPTY_WORDS)).select("t")
    at = F.crc32(F.encode("t", "utf-8")).bitwiseAND(F.lit(8 * BITMAP - 1))
    part = rare.select(at.alias("at")).selectExpr("int(at div 32) as k", "shiftleft(1L, int(at % 32)) as b").groupBy("k").agg(F.bit_or("b").alias("b"))
    bitmap = np.zeros(BITMAP // 4, "<u4")
    for k, b in part.collect():  # at most BITMAP / 4 rows
        bitmap[k] = b
    return rare, bitmap


SPAN_NAMES = ["doc_id", "kind", "start_at", "end_at", "word", "ini", "small", "after"]
SPAN_TYPES = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_())


def find(docs: DataFrame, artists: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, bits: float = BITS) -> DataFrame:
    """``doc_id, kind, start_at, end_at``: all findings. Null and empty texts have none; texts are read whole; repeated texts have
    theirs each; ids should be unique, rows with a null id are left out. ``artists`` gives the known persons."""
    log = StageLog(docs.sparkSession)
    counts = _person_tokens(artists, log)
    given, familiar = _given_names(counts)

    rare, bitmap = _rare_names(counts)

    def asked(text: str) -> set[str]:
        """Words beside another in capitals that may be rare given names, by the bitmap."""
        words = {fold(m.group(1) or m.group(2)) for m in _BESIDE.finditer(text)} - given - familiar
        return {w for w in words if bitmap[(at := zlib.crc32(w.encode()) & (8 * BITMAP - 1)) >> 5] >> (at & 31) & 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            totals, smalls, texts_with = Counter(), Counter(), Counter()
            settled = b.column("rare").to_pylist() if "rare" in b.schema.names else None
            for k, (doc, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())):
                if settled is None and (words := asked(text)):  # read once its words are settled
                    rows += [(doc, "ask", None, None, w, None, None, None) for w in words]
                    continue
                read = words_of(text)
                taken = typed(text, read[1])
                rows += [(doc, kind, a, e, None, None, None, None) for kind, a, e in taken]
                totals.update(read[1])
                smalls.update(x for (w, _, _), x in zip(*read) if w.islower())
                texts_with.update(set(read[1]))
                spans = name_spans(text, given, familiar, taken, frozenset(settled[k] if settled else ()), read)
                rows += [(doc, "name", a, e, w, g, text[a:e].islower(), "," not in text[a:e] and not text[a:e].islower()) for a, e, w, g in spans]
            # all words of the batch, counted: occurrences, those written small, texts
            rows += [(texts_with[w], "word", n, smalls[w], w, None, None, None) for w, n in totals.items()]
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, SPAN_TYPES)], SPAN_NAMES)

    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = "doc_id bigint, kind string, start_at int, end_at int, word string, ini string, small boolean, after boolean"
    spans = log.stage(spread(texts).mapInArrow(run, kinds), "p8-first")
    asks = spans.where("kind = 'ask'").select("doc_id", F.col("word").alias("t"))
    known_rare = lookup_join(asks, rare.withColumn("hit", F.lit(True)), "t", heavy_keys(asks, "t", asks.count()), "left")
    known_rare = known_rare.groupBy("doc_id").agg(F.collect_set(F.when(F.col("hit"), F.col("t"))).alias("rare"))
    again = log.stage(texts.join(known_rare, "doc_id").repartition(width(docs.sparkSession)).mapInArrow(run, kinds), "p8-again")
    spans = spans.where("kind <> 'ask'").unionByName(again)
    names = spans.where("kind = 'name'")
    # how often each word stands beside a name, and beside whose
    beside = names.groupBy("word", "ini").agg(F.count(F.lit(1)).alias("n"))
    all_ini = beside.groupBy("ini").agg(F.sum("n").alias("n"))
    h_all, n_all = all_ini.agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"), F.sum("n")).first()
    h_all, n_all = h_all or 0.0, n_all or 0
    stats = beside.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))
    places = names.groupBy("word").agg(F.count_if("small").alias("small_here"), F.count_if("after").alias("after"), F.count_distinct("doc_id").alias("docs_here"))
    # all occurrences, those written small, and the texts that hold the word, as the reading of the texts counted them by batches
    total = spans.where("kind = 'word'").groupBy("word").agg(F.sum(F.col("start_at").cast("bigint")).alias("total"), F.sum(F.col("end_at").cast("bigint")).alias("small"), F.sum("doc_id").alias("docs"))
    known = counts.where("last > n").select(F.col("t").alias("plain"), F.lit(True).alias("known"))
    judged = stats.join(places, "word").join(total, "word", "left").withColumn("plain", F.translate("word", "'’", "")).join(known, "plain", "left")
    judged = judged.withColumn("gain", h_all - F.col("h") - (F.col("k") - 1) / (2 * F.col("n") * F.log(F.lit(2.0))))
    common = F.coalesce(2 * (F.col("small") - F.col("small_here")) > F.col("total"), F.lit(False))  # mostly small where no name stands
    after = F.col("after") >= share * F.col("n")  # as the last word of full names; a greeting stands before a name and a comma
    often = F.col("n") >= share * F.coalesce("total", "n")
    told = often & ((F.col("n") <= RARE) | (F.col("gain") >= bits))
    known = F.coalesce("known", F.lit(False))
    named = known | after & (often | (F.col("docs_here") >= share * F.coalesce("docs", "docs_here")))
    judged = judged.withColumn("whole", F.coalesce(told | ~common & named, F.lit(False)))
    kept = judged.where(F.col("whole") | known).select("word", "n", "whole")  # else a known surname's spans in capitals only
    kept = log.stage(kept, "p8-kept")
    heavy = kept.where(F.col("n") > max(10_000, n_all // HEAVY_SHARE)).select("word")  # at most HEAVY_SHARE words
    sure = lookup_join(names, kept.select("word", "whole"), "word", heavy).where("whole or not small").select("doc_id", "kind", "start_at", "end_at")
    found = spans.where("kind not in ('name', 'word')").select("doc_id", "kind", "start_at", "end_at").unionByName(sure).dropDuplicates(["doc_id", "kind", "start_at"])
    found = log.stage(found, "p8-findings")
    log.close(found)
    return found


def replace(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_findings``: each text with placeholders such as ``[EMAIL]`` in place of its findings; texts without
    findings, null ones too, come out unchanged. Of overlapping findings the one that starts first stands."""
    per = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_at", "end_at", "kind"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                out, at, n = [], 0, 0
                for s in spans or ():
                    if text is not None and s["start_at"] >= at:
                        out += [text[at : s["start_at"]], f"[{s['kind'].upper()}]"]
                        at, n = s["end_at"], n + 1
                texts.append(None if text is None else "".join(out) + text[at:])
                counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["doc_id", "text", "n_findings"])

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # a bitmap of fixed size lets all other texts pass where they are
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MARKS)) + 1
    marks = per.select(F.bitmap_bucket_number(slot).alias("_b"), F.bitmap_bit_position(slot).alias("_p")).groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_m"))
    byte = "cast(conv(hex(substring(_m, cast(_q div 8 as int) + 1, 1)), 16, 10) as int)"
    asked = base.withColumn("_b", F.bitmap_bucket_number(slot)).withColumn("_q", F.bitmap_bit_position(slot)).join(F.broadcast(marks), "_b", "left")
    asked = asked.select("doc_id", "text", F.coalesce(F.expr(f"shiftright({byte}, cast(_q % 8 as int)) & 1 = 1"), F.lit(False)).alias("_may"))
    changed = asked.where("_may").select("doc_id", "text").join(per, "doc_id", "left").mapInArrow(run, "doc_id bigint, text string, n_findings int")
    return asked.where("not _may").select("doc_id", "text", F.lit(0).alias("n_findings")).unionByName(changed)
