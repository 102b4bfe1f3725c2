"""Nested records to flat, linked tables.

Each text is parsed once, as a stream: the parser walks it in document order, goes only into members that lead to a wanted field,
passes over all others without keeping them, and gives path-value-ordinal triples; no tree of the text is built (a list in which
nothing further is repeated is read as one piece). Paths that share a
repeated ancestor form one group, and each group is pivoted into one table. Which ancestors are repeated, and which members their
records have, is found from all texts (``repeated``). A record's triples never leave its row, so the pivot needs no shuffle: rows
come out of the scan's own tasks, whatever the size.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carillon.session import spread


@dataclass(frozen=True)
class Group:
    """One repeated ancestor, and so one table.

    ``path``: names from the parent's record to the list. ``fields``: dotted names below the record that become columns.
    ``known``: names by which an object is a record itself and not an object whose members are records. ``scalar``: the field
    that a plain value in the place of a record fills, or None if plain values give no row. ``need``: the field that must be
    present and not blank for a row to come out.
    """

    name: str
    path: tuple[str, ...]
    fields: tuple[str, ...]
    known: frozenset[str] = frozenset()
    scalar: str | None = None
    need: str | None = None
    #: Whether a list can stand here; if not, an object is always a record itself.
    repeated: bool = True
    groups: tuple[Group, ...] = field(default=())


class Unreadable(ValueError):
    """The text isn't one whole JSON document: cut off, with text after it, with a member twice, or with NaN or infinity."""


def _refuse(name: str):
    raise Unreadable(name)


def _members(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Unreadable("a member twice")
    return out


_SPACE = re.compile(r"[ \t\n\r]*").match
_TOKEN = re.compile(r"[ \t\n\r]*(?:([{}\[\],:])|(\")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null))", re.ASCII)
_VALUE = json.JSONDecoder(parse_constant=_refuse, object_pairs_hook=_members).scan_once
_PLAIN = json.JSONDecoder().scan_once
_STRING = json.decoder.scanstring


def _space(t: str, at: int) -> int:
    return _SPACE(t, at).end()


def events(t: str, at: int = 0) -> Iterator[tuple[str, object, int]]:
    """``(kind, value, end)`` of one value's tokens, at any depth: kinds ``{ } [ ]`` for containers, ``key`` and ``leaf``."""
    stack: list[str] = []
    names: list[set[str]] = []
    wanted = "value"
    while True:
        m = _TOKEN.match(t, at)
        if m is None:
            raise Unreadable("no token")
        at, sign = m.end(), m.group(1)
        if m.group(2) and wanted in ("key", "key or }"):
            try:
                name, at = _STRING(t, at)
            except ValueError as e:
                raise Unreadable(str(e)) from None
            if name in names[-1]:
                raise Unreadable("a member twice")
            names[-1].add(name)
            at = _space(t, at)
            if t[at : at + 1] != ":":
                raise Unreadable("no colon")
            at += 1
            yield "key", name, at
            wanted = "value"
            continue
        if wanted in ("value", "value or ]") and (sign is None or sign in "{["):
            if sign is not None:
                stack.append(sign)
                names.append(set())
                yield sign, None, at
                wanted = "key or }" if sign == "{" else "value or ]"
                continue
            if m.group(2):
                try:
                    value, at = _STRING(t, at)
                except ValueError as e:
                    raise Unreadable(str(e)) from None
            else:
                value = json.loads(m.group(3))
            yield "leaf", value, at
        elif sign == "," and wanted == "next":
            wanted = "key" if stack[-1] == "{" else "value"
            continue
        elif stack and sign == ("}" if stack[-1] == "{" else "]") and wanted in ("next", "key or }", "value or ]"):
            stack.pop()
            names.pop()
            yield sign, None, at
        else:
            raise Unreadable("a token out of place")
        if not stack:
            return
        wanted = "next"


_SCALAR = re.compile(r'"[^"\\\x00-\x1f]*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null').match
_KEY = re.compile(r'"([^"\\\x00-\x1f]*)"[ \t\n\r]*:[ \t\n\r]*').match
_COLON = re.compile(r"[ \t\n\r]*:[ \t\n\r]*").match
_NEXT = re.compile(r"[ \t\n\r]*([,}\]])[ \t\n\r]*").match
_OPEN = re.compile(r"[{\[][ \t\n\r]*").match


def read_value(t: str, at: int):
    """The value at a place, and its end. Values nested too deep for the scanner give their text."""
    try:
        return _VALUE(t, at)
    except StopIteration:
        raise Unreadable("no value") from None
    except RecursionError:
        end = at
        for _, _, end in events(t, at):
            pass
        return t[at:end], end
    except Unreadable:
        raise
    except ValueError as e:
        raise Unreadable(str(e)) from None


def pass_over(t: str, at: int) -> int:
    """The end of the value at a place, which isn't kept."""
    m = _SCALAR(t, at)
    return m.end() if m else read_value(t, at)[1]


def walk_object(t: str, at: int) -> Iterator[list]:
    """``[name, at, end]`` of each member of the object that begins at ``at``, then ``[None, at, end]``. The caller sets ``end`` where it
    has read the value; else the value is passed over."""
    at = _OPEN(t, at).end()
    if t[at : at + 1] == "}":
        yield [None, at, at + 1]
        return
    seen = set()
    while True:
        m = _KEY(t, at)
        if m:
            name, at = m.group(1), m.end()
        else:
            try:
                name, at = _STRING(t, at + 1) if t[at : at + 1] == '"' else (None, at)
            except ValueError as e:
                raise Unreadable(str(e)) from None
            m = _COLON(t, at)
            if name is None or m is None:
                raise Unreadable("no member")
            at = m.end()
        if name in seen:
            raise Unreadable("a member twice")
        seen.add(name)
        member = [name, at, None]
        yield member
        m = _NEXT(t, pass_over(t, at) if member[2] is None else member[2])
        if m is None or m.group(1) == "]":
            raise Unreadable("no comma")
        if m.group(1) == "}":
            yield [None, m.start(1), m.start(1) + 1]
            return
        at = m.end()


def walk_array(t: str, at: int) -> Iterator[list]:
    """``[position, at, end]`` of each item from 1, then ``[None, at, end]``; as ``walk_object``."""
    at = _OPEN(t, at).end()
    if t[at : at + 1] == "]":
        yield [None, at, at + 1]
        return
    k = 0
    while True:
        k += 1
        item = [k, at, None]
        yield item
        m = _NEXT(t, pass_over(t, at) if item[2] is None else item[2])
        if m is None or m.group(1) == "}":
            raise Unreadable("no comma")
        if m.group(1) == "]":
            yield [None, m.start(1), m.start(1) + 1]
            return
        at = m.end()


def roots(text: str | None, holds: str, wrappers: tuple[str, ...], enter: dict, reset=lambda: None) -> None:
    """Walks the object that has the member ``holds``, looking through any number of wrapping members (an object or JSON text), and
    calls ``enter[name](text, at)`` at each of its members named there, which gives the member's end; ``reset()`` tells that the
    members entered so far belong to a wrapper. The whole text is read on the way, once, but for what a wrapper holds; what can't be
    read raises ``Unreadable``."""
    if text is None:
        return
    t = text.lstrip("\ufeff \t\r\n")
    at, outer = 0, True
    while True:
        if t[at : at + 1] != "{":
            if outer and t and _space(t, pass_over(t, at)) != len(t):
                raise Unreadable("text after the end")
            return
        places: dict[str, int] = {}
        found = False
        for member in walk_object(t, at):
            name, start, end = member
            if name is None:
                if outer and _space(t, end) != len(t):
                    raise Unreadable("text after the end")
            elif name in enter:
                found |= name == holds
                member[2] = enter[name](t, start)
            elif name in wrappers:
                places[name] = start
        inner = next((places[w] for w in wrappers if w in places and t[places[w] : places[w] + 1] in ("{", '"')), None)
        if found:
            return
        reset()
        if inner is None:
            return
        at, outer = inner, False
        if t[at] == '"':
            t, at, outer = read_value(t, at)[0].lstrip("\ufeff \t\r\n"), 0, True


def text_of(value) -> str | None:
    """A leaf as text: strings as they are, numbers and booleans as JSON writes them, containers as JSON text."""
    if value is None or type(value) is str:
        return value
    return repr(value) if type(value) in (int, float) else json.dumps(value, ensure_ascii=False)


def _lead(groups: tuple[Group, ...], fields: tuple[str, ...]) -> dict:
    """Members that lead to a field or a group, as a tree: under None the group or True for a field."""
    root: dict = {}
    for path, end in [*((tuple(f.split(".")), True) for f in fields), *((g.path, g) for g in groups)]:
        node = root
        for name in path:
            node = node.setdefault(name, {})
        if end is True:
            node[True] = True
        else:
            node.setdefault(None, []).append(end)
    return root


class _Walk:
    """One text's triples."""

    def __init__(self, leads: dict[str, dict], ways: dict[str, list], found: list):
        self.leads, self.ways, self.found = leads, ways, found

    def members(self, t: str, at: int, node: dict, path: str, field: str, base: str, ordinals: tuple[int, ...], group: str | None) -> int:
        """The object at a place inside a record: fields become triples, groups are gone into, all else is passed over."""
        for member in walk_object(t, at):
            name, start, end = member
            if name is None:
                return end
            child = node.get(name)
            if child is None:
                continue
            here = f"{field}.{name}" if field else name
            groups = child.get(None)
            if groups:
                for g in groups:
                    member[2] = self.group(t, start, g, f"{base}.{here}" if base else here, ordinals)
            elif True in child:
                value, member[2] = read_value(t, start)
                if value is not None:
                    self.found.append((f"{path}.{here}", text_of(value), ordinals, group))
                continue
            if t[start : start + 1] == "{" and any(k not in (None, True) for k in child):
                member[2] = self.members(t, start, child, path, here, base, ordinals, group)
        raise Unreadable("no end")

    def group(self, t: str, at: int, g: Group, path: str, ordinals: tuple[int, ...]) -> int:
        """The value where a group's list should stand: a list, a single record, an object whose members are the records, or a
        plain value."""
        first = t[at : at + 1]
        if not g.groups:  # nothing is repeated below: the value is read as one piece
            value, end = read_value(t, at)
            if not (first in "{[" and isinstance(value, str)):
                self.leaves(value, g, path, ordinals)
            return end
        if first == "[":
            for item in walk_array(t, at):
                k, start, end = item
                if k is None:
                    return end
                item[2] = self.record(t, start, g, path, (*ordinals, k))
        if first == "{":
            inner: list[tuple[int, bool, str]] = []
            for name, start, end in walk_object(t, at):
                if name is not None:
                    inner.append((start, t[start : start + 1] in "{[n", name))
            if inner and g.repeated and not any(n in g.known for _, _, n in inner) and all(c for _, c, _ in inner):
                for k, (start, _, _) in enumerate(inner, 1):
                    self.record(t, start, g, path, (*ordinals, k))
                return end
        if first == "n":
            return read_value(t, at)[1]
        return self.record(t, at, g, path, (*ordinals, 1))

    def leaves(self, value, g: Group, path: str, ordinals: tuple[int, ...]) -> None:
        """As ``group``, for a value that is read already."""
        if isinstance(value, dict):
            plain = not g.repeated or not value or any(k in g.known for k in value) or not all(x is None or isinstance(x, (dict, list)) for x in value.values())
            value = [value] if plain else list(value.values())
        elif not isinstance(value, list):
            value = [value]
        for k, x in enumerate(value, 1):
            here = (*ordinals, k)
            if isinstance(x, dict):
                self.found.append((path, None, here, g.name))
                for name, way in self.ways[g.name]:
                    v = x
                    for w in way:
                        v = v.get(w) if isinstance(v, dict) else None
                    if v is not None:
                        self.found.append((f"{path}.{name}", text_of(v), here, g.name))
            elif g.scalar and x is not None and not isinstance(x, list):
                self.found.append((f"{path}.{g.scalar}", text_of(x), here, g.name))

    def record(self, t: str, at: int, g: Group, path: str, ordinals: tuple[int, ...]) -> int:
        if t[at : at + 1] == "{":
            self.found.append((path, None, ordinals, g.name))
            return self.members(t, at, self.leads[g.name], path, "", path, ordinals, g.name)
        value, end = read_value(t, at)
        if g.scalar and value is not None and not isinstance(value, (list, dict)):
            self.found.append((f"{path}.{g.scalar}", text_of(value), ordinals, g.name))
        return end


def triples(text: str | None, groups: tuple[Group, ...], holds: str, wrappers: tuple[str, ...] = ()) -> list[tuple[str, str | None, tuple[int, ...], str]]:
    """``(path, value, ordinals, group)`` in document order; the path leaves the ordinals out. A record without any field still
    gives one triple, with the group's own path and no value. A text that can't be read as a whole gives none."""
    leads: dict[str, dict] = {}
    ways: dict[str, list] = {}

    def learn(gs: tuple[Group, ...]) -> None:
        for g in gs:
            leads[g.name] = _lead(g.groups, g.fields)
            ways[g.name] = [(f, f.split(".")) for f in g.fields]
            learn(g.groups)

    learn(groups)
    found: list = []
    walk, lead = _Walk(leads, ways, found), _lead(groups, ())

    def entered(name: str, node: dict):
        def enter(t: str, at: int) -> int:
            end = None
            for g in node.get(None, ()):
                end = walk.group(t, at, g, name, ())
            if end is None and t[at : at + 1] == "{":
                end = walk.members(t, at, node, "", name, "", (), None)
            return pass_over(t, at) if end is None else end

        return enter

    try:
        roots(text, holds, wrappers, {holds: pass_over} | {n: entered(n, node) for n, node in lead.items() if n not in (None, True)}, found.clear)
    except Unreadable:
        return []
    return found


def pivot(found: Iterable[tuple[str, str | None, tuple[int, ...], str]], groups: tuple[Group, ...]) -> list[tuple[str, tuple[int, ...], dict[str, str]]]:
    """Triples gathered by group and ordinals: ``(group, ordinals, fields)``. Rows that lack what their group needs are left out."""
    need, prefix = {}, {}

    def learn(gs: tuple[Group, ...], at: str) -> None:
        for g in gs:
            prefix[g.name] = f"{at}.{'.'.join(g.path)}".lstrip(".")
            need[g.name] = g.need
            learn(g.groups, prefix[g.name])

    learn(groups, "")
    rows: dict[tuple[str, tuple[int, ...]], dict[str, str]] = {}
    for path, value, ordinals, name in found:
        row = rows.setdefault((name, ordinals), {})
        if value is not None:
            row[path[len(prefix[name]) + 1 :]] = value
    return [(name, o, row) for (name, o), row in rows.items() if need[name] is None or row.get(need[name], "").strip()]


def ancestors(text: str | None, holds: str, wrappers: tuple[str, ...]) -> set[tuple[str, str | None]]:
    """``(path, member)``: the paths at which a text has lists, with None, and the members of the records in them. Names only."""
    out: set[tuple[str, str | None]] = set()

    def enter(t: str, at: int) -> int:
        try:
            value, end = _PLAIN(t, at)
        except (StopIteration, ValueError):
            raise Unreadable("no value") from None
        except RecursionError:  # too deep a text isn't asked for its paths; it is still read
            return pass_over(t, at)
        stack = [(value, holds, False)]
        while stack:
            v, path, item = stack.pop()
            if isinstance(v, list):
                out.add((path, None))
                stack += [(x, path, True) for x in v if isinstance(x, (dict, list))]
            elif isinstance(v, dict):
                for k, x in v.items():
                    if item:
                        out.add((path, k))
                    if isinstance(x, (dict, list)):
                        stack.append((x, f"{path}.{k}", False))
        return end

    try:
        roots(text, holds, wrappers, {holds: enter})
    except Unreadable:
        return set()
    return out


#: A path or member counts if it stands in one text of so many: so what comes to the driver is at most this number times what a
#: text has of them.
SEEN_SHARE = 1000


def repeated(df: DataFrame, text: str, holds: str, wrappers: tuple[str, ...] = ()) -> dict[str, frozenset[str]]:
    """The repeated ancestors of all texts: path -> members of its records. Counted with map-side combining."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = Counter(x for t in b.column("text").to_pylist() for x in ancestors(t, holds, wrappers))
            counts[("", None)] += b.num_rows
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["path", "member", "n"])

    seen = spread(df.select(F.col(text).alias("text")).where("text is not null")).mapInArrow(run, "path string, member string, n bigint").groupBy("path", "member").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("path") == "", F.col("n"))).over(Window.partitionBy())
    kept = seen.withColumn("total", total).where((F.col("path") != "") & (F.col("n") * SEEN_SHARE >= F.col("total"))).select("path", "member").collect()
    return {p: frozenset(r[1] for r in kept if r[0] == p and r[1] is not None) for p in {r[0] for r in kept if r[1] is None}}


def grouped(found: dict[str, frozenset[str]], tables: dict[str, tuple[str, tuple[str, ...], str | None, str | None]]) -> tuple[Group, ...]:
    """Groups from the repeated ancestors. ``tables``: path -> name, fields, scalar and need of the tables asked for, of which each
    hangs on the nearest other one above it; one whose path is never a list has one record for each of its parent."""

    def below(parent: str) -> tuple[Group, ...]:
        inside = [p for p in tables if p != parent and (not parent or p.startswith(parent + "."))]
        out = []
        for p in sorted(inside, key=list(tables).index):
            if not any(q != p and p.startswith(q + ".") for q in inside):
                name, fields, scalar, need = tables[p]
                known = frozenset(found.get(p, ())) | {f.split(".")[0] for f in fields}
                out.append(Group(name, tuple(p[len(parent) + 1 if parent else 0 :].split(".")), fields, known, scalar, need, p in found, below(p)))
        return tuple(out)

    return below("")


def flatten(df: DataFrame, key: str | Column, text: str | Column, groups: tuple[Group, ...], holds: str, wrappers: tuple[str, ...] = ()) -> DataFrame:
    """All flat records of all texts: ``rec_id, kind, ordinals array<int>, fields map<string,string>``.

    ``ordinals`` has one position per repeated level down to the record; without its last item it is the parent's link. Texts
    that are null, blank, broken or hold something other than an object give no rows. Only ``key`` and ``text`` are read, so
    further columns may have any names; repeated rows give repeated records; a null key is kept. Texts may be nested to any depth.
    """
    schema = T.StructType([
        T.StructField("rec_id", df.select(key).schema[0].dataType),
        T.StructField("kind", T.StringType()),
        T.StructField("ordinals", T.ArrayType(T.IntegerType())),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs, kinds, ords, fields = [], [], [], []
            for rec, body in zip(batch["rec_id"].to_pylist(), batch["text"].to_pylist()):
                for name, o, row in pivot(triples(body, groups, holds, wrappers), groups):
                    recs.append(rec)
                    kinds.append(name)
                    ords.append(o)
                    fields.append(list(row.items()))
            types = (batch.schema.field("rec_id").type, pa.string(), pa.list_(pa.int32()), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((recs, kinds, ords, fields), types)], ["rec_id", "kind", "ordinals", "fields"])

    k = F.col(key) if isinstance(key, str) else key
    t = F.col(text) if isinstance(text, str) else text
    return spread(df.select(k.alias("rec_id"), t.alias("text")).where("text is not null")).mapInArrow(run, schema)


def table(flat: DataFrame, kind: str, levels: tuple[str, ...], columns: dict[str, str]) -> DataFrame:
    """One group's table: ``rec_id``, a position per level, and ``columns`` (column name -> field)."""
    return flat.where(F.col("kind") == kind).select(
        "rec_id",
        *(F.get("ordinals", F.lit(k)).alias(n) for k, n in enumerate(levels)),
        *(F.col("fields").getItem(f).alias(c) for c, f in columns.items()),
    )


TRACK_FIELDS = ("track", "title", "duration", "loudness.trackLUFS", "loudness.truePeakDbTP", "audio.path", "audio.sha256")

#: Tables of a manifest document: name, fields, the field that a plain value fills, and the field that must be there.
MANIFEST_TABLES = {
    "media": ("medium", ("disc", "format", "title"), None, None),
    "media.tracks": ("track", TRACK_FIELDS, None, None),
    "media.tracks.artists": ("artist", ("name", "role", "sortName", "musicbrainzId"), "name", "name"),
    "media.tracks.identifiers.isrc": ("isrc", ("code",), "code", "code"),
    "media.tracks.waveform": ("waveform", ("path", "version", "intervalMs", "encoding", "floorDb", "points"), None, "path"),
}
WRAPPERS = ("manifest", "document", "package", "payload", "data")


def pruned(groups: tuple[Group, ...], keep: dict[str, tuple[str, ...]]) -> tuple[Group, ...]:
    """Only the groups named in ``keep``, with the fields named there and those they need, and the groups above them; all else is
    passed over where the texts are read."""
    out = []
    for g in groups:
        below = pruned(g.groups, keep)
        if below or g.name in keep:
            wanted = {*keep.get(g.name, ()), g.need, g.scalar}
            out.append(replace(g, fields=tuple(f for f in g.fields if f in wanted), groups=below))
    return tuple(out)


#: Lists by the format and what it names in their records; all else is found in the texts.
STATED = {
    "media": frozenset({"disc", "format", "title", "tracks"}), "media.tracks": frozenset({"track", "title", "artists", "identifiers", "duration", "loudness", "audio", "waveform", "representations"}),
    "media.tracks.artists": frozenset({"name"}), "media.tracks.identifiers.isrc": frozenset(),
}
#: The groups as far as the format states them, for single texts; ``manifest_groups`` finds them in a table.
MANIFEST_GROUPS = grouped(STATED, MANIFEST_TABLES)


def manifest_groups(manifests: DataFrame) -> tuple[Group, ...]:
    """Groups of the manifest tables: the repeated ancestors and their records' members as all texts show them, with those that the
    format states."""
    found = repeated(manifests, "manifest", "media", WRAPPERS)
    return grouped({p: found.get(p, frozenset()) | STATED.get(p, frozenset()) for p in found.keys() | STATED.keys()}, MANIFEST_TABLES)


def flatten_manifests(manifests: DataFrame, keep: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``flatten`` over ``manifest_id, manifest``; ``keep`` names the tables and fields wanted (see ``pruned``), None all."""
    groups = manifest_groups(manifests)
    return flatten(manifests, "manifest_id", "manifest", groups if keep is None else pruned(groups, keep), "media", WRAPPERS)


def manifest_records(flat: DataFrame) -> DataFrame:
    """One row per flat record: ``manifest_id, media_pos, track_pos, kind, item_pos``; positions below the record's own level are 0."""
    pos = lambda k: F.coalesce(F.get("ordinals", F.lit(k)), F.lit(0))
    return flat.select(F.col("rec_id").alias("manifest_id"), pos(0).alias("media_pos"), pos(1).alias("track_pos"), "kind", pos(2).alias("item_pos"))
